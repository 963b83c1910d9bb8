"""Queries of the registry's build, of attributes with their fallbacks, and of the stream's log, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators import attributes, graph, reconcile
from ..storage import shared_folder, sized
from ..streaming import log, resolve
from . import jobs
from .minting_queries import _closed
from .queries import FAMILY, GROUP, LINEAGE, MODELS, models, nothing, query, sized_parts, t, walk_sql
from .reconcile_queries import _c

_BUILT = {
    "model": [
        ("lab/base-#", "lab;-;true;lab/base-#;-;lab;"), ("lab/base-#-2024-05-06", "lab;2024-05-06;true;lab/base-#;-;lab;lab/base-#"), ("ext#/fork-#", "ext#;-;-;ext#/fork-#;lab/base-#;lab;lab/base-#"),
        ("lab/v1.5-#", "lab;2023-01-01;false;lab/v1.5-#;-;lab;"), ("lab/kid-#", "lab;-;false;lab/v1.5-#;-;lab;lab/v1.5-#|lab/none-#"),
    ],
    "org": [("ext#", "ext#;community")],
    "benchmark": [("bench-#", "Bench #;b #")],
    "alias": [
        ("lab/base-#", "lab/base-#"), ("Base #", "lab/base-#"), ("b-#", "lab/base-#"), ("lab/base-#-2024-05-06", "lab/base-#-2024-05-06"), ("Dated #", "lab/base-#-2024-05-06"), ("ext#/fork-#", "ext#/fork-#"), ("Fork #", "ext#/fork-#"),
        ("lab/v1.5-#", "lab/v1.5-#"), ("Vee #", "lab/v1.5-#"), ("lab/v1-5-#", "lab/v1.5-#"), ("lab/kid-#", "lab/kid-#"), ("Kid #", "lab/kid-#"),
    ],
    "kept": [("b-#", "alias"), ("auto-#", "alias"), ("gone2-#", "entity"), ("ext#", "entity"), ("dr-#", "entity")],
    "check": [("edge to nothing", "lab/kid-#>lab/none-#"), ("claimed twice", "twice-#")],
}


@query(_closed(_BUILT) + " UNION ALL SELECT 'org', 'lab', 'Lab;lab'")
def built_registry(spark, d):
    """Every part: a lab's model, its snapshot, another's finetune, two spellings of one id, and a child of the losing one; an earlier seed to prune."""
    p = sized_parts(spark, d)
    k = F.col("p_partkey").cast("string")
    edge = lambda to, kind, axis=None: F.struct(to.alias("id"), F.lit(kind).alias("relationship"), F.lit(axis).cast("string").alias("axis"))
    e = lambda rank, id_, name, source, alias=(), parents=(), open_=None, status="draft": F.struct(F.lit(rank).alias("layer_rank"), id_.alias("id"), name.alias("display_name"), nothing().alias("org_id"), nothing().alias("release_date"), F.lit(open_).cast("boolean").alias("open_weights"), F.lit(source).alias("resolution_source"), F.lit(status).alias("review_status"), F.array(*alias).cast("array<string>").alias("aliases"), F.array(*parents).cast(reconcile.EDGES).alias("parents"))
    rows = [
        e(0, _c("lab/base-", k), _c("Base ", k), "curated", [_c("b-", k), _c("twice-", k)], open_=True, status="reviewed"), e(1, _c("lab/base-", k, "-2024-05-06"), _c("Dated ", k), "models_dev", parents=[edge(_c("lab/base-", k), "variant", "version")]),
        e(2, _c("ext", k, "/fork-", k), _c("Fork ", k), "hf", [_c("twice-", k)], [edge(_c("lab/base-", k), "finetune")]), e(0, _c("lab/v1.5-", k), _c("Vee ", k), "curated", open_=False), e(1, _c("lab/v1-5-", k), nothing(), "models_dev"),
        e(1, _c("lab/kid-", k), _c("Kid ", k), "models_dev", parents=[edge(_c("lab/v1-5-", k), "variant", "mode"), edge(_c("lab/none-", k), "finetune")]),
    ]
    several = lambda *x: sized(p.select(F.explode(F.array(*x)).alias("_x")).select("_x.*"))
    pair = lambda **x: F.struct(*((v if not isinstance(v, str) else F.lit(v)).alias(n) for n, v in x.items()))
    layers = several(*rows).withColumn("file", F.lit("f")).withColumn("pos", F.lit(0))
    weak = several(pair(id=_c("lab/v1-5-", k), release_date="2023-01-01"), pair(id=_c("lab/base-", k, "-2024-05-06"), release_date="2020-01-01")).select("*", F.lit(5).alias("layer_rank"), F.lit("w").alias("file"), F.lit(0).alias("pos"))
    org = "id string, hf_org string, display_name string, aliases array<string>, kind string, seq long"
    orgs = spark.createDataFrame([("lab", None, "generated", None, "unknown", 1)], org), spark.createDataFrame([("lab", None, "Lab", None, "lab", 1)], org)
    bench = p.select(_c("bench-", k).alias("id"), F.lit("generated").alias("display_name"), F.array().cast("array<string>").alias("aliases"), F.array().cast("array<string>").alias("explicit_keys"))
    stated = p.select(_c("bench-", k).alias("id"), _c("Bench ", k).alias("display_name"), F.array(_c("b ", k)).alias("aliases"), F.array(F.lit("display_name")).alias("explicit_keys"))
    old = several(*(pair(id=_c(raw, k), raw_value=_c(raw, k), canonical_id=_c(to, k), strategy=how) for raw, to, how in (("old-", "lab/base-", "seed"), ("b-", "lab/base-", "seed"), ("auto-", "gone2-", "auto"))))
    known = several(*(pair(entity_type=kind, id=_c(id_, k), review_status=status) for kind, id_, status in (("model", "gone-", "reviewed"), ("model", "gone2-", "reviewed"), ("org", "ext", "reviewed"), ("model", "dr-", "draft"))))
    before = {"aliases": old.select("*", F.lit("model").alias("entity_type"), nothing().alias("source_config")), "entities": known}
    org_map = spark.createDataFrame([("lab", "lab")], "name string, org string")
    out = jobs.build_registry(layers, org_map, ["display_name", "org_id", "release_date", "open_weights", "resolution_source", "review_status"], ["aliases"], orgs, (bench, stated), before=before, weak=weak, weak_fields=["release_date"])
    dash = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    facts = [dash(c) for c in ("org_id", "release_date", "open_weights", "model_group_id", "lineage_origin_model_id", "lineage_origin_model_org_id")]
    say = lambda df, kind, a, b: df.select(F.lit(kind).alias("kind"), F.col(a).alias("a"), b.alias("b"))
    parts = [
        say(out["models"], "model", "id", F.concat_ws(";", *facts, F.array_join(F.transform("parents", lambda x: x["id"]), "|"))), say(out["orgs"], "org", "id", F.concat_ws(";", "display_name", "kind")), say(out["benchmarks"], "benchmark", "id", F.concat_ws(";", "display_name", F.array_join("aliases", "|"))),
        say(out["aliases"].where("entity_type = 'model'"), "alias", "raw_value", F.col("canonical_id")), say(out["kept_aliases"], "kept", "raw_value", F.lit("alias")), say(out["entities"], "kept", "id", F.lit("entity")), say(out["checks"], "check", "check", F.col("offender")),
    ]
    return reduce(DataFrame.unionByName, parts)


_SPACED = MODELS.replace("CASE WHEN p_size % 4 <> 0 THEN p_type END AS org_id", "CASE WHEN p_size % 4 <> 0 THEN p_type WHEN p_partkey % 3 = 0 THEN CASE WHEN p_brand = 'Brand#11' THEN 'eleven' ELSE p_brand END END AS org_id")


@query(rf"""WITH RECURSIVE {_SPACED}, {walk_sql("g", GROUP, True)}, {walk_sql("f", FAMILY, True)}, {walk_sql("l", LINEAGE, False)}, {walk_sql("i", "c.relationship IN ('variant', 'quantized')", False)},
    v AS (SELECT w.id, arg_min(m.open_weights, w.depth) FILTER (m.open_weights IS NOT NULL) AS open_weights, arg_min(m.n, w.depth) FILTER (m.n IS NOT NULL) AS size FROM i_walk w JOIN (SELECT 'm' || p_partkey AS id, CASE WHEN p_partkey % 6 = 1 THEN p_size > 20 END AS open_weights, CASE WHEN p_partkey % 5 = 2 THEN p_size END AS n FROM part) m ON m.id = w.place GROUP BY w.id),
    spelled AS (SELECT 'm' || p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_brand || '/' || p_partkey ELSE 'm' || p_partkey || CASE WHEN p_partkey % 3 = 1 THEN '-2024-0' || (p_size % 10) ELSE '' END END AS name, p_partkey % 4 = 0 AS dated FROM part)
    SELECT a.name AS id, m.org_id, CASE WHEN a.dated THEN '2020-02-02' WHEN a.name LIKE '%-2024-0%' AND right(a.name, 1) <> '0' THEN right(a.name, 7) || '-01' END AS release_date, v.open_weights, v.size,
        m.org_id IS NULL AS tagged, b.name AS model_group_id, c.name AS model_family_id, nullif(o.name, a.name) AS lineage_origin_model_id
    FROM model m JOIN spelled a USING (id) JOIN g USING (id) JOIN f USING (id) JOIN l USING (id) JOIN v USING (id) JOIN spelled b ON b.id = g.root JOIN spelled c ON c.id = f.root JOIN spelled o ON o.id = l.root""")
def settled_attributes(spark, d):
    """Models of which a third are named in their brand's namespace and a third by a month; two attributes share one walk."""
    p = t(spark, d, "part")
    n = F.col("p_partkey")
    name = F.when(n % 3 == 0, F.concat("p_brand", F.lit("/"), n)).when(n % 3 == 1, F.concat(F.lit("m"), n, F.lit("-2024-0"), F.col("p_size") % 10)).otherwise(F.concat(F.lit("m"), n))
    spelled = p.select(F.concat(F.lit("m"), n).alias("id"), name.alias("name"), F.when(n % 4 == 0, "2020-02-02").otherwise(" ").alias("release_date"), F.when(n % 5 == 2, F.col("p_size")).alias("size"))
    parents = spelled.select(F.col("id").alias("_p"), F.col("name").alias("_up"))
    m = models(spark, d).join(spelled, "id").withColumn("_e", F.get("parents", F.lit(0))).withColumn("_p", F.col("_e.id")).join(parents, "_p", "left")
    edge = F.array(F.struct(F.col("_up").alias("id"), F.col("_e.relationship").alias("relationship"), F.col("_e.axis").alias("axis")))
    rows = m.select(F.col("name").alias("id"), "org_id", F.when(F.col("_up").isNotNull(), edge).alias("parents"), "open_weights", "release_date", "size", F.when(F.col("org_id").isNotNull(), F.array(F.lit(attributes.NO_ORG_TAG))).alias("tags"))
    out = attributes.derive(rows, spark.createDataFrame([("brand#11", "eleven")], "name string, org string"), inherited=("open_weights", "size"))["models"]
    return out.select("id", "org_id", "release_date", "open_weights", "size", F.coalesce(F.array_contains("tags", attributes.NO_ORG_TAG), F.lit(False)).alias("tagged"), "model_group_id", "model_family_id", "lineage_origin_model_id")


@query("""WITH u AS (SELECT user_id AS u, count(*) AS requests FROM events GROUP BY 1)
    SELECT 'U' || u AS raw_value, requests, CASE WHEN u % 5 <> 4 THEN 'u-' || u END AS canonical_id, CASE WHEN u % 5 <> 4 THEN 'normalized' ELSE 'no_match' END AS strategy, CASE WHEN u % 5 = 4 THEN NULL WHEN u % 3 = 0 THEN 'F' || (u % 10) WHEN u % 3 = 1 AND u - 1 IN (SELECT u FROM u) THEN 'u-' || (u - 1) ELSE 'u-' || u END AS family_id,
        CASE WHEN u % 5 <> 4 AND u % 3 = 0 AND u % 10 < 5 THEN 'C' || (u % 10) END AS composite_id, CASE WHEN u % 5 <> 4 THEN CASE WHEN u % 3 = 1 THEN 'slice' ELSE 'benchmark' END END AS level, CASE WHEN u % 5 <> 4 AND u % 3 = 1 THEN 'U' || u END AS matched_subset,
        CASE WHEN u % 5 <> 4 THEN concat_ws('|', CASE WHEN u % 3 = 0 THEN 'F' || (u % 10) || ':family' WHEN u % 3 = 1 AND u - 1 IN (SELECT u FROM u) THEN 'u-' || (u - 1) || ':family' END, CASE WHEN u % 3 = 0 AND u % 10 < 5 THEN 'C' || (u % 10) || ':composite' END) END AS above FROM u""")
def stream_log(spark, d):
    """Users as benchmarks, a third of them slices of the one before: what a stream over the events logs, its only batch written twice."""
    ev = t(spark, d, "events")
    u = F.col("user_id")
    known = ev.select("user_id").distinct().select("user_id", F.concat(F.lit("u-"), "user_id").alias("id"), F.when(u % 3 == 1, F.concat(F.lit("u-"), u - 1)).alias("parent_benchmark_id"))
    alias = known.where(u % 5 != 4).select(F.concat(F.lit("u"), "user_id").alias("raw_value"), F.lit("benchmark").alias("entity_type"), nothing().alias("source_config"), F.col("id").alias("canonical_id"), F.lit("auto").alias("status"), F.lit(1).alias("seq"))
    families = known.where(u % 3 == 0).groupBy((u % 10).alias("seq")).agg(F.collect_list("id").alias("benchmark_ids")).select(F.concat(F.lit("F"), "seq").alias("id"), "seq", "benchmark_ids")
    composites = families.where("seq < 5").select(F.concat(F.lit("C"), "seq").alias("id"), F.col("id").alias("family_id"))
    levels = {"families": families, "roots": graph.benchmark_family(known, families), "composites": composites, "parents": known}
    said = lambda df: df.select("event_id", F.concat(F.lit("U"), "user_id").alias("raw_value"), F.lit("benchmark").alias("entity_type"), nothing().alias("source_config"))
    root = shared_folder(spark, "stream")
    stream = spark.readStream.schema(ev.schema).parquet(f"{d}/events*.parquet")
    resolve.resolve_stream(said(stream), alias, f"{root}/out", f"{root}/state", f"{root}/log", trigger={"availableNow": True}, levels=levels).awaitTermination()
    resolve.batch_writer(alias, f"{root}/out", f"{root}/state", f"{root}/log", levels)(said(ev), 0)
    above = F.array_join(F.transform("ancestry", lambda x: F.concat_ws(":", x["canonical_id"], x["level"])), "|")
    return log.read_log(spark, f"{root}/log").select("raw_value", "requests", "canonical_id", "strategy", "family_id", "composite_id", "resolution_detail.level", "resolution_detail.matched_subset", above.alias("above"))
