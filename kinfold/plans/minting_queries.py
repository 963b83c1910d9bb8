"""Queries of drafts with what hangs on them, and of seeding by rank, with their SQL. Every part gives one case of each rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators import minting
from ..storage import sized
from .queries import nothing, query, sized_parts
from .reconcile_queries import _c, _joined

_MINTED = {
    "draft": [
        ("repo#/new-Model", "repo#;reviewed;hf;;lab/llama-#:quantized;2024-05-05"), ("lab/known#-2025-01-15", "lab;draft;inferred;;lab/known#:variant;-"), ("fresh#/llama-#-tuned", "fresh#;draft;inferred;;lab/llama-#:finetune;-"),
        ("unknown/thing#", "-;draft;inferred;org-unknown;;-"), ("Att#/M", "lab;reviewed;hf;;;-"), ("plain-#", "-;draft;-;;;-"), ("repo#", "-;reviewed;-;;;-"), ("fresh#", "-;draft;-;;;-"),
    ],
    "kind": [("repo#", "community"), ("fresh#", "unknown")],
    "alias": [
        ("Repo#/New-Model", "repo#/new-Model;uncertain"), ("REPO#/new-model", "repo#/new-Model;uncertain"), ("lab/known#-2025-01-15", "lab/known#-2025-01-15;uncertain"), ("fresh#/llama-#-tuned", "fresh#/llama-#-tuned;uncertain"), ("fresh#", "fresh#;uncertain"),
        ("unknown/thing#", "unknown/thing#;uncertain"), ("att#/m", "Att#/M;auto"), ("case#/m", "case#/M;auto"), ("Plain #", "plain-#;uncertain"), ("plain_#", "plain-#;uncertain"),
    ],
}


def _closed(table: dict[str, list[tuple[str, str]]]) -> str:
    say = lambda x: "'" + x.replace("#", "' || k || '") + "'"
    return "WITH u AS (SELECT p_partkey AS k FROM part) " + " UNION ALL ".join(f"SELECT '{kind}' AS kind, {say(a)} AS a, {say(b)} AS b FROM u" for kind, rows in table.items() for a, b in rows)


@query(_closed(_MINTED))
def minted_dependents(spark, d):
    p = sized_parts(spark, d)
    k = F.col("p_partkey").cast("string")
    rows = [("model", _c("Repo", k, "/New-Model")), ("model", _c("REPO", k, "/new-model")), ("model", _c("lab/known", k, "-2025-01-15")), ("model", _c("fresh", k, "/llama-", k, "-tuned")), ("model", _c("unknown/thing", k)), ("model", _c("att", k, "/m"), _c("Att", k, "/M")), ("model", _c("case", k, "/m"), _c("Case", k, "/m")), ("benchmark", _c("Plain ", k)), ("benchmark", _c("plain_", k)), ("family", _c("fam ", k))]
    struct = lambda kind, raw, att=None: F.struct(raw.alias("raw_value"), F.lit(kind).alias("entity_type"), (nothing() if att is None else att).alias("attested_id"))
    unmatched = sized(p.select(F.explode(F.array(*(struct(*r) for r in rows))).alias("_x")).select("_x.*", nothing().alias("source_config")), "unmatched")
    entities = p.select(F.explode(F.array(*(_c(a, k, b) for a, b in (("lab/known", ""), ("lab/llama-", ""), ("case", "/M"))))).alias("id"), F.lit("model").alias("entity_type")).unionByName(spark.sql("select 'lab' as id, 'org' as entity_type"))
    entities = sized(entities, "entities")
    forms = F.array(*(F.struct(raw.alias("raw_value"), id_.alias("canonical_id")) for raw, id_ in ((_c("lab/known", k), _c("lab/known", k)), (_c("llama-", k), _c("lab/llama-", k)), (_c("lab/llama-", k), _c("lab/llama-", k)))))
    alias = p.select(F.explode(forms).alias("_x")).select("_x.*", F.lit("model").alias("entity_type")).unionByName(spark.sql("select 'lab' as raw_value, 'lab' as canonical_id, 'org' as entity_type"))
    alias = sized(alias.select("*", nothing().alias("source_config"), F.lit("auto").alias("status"), F.lit(1).alias("seq")), "alias")
    external = p.select(_c("repo", k, "/new-Model").alias("id"), F.lit("2024-05-05").alias("release_date"), F.lit(7.0).alias("params_billions"), F.lit(True).alias("open_weights"), F.lit("quantized").alias("relation"), F.array(_c("LAB/llama_", k), F.lit("no/such")).alias("base_models"))
    org_map = p.select(_c("att", k).alias("name"), F.lit("lab").alias("org"))
    out = minting.mint_dependents(unmatched, entities, alias, external, org_map)
    dash = lambda c: F.coalesce(c, F.lit("-"))
    edges = F.array_join(F.transform("parents", lambda e: F.concat_ws(":", e["id"], e["relationship"])), "|")
    drafts = out["drafts"]
    parts = [
        drafts.select(F.lit("draft").alias("kind"), F.col("id").alias("a"), F.concat_ws(";", dash("org_id"), "review_status", dash("resolution_source"), _joined("tags"), edges, dash("release_date")).alias("b")),
        drafts.where("kind is not null").select(F.lit("kind").alias("kind"), F.col("id").alias("a"), F.col("kind").alias("b")), out["aliases"].select(F.lit("alias").alias("kind"), F.col("raw_value").alias("a"), F.concat_ws(";", "canonical_id", "status").alias("b")),
    ]
    return reduce(DataFrame.unionByName, parts)


_SEEDED = {
    "alias": [
        ("lab/m-#", "lab/m-#"), ("Lab M #", "lab/m-#"), ("m-#", "lab/m-#"), ("fork/m-#", "fork/m-#"), ("draft/r-#", "draft/r-#"), ("real/r-#", "real/r-#"), ("R #", "real/r-#"), ("lab2/m-#", "lab2/m-#"), ("M #", "lab2/m-#"),
        ("lab/m-#-mint", "lab/m-#-mint"), ("mint-#", "lab/m-#-mint"), ("bench-#", "bench-#"), ("Bench #", "bench-#"), ("own-#@cfg", "fork/m-#"),
    ],
    "claim": [("twice-#", "fork/m-#|real/r-#")],
    "redirected": [("m-#", "fork/m-#;lab/m-#"), ("R #", "draft/r-#;real/r-#"), ("m-#", "lab/m-#-mint;lab/m-#")],
    "shadowed": [("Lab M #", "fork/m-#")],
    "change": [("m-#", "repoint;fork/m-#"), ("Lab M #", "insert;-")],
}


@query(_closed(_SEEDED))
def seeded_by_rank(spark, d):
    """A lab's model, a fork with its name, a draft of a real repo's name, another lab's, the lab's own mint, a benchmark; a form that two claim."""
    p = sized_parts(spark, d)
    k = F.col("p_partkey").cast("string")
    e = lambda id_, name, org, *alias, kind="model", source="models_dev", status="draft", seq=1: F.struct(F.lit(kind).alias("entity_type"), id_.alias("id"), name.alias("display_name"), F.array(*alias).cast("array<string>").alias("aliases"), F.lit(org).cast("string").alias("org_id"), F.lit(source).alias("resolution_source"), F.lit(status).alias("review_status"), F.lit(seq).cast("long").alias("seq"))
    rows = [
        e(_c("lab/m-", k), _c("Lab M ", k), "lab", status="reviewed", seq=1), e(_c("fork/m-", k), _c("Lab M ", k), None, _c("m-", k), _c("twice-", k), source="hf", seq=2), e(_c("draft/r-", k), _c("R ", k), "draft", seq=3),
        e(_c("real/r-", k), _c("R ", k), "real", _c("twice-", k), source="hf", seq=4), e(_c("lab2/m-", k), _c("M ", k), "lab2", status="reviewed", seq=5), e(_c("lab/m-", k, "-mint"), _c("mint-", k), None, _c("m-", k), seq=6), e(_c("bench-", k), _c("Bench ", k), None, kind="benchmark", seq=7),
    ]
    entities = sized(p.select(F.explode(F.array(*rows)).alias("_x")).select("_x.*"), "entities")
    orgs = spark.createDataFrame([("lab", None, "Lab", None, "lab", 1), ("lab2", None, "Lab 2", None, "lab", 2), ("fork", None, "Fork", None, "community", 3)], "id string, hf_org string, display_name string, aliases array<string>, kind string, seq long")
    scoped = p.select(F.lit("model").alias("entity_type"), _c("fork/m-", k).alias("id"), _c("own-", k).alias("raw_value"), F.lit("cfg").alias("source_config"))
    stored_ = p.select(F.explode(F.array(F.struct(_c("m-", k).alias("raw_value"), _c("fork/m-", k).alias("canonical_id"), F.lit("confirmed").alias("status")), F.struct(_c("Lab M ", k).alias("raw_value"), _c("fork/m-", k).alias("canonical_id"), F.lit("rejected").alias("status")))).alias("_x")).select("_x.*", F.lit("model").alias("entity_type"), nothing().alias("source_config"))
    stored_ = sized(stored_, "known")
    out = minting.seed_by_rank(entities, orgs, spark.createDataFrame([], "name string, org string"), scoped, stored_)
    changes = out["changes"].where("raw_value like 'm-%' or raw_value like 'Lab M%'")
    parts = [
        out["aliases"].select(F.lit("alias").alias("kind"), F.concat_ws("@", "raw_value", "source_config").alias("a"), F.col("canonical_id").alias("b")), out["claims"].select(F.lit("claim").alias("kind"), F.col("raw_value").alias("a"), F.array_join("owners", "|").alias("b")),
        out["redirected"].select(F.lit("redirected").alias("kind"), F.col("raw_value").alias("a"), F.concat_ws(";", "declared_by", "canonical_id").alias("b")), out["shadowed"].select(F.lit("shadowed").alias("kind"), F.col("raw_value").alias("a"), F.col("declared_by").alias("b")),
        changes.select(F.lit("change").alias("kind"), F.col("raw_value").alias("a"), F.concat_ws(";", "change", F.coalesce("before", F.lit("-"))).alias("b")),
    ]
    return reduce(DataFrame.unionByName, parts)
