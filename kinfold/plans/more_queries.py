"""Further registry queries: checks, enrichment, catalogue work and whole jobs, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import keys
from ..operators import catalogue, checks, facts, graph, match, merge, reconcile
from ..sources import registry
from ..storage import shared_folder, stored
from . import jobs
from .queries import ALIASES, CATALOGUE, FAMILY, GROUP, LINEAGE, MODELS, RESOLVED, RULES, aliases, catalogue_rows, mentions, models, nothing, org_tables, query, t, walk_sql


def counted(found: list[tuple[str, DataFrame]]) -> DataFrame:
    """(problem, n): how many rows each check returns."""
    return reduce(DataFrame.unionByName, (bad.agg(F.lit(name).alias("problem"), F.count("*").alias("n")) for name, bad in found))


def dashed(c: str, to: str = "-"):
    return F.replace(c, F.lit(" "), F.lit(to))


# --- matching and its results ---------------------------------------------------------------------------------


@query(f"""WITH {RESOLVED} SELECT a.p_partkey, a.canonical_id, p.p_type AS type, p.p_retailprice AS price FROM answer a LEFT JOIN part p ON a.canonical_id = 'p-' || p.p_partkey OR a.canonical_id = 'b-' || p.p_partkey""")
def enriched_mentions(spark, d):
    p = t(spark, d, "part")
    entities = p.select(F.explode(F.array(F.concat(F.lit("p-"), "p_partkey"), F.concat(F.lit("b-"), "p_partkey"))).alias("id"), F.lit("model").alias("entity_type"), F.col("p_type").alias("type"), F.col("p_retailprice").alias("price"))
    org_map, orgs = org_tables(spark, d)
    out = jobs.resolve_mentions(mentions(spark, d), aliases(spark, d), entities, ["type", "price"], rules=RULES, org_map=org_map, known_orgs=orgs)
    return out.select("p_partkey", "canonical_id", "type", "price")


@query("""WITH b AS (SELECT p_partkey, p_name AS raw_value, CASE WHEN p_size % 2 = 0 THEN upper(p_name) ELSE p_type END AS canonical_id, CASE p_size % 3 WHEN 0 THEN NULL WHEN 1 THEN p_brand ELSE CASE WHEN p_size % 2 = 0 THEN upper(p_name) ELSE p_type END END AS parent FROM part)
    SELECT p_partkey, CASE WHEN parent <> canonical_id THEN 'slice' ELSE 'benchmark' END AS level, CASE WHEN parent <> canonical_id AND lower(raw_value) <> lower(canonical_id) THEN raw_value END AS matched_subset, NULL::VARCHAR AS strategy FROM b""")
def result_detail(spark, d):
    id_ = F.when(F.col("p_size") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_type"))
    parent = F.when(F.col("p_size") % 3 == 1, F.col("p_brand")).when(F.col("p_size") % 3 == 2, id_)
    hits = t(spark, d, "part").select("p_partkey", F.col("p_name").alias("raw_value"), id_.alias("canonical_id"), parent.alias("parent_benchmark_id"), F.array("p_partkey").alias("ancestry"))
    out = match.lean(match.with_detail(hits).withColumn("source_config", F.col("p_partkey")))
    return out.select(F.col("source_config").alias("p_partkey"), "resolution_detail.level", "resolution_detail.matched_subset", "strategy")


@query("""WITH a AS (SELECT DISTINCT p_name AS n FROM part) SELECT p_partkey, n AS stem_id FROM part LEFT JOIN a ON n = p_name AND p_partkey % 3 <> 2""")
def benchmark_stems(spark, d):
    """Names with run configs around them: cot in front, a shot count behind, or both words glued to the name (no stem)."""
    p = t(spark, d, "part")
    n = F.col("p_partkey") % 3
    raw = F.when(n == 0, F.concat(F.lit("cot "), "p_name")).when(n == 1, F.concat("p_name", F.lit(" zeroshot"))).otherwise(F.concat(F.lit("cot"), "p_name"))
    m = p.select("p_partkey", raw.alias("raw_value"), F.lit("benchmark").alias("entity_type"), nothing().alias("source_config"))
    al = p.select(F.col("p_name").alias("raw_value")).distinct().select("raw_value", F.lit("benchmark").alias("entity_type"), nothing().alias("source_config"), F.col("raw_value").alias("canonical_id"), F.lit("auto").alias("status"), F.lit(1).alias("seq"))
    return match.resolve(m, al, rules=RULES).select("p_partkey", F.col("canonical_id").alias("stem_id"))


@query("""SELECT p_partkey, (SELECT min(p_name) FROM part q WHERE q.p_name = p.p_name AND q.p_size > 25) AS id FROM part p WHERE EXISTS (SELECT 1 FROM part q WHERE q.p_name = p.p_name AND q.p_size > 25)""")
def case_lookups(spark, d):
    p = t(spark, d, "part")
    names = p.select("p_partkey", F.upper("p_name").alias("raw_value"))
    return names.join(match.case_variants(names, p.where("p_size > 25").select(F.col("p_name").alias("id"))), "raw_value").select("p_partkey", "id")


@query("""WITH g AS (SELECT p_partkey AS id, p_type AS org, replace(p_name, ' ', '-') AS plain FROM part), real AS (SELECT DISTINCT p_type AS org, p_name AS k, p_type || '/' || upper(replace(p_name, ' ', '_')) AS fixed FROM part WHERE p_size > 20),
    hit AS (SELECT id, fixed FROM g JOIN real ON real.org = g.org AND replace(plain, '-', ' ') = k WHERE id % 4 <> 3) SELECT id, fixed AS target FROM hit""")
def deferred_groups(spark, d):
    """A fourth of the groups have no org; others carry the org's name in front of theirs, or a longer form beside."""
    p = t(spark, d, "part")
    n = F.col("p_partkey") % 4
    plain = dashed("p_name")
    form = F.when(n == 1, F.concat_ws("-", F.lower("p_type"), plain)).otherwise(F.concat(F.lit("host/"), plain))
    groups = p.select(F.col("p_partkey").cast("string").alias("id"), F.when(n != 3, F.col("p_type")).alias("org"), F.array(form, F.concat(plain, F.lit("-extra"))).alias("forms"))
    truth = p.select(F.concat_ws("/", "p_type", F.upper(dashed("p_name", "_"))).alias("fixed_id"), F.when(F.col("p_size") > 20, "fixed_exact").otherwise("open").alias("status"), F.col("p_partkey").alias("seq"))
    org_map = match.build_org_map(p.select(F.col("p_type").alias("id"), nothing().alias("hf_org")).distinct())
    return match.defer_targets(groups, truth, org_map).select(F.col("id").cast("long").alias("id"), "target")


@query("""SELECT p_partkey AS id, p_brand AS org_id, CASE WHEN p_brand IN (SELECT p_brand FROM part WHERE p_size > 48) THEN 'Name of ' || p_brand END AS developer FROM part""")
def developers(spark, d):
    p = t(spark, d, "part")
    orgs = p.where("p_size > 48").select(F.col("p_brand").alias("id"), F.concat(F.lit("Name of "), "p_brand").alias("display_name")).distinct()
    return facts.with_developer(p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("org_id")), orgs)


@query(f"""WITH {ALIASES} SELECT raw_value, canonical_id FROM live WHERE source_config IS NULL OR source_config = 'Brand#2'""")
def alias_listing(spark, d):
    return facts.alias_pairs(aliases(spark, d), "model", "Brand#2")


@query("""SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'O'""")
def facts_listing(spark, d):
    rows = t(spark, d, "lineitem").select(F.col("l_returnflag").alias("model_id"), F.col("l_linestatus").alias("benchmark_id"), "l_orderkey", "l_linenumber", "l_quantity")
    return facts.facts_of(rows, "R", "O").select("l_orderkey", "l_linenumber", "l_quantity")


@query("""SELECT count(*) AS n, count(DISTINCT o_orderkey) AS distinct_keys FROM (SELECT * FROM orders LIMIT 500)""")
def hashed_sample(spark, d):
    o = t(spark, d, "orders")
    twice = facts.hash_sample(o, ["o_orderkey"], 500).select("o_orderkey", "o_custkey")
    same = twice.join(facts.hash_sample(o.repartition(3), ["o_orderkey"], 500).select("o_orderkey"), "o_orderkey")
    return same.agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("distinct_keys"))


# --- merging and catalogue ------------------------------------------------------------------------------------


@query("""SELECT p_partkey, string_agg(f, '|' ORDER BY f) AS forms FROM (SELECT DISTINCT p_partkey, unnest(['Host/' || p_name, 'host/' || p_name, replace(p_name, ' ', '-'), p_brand || '/' || replace(p_name, ' ', '-')]) AS f FROM part) GROUP BY p_partkey""")
def surface_spellings(spark, d):
    raw = F.concat(F.lit("Host/"), "p_name")
    return t(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(keys.surface_forms(raw, keys.catalogue_name(raw), F.col("p_brand"))), "|").alias("forms"))


@query("""SELECT p_partkey AS id, array_to_string(list_sort(list_distinct([p_type, p_brand, p_name])), '|') AS aliases, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS known FROM part""")
def provenance_maps(spark, d):
    p = t(spark, d, "part")
    sources = F.map_from_arrays(F.array("p_brand", "p_name", F.col("p_partkey").cast("string")), F.array(F.when(F.col("p_size") % 2 == 0, F.lit("host")), nothing(), nothing()))
    out = catalogue.flatten_provenance(p.select(F.col("p_partkey").cast("string").alias("id"), F.array("p_type").alias("aliases"), sources.alias("alias_platforms")))
    return out.select(F.col("id").cast("long").alias("id"), F.array_join(F.array_sort("aliases"), "|").alias("aliases"), F.size("provenance").alias("known"))


@query("""SELECT DISTINCT 'x/' || replace(p_name, ' ', '-') AS id, p_name IN (SELECT p_name FROM part WHERE p_size > 45) AS external_key FROM part""")
def external_tags(spark, d):
    p = t(spark, d, "part")
    entries = p.select(F.concat(F.lit("x/"), dashed("p_name")).alias("id")).distinct()
    return catalogue.tag_external(entries, p.where("p_size > 45").select(F.concat(F.lit("us.meta."), dashed("p_name", "_"), F.lit(":free")).alias("key")))


@query("""WITH f AS (SELECT DISTINCT p_type AS org, replace(p_name, ' ', '-') AS id FROM part WHERE p_type <> 'none'), old AS (SELECT DISTINCT p_type AS org, p_type || '/' || replace(p_name, ' ', '_') AS id, replace(p_name, ' ', '-') AS n FROM part WHERE p_size > 25)
    SELECT f.org || ':' || f.id AS id, old.id AS target, CASE WHEN old.id IS NULL THEN 'minted' ELSE 'enriched' END AS kind FROM f LEFT JOIN old ON old.org = f.org AND old.n = f.id""")
def catalogue_split(spark, d):
    p = t(spark, d, "part")
    fresh = p.select(F.col("p_type").alias("org"), dashed("p_name").alias("n")).distinct().select(F.concat_ws(":", "org", "n").alias("id"), "org", F.array(F.concat(F.lit("host/"), "n")).alias("forms"))
    old = p.where("p_size > 25").select(F.concat_ws("/", "p_type", dashed("p_name", "_")).alias("id"), F.col("p_type").alias("org")).distinct().select("id", "org", F.array().cast("array<string>").alias("aliases"), F.lit(1).alias("seq"))
    minted, enriched = catalogue.split_catalogue(fresh, old, org_tables(spark, d)[0])
    gains = enriched.select(F.explode("aliases").alias("_a"), F.col("id").alias("target")).where("not startswith(_a, 'host/')").select(F.col("_a").alias("id"), "target", F.lit("enriched").alias("kind"))
    return minted.select("id", nothing().alias("target"), F.lit("minted").alias("kind")).unionByName(gains)


@query("""WITH e AS (SELECT p_partkey AS id, p_size FROM part) SELECT 'e' || id AS id, CASE WHEN id % 10 = 0 THEN 2 ELSE 1 END AS aliases FROM e WHERE id % 10 <> 1 OR id + 0 = (SELECT max(id) FROM e) + 1""")
def curated_folds(spark, d):
    """Every id that ends in 1 folds onto the one before it; folds of other ids are proposed, but not confirmed."""
    p = t(spark, d, "part").select(F.col("p_partkey").alias("k"))
    e = lambda c: F.concat(F.lit("e"), c)
    entries = p.select(e("k").alias("id"), F.array(e("k")).alias("aliases"))
    folds = p.where("k > 0").select(e("k").alias("id"), e(F.col("k") - 1).alias("target"), F.lit("name").alias("match_type"))
    out, _ = reconcile.apply_folds(entries, folds, p.where("k % 10 = 1").select(e("k").alias("id")))
    return out.select("id", F.size("aliases").alias("aliases"))


@query("""SELECT p_partkey AS id, 'entity' AS kind FROM part WHERE NOT (p_size > 20 AND p_partkey % 3 = 0) UNION ALL SELECT p_partkey, 'alias' FROM part WHERE NOT (p_size > 20 AND p_partkey % 3 = 0)""")
def clean_universe(spark, d):
    p = t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 20, "inferred").otherwise("curated").alias("resolution_source"))
    kept, al = merge.without_own_output(p, p.select(F.col("id").alias("canonical_id")), p.where("id % 3 = 0").select("id"))
    return kept.select("id", F.lit("entity").alias("kind")).unionByName(al.select(F.col("canonical_id").alias("id"), F.lit("alias").alias("kind")))


@query(f"""WITH {MODELS} SELECT id, CASE WHEN relationship = 'variant' THEN parent END AS parent_canonical_id FROM model""")
def variant_parents(spark, d):
    return graph.immediate_parent(models(spark, d)).select("id", "parent_canonical_id")


@query("""SELECT p_partkey AS id, CASE WHEN p_size > 25 THEN p_brand ELSE p_type END AS name FROM part""")
def whole_replacement(spark, d):
    p = t(spark, d, "part")
    row = lambda df, c: df.select(F.col("p_partkey").alias("id"), F.col(c).alias("name"))
    return merge.replace_whole(row(p, "p_type"), row(p.where("p_size > 25"), "p_brand"))


@query("""WITH l AS (SELECT p_name, p_type, CASE WHEN p_size % 2 = 0 THEN 'variant' WHEN p_size % 2 = 1 AND p_size % 5 = 0 THEN 'finetune' END AS relationship, CASE WHEN p_size % 3 = 1 THEN p_brand END AS axis, row_number() OVER (PARTITION BY p_name ORDER BY p_size % 3, p_brand, p_partkey) AS o FROM part),
    e AS (SELECT p_name AS id, p_type AS parent, arg_max(relationship, o) FILTER (relationship IS NOT NULL) AS relationship, arg_max(axis, o) FILTER (axis IS NOT NULL) AS axis, min(o) AS o FROM l GROUP BY ALL)
    SELECT id, parent, relationship, axis, row_number() OVER (PARTITION BY id ORDER BY o) - 1 AS place FROM e""")
def edge_union(spark, d):
    size = F.col("p_size")
    edge = F.struct(F.col("p_type").alias("id"), F.when(size % 2 == 0, "variant").when(size % 5 == 0, "finetune").alias("relationship"), F.when(size % 3 == 1, F.col("p_brand")).alias("axis"))
    layers = t(spark, d, "part").select(F.col("p_name").alias("id"), (size % 3).alias("layer_rank"), F.col("p_brand").alias("file"), F.col("p_partkey").alias("pos"), F.array(edge).alias("parents"))
    out = merge.merge_layers(layers, [], edges="parents").select("id", F.posexplode("parents").alias("place", "e"))
    return out.select("id", F.col("e.id").alias("parent"), "e.relationship", "e.axis", F.col("place").cast("long").alias("place"))


@query("""SELECT p_name AS id, max(p_retailprice) AS price, string_agg(DISTINCT p_brand, '|' ORDER BY p_brand) AS aliases FROM part GROUP BY p_name""")
def latest_rows(spark, d):
    p = t(spark, d, "part").select(F.col("p_name").alias("id"), F.col("p_retailprice").alias("price"), F.array("p_brand").alias("aliases"))
    return merge.latest_by_id(p, "price").select("id", "price", F.array_join("aliases", "|").alias("aliases"))


# --- checks ---------------------------------------------------------------------------------------------------


@query("""WITH n AS (SELECT DISTINCT p_name, p_type FROM part), per AS (SELECT p_name, count(*) AS c FROM n GROUP BY p_name)
    SELECT 'alias layer' AS problem, count(*) AS n FROM part WHERE p_size > 40 UNION ALL SELECT 'same name', count(*) FROM per WHERE c > 1 UNION ALL SELECT 'inferred', count(*) FROM part WHERE (p_size % 2 = 0 AND p_size % 3 = 0) OR (p_size % 5 = 0 AND p_size % 4 <> 0)
    UNION ALL SELECT 'split orgs', count(*) FROM (SELECT DISTINCT p_type FROM part) UNION ALL SELECT 'twins', (SELECT count(DISTINCT p_name) FROM part) + (SELECT count(*) FROM part) UNION ALL SELECT 'attested', count(*) FROM part WHERE p_size % 2 = 0 AND p_partkey % 3 = 0
    UNION ALL SELECT 'raw names', count(*) FROM part WHERE p_size % 2 = 1 UNION ALL SELECT 'bare alias', count(*) FROM (SELECT p_name FROM part GROUP BY p_name HAVING count(DISTINCT p_type) = 1) JOIN part USING (p_name) WHERE p_size % 2 = 0
    UNION ALL SELECT 'shared identity', (SELECT count(*) FROM n) UNION ALL SELECT 'double claims', count(*) FROM per WHERE c > 1 UNION ALL SELECT 'two families', count(*) FROM per WHERE c > 1 UNION ALL SELECT 'floor', 1 UNION ALL SELECT 'bare ids', 1""")
def registry_checks(spark, d):
    p = t(spark, d, "part")
    n, size, key = F.col("p_name"), F.col("p_size"), F.col("p_partkey")
    owned = p.groupBy(keys.match_key(n).alias("leaf")).agg(F.min("p_type").alias("owner"), F.count_distinct("p_type").alias("claims"))
    twins = p.select(F.explode(F.array(dashed("p_name"), dashed("p_name", "_"))).alias("id")).distinct().unionByName(p.select(F.concat_ws("/", "p_partkey", "p_partkey").alias("id")))
    found = [
        ("alias layer", checks.created_by_alias_layers(p.select(key.alias("id")), p.where("p_size <= 40").select(key.alias("id")))),
        ("same name", checks.same_name_merged(p.select(F.concat_ws("/", "p_type", dashed("p_name")).alias("id"), F.lit("g").alias("model_group_id"), F.col("p_type").alias("org_id")))),
        ("inferred", checks.inferred_not_draft(p.select(key.alias("id"), F.when(size % 2 == 0, "inferred").otherwise("curated").alias("resolution_source"), F.when(size % 3 == 0, "reviewed").otherwise("draft").alias("review_status"), F.when(size % 5 != 0, n).alias("org_id"), F.when(size % 4 == 0, F.array(F.lit("org-unknown"))).otherwise(F.array(F.lit("other"))).alias("tags")))),
        ("split orgs", checks.split_orgs(p.select(F.explode(F.array("p_type", F.concat(F.lower("p_type"), F.lit("-")), F.concat(F.lit("only"), "p_brand"))).alias("id")).distinct())),
        ("twins", checks.separator_twins(twins)),
        ("attested", checks.attested_mismatch(p.select(F.when(size % 2 == 0, "attested").otherwise("exact").alias("strategy"), n.alias("raw_value"), F.when(key % 3 == 0, F.lit("else")).otherwise(F.upper(n)).alias("canonical_id")))),
        ("raw names", checks.raw_display_names(p.select(key.alias("id"), F.when(size % 2 == 1, dashed("p_name")).otherwise(n).alias("display_name")))),
        ("bare alias", checks.bare_alias_elsewhere(p.select(n.alias("raw_value"), F.when(size % 2 == 0, "elsewhere").otherwise(F.col("p_type")).alias("canonical_id")), owned)),
        ("shared identity", checks.shared_identity(p.select(F.explode(F.array(F.concat(F.lit("x/"), dashed("p_name")), F.concat(F.lit("x/"), F.concat_ws("-", F.substring_index("p_name", " ", -1), F.substring_index("p_name", " ", 1))))).alias("id"), F.col("p_type").alias("org_id")))),
        ("double claims", checks.double_claims(p.select(F.lit("model").alias("entity_type"), n.alias("raw_value"), F.col("p_type").alias("canonical_id")))),
        ("two families", checks.in_two_families(p.select(F.col("p_type").alias("id"), F.array("p_name").alias("benchmark_ids")))),
        ("floor", checks.below_floor(p, 10**9)),
        ("bare ids", checks.bare_ids(p.select(n.alias("id")), 3)),
    ]
    return counted(found)


@query(f"""WITH {MODELS} SELECT id AS child, parent, 'now-' || parent AS canonical_id FROM model WHERE substr(parent, 2)::INT % 5 = 0""")
def renamed_parents(spark, d):
    m = models(spark, d).where("cast(substr(id, 2) as int) % 5 <> 0 or id is null").unionByName(models(spark, d).where("cast(substr(id, 2) as int) % 5 = 0").withColumn("id", F.concat(F.lit("now-"), "id")))
    al = models(spark, d).select(F.col("id").alias("raw_value")).where("cast(substr(raw_value, 2) as int) % 5 = 0").withColumn("canonical_id", F.concat(F.lit("now-"), "raw_value"))
    out = checks.renamed_edges(m, al)
    return out.select(F.regexp_replace("child", "^now-", "").alias("child"), "parent", "canonical_id")


@query("""SELECT p_type || '/' || p_partkey AS raw_value, CASE WHEN p_partkey % 6 = 3 THEN 'no match' WHEN p_partkey % 6 = 1 THEN 'name' WHEN p_partkey % 6 = 2 THEN 'org' WHEN p_partkey % 6 = 4 THEN 'name and org' ELSE 'bad redirect' END AS problem FROM part WHERE p_partkey % 6 <> 0""")
def truth_mismatches(spark, d):
    """The known answer is the row's own id; results differ in name, org or both, or follow a near miss to another size."""
    p = t(spark, d, "part")
    n, raw = F.col("p_partkey") % 6, F.concat_ws("/", "p_type", "p_partkey")
    moved = F.concat(raw, F.lit("-7b"))
    rows = p.select(F.when(n == 5, F.concat(raw, F.lit("-8b"))).otherwise(raw).alias("raw_value"), F.when(n == 5, moved).otherwise(raw).alias("fixed_id"), F.when(n == 5, "fixed_near_miss").otherwise("fixed_exact").alias("status"),
        F.when(n == 1, F.concat(raw, F.lit("x"))).when(n == 2, F.concat(F.lit("other/"), "p_partkey")).when(n == 4, F.lit("other/else")).when(n == 5, moved).when(n == 0, F.concat_ws("/", F.lower("p_type"), "p_partkey")).alias("canonical_id"))
    org_map = match.build_org_map(p.select(F.col("p_type").alias("id"), nothing().alias("hf_org")).distinct())
    out = checks.oracle_mismatch(rows.select("raw_value", "canonical_id"), rows.select("raw_value", "fixed_id", "status"), org_map, spark.createDataFrame([], "raw string"))
    return out.select(F.regexp_replace("raw_value", "-8b$", "").alias("raw_value"), "problem")


@query("""SELECT p_type AS org, replace(p_name, ' ', '-') AS name, min(p_type || '/' || upper(replace(p_name, ' ', '-'))) AS "real", count(*) FILTER (p_size <= 40) AS slugs FROM part GROUP BY ALL HAVING count(*) FILTER (p_size > 40) > 0 AND count(*) FILTER (p_size <= 40) > 0""")
def slug_duplicates(spark, d):
    p = t(spark, d, "part")
    real = F.col("p_size") > 40
    m = p.select(F.concat_ws("/", "p_type", F.when(real, F.upper(dashed("p_name"))).otherwise(dashed("p_name", "_"))).alias("id"), real.alias("is_real"))
    return checks.duplicated_by_slug(m, match.build_org_map(p.select(F.col("p_type").alias("id"), nothing().alias("hf_org")).distinct()))


@query("""SELECT DISTINCT 'mint-' || p_partkey AS id FROM part m WHERE p_size <= 40 AND p_partkey % 7 <> 0 AND EXISTS (SELECT 1 FROM part r WHERE r.p_size > 40 AND r.p_type = m.p_type AND r.p_name = m.p_name)""")
def shadowed_ids(spark, d):
    p = t(spark, d, "part")
    mints = p.where("p_size <= 40").select(F.concat(F.lit("mint-"), "p_partkey").alias("id"), F.col("p_type").alias("org"), F.array(dashed("p_name", "_")).alias("forms"))
    real = p.where("p_size > 40").select(F.concat_ws("/", "p_type", dashed("p_name")).alias("id"), F.col("p_type").alias("org")).distinct().select("id", "org", F.array().cast("array<string>").alias("aliases"), F.lit(1).alias("seq"))
    return checks.shadowing_mints(mints, real, org_tables(spark, d)[0], mints.where("cast(substr(id, 6) as int) % 7 = 0")).select("id")


@query(f"""WITH RECURSIVE {MODELS}, {walk_sql("g", GROUP, True)}, {walk_sql("f", FAMILY, True)} SELECT id, 'parents' AS problem FROM model WHERE parent IS NOT NULL AND substr(id, 2)::INT % 3 = 0
    UNION ALL SELECT m.id, 'ancestry' FROM model m JOIN g USING (id) JOIN f USING (id) WHERE parent IS NOT NULL AND (g.root <> m.id OR f.root <> m.id) AND substr(id, 2)::INT % 4 = 0""")
def lineage_hidden(spark, d):
    m = graph.derive_lineage(models(spark, d))
    k = F.expr("cast(substr(id, 2) as int)")
    results = m.select(F.col("id").alias("canonical_id"), F.when(k % 3 != 0, F.col("parents")).alias("parents"), F.when(k % 4 != 0, F.array("model_family_id")).alias("ancestry"))
    return checks.hidden_lineage(results, m)


@query("""SELECT 'unresolved' AS problem, count(DISTINCT p_name) AS n FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size > 48) UNION ALL SELECT 'prefix', count(*) FROM part WHERE (p_size % 3 = 0 OR p_size % 5 = 0 AND p_size % 3 <> 1) AND p_partkey % 4 <> 0""")
def external_checks(spark, d):
    """Prefixes: the org in other spelling, another org, or a placeholder, with an org or without one; a fourth is adopted."""
    p = t(spark, d, "part")
    n, size = F.col("p_name"), F.col("p_size")
    ext = p.select(F.concat(F.lit("~x/"), n).alias("key")).unionByName(p.select(F.concat(F.lit("~router/"), "p_partkey").alias("key")))
    resolved = p.select(F.concat(F.lit("~x/"), n).alias("raw_value"), F.when(size > 48, n).alias("canonical_id"))
    prefix = F.when(size % 3 == 0, "elsewhere").when(size % 3 == 1, "unknown").otherwise(F.concat(F.lower("p_type"), F.lit("-")))
    org = F.when((size % 3 != 1) & (size % 5 != 0), F.col("p_type"))
    m = p.select(F.concat_ws("/", prefix, "p_partkey").alias("id"), org.alias("org_id"), "p_partkey")
    orgs = match.build_org_map(p.select(F.col("p_type").alias("id"), nothing().alias("hf_org")).distinct())
    return counted([("unresolved", checks.unresolved_keys(ext, resolved, "router")), ("prefix", checks.foreign_prefixes(m, m.where("p_partkey % 4 = 0"), orgs))])


# --- sources and whole jobs -----------------------------------------------------------------------------------


@query("""SELECT s_suppkey AS id, s_nationkey AS nation, strftime(date '2025-01-01' + (s_suppkey % 3)::INT, '%Y-%m-%d') AS date FROM supplier""")
def stored_tables(spark, d):
    """Written, appended to and read back: a log by its date beside a table that persisting writes."""
    s = t(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_nationkey").cast("string").alias("display_name"), F.concat(F.date_format(F.date_add(F.lit("2025-01-01").cast("date"), (F.col("s_suppkey") % 3).cast("int")), "yyyy-MM-dd"), F.lit("T00:00:00Z")).alias("created_at"))
    root = shared_folder(spark, "registry")
    registry.save_registry({"canonical_orgs": s.select("id", "display_name"), "hub_stats_index": s}, root)
    registry.append_log(s.where("cast(id as long) % 2 = 0"), f"{root}/log")
    registry.append_log(s.where("cast(id as long) % 2 = 1"), f"{root}/log")
    back = registry.load_registry(spark, root, ["canonical_orgs", "hub_stats_index"])
    assert back["hub_stats_index"].isEmpty()
    log = spark.read.parquet(f"{root}/log").select("id", F.col("date").cast("string").alias("date"))
    return back["canonical_orgs"].join(log, "id").select(F.col("id").cast("long").alias("id"), F.col("display_name").cast("int").alias("nation"), "date")


@query("""SELECT s_suppkey AS id, s_nationkey % 3 AS layer, s_name AS name, s_suppkey % 4 = 0 AS states_org FROM supplier""")
def layer_files(spark, d):
    s = t(spark, d, "supplier")
    root = shared_folder(spark, "layers")
    folders = []
    for k in range(3):
        entry = F.to_json(F.struct(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name")))
        entry = F.when(F.col("s_suppkey") % 4 == 0, F.regexp_replace(entry, r"\}$", ',"org":null}')).otherwise(entry)
        s.where(F.col("s_nationkey") % 3 == k).select(entry.alias("value")).write.text(f"{root}/layer={k}")
        folders.append(f"{root}/layer={k}")
    rows = registry.read_layers(spark, folders)
    return rows.select(F.col("id").cast("long").alias("id"), F.col("layer_rank").alias("layer"), F.expr("variant_get(entry, '$.name', 'string')").alias("name"), F.array_contains("explicit_keys", "org").alias("states_org"))


@query("""SELECT o_orderkey, o_orderpriority AS config FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')""")
def record_scan(spark, d):
    root = shared_folder(spark, "records")
    t(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("source_config")).write.partitionBy("source_config").parquet(f"{root}/all")
    return registry.read_records(spark, f"{root}/all", ["1-URGENT", "5-LOW"]).select("o_orderkey", F.col("source_config").alias("config"))


@query("""SELECT DISTINCT replace(p_name, ' ', '-') AS slug, p_name AS fields, replace(p_name, ' ', '-') || ',' || replace(p_name, ' ', '_') AS configs FROM part""")
def flattened_maps(spark, d):
    p = t(spark, d, "part")
    maps = p.select("p_partkey", F.create_map(dashed("p_name"), F.col("p_name")).alias("entries"))
    return registry.flatten_map(maps, "entries", True).select("slug", "fields", F.array_join("configs", ",").alias("configs")).distinct()


@query("""SELECT s_suppkey AS id FROM supplier""")
def built_index(spark, d):
    s = t(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.struct(F.col("s_suppkey").alias("total")).alias("safetensors"), nothing().alias("gguf"), F.lit(None).cast("timestamp").alias("createdAt"), nothing().alias("pipeline_tag"), F.lit(1).alias("downloads"))
    root = shared_folder(spark, "index")
    registry.build_index(s, f"{root}/index", 1)
    return spark.read.parquet(f"{root}/index").select(F.col("id").cast("long").alias("id"))


@query(f"""WITH RECURSIVE {MODELS}, {walk_sql("l", LINEAGE, False)}, {walk_sql("i", "c.relationship IN ('variant', 'quantized')", False)},
    o AS (SELECT w.id, arg_min(m.open_weights, w.depth) FILTER (m.open_weights IS NOT NULL) AS open_weights FROM i_walk w JOIN model m ON m.id = w.place GROUP BY w.id)
    SELECT m.id, nullif(l.root, m.id) AS lineage_origin_model_id, o.open_weights FROM model m JOIN l USING (id) JOIN o USING (id)""")
def lineage_job(spark, d):
    return jobs.add_lineage(models(spark, d)).select("id", "lineage_origin_model_id", "open_weights")


@query("""WITH first AS (SELECT p_name, min(p_partkey) AS k FROM part GROUP BY p_name), m AS (SELECT CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN replace(p_name, ' ', '_') WHEN 3 THEN p_name || '-fp8' ELSE 'x ' || p_name END AS raw_value, p_partkey % 5 <> 4 AND k % 7 <> 0 AS hit FROM part JOIN first USING (p_name))
    SELECT raw_value, count(*) AS n FROM m WHERE NOT hit GROUP BY raw_value ORDER BY n DESC, raw_value LIMIT 10""")
def audit_job(spark, d):
    """The most frequent open mentions, all in global scope: names in front of which nothing strips the x, and rejected aliases."""
    m = mentions(spark, d).withColumn("source_config", nothing())
    org_map, orgs = org_tables(spark, d)
    out = jobs.audit(m, aliases(spark, d).where("source_config is null"), 10, rules=RULES, org_map=org_map, known_orgs=orgs)
    return out["unmatched"].select("raw_value", "n")


@query("""WITH p AS (SELECT *, p_type || '/' || upper(replace(p_name, ' ', '-')) AS fixed, p_type || '/' || replace(p_name, ' ', '_') AS old FROM part), o AS (SELECT DISTINCT p_type, old, fixed FROM p WHERE p_size > 30), top AS (SELECT p_type, min(old) AS low, arg_min(fixed, old) AS up FROM o GROUP BY p_type)
    SELECT DISTINCT CASE WHEN o.old IS NULL THEN 'mint' ELSE 'rekey' END AS kind, p.fixed AS a, o.old AS b FROM p LEFT JOIN o ON o.fixed = p.fixed
    UNION ALL SELECT 'alias', CASE WHEN p_partkey % 4 = 2 THEN p_type || '/n' || p_partkey ELSE 'n' || p_partkey END, fixed FROM p WHERE p_partkey % 4 <> 0 UNION ALL SELECT 'refused', 'other/n' || p_partkey, fixed FROM p WHERE p_partkey % 4 = 0
    UNION ALL SELECT 'edge', fixed, up FROM o JOIN top USING (p_type) WHERE old <> low""")
def oracle_layer_job(spark, d):
    """Every name has a known answer in capitals; large parts are there already in other spelling, with the least of their type as parent."""
    p = t(spark, d, "part").withColumn("fixed", F.concat_ws("/", "p_type", F.upper(dashed("p_name")))).withColumn("old", F.concat_ws("/", "p_type", dashed("p_name", "_")))
    n = F.col("p_partkey") % 4
    raw = F.concat(F.when(n == 0, "other/").when(n == 2, F.concat("p_type", F.lit("/"))).otherwise(""), F.lit("n"), "p_partkey")
    truth = p.select(raw.alias("raw_value"), F.col("fixed").alias("fixed_id"), F.when(n % 2 == 0, "fixed_near_miss").otherwise("fixed_exact").alias("status"))
    o = p.where("p_size > 30").select("p_type", "old").distinct()
    top = o.groupBy("p_type").agg(F.min("old").alias("low"))
    old = o.join(top, "p_type").select(F.col("old").alias("id"), F.array(F.struct(F.col("low").alias("id"), F.lit("variant").alias("relationship"), F.lit("size").alias("axis"))).alias("parents"))
    org_map = match.build_org_map(p.select(F.col("p_type").alias("id"), nothing().alias("hf_org")).distinct())
    out = jobs.oracle_layer(truth, old, org_map, spark.createDataFrame([], "raw string"))
    rows = [out["targets"].select(F.col("action").alias("kind"), F.col("id").alias("a"), F.col("incumbent").alias("b"))]
    for kind, name, a, b in (("alias", "aliases", "raw_value", "canonical_id"), ("refused", "refused", "raw", "fixed"), ("edge", "edges", "child", "parent")):
        rows.append(out[name].select(F.lit(kind).alias("kind"), F.col(a).alias("a"), F.col(b).alias("b")))
    return reduce(DataFrame.unionByName, rows)


@query(f"""WITH {CATALOGUE}, raw AS (SELECT keyed.*, p_size, ['', 'us.meta.', 'accounts/x/models/', 'hf:org/', 'azure-', 'org--'][p_partkey % 6 + 1] || CASE WHEN p_partkey % 2 = 0 THEN a || '-' || b ELSE b || '_' || upper(a) END
        || ['', ':free', '-fast', '-turbo', '-20250101', '@20250101', '-2025-01-02', '-latest', '-v2', '-fp8:1024'][p_partkey % 10 + 1] AS model_id FROM keyed JOIN part USING (p_partkey)),
    fams AS (SELECT a, b, k, list(DISTINCT family) FILTER (family IS NOT NULL) AS f FROM keyed GROUP BY ALL),
    pair AS (SELECT x.k AS low, y.k AS high FROM fams x JOIN fams y ON x.a = y.a AND x.b = y.b AND x.k < y.k WHERE x.f IS NULL OR y.f IS NULL OR list_has_any(x.f, y.f)),
    old AS (SELECT DISTINCT model_id FROM raw WHERE p_size > 45), g AS (SELECT coalesce(low, k) AS id, model_id, old.model_id AS target FROM raw LEFT JOIN pair ON high = k LEFT JOIN old USING (model_id))
    SELECT id, min(target) AS target, CASE WHEN min(target) IS NULL THEN 0 ELSE count(DISTINCT model_id) END AS forms FROM g GROUP BY id""")
def catalogue_job(spark, d):
    """Groups with a row of a large part are known by that row's spelling and give it all of theirs; the others are minted."""
    p = t(spark, d, "part").where("p_size > 45").select(F.col("p_partkey").alias("pos"))
    rows = catalogue_rows(spark, d)
    old = rows.join(p, "pos").select(F.col("model_id").alias("id")).distinct().select("id", nothing().alias("org"), F.array().cast("array<string>").alias("aliases"), F.lit(1).alias("seq"))
    out = jobs.refresh_catalogue(rows, old, org_tables(spark, d)[0])
    given = out["folds"].join(out["enriched"], "target").groupBy("id", "target").agg(F.count("*").alias("forms"))
    return out["minted"].select("id", nothing().alias("target"), F.lit(0).cast("long").alias("forms")).unionByName(given)
