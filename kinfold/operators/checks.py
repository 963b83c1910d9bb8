"""Quality checks: each returns the rows that offend; no rows means the check passes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import keys
from . import graph, match


def unresolved(results: DataFrame) -> DataFrame:
    return results.where("canonical_id is null")


def duplicate_ids(df: DataFrame) -> DataFrame:
    """(key, ids): ids that differ only in case."""
    return df.groupBy(F.lower("id").alias("key")).agg(F.array_sort(F.collect_set("id")).alias("ids")).where(F.size("ids") > 1)


def created_by_alias_layers(alias_layer: DataFrame, entities: DataFrame) -> DataFrame:
    """Ids that only an alias layer knows."""
    return alias_layer.select("id").distinct().join(entities.select("id"), "id", "left_anti")


def dangling_edges(models: DataFrame) -> DataFrame:
    return graph.edges(models).join(models.select(F.col("id").alias("parent")), "parent", "left_anti").select("child", "parent")


def not_total(models: DataFrame) -> DataFrame:
    """Models whose group or family is null or isn't a model."""
    out = None
    for c in ("model_group_id", "model_family_id"):
        bad = models.join(models.select(F.col("id").alias(c), F.lit(True).alias("_k")), c, "left").where("_k is null").select("id", F.lit(c).alias("field"))
        out = bad if out is None else out.unionByName(bad)
    return out


def self_origin(models: DataFrame) -> DataFrame:
    return models.where("lineage_origin_model_id = id").select("id")


def crossing_orgs(models: DataFrame, group: str = "model_group_id") -> DataFrame:
    """Groups that hold models of more than one org."""
    return models.where("org_id is not null").groupBy(group).agg(F.count_distinct("org_id").alias("orgs")).where("orgs > 1")


def same_name_merged(models: DataFrame) -> DataFrame:
    """Name keys of one group id over several orgs."""
    leaf = keys.name_key(F.regexp_replace("id", r"^[^/]*/", ""))
    return models.groupBy(leaf.alias("name"), "model_group_id").agg(F.count_distinct("org_id").alias("orgs")).where("orgs > 1")


def inferred_not_draft(models: DataFrame) -> DataFrame:
    return models.where("resolution_source = 'inferred' and review_status <> 'draft' or org_id is null and not array_contains(tags, 'org-unknown')").select("id")


def dangling_orgs(models: DataFrame, orgs: DataFrame) -> DataFrame:
    refs = models.select("id", F.explode(F.filter(F.array("org_id", "lineage_origin_model_org_id"), lambda x: x.isNotNull())).alias("org"))
    return refs.join(orgs.select(F.col("id").alias("org")), "org", "left_anti").select("id", "org").distinct()


def split_orgs(orgs: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """(key, ids): orgs that differ only in case and signs, but for allowed keys."""
    out = orgs.groupBy(keys.org_key(F.col("id")).alias("key")).agg(F.array_sort(F.collect_set("id")).alias("ids")).where(F.size("ids") > 1)
    return out if allowed is None else out.join(allowed.select("key"), "key", "left_anti")


def separator_twins(df: DataFrame) -> DataFrame:
    """(key, ids): ids with one collision key; ids with a slash."""
    twins = df.groupBy(keys.collision_key(F.col("id")).alias("key")).agg(F.array_sort(F.collect_set("id")).alias("ids")).where(F.size("ids") > 1)
    return twins.unionByName(df.where("contains(id, '/')").select(F.lit("/").alias("key"), F.array("id").alias("ids")))


def attested_mismatch(results: DataFrame) -> DataFrame:
    """Attested results whose id isn't the repo's."""
    return results.where("strategy = 'attested' and lower(canonical_id) <> lower(raw_value)")


def oracle_mismatch(results: DataFrame, truth: DataFrame, org_map: DataFrame, deny: DataFrame) -> DataFrame:
    """(raw_value, fixed_id, canonical_id, problem): mentions that don't resolve to their known answer (truth: raw_value, fixed_id, status).

    Names are compared with their case, orgs after mapping. A near miss that would change what is meant (see
    ``match.guard_redirects``) must not be followed: it offends where it is.
    """
    fixed = truth.where("status in ('fixed_exact', 'fixed_near_miss')").select("raw_value", "fixed_id", "status").distinct()
    near = fixed.where("status = 'fixed_near_miss'").select(F.col("raw_value").alias("raw"), F.col("fixed_id").alias("fixed"))
    good = match.guard_redirects(near, deny, org_map).select(F.col("raw").alias("raw_value"), F.col("fixed").alias("fixed_id"), F.lit(True).alias("_good"))
    out = fixed.join(good, ["raw_value", "fixed_id"], "left").join(results.select("raw_value", "canonical_id").distinct(), "raw_value", "left")
    for side, c in (("_ro", "canonical_id"), ("_fo", "fixed_id")):
        out = out.withColumn("name", F.lower(F.substring_index(c, "/", 1))).join(org_map, "name", "left").withColumn(side, F.lower(F.coalesce("org", "name"))).drop("name", "org")
    leaf = lambda c: F.regexp_replace(c, "^[^/]*/", "")
    name, org = leaf("canonical_id") == leaf("fixed_id"), F.col("_ro") == F.col("_fo")
    refused = (F.col("status") == "fixed_near_miss") & F.col("_good").isNull()
    problem = (
        F.when(F.col("canonical_id").isNull(), "no match").when(refused, F.when(name & org, "bad redirect"))
        .when(~name & ~org, "name and org").when(~name, "name").when(~org, "org")
    )
    return out.select("raw_value", "fixed_id", "canonical_id", problem.alias("problem")).where("problem is not null")


def duplicated_by_slug(models: DataFrame, org_map: DataFrame) -> DataFrame:
    """(org, name, real, slugs): real ids (``is_real``) and other ids of the same developer and name up to separators."""
    name = F.regexp_replace(F.lower(F.regexp_replace("id", "^[^/]*/", "")), r"([a-z])[-_ /]+(\d)", "$1$2")
    name = F.regexp_replace(F.regexp_replace(name, r"(\d)\.(\d)(?![bmkt])", "$1-$2"), "[-_ /]+", "-")
    m = models.where("contains(id, '/')").select("id", "is_real", F.lower(F.substring_index("id", "/", 1)).alias("name"), name.alias("_n")).join(org_map, "name", "left")
    found = m.groupBy(F.coalesce("org", "name").alias("org"), F.col("_n").alias("name")).agg(F.min(F.when(F.col("is_real"), F.col("id"))).alias("real"), F.count_if(~F.col("is_real")).alias("slugs"))
    return found.where("real is not null and slugs > 0")


def shadowing_mints(mints: DataFrame, real: DataFrame, org_map: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """(id, target, tier): minted rows that would still fold onto a real id, but for allowed ids."""
    out = match.decide_folds(mints, real, org_map)
    return out if allowed is None else out.join(allowed.select("id"), "id", "left_anti")


def hidden_lineage(results: DataFrame, models: DataFrame) -> DataFrame:
    """(id, problem): models with parents, or a group or family above them, whose results (canonical_id, parents, ancestry) don't show it."""
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    r = results.groupBy(F.col("canonical_id").alias("id")).agg(F.bool_or(~none("parents")).alias("_p"), F.bool_or(~none("ancestry")).alias("_a"))
    m = models.where(~none("parents")).select("id", F.coalesce((F.col("model_family_id") != F.col("id")) | (F.col("model_group_id") != F.col("id")), F.lit(False)).alias("_up")).join(r, "id", "left")
    shown = lambda c: F.coalesce(c, F.lit(False))
    problems = F.array(F.when(~shown("_p"), "parents"), F.when(F.col("_up") & ~shown("_a"), "ancestry"))
    return m.select("id", F.explode(F.filter(problems, lambda x: x.isNotNull())).alias("problem"))


def unresolved_keys(external: DataFrame, resolved: DataFrame, own: str) -> DataFrame:
    """External keys that nothing resolves, but for the router's own products (``own`` as the org part)."""
    keys_ = external.where(~F.lower(F.ltrim("key", F.lit("~"))).startswith(own + "/")).select("key").distinct()
    return keys_.join(resolved.where("canonical_id is not null").select(F.col("raw_value").alias("key")), "key", "left_anti")


def foreign_prefixes(models: DataFrame, external: DataFrame, org_map: DataFrame) -> DataFrame:
    """(id, org_id): ids whose org part isn't their developer's, after mapping; adopted external ids (``id``) may keep theirs.

    A placeholder org part without an org passes; ids without an org part aren't judged here.
    """
    m = models.where("contains(id, '/')").join(external.select("id"), "id", "left_anti").select("id", "org_id", F.lower(F.substring_index("id", "/", 1)).alias("_p"))
    for c, to in (("_p", "_a"), ("org_id", "_b")):
        named = org_map.select(F.col("name").alias("_n"), F.col("org").alias(to))
        m = m.withColumn("_n", F.lower(c)).join(named, "_n", "left").withColumn(to, keys.org_key(F.coalesce(to, c))).drop("_n")
    fits = F.when(F.col("org_id").isNull(), F.col("_p").isin(*keys.PLACEHOLDER_ORGS)).otherwise(F.col("_a") == F.col("_b"))
    return m.where(~fits).select("id", "org_id")


def bare_ids(models: DataFrame, most: int) -> DataFrame:
    """The number of ids without an org part, where it is over the ceiling."""
    return models.where("not contains(id, '/')").agg(F.count("*").alias("n")).where(F.col("n") > most)


def lost_since(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of the earlier snapshot that are missing now."""
    return before.select(*columns).distinct().join(after.select(*columns), columns, "left_anti")


def raw_display_names(df: DataFrame) -> DataFrame:
    """Display names that still look like slugs."""
    return df.where(r"display_name rlike '^[a-z0-9]+(?:[-_][a-z0-9.]+)+$'").select("id", "display_name")


def not_own_alias(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Ids that are no alias of themselves."""
    own = aliases.where("raw_value = canonical_id and coalesce(status, '') <> 'rejected'").select(F.col("canonical_id").alias("id"))
    return entities.select("id").join(own, "id", "left_anti")


def bare_alias_elsewhere(aliases: DataFrame, claims: DataFrame) -> DataFrame:
    """Bare aliases that don't point at the only owner of their leaf."""
    one = claims.where("claims = 1").select("leaf", "owner")
    return aliases.where("not contains(raw_value, '/')").withColumn("leaf", keys.match_key(F.col("raw_value"))).join(one, "leaf").where("canonical_id <> owner").select("raw_value", "canonical_id", "owner")


def renamed_edges(models: DataFrame, aliases: DataFrame) -> DataFrame:
    """Edges to a name that is an alias of another id."""
    a = aliases.where("raw_value <> canonical_id").select(F.col("raw_value").alias("parent"), "canonical_id").distinct()
    return graph.edges(models).join(a, "parent").join(models.select(F.col("id").alias("parent")), "parent", "left_anti").select("child", "parent", "canonical_id")


def shared_identity(models: DataFrame) -> DataFrame:
    """(key, ids): models of one org and signature."""
    key = F.concat_ws("|", keys.org_key(F.coalesce("org_id", F.lit(""))), keys.signature(keys.match_key(F.regexp_replace("id", r"^[^/]*/", ""))))
    return models.groupBy(key.alias("key")).agg(F.array_sort(F.collect_set("id")).alias("ids")).where(F.size("ids") > 1)


def double_claims(forms: DataFrame) -> DataFrame:
    """(entity_type, raw_value, owners): forms that two ids claim in one pass."""
    return forms.groupBy("entity_type", "raw_value").agg(F.count_distinct("canonical_id").alias("owners")).where("owners > 1")


def in_two_families(families: DataFrame) -> DataFrame:
    """Benchmarks that more than one family lists."""
    return families.select("id", F.explode("benchmark_ids").alias("benchmark_id")).groupBy("benchmark_id").agg(F.count_distinct("id").alias("families")).where("families > 1")


def bad_metric_folds(folds: DataFrame, benchmarks: DataFrame, metrics: DataFrame) -> DataFrame:
    """(benchmark_id, from_metric_id, to_metric_id, problem) of folds: unknown ids, to itself, repeated, chained, factor not above 0."""
    f = folds.select("benchmark_id", "from_metric_id", "to_metric_id", "scale_factor")
    known = lambda df, c, n: df.select(F.col("id").alias(c), F.lit(True).alias(n)).distinct()
    f = f.join(known(benchmarks, "benchmark_id", "_b"), "benchmark_id", "left").join(known(metrics, "from_metric_id", "_f"), "from_metric_id", "left").join(known(metrics, "to_metric_id", "_t"), "to_metric_id", "left")
    twice = folds.groupBy("benchmark_id", "from_metric_id").agg((F.count("*") > 1).alias("_twice"))
    chain = folds.select("benchmark_id", F.col("from_metric_id").alias("to_metric_id"), F.lit(True).alias("_chain")).distinct()
    f = f.join(twice, ["benchmark_id", "from_metric_id"], "left").join(chain, ["benchmark_id", "to_metric_id"], "left")
    problem = (
        F.when(F.col("_b").isNull() | F.col("_f").isNull() | F.col("_t").isNull(), "unknown id").when(F.col("from_metric_id") == F.col("to_metric_id"), "self")
        .when(F.col("_twice"), "repeated").when(F.col("_chain"), "chain").when(F.col("scale_factor") <= 0, "factor")
    )
    return f.select("benchmark_id", "from_metric_id", "to_metric_id", problem.alias("problem")).where("problem is not null")


def below_floor(df: DataFrame, least: int) -> DataFrame:
    """The row count, where it is below the floor."""
    return df.agg(F.count("*").alias("n")).where(F.col("n") < least)


def report(models: DataFrame, aliases: DataFrame, claims: DataFrame, orgs: DataFrame | None = None, benchmarks: DataFrame | None = None) -> DataFrame:
    """(check, offender): what the checks of a built registry find; offenders of several ids are joined by a bar."""
    ids = F.array_join("ids", "|")
    found = {
        "same id but for case": duplicate_ids(models).select(ids), "edge to nothing": dangling_edges(models).select(F.concat_ws(">", "child", "parent")), "no group or family": not_total(models).select(F.concat_ws(":", "field", "id")),
        "own origin": self_origin(models).select("id"), "group over orgs": crossing_orgs(models).select("model_group_id"), "raw name": raw_display_names(models).select("id"), "claimed twice": claims.select("raw_value"),
        "no alias of its own": not_own_alias(models, aliases.withColumn("status", F.lit(None).cast("string"))).select("id"), "edge to an alias": renamed_edges(models, aliases).select(F.concat_ws(">", "child", "parent")), "same identity": shared_identity(models).select(ids),
    }
    if orgs is not None:
        found |= {"org without row": dangling_orgs(models, orgs).select(F.concat_ws(":", "id", "org")), "split org": split_orgs(orgs).select(ids)}
    if benchmarks is not None:
        found["benchmark twins"] = separator_twins(benchmarks).select(ids)
    return reduce(DataFrame.unionByName, (df.toDF("offender").select(F.lit(name).alias("check"), "offender") for name, df in found.items()))
