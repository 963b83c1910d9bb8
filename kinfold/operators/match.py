"""Matching mentions to canonical entities in ordered stages.

Mentions have raw_value, entity_type and source_config; aliases have raw_value, entity_type, source_config,
canonical_id, status and seq (their order: the last one wins). All stages work on distinct mentions and are
joined back, so a mention that recurs millions of times costs one lookup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import keys
from ..functions.keys import FuzzyRules
from ..storage import sized

KEY = ["raw_value", "entity_type", "source_config"]


def _no() -> Column:
    return F.lit(None).cast("string")


def _scope(c: str) -> Column:
    return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(""))


def _index(aliases: DataFrame, key: Column, name: str) -> DataFrame:
    """One row per type, key and scope; rejected aliases never match and the last one wins."""
    live = aliases.where(F.coalesce("status", F.lit("")) != "rejected")
    return live.groupBy(F.col("entity_type"), key.alias("_key"), _scope("source_config").alias("_scope")).agg(F.max_by("canonical_id", "seq").alias(name))


def _scoped_join(mentions: DataFrame, index: DataFrame, key: Column, name: str) -> DataFrame:
    """Look the key up in the mention's own scope, then among global aliases."""
    out = mentions.withColumn("_key", key).withColumn("_scope", _scope("source_config"))
    own = index.where("_scope <> ''").withColumnRenamed(name, "_own")
    everywhere = index.where("_scope = ''").drop("_scope").withColumnRenamed(name, "_any")
    out = out.join(own, ["entity_type", "_key", "_scope"], "left").join(everywhere, ["entity_type", "_key"], "left")
    return out.withColumn(name, F.coalesce("_own", "_any")).drop("_own", "_any", "_key", "_scope")


def match_exact(mentions: DataFrame, aliases: DataFrame, name: str = "exact_id") -> DataFrame:
    """Add the id of the alias with exactly this value."""
    return _scoped_join(mentions, _index(aliases, F.col("raw_value"), name), F.col("raw_value"), name)


def match_normalized(mentions: DataFrame, aliases: DataFrame, name: str = "normalized_id") -> DataFrame:
    """Add the id of the alias with the same match key."""
    key = keys.match_key(F.col("raw_value"))
    return _scoped_join(mentions, _index(aliases, key, name), key, name)


def attestation_index(external: DataFrame) -> DataFrame:
    """(id_norm, id) of keys that only one external id has (up to case)."""
    each = external.groupBy(keys.index_key(F.col("id")).alias("id_norm"))
    return each.agg(F.min("id").alias("id"), F.count_distinct(F.lower("id")).alias("n")).where("n = 1").drop("n")


def match_attested(mentions: DataFrame, external: DataFrame, tier: str = "verbatim") -> DataFrame:
    """Add ``attested_id``: a model mention's external id, equal up to case (verbatim) or by its index key."""
    model = (F.col("entity_type") == "model") & keys.is_repo_id(F.col("raw_value"))
    if tier == "verbatim":
        index = external.groupBy(F.lower("id").alias("_k")).agg(F.min("id").alias("_id"))
        key = F.lower("raw_value")
    else:
        index = attestation_index(external).select(F.col("id_norm").alias("_k"), F.col("id").alias("_id"))
        key = keys.index_key(F.col("raw_value"))
    return mentions.withColumn("_k", F.when(model, key)).join(index, "_k", "left").withColumnRenamed("_id", "attested_id" if tier == "verbatim" else "attested_norm_id").drop("_k")


def build_org_map(orgs: DataFrame, org_aliases: DataFrame | None = None, static: DataFrame | None = None) -> DataFrame:
    """(name, org): lower-case names of orgs; static ones first, then ids, then namespaces, then aliases, the last wins."""
    rank = lambda df, n, name, org: df.select(F.lower(name).alias("name"), F.col(org).alias("org"), F.lit(n).alias("_n"))
    all_ = rank(orgs, 1, "id", "id").unionByName(rank(orgs, 2, "hf_org", "id"))
    if static is not None:
        all_ = all_.unionByName(rank(static, 0, "name", "org"))
    if org_aliases is not None:
        all_ = all_.unionByName(rank(org_aliases, 3, "raw_value", "canonical_id"))
    return all_.where("name is not null").groupBy("name").agg(F.max_by("org", F.struct("_n", "org")).alias("org"))


def platform_map(platforms: DataFrame) -> DataFrame:
    """(token, platform): host tokens of each platform; ``unknown`` stands for none."""
    out = platforms.select(F.explode("aliases").alias("token"), F.col("id").alias("platform")).withColumn("token", F.lower("token"))
    return out.groupBy("token").agg(F.min("platform").alias("platform")).withColumn("platform", F.nullif("platform", F.lit("unknown")))


def orgs_agree(df: DataFrame, a: str, b: str, org_map: DataFrame, known_orgs: DataFrame, name: str = "agree") -> DataFrame:
    """Add whether the orgs of two ids agree: equal after mapping, or unregistered and alike but for case and signs.

    Two registered orgs that differ never agree; an id without an org agrees with any.
    """
    out = df
    for side, c in (("_a", a), ("_b", b)):
        out = out.withColumn(side, F.when(F.col(c).contains("/"), F.substring_index(c, "/", 1)))
        for suffix, key in (("1", F.lower(side)), ("2", keys.org_key(F.col(side)))):
            named = org_map.select(F.col("name").alias(f"{side}n{suffix}"), F.col("org").alias(f"{side}o{suffix}"))
            out = out.withColumn(f"{side}n{suffix}", key).join(named, f"{side}n{suffix}", "left").drop(f"{side}n{suffix}")
        out = out.withColumn(side, F.coalesce(f"{side}o1", f"{side}o2", side)).drop(f"{side}o1", f"{side}o2")
        known = known_orgs.select(F.col("id").alias(side), F.lit(True).alias(f"{side}k")).distinct()
        out = out.join(known, side, "left")
    both = F.coalesce("_ak", F.lit(False)) & F.coalesce("_bk", F.lit(False))
    agree = F.when(F.col("_a").isNull() | F.col("_b").isNull() | (F.col("_a") == F.col("_b")), True).when(both, False).otherwise(keys.org_key(F.col("_a")) == keys.org_key(F.col("_b")))
    return out.withColumn(name, agree).drop("_a", "_b", "_ak", "_bk")


def fuzzy_candidates(mentions: DataFrame, rules: FuzzyRules) -> DataFrame:
    """(mention columns, rank, candidate, platform) of model mentions, and the one candidate of benchmarks."""
    models = mentions.where("entity_type = 'model'")
    for kind, step in keys.fuzzy_steps("raw_value", rules):
        if kind == "start":
            models = models.withColumn("_c", step)
        else:
            models = models.withColumn("_c", F.concat("_c", F.flatten(F.transform(F.concat(F.array("raw_value"), F.col("_c")), step))))
    models = models.withColumn("platform", keys.captured_platform("raw_value", "_c", rules))
    stems = mentions.where("entity_type = 'benchmark'").withColumn("_s", keys.without_run_config(F.col("raw_value")))
    stems = stems.where("_s is not null").withColumn("_c", F.array("_s")).withColumn("platform", _no()).drop("_s")
    both = models.unionByName(stems)
    return both.select(*mentions.columns, "platform", F.posexplode("_c").alias("rank", "candidate"))


def match_fuzzy(mentions: DataFrame, aliases: DataFrame, rules: FuzzyRules, org_map: DataFrame, known_orgs: DataFrame) -> DataFrame:
    """(mention key, fuzzy_id, platform): the first candidate whose exact or normalized hit has an agreeing org.

    Null and empty scopes are one scope, here spelled as the empty one.
    """
    one = mentions.select("raw_value", "entity_type", _scope("source_config").alias("source_config")).distinct()
    tried = fuzzy_candidates(one, rules).withColumnRenamed("raw_value", "_raw").withColumnRenamed("candidate", "raw_value")
    tried = match_normalized(match_exact(tried, aliases), aliases)
    hits = tried.select("_raw", "entity_type", "source_config", "platform", "rank", "raw_value", F.explode(F.array(F.struct(F.lit(0).alias("tier"), F.col("exact_id").alias("id")), F.struct(F.lit(1).alias("tier"), F.col("normalized_id").alias("id")))).alias("_h"))
    hits = hits.select("*", F.col("_h.tier").alias("tier"), F.col("_h.id").alias("hit")).drop("_h").where("hit is not null")
    hits = orgs_agree(hits, "raw_value", "hit", org_map, known_orgs)
    hits = hits.where(F.col("agree") | (F.col("entity_type") == "benchmark"))
    return hits.groupBy(F.col("_raw").alias("raw_value"), "entity_type", "source_config").agg(F.min_by("hit", F.struct("rank", "tier")).alias("fuzzy_id"), F.first("platform").alias("platform"))


def resolve(mentions: DataFrame, aliases: DataFrame, external: DataFrame | None = None, rules: FuzzyRules | None = None, org_map: DataFrame | None = None, known_orgs: DataFrame | None = None, mode: str = "resolve", threshold: float = 0.85) -> DataFrame:
    """Add canonical_id, strategy, confidence and inference_platform to every mention.

    Order: exact; an external id equal up to case, which outranks an exact hit that differs; normalized (0.95,
    if the threshold allows); external by index key; fuzzy (0.9, left out in mode ``exact``); no_match. Only
    what is still open is expanded into fuzzy candidates. Without an org map, orgs agree where they are spelled alike.
    """
    distinct = mentions.select(*KEY).distinct()
    out = match_normalized(match_exact(distinct, aliases), aliases)
    if threshold > 0.95:
        out = out.withColumn("normalized_id", _no())
    if external is not None:
        out = match_attested(match_attested(out, external), external, "normalized")
    else:
        out = out.withColumn("attested_id", _no()).withColumn("attested_norm_id", _no())
    stages = [("attested_id", "attested", 1.0), ("exact_id", "exact", 1.0), ("normalized_id", "normalized", 0.95), ("attested_norm_id", "attested_normalized", 0.95)]
    # An exact hit on the very attested id stays an exact hit.
    out = out.withColumn("attested_id", F.when(~F.col("attested_id").eqNullSafe(F.col("exact_id")), F.col("attested_id")))
    if mode != "exact" and rules is not None:
        # Both the open rest and the final join read this, so it is made once.
        out = sized(out)
        open_ = out.where(F.coalesce(*(c for c, _, _ in stages)).isNull())
        nobody = mentions.sparkSession.createDataFrame([], "name string, org string, id string")
        fuzzy = match_fuzzy(open_, aliases, rules, nobody if org_map is None else org_map, nobody if known_orgs is None else known_orgs)
        out = out.withColumn("_s", _scope("source_config")).join(fuzzy.withColumnRenamed("source_config", "_s"), ["raw_value", "entity_type", "_s"], "left").drop("_s")
        stages.append(("fuzzy_id", "fuzzy", 0.9))
    else:
        out = out.withColumn("platform", _no())
    best = F.coalesce(*(F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("id"), F.lit(s).alias("strategy"), F.lit(x).alias("confidence"))) for c, s, x in stages), F.struct(_no().alias("id"), F.lit("no_match").alias("strategy"), F.lit(0.0).alias("confidence")))
    out = out.withColumn("_b", best).select(*KEY, F.col("_b.id").alias("canonical_id"), F.col("_b.strategy").alias("strategy"), F.col("_b.confidence").alias("confidence"), F.when(F.col("_b.strategy") == "fuzzy", F.col("platform")).alias("inference_platform"))
    # Null and empty scopes are the same scope, so the join back can be an equi-join.
    keyed = out.withColumn("_s", F.coalesce("source_config", F.lit("\x00"))).drop("source_config")
    return mentions.withColumn("_s", F.coalesce("source_config", F.lit("\x00"))).join(keyed, ["raw_value", "entity_type", "_s"], "left").drop("_s")


def compare_stored(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored aliases beside fresh results: agree, case_only, attested_disagrees (to be flagged) or stale (kept)."""
    f = fresh.select(*KEY, F.col("canonical_id").alias("fresh_id"), F.col("strategy").alias("fresh_strategy")).withColumn("source_config", _scope("source_config"))
    out = stored.withColumn("_sc", F.col("source_config")).withColumn("source_config", _scope("source_config")).join(f, KEY, "left").withColumn("source_config", F.col("_sc")).drop("_sc")
    outcome = (
        F.when(F.col("fresh_id").isNull(), "stale").when(F.col("fresh_id") == F.col("canonical_id"), "agree").when(F.lower("fresh_id") == F.lower("canonical_id"), "case_only")
        .when(F.col("fresh_strategy").startswith("attested"), "attested_disagrees").otherwise("stale")
    )
    return out.withColumn("outcome", outcome)


def _lookup(df: DataFrame, column: str, kind: str, aliases: DataFrame, name: str) -> DataFrame:
    """Exact, then normalized, global alias of a column's values."""
    cols = df.columns
    out = df.withColumn("_keep", F.col("raw_value") if "raw_value" in cols else _no()).withColumn("raw_value", F.col(column)).withColumn("entity_type", F.lit(kind))
    if "source_config" not in cols:
        out = out.withColumn("source_config", _no())
    out = match_normalized(match_exact(out, aliases, "_e"), aliases, "_n").withColumn(name, F.coalesce("_e", "_n"))
    return out.select(*(F.col("_keep").alias(c) if c == "raw_value" else F.col(c) for c in cols), name)


def resolve_structured_metric(df: DataFrame, column: str, aliases: DataFrame, catch_all: DataFrame) -> DataFrame:
    """(column, metric_id) for ids with parts: the one metric that parts after the first name, catch-alls aside."""
    parts = df.select(column).distinct().withColumn("_p", F.split(column, r"[./]")).where(F.size("_p") > 1)
    parts = parts.select(column, F.explode(F.slice("_p", 2, 10_000)).alias("part")).where("trim(part) <> ''")
    hits = _lookup(parts, "part", "metric", aliases, "hit").where("hit is not null")
    hits = hits.join(catch_all.select(F.col("id").alias("hit")), "hit", "left_anti")
    one = hits.groupBy(column).agg(F.count_distinct("hit").alias("n"), F.min("hit").alias("metric_id"))
    return df.select(column).distinct().join(one.where("n = 1").drop("n"), column, "left")


def resolve_structured_name(df: DataFrame, column: str, aliases: DataFrame, namespaces: DataFrame, least: int = 3) -> DataFrame:
    """(column, benchmark_id) for dotted names.

    Parts are tried left to right up to the first that is neither a benchmark nor a namespace; then the joined
    tails from there, the shallowest hit first; else the deepest hit before it. Parts shorter than ``least``
    don't count.
    """
    parts = df.select(column).distinct().withColumn("_p", keys.name_segments(F.col(column))).where("_p is not null")
    each = parts.select(column, "_p", F.posexplode("_p").alias("pos", "part"))
    hits = _lookup(each, "part", "benchmark", aliases, "hit").withColumn("hit", F.when(F.length("part") >= least, F.col("hit")))
    hits = hits.join(namespaces.select(F.lower("name").alias("_ns"), F.lit(True).alias("ns")).distinct(), F.lower("part") == F.col("_ns"), "left").drop("_ns")
    stop = hits.groupBy(column).agg(F.min(F.when(F.col("hit").isNull() & F.col("ns").isNull(), F.col("pos"))).alias("stop"))
    hits = hits.join(stop, column)
    before = hits.where("stop is null or pos < stop").groupBy(column).agg(F.max_by("hit", F.when(F.col("hit").isNotNull(), F.col("pos"))).alias("deepest"))
    tails = hits.where("pos >= coalesce(stop, 2147483647)").withColumn("tail", F.concat_ws(" ", F.expr("slice(_p, pos + 1, size(_p))")))
    tails = _lookup(tails.drop("hit"), "tail", "benchmark", aliases, "hit").where(F.col("hit").isNotNull() & (F.length("tail") >= least))
    tails = tails.groupBy(column).agg(F.min_by("hit", "pos").alias("tail_hit"))
    out = df.select(column).distinct().join(before, column, "left").join(tails, column, "left")
    return out.select(column, F.coalesce("tail_hit", "deepest").alias("benchmark_id"))


def enrich(hits: DataFrame, entities: DataFrame, fields: list[str]) -> DataFrame:
    """Add fields of the matched entity (entities: id, entity_type and the fields; NaN counts as null)."""
    e = entities.select(F.col("id").alias("canonical_id"), "entity_type", *(F.nanvl(f, F.lit(None)).alias(f) if t == "double" else F.col(f) for f, t in entities.select(*fields).dtypes))
    return hits.join(e, ["entity_type", "canonical_id"], "left")


def with_ancestry(hits: DataFrame, families: DataFrame, roots: DataFrame, composites: DataFrame) -> DataFrame:
    """Add ``family_id``, ``composite_id`` and ``ancestry`` to benchmark hits.

    The family is the first that lists the benchmark, else that of the walk (``roots``: id, root), else the
    benchmark; the composite is the one that names the family. Levels equal to the hit are left out.
    """
    member = families.select(F.col("id").alias("_f"), "seq", F.explode("benchmark_ids").alias("canonical_id")).groupBy("canonical_id").agg(F.min_by("_f", "seq").alias("_listed"))
    above = composites.where("family_id is not null").groupBy(F.col("family_id")).agg(F.min("id").alias("composite_id"))
    out = hits.join(member, "canonical_id", "left").join(roots.select(F.col("id").alias("canonical_id"), F.col("root").alias("_root")), "canonical_id", "left")
    out = out.withColumn("family_id", F.coalesce("_listed", "_root", "canonical_id")).drop("_listed", "_root").join(above, "family_id", "left")
    levels = F.array(*(F.struct(F.col(c).alias("canonical_id"), F.lit(level).alias("level")) for c, level in (("family_id", "family"), ("composite_id", "composite"))))
    return out.withColumn("ancestry", F.filter(levels, lambda x: x["canonical_id"].isNotNull() & (x["canonical_id"] != F.col("canonical_id"))))


def with_detail(hits: DataFrame) -> DataFrame:
    """Add ``resolution_detail``: whether a benchmark is a slice, and the subset named if it isn't just the id."""
    sliced = F.col("parent_benchmark_id").isNotNull() & (F.col("parent_benchmark_id") != F.col("canonical_id"))
    subset = F.when(sliced & (F.lower("raw_value") != F.lower("canonical_id")), F.col("raw_value"))
    return hits.withColumn("resolution_detail", F.struct(F.when(sliced, "slice").otherwise("benchmark").alias("level"), subset.alias("matched_subset")))


def lean(results: DataFrame) -> DataFrame:
    """The result's ever-present fields."""
    names = ["raw_value", "entity_type", "source_config", "canonical_id", "strategy", "confidence", "review_status", "parent_canonical_id", "ancestry", "resolution_detail"]
    return results.select(*(F.col(c) if c in results.columns else _no().alias(c) for c in names))


def decide_folds(mints: DataFrame, targets: DataFrame, org_map: DataFrame) -> DataFrame:
    """(id, target, tier): which existing entity a mint is, by exact id, alias, name and org, or brand-less name and org.

    ``mints`` has id and org and forms (array); ``targets`` id, org, aliases (array) and seq. Orgs must agree but for
    the first tier; a mint without an org never folds by name. Ties go to the lower tier, then the smaller target.
    """
    stripped = lambda c, o: F.regexp_replace(keys.name_key(c), F.concat(F.lit("^"), keys.org_key(F.coalesce(o, F.lit("")))), "")
    leaf = lambda c: F.regexp_replace(c, r"^[^/]*/", "")
    keyed = lambda df, o: df.withColumn("_n", keys.name_key(leaf(F.col("form")))).withColumn("_s", stripped(leaf(F.col("form")), F.col(o)))
    m = mints.select("id", F.col("org").alias("m_org"), F.explode(F.array_distinct(F.concat(F.array("id"), "forms"))).alias("form"))
    forms = targets.select(F.col("id").alias("target"), F.col("org").alias("t_org"), F.explode(F.array_distinct(F.concat(F.array("id"), "aliases"))).alias("form"))
    m, forms = sized(keyed(m, "m_org"), "mint_names"), sized(keyed(forms, "t_org"), "target_names")
    # All tiers are one join; names count under their org only.
    tier = lambda n, key, ok: F.when(ok & (key != ""), F.struct(F.lit(n).alias("tier"), key.alias("_k")))
    tiers = lambda o, first: F.explode(F.array_compact(F.array(
        tier(1, F.col("form"), first), tier(2, F.lower("form"), F.lit(True)), *(F.when(F.col(c) != "", tier(n, F.concat_ws("\n", F.lower(o), c), F.col(o).isNotNull())) for n, c in ((3, "_n"), (4, "_s")))
    ))).alias("_x")
    left = m.select("id", F.lower("m_org").alias("_m"), tiers("m_org", F.lit(True))).select("id", "_m", "_x.*")
    right = forms.select("target", F.lower("t_org").alias("_t"), tiers("t_org", F.col("form") == F.col("target"))).select("target", "_t", "_x.*")
    hits = left.join(right, ["tier", "_k"]).where("tier <> 2 or _m is null or _m = _t")
    return hits.groupBy("id").agg(F.min(F.struct("tier", "target")).alias("_b")).select("id", F.col("_b.target").alias("target"), F.col("_b.tier").alias("tier"))


def vendor_by_token(df: DataFrame, column: str, rules: DataFrame) -> DataFrame:
    """Add ``vendor``: that of the longest rule token the name starts with, where the token ends there.

    ``rules`` (token, vendor) meets the name's prefixes of the rules' lengths in an equi-join.
    """
    lengths = [r[0] for r in rules.select(F.length("token")).distinct().collect()]
    low = F.lower(column)
    sized = F.array(*(F.when((F.length(low) >= n) & F.substring(low, n + 1, 1).rlike(r"^(?:[0-9._:-]|)$"), F.substring(low, 1, n)) for n in sorted(lengths))) if lengths else F.array().cast("array<string>")
    names = df.select(column).distinct().withColumn("token", F.explode(F.filter(sized, lambda x: x.isNotNull())))
    best = names.join(rules.withColumn("token", F.lower("token")), "token").groupBy(column).agg(F.max_by("vendor", F.length("token")).alias("vendor"))
    return df.join(best, column, "left")


def infer_base(drafts: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, base, relationship, axis): the longest proper stem of an id that names another model.

    Stems with the org go before bare ones of the same length. What is left over makes the edge a version where
    it is only dates or numbers, else a fine-tune.
    """
    parts = F.split(F.regexp_replace("id", r"^[^/]*/", ""), "-")
    d = drafts.select("id").distinct().withColumn("_p", parts).withColumn("_o", F.when(F.col("id").contains("/"), F.substring_index("id", "/", 1)))
    d = d.where(F.size("_p") > 1).withColumn("n", F.explode(F.sequence(F.lit(1), F.size("_p") - 1)))
    stem = F.array_join(F.slice("_p", F.lit(1), F.col("n")), "-")
    d = d.withColumn("_f", F.explode(F.filter(F.array(F.struct(F.lit(0).alias("bare"), F.concat("_o", F.lit("/"), stem).alias("stem")), F.struct(F.lit(1).alias("bare"), stem.alias("stem"))), lambda x: x["stem"].isNotNull())))
    d = d.select("id", "n", F.col("_f.bare").alias("bare"), F.col("_f.stem").alias("stem"), F.array_join(F.expr("slice(_p, n + 1, size(_p))"), "-").alias("rest"))
    hits = _lookup(d, "stem", "model", aliases, "hit").where("hit is not null and hit <> id")
    best = hits.groupBy("id").agg(F.min_by(F.struct("hit", "rest"), F.struct((-F.col("n")).alias("n"), "bare")).alias("_b"))
    version = F.col("_b.rest").rlike(r"^(?:v?\d+(?:[.-]\d+)*)$")
    return best.select("id", F.col("_b.hit").alias("base"), F.when(version, "variant").otherwise("finetune").alias("relationship"), F.when(version, "version").alias("axis"))


def infer_snapshot_edges(ids: DataFrame, index: DataFrame) -> DataFrame:
    """(id, parent): the first snapshot stem of an id that the index (form, canonical_id) knows by its index key."""
    known = index.groupBy(keys.index_key(F.col("form")).alias("_k")).agg(F.min("canonical_id").alias("parent"))
    stems = ids.select("id").distinct().select("id", F.posexplode(keys.snapshot_stems(F.col("id"))).alias("rank", "stem"))
    hits = stems.withColumn("_k", keys.index_key(F.col("stem"))).join(known, "_k").where("parent <> id")
    return hits.groupBy("id").agg(F.min_by("parent", "rank").alias("parent"))


def guard_redirects(pairs: DataFrame, deny: DataFrame, org_map: DataFrame) -> DataFrame:
    """Redirects (raw, fixed) that keep identity: not denied, sizes not disjoint, orgs the same after mapping."""
    out = pairs.join(deny.select("raw"), "raw", "left_anti")
    a, b = keys.size_signature(F.col("raw")), keys.size_signature(F.col("fixed"))
    out = out.where((F.size(a) == 0) | (F.size(b) == 0) | F.arrays_overlap(a, b))
    return orgs_agree(out, "raw", "fixed", org_map, org_map.select(F.col("org").alias("id"))).where("agree").drop("agree")


def defer_targets(groups: DataFrame, authority: DataFrame, org_map: DataFrame) -> DataFrame:
    """(id, target): the attested repo that a catalogue group (id, org, forms) is, within its own developer; others are to be minted.

    ``authority`` has fixed_id, status and seq; only rows fixed exactly or nearly count, of one name the first. A form is
    compared by its last part, with and without a leading word that stands for the group's org. The shortest form that
    hits decides (fewest words, then characters, then the alphabet). Groups without an org give nothing.
    """
    leaf = lambda c: keys.match_key(F.regexp_replace(c, "(?s)^.*/", ""))
    real = authority.where("status in ('fixed_exact', 'fixed_near_miss') and contains(fixed_id, '/')")
    real = real.withColumn("name", F.lower(F.substring_index("fixed_id", "/", 1))).join(org_map, "name", "left")
    real = real.groupBy(F.coalesce("org", "name").alias("org"), keys.match_key(F.regexp_replace("fixed_id", "^[^/]*/", "")).alias("_k")).agg(F.min_by("fixed_id", F.struct("seq", "fixed_id")).alias("target"))
    g = groups.where("org is not null").select("id", "org", F.explode(F.array_union(F.filter("forms", lambda x: x.isNotNull()), F.array("id"))).alias("_f"))
    g = sized(g.select("id", "org", leaf(F.col("_f")).alias("_k")), "leaves")
    branded = g.withColumn("name", F.substring_index("_k", " ", 1)).join(org_map.withColumnRenamed("org", "_o"), "name").where("_o = org and contains(_k, ' ')")
    names = g.unionByName(branded.select("id", "org", F.regexp_replace("_k", "^[^ ]* ", "").alias("_k"))).where("_k <> ''")
    spaces = F.length("_k") - F.length(F.replace("_k", F.lit(" "), F.lit("")))
    return names.join(real, ["org", "_k"]).groupBy("id").agg(F.min_by("target", F.struct(spaces.alias("s"), F.length("_k").alias("l"), "_k")).alias("target"))


def case_variants(names: DataFrame, entities: DataFrame, column: str = "raw_value") -> DataFrame:
    """(column, id): the least entity id that equals a name up to case."""
    ids = entities.groupBy(F.lower("id").alias("_k")).agg(F.min("id").alias("id"))
    return names.select(column).distinct().withColumn("_k", F.lower(column)).join(ids, "_k").drop("_k")


def stolen_forms(forms: DataFrame, owners: DataFrame) -> DataFrame:
    """Forms (form, id) that another id already owns, exactly or by match key; with ``owner``."""
    exact = owners.groupBy("form").agg(F.min("id").alias("_e"))
    norm = owners.groupBy(keys.match_key(F.col("form")).alias("_k")).agg(F.min("id").alias("_n"))
    out = forms.join(exact, "form", "left").withColumn("_k", keys.match_key(F.col("form"))).join(norm, "_k", "left").drop("_k")
    return out.withColumn("owner", F.coalesce("_e", "_n")).drop("_e", "_n").where("owner is not null and owner <> id")


def attribute_orgs(entries: DataFrame, org_map: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries with ``org_id``, merges): ids without an org get that of their leading token.

    Where a row with an org has the same org and name key, the bare id is to be merged into the smallest such id.
    """
    lead = F.regexp_extract(F.lower("id"), r"^([a-z]+)", 1)
    bare = entries.where("org_id is null and not contains(id, '/')").withColumn("name", lead).join(org_map, "name").drop("name")
    key = lambda c: keys.name_key(F.regexp_replace(c, r"^[^/]*/", ""))
    slashed = entries.where("contains(id, '/')").select(F.coalesce("org_id", F.substring_index("id", "/", 1)).alias("org"), key(F.col("id")).alias("_k"), F.col("id").alias("into"))
    slashed = slashed.groupBy("org", "_k").agg(F.min("into").alias("into"))
    found = bare.withColumn("_k", key(F.col("id"))).join(slashed, ["org", "_k"], "left")
    merges = found.where("into is not null").select("id", "into")
    orgs = found.where("into is null").select("id", F.col("org").alias("_org"))
    out = entries.join(orgs, "id", "left").withColumn("org_id", F.coalesce("org_id", "_org")).drop("_org")
    return out, merges
