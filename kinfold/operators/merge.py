"""Merging layers, folding duplicates, ownership and carry-forward."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import keys
from ..storage import sized
from . import graph


def _rank() -> Column:
    return F.struct("layer_rank", "file", "pos")


def _filled(c: str, kind: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c) != "" if kind == "string" else F.lit(True))


def merge_layers(layers: DataFrame, scalars: list[str], unions: list[str] = (), maps: list[str] = (), edges: str | None = None) -> DataFrame:
    """One row per id: of scalars the last that isn't empty, lists joined without repeats in case, maps by key the last.

    ``edges`` names a list of parents (id, relationship, axis), joined by the parent's id: an edge keeps its first place, and of
    its fields the last that isn't empty counts.

    Rows have layer_rank, file and pos for their order. List items keep the order and the spelling of their first place.
    """
    kinds = dict(layers.dtypes)
    out = layers.groupBy("id").agg(*(F.max_by(F.when(_filled(c, kinds[c]), F.col(c)), F.when(_filled(c, kinds[c]), _rank())).alias(c) for c in scalars), F.count("*").alias("n_rows"))
    for c in unions:
        items = layers.select("id", _rank().alias("_r"), F.posexplode(c).alias("_k", "_v")).where("_v is not null")
        first = items.groupBy("id", F.lower("_v").alias("_l")).agg(F.min(F.struct("_r", "_k", "_v")).alias("_f"))
        lists = first.groupBy("id").agg(F.transform(F.array_sort(F.collect_list("_f")), lambda x: x["_v"]).alias(c))
        out = out.join(lists, "id", "left").withColumn(c, F.coalesce(c, F.array().cast("array<string>")))
    for c in maps:
        items = layers.select("id", _rank().alias("_r"), F.explode(c).alias("_k", "_v")).groupBy("id", "_k").agg(F.max_by("_v", "_r").alias("_v"))
        out = out.join(items.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_v")))).alias(c)), "id", "left")
    if edges:
        items = layers.select("id", _rank().alias("_n"), F.posexplode(edges).alias("_k", "_e")).select("id", "_e", F.struct("_n", "_k").alias("_r"))
        items = items.where("_e.id <> ''")
        last = lambda f: F.max_by(f"_e.{f}", F.when(F.col(f"_e.{f}") != "", F.col("_r"))).alias(f)
        each = items.groupBy("id", F.col("_e.id").alias("_p")).agg(F.min("_r").alias("_r"), last("relationship"), last("axis"))
        lists = each.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("_r", F.struct(F.col("_p").alias("id"), "relationship", "axis").alias("e")))).alias("_l"))
        out = out.join(lists.select("id", F.transform("_l", lambda x: x["e"]).alias(edges)), "id", "left").withColumn(edges, F.coalesce(edges, F.array().cast(kinds[edges])))
    return out


def fill_weak(core: DataFrame, weak: DataFrame, fields: list[str]) -> DataFrame:
    """Fill fields that are empty and that no core entry states explicitly (``explicit_keys``); the first weak value wins."""
    kinds = dict(weak.dtypes)
    first = weak.groupBy("id").agg(*(F.min_by(c, F.when(_filled(c, kinds[c]), _rank())).alias(f"_w_{c}") for c in fields))
    out = core.join(first, "id", "left")
    for c in fields:
        free = ~F.coalesce(F.array_contains("explicit_keys", c), F.lit(False))
        out = out.withColumn(c, F.when(_filled(c, kinds[c]), F.col(c)).when(free, F.col(f"_w_{c}")).otherwise(F.col(c))).drop(f"_w_{c}")
    return out


def override_merge(base: DataFrame, curated: DataFrame, fields: list[str], unions: list[str] = ()) -> DataFrame:
    """Curated rows override each field they state (``explicit_keys``), even with null; lists are joined."""
    c = curated.select("id", F.col("explicit_keys").alias("_x"), *(F.col(f).alias(f"_c_{f}") for f in (*fields, *unions)))
    out = base.join(c, "id", "full_outer")
    for f in fields:
        out = out.withColumn(f, F.when(F.coalesce(F.array_contains("_x", f), F.lit(False)), F.col(f"_c_{f}")).otherwise(F.col(f)))
    for f in unions:
        none = F.array().cast(dict(base.dtypes)[f])
        out = out.withColumn(f, F.array_union(F.coalesce(f, none), F.coalesce(f"_c_{f}", none)))
    return out.drop("_x", *(f"_c_{f}" for f in (*fields, *unions)))


def replace_whole(base: DataFrame, curated: DataFrame) -> DataFrame:
    """Curated rows in place of base rows of the same id."""
    return base.join(curated.select("id"), "id", "left_anti").unionByName(curated, allowMissingColumns=True)


def fold_collisions(entries: DataFrame, never: DataFrame | None = None, prefer: DataFrame | None = None, forced: DataFrame | None = None) -> DataFrame:
    """(loser, winner) of ids that collide by collision key.

    A group is left alone if two or more of its rows have a real source, if its sizes differ, or if a never-fold pair
    (a, b) lies in it. The winner is a preferred id, else the one with a real org, the higher ``source_rank``, a dot in
    its name, the shorter and then the larger id. ``forced`` (loser, winner) merges come on top; chains are compressed.
    """
    key, size = keys.collision_key(F.col("id")), keys.size_signature(F.col("id"))
    rows = entries.select("id", "source_rank", "is_real", key.alias("key"), size.alias("size"))
    groups = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("is_real").cast("int")).alias("real"), F.count_distinct("size").alias("sizes")).where("n > 1 and real < 2 and sizes = 1")
    if never is not None:
        inside = never.join(rows.select(F.col("id").alias("a"), "key"), "a").join(rows.select(F.col("id").alias("b"), F.col("key").alias("_k")), "b").where("key = _k").select("key").distinct()
        groups = groups.join(inside, "key", "left_anti")
    rows = rows.join(groups.select("key"), "key")
    rows = rows.join(prefer.select("id", F.lit(True).alias("_p")), "id", "left") if prefer is not None else rows.withColumn("_p", F.lit(None).cast("boolean"))
    org = F.when(F.col("id").contains("/"), F.lower(F.substring_index("id", "/", 1)))
    order = F.struct(F.coalesce("_p", F.lit(False)).alias("p"), (org.isNotNull() & ~org.isin(*keys.PLACEHOLDER_ORGS)).alias("o"), F.col("source_rank").alias("s"), F.col("id").rlike(r"\d\.\d").alias("d"), (-F.length("id")).alias("l"), F.col("id").alias("i"))
    best = rows.groupBy("key").agg(F.max_by("id", order).alias("winner"))
    remap = rows.join(best, "key").where("id <> winner").select(F.col("id").alias("loser"), "winner")
    return graph.compress_remap(remap if forced is None else remap.unionByName(forced))


def apply_remap(entries: DataFrame, remap: DataFrame, unions: list[str]) -> DataFrame:
    """Losers' list items (and ids) move to their winners; losers go. A loser whose winner has no row stays as it is."""
    remap = remap.join(entries.select(F.col("id").alias("winner")).distinct(), "winner", "left_semi")
    out = entries.join(remap.select(F.col("loser").alias("id")), "id", "left_anti")
    lost = entries.join(remap.select(F.col("loser").alias("id"), "winner"), "id")
    given = lost.select(F.col("winner").alias("id"), *(F.concat(F.array("id") if c == "aliases" else F.array().cast("array<string>"), F.coalesce(c, F.array().cast("array<string>"))).alias(c) for c in unions))
    for c in unions:
        items = given.select("id", F.explode(c).alias("_x")).groupBy("id").agg(F.array_sort(F.collect_set("_x")).alias(f"_g_{c}"))
        out = out.join(items, "id", "left")
    for c in unions:
        out = out.withColumn(c, F.array_union(F.coalesce(c, F.array().cast("array<string>")), F.coalesce(f"_g_{c}", F.array().cast("array<string>")))).drop(f"_g_{c}")
    return out


def duplicate_keys(forms: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """(key, ids): strict keys of (id, form) rows that several ids share, but for groups inside an allowed one (array ``ids``)."""
    out = forms.withColumn("key", keys.strict_key(F.col("form"))).where("key <> ''").groupBy("key").agg(F.array_sort(F.collect_set("id")).alias("ids")).where(F.size("ids") > 1)
    if allowed is None:
        return out
    ok = allowed.select(F.col("ids").alias("_a"), F.explode("ids").alias("_one"))
    inside = out.withColumn("_one", F.get("ids", F.lit(0))).join(ok, "_one").where(F.size(F.array_except("ids", "_a")) == 0).select("key").distinct()
    return out.join(inside, "key", "left_anti")


def dedup_by_id(entries: DataFrame, unions: list[str]) -> DataFrame:
    """One row per id: lists joined and sorted, open if any is, reviewed if any is, the earliest date."""
    return entries.groupBy("id").agg(*(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in unions), F.bool_or("open_weights").alias("open_weights"), F.when(F.bool_or(F.col("review_status") == "reviewed"), "reviewed").otherwise(F.min("review_status")).alias("review_status"), F.min("release_date").alias("release_date"))


def latest_by_id(entries: DataFrame, date: str = "release_date") -> DataFrame:
    """One row per id, that of the latest date; it has the ``aliases`` of all, sorted."""
    others = [c for c in entries.columns if c not in ("id", "aliases")]
    out = entries.groupBy("id").agg(F.max_by(F.struct(*others), F.struct(date, *others)).alias("_r")).select("id", "_r.*")
    if "aliases" not in entries.columns:
        return out
    forms = entries.select("id", F.explode("aliases").alias("_a")).groupBy("id").agg(F.array_sort(F.collect_set("_a")).alias("aliases"))
    return out.join(forms, "id", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def ambiguous(forms: DataFrame) -> DataFrame:
    """Ids (id, form) that share a match key with another id."""
    shared = forms.withColumn("_k", keys.match_key(F.col("form"))).groupBy("_k").agg(F.count_distinct("id").alias("n")).where("n > 1").select("_k")
    return forms.withColumn("_k", keys.match_key(F.col("form"))).join(shared, "_k", "left_semi").select("id").distinct()


def bare_claims(models: DataFrame) -> DataFrame:
    """(leaf, claims, owner): match keys of ids' last parts, how many ids have them, and the only one's id."""
    leaf = keys.match_key(F.regexp_replace("id", r"^.*/", ""))
    return models.groupBy(leaf.alias("leaf")).agg(F.count_distinct("id").alias("claims"), F.min("id").alias("owner"))


def form_owners(forms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(owners, losers): who owns each form of (form, id, is_core): its own id, then core, a natural name, the smallest id."""
    natural = keys.match_key(F.regexp_replace("id", r"^[^/]*/", "")) == keys.match_key(F.regexp_replace("form", r"^[^/]*/", ""))
    order = F.struct((F.col("form") != F.col("id")).alias("a"), (~F.col("is_core")).alias("b"), (~natural).alias("c"), F.col("id").alias("d"))
    owners = forms.groupBy("form").agg(F.min_by("id", order).alias("owner"))
    return owners, forms.join(owners, "form").where("id <> owner")


def prefer_official(mentions: DataFrame, claims: DataFrame) -> DataFrame:
    """Add ``redirect``: for a bare name the one confirmed owner of its leaf."""
    one = claims.where("claims = 1").select(F.col("leaf").alias("_l"), "owner")
    key = F.when(~F.col("raw_value").contains("/"), keys.match_key(F.col("raw_value")))
    return mentions.withColumn("_l", key).join(one, "_l", "left").withColumnRenamed("owner", "redirect").drop("_l")


def community_casing(names: DataFrame, column: str) -> DataFrame:
    """(org_key, spelling): the least spelling of each org key."""
    return names.where(f"{column} is not null").groupBy(keys.org_key(F.col(column)).alias("org_key")).agg(F.min(column).alias("spelling"))


def canonicalize_orgs(df: DataFrame, column: str, org_map: DataFrame, casing: DataFrame, distinct: DataFrame) -> DataFrame:
    """Replace an org by its curated name; listed distinct ones stay; else the community's spelling, else itself."""
    out = df.withColumn("_l", F.lower(column)).join(org_map.select(F.col("name").alias("_l"), F.col("org").alias("_m")), "_l", "left")
    out = out.join(distinct.select(F.col("org").alias(column), F.lit(True).alias("_d")), column, "left").withColumn("_k", keys.org_key(F.col(column))).join(casing.select(F.col("org_key").alias("_k"), "spelling"), "_k", "left")
    return out.withColumn(column, F.coalesce("_m", F.when(F.col("_d"), F.col(column)), "spelling", column)).drop("_l", "_m", "_d", "_k", "spelling")


def carry_forward(fresh: DataFrame, committed: DataFrame) -> DataFrame:
    """Fresh rows, and committed ones that are missing now, tagged removed."""
    gone = committed.join(fresh.select("id"), "id", "left_anti")
    return fresh.withColumn("removed", F.lit(False)).unionByName(gone.withColumn("removed", F.lit(True)), allowMissingColumns=True)


def carry_forward_stable(fresh: DataFrame, committed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, remap): committed ids stay; a fresh id that is a twin of one (same twin key and sizes) is renamed to it.

    A fresh row of a higher ``rung`` promotes itself instead, and the committed id is remapped to it.
    """
    twin = lambda df, p: df.select(F.col("id").alias(f"{p}id"), F.col("rung").alias(f"{p}rung"), keys.size_signature(F.col("id")).alias("_s"), F.explode(keys.twin_keys(F.col("id"))).alias("_k"))
    new = fresh.join(committed.select("id"), "id", "left_anti")
    old = committed.join(fresh.select("id"), "id", "left_anti")
    pairs = twin(new, "f").join(twin(old, "c"), ["_k", "_s"]).groupBy("fid", "frung").agg(F.min(F.struct("cid", "crung")).alias("_c")).select("fid", "frung", "_c.*")
    one = pairs.withColumn("_n", F.row_number().over(Window.partitionBy("cid").orderBy("fid"))).where("_n = 1")
    remap = one.select(F.when(F.col("frung") > F.col("crung"), F.col("cid")).otherwise(F.col("fid")).alias("loser"), F.when(F.col("frung") > F.col("crung"), F.col("fid")).otherwise(F.col("cid")).alias("winner"))
    rows = fresh.join(remap.withColumnRenamed("loser", "id"), "id", "left").withColumn("id", F.coalesce("winner", "id")).drop("winner")
    kept = committed.join(rows.select("id"), "id", "left_anti").join(remap.select(F.col("loser").alias("id")), "id", "left_anti")
    return rows.unionByName(kept, allowMissingColumns=True), remap


def union_layers(layers: list[DataFrame], skip_ids: DataFrame | None = None, skip_source_ids: DataFrame | None = None) -> DataFrame:
    """All layers in order (``layer_rank``), without skipped ids; the second list spares the first (core) layer."""
    out = None
    for rank, df in enumerate(layers):
        if skip_source_ids is not None and rank:
            df = df.join(skip_source_ids.select("id"), "id", "left_anti")
        df = df.withColumn("layer_rank", F.lit(rank))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out if skip_ids is None else out.join(skip_ids.select("id"), "id", "left_anti")


def missing_orgs(entries: DataFrame, orgs: DataFrame) -> DataFrame:
    """Referenced orgs (``org_id``) that have no row; not those whose org key a row has."""
    wanted = entries.where("org_id is not null").select(F.col("org_id").alias("id")).distinct()
    twins = orgs.select(keys.org_key(F.col("id")).alias("_k")).distinct()
    return wanted.join(orgs.select("id"), "id", "left_anti").withColumn("_k", keys.org_key(F.col("id"))).join(twins, "_k", "left_anti").drop("_k")


def without_own_output(entities: DataFrame, aliases: DataFrame, prior: DataFrame, source: str = "inferred") -> tuple[DataFrame, DataFrame]:
    """Entities and aliases without what this job made before (ids in ``prior``), so that reruns agree."""
    own = prior.select("id").join(entities.where(F.col("resolution_source") == source).select("id"), "id", "left_semi")
    return entities.join(own, "id", "left_anti"), aliases.join(own.withColumnRenamed("id", "canonical_id"), "canonical_id", "left_anti")


def nothing_removed(before: DataFrame, claimed: DataFrame, resolved: DataFrame) -> DataFrame:
    """Forms known before that nobody claims now, with what they resolve to: pinned (fuzzy), fine or lost."""
    left = before.select("form").distinct().join(claimed.select("form"), "form", "left_anti")
    out = left.join(resolved.select(F.col("raw_value").alias("form"), "canonical_id", "strategy"), "form", "left")
    return out.withColumn("route", F.when(F.col("canonical_id").isNull(), "lost").when(F.col("strategy") == "fuzzy", "pinned").otherwise("fine"))


def group_catalogue(records: DataFrame, rules: keys.CatalogueRules | None = None) -> DataFrame:
    """Add ``grp``: the catalogue key, or the least key of its signature where their families meet.

    In key order, a key joins the first one if it has a family in common with those that joined before, or either side has
    none. Keys of one signature are orders of the same words, so the sorted list is short however many rows there are. Rows
    with an empty key are left out.
    """
    rows = sized(records.withColumn("_key", keys.catalogue_key(F.col("model_id"), rules)), "keyed").where("_key <> ''")
    each = rows.groupBy("_key").agg(F.collect_set(F.nullif("family", F.lit(""))).alias("fams"))
    listed = each.groupBy(keys.catalogue_signature(F.col("_key")).alias("_sig")).agg(F.array_sort(F.collect_list(F.struct(F.col("_key").alias("key"), "fams"))).alias("all"))

    def join(acc, x):
        meets = (F.size(acc["fams"]) == 0) | (F.size(x["fams"]) == 0) | F.arrays_overlap(acc["fams"], x["fams"])
        return F.when(meets, F.struct(F.array_union(acc["fams"], x["fams"]).alias("fams"), F.array_append(acc["members"], x["key"]).alias("members"))).otherwise(acc)

    none = F.array().cast("array<string>")
    first = F.struct(F.get("all", F.lit(0))["fams"].alias("fams"), none.alias("members"))
    base = listed.where("size(all) > 1").select(F.col("all")[0]["key"].alias("_base"), F.aggregate("all", first, join)["members"].alias("members"))
    return rows.join(base.select(F.explode("members").alias("_key"), "_base"), "_key", "left").withColumn("grp", F.coalesce("_base", "_key")).drop("_key", "_base")


def pick_heads(groups: DataFrame) -> DataFrame:
    """One row per group: commonest family and name (first seen on ties), earliest date, open if any, cleanest spelling."""
    def commonest(c: str) -> DataFrame:
        n = groups.where(F.col(c).isNotNull()).groupBy("grp", c).agg(F.count("*").alias("n"), F.min("pos").alias("p"))
        return n.groupBy("grp").agg(F.max_by(c, F.struct("n", (-F.col("p")).alias("p"))).alias(c))

    out = groups.groupBy("grp").agg(F.min("release_date").alias("release_date"), F.bool_or("open_weights").alias("open_weights"), F.min_by("model_id", F.struct(F.length("model_id").alias("l"), "model_id")).alias("spelling"), F.count("*").alias("n"))
    return out.join(commonest("family"), "grp", "left").join(commonest("name"), "grp", "left")


def reconcile_batch(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, remap): entries that are one by name key and org become one; deferred, adopted, with org, cased, reviewed, short, small wins."""
    leaf = keys.name_key(F.regexp_replace("id", r"^[^/]*/", ""))
    order = F.struct(*((~F.coalesce(c, F.lit(False))).alias(n) for n, c in (("a", F.col("deferred")), ("b", F.col("adopted")), ("c", F.col("org_id").isNotNull()), ("d", F.col("id") != F.lower("id")), ("e", F.col("review_status") == "reviewed"))), F.length("id").alias("l"), F.col("id").alias("i"))
    rows = entries.withColumn("_o", F.lower("org_id")).withColumn("_k", leaf)
    best = rows.groupBy("_o", "_k").agg(F.min_by("id", order).alias("winner"))
    remap = rows.where("_o is not null").join(best, ["_o", "_k"]).where("id <> winner").select(F.col("id").alias("loser"), "winner")
    return apply_remap(entries, remap, ["aliases"]), remap


def adopt_external_ids(entries: DataFrame, external: DataFrame, denied: DataFrame | None = None) -> DataFrame:
    """(id, key): an external key of the same org and signature as an entry; each key and entry once, shortest key first."""
    sig = lambda c: keys.signature(keys.match_key(F.regexp_replace(c, r"^[^/]*/", "")))
    e = entries.select("id", F.lower("org_id").alias("_o"), sig(F.col("id")).alias("_s"))
    x = external.select("key", F.lower(F.substring_index("key", "/", 1)).alias("_o"), sig(F.col("key")).alias("_s"))
    if denied is not None:
        x = x.join(denied.select("key"), "key", "left_anti")
    # Entries and keys of one signature pair off in order, so no pair blocks another.
    by = Window.partitionBy("_o", "_s")
    e = e.withColumn("_n", F.row_number().over(by.orderBy("id")))
    x = x.withColumn("_n", F.row_number().over(by.orderBy(F.length("key"), "key")))
    return e.join(x, ["_o", "_s", "_n"]).where("id <> key").select("id", "key")
