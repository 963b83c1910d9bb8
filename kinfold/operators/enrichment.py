"""Known models enriched in bulk from a large table of repositories.

The large table is read once, with the ids that known models name; only what is found goes on. A repository enriches the model
that its id leads to, and never takes a form from another one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import keys
from ..storage import sized
from . import match, merge, reconcile

FACTS = ("release_date", "params_billions", "open_weights", "tags")


def _leaf(c: Column) -> Column:
    return F.regexp_replace(c, r"^[^/]*/", "")


def _aliases() -> Column:
    return F.coalesce("aliases", F.array().cast("array<string>"))


def candidates(entries: DataFrame, spellings: DataFrame) -> DataFrame:
    """Repository ids to look up (id): ids and aliases of entries (id, aliases) that have an org, and ids under every other
    spelling (org, spelling) of their org."""
    named = entries.select(F.explode(F.array_append(_aliases(), F.col("id"))).alias("id"))
    other = entries.select(F.substring_index("id", "/", 1).alias("org"), "id").join(spellings.select("org", "spelling"), "org")
    other = other.where(F.contains("id", F.lit("/"))).select(F.concat("spelling", F.lit("/"), _leaf(F.col("id"))).alias("id"))
    return named.unionByName(other).where(F.contains("id", F.lit("/"))).distinct()


def form_index(entries: DataFrame) -> DataFrame:
    """(key, owner, form): whom a match key leads to, and by which form: the first entry (``seq``) with that id, else the first with that alias.

    Aliases count where they have an org.
    """
    ids = entries.select("id", "seq", F.col("id").alias("form"), F.lit(0).alias("tier"))
    aliases = entries.select("id", "seq", F.explode(_aliases()).alias("form"), F.lit(1).alias("tier")).where(F.contains("form", F.lit("/")))
    return _first_owner(ids.unionByName(aliases))


def name_index(entries: DataFrame) -> DataFrame:
    """(key, owner, form): the first entry whose id, or id without org, has a match key."""
    forms = F.array_distinct(F.array("id", _leaf(F.col("id"))))
    return _first_owner(entries.select("id", "seq", F.explode(forms).alias("form"), F.lit(0).alias("tier")))


def _first_owner(forms: DataFrame) -> DataFrame:
    first = F.min(F.struct("tier", "seq", "id", "form"))
    return forms.groupBy(keys.match_key(F.col("form")).alias("key")).agg(first.alias("_f")).select("key", F.col("_f.id").alias("owner"), "_f.form")


def _developer_id(df: DataFrame, column: str, org_map: DataFrame, name: str) -> DataFrame:
    """Add ``name``: a repository's id under its org's developer (name, org), as it is where the org has none."""
    known = org_map.groupBy(F.lower("name").alias("_o")).agg(F.min("org").alias("_dev"))
    out = df.withColumn("_o", F.lower(F.substring_index(column, "/", 1))).join(known, "_o", "left")
    return out.withColumn(name, F.when(F.col("_dev").isNotNull() & F.contains(column, F.lit("/")), F.concat("_dev", F.lit("/"), _leaf(F.col(column)))).otherwise(F.col(column))).drop("_o", "_dev")


def targets(repos: DataFrame, entries: DataFrame, index: DataFrame, org_map: DataFrame) -> DataFrame:
    """(repo, id): the entry that each repository (id) enriches; none where nobody is known by its id, or where that entry shares a
    form with another one, as more forms could tip the match between the two."""
    out = _developer_id(repos.select(F.col("id").alias("repo")).distinct(), "repo", org_map, "_c")
    out = out.withColumn("key", keys.match_key(F.col("_c"))).join(index.select("key", F.col("owner").alias("id")), "key")
    forms = entries.select("id", F.explode(F.array_distinct(F.concat(F.array("id", _leaf(F.col("id"))), _aliases()))).alias("form")).where("form <> ''")
    return out.join(merge.ambiguous(forms), "id", "left_anti").select("repo", "id")


def free_aliases(pairs: DataFrame, index: DataFrame, names: DataFrame) -> DataFrame:
    """(repo, id) of ``pairs`` whose repository id may become an alias: another form than the id, and no one else's by itself or without its org."""
    out = pairs.where("repo <> id")
    for owners, form in ((index, F.col("repo")), (names, F.col("repo")), (names, _leaf(F.col("repo")))):
        taken = owners.select("key", F.col("owner").alias("_owner"))
        out = out.withColumn("key", keys.match_key(form)).join(taken, "key", "left").where("_owner is null or _owner = id").drop("key", "_owner")
    return out


def base_edges(repos: DataFrame, pairs: DataFrame, index: DataFrame, org_map: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parents, origins): (repo, parents) and (repo, lineage_org) from ``base_models`` (array of ids) and ``relation``.

    A base is looked up by itself, then under its org's developer; unknown ones are dropped, so are edges to the entry itself. Without an edge
    to a version, one to the entry that the id is a dated snapshot of is added. The first edge that isn't a variant gives the developer
    that the lineage comes from.
    """
    bases = repos.select(F.col("id").alias("repo"), "relation", F.posexplode("base_models").alias("pos", "base")).join(pairs, "repo")
    bases = _developer_id(bases, "base", org_map, "_c")
    for column, name in (("base", "_a"), ("_c", "_b")):
        bases = bases.withColumn("key", keys.match_key(F.col(column))).join(index.select("key", F.col("owner").alias(name)), "key", "left").drop("key")
    bases = bases.select("repo", "id", "pos", F.coalesce("_a", "_b").alias("parent"), F.coalesce("relation", F.lit("finetune")).alias("relationship"), F.lit(None).cast("string").alias("axis"))
    bases = sized(bases.where("parent <> id"), "bases")
    forms = index.select("form", F.col("owner").alias("canonical_id"))
    dated = match.infer_snapshot_edges(pairs.select(F.col("repo").alias("id")), forms).withColumnRenamed("id", "repo").join(pairs, "repo").where("parent <> id")
    dated = dated.select("repo", "id", F.lit(1 << 30).alias("pos"), "parent", F.lit("variant").alias("relationship"), F.lit("version").alias("axis"))
    one = bases.unionByName(dated).groupBy("repo", "parent").agg(F.min_by(F.struct("pos", "parent", "relationship", "axis"), "pos").alias("_e"))
    parents = one.groupBy("repo").agg(F.transform(F.array_sort(F.collect_list("_e")), lambda e: F.struct(e["parent"].alias("id"), e["relationship"].alias("relationship"), e["axis"].alias("axis"))).alias("parents"))
    first = bases.where("relationship <> 'variant'").groupBy("repo").agg(F.min_by("parent", "pos").alias("_p"))
    known = org_map.groupBy(F.lower("name").alias("_o")).agg(F.min("org").alias("_dev"))
    first = first.where(F.contains("_p", F.lit("/"))).withColumn("_org", F.substring_index("_p", "/", 1)).withColumn("_o", F.lower("_org")).join(known, "_o", "left")
    return parents, first.select("repo", F.coalesce("_dev", "_org").alias("lineage_org"))


def enrich_known(entries: DataFrame, spellings: DataFrame, repos: DataFrame, org_map: DataFrame, committed: DataFrame | None = None) -> DataFrame:
    """What repositories add to known entries: id, FACTS, parents, lineage_org, repo_id, aliases, removed; one row per entry.

    ``entries`` (id, aliases, seq) in their layers' order, ``spellings`` (org, spelling) and ``org_map`` (name, org) of orgs and their developers,
    ``repos`` (id, FACTS, relation, base_models). Of several repositories of one entry the one of the latest date counts (then the one with the
    greater id), with the aliases of all. ``repo_id`` says that the entry is that repository: it is null where the entry is spelled otherwise and
    the repository isn't an entry itself. Rows of ``committed`` (an earlier result) whose entry isn't found any more stay, as removed.
    """
    found = sized(repos.join(candidates(entries, spellings), "id", "left_semi").dropDuplicates(["id"]), "found")
    index, names = sized(form_index(entries), "forms"), name_index(entries)
    pairs = sized(targets(found, entries, index, org_map), "targets")
    parents, origins = base_edges(found, pairs, index, org_map)
    free = free_aliases(pairs, index, names).select("repo", F.array("repo").alias("aliases"))
    own = index.select("key", F.col("owner").alias("_owner"))
    rows = pairs.join(found.select(F.col("id").alias("repo"), *FACTS), "repo").join(parents, "repo", "left").join(origins, "repo", "left").join(free, "repo", "left")
    rows = rows.withColumn("key", keys.match_key(F.col("repo"))).join(own, "key", "left")
    claim = F.when((F.col("repo") == F.col("id")) | (F.col("_owner") == F.col("repo")), F.col("repo"))
    rows = rows.select("id", *FACTS, F.coalesce("parents", F.array().cast(reconcile.EDGES)).alias("parents"), "lineage_org", claim.alias("repo_id"), _aliases().alias("aliases"), F.struct("release_date", "repo").alias("_order"))
    out = merge.latest_by_id(rows, "_order").drop("_order")
    if committed is None:
        return out.withColumn("removed", F.lit(False))
    return merge.carry_forward(out, committed.select(out.columns))
