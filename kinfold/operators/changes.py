"""Writes as change sets: each takes a table and changes and returns the new snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import keys

ALIAS_KEY = ["entity_type", "raw_value", "source_config"]


def upsert(base: DataFrame, changes: DataFrame, key: str = "id", now: str | None = None) -> DataFrame:
    """Changes overwrite the columns they have; other columns, and ``created_at``, stay. The last change of a key (by ``seq``) counts.

    Where there is no ``seq``, or two changes share the last one, the greater one by its values counts, so that a key never has two rows.

    ``now`` is the time for ``updated_at`` of changed rows and for ``created_at`` of new ones.
    """
    given = [c for c in changes.columns if c not in (key, "seq", "created_at")]
    order = F.struct(*([F.col("seq")] if "seq" in changes.columns else []), F.to_json(F.struct(*given)))
    changes = changes.groupBy(key).agg(F.max_by(F.struct(*given), order).alias("_c")).select(key, "_c.*")
    c = changes.select(F.col(key).alias("_k"), *(F.col(x).alias(f"_n_{x}") for x in given))
    out = base.join(c, base[key] == F.col("_k"), "full_outer")
    new = F.col("_k").isNotNull()
    columns = [F.coalesce(F.col(key), F.col("_k")).alias(key)]
    for x in base.columns:
        if x == key:
            continue
        value = F.when(new, F.col(f"_n_{x}")).otherwise(F.col(x)) if x in given else F.col(x)
        if now and x == "updated_at":
            value = F.when(new, F.lit(now)).otherwise(F.col(x))
        if now and x == "created_at":
            value = F.coalesce(F.col(x), F.when(new, F.lit(now)))
        columns.append(value.alias(x))
    return out.select(*columns)


def insert_aliases(base: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ok, clashes): new aliases whose key is free; those that meet a live alias or each other."""
    scope = F.coalesce("source_config", F.lit(""))
    live = base.where(F.coalesce("status", F.lit("")) != "rejected").select("entity_type", "raw_value", scope.alias("_s"), F.lit("taken").alias("_why")).distinct()
    rows = new.withColumn("_s", scope)
    repeated = rows.groupBy("entity_type", "raw_value", "_s").agg(F.count("*").alias("_n"))
    rows = rows.join(repeated, ["entity_type", "raw_value", "_s"]).join(live, ["entity_type", "raw_value", "_s"], "left")
    why = F.coalesce("_why", F.when(F.col("_n") > 1, "repeated"))
    rows = rows.withColumn("reason", why).drop("_s", "_why", "_n")
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null")


def seed_aliases(entities: DataFrame, scoped: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(aliases, double claims) of entities (id, entity_type, display_name, aliases): ids, names and aliases.

    ``scoped`` has entity_type, id, raw_value and source_config. A form two ids claim at once is reported, not seeded.
    """
    forms = F.array_distinct(F.filter(F.concat(F.array("id", "display_name"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda x: x.isNotNull() & (F.trim(x) != "")))
    rows = entities.select("entity_type", F.col("id").alias("canonical_id"), F.explode(forms).alias("raw_value"), F.lit(None).cast("string").alias("source_config"))
    if scoped is not None:
        rows = rows.unionByName(scoped.select("entity_type", F.col("id").alias("canonical_id"), "raw_value", "source_config"))
    key = ["entity_type", "raw_value", "source_config"]
    claims = rows.groupBy(*key).agg(F.array_sort(F.collect_set("canonical_id")).alias("owners"))
    ok = claims.where(F.size("owners") == 1).select(*key, F.get("owners", F.lit(0)).alias("canonical_id"))
    return ok, claims.where(F.size("owners") > 1)


def refresh_aliases(compared: DataFrame) -> DataFrame:
    """Aliases after a rerun (rows of compare_stored): a confirmed one is never repointed, only noted; a disagreeing attestation makes
    it uncertain; spelling changes are followed.
    """
    confirmed = F.col("status") == "confirmed"
    follow = F.col("outcome") == "case_only"
    flag = F.col("outcome") == "attested_disagrees"
    note = F.concat(F.lit("resolves to "), F.col("fresh_id"))
    return (
        compared.withColumn("notes", F.when((follow | flag) & (confirmed | flag), note).otherwise(F.col("notes")))
        .withColumn("canonical_id", F.when(follow & ~confirmed, F.col("fresh_id")).otherwise(F.col("canonical_id")))
        .withColumn("status", F.when(flag & ~confirmed, "uncertain").otherwise(F.col("status")))
    )


def patch_aliases(base: DataFrame, patches: DataFrame, now: str | None = None) -> DataFrame:
    """Review patches by alias id; a null in a patch leaves the column as it is."""
    given = [c for c in patches.columns if c != "id"]
    p = patches.select("id", *(F.col(c).alias(f"_p_{c}") for c in given), F.lit(True).alias("_hit"))
    out = base.join(p, "id", "left")
    for c in given:
        out = out.withColumn(c, F.coalesce(f"_p_{c}", c))
    if now and "updated_at" in base.columns:
        out = out.withColumn("updated_at", F.when(F.col("_hit"), F.lit(now)).otherwise(F.col("updated_at")))
    return out.select(*base.columns)


def prune_stale(aliases: DataFrame, entities: DataFrame, seeded: DataFrame, kept_entities: DataFrame, referenced: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(aliases, entities) without seed aliases and reviewed entities that the snapshot no longer has.

    Referenced entities, and those with an alias that isn't from the seed, stay.
    """
    null = F.lit("\x00")
    key = lambda df: df.withColumn("_s", F.coalesce("source_config", null))
    four = ["entity_type", "raw_value", "_s", "canonical_id"]
    stale = key(aliases.where("strategy = 'seed'")).join(key(seeded).select(*four), four, "left_anti").select("id")
    left = aliases.join(stale, "id", "left_anti")
    gone = entities.where("review_status = 'reviewed'").select("id").join(kept_entities.select("id"), "id", "left_anti").join(referenced.select("id"), "id", "left_anti")
    gone = gone.join(left.where("coalesce(strategy, '') <> 'seed'").select(F.col("canonical_id").alias("id")), "id", "left_anti")
    return left, entities.join(gone, "id", "left_anti")


def mint_drafts(unmatched: DataFrame, entities: DataFrame) -> DataFrame:
    """Draft entities for mentions (raw_value, entity_type) without a match: id, names, tags, status.

    The id is the mention where it is an org and a name, else a slug; one that is taken gets a hash behind it. Spellings
    with one match key share a draft, named by the least spelling. Families and composites get none.
    """
    m = unmatched.where(~F.col("entity_type").isin("family", "composite")).select("raw_value", "entity_type").distinct()
    one = m.groupBy("entity_type", keys.match_key(F.col("raw_value")).alias("_k")).agg(F.min("raw_value").alias("raw_value"))
    shaped = keys.is_repo_id(F.col("raw_value")) & (F.col("entity_type") == "model")
    one = one.withColumn("id", F.when(shaped, F.trim("raw_value")).otherwise(keys.slug(F.col("raw_value"))))
    taken = entities.select(F.col("id"), "entity_type", F.lit(True).alias("_t")).distinct()
    one = one.join(taken, ["id", "entity_type"], "left")
    n = F.count("*").over(Window.partitionBy("id", "entity_type"))
    one = one.withColumn("id", F.when(F.col("_t") | (n > 1), F.concat("id", F.lit("-"), F.substring(F.sha2("raw_value", 256), 1, 6))).otherwise(F.col("id")))
    org = F.when(shaped, F.substring_index("id", "/", 1))
    return one.select("id", "entity_type", F.when(F.col("entity_type") == "model", keys.display_name(F.col("raw_value"))).otherwise(F.col("raw_value")).alias("display_name"), org.alias("org_id"), F.lit("draft").alias("review_status"), F.array(F.lit("auto-created")).alias("tags"), "_k")


def draft_aliases(unmatched: DataFrame, drafts: DataFrame) -> DataFrame:
    """Uncertain aliases from every spelling to its draft."""
    d = drafts.select("entity_type", "_k", F.col("id").alias("canonical_id"))
    rows = unmatched.select("raw_value", "entity_type", "source_config").distinct().withColumn("_k", keys.match_key(F.col("raw_value")))
    return rows.join(d, ["entity_type", "_k"]).select("raw_value", "entity_type", "source_config", "canonical_id", F.lit("uncertain").alias("status"), F.lit("auto").alias("strategy"))


def enrich_drafts(drafts: DataFrame, external: DataFrame, index: DataFrame) -> DataFrame:
    """Add date, size, weights and resolved base edges of external rows to drafts of the same id (in any case).

    External base_models (array of ids) are looked up in ``index`` (form, canonical_id); unknown ones are dropped.
    """
    known = index.groupBy(keys.index_key(F.col("form")).alias("_k")).agg(F.min("canonical_id").alias("base"))
    bases = external.select(F.lower("id").alias("_id"), "relation", F.explode("base_models").alias("raw")).withColumn("_k", keys.index_key(F.col("raw"))).join(known, "_k").where(F.lower("base") != F.col("_id"))
    bases = bases.groupBy("_id").agg(F.array_sort(F.collect_set(F.struct(F.col("base").alias("id"), F.coalesce("relation", F.lit("finetune")).alias("relationship"), F.lit(None).cast("string").alias("axis")))).alias("parents"))
    row = external.groupBy(F.lower("id").alias("_id")).agg(*(F.min_by(c, "id").alias(c) for c in ("release_date", "params_billions", "open_weights")))
    return drafts.withColumn("_id", F.lower("id")).join(row, "_id", "left").join(bases, "_id", "left").drop("_id")


def log_rows(results: DataFrame, run_id: str, now: str) -> DataFrame:
    """One log row per mention resolved in a run; ``created_new`` (false where the results have none) tells drafts made in this run."""
    once = results.dropDuplicates(["raw_value", "entity_type", "source_config"])
    new = F.coalesce("created_new", F.lit(False)) if "created_new" in results.columns else F.lit(False)
    key = F.sha2(F.concat_ws("\x00", F.lit(run_id), "entity_type", "raw_value", F.coalesce("source_config", F.lit(""))), 256)
    return once.select(F.substring(key, 1, 16).alias("id"), "raw_value", "entity_type", "source_config", "canonical_id", "strategy", "confidence", new.alias("created_new"), F.lit(run_id).alias("sync_run_id"), F.lit(now).alias("created_at"))


def run_summary(run_id: str, facts: DataFrame, aliases_before: DataFrame, aliases_after: DataFrame, drafts: DataFrame, errors: DataFrame, rerun: bool = False) -> DataFrame:
    """One row of counts; failed if there are errors. Growth in aliases counts as updates in a rerun."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    out = n(facts, "records_processed").crossJoin(n(aliases_before, "_b")).crossJoin(n(aliases_after, "_a")).crossJoin(n(drafts, "entities_created")).crossJoin(n(errors, "n_errors"))
    grown = F.col("_a") - F.col("_b")
    return out.select(F.lit(run_id).alias("id"), F.when(F.col("n_errors") > 0, "failed").otherwise("completed").alias("status"), "records_processed", (F.lit(0) if rerun else grown).cast("long").alias("aliases_created"), (grown if rerun else F.lit(0)).cast("long").alias("aliases_updated"), "entities_created", "n_errors")
