"""Catalogue and residual work: external features, attaching spellings, re-keying, splitting and minting."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import keys
from . import match, merge


def external_features(rows: DataFrame, useful_tags: list[str]) -> DataFrame:
    """Columns of external repo rows: date, open weights, size, licence, useful tags, base edges and metadata.

    ``card`` is JSON text; ``base_relation`` and ``base_models`` give the edges. Metadata is kept only where it has more than two keys.
    """
    tags = F.array_sort(F.array_distinct(F.filter("tags", lambda t: F.lower(t).isin(*[x.lower() for x in useful_tags]))))
    meta = F.map_filter(F.create_map(F.lit("license"), F.get_json_object("card", "$.license"), F.lit("library"), F.col("library_name"), F.lit("pipeline"), F.col("pipeline_tag"), F.lit("downloads"), F.col("downloads").cast("string")), lambda k, v: v.isNotNull())
    base = F.transform(F.coalesce("base_models", F.array().cast("array<string>")), lambda b: F.struct(b.alias("id"), F.coalesce("base_relation", F.lit("finetune")).alias("relationship"), F.lit(None).cast("string").alias("axis")))
    return rows.select(
        "id", F.substring("created_at", 1, 10).alias("release_date"), (F.col("total").isNotNull() | F.col("has_gguf")).alias("open_weights"), F.round(F.col("total") / 1e9, 2).alias("params_billions"),
        F.get_json_object("card", "$.license").alias("license"), tags.alias("tags"), base.alias("parents"), F.when(F.size(meta) > 2, F.to_json(meta)).alias("metadata"),
    )


def flatten_provenance(entries: DataFrame, sources: str = "alias_platforms") -> DataFrame:
    """Join a map {alias: platform} into the aliases (but the id) and keep its known platforms as ``provenance``."""
    given = F.filter(F.map_keys(sources), lambda a: a != F.col("id"))
    none = F.array().cast("array<string>")
    return entries.withColumn("aliases", F.array_union(F.coalesce("aliases", none), F.coalesce(given, none))).withColumn("provenance", F.map_filter(sources, lambda k, v: v.isNotNull())).drop(sources)


def family_rollup(records: DataFrame) -> DataFrame:
    """One row per family: modalities and snapshots joined and sorted, the earliest date."""
    joined = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return records.groupBy("family").agg(joined("input_modalities"), joined("output_modalities"), F.array_sort(F.collect_set("release_date")).alias("dates"), F.array_sort(F.collect_set("model_id")).alias("snapshots"), F.min("release_date").alias("release_date"))


def attach_aliases(entries: DataFrame, records: DataFrame) -> DataFrame:
    """(id, form, platform): provider spellings (grp, form, platform, pos) of a group's entries (id, grp), where sizes and versions fit.

    A form that another entry owns isn't attached; the first known platform stays.
    """
    e = entries.select("id", "grp", keys.size_signature(F.col("id")).alias("_s"), keys.signature(keys.match_key(F.regexp_replace("id", r"^[^/]*/", ""))).alias("_k"))
    r = records.withColumn("_s", keys.size_signature(F.col("form"))).withColumn("_k", keys.signature(keys.match_key(F.regexp_replace("form", r"^[^/]*/", ""))))
    fits = r.join(e, ["grp", "_s", "_k"])
    fits = fits.join(match.stolen_forms(fits.select("form", "id").distinct(), entries.select(F.col("id").alias("form"), "id")).select("form", "id"), ["form", "id"], "left_anti")
    return fits.groupBy("id", "form").agg(F.min_by("platform", F.when(F.col("platform").isNotNull(), F.col("pos"))).alias("platform"))


def tag_external(entries: DataFrame, external: DataFrame) -> DataFrame:
    """Add ``external_key``: whether a full entry's id is a cleaned catalogue key."""
    known = external.select(keys.catalogue_key(F.col("key")).alias("_k"), F.lit(True).alias("_t")).distinct()
    return entries.withColumn("_k", keys.catalogue_key(F.col("id"))).join(known, "_k", "left").withColumn("external_key", F.coalesce("_t", F.lit(False))).drop("_k", "_t")


def partition_targets(targets: DataFrame, incumbents: DataFrame) -> DataFrame:
    """(id, action, incumbent): a true id is there already (ok), takes over an incumbent of its match key (rekey), or is new (mint).

    An incumbent is re-keyed at most once, to the smallest id.
    """
    exact = incumbents.select(F.col("id"), F.lit(True).alias("_e")).distinct()
    norm = incumbents.groupBy(keys.match_key(F.col("id")).alias("_k")).agg(F.min("id").alias("incumbent"))
    t = targets.select("id").distinct().join(exact, "id", "left").withColumn("_k", keys.match_key(F.col("id"))).join(norm, "_k", "left")
    first = t.where("_e is null and incumbent is not null").groupBy("incumbent").agg(F.min("id").alias("_first"))
    t = t.join(first, "incumbent", "left")
    action = F.when(F.col("_e"), "ok").when(F.col("id") == F.col("_first"), "rekey").otherwise("mint")
    return t.select("id", action.alias("action"), F.when(action == "rekey", F.col("incumbent")).alias("incumbent"))


def reconcile_existing(fresh: DataFrame, existing: DataFrame, org_map: DataFrame) -> dict[str, DataFrame]:
    """Fresh rows (id, org, forms) against existing ones: what folds gives its forms to the owner, the rest stays without stolen forms."""
    folds = match.decide_folds(fresh, existing, org_map)
    donated = fresh.join(folds, "id").select("target", F.explode(F.concat(F.array("id"), "forms")).alias("form")).where("form <> target").distinct()
    owners = existing.select("id", F.explode(F.concat(F.array("id"), "aliases")).alias("form")).unionByName(donated.select(F.col("target").alias("id"), "form"))
    kept = fresh.join(folds.select("id"), "id", "left_anti")
    forms = kept.select("id", F.explode("forms").alias("form")).distinct()
    clean = forms.join(match.stolen_forms(forms, owners).select("form", "id"), ["form", "id"], "left_anti").groupBy("id").agg(F.array_sort(F.collect_set("form")).alias("forms"))
    return {"folds": folds, "donated": donated, "kept": kept.drop("forms").join(clean, "id", "left")}


def split_catalogue(fresh: DataFrame, existing: DataFrame, org_map: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(minted, enrichments): fresh rows that are new, and (id, aliases) that existing rows gain."""
    out = reconcile_existing(fresh, existing, org_map)
    return out["kept"], out["donated"].groupBy(F.col("target").alias("id")).agg(F.array_sort(F.collect_set("form")).alias("aliases"))


def canonicalize_layers(layers: DataFrame, org_map: DataFrame, read_only: list[int]) -> tuple[DataFrame, DataFrame]:
    """(layers, report): ``org_id`` mapped in every layer but read-only ones; the report counts changes and, for read-only layers, warnings."""
    out = layers.withColumn("_l", F.lower("org_id")).join(org_map.select(F.col("name").alias("_l"), F.col("org").alias("_m")), "_l", "left").withColumn("_new", F.coalesce("_m", "org_id"))
    locked = F.col("layer_rank").isin(*read_only) if read_only else F.lit(False)
    report = out.where("_new <> org_id").groupBy("layer_rank").agg(F.count("*").alias("n"), F.bool_or(locked).alias("warning"))
    return out.withColumn("org_id", F.when(locked, F.col("org_id")).otherwise(F.col("_new"))).drop("_l", "_m", "_new"), report


def residual_mint(unmatched: DataFrame, existing: DataFrame, org_map: DataFrame) -> dict[str, DataFrame]:
    """What matching left open: folds onto existing rows, one draft for each twin (org, name key and sizes), and the rest to review.

    A mention with a placeholder org is tried without it first; bare names have no org to mint under and go to review.
    """
    m = unmatched.select("raw_value").distinct()
    org = F.when(F.col("raw_value").contains("/"), F.lower(F.substring_index("raw_value", "/", 1)))
    m = m.withColumn("org", F.when(~org.isin(*keys.PLACEHOLDER_ORGS), org)).withColumn("id", F.when(org.isin(*keys.PLACEHOLDER_ORGS), F.regexp_replace("raw_value", "^[^/]*/", "")).otherwise(F.col("raw_value")))
    folds = match.decide_folds(m.select("id", "org", F.array("raw_value").alias("forms")).dropDuplicates(["id", "org"]), existing, org_map)
    left = m.join(folds.select("id"), "id", "left_anti")
    twin = ["org", "_k", "_s"]
    new = left.where("org is not null").withColumn("_k", keys.name_key(F.regexp_replace("id", r"^[^/]*/", ""))).withColumn("_s", keys.size_signature(F.col("id")))
    best = new.groupBy(*twin).agg(F.min_by("id", F.struct((F.col("id") == F.lower("id")).alias("a"), F.length("id").alias("l"), "id")).alias("draft"))
    return {"folds": folds, "drafts": new.join(best, twin).select("raw_value", "draft"), "review": left.where("org is null").select("raw_value")}
