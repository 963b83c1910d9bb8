"""Attributes of models that follow from their ids and their parents, each with its own fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import keys
from ..storage import sized
from . import graph

NO_ORG = "unknown"
NO_ORG_TAG = "org-unknown"


def settle_orgs(models: DataFrame, org_map: DataFrame) -> DataFrame:
    """``org_id`` of rows without one from their id's namespace, by ``org_map`` (name, org), else as it stands.

    An org that is there, even an empty one, stays; an id without a namespace gets none.
    """
    space = F.when(F.col("id").contains("/"), F.nullif(F.substring_index("id", "/", 1), F.lit("")))
    named = models.withColumn("_space", F.when(F.col("org_id").isNull(), space)).withColumn("name", F.lower("_space"))
    known = org_map.groupBy("name").agg(F.max("org").alias("_org"))
    return named.join(known, "name", "left").withColumn("org_id", F.coalesce("org_id", "_org", "_space")).drop("name", "_space", "_org")


def settle_dates(models: DataFrame) -> DataFrame:
    """``release_date`` as stated, or where it is null or blank, the date in the id's tail."""
    return models.withColumn("release_date", F.when(F.trim("release_date") != "", F.col("release_date")).otherwise(keys.id_date(F.col("id"))))


def sync_org_tag(models: DataFrame) -> DataFrame:
    """``tags`` with ``org-unknown`` at their end exactly where a row has no org, or the one that stands for none."""
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    none = F.col("org_id").isNull() | (F.col("org_id") == NO_ORG)
    has = F.array_contains(tags, NO_ORG_TAG)
    return models.withColumn("tags", F.when(none & ~has, F.array_append(tags, F.lit(NO_ORG_TAG))).when(~none & has, F.array_remove(tags, NO_ORG_TAG)).otherwise(F.col("tags")))


def community_orgs(models: DataFrame, settled: DataFrame, orgs: DataFrame) -> DataFrame:
    """Rows for orgs that ``settled`` took from namespaces and ``orgs`` (id) doesn't have."""
    open_ = models.where("org_id is null").select("id")
    new = settled.join(open_, "id", "left_semi").where("org_id is not null").select("org_id").distinct().withColumnRenamed("org_id", "id")
    new = new.join(orgs.select("id"), "id", "left_anti")
    return new.select("id", F.col("id").alias("display_name"), F.col("id").alias("hf_org"), F.lit("community").alias("kind"), F.lit("reviewed").alias("review_status"))


def derive(models: DataFrame, org_map: DataFrame, orgs: DataFrame | None = None, inherited: tuple[str, ...] = ("open_weights",)) -> dict[str, DataFrame]:
    """``models`` with orgs, dates, tags, lineage and what ``inherited`` takes from parents; ``orgs``: rows that these need.

    Orgs come first, as groups and families end where orgs differ; the inherited attributes share one walk. Columns that the
    models lack (``release_date``, ``tags``) are added; others pass through. An empty table gives empty ones.
    """
    kinds = {"org_id": "string", "release_date": "string", "tags": "array<string>"}
    full = models.withColumns({c: F.lit(None).cast(kind) for c, kind in kinds.items() if c not in models.columns})
    # Stored once: each graph reads it for its nodes, its edges and their ends.
    settled = sized(sync_org_tag(settle_dates(settle_orgs(full, org_map))), "settled")
    lineage = graph.derive_lineage(settled)
    if inherited:
        lineage = lineage.drop(*inherited).join(graph.inherit(settled, list(inherited)), "id", "left")
    out = {"models": lineage}
    if orgs is not None:
        out["orgs"] = community_orgs(full, settled, orgs)
    return out
