"""Full regeneration: every layer in order, each a stage whose snapshot is kept as long as what it was made from stays the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import keys
from ..operators import merge, minting, reconcile, residual
from ..sources import publish
from ..storage import sized
from . import jobs

FACTS = ("family", "params_billions")
NONE = "array<string>"


def _entries(df: DataFrame, source: str, rank: int) -> DataFrame:
    """Entries as a layer: what all layers have in common, with their source and rank."""
    full = reconcile.complete(df)
    kinds = {"family": "string", "params_billions": "double"}
    facts = df.select("id", *((F.col(f) if f in df.columns else F.lit(None)).cast(k).alias(f) for f, k in kinds.items()))
    return full.join(facts, "id").withColumn("resolution_source", F.lit(source)).withColumn("layer_rank", F.lit(rank)).select(
        "id", "display_name", "org_id", F.coalesce("aliases", F.array().cast(NONE)).alias("aliases"), F.coalesce("parents", F.array().cast(reconcile.EDGES)).alias("parents"), "release_date", "open_weights", "review_status", *FACTS, "resolution_source", "layer_rank",
    )


def oracle_stage(x: dict[str, DataFrame]) -> DataFrame:
    """Known answers as entries: true ids that are new, and the spellings that lead to true ids."""
    out = jobs.oracle_layer(x["truth"], x["core"].select("id", "parents"), x["org_map"], x["deny"])
    forms = out["aliases"].groupBy(F.col("canonical_id").alias("id")).agg(F.array_sort(F.collect_set("raw_value")).alias("aliases"))
    rekeyed = out["targets"].where("action = 'rekey'").select("id", F.col("incumbent").alias("_old"))
    rows = out["targets"].where("action <> 'ok'").select("id").join(rekeyed, "id", "left").join(forms, "id", "full_outer")
    both = F.array_sort(F.array_union(F.coalesce("aliases", F.array().cast(NONE)), F.when(F.col("_old").isNotNull(), F.array("_old")).otherwise(F.array().cast(NONE))))
    made = rows.join(x["core"].select("id", F.lit(True).alias("_there")), "id", "left")
    org = F.when(F.col("id").contains("/"), F.substring_index("id", "/", 1))
    named = made.withColumn("name", F.lower(org)).join(x["org_map"], "name", "left")
    return _entries(named.select("id", F.when(F.col("_there").isNull(), F.regexp_replace("id", r"^[^/]*/", "")).alias("display_name"), F.coalesce("org", org).alias("org_id"), both.alias("aliases"), F.lit("reviewed").alias("review_status")), "hf", 1)


def catalogue_stage(x: dict[str, DataFrame]) -> DataFrame:
    """The providers' catalogue beside the core and oracle layers."""
    independent = _entries(x["core"], "curated", 0).unionByName(x["oracle"]).withColumn("seq", F.col("layer_rank").cast("long"))
    out = jobs.regenerate_catalogue(x["records"], x["org_map"], x["repos"], x["committed"], independent, independent.limit(0), external=x["external_keys"])
    return _entries(out["entries"], "models_dev", 2)


def enrichment_stage(x: dict[str, DataFrame]) -> DataFrame:
    """What the external index knows of ids of the other layers: facts only."""
    known = x["core"].select("id").unionByName(x["oracle"].select("id")).unionByName(x["catalogue"].select("id")).distinct()
    rows = x["external"].withColumn("_l", F.lower("id")).groupBy("_l").agg(*(F.min_by(c, "id").alias(c) for c in ("release_date", "params_billions", "open_weights")))
    return _entries(known.withColumn("_l", F.lower("id")).join(rows, "_l").drop("_l"), "hub", 3)


def _owned(layers: DataFrame) -> DataFrame:
    """Layers with every alias left to its owner (cross-layer ownership)."""
    forms = layers.select("id", (F.col("layer_rank") == 0).alias("is_core"), F.explode(F.concat(F.array("id"), "aliases")).alias("form")).groupBy("form", "id").agg(F.bool_or("is_core").alias("is_core"))
    lost = merge.form_owners(forms)[1].groupBy("id").agg(F.collect_set("form").alias("_lost"))
    return layers.join(lost, "id", "left").withColumn("aliases", F.array_sort(F.array_except("aliases", F.coalesce("_lost", F.array().cast(NONE))))).drop("_lost")


def _models(layers: DataFrame, org_map: DataFrame) -> DataFrame:
    """Layers to models (``jobs.settle_models``)."""
    rows = layers.withColumn("file", F.lit("layer")).withColumn("pos", F.lit(0))
    return jobs.settle_models(rows, org_map, ["display_name", "org_id", "release_date", "open_weights", "review_status", "resolution_source", *FACTS], ["aliases"])["models"].drop("n_rows", "tags")


def registry_stage(x: dict[str, DataFrame]) -> DataFrame:
    layers = _entries(x["core"], "curated", 9).unionByName(x["oracle"]).unionByName(x["catalogue"]).unionByName(x["enrichment"])
    return _models(_owned(sized(layers.withColumn("layer_rank", F.when(F.col("layer_rank") == 9, 0).otherwise(F.col("layer_rank"))), "layers")), x["org_map"])


def _alias_table(models: DataFrame) -> DataFrame:
    rows = models.select(F.col("id").alias("canonical_id"), F.explode(F.array_distinct(F.concat(F.array("id"), "aliases"))).alias("raw_value")).groupBy("raw_value").agg(F.min("canonical_id").alias("canonical_id"))
    return rows.select("raw_value", F.lit("model").alias("entity_type"), F.lit(None).cast("string").alias("source_config"), "canonical_id", F.lit("confirmed").alias("status"), F.lit(1).cast("long").alias("seq"))


def residual_stage(x: dict[str, DataFrame]) -> DataFrame:
    """Mentions that the registry doesn't match."""
    models = x["registry"]
    claims = models.select("id", F.explode(F.concat(F.array("id"), "aliases")).alias("form")).select("form", "id").distinct()
    out = residual.residual_layer(x["mentions"], models.select("id", "org_id", "resolution_source", "aliases", F.lit(1).cast("long").alias("seq")), _alias_table(models), x["prior"], claims, x["org_map"])
    return out["entries"].select("id", "display_name", "org_id", "aliases", F.coalesce("parents", F.array().cast(reconcile.EDGES)).alias("parents"), "review_status")


def models_stage(x: dict[str, DataFrame]) -> DataFrame:
    """The registry with the residual layer, orgs in one spelling, every form with one owner."""
    base = x["registry"].select("id", "display_name", "org_id", "aliases", "parents", "release_date", "open_weights", "review_status", *FACTS, "resolution_source", F.lit(0).alias("layer_rank"))
    layers = sized(base.unionByName(_entries(x["residual"], "inferred", 4).withColumn("resolution_source", F.when(F.col("display_name").isNotNull(), F.col("resolution_source")))), "layers")
    casing = merge.community_casing(layers.where("layer_rank = 0"), "org_id")
    layers = merge.canonicalize_orgs(layers, "org_id", x["org_map"], casing, x["org_map"].select("org").limit(0))
    return _models(_owned(layers), x["org_map"])


def aliases_stage(x: dict[str, DataFrame]) -> DataFrame:
    """The alias table, seeded by rank."""
    rows = x["models"].select(F.lit("model").alias("entity_type"), "id", "display_name", "aliases", "org_id", "resolution_source", "review_status", F.lit(1).cast("long").alias("seq"))
    return minting.seed_by_rank(rows, x["orgs"], x["org_map"])["aliases"]


STAGES = [
    ("oracle", ["truth", "core", "org_map", "deny"], oracle_stage), ("catalogue", ["records", "core", "oracle", "org_map", "repos", "committed", "external_keys"], catalogue_stage), ("enrichment", ["core", "oracle", "catalogue", "external"], enrichment_stage),
    ("registry", ["core", "oracle", "catalogue", "enrichment", "org_map"], registry_stage), ("residual", ["registry", "mentions", "prior", "org_map"], residual_stage), ("models", ["registry", "residual", "org_map"], models_stage), ("aliases", ["models", "orgs", "org_map"], aliases_stage),
]


def regenerate(spark: SparkSession, inputs: dict[str, DataFrame], path: str, release: str = "1") -> tuple[dict[str, DataFrame], dict[str, str]]:
    """All stages over ``inputs`` with snapshots under ``path`` (see ``publish.run_stages``).

    Inputs: ``truth`` (raw_value, fixed_id, status), ``core`` (curated entries), ``org_map`` (name, org), ``orgs``, ``deny`` (raw), ``records`` (provider rows), ``repos``
    (fixed_id, status, seq), ``committed`` (catalogue entries of the last generation), ``external_keys`` (key), ``external`` (repo facts), ``mentions`` (raw_value), ``prior``
    (residual entries of the last run).
    """
    return publish.run_stages(spark, inputs, STAGES, path, release)
