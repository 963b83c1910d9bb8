"""The log of what a stream resolved: one file set for each stream and batch, the same however often the batch runs."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import match

LEVELS = ("families", "roots", "composites", "parents")


def stream_name(checkpoint: str) -> str:
    """A name that a stream keeps over restarts: that of its checkpoint folder; with a letter first, so that it never reads as a number."""
    return "s" + hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:12]


def request_log(results: DataFrame, stream: str, batch: int, levels: dict[str, DataFrame] | None = None) -> DataFrame:
    """One row for each distinct mention of a batch, with the number of its ``requests``.

    ``request_id`` follows from stream, batch and mention, so a batch that runs again gives the same ids; null and empty scopes are one.
    ``levels`` adds to benchmark hits what ``match.with_ancestry`` and ``match.with_detail`` tell of them: ``families``, ``roots``, ``composites``
    and ``parents`` (id, parent_benchmark_id). Open mentions and other kinds have nulls there; an empty batch gives an empty log.
    """
    key = ["raw_value", "entity_type", "source_config"]
    one = results.withColumn("source_config", F.nullif("source_config", F.lit(""))).groupBy(*key).agg(F.count("*").alias("requests"), F.min(F.struct("canonical_id", "strategy", "confidence")).alias("_hit"))
    name = F.sha2(F.to_json(F.struct(F.lit(stream).alias("s"), F.lit(batch).alias("b"), *key)), 256)
    out = one.select(F.substring(name, 1, 32).alias("request_id"), *key, "_hit.*", "requests")
    if levels is None:
        return out
    hit = (F.col("entity_type") == "benchmark") & F.col("canonical_id").isNotNull()
    above = levels["parents"].select(F.col("id").alias("canonical_id"), "parent_benchmark_id")
    told = match.with_ancestry(out.where(hit), *(levels[x] for x in LEVELS[:3])).join(above, "canonical_id", "left")
    told = match.with_detail(told).drop("parent_benchmark_id")
    return told.unionByName(out.where(~F.coalesce(hit, F.lit(False))), allowMissingColumns=True)


def write_batch(df: DataFrame, path: str, stream: str, batch: int) -> str:
    """Write a batch to its own folder, over what an earlier attempt left there; gives the folder."""
    folder = f"{path.rstrip('/')}/stream={stream}/batch={batch}"
    df.write.mode("overwrite").parquet(folder)
    return folder


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a log, with ``stream`` and ``batch`` as columns."""
    return spark.read.option("basePath", path).parquet(f"{path.rstrip('/')}/stream=*")
