"""Stored tables that tell Spark their real size."""

from pyspark.sql import functions as F

from kinfold.plans.enrichment_queries import _rows
from kinfold.storage import sized


def size(df):
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def test_like_ids_keep_their_size(spark):
    ids = spark.range(50_000).select(F.concat(F.lit("organisation/a-model-name-"), F.col("id") % 7).alias("id"))
    assert size(sized(ids)) >= 50_000 * 27


def test_exploded_rows_count(spark):
    parts = spark.range(20_000).select(F.col("id").alias("p_partkey"))
    rows = _rows(parts, {"id": "string"}, [{"id": f"organisation/model-{k}-#"} for k in range(8)])
    assert size(rows) >= 8 * 20_000 * 20
