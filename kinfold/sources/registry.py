"""Reading and writing the registry's tables, layered sources, records and the external index."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import keys
from . import schemas


def load_registry(spark: SparkSession, path: str, names: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """The named tables (all by default); a table without files is empty."""
    out = {}
    for name in names or schemas.TABLES:
        try:
            out[name] = schemas.reconcile(spark.read.parquet(f"{path}/{name}"), name)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            out[name] = spark.createDataFrame([], schemas.schema(name))
    return out


def save_registry(tables: dict[str, DataFrame], path: str, owned_elsewhere: Iterable[str] = schemas.OWNED_ELSEWHERE) -> None:
    """Write each table as one folder, but for those that another job owns."""
    for name, df in tables.items():
        if name not in owned_elsewhere:
            df.write.mode("overwrite").parquet(f"{path}/{name}")


def append_log(rows: DataFrame, path: str) -> None:
    """Append log rows by the date of ``created_at``."""
    rows.withColumn("date", F.substring("created_at", 1, 10)).write.mode("append").partitionBy("date").parquet(path)


def read_records(spark: SparkSession, path: str, configs: Iterable[str] | None = None) -> DataFrame:
    """Nested records under ``path/source_config=NAME``; partitions of other configs aren't read."""
    df = spark.read.option("basePath", path).parquet(path)
    return df if configs is None else df.where(F.col("source_config").isin(*configs))


def read_layers(spark: SparkSession, folders: list[str], file_order: bool = True) -> DataFrame:
    """Sparse JSON entries of several layers, each with its layer, file and position and the keys it states.

    A key that is present with null is in ``explicit_keys``, one that is absent isn't.
    """
    out = None
    for rank, folder in enumerate(folders):
        text = spark.read.text(folder).select(F.col("value"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("pos"))
        row = text.where(F.trim("value") != "").select(F.lit(rank).alias("layer_rank"), "file", "pos", F.parse_json("value").alias("entry"), F.json_object_keys("value").alias("explicit_keys"))
        row = row.withColumn("id", F.variant_get("entry", "$.id", "string"))
        out = row if out is None else out.unionByName(row)
    return out


def flatten_map(df: DataFrame, entries: str, with_configs: bool = False) -> DataFrame:
    """``{slug: fields}`` maps as rows (slug, fields); configs in both spellings if asked for."""
    out = df.select(F.explode(entries).alias("slug", "fields"))
    return out.withColumn("configs", F.array_distinct(F.array("slug", F.replace("slug", F.lit("-"), F.lit("_"))))) if with_configs else out


def index_rows(external: DataFrame) -> DataFrame:
    """Index rows of an external repo table: only repos with weights; key, size in billions and date derived."""
    rows = external.where("safetensors is not null or gguf is not null")
    return rows.select(
        "id", keys.index_key(F.col("id")).alias("id_norm"), F.date_format("createdAt", "yyyy-MM-dd").alias("release_date"), "pipeline_tag",
        F.round(F.col("safetensors.total") / 1e9, 2).alias("params_billions"), F.col("downloads").cast("bigint").alias("downloads"), (F.col("safetensors").isNotNull() | F.col("gguf").isNotNull()).alias("open_weights"),
    )


def build_index(external: DataFrame, path: str, least_rows: int) -> int:
    """Write the index unless it has fewer than ``least_rows`` rows; the row count."""
    rows = index_rows(external)
    n = rows.count()
    if n == 0 or n < least_rows:
        raise ValueError(f"the index has {n} rows, fewer than {max(1, least_rows)}: nothing is written")
    rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return n


def extract_candidates(external: DataFrame, forms: DataFrame, form: str = "form") -> DataFrame:
    """Rows of a large external table whose id is a known form, in exactly that case."""
    wanted = forms.where(keys.is_repo_id(F.col(form))).select(F.col(form).alias("id")).distinct()
    return external.join(wanted, "id", "left_semi")


def unchecked(candidates: DataFrame, state: DataFrame, snapshot_tag: str) -> DataFrame:
    """Candidates that weren't checked under this snapshot yet."""
    return candidates.join(state.where(F.col("snapshot_tag") == snapshot_tag), "id", "left_anti")


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows, hash): a content hash that row order doesn't change."""
    out = None
    for name, df in sorted(tables.items()):
        h = F.xxhash64(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})).cast("decimal(38,0)")
        row = df.agg(F.lit(name).alias("table"), F.count("*").alias("rows"), F.sha2(F.concat_ws(":", F.count("*"), F.coalesce(F.sum(h), F.lit(0))), 256).alias("hash"))
        out = row if out is None else out.unionByName(row)
    return out
