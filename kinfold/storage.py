"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the folder that all executors share (``spark.checkpoint.dir``).

    Only on one machine (a local master), as in tests, may that setting be absent; a temporary folder takes
    its place there. On a cluster, where no other machine would see such a folder, this raises an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="kinfold-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: later steps read files that outlive any executor, and see one fixed result
    however often they run.
    """
    return _written(df, name)


def sized(df: DataFrame, name: str = "step") -> DataFrame:
    """As ``stored``, in plain encoding: the files are about as large as the rows in memory.

    Spark takes the files' size for the table's and broadcasts what looks small, through the driver. Ids that are much alike
    shrink to a tenth or less in compressed files, and exploding them isn't counted, so millions of rows looked small.
    """
    return _written(df, name, {"compression": "none", "parquet.enable.dictionary": "false"})


def _written(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    path = shared_folder(df.sparkSession, name)
    df.write.options(**(options or {})).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_in = path
    return out


def released(*tables: DataFrame) -> None:
    """Delete the folders of ``tables`` that ``stored`` or ``sized`` gave and that nothing reads any more, so that the disk holds only what is still needed.

    Whatever was made of them must have been stored; a table that is only planned would miss them.
    """
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_in)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
