"""Snapshots that say what is in them: content hashes decide what is written, published and worked on again.

A manifest names for each table its content hash, row count and folder. Tables are written to new folders first and the manifest
last, so readers see the old state or the new one, and a job that dies in between leaves the old one. Manifests are small (a row for each table);
the newest complete one counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..storage import stored
from .registry import manifest

MANIFEST = "table string, hash string, rows long, folder string, key string, version long"


def content_hash(df: DataFrame) -> tuple[str, int]:
    """(hash, rows) of a table, whatever the order of its rows and columns."""
    r = manifest({"t": df}).first()
    return r["hash"], r["rows"]


def load_manifest(spark: SparkSession, path: str) -> dict[str, dict]:
    """{table: row} of the newest manifest under ``path``; empty where there is none."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{path}/_manifest").collect()
    except AnalysisException:
        return {}
    newest = max((r["version"] for r in rows), default=0)
    return {r["table"]: r.asDict() for r in rows if r["version"] == newest}


def _save_manifest(spark: SparkSession, path: str, tables: dict[str, dict], version: int) -> None:
    rows = [(name, r["hash"], r["rows"], r["folder"], r.get("key"), version) for name, r in sorted(tables.items())]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/_manifest")


def publish(tables: dict[str, DataFrame], path: str) -> dict[str, str]:
    """Publish tables under ``path``: {table: ``written`` or ``same``}.

    A table whose content hash is that of the manifest is not written again; where all are, and none is missing or new, there is no new manifest
    either. Tables that aren't given any more leave the manifest.
    """
    spark = next(iter(tables.values())).sparkSession
    before, after, out = load_manifest(spark, path), {}, {}
    for name, df in sorted(tables.items()):
        fixed = stored(df, name)
        digest, rows = content_hash(fixed)
        old = before.get(name)
        if old and old["hash"] == digest:
            after[name], out[name] = old, "same"
            continue
        folder = f"{path}/{name}-{digest[:12]}-{uuid.uuid4().hex[:8]}"
        fixed.write.parquet(folder)
        after[name], out[name] = {"hash": digest, "rows": rows, "folder": folder}, "written"
    if set(out.values()) != {"same"} or set(before) != set(after):
        _save_manifest(spark, path, after, 1 + max((r["version"] for r in before.values()), default=0))
    return out


def read_published(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(load_manifest(spark, path)[name]["folder"])


def run_stages(spark: SparkSession, inputs: dict[str, DataFrame], stages: list[tuple[str, list[str], Callable[[dict[str, DataFrame]], DataFrame]]], path: str, release: str = "1") -> tuple[dict[str, DataFrame], dict[str, str]]:
    """({table: DataFrame}, {stage: ``ran``, ``same result`` or ``skipped``}): stages (name, tables it needs, function) in order.

    A stage's key is its name, ``release`` and the content hashes of what it needs. If the manifest has it with that key, it isn't run. If it runs and gives
    what it gave before, its snapshot isn't written again, and what depends on it alone is skipped. Raise ``release`` when the rules of stages change.
    The manifest is written after each stage, so a run that was cut off goes on where it stopped.
    """
    before = load_manifest(spark, path)
    version = max((r["version"] for r in before.values()), default=0)
    tables, hashes, state, said = dict(inputs), {}, {}, {}
    for name, needs, make in stages:
        for need in needs:
            if need not in hashes:
                hashes[need] = content_hash(tables[need])[0]
        key = f"{name}:{release}:" + ",".join(f"{need}={hashes[need][:16]}" for need in needs)
        old = before.get(name)
        if old and old["key"] == key:
            state[name], said[name] = old, "skipped"
        else:
            made = stored(make({need: tables[need] for need in needs}), name)
            digest, rows = content_hash(made)
            if old and old["hash"] == digest:
                state[name], said[name] = {**old, "key": key}, "same result"
            else:
                folder = f"{path}/{name}-{digest[:12]}-{uuid.uuid4().hex[:8]}"
                made.write.parquet(folder)
                state[name], said[name] = {"hash": digest, "rows": rows, "folder": folder, "key": key}, "ran"
            version += 1
            _save_manifest(spark, path, {**before, **state}, version)
        hashes[name] = state[name]["hash"]
        tables[name] = spark.read.parquet(state[name]["folder"])
    return {name: tables[name] for name, _, _ in stages}, said


# --- watermarks ------------------------------------------------------------------------------------------------

STATE = "snapshot_tag string, id string"


def checked_ids(spark: SparkSession, path: str, tag: str | None) -> DataFrame:
    """Ids that were checked under this tag; without a tag, or a readable state, none: everything is checked again."""
    try:
        state = spark.read.schema(STATE).parquet(path)
        if tag is None:
            state = state.where("false")
    except AnalysisException:
        state = spark.createDataFrame([], STATE)
    return state.where(F.col("snapshot_tag") == F.lit(tag)).select("id").distinct()


def refresh_unchecked(candidates: DataFrame, path: str, tag: str | None, check: Callable[[DataFrame], DataFrame], keep: Callable[[DataFrame], None]) -> int:
    """Check the candidates (id) that this snapshot hasn't been asked for yet: how many there were.

    ``check`` gives rows for open candidates and ``keep`` stores them; only then are the ids noted under ``tag``, so that a run that fails in between
    is done again. Nothing is checked or noted where all candidates are known; without a tag everything is checked and nothing noted.
    """
    spark = candidates.sparkSession
    open_ = stored(candidates.select("id").distinct().join(checked_ids(spark, path, tag), "id", "left_anti"), "candidates")
    n = open_.count()
    if n:
        keep(check(open_))
        if tag is not None:
            open_.select(F.lit(tag).alias("snapshot_tag"), "id").write.mode("append").parquet(path)
    return n
