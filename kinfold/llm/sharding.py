"""Reproducible shuffling into shards: a Feistel permutation with cycle walking over global row numbers."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import shuffle_partitions, stored

ROUNDS = 6
PRIME = 2**31 - 1


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    """A factor and a summand for each round, from the seed."""
    draw = random.Random(seed)
    return [(draw.randrange(1 << 29, PRIME), draw.randrange(PRIME)) for _ in range(rounds)]


def half_width(n: int) -> int:
    """Bits of each half, so that two halves number at least ``n`` rows and at most four times as many."""
    return max(1, (max(1, n - 1).bit_length() + 1) // 2)


def _once(x: np.ndarray, width: int, keys: list[tuple[int, int]]) -> np.ndarray:
    low = (1 << width) - 1
    left, right = x >> width, x & low
    for factor, summand in keys:
        left, right = right, left ^ (((right * factor + summand) % PRIME) & low)
    return (left << width) | right


def _back(x: np.ndarray, width: int, keys: list[tuple[int, int]]) -> np.ndarray:
    low = (1 << width) - 1
    left, right = x >> width, x & low
    for factor, summand in reversed(keys):
        left, right = right ^ (((left * factor + summand) % PRIME) & low), left
    return (left << width) | right


def _walk(rows: np.ndarray, n: int, seed: int, step) -> np.ndarray:
    width, keys = half_width(n), round_keys(seed)
    if width > 31:
        raise ValueError("more rows than 2**62")
    out = step(np.asarray(rows, np.int64), width, keys)
    while (far := np.flatnonzero(out >= n)).size:
        out[far] = step(out[far], width, keys)
    return out


def position_of(rows, n: int, seed: int) -> np.ndarray:
    """Places of row numbers 0 to n-1 in the shuffled order; walks on while a place lies beyond n."""
    return _walk(rows, n, seed, _once)


def row_at(positions, n: int, seed: int) -> np.ndarray:
    """The inverse of ``position_of``: which row number stands at a place."""
    return _walk(positions, n, seed, _back)


def number_rows(df: DataFrame, order_by: list[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """Add gapless global row numbers from 0 in the order of ``order_by``, and return the count too.

    Rows are range-partitioned and sorted once and stored with their place in their partition; the
    partitions' counts (one row each) give the offsets. Nulls come first. Ties are broken by a hash of the
    whole row and then by place in the input, which also splits a key that many rows share. The result
    doesn't depend on how the input is partitioned, but for rows that agree in every column.
    """
    df = df.drop(name, "_tie", "_place", "_part")
    hashable = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    keyed = df.withColumn("_tie", F.xxhash64(*hashable)).withColumn("_place", F.monotonically_increasing_id())
    keys = [*order_by, "_tie", "_place"]
    ranged = keyed.repartitionByRange(shuffle_partitions(df.sparkSession), *keys).sortWithinPartitions(*keys).drop("_tie", "_place")
    placed = stored(ranged.withColumn("_place", F.monotonically_increasing_id()), "numbered")
    placed = placed.withColumn("_part", F.shiftright("_place", 33)).withColumn("_place", F.col("_place").bitwiseAND((1 << 33) - 1))
    counts = sorted((r["_part"], r["n"]) for r in placed.groupBy("_part").agg((F.max("_place") + 1).alias("n")).collect())
    offsets, n = [], 0
    for part, count in counts:
        offsets.append((part, n))
        n += count
    starts = df.sparkSession.createDataFrame(offsets, "_part long, _start long")
    # One row for each partition, which is a setting's size and not the data's.
    numbered = placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_place"))
    return numbered.drop("_part", "_place", "_start"), n


def assign_shards(df: DataFrame, order_by: list[str], n_shards: int, seed: int = 0) -> DataFrame:
    """Add ``row_number``, ``position``, ``shard`` and ``slot`` to every row.

    ``position`` is the row number's place under the permutation; ``shard`` is its remainder by
    ``n_shards`` and ``slot`` its quotient. So shards differ by at most one row, slots are gapless from 0,
    and ``position_of`` computes both for a row number (``row_at`` the row for a place) without any table.

    Null keys sort first, ties as in ``number_rows``; repeated rows get places of their own; an empty
    table gives an empty result; an input column named like an output column is replaced. Only ``order_by``
    and the columns present travel, so select what the shards need first.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    df = df.drop("position", "shard", "slot")
    numbered, n = number_rows(df, order_by)

    @F.pandas_udf("long")
    def place(rows: pd.Series) -> pd.Series:
        return pd.Series(position_of(rows.to_numpy(), n, seed))

    out = numbered.withColumn("position", place("row_number"))
    return out.withColumn("shard", (F.col("position") % n_shards).cast("int")).withColumn("slot", F.expr(f"position div {n_shards}"))


def write_shards(assigned: DataFrame, path: str) -> None:
    """Write one folder for each shard, rows in the order of their slots.

    ``assigned`` has ``shard`` and ``slot`` (see ``assign_shards``); all other columns are written as they are, nulls included, and repeated rows, which
    have slots of their own, stay. A shard without rows gets no folder, an empty table none at all. A ``path`` that exists is an error.
    """
    parts = shuffle_partitions(assigned.sparkSession)
    ordered = assigned.repartitionByRange(parts, "shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.partitionBy("shard").parquet(path)


def position_sql(source: str, seed: int) -> str:
    """The same permutation as SQL: a recursive table walk(row_number, x) over ``source``.

    ``source`` has row_number, n (the count) and w (the half width); the place is the x that is below n.
    """

    def rounds(rows: str) -> str:
        sql = f"SELECT row_number, n, w, x >> w AS l, x & ((1 << w) - 1) AS r FROM ({rows})"
        for factor, summand in round_keys(seed):
            sql = f"SELECT row_number, n, w, r AS l, xor(l, ((r * {factor} + {summand}) % {PRIME}) & ((1 << w) - 1)) AS r FROM ({sql})"
        return f"SELECT row_number, n, w, (l << w) | r AS x FROM ({sql})"

    first = f"SELECT row_number, n, w, row_number AS x FROM {source}"
    return f"walk AS ({rounds(first)} UNION ALL {rounds('SELECT row_number, n, w, x FROM walk WHERE x >= n')})"
