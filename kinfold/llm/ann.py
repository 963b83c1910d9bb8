"""Nearest neighbours by shifted space-filling curves.

Vectors are projected several times onto a few random directions; each projection, shifted at random, is
put in the order of a Hilbert curve. Spark sorts and numbers each ordering by range partitioning. A query's
candidates are the rows within a window around its own place in every ordering; they are scored on the
original vectors, and the windows' best merge.

Equal vectors are one class (of a 128-bit digest) with its few smallest ids, so a vector that many rows share is
one row in the orderings and one task never holds its group.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .common import stored
from .sharding import number_rows

ORDERINGS, DIMENSIONS, BITS, BLOCK = 8, 4, 15, 2048
#: Share of all rows in a window, both sides together.
SHARE = 0.2
#: More than rounding can move a cosine that a matrix product gives.
MARGIN = 1e-9


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of integer points (rows) with ``bits`` bits in each coordinate.

    The coordinates are brought into the curve's transposed form (exchanges and inversions from the high
    bit down, then a Gray decoding), whose bits interleave into the place.
    """
    x = cells.astype(np.int64).copy()
    dims = x.shape[1]
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for d in range(dims):
            on = (x[:, d] & bit) != 0
            swap = np.where(on, 0, (x[:, 0] ^ x[:, d]) & low)
            x[:, 0] ^= np.where(on, low, swap)
            x[:, d] ^= swap
    for d in range(1, dims):
        x[:, d] ^= x[:, d - 1]
    flip = np.zeros(len(x), np.int64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[:, -1] >> level) & 1, (1 << level) - 1, 0)
    x ^= flip[:, None]
    key = np.zeros(len(x), np.int64)
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            key = key << 1 | (x[:, d] >> level) & 1
    return key


def _directions(length: int, seed: int, orderings: int, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthogonal directions and a shift for each ordering."""
    draw = np.random.default_rng(seed)
    frames = [np.linalg.qr(draw.normal(size=(length, min(length, dimensions))))[0] for _ in range(orderings)]
    return np.stack(frames), draw.random((orderings, min(length, dimensions)))


def _scaled(x: np.ndarray) -> np.ndarray:
    """The vector times the power of two that brings its largest component between a half and one: no square leaves the range of doubles."""
    return np.ldexp(x, -np.frexp(np.abs(x).max())[1]) + 0.0


def _usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, vec) of the vectors that take part, as packed doubles; scaled, which changes no cosine."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    good = vectors.where(F.col(vec_id).isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)).select(F.col(vec_id).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))

    def pack(batches):
        for batch in batches:
            column = batch.column(1)
            rows = [_scaled(np.asarray(x, np.float64)) for x in column.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in rows], pa.int32()), pa.array([x.tobytes() for x in rows], pa.binary())], names=["vec_id", "length", "vec"])

    packed = good.mapInArrow(pack, "vec_id long, length int, vec binary")
    return packed.withColumn("cid", F.unhex(F.md5("vec")))


def search(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", seed: int = 0, orderings: int = ORDERINGS, dimensions: int = DIMENSIONS, share: float = SHARE) -> DataFrame:
    """(``query_id``, ``rank``, ``vec_id``, ``score``): each query's ``k`` nearest found, by cosine.

    ``is_query`` is a condition on the id column; all rows are candidates of every query but itself. Ties
    go to the smaller id; multiples of a vector by powers of two tie exactly, others may differ in the last bit, by which a score
    can also pass 1. Finite vectors of any length but 0 take part. Vectors that are null, zero or empty, or hold null or non-finite components, and
    rows without an id take no part; of vectors of several lengths only the commonest length does (the
    longer one on ties). An id that repeats takes part once for each of its different vectors. Other
    columns are ignored. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    usable = stored(_usable(vectors, vec_id, vector), "vectors")
    result = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])
    common = usable.groupBy("length").count().orderBy(F.desc("count"), F.desc("length")).first()
    if common is None:
        return spark.createDataFrame([], result)
    length = common["length"]
    usable = usable.where(F.col("length") == length).drop("length")
    queries = usable.where(is_query).select(F.col("vec_id").alias("query_id"), "cid").distinct()
    # The k + 1 smallest ids of each class are all that an answer can hold; Spark limits them before the shuffle.
    place = F.row_number().over(Window.partitionBy("cid").orderBy("vec_id"))
    few = usable.select("cid", "vec_id").distinct().withColumn("_k", place).where(F.col("_k") <= k + 1).groupBy("cid").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    classes = usable.groupBy("cid").agg(F.first("vec").alias("vec"), F.max(is_query).alias("asks")).join(few, "cid")
    classes = stored(classes, "classes")

    frames, shifts = _directions(length, seed, orderings, dimensions)
    bits = min(BITS, 62 // frames.shape[2])

    def keys(batches):
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float64).reshape(batch.num_rows, length)
            x = x / np.sqrt((x * x).sum(1))[:, None]
            for o in range(orderings):
                # Coordinates of unit vectors lie in [-1, 1]; few pass a multiple of the usual 1/sqrt(length).
                cells = np.clip((x @ frames[o]) * np.sqrt(length) / 8 + 0.5, 0, 1) / 2 + shifts[o] / 2
                key = hilbert_keys((cells * ((1 << bits) - 1)).astype(np.int64), bits)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, o, np.int32)), pa.array(key), batch.column(0), batch.column(1)], names=["o", "key", "cid", "asks"])

    ordered = classes.select("cid", "asks", "vec").mapInArrow(keys, "o int, key long, cid binary, asks boolean")
    numbered, rows = number_rows(ordered, ["o", "key", "cid"])
    n = rows // orderings
    half = max(math.ceil(share * n / 2), min(n, BLOCK // 4))
    numbered = numbered.withColumn("place", F.col("row_number") - F.col("o") * n)
    # Queries of one block of rows are dealt out further where a window holds many of them.
    n_asking = classes.where("asks").count()
    chunks = max(1, math.ceil(n_asking * min(1.0, (2 * half + BLOCK) / n) / BLOCK))
    at = lambda p: F.floor(p / BLOCK).cast("long")
    last = (n - 1) // BLOCK
    vec = classes.select("cid", "vec", F.col("ids")[0].alias("least"))
    data = numbered.select("o", at(F.col("place")).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "cid").join(vec, "cid")
    near = F.sequence(F.greatest(at(F.col("place") - half), F.lit(0)), F.least(at(F.col("place") + half), F.lit(last)))
    asked = numbered.where("asks").select("o", F.explode(near).alias("block"), F.pmod(F.xxhash64("cid"), F.lit(chunks)).cast("int").alias("chunk"), "cid").join(classes.select("cid", "vec"), "cid")

    def score(rows_: pd.DataFrame, asked_: pd.DataFrame) -> pd.DataFrame:
        names = ["qid", "cid", "least", "score"]
        if not len(rows_) or not len(asked_):
            return pd.DataFrame(columns=names)
        x, q = (np.frombuffer(b"".join(t["vec"]), np.float64).reshape(len(t), length) for t in (rows_, asked_.rename(columns={"q_vec": "vec"})))
        nx, nq = np.sqrt((x * x).sum(1)), np.sqrt((q * q).sum(1))
        least, most = rows_["least"].to_numpy(), min(len(x), k + 1)
        out: dict[str, list] = {name: [] for name in names}
        for start in range(0, len(q), 64):
            part = slice(start, start + 64)
            near = (q[part] / nq[part, None]) @ (x / nx[:, None]).T
            edge = -np.partition(-near, most - 1, axis=1)[:, most - 1]
            # All rows within rounding of the edge are scored exactly, so no tie is decided here but by id.
            for row, at in enumerate(near >= edge[:, None] - MARGIN, start):
                at = np.flatnonzero(at)
                exact = (q[row] * x[at]).sum(1) / (nq[row] * nx[at])
                best = np.lexsort((least[at], -exact))[:most]
                out["qid"].extend([asked_["q_cid"].iat[row]] * len(best))
                out["cid"].extend(rows_["cid"].to_numpy()[at[best]])
                out["least"].extend(least[at[best]].tolist())
                out["score"].extend(exact[best].tolist())
        return pd.DataFrame(out)

    asked = asked.select("cid", "o", "block", "chunk", "vec").toDF("q_cid", "q_o", "q_block", "q_chunk", "q_vec")
    found = data.groupBy("o", "block", "chunk").cogroup(asked.groupBy("q_o", "q_block", "q_chunk")).applyInPandas(score, "qid binary, cid binary, least long, score double")
    order = [F.desc("score"), "least"]
    top = found.distinct().withColumn("_k", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where(F.col("_k") <= k + 1)
    ids = top.join(classes.select("cid", "ids"), "cid").select("qid", "score", F.explode("ids").alias("vec_id"))
    ids = ids.withColumn("_k", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))).where(F.col("_k") <= k + 1)
    best = ids.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))).alias("best"))
    own = queries.join(best, queries["cid"] == best["qid"]).select("query_id", F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("best"))
    out = own.select("query_id", F.posexplode("best").alias("_p", "_b"))
    return out.select("query_id", (F.col("_p") + 1).alias("rank"), F.col("_b.vec_id").alias("vec_id"), (-F.col("_b.far")).alias("score"))
