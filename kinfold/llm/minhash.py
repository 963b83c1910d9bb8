"""Near-duplicates by min-max hashing: both the least and the greatest value under each permutation.

One pass over a set's hashes under one permutation gives two signature values, so half as many
permutations are evaluated. Bands of values find candidates. Links are confirmed on the full sets: by their
hashes first, and what these would link by the words themselves.

No pairs are made within a class of equal sets, which is one node. In a band's bucket every node is first
compared with the bucket's least node only. What that leaves open (nodes of a bucket that are not yet
connected) is compared block by block, so a bucket of any size is spread over many bounded tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..operators.graph import components
from .common import bounded_batches, small_batches, squeeze, stored, unsqueeze, utf8
from .words import lower_ascii, mix, salted, window_hashes, word_hashes

SHINGLE_WORDS = 5
PERMUTATIONS, BANDS, ROWS = 60, 24, 5
BLOCK = 128
_U = np.uint64


def shingle_sets(column: pa.Array, width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text as sorted hashes, end to end, and each text's bounds.

    Words are taken after lower-casing A-Z. A text with fewer words is one shingle, without words none.
    """
    data, bounds = utf8(column)
    words, at = word_hashes(lower_ascii(data), bounds)
    counts = np.diff(at)
    windows = window_hashes(words, width, 3)
    long = np.maximum(counts - width + 1, 0)
    owner = np.repeat(np.arange(len(counts)), long)
    first = np.repeat(at[:-1], long)
    hashes = windows[first + (np.arange(len(owner)) - np.repeat(np.cumsum(long) - long, long))]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        whole = np.array([_short(words[at[k] : at[k + 1]]) for k in short], _U)
        owner, hashes = np.append(owner, short), np.append(hashes, whole)
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[new], np.searchsorted(owner[new], np.arange(len(counts) + 1))


def _short(words: np.ndarray) -> np.uint64:
    return window_hashes(words, len(words), 3 + len(words))[0]


def signatures(hashes: np.ndarray, bounds: np.ndarray, permutations: int, bands: int, rows: int) -> np.ndarray:
    """Band values (sets x bands) of sets that aren't empty; ``bounds`` are their starts."""
    if 2 * permutations != bands * rows:
        raise ValueError("bands * rows must be twice the number of permutations")
    out = np.zeros((len(bounds), bands), _U)
    factors, shifts, salts = salted(7, permutations) | _U(1), salted(8, permutations), salted(9, bands * rows) | _U(1)
    with np.errstate(over="ignore"):
        for k in range(permutations):
            # An odd factor after a fixed shift permutes the 64-bit integers; the order comes from the high bits.
            values = (hashes ^ shifts[k]) * factors[k]
            for place, ends in ((k, np.minimum), (permutations + k, np.maximum)):
                out[:, place // rows] += mix(ends.reduceat(values, bounds) * salts[place])
        return mix(out)


def node_keys(hashes: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """A 128-bit key of each set that isn't empty, the same for equal sets."""
    with np.errstate(over="ignore"):
        halves = [mix(np.add.reduceat(mix(hashes * factor), starts) + counts.astype(_U)) for factor in salted(10, 2) | _U(1)]
    return [row.tobytes() for row in np.stack(halves, 1).astype(">u8")]


def sketch(df: DataFrame, text: str = "text", permutations: int = PERMUTATIONS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Replace the text by ``n_shingles``, ``node`` (128-bit hash of the set, null if empty) and ``bands``.

    A null text, or one without words, has no shingles and no node; its bands are zeros that mean nothing. Rows are sketched each for itself, so repeated ones stay and nulls in
    other columns are carried along; an input column named like an output column is replaced. An empty table gives an empty result.
    """
    small_batches(df.sparkSession)
    names = [c for c in df.columns if c not in (text, "n_shingles", "node", "bands")]
    at, source = [df.columns.index(c) for c in names], df.columns.index(text)
    schema = T.StructType([*(df.schema[c] for c in names), T.StructField("n_shingles", T.LongType()), T.StructField("node", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in bounded_batches(batches):
            hashes, bounds = shingle_sets(batch.column(source))
            counts = np.diff(bounds)
            full = np.flatnonzero(counts)
            found = np.zeros((len(counts), bands), _U)
            nodes: list[bytes | None] = [None] * len(counts)
            if len(full):
                starts = bounds[:-1][full]
                found[full] = signatures(hashes, starts, permutations, bands, rows)
                for k, node in zip(full, node_keys(hashes, starts, counts[full])):
                    nodes[k] = node
            flat = pa.array(found.view(np.int64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32) * bands), flat)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in at), pa.array(counts), pa.array(nodes, pa.binary()), lists], names=schema.names)

    return df.mapInArrow(run, schema)


def _sets(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """(``node``, ``words``) for the wanted nodes (node, first) out of ``df`` (doc_id, text): lower-case words, compressed.

    Texts are found by doc_id, those without one are all read; each set's node is computed anew, so a
    doc_id that repeats with another text gives no wrong set.
    """
    ids = wanted.select(F.col("first").alias("doc_id")).where("doc_id is not null").distinct()
    few = df.join(ids, "doc_id", "left_semi").select("text").unionByName(df.where("doc_id is null").select("text"))
    schema = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("words", T.BinaryType())])

    def run(batches):
        for batch in bounded_batches(batches):
            hashes, bounds = shingle_sets(batch.column(0))
            full = np.flatnonzero(np.diff(bounds))
            nodes = node_keys(hashes, bounds[:-1][full], np.diff(bounds)[full]) if len(full) else []
            texts = batch.column(0).take(pa.array(full, pa.int64())).to_pylist()
            packed = [squeeze(b" ".join(t.encode().lower().split())) for t in texts]  # bytes.lower changes A-Z alone
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(packed, pa.binary())], names=schema.names)

    return few.mapInArrow(run, schema).join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = np.sort(np.concatenate((x, y)), kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(x) + len(y) - common)


def shingle_numbers(a: bytes, b: bytes, width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of two texts as numbers, the same number only for the same words."""
    table: dict[bytes, int] = {}
    x, y = ([table.setdefault(w, len(table)) for w in text.split()] for text in (a, b))
    if min(len(x), len(y)) < width:
        # A shorter text is one shingle, which only a text of the same words shares.
        return np.zeros(min(1, len(x)), np.int64), np.full(min(1, len(y)), 0 if x == y else 1, np.int64)
    x, y = np.array(x, np.int64), np.array(y, np.int64)
    left, right, most = x, y, len(table)
    for _ in range(width - 1):
        if most * len(table) >= 1 << 62:
            # So many that a longer number would overflow: number those that occur.
            kinds, every = np.unique(np.concatenate((left, right)), return_inverse=True)
            left, right, most = every[: len(left)], every[len(left) :], len(kinds)
        left, right, most = left[:-1] * len(table) + x[len(x) - len(left) + 1 :], right[:-1] * len(table) + y[len(y) - len(right) + 1 :], most * len(table)
    return np.unique(left), np.unique(right)


class _Sets:
    """The sets of a batch of compressed texts: compared by hash, and confirmed word by word."""

    def __init__(self, column: pa.Array, percent: int):
        self.texts = [unsqueeze(t) for t in column.to_pylist()]
        self.hashes, self.bounds = shingle_sets(pa.array(self.texts, pa.large_binary()))
        self.percent = percent

    def _of(self, k: int) -> np.ndarray:
        return self.hashes[self.bounds[k] : self.bounds[k + 1]]

    def linked(self, k: int, other: _Sets, j: int) -> bool:
        if not _alike(self._of(k), other._of(j), self.percent):
            return False
        return _alike(*shingle_numbers(self.texts[k], other.texts[j]), self.percent)


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike enough."""
    joined = pairs.join(sets.select(F.col("node").alias("b"), F.col("words").alias("wb")), "b").join(sets.select(F.col("node").alias("a"), F.col("words").alias("wa")), "a")

    def run(batches):
        for batch in bounded_batches(batches):
            x, y = _Sets(batch.column(2), percent), _Sets(batch.column(3), percent)
            ok = [x.linked(k, y, k) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return joined.select("a", "b", "wa", "wb").mapInArrow(run, "a binary, b binary")


def _block_links(labelled: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between members of a bucket that are not yet connected, comparing block with block.

    ``labelled`` has bucket, node, n and component. Members of a bucket's largest component need no
    comparison among themselves; the others are compared with them and with each other. Blocks hold about
    ``BLOCK`` nodes, and each pair of blocks is a task of its own, so no bucket is gathered in one task.
    Buckets with the same members are done once.
    """
    parts = labelled.groupBy("bucket", "component").agg(F.count("*").alias("k"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("h"))
    buckets = parts.groupBy("bucket").agg(F.max_by("component", F.struct("k", "component")).alias("_main"), F.max("k").alias("_most"), F.sum("k").alias("_size"), F.count("*").alias("_parts"), F.sum("h").alias("_h"))
    # Two nodes in different components were a pair with the least node already.
    open_ = buckets.where("_parts > 1 and _size > 2").groupBy("_size", "_h").agg(F.min(F.struct("bucket", "_main", "_most")).alias("_b"), F.first("_parts").alias("_parts")).select("_b.*", "_size")
    placed = labelled.join(open_, "bucket")
    blocks = lambda count: F.greatest(F.ceil(count / BLOCK), F.lit(1)).cast("int")
    main, rest = F.col("component") == F.col("_main"), blocks(F.col("_size") - F.col("_most"))
    own = F.pmod(F.xxhash64("node"), F.when(main, blocks(F.col("_most"))).otherwise(rest)).cast("int")
    placed = placed.select("bucket", "node", "n", "component", main.alias("main"), own.alias("block"), rest.alias("_rest"), blocks(F.col("_most")).alias("_mains"))
    upto = lambda count: F.sequence(F.lit(0), count - 1)
    tasks = F.when(
        F.col("main"), F.transform(upto(F.col("_rest")), lambda k: F.struct(k.alias("i"), F.lit(True).alias("across"), F.col("block").alias("j")))
    ).otherwise(
        F.concat(
            F.transform(upto(F.col("_rest")), lambda k: F.struct(F.least(k, "block").alias("i"), F.lit(False).alias("across"), F.greatest(k, "block").alias("j"))),
            F.transform(upto(F.col("_mains")), lambda k: F.struct(F.col("block").alias("i"), F.lit(True).alias("across"), k.alias("j"))),
        )
    )
    full = placed.withColumn("_t", F.explode(tasks)).select("bucket", "_t.*", "main", "block", "node", "n", "component").join(sets, "node")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        across, same = bool(pdf["across"].iat[0]), pdf["i"].iat[0] == pdf["j"].iat[0]
        root: dict[bytes, bytes] = {c: c for c in pdf["component"]}

        def find(c: bytes) -> bytes:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        sides = pdf["main"] if across else pdf["block"]
        rows = list(zip(sides, pdf["node"], pdf["n"], pdf["component"]))
        sets = _Sets(pa.array(pdf["words"], pa.binary()), percent)
        out = []
        for x, p in enumerate(rows):
            for y, q in enumerate(rows[x + 1 :], x + 1):
                if (across or not same) and p[0] == q[0]:
                    continue
                if 100 * min(p[2], q[2]) < percent * max(p[2], q[2]) or find(p[3]) == find(q[3]):
                    continue
                if sets.linked(x, sets, y):
                    root[find(p[3])] = find(q[3])
                    out.append((p[1], q[1]))
        return pd.DataFrame(out, columns=["a", "b"])

    return full.groupBy("bucket", "i", "across", "j").applyInPandas(compare, "a binary, b binary")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 85, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id`` and ``kept``, and the columns to ``carry``.

    Documents are linked where 100 times their sets' intersection is at least ``percent`` times the
    union; ``component_id`` is the least doc_id reachable over links, the document's own included, and
    ``kept`` says whether that is the document's own.

    A null text, or one without words, has an empty set and is linked with nothing. A null doc_id is never
    a component's id unless all its documents have none; such rows have a null ``component_id`` and are
    kept. Rows that repeat a doc_id are rows of their own. An empty table gives an empty result; other
    columns are ignored. With 24 bands of 5 values a pair at 85 percent goes unseen with a probability
    below 1e-6, one at 80 percent with about 7e-5 (and may still be connected over others); more alike
    pairs far less. Documents whose sets have the same 128-bit key are taken for equal, all other links are
    confirmed by their words. Names in ``carry`` must not be those of the other output columns.
    """
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    slim = stored(sketch(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.struct(F.lit(1).alias("_"), *carry).alias("_carried"))), "sketches")
    classes = slim.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    entries = classes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("least"), F.count("*").alias("_size")).where("_size > 1")
    members = stored(entries.join(shared, "bucket").select("bucket", "node", "n", "least"), "members")
    alike = 100 * F.least("n", "least.n") >= percent * F.greatest("n", "least.n")
    pairs = members.where(alike & (F.col("node") != F.col("least.node"))).select(F.col("least.node").alias("a"), F.col("node").alias("b")).distinct()
    classes = classes.select("node", "first")
    sets = stored(_sets(docs, classes.join(members.select("node").distinct(), "node")), "sets")
    links = stored(_confirm(pairs, sets, percent), "confirmed")
    found = components(links).withColumnRenamed("id", "node")
    labelled = members.join(found, "node", "left").select("bucket", "node", "n", F.coalesce("component", "node").alias("component"))
    more = stored(_block_links(stored(labelled, "labelled"), sets, percent), "more")
    if not more.isEmpty():
        # The first run's result stands for its links.
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)).withColumnRenamed("id", "node")
    grouped = classes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    resolved = grouped.join(ids, "component").select("node", "component_id")
    out = slim.select("doc_id", "n_shingles", "node", "_carried").join(resolved, "node", "left")
    component_id = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component_id.alias("component_id"), *(F.col("_carried")[c].alias(c) for c in carry)).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
