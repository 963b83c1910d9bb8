"""Exact substring dedup: Rabin-Karp hashes of every window of words, counted by Spark, then confirmed.

Each task hashes all windows of a batch of documents. Windows that recur within the batch are compared word
by word; only the first of equal ones travels on, so a passage that many documents share arrives once from
each batch. The rest is dealt out by hash, packed as plain arrays. Where a hash meets itself, its windows are
candidates: they go to their documents, whose words give a 128-bit digest for each, and where digests meet,
all but the first place (least document, then least start) repeat. So a hash that two different windows share
removes nothing. Repeats go back to their documents, where overlapping windows merge into maximal intervals,
which are removed.

Places and texts of a group of documents come together by a sort of Spark's, places first: a task keeps the
group's packed places and passes the texts through one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import bounded_batches, shuffle_partitions, small_batches, squeeze, stored, unsqueeze, utf8
from .words import hash_spans, rolling_hashes, separators, spans

WINDOW_WORDS = 20
BATCH_BYTES = 4 << 20
#: So many digests leave a task at a time.
DIGESTS = 1 << 18
_U = np.uint64
#: Bytes of a window's hash that travel; the bucket it travels to implies more.
_HASH_BYTES = 5
_PACKED = [T.StructField(c, T.BinaryType()) for c in ("docs", "counts", "gaps")]
_MESSAGE = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("keys", T.BinaryType()), *_PACKED])
_PLACES = T.StructType([T.StructField("home", T.IntegerType()), T.StructField("sure", T.BooleanType()), *_PACKED])


def _first(*keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    out = np.ones(len(keys[0]), bool)
    out[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return out


def _pack_places(rows: np.ndarray, docs: np.ndarray, starts: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Documents by runs of ``rows``, the runs' lengths, and each start's gap to the one before in its run.

    A gap is bytes of 255 and then a smaller one, which add up to it.
    """
    first = _first(rows)
    at = np.flatnonzero(first)
    gaps = np.diff(starts, prepend=0)
    gaps[at] = starts[at]
    full = gaps // 255
    ends = np.cumsum(full + 1)
    packed = np.full(int(ends[-1]), 255, np.uint8)
    packed[ends - 1] = gaps - 255 * full
    return docs[at].astype("<i8").tobytes(), np.diff(at, append=len(rows)).astype("<u4").tobytes(), packed.tobytes()


def _unpack_places(docs: bytes, counts: bytes, gaps: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs' documents, their lengths, and all starts."""
    each = np.frombuffer(counts, "<u4").astype(np.int64)
    raw = np.frombuffer(gaps, np.uint8)
    run = np.cumsum(raw, dtype=np.int64)[raw != 255]
    ends = np.cumsum(each)
    base = np.zeros(len(each), np.int64)
    base[1:] = run[ends[:-1] - 1]
    return np.frombuffer(docs, "<i8"), each, run - np.repeat(base, each)


def _dealt(group: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """The entries of each of ``n`` groups, in their order."""
    order = np.argsort(group, kind="stable")
    cuts = np.searchsorted(group[order], np.arange(n + 1))
    for k in np.flatnonzero(np.diff(cuts)):
        yield int(k), order[cuts[k] : cuts[k + 1]]


def _batch(rows: list, schema: T.StructType) -> pa.RecordBatch:
    kinds = {T.IntegerType(): pa.int32(), T.BooleanType(): pa.bool_(), T.BinaryType(): pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[f.dataType]) for c, f in zip(zip(*rows), schema)], names=schema.names)


def _batches(rows: list, schema: T.StructType, most: int = 64) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(rows), most):
        yield _batch(rows[k : k + most], schema)


def _home(docs: Column | np.ndarray, n: int):
    """The group of documents that a document belongs to, for columns and arrays alike."""
    return F.pmod(docs, F.lit(n)).cast("int") if isinstance(docs, Column) else docs % n


def _odd(n: int) -> int:
    """The least prime of at least n, so that ids at even distances spread over all groups."""
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


class _Windows:
    """All windows of a batch of texts: hashes, rows, starts in their row, and places among the batch's words."""

    def __init__(self, column: pa.Array, width: int):
        data, bounds = utf8(column)
        self.width = width
        self.starts, self.ends = spans(separators(data), bounds)
        at = np.searchsorted(self.starts, bounds)
        counts = np.maximum(np.diff(at) - width + 1, 0)
        self.row = np.repeat(np.arange(len(counts)), counts)
        self.start = np.arange(len(self.row)) - np.repeat(np.cumsum(counts) - counts, counts)
        self.place = np.repeat(at[:-1], counts) + self.start
        self.hashes = rolling_hashes(hash_spans(data, self.starts, self.ends), width)[self.place]
        self.raw = data.tobytes()

    def _same(self, a: int, b: int, words: int) -> bool:
        x, y = (self.raw[self.starts[k] : self.ends[k + words - 1]] for k in (a, b))
        return x == y or x.split() == y.split()  # bytes.split takes exactly space and 9 to 13 as white space

    def equal(self, these: np.ndarray, those: np.ndarray) -> np.ndarray:
        """Whether the words of windows ``these`` are those of ``those``; runs of both are compared at once."""
        a, b = self.place[these], self.place[those]
        follows = (a[1:] == a[:-1] + 1) & (b[1:] == b[:-1] + 1) & (self.row[these[1:]] == self.row[these[:-1]]) & (self.row[those[1:]] == self.row[those[:-1]])
        cuts = np.flatnonzero(np.concatenate(([True], ~follows, [True])))
        out = np.empty(len(these), bool)
        for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            out[start:end] = self._same(a[start], b[start], end - start + self.width - 1)
            if not out[start]:
                out[start:end] = [self._same(x, y, self.width) for x, y in zip(a[start:end], b[start:end])]
        return out


def _share(df: DataFrame, width: int, buckets: int, homes: int) -> DataFrame:
    """Messages of all windows of (doc_id, text): to a bucket by hash, or (bucket -1 - home) places that surely repeat."""

    def send(held: list):
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        table = table.take(pa.compute.sort_indices(table.column(0)))
        w = _Windows(table.column(1), width)
        docs = table.column(0).to_numpy(zero_copy_only=False)[w.row]
        order = np.argsort(w.hashes, kind="stable")
        first = _first(w.hashes[order])
        lead = np.empty(len(order), np.int64)
        lead[order] = order[first][np.cumsum(first) - 1]
        travels = np.zeros(len(order), bool)
        travels[order[first]] = True
        # A place equal to the first one (of a repeated row) is no repeat.
        again = np.flatnonzero(~travels & ((docs != docs[lead]) | (w.start != w.start[lead])))
        same = w.equal(again, lead[again]) if len(again) else np.zeros(0, bool)
        travels[again[~same]] = True
        again = again[same]
        for home, at in _dealt(_home(docs[again], homes), homes):
            k = again[at]
            yield (-1 - home, b"", *_pack_places(w.row[k], docs[k], w.start[k]))
        at = np.flatnonzero(travels)
        hashes = w.hashes[at]
        low = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_HASH_BYTES]
        for bucket, k in _dealt(((hashes >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64), buckets):
            yield (bucket, low[k].tobytes(), *_pack_places(w.row[at[k]], docs[at[k]], w.start[at[k]]))

    def run(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        held, size = [], 0
        for batch in bounded_batches(batches):
            held.append(batch)
            size += batch.nbytes
            if size >= BATCH_BYTES:
                yield from _batches(list(send(held)), _MESSAGE)
                held, size = [], 0
        if held:
            yield from _batches(list(send(held)), _MESSAGE)

    return df.select("doc_id", "text").where("doc_id is not null").mapInArrow(run, _MESSAGE)


def _meet(messages: DataFrame, buckets: int, homes: int, key_bytes: int, exact: bool) -> DataFrame:
    """Places of keys that meet themselves: all of them as candidates, or if keys are exact all but the first."""

    def keys_of(packed: bytes, bucket: int) -> list[np.ndarray]:
        if key_bytes == 16:
            both = np.frombuffer(packed, "<u8").reshape(-1, 2)
            return [both[:, 0], both[:, 1]]
        wide = np.zeros((len(packed) // key_bytes, 8), np.uint8)
        wide[:, :key_bytes] = np.frombuffer(packed, np.uint8).reshape(-1, key_bytes)
        # A task may hold several buckets, whose hashes differ in bytes that don't travel.
        return [wide.view("<u8").ravel() | _U(bucket << 8 * key_bytes)]

    def run(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        messages_, found = [], []
        for batch in batches:
            for bucket, packed, docs, counts, gaps in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if bucket < 0:
                    yield _batch([(-1 - bucket, True, docs, counts, gaps)], _PLACES)
                else:
                    found.append(keys_of(packed, bucket))
                    messages_.append((docs, counts, gaps))
        if not found:
            return
        sizes = np.array([len(x[0]) for x in found])
        keys = [np.concatenate(parts) for parts in zip(*found)]
        found.clear()
        order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys)
        first = _first(*(k[order] for k in keys))
        # Places are read only for keys that occur twice, so most of a task's data stays packed.
        shared = np.sort(order[~(first & np.append(first[1:], True))])
        del order, first
        keys = [k[shared] for k in keys]
        docs, starts = np.empty(len(shared), np.int64), np.empty(len(shared), np.int64)
        cuts, ends = np.searchsorted(shared, np.append(0, np.cumsum(sizes))), np.cumsum(sizes)
        for k, packed in enumerate(messages_):
            if cuts[k] < cuts[k + 1]:
                at = shared[cuts[k] : cuts[k + 1]] - (ends[k] - sizes[k])
                ids, counts, places = _unpack_places(*packed)
                docs[cuts[k] : cuts[k + 1]] = np.repeat(ids, counts)[at]
                starts[cuts[k] : cuts[k + 1]] = places[at]
        messages_.clear()
        if exact:
            order = np.lexsort((starts, docs, *keys))
            first = _first(*(k[order] for k in keys))
            lead = order[first][np.cumsum(first) - 1]
            keep = order[~first & ((docs[order] != docs[lead]) | (starts[order] != starts[lead]))]
        else:
            keep = np.arange(len(shared))
        keep = keep[np.lexsort((starts[keep], docs[keep]))]
        for home, at in _dealt(_home(docs[keep], homes), homes):
            k = keep[at]
            yield _batch([(home, exact, *_pack_places(docs[k], docs[k], starts[k]))], _PLACES)

    return messages.repartition(buckets, "bucket").mapInArrow(run, _PLACES)


def _squeezed(df: DataFrame, text: str) -> DataFrame:
    """Replace the text by ``_zip``: its length in bytes and its compressed bytes, null for null."""
    names = [c for c in df.columns if c != text]
    schema = T.StructType([*(df.schema[c] for c in names), T.StructField("_zip", T.BinaryType())])

    def run(batches):
        for batch in bounded_batches(batches):
            zipped = pa.array([None if t is None else squeeze(t.encode()) for t in batch.column(len(names)).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], zipped], names=schema.names)

    return df.select(*names, text).mapInArrow(run, schema)


def _at_home(places: DataFrame, rows: DataFrame, parts: int) -> DataFrame:
    """Packed places and rows (``_home``, ``_doc``, ``_zip`` and others) by home, the places before the rows."""
    both = places.select(F.col("home").alias("_home"), F.lit(0).alias("_kind"), "docs", "counts", "gaps").unionByName(rows.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    first = ["_home", "_kind", "docs", "counts", "gaps", "_doc", "_zip"]
    both = both.select(*first, *(c for c in rows.columns if c not in first))
    return both.repartition(parts, "_home").sortWithinPartitions("_home", "_kind")


class _Known:
    """The starts of a group's documents, gathered packed and sorted once when first asked for."""

    def __init__(self):
        self.held: list[tuple] = []
        self.ids = None

    def add(self, *packed: bytes) -> None:
        self.held.append(packed)
        self.ids = None

    def of(self, doc: int) -> np.ndarray | None:
        if self.ids is None:
            parts = [_unpack_places(*p) for p in self.held]
            docs = np.concatenate([np.repeat(ids, each) for ids, each, _ in parts]) if parts else np.zeros(0, np.int64)
            starts = np.concatenate([x.astype(np.uint32) for _, _, x in parts]) if parts else np.zeros(0, np.uint32)
            order = np.argsort(docs, kind="stable")
            docs, self.starts = docs[order], starts[order]
            self.ids, self.cuts = np.unique(docs, return_index=True)
            self.cuts = np.append(self.cuts, len(docs))
        at = int(np.searchsorted(self.ids, doc))
        if at == len(self.ids) or self.ids[at] != doc:
            return None
        return np.unique(self.starts[self.cuts[at] : self.cuts[at + 1]]).astype(np.int64)


def _visits(batches) -> Iterator[tuple[pa.RecordBatch, list]]:
    """For each batch of ``_at_home`` its rows that are no places, with (text, starts or none) for each."""
    home, known = None, _Known()
    for batch in bounded_batches(batches):
        chosen, out = [], []
        for k, (at, kind, docs, counts, gaps, doc, zipped) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(7)))):
            if at != home:
                home, known = at, _Known()
            if kind:
                chosen.append(k)
                out.append((b"" if zipped is None else unsqueeze(zipped), None if doc is None else known.of(doc)))
            else:
                known.add(docs, counts, gaps)
        if chosen:
            yield batch.take(pa.array(chosen, pa.int64())), out


def _digests(candidates: DataFrame, rows: DataFrame, width: int, buckets: int) -> DataFrame:
    """Messages of the digests of all candidate windows, by digest."""

    def run(batches):
        keys, docs, counts, starts = [], [], [], []

        def send():
            every = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 16)
            ids, row, at = np.repeat(docs, counts), np.repeat(np.arange(len(docs)), counts), np.concatenate(starts)
            for x in (keys, docs, counts, starts):
                x.clear()
            high = every.view("<u8")[:, 1] >> _U(32)
            rows_ = [(bucket, every[k].tobytes(), *_pack_places(row[k], ids[k], at[k])) for bucket, k in _dealt((high * _U(buckets) >> _U(32)).astype(np.int64), buckets)]
            yield from _batches(rows_, _MESSAGE)

        for batch, visited in _visits(batches):
            for doc, (text, found) in zip(batch.column(5).to_pylist(), visited):
                if found is None:
                    continue
                words = text.split()
                at = found[found <= len(words) - width]
                if len(at):
                    keys.extend(hashlib.blake2b(b" ".join(words[s : s + width]), digest_size=16).digest() for s in at.tolist())
                    docs.append(doc)
                    counts.append(len(at))
                    starts.append(at)
                if len(keys) >= DIGESTS:
                    yield from send()
        if keys:
            yield from send()

    return _at_home(candidates, rows, buckets).mapInArrow(run, _MESSAGE)


def repeated_windows(df: DataFrame, width: int, homes: int) -> DataFrame:
    """(``home``, ``sure``, ``docs``, ``counts``, ``gaps``): packed places of windows that also start earlier.

    ``df`` has doc_id (long) and text. A place may be given more than once.
    """
    buckets = shuffle_partitions(df.sparkSession)
    small_batches(df.sparkSession)
    met = stored(_meet(_share(df, width, buckets, homes), buckets, homes, _HASH_BYTES, False), "candidates")
    docs = df.where("doc_id is not null")
    rows = _squeezed(docs.select(F.col("doc_id").alias("_doc"), _home(F.col("doc_id"), homes).alias("_home"), "text"), "text")
    exact = _meet(_digests(met.where("not sure"), rows, width, buckets), buckets, homes, 16, True)
    return met.where("sure").unionByName(exact)


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WINDOW_WORDS, leave_whole: bool = False) -> DataFrame:
    """Add ``n_words``, ``n_removed`` and ``kept_text`` to each row and drop the text column.

    A word is removed if a window over it has a word sequence that also starts earlier: in a document of
    smaller id, or earlier in the same one. Windows are judged on the input. ``kept_text`` is the other
    words joined by single spaces; with ``leave_whole`` a text of which nothing is removed stays as it is,
    null included. Whole texts are read, all windows are counted.

    A null text has no words. A row without a doc_id is returned with nothing removed and is no earlier
    place for others. Rows that repeat a doc_id share its places: a window at the same id and start is the
    same place and so no repeat. Other columns are carried along; an input column named like an output column is
    replaced; an empty table gives an empty result.
    """
    df = df.drop("n_words", "n_removed", "kept_text")
    parts = shuffle_partitions(df.sparkSession)
    homes = _odd(parts)
    places = repeated_windows(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), width, homes)
    names = [c for c in df.columns if c != text]
    row = F.struct(F.lit(1).alias("_"), *names).alias("_row")
    home = F.coalesce(_home(F.col(doc_id).cast("long"), homes), F.pmod(F.xxhash64(text), F.lit(homes)).cast("int")).alias("_home")
    rows = _squeezed(df.select(row, F.col(doc_id).cast("long").alias("_doc"), home, F.col(text).alias("_text")), "_text")
    schema = T.StructType([rows.schema["_row"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])

    def clean(batches):
        for batch, visited in _visits(batches):
            made = [_cut(value, found, width, leave_whole) for value, found in visited]
            if leave_whole:
                empty = [z is None for z in batch.column(6).to_pylist()]
                made = [(*m[:2], None) if e else m for m, e in zip(made, empty)]
            counted, removed, kept = zip(*made)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("_row")), pa.array(counted, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=schema.names)

    out = _at_home(places, rows, parts).mapInArrow(clean, schema)
    return out.select(*(F.col("_row")[c].alias(c) for c in names), "n_words", "n_removed", "kept_text")


def _cut(text: bytes, starts: np.ndarray | None, width: int, leave_whole: bool) -> tuple[int, int, str]:
    """Number of words, of removed ones, and the rest's text; overlapping windows merge first."""
    words = text.split()
    whole = lambda: (text if leave_whole else b" ".join(words)).decode()
    if starts is None:
        return len(words), 0, whole()
    depth = np.zeros(len(words) + 1, np.int64)
    at = starts[starts <= len(words) - width]
    np.add.at(depth, at, 1)
    np.add.at(depth, at + width, -1)
    gone = np.cumsum(depth[:-1]) > 0
    if not gone.any():
        return len(words), 0, whole()
    return len(words), int(gone.sum()), b" ".join([w for w, g in zip(words, gone.tolist()) if not g]).decode()
