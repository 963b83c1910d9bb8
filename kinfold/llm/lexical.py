"""Ranked lexical search of many items at once: what items share is summed once for each document.

A score is a sum over an item's terms, so items are sums over term sets. Terms that occur in the same items form one set; sets that
occur together in several items are paired again and again, most shared first, and each pair becomes a node of a graph that all items
share. A batch of documents gets one row of partial sums for each set (its accumulators) and one addition for each node; items read their last
node. Each task keeps its best documents of every item, so only these travel.

Items are taken in blocks of bounded size, of which each is one pass over the documents' counted terms.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import bounded_batches, give_back, shuffle_partitions, small_batches, stored, utf8
from .words import hash_spans, lower_ascii, spans

#: (item, term) pairs of a block; an item with more terms is a block of its own.
BLOCK_PAIRS = 1 << 16
#: Bytes of accumulators in a batch of documents.
SUM_BYTES = 16 << 20
#: Sets of an item that take part in pairing, the most shared ones; this bounds the work of mining, not the result.
PAIRED_SETS = 64
_TERM = np.ones(256, bool)
for _low, _high in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    _TERM[_low : _high + 1] = False


def _terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes in lower case, starts and ends of terms, each term's row, terms of each row). Bytes from 128 on belong to terms."""
    data, bounds = utf8(column)
    data = lower_ascii(data)
    starts, ends = spans(~_TERM[data], bounds)
    row = np.searchsorted(bounds, starts, side="right") - 1
    return data, starts, ends, row, np.bincount(row, minlength=len(column)).astype(np.int64)


class Vocabulary:
    """Numbers for a bounded set of terms, found by 64-bit hashes and confirmed by their bytes."""

    def __init__(self, terms: list[bytes]):
        """``terms`` are distinct; their places in the list are their numbers."""
        self.sizes = np.array([len(t) for t in terms], np.int64)
        self.data = np.frombuffer(b"".join(terms), np.uint8)
        self.starts = np.cumsum(self.sizes) - self.sizes
        hashes = hash_spans(self.data, self.starts, self.starts + self.sizes)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two terms share a 64-bit hash")

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each span's term, or -1."""
        out = np.full(len(starts), -1, np.int64)
        if not len(self.hashes) or not len(starts):
            return out
        hashes = hash_spans(data, starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == hashes)
        number, size = self.order[at[hit]], (ends - starts)[hit]
        same = self.sizes[number] == size
        hit, number, size = hit[same], number[same], size[same]
        if len(hit):
            first = np.cumsum(size) - size
            step = np.arange(size.sum()) - np.repeat(first, size)
            wrong = data[np.repeat(starts[hit], size) + step] != self.data[np.repeat(self.starts[number], size) + step]
            good = np.add.reduceat(wrong, first) == 0
            out[hit[good]] = number[good]
        return out


class Plan:
    """Items as sums over shared term sets: ``sets`` (term to set), ``pairs`` (two nodes each, in order), ``last`` (item to node)."""

    def __init__(self, items: list[list[int]], n_terms: int):
        """``items`` lists each item's distinct terms."""
        where: dict[int, list[int]] = defaultdict(list)
        for item, terms in enumerate(items):
            for term in terms:
                where[term].append(item)
        sets: dict[tuple, int] = {}
        self.sets = np.full(n_terms, -1, np.int64)
        for term, holders in sorted(where.items()):
            self.sets[term] = sets.setdefault(tuple(holders), len(sets))
        self.n_sets = len(sets)
        parts: list[set[int]] = [set() for _ in items]
        for holders, node in sets.items():
            for item in holders:
                parts[item].add(node)
        self.pairs: list[tuple[int, int]] = []
        self._mine(parts, {node: len(holders) for holders, node in sets.items()})
        self.last = np.full(len(items), -1, np.int64)
        for item, nodes in enumerate(parts):
            left = sorted(nodes)
            while len(left) > 1:
                self.pairs.append((left[0], left[1]))
                left = left[2:] + [self.n_sets + len(self.pairs) - 1]
            if left:
                self.last[item] = left[0]
        self.n_nodes = self.n_sets + len(self.pairs)

    def _mine(self, parts: list[set[int]], shared: dict[int, int]) -> None:
        """Replace the pair of nodes that most items have in common by a new node, until no two items share a pair."""
        active = [set(heapq.nsmallest(PAIRED_SETS, (n for n in nodes if shared[n] > 1), key=lambda n: (-shared[n], n))) for nodes in parts]
        holders: dict[tuple[int, int], set[int]] = defaultdict(set)
        for item, nodes in enumerate(active):
            for pair in combinations(sorted(nodes), 2):
                holders[pair].add(item)
        queue = [(-len(h), pair) for pair, h in holders.items() if len(h) > 1]
        heapq.heapify(queue)
        while queue:
            count, pair = heapq.heappop(queue)
            held = holders.get(pair, set())
            if len(held) != -count:
                if len(held) > 1:
                    heapq.heappush(queue, (-len(held), pair))
                continue
            new = self.n_sets + len(self.pairs)
            self.pairs.append(pair)
            grown: Counter = Counter()
            for item in sorted(held):
                rest = active[item] - set(pair)
                for gone in pair:
                    for other in rest:
                        holders[min(gone, other), max(gone, other)].discard(item)
                for other in rest:
                    holders[other, new].add(item)
                    grown[other, new] += 1
                active[item] = rest | {new}
                parts[item] = (parts[item] - set(pair)) | {new}
            del holders[pair]
            for made, n in grown.items():
                if n > 1:
                    heapq.heappush(queue, (-n, made))

    def accumulate(self, number: np.ndarray, row: np.ndarray, part: np.ndarray, n_rows: int) -> np.ndarray:
        """Sums of ``part`` (of the terms ``number`` in the documents ``row``), one line for each node and one column for each document."""
        sums = np.zeros((self.n_nodes, n_rows), np.int64)
        np.add.at(sums.reshape(-1), self.sets[number] * n_rows + row, part)
        for k, (a, b) in enumerate(self.pairs, self.n_sets):
            np.add(sums[a], sums[b], out=sums[k])
        return sums


def count_terms(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n (terms with repeats) and the vocabulary's terms in each text: ``terms`` and ``counts``, packed as 32-bit and 64-bit integers."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in bounded_batches(batches):
            data, starts, ends, row, n = _terms(batch.column(1))
            number = vocabulary.find(data, starts, ends)
            known = np.flatnonzero(number >= 0)
            keys, counts = np.unique(row[known] * max(1, len(vocabulary.sizes)) + number[known], return_counts=True)
            row, number = np.divmod(keys, max(1, len(vocabulary.sizes)))
            bounds = np.searchsorted(row, np.arange(batch.num_rows + 1))
            number, counts = number.astype("<i4"), counts.astype("<i8")
            packed = [[a[x:y].tobytes() for x, y in zip(bounds[:-1], bounds[1:])] for a in (number, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(packed[0], pa.binary()), pa.array(packed[1], pa.binary())], ["doc_id", "n", "terms", "counts"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text)).mapInArrow(run, "doc_id long, n long, terms binary, counts binary")


def _unpack(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, row, count) of all entries of a batch of counted documents."""
    data, bounds = utf8(batch.column("terms"))
    counts, _ = utf8(batch.column("counts"))
    row = np.repeat(np.arange(batch.num_rows), np.diff(bounds) // 4)
    return np.frombuffer(data.tobytes(), "<i4").astype(np.int64), row, np.frombuffer(counts.tobytes(), "<i8")


def _best(item: np.ndarray, score: np.ndarray, doc: np.ndarray, named: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best of each item: highest score, then rows with an id, then the smaller id."""
    order = np.lexsort((doc, ~named, -score, item))
    first = np.searchsorted(item[order], item[order])
    return order[np.arange(len(order)) - first < k]


def best_documents(counted: DataFrame, plan: Plan, weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """Each task's ``k`` best documents of every item with a score above 0: item (its place), doc_id, score."""

    def run(batches):
        kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]
        held, waiting, least = [], 0, np.ones(len(plan.last), np.int64)
        live = np.flatnonzero(plan.last >= 0)
        rows = max(1, SUM_BYTES // (8 * max(1, plan.n_nodes)))
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                number, row, tf = _unpack(batch)
                n = batch.column("n").to_numpy(zero_copy_only=False)
                if len(n) and 50 * int(n.max()) * n_docs < 1 << 63:
                    m = 50 + 50 * n * n_docs // max(1, n_terms)
                else:
                    m = np.array([50 + 50 * int(x) * n_docs // max(1, n_terms) for x in n], np.int64)
                part = weights[number] * (1_000_000_000 * tf // (1000 * tf + 20 * m[row]))
                sums = plan.accumulate(number, row, part, batch.num_rows)[plan.last[live]]
                item, column = np.nonzero(sums >= least[live][:, None])
                ids = batch.column("doc_id")
                named = ids.is_valid().to_numpy(zero_copy_only=False)
                ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
                held.append([live[item], sums[item, column], ids[column], named[column]])
                waiting += len(item)
                if waiting > 4 * k * len(plan.last) + 100_000:
                    kept, least = settle(kept, held, least)
                    held, waiting = [], 0
        kept, _ = settle(kept, held, least)
        yield pa.RecordBatch.from_arrays([pa.array(kept[0]), pa.array(kept[2], mask=~kept[3]), pa.array(kept[1])], ["item", "doc_id", "score"])
        give_back()

    def settle(kept, held, least):
        joined = [np.concatenate(x) for x in zip(kept, *held)]
        chosen = _best(*joined[:3], joined[3], k)
        kept = [x[chosen] for x in joined]
        bounds = np.searchsorted(kept[0], np.arange(len(least) + 1))
        full = np.flatnonzero(np.diff(bounds) == k)
        least = least.copy()
        least[full] = kept[1][bounds[full + 1] - 1]
        return kept, least

    return counted.mapInArrow(run, "item long, doc_id long, score long")


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct (item_id, term) of all items; a term is binary, in lower case."""
    kind = dict(items.dtypes)[item_id]
    small_batches(items.sparkSession)

    def run(batches):
        for batch in bounded_batches(batches):
            data, starts, ends, row, _ = _terms(batch.column(1))
            raw = data.tobytes()
            found = [raw[a:b] for a, b in zip(starts, ends)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(found, pa.binary())], ["item_id", "term"])

    return items.select(F.col(item_id).alias("item_id"), F.col(text)).mapInArrow(run, f"item_id {kind}, term binary").distinct()


def _blocks(pairs: DataFrame):
    """Lists of (item_id, terms) of at most ``BLOCK_PAIRS`` pairs, or of one item."""
    lists = pairs.groupBy("item_id").agg(F.array_sort(F.collect_list("term")).alias("terms"))
    block, size = [], 0
    for r in lists.orderBy("item_id").toLocalIterator():
        if block and size + len(r.terms) > BLOCK_PAIRS:
            yield block
            block, size = [], 0
        block.append((r.item_id, [bytes(t) for t in r.terms]))
        size += len(r.terms)
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, k: int = 50, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """The ``k`` documents of the highest score for each item: item_id, rank (from 1), doc_id, score.

    Terms are maximal runs of ASCII letters, digits and characters from U+0080 on, of the whole text, with A-Z in lower case. Of N
    documents with a term, df with this one, L terms in all and n in the document, a term weighs floor(1000 * ln((2N + 2) / (2df + 1)))
    and adds that times (10^9 tf) div (1000 tf + 20 m), m = 50 + (50 n N) div L. Only scores above 0 are returned; equal scores go to
    the smaller doc_id.

    Null texts have no terms. Rows of one doc_id are documents of their own and may both be ranked; rows without one count as
    documents, and are ranked behind those with one at equal scores. Rows of one item_id make one item with the terms of all of them; a
    null item_id is an item too. Items without terms, or whose terms no document has, have no rows; without items or documents the result
    is empty. Other columns are ignored, whatever their names. Each block of items (65,536 item-term pairs) is one pass.
    """
    spark = docs.sparkSession
    kind = dict(items.dtypes)[item_id]
    pairs = stored(item_terms(items, item_id, text), "item-terms")
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for block in _blocks(pairs):
        out = out.unionByName(_search_block(docs, block, kind, k, text, doc_id))
    return out


def _search_block(docs: DataFrame, block: list, kind: str, k: int, text: str, doc_id: str) -> DataFrame:
    spark = docs.sparkSession
    terms = sorted({t for _, found in block for t in found})
    number = {t: j for j, t in enumerate(terms)}
    vocabulary, plan = Vocabulary(terms), Plan([[number[t] for t in found] for _, found in block], len(terms))
    counted = stored(count_terms(docs, vocabulary, text, doc_id), "counted")

    def held(batches):
        df = np.zeros(len(terms), np.int64)
        for batch in batches:
            df += np.bincount(_unpack(batch)[0], minlength=len(terms))
        there = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(df[there])], ["term", "df"])

    # One number for each term of the block, whatever the number of documents.
    found = {r.term: r.df for r in counted.mapInArrow(held, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()}
    size = counted.agg(F.count(F.when(F.col("n") > 0, 1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    weights = np.array([math.floor(1000 * math.log((2 * size.n + 2) / (2 * found.get(j, 0) + 1))) for j in range(len(terms))], np.int64)
    best = best_documents(counted, plan, weights, size.n, size.l, k)
    # Two rounds of ranking: the first spreads each item's rows over several tasks.
    lanes = max(1, min(32, shuffle_partitions(spark)))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    best = best.withColumn("_lane", F.pmod(F.xxhash64("doc_id"), F.lit(lanes)))
    for key in (["item", "_lane"], ["item"]):
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= k)
    best = stored(best.drop("_lane"), "ranked")
    names = spark.createDataFrame([(j, name) for j, (name, _) in enumerate(block)], f"item long, item_id {kind}")
    return names.join(best, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
