"""Packing documents into sequences: first-fit decreasing with a tournament tree of bin capacities.

Each document's ids are cut into full pieces and one shorter rest. The rests of a randomised group of
documents are placed, longest first, each into the first sequence with room for it; the tree over the
sequences' free room finds that one in logarithmic time.
"""

from __future__ import annotations

import math
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from .byte_bpe import read_ranks
from .chunks import ChunkEncoder, same_white
from .common import bounded_batches, shuffle_partitions, small_batches

SEQUENCE_TOKENS = 1024
GROUP_PIECES = 8192


class Bins:
    """Bins of equal capacity under a tournament tree: each inner node holds the most room below it."""

    def __init__(self, most: int, capacity: int):
        self.base = 1 << max(0, (most - 1).bit_length())
        self.room = [capacity] * (2 * self.base)
        self.capacity, self.used = capacity, 0

    def first_fit(self, size: int) -> tuple[int, int]:
        """Put an item into the first bin with room for it; its number and the place inside."""
        room, node, base = self.room, 1, self.base
        while node < base:
            node *= 2
            if room[node] < size:
                node += 1
        place = self.capacity - room[node]
        room[node] -= size
        bin_ = node - base
        self.used = max(self.used, bin_ + 1)
        node //= 2
        while node:
            most = room[2 * node] if room[2 * node] >= room[2 * node + 1] else room[2 * node + 1]
            if room[node] == most:
                break
            room[node] = most
            node //= 2
        return bin_, place


class _Tokens:
    """Ids as the tokenizer file gives them, found through the rank file of the same vocabulary."""

    def __init__(self, ranks_path: str, pattern: str, special: dict[str, int]):
        import tiktoken

        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens={})
        core = encoding._core_bpe
        self.special = special
        self.chunks = ChunkEncoder(lambda chunks: [struct.pack(f"<{len(x)}I", *x) for x in map(core.encode_ordinary, chunks)])
        self.split = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None

    def encode(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text; strings of ``special`` become their single ids."""
        parts = [self.split.split(t) if self.split and any(x in t for x in self.special) else [t] for t in texts]
        coded = iter(self.chunks.encode([p for text in parts for p in text[::2]]))
        return [b"".join(struct.pack("<I", self.special[p]) if k % 2 else next(coded) for k, p in enumerate(text)) for text in parts]


@lru_cache(maxsize=1)
def _tokens(ranks_path: str, pattern: str, special: tuple) -> _Tokens:
    return _Tokens(ranks_path, pattern, dict(special))


def cut_pieces(df: DataFrame, ranks_path: str, pattern: str, special: dict[str, int], doc_id: str = "doc_id", text: str = "text", end_id: int = 0, tokens: int = SEQUENCE_TOKENS) -> DataFrame:
    """The documents' pieces: doc_id, start, length, doc_tokens and ids (packed unsigned 32-bit integers).

    A document is its text's ids and then ``end_id``; a null or empty text is ``end_id`` alone. Pieces are
    cut every ``tokens`` ids, so only a document's last piece can be shorter. Strings in ``special`` are
    single ids. A null doc_id is carried along; repeated rows are documents of their own.
    """
    small_batches(df.sparkSession)
    key = tuple(sorted(special.items()))
    end = struct.pack("<I", end_id)
    kind = df.schema[doc_id].dataType
    schema = T.StructType([T.StructField("doc_id", kind)] + [T.StructField(n, T.LongType()) for n in ("start", "length", "doc_tokens")] + [T.StructField("ids", T.BinaryType())])

    def run(batches):
        encoder = _tokens(ranks_path, pattern, key)
        for batch in bounded_batches(batches):
            at, start, length, total, pieces = [], [], [], [], []
            for row, ids in enumerate(encoder.encode([value or "" for value in batch.column(1).to_pylist()])):
                ids += end
                n = len(ids) // 4
                for s in range(0, n, tokens):
                    at.append(row)
                    start.append(s)
                    length.append(min(tokens, n - s))
                    total.append(n)
                    pieces.append(ids[4 * s : 4 * (s + tokens)])
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(total, pa.int64()), pa.array(pieces, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.select(doc_id, text).mapInArrow(run, schema)


def assign_sequences(pieces: DataFrame, n_groups: int, seed: int = 0, tokens: int = SEQUENCE_TOKENS, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to each piece (doc_id, start and length are read).

    Pieces fall into ``n_groups`` groups by a seeded hash. A group is packed longest first (ties by
    doc_id, then start); a full piece is a sequence of its own. Should a group hold more than
    ``group_pieces`` pieces, as when a third of all rows repeat, it is packed in runs of so many, so memory
    stays bounded. Sequence ids are the group's number times 2**32 and then count up from 0.

    An empty table gives an empty result, input columns named like an output column are replaced.
    """
    pieces = pieces.drop("sequence_id", "offset")
    spread = [c for c in ("doc_id", "start", "ids_crc32", "doc_tokens") if c in pieces.columns]
    grouped = pieces.withColumn("_group", F.pmod(F.xxhash64(*spread, F.lit(seed)), F.lit(n_groups)))
    parts = min(shuffle_partitions(pieces.sparkSession), max(1, n_groups))
    grouped = grouped.repartition(parts, "_group").sortWithinPartitions("_group", F.desc("length"), "doc_id", "start")
    names = [c for c in grouped.columns if c != "_group"]
    schema = T.StructType([*(pieces.schema[c] for c in names), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches):
        group, bins, first, held = None, None, 0, 0
        for batch in batches:
            sequence = np.empty(batch.num_rows, np.int64)
            offset = np.zeros(batch.num_rows, np.int64)
            keys = batch.column(batch.schema.get_field_index("_group")).to_pylist()
            sizes = batch.column(batch.schema.get_field_index("length")).to_pylist()
            for row, (key, size) in enumerate(zip(keys, sizes)):
                if key != group:
                    group, bins, first, held = key, Bins(group_pieces, tokens), 0, 0
                if size >= tokens:
                    sequence[row] = (key << 32) + first
                    first += 1
                    continue
                if held == group_pieces:
                    bins, first, held = Bins(group_pieces, tokens), first + bins.used, 0
                bin_, offset[row] = bins.first_fit(size)
                held += 1
                sequence[row] = (key << 32) + first + bin_
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(sequence), pa.array(offset)], names=schema.names)

    return grouped.mapInArrow(run, schema)


def groups_for(n_documents: int, group_pieces: int = GROUP_PIECES) -> int:
    """So many groups that each holds about half as many documents as a run may."""
    return max(1, math.ceil(2 * n_documents / group_pieces))
