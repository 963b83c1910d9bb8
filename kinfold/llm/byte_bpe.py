"""Byte-level BPE through sentencepiece: the model is serialised straight from a vocabulary of ranks.

Each byte becomes one character, each token a piece scored by its negative rank, and normalisation is the
identity. Then sentencepiece's merges (best score first, leftmost on ties) are the merges by rank.
"""

from __future__ import annotations

import base64
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, types as T

from .chunks import ChunkEncoder, same_white
from .common import bounded_batches, small_batches

FIRST_CHARACTER = 0x100
_TO_CHARACTERS = {byte: FIRST_CHARACTER + byte for byte in range(256)}


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks from lines of base64 text and number."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def mapped(token: bytes) -> str:
    """One character for each byte."""
    return token.decode("latin-1").translate(_TO_CHARACTERS)


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value) -> bytes:
    """One protobuf field: a length-delimited one for bytes, a 32-bit one for floats, else a varint."""
    if isinstance(value, bytes):
        return _number(number << 3 | 2) + _number(len(value)) + value
    if isinstance(value, float):
        return _number(number << 3 | 5) + struct.pack("<f", value)
    return _number(number << 3) + _number(value & (1 << 64) - 1)


def serialise(ranks: dict[bytes, int]) -> tuple[bytes, list[int]]:
    """A sentencepiece BPE model of the vocabulary, and the rank of each of its piece ids (-1: unknown)."""
    order = sorted(ranks.items(), key=lambda x: x[1])
    # Fields of the public sentencepiece model format: piece 1, score 2, type 3 (1 normal, 2 unknown).
    pieces = _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    pieces += b"".join(_field(1, _field(1, mapped(token).encode()) + _field(2, float(-rank)) + _field(3, 1)) for token, rank in order)
    trainer = _field(2, _field(3, 2) + _field(40, 0) + _field(41, -1) + _field(42, -1) + _field(43, -1))
    normalizer = _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return pieces + trainer + normalizer, [-1, *(rank for _, rank in order)]


class Codec:
    """Encodes texts to packed ids (little-endian unsigned 32-bit) and decodes them."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        model, self.rank_of = serialise(self.ranks)
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pattern = regex.compile(same_white(pattern))
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.chunks = ChunkEncoder(self.encode_chunks)

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        matches = list(map(self.pattern.findall, chunks))
        found: dict[str, bytes] = {}
        unmerged = []
        for match in set().union(*matches):
            if (rank := self.ranks.get(match.encode())) is not None:
                found[match] = rank.to_bytes(4, "little")
            else:
                unmerged.append(match)
        rank_of = self.rank_of
        for match, ids in zip(unmerged, self.pieces.encode([mapped(m.encode()) for m in unmerged], num_threads=1)):
            found[match] = struct.pack(f"<{len(ids)}I", *[rank_of[i] for i in ids])
        return [found[m[0]] if len(m) == 1 else b"".join(map(found.__getitem__, m)) for m in matches]

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.chunks.encode(texts)

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _map_column(df: DataFrame, source: str, target: str, make) -> DataFrame:
    """Replace column ``source`` by a binary column ``target``; all other columns stay as they are."""
    small_batches(df.sparkSession)
    names = [c for c in df.columns if c not in (source, target)]
    schema = T.StructType([*(df.schema[c] for c in names), T.StructField(target, T.BinaryType())])

    def run(batches):
        convert = make()
        for batch in bounded_batches(batches):
            made = pa.array(convert(batch.column(source).to_pylist()), pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), made], names=[*names, target])

    return df.select(*names, source).mapInArrow(run, schema)


def encode_texts(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Replace the text column by its token ids, packed as little-endian unsigned 32-bit integers.

    ``path`` names a rank file on every machine, ``pattern`` the expression whose matches are encoded each
    for itself. A null or empty text gives no ids (empty bytes). Texts are encoded whole whatever their
    length; rows are independent, so repeated rows and an empty table need no care; an input column named
    like ``ids`` is replaced, all others are carried along.
    """

    def make():
        encoder = codec(path, pattern)
        return lambda values: encoder.encode([value or "" for value in values])

    return _map_column(df, text, ids, make)


def decode_ids(df: DataFrame, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Replace packed ids by the bytes they stand for; null counts as no ids.

    An id that isn't in the vocabulary, or a value that isn't whole 32-bit ids, ends the job with an error, as no bytes would be right for it.
    Repeated rows are decoded each for itself, an input column named like ``decoded`` is replaced, an empty table gives an empty result.
    """

    def make():
        decoder = codec(path, pattern)
        return lambda values: [decoder.decode(value) if value else b"" for value in values]

    return _map_column(df, ids, decoded, make)
