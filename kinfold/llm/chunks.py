"""Byte-level BPE of long texts by cached chunks.

The tokenizers' pattern never matches from a non-space character into white space, so a text may be cut
before any run of white space and its parts encoded each for itself. Most parts recur, so their ids are
kept in a bounded table.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

#: The characters with the Unicode property White_Space, as a regular expression's class.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNK = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
_TOUCHING = re.compile(f" (?:(?=[{WHITE}])|(?<=[{WHITE}] ))")
_CUT = re.compile(f"(?<=[^{WHITE}]) ")


def same_white(pattern: str) -> str:
    """The pattern with white space spelled as the Unicode property, as the tokenizers understand it."""
    return pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


def segments(text: str, limit: int = 1 << 20) -> Iterator[str]:
    """Parts of about ``limit`` characters, cut where a run of white space begins."""
    at = 0
    while len(text) - at > limit and (cut := _CUT.search(text, at + limit)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


class ChunkEncoder:
    """Encodes batches of texts by way of ``encode_chunks`` (new chunks to packed ids).

    Up to ``most`` results are kept from batch to batch. Keys are what stands between single spaces, so a
    word is one key whether or not a space goes before it in the text's first place.
    """

    def __init__(self, encode_chunks: Callable[[list[str]], list[bytes]], most: int = 200_000):
        self.encode_chunks, self.most = encode_chunks, most
        self.spaced: dict[str, bytes] = {}
        self.plain: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text."""
        out, rows, open_, plan = [], [], {True: [], False: []}, []
        for text in texts:
            for part in segments(text):
                if _TOUCHING.search(part) or part[:1] == " ":
                    plan.append(self._look(False, _CHUNK.findall(part), open_))
                else:
                    first, *rest = part.split(" ")
                    plan.append(self._look(False, [first] if first else [], open_))
                    plan.append(self._look(True, rest, open_))
            rows.append(len(plan))
        for spaced, waiting in open_.items():
            self._learn(spaced, waiting)
        at = 0
        for row in rows:
            out.append(b"".join([b"".join(found) for found in plan[at:row]]))
            at = row
        return out

    def _look(self, spaced: bool, keys: list[str], open_: dict) -> list:
        found = list(map((self.spaced if spaced else self.plain).get, keys))
        if None in found:
            open_[spaced].append((keys, found))
        return found

    def _learn(self, spaced: bool, waiting: list) -> None:
        """Encode what wasn't known and fill it in; keep it while there is room."""
        kept = self.spaced if spaced else self.plain
        missing = list({keys[k] for keys, found in waiting for k, value in enumerate(found) if value is None})
        new = dict(zip(missing, self.encode_chunks([" " + key for key in missing] if spaced else missing)))
        for keys, found in waiting:
            for k, value in enumerate(found):
                if value is None:
                    found[k] = new[keys[k]]
        if len(kept) + len(new) <= self.most:
            kept.update(new)
