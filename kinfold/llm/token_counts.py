"""Token counts by a deterministic transducer compiled from a BPE vocabulary.

The tokens of a text's first characters end in exactly one token, and it follows from the tokens that end
a few characters before: the only suffix that is a token and stays apart from the token before it. So a
finite state (the suffix that can still grow into a token, with the last token and the count at each of
its positions) is enough, and each transition is annotated with the tokens it adds. States are made when
they are first reached, and forgotten when there are too many, also in the middle of a word.

A text is chunks of spaces and then other characters; no token goes on after a chunk. Runs of spaces merge
last, so of several spaces only the last one can join the word: the transducer starts behind it, in a state
marked so that the total shows whether it did.

A part of a text is a state map: for each state that may come before it, what it adds and the state behind
it. Which states may come before follows from the characters before the part. Maps compose associatively:
Spark gathers neighbouring maps in blocks, whose compositions are gathered again, until each text has one.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import bounded_batches, small_batches, stored

SPACE = "▁"
PART_CHARACTERS = 1 << 18
#: Characters before a part from each of which a state before it is tried, and parts composed in one block.
CONTEXT, BLOCK = 64, 64
_CHUNK = re.compile("( +)([^ ]*)")
_TURN = re.compile("(?<=[^ ]) ")
#: Added to a chunk's total while its first token is the last space alone.
_ALONE = 1 << 40


def read_pieces(model: bytes) -> dict[str, float]:
    """Normal pieces and their scores out of a serialised sentencepiece model."""

    def fields(data: bytes):
        at = 0

        def number() -> int:
            nonlocal at
            value = shift = 0
            while True:
                byte = data[at]
                at += 1
                value |= (byte & 127) << shift
                shift += 7
                if byte < 128:
                    return value

        while at < len(data):
            key = number()
            size = {0: 0, 1: 8, 2: -1, 5: 4}[key & 7]
            if size == 0:
                yield key >> 3, number()
            else:
                size = number() if size < 0 else size
                yield key >> 3, data[at : at + size]
                at += size

    out = {}
    for number, value in fields(model):
        if number == 1:
            piece = dict(fields(value))
            if piece.get(3, 1) == 1:
                out[piece[1].decode()] = struct.unpack("<f", piece[2])[0]
    return out


class Transducer:
    """Counts the tokens of chunks; keeps up to about ``most`` states and transitions, and twice as many counts of words."""

    def __init__(self, pieces: dict[str, float], most: int = 200_000):
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces):
            raise ValueError("a piece goes on after a space, so chunks can't be counted apart")
        runs = {p: score for p, score in pieces.items() if len(p) > 1 and not p.strip(SPACE)}
        joined = [score for p, score in pieces.items() if p[:1] == SPACE and p.strip(SPACE)]
        if any(p.startswith(SPACE * 2) and p.strip(SPACE) for p in pieces) or (runs and joined and max(runs.values()) >= min(joined)):
            raise ValueError("runs of spaces merge before words, so they can't be counted apart")
        self.pieces, self.most = pieces, most
        self.starts = {p[:k] for p in pieces for k in range(1, len(p))}
        self.apart: dict[tuple[str | None, str], bool] = {}
        self.known: dict[str, int] = {}
        self.single: dict[str, int] = {}
        self.longest_run = max(map(len, runs), default=1)
        self.run_counts = [0, *(len(self.merge(SPACE * k)) for k in range(1, 4 * self.longest_run + 1))]
        if any(self.run_counts[k + self.longest_run] != self.run_counts[k] + 1 for k in range(self.longest_run, 3 * self.longest_run + 1)):
            raise ValueError("counts of runs of spaces don't repeat")
        self._clear()

    def _clear(self) -> None:
        self.states: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        self.steps: list[dict] = []
        self.transitions = 0
        self.number(("", (None,), (0,)))
        # Behind a space that is a token by itself so far, at a price that a longer first token takes back.
        count = 1 if SPACE in self.pieces else len(SPACE.encode())
        self.marked = self.number((SPACE, (None, SPACE), (-count - _ALONE, 0)))
        self.marked_count = count

    def number(self, state: tuple) -> int:
        if (found := self.numbers.get(state)) is None:
            found = self.numbers[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
        return found

    def runs(self, spaces: int) -> int:
        """Tokens of so many spaces by themselves."""
        whole = max(0, spaces // self.longest_run - 2)
        return whole + self.run_counts[spaces - whole * self.longest_run]

    def chunk(self, spaces: int, total: int) -> int:
        """Tokens of a chunk of so many spaces and a word whose transitions add up to ``total`` (0: no word)."""
        if not total:
            return self.runs(spaces)
        if total >= _ALONE:  # the last space is left to the others
            return total - _ALONE - self.marked_count + self.runs(spaces)
        return total + self.runs(spaces - 1)

    def merge(self, text: str) -> list[str]:
        """The tokens of a text by merging: best score first, leftmost on ties."""
        symbols: list[str | None] = list(text)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(left: int) -> None:
            if left >= 0 and after[left] < n:
                both = symbols[left] + symbols[after[left]]
                if (score := self.pieces.get(both)) is not None:
                    heapq.heappush(heap, (-score, left, both))

        for left in range(n - 1):
            offer(left)
        while heap:
            _, left, both = heapq.heappop(heap)
            right = after[left] if symbols[left] is not None else n
            if right >= n or symbols[left] + symbols[right] != both:
                continue
            symbols[left], symbols[right] = both, None
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
            offer(before[left])
            offer(left)
        return [s for s in symbols if s is not None]

    def _stays(self, last: str | None, token: str) -> bool:
        """Whether the merges leave ``last`` and ``token`` apart when they meet."""
        if (known := self.apart.get((last, token))) is None:
            if len(self.apart) > 3 * self.most // 2:
                self.apart.clear()
            whole = [token] if last is None else [last, token]
            known = self.apart[last, token] = self.merge("".join(whole)) == whole
        return known

    def _step(self, state: int, char: str) -> tuple[int, int]:
        suffix, lasts, counts = self.states[state]
        text = suffix + char
        for length in range(len(text), 0, -1):
            token = text[-length:]
            if (length == 1 or token in self.pieces) and self._stays(lasts[len(text) - length], token):
                break
        cost = 1 if token in self.pieces else len(char.encode())
        count = counts[len(text) - length] + cost
        keep = next((k for k in range(len(text), 0, -1) if text[-k:] in self.starts), 0)
        # Places from which no token can grow are left blank, so that more texts share a state.
        at = len(text) - keep
        grows = [text[k:] in self.starts for k in range(at, len(text))]
        lasts = (*(t if g else None for t, g in zip(lasts[at:], grows)), token)
        counts = (*(c - count if g else 0 for c, g in zip(counts[at:], grows)), 0)
        # Counts in a state are relative to its last place, so this one is what the step emits.
        self.steps[state][char] = out = (self.number((text[at:], lasts, counts)), count)
        self.transitions += 1
        return out

    def _forget(self, states: list[int]) -> list[int]:
        """Forget all states but these, if there are too many; the numbers these have now."""
        if len(self.states) <= self.most and self.transitions <= 2 * self.most:
            return states
        kept = [self.states[s] for s in states]
        self._clear()
        return [self.number(k) for k in kept]

    def run(self, state: int, text: str) -> tuple[int, int]:
        """Where a state leads over a text without spaces, and what it adds."""
        total = 0
        for start in range(0, len(text), 256):
            state = self._forget([state])[0]
            steps = self.steps
            for char in text[start : start + 256]:
                found = steps[state].get(char) or self._step(state, char)
                state = found[0]
                total += found[1]
        return state, total

    def follow(self, states: list[int], text: str) -> list[tuple[int, int]]:
        """``run`` for several states; those that meet go on as one."""
        at = list(dict.fromkeys(states))
        of = [at.index(s) for s in states]
        ahead, base = [0] * len(states), [0] * len(at)
        for k, char in enumerate(text):
            if len(at) == 1:
                state, added = self.run(at[0], text[k:])
                return [(state, base[0] + x + added) for x in ahead]
            at = self._forget(at)
            for j, state in enumerate(at):
                found = self.steps[state].get(char) or self._step(state, char)
                at[j] = found[0]
                base[j] += found[1]
            if len(set(at)) < len(at):
                order = list(dict.fromkeys(at))
                first = [at.index(s) for s in order]
                ahead = [x + base[j] - base[at.index(at[j])] for x, j in zip(ahead, of)]
                of = [order.index(at[j]) for j in of]
                at, base = order, [base[j] for j in first]
        return [(at[j], base[j] + x) for x, j in zip(ahead, of)]

    def word(self, word: str) -> int:
        """What the transitions over a word behind a space add up to."""
        if (found := self.known.get(word)) is None:
            found = self.marked_count + _ALONE + self.run(self.marked, word)[1] if word else 0
            if len(self.known) < self.most * 2 and len(word) < 60:
                self.known[word] = found
        return found

    def _behind_single_spaces(self, words: list[str]) -> int:
        """Tokens of all these words, each behind one space."""
        found = list(map(self.single.get, words))
        if None in found:
            for k, count in enumerate(found):
                if count is None:
                    found[k] = self.chunk(1, self.word(words[k]))
                    if len(self.single) < self.most * 2 and len(words[k]) < 60:
                        self.single[words[k]] = found[k]
        return sum(found)

    def _closed(self, text: str, with_state: bool = True) -> tuple[int, int, int, int | None]:
        """Of text from a space on: tokens of its chunks but the last one; the last one's spaces, total and state."""
        if "  " not in text:
            *words, last = text[1:].split(" ")
            between, spaces = self._behind_single_spaces(words), 1
        else:
            *chunks, (blank, last) = _CHUNK.findall(text)
            between, spaces = sum(self.chunk(len(b), self.word(w)) for b, w in chunks), len(blank)
        if not last:
            return between, spaces, 0, None
        # What stands behind the last word matters to parts alone; a whole text needs its total.
        if not with_state:
            return between, spaces, self.word(last), None
        state, added = self.run(self.marked, last)
        return between, spaces, self.marked_count + _ALONE + added, state

    def count(self, text: str) -> int:
        """Tokens of a whole text; a space goes before a text that isn't empty."""
        if not text:
            return 0
        between, spaces, total, _ = self._closed(" " + text.replace(SPACE, " "), False)
        return between + self.chunk(spaces, total)

    def _key(self, state: int | None) -> str:
        return "" if state is None else json.dumps(self.states[state])

    def _before(self, context: str) -> list[int | None]:
        """The states that may stand behind the last characters before a part; none: behind a space or the start."""
        if not context or context[-1] == " ":
            return [None]
        word = context[context.rfind(" ") + 1 :]
        if len(word) < len(context):
            return [self.run(self.marked, word)[0]]
        kept: dict[tuple, None] = {}
        for at in range(len(word)):
            for start in (0, self.marked):
                kept[self.states[self.run(start, word[at:])[0]]] = None
        return [self.number(k) for k in kept]

    def state_map(self, text: str, context: str) -> dict[str, list]:
        """For each state before a part (``""``: spaces; ``*``: any word) what the part adds.

        That is: whether the chunk before ends in the part; how many spaces and how much of a total it still gets;
        tokens of whole chunks after it; and the spaces, total and state of the part's last chunk.
        """
        text, context = text.replace(SPACE, " "), context.replace(SPACE, " ")
        turn = _TURN.search(text)
        head = text[: turn.start()] if turn else text
        word = head.lstrip(" ")
        blank = len(head) - len(word)
        out: dict[str, list] = {}
        before = self._before(context)
        keys = [self._key(s) for s in before]
        start = self.marked_count + _ALONE
        if blank or before == [None]:
            state, added = self.run(self.marked, word) if word else (None, -start)
            out[""] = [False, blank, start + added, 0, 0, 0, self._key(state)]
            if blank:
                out["*"] = [True, 0, 0, 0, blank, start + added, self._key(state)]
        else:
            ends = self.follow(before, word)
            out |= {key: [False, 0, added, 0, 0, 0, self._key(state)] for key, (state, added) in zip(keys, ends)}
        if turn:
            between, spaces, total, state = self._closed(text[turn.start() :])
            rest = {"*": [True, 0, 0, between, spaces, total, self._key(state)]}
            out = self.compose(out, rest)
        return out

    def compose(self, a: dict[str, list], b: dict[str, list]) -> dict[str, list]:
        """The state map of two parts that stand side by side; what leads to an unknown state is left out."""
        out = {}
        for entry, (ends, blank, total, between, spaces, own, state) in a.items():
            found = b.get(state) or (b.get("*") if state else None)
            if found is None:
                continue
            ends2, blank2, total2, between2, spaces2, own2, state2 = found
            if not ends:
                out[entry] = [ends2, blank + blank2, total + total2, between2, spaces2, own2, state2]
            elif not ends2:
                out[entry] = [True, blank, total, between, spaces + blank2, own + total2, state2]
            else:
                out[entry] = [True, blank, total, between + self.chunk(spaces + blank2, own + total2) + between2, spaces2, own2, state2]
        return out

    def total(self, whole: dict[str, list]) -> int | None:
        """Tokens of the text with this state map, none if the map doesn't tell."""
        if (found := whole.get("")) is None:
            return None
        ends, blank, total, between, spaces, own, _ = found
        first = self.chunk(1 + blank, total)
        return first + between + self.chunk(spaces, own) if ends else first


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    with open(path, "rb") as model:
        return Transducer(read_pieces(model.read()))


def count_tokens(df: DataFrame, model_path: str, text: str = "text", part_characters: int = PART_CHARACTERS) -> DataFrame:
    """Add ``n_bytes`` (UTF-8) and ``n_tokens`` to each row and drop the text column.

    ``model_path`` names, on every machine, a sentencepiece BPE model with byte fallback, identity
    normalisation and a space put before the text. Texts are cut into parts of ``part_characters``, with or
    without spaces in them; the parts' state maps are made in parallel and composed by text. Should a text's
    maps not meet in a known state, it is counted once more from its start, in bounded memory beside the text.

    A null text counts as empty: no bytes, no tokens. Repeated rows are counted each for itself, all other
    columns are carried along, an input column named like an output column is replaced; an empty table gives an
    empty result. Rows are told apart by ``monotonically_increasing_id``, so the input should be a scan or a
    stored table.
    """
    small_batches(df.sparkSession)
    df = df.drop("n_bytes", "n_tokens")
    kept = [c for c in df.columns if c != text]
    value = F.coalesce(text, F.lit(""))
    slice_ = lambda at, size: F.struct(F.substring(value, at - CONTEXT + 1, F.lit(CONTEXT)).alias("before"), F.substring(value, at + 1, size).alias("text"))
    whole = F.struct(F.lit("").alias("before"), value.alias("text"))
    first = F.struct(F.lit("").alias("before"), F.substring(value, F.lit(1), F.lit(part_characters)).alias("text"))
    parts = F.when(F.length(value) <= part_characters, F.array(whole)).otherwise(
        F.concat(F.array(first), F.transform(F.sequence(F.lit(part_characters), F.greatest(F.length(value) - 1, F.lit(part_characters)), F.lit(part_characters)), lambda at: slice_(at, F.lit(part_characters))))
    )
    # The id is made before the parts are, else each part would get one of its own.
    rows = df.withColumn("_id", F.monotonically_increasing_id())
    cut = rows.select("_id", F.struct(F.lit(1).alias("_"), *kept).alias("_row"), (F.length(value) <= part_characters).alias("_one"), F.posexplode(parts).alias("_part", "_p"))
    cut = cut.select("_id", F.when(F.col("_part") == 0, F.col("_row")).alias("_row"), "_part", "_one", F.col("_p.before").alias("_before"), F.col("_p.text").alias("_text"))
    made = T.StructType([T.StructField("_id", T.LongType()), T.StructField("_row", cut.schema["_row"].dataType), T.StructField("_part", T.IntegerType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("_map", T.StringType())])

    def maps(batches):
        counter = transducer(model_path)
        for batch in bounded_batches(batches):
            counts, found, sizes = [], [], []
            for one, before, part in zip(*(batch.column(k).to_pylist() for k in (3, 4, 5))):
                sizes.append(len(part.encode()))
                counts.append(counter.count(part) if one else None)
                found.append(None if one else json.dumps(counter.state_map(part, before)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array(found, pa.string())], names=made.names)

    def compose(batches):
        counter = transducer(model_path)
        for batch in bounded_batches(batches):
            counts, found = [], []
            for count, held in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                held = [json.loads(m["_map"]) for m in held]
                while len(held) > 1:
                    held = [counter.compose(*held[k : k + 2]) if k + 1 < len(held) else held[k] for k in range(0, len(held), 2)]
                found.append(json.dumps(held[0]) if held else None)
                # Only a text's last composition starts at its start, all others find no use for this.
                counts.append(counter.total(held[0]) if held else count)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(counts, pa.int64()), pa.array(found, pa.string())], names=made.names)

    level = cut.mapInArrow(maps, made)
    while True:
        block = F.floor(F.col("_part") / BLOCK).cast("int")
        held = F.array_sort(F.collect_list(F.when(F.col("_map").isNotNull(), F.struct("_part", "_map"))))
        gathered = level.groupBy("_id", block.alias("_part")).agg(F.first("_row", ignorenulls=True).alias("_row"), F.sum("n_bytes").alias("n_bytes"), F.max("n_tokens").alias("n_tokens"), held.alias("_maps"))
        level = stored(gathered.select("_id", "_row", "_part", "n_bytes", "n_tokens", "_maps").mapInArrow(compose, made), "maps")
        if level.where("_part > 0").isEmpty():
            break
        level = level.withColumn("n_tokens", F.when(F.col("_map").isNull(), F.col("n_tokens")))
    out = level.select("_id", "_row", "n_bytes", "n_tokens")
    lost = out.where("n_tokens is null")
    if not lost.isEmpty():
        again = T.StructType([T.StructField("_id", T.LongType()), T.StructField("_again", T.LongType())])

        def recount(batches):
            counter = transducer(model_path)
            for batch in bounded_batches(batches):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(counter.count, batch.column(1).to_pylist()), pa.int64())], names=again.names)

        counted = rows.select("_id", value.alias("_text")).join(lost.select("_id"), "_id", "left_semi").mapInArrow(recount, again)
        out = out.join(counted, "_id", "left").withColumn("n_tokens", F.coalesce("n_tokens", "_again"))
    return out.select(*(F.col("_row")[c].alias(c) for c in kept), "n_bytes", "n_tokens")
