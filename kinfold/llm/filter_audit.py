"""What each filter removes in every order of filters, by counting paths through the lattice of filter subsets.

A state is the set of filters applied so far; an edge applies one more. What an edge removes doesn't depend on the order in
which its state was reached, so all orders together need no more than one number for each edge. The orders that pass an edge are
those that reach its state (counted forward from the empty set) times those that leave its end (counted backward from the full
set): they weigh the edge's removals for the Shapley sums, and the steps of each single order are read from the same edges.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored

WORD = r"[^\x20\x09-\x0D]+"
MOST_FILTERS = 7


def lattice(n: int) -> list[tuple[int, int, int]]:
    """Edges (state, filter, orders that pass): states are bit sets over ``n`` filters."""
    full = (1 << n) - 1
    reach, leave = [0] * (full + 1), [0] * (full + 1)
    reach[0] = leave[full] = 1
    for state in range(full + 1):
        for f in range(n):
            if not state >> f & 1:
                reach[state | 1 << f] += reach[state]
    for state in range(full, -1, -1):
        for f in range(n):
            if not state >> f & 1:
                leave[state] += leave[state | 1 << f]
    return [(s, f, reach[s] * leave[s | 1 << f]) for s in range(full + 1) for f in range(n) if not s >> f & 1]


def steps(letters: str) -> list[tuple[str, int, int, int]]:
    """(order, step from 1, state before, filter) of all orders."""
    out = []
    for order in permutations(range(len(letters))):
        state = 0
        for k, f in enumerate(order):
            out.append(("".join(letters[g] for g in order), k + 1, state, f))
            state |= 1 << f
    return out


def _structs(rows: list[tuple], names: list[str], kinds: list[str]) -> Column:
    """A constant array of structs."""
    text = ", ".join("named_struct(" + ", ".join(f"'{n}', cast({v!r} as {k})" for n, v, k in zip(names, row, kinds)) + ")" for row in rows)
    return F.expr(f"array({text})")


def audit(failures: DataFrame, letters: str, part: str = "part", flags: tuple[str, ...] = (), n: str = "n") -> DataFrame:
    """Counts of every step of every order of the filters, for each part.

    ``failures`` has ``part``, ``mask`` (bit k: fails the filter ``letters[k]``), a boolean column for each of ``flags``, and how many rows
    it stands for (``n``). Of each (part, filter_order, step): kept, removed, redundant (fails the step's filter, removed earlier),
    unique_fails (fails this filter only), <flag>_lost for each flag (removed here with that flag), and shapley (what the step's filter
    removes, summed over all orders). Null flags count as false; a null part is one part of its own; without rows the result is empty. The number of orders grows with
    the factorial of the filters, so there may be at most 7.
    """
    if not 0 < len(letters) <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters")
    count = len(letters)
    cells = failures.groupBy(part, "mask", *flags).agg(F.sum(n).alias("n"))
    edges = _structs(lattice(count), ["state", "filter", "orders"], ["int", "int", "long"])
    crossed = cells.withColumn("_e", F.explode(edges)).select("*", "_e.*")
    bit = F.expr("shiftleft(1, filter)")
    before, fails = F.col("mask").bitwiseAND(F.col("state")) == 0, F.col("mask").bitwiseAND(bit) != 0
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(F.lit(0).cast("long")))
    measured = crossed.groupBy(part, "state", "filter").agg(
        F.first("orders").alias("orders"),
        total(before & ~fails).alias("kept"), total(before & fails).alias("removed"), total(~before & fails).alias("redundant"),
        total(F.col("mask") == bit).alias("unique_fails"), *(total(before & fails & F.coalesce(f, F.lit(False))).alias(f"{f}_lost") for f in flags),
    )
    # Edges are few for each part, whatever the number of rows: both readings of them start from this table.
    measured = stored(measured, "lattice")
    worth = F.sum(F.col("orders") * F.col("removed")).over(Window.partitionBy(part, "filter"))
    both = measured.withColumn("shapley", worth)
    by_edge: dict[tuple[int, int], list] = {}
    for order, step, state, f in steps(letters):
        by_edge.setdefault((state, f), []).append((order, step))
    # All (order, step) that pass an edge, in a constant table keyed by the edge.
    table = measured.sparkSession.createDataFrame([(s, f, o, k) for (s, f), passing in by_edge.items() for o, k in passing], "state int, filter int, filter_order string, step int")
    out = both.join(table, ["state", "filter"])
    return out.select(part, "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *(f"{f}_lost" for f in flags), "shapley")


def text_failures(docs: DataFrame) -> DataFrame:
    """``_digest`` of each text and ``mask`` of the text's own filters A (1), B (2), C (4) and D (8), in place of ``text``.

    A: under 50 words; B: 100 * distinct words < 65 * words; C: 100 * A-Z > 5 * code points; D: holds one of ``#$%&*|``.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.withColumn("_w", F.regexp_extract_all(text, F.lit(WORD), 0))
    words, distinct = F.size("_w"), F.size(F.array_distinct("_w"))
    length = F.length(text)
    capitals = length - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    tests = [words < 50, 100 * distinct.cast("long") < 65 * words.cast("long"), 100 * capitals.cast("long") > 5 * length.cast("long"), text.rlike(r"[#$%&*|]")]
    mask = sum((F.when(t, 1 << k).otherwise(0) for k, t in enumerate(tests)), F.lit(0))
    return rows.withColumn("mask", mask).withColumn("_digest", F.sha2(text, 256)).drop("_w", "text")


def document_failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows for ``audit``: part, mask over filters A to E, good, toxic, n; E: the text is identical to that of a smaller doc_id.

    A null text counts as empty, a null source as the empty part. A row without a doc_id neither fails E nor makes others fail it, and has
    no label; rows of one doc_id and text are not smaller than each other. A document is good (toxic) where any row of
    ``labels`` (doc_id, quality, toxic) says so. Other columns are ignored, whatever their names. Texts leave their task as digests only, and
    repeated rows are counted before they are shuffled.
    """
    slim = text_failures(docs.select("doc_id", "text", F.coalesce("source", F.lit("")).alias("part")))
    rows = slim.groupBy("_digest", "doc_id", "part", "mask").agg(F.count("*").alias("n"))
    rows = stored(rows, "failures")
    named = rows.where("doc_id is not null")
    first = named.groupBy("_digest").agg(F.min("doc_id").alias("doc_id")).withColumn("_first", F.lit(True))
    said = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    # Both joins are on keys with doc_id in them, so that neither copies of a text nor rows without an id meet in one task.
    judged = named.join(first, ["_digest", "doc_id"], "left").join(said, "doc_id", "left")
    out = judged.select("part", (F.col("mask") + F.when(F.col("_first"), 0).otherwise(16)).alias("mask"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), "n")
    return out.unionByName(rows.where("doc_id is null").select("part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic"), "n"))
