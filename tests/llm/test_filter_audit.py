"""The audit of filters against every order run for itself."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations
from math import factorial

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
from kinfold.llm import filter_audit  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS, LABELS = "doc_id long, text string, source string", "doc_id long, quality int, toxic int"


def fails(docs):
    out = []
    for doc_id, text, _ in docs:
        text = text or ""
        w = WORD.findall(text)
        copy = doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t, _ in docs)
        out.append({c for c, bad in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum("A" <= x <= "Z" for x in text) > 5 * len(text), re.search(r"[#$%&*|]", text), copy)) if bad})
    return out


def brute(docs, labels):
    failing, rows = fails(docs), []
    good, toxic = {d for d, q, _ in labels if q == 1} - {None}, {d for d, _, t in labels if t == 1} - {None}
    for part in {s or "" for _, _, s in docs}:
        mine = [(f, d) for f, (d, _, s) in zip(failing, docs) if (s or "") == part]
        total = Counter()
        steps = []
        for order in permutations("ABCDE"):
            left = list(mine)
            for k, c in enumerate(order, 1):
                gone = [x for x in left if c in x[0]]
                left = [x for x in left if c not in x[0]]
                total[c] += len(gone)
                fail = sum(c in f for f, _ in mine)
                steps.append((part, "".join(order), k, len(left), len(gone), fail - len(gone), sum(f == {c} for f, _ in mine), sum(d in good for _, d in gone), sum(d in toxic for _, d in gone), c))
        rows += [(*s[:-1], total[s[-1]]) for s in steps]
    return sorted(rows)


def run(spark, docs, labels):
    left = spark.createDataFrame(docs, DOCS).withColumn("part", F.lit(3)).withColumn("mask", F.lit("clash")).withColumn("good", F.lit(True))
    failures = filter_audit.document_failures(left, spark.createDataFrame(labels, LABELS).withColumn("text", F.lit("clash")))
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return sorted(tuple(r[c] for c in columns) for r in filter_audit.audit(failures, "ABCDE", flags=("good", "toxic")).collect())


def test_audit_equals_every_order(spark):
    draw = random.Random(4)
    text = lambda: " ".join(draw.choices([f"w{k}" for k in range(draw.choice([20, 400]))] + draw.choice([[], ["UP"] * 40, ["#"]]), k=draw.choice([3, 49, 50, 90])))
    pool = [text() for _ in range(60)] + [None, "", "  ", "é" * 300, "word " * 4000]
    docs = [(k, draw.choice(pool), draw.choice(["a", "b", None, "", "\x00"])) for k in range(300)]
    docs += [docs[5], (5, docs[5][1], "b"), (None, pool[0], "a"), (None, pool[0], "a"), (None, "n " * 60, "c")]
    labels = [(k, draw.choice([0, 1, None]), draw.choice([0, 1])) for k in range(0, 300, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    assert run(spark, docs, labels) == brute(docs, labels)
    assert run(spark, docs[:1], []) == brute(docs[:1], [])
    assert run(spark, [], labels) == []


def test_lattice_counts_orders():
    for n in range(1, 6):
        edges = filter_audit.lattice(n)
        assert len(edges) == n * 2 ** (n - 1)
        by_step = defaultdict(int)
        for state, f, orders in edges:
            by_step[bin(state).count("1")] += orders
        assert set(by_step.values()) == {factorial(n)}


def test_other_filters_and_null_parts(spark):
    rows = [(None, 1, 2), (None, 3, 1), ("x", 0, 5), ("x", 2, 1)]
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.shapley) for r in filter_audit.audit(spark.createDataFrame(rows, "part string, mask int, n long"), "PQ").collect()}
    assert got[None, "PQ", 1] == (0, 3, 5) and got[None, "QP", 1] == (2, 1, 1) and got[None, "QP", 2] == (0, 2, 5) and got["x", "PQ", 1] == (6, 0, 0) and len(got) == 8
    with pytest.raises(ValueError):
        filter_audit.audit(spark.createDataFrame(rows, "part string, mask int, n long"), "ABCDEFGH")
