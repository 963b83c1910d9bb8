"""Ranked search of many items against a plain count, and the shared sums against plain ones."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
from kinfold.llm import lexical  # noqa: E402

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    counted = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, asked in wanted.items():
        scored = []
        for d, c in counted:
            n = sum(c.values())
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * (50 + 50 * n * n_docs // n_terms))) for t in asked if c[t])
            if score > 0:
                scored.append((-score, d is None, d))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, rank, d, -s) for rank, (s, _, d) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def texts(n, seed):
    draw = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["Été", "日本", "ÀB", "a_b", "x\x00y", "it's", "😀"]
    return [" ".join(draw.choices(vocabulary, k=draw.randrange(1, 60))) + draw.choice(["", ".", "\n"]) for _ in range(n)]


def run(docs, items, k=50):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.search(docs, items, k).collect()), key=str)


def cases():
    body = texts(300, 1)
    docs = list(enumerate(body)) + [(400 + j, body[3]) for j in range(70)] + [(900, None), (901, ""), (902, " .-, "), (None, body[5]), (None, "zz"), (7, body[7]), (903, "zz " * 20_000), (904, "q" * 9000)]
    items = [(j, t) for j, t in enumerate(texts(25, 2))] + [(50, None), (51, "..."), (52, "nowhere"), (3, "ZZ zz"), (53, body[3]), (53, body[3]), (None, "w1 w2"), (54, "Q" * 9000)]
    return docs, items


@pytest.mark.parametrize("pairs, bytes_", [(lexical.BLOCK_PAIRS, lexical.SUM_BYTES), (60, 1 << 14)])
def test_search_equals_brute_force(spark, monkeypatch, pairs, bytes_):
    monkeypatch.setattr(lexical, "BLOCK_PAIRS", pairs)
    monkeypatch.setattr(lexical, "SUM_BYTES", bytes_)
    docs, items = cases()
    left = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("n", F.lit(1)).repartition(5)
    right = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("clash"))
    assert run(left, right) == brute(docs, items, 50)
    assert run(left, right, 3) == brute(docs, items, 3)


def test_ties_and_empty_tables(spark):
    docs = spark.createDataFrame([(j, "same words here") for j in range(200, 0, -1)] + [(500, "other")], "doc_id long, text string").repartition(7)
    items = spark.createDataFrame([(1, "same")], "item_id long, text string")
    assert [d for _, _, d, _ in sorted(run(docs, items), key=lambda r: r[1])] == list(range(1, 51))
    assert run(docs.where("false"), items) == [] and run(docs, items.where("false")) == [] and lexical.search(docs, items.where("false")).columns == ["item_id", "rank", "doc_id", "score"]


def test_shared_sums():
    draw = random.Random(5)
    common = [draw.sample(range(100), 12) for _ in range(6)]
    items = [sorted(set(draw.choice(common)) | set(draw.choice(common)) | set(draw.sample(range(200), 8))) for _ in range(60)] + [[], [5]]
    plan = lexical.Plan(items, 200)
    asked = np.array([t for t in range(200) if plan.sets[t] >= 0])
    part = np.arange(1, len(asked) + 1) * 7
    sums = plan.accumulate(asked, np.zeros(len(asked), np.int64), part, 1)
    value = dict(zip(asked, part))
    for item, found in enumerate(items):
        assert (sums[plan.last[item], 0] if found else 0) == sum(value[t] for t in found)
    # Sharing saves additions against summing each item for itself.
    assert len(plan.pairs) < 0.8 * sum(len({plan.sets[t] for t in found}) - 1 for found in items if found)


def test_vocabulary_confirms_bytes():
    words = [b"ab", b"abcdefghij" * 12, "é".encode()]
    v = lexical.Vocabulary(words)
    data = np.frombuffer(b"ab abcdefghij" + words[1] + words[2] + b"zz", np.uint8)
    bounds = [(0, 2), (3, 13), (13, 133), (133, 135), (135, 137)]
    assert list(v.find(data, *np.array(bounds).T)) == [0, -1, 1, 2, -1]
    v.data = np.frombuffer(b"aX" + v.data.tobytes()[2:], np.uint8)
    assert list(v.find(data, *np.array(bounds).T)) == [-1, -1, 1, 2, -1]
