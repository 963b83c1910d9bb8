"""The pipeline's stages where their rules differ from the operators' own."""

import re
from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_kept(docs, percent):
    """The least id of each component of documents whose shingles are alike enough."""
    sets, index = {k: shingles(t) for k, t in docs}, {}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k in sorted(sets):
        for j, both in Counter(j for s in sets[k] for j in index.get(s, ())).items():
            if 100 * both >= percent * (len(sets[k]) + len(sets[j]) - both):
                a, b = find(j), find(k)
                root[max(a, b)] = min(a, b)
        for s in sets[k]:
            index.setdefault(s, []).append(k)
    return {k for k in sets if find(k) == k}


def test_near_dedup_links_from_80_percent(spark):
    rows = []
    for k, changed in enumerate((7, 8, 9, 10, 11, 12)):  # similarities (90 - changed) / (90 + changed): 0.86 to 0.76, 0.80 for 10
        words = [f"d{k}w{j}" for j in range(94)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:-changed] + [f"d{k}n{j}" for j in range(changed)]))]
    want = brute_kept(rows, 80)
    assert want == {0, 2, 4, 6, 8, 9, 10, 11}
    docs = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in rows], SCHEMA)
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == want


def test_near_dedup_on_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_kept(rows, 80)
    assert want != brute_kept(rows, 85)
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == want
