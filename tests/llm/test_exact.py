"""Words and windows whose hashes collide, or are made to, are still told apart."""

import numpy as np

from kinfold.llm import minhash, substrings, words


def alternating(n, swapped=False):
    """The Thue-Morse word, or its complement: no polynomial modulo 2**64 tells the two apart from 1,024 letters on."""
    return "".join("ab"[(bin(k).count("1") + swapped) % 2] for k in range(n))


def test_words_that_defeat_polynomials():
    for n in (1024, 2048, 4096):
        data = np.frombuffer(f"{alternating(n)} {alternating(n, True)}".encode(), np.uint8)
        hashes, _ = words.word_hashes(data, np.array([0, len(data)]))
        assert hashes[0] != hashes[1]


def test_words_at_all_places_and_lengths():
    spelled = ["x" * k + "y" * (n - k) for n in (1, 7, 8, 9, 16, 17, 63, 64, 65, 200) for k in range(n)]
    data = np.frombuffer(" ".join(spelled + ["z", *spelled]).encode(), np.uint8)
    hashes, _ = words.word_hashes(data, np.array([0, len(data)]))
    assert len(set(hashes[: len(spelled)].tolist())) == len(set(spelled))
    assert (hashes[: len(spelled)] == hashes[len(spelled) + 1 :]).all()


def test_window_hashes_do_not_depend_on_their_place():
    part = words.salted(1, 50)
    hashes = words.rolling_hashes(np.tile(part, 45_000), 20)  # more than one block of powers
    assert (hashes.reshape(-1)[: 50 * 44_999].reshape(-1, 50) == hashes[:50]).all() and len(np.unique(hashes[:50])) == 50


def test_colliding_words_are_no_repeat(spark):
    shared = [f"s{k}" for k in range(19)]
    rows = [(1, " ".join([*shared, alternating(1024)])), (2, " ".join([*shared, alternating(1024, True)])), (3, " ".join([*shared, alternating(1024)]))]
    got = {r.doc_id: r.n_removed for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 20}
    lone = [(1, alternating(1024)), (2, alternating(1024, True)), (3, alternating(1024))]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(lone, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_windows_that_share_a_hash_are_told_apart(spark, monkeypatch):
    """With one byte of each hash most windows are candidates; the digests leave the true repeats."""
    monkeypatch.setattr(substrings, "_HASH_BYTES", 1)
    monkeypatch.setattr(substrings, "BATCH_BYTES", 3000)
    draw = np.random.default_rng(2)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = []
    for k in range(80):
        own = " ".join(f"w{x}" for x in draw.integers(0, 500, 90))
        rows.append((k, own + (" " + passage if k % 4 == 0 else "")))
    got = {r.doc_id: r.n_removed for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    assert got == {k: 60 if k % 4 == 0 and k else 0 for k in range(80)}


def test_equal_windows_of_a_batch_are_compared_by_words(monkeypatch):
    import pyarrow as pa

    text = " ".join(f"v{k}" for k in range(40))
    w = substrings._Windows(pa.array([text, text.replace(" ", "\n"), text.replace("v30", "v31")]), 20)
    n = 21
    assert w.equal(np.arange(n, 2 * n), np.arange(n)).all()
    assert w.equal(np.arange(2 * n, 3 * n), np.arange(n)).tolist() == [k + 20 <= 30 for k in range(n)]


def test_places_pack_and_unpack():
    rows, docs, starts = np.array([0, 0, 0, 1, 2, 2]), np.array([5, 5, 5, 5, 9, 9]), np.array([3, 258, 100_000, 0, 255, 510])
    ids, counts, got = substrings._unpack_places(*substrings._pack_places(rows, docs, starts))
    assert ids.tolist() == [5, 5, 9] and counts.tolist() == [3, 1, 2] and got.tolist() == starts.tolist()
