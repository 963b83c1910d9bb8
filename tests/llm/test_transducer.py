"""Token counts of text that is cut anywhere, against the library."""

import random

import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
spm = pytest.importorskip("sentencepiece")

from kinfold.llm import token_counts  # noqa: E402

PATH = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def exact():
    model = spm.SentencePieceProcessor(model_file=PATH)
    return lambda t: len(model.encode(t))


@pytest.fixture(scope="module")
def pieces():
    with open(PATH, "rb") as f:
        return token_counts.read_pieces(f.read())


def unspaced(seed, n):
    draw = random.Random(seed)
    kinds = ["thequickbrownfoxjumpsoverthelazydog", "aaaaaaaaaaaaaaaa", "ababababcabc", "日本語テキスト", "0123456789", "==--__##", "😀é\x1c", "internationalization"]
    out = []
    while sum(map(len, out)) < n:
        kind = draw.choice(kinds)
        at = draw.randrange(len(kind))
        out.append(kind[at : at + draw.randrange(1, 12)] * draw.choice([1, 1, 1, 7]))
    return "".join(out)[:n]


def test_runs_of_spaces(exact, pieces):
    counter = token_counts.Transducer(pieces)
    for k in [*range(1, 40), 63, 64, 65, 1000]:
        for tail in ("", "the", "日", "\x1c", "x" * k + "  y", "▁▁z"):
            assert counter.count(" " * k + tail) == exact(" " * k + tail), (k, tail)
            assert counter.count("a" + " " * k + tail) == exact("a" + " " * k + tail), (k, tail)


def test_states_stay_bounded_within_one_word(exact, pieces):
    counter = token_counts.Transducer(pieces, most=1000)
    text = unspaced(5, 50_000)
    assert counter.count(text) == exact(text)
    assert len(counter.states) <= 1100 and counter.transitions <= 2100


def test_maps_compose_wherever_a_text_is_cut(exact, pieces):
    counter = token_counts.Transducer(pieces)
    draw = random.Random(6)
    for seed in range(60):
        text = unspaced(seed, 300) if seed % 2 else "".join(draw.choice(["the ", " ", "  ", "cat", "日本", "\n", "x" * 20, "▁"]) for _ in range(60))
        size = draw.choice([1, 2, 3, 7, 50])
        maps = [counter.state_map(text[k : k + size], text[max(0, k - token_counts.CONTEXT) : k]) for k in range(0, len(text), size)]
        left = maps[0]
        for m in maps[1:]:
            left = counter.compose(left, m)
        right = maps[-1]
        for m in maps[-2::-1]:
            right = counter.compose(m, right)
        assert counter.total(left) == counter.total(right) == exact(text), (seed, size)


def test_long_text_without_spaces_in_parts(spark, exact):
    for part, n in ((100_000, 1_000_000), (1_000, 30_000)):
        rows = [(0, unspaced(1, n)), (1, "a" * (n // 4)), (2, " " * (n // 8) + "b"), (3, "the cat " * (n // 20)), (4, None), (5, "")]
        got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), PATH, part_characters=part).collect()}
        assert got == {k: exact(t or "") for k, t in rows}


def test_texts_whose_maps_do_not_meet_are_counted_again(spark, exact, monkeypatch):
    monkeypatch.setattr(token_counts.Transducer, "_before", lambda self, context: [0])
    rows = [(k, unspaced(k, 500)) for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_bytes", F.lit("clash"))
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df, PATH, part_characters=40).collect()}
    assert got == {k: exact(t) for k, t in rows}
