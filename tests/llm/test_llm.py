"""The training-data operators against brute force, and on nulls, empty and long texts, ties and repeated rows."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

from kinfold.llm import ann, byte_bpe, minhash, packing, quality, sharding, substrings, token_counts, url_filter, warc, words  # noqa: E402
from kinfold.llm.queries import PACK_RANKS, PACK_SPECIAL, RULES  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def texts(n=120, seed=0):
    """Random texts with copies, shared passages, odd white space, other scripts, blanks and nulls."""
    draw = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["Été", "日本", "#x", "don't", "😀", "a\x1cb", "x\xa0y"]
    passage = " ".join(draw.choices(vocabulary, k=45))
    out = [None, "", "  \n\t ", "one", "Two words", "a b c d", "a B c D e", passage, passage, "x" * 3000, " " * 500 + "y"]
    while len(out) < n:
        body = [draw.choice(vocabulary) for _ in range(draw.randrange(1, 160))]
        if draw.random() < 0.3:
            body[len(body) // 2 :] = passage.split(" ")
        text = "".join(w + draw.choice([" ", " ", " ", "\n", "  ", "\t"]) for w in body)
        out += [text] if draw.random() < 0.8 else [text, text, text.replace("w1", "w2", 1)]
    out.append(" ".join(draw.choices(vocabulary, k=30_000)))
    return out[:n] + out[-1:]


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def docs():
    return list(enumerate(texts()))


def test_permutation_is_a_bijection():
    for n in (1, 2, 5, 1000, 4097):
        at = sharding.position_of(np.arange(n), n, 7)
        assert sorted(at) == list(range(n))
        assert (sharding.row_at(at, n, 7) == np.arange(n)).all()


def test_shards(spark, docs):
    df = frame(spark, docs + docs[:3] + [(None, "z"), (None, None)]).withColumn("shard", F.lit("clash"))
    rows = sharding.assign_shards(df, ["doc_id"], 7, 1).collect()
    assert len(rows) == len(docs) + 5
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for shard in sizes:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sizes[shard]))
    again = sharding.assign_shards(df.repartition(9), ["doc_id"], 7, 1).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "", r.row_number)
    assert sorted(rows, key=key) == sorted(again, key=key)
    assert sharding.assign_shards(df.limit(0), ["doc_id"], 7).count() == 0


def test_write_shards(spark, docs, tmp_path):
    out = f"file://{tmp_path}/shards"
    sharding.write_shards(sharding.assign_shards(frame(spark, docs), ["doc_id"], 3), out)
    back = spark.read.parquet(out)
    assert back.count() == len(docs) and back.select("shard").distinct().count() == 3


def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        order = np.argsort(ann.hilbert_keys(cells, bits))
        assert sorted(ann.hilbert_keys(cells, bits)) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[order], axis=0)).sum(1) == 1).all()


def test_nearest(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(400, 16))
    x[100:160] = x[100]
    rows = [(k, x[k].tolist()) for k in range(400)] + [(400, None), (450, [0.0] * 16), (401, [float("nan")] * 16), (402, [1.0, None] * 8), (None, x[1].tolist()), (500, [1.0, 2.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = total = 0
    for q in range(0, 400, 50):
        s = y @ y[q]
        s[q] = -9
        want = sorted(range(400), key=lambda k: (-round(s[k], 12), k))[:5]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        assert all(abs(r.score - s[r.vec_id]) < 1e-12 for r in mine)
        hit += len({r.vec_id for r in mine} & set(want))
        total += 5
    assert hit / total >= 0.9 and {r.query_id for r in got} == set(range(0, 400, 50))
    assert [r.vec_id for r in sorted((r for r in got if r.query_id == 150), key=lambda r: r["rank"])] == [100, 101, 102, 103, 104]
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).count() == 0
    assert len(ann.search(spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()) == 2


def test_recall_on_given_vectors(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = ann.search(v, F.col("vec_id") % 50 == 0).toPandas().groupby("query_id").vec_id.apply(set)
    p = v.orderBy("vec_id").toPandas()
    x = np.array(p.embedding.tolist(), float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    assert np.mean([len(got[q] & set(np.argsort(-s[q])[:5])) / 5 for q in range(0, len(x), 50)]) >= 0.9


@pytest.mark.parametrize("broadcast", [0, 100_000])
def test_archive(spark, monkeypatch, broadcast):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", broadcast)
    pages = [(k, f"http://A.example.com/p{k % 3}?q={k}", t) for k, t in enumerate(["<a>", "<b>", "<a>", "", None, "<a>", "é" * 5000])]
    pages += [(7, None, "<b>"), (8, "no scheme here", "z"), (None, "http://x/y", "<a>"), (2, "http://A.example.com/p2?q=2", "<a>"), (9, "http://h/" + "l" * 5000, "q")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    got = sorted(warc.archive(df).collect(), key=lambda r: (r.page_id is None, r.page_id or 0))
    assert len(got) == len(pages)
    payload = {k: (h or "").encode() for k, _, h in pages}
    for r in got:
        assert r.payload_bytes == len(payload[r.page_id]) and r.payload_digest == base64.b32encode(hashlib.sha1(payload[r.page_id]).digest()).decode()
        first = min((k for k in payload if k is not None and payload[k] == payload[r.page_id]), default=None)
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == first else ("revisit", first))
        assert r.payload == (payload[r.page_id] if r.record_type == "response" else None)
    assert warc.archive(df.limit(0)).count() == 0
    assert all(r.record_type == "response" for r in warc.archive(df, least_bytes=1).collect() if r.payload_bytes == 0)


def test_archive_of_long_text_ids(spark):
    rows = [("page-with-a-very-long-name-" + str(k), "http://same/url", f"<p>{k % 5}") for k in range(40)]
    got = {r.page_id: r for r in warc.archive(spark.createDataFrame(rows, "page_id string, url string, html string").repartition(3)).collect()}
    first = {html: min(i for i, _, h in rows if h == html) for _, _, html in rows}
    for i, _, html in rows:
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if first[html] == i else ("revisit", first[html]))
        assert got[i].payload_digest == base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()


def test_ids_that_cannot_be_decoded(spark):
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    decode = lambda values: byte_bpe.decode_ids(spark.createDataFrame([(v, b"x") for v in values], "ids binary, decoded binary"), path, pattern)
    assert [bytes(r.decoded) for r in decode([None, bytearray(b"")]).collect()] == [b"", b""]
    assert decode([bytearray(4)]).limit(0).count() == 0
    for wrong in (b"\xff\xff\xff\x7f", b"\x01\x00\x00"):
        with pytest.raises(Exception):
            decode([bytearray(wrong)]).collect()


def test_index_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    df = spark.range(200).selectExpr("id AS page_id", "concat('http://h', id % 5, '.org/', id % 7) AS url", "concat('x', id % 50) AS html")
    got = {r.page_id: r for r in warc.archive(df).collect()}
    assert len(got) == 200 and all(got[k].refers_to == k % 50 for k in range(50, 200))


def shingles(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = WORD.findall(low)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(docs):
    sets = {k: shingles(t) for k, t in docs}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                    root[max(find(a), find(b))] = min(find(a), find(b))
    return {k: (len(sets[k]), find(k)) for k in sets}


def test_near_duplicates(spark, docs):
    got = minhash.near_duplicates(frame(spark, docs).withColumn("node", F.lit("clash"))).collect()
    want = brute_components(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


def test_near_duplicates_without_ids(spark):
    same = "a b c d e f g h"
    got = minhash.near_duplicates(frame(spark, [(None, same), (None, same), (3, same), (3, same), (None, "q r s t u"), (5, None)])).collect()
    assert len(got) == 6 and Counter((r.doc_id, r.component_id, r.kept) for r in got) == {(None, 3, False): 2, (3, 3, True): 2, (None, None, True): 1, (5, 5, True): 1}


def test_chain_of_links_and_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    base = [f"t{k}" for k in range(200)]
    chain = []
    for step in range(30):
        base[step * 6 % 200] = f"n{step}"
        base[(step * 6 + 1) % 200] = f"m{step}"
        chain.append((step, " ".join(base)))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, chain)).collect()}
    assert got == {k: c for k, (_, c) in brute_components(chain).items()}


def test_min_max_estimates_similarity():
    draw = np.random.default_rng(1)
    pool = words.mix(draw.integers(0, 2**63, 1200).astype(np.uint64))
    a, b = pool[:1000], pool[200:]
    one = lambda x: minhash.signatures(x, np.array([0]), 300, 600, 1)[0]
    assert abs(np.mean(one(a) == one(b)) - 800 / 1200) < 0.06


ODD = ["", " ", "  ", "a  b   c", "\n\n x\r\n y;\r z", "日本語テキスト", "aaaa" * 400, "  " * 33 + "x", "a b", "<s> <|endoftext|> </s>", "été\tfoo  \n", "x ", " \x85\xa0\u2003x", "😀😀 a" * 50]


def odd_texts(seed, n=400):
    draw = random.Random(seed)
    return ODD + ["".join(draw.choice(" ab\nthe é日 \x1c\xa0;{}\r\t1's▁<|>") for _ in range(draw.randrange(60))) for _ in range(n)]


def test_byte_bpe_round_trip(spark):
    tiktoken = pytest.importorskip("tiktoken")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    exact = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    rows = list(enumerate([None, *odd_texts(1), *(t or "" for t in texts(40))]))
    df = frame(spark, rows).withColumn("ids_", F.lit(1))
    got = {r.doc_id: bytes(r.ids) for r in byte_bpe.encode_texts(df, path, P.PATTERN).collect()}
    assert all(got[k] == np.array(exact.encode_ordinary(t or ""), "<u4").tobytes() for k, t in rows)
    back = byte_bpe.decode_ids(byte_bpe.encode_texts(df, path, P.PATTERN), path, P.PATTERN).collect()
    assert {r.doc_id: bytes(r.decoded) for r in back} == {k: (t or "").encode() for k, t in rows}
    assert byte_bpe.encode_texts(df.limit(0), path, P.PATTERN).count() == 0


def test_long_texts_are_cut_at_spaces():
    from kinfold.llm.chunks import segments

    text = "ab cd\n ef " * 5000
    parts = list(segments(text, 1000))
    assert "".join(parts) == text and len(parts) > 20 and max(map(len, parts)) < 1020


def test_statistics(spark, docs):
    got = {r.doc_id: r for r in quality.with_statistics(frame(spark, docs).withColumn("n_words", F.lit("clash"))).collect()}
    for k, t in docs:
        w = WORD.findall(t or "")
        grams = Counter(zip(w, w[1:], w[2:]))
        covered = {j + s for j in range(len(w) - 2) if grams[tuple(w[j : j + 3])] > 1 for s in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        assert tuple(got[k][c] for c in quality.BASE) == want, k
        assert got[k].base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_outliers_are_rejected_and_others_kept(spark):
    draw = random.Random(5)
    clean = [(k, " ".join(f"w{draw.randrange(3000)}" for _ in range(draw.randrange(60, 400))), draw.choice(["en", None]), draw.choice(["a", "b", None])) for k in range(600)]
    junk = [(1000 + k, " ".join("#$%&*|<>" if j % 2 else "#" for j in range(100)), "en", "a") for k in range(20)]
    df = spark.createDataFrame(clean + junk + [(2000, None, None, None), (2001, "", "xx", "yy")], "doc_id long, text string, lang string, source string")
    stats = quality.stored(quality.with_statistics(df), "t")
    got = {r.doc_id: r for r in quality.judge(stats, quality.fit(stats, ["lang", "source"]), ["lang", "source"]).collect()}
    assert all(got[k].kept for k in range(600)) and not any(got[1000 + k].kept for k in range(20))
    assert not got[2000].kept and not got[2001].kept and len(got) == 622
    assert sorted(r.doc_id for r in quality.filter_quality(df, ["lang", "source"]).collect()) == list(range(600))
    empty = stats.limit(0)
    assert quality.judge(empty, quality.fit(empty, ["lang", "source"]), ["lang", "source"]).count() == 0


def test_token_counts(spark):
    spm = pytest.importorskip("sentencepiece")
    path = P.path("piece_bpe_32k.model")
    exact = spm.SentencePieceProcessor(model_file=path)
    rows = list(enumerate([None, *odd_texts(2), *texts(40)]))
    for part in (1 << 18, 7):
        got = {r.doc_id: r for r in token_counts.count_tokens(frame(spark, rows).withColumn("n_tokens", F.lit("clash")), path, part_characters=part).collect()}
        assert all((got[k].n_bytes, got[k].n_tokens) == (len((t or "").encode()), len(exact.encode(t or ""))) for k, t in rows)
    assert token_counts.count_tokens(frame(spark, []), path).count() == 0


def test_transducer_forgets_and_goes_on():
    spm = pytest.importorskip("sentencepiece")
    path = P.path("piece_bpe_32k.model")
    exact = spm.SentencePieceProcessor(model_file=path)
    with open(path, "rb") as f:
        small = token_counts.Transducer(token_counts.read_pieces(f.read()), most=50)
    for t in odd_texts(3, 100):
        assert small.count(t) == len(exact.encode(t))


def judge_url(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]) if m else ("", "")
    fits = [(len(h + p), len(h), a == "block", h + p, a) for h, p, a in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, 0, None, "allow"))
    return host, path, best[3], best[4]


def test_urls(spark):
    urls = [None, "", "x", "http://", "http://net", "http://net/", "http://a.net/x", "http://NET/x", "http://example.net/en/1", "http://example.net/en", "http://b.example.net/en/?q", "http://example.net?x/", "https://example.com/de/#a",
            "ftp://q.example.com/de/x", "http://myexample.com/de/", "http://a.org/fr/b/c", "http://org/fr", "http://x://y.net/", "http://a.net" + "/x" * 3000, "http://" + "a." * 2000 + "net/", "http://net/\nx", "http://a.example.net/en//x"]
    rows = [(k, u) for k, u in enumerate(urls)] + [(5, "http://net/"), (None, "http://net/x")]
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    got = url_filter.judge_urls(df, rules).collect()
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got), key=str) == sorted(((k, *judge_url(u)) for k, u in rows), key=str)
    more = spark.createDataFrame([("net", "/ab", "block"), ("a.net", "", "allow")], "host string, path string, action string")
    assert {r.page_id: r.verdict for r in url_filter.judge_urls(spark.createDataFrame([(1, "http://a.net/abc"), (2, "http://a.net"), (3, "http://net/abx/y"), (4, "http://net/a")], "page_id long, url string"), more).collect()} == {1: "block", 2: "allow", 3: "block", 4: "allow"}
    assert url_filter.judge_urls(df.limit(0), rules).count() == 0


def brute_repeats(docs, width=20):
    seen, out = set(), {}
    for k, t in sorted(docs):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for j in range(len(w) - width + 1):
            window = tuple(w[j : j + width])
            if window in seen:
                gone[j : j + width] = [True] * width
            seen.add(window)
        out[k] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def test_substrings(spark, docs, monkeypatch):
    want = brute_repeats(docs)
    for batch in (substrings.BATCH_BYTES, 2000):
        monkeypatch.setattr(substrings, "BATCH_BYTES", batch)
        got = substrings.remove_repeats(frame(spark, docs).repartition(5).withColumn("n_words", F.lit("clash"))).collect()
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == want and len(got) == len(docs)
    assert sum(x[1] for x in want.values()) > 100
    assert substrings.remove_repeats(frame(spark, [])).count() == 0


def test_substrings_with_repeated_and_missing_ids(spark):
    text = " ".join(f"v{k}" for k in range(30))
    got = substrings.remove_repeats(frame(spark, [(1, text), (1, text), (None, text), (2, text), (70_000_000_000, text + " " + text)])).collect()
    assert Counter((r.doc_id, r.n_removed) for r in got) == {(1, 0): 2, (None, 0): 1, (2, 30): 1, (70_000_000_000, 60): 1}


def test_packing(spark, docs):
    tokenizers = pytest.importorskip("tokenizers")
    tok = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = docs + [(None, "x"), (3, "one"), (900, "a <|endoftext|> b")] + [(1000 + k, t) for k, t in enumerate(odd_texts(4, 100))]
    pieces = packing.cut_pieces(frame(spark, rows), P.path(PACK_RANKS), P.PATTERN, PACK_SPECIAL).withColumn("ids_crc32", F.crc32("ids")).withColumn("offset", F.lit("clash"))
    got = packing.assign_sequences(pieces, 3, group_pieces=40).collect()
    want = Counter()
    for k, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        for s in range(0, len(ids), 1024):
            part = ids[s : s + 1024]
            want[k, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
    assert packing.assign_sequences(pieces.limit(0), 1).count() == 0


def test_first_fit_matches_plain_search():
    draw = random.Random(2)
    bins, room = packing.Bins(300, 100), []
    for size in sorted((draw.randrange(1, 100) for _ in range(300)), reverse=True):
        want = next((k for k, free in enumerate(room) if free >= size), len(room))
        if want == len(room):
            room.append(100)
        assert bins.first_fit(size) == (want, 100 - room[want])
        room[want] -= size


def test_padding_is_small(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pieces = packing.cut_pieces(docs, P.path(PACK_RANKS), P.PATTERN, PACK_SPECIAL).drop("ids")
    row = packing.assign_sequences(pieces, 1).agg(F.sum("length").alias("n"), F.count_distinct("sequence_id").alias("s")).first()
    assert row.n / (1024 * row.s) > 0.97


def test_pipeline(spark):
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = corpus_pipeline.quality_rules(spark, docs, "").cache()
    assert kept.columns == docs.columns and kept.join(docs, docs.columns, "left_anti").isEmpty()
    deduped = corpus_pipeline.near_dedup(spark, kept, "").cache()
    pairs = [(r.doc_id, r.text) for r in kept.collect()]
    want = {k for k, (_, c) in brute_sparse(pairs, corpus_pipeline.NEAR_PERCENT).items() if k == c}
    assert {r.doc_id for r in deduped.collect()} == want
    cut = {r.doc_id: r for r in corpus_pipeline.substring_dedup(spark, deduped, "").collect()}
    rows = [(r.doc_id, r.text) for r in deduped.collect()]
    for k, (n, gone, text) in brute_repeats(rows).items():
        assert (k in cut) == (gone < n or n == 0)
        if k in cut:
            assert cut[k].text == (text if gone else dict(rows)[k])
    packed = corpus_pipeline.run(spark, "/root/testdata/sf0.01").select("doc_id").distinct()
    assert {r.doc_id for r in packed.collect()} == set(cut)


def brute_sparse(docs, percent=85):
    """As brute_components, by way of shared shingles."""
    sets = {k: shingles(t) for k, t in docs}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    index = {}
    for k in sorted(sets):
        common = Counter(j for s in sets[k] for j in index.get(s, ()))
        for j, both in common.items():
            if 100 * both >= percent * (len(sets[k]) + len(sets[j]) - both):
                a, b = find(j), find(k)
                root[max(a, b)] = min(a, b)
        for s in sets[k]:
            index.setdefault(s, []).append(k)
    return {k: (len(sets[k]), find(k)) for k in sets}
