"""Personal data against the plain patterns and a plain bootstrapping loop."""

import hashlib
import random
from collections import defaultdict

import pytest
import regex
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
from kinfold.llm import private_data, queries  # noqa: E402

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def luhn(digits):
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d *= 1 + k % 2
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def counts(kind, value):
    digits = regex.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def plain_base(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PLAIN.items()) for m in regex.finditer(p, text or "") if counts(kind, m[0])]
    return [(kind, a, b) for a, _, b, kind in sorted(found)]


def words(text):
    return regex.findall(r"[^\x20\x09-\x0D]+", regex.sub("[0-9]+", "0", text.translate(LOWER)))


def matches(text, kind, pattern):
    found = list(regex.finditer(pattern, text))
    for k, m in enumerate(found):
        before = text[found[k - 1].end() if k else 0 : m.start()][-80:]
        behind = text[m.end() : found[k + 1].start() if k + 1 < len(found) else len(text)][:80]
        left, right = words(before), words(behind)
        patterns = ([" ".join(left[-2:]) + " \n"] if left else []) + ([left[-1] + " \n " + right[0]] if left and right else [])
        yield kind, m.start(), m.end(), m[0], patterns


def could_be(value):
    n, address = len(regex.sub("[^0-9]", "", value)), "@" in value
    return [address, not address and bool(regex.match(r"^[0-9]{1,3}([.-][0-9]{1,3}){3}$", value)), not address and 12 <= n <= 19, not address and 7 <= n <= 15]


def plain_added(texts, rounds=4, confidence=750_000, support=5):
    seen = []
    for row, text in enumerate(texts):
        base = [m for kind, p in PLAIN.items() for m in matches(text or "", kind, p) if counts(kind, m[3])]
        open_ = [m for m in matches(text or "", "", private_data.CANDIDATE) if not any(b[1] < m[2] and m[1] < b[2] for b in base)]
        seen += [(row, *m) for m in base + open_]
    edges = {(kind, value.lower(), p) for _, kind, _, _, value, patterns in seen for p in patterns}
    by_pattern, by_value = defaultdict(list), defaultdict(list)
    for kind, value, p in edges:
        by_pattern[p].append((kind, value))
        if not kind:
            by_value[value].append(p)
    score = defaultdict(lambda: [0] * 4)
    for t in range(rounds):
        if t:
            for value, patterns in by_value.items():
                score[value] = [sum(c[p][k] for p in patterns) // len(patterns) if ok else 0 for k, ok in enumerate(could_be(value))]
        mass = {p: [sum((1_000_000 if kind == name else 0) if kind else score[value][k] for kind, value in found) for k, name in enumerate(private_data.KINDS)] for p, found in by_pattern.items()}
        c = {p: [s // (len(by_pattern[p]) + 1) for s in m] for p, m in mass.items()}
    out = defaultdict(list)
    for row, kind, start, end, value, patterns in seen:
        if not kind:
            good = [(c[p][k], -k) for p in patterns for k in range(4) if could_be(value)[k] and c[p][k] >= confidence and mass[p][k] >= support * 1_000_000]
            if good:
                out[row].append((private_data.KINDS[-max(good)[1]], start, end))
    return {row: sorted(s, key=lambda x: x[1]) for row, s in out.items()}


def noisy(n=400, seed=3):
    draw = random.Random(seed)
    word = lambda: draw.choice(["de", "la", "éa", "😀", "the", "of,", "in", "Übel", "x1", "...", "a\xa0b"])
    number = lambda k: "".join(draw.choice("0123456789") for _ in range(k))

    def card():
        body = number(15)
        return body + next(d for d in "0123456789" if luhn(body + d))

    make = [
        lambda: f"u{number(3)}.x@mail{number(1)}.example.com", lambda: f"{number(2)}.{number(3)}.0{number(2)}.{number(1)}", card, lambda: f"+{number(2)} ({number(3)}) {number(3)}-{number(4)}",
        lambda: number(draw.randrange(1, 22)), lambda: " ".join(number(4) for _ in range(4)), lambda: "-".join(number(2) for _ in range(9)), lambda: "a@b.c_d@e.f", lambda: "a@b", lambda: f"({number(3)}) {number(3)}-{number(4)}",
        lambda: "1.2.3.4.5.6.7.8", lambda: "+1", lambda: "+1 2 3 ((", lambda: "x@y..z@w.org.", lambda: "1 -2-3 4", lambda: f"{number(3)}-{number(4)}", lambda: "1234567@host.example",
    ]
    texts = [None, "", " ", "+", "@", "@@..@", "a" * 5000 + " " + "." * 3000, "1 " * 4000, "a.b@" * 300, "9" * 3000, "+" * 500, "7.7." * 900]
    while len(texts) < n:
        texts.append(" ".join(draw.choice(make)() if draw.random() < 0.2 else word() for _ in range(draw.randrange(1, 80))) + draw.choice(["", ".", "\n"]))
    for k in range(12):
        texts.append(f"zz {word()} please ring me on +4{number(1)} {number(8)} today. {word()}")
        texts.append(f"{word()} paid from Card no: {card()} yesterday")
        texts.append(f"{word()} write to u{number(4)}@firm.example soon")
    texts += [f"{word()} please ring me on ({number(3)}) {number(3)}-{number(4)} today or ring me on {number(8)} now" for _ in range(4)]
    texts += ["and Card no: 1111 2222 3333 4445 was lost; write to boss@intranet now", "please Ring ME on 555-0199-12"]
    return texts


def test_spans_equal_brute_force(spark):
    texts = noisy()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("kind", F.lit("clash")).withColumn("start", F.lit(1))
    got = {r.doc_id: r for r in private_data.find_private(df).collect()}
    assert set(got) == set(range(len(texts)))
    added = plain_added(texts)
    assert {k for spans in added.values() for k, _, _ in spans} >= {"phone", "card", "email"}
    for row, text in enumerate(texts):
        assert [tuple(s) for s in got[row].base] == plain_base(text), text
        assert [tuple(s) for s in got[row].added] == added.get(row, []), text


def test_unseen_identifiers_are_found_and_clean_numbers_left(spark):
    texts = noisy()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    added = {r.doc_id: [r2 for r2 in r.added] for r in private_data.find_private(df).collect()}
    n = len(texts)
    assert [len(added[k]) for k in range(n - 6, n - 2)] == [2] * 4 and [s.kind for s in added[n - 2]] == ["card", "email"] and [s.kind for s in added[n - 1]] == ["phone"]
    # Numbers among random words stay.
    assert sum(len(added[k]) for k in range(400)) == 0


def test_rows_without_id_repeats_and_empty(spark):
    rows = [(None, "a@b.cd"), (None, "a@b.cd"), (7, "x"), (7, "y +1 2345 67890"), (8, None)]
    got = private_data.find_private(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), len(r.base), len(r.added)) for r in got) == [("7", 0, 0), ("7", 1, 0), ("8", 0, 0), ("None", 1, 0), ("None", 1, 0)]
    assert private_data.find_private(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_redact(spark):
    text = "é a@b.cd, +1 2345 67890 end"
    found = private_data.find_private(spark.createDataFrame([(1, text), (2, None), (3, "x")], "doc_id long, text string"), carry=("doc_id", "text"))
    got = {r.doc_id: r.text for r in private_data.redact(found, spans="base").collect()}
    assert got == {1: "é <email>, <phone> end", 2: None, 3: "x"}


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    added = plain_added([t for _, t in docs])
    got = {r.doc_id: r for r in queries.op11_private_data(spark, sf).collect()}
    for row, (doc_id, text) in enumerate(docs):
        base = plain_base(text)
        show = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert got[doc_id].base_sha256 == hashlib.sha256(show(base).encode()).hexdigest()
        assert [got[doc_id][f"n_{k}"] for k in private_data.KINDS] == [sum(s[0] == k for s in base) for k in private_data.KINDS]
        assert got[doc_id].spans == show(sorted(base + added.get(row, []), key=lambda s: (s[1], private_data.KINDS.index(s[0]))))
