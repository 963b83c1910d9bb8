"""The minimum-covariance-determinant estimate against plain numpy, and what only a fitted shape can judge."""

import numpy as np

from kinfold.llm import quality

SCHEMA = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def vectors(rows):
    a = np.array([r[2:7] for r in rows], float)
    n = a[:, 0]
    rate = lambda e: np.sqrt((e + 0.375) / n)
    return np.stack([np.sqrt(np.log(n)), np.log(a[:, 1] / n), rate(a[:, 2]), rate(a[:, 3]), rate(a[:, 4] / quality.RUN_WORDS)], 1), 1 / n


def least_determinant(x, per, starts=60, seed=1):
    """The best of many random starts, each concentrated on exactly three quarters of the rows until it rests."""
    draw, h, best = np.random.default_rng(seed), int(np.ceil(0.75 * len(x))), None
    for _ in range(starts):
        near = draw.choice(len(x), 20, replace=False)
        for _ in range(50):
            mean = x[near].mean(0)
            cov = np.cov(x[near].T, bias=True) + np.diag(np.array(quality.NOISE) * per[near].mean() + quality.ROUNDING)
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            new = np.argsort(d)[:h]
            if set(new) == set(near):
                break
            near = new
        found = np.linalg.slogdet(cov)[1], mean, cov
        best = found if best is None or found[0] < best[0] else best
    return best


def made(draw, k, lang="en", n=(60, 900), chars=5.0, symbols=0.01, repeats=0.02):
    words = int(np.exp(draw.uniform(*np.log(n))))
    return (k, lang, words, int(words * chars * np.exp(draw.normal() * 0.05)), draw.poisson(symbols * words), draw.poisson(0.002 * words), min(words // 2, 6 * draw.poisson(repeats * words / 6)), False)


def test_estimate_has_the_least_determinant(spark, monkeypatch):
    draw = np.random.default_rng(4)
    monkeypatch.setattr(quality, "HALF_ROWS", 0)
    rows = [made(draw, k) for k in range(500)] + [made(draw, 500 + k, chars=9, symbols=1) for k in range(100)]
    got = quality.fit(spark.createDataFrame(rows, SCHEMA), []).first()["_fit"]
    logdet, mean, cov = least_determinant(*vectors(rows))
    inverse = np.array(got["precision"]).reshape(5, 5)
    # The consistency factor scales the covariance, and whole bins of distance take in a few rows more.
    factor = np.trace(np.linalg.inv(inverse) @ np.linalg.inv(cov)) / 5
    assert 1 <= factor < 3
    assert abs(-np.linalg.slogdet(inverse)[1] - 5 * np.log(factor) - logdet) < 0.35
    spread = np.sqrt(cov.diagonal())
    assert (np.abs(np.array(got["mean"]) - mean) < 0.2 * spread).all()


def test_a_start_that_rests_elsewhere_does_not_count(spark):
    """Two clusters of rows: the tight one with three quarters of them wins over whatever the middle of both suggests."""
    draw = np.random.default_rng(9)
    rows = [made(draw, k, symbols=0, repeats=0) for k in range(400)] + [made(draw, 400 + k, symbols=0.8, chars=8, repeats=0.2) for k in range(120)]
    stats = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r.kept for r in quality.judge(stats, quality.fit(stats, []), []).collect()}
    assert all(got[k] for k in range(400)) and not any(got[400 + k] for k in range(120))


def test_an_elliptical_outlier_is_rejected(spark):
    """Long texts have long words here; one that is long with short words is usual in each statistic alone."""
    draw = np.random.default_rng(5)
    rows = []
    for k in range(800):
        words = int(np.exp(draw.uniform(np.log(200), np.log(20_000))))
        rows.append((k, "en", words, int(words * np.exp(1.2 + 0.1 * np.log(words) + draw.normal() * 0.01)), 0, 0, 0, False))
    odd = (900, "en", 15_000, int(15_000 * np.exp(1.2 + 0.1 * np.log(300))), 0, 0, 0, False)
    stats = spark.createDataFrame([*rows, odd], SCHEMA)
    got = {r.doc_id: r for r in quality.judge(stats, quality.fit(stats, []), []).collect()}
    x, _ = vectors([*rows, odd])
    alone = np.abs(x[-1] - x.mean(0)) / x.std(0)
    assert alone.max() < 2.5  # a scale for each statistic by itself keeps it
    assert not got[900].kept and np.mean([got[k].kept for k in range(800)]) > 0.99


def test_groups_judge_the_same_vector_differently(spark):
    draw = np.random.default_rng(6)
    rows = [made(draw, k, "de", chars=6.5, symbols=0) for k in range(600)] + [made(draw, 1000 + k, "xx", chars=3.5, symbols=0.6) for k in range(600)]
    same = [(2000, "de", 400, 400 * 35 // 10, 240, 0, 0, False), (2001, "xx", 400, 400 * 35 // 10, 240, 0, 0, False)]
    stats = spark.createDataFrame([*rows, *same], SCHEMA)
    got = {r.doc_id: r for r in quality.judge(stats, quality.fit(stats, ["lang"]), ["lang"]).collect()}
    assert not got[2000].kept and got[2001].kept and got[2000].distance > 3 * got[2001].distance


def test_verdicts_do_not_jump_with_a_group_s_size(spark):
    """A group's estimate moves towards its own rows by small steps as it grows."""
    draw = np.random.default_rng(7)
    base = [made(draw, k, "en") for k in range(600)]
    other = [made(draw, 1000 + k, "fr", chars=5.6) for k in range(400)]
    far = []
    for n in (19, 20, 199, 200):
        stats = spark.createDataFrame([*base, *other[:n]], SCHEMA)
        far.append(quality.judge(stats, quality.fit(stats, ["lang"]), ["lang"]).where("doc_id = 1000").first().distance)
    assert abs(far[1] / far[0] - 1) < 0.3 and abs(far[3] / far[2] - 1) < 0.2


def test_short_texts_of_a_group_of_long_ones_stay(spark):
    draw = np.random.default_rng(8)
    rows = [made(draw, k, n=(4000, 9000), symbols=0.001) for k in range(600)] + [(1000 + k, "en", 150, 150 * 5, k % 2, k % 3 // 2, 0, False) for k in range(12)]
    stats = spark.createDataFrame(rows, SCHEMA)
    fit = quality.fit(stats, [])
    got = {r.doc_id: r for r in quality.judge(stats, fit, []).collect()}
    # Two hundred words hold one symbol or repeated line by chance; only their length is unusual.
    ratios = [got[1000 + k].distance - got[1000].distance for k in range(12)]
    assert max(ratios) < 20


def test_junk_of_tiny_groups_does_not_hide_in_them(spark):
    """Sources of 2 to 10 rows, one or two of which are junk: the junk goes, the others stay."""
    draw = np.random.default_rng(10)
    keys = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"
    rows, junk = [], set()
    for size in range(2, 11):
        for bad in (0, 1, 2):
            for k in range(size):
                doc = len(rows)
                odd = k < min(bad, size - 1)
                r = made(draw, doc, n=(150, 900), symbols=draw.choice([1.0, 2.5]) if odd else 0.004)
                rows.append((*r[:2], f"s{size}-{bad}", *r[2:]))
                junk |= {doc} if odd else set()
    rows += [(len(rows) + k, r[1], "large", *r[2:]) for k, r in enumerate(made(draw, 0, n=(150, 900), symbols=0.004) for _ in range(300))]
    stats = spark.createDataFrame(rows, keys)
    got = {r.doc_id: r.kept for r in quality.judge(stats, quality.fit(stats, ["lang", "source"]), ["lang", "source"]).collect()}
    assert not any(got[k] for k in junk)
    assert np.mean([kept for k, kept in got.items() if k not in junk]) > 0.99
