"""Quality rules: robust multivariate outliers among text statistics, per language and source.

Each text gives a vector of transformed statistics. For every language and source, every language and the
whole corpus, the minimum-covariance-determinant estimate is sought from several starts by concentration steps
(distances from the last estimate, then mean and covariance of the closer three quarters) until the determinant
stops falling; the start with the least determinant counts. A step is one aggregation over all rows into a
bounded number of distance bins for each group and start, so a group may hold any share of the rows.

The statistics are counts, many of them zero, so a plain covariance of them may be singular. They are therefore
taken as square roots of rates, whose counting noise is known: a quarter over the number of words, whatever the
rate. Each row stands for a distribution of that variance around its vector, and the covariance of the closer
rows is that of these distributions. A group's estimate is drawn towards its language's, and that towards the
corpus's, the more the fewer rows it has.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .common import bounded_batches, small_batches, stored, utf8
from .words import hash_spans, mix, separators, spans, window_hashes

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The bytes of the symbols # * $ % & | < >
SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
#: Words in a run of repeated words; a run, not each word, is counted as an event.
RUN_WORDS = 4
#: Counting noise of each coordinate: a variance of so much over the number of words.
NOISE = (0.0, 0.25, 0.25, 0.25, 0.25)
#: Variance of rounding, so that no matrix is singular.
ROUNDING = 1e-9
SHARE, STARTS, START_ROWS = 0.75, 3, 64
#: Concentration goes on while a determinant's logarithm falls by more than this.
FALL, MOST_STEPS = 1e-2, 30
#: An estimate in five dimensions from so few rows holds the group's own outliers, so these rows count for nothing; of a group with
#: ``HALF_ROWS`` more, its own estimate counts half and its parent's the other half.
FEW_ROWS, HALF_ROWS = 20, 20
#: Squared distances beyond this are outliers: the chi-squared quantile for 5 degrees of freedom at 1 - 1e-7.
CUTOFF = 40.9
MEDIAN_CHI2 = 4.3515
#: By how much the closest three quarters of a normal distribution in 5 dimensions have less variance than all of it.
CONSISTENCY = 1.412
_VALUES = tuple(f"_x{k}" for k in range(len(BASE)))
_PAIRS = tuple((j, k) for j in range(len(BASE)) for k in range(j, len(BASE)))


def _per_row(marks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(marks, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _owner(bounds: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def statistics(column: pa.Array) -> list[np.ndarray]:
    """The base statistics of a batch of texts, in the order of ``BASE``."""
    data, bounds = utf8(column)
    apart = separators(data)
    starts, ends = spans(apart, bounds)
    word_bounds = np.searchsorted(starts, bounds)
    words = hash_spans(data, starts, ends)
    # Lines: everything between line feeds; those with a word count.
    line_starts, line_ends = spans(data == 10, bounds)
    worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[worded], line_ends[worded]
    line_bounds = np.searchsorted(line_starts, bounds)
    with np.errstate(over="ignore"):
        owners = _owner(line_bounds).astype(np.uint64)
        keys = mix(hash_spans(data, line_starts, line_ends) + owners * np.uint64(0xA24BAED4963EE407))
        again = np.ones(len(keys), bool)
        again[np.unique(keys, return_index=True)[1]] = False
        owners = _owner(word_bounds)
        windows = window_hashes(words, 3, 5)
        own = owners[: len(windows)] == owners[2:] if len(windows) else np.zeros(0, bool)
        keys = mix(windows + owners[: len(windows)].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    at = np.flatnonzero(own)
    order = at[np.argsort(keys[at], kind="stable")]
    same = keys[order][1:] == keys[order][:-1]
    twice = np.append(same, False) | np.append(False, same) if len(order) else np.zeros(0, bool)
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[order[twice] + shift] = True
    return [
        np.diff(word_bounds),
        _per_row(~apart & ((data & 0xC0) != 0x80), bounds),
        _per_row(np.isin(data, SYMBOLS), bounds),
        _per_row(again, line_bounds),
        _per_row(covered, word_bounds),
    ]


def with_statistics(df: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """Add the base statistics (``BASE``) and ``base_failed`` to each row.

    A null text counts as empty, all statistics of which are 0. Whole texts are read. Input columns named
    like an output column are replaced; the text itself is kept only if asked for.
    """
    small_batches(df.sparkSession)
    df = df.drop(*BASE, "base_failed")
    names = [c for c in df.columns if keep_text or c != text]
    at = [df.columns.index(c) for c in names]
    schema = T.StructType([*(df.schema[c] for c in names), *(T.StructField(c, T.LongType()) for c in BASE)])
    source = df.columns.index(text)

    def run(batches):
        for batch in bounded_batches(batches):
            made = [pa.array(x.astype(np.int64)) for x in statistics(batch.column(source))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in at), *made], names=schema.names)

    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.mapInArrow(run, schema).withColumn("base_failed", failed)


def _words() -> Column:
    return F.greatest(F.col("n_words"), F.lit(1)).cast("double")


def _vector() -> list[Column]:
    """Length (the square root of its logarithm, as lengths are more skewed than log-normal), log word length, and square roots of the rates of
    symbols, repeated lines and runs of repeated words."""
    words = _words()
    rate = lambda events: F.sqrt((events + 0.375) / words)
    return [
        F.sqrt(F.log(words)),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
        rate(F.col("n_symbols")),
        rate(F.col("n_dup_lines")),
        rate(F.col("n_repeat_words") / RUN_WORDS),
    ]


def _levels(df: DataFrame, keys: list[str]) -> DataFrame:
    """Each row once for its full group and once for each shorter one; level 0 is the whole corpus."""
    return df.select(F.explode(_groups(df, keys)).alias("_g"), *_VALUES, "_per")


def _groups(df: DataFrame, keys: list[str]) -> Column:
    level = lambda n: F.struct(F.lit(n).alias("_level"), *((F.col(k) if i < n else F.lit(None).cast(df.schema[k].dataType)).alias(k) for i, k in enumerate(keys)))
    return F.array(*(level(n) for n in range(len(keys) + 1)))


def _squared(mean: str = "mean", precision: str = "precision", shrink: list[Column] | None = None) -> Column:
    """The squared Mahalanobis distance of the row's vector, its gaps first multiplied by ``shrink``."""
    gap = [(F.col(v) - F.col(mean)[k]) * (shrink[k] if shrink else 1.0) for k, v in enumerate(_VALUES)]
    n = len(BASE)
    return sum((F.col(precision)[j * n + k] * gap[j] * gap[k] * (1.0 if j == k else 2.0) for j, k in _PAIRS), F.lit(0.0))


def _sums() -> list[Column]:
    """The sums that give a group's mean and covariance, and its mean counting noise."""
    return [
        F.count("*").alias("_n"), F.sum("_per").alias("_per"), *(F.sum(v).alias(f"_f{k}") for k, v in enumerate(_VALUES)),
        *(F.sum(F.col(_VALUES[j]) * F.col(_VALUES[k])).alias(f"_p{j}{k}") for j, k in _PAIRS),
    ]


_SUM_NAMES = ("_n", "_per", *(f"_f{k}" for k in range(len(BASE))), *(f"_p{j}{k}" for j, k in _PAIRS))


def covariance(count: float, per: float, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance out of sums: that of the vectors, and the mean counting noise."""
    n = len(BASE)
    mean, cov = np.asarray(first) / count, np.zeros((n, n))
    for (j, k), v in zip(_PAIRS, second):
        cov[j, k] = cov[k, j] = v / count - mean[j] * mean[k]
    # Rounding of sums may leave a variance slightly below 0.
    cov[np.diag_indices(n)] = np.maximum(cov.diagonal(), 0)
    return mean, cov + np.diag(np.array(NOISE) * per / count + ROUNDING)


def _solve(sums: DataFrame) -> DataFrame:
    """Mean, covariance, precision and log determinant of each group and start out of its sums (one small row for each)."""
    n = len(BASE)

    @F.pandas_udf("struct<mean:array<double>,cov:array<double>,precision:array<double>,logdet:double>")
    def solved(count: pd.Series, per: pd.Series, first: pd.Series, second: pd.Series) -> pd.DataFrame:
        out = []
        for row in zip(count, per, first, second):
            mean, cov = covariance(*row)
            out.append((mean, cov.ravel(), np.linalg.inv(cov).ravel(), np.linalg.slogdet(cov)[1]))
        return pd.DataFrame(out, columns=["mean", "cov", "precision", "logdet"])

    out = sums.withColumn("_s", solved("_n", "_per", F.array(*(f"_f{k}" for k in range(n))), F.array(*(f"_p{j}{k}" for j, k in _PAIRS))))
    return out.select("_g", "_start", "_rows", "_s.*")


def _bin(squared: Column) -> Column:
    return F.floor(8 * F.log2(F.greatest(squared, F.lit(2.0**-20)))).cast("int")


def _concentrate(rows: DataFrame, squared: Column) -> DataFrame:
    """The estimate from the closest ``SHARE`` of each group (whole bins of the distance), for each start."""
    bins = rows.withColumn("_bin", _bin(squared)).groupBy("_g", "_start", "_bin").agg(*_sums())
    group = Window.partitionBy("_g", "_start")  # a bounded number of bins
    bins = bins.withColumn("_rows", F.sum("_n").over(group)).withColumn("_before", F.sum("_n").over(group.orderBy("_bin")) - F.col("_n"))
    near = bins.where(F.col("_before") < SHARE * F.col("_rows")).groupBy("_g", "_start", "_rows").agg(*(F.sum(c).alias(c) for c in _SUM_NAMES))
    return _solve(near)


def _starts(rows: DataFrame) -> DataFrame:
    """First estimates: the middle and the quartiles of each statistic, and about ``START_ROWS`` rows at random for each other start."""
    n = len(BASE)
    each = rows.select("_g", "_per", F.posexplode(F.array(*_VALUES)).alias("_k", "_x")).groupBy("_g", "_k", F.floor(F.col("_x") * 256).alias("_b")).agg(F.count("*").alias("count"), F.sum("_per").alias("_per"))
    group = Window.partitionBy("_g", "_k")
    each = each.withColumn("_before", F.sum("count").over(group.orderBy("_b")) - F.col("count")).withColumn("_all", F.sum("count").over(group)).withColumn("_noise", F.sum("_per").over(group) / F.sum("count").over(group))
    at = lambda share: F.min(F.when(F.col("_before") + F.col("count") >= share * F.col("_all"), F.col("_b"))) / 256
    noise = F.element_at(F.array(*map(F.lit, NOISE)), F.col("_k") + 1) * F.first("_noise")
    middle = each.groupBy("_g", "_k").agg(at(0.5).alias("m"), (F.pow((at(0.75) - at(0.25)) / 1.349, 2) + noise + ROUNDING).alias("v"), F.first("_all").alias("_all"))
    pick = lambda name: [F.max(F.when(F.col("_k") == k, F.col(name))) for k in range(n)]
    spread = pick("v")
    diagonal = [1 / spread[j] if j == k else F.lit(0.0) for j in range(n) for k in range(n)]
    middles = stored(middle.groupBy("_g").agg(F.array(*pick("m")).alias("mean"), F.array(*diagonal).alias("precision"), F.max("_all").alias("_all")), "middles")
    first = middles.select("_g", F.lit(0).alias("_start"), "mean", "precision")
    draw = F.explode(F.array(*(F.struct(F.lit(k).alias("_start"), F.pmod(F.xxhash64(*_VALUES, F.lit(k)), F.lit(1 << 30)).alias("_u")) for k in range(1, STARTS)))).alias("_d")
    chance = F.least(F.lit(1.0), START_ROWS / F.col("_all")) * float(1 << 30)
    few = rows.join(middles.select("_g", "_all"), "_g").select("_g", *_VALUES, "_per", "_all", draw).where(F.col("_d._u") < chance)
    few = few.groupBy("_g", F.col("_d._start").alias("_start"), F.col("_all").alias("_rows")).agg(*_sums())
    return stored(first.unionByName(_solve(few).select("_g", "_start", "mean", "precision")), "starts")


def fit(stats: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each group of ``keys``: the keys, ``_fit`` (mean, precision, spread, noise) and ``_rows``.

    ``stats`` has the base statistics; rows with ``base_failed`` take no part. All other rows do. Nulls in ``keys`` are
    groups of their own; an empty table gives an empty result.
    """
    fitted = stats.where(~F.col("base_failed")).select(*keys, *(x.alias(v) for v, x in zip(_VALUES, _vector())), (1 / _words()).alias("_per"))
    rows = stored(_levels(fitted, keys), "vectors")
    best = stored(_concentrate(rows.join(_starts(rows), "_g"), _squared()), "estimates")
    for _ in range(MOST_STEPS):
        now = _concentrate(rows.join(best.select("_g", "_start", "mean", "precision"), "_g"), _squared())
        old = best.select("_g", "_start", F.struct("logdet", "_rows", "mean", "cov", "precision").alias("_old"))
        both = now.select("_g", "_start", F.struct("logdet", "_rows", "mean", "cov", "precision").alias("_new")).join(old, ["_g", "_start"])
        fell = F.col("_new.logdet") < F.col("_old.logdet") - FALL
        both = stored(both.select("_g", "_start", F.when(fell, F.col("_new")).otherwise(F.col("_old")).alias("_e"), fell.alias("_fell")), "steps")
        best = both.select("_g", "_start", "_e.*")
        if both.where("_fell").isEmpty():
            break
    chosen = best.groupBy("_g").agg(F.min_by(F.struct("_rows", "mean", "cov", "precision"), F.struct("logdet", "_start")).alias("_e")).select("_g", "_e.*")
    chosen = stored(chosen, "chosen")
    # The consistency factor: that of a normal distribution, or more where half of the rows need more.
    binned = rows.join(chosen, "_g").groupBy("_g", _bin(_squared()).alias("_b")).agg(F.count("*").alias("count"))
    group = Window.partitionBy("_g")
    binned = binned.withColumn("_before", F.sum("count").over(group.orderBy("_b")) - F.col("count")).withColumn("_all", F.sum("count").over(group))
    median = binned.groupBy("_g").agg(F.min(F.when(F.col("_before") + F.col("count") >= 0.5 * F.col("_all"), F.col("_b"))).alias("_b"))
    noise = rows.groupBy("_g").agg(F.avg("_per").alias("_noise"))
    scaled = chosen.join(median.select("_g", F.greatest(F.pow(F.lit(2.0), (F.col("_b") + 1) / 8) / MEDIAN_CHI2, F.lit(CONSISTENCY)).alias("_scale")), "_g").join(noise, "_g")
    return stored(_blend(scaled, keys), "fitted")


def _blend(estimates: DataFrame, keys: list[str]) -> DataFrame:
    """Each full group's estimate, drawn at every level towards that of the shorter group before."""

    @F.pandas_udf("struct<mean:array<double>,cov:array<double>,noise:double>")
    def blended(rows: pd.Series, mean: pd.Series, cov: pd.Series, scale: pd.Series, noise: pd.Series, above: pd.DataFrame) -> pd.DataFrame:
        out = []
        for n, m, c, s, e, am, ac, ae in zip(rows, mean, cov, scale, noise, above["mean"], above["cov"], above["noise"]):
            m, c, am, ac = np.asarray(m), np.asarray(c) * s, np.asarray(am), np.asarray(ac)
            free = max(0, n - FEW_ROWS)
            w = free / (free + HALF_ROWS) if free else 0.0
            out.append((w * m + (1 - w) * am, w * c + (1 - w) * ac, w * e + (1 - w) * ae))
        return pd.DataFrame(out, columns=["mean", "cov", "noise"])

    @F.pandas_udf("array<double>")
    def inverse(cov: pd.Series) -> pd.Series:
        n = len(BASE)
        return pd.Series([np.linalg.inv(np.asarray(c).reshape(n, n)).ravel() for c in cov])

    top = estimates.where("_g._level = 0")
    found = top.select(F.struct("mean", F.transform("cov", lambda x: x * F.col("_scale")).alias("cov"), F.col("_noise").alias("noise")).alias("_up"), F.col("_rows").alias("_n"))
    for level in range(1, len(keys) + 1):
        own = estimates.where(F.col("_g._level") == level).select(*(F.col(f"_g.{k}").alias(k) for k in keys[:level]), "_rows", "mean", "cov", "_scale", "_noise")
        shorter = found.select(*(F.col(k).alias(f"_on_{k}") for k in keys[: level - 1]), "_up")
        joined = own.join(shorter, [F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in keys[: level - 1]]) if level > 1 else own.join(F.broadcast(shorter), F.lit(True))  # a single row
        found = joined.select(*keys[:level], blended("_rows", "mean", "cov", "_scale", "_noise", "_up").alias("_up"), F.col("_rows").alias("_n"))
    spread = F.transform(F.sequence(F.lit(0), F.lit(len(BASE) - 1)), lambda k: F.element_at("_up.cov", (k * (len(BASE) + 1) + 1).cast("int")))
    return found.select(*keys, F.struct(F.col("_up.mean").alias("mean"), inverse("_up.cov").alias("precision"), spread.alias("spread"), F.col("_up.noise").alias("noise")).alias("_fit"), F.col("_n").alias("_rows"))


def judge(stats: DataFrame, estimates: DataFrame, keys: list[str], cutoff: float = CUTOFF) -> DataFrame:
    """Add ``distance`` (squared, null if not measured) and ``kept`` to rows with base statistics.

    A row is measured against the estimate of its own group of ``keys``. Gaps of a text shorter than the
    group's usual ones shrink by its greater counting noise. Nulls in ``keys`` are groups of their own. ``kept``
    is false for ``base_failed`` and beyond the cutoff.
    """
    names = [c for c in stats.columns if c not in ("distance", "kept")]
    out = stats.select(*names, *(x.alias(v) for v, x in zip(_VALUES, _vector())))
    fitted = estimates.select(*(F.col(k).alias(f"_key_{k}") for k in keys), "_fit")
    on = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    out = out.join(fitted, on, "left") if on else out.join(F.broadcast(fitted), F.lit(True), "left")  # a single row
    more = F.greatest(1 / _words() - F.col("_fit.noise"), F.lit(0.0))
    shrink = [F.sqrt(F.col("_fit.spread")[k] / (F.col("_fit.spread")[k] + noise * more)) for k, noise in enumerate(NOISE)]
    out = out.withColumn("distance", F.when(~F.col("base_failed"), _squared("_fit.mean", "_fit.precision", shrink)))
    return out.select(*names, "distance", (~F.col("base_failed") & ~F.coalesce(F.col("distance") > cutoff, F.lit(False))).alias("kept"))


def filter_quality(df: DataFrame, keys: list[str], text: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``df`` that pass, unchanged.

    The estimates come from one pass over all rows that keeps numbers only; a second pass measures each
    row with its text beside it, so no text is shuffled or stored.
    """
    columns = df.columns
    estimates = fit(stored(with_statistics(df.select(*dict.fromkeys([*keys, text])), text), "statistics"), keys)
    return judge(with_statistics(df, text, keep_text=True), estimates, keys, cutoff).where("kept").select(*columns)
