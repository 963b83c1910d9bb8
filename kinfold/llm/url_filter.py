"""URL filters: host-suffix and path-prefix expressions of each URL, joined on short hash prefixes.

Everything is a DataFrame expression. Each URL expands into (host suffix, path directory) expressions; an
equi-join on the first hex digits of their digests finds candidate rules, the full digest and the rest of
the rule's path confirm them, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_DIGITS = 8


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty where there is no ``://``."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def _keyed(df: DataFrame, expression: Column) -> DataFrame:
    df = df.withColumn("_digest", F.sha2(expression, 256))
    return df.withColumn("_short", F.substring("_digest", 1, PREFIX_DIGITS))


def judge_urls(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to each row.

    ``rules`` has ``host``, ``path`` and ``action`` (block or allow). A rule fits its host and all
    subdomains where the URL's path starts with the rule's path. The longest fitting rule (host and path
    together) wins, among these the one with the longer host, then block before allow. Without a fitting
    rule ``rule`` is null and ``verdict`` is ``default``.

    A null URL, or one without ``://``, has an empty host and path and fits no rule. Repeated rows are
    judged each for itself; an input column named like an output column is replaced. Only as many host
    labels and path directories are expanded as the deepest rule has, so long URLs stay cheap.

    Rows are told apart by ``monotonically_increasing_id``, so the input should be a scan or a stored
    table, of which a repeated task reads the same rows.
    """
    rules = rules.select("host", F.coalesce("path", F.lit("")).alias("path"), "action").where("host is not null").distinct()
    depth = rules.agg(
        F.max(F.size(F.split("host", r"\."))).alias("labels"),
        F.max(F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))).alias("slashes"),
    ).first()
    labels, slashes = depth.labels or 1, depth.slashes or 0
    df = df.drop("host", "path", "rule", "verdict")
    rows = df.select(F.struct(*df.columns).alias("_row"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.monotonically_increasing_id().alias("_id"))
    parts = F.split("host", r"\.")
    tails = F.transform(
        F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))),
        lambda k: F.array_join(F.slice(parts, F.size(parts) - k + 1, k), "."),
    )
    steps = F.split("path", "/", slashes + 1)
    folders = F.concat(
        F.array(F.lit("")),
        F.when(
            F.size(steps) > 1,
            F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda k: F.concat(F.array_join(F.slice(steps, 1, k), "/"), F.lit("/"))),
        ).otherwise(F.array().cast("array<string>")),
    )
    expanded = rows.withColumn("_tail", F.explode(tails)).withColumn("_folder", F.explode(folders))
    expanded = _keyed(expanded, F.concat("_tail", F.lit("\n"), "_folder"))
    keyed = rules.select(
        F.col("host").alias("_rule_host"),
        F.col("path").alias("_rule_path"),
        F.col("action").alias("_action"),
        F.regexp_extract("path", r"(?s)^(.*/)?", 0).alias("_rule_folder"),
    )
    keyed = _keyed(keyed, F.concat("_rule_host", F.lit("\n"), "_rule_folder")).withColumnRenamed("_digest", "_full")
    fits = expanded.join(keyed, "_short", "left")
    confirmed = (F.col("_digest") == F.col("_full")) & F.startswith("path", "_rule_path") & (F.col("host") != "")
    best = F.max(
        F.when(
            confirmed,
            F.struct(
                (F.length("_rule_host") + F.length("_rule_path")).alias("long"),
                F.length("_rule_host").alias("host_long"),
                (F.col("_action") == "block").cast("int").alias("block"),
                F.concat("_rule_host", "_rule_path").alias("rule"),
                F.col("_action").alias("action"),
            ),
        )
    )
    judged = fits.groupBy("_id").agg(F.first("_row").alias("_row"), F.first("host").alias("host"), F.first("path").alias("path"), best.alias("_best"))
    return judged.select("_row.*", "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.action", F.lit(default)).alias("verdict"))
