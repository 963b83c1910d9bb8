"""Flattening nested evaluation records into facts, and reports over mentions and facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import keys
from ..storage import sized


def score_of(result: str) -> Column:
    """The first of score_details.score, score, value and result that isn't null; 0 counts."""
    return F.coalesce(F.col(f"{result}.score_details.score"), F.col(f"{result}.score"), F.col(f"{result}.value"), F.col(f"{result}.result"))


def record_id(evaluation_id: Column, index: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", evaluation_id, index.cast("string")), 256), 1, 16)


def _filled(*names: str) -> Column:
    """The first of these that is neither null nor empty."""
    return F.coalesce(*(F.nullif(F.col(n), F.lit("")) for n in names))


def explode_results(records: DataFrame) -> DataFrame:
    """One row per named result: record, evaluation_id, source_config, result_index (its place among all results), name, dataset, model and
    harness names, benchmark and metric (names as they are looked up), and score.

    A record without a model is skipped. One without an id gets a hash of its config and model; ``record`` numbers the rows in
    their order, so records that share an id, or everything, are told apart. The benchmark is the name without its metric. The metric is taken from the metric's name,
    else its id, else the description. Both are worked out once for each distinct text.
    """
    model = _filled("model_info.id", "model_info.model_name", "model_info.name")
    own = F.concat("source_config", F.lit("/auto-"), F.substring(F.sha2(F.concat_ws(":", "source_config", "model_raw"), 256), 1, 12))
    # Numbered before results are exploded, or each result would get a number of its own.
    numbered = records.withColumn("model_raw", model).withColumn("record", F.monotonically_increasing_id())
    base = numbered.where("model_raw is not null").select(
        "record", F.coalesce(_filled("evaluation_id", "source_metadata.evaluation_id", "source_metadata.id"), own).alias("evaluation_id"), "source_config", "model_raw",
        _filled("eval_library.name", "eval_library.library_name").alias("harness_raw"), F.posexplode("evaluation_results").alias("result_index", "r"),
    )
    rows = sized(base.where("r.evaluation_name <> ''").select(
        "record", "evaluation_id", "source_config", "result_index", "model_raw", "harness_raw", F.col("r.evaluation_name").alias("name"), F.col("r.source_data.dataset_name").alias("dataset"),
        _filled("r.metric_config.metric_name", "r.metric_config.metric_id", "r.metric_config.evaluation_description").alias("_metric"), score_of("r").alias("score"),
    ), "results")
    # Stored, these dictionaries have a known size: small ones are broadcast, and the results aren't shuffled by a few frequent names.
    names = sized(rows.select("name").distinct(), "names").withColumn("benchmark_raw", keys.clean_name(F.col("name")))
    metrics = sized(rows.select("_metric").distinct().where("_metric is not null"), "metrics").withColumn("metric_raw", F.nullif(keys.metric_phrase(F.col("_metric")), F.lit("")))
    return rows.join(names, "name").join(metrics, "_metric", "left").drop("_metric")


def result_rows(records: DataFrame) -> DataFrame:
    """The records' results with their parents, stored: mentions and facts are both taken from them."""
    return sized(_with_parents(explode_results(records)), "rows")


def _with_parents(rows: DataFrame) -> DataFrame:
    """The rows with what ``detect_parents`` says of each, in one shuffle by record: both windows lie within one."""
    own, named = Window.partitionBy("record", "dataset"), Window.partitionBy("record", "name")
    counted = rows.repartition("record").withColumn("_p", F.when(F.col("dataset").isNotNull() & (F.count("*").over(own) > 1), F.col("dataset")))
    return counted.withColumn("parent", F.max_by("_p", "result_index").over(named)).drop("_p")


def detect_parents(results: DataFrame, record: str = "evaluation_id", name: str = "name", dataset: str = "dataset", position: str = "result_index") -> DataFrame:
    """(record, name, parent): the dataset is the parent where more than one result row of the record names it.

    Rows are counted, not names; of a repeated name the last row decides.
    """
    by = Window.partitionBy(record, dataset)
    counted = results.withColumn("_p", F.when(F.col(dataset).isNotNull() & (F.count("*").over(by) > 1), F.col(dataset)))
    return counted.groupBy(record, name).agg(F.max_by("_p", position).alias("parent"))


def mentions_of(results: DataFrame) -> DataFrame:
    """All mentions of result rows: raw_value, entity_type, source_config."""
    kinds = [("model_raw", "model"), ("harness_raw", "harness"), ("benchmark_raw", "benchmark"), ("parent", "benchmark"), ("metric_raw", "metric")]
    each = F.array(*(F.struct(F.col(c).alias("raw_value"), F.lit(k).alias("entity_type")) for c, k in kinds if c in results.columns))
    return results.select(F.explode(each).alias("m"), "source_config").select("m.*", "source_config").where("raw_value is not null")


def flatten_records(rows: DataFrame, resolved: DataFrame, numbered: bool = False) -> DataFrame:
    """Fact rows (with ``seq``, the place of their record, if ``numbered``) out of ``result_rows``: ids of model, harness, benchmark, parent and metric from ``resolved`` (mention key to canonical_id)."""
    look = sized(resolved.select(F.col("raw_value").alias("_raw"), F.col("entity_type").alias("_type"), F.col("source_config"), F.col("canonical_id").alias("_id")).distinct(), "look")
    # Each kind is stored for itself, as models are many where the others are few: what is small is broadcast, and the facts aren't shuffled by it.
    of = {kind: sized(look.where(F.col("_type") == kind).drop("_type"), kind) for kind in ("model", "harness", "benchmark", "metric")}
    for column, kind, name in (("model_raw", "model", "model_id"), ("harness_raw", "harness", "harness_id"), ("benchmark_raw", "benchmark", "benchmark_id"), ("parent", "benchmark", "parent_benchmark_id"), ("metric_raw", "metric", "metric_id")):
        hit = of[kind].select(F.col("_raw").alias(column), "source_config", F.col("_id").alias(name))
        rows = rows.join(hit, [column, "source_config"], "left")
    return rows.select(record_id(F.col("evaluation_id"), F.col("result_index")).alias("id"), "evaluation_id", "result_index", "source_config", "model_id", "harness_id", "benchmark_id", "parent_benchmark_id", "metric_id", "score", *([F.col("record").alias("seq")] if numbered else []))


def apply_metric_folds(facts: DataFrame, folds: DataFrame) -> DataFrame:
    """Facts with a folded metric get the target metric and the scaled score."""
    f = folds.select("benchmark_id", F.col("from_metric_id").alias("metric_id"), "to_metric_id", "scale_factor")
    out = facts.join(f, ["benchmark_id", "metric_id"], "left")
    return out.withColumn("score", F.col("score") * F.coalesce("scale_factor", F.lit(1.0))).withColumn("metric_id", F.coalesce("to_metric_id", "metric_id")).drop("to_metric_id", "scale_factor")


def mention_frequency(mentions: DataFrame) -> DataFrame:
    """(entity_type, raw_value, n, n_configs)."""
    return mentions.groupBy("entity_type", "raw_value").agg(F.count("*").alias("n"), F.count_distinct("source_config").alias("n_configs"))


def draft_proposals(frequency: DataFrame, least_configs: int = 2) -> DataFrame:
    return frequency.where(F.col("n_configs") >= least_configs)


def coverage(frequency: DataFrame, resolved: DataFrame) -> DataFrame:
    """Coverage by type and strategy with subtotals: distinct mentions, occurrences, and hits of each."""
    r = resolved.select("entity_type", "raw_value", "canonical_id", "strategy").distinct()
    both = frequency.join(r, ["entity_type", "raw_value"], "left").withColumn("strategy", F.coalesce("strategy", F.lit("no_match")))
    hit = F.col("canonical_id").isNotNull()
    return both.rollup("entity_type", "strategy").agg(F.count("*").alias("mentions"), F.sum("n").alias("occurrences"), F.count_if(hit).alias("hits"), F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("hit_occurrences"))


def stratified_coverage(frequency: DataFrame, resolved: DataFrame, thresholds: tuple[int, ...] = (1, 2, 3, 5, 7)) -> DataFrame:
    """Coverage of mentions seen in at least so many configs; a mention counts in each stratum it reaches."""
    r = resolved.select("entity_type", "raw_value", "canonical_id").distinct()
    level = F.explode(F.filter(F.array(*map(F.lit, thresholds)), lambda t: t <= F.col("n_configs"))).alias("threshold")
    both = frequency.join(r, ["entity_type", "raw_value"], "left").select(level, "n", "canonical_id")
    return both.groupBy("threshold").agg(F.count("*").alias("mentions"), F.sum("n").alias("occurrences"), F.count_if(F.col("canonical_id").isNotNull()).alias("hits"))


def registry_stats(tables: dict[str, DataFrame], column: str = "review_status") -> DataFrame:
    """(table, total, and counts of draft and reviewed)."""
    out = None
    for name, df in sorted(tables.items()):
        row = df.agg(F.lit(name).alias("table"), F.count("*").alias("total"), F.count_if(F.col(column) == "draft").alias("draft"), F.count_if(F.col(column) == "reviewed").alias("reviewed"))
        out = row if out is None else out.unionByName(row)
    return out


def resolution_quality(facts: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """(review_status, facts): how many facts point at entities of each status."""
    e = entities.select(F.col("id").alias(key), "review_status")
    return facts.join(e, key, "left").groupBy(F.coalesce("review_status", F.lit("missing")).alias("review_status")).agg(F.count("*").alias("facts"))


def top_unmatched(frequency: DataFrame, resolved: DataFrame, k: int) -> DataFrame:
    """The k most frequent mentions of each type without an id."""
    hit = resolved.where("canonical_id is not null").select("entity_type", "raw_value").distinct()
    left = frequency.join(hit, ["entity_type", "raw_value"], "left_anti")
    return left.withColumn("rank", F.row_number().over(Window.partitionBy("entity_type").orderBy(F.desc("n"), "raw_value"))).where(F.col("rank") <= k)


def even_spread(df: DataFrame, key: str, every: int) -> DataFrame:
    """Rows of every ``every``-th value of a key, in order; the values are few (names of configs)."""
    values = df.select(key).distinct()
    picked = values.withColumn("_n", F.row_number().over(Window.orderBy(key))).where((F.col("_n") - 1) % every == 0).select(key)
    return df.join(picked, key, "left_semi")


def cap_rows(df: DataFrame, key: str, most: int, order: list[str]) -> DataFrame:
    """At most so many rows of each key, the first in order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def hash_sample(df: DataFrame, columns: list[str], k: int, seed: int = 0) -> DataFrame:
    """k rows in the order of a seeded hash: a random sample that is the same on every run."""
    return df.orderBy(F.xxhash64(*columns, F.lit(seed)), *columns).limit(k)


def list_entities(df: DataFrame, search: str | None = None, review_status: str | None = None, **filters) -> DataFrame:
    """Entities whose id or display name fits the pattern ``search`` in any case, with equality filters."""
    out = df
    if search:
        pattern = f"(?i){search}"
        out = out.where(F.col("id").rlike(pattern) | F.coalesce(F.col("display_name").rlike(pattern), F.lit(False)))
    for column, value in {"review_status": review_status, **filters}.items():
        if value is not None:
            out = out.where(F.col(column) == value)
    return out


def with_developer(entities: DataFrame, orgs: DataFrame) -> DataFrame:
    """Add ``developer``: the display name of the entity's org, null where the org has no row."""
    return entities.join(orgs.select(F.col("id").alias("org_id"), F.col("display_name").alias("developer")), "org_id", "left")


def facts_of(df: DataFrame, model_id: str | None = None, benchmark_id: str | None = None, source_config: str | None = None) -> DataFrame:
    """Facts of a model, a benchmark or a config; the conditions reach the scan."""
    for column, value in (("model_id", model_id), ("benchmark_id", benchmark_id), ("source_config", source_config)):
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


def alias_pairs(aliases: DataFrame, entity_type: str, source_config: str | None = None) -> DataFrame:
    """(raw_value, canonical_id) of one type: not rejected, global or of one scope."""
    live = aliases.where((F.col("entity_type") == entity_type) & (F.coalesce("status", F.lit("")) != "rejected"))
    return live.where(F.col("source_config").isNull() | (F.col("source_config") == F.lit(source_config))).select("raw_value", "canonical_id")
