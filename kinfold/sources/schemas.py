"""Schemas of the registry tables, and reconciling older files with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

_PARENTS = "array<struct<id:string,relationship:string,axis:string>>"
_ENTITY = "display_name string, tags array<string>, metadata map<string,string>, review_status string, created_at string, updated_at string"
TABLES = {
    "canonical_orgs": f"id string, parent_org_id string, hf_org string, kind string, {_ENTITY}",
    "canonical_models": f"id string, org_id string, params_billions double, parents {_PARENTS}, model_group_id string, model_family_id string, lineage_origin_model_id string, lineage_origin_model_org_id string, resolution_source string, resolution_granularity string, open_weights boolean, release_date string, input_modalities array<string>, output_modalities array<string>, {_ENTITY}",
    "canonical_benchmarks": f"id string, parent_benchmark_id string, preferred_metric_id string, dataset_repo string, {_ENTITY}",
    "canonical_families": f"id string, category string, benchmark_ids array<string>, primary_benchmark_key string, folder_aliases array<string>, composite_keys array<string>, {_ENTITY}",
    "canonical_composites": f"id string, source_configs array<struct<config:string,org:string,source:string>>, family_id string, {_ENTITY}",
    "canonical_metrics": f"id string, lower_is_better boolean, min_score double, max_score double, {_ENTITY}",
    "benchmark_metric_folds": "benchmark_id string, from_metric_id string, to_metric_id string, scale_factor double",
    "eval_harnesses": f"id string, version string, fork_url string, {_ENTITY}",
    "canonical_inference_platforms": f"id string, kind string, aliases array<string>, canonical_org string, variant_of string, {_ENTITY}",
    "aliases": "id string, raw_value string, entity_type string, canonical_id string, source_config string, source_field string, status string, strategy string, confidence double, inference_platform string, notes string, created_at string, updated_at string",
    "resolution_log": "id string, raw_value string, entity_type string, source_config string, canonical_id string, strategy string, confidence double, created_new boolean, sync_run_id string, created_at string",
    "eval_results": "id string, evaluation_id string, result_index bigint, source_config string, model_id string, benchmark_id string, parent_benchmark_id string, metric_id string, harness_id string, score double, created_at string, updated_at string",
    "sync_runs": "id string, source_config string, status string, started_at string, finished_at string, records_processed bigint, aliases_created bigint, aliases_updated bigint, entities_created bigint, errors string",
    "hub_stats_index": "id string, id_norm string, release_date string, pipeline_tag string, params_billions double, downloads bigint, open_weights boolean",
}
#: The tables that matching reads.
QUERY_TABLES = [t for t in TABLES if t not in ("resolution_log", "eval_results", "sync_runs", "hub_stats_index")]
#: Tables that another job writes, so that persisting leaves them alone.
OWNED_ELSEWHERE = ("hub_stats_index",)


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])


def _to(c: Column, have: T.DataType, want: T.DataType) -> Column:
    if isinstance(want, (T.ArrayType, T.MapType, T.StructType)) and isinstance(have, T.StringType):
        empty = F.array() if isinstance(want, T.ArrayType) else F.create_map() if isinstance(want, T.MapType) else F.lit(None)
        return F.coalesce(F.from_json(c, want), empty.cast(want))
    return c.cast(want)


def reconcile(df: DataFrame, table: str) -> DataFrame:
    """The table's columns in order: missing ones null, unknown ones dropped, JSON text parsed (bad text: empty).

    A ``parent_model_id`` of older files becomes a parent by size variant, where there are no parents.
    """
    want = schema(table)
    if table == "canonical_models" and "parent_model_id" in df.columns:
        old = F.when(F.col("parent_model_id").isNotNull(), F.array(F.struct(F.col("parent_model_id").alias("id"), F.lit("variant").alias("relationship"), F.lit("size").alias("axis"))))
        now = _to(F.col("parents"), df.schema["parents"].dataType, want["parents"].dataType) if "parents" in df.columns else F.lit(None).cast(want["parents"].dataType)
        df = df.withColumn("parents", F.coalesce(F.when(F.size(now) > 0, now), old, now))
    return df.select(*((_to(F.col(f.name), df.schema[f.name].dataType, f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in want))
