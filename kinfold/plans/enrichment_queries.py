"""Queries of known models enriched from repositories, and of folds with all that moves with them, with their SQL. Every part gives one case of each rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import enrichment, reconcile
from ..storage import sized
from .minting_queries import _closed
from .queries import query, t
from .reconcile_queries import _c


def _rows(df: DataFrame, kinds: dict[str, str], rows: list[dict]) -> DataFrame:
    """One row for each of ``rows`` (values by column, texts with ``#`` for the part's number) and each part."""
    k = F.col("p_partkey").cast("string")

    def value(x, kind: str) -> Column:
        if isinstance(x, list):
            return F.array(*(value(y, "string") for y in x)).cast(kind)
        if isinstance(x, str):
            return _c(*(piece for at, text in enumerate(x.split("#")) for piece in (([k] if at else []) + [text])))
        return F.lit(x).cast(kind)

    one = lambda r: F.struct(*(value(r.get(c), kind).alias(c) for c, kind in kinds.items()))
    return sized(df.select(F.explode(F.array(*map(one, rows))).alias("_x")).select("_x.*"), "rows")


def _edges(c: str) -> Column:
    return F.array_join(F.transform(c, lambda e: F.concat_ws(":", e["id"], e["relationship"], e["axis"])), "|")


def _dash(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("-"))


_KNOWN = {
    "row": [
        ("lab/base-#m", "2024-02-02;8.0;-;y;;-;-;LabHF/Base-#m|LabHF/base-#m;false"), ("lab/kid-#m", "-;-;true;;lab/base-#m:quantized;lab;lab/kid-#m;;false"), ("lab/kid-#m-2024-05-06", "2024-05-06;-;-;;lab/kid-#m:variant:version;-;lab/kid-#m-2024-05-06;;false"),
        ("lab/steal-#m", "2024-03-03;-;-;;;-;-;;false"), ("lab/tuned-#m", "2024-04-04;-;-;;lab/kid-#m:finetune|lab/base-#m:finetune;lab;lab/tuned-#m;;false"), ("lab/old-#m", "2019-09-09;-;-;;;-;lab/old-#m;;true"),
    ],
}


@query(_closed(_KNOWN))
def known_enrichment(spark, d):
    """A model under two spellings of its repository, its quantized and its dated kin, a form that is another's, a base under its developer, two that share a form, one that was found before."""
    p = t(spark, d, "part")
    ids = {"id": "string", "aliases": "array<string>", "seq": "long"}
    entries = _rows(p, ids, [
        {"id": "lab/base-#m", "aliases": ["LabHF/Base-#m"]}, {"id": "lab/kid-#m"}, {"id": "lab/kid-#m-2024-05-06"}, {"id": "lab/steal-#m"}, {"id": "LabHF-steal-#m"}, {"id": "lab/tuned-#m"},
        {"id": "lab/old-#m"}, {"id": "lab/twin-#m", "aliases": ["other twin #m"]}, {"id": "lab/other-twin-#m", "aliases": ["lab/twin-#m-alias"]}, {"id": "far/solo-#m"},
    ]).withColumn("seq", F.lit(1).cast("long"))
    facts = {"id": "string", "release_date": "string", "params_billions": "double", "open_weights": "boolean", "tags": "array<string>", "relation": "string", "base_models": "array<string>"}
    repos = _rows(p, facts, [
        {"id": "LabHF/base-#m", "release_date": "2024-01-01", "params_billions": 7.0, "open_weights": True, "tags": ["x"]}, {"id": "LabHF/Base-#m", "release_date": "2024-02-02", "params_billions": 8.0, "tags": ["y"], "base_models": ["LabHF/Base-#m", "zzz/none"]},
        {"id": "lab/kid-#m", "open_weights": True, "relation": "quantized", "base_models": ["zzz/none-#m", "labhf/BASE-#m"]}, {"id": "lab/kid-#m-2024-05-06", "release_date": "2024-05-06"}, {"id": "LabHF/steal-#m", "release_date": "2024-03-03"},
        {"id": "lab/tuned-#m", "release_date": "2024-04-04", "base_models": ["LabHF/kid-#m", "lab/base-#m", "lab/kid-#m"]}, {"id": "lab/twin-#m", "release_date": "2024-06-06"}, {"id": "LAB/kid-#m", "release_date": "2025-01-01"},
    ])
    spellings, org_map = spark.sql("select 'lab' as org, 'LabHF' as spelling"), spark.sql("select 'labhf' as name, 'lab' as org")
    done = {c: facts[c] for c in ("id", *enrichment.FACTS)} | {"parents": reconcile.EDGES, "lineage_org": "string", "repo_id": "string", "aliases": "array<string>"}
    committed = _rows(p, done, [{"id": "lab/old-#m", "release_date": "2019-09-09", "repo_id": "lab/old-#m", "aliases": []}, {"id": "lab/kid-#m", "release_date": "2001-01-01", "aliases": ["dropped-#m"]}])
    out = enrichment.enrich_known(entries, spellings, repos, org_map, committed)
    joined = [F.coalesce(x, F.lit("")) for x in (F.array_join("tags", "|"), _edges("parents"), F.array_join("aliases", "|"))]
    said = F.concat_ws(";", _dash("release_date"), _dash("params_billions"), _dash("open_weights"), joined[0], joined[1], _dash("lineage_org"), _dash("repo_id"), joined[2], "removed")
    return out.select(F.lit("row").alias("kind"), F.col("id").alias("a"), said.alias("b"))


_FOLDED = {
    "entry": [
        ("lab/t-#", "T-#|m0-#|Extra-#|m1-#|M one #;a|c|b;2020-02-02;true;"), ("kid-#", ";;-;-;lab/t-#:variant"), ("m3-#", "three-#;;2022-02-02;-;"), ("m4-#", "four-#;;-;false;lab/t-#:finetune"),
    ],
}


@query(_closed(_FOLDED) + " UNION ALL SELECT 'report', 'exact', 2 * count(*) || ';' || count(*) FROM u")
def folds_with_facts(spark, d):
    """Two folds in a chain, one that isn't confirmed and one onto an id that has no row."""
    p = t(spark, d, "part")
    kinds = {"id": "string", "display_name": "string", "aliases": "array<string>", "providers": "array<string>", "release_date": "string", "open_weights": "boolean"}
    rows = _rows(p, kinds | {"up": "array<string>"}, [
        {"id": "lab/t-#", "display_name": "T #", "aliases": ["T-#"], "providers": ["a"], "release_date": "", "up": ["m1-#:finetune"]}, {"id": "m1-#", "display_name": "M one #", "aliases": ["t-#", "extra-#"], "providers": ["b", "A"], "release_date": "2024-01-01"},
        {"id": "m0-#", "aliases": ["Extra-#", "lab/t-#"], "providers": ["c"], "release_date": "2020-02-02", "open_weights": True, "up": ["kid-#:variant"]}, {"id": "kid-#", "display_name": "Kid", "up": ["m1-#:variant", "lab/t-#:finetune"]},
        {"id": "m3-#", "display_name": "Three", "aliases": ["three-#"], "release_date": "2022-02-02"}, {"id": "m4-#", "aliases": ["four-#"], "open_weights": False, "up": ["m0-#:finetune"]},
    ])
    edge = lambda x: F.struct(F.substring_index(x, ":", 1).alias("id"), F.substring_index(x, ":", -1).alias("relationship"), F.lit(None).cast("string").alias("axis"))
    entries = rows.withColumn("parents", F.transform("up", edge)).drop("up")
    pairs = [("m1-#", "lab/t-#"), ("m0-#", "m1-#"), ("m3-#", "lab/t-#"), ("m4-#", "gone-#")]
    folds = _rows(p, {"id": "string", "target": "string", "match_type": "string"}, [{"id": a, "target": b, "match_type": "exact"} for a, b in pairs])
    out, report = reconcile.apply_folds(entries, folds, folds.select("id").where("not startswith(id, 'm3')"))
    lists = [F.coalesce(x, F.lit("")) for x in (F.array_join("aliases", "|"), F.array_join("providers", "|"), _edges("parents"))]
    said = F.concat_ws(";", lists[0], lists[1], _dash("release_date"), _dash("open_weights"), lists[2])
    parts = [out.select(F.lit("entry").alias("kind"), F.col("id").alias("a"), said.alias("b")), report.select(F.lit("report").alias("kind"), F.col("match_type").alias("a"), F.concat_ws(";", "n", "missing").alias("b"))]
    return reduce(DataFrame.unionByName, parts)
