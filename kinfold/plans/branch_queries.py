"""Queries that reach every branch of matching by parts, folding and checking, with their SQL. Every part gives one case of each; offenders are compared, not counted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators import checks, match
from .enrichment_queries import _dash, _rows
from .minting_queries import _closed
from .queries import query, t

_ALIAS = {"raw_value": "string", "canonical_id": "string"}


def _said(df: DataFrame, kind: str, a, b) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))


def _aliases(df: DataFrame, kind: str, rows: list[tuple[str, str]]) -> DataFrame:
    known = _rows(df, _ALIAS, [{"raw_value": raw, "canonical_id": to} for raw, to in rows]).distinct()
    return known.select("raw_value", F.lit(kind).alias("entity_type"), F.lit(None).cast("string").alias("source_config"), "canonical_id", F.lit("auto").alias("status"), F.lit(1).alias("seq"))


_TIERS = {"fold": [("lab/Real-#m", "lab/Real-#m;1"), ("a#m", "lab/Real-#m;2"), ("c#m", "lab/Real-#m;3"), ("d#m", "lab/Real-#m;4"), ("f#m", "lab/abc-#m;2")]}


@query(_closed(_TIERS))
def fold_tiers(spark, d):
    """Each tier decides one mint; another org, no org for a name and two owners of one alias decide the others."""
    p = t(spark, d, "part")
    targets = _rows(p, {"id": "string", "org": "string", "aliases": "array<string>"}, [{"id": "lab/Real-#m", "org": "lab", "aliases": ["Nick #m"]}, {"id": "lab/zed-#m", "org": "lab", "aliases": ["both #m"]}, {"id": "lab/abc-#m", "org": "lab", "aliases": ["both #m"]}])
    mints = _rows(p, {"id": "string", "org": "string", "forms": "array<string>"}, [
        {"id": "lab/Real-#m", "org": "other", "forms": []}, {"id": "a#m", "forms": ["NICK #m"]}, {"id": "b#m", "org": "far", "forms": ["NICK #m", "lab/real-#m"]}, {"id": "c#m", "org": "LAB", "forms": ["other/real.#m"]},
        {"id": "d#m", "org": "lab", "forms": ["lab-real-#m"]}, {"id": "e#m", "forms": ["real #m"]}, {"id": "f#m", "org": "lab", "forms": ["BOTH #m"]},
    ])
    out = match.decide_folds(mints, targets.withColumn("seq", F.lit(1)), spark.sql("select 'lab' as name, 'lab' as org"))
    return _said(out, "fold", F.col("id"), F.concat_ws(";", "target", "tier"))


_MERGED = {"entry": [("lab-model-#m", "-;lab/Lab_Model-#m"), ("lab-alone-#m", "lab;-"), ("lab-two-#m", "lab;-"), ("zzz-x-#m", "-;-"), ("lab-has-#m", "own;-"), ("lab/lab-model-#m", "lab;-"), ("lab/Lab_Model-#m", "-;-"), ("far/lab-two-#m", "far;-")]}


@query(_closed(_MERGED))
def org_merges(spark, d):
    """Bare ids: one that two ids of its org hold under their names, one alone, one that only another org has, one without a known org."""
    rows = [{"id": "lab-model-#m"}, {"id": "lab-alone-#m"}, {"id": "lab-two-#m"}, {"id": "zzz-x-#m"}, {"id": "lab-has-#m", "org_id": "own"}, {"id": "lab/lab-model-#m", "org_id": "lab"}, {"id": "lab/Lab_Model-#m"}, {"id": "far/lab-two-#m", "org_id": "far"}]
    out, merges = match.attribute_orgs(_rows(t(spark, d, "part"), {"id": "string", "org_id": "string"}, rows), spark.sql("select 'lab' as name, 'lab' as org"))
    return _said(out.join(merges, "id", "left"), "entry", F.col("id"), F.concat_ws(";", _dash("org_id"), _dash("into")))


_PATHS = {
    "name": [
        ("src.suite-#m", "b-suite-#m"), ("suite-#m.leaf-#m", "b-leaf-#m"), ("suite-#m.zzz.leaf-#m", "b-leaf-#m"), ("suite-#m.two.words.#m", "b-two-#m"), ("suite-#m.zzz", "b-suite-#m"), ("src.12.SUITE_#m.overall", "b-suite-#m"), ("src.q#.rest-#m", "-"),
        ("zzz-#m.src", "-"), ("plain-#m", "-"), ("suite-#m.suite-#m.src", "b-suite-#m"),
    ],
    "metric": [("acc-#m.score", "-"), ("x.acc-#m.score", "m-acc-#m"), ("x/ACC_#m", "m-acc-#m"), ("x.acc-#m.f1-#m", "-"), ("x.acc-#m.ACC #m", "m-acc-#m"), ("acc-#m", "-"), ("x..zzz-#m", "-")],
}


@query(_closed(_PATHS))
def structured_paths(spark, d):
    """Dotted names that end at a namespace, a benchmark, a joined tail or nothing; ids with one metric, two, a catch-all or none."""
    p = t(spark, d, "part")
    known = _aliases(p, "benchmark", [("suite-#m", "b-suite-#m"), ("leaf-#m", "b-leaf-#m"), ("two words #m", "b-two-#m")])
    named = _rows(p, {"name": "string"}, [{"name": a} for a, _ in _PATHS["name"]])
    names = match.resolve_structured_name(named, "name", known, spark.sql("select 'src' as name"))
    metrics = _aliases(p, "metric", [("acc-#m", "m-acc-#m"), ("f1-#m", "m-f1-#m"), ("score", "score")])
    ids = match.resolve_structured_metric(_rows(p, {"raw_id": "string"}, [{"raw_id": a} for a, _ in _PATHS["metric"]]), "raw_id", metrics, spark.sql("select 'score' as id"))
    return _said(names, "name", F.col("name"), _dash("benchmark_id")).unionByName(_said(ids, "metric", F.col("raw_id"), _dash("metric_id")))


_OFFENDERS = {
    "alias layer": [("only-#m", "")], "same name": [("same#m", "g-#m")], "inferred": [("i1-#m", ""), ("i3-#m", "")], "split orgs": [("org#m", "Org-#m|org#m")], "twins": [("tw#m", "tw-#m|tw_#m"), ("/", "sl/#m")], "attested": [("lab/A#m", "lab/b#m")],
    "raw names": [("r1-#m", "raw-name-#m")], "bare alias": [("only #m", "else-#m>own/only-#m")], "shared identity": [("lab|#m alpha beta", "lab/Beta-alpha-#m|lab/alpha-beta-#m")], "double claims": [("twice-#m", "2")], "two families": [("bench-#m", "2")],
    "metric folds": [("b-#m:m1-#m", "none-#m:unknown id"), ("b-#m:m2-#m", "m2-#m:self"), ("b-#m:m3-#m", "m4-#m:repeated"), ("b-#m:m3-#m", "m5-#m:repeated"), ("b-#m:m6-#m", "m7-#m:chain"), ("b-#m:m7-#m", "m8-#m:factor")],
}


@query(_closed(_OFFENDERS))
def check_offenders(spark, d):
    p = t(spark, d, "part")
    text = lambda names, rows: _rows(p, {n: "string" for n in names.split()}, [dict(zip(names.split(), r)) for r in rows])
    c = F.col
    ids = F.array_join("ids", "|")
    tags = {"id": "string", "resolution_source": "string", "review_status": "string", "org_id": "string", "tags": "array<string>"}
    inferred = _rows(p, tags, [
        {"id": "i1-#m", "resolution_source": "inferred", "review_status": "reviewed", "org_id": "o", "tags": []}, {"id": "i2-#m", "resolution_source": "inferred", "review_status": "draft", "org_id": "o", "tags": []},
        {"id": "i3-#m", "resolution_source": "curated", "review_status": "reviewed", "tags": ["other"]}, {"id": "i4-#m", "resolution_source": "curated", "review_status": "reviewed", "tags": ["org-unknown"]},
    ])
    folds = _rows(p, {"benchmark_id": "string", "from_metric_id": "string", "to_metric_id": "string", "scale_factor": "double"}, [
        {"benchmark_id": "b-#m", "from_metric_id": f"m{a}-#m", "to_metric_id": f"{b}-#m", "scale_factor": x} for a, b, x in ((1, "none", 1.0), (2, "m2", 1.0), (3, "m4", 1.0), (3, "m5", 1.0), (6, "m7", 1.0), (7, "m8", 0.0), (9, "m8", 0.5))
    ])
    claims = _rows(p, {"leaf": "string", "owner": "string", "claims": "long"}, [{"leaf": "only #m", "owner": "own/only-#m", "claims": 1}, {"leaf": "many #m", "owner": "own/many-#m", "claims": 2}])
    families = _rows(p, {"id": "string", "benchmark_ids": "array<string>"}, [{"id": "f1-#m", "benchmark_ids": ["bench-#m", "other-#m"]}, {"id": "f2-#m", "benchmark_ids": ["bench-#m"]}])
    none = F.lit("")
    found = [
        _said(checks.created_by_alias_layers(text("id", [("only-#m",), ("both-#m",)]), text("id", [("both-#m",)])), "alias layer", c("id"), none),
        _said(checks.same_name_merged(text("id model_group_id org_id", [("x/Same-#m", "g-#m", "x"), ("y/same_#m", "g-#m", "y"), ("z/same-#m", "h-#m", "z")])), "same name", c("name"), c("model_group_id")),
        _said(checks.inferred_not_draft(inferred), "inferred", c("id"), none),
        _said(checks.split_orgs(text("id", [("Org-#m",), ("org#m",), ("Ok-#m",), ("ok#m",), ("one#m",)]), text("key", [("ok#m",)])), "split orgs", c("key"), ids),
        _said(checks.separator_twins(text("id", [("tw-#m",), ("tw_#m",), ("lone-#m",), ("sl/#m",)])), "twins", c("key"), ids),
        _said(checks.attested_mismatch(text("strategy raw_value canonical_id", [("attested", "lab/A#m", "lab/b#m"), ("attested", "lab/A#m", "LAB/a#m"), ("exact", "lab/A#m", "lab/c#m")])), "attested", c("raw_value"), c("canonical_id")),
        _said(checks.raw_display_names(text("id display_name", [("r1-#m", "raw-name-#m"), ("r2-#m", "Raw-name-#m"), ("r3-#m", "raw #m")])), "raw names", c("id"), c("display_name")),
        _said(checks.bare_alias_elsewhere(text("raw_value canonical_id", [("only #m", "else-#m"), ("Only-#m", "own/only-#m"), ("many-#m", "else-#m"), ("own/only-#m", "else-#m")]), claims), "bare alias", c("raw_value"), F.concat_ws(">", "canonical_id", "owner")),
        _said(checks.shared_identity(text("id org_id", [("lab/alpha-beta-#m", "lab"), ("lab/Beta-alpha-#m", "LAB"), ("far/alpha-beta-#m", "far")])), "shared identity", c("key"), ids),
        _said(checks.double_claims(text("entity_type raw_value canonical_id", [("model", "twice-#m", "a"), ("model", "twice-#m", "b"), ("org", "once-#m", "a"), ("model", "once-#m", "b")])), "double claims", c("raw_value"), c("owners").cast("string")),
        _said(checks.in_two_families(families), "two families", c("benchmark_id"), c("families").cast("string")),
        _said(checks.bad_metric_folds(folds, text("id", [("b-#m",)]), text("id", [(f"m{x}-#m",) for x in range(1, 10)])), "metric folds", F.concat_ws(":", "benchmark_id", "from_metric_id"), F.concat_ws(":", "to_metric_id", "problem")),
    ]
    return reduce(DataFrame.unionByName, found)
