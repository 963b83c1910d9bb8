"""The enrichment of known models as a job: what skips it, what is noted, what stays when a repository goes."""

import pytest

from kinfold.operators import enrichment, reconcile
from kinfold.plans import jobs
from kinfold.sources import publish

REPO = "id string, release_date string, params_billions double, open_weights boolean, tags array<string>, relation string, base_models array<string>"


def tables(spark, entries, repos):
    known = spark.createDataFrame([(i, a, k) for k, (i, a) in enumerate(entries)], "id string, aliases array<string>, seq long")
    orgs = spark.createDataFrame([("labhf", "lab")], "name string, org string")
    return known, spark.createDataFrame([("lab", "LabHF")], "org string, spelling string"), spark.createDataFrame([(i, date, None, None, None, None, None) for i, date in repos], REPO), orgs


def test_snapshot_tags_decide_what_is_asked(spark, tmp_path):
    path = f"file://{tmp_path}/enrichment"
    first = [("lab/a", None), ("lab/b", ["LabHF/B-x"])]
    repos = [("lab/a", "2024-01-01"), ("LabHF/B-x", "2024-02-02"), ("nobody/else", "2024-03-03")]
    run = lambda entries, repos, tag: jobs.refresh_enrichment(*tables(spark, entries, repos), path, tag)
    read = lambda: {r.id: (r.release_date, r.removed) for r in publish.read_published(spark, path, "enrichment").collect()}
    assert run(first, repos, "s1") == "written"
    # LabHF/B-x leads to lab/B-x, which isn't known yet; that lab/b has it as an alias doesn't make it lab/b's repository.
    assert read() == {"lab/a": ("2024-01-01", False)}
    assert run(first, [], "s1") == "skipped"
    more = [*first, ("lab/B-x", None)]
    assert run(more, repos, "s1") == "written" and read() == {"lab/a": ("2024-01-01", False), "lab/B-x": ("2024-02-02", False)}
    assert run(more, repos, "s1") == "skipped" and run(more, repos, "s2") == "same" and run(more, repos, None) == "same"
    assert run(more, repos[1:], "s3") == "written"
    assert read() == {"lab/a": ("2024-01-01", True), "lab/B-x": ("2024-02-02", False)}
    assert run(more, repos, "s4") == "written" and not any(removed for _, removed in read().values())


def test_nothing_is_noted_when_a_run_breaks_off(spark, tmp_path):
    path = f"file://{tmp_path}/enrichment"
    known, spellings, repos, orgs = tables(spark, [("lab/a", None)], [("lab/a", "2024-01-01")])
    with pytest.raises(Exception):
        jobs.refresh_enrichment(known, spellings, repos.selectExpr("*", "raise_error('lost') AS x").drop("release_date").withColumnRenamed("x", "release_date"), orgs, path, "s1")
    assert publish.checked_ids(spark, f"{path}/_checked", "s1").count() == 0
    assert jobs.refresh_enrichment(known, spellings, repos, orgs, path, "s1") == "written"


def test_empty_tables(spark):
    known, spellings, repos, orgs = tables(spark, [("lab/a", None)], [("lab/a", "2024-01-01")])
    assert enrichment.enrich_known(known.limit(0), spellings, repos, orgs).count() == 0
    assert enrichment.enrich_known(known, spellings.limit(0), repos.limit(0), orgs.limit(0)).count() == 0
    rows, report = reconcile.apply_folds(known, spellings.selectExpr("org AS id", "spelling AS target", "'m' AS match_type"), spellings.selectExpr("org AS id"))
    assert [r.id for r in rows.collect()] == ["lab/a"] and [(r.n, r.missing) for r in report.collect()] == [(0, 1)]
