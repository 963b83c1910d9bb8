"""Work that must be dealt to all cores and made once, whatever the tables' sizes."""

from __future__ import annotations

import os
import uuid

from kinfold import storage
from kinfold.operators import graph, match, reconcile
from kinfold.plans import queries, reconcile_queries


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_parts_of_one_file_are_dealt_to_all_cores(spark, tmp_path):
    spark.range(100).selectExpr("id as p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert queries.sized_parts(spark, str(tmp_path)).rdd.getNumPartitions() >= min(spark.sparkContext.defaultParallelism, 4)


def test_entries_of_one_org_are_not_dealt_to_one_task(spark):
    entries = spark.range(10).selectExpr("concat('o/m-', id) as id")
    assert "Exchange hashpartitioning" not in _plan(reconcile._twin_rows(entries, reconcile_queries._org_map(spark, ["o"])))


def test_tiers_of_folds_share_one_join(spark):
    org = spark.createDataFrame([], "name string, org string")
    mints = spark.createDataFrame([("x/Acme-One", "x", ["t/one"]), ("Two", None, ["two-b"]), ("x/acme-three", "X", []), ("y/four", None, [])], "id string, org string, forms array<string>")
    targets = spark.createDataFrame([("t/one", "t", [], 1), ("t/two", "t", ["TWO-B"], 1), ("x/Acme three", "x", [], 1), ("z/acme-one", "x", [], 1), ("t/four", "t", [], 1)], "id string, org string, aliases array<string>, seq long")
    out = match.decide_folds(mints, targets, org)
    assert _plan(out).count("SortMergeJoin") + _plan(out).count("HashJoin") == 1
    assert sorted(map(tuple, out.collect())) == [("Two", "t/two", 2), ("x/Acme-One", "t/one", 1), ("x/acme-three", "x/Acme three", 3)]


def test_forms_are_looked_up_as_they_are_and_by_key_only(spark):
    """An owner's facts come with its forms: no join for each of them."""
    e = spark.range(1).selectExpr("'a/x' as id", "'X' as display_name", "'a' as org_id", "array('x-1') as aliases", "1L as seq")
    fresh = spark.range(1).selectExpr("'b/y' as id", "'Y' as display_name", "'b' as org_id", "array('X 1', 'y-1') as aliases")
    out = reconcile.reconcile_existing(fresh, e, e.limit(0), spark.createDataFrame([], "name string, org string"))
    assert [r["aliases"] for r in out["entries"].collect()] == [["y-1"]]
    assert "held" in str(out["entries"].inputFiles()) and _plan(out["vetoed"]).count("Join") == 0


def test_walks_keep_their_last_round_without_ends(spark, tmp_path, monkeypatch):
    """Ends are stored once, with the steps, and a round goes when the next is there."""
    monkeypatch.setattr(storage, "shared_folder", lambda spark, name: f"file://{tmp_path}/{name}-{uuid.uuid4().hex}")
    ends = graph.walk_up(spark.range(40).selectExpr("id", "if(id % 20 = 0, null, id - 1) as up")).collect()
    assert sorted(map(tuple, ends)) == [(k, k - k % 20, k % 20) for k in range(40)]
    assert sorted(spark.read.parquet(f"{tmp_path}/{f}").count() for f in os.listdir(tmp_path)) == [38, 40]
