"""Reconciling batches: literal cases beside those of the queries, and repeated runs."""

import duckdb
import pytest
from pyspark.sql import functions as F

from kinfold.functions import keys
from kinfold.operators import reconcile
from kinfold.plans import jobs, queries, reconcile_queries  # noqa: F401  (the last adds to the queries)

ENTRY = "id string, display_name string, org_id string, aliases array<string>, release_date string, deferred boolean, seq long, family string"


def entries(spark, *rows):
    names = [c.split(" ")[0] for c in ENTRY.split(", ")]
    return spark.createDataFrame([tuple(({"id": r} if isinstance(r, str) else r).get(c) for c in names) for r in rows], ENTRY)


@pytest.fixture(scope="module")
def org_map(spark):
    return spark.createDataFrame([("acme", "acme"), ("acmecorp", "acme")], "name string, org string")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_a_pair_kept_apart_keeps_its_whole_component_apart(spark, org_map):
    rows = entries(spark, {"id": "acme/a-1", "org_id": "acme"}, {"id": "acme/A_1", "org_id": "acme"}, {"id": "acme/acmecorp-a-1", "org_id": "acme"}, {"id": "acme/b", "org_id": "acme"}, {"id": "acme/B", "org_id": "acme"})
    assert ids(reconcile.reconcile_batch(rows, org_map)["entries"]) == ["acme/A_1", "acme/B"]
    apart = spark.createDataFrame([("acme/a-1", "acme/acmecorp-a-1")], "a string, b string")
    assert ids(reconcile.reconcile_batch(rows, org_map, apart=apart)["entries"]) == ["acme/A_1", "acme/B", "acme/a-1", "acme/acmecorp-a-1"]


def test_different_sizes_and_orgs_stay_apart(spark, org_map):
    rows = entries(spark, {"id": "acme/a-1.3b", "org_id": "acme"}, {"id": "acme/a-13b", "org_id": "acme"}, {"id": "zed/a-13b", "org_id": "zed"}, "a-13b")
    out = reconcile.reconcile_batch(rows, org_map)
    assert len(ids(out["entries"])) == 4 and out["remap"].count() == 0


def test_reconciling_again_changes_nothing(spark, org_map):
    rows = entries(spark, {"id": "acme/x-1", "org_id": "acme", "aliases": ["x1", "zed/y"]}, {"id": "acme/X_1", "org_id": "acme", "aliases": ["both"]}, {"id": "zed/y", "org_id": "zed", "aliases": ["both", "acme x 1"], "display_name": "both"})
    once = reconcile.reconcile_batch(rows, org_map, ["family"])["entries"].select("id", "display_name", "org_id", "aliases", "release_date", "deferred", "seq", "family")
    again = reconcile.reconcile_batch(once, org_map, ["family"])["entries"].select(once.columns)
    assert sorted(map(str, once.collect())) == sorted(map(str, again.collect()))
    kept = {r.id: (r.display_name, r.aliases) for r in once.collect()}
    assert kept == {"acme/X_1": (None, ["acme/x-1", "both", "x1"]), "zed/y": ("y", [])}


def test_empty_batches(spark, org_map):
    none = entries(spark)
    assert reconcile.reconcile_batch(none, org_map)["entries"].count() == 0
    assert reconcile.carry_forward(none, none, org_map)["entries"].count() == 0
    assert reconcile.reconcile_existing(none, none, none, org_map)["entries"].count() == 0
    one = entries(spark, {"id": "acme/x", "display_name": "X"})
    assert ids(reconcile.carry_forward(none, one, org_map)["entries"]) == ["acme/x"] and ids(reconcile.carry_forward(one, none, org_map)["entries"]) == ["acme/x"]
    assert ids(reconcile.reconcile_existing(one, none, none, org_map)["entries"]) == ["acme/x"]


def test_a_repo_over_a_repo_keeps_the_committed_one(spark, org_map):
    """A promoted spelling and then a committed repo of the same twin: both end at the committed repo."""
    fresh = entries(spark, {"id": "acme/New-1", "display_name": "N", "deferred": True})
    old = entries(spark, {"id": "acme/new1", "display_name": "a", "seq": 1}, {"id": "acme/New_1", "display_name": "b", "deferred": True, "seq": 2})
    out = reconcile.carry_forward(fresh, old, org_map)
    assert {(r.loser, r.winner) for r in out["remap"].collect()} == {("acme/new1", "acme/New_1"), ("acme/New-1", "acme/New_1")}
    assert [(r.id, r.aliases) for r in out["entries"].collect()] == [("acme/New_1", ["a", "acme/New-1", "acme/new1", "b"])]


def test_catalogue_generation_is_stable(spark, org_map):
    """The job over its own output as the committed generation: same ids, nothing removed, nothing renamed."""
    def provider(n, model, **more):
        base = {"provider": "p", "model_id": model, "family": None, "name": None, "release_date": "2024-01-01", "open_weights": False, "pos": n, "platform": "host"}
        return tuple((base | more).values())

    schema = "provider string, model_id string, family string, name string, release_date string, open_weights boolean, pos long, platform string"
    records = spark.createDataFrame([provider(1, "acme-alpha-7b"), provider(2, "us.meta.acme_alpha-7b:free"), provider(3, "acme-beta-2"), provider(4, "acme-gamma"), provider(5, "nobody-x1"), provider(6, "acme-core-9")], schema)
    repos = spark.createDataFrame([("acme/Acme-Alpha-7B", "fixed_exact", 1)], "fixed_id string, status string, seq long")
    external = spark.createDataFrame([("acme/beta-acme-2",), ("acme/denied",)], "key string")
    independent = entries(spark, {"id": "acme/Core-9", "display_name": "Core 9", "org_id": "acme", "aliases": ["acme/acme-core-9"], "seq": 1})
    committed = entries(spark, {"id": "acme/old-one", "display_name": "Old one", "org_id": "acme", "aliases": ["o1"], "seq": 1}, {"id": "acme/acme-gam-ma", "display_name": "G", "org_id": "acme", "seq": 2})

    def run(before):
        return jobs.regenerate_catalogue(records, org_map, repos, before, independent, entries(spark), external=external)

    first = run(committed)
    rows = {r.id: r for r in first["entries"].collect()}
    assert set(rows) == {"acme/Acme-Alpha-7B", "acme/beta-acme-2", "acme/acme-gam-ma", "nobody-x1", "acme/old-one", "acme/Core-9"}
    assert rows["acme/Acme-Alpha-7B"].deferred and rows["acme/beta-acme-2"].adopted and rows["acme/old-one"].upstream_status == "removed"
    assert "acme/acme-gamma" in rows["acme/acme-gam-ma"].aliases and rows["acme/Core-9"].display_name is None
    assert rows["acme/Acme-Alpha-7B"].platforms.get("acme-alpha-7b") == "host"
    assert {(r.id, r.reason) for r in first["suppressed"].collect()} == {("acme/acme-core-9", "form")}
    again = run(first["entries"].withColumn("seq", F.coalesce("seq", F.lit(0))))
    assert ids(again["entries"]) == sorted(rows)
    assert {r.outcome for r in again["report"].collect()} <= {"retained", "renamed"}
    forms = {r.id: set(r.aliases or []) for r in first["entries"].collect()}
    for r in again["entries"].collect():
        assert set(r.aliases or []) >= forms[r.id]


def test_parts_whose_numbers_look_like_dates(spark, tmp_path):
    """The catalogue query and its SQL over parts of six and eight digits: none is a date, each is its own group."""
    con = duckdb.connect()
    con.execute("CREATE VIEW part AS SELECT * REPLACE (k AS p_partkey) FROM (SELECT * FROM '/root/testdata/sf0.001/part.parquet' WHERE p_partkey = 1), (SELECT unnest([7, 99999, 100001, 202401, 240101, 1000000, 20240101]) AS k)")
    con.execute(f"COPY part TO '{tmp_path}/part.parquet'")
    got = queries.QUERIES["catalogue_generation"](spark, str(tmp_path)).select("id", "state", "aliases").collect()
    want = con.execute(f"SELECT id, state, aliases FROM ({queries.SQL['catalogue_generation']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)


def test_number_words_are_dates_by_the_rules(spark):
    names = spark.createDataFrame([("acme-a-100001",), ("acme-a-20240101-b",)], "n string")
    key = lambda rules: [r[0] for r in names.select(keys.catalogue_key(F.col("n"), rules)).collect()]
    assert key(None) == ["acme-a", "acme-a-b"]
    assert key(keys.CatalogueRules(stamps=())) == ["acme-a-100001", "acme-a-20240101-b"]
