"""Regeneration in stages: what changed runs again, what didn't is left alone; publishing and watermarks."""

from pyspark.sql import functions as F

from kinfold.plans import regenerate
from kinfold.sources import publish


def test_stages_skip_what_did_not_change(spark, tmp_path):
    calls = []

    def stage(name, f):
        def run(x):
            calls.append(name)
            return f(x)

        return run

    stages = [("even", ["numbers"], stage("even", lambda x: x["numbers"].where("id % 2 = 0"))), ("sum", ["even"], stage("sum", lambda x: x["even"].agg(F.sum("id").alias("s")))), ("all", ["numbers", "sum"], stage("all", lambda x: x["numbers"].crossJoin(x["sum"])))]
    path = f"file://{tmp_path}/s"
    run = lambda n, release="1": publish.run_stages(spark, {"numbers": n}, stages, path, release)
    numbers = spark.range(10)
    assert run(numbers)[1] == {"even": "ran", "sum": "ran", "all": "ran"}
    assert run(numbers.repartition(3))[1] == {"even": "skipped", "sum": "skipped", "all": "skipped"} and len(calls) == 3
    # Another odd number: the first stage gives what it gave, so the second isn't run.
    tables, said = run(spark.range(10).union(spark.createDataFrame([(11,)], "id long")))
    assert said == {"even": "same result", "sum": "skipped", "all": "ran"} and tables["all"].count() == 11
    assert run(spark.range(12), "2")[1] == {"even": "ran", "sum": "ran", "all": "ran"}
    folders = {r["folder"] for r in publish.load_manifest(spark, path).values()}
    assert len(folders) == 3 and tables["all"].count() == 11  # snapshots that were read stay


def test_publishing_by_content(spark, tmp_path):
    path = f"file://{tmp_path}/p"
    a, b = spark.createDataFrame([(1, "x"), (2, None)], "id int, v string"), spark.range(3)
    assert publish.publish({"a": a, "b": b}, path) == {"a": "written", "b": "written"}
    first = publish.load_manifest(spark, path)
    assert publish.publish({"a": a.orderBy(F.desc("id")), "b": b.repartition(2)}, path) == {"a": "same", "b": "same"}
    assert publish.load_manifest(spark, path) == first
    assert publish.publish({"a": a.withColumn("v", F.coalesce("v", F.lit(""))), "b": b}, path) == {"a": "written", "b": "same"}
    assert sorted(map(tuple, publish.read_published(spark, path, "a").collect())) == [(1, "x"), (2, "")]
    assert publish.load_manifest(spark, path)["b"]["folder"] == first["b"]["folder"]
    assert publish.publish({"b": b}, path) == {"b": "same"} and set(publish.load_manifest(spark, path)) == {"b"}


def test_watermark(spark, tmp_path):
    path, seen = f"file://{tmp_path}/state", []

    def run(ids, tag, fail=False):
        def keep(df):
            if fail:
                raise OSError("full")
            seen.append(sorted(r.id for r in df.collect()))

        return publish.refresh_unchecked(spark.createDataFrame([(i,) for i in ids], "id string"), path, tag, lambda df: df, keep)

    assert run("ab", "t1") == 2 and run("ab", "t1") == 0 and run("abc", "t1") == 1 and run("abc", "t2") == 3 and run("abc", "t2") == 0
    assert seen == [["a", "b"], ["c"], ["a", "b", "c"]]
    try:
        run("abcd", "t2", fail=True)
    except OSError:
        pass
    assert run("abcd", "t2") == 1 and run("ab", None) == 2 and run("ab", None) == 2


def world(spark):
    entry = "id string, display_name string, org_id string, aliases array<string>, parents array<struct<id:string,relationship:string,axis:string>>, release_date string, open_weights boolean, review_status string, seq long, family string"
    df = spark.createDataFrame
    records = [("p", m, None, None, "2024-01-01", False, k, "host") for k, m in enumerate(["acme-alpha-7b", "acme-beta-2", "acme-core-9"])]
    return {
        "truth": df([("mentioned alpha", "acme/Alpha-7B", "fixed_exact")], "raw_value string, fixed_id string, status string"),
        "core": df([("acme/Core-9", "Core 9", "acme", ["acme/acme-core-9"], [], None, True, "reviewed", 1, "core")], entry),
        "org_map": df([("acme", "acme")], "name string, org string"), "orgs": df([("acme", None, "Acme", None, "lab", 1)], "id string, hf_org string, display_name string, aliases array<string>, kind string, seq long"),
        "deny": df([], "raw string"), "records": df(records, "provider string, model_id string, family string, name string, release_date string, open_weights boolean, pos long, platform string"),
        "repos": df([("acme/Alpha-7B", "fixed_exact", 1)], "fixed_id string, status string, seq long"), "committed": df([("acme/gone", "Gone", "acme", [], [], None, None, "draft", 1, None)], entry),
        "external_keys": df([], "key string"), "external": df([("acme/alpha-7b", "2023-12-01", 7.0, True)], "id string, release_date string, params_billions double, open_weights boolean"),
        "mentions": df([("acme/alpha-7b",), ("fork/unseen-1",), ("mentioned alpha",)], "raw_value string"), "prior": df([], "id string, display_name string, aliases array<string>"),
    }


def test_full_regeneration(spark, tmp_path):
    path, inputs = f"file://{tmp_path}/g", world(spark)
    tables, said = regenerate.regenerate(spark, inputs, path)
    assert set(said.values()) == {"ran"}
    models = {r.id: r for r in tables["models"].collect()}
    assert set(models) == {"acme/Alpha-7B", "acme/acme-beta-2", "acme/Core-9", "acme/gone", "fork/unseen-1"}
    assert models["acme/Alpha-7B"].params_billions == 7.0 and models["acme/Alpha-7B"].model_group_id == "acme/Alpha-7B" and models["acme/Core-9"].family == "core"
    assert models["fork/unseen-1"].resolution_source == "inferred" and models["fork/unseen-1"].org_id == "fork"
    leads = {r.raw_value: r.canonical_id for r in tables["aliases"].collect()}
    assert leads["mentioned alpha"] == "acme/Alpha-7B" and leads["acme-alpha-7b"] == "acme/Alpha-7B" and leads["acme/acme-core-9"] == "acme/Core-9"
    again = {**inputs, "mentions": inputs["mentions"].union(spark.createDataFrame([("fork/second-2",)], "raw_value string")), "prior": tables["residual"].select("id", "display_name", "aliases")}
    more, said = regenerate.regenerate(spark, again, path)
    assert {k: v for k, v in said.items() if v == "skipped"}.keys() == {"oracle", "catalogue", "enrichment", "registry"}
    assert {r.id for r in more["models"].collect()} == {*models, "fork/second-2"}
