"""Small literal cases of the registry operators, and results that don't depend on the order of rows."""

from pyspark.sql import functions as F

from kinfold.functions import keys
from kinfold.functions.keys import FuzzyRules
from kinfold.operators import changes, facts, graph, match, merge
from kinfold.plans import jobs
from kinfold.sources import registry, schemas

ALIAS = "raw_value string, entity_type string, canonical_id string, source_config string, status string, seq int"
MENTION = "raw_value string, entity_type string, source_config string"


def aliases(spark):
    rows = [("IFEval", "benchmark", "ifeval", None, "auto"), ("MATH", "benchmark", "math-global", None, "auto"), ("MATH", "benchmark", "math-helm", "helm_lite", "auto"), ("Gone", "benchmark", "gone", None, "rejected"),
            ("Overall", "benchmark", "o1", "c1", "auto"), ("Overall", "benchmark", "o2", "c2", "auto"), ("Easy Problems", "benchmark", "lcb-pro", "c1", "auto"), ("zai/glm-4.5", "model", "zai/glm-4.5", None, "auto"),
            ("twice", "benchmark", "first", None, "auto"), ("twice", "benchmark", "last", None, "auto"), ("openai/gpt-5-2025-08", "model", "openai/gpt-5-2025-08", None, "auto"), ("acme/base", "model", "acme/base", None, "auto"),
            ("elo", "metric", "elo", None, "auto"), ("accuracy", "metric", "accuracy", None, "auto"), ("exact-match", "metric", "exact-match", None, "auto"), ("score", "metric", "score", None, "auto"), ("mmlu physics", "benchmark", "mmlu-physics", None, "auto")]
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], ALIAS)


RULES = FuzzyRules(suffixes=("-fc", "-fp8", "-prompt", "-int4-awq", "-awq"), platform_suffixes={"-bedrock": "bedrock"}, host_prefixes={"together": "together", "unknown": None}, org_aliases={"zhipu": "zai"})


def resolved(spark, mentions, **options):
    orgs = spark.createDataFrame([("zai", None), ("acme", "ACME"), ("other", None)], "id string, hf_org string")
    df = spark.createDataFrame(mentions, MENTION)
    out = match.resolve(df, options.pop("aliases", aliases(spark)), rules=RULES, org_map=match.build_org_map(orgs), known_orgs=orgs, **options)
    return {(r.raw_value, r.source_config): (r.canonical_id, r.strategy) for r in out.collect()}


MENTIONS = [("IFEval", "benchmark", None), ("MATH", "benchmark", "helm_lite"), ("MATH", "benchmark", "x"), ("MATH", "benchmark", ""), ("Gone", "benchmark", None), ("Overall", "benchmark", "c3"), ("easy_problems", "benchmark", "c1"), ("zhipu/glm-4.5", "model", None),
            ("twice", "benchmark", None), ("openai/gpt-5-2025-08-07", "model", None), ("acme/base-fp8-fc", "model", None), ("other/base-fp8", "model", None), ("together/acme/base", "model", None), ("mmlu_flan_cot_zeroshot_physics", "benchmark", None),
            ("acme/acme-base", "model", None), ("acme/base-int4-awq", "model", None), ("acme/base-bedrock", "model", None)]
WANT = {("IFEval", None): ("ifeval", "exact"), ("MATH", "helm_lite"): ("math-helm", "exact"), ("MATH", "x"): ("math-global", "exact"), ("MATH", ""): ("math-global", "exact"), ("Gone", None): (None, "no_match"), ("Overall", "c3"): (None, "no_match"),
        ("easy_problems", "c1"): ("lcb-pro", "normalized"), ("zhipu/glm-4.5", None): ("zai/glm-4.5", "fuzzy"), ("twice", None): ("last", "exact"), ("openai/gpt-5-2025-08-07", None): ("openai/gpt-5-2025-08", "fuzzy"), ("acme/base-fp8-fc", None): ("acme/base", "fuzzy"),
        ("other/base-fp8", None): (None, "no_match"), ("together/acme/base", None): ("acme/base", "fuzzy"), ("mmlu_flan_cot_zeroshot_physics", None): ("mmlu-physics", "fuzzy"), ("acme/acme-base", None): ("acme/base", "fuzzy"), ("acme/base-int4-awq", None): ("acme/base", "fuzzy"),
        ("acme/base-bedrock", None): ("acme/base", "fuzzy")}


def test_cascade(spark):
    assert resolved(spark, MENTIONS) == WANT


def test_cascade_does_not_depend_on_row_order(spark):
    assert resolved(spark, MENTIONS[::-1], aliases=aliases(spark).repartition(5).orderBy(F.desc("seq"))) == WANT


def test_exact_mode_and_attestation(spark):
    external = spark.createDataFrame([("Acme/Base",), ("q/Model_x",), ("q/model-X",), ("solo/Net.v1",)], "id string")
    got = resolved(spark, [("acme/base", "model", None), ("SOLO/net_v1", "model", None), ("q/model.x", "model", None), ("zhipu/glm-4.5", "model", None)], external=external, mode="exact")
    assert got == {("acme/base", None): ("Acme/Base", "attested"), ("SOLO/net_v1", None): ("solo/Net.v1", "attested_normalized"), ("q/model.x", None): (None, "no_match"), ("zhipu/glm-4.5", None): (None, "no_match")}


def values(spark, function, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r[0] for r in df.select("k", function(F.col("t")).alias("v")).orderBy("k").select("v").collect()]


def test_keys(spark):
    assert values(spark, keys.match_key, ["tau-bench-2/airline", "tau-bench-2_airline", "GLM 4.5", "MBPP+", "Été (x)!", " a__b ", None]) == ["tau bench 2 airline"] * 2 + ["glm 4 5", "mbpp+", "été x", "a b", None]
    assert values(spark, keys.index_key, ["A/b_C.d:e--", None]) == ["a-b-c-d-e", None]
    assert values(spark, keys.collision_key, ["unknown/Opt-1.3b", "facebook/opt_1.3b"]) == ["opt13b", "facebookopt13b"]
    assert values(spark, keys.size_signature, ["opt-13b-1.3b", "x"]) == [[1.3, 13.0], []]
    assert values(spark, keys.strict_key, ["Éa ß-1", "naïve"]) == ["eass1", "naive"]
    assert values(spark, keys.id_date, ["x-2025-01-31", "x-20240102", "x-2024-05", "x-2040-01-01", "x-2024-13", "x"]) == ["2025-01-31", "2024-01-02", "2024-05-01", None, None, None]
    assert values(spark, keys.is_repo_id, ["a/b", "a", "a/b/c", " /b", "a/ ", "", None]) == [True, False, False, False, False, False, False]
    assert values(spark, keys.without_run_config, ["mmlu_flan_cot_zeroshot_x", "mmlu", "cot", "x_5shot"]) == ["mmlu x", None, None, "x"]
    assert values(spark, keys.family_slug, ["m-preview-2025-01-02", "m-v2-latest", "m-7b"]) == ["m", "m", "m-7b"]
    assert values(spark, keys.display_name, ["org/gpt-4o-8b-20250101", "Has Space", "llama-3"]) == ["GPT 4o 8B (20250101)", "Has Space", "Llama 3"]


def test_phrases(spark):
    texts = ["Accuracy on IFEval", "Exact Match on MATH Level 5", "EM on GSM8K", "F1", "bfcl.live.live_accuracy", "Chat accuracy - includes easy subsets", "Global MMLU Lite - Arabic", "pass@10 rate", "", "GDPval evaluates AI agents on tasks and reports performance as an Elo score."]
    assert values(spark, keys.metric_phrase, texts) == ["Accuracy", "Exact Match", "EM", "F1", "Accuracy", "Accuracy", "score", "Pass@10", "", "Elo Rating"]
    assert values(spark, keys.clean_name, ["bfcl.live.live_accuracy", "fibble1_arena_win_rate", "Gaming Score", "Score", "MMLU"]) == ["bfcl live", "fibble1 arena", "Gaming", "Score", "MMLU"]
    assert values(spark, keys.name_segments, ["bbq.bbq.overall", "a.2.0.b", "plain", "x y.z", "overall.1"]) == [["bbq"], ["a", "b"], None, None, None]


def test_structured_metrics(spark):
    df = spark.createDataFrame([("vals_ai.mgsm.mgsm_de.accuracy",), ("lmarena.elo.overall",), ("openeval/bbq/exact-match",), ("x.score",), ("x.elo.accuracy",)], "m string")
    got = {r.m: r.metric_id for r in match.resolve_structured_metric(df, "m", aliases(spark), spark.createDataFrame([("score",)], "id string")).collect()}
    assert got == {"vals_ai.mgsm.mgsm_de.accuracy": "accuracy", "lmarena.elo.overall": "elo", "openeval/bbq/exact-match": "exact-match", "x.score": None, "x.elo.accuracy": None}


PARENTS = "array<struct<id:string,relationship:string,axis:string>>"


def test_lineage_with_cycle_and_dangling_parent(spark):
    edge = lambda p, r, a=None: [(p, r, a)]
    rows = [("a", "o", edge("b", "variant", "version")), ("b", "o", edge("a", "variant", "version")), ("base", "meta", []), ("ft", "x", edge("base", "finetune")), ("q", "x", edge("ft", "quantized")), ("lost", "x", edge("nowhere", "quantized")), ("two", "x", [("aaa", "quantized", None), ("ft", "quantized", None)])]
    m = spark.createDataFrame(rows, f"id string, org_id string, parents {PARENTS}")
    got = {r.id: (r.model_group_id, r.lineage_origin_model_id, r.lineage_origin_model_org_id) for r in graph.derive_lineage(m).collect()}
    assert got["a"][0] == "b" and got["b"][0] == "a"
    assert got["q"] == ("ft", "base", "meta") and got["ft"] == ("ft", "base", "meta") and got["base"] == ("base", None, "meta")
    assert got["lost"] == ("lost", None, "x")
    assert got["two"][0] == "two"  # the least parent isn't in the table, so the walk stops


def test_long_walk_and_components(spark):
    n = 500
    steps = spark.range(n).selectExpr("cast(id AS string) AS id", "CASE WHEN id > 0 THEN cast(id - 1 AS string) END AS up")
    got = {r.id: (r.root, r.depth) for r in graph.walk_up(steps).collect()}
    assert got == {str(k): ("0", k) for k in range(n)}
    comp = graph.components(spark.range(n - 1).selectExpr("id AS a", "id + 1 AS b"))
    assert comp.count() == n and comp.select("component").distinct().count() == 1


def test_collisions(spark):
    rows = [("google/gemini-1.5-pro",), ("google/gemini-1-5-pro",), ("facebook/opt-1.3b",), ("facebook/opt-13b",), ("n/a-b",), ("n/a_b",), ("real/x-1",), ("real/x_1",)]
    e = spark.createDataFrame(rows, "id string").withColumn("source_rank", F.lit(0)).withColumn("is_real", F.col("id").startswith("real/"))
    never = spark.createDataFrame([("n/a-b", "n/a_b")], "a string, b string")
    assert [tuple(r) for r in merge.fold_collisions(e, never).collect()] == [("google/gemini-1-5-pro", "google/gemini-1.5-pro")]


def test_explicit_null_keeps_weak_value_out(spark):
    core = spark.createDataFrame([("a", None, ["name"]), ("b", None, [])], "id string, name string, explicit_keys array<string>")
    weak = spark.createDataFrame([("a", "w", 0, "f", 0), ("b", "w2", 1, "f", 1), ("b", "w1", 0, "f", 0)], "id string, name string, layer_rank int, file string, pos int")
    assert {r.id: r.name for r in merge.fill_weak(core, weak, ["name"]).collect()} == {"a": None, "b": "w1"}


def test_facts_parents_and_scores(spark):
    rows = [("r", "a", "RB", 0), ("r", "b", "RB", 1), ("r", "c", "RB", 2), ("r", "d", "X", 3), ("s", "a", "RB", 0)]
    got = {(r.evaluation_id, r.name): r.parent for r in facts.detect_parents(spark.createDataFrame(rows, "evaluation_id string, name string, dataset string, result_index int")).collect()}
    assert got == {("r", "a"): "RB", ("r", "b"): "RB", ("r", "c"): "RB", ("r", "d"): None, ("s", "a"): None}


def test_reconcile_and_round_trip(spark, tmp_path):
    old = spark.createDataFrame([("m1", "base", '{"a": "b"}', "not json", 3)], "id string, parent_model_id string, metadata string, tags string, extra int")
    row = schemas.reconcile(old, "canonical_models").first()
    assert row.parents[0].id == "base" and row.parents[0].axis == "size" and row.metadata == {"a": "b"} and row.tags == []
    path = str(tmp_path / "reg")
    registry.save_registry({"canonical_models": schemas.reconcile(old, "canonical_models")}, path)
    tables = registry.load_registry(spark, path, ["canonical_models", "aliases"])
    assert tables["canonical_models"].count() == 1 and tables["aliases"].count() == 0 and tables["aliases"].schema == schemas.schema("aliases")


def test_layers_keep_explicit_keys(spark, tmp_path):
    (tmp_path / "l0").mkdir()
    (tmp_path / "l0" / "a.json").write_text('{"id": "a", "name": null}\n{"id": "b"}\n')
    got = {r.id: r.explicit_keys for r in registry.read_layers(spark, [str(tmp_path / "l0")]).select("id", "explicit_keys").collect()}
    assert got == {"a": ["id", "name"], "b": ["id"]}


def test_upsert_and_patch(spark):
    base = spark.createDataFrame([("a", "x", "t0", "t0"), ("b", "y", "t0", "t0")], "id string, v string, created_at string, updated_at string")
    change = spark.createDataFrame([("a", None, 1), ("c", "z1", 1), ("c", "z2", 2)], "id string, v string, seq int")
    assert {tuple(r) for r in changes.upsert(base, change, now="t1").collect()} == {("a", None, "t0", "t1"), ("b", "y", "t0", "t0"), ("c", "z2", "t1", "t1")}
    al = spark.createDataFrame([("1", "auto", None)], "id string, status string, notes string")
    assert tuple(changes.patch_aliases(al, spark.createDataFrame([("1", None, "n")], "id string, status string, notes string")).first()) == ("1", "auto", "n")


def test_drafts_share_spellings(spark):
    m = spark.createDataFrame([("Foo Bar", "benchmark", None), ("foo_bar", "benchmark", "c"), ("org/Name-7b", "model", None), ("", "metric", None)], MENTION)
    d = changes.mint_drafts(m, spark.createDataFrame([("foo-bar", "benchmark")], "id string, entity_type string")).collect()
    ids = {r.entity_type: r.id for r in d}
    assert len(d) == 3 and ids["model"] == "org/Name-7b" and ids["benchmark"].startswith("foo-bar-") and ids["metric"].startswith("auto-")


def test_sync_twice(spark):
    """A rerun keeps facts it didn't make, replaces its own, and reports its counts."""
    from kinfold.plans import jobs, queries

    records = queries.records(spark, "/root/testdata/sf0.001").limit(20)
    none = spark.createDataFrame([], "raw_value string, entity_type string, source_config string, canonical_id string, status string, seq long")
    entities = spark.createDataFrame([], "id string, entity_type string")
    first = jobs.sync_records(records, none, entities, run_id="r1")
    facts = first["facts"].cache()
    n = facts.count()
    run = first["run"].first()
    assert (run.id, run.status, run.records_processed, run.entities_created) == ("r1", "completed", 20, first["drafts"].count())
    assert run.aliases_created == first["aliases"].count() and run.aliases_updated == 0
    known = first["aliases"].select("raw_value", "entity_type", "source_config", "canonical_id", "status").selectExpr("*", "1L AS seq")
    old = facts.limit(1).withColumn("id", F.lit("other")).unionByName(facts.withColumn("score", F.lit(-1).cast(dict(facts.dtypes)["score"])))
    again = jobs.sync_records(records, known, entities, known_facts=old, rerun=True)
    kept = again["all_facts"]
    assert kept.count() == n + 1 and kept.where("score = -1").count() == 0
    assert again["drafts"].count() == 0 and again["run"].first().aliases_updated == 0
    assert [r.outcome for r in again["refreshed"].select("outcome").distinct().collect()] == ["agree"]


def test_null_and_empty_scopes_are_one(spark):
    aliases = spark.createDataFrame([("model", "x", None, "m1", "confirmed", 1)], "entity_type string, raw_value string, source_config string, canonical_id string, status string, seq long")
    mentions = spark.createDataFrame([(1, "x-fp8", "model", None), (2, "x-fp8", "model", ""), (3, "x-fp8", "model", "s")], "n int, raw_value string, entity_type string, source_config string")
    got = match.resolve(mentions, aliases, rules=FuzzyRules(suffixes=("-fp8",))).orderBy("n").collect()
    assert [(r.n, r.canonical_id, r.strategy) for r in got] == [(1, "m1", "fuzzy"), (2, "m1", "fuzzy"), (3, "m1", "fuzzy")]


def _records(spark, rows):
    schema = (
        "evaluation_id string, source_metadata struct<evaluation_id:string,id:string>, source_config string, model_info struct<id:string,model_name:string,name:string>, eval_library struct<name:string,library_name:string,version:string>, "
        "evaluation_results array<struct<evaluation_name:string,source_data:struct<dataset_name:string>,metric_config:struct<metric_name:string,metric_id:string,evaluation_description:string>,score_details:struct<score:double>,score:double,value:double,result:double>>"
    )
    return spark.createDataFrame([(e, None, "cfg", (m, None, None), ("lib", None, None), [(n, (d,), ("Accuracy", None, None), None, s, None, None) for n, d, s in results]) for e, m, results in rows], schema)


def test_repeated_records_have_no_false_parents_and_the_last_fact_wins(spark):
    one = ("e1", "org/m", [("alpha", "D", 1.0)])
    two = ("e1", "org/m", [("alpha", "D", 2.0)])
    nothing = spark.createDataFrame([], "raw_value string, entity_type string, source_config string, canonical_id string, status string, seq long")
    entities = spark.createDataFrame([], "id string, entity_type string")
    base = jobs.sync_records(_records(spark, [one]), nothing, entities)["facts"]
    out = jobs.sync_records(_records(spark, [one, one, two]).coalesce(1), nothing, entities, known_facts=base.limit(0), run_id="r", now="t")
    pair = ("e2", "org/m", [("alpha", "D", 1.0), ("beta", "D", 2.0), ("gamma", "E", 3.0)])
    twice = facts.result_rows(_records(spark, [pair, pair])).collect()
    assert sorted((r.name, str(r.parent)) for r in twice) == sorted([("alpha", "D"), ("beta", "D"), ("gamma", "None")] * 2)
    rows = out["facts"].collect()
    assert len(rows) == 3 and all(r.parent_benchmark_id is None for r in rows)
    assert [r.score for r in out["all_facts"].collect()] == [2.0]
    log = {(r.entity_type, r.raw_value): (r.canonical_id, r.created_new) for r in out["log"].collect()}
    assert log["model", "org/m"] == ("org/m", True) and all(i is not None for i, _ in log.values())


def test_repeated_changes_leave_one_row(spark):
    base = spark.createDataFrame([("a", 1, "x")], "id string, v int, w string")
    got = changes.upsert(base, spark.createDataFrame([("a", 2), ("a", 3), ("b", 5)], "id string, v int")).orderBy("id").collect()
    assert [tuple(r) for r in got] == [("a", 3, "x"), ("b", 5, None)]


def test_a_loser_without_its_winner_stays(spark):
    e = spark.createDataFrame([("a", ["x"]), ("b", ["y"]), ("c", None)], "id string, aliases array<string>")
    got = {r.id: r.aliases for r in merge.apply_remap(e, spark.createDataFrame([("a", "gone"), ("b", "c")], "loser string, winner string"), ["aliases"]).collect()}
    assert got == {"a": ["x"], "c": ["b", "y"]}


def test_facts_are_not_shuffled_by_small_dictionaries(spark):
    """Few names are broadcast to the results, whatever Spark guesses of the table that they come from."""
    rows = spark.createDataFrame([(0, "e1", "c", 0, "n acc", "m", "h", "n", "p", "acc", 1.0), (0, "e1", "c", 1, "n elo", "m", "h", "n", None, "elo", 2.0)], "record long, evaluation_id string, source_config string, result_index int, name string, model_raw string, harness_raw string, benchmark_raw string, parent string, metric_raw string, score double")
    out = facts.flatten_records(rows, facts.mentions_of(rows).distinct().withColumn("canonical_id", F.concat("entity_type", F.lit(":"), "raw_value")))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 5 and "SortMergeJoin" not in plan
    assert {(r.result_index, r.model_id, r.harness_id, r.benchmark_id, r.parent_benchmark_id, r.metric_id) for r in out.collect()} == {(0, "model:m", "harness:h", "benchmark:n", "benchmark:p", "metric:acc"), (1, "model:m", "harness:h", "benchmark:n", None, "metric:elo")}


def test_parents_of_rows_are_those_detected(spark):
    """Repeated names in a record, the last of which decides, beside a record of the same names."""
    rows = spark.createDataFrame([(1, "a", "d", 0), (1, "a", "x", 1), (1, "b", "d", 2), (1, "c", None, 3), (1, "c", None, 4), (2, "a", "d", 0), (2, "b", "x", 1), (3, "a", "z", 1), (3, "a", "z", 0)], "record long, name string, dataset string, result_index int")
    want = {(r.record, r.name): r.parent for r in facts.detect_parents(rows, "record").collect()}
    got = facts._with_parents(rows).collect()
    assert len(got) == 9 and {(r.record, r.name): r.parent for r in got} == want == {(1, "a"): None, (1, "b"): "d", (1, "c"): None, (2, "a"): None, (2, "b"): None, (3, "a"): "z"}
