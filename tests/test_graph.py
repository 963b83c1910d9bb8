"""Walks that run into cycles, and components, against plain loops."""

import random

from pyspark.sql import functions as F

from kinfold.operators import attributes, graph


def walked(up, node):
    seen, depth = {node}, 0
    while up.get(node) is not None and up[node] not in seen:
        node = up[node]
        seen.add(node)
        depth += 1
    return node, depth


def test_walks_with_cycles(spark):
    draw = random.Random(3)
    up = {k: draw.choice([None, *range(60)]) if k < 60 else k - 1 for k in range(90)}
    up |= {k: k + 1 for k in range(100, 130)} | {130: 100, 131: 115}  # a long cycle and a node that leads into it
    up = {k: None if v == k else v for k, v in up.items()}
    got = {r.id: (r.root, r.depth) for r in graph.walk_up(spark.createDataFrame(list(up.items()), "id long, up long")).collect()}
    assert got == {k: walked(up, k) for k in up}


def test_components_of_a_long_path(spark):
    pairs = [(k, k + 1) for k in range(300)] + [(1000, 1001), (5, 5), (None, 7)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(301)}, 1000: 1000, 1001: 1000}


def test_inherited_values_round_a_cycle(spark):
    edge = lambda p: [(p, "variant", "version")] if p else []
    rows = [("a", edge("b"), None), ("b", edge("c"), None), ("c", edge("a"), None), ("d", edge("a"), None), ("x", edge("y"), None), ("y", edge("x"), True), ("z", edge("x"), None)]
    nodes = spark.createDataFrame(rows, "id string, parents array<struct<id:string,relationship:string,axis:string>>, open_weights boolean")
    assert {r.id: r.open_weights for r in graph.inherit(nodes, "open_weights").collect()} == {"a": None, "b": None, "c": None, "d": None, "x": True, "y": True, "z": True}


EDGES = "array<struct<id:string,relationship:string,axis:string>>"


def test_three_attributes_in_one_walk(spark):
    draw = random.Random(5)
    up = {k: draw.choice([None, *range(80)]) for k in range(80)} | {k: k - 1 for k in range(80, 140)}
    value = lambda share: {k: draw.choice("xyz") if draw.random() < share else None for k in up}
    given = {"u": value(0.1), "v": value(0.5), "w": value(0.02)}
    rows = [(str(k), [(str(p), "variant", None)] if p is not None else None, *(given[c][k] for c in "uvw")) for k, p in up.items()]
    nodes = spark.createDataFrame(rows, f"id string, parents {EDGES}, u string, v string, w string")

    def first(c, k):
        seen = set()
        while k is not None and k not in seen:
            if given[c][k] is not None:
                return given[c][k]
            seen.add(k)
            k = up[k]

    got = {int(r.id): tuple(r[c] for c in "uvw") for r in graph.inherit(nodes, ["u", "v", "w"]).collect()}
    assert got == {k: tuple(first(c, k) for c in "uvw") for k in up}
    assert graph.inherit(nodes.limit(0), ["u", "v"]).count() == 0


def test_attributes_have_their_own_fallbacks(spark):
    variant = lambda p: [(p, "variant", "version")]
    rows = [
        ("Lab-HF/m-1", None, [], None, True, ["org-unknown", "x"]), ("lab/m-1-2025-03-04", None, variant("Lab-HF/m-1"), " ", None, None), ("new/m-20240230", "kept", variant("lab/m-1-2025-03-04"), "2020", False, ["a"]),
        ("new/m-20240132", None, variant("new/m-20240230"), None, None, ["org-unknown"]), ("bare-2025-13", None, variant("gone"), None, None, ["b"]), ("q", "unknown", variant("q"), None, None, None), ("/odd", None, None, None, None, ["org-unknown"]), ("e/m", "", None, None, None, None),
    ]
    models = spark.createDataFrame(rows, f"id string, org_id string, parents {EDGES}, release_date string, open_weights boolean, tags array<string>")
    out = attributes.derive(models, spark.createDataFrame([("lab-hf", "lab")], "name string, org string"), spark.createDataFrame([("lab",)], "id string"))
    got = {r.id: (r.org_id, r.release_date, r.open_weights, r.tags, r.model_group_id) for r in out["models"].collect()}
    assert got == {
        "Lab-HF/m-1": ("lab", None, True, ["x"], "Lab-HF/m-1"), "lab/m-1-2025-03-04": ("lab", "2025-03-04", True, None, "Lab-HF/m-1"), "new/m-20240230": ("kept", "2020", False, ["a"], "new/m-20240230"), "new/m-20240132": ("new", None, False, [], "new/m-20240132"),
        "bare-2025-13": (None, None, None, ["b", "org-unknown"], "bare-2025-13"), "q": ("unknown", None, None, ["org-unknown"], "q"), "/odd": (None, None, None, ["org-unknown"], "/odd"), "e/m": ("", None, None, None, "e/m"),
    }
    assert [tuple(r) for r in out["orgs"].collect()] == [("new", "new", "new", "community", "reviewed")]


def test_attributes_work_their_models_out_once(spark):
    """However many graphs and walks read them, the models' own plan runs once."""
    seen = spark.sparkContext.accumulator(0)

    def noted(x):
        seen.add(1)
        return x

    edge = "array<struct<id:string,relationship:string,axis:string>>"
    rows = [("a", "o", None, True), ("b", "o", [("a", "variant", "version")], None), ("c", None, [("b", "finetune", None)], None), ("d", "o", [("0", "quantized", None), ("b", "quantized", None)], None), ("e", "p", [("b", "variant", "size"), ("d", "finetune", None)], None)]
    models = spark.createDataFrame(rows, f"id string, org_id string, parents {edge}, open_weights boolean").withColumn("org_id", F.udf(noted, "string").asNondeterministic()("org_id"))
    out = attributes.derive(models, spark.createDataFrame([], "name string, org string"))["models"].collect()
    assert seen.value == 5
    got = {r.id: (r.model_group_id, r.model_family_id, r.lineage_origin_model_id, r.open_weights) for r in out}
    # d's least parent isn't there and ends its walks; c and e lie in other orgs than their parents.
    assert got == {"a": ("a", "a", None, True), "b": ("a", "a", None, True), "c": ("c", "c", "b", None), "d": ("d", "d", None, None), "e": ("e", "e", "d", True)}
