"""The residual layer: each way a mention can go, and that it is a fixed point on its own output."""

import pytest

from kinfold.functions.keys import FuzzyRules
from kinfold.operators import residual

ALIAS = "raw_value string, entity_type string, source_config string, canonical_id string, status string, seq long"
PRIOR = "id string, display_name string, aliases array<string>"


@pytest.fixture(scope="module")
def world(spark):
    entities = spark.createDataFrame([("acme/llama-3", "acme", "hf", [], 1), ("acme/Core.X-7b", "acme", "curated", ["acme core"], 2), ("zed/known", "zed", "hf", [], 3)], "id string, org_id string, resolution_source string, aliases array<string>, seq long")
    aliases = spark.createDataFrame([(f, "model", None, i, "confirmed", k) for k, (f, i) in enumerate([("acme/llama-3", "acme/llama-3"), ("llama-3", "acme/llama-3"), ("acme/Core.X-7b", "acme/Core.X-7b"), ("zed/known", "zed/known"), ("known one", "zed/known")])], ALIAS)
    claims = spark.createDataFrame([("acme/llama-3", "acme/llama-3"), ("known one", "zed/known"), ("curated/thing", "zed/known")], "form string, id string")
    mentions = spark.createDataFrame([(r,) for r in (
        "unknown/llama-3", "unknown/Open Hands", "acme/llama-3-2024-05-01", "fork/llama-3-chat", "New/Model-7B", "new/model_7b", "new/model-8b", "acme/core-x7b", "Just A Name", "known one", "curated/thing", "zed/known-fp8", "fork/LLAMA-3-chat",
    )], "raw_value string")
    return entities, aliases, claims, mentions, spark.createDataFrame([("acme", "acme")], "name string, org string"), spark.createDataFrame([("curated/thing",)], "form string")


def run(world, prior, entities=None, aliases=None):
    e, a, claims, mentions, org_map, curated = world
    return residual.residual_layer(mentions, e if entities is None else entities, a if aliases is None else aliases, prior, claims, org_map, curated, rules=FuzzyRules(suffixes=("-fp8",)))


def rows(df):
    return {r.id: r for r in df.collect()}


def plain(out):
    return sorted(map(str, out["entries"].select("id", "display_name", "org_id", "aliases", "parents", "tags").collect()))


def test_each_way_and_the_fixed_point(spark, world):
    prior = spark.createDataFrame([("old/gone", "old/gone", ["og"]), ("zed/known-fp8", "zed/known-fp8", ["kf8"]), ("new/model-8b", "new/model-8b", ["m8"])], PRIOR)
    first = run(world, prior)
    got = rows(first["entries"])
    assert got["acme/llama-3"].display_name is None and got["acme/llama-3"].aliases == ["unknown/llama-3"]  # without its placeholder org
    dated = got["acme/llama-3-2024-05-01"]
    assert dated.org_id == "acme" and [tuple(p) for p in dated.parents] == [("acme/llama-3", "variant", "version")]
    assert [tuple(p) for p in got["fork/LLAMA-3-chat"].parents] == [("acme/llama-3", "finetune", None)] and got["fork/LLAMA-3-chat"].aliases == ["fork/LLAMA-3-chat", "fork/llama-3-chat"]
    assert got["New/Model-7B"].aliases == ["New/Model-7B", "new/model_7b"] and got["new/model-8b"].display_name == "new/model-8b"
    assert got["acme/Core.X-7b"].aliases == ["acme/core-x7b"] and got["acme/Core.X-7b"].display_name is None  # collision twin
    assert got["just-a-name"].tags == ["org-unknown"] and got["unknown/open-hands"].org_id is None
    assert "curated/thing" not in got and not any("curated/thing" in r.aliases for r in got.values())
    # The floor: a form that only fuzzy rules match is pinned, its record's others go along; a draft's old alias stays with it.
    assert got["zed/known"].aliases == ["kf8", "zed/known-fp8"] and "m8" in got["new/model-8b"].aliases
    assert {(r.home, r.form) for r in first["lost"].collect()} == {("old/gone", "old/gone"), ("old/gone", "og")}
    assert {r.raw_value for r in first["review"].collect()} == {"Just A Name", "unknown/Open Hands"}
    entities, aliases = residual.apply_layer(world[0], world[1], first["entries"])
    second = run(world, first["entries"].select("id", "display_name", "aliases"), entities, aliases)
    assert plain(second) == plain(first) and second["lost"].count() == 0


def test_empty(spark, world):
    e, a, claims, mentions, org_map, curated = world
    out = residual.residual_layer(mentions.where("false"), e, a, spark.createDataFrame([], PRIOR), claims, org_map)
    assert out["entries"].count() == 0 and out["report"].count() == 0
