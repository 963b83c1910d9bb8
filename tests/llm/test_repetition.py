"""Quality rules on repetition that the base rules let pass."""

import random

from kinfold.llm import quality


def test_strong_repetition_is_rejected_and_light_stays(spark):
    draw = random.Random(8)
    fresh = lambda n: [f"w{draw.randrange(100_000)}" for _ in range(n)]
    clean = [(k, " ".join(fresh(draw.randrange(60, 400)))) for k in range(400)]
    light = [(1000 + k, " ".join(fresh(145)) + "\none line that recurs here\n" + " ".join(fresh(145)) + "\none line that recurs here") for k in range(10)]
    lines = [(2000 + k, "\n".join("click to share\n" + " ".join(fresh(4)) for _ in range(14))) for k in range(10)]
    words = [(3000 + k, " ".join(" ".join([*fresh(12), "buy", "the", "best", "of", "all", "of", "them", "here", "and", "now"]) for _ in range(9))) for k in range(10)]
    df = spark.createDataFrame(clean + light + lines + words, "doc_id long, text string")
    stats = quality.stored(quality.with_statistics(df), "t")
    got = {r.doc_id: r for r in quality.judge(stats, quality.fit(stats, []), []).collect()}
    assert not any(r.base_failed for r in got.values())
    assert all(got[k].kept for k, _ in clean + light)
    assert not any(got[k].kept for k, _ in lines + words)
