"""The stream's log over failures, restarts and other streams."""

import pytest

from kinfold.streaming import log, resolve

SCHEMA = "raw_value string, entity_type string, source_config string"


def told(spark, path):
    return sorted((r.batch, r.raw_value, r.source_config or "", r.canonical_id, r.requests) for r in log.read_log(spark, path).collect())


def test_a_failed_batch_is_logged_once(spark, tmp_path, monkeypatch):
    aliases = spark.createDataFrame([("a", "model", None, "id-a", "auto", 1), ("a", "model", "cfg", "id-b", "auto", 2)], f"{SCHEMA}, canonical_id string, status string, seq int")
    incoming, root = f"file://{tmp_path}/in", f"file://{tmp_path}"
    add = lambda *rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(incoming)
    write, failures = log.write_batch, [2]

    def failing(df, path, stream, batch):
        # The second write of the first two attempts fails: results are there, the log isn't, or is and nobody knows.
        folder = write(df, path, stream, batch)
        if path.endswith("log") and failures[0]:
            failures[0] -= 1
            raise OSError("lost")
        return folder

    def run(state):
        mentions = spark.readStream.schema(SCHEMA).parquet(incoming)
        resolve.resolve_stream(mentions, aliases, f"{root}/out", f"{root}/{state}", f"{root}/log", trigger={"availableNow": True}).awaitTermination()

    monkeypatch.setattr(log, "write_batch", failing)
    add(("a", "model", None), ("a", "model", ""), ("A", "model", None), ("a", "model", "cfg"))
    for _ in range(2):
        with pytest.raises(Exception, match="lost"):
            run("state")
    run("state")
    first = [(0, "A", "", "id-a", 1), (0, "a", "", "id-a", 2), (0, "a", "cfg", "id-b", 1)]
    assert told(spark, f"{root}/log") == first
    add(("a", "model", None), ("zz", "model", None))
    run("state")
    run("state")
    assert told(spark, f"{root}/log") == [*first, (1, "a", "", "id-a", 1), (1, "zz", "", None, 1)]
    assert spark.read.parquet(f"{root}/out").count() == 6
    ids = [r.request_id for r in log.read_log(spark, f"{root}/log").collect()]
    assert len(set(ids)) == 5
    # Another stream over the same input adds its own rows, it doesn't replace the first one's.
    run("other")
    assert len(told(spark, f"{root}/log")) == 5 + 4 and spark.read.parquet(f"{root}/out").count() == 12


def test_an_empty_batch(spark):
    none = spark.createDataFrame([], f"{SCHEMA}, canonical_id string, strategy string, confidence double")
    assert log.request_log(none, "s", 0).count() == 0
