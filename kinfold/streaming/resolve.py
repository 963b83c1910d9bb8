"""Matching as a stream: mentions meet static tables; results and logs are appended by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.keys import FuzzyRules
from ..operators import match
from . import log


def batch_writer(aliases: DataFrame, path: str, checkpoint: str, log_path: str | None = None, levels: dict[str, DataFrame] | None = None, **options) -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch``: resolve the batch, write the results, and their log (``log.request_log``) from what was written.

    Folders are named by the stream (its checkpoint) and the batch, so a batch that runs again replaces what it left, whether it
    had failed before, between or after the two writes; a stream with another checkpoint adds to the same paths.
    """
    name = log.stream_name(checkpoint)

    def write(batch: DataFrame, n: int) -> None:
        folder = log.write_batch(match.resolve(batch, aliases, **options), path, name, n)
        if log_path:
            # The log is taken from the rows just written, so each batch is resolved once.
            done = batch.sparkSession.read.parquet(folder)
            rows = log.request_log(done, name, n, levels).withColumn("created_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
            log.write_batch(rows, log_path, name, n)

    return write


def resolve_stream(mentions: DataFrame, aliases: DataFrame, path: str, checkpoint: str, log_path: str | None = None, external: DataFrame | None = None, rules: FuzzyRules | None = None, org_map: DataFrame | None = None, known_orgs: DataFrame | None = None, trigger: dict | None = None, levels: dict[str, DataFrame] | None = None) -> StreamingQuery:
    """Resolve a stream of mentions without writing aliases; append results (and a log) once per micro-batch (``batch_writer``).

    Mentions that repeat within a batch are resolved once; a later batch sees a refreshed alias table.
    """
    write = batch_writer(aliases, path, checkpoint, log_path, levels, external=external, rules=rules, org_map=org_map, known_orgs=known_orgs)
    return mentions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "300 seconds"})).start()
