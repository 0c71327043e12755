"""Streams that can stop and go on: files in, state and checkpoint kept, each batch delivered once; event-time windows.

A run reads what has come since the last one and ends (available-now trigger); where it stands is in its checkpoint. Batches are
delivered by number, a folder each, so a batch that is run again after a failure takes its own place. A client follows a
job's messages from there, with a sign of life in silence, to the end marker.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Settings
from . import FURTHER, INPUT, OUTPUT, ordered_progress, server_sent

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEEP_ALIVE = ": keep-alive\n\n"


def deliver_batch(rows: DataFrame, batch_id: int, folder: str) -> None:
    """Write a batch in its own place; the same batch again replaces itself."""
    rows.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")


def delivered(spark: SparkSession, folder: str, schema: str = OUTPUT) -> DataFrame:
    """All rows delivered so far, with the number of their ``batch``."""
    return spark.read.schema(f"{schema}, batch long").option("basePath", folder).parquet(f"{folder}/batch=*")


def run_available(out: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run a stream over what has come since its last run, deliver its batches, and wait for the end; the finished query."""
    query = out.writeStream.foreachBatch(lambda rows, batch_id: deliver_batch(rows, batch_id, folder)).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def progress_run(spark: SparkSession, inbox: str, folder: str, checkpoint: str, settings: Settings | None = None, files: int = 1000, **options) -> StreamingQuery:
    """ordered_progress() over the files of ``inbox`` (INPUT and FURTHER columns) that no earlier run with this checkpoint has read.

    Jobs do not expire by the clock between runs: an unfinished one waits for the next run.
    """
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        stream = spark.readStream.schema(f"{INPUT}, {FURTHER}").option("maxFilesPerTrigger", files).parquet(inbox)
        return run_available(ordered_progress(stream, settings, expiry_sec=None, **options), folder, checkpoint)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def follow(read: Callable[[int], list[tuple[int, str, str]]], silence_sec: float = 30.0, poll_sec: float = 1.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> Iterator[str]:
    """The event stream of one job: frames in order, a keep-alive after each ``silence_sec`` without one, the end marker last.

    read: from a sequence number on, (seq, type, frame) of the messages that are there. A message that comes early waits for
    those before it; one that comes again is not sent again.
    """
    after, last = 0, clock()
    while True:
        sent = False
        for seq, kind, frame in sorted(read(after)):
            if seq != after:
                continue  # before: sent already; behind: its turn comes later
            yield frame
            after, sent = after + 1, True
            if kind == "eof":
                return
        if sent:
            last = clock()
            continue
        if clock() - last >= silence_sec:
            yield KEEP_ALIVE
            last = clock()
        sleep(poll_sec)


def job_messages(spark: SparkSession, folder: str, job: str) -> Callable[[int], list[tuple[int, str, str]]]:
    """follow()'s reader of one job: its messages are filtered in the scan, and only those from ``after`` on leave it."""

    def read(after: int) -> list[tuple[int, str, str]]:
        rows = server_sent(delivered(spark, folder).where((F.col("job") == job) & (F.col("seq") >= after)))
        return [(r["seq"], r["type"], r["frame"]) for r in rows.select("seq", "type", "frame").distinct().collect()]

    return read


# ------------------------------------------------------------------ event time
def event_windows(stream: DataFrame, ts: str, keys: list[str], first: float, length_sec: int, stride_sec: int, delay_sec: int) -> DataFrame:
    """keys, window_start (timestamp) and n, the rows, of sliding event-time windows that begin with the stream: the first one
    of all starts at ``first`` (seconds since 1970), not at a full hour. Rows count as long as their window ends behind the
    watermark, the latest time of earlier batches less ``delay_sec``; null times belong to no window.
    """
    start = f"{int(round(first % stride_sec * 1_000_000))} microseconds"
    window = F.window(F.col(ts), f"{length_sec} seconds", f"{stride_sec} seconds", start)
    out = stream.withWatermark(ts, f"{delay_sec} seconds").groupBy(*keys, window.alias("w")).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("w.start").alias("window_start"), "n")


def late_groups(query: StreamingQuery) -> dict[int, int]:
    """Of each batch of a finished run, how many groups (keys and window) came behind the watermark and were left out."""
    out: dict[int, int] = {}
    for p in query.recentProgress:
        out[p.batchId] = out.get(p.batchId, 0) + sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
    return out


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of updates delivered in batches, the last one of each key."""
    names = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*names), "batch").alias("_u")).select(*keys, *[F.col(f"_u.{n}").alias(n) for n in names])
