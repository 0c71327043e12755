"""Queries that run a stream over the events, with a stop in between, and read what it has delivered."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import delivery as S
from ..tables import shared_folder
from . import SETTINGS, SMOOTH, TYPES, chunks, events_sql, final_sql, merged_sql, runs_sql, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def job_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks as input rows of the progress stream: a user is a job."""
    c = chunks(spark, sf_dir).where("user_id IS NOT NULL")
    total = c.groupBy("user_id").agg(F.count("*").alias("total"))
    probs = F.concat(F.array(1 - F.col("p_anom")), "probs")
    rows = c.join(total, "user_id").select(F.col("user_id").cast("string").alias("job"), F.lit("chunk").alias("kind"), F.col("chunk_idx").cast("long").alias("idx"), "total", (F.col("total") + 1.0).alias("duration"), probs.alias("probs"), "start_sec", "end_sec")
    calls = {"began_ms": F.col("start_sec") * 1000, "ms": F.lit(100.0), "message": F.lit(None).cast("string"), "frames": F.col("total") * 8, "windows": F.lit(None).cast("array<array<double>>")}
    return rows.withColumns(calls)


@query(f"WITH {SMOOTH}{runs_sql(gate='0.65')}{events_sql()}{merged_sql()}{final_sql()} SELECT user_id, class_name, start_sec, end_sec, round(score, 4) AS score, event_ord FROM fin WHERE user_id IS NOT NULL")
def events_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The final events from the progress stream, run twice: chunks of odd and of even numbers come before and after a stop."""
    folder = f"{shared_folder(spark)}/spanloom-stream-{uuid.uuid4().hex}"
    rows = job_rows(spark, sf_dir)
    for half in (1, 0):
        rows.where(F.col("idx") % 2 == half).write.mode("append").parquet(f"{folder}/in")
        S.progress_run(spark, f"{folder}/in", f"{folder}/out", f"{folder}/check", SETTINGS, classes=("normal", *TYPES))
    kind = "struct<events:array<struct<class_name:string,start_time_sec:double,end_time_sec:double,confidence:double>>>"
    found = S.delivered(spark, f"{folder}/out").where("type = 'events'").select("job", F.posexplode(F.from_json("body", kind)["events"]).alias("at", "e"))
    return found.select(F.col("job").cast("long").alias("user_id"), "e.class_name", F.col("e.start_time_sec").alias("start_sec"), F.col("e.end_time_sec").alias("end_sec"), F.round("e.confidence", 4).alias("score"), (F.col("at") + 1).cast("long").alias("event_ord"))


#: Days of a window and of its stride, and of the watermark's delay; every tenth event comes a fifth of the time late, in the last batch.
LENGTH, STRIDE, DELAY, BATCHES = 2 * 86_400, 86_400, 86_400, 4
BATCH = f"CASE WHEN event_id % 10 = 0 THEN {BATCHES - 1} ELSE least({BATCHES - 1}, floor((epoch - first) / (last - first) * {BATCHES})) END"
WINDOWS = f"""WITH t AS (SELECT user_id, event_id, epoch_us(ts) / 1000000.0::DOUBLE AS epoch, epoch_us(ts) AS us FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL),
    b AS (SELECT *, {BATCH}::INT AS batch, min(us) OVER () AS us0 FROM (SELECT *, min(epoch) OVER () AS first, max(epoch) OVER () AS last FROM t)),
    m AS (SELECT batch, coalesce(max(max(us)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) // 1000 * 1000 - {DELAY * 1_000_000}, 0) AS mark FROM b GROUP BY batch),
    w AS (SELECT user_id, batch, mark, us0 + ((us - us0) // {STRIDE * 1_000_000} - k) * {STRIDE * 1_000_000} AS start FROM b JOIN m USING (batch), unnest([0, 1]) AS u(k)),
    g AS (SELECT user_id, batch, start, start + {LENGTH * 1_000_000} <= mark AS late, count(*) AS n FROM w GROUP BY ALL)"""


def _windows(spark: SparkSession, sf_dir: str) -> tuple[str, dict[int, int]]:
    """Where the updates of the windowed stream are delivered, and the late groups of each batch."""
    folder = f"{shared_folder(spark)}/spanloom-stream-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events").where("ts IS NOT NULL AND user_id IS NOT NULL").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    e = e.withColumn("epoch", F.unix_micros("ts") / F.lit(1e6))
    first, last = e.agg(F.min("epoch"), F.max("epoch")).first()
    batch = F.when(F.col("event_id") % 10 == 0, BATCHES - 1).otherwise(F.least(F.lit(BATCHES - 1), F.floor((F.col("epoch") - first) / F.lit((last or 0) - (first or 0)) * BATCHES)))
    late: dict[int, int] = {}
    for k in range(BATCHES):
        e.where(batch == k).select("user_id", "ts").write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema("user_id long, ts timestamp").parquet(f"{folder}/in")
        done = S.run_available(S.event_windows(stream, "ts", ["user_id"], first or 0.0, LENGTH, STRIDE, DELAY), f"{folder}/out", f"{folder}/check", "update")
        late |= {k: sum(S.late_groups(done).values())}
    return folder, late


@query(f"{WINDOWS} SELECT user_id, make_timestamp(start::BIGINT) AS window_start, sum(n)::BIGINT AS n FROM g WHERE NOT late GROUP BY ALL")
def windows_on_event_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of two days from the first event on, one each day, from a stream of four runs with late rows in the last."""
    folder, _ = _windows(spark, sf_dir)
    out = S.latest(S.delivered(spark, f"{folder}/out", "user_id long, window_start timestamp, n long"), ["user_id", "window_start"])
    return out.select("user_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


@query(f"{WINDOWS} SELECT batch::BIGINT AS batch, count(*) FILTER (late)::BIGINT AS late FROM g GROUP BY batch")
def windows_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many groups of each run came behind the watermark."""
    _, late = _windows(spark, sf_dir)
    return spark.createDataFrame(sorted(late.items()), "batch long, late long")
