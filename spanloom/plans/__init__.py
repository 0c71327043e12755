"""Registered queries over the given tables, each beside SQL that says the same.

No table holds videos, so ``events`` stands in: a user is a video, their events in time order are its chunks (2 s long,
1 s apart), value / (value + 20) is a chunk's anomaly and event_type its class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Profile, Settings
from ..tables import spread

#: Classes of the stand-in, in ordinal order, and their least durations.
TYPES = ["click", "error", "purchase", "signup", "view"]
DURATIONS = {"click": 1.0, "error": 4.0, "purchase": 2.0, "signup": 3.0}
SETTINGS = Settings(min_duration=DURATIONS)
WINDOW = Profile(2.0, 1.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_probs(events: DataFrame) -> DataFrame:
    """Placed events (chunk_idx) as chunks: user_id, chunk_idx, start_sec, end_sec, event_type, p_anom and probs (an array by TYPES)."""
    out = events.withColumn("p_anom", F.col("value") / (F.col("value") + 20.0))
    probs = F.array(*[F.when(F.col("event_type") == t, F.col("p_anom")) for t in TYPES])
    return out.select("user_id", "chunk_idx", F.col("chunk_idx").cast("double").alias("start_sec"), (F.col("chunk_idx") + 2.0).alias("end_sec"), "event_type", "p_anom", probs.alias("probs"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as chunks, numbered in time order, in as many tasks as their number asks for."""
    e = spread(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value"), "user_id")
    return with_probs(e.withColumn("chunk_idx", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1))


# ------------------------------------------------------------------ the same in SQL
SIG = """
sig AS (SELECT user_id, event_type, value / (value + 20.0) AS p,
               row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS chunk_idx FROM events)"""
SMOOTH = (
    SIG
    + """,
near AS (SELECT *, lag(p) OVER w AS b, lead(p) OVER w AS a, count(*) OVER (PARTITION BY user_id) AS n
         FROM sig WINDOW w AS (PARTITION BY user_id ORDER BY chunk_idx)),
sm AS (SELECT user_id, chunk_idx, event_type, p,
              CASE WHEN n < 3 THEN p WHEN b IS NULL THEN (p + a) / 2 WHEN a IS NULL THEN (b + p) / 2
                   ELSE list_sort([b, p, a])[2] END AS s FROM near)"""
)


def runs_sql(k: int = 2, high: str = "0.7", low: str = "0.25", gate: str | None = None, grid: bool = False) -> str:
    """CTEs to ``runs``: rows inside runs, with run_id. grid: thresholds come from the rows of ``grid``."""
    key = "user_id" + (", t_high" if grid else "")
    source = "sm" if gate is None else f"(SELECT * FROM (SELECT *, max(s) OVER (PARTITION BY user_id) AS top FROM sm) WHERE top >= {gate})"
    if grid:
        source, high = f"(SELECT * FROM {source} CROSS JOIN grid)", "t_high"
    return f""",
isl AS (SELECT *, sum(CASE WHEN s < {low} THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY chunk_idx) AS run_id,
               (min(s) OVER f >= {high} AND count(*) OVER f = {k})
               OR (count(*) OVER (PARTITION BY {key}) < {k} AND s >= {high}) AS opens
        FROM {source} WINDOW f AS (PARTITION BY {key} ORDER BY chunk_idx ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING)),
opened AS (SELECT *, min(CASE WHEN opens THEN chunk_idx END) OVER (PARTITION BY {key}, run_id) AS first_open FROM isl),
runs AS (SELECT * FROM opened WHERE s >= {low} AND chunk_idx >= first_open)"""


def events_sql(grid: bool = False) -> str:
    key = "user_id" + (", t_high" if grid else "")
    return f""",
votes AS (SELECT {key}, run_id, event_type, sum(p) AS w FROM runs GROUP BY ALL),
cls AS (SELECT {key}, run_id, event_type AS class_name FROM votes
        QUALIFY row_number() OVER (PARTITION BY {key}, run_id ORDER BY w DESC, event_type) = 1),
spans AS (SELECT {key}, run_id, min(chunk_idx)::DOUBLE AS start_sec, max(chunk_idx) + 2.0::DOUBLE AS end_sec, max(s) AS score
          FROM runs GROUP BY ALL),
ev AS (SELECT * FROM spans JOIN cls USING ({key}, run_id))"""


def merged_sql(gap: str = "2.0", grid: bool = False) -> str:
    key = "user_id" + (", t_high" if grid else "")
    return f""",
cuts AS (SELECT *, CASE WHEN lag(class_name) OVER w = class_name AND start_sec - lag(end_sec) OVER w <= {gap} THEN 0 ELSE 1 END AS cut
         FROM ev WINDOW w AS (PARTITION BY {key} ORDER BY start_sec, end_sec)),
grp AS (SELECT *, sum(cut) OVER (PARTITION BY {key} ORDER BY start_sec, end_sec) AS g FROM cuts),
merged AS (SELECT {key}, g, min(class_name) AS class_name, min(start_sec) AS start_sec, max(end_sec) AS end_sec, max(score) AS score
           FROM grp GROUP BY ALL)"""


def final_sql(grid: bool = False) -> str:
    key = "user_id" + (", t_high" if grid else "")
    return f""",
long AS (SELECT * FROM merged WHERE end_sec - start_sec >=
         CASE class_name WHEN 'click' THEN 1.0 WHEN 'error' THEN 4.0 WHEN 'purchase' THEN 2.0 WHEN 'signup' THEN 3.0 ELSE 1.0 END),
best AS (SELECT * FROM long QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY score DESC, start_sec, class_name) <= 4),
fin AS (SELECT {key}, class_name, start_sec, end_sec, score,
               row_number() OVER (PARTITION BY {key} ORDER BY start_sec, class_name) AS event_ord FROM best)"""
