"""Rules for answer sheets, overlays of several runs, and call-time statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import CLASSES
from .matching import missing


def violations(events: DataFrame, answers: DataFrame, manifest: DataFrame, runtimes: DataFrame | None = None, classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """(video_id, rule, detail), one row for each breach.

    answers: one row (video_id) per answer, so that repeats show; events: (video_id, class_name, start_sec, end_sec,
    explanation); manifest: (video_id, level); runtimes: (video_id, total_time_ms, call_count, average_time_ms). Rules:
    duplicate, unknown_video, normal_class, bad_class, level1_times, bad_start, bad_end, explanation_length,
    average_mismatch.
    """
    found = answers.groupBy("video_id").agg(F.count("*").alias("n"))
    repeats = found.where("n > 1").select("video_id", F.lit("duplicate").alias("rule"), F.explode(F.transform(F.sequence(F.lit(2).cast("long"), F.col("n")), lambda x: x.cast("string"))).alias("detail"))
    strange = missing(answers, manifest, ["video_id"]).select("video_id", F.lit("unknown_video").alias("rule"), F.lit("").alias("detail"))
    e = events.join(manifest.select("video_id", "level").dropDuplicates(["video_id"]), "video_id", "left")
    one = F.coalesce(F.col("level") == 1, F.lit(False))
    start_bad = F.col("start_sec").isNull() | (F.col("start_sec") < 0)
    rule = lambda cond, name, detail: F.when(cond, F.struct(F.lit(name).alias("rule"), detail.cast("string").alias("detail")))
    rules = F.array_compact(
        F.array(
            rule(F.col("class_name") == "normal", "normal_class", F.col("class_name")),
            rule(~F.col("class_name").isin(*classes), "bad_class", F.col("class_name")),
            rule(one & (F.col("start_sec").isNotNull() | F.col("end_sec").isNotNull()), "level1_times", F.col("class_name")),
            rule(~one & start_bad, "bad_start", F.col("class_name")),
            rule(~one & ~start_bad & (F.col("end_sec").isNull() | (F.col("end_sec") <= F.col("start_sec"))), "bad_end", F.col("class_name")),
            rule(F.col("explanation").isNotNull() & ~F.length("explanation").between(20, 500), "explanation_length", F.length("explanation")),
        )
    )
    out = repeats.unionByName(strange).unionByName(e.select("video_id", F.explode(rules).alias("r")).select("video_id", "r.rule", "r.detail"))
    if runtimes is not None:
        want = F.col("total_time_ms") / F.greatest("call_count", F.lit(1))
        off = F.abs(want - F.col("average_time_ms")) > 0.02 * F.greatest(want, F.lit(1e-9))
        out = out.unionByName(runtimes.where(off).select("video_id", F.lit("average_mismatch").alias("rule"), F.lit("").alias("detail")))
    return out


def first_violations(found: DataFrame, n: int = 40) -> DataFrame:
    """The report shows the first n only."""
    return found.orderBy("video_id", "rule", "detail").limit(n)


def passing(answers: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Answers of the sheets (``key``) without any violation: the others are not written."""
    return missing(answers, found, [key])


def overlay(log: DataFrame, key: str, run: str) -> DataFrame:
    """The latest run's answer for each key; keys that a later run does not mention keep their earlier answer."""
    newest = log.groupBy(key).agg(F.max(run).alias(run))
    return log.join(newest, [key, run])


def latency(calls: DataFrame, keys: list[str], ms: str) -> DataFrame:
    """call_count, total, average, p50, p95 (interpolated) and max of call times."""
    two = F.percentile(ms, F.array(F.lit(0.5), F.lit(0.95)))
    out = calls.groupBy(*keys).agg(F.greatest(F.count(ms), F.lit(1)).alias("call_count"), F.coalesce(F.sum(ms), F.lit(0.0)).alias("total_time_ms"), two.alias("_p"), F.coalesce(F.max(ms), F.lit(0.0)).alias("max_time_ms"))
    part = lambda i: F.coalesce(F.col("_p")[i], F.lit(0.0))
    return out.withColumns({"average_time_ms": F.col("total_time_ms") / F.col("call_count"), "p50_time_ms": part(0), "p95_time_ms": part(1)}).drop("_p")


def nearest_rank(calls: DataFrame, keys: list[str], ms: str, q: float) -> DataFrame:
    """The value at place floor(n * q), counted from 0, of the sorted times: a different percentile from latency()'s.

    Ranks come from a window over the key, so a key's times are never gathered in one array.
    """
    by = W.partitionBy(*keys)
    at = F.row_number().over(by.orderBy(ms)) - 1
    ranked = calls.where(F.col(ms).isNotNull()).withColumns({"_at": at, "_n": F.count("*").over(by)})
    return ranked.where(F.col("_at") == F.least(F.floor(F.col("_n") * F.lit(q)), F.col("_n") - 1)).select(*keys, F.col(ms).alias("value"))


def running(calls: DataFrame, key: str, order: list[str], ms: str) -> DataFrame:
    """calls with ``done``, ``mean_ms`` and ``max_ms`` so far, in order within the key."""
    w = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    done = F.count("*").over(w)
    return calls.withColumns({"done": done, "mean_ms": F.sum(ms).over(w) / done, "max_ms": F.max(ms).over(w)})


def realtime_factor(wall_ms: Column, duration_sec: Column) -> Column:
    return F.when(duration_sec > 0, F.bround(wall_ms / 1000 / duration_sec, 3))
