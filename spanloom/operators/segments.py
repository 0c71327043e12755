"""Long series cut into segments: places, running percentiles, and the detection chain, without a task for a whole series.

Rows get their place by range partitions of the whole table and the counts of each. A segment is a run of ``size`` places of
a key. What a segment needs of its neighbours is a few copied rows (a halo); what it needs of all before it is a summary of
one row for each segment, composed by a prefix over those rows.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Settings
from ..tables import map_groups, materialize
from .detection import long_enough, top_events


def numbered(df: DataFrame, key: str, order: list[str], out: str, total: str | None = None) -> DataFrame:
    """df with each row's place within its key, from 0 (``out``, long), and the key's rows (``total``).

    The table is range-partitioned by key and order, so a long key is spread over tasks; a row for each partition and key
    says how many rows of the key lie ahead of it. Rows that are equal in ``order`` have any order, but a lasting one, as the
    sorted table is written. Null keys are one key; an empty table gives an empty result.
    """
    place = materialize(df.repartitionByRange(F.col(key), *order).sortWithinPartitions(key, *order).withColumn("_at", F.monotonically_increasing_id()))
    rows = place.withColumn("_part", F.shiftright("_at", 33))
    parts = rows.groupBy(F.col("_part").alias("_p"), F.col(key).alias("_k")).agg(F.min("_at").alias("_from"), F.count("*").alias("_n"))
    by = W.partitionBy("_k")
    ahead = F.coalesce(F.sum("_n").over(by.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumns({"_ahead": ahead, "_sum": F.sum("_n").over(by)})
    both = rows.join(parts, (rows["_part"] == parts["_p"]) & rows[key].eqNullSafe(parts["_k"]))
    more = [parts["_sum"].alias(total)] if total else []
    return both.select(*[rows[c] for c in df.columns], (rows["_at"] - parts["_from"] + parts["_ahead"]).alias(out), *more)


# ------------------------------------------------------------------ running percentiles
def running_percentiles(calls: DataFrame, key: str, order: list[str], ms: str, quantiles: dict[str, float], size: int = 4096) -> DataFrame:
    """calls with a column for each of ``quantiles`` (name to share): the value at place floor(n * share), from 0, of the n
    sorted times so far, in order within the key.

    Rows are placed in time (segments) and by value (blocks). While a segment runs, a percentile's place moves by no more than
    the segment has rows, so its answers are rows of the segment, or rows before it whose rank there is that near the
    percentile's. Counts by segment and block say which blocks hold those; a group has a segment's rows and a few times as
    many candidates, whatever the key's length. Segments of a key of n rows have at least n^(2/3) rows, so that the counts
    are no more than the rows. Rows without a time do not count and get nulls; keys may be null; ``order`` must be total; an empty
    table gives an empty result.
    """
    names = calls.columns
    shares = list(quantiles.values())
    placed = numbered(calls.where(F.col(ms).isNotNull()), key, order, "_pos", "_all")
    placed = numbered(placed, key, [ms, "_pos"], "_rank")
    wide = F.greatest(F.lit(size), F.ceil(F.pow("_all", F.lit(2 / 3)))).cast("long")
    rows = materialize(placed.withColumn("_size", wide).withColumns({"_seg": F.floor(F.col("_pos") / F.col("_size")), "_block": F.floor(F.col("_rank") / F.col("_size")), "_key": F.struct(F.col(key))}))

    counts = rows.groupBy("_key", "_seg", "_block").agg(F.count("*").alias("n"), F.max("_size").alias("_size"), F.max("_all").alias("_all"))
    last = F.floor((F.col("_all") - 1) / F.col("_size"))
    keys = counts.groupBy("_key").agg(F.max("_size").alias("_size"), F.max("_all").alias("_all")).where(F.col("_all") > F.col("_size"))
    grid = keys.withColumn("_seg", F.explode(F.sequence(F.lit(0).cast("long"), last))).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    grid = grid.join(counts.select("_key", "_seg", "_block", "n"), ["_key", "_seg", "_block"], "left").na.fill(0, ["n"])
    earlier = grid.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("_key", "_block").orderBy("_seg").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    under = F.coalesce(F.sum("before").over(W.partitionBy("_key", "_seg").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    earlier = earlier.withColumn("under", under).where("before > 0")
    seen = F.col("_seg") * F.col("_size")
    which = F.explode(F.array(*[F.struct(F.lit(i).alias("which"), F.lit(float(q)).alias("share")) for i, q in enumerate(shares)]))
    wanted = earlier.withColumn("w", which).select("_key", F.col("_seg").alias("_for"), "_block", "under", "before", "w.*", (F.floor(seen * F.col("w.share")) - F.col("_size")).alias("low"), F.floor((seen + F.col("_size")) * F.col("w.share")).alias("high"))
    wanted = wanted.where("under + before > low AND under <= high")
    candidates = rows.select("_key", "_block", "_seg", "_rank", F.col(ms).cast("double").alias("_value")).join(wanted, ["_key", "_block"]).where(F.col("_seg") < F.col("_for"))
    candidates = candidates.select("_key", F.col("_for").alias("_seg"), "which", F.lit(None).cast("long").alias("_pos"), "_rank", "_value", "under")
    own = rows.select("_key", "_seg", F.lit(-1).alias("which"), "_pos", "_rank", F.col(ms).cast("double").alias("_value"), F.lit(0).cast("long").alias("under"))

    def settle(table: pa.Table, edges: np.ndarray) -> pa.Table:
        which, ranks, values, under, place = (table[c].to_numpy() for c in ("which", "_rank", "_value", "under", "_pos"))
        kept = which < 0
        answers: list[list[float]] = [[] for _ in shares]
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            at = a + np.searchsorted(which[a:b], range(len(shares) + 1))  # the segment's own rows, then candidates of each share
            value = dict(zip(ranks[a:b].tolist(), values[a:b].tolist(), strict=True))
            mine = list(zip(place[a : at[0]].astype(np.int64).tolist(), ranks[a : at[0]].tolist(), strict=True))
            for i, share in enumerate(shares):
                line = ranks[at[i] : at[i + 1]].tolist()
                base = int(under[at[i] : at[i + 1]].min()) if line else 0
                for pos, rank in mine:
                    bisect.insort(line, rank)
                    answers[i].append(value[line[int((pos + 1) * share) - base]])
        own = table.filter(pa.array(kept)).select(["_key", "_pos"])
        for i, found in enumerate(answers):
            own = own.append_column(f"v{i}", pa.array(found, pa.float64()))
        return own

    kind = rows.schema["_key"].dataType.simpleString()
    done = map_groups(own.unionByName(candidates), ["_key", "_seg"], ["which", "_pos", "_rank"], settle, f"_key {kind}, _pos long, " + ", ".join(f"v{i} double" for i in range(len(shares))))
    done = done.select(F.col("_key"), "_pos", *[F.col(f"v{i}").alias(n) for i, n in enumerate(quantiles)])
    timed = rows.select(*names, "_key", "_pos").join(done, ["_key", "_pos"]).select(*names, *quantiles)
    untimed = calls.where(F.col(ms).isNull()).select(*names, *[F.lit(None).cast("double").alias(n) for n in quantiles])
    return timed.unionByName(untimed)


# ------------------------------------------------------------------ the detection chain
def _with_halo(df: DataFrame, order: str, size: int, before: int, after: int) -> DataFrame:
    """df with ``_seg`` and ``_own``: each row in its segment, and copies of the rows just before and behind a segment."""
    seg = F.floor(F.col(order) / F.lit(size))
    own = F.struct(seg.alias("s"), F.lit(True).alias("own"))
    left = F.when((F.col(order) % size < after) & (seg > 0), F.struct((seg - 1).alias("s"), F.lit(False).alias("own")))
    right = F.when(F.col(order) % size >= size - before, F.struct((seg + 1).alias("s"), F.lit(False).alias("own")))
    return df.withColumn("_h", F.explode(F.array_compact(F.array(own, left, right)))).withColumns({"_seg": F.col("_h.s"), "_own": F.col("_h.own")}).drop("_h")


def _earlier(summary: DataFrame, key: str, value: Column, out: str) -> DataFrame:
    """``value`` over a key's segments before each one; a summary has a row for each segment."""
    return summary.withColumn(out, value.over(W.partitionBy(key).orderBy("_seg").rowsBetween(W.unboundedPreceding, -1)))


def smoothed_segments(chunks: DataFrame, key: str, order: str, value: str, size: int) -> DataFrame:
    """detection.center_median() of width 3 for series cut into segments of ``size`` places (3 at least)."""
    near = W.partitionBy(key, "_seg").orderBy(order)
    x, b, a = F.col(value), F.col("_b"), F.col("_a")
    out = _with_halo(chunks, order, size, 1, 1).withColumns({"_b": F.lag(value).over(near), "_a": F.lead(value).over(near), "_n": F.count("*").over(W.partitionBy(key, "_seg"))}).where("_own")
    whole = (F.col("_seg") == 0) & (F.col("_n") < 3)  # a series of under 3 rows is one segment without a halo
    median = F.when(whole, x).when(b.isNull(), (x + a) / 2).when(a.isNull(), (b + x) / 2).otherwise(F.element_at(F.sort_array(F.array(b, x, a)), 2))
    return out.withColumn("smoothed", median).drop("_b", "_a", "_n", "_own", "_seg")


def detect_segments(chunks: DataFrame, key: str, classes: list[str], settings: Settings, size: int, order: str = "chunk_idx", p_anom: str = "p_anom", probs: str = "probs") -> DataFrame:
    """detection.detect() for series cut into segments of ``size`` chunks: the same events, no window over a series' rows.

    ``order`` counts from 0 within the key (numbered() gives it), ``key`` is not null. A segment's state function is a few
    numbers: how many of its rows are under t_low, and of each stretch between those the first opening row with two sums,
    over all its rows and from that row on. An island of several segments opens at its first opening row: stretches behind
    count whole, the one that holds it from there on. Gap merging carries each segment's last event to the next.
    """
    if size < max(3, settings.t_open_chunks):
        raise ValueError("segments must be longer than the window and the opening")
    k, v = settings.t_open_chunks, F.col("smoothed")
    signal = materialize(smoothed_segments(chunks.select(key, order, "start_sec", "end_sec", p_anom, probs), key, order, p_anom, size))
    loud = signal.groupBy(key).agg(F.max("smoothed").alias("_top")).where(F.col("_top") >= settings.t_video)
    rows = _with_halo(signal.join(loud.select(key), key, "left_semi"), order, size, 0, k - 1)
    own = W.partitionBy(key, "_seg").orderBy(order)
    ahead = own.rowsBetween(0, k - 1)
    short = (F.col("_seg") == 0) & (F.count("*").over(W.partitionBy(key, "_seg")) < k)
    opens = ((F.min("smoothed").over(ahead) >= settings.t_high) & (F.count("*").over(ahead) == k)) | (short & (v >= settings.t_high))
    rows = rows.withColumns({"_opens": opens, "_low": (v < settings.t_low).cast("int")}).where("_own").withColumn("_local", F.sum("_low").over(own))
    first = F.min(F.when(F.col("_opens"), F.col(order))).over(W.partitionBy(key, "_seg", "_local"))
    rows = rows.withColumn("_first", F.when(F.col("_low") == 0, first))

    def sums(since: Column, name: str) -> list[Column]:
        kept = lambda x: F.when(since, x)
        stats = [F.min(kept(F.col("start_sec"))).alias("start"), F.max(kept(F.col("end_sec"))).alias("end"), F.max(kept(v)).alias("score")]
        votes = F.array(*[F.sum(kept(F.col(probs)[i])) for i in range(len(classes))]).alias("votes")
        return [F.struct(*stats, votes).alias(name)]

    high = F.col("_low") == 0
    pieces = rows.groupBy(key, "_seg", "_local").agg(F.sum("_low").alias("_lows"), F.min("_first").alias("_first"), *sums(high, "whole"), *sums(high & (F.col(order) >= F.col("_first")), "rest"))
    pieces = materialize(pieces)
    summary = _earlier(pieces.groupBy(key, "_seg").agg(F.sum("_lows").alias("_lows")), key, F.sum("_lows"), "_ahead")
    pieces = pieces.join(summary.select(key, "_seg", F.coalesce("_ahead", F.lit(0)).alias("_ahead")), [key, "_seg"]).withColumn("_island", F.col("_ahead") + F.col("_local"))
    opened = pieces.groupBy(key, "_island").agg(F.min("_first").alias("_open")).where("_open IS NOT NULL")
    parts = pieces.join(opened, [key, "_island"])
    at = F.floor(F.col("_open") / F.lit(size))
    parts = parts.withColumn("p", F.when(F.col("_seg") > at, F.col("whole")).when(F.col("_seg") == at, F.col("rest"))).where("p IS NOT NULL")
    votes = [F.sum(F.col("p.votes")[i]).alias(f"_s{i}") for i in range(len(classes))]
    events = parts.groupBy(key, "_island").agg(F.bround(F.min("p.start"), 2).alias("start_sec"), F.bround(F.max("p.end"), 2).alias("end_sec"), F.max("p.score").alias("score"), F.min(at).alias("_seg"), *votes)
    entries = F.array(*[F.when(F.col(f"_s{i}").isNotNull(), F.struct(F.col(f"_s{i}").alias("w"), F.lit(-i).alias("o"))) for i in range(len(classes))])
    events = events.withColumn("_best", F.array_max(F.array_compact(entries))).where("_best IS NOT NULL")
    events = events.select(key, "_seg", "start_sec", "end_sec", "score", F.element_at(F.array(*map(F.lit, classes)), 1 - F.col("_best.o")).alias("class_name"))
    merged = merge_segments(materialize(events), key, settings.merge_gap_sec)
    return top_events(long_enough(merged, settings.min_duration, settings.default_duration), key, settings.max_events)


def merge_segments(events: DataFrame, key: str, gap: float) -> DataFrame:
    """detection.merge_gaps() for events with the segment ``_seg`` that they begin in (later segments, later starts)."""
    near = W.partitionBy(key, "_seg").orderBy("start_sec", "end_sec")
    last = events.groupBy(key, "_seg").agg(F.max_by(F.struct("class_name", "end_sec"), F.struct("start_sec", "end_sec")).alias("_tail"))
    last = _earlier(last, key, F.last("_tail"), "_before").select(key, "_seg", "_before")
    mine = F.lag(F.struct("class_name", "end_sec")).over(near)
    before = F.coalesce(F.col("_mine"), F.col("_before"))
    rows = events.withColumn("_mine", mine).join(last, [key, "_seg"])
    joined = (before["class_name"] == F.col("class_name")) & (F.col("start_sec") - before["end_sec"] <= gap)
    rows = rows.withColumn("_cut", F.coalesce(~joined, F.lit(True)).cast("int")).withColumn("_local", F.sum("_cut").over(near))
    rows = materialize(rows.select(key, "_seg", "_local", "_cut", "class_name", "start_sec", "end_sec", "score"))
    ahead = _earlier(rows.groupBy(key, "_seg").agg(F.sum("_cut").alias("_cuts")), key, F.sum("_cuts"), "_ahead")
    rows = rows.join(ahead.select(key, "_seg", F.coalesce("_ahead", F.lit(0)).alias("_ahead")), [key, "_seg"]).withColumn("_group", F.col("_ahead") + F.col("_local"))
    return rows.groupBy(key, "_group").agg(F.min_by("class_name", "start_sec").alias("class_name"), F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"), F.max("score").alias("score")).drop("_group")
