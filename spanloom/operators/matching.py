"""Matching intervals by overlap, scores, and event-level precision and recall.

Truths: (video_id, gt_ord, class_name, start_sec, end_sec); predictions: (video_id, pred_ord, class_name, start_sec,
end_sec). Orders count from 0 within a video.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import iou, let
from ..tables import discard, map_groups, materialize
from .segments import numbered

GATE = 0.5


def _clusters(truths: DataFrame, preds: DataFrame) -> DataFrame:
    """Both sides in one frame (video_id, class_name, is_truth, ord, start_sec, end_sec, cluster).

    Intervals of one video and class fall into clusters between which nothing overlaps: a new one begins where a start
    lies behind all ends before it. Null, empty and inverted intervals overlap nothing and are left out.
    """
    own = ["video_id", "class_name"]
    side = lambda df, order, truth: df.select(*own, F.lit(truth).alias("is_truth"), F.col(order).cast("int").alias("ord"), "start_sec", "end_sec")
    both = side(truths, "gt_ord", True).unionByName(side(preds, "pred_ord", False)).where("start_sec < end_sec")
    near = Window.partitionBy(*own).orderBy("start_sec", "end_sec")
    reach = F.max("end_sec").over(near.rowsBetween(Window.unboundedPreceding, -1))
    cut = F.coalesce((F.col("start_sec") >= reach).cast("int"), F.lit(0))
    return both.withColumn("_cut", cut).withColumn("cluster", F.sum("_cut").over(near)).drop("_cut")


def _cells(both: DataFrame, gate: float) -> tuple[DataFrame, DataFrame]:
    """Truths and predictions (with their ends as g0, g1 and p0, p1) with the ``level`` and ``cell`` in which they meet.

    Two intervals whose IoU reaches the gate differ in length by 1 / gate at most. A level holds lengths up to ``base``
    times its least, so their levels are neighbours. A truth has the cell of its start, in cells as long as its level's
    intervals; a prediction goes to the few cells of three levels in which a truth could begin, whatever its length.
    """
    own = ["video_id", "class_name", "cluster"]
    base = max(2.0, 1 / gate) * 1.001  # so that rounding cannot part levels
    level = F.floor(F.log(F.col("end_sec") - F.col("start_sec")) / F.log(F.lit(base)))
    length = lambda at: F.pow(F.lit(base), at + 1)
    g = both.where("is_truth").withColumn("level", level).withColumn("cell", F.floor(F.col("start_sec") / length(F.col("level"))))
    p = both.where("NOT is_truth").withColumn("level", F.explode(F.sequence(level - 1, level + 1)))
    first, last = (F.floor(F.col("start_sec") / length(F.col("level"))) - 1, F.floor(F.col("end_sec") / length(F.col("level"))))
    p = p.withColumn("cell", F.explode(F.sequence(first, last)))
    return tuple(df.select(*own, "level", "cell", F.col("ord").alias(f"{name}_ord"), F.col("start_sec").alias(f"{side}0"), F.col("end_sec").alias(f"{side}1")) for df, name, side in ((g, "gt", "g"), (p, "pred", "p")))


def overlaps(truths: DataFrame, preds: DataFrame, gate: float | None = GATE) -> DataFrame:
    """Pairs of one video and class with their IoU, at least ``gate`` (None: over 0), and their ``cluster``.

    An equi join, so a long series is no quadratic join: on (video, class, cluster) and, with a gate, on cells of like
    length and place, so that neither is a large cluster. Both sides share one shuffle.
    """
    both = _clusters(truths, preds)
    own = ["video_id", "class_name", "cluster"]
    if gate:
        g, p = _cells(both, gate)
        pairs = g.join(p, [*own, "level", "cell"]).drop("level", "cell")
    else:
        g = both.where("is_truth").select(*own, F.col("ord").alias("gt_ord"), F.col("start_sec").alias("g0"), F.col("end_sec").alias("g1"))
        p = both.where("NOT is_truth").select(*own, F.col("ord").alias("pred_ord"), F.col("start_sec").alias("p0"), F.col("end_sec").alias("p1"))
        pairs = g.join(p, own)
    out = pairs.withColumn("iou", iou(F.col("g0"), F.col("g1"), F.col("p0"), F.col("p1")))
    return out.where(F.col("iou") > 0 if gate is None else F.col("iou") >= gate)


#: Candidates of a cluster that are folded in one row, and of a block of a larger cluster.
FOLD, BLOCK = 200, 50_000


def _taken(candidates: Column) -> Column:
    """Sorted candidates (g, o, p, iou) taken one after the other if neither side is taken yet.

    The order begins with the truth, so of the truths only the last one taken is kept in mind.
    """
    kind = "struct<g:int,used:array<int>,taken:array<struct<g:int,p:int,iou:double>>>"
    zero = F.struct(F.lit(-1).alias("g"), F.array().alias("used"), F.array().alias("taken")).cast(kind)

    def take(acc: Column, c: Column) -> Column:
        free = (acc["g"] != c["g"]) & ~F.array_contains(acc["used"], c["p"])
        one = F.struct(c["g"].alias("g"), c["p"].alias("p"), c["iou"].alias("iou"))
        more = F.struct(c["g"].alias("g"), F.concat(acc["used"], F.array(c["p"])).alias("used"), F.concat(acc["taken"], F.array(one)).alias("taken")).cast(kind)
        return F.when(free, more).otherwise(acc)

    return F.aggregate(candidates, zero, take, lambda acc: acc["taken"])


def _unfolded(rows: DataFrame) -> DataFrame:
    taken = rows.select("video_id", "class_name", F.explode(_taken(F.col("c"))).alias("t"))
    return taken.select("video_id", "class_name", F.col("t.g").alias("gt_ord"), F.col("t.p").alias("pred_ord"), F.col("t.iou").alias("iou"))


def _fold(pairs: DataFrame) -> DataFrame:
    """Pairs taken in order (truth, ``_o``, prediction), cluster by cluster in one row each."""
    order = F.struct(F.col("gt_ord").alias("g"), F.col("_o").alias("o"), F.col("pred_ord").alias("p"), F.col("iou").alias("iou"))
    return _unfolded(pairs.groupBy("video_id", "class_name", "cluster").agg(F.sort_array(F.collect_list(order)).alias("c")))


def _fold_clusters(truths: DataFrame, preds: DataFrame, gate: float, best: bool) -> DataFrame:
    """The same from the intervals themselves: a cluster's two sides are gathered once and paired within their row, so
    neither side is computed again for a join."""
    side = lambda truth: F.collect_list(F.when(F.col("is_truth") == truth, F.struct("ord", "start_sec", "end_sec")))
    rows = _clusters(truths, preds).groupBy("video_id", "class_name", "cluster").agg(side(True).alias("g"), side(False).alias("p"))

    def pair(g: Column, p: Column) -> Column:
        own = iou(g["start_sec"], g["end_sec"], p["start_sec"], p["end_sec"])
        return let(own, lambda x: F.struct(g["ord"].alias("g"), (-x if best else F.lit(0.0)).alias("o"), p["ord"].alias("p"), x.alias("iou")))

    near = lambda g: F.filter("p", lambda p: (p["start_sec"] < g["end_sec"]) & (p["end_sec"] > g["start_sec"]))
    every = F.flatten(F.transform("g", lambda g: F.filter(F.transform(near(g), lambda p: pair(g, p)), lambda c: c["iou"] >= gate)))
    return _unfolded(rows.where((F.size("g") > 0) & (F.size("p") > 0)).select("video_id", "class_name", F.sort_array(every).alias("c")))


def _pass(table: pa.Table, edges: np.ndarray) -> pa.Table:
    """What is sure in each block: truths in order, each with its best free prediction, unless an earlier truth may want that.

    ``rival``: the earliest open truth of other blocks that the prediction is a candidate of. A truth that must wait may
    take any of its candidates later, so later truths wait for those, too. Settled truths come out, -1 for no prediction.
    """
    truths, preds, rivals, ious = (table[c].to_pylist() for c in ("gt_ord", "pred_ord", "rival", "iou"))
    rows: list[int] = []
    out: list[tuple[int, float]] = []
    for at, stop in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        used: set[int] = set()
        awaited: set[int] = set()
        while at < stop:
            end = at
            while end < stop and truths[end] == truths[at]:
                end += 1
            best = next((k for k in range(at, end) if preds[k] not in used), None)
            if best is None:
                rows.append(at)
                out.append((-1, 0.0))
            elif preds[best] in awaited or rivals[best] < truths[at]:
                awaited.update(preds[k] for k in range(at, end) if preds[k] not in used)
            else:
                used.add(preds[best])
                rows.append(at)
                out.append((preds[best], ious[best]))
            at = end
    made = table.select(["video_id", "class_name", "gt_ord"]).take(pa.array(rows, pa.int64()))
    return made.append_column("pred_ord", pa.array([p for p, _ in out], pa.int32())).append_column("iou", pa.array([x for _, x in out], pa.float64()))


def _rounds(pairs: DataFrame, block: int) -> DataFrame:
    """The same for clusters of any size: blocks of about ``block`` candidates settle what they can, round by round.

    A block holds truths that are near in time, with all their candidates. A truth can settle when no earlier open truth
    wants its best free prediction, so the earliest open truth of a cluster always does, and a chain of dependent truths
    goes through a whole block in one round.
    """
    own = ["video_id", "class_name", "cluster"]
    rows = numbered(pairs.withColumn("_key", F.struct(*own)), "_key", ["g0", "gt_ord", "pred_ord"], "_place")
    least = F.min("_place").over(Window.partitionBy("video_id", "gt_ord"))
    rows = materialize(rows.withColumn("_block", F.floor(least / F.lit(block))).select(*own, "_block", "gt_ord", "pred_ord", "iou", "_o"))
    settled = []
    while True:
        pred = ["video_id", "pred_ord"]
        wants = rows.groupBy(*pred, "_block").agg(F.min("gt_ord").alias("w"))
        first = wants.groupBy(*pred).agg(F.min(F.struct("w", "_block")).alias("a"))
        second = wants.join(first, pred).where(F.col("_block") != F.col("a._block")).groupBy(*pred).agg(F.min("w").alias("b"))
        rival = first.join(second, pred, "left").select(*pred, "a", "b")
        far = F.lit(2**31 - 1)
        asked = rows.join(rival, pred).withColumn("rival", F.coalesce(F.when(F.col("a._block") != F.col("_block"), F.col("a.w")).otherwise(F.col("b")), far)).drop("a", "b")
        kind = rows.schema["video_id"].dataType.simpleString()
        done = materialize(map_groups(asked, [*own, "_block"], ["gt_ord", "_o", "pred_ord"], _pass, f"video_id {kind}, class_name string, gt_ord int, pred_ord int, iou double"))
        settled.append(done)
        left = missing(missing(rows, done, ["video_id", "gt_ord"]), done.where("pred_ord >= 0"), pred)
        rows, before = materialize(left), rows
        discard(before)
        if rows.isEmpty():
            discard(rows)
            return reduce(DataFrame.unionByName, settled).where("pred_ord >= 0")


def _greedy(truths: DataFrame, preds: DataFrame, gate: float, best: bool, rounds: bool, fold: int, block: int) -> DataFrame:
    """Truths in order take a free prediction: the one of greatest IoU (``best``), else the first; ties: the first.

    Each cluster is folded in a row, and nothing runs until the result is read. With ``rounds``, the candidates are written
    once, clusters of up to ``fold`` of them are folded, and larger ones go by rounds.
    """
    if not rounds:
        return _fold_clusters(truths, preds, gate, best)
    own = ["video_id", "class_name", "cluster"]
    columns = [F.col("gt_ord").cast("int").alias("gt_ord"), F.col("pred_ord").cast("int").alias("pred_ord"), "iou", (-F.col("iou") if best else F.lit(0.0)).alias("_o"), "g0"]
    pairs = materialize(overlaps(truths, preds, gate).select(*own, *columns))
    large = pairs.groupBy(*own).agg(F.count("*").alias("n")).where(F.col("n") > fold).select(*own)
    if large.isEmpty():
        return _fold(pairs)
    return _fold(missing(pairs, large, own)).unionByName(_rounds(existing(pairs, large, own), block))


def match_best(truths: DataFrame, preds: DataFrame, gate: float = GATE, rounds: bool = False, fold: int = FOLD, block: int = BLOCK) -> DataFrame:
    """Truths in order take their unused prediction of greatest IoU (ties: the first). rounds: for series in which thousands of
    intervals overlap each other in one cluster, so that none is a row."""
    return _greedy(truths, preds, gate, True, rounds, fold, block)


def match_first(truths: DataFrame, preds: DataFrame, gate: float = GATE, timed: bool = True, rounds: bool = False, fold: int = FOLD, block: int = BLOCK) -> DataFrame:
    """Truths in order take the first unused prediction over the gate; untimed: the class alone decides, so the n-th truth
    of a class takes its n-th prediction."""
    if not timed:
        own = ["video_id", "class_name"]
        g = truths.select(*own, F.col("gt_ord").cast("int").alias("gt_ord"), F.row_number().over(Window.partitionBy(*own).orderBy("gt_ord")).alias("_turn"))
        p = preds.select(*own, F.col("pred_ord").cast("int").alias("pred_ord"), F.row_number().over(Window.partitionBy(*own).orderBy("pred_ord")).alias("_turn"))
        return g.join(p, [*own, "_turn"]).select("video_id", "class_name", "gt_ord", "pred_ord", F.lit(None).cast("double").alias("iou"))
    return _greedy(truths, preds, gate, False, rounds, fold, block)


def unmatched(preds: DataFrame, matches: DataFrame) -> DataFrame:
    """Predictions that nothing matched: false alarms and fragments."""
    return missing(preds, matches, ["video_id", "pred_ord"])


#: Cells that an event may spread over before it goes to cells SPREAD times as long, and how many such levels there are.
SPREAD, LEVELS = 64, 5


def at_time(points: DataFrame, events: DataFrame, cell: float = 60.0) -> DataFrame:
    """points (video_id, t) with the first event (by event_ord) active at t, ends included; points without one stay.

    Both sides meet in cells of ``cell`` seconds, so that a long series is no quadratic join. An event over more than SPREAD
    of them goes to longer cells, level by level, and for those events alone each point goes to one cell of every level.
    """
    size = lambda level: F.lit(cell) * F.pow(F.lit(float(SPREAD)), level)
    at = lambda c, level: F.floor(F.col(c) / size(level)).cast("long")
    over = F.log(F.greatest(F.col("end_sec") - F.col("start_sec"), F.lit(cell)) / F.lit(cell * SPREAD)) / F.log(F.lit(float(SPREAD)))
    level = F.least(F.greatest(F.ceil(over), F.lit(0)), F.lit(LEVELS - 1)).cast("int")
    e = events.where("start_sec <= end_sec").select("video_id", "event_ord", "class_name", "start_sec", "end_sec", level.alias("_level"))
    e = e.withColumn("_cell", F.explode(F.sequence(at("start_sec", F.col("_level")), at("end_sec", F.col("_level")))))
    active = F.col("t").between(F.col("start_sec"), F.col("end_sec"))
    near = points.withColumn("_cell", at("t", F.lit(0))).join(e.where("_level = 0").drop("_level"), ["video_id", "_cell"]).where(active)
    levels = points.withColumn("_level", F.explode(F.array(*map(F.lit, range(1, LEVELS)))))
    far = levels.withColumn("_cell", at("t", F.col("_level"))).join(e.where("_level > 0"), ["video_id", "_level", "_cell"]).where(active)
    hits = near.select("video_id", "t", "class_name", "event_ord").unionByName(far.select("video_id", "t", "class_name", "event_ord"))
    first = hits.groupBy("video_id", "t").agg(F.min_by("class_name", "event_ord").alias("class_name"), F.min("event_ord").alias("event_ord"))
    return points.join(first, ["video_id", "t"], "left")


def best_overlap(truths: DataFrame, preds: DataFrame) -> DataFrame:
    """For each truth its prediction of greatest IoU over 0 (ties: the first) and the shared segment; predictions may serve several."""
    pairs = overlaps(truths, preds, None)
    best = pairs.groupBy("video_id", "gt_ord").agg(F.max_by(F.struct("pred_ord", "iou", F.greatest("g0", "p0").alias("from_sec"), F.least("g1", "p1").alias("to_sec")), F.struct(F.col("iou"), -F.col("pred_ord"))).alias("b"))
    return best.select("video_id", "gt_ord", "b.*")


# ------------------------------------------------------------------ lookups
def left_default(left: DataFrame, right: DataFrame, on: list[str], defaults: dict) -> DataFrame:
    """left with right's columns; where right has no row (and where it is null), the defaults."""
    return left.join(right, on, "left").withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def existing(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of left whose key right holds."""
    return left.join(right.select(*on), on, "left_semi")


def missing(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of left whose key right does not hold."""
    return left.join(right.select(*on), on, "left_anti")


# ------------------------------------------------------------------ scores
# Weights of alert, matched share and timing; the fragment penalty and its limit.
WEIGHTS = {2: (0.30, 0.45, 0.25), 3: (0.20, 0.40, 0.40)}
PENALTY, PENALTY_MAX = 0.1, 0.3


def score_level1(truths: DataFrame, preds: DataFrame) -> DataFrame:
    """One row n, anomaly_acc, class_acc, score; a video's first truth (video_id, gt_ord, class_name, is_anomaly) against its first prediction.

    No truths: one row with n 0 and nulls.
    """
    g = truths.groupBy("video_id").agg(F.min_by(F.struct("class_name", "is_anomaly"), "gt_ord").alias("g"))
    p = preds.groupBy("video_id").agg(F.min_by("class_name", "pred_ord").alias("p"))
    both = g.join(p, "video_id", "left")
    anomaly = (F.col("p").isNotNull() == F.col("g.is_anomaly")).cast("double")
    named = (F.coalesce("p", F.lit("normal")) == F.col("g.class_name")).cast("double")
    out = both.agg(F.count("*").alias("n"), F.avg(anomaly).alias("anomaly_acc"), F.avg(named).alias("class_acc"))
    return out.withColumn("score", 0.5 * F.col("anomaly_acc") + 0.5 * F.col("class_acc"))


def video_scores(videos: DataFrame, truths: DataFrame, preds: DataFrame, level: int, matches: DataFrame | None = None) -> DataFrame:
    """video_id, n_gt, n_pred, n_match, score for each of ``videos``; truths hold only anomalous events."""
    matches = match_best(truths, preds) if matches is None else matches
    g = truths.groupBy("video_id").agg(F.count("*").alias("n_gt"))
    p = preds.groupBy("video_id").agg(F.count("*").alias("n_pred"))
    m = matches.groupBy("video_id").agg(F.count("*").alias("n_match"), F.avg("iou").alias("timing"))
    out = videos.select("video_id").distinct().join(g, "video_id", "left").join(p, "video_id", "left").join(m, "video_id", "left").na.fill(0)
    alert, share, time = WEIGHTS.get(level, WEIGHTS[2])
    raw = alert * (F.col("n_pred") > 0).cast("double") + share * F.col("n_match") / F.col("n_gt") + time * F.col("timing")
    loss = F.least((F.col("n_pred") - F.col("n_match")) * PENALTY, F.lit(PENALTY_MAX))
    silent = (F.col("n_pred") == 0).cast("double")
    return out.select("video_id", "n_gt", "n_pred", "n_match", F.when(F.col("n_gt") == 0, silent).otherwise(F.greatest(F.lit(0.0), raw - loss)).alias("score"))


def level_score(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"))


def precision_recall(truths: DataFrame, preds: DataFrame, matches: DataFrame) -> DataFrame:
    """One row tp, fp, fn, precision, recall, f1; ratios over nothing are 0."""
    tagged = matches.select(F.lit("m").alias("k")).unionByName(truths.select(F.lit("g").alias("k"))).unionByName(preds.select(F.lit("p").alias("k")))
    n = tagged.agg(*[F.coalesce(F.sum((F.col("k") == x).cast("long")), F.lit(0)).alias(x) for x in "mgp"])
    out = n.select(F.col("m").alias("tp"), (F.col("p") - F.col("m")).alias("fp"), (F.col("g") - F.col("m")).alias("fn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    out = out.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def per_class(truths: DataFrame, preds: DataFrame, matches: DataFrame) -> DataFrame:
    """class_name, found, total, false: matches, truths, and predictions that nothing matched.

    A match has one class and uses up one truth and one prediction, so counts by class say it all, without a join of rows.
    """
    count = lambda df, *own: df.groupBy("class_name").agg(F.count("*").alias("_n")).select("class_name", *[(F.lit(x) * F.col("_n")).alias(n) for n, x in zip(("found", "total", "false"), own, strict=True)])
    every = count(matches, 1, 0, -1).unionByName(count(truths, 0, 1, 0)).unionByName(count(preds, 0, 0, 1))
    return every.groupBy("class_name").agg(*[F.sum(c).alias(c) for c in ("found", "total", "false")])
