"""Queries of matching, scores and reports. Predictions are the final events; truths are the unmerged runs that one chunk opens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import detection as D
from ..operators import matching as M
from ..operators import quality as Q
from ..operators import segments as G
from . import SETTINGS, SMOOTH, TYPES, events_sql, final_sql, merged_sql, runs_sql, table
from .detection import smoothed

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smoothed signal that truths and predictions both start from, with the same filter, so that both read one
    shuffle; a null video never matches."""
    return smoothed(spark, sf_dir).where("user_id IS NOT NULL")


def truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = D.hysteresis(_signal(spark, sf_dir), "user_id", "chunk_idx", "smoothed", SETTINGS.t_high, SETTINGS.t_low, 1)
    e = D.run_events(runs, "user_id", "probs", "smoothed", TYPES)
    order = F.row_number().over(W.partitionBy("user_id").orderBy("start_sec", "end_sec")) - 1
    return e.select(F.col("user_id").alias("video_id"), order.cast("int").alias("gt_ord"), "class_name", "start_sec", "end_sec")


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = D.detect_smoothed(_signal(spark, sf_dir), "user_id", TYPES, SETTINGS)
    return out.select(F.col("user_id").alias("video_id"), (F.col("event_ord") - 1).cast("int").alias("pred_ord"), "class_name", "start_sec", "end_sec")


def _renamed(sql: str, pairs: list[tuple[str, str]]) -> str:
    for a, b in pairs:
        sql = sql.replace(a, b)
    return sql


GT = _renamed(runs_sql(1) + events_sql(), [("isl", "isl1"), ("opened", "opened1"), (" runs", " runs1"), (",\nruns", ",\nruns1"), ("votes", "votes1"), ("cls", "cls1"), ("spans", "spans1"), ("ev AS", "ev1 AS")])
BOTH = (
    f"{SMOOTH}{runs_sql(gate='0.65')}{events_sql()}{merged_sql()}{final_sql()}{GT}"
    """,
gt AS (SELECT user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY start_sec, end_sec) - 1 AS gt_ord, class_name, start_sec, end_sec FROM ev1),
pr AS (SELECT user_id AS video_id, event_ord - 1 AS pred_ord, class_name, start_sec, end_sec FROM fin),
pair AS (SELECT video_id, class_name, gt_ord, pred_ord, g.start_sec AS g0, g.end_sec AS g1, p.start_sec AS p0, p.end_sec AS p1,
                greatest(0.0, least(g.end_sec, p.end_sec) - greatest(g.start_sec, p.start_sec)) / (greatest(g.end_sec, p.end_sec) - least(g.start_sec, p.start_sec)) AS iou
         FROM gt g JOIN pr p USING (video_id, class_name))"""
)


def walk(order: str, where: str = "iou >= 0.5") -> str:
    """CTEs to ``m``: candidates taken one after the other if both sides are free."""
    return f""",
cand AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY {order}) AS n FROM pair WHERE {where}),
walk AS (SELECT DISTINCT video_id, 0::BIGINT AS n, []::BIGINT[] AS gs, []::BIGINT[] AS ps, false AS ok, 0::BIGINT AS gt_ord, 0::BIGINT AS pred_ord, 0.0::DOUBLE AS iou FROM cand
         UNION ALL
         SELECT w.video_id, c.n, CASE WHEN f THEN list_append(gs, c.gt_ord) ELSE gs END, CASE WHEN f THEN list_append(ps, c.pred_ord) ELSE ps END, f, c.gt_ord, c.pred_ord, c.iou
         FROM (SELECT w.*, c.n AS cn, NOT list_contains(gs, c.gt_ord) AND NOT list_contains(ps, c.pred_ord) AS f FROM walk w JOIN cand c ON c.video_id = w.video_id AND c.n = w.n + 1) w
         JOIN cand c ON c.video_id = w.video_id AND c.n = w.cn),
m AS (SELECT video_id, gt_ord, pred_ord, iou FROM walk WHERE ok)"""


BEST = f"WITH RECURSIVE {BOTH}{walk('gt_ord, iou DESC, pred_ord')}"
FIRST = f"WITH RECURSIVE {BOTH}{walk('gt_ord, pred_ord')}"


def _match(df: DataFrame) -> DataFrame:
    return df.select("video_id", F.col("gt_ord").cast("long").alias("gt_ord"), F.col("pred_ord").cast("long").alias("pred_ord"), F.round("iou", 9).alias("iou"))


@query(f"WITH {BOTH} SELECT video_id, gt_ord, pred_ord, round(iou, 9) AS iou FROM pair WHERE iou >= 0.5")
def interval_iou_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _match(M.overlaps(truths(spark, sf_dir), preds(spark, sf_dir)))


@query(f"{BEST} SELECT video_id, gt_ord, pred_ord, round(iou, 9) AS iou FROM m")
def match_greedy_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _match(M.match_best(truths(spark, sf_dir), preds(spark, sf_dir)))


@query(f"{BEST} SELECT video_id, gt_ord, pred_ord, round(iou, 9) AS iou FROM m")
def match_by_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """match_greedy_best by the way of large clusters, in blocks of 4 candidates."""
    return _match(M.match_best(truths(spark, sf_dir), preds(spark, sf_dir), rounds=True, fold=0, block=4))


@query(f"{FIRST} SELECT video_id, gt_ord, pred_ord, round(iou, 9) AS iou FROM m")
def match_first_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _match(M.match_first(truths(spark, sf_dir), preds(spark, sf_dir)))


@query(f"WITH RECURSIVE {BOTH}{walk('gt_ord, pred_ord', 'true')} SELECT video_id, gt_ord, pred_ord FROM m")
def match_untimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _match(M.match_first(truths(spark, sf_dir), preds(spark, sf_dir), timed=False)).drop("iou")


@query(
    f"""WITH {BOTH} SELECT video_id, gt_ord, pred_ord, round(iou, 9) AS iou, greatest(g0, p0) AS from_sec, least(g1, p1) AS to_sec FROM pair WHERE iou > 0
    QUALIFY row_number() OVER (PARTITION BY video_id, gt_ord ORDER BY iou DESC, pred_ord) = 1"""
)
def best_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.best_overlap(truths(spark, sf_dir), preds(spark, sf_dir))
    return out.select("video_id", F.col("gt_ord").cast("long").alias("gt_ord"), F.col("pred_ord").cast("long").alias("pred_ord"), F.round("iou", 9).alias("iou"), "from_sec", "to_sec")


@query(
    f"""WITH {BOTH}, pt AS (SELECT user_id AS video_id, chunk_idx + 0.5::DOUBLE AS t FROM sig)
    SELECT pt.video_id, t, arg_min(class_name, pred_ord) AS class_name FROM pt LEFT JOIN pr ON pr.video_id = pt.video_id AND t BETWEEN start_sec AND end_sec GROUP BY ALL"""
)
def point_in_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chunks

    points = chunks(spark, sf_dir).select(F.col("user_id").alias("video_id"), (F.col("chunk_idx") + 0.5).cast("double").alias("t"))
    return M.at_time(points, preds(spark, sf_dir).withColumnRenamed("pred_ord", "event_ord"), 16.0).select("video_id", "t", "class_name")


@query(f"{BEST} SELECT p.video_id, p.class_name, count(*) AS n FROM pr p ANTI JOIN m ON m.video_id = p.video_id AND m.pred_ord = p.pred_ord GROUP BY ALL")
def false_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, p = truths(spark, sf_dir), preds(spark, sf_dir)
    return M.unmatched(p, M.match_best(g, p)).groupBy("video_id", "class_name").agg(F.count("*").alias("n"))


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id")).distinct()


def _score_sql(a: float, s: float, t: float) -> str:
    return f"""{BEST}, v AS (SELECT DISTINCT user_id AS video_id FROM events),
    n AS (SELECT v.video_id, (SELECT count(*) FROM gt WHERE gt.video_id = v.video_id) AS n_gt, (SELECT count(*) FROM pr WHERE pr.video_id = v.video_id) AS n_pred,
                 (SELECT count(*) FROM m WHERE m.video_id = v.video_id) AS n_match, coalesce((SELECT avg(iou) FROM m WHERE m.video_id = v.video_id), 0) AS timing FROM v)
    SELECT video_id, n_gt, n_pred, n_match, round(CASE WHEN n_gt = 0 THEN CASE WHEN n_pred = 0 THEN 1.0 ELSE 0.0 END
        ELSE greatest(0.0, {a} * CASE WHEN n_pred > 0 THEN 1 ELSE 0 END + {s}::DOUBLE * n_match / n_gt + {t}::DOUBLE * timing - least((n_pred - n_match) * 0.1, 0.3)) END::DOUBLE, 9) AS score FROM n"""


def _scores(spark: SparkSession, sf_dir: str, level: int) -> DataFrame:
    out = M.video_scores(videos(spark, sf_dir), truths(spark, sf_dir), preds(spark, sf_dir), level)
    return out.withColumn("score", F.round("score", 9))


@query(_score_sql(0.30, 0.45, 0.25))
def score_level2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, 2)


@query(_score_sql(0.20, 0.40, 0.40))
def score_level3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, 3)


@query(f"SELECT count(*) AS n, round(avg(score), 8) AS mean_score FROM ({_score_sql(0.30, 0.45, 0.25)})")
def level_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.level_score(_scores(spark, sf_dir, 2)).withColumn("mean_score", F.round("mean_score", 8))


@query(
    f"""WITH {BOTH}, v AS (SELECT DISTINCT user_id AS video_id FROM events),
    t AS (SELECT video_id, coalesce((SELECT arg_min(class_name, gt_ord) FROM gt WHERE gt.video_id = v.video_id), 'normal') AS truth,
                 (SELECT arg_min(class_name, pred_ord) FROM pr WHERE pr.video_id = v.video_id) AS guess FROM v),
    a AS (SELECT count(*) AS n, avg(CASE WHEN (guess IS NOT NULL) = (truth <> 'normal') THEN 1.0 ELSE 0.0 END) AS anomaly_acc, avg(CASE WHEN coalesce(guess, 'normal') = truth THEN 1.0 ELSE 0.0 END) AS class_acc FROM t)
    SELECT n, round(anomaly_acc, 9) AS anomaly_acc, round(class_acc, 9) AS class_acc, round(0.5::DOUBLE * anomaly_acc + 0.5::DOUBLE * class_acc, 9) AS score FROM a"""
)
def score_level1(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = videos(spark, sf_dir).join(truths(spark, sf_dir), "video_id", "left")
    g = g.select("video_id", F.coalesce("gt_ord", F.lit(0)).alias("gt_ord"), F.coalesce("class_name", F.lit("normal")).alias("class_name"), F.col("gt_ord").isNotNull().alias("is_anomaly"))
    out = M.score_level1(g, preds(spark, sf_dir))
    return out.select("n", *[F.round(c, 9).alias(c) for c in ("anomaly_acc", "class_acc", "score")])


@query(
    f"""{FIRST}, n AS (SELECT (SELECT count(*) FROM m) AS tp, (SELECT count(*) FROM pr) AS np, (SELECT count(*) FROM gt) AS ng),
    r AS (SELECT tp, np - tp AS fp, ng - tp AS fn, coalesce(tp / nullif(np, 0), 0)::DOUBLE AS precision, coalesce(tp / nullif(ng, 0), 0)::DOUBLE AS recall FROM n)
    SELECT tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 9) AS f1 FROM r"""
)
def prf_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, p = truths(spark, sf_dir), preds(spark, sf_dir)
    out = M.precision_recall(g, p, M.match_first(g, p))
    return out.select("tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(
    f"""{FIRST}, u AS (SELECT g.class_name, 1 AS found, 0 AS total, 0 AS fa FROM m JOIN gt g USING (video_id, gt_ord) UNION ALL SELECT class_name, 0, 1, 0 FROM gt
    UNION ALL SELECT p.class_name, 0, 0, 1 FROM pr p ANTI JOIN m ON m.video_id = p.video_id AND m.pred_ord = p.pred_ord)
    SELECT class_name, sum(found)::BIGINT AS found, sum(total)::BIGINT AS total, sum(fa)::BIGINT AS "false" FROM u GROUP BY class_name"""
)
def per_class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, p = truths(spark, sf_dir), preds(spark, sf_dir)
    return M.per_class(g, p, M.match_first(g, p)).orderBy(F.desc("total"), "class_name")


# ------------------------------------------------------------------ labels as truth
@query(
    """WITH j AS (SELECT d.source, l.toxic, CASE WHEN d.n_chars % 7 = 0 THEN 1 ELSE 0 END AS guess FROM documents d JOIN labels l USING (doc_id)),
    n AS (SELECT source, sum(CASE WHEN toxic = 1 AND guess = 1 THEN 1 ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN toxic = 0 AND guess = 1 THEN 1 ELSE 0 END)::BIGINT AS fp, sum(CASE WHEN toxic = 1 AND guess = 0 THEN 1 ELSE 0 END)::BIGINT AS fn FROM j GROUP BY source)
    SELECT source, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0)::DOUBLE, 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0)::DOUBLE, 9) AS recall FROM n"""
)
def label_metrics_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "documents").select("doc_id", "source", (F.col("n_chars") % 7 == 0).alias("guess")).join(table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("toxic")), "doc_id")
    count = lambda cond: F.sum(cond.cast("long"))
    n = j.groupBy("source").agg(count(F.col("toxic") & F.col("guess")).alias("tp"), count(~F.col("toxic") & F.col("guess")).alias("fp"), count(F.col("toxic") & ~F.col("guess")).alias("fn"))
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0)), 9)
    return n.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})


# ------------------------------------------------------------------ call times
@query(
    """SELECT user_id, greatest(count(value), 1) AS call_count, round(sum(value), 6) AS total_time_ms, round(sum(value) / greatest(count(value), 1), 6) AS average_time_ms,
    round(quantile_cont(value, 0.5), 6) AS p50_time_ms, round(quantile_cont(value, 0.95), 6) AS p95_time_ms, max(value) AS max_time_ms FROM events GROUP BY user_id"""
)
def latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Q.latency(table(spark, sf_dir, "events"), ["user_id"], "value")
    return out.select("user_id", "call_count", *[F.round(c, 6).alias(c) for c in ("total_time_ms", "average_time_ms", "p50_time_ms", "p95_time_ms")], "max_time_ms")


@query("SELECT user_id, list_sort(list(value))[least(floor(count(*) * 0.95::DOUBLE)::BIGINT, count(*) - 1) + 1] AS value FROM events GROUP BY user_id")
def nearest_rank_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.nearest_rank(table(spark, sf_dir, "events"), ["user_id"], "value", 0.95)


@query("SELECT user_id, event_id, row_number() OVER w AS done, round(sum(value) OVER w / row_number() OVER w, 9) AS mean_ms, max(value) OVER w AS max_ms FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def running_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Q.running(table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value"), "user_id", ["ts", "event_id"], "value")
    return out.select("user_id", "event_id", "done", F.round("mean_ms", 9).alias("mean_ms"), "max_ms")


@query(
    """WITH r AS (SELECT user_id, event_id, list_sort(list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS so_far FROM events WHERE value IS NOT NULL)
    SELECT user_id, event_id, so_far[floor(len(so_far) * 0.5::DOUBLE)::BIGINT + 1] AS p50_ms, so_far[floor(len(so_far) * 0.95::DOUBLE)::BIGINT + 1] AS p95_ms FROM r
    UNION ALL SELECT user_id, event_id, NULL, NULL FROM events WHERE value IS NULL"""
)
def running_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles after each call, by segments of 16 calls or more (the library's default is 4,096)."""
    calls = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    return G.running_percentiles(calls, "user_id", ["ts", "event_id"], "value", {"p50_ms": 0.5, "p95_ms": 0.95}, 16).select("user_id", "event_id", "p50_ms", "p95_ms")


@query("SELECT user_id, CASE WHEN count(*) > 0 THEN round_even(sum(value) / 1000 / count(*), 3) END AS rtf FROM events GROUP BY user_id")
def realtime_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum("value").alias("ms"), F.count("*").alias("n")).select("user_id", Q.realtime_factor(F.col("ms"), F.col("n").cast("double")).alias("rtf"))
