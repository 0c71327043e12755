"""Golden cases, a state machine as reference, and plan shape."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from spanloom.config import EXPLANATIONS, Profile, Settings
from spanloom.functions import class_distribution, clock, fitted_side, letter_logs, softmax, temperature, token_letter
from spanloom.operators import detection as D
from spanloom.plans import TYPES, chunks
from spanloom.streaming import job_events, median3

CLASSES = ["fire", "smoke", "traffic_accident"]
CHUNKS = "video_id string, chunk_idx int, start_sec double, end_sec double, p_anom double, probs array<double>"


def series(video, values, cls="fire", dur=None):
    dur = dur if dur is not None else len(values) + 0.5
    k = CLASSES.index(cls)
    return [(video, i, float(i), min(i + 2.0, dur), p, [p if j == k else None for j in range(3)]) for i, p in enumerate(values)]


def detect(spark, rows, **options):
    out = D.detect(spark.createDataFrame(rows, CHUNKS), "video_id", CLASSES, Settings(**options))
    return sorted((r["video_id"], r["event_ord"], r["class_name"], r["start_sec"], r["end_sec"], r["score"]) for r in out.collect())


def test_golden_series(spark):
    rows = series("1", [0.1, 0.1, 0.9, 0.1, 0.1])
    rows += series("2", [0.1, 0.1, *[0.9] * 6, 0.1, 0.1], dur=10.5)
    rows += series("3", [0.9, 0.9], dur=2.5)
    rows += series("4a", [0.8], "traffic_accident", 1.2) + series("4b", [0.8], "fire", 1.2)
    rows += series("5", [0.9, 0.5, 0.9, 0.1, 0.1], dur=5.5)
    assert detect(spark, rows) == [("2", 1, "fire", 2.0, 9.0, 0.9), ("3", 1, "fire", 0.0, 2.5, 0.9), ("4a", 1, "traffic_accident", 0.0, 1.2, 0.8), ("5", 1, "fire", 0.0, 4.0, 0.9)]


def test_gap_merge_and_top(spark):
    rows = [("a", "A", 0.0, 3.0, 0.5), ("a", "A", 5.0, 8.0, 0.9), ("b", "A", 0.0, 3.0, 0.5), ("b", "A", 5.01, 8.0, 0.9), ("c", "A", 0.0, 3.0, 0.1), ("c", "B", 3.0, 6.0, 0.2), ("c", "A", 6.0, 9.0, 0.3)]
    df = spark.createDataFrame(rows, "video_id string, class_name string, start_sec double, end_sec double, score double")
    got = sorted((r["video_id"], r["class_name"], r["start_sec"], r["end_sec"], r["score"]) for r in D.merge_gaps(df, "video_id", 2.0).collect())
    assert got == [("a", "A", 0.0, 8.0, 0.9), ("b", "A", 0.0, 3.0, 0.5), ("b", "A", 5.01, 8.0, 0.9), ("c", "A", 0.0, 3.0, 0.1), ("c", "A", 6.0, 9.0, 0.3), ("c", "B", 3.0, 6.0, 0.2)]
    five = spark.createDataFrame([("v", "A", float(i), i + 1.0, s) for i, s in enumerate([0.8, 0.9, 0.7, 0.9, 0.95])], df.schema)
    assert sorted((r["event_ord"], r["start_sec"]) for r in D.top_events(five, "video_id", 4).collect()) == [(1, 0.0), (2, 1.0), (3, 3.0), (4, 4.0)]


def state_runs(xs, high, low, k):
    runs, i, n = [], 0, len(xs)
    while i < n:
        window = xs[i : i + k]
        if (len(window) == k and min(window) >= high) or (n < k and xs[i] >= high):
            j = i
            while j < n and xs[j] >= low:
                j += 1
            runs.append((i, j - 1))
            i = j
        else:
            i += 1
    return runs


@pytest.mark.parametrize("k", [1, 2, 3])
def test_runs_equal_a_state_machine(spark, k):
    rng = random.Random(k)
    values = [0.0, 0.1, 0.25, 0.2499, 0.5, 0.6999, 0.70, 0.8, 1.0]
    all_series = {v: [rng.choice(values) for _ in range(rng.randrange(1, 25))] for v in range(400)}
    df = spark.createDataFrame([(v, i, x) for v, xs in all_series.items() for i, x in enumerate(xs)], "video_id int, chunk_idx int, x double")
    rows = D.hysteresis(df, "video_id", "chunk_idx", "x", 0.70, 0.25, k).groupBy("video_id", "run_id").agg(F.min("chunk_idx").alias("a"), F.max("chunk_idx").alias("b")).collect()
    got = sorted((r["video_id"], r["a"], r["b"]) for r in rows)
    assert got == sorted((v, a, b) for v, xs in all_series.items() for a, b in state_runs(xs, 0.70, 0.25, k))
    with pytest.raises(ValueError):
        D.hysteresis(df, "video_id", "chunk_idx", "x", 0.2, 0.25, k)


def test_batch_equals_stream_rules(spark):
    rng = random.Random(9)
    rows, want = [], []
    for v in range(150):
        xs = [rng.choice([0.05, 0.3, 0.5, 0.72, 0.9]) for _ in range(rng.randrange(1, 40))]
        names = [rng.choice(CLASSES) for _ in xs]
        own = [(f"{v:03d}", i, float(i), i + 2.0, p, [p if c == n else None for c in CLASSES]) for i, (p, n) in enumerate(zip(xs, names))]
        rows += [(*r[:4], 1 - (1 - r[4]), r[5]) for r in own]
        events = job_events([([1 - p, *(p if c == n else None for c in CLASSES)], float(i), i + 2.0) for i, (p, n) in enumerate(zip(xs, names))], Settings(), ("normal", *CLASSES))
        want += [(f"{v:03d}", k + 1, e["class_name"], e["start_time_sec"], e["end_time_sec"], e["confidence"]) for k, e in enumerate(events)]
    assert detect(spark, rows) == sorted(want)
    assert median3([1.0, 5.0, 2.0]) == [3.0, 2.0, 3.5] and median3([4.0, 1.0]) == [4.0, 1.0]


def test_late_quiet_chunks_change_nothing_earlier(spark):
    base = series("a", [0.1, *[0.9] * 5, 0.1, 0.1], dur=100.0)
    more = series("b", [0.1, *[0.9] * 5, 0.1, 0.1, 0.05, 0.05], dur=100.0)
    got = detect(spark, base + more)
    assert [g[2:] for g in got if g[0] == "a"] == [g[2:] for g in got if g[0] == "b"]


def test_windows(spark):
    v = spark.createDataFrame([("0", 0.0), ("3", 0.3), ("57", 5.7)], "video_id string, duration_sec double")
    own = sorted((r["video_id"], r["start_sec"], r["end_sec"]) for r in D.sliding_chunks(v, Profile(2.0, 1.0)).collect())
    assert [x for x in own if x[0] != "57"] == [("0", 0.0, 0.0), ("3", 0.0, 0.3)]
    assert len([x for x in own if x[0] == "57"]) == 6 and own[-1] == ("57", 5.0, 5.7)
    assert [r["video_id"] for r in D.sliding_chunks(v, Profile(2.0, 2.0), floor=0.0).collect()] == ["57"] * 3


def test_frames_round_half_even(spark):
    row = spark.range(1).select(D.frame_indices(F.lit(0.0), F.lit(2.0), F.lit(2.0), F.lit(4), 8).alias("a"), D.frame_indices(F.lit(0.0), F.lit(2.0), F.lit(2.0), F.lit(4), 8, distinct=False).alias("b")).first()
    want = [min(max(round((j + 0.5) / 8 * 2.0 * 2.0), 0), 3) for j in range(8)]
    assert row["b"] == want and row["a"] == list(dict.fromkeys(want))


def test_tiles(spark):
    df = spark.createDataFrame([(1, 7, 9), (2, 1, 50)], "id int, h int, w int")
    got = {(r["id"], r["r"], r["c"]): (r["y0"], r["x0"], r["y1"], r["x1"]) for r in D.tile_grid(df, 2).collect()}
    assert got == {(1, 0, 0): (0, 0, 3, 4), (1, 0, 1): (0, 4, 3, 9), (1, 1, 0): (3, 0, 7, 4), (1, 1, 1): (3, 4, 7, 9), (2, 0, 0): (0, 0, 1, 50)}


def test_distributions(spark):
    df = spark.createDataFrame([([-0.1, None, -3.0],)], "x array<double>")
    row = df.select(softmax(F.col("x")).alias("p"), temperature(softmax(F.col("x")), 3.0).alias("t"), temperature(softmax(F.col("x")), None).alias("n")).first()
    z = math.exp(-0.1) + math.exp(-3.0)
    p = [math.exp(-0.1) / z, math.exp(-3.0) / z]
    t = [x ** (1 / 3) for x in p]
    assert row["p"][1] is None and [row["p"][0], row["p"][2]] == pytest.approx(p) and row["n"] == row["p"]
    assert [row["t"][0], row["t"][2]] == pytest.approx([x / sum(t) for x in t])
    tokens = spark.createDataFrame([(" a",), ("B",), ("",), (" ",), ("z",), ("\tLonely",)], "t string")
    assert [r[0] for r in tokens.select(token_letter(F.col("t"))).collect()] == ["A", "B", None, None, None, "L"]


def test_clip_vote_without_chunks(spark):
    df = spark.createDataFrame([("a", [0.2, 0.5, 0.3]), ("a", [0.1, 0.2, 0.7]), ("b", [0.9, 0.1, None]), ("t", [0.0, 0.5, 0.5])], "video_id string, probs array<double>")
    got = sorted((r["video_id"], r["class_name"]) for r in D.clip_vote(df, "video_id", ["normal", "fire", "smoke"], 0.5).collect())
    assert got == [("a", "smoke"), ("t", "fire")]


def test_small_functions(spark):
    row = spark.range(1).select(clock(F.lit(125.9)).alias("c"), fitted_side(F.lit(10), F.lit(10), F.lit(5000), 448).alias("h"), fitted_side(F.lit(900), F.lit(300), F.lit(900), 448).alias("w")).first()
    assert (row["c"], row["h"], row["w"]) == ("2:05", 28, 448)


def test_one_exchange_and_no_python(spark):
    """The whole chain shuffles once, by the series key, and stays in the JVM."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = D.detect(chunks(spark, "/root/testdata/sf0.001"), "user_id", TYPES, Settings())._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(re.findall(r"\bExchange\b", plan)) == 1 and "Python" not in plan and "Arrow" not in plan
    assert re.search(r"ReadSchema: struct<(?!.*props)", plan)


def test_reply_without_a_class_letter_is_normal(spark):
    kind = "t array<struct<token:string,logprob:double>>"
    rows = [([("A", -0.1), (" b", -2.0), ("b ", -1.0)],), ([("?", -0.1), ("z", -1.0)],), ([],), (None,)]
    got = [r["p"] for r in spark.createDataFrame(rows, kind).select(class_distribution(letter_logs(F.col("t")), 3.0).alias("p")).collect()]
    assert got[0][0] == pytest.approx(1 / (1 + math.exp(-0.3))) and got[0][1] == pytest.approx(1 - got[0][0]) and got[0][2:] == [None] * 10
    assert got[1:] == [[1.0, *[None] * 11]] * 3


def test_explanations(spark):
    df = spark.createDataFrame([(c,) for c in (*EXPLANATIONS, "normal", "other", None)], "class_name string")
    got = {r["class_name"]: r["explanation"] for r in D.explained(df).collect()}
    assert got == EXPLANATIONS | {"normal": None, "other": None, None: None} and all(20 <= len(x) <= 500 for x in EXPLANATIONS.values())


def test_window_images(spark):
    chunks = spark.createDataFrame([("v", 0, [3, 3, 1]), ("v", 1, [1, 9, 9]), ("v", 2, [8, 8, 8])], "video_id string, chunk_idx int, frame_idx array<long>")
    decoded = spark.createDataFrame([("v", 1, b"i1"), ("v", 3, b"i3"), ("v", 8, None), ("w", 9, b"no")], "video_id string, frame long, image binary")
    got = lambda least: {r["chunk_idx"]: [bytes(x) for x in r["images"]] for r in D.window_images(chunks, decoded, least=least).collect()}
    assert got(1) == {0: [b"i3", b"i3", b"i1"], 1: [b"i1"]} and got(2) == {0: [b"i3", b"i3", b"i1"]}


def test_settings_from_conf(spark):
    spark.conf.set("spark.spanloom.t_high", "0.8")
    spark.conf.set("spark.spanloom.verify_band", "[0.1, 0.9]")
    spark.conf.set("spark.spanloom.max_events", "2")
    try:
        s = Settings.from_conf(spark)
    finally:
        for k in ("t_high", "verify_band", "max_events"):
            spark.conf.unset(f"spark.spanloom.{k}")
    assert (s.t_high, s.verify_band, s.max_events, s.t_low) == (0.8, (0.1, 0.9), 2, Settings().t_low)


def test_sweep_reads_the_series_once(spark):
    """All thresholds in one pass: one shuffle by the series key, one for the totals, and one for the distinct users."""
    from spanloom.plans.detection import threshold_sweep

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = threshold_sweep(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("FileScan") == 1 and len(re.findall(r"\bExchange\b", plan)) <= 3
