"""Series cut into segments against whole series and plain loops."""

import bisect
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spanloom.config import Settings
from spanloom.operators import detection as D
from spanloom.operators import segments as G

CLASSES = ["fire", "smoke", "crash"]
SETTINGS = Settings(min_duration={"fire": 3.0}, max_events=50)


def signal(series):
    """Chunks of {key: [(p, class)]}."""
    rows = []
    for key, values in series.items():
        for i, (p, c) in enumerate(values):
            rows.append((key, i, float(i), i + 2.0, p, [p if c == k else None for k in range(len(CLASSES))]))
    return pd.DataFrame(rows, columns=["video", "chunk_idx", "start_sec", "end_sec", "p_anom", "probs"])


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(4)
    out = {}
    for key in range(60):
        p, values = 0.2, []
        for _ in range(rng.choice([1, 2, 3, 4, 5, 31, 32, 33, 64, 150])):
            p = min(0.99, max(0.01, p + rng.choice([-0.3, -0.1, 0, 0.1, 0.35])))
            values.append((round(p, 2), rng.randrange(len(CLASSES))))
        out[key] = values
    out[60] = [(0.9, 0)] * 500  # one island through all segments
    out[61] = [(0.5, 1)] * 300 + [(0.95, 1)] * 3 + [(0.5, 2)] * 300  # opens late
    out[62] = [(0.9, k % 2) if k % 10 < 6 else (0.1, 0) for k in range(400)]
    return spark.createDataFrame(signal(out), "video int, chunk_idx long, start_sec double, end_sec double, p_anom double, probs array<double>").repartition(5).cache()


def rows_of(df):
    return sorted((r["video"], r["class_name"], r["start_sec"], r["end_sec"], round(r["score"], 9), r["event_ord"]) for r in df.collect())


@pytest.mark.parametrize("size, k", [(3, 2), (16, 2), (17, 3), (16, 1), (1000, 2)])
def test_same_events_as_whole_series(series, size, k):
    settings = Settings(min_duration={"fire": 3.0}, max_events=50, t_open_chunks=k)
    got = rows_of(G.detect_segments(series, "video", CLASSES, settings, size))
    assert got == rows_of(D.detect(series, "video", CLASSES, settings)) and len(got) > 50


def test_short_segments_and_no_rows(series):
    with pytest.raises(ValueError):
        G.detect_segments(series, "video", CLASSES, SETTINGS, 2)
    assert G.detect_segments(series.where(F.lit(False)), "video", CLASSES, SETTINGS, 16).count() == 0


def test_numbered(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, 1, 1, 1, 1, 2, 3]), rng.randrange(50), i, "x") for i in range(5000)]
    df = spark.createDataFrame(rows, "k int, t int, i int, _place string").repartition(7)
    got = {r["i"]: (r["n"], r["all"], r["_place"]) for r in G.numbered(df, "k", ["t", "i"], "n", "all").collect()}
    for key in {r[0] for r in rows}:
        own = sorted((t, i) for k, t, i, _ in rows if k == key)
        assert [got[i] for _, i in own] == [(n, len(own), "x") for n in range(len(own))]
    assert G.numbered(df.limit(0), "k", ["t"], "n").count() == 0


def running(times, share):
    line, out = [], []
    for t in times:
        bisect.insort(line, t)
        out.append(line[int(len(line) * share)])
    return out


@pytest.mark.parametrize("size", [8, 100, 4096])
def test_running_percentiles(spark, size):
    """A key of 6,000 calls with trends and ties, short keys, null keys and null times."""
    rng = np.random.default_rng(1)
    calls = [("long", i, float(np.round(i / 50 + rng.normal(0, 20), 0))) for i in range(4000)] + [("long", 4000 + i, float(rng.integers(0, 9))) for i in range(2000)]
    calls += [(k, i, float(rng.integers(0, 30))) for k in ("a", "b", None) for i in range(37)] + [("one", 0, 5.0), ("one", 1, None), ("none", 0, None)]
    df = spark.createDataFrame(calls, "k string, i int, ms double").repartition(6)
    out = G.running_percentiles(df, "k", ["i"], "ms", {"p50": 0.5, "p95": 0.95, "first": 0.0}, size)
    got = {(r["k"], r["i"]): (r["p50"], r["p95"], r["first"]) for r in out.collect()}
    assert len(got) == len(calls)
    for key in {c[0] for c in calls}:
        own = [(i, t) for k, i, t in calls if k == key and t is not None]
        want = list(zip(*(running([t for _, t in own], q) for q in (0.5, 0.95, 0.0))))
        assert [got[key, i] for i, _ in own] == want
    assert got["one", 1] == (None, None, None)
    assert G.running_percentiles(df.limit(0), "k", ["i"], "ms", {"p50": 0.5}).count() == 0
