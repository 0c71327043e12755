"""Matching in clusters of any size against plain loops."""

import random

import numpy as np
import pytest

from spanloom.operators import matching as M

GT = "video_id string, gt_ord int, class_name string, start_sec double, end_sec double"
PR = "video_id string, pred_ord int, class_name string, start_sec double, end_sec double"


def loops(truths, preds, best, gate=0.5):
    """Truths in order, each against all predictions of its video and class."""
    out = set()
    for key in {(t[0], t[2]) for t in truths}:
        own = sorted((p for p in preds if (p[0], p[2]) == key), key=lambda p: p[1])
        if not own:
            continue
        p0, p1, free = np.array([p[3] for p in own]), np.array([p[4] for p in own]), np.ones(len(own), bool)
        for t in sorted((t for t in truths if (t[0], t[2]) == key), key=lambda t: t[1]):
            met = np.maximum(0, np.minimum(t[4], p1) - np.maximum(t[3], p0))
            iou = met / np.maximum(np.maximum(t[4], p1) - np.minimum(t[3], p0), 1e-9)
            good = np.flatnonzero(free & (iou >= gate))
            if len(good):
                k = good[np.argmax(iou[good])] if best else good[0]
                free[k] = False
                out.add((t[0], t[1], own[k][1], round(float(iou[k]), 9)))
    return out


def got(matches):
    return {(r["video_id"], r["gt_ord"], r["pred_ord"], round(r["iou"], 9)) for r in matches.collect()}


def frames(spark, truths, preds):
    return spark.createDataFrame(truths, GT).repartition(4), spark.createDataFrame(preds, PR).repartition(4)


def test_cluster_of_twenty_thousand(spark):
    """One cluster in which every interval overlaps many, orders at random; no row or task holds it."""
    rng = random.Random(6)
    place = lambda: (lambda s, n: (round(s, 2), round(s + n, 2)))(rng.uniform(0, 10_000), rng.choice([3, 5, 8, 13]) * rng.uniform(0.8, 1.2))
    truths = [("v", i, "fire", *place()) for i in range(10_000)]
    preds = [("v", i, "fire", *place()) for i in range(10_000)]
    g, p = frames(spark, truths, preds)
    assert M._clusters(g, p).select("cluster").distinct().count() == 1
    matches = got(M.match_best(g, p, rounds=True, block=5000))
    assert matches == loops(truths, preds, True) and len(matches) > 3000


@pytest.mark.parametrize("best", [True, False])
@pytest.mark.parametrize("fold, block", [(200, 50_000), (0, 7), (3, 1000)])
def test_small_clusters_and_chains(spark, best, fold, block):
    """Several videos and classes, ties, repeats of one interval, and a chain in which each choice hangs on the one before."""
    rng = random.Random(7)
    truths, preds = [], []
    for v in "abc":
        for out in (truths, preds):
            for i in range(80):
                s = rng.randrange(60)
                out.append((v, i, rng.choice(["fire", "smoke"]), float(s), float(s + rng.choice([0, 1, 2, 4, 8]))))
    truths += [("chain", i, "fire", 4.0 * i, 4.0 * i + 10) for i in range(60)] + [("none", 0, "fire", None, 4.0)]
    preds += [("chain", i, "fire", 4.0 * i + 3, 4.0 * i + 13) for i in range(60)] + [("none", 0, "fire", 0.0, 4.0)]
    g, p = frames(spark, truths, preds)
    match = M.match_best if best else M.match_first
    timed = [t for t in truths if t[3] is not None]
    assert got(match(g, p, rounds=True, fold=fold, block=block)) == loops(timed, preds, best)


@pytest.mark.parametrize("gate", [0.1, 0.5, 0.9, 1.0])
def test_cells_lose_no_pair(spark, gate):
    """Lengths over many powers of two, whose quotients lie on the levels' edges."""
    rng = random.Random(8)
    spans = [(float(s), s + 2.0**k * f) for k in range(-3, 9) for f in (1, 1.5, 2) for s in (0, 2.0**k, -(2.0**k), rng.uniform(0, 200))]
    truths, preds = [("v", i, "c", *s) for i, s in enumerate(spans)], [("v", i, "c", *s) for i, s in enumerate(spans)]
    g, p = frames(spark, truths, preds)
    want = set()
    for t in truths:
        for q in preds:
            met = min(t[4], q[4]) - max(t[3], q[3])
            if met > 0 and met / (max(t[4], q[4]) - min(t[3], q[3])) >= gate:
                want.add((t[1], q[1]))
    pairs = [(r["gt_ord"], r["pred_ord"]) for r in M.overlaps(g, p, gate).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_empty(spark):
    g, p = frames(spark, [("v", 0, "c", 0.0, 1.0)], [("v", 0, "c", 0.0, 1.0)])
    assert M.match_best(g.limit(0), p, rounds=True).count() == 0 and M.match_first(g, p.limit(0)).count() == 0


def test_points_in_events_of_any_length(spark):
    """Events from nothing to years, against loops; none spreads over more than SPREAD + 2 cells, whatever its length."""
    rng = random.Random(9)
    lengths = [0.0, 0.5, 3.0, 60.0, 64 * 2.0, 64 * 2.0 + 1, 5e3, 4e5, 3e7, 2e9]
    events = []
    for v in "ab":
        for i in range(60):
            n = rng.choice(lengths)
            s = rng.uniform(-n, 2000)
            events.append((v, i, f"c{i}", s, s + n))
    events.append(("a", 99, "inverted", 5.0, 1.0))
    points = [(v, float(t)) for v in "abc" for t in (*range(0, 2000, 13), *(e[3] for e in events[:10]), *(e[4] for e in events[:10] if e[4] < 1e6))]
    points = sorted(set(points))
    got = M.at_time(spark.createDataFrame(points, "video_id string, t double"), spark.createDataFrame(events, "video_id string, event_ord int, class_name string, start_sec double, end_sec double"), 2.0)
    want = {}
    for v, t in points:
        own = [e for e in events if e[0] == v and e[3] <= t <= e[4]]
        want[v, t] = min(own, key=lambda e: e[1])[2] if own else None
    assert {(r["video_id"], r["t"]): r["class_name"] for r in got.collect()} == want
