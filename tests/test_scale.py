"""What goes wrong only in large tables: sketches computed twice, whole numbers over 2^53."""

import numpy as np
import pandas as pd
import pyarrow as pa

from spanloom.config import Settings
from spanloom.operators import matching as M
from spanloom.operators import sampling as B
from spanloom.operators import segments as G
from spanloom.sources import frames
from spanloom.streaming import processor
from spanloom.tables import map_groups, spread


def test_balance_computes_its_sketch_once(spark):
    """A second sketch of the same rows may have other bounds than those that were counted."""
    df = spark.range(40_000).selectExpr("if(id % 2 = 0, 'normal', 'x') AS cls", "id")
    plan = B.balance(df, "cls", 0.2, ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile_approx" not in plan and "approx_percentile" not in plan


def test_balance_by_large_numbers(spark):
    """Numbers that are one double have an order all the same."""
    base = 2**60
    df = spark.range(200).selectExpr("if(id < 100, 'normal', 'x') AS cls", f"{base} + (id * 37) % 100 AS n")
    out = B.balance(df, "cls", 0.2, ["n"])
    got = sorted(r["n"] - base for r in out.where("cls = 'normal'").collect())
    assert got == list(range(25))


def test_percentiles_are_settled_many_segments_at_a_time(spark):
    """No call into Python for each of a table's many short keys."""
    df = spark.range(400).selectExpr("id % 40 AS k", "id AS i", "cast(id % 7 AS double) AS ms")
    plan = G.running_percentiles(df, "k", ["i"], "ms", {"p50": 0.5}, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan


def test_groups_come_whole(spark):
    """Groups of one row, of a whole batch and of several batches; null and NaN are keys like others."""
    rows = [(k, None if k == 3 else float("nan") if k == 4 else 1.0, i) for k, n in ((0, 1), (1, 25), (2, 10), (3, 9), (4, 31), (5, 10), (6, 1)) for i in range(n)]

    def settle(table, edges):
        x = table["i"].to_pylist()
        own = [x[a:b] for a, b in zip(edges[:-1], edges[1:])]
        return table.select(["k"]).take(pa.array(edges[:-1])).append_column("ok", pa.array([o == list(range(len(o))) for o in own])).append_column("n", pa.array([len(o) for o in own], pa.int64()))

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        df = spark.createDataFrame(rows, "k int, x double, i int")
        got = sorted(tuple(r) for r in map_groups(df, ["k", "x"], ["i"], settle, "k int, ok boolean, n long").collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == [(k, True, n) for k, n in enumerate((1, 25, 10, 9, 31, 10, 1))]


def test_a_pass_settles_many_blocks():
    """What one block has used or awaits says nothing about the next."""
    far = 2**31 - 1
    rows = [(0, 0, 1, far, 0.9), (0, 0, 2, far, 0.8), (0, 1, 1, far, 0.7), (1, 2, 1, far, 0.6), (1, 3, 5, 0, 0.9), (1, 4, 5, far, 0.8), (2, 5, 5, far, 0.5)]
    names = ("block", "gt_ord", "pred_ord", "rival", "iou")
    table = pa.table({n: [r[i] for r in rows] for i, n in enumerate(names)}).append_column("video_id", pa.array(["v"] * 7)).append_column("class_name", pa.array(["c"] * 7))
    got = M._pass(table, np.array([0, 3, 6, 7])).to_pylist()
    assert [(r["gt_ord"], r["pred_ord"]) for r in got] == [(0, 1), (1, -1), (2, 1), (5, 5)]


def test_tasks_go_by_the_number_of_rows(spark):
    df = spark.range(1000)
    assert spread(df, "id", rows=100).rdd.getNumPartitions() == 10 and spread(df, "id", rows=1000) is df
    plan = spread(df, "id", rows=100).groupBy("id").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # what follows by this key takes the same one


def test_short_videos_share_a_task(spark, tmp_path):
    files = [(f"{i:04}.rec", 10) for i in range(9000)]
    parts = frames._dealt(files)
    assert [p for x in parts for p in x.paths] == [f for f, _ in files] and len(parts) == 64
    assert [len(x.paths) for x in frames._dealt([("a", 1 << 25), ("b", 1 << 25), ("c", 1), ("d", 1 << 40)] * 100)][:2] == [2, 1]
    frames.write_frames(spark.range(600).selectExpr("cast(id % 200 AS string) AS video_id", "id div 200 AS frame", "cast('x' AS binary) AS image"), f"file://{tmp_path}/v")
    out = spark.read.format("frames").load(f"file://{tmp_path}/v")
    assert out.rdd.getNumPartitions() == 50 and out.count() == 600


def test_the_store_is_asked_for_blocks():
    """200 chunks in two calls, odd places first, touch four blocks; one call that ends a job leaves nothing in the store."""
    asked = []

    class Store:
        def __init__(self):
            self.rows = {}

        def __getattr__(self, name):
            def call(*args):
                asked.append(name)
                if name == "updateValue":
                    self.rows[args[0]] = args[1]
                elif name == "update":
                    self.rows[None] = args[0]
                elif name == "clear":
                    self.rows.clear()
                return {"exists": bool(self.rows), "containsKey": bool(args) and args[0] in self.rows, "getValue": self.rows.get(args[0]) if args else None, "get": self.rows.get(None)}.get(name)

            return call

    def frame(order):
        return pd.DataFrame([{"job": "a", "kind": "chunk", "idx": i, "total": 200, "duration": 201.0, "probs": [0.1, 0.9], "start_sec": float(i), "end_sec": i + 2.0, "began_ms": 0.0, "ms": 1.0, "message": None} for i in order])

    own = processor(Settings(), ("normal", "fire"), None)
    own.place, own.chunks, said = Store(), Store(), []
    for order in (range(1, 200, 2), range(0, 200, 2)):
        asked.clear()
        said += [b for f in own.handleInputRows(("a",), iter([frame(order)]), None) for b in f["type"]]
        assert len(asked) <= 16
    assert said == ["meta", *["chunk"] * 200, "events", "done", "eof"] and not own.chunks.rows
