"""Streams that stop and go on, batches delivered once, a client's event stream, late rows."""

import json

from spanloom.config import CLASSES
from spanloom.streaming import FURTHER, INPUT
from spanloom.streaming import delivery as S

ROW = f"{INPUT}, {FURTHER}"


def rows(job, p, order, windows=None):
    probs = lambda x: [1 - x, x, *[None] * (len(CLASSES) - 2)]
    return [(job, "chunk", i, len(p), len(p) + 1.0, probs(p[i]), float(i), i + 2.0, 10.0 * i, 5.0, None, 8 * len(p), windows) for i in order]


def test_restart_says_nothing_twice(spark, tmp_path):
    """Three runs on one checkpoint: part of a job, the rest of it and another, and nothing new."""
    p = [0.1, 0.1, 0.9, 0.9, 0.9, 0.1]
    windows = [[float(i), i + 2.0] for i in range(6)]
    parts = [rows("a", p, [4, 0, 1], windows), rows("a", p, [5, 3, 2], windows) + rows("b", [0.2, 0.2], [1, 0]), []]
    ended = []
    for part in parts:
        spark.createDataFrame(part, ROW).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        S.progress_run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check")
        out = sorted((r["job"], r["seq"], r["type"]) for r in S.delivered(spark, f"{tmp_path}/out").collect())
        ended.append(out)
    assert [(s, t) for j, s, t in ended[0]] == [(0, "meta"), (1, "chunk"), (2, "chunk")]
    assert [(s, t) for j, s, t in ended[1] if j == "a"] == [*enumerate(["meta", *["chunk"] * 6, "events", "done", "eof"])]
    assert [(s, t) for j, s, t in ended[1] if j == "b"] == [*enumerate(["meta", "chunk", "chunk", "events", "done", "eof"])]
    assert ended[2] == ended[1]
    meta = {r["job"]: json.loads(r["body"]) for r in S.delivered(spark, f"{tmp_path}/out").where("type = 'meta'").collect()}
    assert meta["a"] == {"kind": "video", "chunks": 6, "duration": 7.0, "frames": 48, "windows": windows}
    assert meta["b"] == {"kind": "video", "chunks": 2, "duration": 3.0, "frames": 16}
    frames = list(S.follow(S.job_messages(spark, f"{tmp_path}/out", "a")))
    assert len(frames) == 10 and frames[-1].startswith("event: eof") and json.loads(frames[0].removeprefix("data: "))["chunks"] == 6


def test_a_batch_again_replaces_itself(spark, tmp_path):
    one, two = (spark.createDataFrame([("j", k, "chunk", str(k)) for k in ks], "job string, seq long, type string, body string") for ks in ([0, 1], [2]))
    for batch, frame in ((0, one), (1, two), (1, two), (0, one)):  # replayed after a failure
        S.deliver_batch(frame, batch, f"{tmp_path}/out")
    got = sorted((r["batch"], r["seq"]) for r in S.delivered(spark, f"{tmp_path}/out").collect())
    assert got == [(0, 0), (0, 1), (1, 2)]


def test_follow_keeps_alive_and_ends():
    """Silence gives a sign of life every 30 seconds; messages out of turn wait, repeated ones are not sent again."""
    now = [0.0]
    there = [(0.0, (0, "meta", "m")), (5.0, (2, "chunk", "c2")), (70.0, (1, "chunk", "c1")), (70.0, (0, "meta", "m")), (75.0, (3, "eof", "end"))]

    def sleep(sec):
        now[0] += sec

    frames = []
    for f in S.follow(lambda after: [m for at, m in there if at <= now[0]], clock=lambda: now[0], sleep=sleep):
        frames.append((now[0], f))
    assert frames == [(0.0, "m"), (30.0, S.KEEP_ALIVE), (60.0, S.KEEP_ALIVE), (70.0, "c1"), (70.0, "c2"), (75.0, "end")]


def test_windows_begin_with_the_stream_and_count_late_groups(spark, tmp_path):
    from datetime import datetime, timezone

    at = lambda sec: datetime.fromtimestamp(1_700_000_003.5 + sec, timezone.utc).replace(tzinfo=None)
    stream = lambda: spark.readStream.schema("k string, t timestamp").parquet(f"{tmp_path}/in")
    late = []
    for part in ([("a", 0), ("a", 1), ("a", 12), ("b", 30)], [("a", 2), ("a", 31), ("b", 3), ("b", 25), ("b", None)], []):
        spark.createDataFrame([(k, None if s is None else at(s)) for k, s in part], "k string, t timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        done = S.run_available(S.event_windows(stream(), "t", ["k"], 1_700_000_003.5, 10, 10, 5), f"{tmp_path}/out", f"{tmp_path}/check", "update")
        late.append(sum(S.late_groups(done).values()))
    out = S.latest(S.delivered(spark, f"{tmp_path}/out", "k string, window_start timestamp, n long"), ["k", "window_start"])
    got = {(r["k"], (r["window_start"] - at(0)).total_seconds()): r["n"] for r in out.collect()}
    # the watermark is 25 s after the first part: windows that end by then take nothing more
    assert got == {("a", 0.0): 2, ("a", 10.0): 1, ("b", 30.0): 1, ("a", 30.0): 1, ("b", 20.0): 1} and late == [0, 2, 0]
