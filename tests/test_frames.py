"""Frame files: what the cursor reads, filters that reach it, and writes that leave nothing behind."""

import io
import os

import pytest
from pyspark.sql import functions as F

from spanloom.sources import frames as S


def packed(images, fps=25.0):
    return S.HEAD.pack(S.MARK, fps, len(images)) + b"".join(S.LENGTH.pack(len(x)) + x for x in images)


def test_cursor_reads_only_what_is_wanted():
    images = [bytes([i]) * i for i in range(50)]
    cursor = S.Cursor(io.BytesIO(packed(images)))
    assert list(cursor.wanted(iter([3, 4, 20]))) == [(i, images[i]) for i in (3, 4, 20)]
    assert (cursor.retrieved, cursor.grabbed) == (3, 18) and cursor.at == 21  # nothing behind the last wanted one
    assert list(cursor.wanted(iter([5, 22, 99]))) == [(22, images[22])] and cursor.retrieved == 4
    short = S.Cursor(io.BytesIO(packed(images)[:-7]))
    assert [n for n, _ in short.wanted(iter([47, 48, 49]))] == [47, 48]
    with pytest.raises(ValueError):
        S.Cursor(io.BytesIO(b"junk"))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("frames"))
    rows = [(v, i, f"{v}-{i}".encode()) for v, n in (("a", 40), ("b/1 ü", 7), ("c", 1)) for i in range(n)]
    S.write_frames(spark.createDataFrame([*rows, (None, 0, b"x")], "video_id string, frame long, image binary").repartition(3), f"file://{out}/videos")
    return f"file://{out}/videos"


def test_names_and_contents(spark, folder):
    assert sorted(os.listdir(folder.removeprefix("file://"))) == sorted(S.file_name(v) for v in ("a", "b/1 ü", "c"))
    got = {(r["video_id"], r["frame"]): bytes(r["image"]) for r in spark.read.format("frames").load(folder).collect()}
    assert got == {(v, i): f"{v}-{i}".encode() for v, n in (("a", 40), ("b/1 ü", 7), ("c", 1)) for i in range(n)}
    assert sorted(tuple(r) for r in S.probe(spark, folder).collect()) == [("a", 25.0, 40, 1.6), ("b/1 ü", 25.0, 7, 0.28), ("c", 25.0, 1, 0.04)]


def test_filters_reach_the_cursor(spark, folder, monkeypatch):
    df = spark.read.format("frames").load(folder)
    out = df.where((F.col("frame") > 4) & (F.col("frame") <= 6) & F.col("video_id").isin("a", "b/1 ü"))
    assert sorted((r["video_id"], r["frame"]) for r in out.collect()) == [("a", 5), ("a", 6), ("b/1 ü", 5), ("b/1 ü", 6)]
    assert out.where(F.col("frame").isin(6, 9, 2) & (F.length("image") > 0)).count() == 2
    cursors = []

    class Counting(S.Cursor):
        def __post_init__(self):
            super().__post_init__()
            cursors.append(self)

    monkeypatch.setattr(S, "Cursor", Counting)
    reader = S.FramesReader(folder)
    left = list(reader.pushFilters([S.In(("frame",), (30, 2, 31)), S.LessThan(("frame",), 31), S.EqualTo(("video_id",), "a"), S.EqualTo(("image",), b"")]))
    assert [f.attribute for f in left] == [("image",)]
    assert [r[1] for p in reader.partitions() for r in reader.read(p)] == [2, 30]
    assert len(cursors) == 1 and (cursors[0].retrieved, cursors[0].grabbed) == (2, 29)


def test_wanted_frames_in_one_pass(spark, folder):
    wanted = spark.createDataFrame([("a", 3), ("a", 3), ("a", 10), ("a", 99), ("b/1 ü", 6), ("gone", 0), (None, 1), ("c", -1)], "video_id string, frame long")
    got = sorted((r["video_id"], r["frame"], bytes(r["image"]).decode(), r["grabbed"], r["retrieved"]) for r in S.read_wanted(wanted, folder).collect())
    assert got == [("a", 3, "a-3", 3, 1), ("a", 10, "a-10", 9, 2), ("b/1 ü", 6, "b/1 ü-6", 6, 1)]
    assert S.read_wanted(wanted.limit(0), folder).count() == 0


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    """A gap in one video fails its task; the files of the others are not moved in either."""
    rows = [(v, i, b"x") for v in "abcdef" for i in range(5) if (v, i) != ("d", 2)]
    df = spark.createDataFrame(rows, "video_id string, frame long, image binary")
    with pytest.raises(Exception, match="frame 3 where 2 is next"):
        S.write_frames(df, f"file://{tmp_path}/out")
    left = [f for _, _, files in os.walk(f"{tmp_path}/out") for f in files]
    assert left == [] and os.listdir(f"{tmp_path}/out") == []
    S.write_frames(df.where("video_id != 'd'"), f"file://{tmp_path}/out")
    assert sorted(os.listdir(f"{tmp_path}/out")) == [f"{v}.rec" for v in "abcef"]
