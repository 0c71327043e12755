"""Raw sheets, uploads that land once, a teacher held by its worker."""

import base64
import json
import os

import pytest
from pyspark.sql import functions as F

from spanloom.functions import decoded_image, encoded_image, fourcc
from spanloom.sources import landing, teacher
from spanloom.sources.sheets import raw_violations
from spanloom.streaming import delivery


def breaches(spark, sheets, **options):
    df = spark.createDataFrame(list(enumerate(sheets)), "sheet int, value string")
    return sorted((r["sheet"], r["answer"], r["rule"], r["detail"]) for r in raw_violations(df, "sheet", **options).collect())


def test_absent_is_not_null(spark):
    good = {"video_id": "E1", "events": [], "runtime_metadata": {"model_runtimes": [{"model_name": "m", "call_count": 2, "call_times_ms": [1, 2], "extra": 1}]}, "confidence": 0.5}
    sheets = [{"predictions": [good, {**good, "events": None}, {k: v for k, v in good.items() if k != "video_id"}]}, {"predictions": None}, {}, {"predictions": {}}, {"predictions": []}]
    got = breaches(spark, [json.dumps(s) for s in sheets] + ["{", None, "[1]"])
    assert got[:2] == [(0, 1, "events_null", None), (0, 2, "video_id_missing", None)]
    assert [(s, r) for s, _, r, _ in got[2:]] == [(1, "predictions_null"), (2, "predictions_missing"), (3, "predictions_type"), (5, "not_json"), (6, "not_json"), (7, "predictions_missing")]


@pytest.mark.parametrize("count, times, wrong", [(2, [1.0, 2], False), (3, [1, 2], True), (0, [], False), (None, [1], True), (2, None, False)])
def test_call_times_have_call_count_entries(spark, count, times, wrong):
    model = {"model_name": "m", "call_count": count} | ({} if times is None else {"call_times_ms": times})
    sheet = {"predictions": [{"video_id": "a", "events": [], "runtime_metadata": {"model_runtimes": [model, {"model_name": "n"}]}}]}
    assert breaches(spark, [json.dumps(sheet)]) == ([(0, 0, "call_times_count", "m")] if wrong else [])


def test_large_sheets_are_not_parsed(spark):
    text = json.dumps({"predictions": [], "note": "é" * 100}, ensure_ascii=False)
    assert breaches(spark, [text], limit=len(text.encode())) == []
    assert breaches(spark, [text, "x" * 500], limit=len(text.encode()) - 1) == [(0, None, "too_large", None), (1, None, "too_large", None)]


def test_uploads_land_once(spark, tmp_path):
    """Two runs: files within the limit with their content, each once; others by name only, even if they cannot be read."""
    box = tmp_path / "in"
    box.mkdir()

    def put(name, size):
        (box / name).write_bytes(b"x" * size)

    put("a.mp4", 10), put("large.mp4", 101), put("empty.mp4", 0), put("skip.txt", 5)
    files = lambda: landing.arrivals(spark, f"file://{box}", "*.mp4")
    for k in range(2):
        if k:
            put("b.mp4", 100)
        delivery.run_available(landing.accepted(files(), 100), f"{tmp_path}/out", f"{tmp_path}/check")
        delivery.run_available(landing.refused(files(), 100), f"{tmp_path}/bad", f"{tmp_path}/check2")
    got = delivery.delivered(spark, f"{tmp_path}/out", "path string, length long, content binary")
    assert sorted((os.path.basename(r["path"]), r["length"], len(r["content"])) for r in got.collect()) == [("a.mp4", 10, 10), ("b.mp4", 100, 100)]
    bad = delivery.delivered(spark, f"{tmp_path}/bad", "path string, length long, reason string")
    assert sorted((os.path.basename(r["path"]), r["reason"]) for r in bad.collect()) == [("large.mp4", "too_large")]


def test_limit_reaches_the_source(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"x" * 50)
    df = landing.accepted(spark.read.format("binaryFile").load(f"file://{tmp_path}"), 20)
    assert "LessThanOrEqual(length,20)" in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 0


def test_a_worker_loads_its_model_once(spark, tmp_path):
    """Many tasks and batches, few workers: a load for each worker, two answers for each sample."""
    def load():
        import uuid

        open(f"{tmp_path}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return "ABCDEFGHIJKL"

    def ask(model, images):
        if images[0] == b"bad":
            raise RuntimeError
        return f" {model[images[0][0] % 12].lower()}) it is"

    rows = [(i, [bytes([i % 7]), bytes([i % 3])]) for i in range(400)] + [(400, None), (401, []), (402, [b"bad", b"a"])]
    df = spark.createDataFrame(rows, "id int, images array<binary>").repartition(16)
    asked = teacher.ask_twice(df, f"stand-in {tmp_path}", load, ask)
    got = {r["id"]: (r["first"], r["second"]) for r in asked.collect()}
    names = os.listdir(tmp_path)
    assert len(names) == len({n.split("-")[0] for n in names}) <= 8
    assert got[5] == (" f) it is", " c) it is") and got[400] == got[401] == (None, None) and got[402] == (None, " b) it is")
    kept = teacher.taught(asked).select("id", "letter").collect()
    assert {r["id"]: r["letter"] for r in kept} == {i: "ABCDEFG"[i % 7] for i in range(400) if i % 7 == i % 3}
    assert "images" in df.columns and df.columns == ["id", "images"]


def test_codec_names_equal_plain_bits(spark):
    codes = [None, 0, 0x31637661, 0x34363248, 0x20202020, 0x20204649, 0xFFA08541, 0x0A1C4120, 2**31 + 5, -1]
    got = [r["c"] for r in spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "i int, code long").orderBy("i").select(fourcc(F.col("code")).alias("c")).collect()]
    assert got == [None if c is None else "".join(chr((c >> 8 * i) & 0xFF) for i in range(4)).strip() for c in codes]


def test_images_as_text_and_back(spark):
    images = [None, b"", b"\xff\xd8\xff", bytes(range(256)) * 40]
    df = spark.createDataFrame(list(enumerate(images)), "i int, data binary").select("i", encoded_image(F.col("data")).alias("text"))
    assert [r["text"] for r in df.orderBy("i").collect()] == [base64.b64encode(x).decode() if x else None for x in images]
    back = df.select("i", decoded_image(F.col("text")).alias("a"), decoded_image(F.concat(F.lit("data:image/png;base64,"), "text")).alias("b"))
    assert [(r["a"], r["b"]) for r in back.orderBy("i").collect()] == [(x or None, x or None) for x in images]
    bad = spark.createDataFrame([("no base64!",), ("data:image/png;base64,",), ("",), (None,)], "t string")
    assert [r["x"] for r in bad.select(decoded_image(F.col("t")).alias("x")).collect()] == [None] * 4
