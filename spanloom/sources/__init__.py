"""Readers and writers with declared schemas, and the adapter for external scorers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import CLASSES, FOLDER_CLASS
from ..functions import class_of_path
from ..operators.quality import first_violations

VIDEO = "struct<video_id:string,level:int,domain:string,duration_sec:double,filename:string,file:string>"
RUNTIME = "struct<model_name:string,call_count:bigint,total_time_ms:double,average_time_ms:double,p50_time_ms:double,p95_time_ms:double,max_time_ms:double>"
EVENT = "struct<class_name:string,start_time_sec:double,end_time_sec:double,explanation:string>"
PREDICTION = f"struct<video_id:string,events:array<{EVENT}>,runtime_metadata:struct<frames_processed:bigint,chunks_processed:bigint,end_to_end_internal_time_ms:double,model_runtimes:array<{RUNTIME}>>>"
SHEET = f"struct<schema_version:string,submission_id:string,model_name:string,run_metadata:struct<total_wall_time_ms:double,max_parallel_videos:int,hardware:string>,predictions:array<{PREDICTION}>>"
TRUTH = "video_id string, level int, is_anomaly string, class_name string, start_time_sec double, end_time_sec double"
REPLY = "struct<choices:array<struct<logprobs:struct<content:array<struct<top_logprobs:array<struct<token:string,logprob:double>>>>>>>>"


# ------------------------------------------------------------------ manifest
def parse_manifest(documents: DataFrame, text: str = "value", keys: tuple[str, ...] = (), first: str | None = None) -> DataFrame:
    """Videos of manifest documents: {"videos": [...]} or a bare list; the last of a repeated id wins.

    video_id, level (default 1), filename (filename, else file, else id.mp4), domain, duration_sec. ``keys`` name the
    columns that tell manifests apart (none: all rows are one manifest); ``first`` a column with the position of a
    document's first entry, for manifests written in several documents.
    """
    body = F.ltrim(F.col(text))
    videos = F.when(body.startswith("["), F.from_json(text, f"array<{VIDEO}>")).otherwise(F.from_json(text, f"struct<videos:array<{VIDEO}>>")["videos"])
    rows = documents.select(*keys, (F.col(first) if first else F.lit(0)).alias("_first"), F.posexplode(videos).alias("_pos", "v")).where("v.video_id IS NOT NULL")
    last = rows.groupBy(*keys, "v.video_id").agg(F.max_by("v", F.col("_first") + F.col("_pos")).alias("v"))
    return last.select(*keys, "video_id", F.coalesce("v.level", F.lit(1)).alias("level"), F.coalesce("v.filename", "v.file", F.concat("video_id", F.lit(".mp4"))).alias("filename"), F.coalesce("v.domain", F.lit("")).alias("domain"), "v.duration_sec")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return parse_manifest(spark.read.text(path, wholetext=True))


def select_videos(videos: DataFrame, levels: list[int], only: list[str] | None = None, files: DataFrame | None = None) -> DataFrame:
    """Videos of the levels, of the ids if any are named, and, given a listing (filename), with a file that exists."""
    out = videos.where(F.col("level").isin(*levels))
    out = out.where(F.col("video_id").isin(*only)) if only else out
    return out if files is None else out.join(files.select("filename").distinct(), "filename", "left_semi")


def probe_defaults(fps: Column, frames: Column) -> tuple[Column, Column, Column]:
    """(fps, frames, duration): a missing or zero rate is 25, missing frames are 0."""
    rate, n = F.coalesce(F.nullif(fps, F.lit(0.0)), F.lit(25.0)), F.coalesce(frames, F.lit(0)).cast("long")
    return rate, n, n / rate


# ------------------------------------------------------------------ truths and answers
def truth_rows(rows: DataFrame, order: Column) -> DataFrame:
    """Ground truths of the columns in TRUTH: is_anomaly as boolean, and gt_ord, the order in the file, which matching
    depends on."""
    place = F.row_number().over(W.partitionBy("video_id").orderBy("_at")) - 1
    return rows.withColumn("_at", order).withColumns({"is_anomaly": F.lower(F.trim("is_anomaly")) == "true", "gt_ord": place}).drop("_at")


def parse_truths(lines: DataFrame, order: str, text: str = "value") -> DataFrame:
    """truth_rows() of CSV lines without their heading; blank times are null."""
    return truth_rows(lines.select(order, F.from_csv(text, TRUTH).alias("r")).select(order, "r.*"), F.col(order))


def read_truths(spark: SparkSession, path: str) -> DataFrame:
    return truth_rows(spark.read.schema(TRUTH).csv(path, header=True), F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()))


def timed_truths(truths: DataFrame, upload: str) -> DataFrame:
    """Anomalous truths with times for an uploaded file, found by its upper-cased stem."""
    stem = upload.rsplit("/", 1)[-1].rsplit(".", 1)[0].upper()
    return _timed(truths).where(F.col("video_id") == stem)


def timed_truths_of(truths: DataFrame, uploads: DataFrame, name: str = "filename") -> DataFrame:
    """timed_truths() of many uploads at once: the uploads' columns beside each of their truths."""
    stem = F.upper(F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"(?<=.)\.[^.]*$", ""))
    return uploads.withColumn("_stem", stem).join(_timed(truths), F.col("_stem") == F.col("video_id")).drop("_stem")


def _timed(truths: DataFrame) -> DataFrame:
    return truths.where(F.col("is_anomaly") & F.col("start_time_sec").isNotNull() & F.col("end_time_sec").isNotNull())


def parse_sheet(documents: DataFrame, text: str = "value", first: str | None = None) -> DataFrame:
    """Answers of sheet documents, the last of a repeated id: video_id, events, runtime_metadata.

    ``first`` names a column with the position of a document's first event, for answers written in several documents.
    """
    part = [first] if first else []
    rows = documents.select(*part, F.posexplode(F.from_json(text, SHEET)["predictions"]).alias("pos", "p"))
    return rows.groupBy(*part, "p.video_id").agg(F.max_by("p", "pos").alias("p")).select(*part, "video_id", F.coalesce("p.events", F.array().cast(f"array<{EVENT}>")).alias("events"), "p.runtime_metadata")


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    return parse_sheet(spark.read.text(path, wholetext=True))


def sheet_events(answers: DataFrame, first: str | None = None) -> DataFrame:
    """(video_id, pred_ord, class_name, start_sec, end_sec, explanation); ``first`` as in parse_sheet()."""
    e = answers.select("video_id", (F.col(first) if first else F.lit(0)).alias("_first"), F.posexplode("events").alias("pred_ord", "e"))
    return e.select("video_id", (F.col("_first") + F.col("pred_ord")).alias("pred_ord"), "e.class_name", F.col("e.start_time_sec").alias("start_sec"), F.col("e.end_time_sec").alias("end_sec"), "e.explanation")


def sheet_json(answers: DataFrame, submission_id: str, model_name: str, wall_ms: float, hardware: str, schema_version: str = "1.0", parallel: int = 1) -> DataFrame:
    """One row (value): the whole sheet as JSON, answers by id, nulls written out. A sheet is one document by definition."""
    body = F.sort_array(F.collect_list(F.struct("video_id", "events", "runtime_metadata")))
    run = F.struct(F.lit(wall_ms).alias("total_wall_time_ms"), F.lit(parallel).alias("max_parallel_videos"), F.lit(hardware).alias("hardware"))
    sheet = F.struct(F.lit(schema_version).alias("schema_version"), F.lit(submission_id).alias("submission_id"), F.lit(model_name).alias("model_name"), run.alias("run_metadata"), F.col("predictions"))
    return answers.agg(body.alias("predictions")).select(F.to_json(sheet, {"ignoreNullFields": "false"}).alias("value"))


def write_sheet(answers: DataFrame, found: DataFrame, path: str, **header) -> DataFrame:
    """Write the sheet as one JSON document, but only if ``found`` (quality.violations()) is empty; returns the report."""
    report = first_violations(found)
    if report.isEmpty():
        sheet_json(answers, **header).coalesce(1).write.text(path)
    return report


# ------------------------------------------------------------------ training rows
def chat_rows(samples: DataFrame, prompt: str, letter: str = "letter", images: str = "images", keys: tuple[str, ...] = ()) -> DataFrame:
    """One row (``keys``, value) per sample: user turn of image marks and the prompt, assistant turn of the letter, image paths."""
    user = F.concat(F.repeat(F.lit("<image>"), F.size(images)), F.lit("\n" + prompt))
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return samples.select(*keys, F.to_json(F.struct(F.array(turn("user", user), turn("assistant", F.col(letter))).alias("messages"), F.col(images).alias("images"))).alias("value"))


def found_files(spark: SparkSession, patterns: list[str]) -> DataFrame:
    """(path) of the files that match any of the patterns, each once; contents are not read."""
    return spark.read.format("binaryFile").load(patterns).select("path").distinct()


def labelled_files(spark: SparkSession, patterns: list[str]) -> DataFrame:
    """(path, class_name) of files that match; files of no known class are left out."""
    return found_files(spark, patterns).withColumn("class_name", class_of_path(F.col("path"), CLASSES, FOLDER_CLASS)).where("class_name IS NOT NULL")


# ------------------------------------------------------------------ external scorers
def reply_tokens(reply: Column) -> Column:
    """array<struct<token, logprob>> of a model's JSON reply; null where it has none."""
    return F.from_json(reply, REPLY)["choices"][0]["logprobs"]["content"][0]["top_logprobs"]


def score_chunks(chunks: DataFrame, scorer: Callable[[list[bytes]], str | None], images: str = "images", retries: int = 2, pause: float = 1.0, timeout: float = 120.0, at_once: int = 16) -> DataFrame:
    """chunks plus reply, ms and scorer_failed; ``scorer`` turns a chunk's images into a JSON reply.

    A task keeps up to ``at_once`` calls going. A call that fails is tried again after ``pause`` seconds, one that takes
    over ``timeout`` seconds is given up; in the end the reply is null and flagged, which class_distribution() reads as
    surely normal. Materialise the result before branching, so that no call is repeated.
    """
    import time
    from concurrent.futures import ThreadPoolExecutor

    schema = chunks.drop(images).schema.add("reply", "string").add("ms", "double").add("scorer_failed", "boolean")
    names = [f.name for f in chunks.schema if f.name != images]

    def call(own: list[bytes]) -> tuple[str | None, float]:
        began, reply = time.perf_counter(), None
        for attempt in range(retries + 1):
            try:
                reply = scorer(own)
                break
            except Exception:  # noqa: BLE001  any failure of the outside model counts
                if attempt < retries:
                    time.sleep(pause)
        return reply, (time.perf_counter() - began) * 1000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = ThreadPoolExecutor(at_once)
        most = (timeout + pause) * (retries + 1)
        try:
            for batch in batches:
                waiting = [pool.submit(call, own) for own in batch.column(batch.schema.get_field_index(images)).to_pylist()]
                done = []
                for w in waiting:
                    try:
                        done.append(w.result(most))
                    except TimeoutError:
                        done.append((None, most * 1000))
                replies, times = ([x[k] for x in done] for k in (0, 1))
                yield pa.record_batch([*(batch.column(batch.schema.get_field_index(n)) for n in names), pa.array(replies, pa.string()), pa.array(times, pa.float64()), pa.array([r is None for r in replies], pa.bool_())], [*names, "reply", "ms", "scorer_failed"])
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    return chunks.mapInArrow(run, schema)


def teacher_letter(answer: Column) -> Column:
    """The first letter A-L of an upper-cased answer, else null."""
    return F.nullif(F.regexp_extract(F.upper(answer), "[A-L]", 0), F.lit(""))
