"""Frame files as a Spark data source, read forward with a cursor and written with commit and abort.

A record file stands for a decoded video: one file for each video, ``<video_id>.rec``, a head (mark, frames a second, number of
frames) and the frames one after the other, each with its length before it. There is no index: as with a video, a reader
steps over the frames it does not want and stops behind the last one it does.

``spark.read.format("frames").load(folder)`` gives (video_id, frame, image) with a partition for a few files; filters on video_id
choose files, filters on frame go to the cursor. Files are opened by pyarrow's file systems, so the folder may be a local path
or the URI of a store that they know.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from . import probe_defaults

SCHEMA = "video_id string, frame long, image binary"
MARK, HEAD, LENGTH = b"SLR1", struct.Struct("<4sdq"), struct.Struct("<I")
SUFFIX = ".rec"


def _store(folder: str):
    """The file system of a folder and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def file_name(video_id: str) -> str:
    """The name that a video's file has by rule; what a path cannot hold is quoted."""
    return quote(video_id, safe="") + SUFFIX


def video_of(name: str) -> str:
    return unquote(name.rsplit("/", 1)[-1].removesuffix(SUFFIX))


@dataclass
class Cursor:
    """A forward cursor over an open record file; ``grabbed`` and ``retrieved`` count the frames stepped over and read."""

    file: object
    fps: float = 0.0
    frames: int = 0
    grabbed: int = 0
    retrieved: int = 0
    at: int = field(default=0)

    def __post_init__(self) -> None:
        head = self.file.read(HEAD.size)
        if len(head) < HEAD.size or head[:4] != MARK:
            raise ValueError("not a record file")
        _, self.fps, self.frames = HEAD.unpack(head)

    def _length(self) -> int | None:
        raw = self.file.read(LENGTH.size)
        return LENGTH.unpack(raw)[0] if len(raw) == LENGTH.size else None

    def wanted(self, numbers: Iterator[int]) -> Iterator[tuple[int, bytes]]:
        """The frames of the ascending ``numbers``, each once; a file that ends early, or within a frame, ends the frames."""
        for number in numbers:
            while self.at <= number:
                length = self._length()
                if length is None:
                    return
                if self.at == number:
                    image = self.file.read(length)
                    if len(image) < length:
                        return
                    self.retrieved += 1
                    self.at += 1
                    yield number, image
                else:
                    self.file.seek(length, 1)
                    self.grabbed += 1
                    self.at += 1


def _numbers(low: int, high: int | None, chosen: list[int] | None, frames: int) -> Iterator[int]:
    if chosen is not None:
        return iter(sorted({n for n in chosen if n >= low and (high is None or n <= high)}))
    return iter(range(max(low, 0), frames if high is None else min(frames, high + 1)))


#: A partition of a folder: at least so many where there are files enough, and bounds of each.
PARTITIONS, FILES, BYTES = 64, 1000, 1 << 26


@dataclass
class FilePartition(InputPartition):
    paths: list[str]


def _dealt(files: list[tuple[str, int]]) -> list[FilePartition]:
    """Files (path, bytes) in their order, those of a partition together: a task for each short video would cost more than it reads."""
    most = min(FILES, -(-len(files) // PARTITIONS))
    out: list[FilePartition] = []
    held = 0
    for path, size in files:
        if not out or len(out[-1].paths) >= most or held + size > BYTES:
            out.append(FilePartition([]))
            held = 0
        out[-1].paths.append(path)
        held += size
    return out


class FramesReader(DataSourceReader):
    def __init__(self, folder: str) -> None:
        self.folder, self.low, self.high, self.chosen, self.videos = folder, 0, None, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality and lists on video_id, and these and ranges on frame, are settled here; the rest is left to Spark."""
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") else None
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if column == "video_id" and values is not None:
                self.videos = values if self.videos is None else self.videos & values
            elif column == "frame" and values is not None:
                self.chosen = sorted(values if self.chosen is None else values & set(self.chosen))
            elif column == "frame" and isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif column == "frame" and isinstance(f, LessThan | LessThanOrEqual):
                most = f.value - isinstance(f, LessThan)
                self.high = most if self.high is None else min(self.high, most)
            else:
                yield f

    def files(self) -> list[tuple[str, int]]:
        """(path, bytes) of the files that the filters leave."""
        from pyarrow import fs

        store, folder = _store(self.folder)
        found = sorted((i.path, i.size) for i in store.get_file_info(fs.FileSelector(folder)) if i.is_file and i.path.endswith(SUFFIX))
        return [(p, n) for p, n in found if self.videos is None or video_of(p) in self.videos]

    def partitions(self) -> list[InputPartition]:
        return _dealt(self.files())

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        store, _ = _store(self.folder)
        for path in partition.paths:
            video = video_of(path)
            with store.open_input_file(path) as file:
                cursor = Cursor(file)
                for number, image in cursor.wanted(_numbers(self.low, self.high, self.chosen, cursor.frames)):
                    yield video, number, image


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class FramesWriter(DataSourceWriter):
    """Each task writes its videos' files beside the folder; commit moves them in, abort deletes them. A video's rows come in one
    task, in order (write_frames() sees to it); a repeated or missing frame fails the task."""

    def __init__(self, folder: str, fps: float, overwrite: bool) -> None:
        self.folder, self.fps, self.overwrite = folder, fps, overwrite

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from uuid import uuid4

        store, folder = _store(self.folder)
        own = f"{folder}/_temporary/{uuid4().hex}"
        store.create_dir(own, recursive=True)
        files: list[tuple[str, str]] = []
        out, video, count = None, None, 0

        def close() -> None:
            if out is not None:
                out.close()
                with store.open_input_file(files[-1][0] + ".body") as body, store.open_output_stream(files[-1][0]) as whole:
                    whole.write(HEAD.pack(MARK, self.fps, count))
                    while piece := body.read(1 << 20):
                        whole.write(piece)
                store.delete_file(files[-1][0] + ".body")

        try:
            for r in rows:
                if r["video_id"] != video:
                    close()
                    video, count = r["video_id"], 0
                    name = file_name(video)
                    files.append((f"{own}/{name}", f"{folder}/{name}"))
                    out = store.open_output_stream(files[-1][0] + ".body")
                if r["frame"] != count:
                    raise ValueError(f"video {video}: frame {r['frame']} where {count} is next")
                image = bytes(r["image"])
                out.write(LENGTH.pack(len(image)) + image)
                count += 1
            close()
            out = None
        except BaseException:
            if out is not None and not out.closed:
                out.close()
            store.delete_dir(own)  # a failed task leaves no file
            raise
        return Written(files)

    def commit(self, messages: list) -> None:
        store, folder = _store(self.folder)
        for made, name in (f for m in messages if m for f in m.files):
            store.move(made, name)
        self._clear(store, folder)

    def abort(self, messages: list) -> None:
        self._clear(*_store(self.folder))

    @staticmethod
    def _clear(store, folder: str) -> None:
        from pyarrow import fs

        if store.get_file_info(f"{folder}/_temporary").type != fs.FileType.NotFound:
            store.delete_dir(f"{folder}/_temporary")


class FramesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FramesReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return FramesWriter(self.options["path"], float(self.options.get("fps", 25.0)), overwrite)


def register(spark: SparkSession) -> None:
    """Make ``format("frames")`` known, with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FramesSource)


def write_frames(frames: DataFrame, folder: str, fps: float = 25.0) -> None:
    """Write (video_id, frame, image) as a file for each video; frames count from 0 without gaps. Rows without an id are left out."""
    register(frames.sparkSession)
    rows = frames.where("video_id IS NOT NULL").select(F.col("video_id").cast("string"), F.col("frame").cast("long"), F.col("image").cast("binary"))
    rows.repartition("video_id").sortWithinPartitions("video_id", "frame").write.format("frames").mode("append").option("path", folder).option("fps", str(fps)).save()


def probe(spark: SparkSession, folder: str) -> DataFrame:
    """(video_id, fps, frames, duration_sec) of each file, from its head alone; a rate of 0 is the default rate."""
    heads = spark.createDataFrame([(p,) for p, _ in FramesReader(folder).files()], "path string")  # names, a row for each file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(folder)
        for batch in batches:
            out = []
            for path in batch.column("path").to_pylist():
                with store.open_input_file(path) as file:
                    cursor = Cursor(file)
                    out.append((video_of(path), cursor.fps, cursor.frames))
            yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.float64(), pa.int64()))], ["video_id", "fps", "frames"])

    fps, frames, duration = probe_defaults(F.col("fps"), F.col("frames"))
    return heads.mapInArrow(run, "video_id string, fps double, frames long").select("video_id", fps.alias("fps"), frames.alias("frames"), duration.alias("duration_sec"))


def read_wanted(wanted: DataFrame, folder: str) -> DataFrame:
    """(video_id, frame, image, grabbed, retrieved) of the frames that ``wanted`` (video_id, frame) names, each once.

    A video's wanted numbers meet its file in one task, where they are merged with the cursor in one pass; the last two columns
    count what the cursor has stepped over and read until then. Frames that a file does not have, and videos without a file,
    give no row.
    """
    rows = wanted.select(F.col("video_id").cast("string"), F.col("frame").cast("long")).where("video_id IS NOT NULL AND frame >= 0").distinct()
    rows = rows.repartition("video_id").sortWithinPartitions("video_id", "frame")
    schema = "video_id string, frame long, image binary, grabbed long, retrieved long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = _store(folder)
        video, cursor, file = None, None, None
        try:
            for batch in batches:
                out = []
                for own, number in zip(batch.column("video_id").to_pylist(), batch.column("frame").to_pylist(), strict=True):
                    if own != video:
                        if file is not None:
                            file.close()
                        video, cursor, file = own, None, None
                        name = f"{path}/{file_name(own)}"
                        if store.get_file_info(name).type == fs.FileType.File:
                            file = store.open_input_file(name)
                            cursor = Cursor(file)
                    if cursor is not None:
                        out += [(own, n, image, cursor.grabbed, cursor.retrieved) for n, image in cursor.wanted(iter([number]))]
                kinds = (pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
                yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["video_id", "frame", "image", "grabbed", "retrieved"])
        finally:
            if file is not None:
                file.close()

    return rows.mapInArrow(run, schema)
