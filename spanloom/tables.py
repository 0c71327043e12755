"""Tables in the folder that the driver and all executors share: they cut lineage and outlive executors. And how rows are dealt to
tasks: by size, and whole groups to Python without a call for each."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, ``spark.checkpoint.dir``; a session without one is refused, not given a local one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage on storage that outlives executors, and makes every later reader see the same rows.
    """
    path = f"{shared_folder(df.sparkSession)}/spanloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize() that nothing reads any more."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if folder.rsplit("/", 1)[-1].startswith("spanloom-"):
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)


#: Rows of a table that go to one task of a chain of windows; each window's sort holds them again.
ROWS = 100_000


def spread(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """df, dealt by ``keys`` to as many tasks as leave about ``rows`` (ROWS) to each, if these are more than the session's
    shuffles have; else as it is. For tables read from files, which are counted by their footers."""
    tasks = -(-df.count() // (rows or ROWS))
    return df.repartition(tasks, *keys) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def _codes(column: pa.ChunkedArray) -> list[np.ndarray]:
    """Whole numbers that are equal where the column's values are; nulls are equal, and so are NaNs."""
    column = column.combine_chunks()
    if pa.types.is_struct(column.type):
        return [pc.is_valid(column).to_numpy(zero_copy_only=False).astype(np.int32)] + [c for x in column.flatten() for c in _codes(pa.chunked_array([x]))]
    return [pc.dictionary_encode(column, null_encoding="encode").indices.to_numpy(zero_copy_only=False)]


def group_edges(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where the groups of a sorted table begin, and its end."""
    cut = np.zeros(max(table.num_rows - 1, 0), bool)
    for name in keys:
        for codes in _codes(table[name]):
            cut |= codes[1:] != codes[:-1]
    return np.concatenate([[0], np.flatnonzero(cut) + 1, [table.num_rows]])


def map_groups(df: DataFrame, keys: list[str], order: list[str], settle: Callable[[pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """settle(table, edges) over whole groups of df, many at a time, each sorted by ``order``.

    A group is a row or a few of a long table here, so a call for each would cost more than its rows. Groups come with the
    Arrow batches that they end in; one that is longer than a batch is put together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # the last group so far
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            last = int(group_edges(new, keys)[-2])
            if not last and held and len(group_edges(pa.concat_tables([held[-1].slice(held[-1].num_rows - 1), new.slice(0, 1)]), keys)) > 2:
                yield from done(held)
                held = []
            if last:
                yield from done([*held, new.slice(0, last)])
                held = []
            held.append(new.slice(last))
        if held:
            yield from done(held)

    def done(parts: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        table = pa.concat_tables(parts).combine_chunks()
        yield from settle(table, group_edges(table, keys)).to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
