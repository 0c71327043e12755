"""Document fingerprints: bottom-k sketches of shingle hashes.

A fingerprint holds the ``SIZE`` smallest 48-bit hashes of a text's distinct five-word shingles, ascending, and says
whether that is all of them. Fingerprints of parts merge into that of the whole set. Two of them estimate resemblance,
containment and the number of distinct shingles. Written as base64 of the packed hashes, after ``=`` if complete or ``+``.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, partitions
from .textkit import Words, chunks, distinct, shingles, text_bytes

SIZE, BITS, SHINGLE = 128, 48, 5


@dataclass(frozen=True)
class Fingerprint:
    hashes: np.ndarray  # ascending, at most SIZE
    complete: bool

    def __str__(self) -> str:
        packed = np.ascontiguousarray(self.hashes.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, : BITS // 8].tobytes()
        return ("=" if self.complete else "+") + base64.b64encode(packed).decode()

    @staticmethod
    def parse(text: str) -> Fingerprint:
        raw = np.frombuffer(base64.b64decode(text[1:]), np.uint8).reshape(-1, BITS // 8)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, : BITS // 8] = raw
        return Fingerprint(wide.view("<u8").ravel().astype(np.uint64), text[0] == "=")

    def merge(self, other: Fingerprint) -> Fingerprint:
        """The fingerprint of the union of both sets."""
        both = np.union1d(self.hashes, other.hashes)
        return Fingerprint(both[:SIZE], self.complete and other.complete and len(both) <= SIZE)

    def count(self) -> float:
        """Estimated number of distinct shingles."""
        if self.complete:
            return float(len(self.hashes))
        return (len(self.hashes) - 1) / max(float(self.hashes[-1]) / 2**BITS, 2.0**-BITS)

    def resemblance(self, other: Fingerprint) -> float:
        """Estimated intersection over union: the share of the union's smallest hashes that both hold. Two empty sets: 1."""
        union = self.merge(other)
        if not len(union.hashes):
            return 1.0
        top = union.hashes[-1]
        common = np.intersect1d(self.hashes, other.hashes, assume_unique=True)
        return float((common <= top).sum()) / len(union.hashes)

    def containment(self, other: Fingerprint) -> float:
        """Estimated share of this set that the other holds."""
        own = self.count()
        return min(1.0, self.resemblance(other) * self.merge(other).count() / own) if own else 1.0


def fingerprints(column: pa.Array, k: int = SHINGLE) -> list[Fingerprint]:
    """A fingerprint for each text; null texts and texts without words have the empty one."""
    data, offsets = text_bytes(column)
    out: list[Fingerprint] = []
    for i, j in chunks(offsets):
        rows, values = shingles(Words(data, offsets, i, j), k)
        rows, values = distinct(rows, values >> np.uint64(64 - BITS))
        edge = np.searchsorted(rows, np.arange(j - i + 1))
        out += [Fingerprint(values[a : min(b, a + SIZE)], b - a <= SIZE) for a, b in zip(edge[:-1], edge[1:], strict=True)]
    return out


def edited(text: str, following: str) -> str:
    """The last quarter (rounded down) replaced by as many first code points of the following text, or all it has."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in order within partitions of blocks of ascending ids, each block followed by the next one's first row.

    Columns: block, doc_id, text, extra (the row only shows what follows). The row after the last block's is the first row
    of all. Blocks end at sampled quantiles of the id; their number is the number of partitions, and what reaches the
    driver is one number for each.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    cuts = docs.where("doc_id IS NOT NULL").approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.25 / parts) if parts > 1 else []
    shared = spark.sparkContext.broadcast(np.unique(np.array(cuts, float).astype(np.int64)))  # one number for each partition

    @F.pandas_udf("int")
    def block_of(ids: pd.Series) -> pd.Series:
        known = ids.fillna(-(2**63)) if ids.dtype == object or ids.isna().any() else ids
        return pd.Series(np.searchsorted(shared.value, known.astype(np.int64), "right").astype(np.int32))

    placed = docs.withColumn("block", F.when(F.col("doc_id").isNull(), 0).otherwise(block_of("doc_id")))
    heads = placed.groupBy("block").agg(F.min("doc_id").alias("head"), F.max(F.col("doc_id").isNull()).alias("null_head")).orderBy("block").collect()  # one row for each block
    # rows that open a block (more than one if an id repeats) also close the block before it
    opens = [(h["block"], None if h["null_head"] else h["head"], heads[i - 1]["block"]) for i, h in enumerate(heads)]
    opens = F.broadcast(spark.createDataFrame(opens, "block int, head long, closes int"))
    own = F.struct(F.col("block"), F.lit(False).alias("extra"))
    closing = F.when(F.col("doc_id").eqNullSafe(F.col("head")), F.struct(F.col("closes").alias("block"), F.lit(True).alias("extra")))
    both = placed.join(opens, "block").withColumn("to", F.explode(F.array_compact(F.array(own, closing))))
    both = both.select(F.col("to.block").alias("block"), F.col("to.extra").alias("extra"), "doc_id", "text")
    return both.repartitionById(parts, F.col("block")).sortWithinPartitions("block", "extra", "doc_id", "text")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The next document is the following one by doc_id (null ids first, repeated ids by text), after the last the first; a
    lone row is its own next. Null texts are empty; very long ones are read whole, in one task; other columns are ignored,
    whatever their names. An empty table gives an empty result.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the row whose next has not come yet: block, doc_id, text
        for batch in batches:
            blocks, extras, ids = (batch.column(c).to_pylist() for c in ("block", "extra", "doc_id"))
            texts = batch.column("text")
            at, n = 0, len(blocks)
            while at < n:
                stop, size = at, 0
                while stop < n and (stop == at or size < 4_000_000):
                    size += len(texts[stop].as_buffer())
                    stop += 1
                rows = [] if held is None else [held]
                rows += [(blocks[i], extras[i], ids[i], texts[i].as_py()) for i in range(at, stop)]
                last = rows[-1]
                pairs = [(a, b) for a, b in zip(rows, rows[1:]) if not a[1] and a[0] == b[0]]
                if pairs:
                    yield answer(pairs)
                held, at = (None if last[1] else last), stop

    def answer(pairs: list[tuple]) -> pa.RecordBatch:
        changed = [edited(a[3], b[3]) for a, b in pairs]
        own = fingerprints(pa.array([a[3] for a, _ in pairs], pa.large_string()))
        # a row's next is nearly always the following pair's own row
        need = [i for i, (_, b) in enumerate(pairs) if i + 1 == len(pairs) or pairs[i + 1][0] is not b]
        others = dict(zip(need, fingerprints(pa.array([pairs[i][1][3] for i in need], pa.large_string())), strict=True))
        following = [others[i] if i in others else own[i + 1] for i in range(len(pairs))]
        new = fingerprints(pa.array(changed, pa.large_string()))
        return pa.record_batch(
            [
                pa.array([a[2] for a, _ in pairs], pa.int64()),
                pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
                pa.array([str(f) for f in own]),
                pa.array([str(f) for f in new]),
                pa.array([f.resemblance(g) for f, g in zip(own, new, strict=True)], pa.float64()),
                pa.array([f.resemblance(g) for f, g in zip(own, following, strict=True)], pa.float64()),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    return with_next(id_text(docs, id_col, text_col)).mapInArrow(run, schema)
