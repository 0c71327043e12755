"""MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets, star-shaped candidate edges.

A document is its set of k-word shingles. One hash permutation is split into ``BANDS * ROWS`` bins; an empty bin copies
the bin that its own probe sequence first finds filled, which keeps every bin's collision probability at the resemblance.
Each band of ``ROWS`` bins names a bucket, so two sets of resemblance 0.8 share one of 24 buckets but for 3 in a million.

Equal sets are one class from the start. In a bucket the classes form a star around the member with the most bucket
mates (the centre), and star edges are confirmed on the full sets. A star bounds the number of pairs but may miss a link
between two members of which one is not linked with the centre. Those are found through what the sets have besides the
centre's: with a = centre less set and b = set less centre (sizes of A and B), x and y can only be linked if
d |B_x & B_y| >= 100 (a_x + a_y) + c (b_x + b_y) - (100 - c) n - d min(a_x, a_y), where c is the percentage, d = 100 + c
and n the centre's size. So an index of each centre's group on the shingles that the centre lacks, rarest first and only
as far as the least such number demands (prefix filter), finds all candidates, and edited copies of one text share none
of their own edits. Pairs for which the bound is not positive are joined directly. No link between different texts is
lost to the star shape, and copies of one text are never paired with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, id_text, join_unique, materialize, text_hash, without
from .components import connected_components
from .textkit import Words, chunks, distinct, lean, list_array, mix, shingles, text_bytes

BANDS, ROWS = 24, 4
BINS = BANDS * ROWS
PROBES = 64


def one_permutation(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """(n, BINS) densified bin minima of the sets given as (row, value) sorted pairs; sets must not be empty."""
    bins = ((values >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    cell = rows * BINS + bins
    new = np.ones(len(cell), bool)
    new[1:] = cell[1:] != cell[:-1]  # values ascend in a row, and so do the bins: the first of a cell is its minimum
    out, filled = np.zeros(n * BINS, np.uint64), np.zeros(n * BINS, bool)
    out[cell[new]], filled[cell[new]] = values[new], True
    out, filled = out.reshape(n, BINS), filled.reshape(n, BINS)
    result, todo = out.copy(), ~filled
    for attempt in range(PROBES):
        if not todo.any():
            break
        probe = (mix(np.arange(BINS, dtype=np.uint64) * np.uint64(1000003) + np.uint64(attempt + 1)) % np.uint64(BINS)).astype(np.int64)
        hit = todo & filled[:, probe]
        result[hit] = out[:, probe][hit]
        todo &= ~hit
    if todo.any():  # a probe sequence that met no filled bin takes the set's minimum, again a shared random choice
        least = np.where(filled, mix(out), np.uint64(2**64 - 1)).argmin(1)
        result = np.where(todo, out[np.arange(n), least][:, None], result)
    return result


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, text_hash, n (set size), sig_a, sig_b (the set's signature), bands (null for empty sets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for i, j in chunks(offsets):
                rows, values = distinct(*shingles(Words(data, offsets, i, j), k))
                n = np.bincount(rows, minlength=j - i)
                sums = []
                for salt in (1, 2):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values * np.uint64(2 * salt + 1) + np.uint64(salt)), dtype=np.uint64)])
                    edge = np.concatenate([[0], np.cumsum(n)])
                    sums.append((total[edge[1:]] - total[edge[:-1]]).view(np.int64))
                full = np.flatnonzero(n)
                dense = np.cumsum(n > 0) - 1
                bins = one_permutation(dense[rows], values, len(full)).reshape(-1, BANDS, ROWS)
                key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), bins.shape[:2]).copy()
                for r in range(ROWS):
                    key = mix(key * np.uint64(0xD6E8FEB86659FD93) + bins[:, :, r])
                bands = list_array(key.view(np.int64).ravel(), np.where(n > 0, BANDS, 0), pa.int64())
                yield pa.record_batch([*(batch.column(c).slice(i, j - i) for c in ("doc_id", "text_hash")), pa.array(n), pa.array(sums[0]), pa.array(sums[1]), bands], ["doc_id", "text_hash", "n", "sig_a", "sig_b", "bands"])

    return docs.mapInArrow(lean(run), "doc_id long, text_hash long, n long, sig_a long, sig_b long, bands array<long>")


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, hashes: the distinct shingles of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for i, j in chunks(offsets):
                rows, values = distinct(*shingles(Words(data, offsets, i, j), k))
                yield pa.record_batch([batch.column("doc_id").slice(i, j - i), list_array(values.view(np.int64), np.bincount(rows, minlength=j - i), pa.int64())], ["doc_id", "hashes"])

    return docs.mapInArrow(lean(run), "doc_id long, hashes array<long>")


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) with the sizes n_u, n_v of their full sets, ``common``, and ``besides``: what v has and u lacks."""
    left = sets.select(F.col("doc_id").alias("u"), F.col("hashes").alias("a"))
    right = sets.select(F.col("doc_id").alias("v"), F.col("hashes").alias("b"))
    both = pairs.join(right, "v").join(left, "u").withColumn("besides", F.array_except("b", "a"))
    return both.select("u", "v", F.size("a").alias("n_u"), F.size("b").alias("n_v"), (F.size("b") - F.size("besides")).alias("common"), "besides")


def _linked(percent: int):
    return F.col("common") * (100 + percent) >= percent * (F.col("n_u") + F.col("n_v"))


def _open_pairs(stars: DataFrame, labels: DataFrame, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs (u, v) of different components in one star's group that may be linked though one is not with the centre; and
    the tables that they are read from."""
    c, d = percent, 100 + percent
    named = labels.select(F.col("node").alias("x"), "component")
    rows = stars.select(F.col("u").alias("p"), F.col("v").alias("x"), F.col("n_u").alias("n"), F.col("n_v").alias("size"), (F.col("n_u") - F.col("common")).alias("a"), F.size("besides").alias("b"), "besides", _linked(percent).alias("near"))
    rows = rows.join(named, "x", "left").withColumn("component", F.coalesce("component", "x"))
    rows = rows.withColumns({"high": 100 * F.col("a") + c * F.col("b") - (100 - c) * F.col("n"), "low": c * (F.col("a") - F.col("b"))})
    every = materialize(rows)
    group = every.groupBy("p").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.min("high").alias("high0"), F.max("low").alias("low1"))
    sizes = materialize(every.groupBy("p").agg(F.count("*").alias("n")))
    rows = materialize(join_unique(every, group.where("c0 != c1").drop("c0", "c1"), ["p"], every.count(), sizes))
    discard(every, sizes)
    least = F.ceil(((100 - c) * F.col("a") + c * F.col("b") - (100 - c) * F.col("n")) / 100)
    tokens = rows.where("b > 0").select("p", "x", "component", "size", "n", "a", "b", "near", F.greatest(F.lit(1), least).alias("least"), F.explode("besides").alias("token"))
    often = tokens.groupBy("p", "token").agg(F.count("*").alias("often"))
    tokens = tokens.join(often, ["p", "token"]).withColumn("rank", F.row_number().over(W.partitionBy("p", "x").orderBy("often", "token")))
    tokens = materialize(tokens.where("rank <= b - least + 1 AND often > 1").drop("rank", "often", "n"))

    def side(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
        return df.select(*keys, *[F.col(x).alias(f"{name}_{x}") for x in df.columns if x not in keys])

    apart = (F.col("u_component") != F.col("v_component")) & ~(F.col("u_near") & F.col("v_near"))
    close = F.least("u_size", "v_size") * 100 >= c * F.greatest("u_size", "v_size")
    met = side(tokens, "u", ["p", "token"]).join(side(tokens, "v", ["p", "token"]), ["p", "token"]).where((F.col("u_x") < F.col("v_x")) & apart & close)
    met = met.groupBy("p", "u_x", "v_x", "u_a", "u_b", "v_a", "v_b", F.greatest("u_least", "v_least").alias("least")).agg(F.count("*").alias("shared"))
    centres = rows.select("p", "n").distinct()
    bound = 100 * (F.col("u_a") + F.col("v_a")) + c * (F.col("u_b") + F.col("v_b")) - (100 - c) * F.col("n") - d * F.least("u_a", "v_a")
    met = met.join(centres, "p").where((F.col("shared") + F.col("least") - 1) * d >= bound).select(F.col("u_x").alias("u"), F.col("v_x").alias("v"))
    # the bound asks for nothing besides the centre: high of the one with the larger a is at most low of the other
    thin = rows.drop("besides", "n")
    far = thin.where("NOT near AND (high <= low1 OR low >= high0)")
    plain = side(far, "u", ["p"]).join(side(thin, "v", ["p"]), "p").where((F.col("u_x") != F.col("v_x")) & apart & close & F.when(F.col("u_a") >= F.col("v_a"), F.col("u_high") <= F.col("v_low")).otherwise(F.col("v_high") <= F.col("u_low")))
    return met.unionByName(plain.select(F.least("u_x", "v_x").alias("u"), F.greatest("u_x", "v_x").alias("v"))).distinct(), [rows, tokens]


def _components(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept for every row. A node of the graph is a class of equal sets."""
    base = id_text(docs, id_col, text_col).withColumn("text_hash", text_hash(F.col("text")))
    marks = materialize(sketch(base, k))
    classes = marks.where("n > 0 AND doc_id IS NOT NULL").groupBy("sig_a", "sig_b", "n").agg(F.min(F.struct("doc_id", "text_hash")).alias("least"), F.first("bands").alias("bands"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()))
    cells = classes.select(F.explode("bands").alias("key"), "node", F.col("least.doc_id").alias("doc"))
    shared = cells.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = materialize(cells.join(shared, "key"))
    degree = members.groupBy("node").agg(F.sum("size").alias("degree"))
    centre = members.join(degree, "node").groupBy("key").agg(F.max(F.struct("degree", (-F.col("doc")).alias("o"), "node")).alias("c")).select("key", F.col("c.node").alias("u"))
    pairs = members.join(centre, "key").where("u != node").select("u", F.col("node").alias("v")).distinct()
    # one row stands for each class; rows that repeat both id and text, if there are any, are reduced to one
    stand = classes.join(members.select("node").distinct(), "node", "left_semi").select("node", "least.doc_id", "least.text_hash")
    twice = materialize(marks.groupBy("doc_id", "text_hash").agg(F.count("*").alias("rows")).where("rows > 1").drop("rows"))
    texts = base.join(stand, ["doc_id", "text_hash"])
    if not twice.isEmpty():
        own = ["doc_id", "text_hash"]
        again = base.join(stand.join(twice, own, "left_semi"), own).dropDuplicates(own)
        texts = base.join(stand.join(twice, own, "left_anti"), own).unionByName(again)
    sets = materialize(shingle_sets(texts.select(F.col("node").alias("doc_id"), "text"), k))
    stars = materialize(_compared(pairs, sets))
    first = labels = connected_components(stars.where(_linked(percent)).select("u", "v"))
    candidates, tables = _open_pairs(stars, labels, percent)
    more = _compared(candidates, sets).where(_linked(percent)).select("u", "v")
    name = lambda side: labels.select(F.col("node").alias(side), F.col("component").alias(f"{side}_c"))
    more = more.join(name("u"), "u", "left").join(name("v"), "v", "left").select(F.coalesce("u_c", "u").alias("u"), F.coalesce("v_c", "v").alias("v"))
    over = connected_components(more)
    discard(members, sets, stars, twice, *tables)
    joined = labels.join(over.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    labels = joined.unionByName(over.join(labels.select("node"), "node", "left_anti"))
    named = materialize(classes.drop("bands").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")))
    discard(first, over, classes)
    winners = named.groupBy("component").agg(F.min("least").alias("winner"))
    named = named.join(winners, "component").select("sig_a", "sig_b", "n", "winner")
    out = marks.drop("bands").join(named, ["sig_a", "sig_b", "n"], "left").withColumn("winner", F.when(F.col("doc_id").isNotNull(), F.col("winner")))
    kept = F.col("winner").isNull() | ((F.col("doc_id") == F.col("winner.doc_id")) & (F.col("text_hash") == F.col("winner.text_hash")))
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.coalesce("winner.doc_id", "doc_id").alias("component_id"), kept.alias("kept"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    docs: any DataFrame with a whole-number id and a text; other columns are ignored, whatever their names. Two documents are linked if their shingle sets'
    resemblance is at least ``percent`` / 100; component_id is the smallest doc_id that links reach, kept says that it is
    the document's own (of rows with that id and different texts, the one whose text has the smallest hash). Null and empty
    texts and those without words have the empty set and are linked with nothing. Very long texts are shingled whole, each in
    one task. Rows that share a doc_id are documents of their own if their texts differ, and share their fate if not. A null
    id is linked with nothing: component_id null, kept true. An empty table gives an empty result.
    """
    return _components(docs, k, percent, id_col, text_col).drop("text_hash")


def representatives(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that near_duplicates() keeps, with all their columns; rows with a null id all stay."""
    return without(docs, _components(docs, k, percent, "doc_id", "text").where(~F.col("kept")))
