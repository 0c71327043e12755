"""Divergence of a language's sources by a K-squared quadtree over the matrix of groups and terms.

A group is a language and a source; a language keeps the terms of enough of its documents. Counts are gathered chunk by chunk
and summed by Spark. A language's matrix (groups by kept terms, mostly zeros) is cut into blocks of columns and strips of rows;
a task takes one block and a pair of strips. There the nonzero cells are the leaves of a quadtree: a node of a level is a
square with a nonzero cell in it. Pairs of squares that share their columns are traversed jointly from the root: a pair of
which both squares are zero is a uniform quadrant, in which every term adds the same to a pair of groups, so its terms are only
counted and priced once; the others are split down to pairs of cells. What leaves the task is a row for each pair of groups,
with the sum over its cells and their number; Spark adds the rows of all blocks, and every term of the language that no cell
accounts for costs what a pair of zeros does.

All arithmetic is on whole numbers. A term's share is p = 1 + floor(SCALE * (count + 2) / (N + 2 V)), N the counted terms of
the group (or the language), V the language's kept terms; two shares diverge by floor((p - q)^2 / (p + q)).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, join_unique, materialize
from .textkit import chunks, lean, text_bytes

#: What cuts terms: ASCII other than small letters (capitals are small by then).
CUTS = r"[\x00-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000
#: Columns of a block and rows of a strip.
BLOCK, STRIP = 1024, 256
#: Bytes of a chunk of texts, and pairs of squares split at once.
CHUNK, AT_ONCE = 1 << 22, 1 << 17


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows with it) by chunk, from (lang, source, text) without nulls; a null
    term stands once in each chunk for a group, whether it has terms or not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, sources = (pc.dictionary_encode(batch.column(c)) for c in ("lang", "source"))
            own = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
            for i, j in chunks(text_bytes(batch.column("text"))[1], CHUNK):
                split = pc.split_pattern_regex(pc.ascii_lower(batch.column("text").slice(i, j - i)), pattern=CUTS)
                row, word = pc.list_parent_indices(split).to_numpy().astype(np.int64), pc.list_flatten(split)
                there = pc.not_equal(word, "")
                row, encoded = row[there.to_numpy(zero_copy_only=False)], pc.dictionary_encode(word.filter(there))
                size, index = max(len(encoded.dictionary), 1), encoded.indices.to_numpy()
                cell, n = np.unique(row * size + index, return_counts=True)  # (row, term)
                key, at = np.unique(own[i:j][cell // size] * size + cell % size, return_inverse=True)  # (group, term)
                total, rows = np.bincount(at, n, len(key)).astype(np.int64), np.bincount(at, minlength=len(key))
                alone = np.unique(own[i:j])
                group = np.concatenate([key // size, alone])
                terms = pa.concat_arrays([encoded.dictionary.take(pa.array(key % size)), pa.nulls(len(alone), encoded.dictionary.type)])
                zeros = np.zeros(len(alone), np.int64)
                out = [langs.dictionary.take(pa.array(group // len(sources.dictionary))), sources.dictionary.take(pa.array(group % len(sources.dictionary))), terms, pa.array(np.concatenate([total, zeros])), pa.array(np.concatenate([rows, zeros]))]
                yield pa.record_batch(out, ["lang", "source", "term", "n", "docs"])

    return docs.mapInArrow(lean(run), "lang string, source string, term string, n long, docs long")


class QuadTree:
    """The nonzero cells of a matrix, and the occupied squares that hold them, level by level up to the root.

    A square of level s has 2^s rows and columns and the number (row >> s) * width + (column >> s).
    """

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, height: int) -> None:
        self.height, self.width = height, 1 << height
        order = np.lexsort((column, row))
        row, column, self.value = row[order], column[order], value[order]
        self.levels = [np.unique((row >> s) * self.width + (column >> s)) for s in range(height + 1)]

    def _at(self, s: int, row: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, square = self.levels[s], row * self.width + column
        at = np.minimum(np.searchsorted(own, square), len(own) - 1)
        return at, own[at] == square

    def occupied(self, s: int, row: np.ndarray, column: np.ndarray) -> np.ndarray:
        return self._at(s, row, column)[1] if len(self.value) else np.zeros(len(row), bool)

    def cells(self, row: np.ndarray, column: np.ndarray, otherwise: np.ndarray) -> np.ndarray:
        """The values of cells, ``otherwise`` where there is none."""
        if not len(self.value):
            return otherwise
        at, there = self._at(0, row, column)
        return np.where(there, self.value[at], otherwise)


def diverge(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def joint_sums(a: QuadTree, b: QuadTree, zero_a: np.ndarray, zero_b: np.ndarray, columns: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``a`` and each of ``b``: the divergence over the columns in which one of them has a cell, and how many
    these are. zero_a, zero_b: each row's share without a cell. same: both are one tree, and only pairs of a row and a later
    one (or itself) are visited.
    """
    total, met = np.zeros((len(zero_a), len(zero_b)), np.int64), np.zeros((len(zero_a), len(zero_b)), np.int64)
    quarter = np.arange(8)

    def below(s: int, r1: np.ndarray, r2: np.ndarray, c: np.ndarray) -> None:
        """Visits pairs of squares of level s, of which at least one is occupied."""
        if not s:
            f = diverge(a.cells(r1, c, zero_a[r1]), b.cells(r2, c, zero_b[r2]))
            pair, own = np.unique(r1 * len(zero_b) + r2, return_inverse=True)
            total.ravel()[pair] += np.bincount(own, f // (1 << 20), len(pair)).astype(np.int64) * (1 << 20) + np.bincount(own, f % (1 << 20), len(pair)).astype(np.int64)
            met.ravel()[pair] += np.bincount(own, minlength=len(pair))
            return
        s -= 1
        for k in range(0, len(r1), AT_ONCE):
            part = slice(k, k + AT_ONCE)
            x, y, z = ((2 * v[part, None] + (quarter >> bit & 1)).ravel() for v, bit in ((r1, 2), (r2, 1), (c, 0)))
            inside = (x << s < len(zero_a)) & (y << s < len(zero_b)) & (z << s < columns)
            keep = inside & (x <= y) if same else inside
            x, y, z = x[keep], y[keep], z[keep]
            mixed = a.occupied(s, x, z) | b.occupied(s, y, z)  # the others are uniform: nothing below them is visited
            below(s, x[mixed], y[mixed], z[mixed])

    root = np.zeros(min(len(a.value) + len(b.value), 1), np.int64)
    below(a.height, root, root, root)
    return total, met


def _block(table: pa.Table) -> pa.Table:
    """Pairs of groups of a block and two strips. Rows without a term name the groups (number, source, share without a cell)."""
    named = pc.is_null(table.column("term"))
    groups, cells = table.filter(named), table.filter(pc.invert(named))
    strip, number = groups.column("strip").to_numpy(), groups.column("number").to_numpy()
    term = cells.column("term").combine_chunks().dictionary_encode()
    term = term.combine_chunks() if isinstance(term, pa.ChunkedArray) else term
    column = term.indices.to_numpy().astype(np.int64)
    columns = len(term.dictionary)
    size = [int(x) for x in (table.column("strip1")[0].as_py(), table.column("strip2")[0].as_py())]
    sides = [size[0]] if size[0] == size[1] else size
    height = int(max(columns, *[int((strip == s).sum()) for s in sides], 1) - 1).bit_length()
    # columns of the same groups side by side, so that squares are full or empty
    order = np.argsort(np.bincount(column, minlength=columns), kind="stable")[::-1]
    place = np.empty(columns, np.int64)
    place[order] = np.arange(columns)
    trees, zeros, names = [], [], []
    for s in sides:
        own = np.flatnonzero(strip == s)
        own = own[np.argsort(number[own])]
        first = int(number[own[0]])
        there = cells.column("strip").to_numpy() == s
        trees.append(QuadTree(cells.column("number").to_numpy()[there] - first, place[column[there]], cells.column("p").to_numpy()[there], height))
        zeros.append(groups.column("p").to_numpy()[own])
        names.append(groups.column("source").take(pa.array(own)))
    same = len(sides) == 1
    total, met = joint_sums(trees[0], trees[-1], zeros[0], zeros[-1], columns, same)
    i, j = np.triu_indices(len(zeros[0]), 1) if same else (x.ravel() for x in np.indices(total.shape))
    out = [pa.array([table.column("lang")[0].as_py()] * len(i), pa.string()), names[0].take(pa.array(i)), names[-1].take(pa.array(j)), pa.array(total[i, j]), pa.array(met[i, j]), pa.array(diverge(zeros[0][i], zeros[-1][j])), pa.array(np.full(len(i), table.column("kept")[0].as_py(), np.int64))]
    return pa.table(out, ["lang", "source", "item", "total", "met", "zero", "kept"])


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _share(count: Column, total: Column, kept: Column) -> Column:
    """A term's share; in decimals, as SCALE times a count may be too much for a long. Without kept terms: 1."""
    whole = lambda x: x.cast("decimal(19,0)")
    return 1 + F.when(kept > 0, _div(whole(count + 2) * F.lit(SCALE).cast("decimal(10,0)"), whole(total + 2 * kept))).otherwise(F.lit(0))


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10, block: int = BLOCK, strip: int = STRIP, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: how far a language's sources are from each other, and by which terms each
    stands out from its language.

    Part ``pair``: each other source of the language, with the divergence over all kept terms, all ranks. Part ``term``: the
    ``top`` kept terms of the group whose share there is over that in the language. A language keeps the terms that occur in
    ``least_docs`` of its rows. Ranks go by value, then item in order of its UTF-8 bytes. Null texts, languages and sources
    are empty ones; groups without terms have pairs too; a language with one source has no pair, one without kept terms has
    pairs of value 0; repeated rows count as often as they are there; very long texts are read whole, as one chunk; other
    columns are ignored, whatever their names; an empty table gives an empty result.
    """
    base = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    cells = materialize(counted(base).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    terms = cells.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
    terms = materialize(terms.where(F.col("docs") >= least_docs).drop("docs"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    held = materialize(cells.drop("docs").join(terms, ["lang", "term"]))
    sums = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = cells.where("term IS NULL").select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "kept", "lang_total"])
    by_lang = W.partitionBy("lang")  # a row for each group
    groups = groups.withColumns({"number": F.row_number().over(by_lang.orderBy("source")).cast("long") - 1, "strips": F.ceil(F.count("*").over(by_lang) / F.lit(strip)), "blocks": F.greatest(F.lit(1), F.ceil(F.col("kept") / F.lit(block)))})
    groups = materialize(groups.withColumn("strip", F.floor(F.col("number") / F.lit(strip))))
    full = join_unique(held, groups, ["lang", "source"], held.count())
    full = materialize(full.withColumns({"p": _share(F.col("n"), F.col("total"), F.col("kept")), "q": _share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))}))
    discard(cells, terms, held)

    columns = ["lang", "source", "kept", "strips", "strip", "number", "term", "p", "block"]
    cell_rows = full.withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks"))).select(*columns)
    zero = _share(F.lit(0).cast("long"), F.col("total"), F.col("kept"))
    name_rows = groups.withColumns({"p": zero, "term": F.lit(None).cast("string"), "block": F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))}).select(*columns)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("strips") - 1))
    both = cell_rows.unionByName(name_rows).withColumn("other", other)
    both = both.withColumns({"strip1": F.least("strip", "other"), "strip2": F.greatest("strip", "other")}).drop("other", "strips")
    pairs = both.groupBy("lang", "block", "strip1", "strip2").applyInArrow(_block, "lang string, source string, item string, total long, met long, zero long, kept long")
    pairs = pairs.groupBy("lang", "source", "item").agg((F.sum("total") + (F.max("kept") - F.sum("met")) * F.max("zero")).alias("value"))
    pairs = materialize(pairs)
    pairs = pairs.unionByName(pairs.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    over = full.where("p > q").withColumn("value", _div((F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("p") + F.col("q")))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    own = over.select("lang", "source", F.col("term").alias("item"), "value").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return out.unionByName(own.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
