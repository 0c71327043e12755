"""Suffix-array dedup: maximal repeats from a common-prefix interval tree over a sparse enhanced suffix array.

Anchors make the array sparse and spread it: of every ``LENGTH``-byte string the ``GRAM``-byte grams with the least hash
are anchors, so equal strings have the same anchors at the same places, and all occurrences of a repeated string meet in
the group of its anchor. In a group the suffixes that begin at the anchor are sorted, neighbours' common prefixes give the
intervals by a stack scan, and in each interval the strings before the anchor, sorted backwards, say how far to the left
each occurrence agrees with any other (not just its neighbour). An interval whose occurrences extend no further to the
left than in the intervals inside it adds nothing. Right plus left agreement of ``LENGTH`` or more is a repeat, and the
spans of one occurrence all hold its anchor, so their union is one span.

Occurrences with the same bytes around the anchor, as far as strings with it reach, are one class with a representative:
a class of two or more is repeated as a whole, and only representatives are compared with other classes. Texts that are
equal as a whole are one text with a number of copies, named by a digest of 128 bits. A group of more than ``CROWD`` classes, which a task should not
hold, is narrowed without gathering it: the places where its strings may begin form a range, which is cut into quarters, and
the classes whose strings of a quarter share the same bytes (by a hash of 128 bits, counted with map-side combination) are a
group again. A class alone has no repeat there; up to ``CROWD`` classes are compared by the tree, as bytes. Of more, those
whose bytes that the strings cover together occur again are settled by a second hash, and the rest is quartered again. So a
class is narrowed on only at the ends of what more than ``CROWD`` classes share, and the rows of all steps are a bounded number for each class.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, id_text, join_unique, materialize, partitions
from .textkit import CHUNK, Prefix, chunks, mix, text_bytes

LENGTH, GRAM = 200, 50
WIDTH = LENGTH - GRAM + 1
#: Classes that one task compares at once; larger groups are narrowed until their parts are not.
CROWD = 1024
#: Parts of a range at each step of narrowing.
PARTS = 4
#: Bytes of a text whose anchors are gathered together, so at most as many.
SPAN = 1 << 16


def _sliding(x: np.ndarray, w: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of x[i : i + w] for every i, cut at the end."""
    fill = np.uint64(2**64 - 1) if least else np.uint64(0)
    op = np.minimum if least else np.maximum
    n = -(-(len(x) + w) // w) * w
    padded = np.full(n, fill, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    ahead = op.accumulate(blocks, axis=1).ravel()
    back = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[: len(x)], ahead[w - 1 : w - 1 + len(x)])


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the anchors of concatenated texts that end at ``ends``."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = np.full(n, np.uint64(2**64 - 1))
    hashes = Prefix(data).grams(GRAM)
    grams[: len(hashes)] = hashes
    end = np.repeat(ends, np.diff(ends, prepend=0))
    at = np.arange(n)
    grams[at + GRAM > end] = np.uint64(2**64 - 1)
    least = _sliding(grams, WIDTH, True)
    least[at + LENGTH > end] = 0  # no string starts here
    best = _sliding(least[::-1], WIDTH, False)[::-1]  # the greatest of the minima of the strings that hold the gram
    hit = np.flatnonzero((best == grams) & (best != 0) & (grams != np.uint64(2**64 - 1)))
    return hit, grams[hit]


def _pieces(offsets: np.ndarray, i: int, j: int) -> list[tuple[int, int, int, int, int]]:
    """(row, from, to, first, last) of rows i..j: anchors at first..last count. Texts over two chunks come in parts that
    hold every string which starts in their own chunk, and the bytes around its anchors."""
    out = []
    for r in range(i, j):
        a, b = offsets[r], offsets[r + 1]
        if b - a <= 2 * CHUNK:
            out.append((r, a, b, a, b))
        else:
            out += [(r, max(a, at - WIDTH + 1), min(b, at + CHUNK + LENGTH + WIDTH - 1), at, min(b, at + CHUNK + WIDTH - 1)) for at in range(a, b, CHUNK)]
    return out


def occurrences(docs: DataFrame) -> DataFrame:
    """(h, hull, k, pos, room): anchors of every text; k names the text, hull the bytes that strings with the anchor may
    hold, room is how many of them follow from the anchor on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            keys = batch.column("k")
            for i, j in chunks(offsets):
                parts = _pieces(offsets, i, j)
                for own in [parts] if j - i > 1 or len(parts) == 1 else [[p] for p in parts]:
                    row, begin, end, first, last = (np.array(x) for x in zip(*own, strict=True))
                    raw = data[begin[0] : end[-1]]
                    ends = np.cumsum(end - begin)
                    hit, h = anchors(raw, ends)
                    part = np.searchsorted(ends, hit, "right")
                    at = hit - (ends - (end - begin))[part] + begin[part]
                    keep = (at >= first[part]) & (at < last[part])
                    hit, h, part, at = hit[keep], h[keep], part[keep], at[keep]
                    pos = at - offsets[row[part]]
                    before, room = np.minimum(pos, WIDTH - 1), np.minimum(offsets[row[part] + 1] - at, LENGTH)
                    hull = mix(Prefix(raw)(hit - before, hit + room) + (before * (LENGTH + 1) + room).astype(np.uint64))
                    yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(hull.view(np.int64)), keys.take(pa.array(row[part])), pa.array(pos), pa.array(room.astype(np.int32))], ["h", "hull", "k", "pos", "room"])

    return docs.mapInArrow(run, "h long, hull long, k binary, pos long, room int")


def contexts(texts: DataFrame) -> DataFrame:
    """(h, hull, k, pos, crowd, before, after) of the rows (k, begin, text, anchors), text being the bytes from ``begin`` on:
    up to WIDTH - 1 bytes before an anchor and LENGTH from it on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in CONTEXT]
            for k, begin, text, own in zip(batch.column("k").to_pylist(), batch.column("begin").to_pylist(), batch.column("text"), batch.column("anchors").to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes()
                for a in own:
                    pos = a["pos"] - begin
                    row = (a["h"], a["hull"], k, a["pos"], a["crowd"], raw[max(0, pos - WIDTH + 1) : pos], raw[pos : pos + LENGTH])
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                if len(cols[0]) > 20_000:
                    yield _contexts_batch(cols)
                    cols = [[] for _ in CONTEXT]
            if cols[0]:
                yield _contexts_batch(cols)

    return texts.mapInArrow(run, "h long, hull long, k binary, pos long, crowd boolean, before binary, after binary")


CONTEXT = ("h", "hull", "k", "pos", "crowd", "before", "after")


def _contexts_batch(cols: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], list(CONTEXT))


def _matrix(values: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    length = np.array([len(v) for v in values], np.int64)
    out = np.zeros((len(values), width), np.uint8)
    flat = np.frombuffer(b"".join(values), np.uint8)
    at = np.repeat(np.arange(len(values)) * width - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(len(flat))
    out.ravel()[at] = flat
    return out, length


def _common(m: np.ndarray, length: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows a and b."""
    differ = m[a] != m[b]
    first = np.where(differ.any(1), differ.argmax(1), m.shape[1])
    return np.minimum(first, np.minimum(length[a], length[b]))


def intervals(lcp: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(common prefix, first, last) of every interval of a suffix array, inner ones first; lcp[i] is that of i-1 and i."""
    stack: list[tuple[int, int]] = []  # (value, first)
    for i in range(1, len(lcp) + 1):
        value, first = (int(lcp[i]) if i < len(lcp) else -1), i - 1
        while stack and stack[-1][0] > value:
            v, first = stack.pop()
            yield v, first, i - 1
        if value >= 0 and (not stack or stack[-1][0] < value):
            stack.append((value, first))


def agreement(lcp: np.ndarray, left_rank: np.ndarray, left_lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(left, right) extent of each suffix's repeats of LENGTH or more, 0 where it has none.

    lcp: of neighbours in suffix order; left_rank: each suffix's rank by the bytes before it, backwards; left_lcp: of
    neighbours in that order.
    """
    m = len(lcp)
    left, right, reach = np.zeros(m, np.int64), np.zeros(m, np.int64), np.full(m, -1)
    for value, first, last in intervals(lcp):
        own = np.arange(first, last + 1)
        order = np.argsort(left_rank[own])
        ranks = left_rank[own][order]
        near = np.minimum.reduceat(left_lcp[: ranks[-1] + 1], ranks[:-1] + 1)
        best = np.zeros(len(own), np.int64)
        best[order[:-1]] = near
        best[order[1:]] = np.maximum(best[order[1:]], near)
        grown = best > reach[own]  # left extensions differ from those inside
        reach[own[grown]] = best[grown]
        hit = own[grown & (best + value >= LENGTH)]
        left[hit] = np.maximum(left[hit], reach[hit])
        right[hit] = np.maximum(right[hit], value)
    return left, right


def _settle(h: np.ndarray, before: list[bytes], after: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(left, right) extent of each occurrence of whole groups ``h``."""
    right_m, right_n = _matrix(after, LENGTH)
    left_m, left_n = _matrix([b[::-1] for b in before], WIDTH - 1)
    n = len(h)
    order = np.lexsort((right_m.view(f"S{LENGTH}").ravel(), h))
    back = np.lexsort((left_m.view(f"S{WIDTH - 1}").ravel(), h))
    lcp, left_lcp = np.zeros(n, np.int64), np.zeros(n, np.int64)
    lcp[1:] = _common(right_m, right_n, order[:-1], order[1:])
    left_lcp[1:] = _common(left_m, left_n, back[:-1], back[1:])
    rank = np.empty(n, np.int64)
    rank[back] = np.arange(n)
    edge = np.flatnonzero(np.diff(h[order], prepend=h[order[0]] - 1 if h[order[0]] > -(2**63) else 0)) if n else np.zeros(0, np.int64)
    if n and (not len(edge) or edge[0]):
        edge = np.concatenate([[0], edge])
    size = np.diff(np.append(edge, n))
    left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    two = edge[size == 2]
    r, l = lcp[two + 1], left_lcp[two + 1]  # noqa: E741  both orders keep a group's rows at the same places
    good = r + l >= LENGTH
    for shift in (0, 1):
        left[order[two[good] + shift]], right[order[two[good] + shift]] = l[good], r[good]
    for e, m in zip(edge[size > 2].tolist(), size[size > 2].tolist(), strict=True):
        own = order[e : e + m]
        a, b = agreement(lcp[e : e + m], rank[own] - e, left_lcp[e : e + m])
        left[own], right[own] = a, b
    return left, right


def tree_extents(rows: DataFrame, group: str) -> DataFrame:
    """(h, hull, left, right) from contexts (group, h, hull, before, after) of groups of up to CROWD classes.

    Two groups under one hash are compared as one: bytes decide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            h = table[group].to_numpy()
            cut = int(np.searchsorted(h, h[-1])) if len(h) else 0  # the last group may go on
            held = table.slice(cut)
            if cut:
                yield from settled(table.slice(0, cut))
        if held is not None and held.num_rows:
            yield from settled(held)

    def settled(table: pa.Table) -> Iterator[pa.RecordBatch]:
        h = table[group].to_numpy()
        at = 0
        while at < len(h):  # whole groups, about 20,000 rows at a time
            stop = len(h) if len(h) - at <= 20_000 else int(np.searchsorted(h, h[at + 20_000], "right"))
            part = table.slice(at, stop - at)
            left, right = _settle(part[group].to_numpy(), part["before"].to_pylist(), part["after"].to_pylist())
            hit = np.flatnonzero(right)
            yield pa.record_batch([pa.array(part["h"].to_numpy()[hit]), pa.array(part["hull"].to_numpy()[hit]), pa.array(left[hit]), pa.array(right[hit])], ["h", "hull", "left", "right"])
            at = stop

    rows = rows.select(*{group: 0, "h": 0}, "hull", "before", "after").repartition(group).sortWithinPartitions(group)
    return rows.mapInArrow(run, "h long, hull long, left long, right long")


def _hashed(rows: DataFrame) -> DataFrame:
    """(h, hull, lo, hi, core, core2, whole, whole2) for each part lo..hi of the rows' ``parts``, strings counted by
    their bytes before the anchor: two hashes each of what the part's strings share and of what they cover (null if some
    are not there)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                before, after = part.column("before").to_pylist(), part.column("after").to_pylist()
                ahead, behind = np.array([len(b) for b in before]), np.array([len(a) for a in after])
                raw = np.frombuffer(b"".join(b + a for b, a in zip(before, after, strict=True)), np.uint8)
                anchor = np.cumsum(ahead + behind) - behind
                parts = part.column("parts")
                lo, hi = (parts.flatten().field(c).to_numpy().astype(np.int64) for c in ("lo", "hi"))
                row = np.repeat(np.arange(part.num_rows), np.diff(parts.offsets.to_numpy()))
                there = np.maximum(lo, LENGTH - behind[row]) <= np.minimum(hi, ahead[row])
                lo, hi, row = lo[there], hi[there], row[there]
                salt = (lo * WIDTH + hi).astype(np.uint64)
                full = (hi <= ahead[row]) & (LENGTH - lo <= behind[row])
                hashes = []
                for prefix in (Prefix(raw), Prefix(raw, second=True)):
                    whole = np.zeros(len(row), np.uint64)
                    whole[full] = mix(prefix(anchor[row][full] - hi[full], anchor[row][full] - lo[full] + LENGTH) + salt[full])
                    core = mix(prefix(anchor[row] - lo, anchor[row] - hi + LENGTH) + salt)
                    hashes += [pa.array(core.view(np.int64)), pa.array(whole.view(np.int64), mask=~full)]
                names = ["h", "hull"]
                kept = [part.column(c).take(pa.array(row)) for c in names]
                yield pa.record_batch([*kept, pa.array(lo), pa.array(hi), *hashes], [*names, "lo", "hi", "core", "whole", "core2", "whole2"])

    return rows.mapInArrow(run, "h long, hull long, lo long, hi long, core long, whole long, core2 long, whole2 long")


def _parts(lo: Column, hi: Column) -> Column:
    step = F.ceil((hi - lo + 1) / PARTS).cast("long")
    return F.transform(F.sequence(lo, hi, step), lambda x: F.struct(x.alias("lo"), F.least(x + step - 1, hi).alias("hi")))


def _with_sizes(rows: DataFrame, keys: list[str], name: str, how: str = "inner") -> DataFrame:
    """rows with ``name``: how many of them hold their keys, null (or no row) where it is one or a key is null.

    A key's rows are dealt by hull to as many slots as there are partitions, so that no task counts or meets all rows of a
    frequent one; each row meets one count."""
    dealt = rows.withColumn("slot", F.pmod("hull", F.lit(partitions(rows.sparkSession))).cast("int"))
    shares = dealt.dropna(subset=keys).groupBy(*keys, "slot").agg(F.count("*").alias(name))
    sizes = shares.groupBy(*keys).agg(F.sum(name).alias(name), F.collect_list("slot").alias("slots")).where(F.col(name) > 1)
    return dealt.join(sizes.select(*keys, name, F.explode("slots").alias("slot")), [*keys, "slot"], how).drop("slot")


def crowd_extents(near: DataFrame) -> DataFrame:
    """(h, hull, left, right) of the classes of crowded groups, several rows for some."""
    found = []
    core, whole = ["core", "core2"], ["whole", "whole2"]
    parts = near.select("h", "hull", _parts(F.lit(0).cast("long"), F.lit(WIDTH - 1).cast("long")).alias("parts"))
    while True:
        nodes = materialize(_hashed(near.join(parts, ["h", "hull"])))
        live = materialize(_with_sizes(nodes, core, "n"))
        few = live.where(F.col("n") <= CROWD).select("h", "hull", "core")
        found.append(tree_extents(near.join(few, ["h", "hull"]), "core"))
        many = materialize(_with_sizes(live.where(F.col("n") > CROWD), whole, "every", "left"))
        discard(nodes)
        found.append(many.where("every > 1").select("h", "hull", F.col("hi").alias("left"), (LENGTH - F.col("lo")).alias("right")))
        rest = many.where("every IS NULL AND lo < hi")
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, found)
        # what is settled may still be what an open part agrees with: one witness for all of the same bytes goes on
        witness = many.where("every > 1").groupBy("lo", "hi", *core, *whole).agg(F.min(F.struct("h", "hull")).alias("one"))
        witness = witness.join(rest.select(*core).distinct(), core, "left_semi")
        rest = rest.select("h", "hull", "lo", "hi").unionByName(witness.select("one.*", "lo", "hi"))
        parts = rest.groupBy("h", "hull").agg(F.flatten(F.collect_list(_parts(F.col("lo"), F.col("hi")))).alias("parts"))  # WIDTH at most


def _repeated(df: DataFrame, keys: list[str], *place: str) -> DataFrame:
    """Keys at more than one place, with how many rows they have."""
    sides = [f(c).alias(f"{n}_{c}") for c in place for f, n in ((F.min, "lo"), (F.max, "hi"))]
    differ = " OR ".join(f"lo_{c} != hi_{c}" for c in place)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *sides).where(differ).select(*keys, "n")


def _runs(spans: DataFrame) -> DataFrame:
    """(k, found): the maximal runs that the spans (k, start, stop) cover, ascending.

    Spans are merged where they start, SPAN bytes together, before a text's runs, at most one for LENGTH bytes, are gathered.
    """
    near = W.partitionBy("k", "part").orderBy("start")
    cut = F.coalesce((F.col("start") > F.max("stop").over(near.rowsBetween(W.unboundedPreceding, -1))).cast("int"), F.lit(0))
    spans = spans.distinct().withColumn("part", F.floor(F.col("start") / SPAN)).withColumn("cut", cut).withColumn("run", F.sum("cut").over(near))
    runs = spans.groupBy("k", "part", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return runs.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("found"))


def merged(starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(zip(starts, stops, strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (array<struct<start, stop>>) for every row.

    Bytes that a string of LENGTH bytes covers which also starts elsewhere, in any row or at another place of the same
    one, are removed; spans are the maximal removed runs of bytes. Null texts are empty; null and repeated ids are rows
    like others; other columns are ignored, whatever their names; an empty table gives an empty result. Very long texts are
    searched in parts and put together again whole, in one task. Strings are compared as bytes (what more than
    CROWD classes share, by two hashes of 64 bits).
    """
    base = id_text(docs, id_col, text_col).withColumn("k", F.unhex(F.md5(F.encode("text", "utf-8"))))
    found = materialize(occurrences(base.select("k", "text")))
    often = materialize(_repeated(found, ["h"], "k", "pos"))
    held = materialize(join_unique(found, often.select("h"), ["h"], found.count(), often))
    discard(found, often)
    classes = held.groupBy("h", "hull").agg(F.count("*").alias("times"), F.min(F.struct("k", "pos", "room")).alias("one"), F.min("k").alias("k0"), F.max("k").alias("k1"), F.min("pos").alias("pos0"), F.max("pos").alias("pos1"))
    classes = materialize(classes.select("h", "hull", "times", "one.*", (F.expr("k0 != k1") | F.expr("pos0 != pos1")).alias("many")))
    size = materialize(classes.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    places = join_unique(classes.drop("many", "times", "room"), size.select("h", (F.col("n") > CROWD).alias("crowd")), ["h"], classes.count(), size)
    # a text's anchors are gathered for SPAN bytes at a time, beside those bytes and the ones around that strings may reach
    places = places.groupBy("k", F.floor(F.col("pos") / SPAN).alias("part")).agg(F.collect_list(F.struct("pos", "h", "hull", "crowd")).alias("anchors"))
    length = F.octet_length("text")
    cuts = base.where(length >= LENGTH).select("k", F.encode("text", "utf-8").alias("bytes"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((length - 1) / SPAN))).alias("part"))
    begin = F.greatest(F.lit(0).cast("long"), F.col("part") * SPAN - WIDTH + 1)
    cuts = cuts.select("k", "part", begin.alias("begin"), F.substr("bytes", (begin + 1).cast("int"), ((F.col("part") + 1) * SPAN + LENGTH - begin).cast("int")).alias("text"))
    cuts = cuts.groupBy("k", "part").agg(F.first("begin").alias("begin"), F.first("text").alias("text"))
    near = materialize(contexts(cuts.join(places, ["k", "part"]).select("k", "begin", "text", "anchors")))
    extents = tree_extents(near.where("NOT crowd"), "h")
    crowd = crowd_extents(near.where("crowd").drop("crowd", "k", "pos"))
    before = F.least("pos", F.lit(WIDTH - 1))
    whole = classes.where("many").select("h", "hull", before.alias("left"), F.col("room").cast("long").alias("right")).where(F.col("left") + F.col("right") >= LENGTH)
    extents = extents.unionByName(crowd).unionByName(whole).groupBy("h", "hull").agg(F.max("left").alias("left"), F.max("right").alias("right"))
    extents = materialize(extents)
    spans = join_unique(held, extents, ["h", "hull"], held.count(), classes.select("h", "hull", F.col("times").alias("n")))
    spans = materialize(_runs(spans.select("k", (F.col("pos") - F.col("left")).alias("start"), (F.col("pos") + F.col("right")).alias("stop"))))
    discard(held, classes, size, near, extents)
    texts = base.groupBy("k").agg(F.first("text").alias("text"), F.count("*").alias("copies"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for k, text, copies, own in zip(batch.column("k").to_pylist(), batch.column("text"), batch.column("copies").to_pylist(), batch.column("found").to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes()
                if copies > 1 and len(raw) >= LENGTH:
                    runs = [(0, len(raw))]
                else:
                    runs = merged([s["start"] for s in own or []], [s["stop"] for s in own or []])
                kept, at = hashlib.sha256(), 0
                for a, b in runs:
                    kept.update(raw[at:a])
                    at = b
                kept.update(raw[at:])
                rows.append((k, len(raw), sum(b - a for a, b in runs), len(runs), kept.hexdigest(), [{"start": a, "stop": b} for a, b in runs]))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["k", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    done = texts.join(spans, "k", "left").select("k", "text", "copies", "found").mapInArrow(cut, "k binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,stop:long>>")
    return base.select("doc_id", "k").join(done, "k").drop("k")
