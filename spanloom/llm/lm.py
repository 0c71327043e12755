"""LM scoring by a hashed maximum-entropy model with a class-factored softmax.

P(word | before) = P(class | before) * P(word | class, before), both factors softmaxes over hashed features. Words fall
into ``CLASSES`` classes by their ending, endings being clustered by the company they keep. P(class | before) reads the last
word's ending, the last word, the last two endings (n-gram) and the ending before the last (skip). P(word | class, before)
is log-linear: the word's count, a weight for its hashed bucket with the class of the last word (n-gram) and one with the
class of the word before that (skip). As these contexts are few, the sum over all words of a class is a product of two
small matrices for all contexts at once, so probabilities are normalised exactly. Words never seen are one event in each
class, without features, so all probabilities sum to one.

Counts are gathered by Spark over all training documents. The weights start from the class bigram counts and are trained
in rounds: each round's tasks run Adagrad on their share of the documents, and their changes are averaged by feature. The
same tasks count what the within-class gradient needs (bucket by context, and contexts); after each round the weights take
gradient steps, scaled by the expected counts, on the sums of all tasks.
Scoring reads head words from a broadcast table of fixed size and joins the others' counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, id_text, materialize, partitions
from .textkit import Prefix, Words, chunks, mix, text_bytes

KEYS, CLASSES, HEAD = 1024, 16, 1 << 18
WORD_BUCKETS, PAIR_BUCKETS = 4096, 8192
#: Rows of the weight matrix: bias, last ending, last word, last two endings, ending before the last.
AT = np.cumsum([0, 1, KEYS, WORD_BUCKETS, PAIR_BUCKETS, KEYS])
FEATURES = int(AT[-1])
#: Buckets of words in each class, and cells of the counts that the within-class gradient needs.
WITHIN = 4096
CELLS = CLASSES * WITHIN * CLASSES
BATCH, ROUNDS, RATE, BLOCK = 1 << 15, 3, 0.15, 256
PART, PRIOR, STEPS = 1 << 15, 4.0, 20  # cells sent together; of the within-class weights: strength of the prior, steps a round
END, END_KEY = np.uint64(0x5851F42D4C957F2D), 0
ADD = 0.1


class Tokens:
    """Words of rows i..j, each row followed by its end: hash, ending key, and where each row starts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, i: int, j: int) -> None:
        words = Words(data, offsets, i, j)
        words.prefix = Prefix(words.data)
        tail = words.prefix(np.maximum(words.start, words.end - 3), words.end)
        key = 1 + (tail >> np.uint64(40)).astype(np.int64) % (KEYS - 1)
        self.hash = np.insert(words.hash(), words.first[1:], END)
        self.key = np.insert(key, words.first[1:], END_KEY)
        self.first = words.first + np.arange(j - i + 1)

    def features(self) -> np.ndarray:
        """(4, tokens): rows of the weight matrix besides the bias; before a text there are ends."""
        n = len(self.hash)
        begin = np.zeros(n, np.int64)
        begin[self.first[:-1]] = self.first[:-1]
        at = np.arange(n) - np.maximum.accumulate(begin)
        key1, key2, last = np.full(n, END_KEY), np.full(n, END_KEY), np.full(n, END)
        key1[1:], last[1:], key2[2:] = self.key[:-1], self.hash[:-1], self.key[:-2]
        key1[at == 0], last[at == 0], key2[at <= 1] = END_KEY, END, END_KEY
        pair = mix((key1 * KEYS + key2).astype(np.uint64))
        return np.stack([AT[1] + key1, AT[2] + (last >> np.uint64(52)).astype(np.int64) % WORD_BUCKETS, AT[3] + (pair % np.uint64(PAIR_BUCKETS)).astype(np.int64), AT[4] + key2])


def contexts(f: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the last word and of the one before it, from Tokens.features()."""
    return own[f[0] - AT[1]], own[f[3] - AT[4]]


def cells(hashes: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The bucket of each word in its class, over all classes."""
    return target * WITHIN + (hashes & np.uint64(WITHIN - 1)).astype(np.int64)


def _batches(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Tokens]]:
    data, offsets = text_bytes(batch.column("text"))
    for i, j in chunks(offsets):
        yield i, j, Tokens(data, offsets, i, j)


def counts(train: DataFrame, flush: int = 1 << 21) -> DataFrame:
    """(kind, h, key, c): kind 0, each word's hash, ending and count; kind 1, each pair of endings (h = last * KEYS + own).

    Tasks add up what they read before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(KEYS * KEYS, np.int64)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            h, key, c = (np.concatenate([x[k] for x in held]) for k in range(3))
            order = np.argsort(h)
            h, key, c = h[order], key[order], c[order]
            edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
            return h[edge], key[edge], np.add.reduceat(c, edge) if len(edge) else c

        def rows(kind: int, h: np.ndarray, key: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch([pa.array(np.full(len(h), kind, np.int32)), pa.array(h), pa.array(key.astype(np.int32)), pa.array(c)], ["kind", "h", "key", "c"])

        for batch in batches:
            for _, _, t in _batches(batch):
                order = np.argsort(t.hash)
                h = t.hash[order]
                edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
                held.append((h[edge], t.key[order][edge], np.diff(np.append(edge, len(h)))))
                size += len(edge)
                pairs += np.bincount((t.features()[0] - AT[1]) * KEYS + t.key, minlength=KEYS * KEYS) if len(h) > KEYS * 64 else 0
                if len(h) <= KEYS * 64:
                    np.add.at(pairs, (t.features()[0] - AT[1]) * KEYS + t.key, 1)
                if size > flush:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > flush // 2:
                        yield rows(0, held[0][0].view(np.int64), held[0][1], held[0][2])
                        held, size = [], 0
        if held:
            h, key, c = merged()
            yield rows(0, h.view(np.int64), key, c)
        hit = np.flatnonzero(pairs)
        yield rows(1, hit, np.zeros(len(hit)), pairs[hit])

    return train.mapInArrow(run, "kind int, h long, key int, c long").groupBy("kind", "h", "key").agg(F.sum("c").alias("c"))


def classes(pairs: np.ndarray, rounds: int = 15) -> np.ndarray:
    """Class of each ending: k-means over the square roots of the shares of the endings before and after it, weighted by
    how often it occurs; seeds are the most frequent endings that lie far from those taken. The end is class 0."""
    weight = pairs.sum(0) + 1e-9
    x = np.concatenate([np.sqrt(pairs / np.maximum(pairs.sum(1, keepdims=True), 1)), np.sqrt(pairs.T / np.maximum(pairs.sum(0)[:, None], 1))], 1).astype(np.float32)
    seeds = [int(np.argmax(np.where(np.arange(KEYS) == END_KEY, 0, weight)))]
    for _ in range(CLASSES - 2):
        far = np.min([((x - x[s]) ** 2).sum(1) for s in seeds], 0)
        seeds.append(int(np.argmax(far * np.sqrt(weight) * (np.arange(KEYS) != END_KEY))))
    centre = x[seeds]
    for _ in range(rounds):
        own = ((centre**2).sum(1) - 2 * x @ centre.T).argmin(1)
        for k in range(len(centre)):
            if (hit := own == k).any():
                centre[k] = np.average(x[hit], axis=0, weights=weight[hit])
    own = own + 1
    own[END_KEY] = 0
    return own


def start_weights(pairs: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The class bigram model: bias log P(class), last ending log P(class | ending) - log P(class)."""
    w = np.zeros((FEATURES, CLASSES), np.float32)
    to = np.zeros((KEYS, CLASSES))
    np.add.at(to.T, own, pairs.T)
    prior = (to.sum(0) + 0.5) / (to.sum() + 0.5 * CLASSES)
    w[0] = np.log(prior)
    w[AT[1] : AT[2]] = np.log((to + 20 * prior) / (to.sum(1, keepdims=True) + 20)) - np.log(prior)
    return w


def _logits(w: np.ndarray, f: np.ndarray) -> np.ndarray:
    out = w[f[0]]
    for row in f[1:]:
        out += w[row]
    out += w[0]
    out -= out.max(1, keepdims=True)
    return out


def _local(w: np.ndarray, square: np.ndarray, seen: np.ndarray, f: np.ndarray, target: np.ndarray) -> None:
    """One Adagrad step on a batch, in place."""
    p = np.exp(_logits(w, f))
    p /= p.sum(1, keepdims=True)
    p[np.arange(len(target)), target] -= 1
    for row in f:
        order = np.argsort(row, kind="stable")
        edge = np.flatnonzero(np.diff(row[order], prepend=-1))
        hit = row[order[edge]]
        size = np.diff(np.append(edge, len(row)))
        g = np.add.reduceat(p[order], edge) / np.sqrt(size)[:, None]
        square[hit] += g * g
        w[hit] -= RATE * g / np.sqrt(square[hit] + 1)
        seen[hit] += size


@dataclass
class Within:
    """P(word | class, before): masses of the buckets (CLASSES, WITHIN) and of the unseen word (CLASSES), and weights
    (CLASSES, WITHIN, CLASSES) for the class of the last word and of the one before it."""

    mass: np.ndarray
    unseen: np.ndarray
    last: np.ndarray
    skip: np.ndarray

    def totals(self) -> np.ndarray:
        """(class, class of the last word, class before it): the sum over all words."""
        return np.matmul((np.exp(self.last) * self.mass[:, :, None]).transpose(0, 2, 1), np.exp(self.skip)) + self.unseen[:, None, None]

    def climb(self, counts: np.ndarray, steps: int) -> None:
        """Gradient steps on the log-likelihood of ``counts`` (bucket by last class, by class before it, and contexts)."""
        seen1, seen2 = (counts[k * CELLS : (k + 1) * CELLS].reshape(self.last.shape) for k in (0, 1))
        n = counts[2 * CELLS :].reshape(CLASSES, CLASSES, CLASSES)
        for _ in range(steps):
            for weights, seen in ((self.last, seen1), (self.skip, seen2)):
                ea, eb = np.exp(self.last) * self.mass[:, :, None], np.exp(self.skip)
                share = n / self.totals()
                expected = ea * np.matmul(eb, share.transpose(0, 2, 1)) if weights is self.last else eb * np.matmul(ea, share)
                weights += np.clip((seen - expected - PRIOR * weights) / (expected + PRIOR), -1, 1)


def _round(train: DataFrame, shared, own: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The class weights after one round (every task's changes, averaged by feature over the tokens that had it), and the
    counts for Within.climb()."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = shared.value
        w, square, seen = start.copy(), np.zeros_like(start), np.zeros(FEATURES)
        counts = np.zeros(2 * CELLS + CLASSES**3, np.uint32)
        for batch in batches:
            for _, _, t in _batches(batch):
                f, target = t.features(), own[t.key]
                c1, c2 = contexts(f, own)
                cell = cells(t.hash, target) * CLASSES
                for at in (cell + c1, CELLS + cell + c2, 2 * CELLS + (target * CLASSES + c1) * CLASSES + c2):
                    hit, times = np.unique(at, return_counts=True)
                    counts[hit] += times.astype(np.uint32)
                for k in range(0, len(target), BATCH):
                    _local(w, square, seen, f[:, k : k + BATCH], target[k : k + BATCH])
        for b in range(0, FEATURES, BLOCK):
            n = seen[b : b + BLOCK]
            if n.any():
                yield pa.record_batch([pa.array([b], pa.int32()), pa.array([(w - start)[b : b + BLOCK].astype(np.float16).tobytes()]), pa.array([n.astype(np.float32).tobytes()])], ["block", "change", "seen"])
        for b in range(0, len(counts), PART):
            part = counts[b : b + PART]
            if part.any():
                yield pa.record_batch([pa.array([-1 - b], pa.int32()), pa.array([part.tobytes()]), pa.array([b""])], ["block", "change", "seen"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, change, n in zip(*(batch.column(c).to_pylist() for c in ("block", "change", "seen")), strict=True):
                if b < 0:
                    part = np.frombuffer(change, np.uint32).astype(np.int64)
                    counts[b] = counts[b] + part if b in counts else part
                    continue
                n = np.frombuffer(n, np.float32).astype(float)
                change = np.frombuffer(change, np.float16).astype(float).reshape(-1, CLASSES) * n[:, None]
                old = sums.setdefault(b, [np.zeros_like(change), np.zeros_like(n)])
                old[0] += change
                old[1] += n
        for b, part in counts.items():
            yield pa.record_batch([pa.array([b], pa.int32()), pa.array([part.tobytes()])], ["block", "change"])
        for b, (change, n) in sums.items():
            yield pa.record_batch([pa.array([b], pa.int32()), pa.array([(change / np.maximum(n, 1)[:, None]).astype(np.float32).tobytes()])], ["block", "change"])

    changes = train.mapInArrow(learn, "block int, change binary, seen binary").repartition(min(parts, -(-FEATURES // BLOCK)), "block")
    out, counts = shared.value.copy(), np.zeros(2 * CELLS + CLASSES**3, np.int64)
    for r in changes.mapInArrow(add, "block int, change binary").collect():  # FEATURES * CLASSES floats and the counts, of fixed size
        if r["block"] < 0:
            part = np.frombuffer(r["change"], np.int64)
            counts[-1 - r["block"] :][: len(part)] = part
            continue
        change = np.frombuffer(r["change"], np.float32).reshape(-1, CLASSES)
        out[r["block"] : r["block"] + len(change)] += change
    return out, counts


@dataclass
class Model:
    table: DataFrame  # h, c of every training word
    tokens: int
    words: int
    own: np.ndarray  # class of each ending
    normal: np.ndarray  # log10 of each class's total
    weights: np.ndarray
    within: Within
    head: tuple[np.ndarray, np.ndarray]  # hashes ascending, log10(c + ADD)


def train(docs: DataFrame) -> Model:
    """docs: (doc_id, text), all of them learnt from."""
    spark = docs.sparkSession
    parts = partitions(spark)
    table = materialize(counts(docs))
    pairs = np.zeros(KEYS * KEYS)
    found = table.where("kind = 1").select("h", "c").toArrow()  # KEYS * KEYS rows at most
    pairs[found["h"].to_numpy()] = found["c"].to_numpy()
    pairs = pairs.reshape(KEYS, KEYS)
    table = table.where("kind = 0")
    by_key = table.groupBy("key").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()  # KEYS rows
    own = classes(pairs)
    n, v = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in by_key:
        n[own[r["key"]]] += r["n"]
        v[own[r["key"]]] += r["v"]
    step = F.floor(F.log2("c") * 8).cast("int")
    least, room = 1 << 30, HEAD  # whole steps of the count, from the highest down, while they fit
    for r in sorted(table.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), reverse=True):  # 512 rows at most
        if r["n"] > room:
            break
        least, room = r["step"], room - r["n"]
    top = table.where(step >= least).select("h", "c").toArrow()  # HEAD rows at most
    h, c = top["h"].to_numpy().view(np.uint64), top["c"].to_numpy()
    order = np.argsort(h)
    weights = start_weights(pairs, own)
    owner = F.element_at(F.lit(own.tolist()), F.col("key") + 1)
    mass, seen = np.zeros((CLASSES, WITHIN)), np.zeros(2 * CELLS + CLASSES**3)
    buckets = table.groupBy(owner.alias("class"), F.pmod("h", F.lit(WITHIN)).alias("low")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()  # CLASSES * WITHIN rows at most
    for r in buckets:
        mass[r["class"], r["low"]] = r["n"] + ADD * r["v"]
    room = n + ADD * (v + 1)
    within = Within(mass / room[:, None], ADD / room, np.zeros((CLASSES, WITHIN, CLASSES)), np.zeros((CLASSES, WITHIN, CLASSES)))
    for k in range(ROUNDS):
        shared = spark.sparkContext.broadcast(weights)
        share = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(ROUNDS)) == k)
        weights, counts_of_round = _round(share, shared, own, parts)
        shared.unpersist()
        seen += counts_of_round
        within.climb(seen, STEPS)
    return Model(table.select("h", "c"), int(n.sum()), int(v.sum()), own, np.log10(room), weights, within, (h[order], np.log10(c[order] + ADD)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score for every row of ``docs`` (doc_id, text)."""
    inside = model.within
    flat = [np.ascontiguousarray(x.reshape(-1), np.float32) for x in (inside.last, inside.skip, np.log(inside.totals()))]
    shared = docs.sparkSession.sparkContext.broadcast((model.own, model.normal, model.weights, *flat, *model.head))  # all of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, normal, w, last, skip, total, head, logs = shared.value
        row = TaskContext.get().partitionId() << 40
        names = ["row", "doc_id", "n_tokens", "n_known", "head", "model", "h", "c", "near"]
        for batch in batches:
            for i, j, t in _batches(batch):
                m, f, target = j - i, t.features(), own[t.key]
                cond = np.empty(len(target))
                for k in range(0, len(target), BATCH):
                    z = _logits(w, f[:, k : k + BATCH])
                    cond[k : k + BATCH] = z[np.arange(len(z)), target[k : k + BATCH]] - np.log(np.exp(z).sum(1))
                c1, c2 = contexts(f, own)
                cell = cells(t.hash, target) * CLASSES
                near = (last[cell + c1] + skip[cell + c2]).astype(float)
                cond -= total[(target * CLASSES + c1) * CLASSES + c2]
                at = np.minimum(np.searchsorted(head, t.hash), max(0, len(head) - 1))
                known = head[at] == t.hash if len(head) else np.zeros(len(t.hash), bool)
                sums = np.add.reduceat(np.stack([known, np.where(known, logs[at] if len(logs) else 0.0, 0.0), (cond + np.where(known, near, 0.0)) / np.log(10) - normal[target]]), t.first[:-1], axis=1)
                rows = row + np.arange(m)
                row += m
                empty = pa.nulls(m, pa.int64())
                yield pa.record_batch([pa.array(rows), batch.column("doc_id").slice(i, m), pa.array(np.diff(t.first)), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2]), empty, empty, pa.nulls(m, pa.float64())], names)
                doc = np.repeat(np.arange(m), np.diff(t.first))[~known]
                rest, near = t.hash[~known], near[~known] / np.log(10)
                order = np.lexsort((rest, doc))
                doc, rest = doc[order], rest[order]
                edge = np.flatnonzero(np.concatenate([[True], (rest[1:] != rest[:-1]) | (doc[1:] != doc[:-1])])) if len(doc) else np.zeros(0, np.int64)
                none, number = pa.nulls(len(edge), pa.int64()), np.diff(np.append(edge, len(doc)))
                yield pa.record_batch([pa.array(rows[doc[edge]]), none, none, none, pa.nulls(len(edge), pa.float64()), pa.nulls(len(edge), pa.float64()), pa.array(rest[edge].view(np.int64)), pa.array(number), pa.array(np.add.reduceat(near[order], edge) if len(edge) else near)], names)

    both = materialize(docs.mapInArrow(run, "row long, doc_id long, n_tokens long, n_known long, head double, model double, h long, c long, near double"))
    tail = both.where("h IS NOT NULL").select("row", "h", F.col("c").alias("times"), "near")
    tail = tail.join(model.table, "h", "left").groupBy("row").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("tail_known"), F.sum(F.col("times") * F.log10(F.coalesce(F.col("c"), F.lit(0)) + F.lit(ADD))).alias("tail"), F.sum(F.when(F.col("c").isNotNull(), F.col("near")).otherwise(0.0)).alias("tail_near"))
    out = both.where("h IS NULL").drop("h", "c", "near").join(tail, "row", "left")
    logs = F.col("head") + F.coalesce("tail", F.lit(0.0))
    whole = float(np.log10(model.tokens + ADD * (model.words + 1)))
    return out.select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), (logs - F.col("n_tokens") * F.lit(whole)).alias("base_score"), (logs + F.col("model") + F.coalesce("tail_near", F.lit(0.0))).alias("score"))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """score() of every row, learning from those not held out, with ``held_out`` and ``train_tokens``.

    Null and empty texts are one end token. Rows with null ids are held out; repeated rows are scored each, and learnt
    from each. Very long texts are read whole, in one task; other columns are ignored, whatever their names. An empty table
    gives an empty result.
    """
    base = id_text(docs, id_col, text_col)
    model = train(base.where(~held_out(F.col("doc_id"), 10)))
    out = score(base, model)
    return out.select("doc_id", held_out(F.col("doc_id"), 10).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
