"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its byte n-grams (3 to 6, with the blanks around it) and of the whole word, hashed
into buckets; a passage of ``WINDOW`` words is the mean of its words, and a linear softmax over two classes reads it. A
document scores by its ``TOP`` most toxic passages, weighted by a logistic calibration, so a few words count the same in
short and long texts. Unseen misspellings
share n-gram vectors with the words they come from.

The classifier is fitted on a bounded sample of labelled rows (``max_rows`` of each label, documents of up to
``max_bytes``); every document is scored whole.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text
from .textkit import Prefix, Words, chunks, lean, text_bytes

BUCKETS, GRAMS, DIM, WINDOW, TOP = 1 << 17, (3, 4, 5, 6), 8, 4, 4


@dataclass
class Model:
    """``weight``: each bucket's vector times the difference of the softmax's two columns; scale and shift: calibration."""

    weight: np.ndarray
    bias: float
    scale: np.ndarray
    shift: float


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(47)).astype(np.int64) & (BUCKETS - 1)


def _word_scores(words: Words, weight: np.ndarray) -> np.ndarray:
    """Mean weight of each word's n-grams."""
    words.prefix = words.prefix or Prefix(words.data)
    total = weight[_bucket(words.hash())].astype(float)
    count = np.ones(len(total))
    for q in GRAMS:
        sums = np.zeros(len(words.data) + 1)
        grams = weight[_bucket(words.prefix.grams(q))]
        np.cumsum(grams, out=sums[1 : len(grams) + 1])
        sums[len(grams) + 1 :] = sums[len(grams)]
        number = np.maximum(words.end - words.start + 3 - q, 0)
        total += np.where(number > 0, sums[words.start - 1 + number] - sums[words.start - 1], 0)
        count += number
    return total / count


def _passages(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, number of words) of each passage: ``WINDOW`` words, a row's last one with its remainder."""
    n = np.diff(first)
    number = np.where(n > 0, np.maximum(n // WINDOW, 1), 0)
    row = np.repeat(np.arange(len(n)), number)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
    start = first[row] + nth * WINDOW
    last = nth == number[row] - 1
    return row, start, np.where(last, first[row + 1] - start, WINDOW)


def _best(scores: np.ndarray, first: np.ndarray, base: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each row: its ``TOP`` highest passage scores, falling (``base`` where it has fewer), and their numbers (-1)."""
    row, start, length = _passages(first)
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    value = (sums[start + length] - sums[start]) / np.maximum(length, 1) + base
    order = np.lexsort((-value, row))
    nth = np.arange(len(row)) - np.searchsorted(row, row)  # rows ascend, so the order within them is a rank
    out, which = np.full((len(first) - 1, TOP), base), np.full((len(first) - 1, TOP), -1)
    keep = nth < TOP
    out[row[keep], nth[keep]] = value[order][keep]
    which[row[keep], nth[keep]] = order[keep]
    return out, which


def score_texts(column: pa.Array, model: Model) -> np.ndarray:
    """Each text's probability of being toxic; a text without words scores as one of neutral words."""
    data, offsets = text_bytes(column)
    out = np.full((len(column), TOP), model.bias)
    for i, j in chunks(offsets):
        words = Words(data, offsets, i, j)
        if len(words.start):
            out[i:j] = _best(_word_scores(words, model.weight), words.first, model.bias)[0]
    return 1 / (1 + np.exp(-np.clip(out @ model.scale + model.shift, -60, 60)))


def _features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words as bags of buckets (offsets, values), each text's words as indices (first, index)."""
    data, offsets = text_bytes(texts)
    parts = list(chunks(offsets))
    hashes, firsts = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for i, j in parts:
        words = Words(data, offsets, i, j)
        hashes.append(words.hash())
        firsts.append(words.first[1:] + firsts[-1][-1])
    uniq, seen, inverse = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    order = np.argsort(seen)  # words are numbered as they come
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order))
    seen = seen[order]
    bags, sizes, base = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
    for i, j in parts:
        words = Words(data, offsets, i, j)
        own = words.hash()
        new = seen[np.searchsorted(seen, base) : np.searchsorted(seen, base + len(own))] - base
        base += len(own)
        start, length = words.start[new] - 1, words.end[new] - words.start[new] + 2
        number = np.stack([np.ones(len(start), np.int64), *(np.maximum(length - q + 1, 0) for q in GRAMS)], 1)
        flat = np.zeros(number.sum(), np.int32)
        to = np.cumsum(number.ravel()).reshape(number.shape) - number  # where each word's grams of each length go
        flat[to[:, 0]] = _bucket(own[new])
        for c, q in enumerate(GRAMS, 1):
            n = number[:, c]
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            flat[np.repeat(to[:, c], n) + nth] = _bucket(words.prefix.grams(q)[np.repeat(start, n) + nth])
        bags.append(flat)
        sizes.append(number.sum(1))
    return np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), np.concatenate(bags), np.concatenate(firsts), rank[inverse.ravel()]


def fit(texts: pa.Array, toxic: np.ndarray, epochs: int = 6, rate: float = 0.5, seed: int = 7) -> Model:
    """Adagrad on passages; after the first epoch a toxic text is stood for by its most toxic passages only.

    With no text of one of the labels, every text gets the share of toxic texts.
    """
    toxic = np.asarray(toxic, bool)
    if not len(toxic) or toxic.all() or not toxic.any():
        share = float(toxic.mean()) if len(toxic) else 0.0
        return Model(np.zeros(BUCKETS, np.float32), 0.0, np.zeros(TOP), float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    rng = np.random.default_rng(seed)
    bag_off, bag, first, index = _features(texts)
    size = np.diff(bag_off)
    vectors = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    soft = np.zeros((DIM, 2), np.float32)
    soft[:, 1] = rng.normal(0, 0.5, DIM)
    bias = np.zeros(2, np.float32)
    sq_v, sq_s, sq_b = np.full(BUCKETS, 1e-6, np.float32), np.full(soft.shape, 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    row, start, length_of = _passages(first)
    number = np.bincount(row, minlength=len(toxic))
    begin = np.cumsum(number) - number

    def word_scores() -> np.ndarray:
        s = vectors @ (soft[:, 1] - soft[:, 0])
        out = np.zeros(len(size))
        for k in range(0, len(size), 1 << 14):  # a part of the words at a time: their grams are many
            own = bag_off[k : k + (1 << 14) + 1]
            out[k : k + len(own) - 1] = np.add.reduceat(s[bag[own[0] : own[-1]]].astype(float), own[:-1] - own[0])
        return out / np.maximum(size, 1)

    for epoch in range(epochs):
        _, which = _best(word_scores()[index], first, 0.0)
        chosen = [np.zeros(0, np.int64)]
        for k in np.flatnonzero(number):
            if toxic[k]:
                chosen.append(which[k][which[k] >= 0][: TOP - 1] if epoch else begin[k] + rng.integers(0, number[k], 8))
            else:
                chosen.append(np.concatenate([which[k][which[k] >= 0][:2], begin[k] + rng.integers(0, number[k], 6 if epoch else 8)]))
        chosen = np.concatenate(chosen)
        labels, starts = toxic[row[chosen]].astype(int), start[chosen]
        stop = starts + length_of[chosen]
        order = rng.permutation(len(starts))
        for k in range(0, len(order), 256):
            own = order[k : k + 256]
            length = stop[own] - starts[own]
            flat = np.repeat(starts[own] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
            passage, word = np.repeat(np.arange(len(own)), length), index[flat]
            parts = size[word]
            buckets = bag[np.repeat(bag_off[word] - np.concatenate([[0], np.cumsum(parts)[:-1]]), parts) + np.arange(parts.sum())]
            passage = np.repeat(passage, parts)
            share = np.repeat(1 / (parts * length[np.repeat(np.arange(len(own)), length)]), parts).astype(np.float32)
            edges = np.flatnonzero(np.diff(passage, prepend=-1))
            mean = np.add.reduceat(vectors[buckets] * share[:, None], edges)
            logit = mean @ soft + bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(own)), labels[own]] -= 1
            g_soft, g_bias, g_mean = mean.T @ p / len(own), p.mean(0), p @ soft.T
            by = np.argsort(buckets, kind="stable")
            edges = np.flatnonzero(np.diff(buckets[by], prepend=-1))
            g = np.add.reduceat(g_mean[passage[by]] * share[by, None], edges)
            hit = buckets[by][edges]
            sq_v[hit] += (g * g).mean(1)
            vectors[hit] -= rate * g / np.sqrt(sq_v[hit])[:, None]
            sq_s += g_soft**2
            soft -= 0.1 * g_soft / np.sqrt(sq_s)
            sq_b += g_bias**2
            bias -= 0.1 * g_bias / np.sqrt(sq_b)
    weight = (vectors @ (soft[:, 1] - soft[:, 0])).astype(np.float32)
    shift = float(bias[1] - bias[0])
    x = np.column_stack([_best(word_scores()[index], first, shift)[0], np.ones(len(toxic))])
    y, prior = toxic.astype(float), np.array([*[1.0, *[0.0] * (TOP - 1)], 0.0])
    held, w = np.diag([*[1.0] * TOP, 0.01]), prior.copy()
    for _ in range(50):  # Newton steps of a logistic calibration, held near the best passage's own logit
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve((x * (q * (1 - q) + 1e-6)[:, None]).T @ x + held, x.T @ (q - y) + held @ (w - prior))
    return Model(weight, shift, w[:TOP], float(w[TOP]))


def sample(docs: DataFrame, labels: DataFrame, max_rows: int, max_bytes: int) -> DataFrame:
    """(text, toxic) of about ``max_rows`` documents of each label, first in the order of a hash of their id, in one partition.

    Rows with a null id or another label than 0 or 1 are left out; an id with both labels counts as toxic.
    These are at most 3 * max_rows * max_bytes bytes, whatever the size of the tables.
    """
    labels = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, F.lit(max_rows / max(1, counts.get(1, 0)))).otherwise(F.lit(max_rows / max(1, counts.get(0, 0))))
    chosen = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20)).orderBy(F.xxhash64("doc_id")).limit(2 * max_rows)
    rows = id_text(docs).where(F.octet_length("text") <= max_bytes).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic").orderBy(F.xxhash64("doc_id"), F.xxhash64("text")).limit(3 * max_rows)
    return rows.select("text", "toxic")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 2500, max_bytes: int = 12_000) -> Model:
    """fit() on the sample, in one task: what is bounded fits there, and only the model reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = list(batches)
        texts = pa.chunked_array([b.column("text") for b in own], pa.string()).combine_chunks()
        toxic = np.concatenate([np.zeros(0, np.int64), *(b.column("toxic").to_numpy().astype(np.int64) for b in own)])
        yield pa.record_batch([pa.array([pickle.dumps(fit(texts, toxic))], pa.binary())], ["model"])

    row = sample(docs, labels, max_rows, max_bytes).mapInArrow(lean(run), "model binary").first()
    return pickle.loads(row["model"]) if row else fit(pa.array([], pa.string()), np.zeros(0))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score for every row of ``docs``.

    Null texts score as empty ones, null ids stay null, repeated rows are scored each, equal texts alike; a very long text
    is read whole, in one task; other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column("doc_id"), pa.array(score_texts(batch.column("text"), shared.value))], ["doc_id", "score"])

    return id_text(docs, id_col, text_col).mapInArrow(lean(run), "doc_id long, score double")


def clean_only(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score under the threshold, with all their columns, in one pass without a shuffle."""
    shared, schema = docs.sparkSession.sparkContext.broadcast(model), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            yield batch.filter(pa.array(score_texts(text, shared.value) < threshold))

    return docs.mapInArrow(lean(run), schema)
