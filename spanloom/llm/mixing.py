"""Mixing sources to target weights by soft membership.

A classifier fitted on a labelled table gives every document a posterior over domains. Nonnegative document rates r_d
minimise sum_k (E_k - T_k)^2 / w_k with E_k = sum_d r_d n_d p_dk the expected tokens of domain k, T_k its target and
w_k = sum_d n_d^2 p_dk, by projected gradient steps from r = 1. These weights bound the curvature by one in every domain, so
that scarce domains reach their targets as fast as common ones; a line search lengthens the steps where soft posteriors would make
them slow. A step needs only E (one number for each domain and length tried), summed by Spark over all documents; a document's rate after t steps follows from its own n_d, p_d and the t residuals, so no rate table
is rewritten between steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, materialize, text_hash
from .textkit import Words, chunks, lean, release, text_bytes

BUCKETS = 1 << 16
#: Lengths of a gradient step that are tried together, the first one safe for any data.
SCALES = [float(1 << i) for i in range(8)]
PATIENCE = 5


@dataclass
class Classifier:
    domains: list[str]
    logs: np.ndarray  # (BUCKETS, domains): log probability of a word's bucket
    prior: np.ndarray


def _bucket(words: Words) -> np.ndarray:
    return (words.hash() >> np.uint64(48)).astype(np.int64)


def fit_domains(docs: DataFrame, labels: DataFrame, max_rows: int = 3000, max_bytes: int = 20_000) -> Classifier:
    """Naive Bayes over hashed words, its logs averaged per word so that long texts stay soft.

    labels: (doc_id, domain). About ``max_rows`` labelled rows of up to ``max_bytes`` bytes are used: a bounded sample
    drawn by a hash of the id, first in the order of that hash, so that runs agree. An id with several labels counts as
    the least of them. With no labelled row there is one domain, "all". Words are counted in the task that holds the
    sample; the driver gets the counts.
    """
    labels = labels.where("doc_id IS NOT NULL AND domain IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("domain").alias("domain"))
    total = labels.count()
    chosen = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(max_rows / max(1, total) * (1 << 20))).orderBy(F.xxhash64("doc_id")).limit(2 * max_rows)
    rows = id_text(docs).where(F.octet_length("text") <= max_bytes).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "domain").orderBy(F.xxhash64("doc_id"), F.xxhash64("text")).limit(4 * max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words of each domain, counted by bucket; one row for each domain of a batch."""
        for batch in batches:
            own = pc.dictionary_encode(batch.column("domain"))
            y = own.indices.to_numpy()
            counts = np.zeros((len(own.dictionary), BUCKETS), np.int64)
            data, offsets = text_bytes(batch.column("text"))
            for i, j in chunks(offsets):
                words = Words(data, offsets, i, j)
                np.add.at(counts, (y[i + words.doc], _bucket(words)), 1)
            number = np.bincount(y, minlength=len(counts))
            yield pa.record_batch([own.dictionary, pa.array(number), pa.array([c.tobytes() for c in counts], pa.binary())], ["domain", "n", "counts"])

    seen: dict[str, tuple[int, np.ndarray]] = {}
    for row in rows.select("text", "domain").mapInArrow(lean(run), "domain string, n long, counts binary").toLocalIterator():
        n, counts = seen.get(row["domain"], (0, np.zeros(BUCKETS, np.int64)))
        seen[row["domain"]] = n + row["n"], counts + np.frombuffer(row["counts"], np.int64)
    names = sorted(seen) or ["all"]
    counts = np.stack([seen[d][1] if d in seen else np.zeros(BUCKETS) for d in names], 1) + 0.1
    prior = np.log(np.array([seen[d][0] if d in seen else 0 for d in names]) + 1.0)
    release()
    return Classifier(names, np.log(counts / counts.sum(0)).astype(np.float32), prior - np.log(np.exp(prior).sum()))


def posteriors(docs: DataFrame, model: Classifier, sharpness: float = 20.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, n_tokens (words), posterior array<double> in the order of ``model.domains``, for every row.

    Null and empty texts and those without words get the prior; null and repeated ids are rows like others; other columns
    are ignored, whatever their names; a very long text is read whole, in one task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS * domains floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        size = len(model.domains)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for i, j in chunks(offsets):
                words = Words(data, offsets, i, j)
                n, bucket = np.diff(words.first), _bucket(words)
                logit = np.empty((j - i, size))
                for d in range(size):
                    sums = np.concatenate([[0.0], np.cumsum(model.logs[bucket, d], dtype=float)])
                    logit[:, d] = model.prior[d] + (sums[words.first[1:]] - sums[words.first[:-1]]) * np.minimum(1, sharpness / np.maximum(n, 1))
                p = np.exp(logit - logit.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                yield pa.record_batch([*(batch.column(c).slice(i, j - i) for c in ("doc_id", "text_hash")), pa.array(n.astype(np.int64)), pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), size).cast(pa.list_(pa.float64()))], ["doc_id", "text_hash", "n_tokens", "posterior"])

    base = id_text(docs, id_col, text_col).withColumn("text_hash", text_hash(F.col("text")))
    return base.mapInArrow(lean(run), "doc_id long, text_hash long, n_tokens long, posterior array<double>")


def _rates(tokens: np.ndarray, p: np.ndarray, steps: np.ndarray, high: float | None) -> np.ndarray:
    """Rates after the given residual steps: r <- max(0, r - (n / mean n) * p . step), at most ``high``."""
    r = np.ones(len(tokens))
    for step in steps:
        r = np.clip(r - tokens * (p @ step), 0.0, high)
    return r


@dataclass
class Fit:
    """How mix() ended: the steps taken, each domain's expected total and target, and whether they agree."""

    steps: int
    totals: list[float]
    targets: list[float]
    reached: bool


def mix(soft: DataFrame, targets: list[float], total: float | None = None, steps: int | None = None, max_rate: float | None = None) -> DataFrame:
    """The rows of fit_rates(), without its account."""
    return fit_rates(soft, targets, total, steps, max_rate)[0]


def fit_rates(soft: DataFrame, targets: list[float], total: float | None = None, steps: int | None = None, max_rate: float | None = None) -> tuple[DataFrame, Fit]:
    """soft (doc_id, n_tokens, posterior, and text_hash if it is there) plus ``rate`` and ``copies``, and how close the totals came.

    targets: weight of each domain (they are normalised); total: tokens wanted, by default those there are. copies is
    the whole part of the rate plus one for the share of ids, by hash, that the fraction says, so its mean is the rate.
    Each step tries the gradient times each of ``SCALES`` in one pass and takes the one with the least objective; as the
    first is within the curvature, the objective never grows. Steps go on until the domains' totals are within 1e-4 of the
    targets, or ``PATIENCE`` steps have not lowered the objective by a hundredth (targets out of reach); ``steps`` limits them. Rates are only held at 0 or more, unless ``max_rate`` is given.
    Documents without words keep rate 1; so do rows with null ids, which count into the totals and get one copy. Rows that
    share an id share the draw, each with its own rate. An empty table gives an empty result.
    """
    size = len(targets)
    names = {"doc_id": "long", **({"text_hash": "long"} if "text_hash" in soft.columns else {}), "n_tokens": "long", "posterior": "array<double>"}
    soft = soft.select(*names, F.col("doc_id").isNotNull().alias("known"))
    there = soft.agg(F.sum("n_tokens").alias("n"), F.avg("n_tokens").alias("mean"), *[F.sum(F.col("n_tokens").cast("double") * F.col("n_tokens") * F.col("posterior")[k]).alias(f"s{k}") for k in range(size)]).first()
    n, mean = float(there["n"] or 0), float(there["mean"] or 1) or 1.0
    wanted = np.array(targets, float) / sum(targets) * (n if total is None else total)
    reach = np.array([float(there[f"s{k}"] or 0) / mean or 1.0 for k in range(size)])
    history: list[np.ndarray] = []

    def columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return batch.column("n_tokens").to_numpy(), batch.column("posterior").flatten().to_numpy().reshape(-1, size), batch.column("known").to_numpy(zero_copy_only=False)

    def totals(last: list[np.ndarray]) -> np.ndarray:
        """The domains' totals after the steps so far and each of ``last``, summed in one pass."""
        taken, high = np.array(history).reshape(-1, size), max_rate
        sums_of = [f"e{i}" for i in range(len(last) * size)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                tokens, p, free = columns(batch)
                r = _rates(tokens / mean, p, taken, high)
                e = [(np.where(free, np.clip(r - tokens / mean * (p @ x), 0.0, high) if x.any() else r, 1.0) * tokens) @ p for x in last]
                yield pa.record_batch([pa.array([float(x)]) for x in np.concatenate(e)], sums_of)

        sums = soft.select("n_tokens", "posterior", "known").mapInArrow(lean(run), ", ".join(f"{x} double" for x in sums_of))
        return np.array(sums.agg(*[F.coalesce(F.sum(x), F.lit(0.0)) for x in sums_of]).first(), float).reshape(-1, size)

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, p, free = columns(batch)
            rate = np.where(free, _rates(tokens / mean, p, np.array(history).reshape(-1, size), max_rate), 1.0)
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(rate)], [*names, "rate"])

    e = totals([np.zeros(size)])[0]
    ways = [float(((e - wanted) ** 2 / reach).sum())]  # the objective after each step
    while True:
        reached = float(np.abs(e - wanted).sum()) <= 1e-4 * max(wanted.sum(), 1)
        if reached or len(history) == steps or (len(ways) > PATIENCE and ways[-1] > 0.99 * ways[-1 - PATIENCE]):
            break
        tries = [scale * (e - wanted) / reach for scale in SCALES]
        after = totals(tries)
        best = int((((after - wanted) ** 2) / reach).sum(1).argmin())
        history.append(tries[best])
        e = after[best]
        ways.append(float(((e - wanted) ** 2 / reach).sum()))
    out = soft.mapInArrow(lean(rated), ", ".join(f"{n} {t}" for n, t in names.items()) + ", rate double")
    u = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = F.floor("rate") + F.when(u < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return out.withColumn("copies", copies.cast("int")), Fit(len(history), [float(x) for x in e], wanted.tolist(), reached)


def labelled_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labels table: ``high`` or ``low`` quality; rows without a quality are left out."""
    return labels.where("quality IS NOT NULL").select("doc_id", F.when(F.col("quality") == 1, "high").otherwise("low").alias("domain"))


def mix_documents(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, **options) -> tuple[DataFrame, Classifier, Fit]:
    """fit_rates() of ``docs`` with the domains of ``labels``, and their classifier; weights: by domain, others keep 0; None: equal weights."""
    model = fit_domains(docs, labels)
    soft = materialize(posteriors(docs, model))
    weights = weights or dict.fromkeys(model.domains, 1.0)
    targets = [weights.get(d, 0.0) for d in model.domains]
    mixed, fit = fit_rates(soft, targets if sum(targets) else [1.0] * len(targets), **options)
    return mixed, model, fit
