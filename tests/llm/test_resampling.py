"""Importance resampling against a plain version, feature by feature."""

import hashlib
import math
import re
import zlib

import pyarrow as pa
import pytest

from spanloom.llm import resampling

SCHEMA = "doc_id long, text string, weight string, rank string"


def grams(text, order=2):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return words, [" ".join(words[i : i + n]) for n in range(1, order + 1) for i in range(len(words) - n + 1)]


def plain(docs, target, percent=25, least=20, seed=7, order=2, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for texts, into in (([x for _, x in docs], s), (target, t)):
        for text in texts:
            for f in grams(text, order)[1]:
                into[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for d, text in docs:
        words, own = grams(text, order)
        weight = sum(gain[bucket(f)] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= least))
    order_of = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = percent * len(order_of) // 100
    return sorted([(*r[:4], k if k <= drawn else None) for k, r in enumerate(order_of, 1)] + [(*r[:4], None) for r in rows if not r[4]], key=str)


def got(frame):
    return sorted([(r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in frame.collect()], key=str)


@pytest.mark.parametrize("order, buckets", [(1, 50), (2, 10_000), (3, 997)])
def test_equal_to_plain(spark, order, buckets):
    docs = [(1, None), (2, ""), (None, "a b " * 30), (4, "Same, words! " * 12), (4, "Same, words! " * 12), (5, "été_2024 — naïve🎉ünï " * 9), (6, "w\x00x " * 4000), (7, "one"), (8, "x" * 100_000)]
    docs += [(i, " ".join(f"t{(i * j) % 23}" for j in range(i % 60))) for i in range(10, 200)]
    target = ["t1 t2 t3 T4-t5 " * 20, None, "", "été t7"]
    df = spark.createDataFrame([(*r, "x", "y") for r in docs], SCHEMA).repartition(5)
    aim = spark.createDataFrame([(x,) for x in target], "text string")
    assert got(resampling.resample(df, aim, 40, 10, 3, order, buckets)) == plain(docs, target, 40, 10, 3, order, buckets)


def test_one_id_of_many_rows(spark):
    """Rows of one id and score have one place in the order, and ranks stay 1, 2, 3, ..."""
    docs = [(3, "a b c d " * 6)] * 300 + [(i, "a b c d " * 6) for i in range(10, 110)]
    df = spark.createDataFrame([(*r, "x", "y") for r in docs], SCHEMA).repartition(7)
    assert got(resampling.resample(df, spark.createDataFrame([("a b",)], "text string"))) == plain(docs, ["a b"])


def test_empty(spark):
    none, aim = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "text string")
    assert resampling.resample(none, aim).count() == 0
    some = spark.createDataFrame([(1, "a b " * 20, "x", "y")], SCHEMA)
    assert got(resampling.resample(some, aim, 100)) == plain([(1, "a b " * 20)], [], 100)


def test_features_of_chunks():
    words, row, bucket = resampling.features(pa.array(["a B", "", "c"]))
    want = [(0, "a"), (0, "b"), (2, "c"), (0, "a b")]
    assert words.tolist() == [2, 0, 1] and list(zip(row.tolist(), bucket.tolist())) == [(r, zlib.crc32(f.encode()) % 10_000) for r, f in want]
