"""Differencing against its definition with whole tuples, and packing as a round trip."""

import heapq
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm import differencing, queries

SF = "/root/testdata/sf0.01"


def plain(lengths, m):
    """Partial partitions as whole tuples of m sums."""
    heap = [(-x, k, [0] * (m - 1) + [x]) for k, x in enumerate(sorted(lengths, reverse=True))]
    heapq.heapify(heap)
    k = len(heap)
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        both = sorted(x + y for x, y in zip(a, reversed(b)))
        heapq.heappush(heap, (both[0] - both[-1], k, both))
        k += 1
    return heap[0][2]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=40), st.integers(1, 9))
def test_difference(lengths, windows):
    x = np.array(lengths)
    assert sorted(np.bincount(differencing.difference(x, windows), x, windows)) == plain(lengths, windows)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=40))
def test_level_and_fitted(lengths):
    x, capacity = np.array(lengths), 100
    windows = -(-int(x.sum()) // capacity)
    parts = differencing.level(x, differencing.difference(x, windows), windows, capacity)
    sums, spans = defaultdict(int), defaultdict(list)
    for i, start, n, w in parts:
        sums[w] += n
        spans[i].append((start, n))
    assert max(sums.values()) <= capacity
    for i, own in spans.items():
        own.sort()
        assert [a for a, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) == lengths[i]
    window, count = differencing.fitted(x, capacity)
    assert np.bincount(window, x, count).max() <= capacity and count >= windows


def test_count_rises():
    """Three of 60 fill two windows of 100 by their sum, but not one by one."""
    window, count = differencing.fitted(np.array([60, 60, 60]), 100)
    assert count == 3 and len(set(window)) == 3


def test_powers():
    for total in range(700):
        own = differencing.powers(total, 100)
        assert sum(own) == total and all(p & (p - 1) == 0 and p <= 64 for p in own)


def checked(rows, texts, capacity):
    """Rows of the packing against the tokenizer; the length of each sequence."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    tok.encode_special_tokens = True
    sequences, pieces = defaultdict(list), defaultdict(list)
    ids = {d: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for d, t in texts}
    for r in rows:
        own = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert len(own) == r["length"] > 0 and zlib.crc32(own.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append((r["start"], r["length"]))
    for own in sequences.values():
        own.sort()
        assert [a for a, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
    times = defaultdict(int)
    for d, _ in texts:
        times[d] += 1
    for d, own in pieces.items():
        covered = np.zeros(len(ids[d]), int)
        for start, n in own:
            covered[start : start + n] += 1
        assert (covered == times[d]).all()
    assert set(pieces) == set(times)
    out = [sum(n for _, n in own) for own in sequences.values()]
    assert max(out) <= capacity
    return out


def test_query(spark):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    totals = checked(queries.op12_differencing(spark, SF).collect(), texts, 1024)
    assert all(n == 1024 or n & (n - 1) == 0 for n in totals)  # no padding at all
    assert len(totals) <= -(-sum(totals) // 1024) + 10 * 8


@pytest.mark.parametrize("cut", [True, False])
def test_odd_rows(spark, cut):
    texts = [(1, None), (2, ""), (4, "same text here"), (4, "same text here"), (5, "été 🎉 \n\t  ünï"), (6, "word " * 5000)] + [(10 + i, "some words of a text " * (i % 37)) for i in range(200)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in texts], "doc_id long, text string, start string, length int").repartition(3)
    totals = checked(differencing.pack_balanced(df, queries.tokenizer_path(), 128, windows=8, cut=cut).collect(), texts, 128)
    if cut:
        assert sum(n != 128 for n in totals) <= 3 * 7
    null = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    assert [r["doc_id"] for r in differencing.pack_balanced(null, queries.tokenizer_path(), cut=cut).collect()][0] is None
    assert differencing.pack_balanced(df.limit(0), queries.tokenizer_path(), cut=cut).count() == 0
