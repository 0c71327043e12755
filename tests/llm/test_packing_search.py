"""The branch-and-bound of packing where descents do not reach the least number of sequences."""

from collections import Counter

import pytest

from spanloom.llm import packing, queries

SF = "/root/testdata/sf0.01"
#: (capacity, histogram, sequences by descents alone, by the search)
MISSED = [
    (105, {41: 1, 8: 1, 56: 1, 31: 3, 26: 2, 48: 1, 60: 1, 45: 2, 33: 1, 27: 1, 1: 1, 47: 1, 46: 1, 10: 2, 49: 1, 64: 1}, 8, 7),
    (66, {27: 7, 39: 7, 19: 7, 16: 14, 31: 7, 22: 14, 28: 7, 21: 7, 23: 14, 15: 14, 10: 7, 26: 7, 29: 7, 11: 7, 9: 7, 17: 7, 34: 7, 4: 7, 5: 7}, 50, 49),
    (45, {12: 2000, 5: 500, 28: 500, 10: 2500, 1: 1000, 18: 2000, 16: 1000, 22: 500, 17: 1000, 9: 1000, 19: 1000, 33: 500, 6: 1000, 4: 1000, 23: 500, 27: 500, 29: 500, 14: 500}, 5529, 5512),
]


@pytest.mark.parametrize("capacity, histogram, before, after", MISSED)
def test_search_beats_the_descents(capacity, histogram, before, after):
    first, found = packing.solve(histogram, capacity, nodes=0), packing.solve(histogram, capacity, nodes=20_000)
    assert first.sequences == before and found.sequences <= after
    used = Counter()
    for p in found.patterns:
        assert sum(x * c for x, c in p.lengths.items()) <= capacity
        for x, c in p.lengths.items():
            used[x] += c * p.times
    assert used == Counter(histogram) and found.sequences == sum(p.times for p in found.patterns)


def test_least_sequences_on_the_table(spark):
    rows = queries.op10_packing(spark, SF).select("length", "sequence_id").collect()
    assert len({r["sequence_id"] for r in rows}) == packing.least_sequences(Counter(r["length"] for r in rows), 1024)
