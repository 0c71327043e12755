import random
from itertools import combinations

from pyspark.sql import functions as F

from spanloom.llm import near_dedup

SF = "/root/testdata/sf0.01"


def brute(rows, k, percent):
    sets = {}
    for doc, text in rows:
        words = (text or "").encode().lower().split()
        sets[doc] = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 5 * min(len(sets[a]), len(sets[b])) >= 4 * max(len(sets[a]), len(sets[b])):
            common = len(sets[a] & sets[b])
            if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(s), root(d)) for d, s in sets.items()}


def check(spark, docs, k=2):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs, k, 80).collect()}
    assert got == brute(rows, k, 80)


def test_whole_table_equals_brute_force(spark):
    check(spark, spark.read.parquet(f"{SF}/documents.parquet"))


def test_chains_copies_and_odd_rows(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(1000)}" for _ in range(120)]
    rows, words = [], list(base)
    for i in range(30):  # a drifting chain: neighbours are close, the ends are not
        rows.append((100 + i, " ".join(words), "x", 1))
        for _ in range(4):
            words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
    for i in range(40):  # copies that are close to the centre only
        own = list(base)
        for j in rng.sample(range(120), 5):
            own[j] = f"m{i}-{j}"
        rows.append((200 + i, " ".join(own), "x", 1))
    rows += [(1, None, None, None), (2, "", "x", 2), (3, " \n\t ", "x", 3), (4, "one", "x", 4), (5, "ONE", "x", 5), (6, "one two", "x", 6), (7, "long " * 50_000, "x", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_shingles string, component_id int")
    check(spark, docs)


def test_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c"), (9, "a b c"), (4, "a b c"), (4, "a b c")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs, 2).collect())
    assert got == [(0, None, True), (4, 4, True), (4, 4, True), (9, 4, False)]
    assert near_dedup.near_duplicates(docs.where(F.lit(False)), 2).count() == 0


def test_stages_with_clashing_names(spark):
    """Columns named like the operators' own stay, values and all, and only the copies go; other ids than numbers are refused."""
    import pytest

    from spanloom.llm import exact_dedup

    rows = [(3, "a b c d e f g", 1, "x", 9), (5, "a b c d e f g", 2, None, 8), (6, None, 3, "y", 7), (7, "", 4, "z", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, dropped_id int, dropped_text string, row int")
    for stage in (exact_dedup.keep_first, near_dedup.representatives):
        out = stage(docs)
        want = [rows[0], rows[2]] if stage is exact_dedup.keep_first else [rows[0], rows[2], rows[3]]
        assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == want
    with pytest.raises(TypeError):
        exact_dedup.exact_duplicates(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
