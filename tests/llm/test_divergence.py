"""Divergence of sources against plain whole-number loops."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from spanloom.llm import divergence

SCHEMA = "doc_id long, lang string, source string, text string, term string, p long, total string"


def plain(rows, least=10, top=10):
    """rows: (lang, source, text), nulls allowed."""
    groups, langs, held = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        groups[lang, source].update(words)
        langs[lang].update(words)
        held[lang].update(set(words))
    out = set()
    for lang in langs:
        kept = [t for t in langs[lang] if held[lang][t] >= least]
        sources = [s for x, s in groups if x == lang]

        def share(counts, kept=kept):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (n + 2 * len(kept)) for t in kept}

        q, p = share(langs[lang]), {s: share(groups[lang, s]) for s in sources}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pair = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            term = [(-f(p[s][t], q[t]), t.encode()) for t in kept if groups[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                out |= {(lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(sorted(found)[:most], 1)}
    return out


def rows_of(frame):
    return [(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in frame.collect()]


@pytest.mark.parametrize("block, strip", [(1024, 256), (7, 3), (1, 1)])
def test_equal_to_loops(spark, block, strip):
    rng = np.random.default_rng(5)
    names = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}é" for i in range(60)]
    rows = []
    for i in range(300):
        source = f"s{int(rng.integers(8))}" if i % 3 else "hot"
        words = rng.choice(names, int(rng.integers(0, 12)), p=np.arange(60, 0, -1) / 1830)
        rows.append((i, "en" if i % 4 else "de", source, " ".join(words).upper() if i % 5 else " ".join(words), "x", 1, "y"))
    rows += [(1, "en", "s1", None, "x", 1, "y"), (2, None, None, "word " * 12, "x", 1, "y"), (None, "fr", "alone", "", "x", 1, "y"), (None, "es", "a", "", "x", 1, "y"), (3, "es", "b", None, "x", 1, "y")]
    rows += [(4, "it", s, "mille " * 3000 + "due", "x", 1, "y") for s in "abcabcabcabc"]
    got = rows_of(divergence.audit(spark.createDataFrame(rows, SCHEMA).repartition(5), block=block, strip=strip))
    assert len(got) == len(set(got)) and set(got) == plain([r[1:4] for r in rows])


def test_empty(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_uniform_quadrants_are_not_visited():
    """Two rows far apart share no square: what is met are their own columns only, each pair once."""
    row, column = np.repeat([0, 63], 10), np.concatenate([np.arange(10), np.arange(500, 510)])
    tree = divergence.QuadTree(row, column, np.full(20, 90), 10)
    zero = np.full(64, 7)
    total, met = divergence.joint_sums(tree, tree, zero, zero, 1024, True)
    assert met[0, 63] == 20 and total[0, 63] == 20 * ((90 - 7) ** 2 // 97)
    assert met[0, 1] == 10 and met[1, 2] == 0 and total[1, 2] == 0


def test_shares_beyond_longs(spark):
    """Counts of ten thousand million occurrences: 10^9 times as many does not fit in a long."""
    from pyspark.sql import functions as F

    r = spark.range(1).select(divergence._share(F.lit(10**12), F.lit(10**13), F.lit(10**6)).alias("p")).first()
    assert r["p"] == 1 + 10**9 * (10**12 + 2) // (10**13 + 2 * 10**6)
