"""Operators of the corpus subpackage against plain versions, and on odd rows."""

import hashlib
import itertools
import math
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.llm import exact_dedup, fingerprint, license_scan, lm, mixing, packing, pii, queries, repeats, textkit, toxicity

SF = "/root/testdata/sf0.01"
ODD = [(1, None, "x", 1), (2, "", "x", 2), (3, "same text here", None, None), (4, "same text here", "y", 4), (4, "same text here", "y", 4), (None, "no id", "z", 5), (7, " \n\t ", "z", 6), (8, "été — naïve 🎉 ünï", "z", 7), (9, "word " * 30_000, "z", 8)]


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and texts, repeated rows, a long text, and columns named like the operators' own."""
    return spark.createDataFrame(ODD, "doc_id long, text string, score string, k int")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where(F.lit(False))


@pytest.fixture(scope="module")
def documents(spark):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


# ------------------------------------------------------------------ exact dedup
def test_exact_dedup(spark, odd, empty):
    got = sorted((r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"], r["kept"]) for r in exact_dedup.exact_duplicates(odd, keep="largest").collect())
    assert got == [(0, 0, 1, True), (1, 2, 2, False), (2, 2, 2, True), (3, 4, 3, False), (4, 4, 3, True), (4, 4, 3, True), (7, 7, 1, True), (8, 8, 1, True), (9, 9, 1, True)]
    assert exact_dedup.exact_duplicates(empty).count() == 0
    assert exact_dedup.keep_first(odd).count() == 6


def test_exact_dedup_hot_text(spark):
    rows = [(i, "hot" if i % 2 else f"text {i % 300}") for i in range(2000)]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    assert got == {i: (min(groups[t]), len(groups[t])) for i, t in rows}


def test_exact_dedup_normalised(spark):
    df = spark.createDataFrame([(1, "A  b"), (2, "a b"), (3, "c")], "doc_id long, text string")
    out = exact_dedup.exact_duplicates(df, normalise=lambda t: F.lower(F.regexp_replace(t, r"\s+", " ")))
    assert sorted((r["doc_id"], r["keep_id"]) for r in out.collect()) == [(1, 1), (2, 1), (3, 3)]


# ------------------------------------------------------------------ fingerprints
def exact_set(text, k=5):
    words = text.encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def test_fingerprints_query(spark, documents):
    rows = {r["doc_id"]: r for r in queries.op5_fingerprints(spark, SF).collect()}
    docs = sorted(documents)
    worst = []
    for i, (doc, text) in enumerate(docs):
        following = docs[(i + 1) % len(docs)][1]
        n = len(text) // 4
        changed = text[: len(text) - n] + following[:n]
        r = rows[doc]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        for other, near in ((changed, r["near_edited"]), (following, r["near_next"])):
            a, b = exact_set(text), exact_set(other)
            worst.append(abs((len(a & b) / len(a | b) if a | b else 1.0) - near))
    assert np.mean(worst) < 0.02 and np.quantile(worst, 0.99) < 0.12
    same = defaultdict(set)
    for doc, text in docs:
        same[text].add(rows[doc]["fingerprint"])
    assert all(len(x) == 1 for x in same.values())


def test_fingerprint_merge_and_estimates():
    whole = [f"w{i}" for i in range(4000)]
    parts = [" ".join(whole[:2000]), " ".join(whole[1996:])]
    a, b, c = fingerprint.fingerprints(pa.array([*parts, " ".join(whole)]))
    assert str(a.merge(b)) == str(c) and str(fingerprint.Fingerprint.parse(str(c))) == str(c)
    assert abs(c.count() - 3996) < 1200 and abs(a.containment(c) - 1) < 0.25 and abs(a.resemblance(c) - 0.5) < 0.15
    none = fingerprint.fingerprints(pa.array([None, ""], pa.string()))
    assert none[0].resemblance(none[1]) == 1.0 and none[0].count() == 0


def test_fingerprints_odd(spark, odd, empty):
    got = fingerprint.fingerprint_documents(odd).collect()
    assert len(got) == len(ODD) and all(0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1 for r in got)
    lone = fingerprint.fingerprint_documents(odd.where("doc_id = 8")).collect()
    assert len(lone) == 1 and lone[0]["near_next"] == 1.0
    assert fingerprint.fingerprint_documents(empty).count() == 0


# ------------------------------------------------------------------ packing
def test_packing_round_trip(spark, documents):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    ids = {d: [*tok.encode(t, add_special_tokens=False).ids, 2] for d, t in documents}
    rows = queries.op10_packing(spark, SF).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        own = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert len(own) == r["length"] <= 1024 and zlib.crc32(own.tobytes()) == r["ids_crc32"]
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc, own in pieces.items():
        own.sort()
        assert [p for p, _, _ in own] == list(range(len(own))) and sum(n for _, _, n in own) == len(ids[doc])
        assert all(n == 1024 for _, _, n in own[1:]) and all(a[1] + a[2] == b[1] for a, b in zip(own, own[1:]))
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 1024
    assert set(pieces) == set(ids)
    histogram = Counter(r["length"] for r in rows)
    assert len(sequences) <= packing.least_sequences(histogram, 1024) + 2


def test_encoder_equals_tokenizer():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tok, own = Tokenizer.from_file(path), packing.Encoder(path)
    for text in ["", " ", "  ", " a", "a ", "a  b", "a \n b", "\n", "don't we'll x's", "<|endoftext|> x", "a<|endoftext|>", " x   y", "a\tb c", "123 45.6!? ...", "été 🎉 ünï", "x\n y", "a\n\nb c", "  a", "tail "]:
        assert own(text) == np.array([*tok.encode(text, add_special_tokens=False).ids, 2], "<u4").tobytes(), repr(text)


def test_packing_patterns_and_odd(spark, odd, empty):
    rng = np.random.default_rng(5)
    for _ in range(20):
        histogram = Counter(rng.integers(1, 65, rng.integers(1, 400)).tolist())
        used, n = Counter(), 0
        for p in packing.solve(histogram, 64).patterns:
            assert sum(x * c for x, c in p.lengths.items()) <= 64
            n += p.times
            for x, c in p.lengths.items():
                used[x] += c * p.times
        assert used == histogram and n <= math.ceil(1.05 * packing.least_sequences(histogram, 64)) + 1
    got = packing.pack(odd, queries.tokenizer_path()).collect()
    assert sum(r["length"] == 1 for r in got) == 2 and len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)
    assert packing.pack(empty, queries.tokenizer_path()).count() == 0


def brute_fillings(room, counts):
    """All multisets of lengths that fit, by their waste, without those where a pair gives way to one length."""
    out = []

    def go(left, most, own):
        used = Counter(own)
        pairs = {own[i] + own[j] for i in range(len(own)) for j in range(i + 1, len(own))}
        if all(z > room or counts[z] <= used[z] for z in pairs):
            out.append((left, tuple(own)))
        for x in range(min(left, most), 0, -1):
            if counts[x] > used[x]:
                go(left - x, x, [*own, x])

    go(room, room, [])
    return out


def brute_bins(items, capacity):
    """The least number of bins, by trying every bin for every item."""
    best = [len(items)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] >= items[k] and bins[i] not in bins[:i]:
                go(k + 1, [*bins[:i], bins[i] - items[k], *bins[i + 1 :]])
        go(k + 1, [*bins, capacity - items[k]])

    go(0, [])
    return best[0]


def test_packing_fillings_equal_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(60):
        counts = np.zeros(31, np.int64)
        np.add.at(counts, rng.integers(1, 16, 9), 1)
        room = int(rng.integers(1, 24))
        got = [(room - sum(own), tuple(own)) for own in packing.fillings(room, counts, room)]
        assert sorted(got) == sorted(brute_fillings(room, counts)) and [w for w, _ in got] == sorted(w for w, _ in got)


def test_packing_is_optimal_where_it_says_so():
    """Against all packings; without nodes the incumbent stays and is not called optimal."""
    rng = np.random.default_rng(8)
    missed = 0
    for k in range(80):
        items = sorted((int(x) for x in rng.integers(4, 26, 11)), reverse=True)
        want = brute_bins(items, 40)
        found = packing.solve(Counter(items), 40)
        assert found.optimal and found.sequences == want == sum(p.times for p in found.patterns)
        first = packing.solve(Counter(items), 40, nodes=0)
        assert first.sequences >= want and first.optimal == (first.sequences == first.bound)
        missed += first.sequences > want
    assert missed < 10


# ------------------------------------------------------------------ toxicity
def test_toxicity_held_out(spark):
    rows = queries.op8_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert ((rows.score >= 0.5) == (rows.toxic == 1)).mean() > 0.95
    assert (rows[rows.toxic == 0].score < 0.5).mean() > 0.97 and (rows[rows.toxic == 1].score >= 0.5).mean() > 0.7


def test_toxicity_unseen_misspelling_and_odd(spark, odd, empty):
    rng = np.random.default_rng(1)
    words = ["table", "river", "window", "quiet", "garden", "north", "paper", "cloud", "seven", "metal"]
    clean = [" ".join(rng.choice(words, 40)) for _ in range(300)]
    toxic = [" ".join(rng.choice(words, 20)) + f" {rng.choice(['blockhead', 'blockheads', 'Blockheaded'])} " + " ".join(rng.choice(words, 20)) for _ in range(100)]
    model = toxicity.fit(pa.array(clean + toxic), np.array([0] * 300 + [1] * 100))
    p = toxicity.score_texts(pa.array(["quiet river " * 30, "quiet river " * 15 + "blockheadz " + "north paper " * 15, "quiet river " * 15 + "blokheads " + "north paper " * 15, None, ""]), model)
    assert p[0] < 0.5 < p[1] and p[0] < p[2] and 0 <= p[3] == p[4] <= 1
    assert toxicity.score(odd, model).count() == len(ODD) and toxicity.score(empty, model).count() == 0
    assert toxicity.clean_only(odd, model).columns == odd.columns
    lone = toxicity.fit(pa.array(["a", "b"]), np.array([0, 0]))
    assert (toxicity.score_texts(pa.array(["a", ""]), lone) < 0.5).all()


# ------------------------------------------------------------------ mixing
def test_mixing_reaches_targets(spark, odd, empty):
    rng = np.random.default_rng(2)
    rows = [(i, int(rng.integers(1, 200)), [float(x) for x in rng.dirichlet([1, 1, 1])]) for i in range(3000)]
    soft = spark.createDataFrame(rows, "doc_id long, n_tokens long, posterior array<double>")
    out = mixing.mix(soft, [0.5, 0.3, 0.2], steps=60).toPandas()
    expected = sum(r * n * np.array(p) for r, n, p in zip(out.rate, out.n_tokens, out.posterior))
    assert np.allclose(expected / expected.sum(), [0.5, 0.3, 0.2], atol=0.02) and (out.rate >= 0).all()
    kept = sum(c * n for c, n in zip(out.copies, out.n_tokens)) / expected.sum()
    assert 0.95 < kept < 1.05
    labels = spark.createDataFrame([(3, "a"), (4, "b"), (8, "b"), (None, "a"), (9, None)], "doc_id long, domain string")
    assert mixing.mix_documents(odd, labels)[0].count() == len(ODD) and mixing.mix_documents(empty, labels)[0].count() == 0


def test_mixing_reaches_targets_by_default(spark):
    """The production parameters go on until the totals are there; targets out of reach end for lack of progress."""
    rng = np.random.default_rng(2)
    rows = [(i, int(rng.integers(1, 200)), [float(x) for x in rng.dirichlet([1, 1, 1])]) for i in range(3000)]
    soft = spark.createDataFrame(rows, "doc_id long, n_tokens long, posterior array<double>")
    total = sum(n for _, n, _ in rows)
    out = mixing.mix(soft, [0.5, 0.3, 0.2]).toPandas()
    expected = sum(r * n * np.array(p) for r, n, p in zip(out.rate, out.n_tokens, out.posterior))
    assert np.allclose(expected, np.array([0.5, 0.3, 0.2]) * total, rtol=0.001)
    same = spark.createDataFrame([(1, 10, [0.5, 0.5]), (2, 20, [0.5, 0.5])], "doc_id long, n_tokens long, posterior array<double>")
    assert mixing.mix(same, [0.9, 0.1]).count() == 2


# ------------------------------------------------------------------ language model
def test_lm_counts_scores_and_probabilities(spark, documents):
    got = {r["doc_id"]: r for r in queries.op2_lm_scoring(spark, SF).collect()}
    tokens = {d: [*(w for w in t.encode().lower().split()), None] for d, t in documents}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in documents}
    count = Counter(w for d, own in tokens.items() if not held[d] for w in own)
    n, v = sum(count.values()), len(count)
    for d, own in tokens.items():
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[d], len(own), sum(w in count for w in own), n)
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        assert abs(base - r["base_score"]) < 1e-6 * abs(base) + 1e-6
    out = [d for d in tokens if held[d]]
    assert sum(got[d]["score"] for d in out) > sum(got[d]["base_score"] for d in out)


def plain_lm(model, counts, key, before):
    """{word: probability} of every training word, and the probability of any unseen word, after the two words before."""
    names = [lm.END_KEY if w is None else key[w] for w in before]  # the last word, and the one before it
    last = int(lm.END) if before[0] is None else before[0]
    pair = int(textkit.mix(np.array([names[0] * lm.KEYS + names[1]], np.uint64))[0])
    rows = [0, lm.AT[1] + names[0], lm.AT[2] + (last >> 52) % lm.WORD_BUCKETS, lm.AT[3] + pair % lm.PAIR_BUCKETS, lm.AT[4] + names[1]]
    z = sum(model.weights[r].astype(float) for r in rows)
    p_class = [math.exp(x) for x in z - z.max()]
    p_class = [x / sum(p_class) for x in p_class]
    c1, c2 = (int(model.own[k]) for k in names)
    weight, total = {}, defaultdict(float)
    size, kinds = Counter(), Counter()
    for w, c in counts.items():
        size[int(model.own[key[w]])] += c
        kinds[int(model.own[key[w]])] += 1
    for w, c in counts.items():
        k = int(model.own[key[w]])
        near = model.within.last[k, w % lm.WITHIN, c1] + model.within.skip[k, w % lm.WITHIN, c2]
        weight[w] = k, (c + 0.1) / (size[k] + 0.1 * (kinds[k] + 1)) * math.exp(near)
        total[k] += weight[w][1]
    for k in range(lm.CLASSES):
        total[k] += 0.1 / (size[k] + 0.1 * (kinds[k] + 1))
    unseen = {k: p_class[k] * 0.1 / (size[k] + 0.1 * (kinds[k] + 1)) / total[k] for k in range(lm.CLASSES)}
    return {w: p_class[k] * x / total[k] for w, (k, x) in weight.items()}, unseen


@pytest.mark.parametrize("head", [lm.HEAD, 40])
def test_lm_score_equals_plain_probabilities(spark, monkeypatch, head):
    """Every token's probability from first principles: they sum to one over the vocabulary, and their logs to the score."""
    monkeypatch.setattr(lm, "HEAD", head)
    rng = np.random.default_rng(3)
    nouns, verbs = [f"noun{i}er" for i in range(30)], [f"verb{i}ing" for i in range(20)]
    say = lambda: " ".join(f"the {nouns[i % 30]} {verbs[(i * 7 + j) % 20]}" for i, j in rng.integers(0, 60, (12, 2)))
    rows = [(i, say()) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = lm.train(docs)
    tests = [(1, "the noun3er verb1ing the other noun5er"), (2, ""), (3, "verb2ing strange the the"), *rows[:2]]
    data, offsets = textkit.text_bytes(pa.array([t for _, t in rows + tests]))
    t = lm.Tokens(data, offsets, 0, len(rows + tests))
    key = dict(zip(t.hash.tolist(), t.key.tolist()))
    first = t.first.tolist()
    counts = Counter(t.hash[: first[len(rows)]].tolist())
    got = {r["doc_id"]: r["score"] for r in lm.score(spark.createDataFrame(tests[:3], "doc_id long, text string"), model).collect()}
    for i, (doc, _) in enumerate(tests[:3], len(rows)):
        own, want = t.hash[first[i] : first[i + 1]].tolist(), 0.0
        for j, w in enumerate(own):
            p, unseen = plain_lm(model, counts, key, [own[j - 1] if j else None, own[j - 2] if j > 1 else None])
            assert abs(sum(p.values()) + sum(unseen.values()) - 1) < 1e-6
            want += math.log10(p[w] if w in p else unseen[int(model.own[key[w]])])
        assert abs(got[doc] - want) < 1e-4 * max(1, abs(want))
    context = [model.within.last, model.within.skip]
    assert all(np.abs(x).max() > 0.1 for x in context)  # the words of a class do differ by context


def test_lm_odd(spark, odd, empty):
    got = lm.score_documents(odd).collect()
    assert len(got) == len(ODD) and all(r["score"] <= 0 for r in got) and lm.score_documents(empty).count() == 0


# ------------------------------------------------------------------ personal data
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip":
                ok = all(int(p) <= 255 for p in m[0].split("."))
            elif kind == "card":
                ok = 16 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
            else:
                ok = kind != "phone" or 8 <= len(digits) <= 15
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def check_pii(rows, got):
    for doc, text in rows:
        own = plain_spans(text or "")
        r = got[doc]
        n = Counter(k for k, _, _ in own)
        assert [r[f"n_{k}"] for k in PATTERNS] == [n[k] for k in PATTERNS], text
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in own).encode()).hexdigest()
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        assert {(k, int(a), int(b)) for k, a, b in spans} >= set(own)
        assert [(list(PATTERNS).index(k), int(a)) for k, a, _ in spans] == sorted((list(PATTERNS).index(k), int(a)) for k, a, _ in spans)


def test_pii_whole_table(spark, documents):
    check_pii(documents, {r["doc_id"]: r for r in queries.op3_pii(spark, SF).collect()})


def test_pii_cases(spark, odd, empty):
    texts = ["a@b.c.d@e.f x@y", "🎉 mail é.x@y-z.co.uk.", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 0001.02.3.255", "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111", "+1 (555) 010-9999. +49 30 1234567 +1-2", "9" * 5000, "1 " * 5000, "a." * 4000 + "@x.y", "x@" + "a." * 4000 + "b", "+" + "1" * 5000, "@@@ a@@b.c", "call (555) 123-4567 or me at me [at] here [dot] org"]
    rows = list(enumerate(texts))
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string"))
    check_pii(rows, {r["doc_id"]: r for r in found.collect()})
    assert pii.find(odd).count() == len(ODD) and pii.find(empty).count() == 0
    red = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string"), found).collect()}
    assert red[1] == "🎉 mail é[EMAIL]."


def test_pii_adds_valid_loose_items(spark):
    """Spelled-out and broken forms are added by their own validity, also without a strict item near; look-alikes are not."""
    real = ["write to me [at] here [dot] org now", "call (555) 123-4567 now", "host 1[.]2[.]3[.]4 is up", "card 4111.1111.1111.1111 paid"]
    alike = ["five @ 3.99 each", "host 999[.]2[.]3[.]4 is up", "card 4111.1111.1111.1112 paid"]
    want = ["me [at] here [dot] org", "(555) 123-4567", "1[.]2[.]3[.]4", "4111.1111.1111.1111"]
    for times in ((1, 0), (60, 1)):
        texts = real * times[0] + alike * times[1]
        got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
        for i, text in enumerate(texts):
            own = [text[int(a) : int(b)] for _, a, b in (s.split(":") for s in got[i]["spans"].split(",") if s)]
            assert own == ([want[i % 4]] if i < len(real) * times[0] else []) and got[i]["n_added"] == len(own), text
    few = [f"card {1000 + i}.1111.1111.{2000 + 7 * i} paid" for i in range(200)]  # numbers of which a tenth pass by chance
    assert pii.find(spark.createDataFrame(list(enumerate(few)), "doc_id long, text string")).where("n_added > 0").count() == 0


def test_pii_many_matches_in_one_text(spark):
    """Places come from sums over blocks: a text with a hundred thousand matches takes seconds, and every place is right."""
    import time

    text = "".join(f"a{i}@b.io " for i in range(100_000))
    began = time.perf_counter()
    r = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert time.perf_counter() - began < 60
    own = ",".join(f"email:{m.start()}:{m.end()}" for m in re.finditer(r"a[0-9]+@b\.io", text))
    assert r["n_email"] == 100_000 and r["base_sha256"] == hashlib.sha256(own.encode()).hexdigest() and r["spans"] == own


def test_pii_added_spans_equal_plain_rules(spark):
    """Which loose candidates touch a base span or lie inside a longer number, against plain loops."""
    rng = np.random.default_rng(7)
    bits = ["me [at] here [dot] org", "(555) 123-4567", "a@b.io", "4111 1111 1111 1111", "1234 5678 9012 345", "555 123 4567", "10.0.0.1", "1[.]2[.]3[.]4", "word", "0049 555 123 4567", "4111.1111.1111.1111", "x", "12-34"]
    texts = [" ".join(rng.choice(bits, 12)) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r["doc_id"]: r for r in pii.with_spans(docs).collect()}
    got = {r["doc_id"]: r for r in pii.find(docs).collect()}
    digits = lambda s: len(re.sub("[^0-9]", "", s["value"]))
    meet = lambda a, b: a["start"] < b["stop"] and b["start"] < a["stop"]
    some = 0
    for i, text in enumerate(texts):
        r = spans[i]
        assert [(s["start"], s["stop"]) for s in r["email_all"]] == [m.span() for m in re.finditer(PATTERNS["email"], text)]
        cards = [*r["card_all"], *r["card_loose"]]
        for s in r["phone_loose"]:
            inside = any(meet(s, c) and digits(c) > digits(s) for c in cards)
            assert s["ok"] == (8 <= digits(s) <= 15 and not inside)
        base = [s for k in PATTERNS for s in r[f"{k}_all"] if s["ok"]]
        added = {tuple(x.split(":")) for x in got[i]["spans"].split(",") if x} - {(k, str(s["start"]), str(s["stop"])) for k in PATTERNS for s in r[f"{k}_all"] if s["ok"]}
        free = {(k, str(s["start"]), str(s["stop"])) for k in PATTERNS for s in r[f"{k}_loose"] if s["ok"] and not any(meet(s, b) for b in base)}
        assert added <= free
        some += len(added)
    assert some > 100


def test_pii_boosting_separates_cells():
    cells = np.array([[0, a, b, 0, 0] for a in range(6) for b in range(4)])
    n = np.full(len(cells), 100.0)
    pos = np.where((cells[:, 1] >= 3) & (cells[:, 2] <= 1), 99.0, 1.0)
    model = pii.boost(cells, n, pos)
    score = sum(pii._apply(t, cells) for t in model.trees)
    assert ((score >= model.thresholds["email"]) == (pos > 50)).all() and model.thresholds["ip"] == float("inf")


# ------------------------------------------------------------------ repeats
def brute_repeats(texts, length=200):
    at = defaultdict(list)
    for i, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            at[t[p : p + length]].append((i, p))
    cover = [bytearray(len(t)) for t in texts]
    for own in at.values():
        if len(own) > 1:
            for i, p in own:
                cover[i][p : p + length] = b"\1" * length
    out = []
    for t, c in zip(texts, cover):
        kept = bytes(b for b, x in zip(t, c) if not x)
        out.append((len(t), sum(c), len(re.findall(b"\1+", bytes(c))), hashlib.sha256(kept).hexdigest()))
    return out


def check_repeats(df):
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in df.select("doc_id", "text").collect()]
    want = sorted((d or -1, *x) for (d, _), x in zip(rows, brute_repeats([t for _, t in rows])))
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"] or -1, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.remove_repeats(df).collect())
    assert got == want


def test_repeats_tables(spark, odd, empty):
    check_repeats(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    check_repeats(odd)
    assert repeats.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("crowd", [4096, 3])
def test_repeats_shapes(spark, monkeypatch, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    rng = np.random.default_rng(4)
    word = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    passage, other = word(420), word(260)
    texts = [word(300) + passage[rng.integers(0, 60) : 420 - rng.integers(0, 60)] + word(100) for _ in range(12)]
    texts += [other[:199] + word(50), word(5) + other[:200] + word(5), other + other, word(150), passage, "a" * 700, "ab" * 400, "x" + "ab" * 150, word(900)]
    texts += [texts[0], texts[3], word(210) + texts[-1][:230]]
    check_repeats(spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string"))


def test_repeats_narrowing_ends_where_a_task_can_compare(spark, monkeypatch):
    """A crowded group of four families goes apart in one step; the families are compared whole, not narrowed again."""
    steps, hashed = [], repeats._hashed
    monkeypatch.setattr(repeats, "CROWD", 16)
    monkeypatch.setattr(repeats, "_hashed", lambda rows: steps.append(1) or hashed(rows))
    rng = np.random.default_rng(8)
    word = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    phrase = word(150)
    texts = [word(150) + before + phrase + after + word(150) for before, after in [(word(100), word(100)) for _ in range(4)] for _ in range(10)]
    check_repeats(spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string"))
    assert len(steps) == 1


def test_repeats_sizes_of_frequent_keys(spark):
    """Every row of a frequent key gets the key's size, by joins whose keys hold a share of its rows each."""
    rows = [(1, i, 7, 7) for i in range(1000)] + [(2, i, 8, i // 2) for i in range(4)] + [(3, 0, 9, 9), (4, 0, None, 9), (4, 1, None, 9)]
    df = spark.createDataFrame(rows, "h long, hull long, a long, b long")
    want = {1: 1000, 2: 2}
    got = repeats._with_sizes(df, ["a", "b"], "n")
    assert sorted((r["h"], r["hull"], r["n"]) for r in got.collect()) == sorted((h, u, want[h]) for h, u, _, _ in rows if h in want)
    left = repeats._with_sizes(df, ["a", "b"], "n", "left")
    assert sorted((r["h"], r["hull"], r["n"] or 0) for r in left.collect()) == sorted((h, u, want.get(h, 0)) for h, u, _, _ in rows)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and "slot" in plan


def test_repeats_long_texts_and_runs_of_one_byte(spark):
    """Texts over several chunks, with repeats over the chunks' and parts' borders, and a long run of one byte."""
    rng = np.random.default_rng(6)
    word = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    passage = [word(250), word(300)]
    border = 1 << 20
    long = word(border - 120) + passage[0] + word(border - 400) + passage[1] + word(border)
    texts = {1: long, 2: word(500) + passage[0] + word(80), 3: word(65_536 - 120) + passage[1] + word(900), 4: "a" * 150_000, 5: word(40) + "a" * 260 + word(40)}
    got = {r["doc_id"]: [(s["start"], s["stop"]) for s in r["spans"]] for r in repeats.remove_repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    # planted passages may share a byte or two more with what stands around them
    near = lambda own, at, n: len(own) == 1 and abs(own[0][0] - at) < 8 and abs(own[0][1] - at - n) < 8
    assert len(got[1]) == 2 and near(got[1][:1], long.index(passage[0]), 250) and near(got[1][1:], long.index(passage[1]), 300)
    assert near(got[2], 500, 250) and near(got[3], 65_536 - 120, 300) and got[4] == [(0, 150_000)] and near(got[5], 40, 260)


def test_interval_tree():
    text = b"banana"
    order = sorted(range(6), key=lambda i: text[i:])
    lcp = np.array([0] + [next((k for k in range(7) if text[a + k : a + k + 1] != text[b + k : b + k + 1]), 6) for a, b in zip(order, order[1:])])
    assert {(v, a, b) for v, a, b in repeats.intervals(lcp) if v} == {(1, 0, 2), (3, 1, 2), (2, 4, 5)}


# ------------------------------------------------------------------ licences
def test_licenses(spark, odd, empty):
    mit = license_scan.TEMPLATES["MIT"]
    texts = [mit, mit.replace("Software", "Program"), "Nothing to see.\nReleased under the MIT License.\nMore.", "This work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0.", "a licensed driver", "x " * 5000 + "\nLicensed under the Apache License, Version 2.0."]
    got = defaultdict(set)
    for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got[r["doc_id"]].add(r["license"])
        if r["doc_id"] == 2:
            assert texts[2][r["start"] : r["stop"]] == "Released under the MIT License." and r["missing"] == 0
    assert got == {0: {"MIT"}, 1: {"MIT"}, 2: {"MIT"}, 3: {"GPL-3.0", "CC-BY-NC-4.0"}, 5: {"Apache-2.0"}}
    assert license_scan.scan(odd).count() == 0 and license_scan.scan(empty).count() == 0


def test_licenses_whole_table(spark, documents):
    lines = {"This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "All rights reserved.": "Proprietary"}
    want = {(d, name) for d, t in documents for line, name in lines.items() if line in t}
    got = {(r["doc_id"], r["license"]) for r in queries.op7_license_scan(spark, SF).collect()}
    assert want <= got and len(got - want) <= 0.02 * len(want) + 1


def licenses_of(spark, texts):
    got = defaultdict(list)
    for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got[r["doc_id"]].append((r["license"], r["missing"], texts[r["doc_id"]][r["start"] : r["stop"]]))
    return [sorted(got[i]) for i in range(len(texts))]


def test_licenses_wrapped(spark):
    """Licences wrapped at 80 columns and less, plain and in comments: no word is lost, and the prose around stays out."""
    texts, want = [], []
    for name in ("MIT", "GPL-3.0", "Apache-2.0"):
        for width, mark in ((80, ""), (80, " * "), (60, "# "), (35, "")):
            body = textwrap.fill(license_scan.TEMPLATES[name], width, initial_indent=mark, subsequent_indent=mark, break_long_words=False, break_on_hyphens=False)
            texts.append(f"A tool for the rest of us.\n\n{body}\n\nUse it at the end of the day.")
            want.append([(name, 0, body)])
    assert licenses_of(spark, texts) == want


def test_licenses_deciding_words(spark):
    """The lines of the tables and their near misses: a version or condition that differs never gives the neighbour's name."""
    cc = "This work is licensed under a Creative Commons Attribution{} International License."
    want = {
        "All rights reserved.": ["Proprietary"],
        "Licensed under the Apache License, Version 2.0.": ["Apache-2.0"],
        "Licensed under the Apache License, Version 1.1.": ["Apache-1.1"],
        "Licensed under the Apache License, Version 3.0.": [],
        "Released under the MIT License.": ["MIT"],
        "Released under the MIT-0 License.": [],
        "This work is licensed under the GNU General Public License, version 3.": ["GPL-3.0"],
        "This work is licensed under the GNU General Public License, version 2.": ["GPL-2.0"],
        "This work is licensed under the GNU Lesser General Public License, version 3.": ["LGPL-3.0"],
        license_scan.TEMPLATES["GPL-3.0"].replace("version 3", "version 2"): ["GPL-2.0"],
        license_scan.TEMPLATES["GPL-3.0"].replace("General", "Lesser General"): [],
        "Licensed under CC BY-NC 4.0.": ["CC-BY-NC-4.0"],
        "Licensed under CC BY-NC 3.0.": [],
        "Licensed under CC BY-NC-SA 4.0.": ["CC-BY-NC-SA-4.0"],
        cc.format(" 4.0"): ["CC-BY-4.0"],
        cc.format(" 3.0"): [],
        cc.format("-NonCommercial 4.0"): ["CC-BY-NC-4.0"],
        cc.format("-ShareAlike 4.0"): ["CC-BY-SA-4.0"],
        cc.format("-NoDerivatives 4.0"): ["CC-BY-ND-4.0"],
        f"Copyright 2001 Someone. All rights reserved.\n{license_scan.TEMPLATES['MIT']}": ["MIT"],
        "Copyright 2001 Someone. All rights reserved.\nMore to come.": ["Proprietary"],
    }
    assert {t: [x for x, *_ in hits] for t, hits in zip(want, licenses_of(spark, list(want)), strict=True)} == want


def test_licenses_every_line_of_table(spark, documents):
    lines = {"This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "All rights reserved.": "Proprietary"}
    want = {(d, name) for d, t in documents for line, name in lines.items() if line in t}
    assert {(r["doc_id"], r["license"]) for r in queries.op7_license_scan(spark, SF).collect()} == want


def test_licenses_notice_file(spark):
    """A block of six wrapped licences gives all six; the saving is measured against each template, whatever the block's length."""
    names = ["Apache-2.0", "MIT", "BSD-3-Clause", "GPL-3.0", "GPL-2.0", "CC-BY-4.0-line"]
    bodies = [textwrap.fill(license_scan.TEMPLATES[n], 80, break_long_words=False, break_on_hyphens=False) for n in names]
    got = licenses_of(spark, ["\n".join(bodies), "\n".join(bodies * 20)])
    want = [(license_scan.license_of(n), 0, b) for n, b in zip(names, bodies, strict=True)]
    assert got == [sorted(want), sorted(want * 20)]


def test_license_alignment():
    """The alignment costs as little as the best of all pairs of subsequences."""
    rng = np.random.default_rng(5)
    for _ in range(100):
        block, template = (list(rng.choice(list("abc"), rng.integers(1, n))) for n in (7, 6))
        missing, added, first, end = license_scan.align(block, template)
        least = license_scan.MISS * len(template)
        for r in range(1, len(template) + 1):
            for a in itertools.combinations(range(len(block)), r):
                if any([block[i] for i in a] == [template[j] for j in b] for b in itertools.combinations(range(len(template)), r)):
                    least = min(least, license_scan.MISS * (len(template) - r) + a[-1] + 1 - a[0] - r)
        assert license_scan.MISS * missing + added == least and end - first == len(template) - missing + added


# ------------------------------------------------------------------ helpers
def test_words_match_bytes_split():
    texts = ["A b c\td", "", None, "  x ", "É y Z\x0b1"]
    data, offsets = textkit.text_bytes(pa.array(texts))
    words = textkit.Words(data, offsets, 0, len(texts))
    got = [[bytes(words.data[s:e]) for s, e, d in zip(words.start, words.end, words.doc) if d == i] for i in range(len(texts))]
    assert got == [(t or "").encode().lower().split() for t in texts]
