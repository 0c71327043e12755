"""Rows of one id with other texts, null ids, repeated rows and clashing names through every stage of the pipeline."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
import plain
from spanloom.llm import mixing, toxicity
from spanloom.llm.common import documents
from test_near_dedup import brute

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, left_out int, copies string, gone_id long, text_hash string, component_id int, posterior string, row int"


@pytest.fixture(scope="module")
def rows(spark):
    """Texts of the table under few ids, so that most ids have many texts; some rows repeat, some ids are null."""
    texts = [r["text"] for r in documents(spark, SF).orderBy("doc_id").limit(240).collect()]
    out = []
    for i, t in enumerate(texts):
        doc = None if i % 17 == 0 else i % 5
        out.append((doc, None if i == 3 else t, "en", "s", len(t), i, "x", i % 3, "y", i, "z", i))
        if i % 9 == 0:
            out.append((doc, t + " and one more", "en", "s", len(t), i, "x", i % 3, "y", i, "z", 1000 + i))
        if i % 11 == 0:
            out.append(out[-1])
    return out


def run(spark, name, rows):
    stage = dict(P.STAGES)[name]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = stage(spark, df, SF)
    if name != "packing":
        assert out.columns == df.columns
    return sorted(map(tuple, out.collect()), key=str)


def test_toxicity(spark, rows):
    score = plain.Toxic(toxicity.train(documents(spark, SF), P.labels(spark, SF)))
    assert run(spark, "toxicity", rows) == sorted((r for r in rows if score(r[1]) < 0.5), key=str)


def test_exact_dedup(spark, rows):
    least = {}
    for r in rows:
        if r[0] is not None:
            least[r[1] or ""] = min(r[0], least.get(r[1] or "", r[0]))
    assert run(spark, "exact dedup", rows) == sorted((r for r in rows if r[0] == least.get(r[1] or "")), key=str)


def test_near_dedup(spark, rows):
    """Each distinct id and text is a document; of a group the one with the smallest id, then hash, stays, and its repeats."""
    hashes = {t or "": h for t, h in spark.createDataFrame([(r[1],) for r in rows], "t string").select("t", F.xxhash64(F.coalesce("t", F.lit("")))).collect()}
    nodes = sorted({(r[0], hashes[r[1] or ""], r[1] or "") for r in rows if r[0] is not None})
    root = {nodes[i]: r for i, (_, r) in brute([(i, n[2]) for i, n in enumerate(nodes)], 5, 80).items()}
    kept = {n[:2] for i, n in enumerate(nodes) if root[n] == i}
    assert run(spark, "near dedup", rows) == sorted((r for r in rows if r[0] is None or (r[0], hashes[r[1] or ""]) in kept), key=str)


def test_mixing(spark, rows):
    """Every row by its own text's rate and its id's draw."""
    model = mixing.fit_domains(documents(spark, SF), mixing.labelled_domains(P.labels(spark, SF)))
    df = spark.createDataFrame([(i, r[1]) for i, r in enumerate(rows)], "doc_id long, text string")
    soft = {r["doc_id"]: r for r in mixing.posteriors(df, model).collect()}
    n, p = np.array([soft[i]["n_tokens"] for i in range(len(rows))], float), np.array([soft[i]["posterior"] for i in range(len(rows))])
    wanted = (n @ p) * np.array([0.5 if d == "low" else 1.0 for d in model.domains])
    ids = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i long, doc_id long").select("i", (F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 30)) / F.lit(float(1 << 30))).alias("u"))
    draw = dict(ids.collect())
    got = run(spark, "mixing", rows)
    free = np.array([r[0] is not None for r in rows])
    rate, weight = np.ones(len(rows)), (n * n) @ p
    for _ in range(400):  # small steps to the minimum, whatever the library's steps are
        rate = np.where(free, np.clip(rate - 0.9 * n * (p @ (((rate * n) @ p - wanted) / weight)), 0, 1), 1.0)
    off = np.abs((rate * n) @ p - wanted).sum()
    assert off < 1e-3 * wanted.sum()
    for i, r in enumerate(rows):
        if r[0] is None or (rate[i] > 0.999 and n[i] == 0):
            assert r in got
    # the kept tokens of each domain are those wanted, but for the few draws, and no row is lost to another of its id
    kept = np.array([r in got for r in rows])
    assert len(got) == kept.sum() and 0 < kept.sum() < len(rows)
    by_id = {d: [k for r, k in zip(rows, kept) if r[0] == d] for d in {r[0] for r in rows} - {None}}
    assert sum(0 < sum(own) < len(own) for own in by_id.values()) >= 2
    assert all(kept[i] == (draw[i] < rate[i]) for i in range(len(rows)) if free[i] and abs(draw[i] - rate[i]) > 0.05)


def test_packing(spark, rows):
    assert sum(r[3] for r in run(spark, "packing", rows)) > 0 and len({r[0] for r in run(spark, "packing", rows)}) == 6


def test_mixing_is_optimal_and_says_so(spark):
    """The rates meet the optimality conditions of the bounded least squares, whatever the steps; missed targets are told."""
    rng = np.random.default_rng(4)
    data = [(i, int(rng.integers(1, 200)), [float(x) for x in rng.dirichlet([0.4, 0.4, 0.4])]) for i in range(2000)]
    soft = spark.createDataFrame(data, "doc_id long, n_tokens long, posterior array<double>")
    n, p = np.array([d[1] for d in data], float), np.array([d[2] for d in data])
    for targets, high, reachable in (([0.5, 0.3, 0.2], None, True), ([0.98, 0.01, 0.01], 1.0, False)):
        mixed, fit = mixing.fit_rates(soft, targets, total=n.sum(), max_rate=high)
        rate = mixed.orderBy("doc_id").toPandas().rate.to_numpy()
        totals = (rate * n) @ p
        assert fit.reached == reachable and np.allclose(totals, fit.totals) and np.allclose(fit.targets, np.array(targets) * n.sum())
        if reachable:
            assert np.abs(totals - fit.targets).sum() <= 1e-4 * n.sum()
        else:  # the objective is within a few hundredths of what further steps would reach
            objective = lambda r: float((((r * n) @ p - fit.targets) ** 2 / ((n * n) @ p)).sum())
            better = rate
            for _ in range(3000):
                better = np.clip(better - 0.9 * n * (p @ (((better * n) @ p - fit.targets) / ((n * n) @ p))), 0, high)
            assert objective(rate) <= 1.05 * objective(better)


def test_mixing_query_meets_its_targets(spark):
    """The registered query: expected tokens by domain are four fifths high and one fifth low, and it says so."""
    from spanloom.llm import queries

    rows = queries.op1_mixing(spark, SF).toPandas()
    tokens = rows.rate * rows.n_tokens
    high, low = (tokens * rows.p_high).sum(), (tokens * rows.p_low).sum()
    assert rows.reached.all() and len(rows) == 1000 and abs(high / (high + low) - 0.8) < 1e-3
    assert abs((high + low) / rows.n_tokens.sum() - 1) < 1e-3 and (rows.rate >= 0).all()
    assert abs((rows.copies * rows.n_tokens).sum() / tokens.sum() - 1) < 0.1
