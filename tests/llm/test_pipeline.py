"""Each stage of the corpus pipeline against a plain version on its own input."""

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
import plain
from spanloom.llm import mixing, toxicity
from spanloom.llm.common import documents
from test_near_dedup import brute

SF = "/root/testdata/sf0.01"


def draws(spark, ids):
    """Each id's draw between 0 and 1: the documented hash of the id."""
    rows = spark.createDataFrame([(int(i),) for i in ids], "doc_id long").select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 30)).alias("u"))
    u = dict(rows.collect())
    return np.array([u[int(i)] / (1 << 30) for i in ids])


def test_stages(spark, tmp_path):
    docs = documents(spark, SF)
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(P.STAGES):
        before = docs.toPandas()
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = docs.toPandas()
        seen.append(name)
        if name != "packing":
            assert docs.columns == columns
            assert set(after.doc_id) <= set(before.doc_id)
        if name == "toxicity":
            score = plain.Toxic(toxicity.train(documents(spark, SF), P.labels(spark, SF)))
            assert set(after.doc_id) == {d for d, t in zip(before.doc_id, before.text) if score(t) < 0.5}
            toxic = dict(P.labels(spark, SF).select("doc_id", "toxic").collect())
            right = [(toxic[d] == 1) == (d not in set(after.doc_id)) for d in before.doc_id if d in toxic]
            assert sum(right) > 0.95 * len(right)
        if name == "exact dedup":
            assert sorted(after.doc_id) == sorted(before.groupby("text").doc_id.min())
        if name == "near dedup":
            want = {root for _, root in brute(list(zip(before.doc_id, before.text)), 5, 80).values()}
            assert set(after.doc_id) == want
        if name == "mixing":
            assert after.doc_id.is_unique
            known = documents(spark, SF).join(mixing.labelled_domains(P.labels(spark, SF)), "doc_id").select("text", "domain")
            model = plain.Domains([(t, d) for t, d in known.collect() if len((t or "").encode()) <= 20_000])  # under 3,000 rows: the sample is all of them
            n, p = zip(*map(model, before.text))
            fitted = mixing.fit_domains(documents(spark, SF), mixing.labelled_domains(P.labels(spark, SF)))
            soft = {r["doc_id"]: r for r in mixing.posteriors(spark.createDataFrame(before[["doc_id", "text"]]), fitted).collect()}
            assert all(soft[d]["n_tokens"] == m and np.allclose(soft[d]["posterior"], q, atol=1e-3) for d, m, q in zip(before.doc_id, n, p))
            targets = [sum(m * q[k] for m, q in zip(n, p)) * (0.5 if domain == "low" else 1) for k, domain in enumerate(model.names)]
            rate = plain.rates(n, p, targets, 1.0)
            draw = draws(spark, before.doc_id)
            sure = np.abs(draw - rate) > 1e-3
            left = ~before.doc_id.isin(after.doc_id).to_numpy()
            assert sure.mean() > 0.98 and (left == (draw >= rate))[sure].all()
        if name == "packing":
            assert set(after.doc_id) == set(before.doc_id)
            count = Tokenizer.from_file(P.tokenizer_path())
            for d, t in zip(before.doc_id, before.text):
                own = after[after.doc_id == d].sort_values("piece")
                assert own.length.sum() == len(count.encode(t or "", add_special_tokens=False).ids) + 1
            for _, own in after.sort_values("offset").groupby("sequence_id"):
                assert list(own.offset) == [0, *own.length.cumsum()[:-1]] and own.length.sum() <= 1024
            bound = -(-int(after.length.sum()) // 1024)
            assert bound <= after.sequence_id.nunique() <= bound + max(2, 0.01 * bound)
    assert len(seen) == 5


def test_empty_input(spark):
    docs = documents(spark, SF).limit(0)
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
    assert P.STAGES[-1][1](spark, docs, SF).count() == 0
