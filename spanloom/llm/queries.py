"""One query for each operator, over its whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import differencing, divergence, exact_dedup, fingerprint, license_scan, lm, mixing, near_dedup, packing, pii, repeats, resampling, toxicity
from .common import documents, held_out

PACK_TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = PACK_TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, model, fit = mixing.mix_documents(documents(spark, sf_dir), mixing.labelled_domains(labels(spark, sf_dir)), {"high": 0.8, "low": 0.2})
    return mixed.select("doc_id", "n_tokens", *[F.round(F.col("posterior")[k], 9).alias(f"p_{d}") for k, d in enumerate(model.domains)], F.round("rate", 9).alias("rate"), "copies", F.lit(fit.reached).alias("reached"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(documents(spark, sf_dir))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), k=2, percent=80)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(documents(spark, sf_dir))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(documents(spark, sf_dir)).drop("spans")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, labels(spark, sf_dir).where(~held_out(F.col("doc_id"), 5)))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id"), 5).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir), keep="largest")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path())


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def op12_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return differencing.pack_balanced(documents(spark, sf_dir), tokenizer_path())


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_pii": op3_pii,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_fingerprints": op5_fingerprints,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_license_scan": op7_license_scan,
    "op8_toxicity": op8_toxicity,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_packing": op10_packing,
    "op11_source_divergence": op11_source_divergence,
    "op12_differencing": op12_differencing,
    "op13_resampling": op13_resampling,
}

ORACLE_SQL: dict[str, str] = {
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op11_source_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x60\x7B-\x7F]+')) AS term FROM d),
        k AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 10),
        l AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM k GROUP BY ALL),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
        t AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY ALL),
        p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
                     1 + 1000000000 * (coalesce(c.n, 0) + 2) // (coalesce(t.total, 0) + 2 * l.v) AS p, 1 + 1000000000 * (k.n + 2) // (l.total + 2 * l.v) AS q
              FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON (c.lang, c.source, c.term) = (g.lang, g.source, k.term)
              LEFT JOIN t ON (t.lang, t.source) = (g.lang, g.source)),
        f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
              FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
              FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON (f.lang, f.source, f.item) = (a.lang, a.source, b.source)
              UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
        x AS (SELECT lang, source, part, item, value::BIGINT AS value,
                     row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM o)
        SELECT * FROM x WHERE part = 'pair' OR rank <= 10""",
    "op13_resampling": r"""
        WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
                            lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps),
        texts AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT NULL, NULL, text FROM benchmark),
        w AS (SELECT r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts),
        f AS (SELECT r, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) AS feature FROM w),
        n AS (SELECT r, feature, count(*) AS n FROM f GROUP BY ALL),
        b AS (SELECT feature, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(hex(feature)) // 2 + 1), lambda i: ('0x' || substr(hex(feature), 2 * i - 1, 2))::BIGINT)),
                                              lambda c, x: xor(c >> 8, steps[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
              FROM (SELECT DISTINCT feature FROM n), crc),
        q AS (SELECT range AS bucket, coalesce(s, 0)::BIGINT AS s, coalesce(t, 0)::BIGINT AS t FROM range(10000) LEFT JOIN
              (SELECT bucket, sum(n) FILTER (r IS NOT NULL) AS s, sum(n) FILTER (r IS NULL) AS t FROM n JOIN b USING (feature) GROUP BY bucket) ON range = bucket),
        g AS (SELECT bucket, floor(1000 * ln((((t + 1) * (sum(s) OVER () + 10000))::DOUBLE) / ((s + 1) * (sum(t) OVER () + 10000))::DOUBLE))::BIGINT AS gain FROM q),
        v AS (SELECT r, sum(n)::BIGINT AS n_features, floor(sum(n * gain) / sum(n))::BIGINT AS weight FROM n JOIN b USING (feature) JOIN g USING (bucket) WHERE r IS NOT NULL GROUP BY r),
        z AS (SELECT doc_id, len(words) >= 20 AS enough, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                     coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
              FROM w LEFT JOIN v USING (r) WHERE w.r IS NOT NULL),
        k AS (SELECT *, row_number() OVER (PARTITION BY enough ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY enough) AS number FROM z)
        SELECT doc_id, n_features, weight, score, CASE WHEN enough AND place <= 25 * number // 100 THEN place END AS rank FROM k""",
}
