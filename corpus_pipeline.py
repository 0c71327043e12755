"""A training corpus from raw documents: toxicity, exact dedup, near dedup, mixing, packing.

In every stage null texts count as empty, null ids and repeated rows are rows like others (rows with a null id are never
near copies nor left out by mixing), rows of one id with different texts are decided each for itself, texts of any length are
read whole, further columns stay as they are whatever their names, and an empty table gives an empty result. Ties go to the
smallest doc_id, then to the text of the smallest hash.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from spanloom.llm.common import discard, documents, materialize, without
from spanloom.llm.queries import labels, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under one half."""
    return toxicity.clean_only(docs, toxicity.train(documents(spark, sf_dir), labels(spark, sf_dir)))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a resemblance of 0.8 over five-word shingles, the smallest doc_id."""
    return near_dedup.representatives(docs, k=5, percent=80)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn at their rates: the tokens of high-quality text stay, those expected low are halved.

    Rates end at 1, so that no copy comes back after dedup.
    """
    model = mixing.fit_domains(documents(spark, sf_dir), mixing.labelled_domains(labels(spark, sf_dir)))
    soft = mixing.materialize(mixing.posteriors(docs, model))
    sums = soft.agg(*[F.coalesce(F.sum(F.col("n_tokens") * F.col("posterior")[k]), F.lit(0.0)) for k in range(len(model.domains))]).first()
    targets = [float(s) * (0.5 if d == "low" else 1.0) for s, d in zip(sums, model.domains, strict=True)]
    if not sum(targets):
        return docs
    mixed, fit = mixing.fit_rates(soft, targets, total=sum(targets), max_rate=1.0)
    if not fit.reached:
        warnings.warn(f"mixing: targets {fit.targets}, totals {fit.totals} after {fit.steps} steps", stacklevel=2)
    return without(docs, mixed.where("copies = 0"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed in sequences of 1024."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("mixing", mix_domains), ("packing", pack_sequences)]

#: The classifiers' decisions and the packing have no SQL form; tests hold each stage against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again as the next one's input."""
    docs, before = documents(spark, sf_dir), None
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return docs
