"""Rules on answer sheets as they come, as raw JSON, where a key that is absent differs from one that is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The largest sheet in bytes, and the keys that every answer must have.
LIMIT, REQUIRED = 5_000_000, ("video_id", "events", "runtime_metadata")


def _state(value: Column, key: str) -> Column:
    """``missing``, ``null``, or null where the variant has the key with a value."""
    own = F.try_variant_get(value, f"$.{key}", "variant")
    return F.when(own.isNull(), "missing").when(F.is_variant_null(own), "null")


def raw_violations(sheets: DataFrame, key: str, text: str = "value", limit: int = LIMIT) -> DataFrame:
    """(key, answer, rule, detail), one row for each breach; ``answer`` counts a sheet's answers from 0, null for the sheet itself.

    Rules: too_large (in bytes of UTF-8; such a sheet is not parsed), not_json, predictions_missing, predictions_null,
    predictions_type, and of each answer, <key>_missing and <key>_null for the keys of REQUIRED, and call_times_count, where
    a model's call_times_ms does not have call_count entries. Further keys are ignored. Null texts are not JSON; repeated
    sheets are judged each for itself; an empty table gives an empty result.
    """
    fits = F.octet_length(text) <= limit
    rows = sheets.select(key, F.col(text).alias("_text"), F.coalesce(fits, F.lit(True)).alias("_fits")).withColumn("_sheet", F.when(F.col("_fits"), F.try_parse_json("_text")))
    top = _state(F.col("_sheet"), "predictions")
    answers = F.try_variant_get(F.col("_sheet"), "$.predictions", "array<variant>")
    whole = (
        F.when(~F.col("_fits"), "too_large")
        .when(F.col("_sheet").isNull(), "not_json")
        .when(top.isNotNull(), F.concat(F.lit("predictions_"), top))
        .when(answers.isNull(), "predictions_type")
    )
    rows = rows.select(key, whole.alias("_rule"), answers.alias("_answers"))
    nothing = F.lit(None)
    of_sheet = rows.where("_rule IS NOT NULL").select(key, nothing.cast("int").alias("answer"), F.col("_rule").alias("rule"), nothing.cast("string").alias("detail"))
    each = rows.where("_rule IS NULL").select(key, F.posexplode("_answers").alias("answer", "_a"))
    found = lambda rule, detail: F.struct(rule.alias("rule"), detail.cast("string").alias("detail"))
    keys = [F.when(_state(F.col("_a"), k).isNotNull(), found(F.concat(F.lit(f"{k}_"), _state(F.col("_a"), k)), nothing)) for k in REQUIRED]
    times = "array<struct<model_name:string,call_count:bigint,call_times_ms:array<double>>>"
    models = F.coalesce(F.try_variant_get(F.col("_a"), "$.runtime_metadata.model_runtimes", times), F.array().cast(times))
    wrong = F.filter(models, lambda m: m["call_times_ms"].isNotNull() & ~F.size(m["call_times_ms"]).eqNullSafe(m["call_count"].cast("int")))
    counts = F.transform(wrong, lambda m: found(F.lit("call_times_count"), m["model_name"]))
    rules = F.concat(F.array_compact(F.array(*keys)), counts)
    return of_sheet.unionByName(each.select(key, "answer", F.explode(rules).alias("r")).select(key, "answer", "r.rule", "r.detail"))
