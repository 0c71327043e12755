"""Class-balanced sampling with explicit, repeatable orders in place of random shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import materialize


def shuffled(seed: int, *keys: str) -> Column:
    """A repeatable random order of rows by their keys: 60 bits of a digest, as a whole number."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def training_rows(labelled: DataFrame, taught: DataFrame) -> DataFrame:
    """Rows (letter, images, source) of labelled files and of those that a teacher labelled; rows without a letter are left out."""
    return labelled.unionByName(taught).where("letter IS NOT NULL")


def cap_per_group(df: DataFrame, by: list[str], n: int, order: list) -> DataFrame:
    """At most n rows of each group, first in ``order``."""
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def round_robin(df: DataFrame, label: str, source: str, order: list, target: int, uncapped: str | None = None) -> DataFrame:
    """Up to ``target`` rows of each label, one from each source in turn, so that a cap buys variety.

    Rows are numbered within (label, source), and those numbers, then the source, order a label's rows. Rows of the label
    ``uncapped`` all stay, unsorted. A source's rows over the target cannot be among a label's first ones, so each task
    drops them before the shuffle, and a label sorts at most target rows of each source.
    """
    every = F.coalesce(F.col(label) == uncapped, F.lit(False)) if uncapped is not None else F.lit(False)
    turn = F.row_number().over(W.partitionBy(label, source).orderBy(*order))
    out = df.where(~every).withColumn("_turn", turn).where(F.col("_turn") <= target)
    out = out.withColumn("_rank", F.row_number().over(W.partitionBy(label).orderBy("_turn", source))).where(F.col("_rank") <= target).drop("_turn", "_rank")
    return out if uncapped is None else out.unionByName(df.where(every))


def stride_plan(videos: DataFrame, cls: str, target: int, per_video: int, max_videos: int, normal: str = "normal") -> DataFrame:
    """Per class: found, used, stride, per_video, from how many chunks each of its videos must give."""
    n = videos.groupBy(cls).agg(F.count("*").alias("found")).withColumn("used", F.least("found", F.lit(max_videos)))
    need = F.lit(float(target)) / F.greatest("used", F.lit(1))
    bound = (F.lit(target) > 0) & (F.col(cls) != normal)
    stride = F.when(bound & (need > 6), 0.5).when(bound & (need > 3), 1.0).otherwise(2.0)
    cap = F.when(bound, F.greatest(F.lit(1), F.least(F.lit(per_video), F.floor(need * 2).cast("int")))).otherwise(F.lit(per_video))
    return n.select(cls, "found", "used", stride.alias("stride"), cap.cast("int").alias("per_video"))


def balance_plan(rows: DataFrame, label: str, share: float, normal: str = "normal") -> DataFrame:
    """Per label: n and keep, so that normals make up about ``share``.

    Enough normals: keep that many. Too few: keep all and shrink the other classes alike, each to one row at least; no
    normals at all: keep every other row.
    """
    return _plan(rows.groupBy(label).agg(F.count("*").alias("n")), label, share, normal)


def _plan(n: DataFrame, label: str, share: float, normal: str) -> DataFrame:
    """balance_plan() of the labels' counts ``n``, with their further columns."""
    more = [c for c in n.columns if c not in (label, "n")]
    every = W.partitionBy(F.lit(1))  # one row for each class
    n = n.withColumns({"_normal": F.sum(F.when(F.col(label) == normal, F.col("n")).otherwise(0)).over(every), "_other": F.sum(F.when(F.col(label) != normal, F.col("n")).otherwise(0)).over(every)})
    wanted = F.floor(F.col("_other") * F.lit(share) / F.lit(max(1 - share, 1e-6)))
    most = F.floor(F.col("_normal") * F.lit(1 - share) / F.lit(max(share, 1e-6)))
    shrunk = F.greatest(F.lit(1), F.rint(F.col("n") * (most / F.col("_other"))).cast("long"))
    other = F.when((F.col("_normal") < wanted) & (most > 0) & (most < F.col("_other")), F.least(shrunk, "n")).otherwise(F.col("n"))
    keep = F.when(F.col(label) == normal, F.least("n", wanted)).otherwise(other)
    return n.select(label, "n", keep.cast("long").alias("keep"), *more)


#: Precision of the percentiles that bound a label's cut-off: about n / ACCURACY rows of a label are sorted.
ACCURACY = 10_000


def balance(rows: DataFrame, label: str, share: float, order: list, normal: str = "normal") -> DataFrame:
    """Rows of each label as balance_plan() says, first in ``order``: a number, then what else breaks ties.

    No label is sorted as a whole: approximate percentiles around the place of the last row kept bound it on both sides
    (counts confirm the bounds, else they are the label's least and greatest number), rows outside need no rank, and only
    the rows between are numbered. A sketch says something else whenever its rows come in another order, so bounds and counts
    are written once, a row for each class. Rows whose number is null are never kept while others are there.
    """
    first, *ties = order
    first = first if isinstance(first, Column) else F.col(first)
    marked = rows.withColumn("_at", F.coalesce(first.cast("double"), F.lit(float("inf"))))
    place = lambda d: F.least(F.greatest((F.col("keep") + d) / F.col("n"), F.lit(0.0)), F.lit(1.0))
    slack = F.ceil(2 * F.col("n") / ACCURACY) + 1
    sketch = marked.groupBy(label).agg(F.count("*").alias("n"), F.percentile_approx("_at", [i / ACCURACY for i in range(0, ACCURACY + 1, 10)], ACCURACY).alias("_q"), F.min("_at").alias("_min"), F.max("_at").alias("_max"))
    step = ACCURACY // 10
    own = _plan(sketch, label, share, normal).withColumns({"_a": F.element_at("_q", (F.floor(place(-slack) * step) + 1).cast("int")), "_b": F.element_at("_q", (F.ceil(place(slack) * step) + 1).cast("int"))})
    own = materialize(own.select(label, "keep", "_a", "_b", "_min", "_max"))  # one row for each class
    n = marked.join(F.broadcast(own.select(label, "_a", "_b")), label).groupBy(label).agg(F.sum((F.col("_at") < F.col("_a")).cast("long")).alias("_under"), F.sum((F.col("_at") <= F.col("_b")).cast("long")).alias("_upto"))
    own = own.join(n, label).withColumn("_good", (F.col("_under") <= F.col("keep")) & (F.col("_upto") >= F.col("keep")))
    own = own.select(label, "keep", F.when(F.col("_good"), F.col("_a")).otherwise(F.col("_min")).alias("_a"), F.when(F.col("_good"), F.col("_b")).otherwise(F.col("_max")).alias("_b"), F.when(F.col("_good"), F.col("_under")).otherwise(0).alias("_under"))
    own = materialize(own)
    near = marked.join(F.broadcast(own), label).where(F.col("_at") <= F.col("_b"))
    low, between = F.col("_at") < F.col("_a"), F.col("_at") >= F.col("_a")
    ranked = near.where(between).withColumn("_rank", F.row_number().over(W.partitionBy(label).orderBy("_at", first.asc_nulls_last(), *ties)) + F.col("_under")).where(F.col("_rank") <= F.col("keep"))
    return near.where(low).select(*rows.columns).unionByName(ranked.select(*rows.columns))


def agreed(df: DataFrame, first: str, second: str, out: str = "label") -> DataFrame:
    """Rows on which both passes give the same label, none null."""
    return df.where(F.col(first) == F.col(second)).withColumn(out, F.col(first))
