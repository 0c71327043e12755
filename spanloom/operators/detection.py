"""From chunk scores to events: windows, smoothing, hysteresis runs, merging, selection, clip votes, verification.

All windows partition by the series key, so a chain of these operators needs one exchange on that key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Profile, Settings
from ..functions import explanation, literal_map


Key = str | list[str]  # the columns that name a series


def _by(key: Key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


# ------------------------------------------------------------------ generators
def sliding_chunks(videos: DataFrame, profile: Profile, dur: str = "duration_sec", floor: float = 0.1) -> DataFrame:
    """One row per window of each video: chunk_idx, start_sec, end_sec (clipped). floor 0: no window for clips to 0.5 s."""
    limit = F.greatest(F.col(dur) - 0.5, F.lit(floor)) if floor else F.col(dur) - 0.5
    last = F.greatest(F.ceil(limit / profile.stride_sec), F.lit(0)).cast("int")
    out = videos.withColumn("chunk_idx", F.explode(F.sequence(F.lit(0), last))).withColumn("start_sec", F.col("chunk_idx") * F.lit(profile.stride_sec))
    return out.where(F.col("start_sec") < limit).withColumn("end_sec", F.least(F.col("start_sec") + profile.chunk_sec, F.col(dur)))


def frame_indices(start: Column, end: Column, fps: Column, frames: Column, images: int, distinct: bool = True) -> Column:
    """Frames at the midpoints of ``images`` equal parts, half-even rounded and clamped; as inference, without repeats."""
    last = F.greatest(frames - 1, F.lit(0))
    at = F.transform(F.sequence(F.lit(0), F.lit(images - 1)), lambda j: F.greatest(F.least(F.rint((start + (end - start) * (j + 0.5) / images) * fps).cast("long"), last), F.lit(0).cast("long")))
    return F.array_distinct(at) if distinct else at


def wanted_frames(chunks: DataFrame, key: str = "video_id", frames: str = "frame_idx") -> DataFrame:
    """The distinct frames to decode, each once however many windows show it."""
    return chunks.select(key, F.explode(frames).alias("frame")).distinct()


def window_images(chunks: DataFrame, decoded: DataFrame, key: str = "video_id", order: str = "chunk_idx", frames: str = "frame_idx", least: int = 1) -> DataFrame:
    """key, order, images: for each window its decoded frames (key, frame, image) in the order wanted, joined back however
    many windows show them.

    Frames that were not decoded, or that have no image, are left out, and so are windows with fewer than ``least``
    images: 1 for inference, the number wanted less 1 for training.
    """
    wanted = chunks.select(key, order, F.posexplode(frames).alias("_place", "frame"))
    got = wanted.join(decoded.where("image IS NOT NULL").select(key, "frame", "image"), [key, "frame"])
    one = F.struct("_place", "image")
    out = got.groupBy(key, order).agg(F.sort_array(F.collect_list(one)).alias("_i"))  # as many as a window has frames
    return out.where(F.size("_i") >= least).select(key, order, F.transform("_i", lambda x: x["image"]).alias("images"))


def tile_grid(images: DataFrame, grid: int, height: str = "h", width: str = "w") -> DataFrame:
    """Rectangles of grid x grid tiles; the last row and column take the rest; an image smaller than the grid is one tile."""
    th, tw = F.floor(F.col(height) / grid), F.floor(F.col(width) / grid)
    small = (th < 1) | (tw < 1)
    cells = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in range(grid) for c in range(grid)])
    out = images.withColumn("_t", F.explode(F.when(small, F.slice(cells, 1, 1)).otherwise(cells))).withColumns({"r": F.col("_t.r"), "c": F.col("_t.c")}).drop("_t")
    edge = lambda i, t, full: F.when(small | (F.col(i) == grid - 1), F.col(full)).otherwise((F.col(i) + 1) * t).cast("int")
    return out.withColumns({"y0": (F.col("r") * th).cast("int"), "x0": (F.col("c") * tw).cast("int"), "y1": edge("r", th, height), "x1": edge("c", tw, width)})


# ------------------------------------------------------------------ signal
def center_median(df: DataFrame, key: Key, order: str, value: str, width: int = 3, out: str = "smoothed") -> DataFrame:
    """Median over a centred frame, cut at the ends (two values: their mean); series shorter than the width stay as they are."""
    by = W.partitionBy(*_by(key))
    if width == 3:
        near, x = by.orderBy(order), F.col(value)
        before, after = F.lag(value).over(near), F.lead(value).over(near)
        n = F.count("*").over(by)
        return df.withColumns({"_b": before, "_a": after, "_n": n}).withColumn(
            out,
            F.when(F.col("_n") < 3, x).when(F.col("_b").isNull(), (x + F.col("_a")) / 2).when(F.col("_a").isNull(), (F.col("_b") + x) / 2).otherwise(F.element_at(F.sort_array(F.array("_b", x, "_a")), 2)),
        ).drop("_b", "_a", "_n")
    half = width // 2
    middle = F.percentile(value, F.lit(0.5)).over(by.orderBy(order).rowsBetween(-half, half))
    return df.withColumn(out, F.when(F.count("*").over(by) < width, F.col(value)).otherwise(middle))


def gate(df: DataFrame, key: Key, value: str, least: float) -> DataFrame:
    """Only series whose greatest value reaches ``least``."""
    return df.withColumn("_top", F.max(value).over(W.partitionBy(*_by(key)))).where(F.col("_top") >= least).drop("_top")


# ------------------------------------------------------------------ runs
def hysteresis(df: DataFrame, key: Key, order: str, value: str, t_high: float | Column, t_low: float, k: int, run: str = "run_id") -> DataFrame:
    """Rows inside runs, with the run's number.

    A run opens at the first row from which k values in sequence are at least t_high (one, in a series shorter than k)
    and lasts while values are at least t_low. It lies in one island of values >= t_low, from the island's first opening
    row on, so islands and a look-ahead frame say it all. t_high may be a column, for several thresholds at once.
    """
    if not isinstance(t_high, Column) and t_low > t_high:
        raise ValueError("t_low must not exceed t_high")
    by = W.partitionBy(*_by(key))
    ahead = by.orderBy(order).rowsBetween(0, k - 1)
    opens = ((F.min(value).over(ahead) >= t_high) & (F.count("*").over(ahead) == k)) | ((F.count("*").over(by) < k) & (F.col(value) >= t_high))
    marked = df.withColumns({run: F.sum((F.col(value) < t_low).cast("int")).over(by.orderBy(order)), "_opens": opens})
    first = F.min(F.when(F.col("_opens"), F.col(order))).over(W.partitionBy(*_by(key), run))
    return marked.withColumn("_first", first).where((F.col(value) >= t_low) & (F.col(order) >= F.col("_first"))).drop("_opens", "_first")


def run_events(runs: DataFrame, key: Key, probs: str, smoothed: str, classes: list[str], run: str = "run_id", start: str = "start_sec", end: str = "end_sec") -> DataFrame:
    """One event per run: class by summed unsmoothed probability (ties: the lower ordinal), span, score.

    probs: array of class probabilities without the normal class, null where the class is missing; runs without any
    class are dropped.
    """
    sums = [F.sum(F.col(probs)[i]).alias(f"_s{i}") for i in range(len(classes))]
    out = runs.groupBy(*_by(key), run).agg(F.bround(F.min(start), 2).alias("start_sec"), F.bround(F.max(end), 2).alias("end_sec"), F.max(smoothed).alias("score"), *sums)
    entries = F.array(*[F.when(F.col(f"_s{i}").isNotNull(), F.struct(F.col(f"_s{i}").alias("w"), F.lit(-i).alias("o"))) for i in range(len(classes))])
    out = out.withColumn("_best", F.array_max(F.array_compact(entries))).where(F.col("_best").isNotNull())
    return out.withColumn("class_name", F.element_at(F.array(*map(F.lit, classes)), 1 - F.col("_best.o"))).drop("_best", *[f"_s{i}" for i in range(len(classes))])


def merge_gaps(events: DataFrame, key: Key, gap: float) -> DataFrame:
    """Events of one class merge with the one just before them (by start) if no more than ``gap`` lies between.

    Another class in between breaks the chain. Ends must not decrease with starts, as for runs of one series.
    """
    near = W.partitionBy(*_by(key)).orderBy("start_sec", "end_sec")
    cut = ~((F.lag("class_name").over(near) == F.col("class_name")) & (F.col("start_sec") - F.lag("end_sec").over(near) <= gap))
    groups = events.withColumn("_cut", F.coalesce(cut, F.lit(True)).cast("int")).withColumn("_group", F.sum("_cut").over(near))
    return groups.groupBy(*_by(key), "_group").agg(F.first("class_name").alias("class_name"), F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"), F.max("score").alias("score")).drop("_group")


def long_enough(events: DataFrame, durations: dict[str, float], default: float = 1.0) -> DataFrame:
    least = F.coalesce(F.try_element_at(literal_map(durations), F.col("class_name")), F.lit(default)) if durations else F.lit(default)
    return events.where(F.col("end_sec") - F.col("start_sec") >= least)


def top_events(events: DataFrame, key: Key, n: int) -> DataFrame:
    """The n events of greatest score (ties: the earlier start), numbered by start."""
    best = F.row_number().over(W.partitionBy(*_by(key)).orderBy(F.desc("score"), "start_sec", "class_name"))
    kept = events.withColumn("_rank", best).where(F.col("_rank") <= n).drop("_rank")
    return kept.withColumn("event_ord", F.row_number().over(W.partitionBy(*_by(key)).orderBy("start_sec", "class_name")))


def detect(chunks: DataFrame, key: str, classes: list[str], settings: Settings, order: str = "chunk_idx", p_anom: str = "p_anom", probs: str = "probs") -> DataFrame:
    """The whole chain: smooth, gate, runs, vote, merge, least duration, top events. One exchange, on the key."""
    return detect_smoothed(center_median(chunks, key, order, p_anom), key, classes, settings, order, probs)


def detect_smoothed(smoothed: DataFrame, key: Key, classes: list[str], settings: Settings, order: str = "chunk_idx", probs: str = "probs", t_high: float | Column | None = None) -> DataFrame:
    """detect() from a smoothed signal on. t_high: in place of the settings', maybe a column that is part of the key."""
    out = gate(smoothed, key, "smoothed", settings.t_video)
    out = hysteresis(out, key, order, "smoothed", settings.t_high if t_high is None else t_high, settings.t_low, settings.t_open_chunks)
    out = merge_gaps(run_events(out, key, probs, "smoothed", classes), key, settings.merge_gap_sec)
    return top_events(long_enough(out, settings.min_duration, settings.default_duration), key, settings.max_events)


def explained(events: DataFrame) -> DataFrame:
    """events with the explanation of their class, as an answer sheet gives it."""
    return events.withColumn("explanation", explanation(F.col("class_name")))


def clip_vote(chunks: DataFrame, key: str, classes: list[str], least: float, probs: str = "probs") -> DataFrame:
    """Pooled vote: sums of class probabilities (classes[0] is normal) over a clip; a clip whose pooled anomaly is under
    ``least``, or that has no chunks, gets no row."""
    sums = chunks.groupBy(key).agg(*[F.coalesce(F.sum(F.col(probs)[i]), F.lit(0.0)).alias(f"_s{i}") for i in range(len(classes))])
    total = sum((F.col(f"_s{i}") for i in range(len(classes))), F.lit(0.0))
    total = F.when(total == 0, 1.0).otherwise(total)
    best = F.array_max(F.array(*[F.struct(F.col(f"_s{i}").alias("w"), F.lit(-i).alias("o")) for i in range(1, len(classes))]))
    out = sums.withColumns({"p_anom": 1 - F.col("_s0") / total, "_best": best}).where(F.col("p_anom") >= least)
    return out.select(key, F.element_at(F.array(*map(F.lit, classes)), 1 - F.col("_best.o")).alias("class_name"), "p_anom")


# ------------------------------------------------------------------ second stage
def wants_verify(p_anom: Column, chunk_idx: Column, settings: Settings) -> Column:
    low, high = settings.verify_band
    inside = (p_anom > low) & (p_anom < high)
    return inside | (chunk_idx % settings.verify_every_n == 0) if settings.verify_every_n else inside


def verify_budget(candidates: DataFrame, key: str, order: str, cost: Column, budget: int) -> DataFrame:
    """Candidates in order while the cost of those before them is under the budget; the last may overshoot it."""
    before = F.coalesce(F.sum(F.greatest(cost, F.lit(1))).over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return candidates.withColumn("spent", before.cast("long")).where(F.col("spent") < budget)


def best_tile(tiles: DataFrame, keys: list[str], p_anom: str = "p_anom", position: str = "tile") -> DataFrame:
    """The most anomalous tile of each chunk; ties: the first position."""
    return tiles.groupBy(*keys).agg(F.max_by(F.struct(F.col(position).alias("tile"), F.col(p_anom).alias("tile_anom")), F.struct(F.col(p_anom), -F.col(position))).alias("_b")).select(*keys, "_b.tile", "_b.tile_anom")


def tile_override(full: Column, tile: Column, least: float) -> Column:
    """A tile's verdict counts if it is more anomalous than the whole frame's and sure enough."""
    return F.coalesce((tile > full) & (tile >= least), F.lit(False))
