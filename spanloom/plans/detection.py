"""Queries of the detection chain: windows, signal, runs, events, votes, verification."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CLASSES, EXPLANATIONS, LETTERS, Profile
from ..functions import class_distribution, letter_class, letter_logs, literal_map, p_anomaly, softmax, temperature, token_letter, top_classes
from ..operators import detection as D
from ..operators import segments as G
from ..sources import frames, reply_tokens, score_chunks, teacher_letter
from ..tables import shared_folder
from . import DURATIONS, SETTINGS, SMOOTH, TYPES, WINDOW, chunks, events_sql, final_sql, merged_sql, runs_sql, table, with_probs

S = SETTINGS
#: Video classes that the stand-in's types go by where an answer needs one.
NAMED = dict(zip(TYPES, ["fire", "smoke", "traffic_accident", "wrong_way_driving", "traffic_congestion"], strict=True))
NAMED_SQL = "CASE class_name " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in NAMED.items()) + " END"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    """Register a function under its name, beside its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.center_median(chunks(spark, sf_dir), "user_id", "chunk_idx", "p_anom")


def runs(spark: SparkSession, sf_dir: str, k: int = 2) -> DataFrame:
    return D.hysteresis(smoothed(spark, sf_dir), "user_id", "chunk_idx", "smoothed", S.t_high, S.t_low, k)


def run_events(spark: SparkSession, sf_dir: str, k: int = 2) -> DataFrame:
    return D.run_events(runs(spark, sf_dir, k), "user_id", "probs", "smoothed", TYPES)


def final_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.detect(chunks(spark, sf_dir), "user_id", TYPES, S)


# ------------------------------------------------------------------ signal and runs
@query(f"WITH {SMOOTH}{runs_sql()}{events_sql()} SELECT user_id, class_name, start_sec, end_sec, score FROM ev")
def flagship_hysteresis_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_events(spark, sf_dir).select("user_id", "class_name", "start_sec", "end_sec", "score")


@query(f"WITH {SMOOTH} SELECT user_id, chunk_idx, p AS p_anom, s AS smoothed FROM sm")
def signal_center_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smoothed(spark, sf_dir).select("user_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), "p_anom", "smoothed")


@query(
    f"""WITH {SMOOTH} SELECT user_id, chunk_idx, round(CASE WHEN count(*) OVER (PARTITION BY user_id) < 5 THEN p
        ELSE quantile_cont(p, 0.5) OVER (PARTITION BY user_id ORDER BY chunk_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) END, 9) AS smoothed FROM sm"""
)
def signal_center_median_w5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = D.center_median(chunks(spark, sf_dir), "user_id", "chunk_idx", "p_anom", 5)
    return out.select("user_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), F.round("smoothed", 9).alias("smoothed"))


def _bounds(df: DataFrame) -> DataFrame:
    return df.groupBy("user_id", "run_id").agg(F.min("chunk_idx").cast("long").alias("first_chunk"), F.max("chunk_idx").cast("long").alias("last_chunk")).drop("run_id")


for _k in (2, 1, 3):

    def _runs(spark: SparkSession, sf_dir: str, k: int = _k) -> DataFrame:
        return _bounds(runs(spark, sf_dir, k))

    _runs.__name__ = "hysteresis_runs" + ("" if _k == 2 else f"_k{_k}")
    query(f"WITH {SMOOTH}{runs_sql(_k)} SELECT user_id, min(chunk_idx) AS first_chunk, max(chunk_idx) AS last_chunk FROM runs GROUP BY user_id, run_id")(_runs)


@query(f"WITH {SMOOTH}{runs_sql()}{events_sql()}{merged_sql()} SELECT user_id, class_name, start_sec, end_sec, score FROM merged")
def gap_merge_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.merge_gaps(run_events(spark, sf_dir), "user_id", S.merge_gap_sec).select("user_id", "class_name", "start_sec", "end_sec", "score")


@query(f"WITH {SMOOTH}{runs_sql(gate='0.65')}{events_sql()}{merged_sql()}{final_sql()} SELECT * FROM fin")
def events_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return final_events(spark, sf_dir).select("user_id", "class_name", "start_sec", "end_sec", "score", F.col("event_ord").cast("long").alias("event_ord"))


@query(f"WITH {SMOOTH}{runs_sql(gate='0.65')}{events_sql()}{merged_sql()}{final_sql()} SELECT * FROM fin WHERE user_id IS NOT NULL")
def events_segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The final events from series cut into segments of 16 chunks, without a task for a whole series."""
    e = table(spark, sf_dir, "events").where("user_id IS NOT NULL").select("user_id", "ts", "event_id", "event_type", "value")
    placed = with_probs(G.numbered(e, "user_id", ["ts", "event_id"], "chunk_idx"))
    out = G.detect_segments(placed, "user_id", TYPES, S, 16)
    return out.select("user_id", "class_name", "start_sec", "end_sec", "score", F.col("event_ord").cast("long").alias("event_ord"))


@query(f"WITH {SMOOTH} SELECT user_id, count(*) AS n FROM (SELECT *, max(s) OVER (PARTITION BY user_id) AS top FROM sm) WHERE top >= 0.88 GROUP BY user_id")
def video_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.gate(smoothed(spark, sf_dir), "user_id", "smoothed", 0.88).groupBy("user_id").agg(F.count("*").alias("n"))


@query(
    f"""WITH grid AS (SELECT unnest([0.6, 0.7, 0.8])::DOUBLE AS t_high), {SMOOTH}{runs_sql(gate='0.65', grid=True)}{events_sql(True)}{merged_sql(grid=True)}{final_sql(True)}
    SELECT t_high, count(*) AS n_events, count(DISTINCT user_id) AS n_users, round(sum(end_sec - start_sec), 6) AS seconds FROM fin GROUP BY t_high"""
)
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same gated signal for each threshold, all in one pass: (user, threshold) is the key of everything after it."""
    base = D.gate(smoothed(spark, sf_dir), "user_id", "smoothed", S.t_video)
    grid = base.withColumn("t_high", F.explode(F.array(*map(F.lit, (0.6, 0.7, 0.8)))))
    every = D.detect_smoothed(grid, ["user_id", "t_high"], TYPES, S, t_high=F.col("t_high"))
    return every.groupBy("t_high").agg(F.count("*").alias("n_events"), F.countDistinct("user_id").alias("n_users"), F.round(F.sum(F.col("end_sec") - F.col("start_sec")), 6).alias("seconds"))


@query(
    f"""WITH {SMOOTH}{runs_sql(gate='0.65')}{events_sql()}{merged_sql()}{final_sql()} SELECT user_id, event_ord, {NAMED_SQL} AS class_name, start_sec, end_sec,
    CASE {NAMED_SQL} {' '.join(f"WHEN '{c}' THEN '{x}'" for c, x in EXPLANATIONS.items())} END AS explanation FROM fin"""
)
def events_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final events as answers: each with the text of its class."""
    out = final_events(spark, sf_dir).withColumn("class_name", F.element_at(literal_map(NAMED), F.col("class_name")))
    return D.explained(out).select("user_id", F.col("event_ord").cast("long").alias("event_ord"), "class_name", "start_sec", "end_sec", "explanation")


@query(
    """WITH v AS (SELECT user_id, event_type, sum(value / (value + 20.0)) AS w, sum(1 - value / (value + 20.0)) AS wn FROM events GROUP BY ALL),
    t AS (SELECT user_id, sum(w) + sum(wn) AS z, sum(wn) AS wn FROM v GROUP BY user_id)
    SELECT user_id, event_type AS class_name, round(1 - t.wn / z, 9) AS p_anom FROM v JOIN t USING (user_id) WHERE 1 - t.wn / z >= 0.5
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY w DESC, event_type) = 1"""
)
def clip_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir).withColumn("probs", F.concat(F.array(1 - F.col("p_anom")), "probs"))
    return D.clip_vote(c, "user_id", ["normal", *TYPES], 0.5).withColumn("p_anom", F.round("p_anom", 9))


# ------------------------------------------------------------------ generators
DUR = "dur AS (SELECT user_id, count(*) / 7.0::DOUBLE AS d FROM events GROUP BY user_id)"


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg((F.count("*") / 7.0).alias("duration_sec"))


def _chunk_sql(length: float, stride: float, limit: str) -> str:
    return f"""{DUR}, c AS (SELECT user_id, d, i AS chunk_idx, i * {stride}::DOUBLE AS start_sec, least(i * {stride}::DOUBLE + {length}::DOUBLE, d) AS end_sec
    FROM dur, unnest(range(0, ceil({limit} / {stride})::BIGINT + 1)) AS u(i) WHERE i * {stride}::DOUBLE < {limit})"""


INFER = _chunk_sql(2.0, 1.0, "greatest(d - 0.5, 0.1)")


@query(f"WITH {INFER} SELECT user_id, chunk_idx, start_sec, end_sec FROM c")
def sliding_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.sliding_chunks(durations(spark, sf_dir), WINDOW).select("user_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), "start_sec", "end_sec")


@query(f"WITH {_chunk_sql(3.0, 1.5, 'greatest(d - 0.5, 0.1)')} SELECT user_id, chunk_idx, start_sec, end_sec FROM c")
def sliding_chunks_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.sliding_chunks(durations(spark, sf_dir), Profile(3.0, 1.5)).select("user_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), "start_sec", "end_sec")


@query(f"WITH {_chunk_sql(2.0, 2.0, '(d - 0.5)')} SELECT user_id, chunk_idx, start_sec, end_sec FROM c")
def train_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.sliding_chunks(durations(spark, sf_dir), Profile(2.0, 2.0), floor=0.0).select("user_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), "start_sec", "end_sec")


FRAME = "greatest(least(round_even(({a} + ({b} - {a}) * (j + 0.5) / 8) * 25.0, 0)::BIGINT, greatest(floor(d * 25.0)::BIGINT - 1, 0)), 0)"


@query(
    f"WITH {INFER} SELECT user_id, chunk_idx, frame, count(*) AS n FROM (SELECT DISTINCT user_id, chunk_idx, {FRAME.format(a='start_sec', b='end_sec')} AS frame FROM c, unnest(range(0, 8)) AS u(j)) GROUP BY ALL"
)
def frame_sample_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = D.sliding_chunks(durations(spark, sf_dir), WINDOW)
    at = D.frame_indices(F.col("start_sec"), F.col("end_sec"), F.lit(25.0), F.floor(F.col("duration_sec") * 25.0).cast("long"), 8)
    return c.select("user_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), F.explode(at).alias("frame"), F.lit(1).cast("long").alias("n"))


DECODED = "(user_id * 31 + frame * 7) % 5 <> 0"


def _window_images(spark: SparkSession, sf_dir: str, end, distinct: bool, least: int) -> DataFrame:
    """Windows, and as decoded frames those of four fifths of the numbers, each with a name in place of its image."""
    c = D.sliding_chunks(durations(spark, sf_dir), WINDOW)
    at = D.frame_indices(F.col("start_sec"), end, F.lit(25.0), F.floor(F.col("duration_sec") * 25.0).cast("long"), 8, distinct)
    c = c.withColumn("frame_idx", at)
    image = F.concat_ws("-", F.col("user_id").cast("string"), F.col("frame").cast("string"))
    decoded = D.wanted_frames(c, "user_id").where((F.col("user_id") * 31 + F.col("frame") * 7) % 5 != 0).withColumn("image", image)
    out = D.window_images(c, decoded, "user_id", least=least)
    return out.select("user_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), F.array_join("images", " ").alias("images"))


def _images_sql(start: str, end: str, distinct: bool, least: int) -> str:
    every = f"SELECT user_id, chunk_idx, j, {FRAME.format(a=start, b=end)} AS frame FROM c, unnest(range(0, 8)) AS u(j)"
    rows = f"SELECT user_id, chunk_idx, min(j) AS j, frame FROM ({every}) GROUP BY ALL" if distinct else every
    return f"""WITH {INFER}, f AS ({rows}) SELECT user_id, chunk_idx, string_agg(user_id || '-' || frame, ' ' ORDER BY j) AS images FROM f
    WHERE {DECODED} GROUP BY user_id, chunk_idx HAVING count(*) >= {least}"""


@query(_images_sql("start_sec", "end_sec", True, 1))
def window_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _window_images(spark, sf_dir, F.col("end_sec"), True, 1)


@query(_images_sql("start_sec", "(start_sec + 2.0)", False, 7))
def train_window_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _window_images(spark, sf_dir, F.col("start_sec") + 2.0, False, 7)


@query(f"WITH {INFER} SELECT DISTINCT user_id, {FRAME.format(a='start_sec', b='(start_sec + 2.0)')} AS frame FROM c, unnest(range(0, 8)) AS u(j)")
def train_wanted_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = D.sliding_chunks(durations(spark, sf_dir), WINDOW)
    at = D.frame_indices(F.col("start_sec"), F.col("start_sec") + 2.0, F.lit(25.0), F.floor(F.col("duration_sec") * 25.0).cast("long"), 8, distinct=False)
    return D.wanted_frames(c.withColumn("frame_idx", at), "user_id")


# ------------------------------------------------------------------ frame files
def frame_folder(spark: SparkSession, sf_dir: str) -> str:
    """The events as record files in the shared folder: a user is a video of 7 frames a second, an event's id its image."""
    folder = f"{shared_folder(spark)}/spanloom-frames-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events").where("user_id IS NOT NULL").select("user_id", "ts", "event_id")
    placed = G.numbered(e, "user_id", ["ts", "event_id"], "frame")
    frames.write_frames(placed.select(F.col("user_id").cast("string").alias("video_id"), "frame", F.col("event_id").cast("string").cast("binary").alias("image")), folder, 7.0)
    return folder


PLACED = "placed AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame FROM events)"


@query("SELECT user_id, 7.0::DOUBLE AS fps, count(*) AS frames, count(*) / 7.0::DOUBLE AS duration_sec FROM events WHERE user_id IS NOT NULL GROUP BY user_id")
def frames_probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.probe(spark, frame_folder(spark, sf_dir)).select(F.col("video_id").cast("long").alias("user_id"), "fps", "frames", "duration_sec")


@query(f"WITH {PLACED} SELECT user_id, frame, event_id FROM placed WHERE user_id IS NOT NULL AND frame BETWEEN 10 AND 29")
def frames_pushed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter on the frame, which goes to the cursor."""
    out = spark.read.format("frames").load(frame_folder(spark, sf_dir)).where("frame >= 10 AND frame < 30")
    return out.select(F.col("video_id").cast("long").alias("user_id"), "frame", F.col("image").cast("string").cast("long").alias("event_id"))


@query(
    f"""WITH {INFER}, {PLACED}, w AS (SELECT DISTINCT user_id, {FRAME.format(a='start_sec', b='end_sec').replace('floor(d * 25.0)', 'round(d * 7.0)').replace('25.0', '7.0')} AS frame FROM c, unnest(range(0, 8)) AS u(j))
    SELECT user_id, frame, event_id, frame - row_number() OVER (PARTITION BY user_id ORDER BY frame) + 1 AS grabbed FROM w JOIN placed USING (user_id, frame)"""
)
def frames_wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames that the windows want, each video's in one pass; grabbed: the frames stepped over until then."""
    folder = frame_folder(spark, sf_dir)
    videos = frames.probe(spark, folder).select("video_id", "frames", "duration_sec", "fps")
    c = D.sliding_chunks(videos, WINDOW)
    at = D.frame_indices(F.col("start_sec"), F.col("end_sec"), F.col("fps"), F.col("frames"), 8)
    out = frames.read_wanted(c.select("video_id", F.explode(at).alias("frame")), folder)
    return out.select(F.col("video_id").cast("long").alias("user_id"), "frame", F.col("image").cast("string").cast("long").alias("event_id"), "grabbed")


@query(
    """WITH i AS (SELECT p_partkey, p_size AS h, (p_partkey % 97 + 1)::INT AS w FROM part),
    t AS (SELECT *, h // 3 AS th, w // 3 AS tw, (h // 3 < 1 OR w // 3 < 1) AS small FROM i),
    g AS (SELECT t.*, r, c FROM t, unnest(range(0, 3)) AS a(r), unnest(range(0, 3)) AS b(c) WHERE NOT small OR (r = 0 AND c = 0))
    SELECT p_partkey, r, c, r * th AS y0, c * tw AS x0, CASE WHEN small OR r = 2 THEN h ELSE (r + 1) * th END AS y1,
           CASE WHEN small OR c = 2 THEN w ELSE (c + 1) * tw END AS x1 FROM g"""
)
def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("h"), (F.col("p_partkey") % 97 + 1).cast("int").alias("w"))
    return D.tile_grid(i, 3).select("p_partkey", *[F.col(c).cast("long").alias(c) for c in ("r", "c", "y0", "x0", "y1", "x1")])


# ------------------------------------------------------------------ distributions
LOGS = "l AS (SELECT vec_id, i AS ord, embedding[i]::DOUBLE AS x FROM embeddings, unnest(range(1, len(embedding) + 1)) AS u(i))"
SOFT = LOGS + ", s AS (SELECT vec_id, ord, exp(x - max(x) OVER w) / sum(exp(x - max_x)) OVER w AS p FROM (SELECT *, max(x) OVER (PARTITION BY vec_id) AS max_x FROM l) WINDOW w AS (PARTITION BY vec_id))"


def _logs():
    return F.transform("embedding", lambda x: x.cast("double"))


def _long(df: DataFrame) -> DataFrame:
    return df.select("vec_id", F.posexplode("d").alias("pos", "p")).select("vec_id", (F.col("pos") + 1).cast("long").alias("ord"), F.round("p", 9).alias("p"))


@query(f"WITH {SOFT} SELECT vec_id, ord, round(p, 9) AS p FROM s")
def class_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(table(spark, sf_dir, "embeddings").select("vec_id", softmax(_logs()).alias("d")))


@query(f"WITH {SOFT}, t AS (SELECT vec_id, ord, pow(greatest(p, 1e-12), 1.0 / 3.0) AS q FROM s) SELECT vec_id, ord, round(q / sum(q) OVER (PARTITION BY vec_id), 9) AS p FROM t")
def temperature_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(table(spark, sf_dir, "embeddings").select("vec_id", temperature(softmax(_logs()), S.temperature).alias("d")))


@query(
    """SELECT user_id, letter, max(lp) AS logprob FROM (
        SELECT user_id, upper(chr((97 + k % 16)::INT)) AS letter, -value / 100 AS lp FROM (
            SELECT user_id, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))
    WHERE letter BETWEEN 'A' AND 'L' GROUP BY ALL"""
)
def letter_max_logprob(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    token = F.concat(F.lit(" \t"), F.char(97 + k % 16), F.lit("x\n"))
    e = table(spark, sf_dir, "events").select("user_id", token_letter(token).alias("letter"), (-F.col("value") / 100).alias("lp"))
    return e.where("letter IS NOT NULL").groupBy("user_id", "letter").agg(F.max("lp").alias("logprob"))


@query(
    """WITH n AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY ALL),
    p AS (SELECT user_id, event_type, c / sum(c) OVER (PARTITION BY user_id) AS p FROM n)
    SELECT user_id, event_type AS class_name, row_number() OVER w AS place, round(p, 4) AS p FROM p WINDOW w AS (PARTITION BY user_id ORDER BY p DESC, event_type) QUALIFY row_number() OVER w <= 3"""
)
def top_class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "events").groupBy("user_id").agg(*[F.sum((F.col("event_type") == t).cast("long")).alias(t) for t in TYPES], F.count("*").alias("n"))
    entries = F.filter(F.array(*[F.struct((F.col(t) / F.col("n")).alias("p"), F.lit(i).alias("ord"), F.lit(t).alias("class_name")) for i, t in enumerate(TYPES)]), lambda x: x["p"] > 0)
    out = n.select("user_id", F.posexplode(top_classes(entries, 3)).alias("pos", "e"))
    return out.select("user_id", "e.class_name", (F.col("pos") + 1).cast("long").alias("place"), F.round("e.p", 4).alias("p"))


# ------------------------------------------------------------------ verification
CANDIDATES = "cand AS (SELECT user_id, chunk_idx, p FROM sig WHERE (p > 0.2 AND p < 0.8) OR chunk_idx % 6 = 0)"


@query(f"WITH {SMOOTH}, {CANDIDATES} SELECT user_id, chunk_idx FROM cand")
def verify_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).where(D.wants_verify(F.col("p_anom"), F.col("chunk_idx"), S)).select("user_id", F.col("chunk_idx").cast("long").alias("chunk_idx"))


@query(
    f"""WITH {SMOOTH}, {CANDIDATES}, b AS (SELECT user_id, chunk_idx, coalesce(sum(4) OVER (PARTITION BY user_id ORDER BY chunk_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spent FROM cand)
    SELECT * FROM b WHERE spent < 60"""
)
def verify_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir).where(D.wants_verify(F.col("p_anom"), F.col("chunk_idx"), S))
    out = D.verify_budget(c, "user_id", "chunk_idx", F.lit(S.verify_grid**2), S.verify_max_calls)
    return out.select("user_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), "spent")


@query(
    """WITH t AS (SELECT vec_id // 4 AS chunk, (vec_id % 4)::BIGINT AS tile, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) * 4 AS tile_anom, list_min(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS full_anom FROM embeddings),
    f AS (SELECT chunk, max(CASE WHEN tile = 0 THEN full_anom END) AS full_anom FROM t GROUP BY chunk),
    b AS (SELECT chunk, tile, tile_anom FROM t QUALIFY row_number() OVER (PARTITION BY chunk ORDER BY tile_anom DESC, tile) = 1)
    SELECT chunk, tile, tile_anom, coalesce(tile_anom > full_anom AND tile_anom >= 0.9, false) AS overrides FROM b JOIN f USING (chunk)"""
)
def tile_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    size = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    t = e.select(F.floor(F.col("vec_id") / 4).alias("chunk"), (F.col("vec_id") % 4).alias("tile"), (F.array_max(size) * 4).alias("p_anom"), F.array_min(size).alias("full"))
    full = t.groupBy("chunk").agg(F.max(F.when(F.col("tile") == 0, F.col("full"))).alias("full_anom"))
    out = D.best_tile(t, ["chunk"]).join(full, "chunk")
    return out.select("chunk", "tile", "tile_anom", D.tile_override(F.col("full_anom") * 1.0, F.col("tile_anom"), S.verify_tile_min_conf).alias("overrides"))


SOFTENED = """s AS (SELECT {key}, letter, exp(lp - max(lp) OVER (PARTITION BY {key})) AS e FROM f),
    p AS (SELECT {key}, letter, pow(greatest(e / sum(e) OVER (PARTITION BY {key}), 1e-12), 1.0 / 3.0) AS q FROM s),
    n AS (SELECT {key}, letter, q / sum(q) OVER (PARTITION BY {key}) AS p FROM p)"""


@query(
    f"""WITH l AS (SELECT user_id, upper(chr((97 + k % 16)::INT)) AS letter, max(-value / 100) AS lp FROM (
            SELECT user_id, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY ALL),
    f AS (SELECT * FROM l WHERE letter <= 'L' AND user_id % 7 <> 3),
    {SOFTENED.format(key='user_id')}
    SELECT user_id, CASE WHEN user_id % 7 = 3 THEN 0 ELSE round(1 - coalesce(sum(CASE WHEN letter = 'A' THEN p END), 0), 9) END AS p_anom, round(max(CASE WHEN letter = 'F' THEN p END), 9) AS p_fire
    FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN n USING (user_id) GROUP BY user_id"""
)
def reply_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's JSON reply for each user, from tokens to the softened distribution; the replies of one user in seven hold
    no letter of a class."""
    k = F.get_json_object("props", "$.k").cast("long")
    best = table(spark, sf_dir, "events").groupBy("user_id", (k % 16).alias("k")).agg(F.max(-F.col("value") / 100).alias("logprob"))
    letter = F.when(F.col("user_id") % 7 == 3, F.concat(F.lit("?"), F.char(97 + F.col("k")))).otherwise(F.concat(F.lit(" "), F.char(97 + F.col("k"))))
    own = best.groupBy("user_id").agg(F.collect_list(F.struct(letter.alias("token"), "logprob")).alias("top_logprobs"))  # a row for each letter at most
    content = F.struct(F.array(F.struct("top_logprobs")).alias("content"))
    reply = F.to_json(F.struct(F.array(F.struct(content.alias("logprobs"))).alias("choices")))
    out = own.select("user_id", class_distribution(letter_logs(reply_tokens(reply)), S.temperature).alias("p"))
    return out.select("user_id", F.round(p_anomaly(F.col("p")[0]), 9).alias("p_anom"), F.round(F.col("p")[5], 9).alias("p_fire"))


def _reply(images: list[bytes]) -> str | None:
    """The stand-in of a model: logprobs of the first letters of an image's words; it fails on every seventh length."""
    import json

    if len(images[0]) % 7 == 0:
        raise RuntimeError("no answer")
    tokens = [{"token": w[:1].decode(errors="replace"), "logprob": -len(w) / 8} for w in images[0].split(b" ") if w]
    return json.dumps({"choices": [{"logprobs": {"content": [{"top_logprobs": tokens}]}}]})


@query(
    f"""WITH d AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations),
    w AS (SELECT conv_id, turn, text, unnest(string_split(text, ' ')) AS word FROM d),
    f AS (SELECT conv_id, turn, upper(word[1]) AS letter, max(-octet_length(encode(word)) / 8.0::DOUBLE) AS lp FROM w WHERE octet_length(encode(text)) % 7 <> 0 AND upper(word[1]) BETWEEN 'A' AND 'L' AND word[1] <> '' AND length(word[1]) = 1 AND ascii(word[1]) < 128 GROUP BY ALL),
    {SOFTENED.format(key='conv_id, turn')},
    a AS (SELECT conv_id, turn, 1 - coalesce(sum(CASE WHEN letter = 'A' THEN p END), 0) AS p_anom FROM n GROUP BY ALL)
    SELECT d.conv_id, d.turn, octet_length(encode(text)) % 7 = 0 AS scorer_failed, round(coalesce(a.p_anom, 0), 9) AS p_anom FROM d LEFT JOIN a USING (conv_id, turn)"""
)
def scored_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An outside scorer over all turns, its failures and replies without a letter read as normal."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array(F.encode(F.coalesce("text", F.lit("")), "utf-8")).alias("images"))
    out = score_chunks(c, _reply, pause=0.0)
    p = class_distribution(letter_logs(reply_tokens(F.col("reply"))), S.temperature)
    return out.select("conv_id", "turn", "scorer_failed", F.round(p_anomaly(p[0]), 9).alias("p_anom"))


@query(f"""SELECT conv_id, turn, {list(CLASSES)}[ascii(nullif(regexp_extract(upper(text), '[A-L]', 0), '')) - 64] AS class_name FROM conversations""")
def taught_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class that a teacher's answer names by its letter."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", letter_class(teacher_letter(F.col("text"))).alias("class_name"))


@query(f"WITH {INFER} SELECT user_id, count(*) AS chunks, count(*) * 8 AS frames_used FROM c GROUP BY user_id")
def frames_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images over all chunks, overlaps counted each time."""
    c = D.sliding_chunks(durations(spark, sf_dir), WINDOW)
    at = D.frame_indices(F.col("start_sec"), F.col("end_sec"), F.lit(25.0), F.floor(F.col("duration_sec") * 25.0).cast("long"), 8, distinct=False)
    return c.groupBy("user_id").agg(F.count("*").alias("chunks"), F.sum(F.size(at)).alias("frames_used"))
