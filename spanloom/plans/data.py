"""Queries of sampling, labels, validation, manifests, sheets and training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import sources as S
from ..functions import class_of_path, clock, decoded_image, encoded_image, file_stem, fitted_side, fourcc, media_kind
from ..operators import matching as M
from ..operators import quality as Q
from ..operators import sampling as B
from ..sources import teacher
from ..sources.sheets import raw_violations
from . import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------------ sampling
@query(
    """WITH t AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS turn FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY turn, source) AS k FROM t) SELECT doc_id, lang, source FROM r WHERE k <= 50 OR lang = 'fr'"""
)
def round_robin_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return B.round_robin(d, "lang", "source", ["doc_id"], 50, uncapped="fr")


@query("SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY doc_id DESC) <= 3")
def class_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.cap_per_group(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), ["source", "lang"], 3, [F.desc("doc_id")])


@query(
    """WITH n AS (SELECT source, count(*) AS found, least(count(*), 100) AS used FROM documents GROUP BY source), d AS (SELECT *, 300.0::DOUBLE / greatest(used, 1) AS need FROM n)
    SELECT source, found, used, CASE WHEN source = 'src0' THEN 2.0 WHEN need > 6 THEN 0.5 WHEN need > 3 THEN 1.0 ELSE 2.0 END::DOUBLE AS stride,
    CASE WHEN source = 'src0' THEN 12 ELSE greatest(1, least(12, floor(need * 2)::INT)) END AS per_video FROM d"""
)
def stride_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.stride_plan(table(spark, sf_dir, "documents").select("source"), "source", 300, 12, 100, normal="src0")


PLAN = """n AS (SELECT lang, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY lang),
t AS (SELECT *, (SELECT sum(n) FROM n WHERE lang = '{normal}') AS nn, (SELECT sum(n) FROM n WHERE lang <> '{normal}') AS oo FROM n),
w AS (SELECT lang, n, nn, oo, floor(oo * 0.45::DOUBLE / 0.55::DOUBLE)::BIGINT AS wanted, floor(nn * 0.55::DOUBLE / 0.45::DOUBLE)::BIGINT AS most FROM t),
plan AS (SELECT lang, n, CASE WHEN lang = '{normal}' THEN least(n, wanted) WHEN nn < wanted AND most > 0 AND most < oo
         THEN least(greatest(1, round_even(n * (most::DOUBLE / oo), 0)::BIGINT), n) ELSE n END AS keep FROM w)"""


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id")


@query(f"WITH {PLAN.format(normal='en')} SELECT lang, n, keep::BIGINT AS keep FROM plan")
def balance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.balance_plan(_labelled(spark, sf_dir), "lang", 0.45, normal="en")


@query(f"WITH {PLAN.format(normal='es')} SELECT lang, n, keep::BIGINT AS keep FROM plan")
def balance_counts_scarce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.balance_plan(_labelled(spark, sf_dir), "lang", 0.45, normal="es")


@query(
    f"""WITH {PLAN.format(normal='es')}, r AS (SELECT d.doc_id, d.lang, row_number() OVER (PARTITION BY d.lang ORDER BY d.doc_id) AS k FROM documents d JOIN labels l USING (doc_id))
    SELECT doc_id, lang FROM r JOIN plan USING (lang) WHERE k <= keep"""
)
def balanced_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.balance(_labelled(spark, sf_dir), "lang", 0.45, ["doc_id"], normal="es").select("doc_id", "lang")


@query("SELECT doc_id, quality AS label FROM labels WHERE quality = toxic")
def label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.agreed(table(spark, sf_dir, "labels"), "quality", "toxic").select("doc_id", "label")


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source")
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ paths and media
PATH = "'/data/' || ['fire', 'Riot', 'Unknown', 'smoke', 'Arson'][page_id % 5 + 1] || CASE WHEN page_id % 3 = 0 THEN '/Videos' WHEN page_id % 3 = 1 THEN '/videos' ELSE '' END || '/clip ' || page_id || '-a.MP4'"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = F.element_at(F.array(*map(F.lit, ["fire", "Riot", "Unknown", "smoke", "Arson"])), (F.col("page_id") % 5 + 1).cast("int"))
    mid = F.when(F.col("page_id") % 3 == 0, "/Videos").when(F.col("page_id") % 3 == 1, "/videos").otherwise("")
    return table(spark, sf_dir, "pages").select("page_id", "url", F.concat(F.lit("/data/"), folder, mid, F.lit("/clip "), F.col("page_id").cast("string"), F.lit("-a.MP4")).alias("path"))


@query(
    f"""SELECT page_id, CASE ['fire', 'Riot', 'Unknown', 'smoke', 'Arson'][page_id % 5 + 1] WHEN 'fire' THEN 'fire' WHEN 'Riot' THEN 'fighting_or_violence' WHEN 'smoke' THEN 'smoke' WHEN 'Arson' THEN 'fire' END AS class_name,
    'clip_' || page_id || '_a' AS stem FROM (SELECT page_id, {PATH} AS path FROM pages) WHERE page_id % 5 <> 2"""
)
def resolve_class_from_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("page_id", class_of_path(F.col("path")).alias("class_name"), file_stem(F.col("path")).alias("stem")).where("class_name IS NOT NULL")


@query(
    """SELECT page_id, regexp_replace(regexp_replace(string_split(url, '/')[-1], '(.)\\.[^.]*$', '\\1'), '[^\\w]+', '_', 'g') AS stem,
    CASE WHEN lower(regexp_extract(url, '\\.([^.]+)$', 1)) IN ('jpg', 'jpeg', 'png', 'bmp', 'webp') THEN 'image' ELSE 'video' END AS kind FROM pages"""
)
def url_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", file_stem(F.col("url")).alias("stem"), media_kind(F.col("url")).alias("kind"))


@query(
    """WITH i AS (SELECT p_partkey, p_size * 37 AS h, (p_partkey % 97 + 1) * 29 AS w FROM part), s AS (SELECT *, 448.0::DOUBLE / greatest(h, w) AS s FROM i)
    SELECT p_partkey, CASE WHEN s < 1 THEN greatest(floor(floor(h * s) / 28) * 28, 28) ELSE h END::BIGINT AS fit_h, CASE WHEN s < 1 THEN greatest(floor(floor(w * s) / 28) * 28, 28) ELSE w END::BIGINT AS fit_w FROM s"""
)
def image_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, w = F.col("p_size") * 37, (F.col("p_partkey") % 97 + 1) * 29
    return table(spark, sf_dir, "part").select("p_partkey", fitted_side(h, h, w, 448).cast("long").alias("fit_h"), fitted_side(w, h, w, 448).cast("long").alias("fit_w"))


@query("SELECT event_id, (floor(value)::BIGINT // 60)::VARCHAR || ':' || lpad((floor(value)::BIGINT % 60)::VARCHAR, 2, '0') AS clock FROM events")
def event_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", clock(F.col("value")).alias("clock"))


@query(
    """SELECT p_partkey, CASE WHEN coalesce(f, 0) = 0 THEN 25.0 ELSE f END::DOUBLE AS fps, coalesce(n, 0)::BIGINT AS frames, round(coalesce(n, 0) / CASE WHEN coalesce(f, 0) = 0 THEN 25.0 ELSE f END::DOUBLE, 9) AS dur
    FROM (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 0.0 WHEN p_size % 4 = 1 THEN NULL ELSE p_size::DOUBLE END AS f, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_partkey END AS n FROM part)"""
)
def probe_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.when(F.col("p_size") % 4 == 0, 0.0).when(F.col("p_size") % 4 == 1, None).otherwise(F.col("p_size").cast("double"))
    n = F.when(F.col("p_size") % 5 == 0, None).otherwise(F.col("p_partkey"))
    fps, frames, dur = S.probe_defaults(f, n)
    return table(spark, sf_dir, "part").select("p_partkey", fps.alias("fps"), frames.alias("frames"), F.round(dur, 9).alias("dur"))


# ------------------------------------------------------------------ binary values
@query(
    """WITH b AS (SELECT event_id, 9 + event_id % 247 AS b0, 9 + (event_id * 7) % 247 AS b1, 9 + (event_id * 31) % 247 AS b2, 9 + (event_id * 101) % 247 AS b3 FROM events)
    SELECT event_id, regexp_replace(chr(b0::INTEGER) || chr(b1::INTEGER) || chr(b2::INTEGER) || chr(b3::INTEGER),
                                    '^[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}]+|[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}]+$', '', 'g') AS codec FROM b"""
)
def codec_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events stand in for probed videos: four bytes made from the event's number are its codec."""
    code = sum((9 + (F.col("event_id") * m) % 247) * 256**i for i, m in enumerate((1, 7, 31, 101)))
    return table(spark, sf_dir, "events").select("event_id", fourcc(code).alias("codec"))


@query(
    """SELECT page_id, nullif(base64(encode(coalesce(html, ''))), '') AS image, octet_length(encode(html))::BIGINT AS n_bytes, md5(html) AS decoded_md5 FROM pages"""
)
def images_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages stand in for image files: written as base64 for a request, and read back from a data URL."""
    p = table(spark, sf_dir, "pages").select("page_id", encoded_image(F.encode("html", "utf-8")).alias("image"))
    back = decoded_image(F.concat(F.lit("data:image/jpeg;base64,"), "image"))
    return p.select("page_id", "image", F.octet_length(back).cast("long").alias("n_bytes"), F.md5(back).alias("decoded_md5"))


# ------------------------------------------------------------------ manifests, sheets
#: Most entries of one document: longer manifests and sheets are written in parts.
PART = 1000


def _parts(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows with ``first``: the position, from 0 within the key, of the first row of their part."""
    at = F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long") - 1
    return rows.withColumn("first", at - at % PART)


@query(
    """WITH v AS (SELECT 'V' || (o_orderkey % 1000) AS video_id, CASE WHEN o_orderkey % 4 = 3 THEN 1 ELSE (o_orderkey % 4 + 1)::INT END AS level,
        CASE WHEN o_orderkey % 3 = 0 THEN 'a' || o_orderkey || '.avi' WHEN o_orderkey % 3 = 1 THEN 'b' || o_orderkey || '.mkv' ELSE 'V' || (o_orderkey % 1000) || '.mp4' END AS filename, o_totalprice AS duration_sec, o_orderkey, o_custkey FROM orders)
    SELECT o_custkey, video_id, level, filename, duration_sec FROM v WHERE level IN (1, 3) QUALIFY row_number() OVER (PARTITION BY o_custkey, video_id ORDER BY o_orderkey DESC) = 1"""
)
def manifest_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests of at most PART orders of a customer, half of the customers' bare lists; parsed in columns."""
    o = _parts(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderkey"])
    vid = F.concat(F.lit("V"), (F.col("o_orderkey") % 1000).cast("string"))
    k = F.col("o_orderkey")
    entry = F.struct(
        k.alias("k"),
        vid.alias("video_id"),
        F.when(k % 4 != 3, (k % 4 + 1).cast("int")).alias("level"),
        F.when(k % 3 == 0, F.concat(F.lit("a"), k.cast("string"), F.lit(".avi"))).alias("filename"),
        F.when(k % 3 != 2, F.concat(F.lit("b"), k.cast("string"), F.lit(".mkv"))).alias("file"),
        F.col("o_totalprice").alias("duration_sec"),
    )
    lists = o.groupBy("o_custkey", "first").agg(F.sort_array(F.collect_list(entry)).alias("videos"))
    texts = lists.select("o_custkey", "first", F.when(F.col("o_custkey") % 2 == 0, F.to_json("videos")).otherwise(F.to_json(F.struct("videos"))).alias("value"))
    out = S.parse_manifest(texts, keys=("o_custkey",), first="first").drop("domain")
    return S.select_videos(out, [1, 3])


@query(
    """SELECT user_id::VARCHAR AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pred_ord, event_type AS class_name,
    CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS start_sec FROM events"""
)
def answer_sheet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to JSON and back, a document for at most PART events of a user; null times survive."""
    e = _parts(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"])
    one = F.struct("ts", "event_id", F.col("event_type").alias("class_name"), F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("start_time_sec"), F.lit(None).cast("double").alias("end_time_sec"), F.lit(None).cast("string").alias("explanation"))
    lists = e.groupBy(F.col("user_id").cast("string").alias("video_id"), "first").agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: F.struct(x["class_name"].alias("class_name"), x["start_time_sec"].alias("start_time_sec"), x["end_time_sec"].alias("end_time_sec"), x["explanation"].alias("explanation"))).alias("events"))
    sheet = F.to_json(F.struct(F.array(F.struct("video_id", "events")).alias("predictions")), {"ignoreNullFields": "false"})
    back = S.sheet_events(S.parse_sheet(lists.select("first", sheet.alias("value")), first="first"), first="first")
    return back.select("video_id", F.col("pred_ord").cast("long").alias("pred_ord"), "class_name", "start_sec")


@query("SELECT user_id, day, n FROM (SELECT user_id, ts::DATE::VARCHAR AS day, count(*) AS n FROM events GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY day DESC) = 1")
def answer_sheet_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").groupBy("user_id", F.col("ts").cast("date").cast("string").alias("day")).agg(F.count("*").alias("n"))
    return Q.overlay(log, "user_id", "day")


RULES = """WITH e AS (SELECT user_id AS video_id, CASE WHEN event_id % 11 = 0 THEN 'normal' WHEN event_id % 13 = 0 THEN 'odd' ELSE event_type END AS class_name,
        CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 17 = 0 THEN -1.0 ELSE value END AS start_sec, CASE WHEN event_id % 19 = 0 THEN NULL ELSE 50.0 END AS end_sec, CASE WHEN event_id % 3 = 0 THEN props END AS explanation,
        CASE WHEN user_id % 10 <> 9 THEN user_id % 3 + 1 END AS level FROM events),
    r AS (SELECT video_id, unnest([CASE WHEN class_name = 'normal' THEN 'normal_class' END, CASE WHEN class_name = 'odd' THEN 'bad_class' END,
        CASE WHEN level = 1 AND (start_sec IS NOT NULL OR end_sec IS NOT NULL) THEN 'level1_times' END, CASE WHEN coalesce(level, 0) <> 1 AND (start_sec IS NULL OR start_sec < 0) THEN 'bad_start' END,
        CASE WHEN coalesce(level, 0) <> 1 AND start_sec >= 0 AND (end_sec IS NULL OR end_sec <= start_sec) THEN 'bad_end' END,
        CASE WHEN explanation IS NOT NULL AND length(explanation) NOT BETWEEN 20 AND 500 THEN 'explanation_length' END]) AS rule FROM e),
    a AS (SELECT video_id, rule FROM r WHERE rule IS NOT NULL UNION ALL SELECT DISTINCT user_id, 'unknown_video' FROM events WHERE user_id % 10 = 9
        UNION ALL SELECT DISTINCT user_id, 'unknown_video' FROM events WHERE user_id % 10 = 9 AND user_id % 4 = 1 UNION ALL SELECT DISTINCT user_id, 'duplicate' FROM events WHERE user_id % 4 = 1
        UNION ALL SELECT user_id, 'average_mismatch' FROM events GROUP BY user_id HAVING user_id % 6 = 0)"""


@query(f"{RULES} SELECT video_id, rule, count(*) AS n FROM a GROUP BY ALL")
def validate_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _violations(spark, sf_dir).groupBy("video_id", "rule").agg(F.count("*").alias("n"))


@query(f"{RULES}, c AS (SELECT video_id, rule FROM a ORDER BY video_id, rule LIMIT 40) SELECT video_id, rule, count(*) AS n FROM c GROUP BY ALL")
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report lists the first forty breaches."""
    return Q.first_violations(_violations(spark, sf_dir)).groupBy("video_id", "rule").agg(F.count("*").alias("n"))


RULE_CLASSES = ("normal", "click", "error", "purchase", "signup", "view")


def _answers(events: DataFrame) -> DataFrame:
    """Events (with a video_id) as answers of which some break rules."""
    i = F.col("event_id")
    return events.select(
        "video_id",
        F.when(i % 11 == 0, "normal").when(i % 13 == 0, "odd").otherwise(F.col("event_type")).alias("class_name"),
        F.when(i % 7 == 0, None).when(i % 17 == 0, -1.0).otherwise(F.col("value")).alias("start_sec"),
        F.when(i % 19 != 0, 50.0).alias("end_sec"),
        F.when(i % 3 == 0, F.col("props")).alias("explanation"),
    )


def _violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events")
    u = F.col("user_id")
    events = _answers(t.withColumn("video_id", u))
    users = t.select(u.alias("video_id")).distinct()
    answers = users.unionByName(users.where("video_id % 4 = 1"))
    manifest = users.where("video_id % 10 != 9").select("video_id", (F.col("video_id") % 3 + 1).cast("int").alias("level"))
    times = t.groupBy(u.alias("video_id")).agg(F.sum("value").alias("total_time_ms"), F.count("*").alias("call_count"))
    times = times.withColumn("average_time_ms", F.col("total_time_ms") / F.col("call_count") * F.when(F.col("video_id") % 6 == 0, 1.5).otherwise(1.0))
    return Q.violations(events, answers, manifest, times, RULE_CLASSES)


@query(
    """SELECT conv_id, turn, '{"messages":[{"role":"user","content":"' || repeat('<image>', (turn % 4 + 1)::INT) || '\\nWhat is shown?"},{"role":"assistant","content":"' || chr((65 + turn % 12)::INT) || '"}],"images":['
    || list_aggregate(list_transform(range(0, turn % 4 + 1), lambda j: '"c' || conv_id || '_' || j || '.jpg"'), 'string_agg', ',') || ']}' AS value FROM conversations"""
)
def chat_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    images = F.transform(F.sequence(F.lit(0).cast("long"), F.col("turn") % 4), lambda j: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("_"), j.cast("string"), F.lit(".jpg")))
    samples = c.select("conv_id", "turn", F.char(65 + F.col("turn") % 12).alias("letter"), images.alias("images"))
    return S.chat_rows(samples, "What is shown?", keys=("conv_id", "turn"))


@query("SELECT conv_id, turn, nullif(regexp_extract(upper(text), '[A-L]', 0), '') AS letter FROM conversations")
def teacher_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", S.teacher_letter(F.col("text")).alias("letter"))


# ------------------------------------------------------------------ truths
LINES = """(SELECT user_id::VARCHAR AS video_id, event_id, event_type, CASE WHEN event_id % 3 = 0 THEN ' TRUE ' WHEN event_id % 3 = 1 THEN 'true' ELSE 'no' END AS flag,
    CASE WHEN event_id % 5 <> 0 THEN event_id / 4.0::DOUBLE END AS start_time_sec, event_id / 4.0::DOUBLE + 3 AS end_time_sec FROM events)"""


def _truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truths from the lines of a file with one for each event."""
    i = F.col("event_id")
    flag = F.when(i % 3 == 0, " TRUE ").when(i % 3 == 1, "true").otherwise("no")
    start = F.when(i % 5 != 0, (i / 4.0).cast("string")).otherwise("")
    lines = table(spark, sf_dir, "events").select("event_id", F.concat_ws(",", F.col("user_id").cast("string"), F.lit("2"), flag, F.col("event_type"), start, (i / 4.0 + 3).cast("string")).alias("value"))
    return S.parse_truths(lines, "event_id")


@query(
    f"""SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY event_id) - 1 AS gt_ord, trim(lower(flag)) = 'true' AS is_anomaly, event_type AS class_name, start_time_sec, end_time_sec FROM {LINES}"""
)
def truth_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _truths(spark, sf_dir)
    return t.select("video_id", F.col("gt_ord").cast("long").alias("gt_ord"), "is_anomaly", "class_name", "start_time_sec", "end_time_sec")


@query(f"""SELECT c_custkey, video_id, start_time_sec, end_time_sec FROM customer JOIN {LINES} ON video_id = (c_custkey % 400)::VARCHAR WHERE trim(lower(flag)) = 'true' AND start_time_sec IS NOT NULL""")
def truths_of_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads by customers, matched with the truths by their names' stems."""
    name = F.concat(F.lit("in/"), (F.col("c_custkey") % 400).cast("string"), F.lit(".Mp4"))
    return S.timed_truths_of(_truths(spark, sf_dir), table(spark, sf_dir, "customer").select("c_custkey", name.alias("filename"))).select("c_custkey", "video_id", "start_time_sec", "end_time_sec")


@query(
    """SELECT o_orderkey::VARCHAR AS video_id, (o_orderkey % 3 + 1)::INT AS level FROM orders WHERE o_orderkey % 3 <> 1
    AND o_custkey % 500 IN (SELECT c_custkey FROM customer) AND o_orderpriority IN ('1-URGENT', '5-LOW')"""
)
def videos_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos of two levels whose file is in a listing."""
    o = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "5-LOW"))
    v = o.select(F.col("o_orderkey").cast("string").alias("video_id"), (F.col("o_orderkey") % 3 + 1).cast("int").alias("level"), F.concat((F.col("o_custkey") % 500).cast("string"), F.lit(".mp4")).alias("filename"))
    files = table(spark, sf_dir, "customer").select(F.concat(F.col("c_custkey").cast("string"), F.lit(".mp4")).alias("filename"))
    return S.select_videos(v, [1, 3], files=files).select("video_id", "level")


@query("SELECT o_orderkey::VARCHAR AS video_id FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey::VARCHAR IN ('1', '2', '3', '6', '33', '34', '96', '99', '100')")
def videos_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos of a level that are named."""
    v = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("video_id"), (F.col("o_orderkey") % 3 + 1).cast("int").alias("level"))
    return S.select_videos(v, [1], only=["1", "2", "3", "6", "33", "34", "96", "99", "100"]).select("video_id")


@query(f"{RULES} SELECT DISTINCT user_id AS video_id FROM events WHERE user_id NOT IN (SELECT video_id FROM a)")
def sheet_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's answers as a sheet of their own: only those without a breach are written."""
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id")).distinct()
    return Q.passing(users, _violations(spark, sf_dir), "video_id")


@query(
    """WITH one AS (SELECT event_id,
        CASE WHEN event_id % 11 = 0 THEN 'normal' WHEN event_id % 13 = 0 THEN 'odd' ELSE event_type END AS class_name,
        CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 17 = 0 THEN -1.0 ELSE value END AS start_sec, CASE WHEN event_id % 19 = 0 THEN NULL ELSE 50.0 END AS end_sec,
        CASE WHEN event_id % 3 = 0 THEN props END AS explanation, user_id % 3 + 1 AS level FROM events)
    SELECT event_id AS video_id FROM one WHERE class_name NOT IN ('normal', 'odd') AND NOT (level = 1 AND (start_sec IS NOT NULL OR end_sec IS NOT NULL))
    AND NOT (level <> 1 AND (start_sec IS NULL OR start_sec < 0)) AND NOT (level <> 1 AND start_sec >= 0 AND (end_sec IS NULL OR end_sec <= start_sec))
    AND (explanation IS NULL OR length(explanation) BETWEEN 20 AND 500)"""
)
def sheet_gate_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a sheet of its own: those without a breach are written."""
    e = table(spark, sf_dir, "events").withColumn("video_id", F.col("event_id"))
    found = Q.violations(_answers(e), e.select("video_id"), e.select("video_id", (F.col("user_id") % 3 + 1).cast("int").alias("level")), None, RULE_CLASSES)
    return Q.passing(e.select("video_id"), found, "video_id")


#: Raw sheets made of orders: what is left out, null or miscounted goes by the key.
RAW = """concat('{"note": 1', CASE WHEN o_orderkey % 17 = 0 THEN '' WHEN o_orderkey % 17 = 1 THEN ', "predictions": null' WHEN o_orderkey % 17 = 2 THEN ', "predictions": {}' ELSE concat(', "predictions": [{"x": 0',
    CASE o_orderkey % 3 WHEN 0 THEN concat(', "video_id": "', CAST(o_custkey AS STRING), '"') WHEN 1 THEN ', "video_id": null' ELSE '' END, CASE o_orderkey % 5 WHEN 0 THEN ', "events": null' WHEN 1 THEN '' ELSE ', "events": []' END,
    CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN ', "runtime_metadata": null' ELSE concat(', "runtime_metadata": {"model_runtimes": [{"model_name": "m", "call_count": ', CAST(o_orderkey % 4 AS STRING), ', "call_times_ms": [1.5, 2]}, {"model_name": "n", "call_count": 9}]}') END, '}]') END,
    CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE '}' END)"""


@query(
    f"""WITH s AS (SELECT o_orderkey, {RAW.replace('STRING', 'VARCHAR')} AS value FROM orders),
    t AS (SELECT *, octet_length(encode(value)) > 150 AS large, o_orderkey % 17 AS m FROM s),
    a AS (SELECT o_orderkey FROM t WHERE NOT large AND o_orderkey % 13 <> 0 AND m > 2)
    SELECT o_orderkey, NULL::INT AS answer, CASE WHEN large THEN 'too_large' WHEN o_orderkey % 13 = 0 THEN 'not_json' WHEN m = 0 THEN 'predictions_missing' WHEN m = 1 THEN 'predictions_null' ELSE 'predictions_type' END AS rule, NULL AS detail
    FROM t WHERE large OR o_orderkey % 13 = 0 OR m <= 2
    UNION ALL SELECT o_orderkey, 0, CASE o_orderkey % 3 WHEN 1 THEN 'video_id_null' ELSE 'video_id_missing' END, NULL FROM a WHERE o_orderkey % 3 <> 0
    UNION ALL SELECT o_orderkey, 0, CASE o_orderkey % 5 WHEN 0 THEN 'events_null' ELSE 'events_missing' END, NULL FROM a WHERE o_orderkey % 5 < 2
    UNION ALL SELECT o_orderkey, 0, CASE o_orderkey % 7 WHEN 1 THEN 'runtime_metadata_null' ELSE 'runtime_metadata_missing' END, NULL FROM a WHERE o_orderkey % 7 < 2
    UNION ALL SELECT o_orderkey, 0, 'call_times_count', 'm' FROM a WHERE o_orderkey % 7 >= 2 AND o_orderkey % 4 <> 2"""
)
def raw_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw JSON sheets of at most 150 bytes: absent and null keys, wrong types, miscounted call times."""
    return raw_violations(table(spark, sf_dir, "orders").select("o_orderkey", F.expr(RAW).alias("value")), "o_orderkey", limit=150)


@query("SELECT conv_id, turn, chr((65 + length(text) % 12)::INT) AS letter FROM conversations WHERE length(text) > 0 AND length(role) > 0 AND length(text) % 12 = length(role) % 12")
def taught_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that a stand-in model, held by each worker, gives one letter whichever image comes first."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array("text", "role").alias("images"))
    asked = teacher.ask_twice(c, "letters", lambda: "ABCDEFGHIJKL", lambda model, images: model[len(images[0]) % 12] if images[0] else None)
    return teacher.taught(asked).drop("images")


SHUFFLE = "('0x' || substr(md5('{seed}:' || {key}), 1, 15))::BIGINT"


@query(f"SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY {SHUFFLE.format(seed=7, key='doc_id')}, doc_id) <= 3")
def class_cap_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A random cap for each group, by a seed."""
    return B.cap_per_group(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), ["source", "lang"], 3, [B.shuffled(7, "doc_id"), "doc_id"])


TRAIN = """(SELECT conv_id * 1000 + turn AS id, nullif(regexp_extract(upper(text), '[A-L]', 0), '') AS letter, 'taught' AS source FROM conversations
    UNION ALL SELECT doc_id, chr((65 + doc_id % 12)::INT), source FROM documents)"""


@query(f"SELECT id, letter, source, {SHUFFLE.format(seed=11, key='id || chr(58) || source')} AS place FROM {TRAIN} WHERE letter IS NOT NULL")
def training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled and taught rows in one bag, in a random order by a seed."""
    taught = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), S.teacher_letter(F.col("text")).alias("letter"), F.lit("taught").alias("source"))
    labelled = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.char(65 + F.col("doc_id") % 12).alias("letter"), "source")
    return B.training_rows(labelled, taught).withColumn("place", B.shuffled(11, "id", "source")).orderBy("place", "id")


# ------------------------------------------------------------------ joins
@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer")
def left_with_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return M.left_default(table(spark, sf_dir, "customer").select("c_custkey"), n, ["c_custkey"], {"n": 0})


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def semi_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return M.existing(table(spark, sf_dir, "customer").select("c_custkey"), o, ["c_custkey"])


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return M.missing(table(spark, sf_dir, "customer").select("c_custkey"), o, ["c_custkey"])


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def lookup_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimension tables are broadcast by their size, which Spark checks against its threshold."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    out = c.join(table(spark, sf_dir, "nation"), "n_nationkey").withColumnRenamed("n_regionkey", "r_regionkey").join(table(spark, sf_dir, "region"), "r_regionkey")
    return out.select("c_custkey", "n_name", "r_name")
