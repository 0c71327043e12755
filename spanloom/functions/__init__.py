"""Column expressions: distributions, intervals, paths, rounding. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CLASSES, EXPLANATIONS, FOLDER_CLASS, LETTERS


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def token_letter(token: Column) -> Column:
    """The first character of the stripped, upper-cased token if it is a letter of a class, else null."""
    first = F.substring(F.upper(F.regexp_replace(token, r"^\s+|\s+$", "")), 1, 1)
    return F.when(first.rlike(f"^[{LETTERS[0]}-{LETTERS[-1]}]$"), first)


def letter_class(letter: Column) -> Column:
    return F.element_at(literal_map(dict(zip(LETTERS, CLASSES, strict=True))), letter)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once; inside a lambda a plain expression would be computed for each element."""
    return F.transform(F.array(value), body)[0]


def normalised(values: Column) -> Column:
    """Values over the sum of those that are not null; a sum of 0 counts as 1."""
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    return let(F.when(total == 0, 1.0).otherwise(total), lambda z: F.transform(values, lambda x: x / z))


def softmax(logs: Column) -> Column:
    """Array of doubles to probabilities over its non-null entries; null entries stay null."""
    return let(F.array_max(logs), lambda top: let(F.transform(logs, lambda x: F.exp(x - top)), normalised))


def letter_logs(tokens: Column) -> Column:
    """The greatest logprob of each class letter (null: not there) of array<struct<token, logprob>>."""
    own = F.transform(F.coalesce(tokens, F.array().cast("array<struct<token:string,logprob:double>>")), lambda t: F.struct(token_letter(t["token"]).alias("letter"), t["logprob"].alias("logprob")))
    best = lambda named, letter: F.array_max(F.transform(F.filter(named, lambda t: t["letter"] == letter), lambda t: t["logprob"]))
    return let(own, lambda named: F.array(*[best(named, x) for x in LETTERS]))


def class_distribution(logs: Column, t: float | None = None) -> Column:
    """temperature(softmax()) over the classes. Where no class has a value (no letter in the reply, or no reply at all
    because the call failed), the first class, normal, is sure."""
    sure = F.array(F.lit(1.0), *[F.lit(None).cast("double")] * (len(LETTERS) - 1))
    some = F.exists(logs, lambda x: x.isNotNull())
    return F.when(some, temperature(softmax(logs), t)).otherwise(sure)


def temperature(probs: Column, t: float | None) -> Column:
    """p^(1/t), renormalised; none, 0 or 1 leaves the distribution as it is."""
    if not t or t == 1.0:
        return probs
    return let(F.transform(probs, lambda p: F.pow(F.greatest(p, F.when(p.isNotNull(), 1e-12)), F.lit(1.0 / t))), normalised)


def explanation(class_name: Column) -> Column:
    """The text that an answer sheet gives for a class; null for a class without one."""
    return F.try_element_at(literal_map(EXPLANATIONS), class_name)


def p_anomaly(p_normal: Column) -> Column:
    return 1 - F.coalesce(p_normal, F.lit(0.0))


def top_classes(entries: Column, n: int = 4) -> Column:
    """The n entries (array of struct<p, ord, ...>) of greatest p; ties by the lower ordinal."""
    order = lambda a, b: F.when((a["p"] > b["p"]) | ((a["p"] == b["p"]) & (a["ord"] < b["ord"])), -1).when((a["p"] == b["p"]) & (a["ord"] == b["ord"]), 0).otherwise(1)
    return F.slice(F.array_sort(entries, order), 1, n)


def iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap over hull, 0 for an empty hull; null bounds give 0, so that a gate on it is false."""
    overlap = F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))
    hull = F.greatest(a1, b1) - F.least(a0, b0)
    known = a0.isNotNull() & a1.isNotNull() & b0.isNotNull() & b1.isNotNull()
    return F.when(known & (hull > 0), overlap / hull).otherwise(0.0)


def class_of_path(path: Column, known: tuple[str, ...] = CLASSES, folders: dict[str, str] = FOLDER_CLASS) -> Column:
    """Class of '<class>/videos/x' or '<class>/x': the parent folder, or its own parent if it is called videos."""
    parts = F.split(path, "/")
    parent = F.when(F.size(parts) >= 2, F.try_element_at(parts, F.lit(-2)))
    named = F.when(F.lower(parent) == "videos", F.try_element_at(parts, F.lit(-3))).otherwise(parent)
    return F.when(named.isin(*known), named).otherwise(F.try_element_at(literal_map(folders), named))


def file_stem(path: Column) -> Column:
    """Base name without its extension, runs of other than word characters made one underscore."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), r"(?U)\W+", "_")


def fitted_side(side: Column, height: Column, width: Column, long_side: int, step: int = 28) -> Column:
    """A side after shrinking the longer one to ``long_side``, cut to a multiple of ``step`` and at least one step."""
    scale = F.lit(float(long_side)) / F.greatest(height, width)
    shrunk = F.greatest(F.floor(F.floor(side * scale) / step) * step, F.lit(step))
    return F.when(scale < 1, shrunk).otherwise(side).cast("int")


def media_kind(name: Column) -> Column:
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return F.when(ext.isin("jpg", "jpeg", "png", "bmp", "webp"), "image").otherwise("video")


def clock(seconds: Column) -> Column:
    """m:ss"""
    whole = F.floor(seconds).cast("long")
    return F.concat((F.floor(whole / 60)).cast("string"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))


def fourcc(code: Column) -> Column:
    """The codec name in a whole number's four lowest bytes, lowest first, without white space at its ends."""
    number = code.cast("long")
    name = F.concat(*[F.char(F.shiftright(number, 8 * i).bitwiseAND(0xFF)) for i in range(4)])
    blank = r"[\s\x1c-\x1f\x85\xa0]+"
    return F.regexp_replace(name, f"^{blank}|{blank}$", "")


def encoded_image(data: Column) -> Column:
    """Bytes of an image as one line of base64; null where it could not be encoded (null or no bytes)."""
    return F.when(F.octet_length(data) > 0, F.regexp_replace(F.base64(data), r"\s", ""))


def decoded_image(text: Column) -> Column:
    """Bytes of a base64 text, with or without a data URL's head; null where it is none."""
    body = F.regexp_replace(text, r"^data:[^,]*;base64,", "")
    return F.when(F.length(body) > 0, F.try_to_binary(body, F.lit("base64")))
