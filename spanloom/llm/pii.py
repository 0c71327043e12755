"""Personal data by candidate gradient boosting, in DataFrame operations only.

Strict patterns give the base spans. Looser generators propose further, overlapping spans. Every candidate has a few
small whole-number features of format and context; Spark counts, over all documents, how many candidates of each feature
combination (a cell of a fixed grid) are valid: strict ones if they are base spans, loose ones if they pass the kind's
checks once their form is restored. Trees are boosted on the counts of one half of the documents, which is the same as boosting
on all candidates there, and compiled to a column expression. For each kind and generator the scores are calibrated on the other
half: from the highest score down, the threshold goes as far as valid ones make up ``PRECISION`` of the candidates of every single
score. Valid loose candidates at or over it that touch no base span are added; what fails its checks never is.

Positions come from the pieces between matches: a match starts where the pieces and matches before it end.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import let
from .common import held_out, id_text, materialize

KINDS = ("email", "ip", "card", "phone")
# The strict patterns. Possessive repeats and the look-behind only save steps: a longer run of the same
# class cannot match from a later start when it does not from its own. \G lets a match begin where the last one ended.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Generators of further candidates: spelled-out or broken forms.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?[\[({]at[\])}]\x20?|\x20@\x20?|@\x20)[A-Za-z0-9-]++(?:(?:\.|\x20?[\[({]dot[\])}]\x20?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\x20\.\x20)[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[._/\x20-]{1,2}[0-9]{4}){2,3}(?:[._/\x20-]{1,2}[0-9]{1,3})?(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,4}\)|00[0-9]{1,3}|[0-9]{3,4})[\x20.-]?[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
}
#: What must occur in a text for a pattern to match; a cheap test before it.
NEEDS = {"email": "[@]|[\\[({](?:at)[\\])}]", "ip": "[0-9]", "card": "[0-9]", "phone": "[0-9]"}
CONTEXT = r"(?:mail|contact|write|call|phone|tel|fax|mobile|card|visa|pay|account|ip|host|server|address)[a-z.]*[:=\x20]*$"
_LOOSE, _FAR = "struct<start:int,stop:int,value:string,before:string,ok:boolean>", 2**31 - 1
WIDTHS = (4, 22, 8, 3, 12, 2)  # values of each feature: their product bounds the cells that reach the driver
PRECISION, TREES, RATE = 0.98, 40, 0.3


def _found(text: Column, pattern: str, needs: str) -> Column:
    """All matches; the pattern runs only where what it needs occurs."""
    return F.when(text.rlike(needs), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _running(values: Column, zero: Column, step, levels: int = 3) -> Column:
    """array<int>: the fold of ``values`` after each of them. Arrays grow by copying, so the fold goes in blocks, then over
    the blocks' ends, ``levels`` deep: a block has about the ``levels``-th root of their number. ``step`` must be associative."""

    def scan(xs: Column) -> Column:
        def grow(acc: Column, x: Column) -> Column:
            at = step(acc["at"], x)
            return F.struct(at.alias("at"), F.concat(acc["out"], F.array(at)).alias("out"))

        start = F.struct(zero.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(xs, start, grow, lambda acc: acc["out"])

    if levels == 1:
        return scan(values)

    def blocks(xs: Column) -> Column:
        width = F.ceil(F.pow(F.size(xs), F.lit(1 / levels))).cast("int")
        return F.transform(F.sequence(F.lit(1), F.size(xs), width), lambda at: scan(F.slice(xs, at, width)))

    def joined(parts: Column) -> Column:
        ends = _running(F.transform(parts, lambda p: F.element_at(p, -1)), zero, step, levels - 1)
        ahead = let(ends, lambda e: F.concat(F.array(zero), F.slice(e, F.lit(1), F.size(e) - 1)))
        return F.flatten(F.zip_with(parts, ahead, lambda p, a: F.transform(p, lambda x: step(a, x))))

    return F.when(F.size(values) > 0, let(let(values, blocks), joined)).otherwise(F.array().cast("array<int>"))


def _placed(text: Column, pattern: str, hits: Column) -> Column:
    """array<struct<start, stop, value, before>> of the matches ``hits``; before: up to 24 code points ahead of them."""
    nothing = F.array().cast("array<struct<start:int,stop:int,value:string,before:string>>")

    def placed(zipped: Column) -> Column:
        ends = _running(F.transform(zipped, lambda x: F.length(x["piece"]) + F.length(x["hit"])), F.lit(0), lambda a, x: a + x)

        def one(x: Column, stop: Column) -> Column:
            start = stop - F.length(x["hit"])
            return F.struct(start.alias("start"), stop.alias("stop"), x["hit"].alias("value"), F.lower(F.substring(x["piece"], -24, 24)).alias("before"))

        return F.zip_with(zipped, ends, one)

    pieces = F.split(text, pattern, -1)
    zipped = F.zip_with(hits, F.slice(pieces, F.lit(1), F.size(hits)), lambda h, p: F.struct(h.alias("hit"), p.alias("piece")))
    return F.when(F.size(hits) > 0, let(zipped, placed)).otherwise(nothing)


def _free(spans: Column, taken: Column) -> Column:
    """The structs of ``spans`` that overlap none of ``taken`` (start, stop): both are put in order of their starts, and a span
    is free if no taken one before it ends behind its start and the next taken one begins at or behind its end."""
    mark = lambda s, own: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.lit(own).alias("own"), (s if own else F.lit(None).cast(_LOOSE)).alias("span"))

    def settled(line: Column) -> Column:
        reach = _running(F.transform(line, lambda x: F.when(x["own"], F.lit(0)).otherwise(x["stop"])), F.lit(0), lambda a, x: F.greatest(a, x))
        behind = F.reverse(_running(F.transform(F.reverse(line), lambda x: F.when(~x["own"], x["start"]).otherwise(F.lit(_FAR))), F.lit(_FAR), lambda a, x: F.least(a, x)))
        both = F.zip_with(F.zip_with(line, reach, lambda x, r: F.struct(x.alias("x"), r.alias("reach"))), behind, lambda y, n: F.struct(y["x"].alias("x"), y["reach"].alias("reach"), n.alias("next")))
        good = F.filter(both, lambda y: y["x"]["own"] & (y["reach"] <= y["x"]["start"]) & (y["next"] >= y["x"]["stop"]))
        return F.transform(good, lambda y: y["x"]["span"])

    line = F.array_sort(F.concat(F.transform(spans, lambda s: mark(s, True)), F.transform(taken, lambda s: mark(s, False))))
    return F.when((F.size(spans) > 0) & (F.size(taken) > 0), let(line, settled)).otherwise(spans)


def _last(points: Column, starts: Column) -> Column:
    """For each of the ascending ``points``, how many of the ascending ``starts`` lie before it."""
    mark = lambda xs, kind: F.transform(xs, lambda x, i: F.struct(x.alias("at"), F.lit(kind).alias("kind"), (i + 1).alias("n")))

    def counted(line: Column) -> Column:
        seen = _running(F.transform(line, lambda x: F.when(x["kind"] == 1, x["n"]).otherwise(0)), F.lit(0), lambda a, x: F.greatest(a, x))
        both = F.zip_with(line, seen, lambda x, n: F.struct(x["kind"].alias("kind"), n.alias("n")))
        return F.transform(F.filter(both, lambda x: x["kind"] == 0), lambda x: x["n"])

    return let(F.array_sort(F.concat(mark(points, 0), mark(starts, 1))), counted)


def _inside(spans: Column, longer: list[Column]) -> Column:
    """array<boolean>: whether a span overlaps one of another list (in order, not overlapping each other) that has more digits.

    Such a one begins before the span or ends behind it, so it is the last to begin before the span's start or its end.
    """
    flags = F.transform(spans, lambda s: F.lit(False))
    for other in longer:
        starts = F.transform(other, lambda t: t["start"])
        for point in (lambda s: s["start"] + 1, lambda s: s["stop"]):
            at = _last(F.transform(spans, point), starts)

            def hit(s: Column, n: Column, other: Column = other) -> Column:
                t = F.try_element_at(other, n)
                return F.coalesce((n > 0) & (t["start"] < s["stop"]) & (s["start"] < t["stop"]) & (F.length(_digits(t["value"])) > F.length(_digits(s["value"]))), F.lit(False))

            one = F.zip_with(spans, at, lambda s, n: hit(s, F.nullif(n, F.lit(0))))
            flags = F.zip_with(flags, one, lambda a, b: a | b)
    return F.when(F.size(spans) > 0, flags).otherwise(F.array().cast("array<boolean>"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    digits = _digits(value)
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        each = F.transform(F.split(F.reverse(digits), ""), lambda x, i: F.when(i % 2 == 0, F.ascii(x) - 48).otherwise((F.ascii(x) - 48) * 2 - F.when(F.ascii(x) > 52, 9).otherwise(0)))
        luhn = F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0
        return F.when(F.length(digits).between(16, 19), luhn).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _restored(kind: str, value: Column) -> Column:
    """A loose candidate in the form that the strict pattern and its checks know."""
    if kind == "email":
        return F.regexp_replace(F.regexp_replace(value, r"\x20?[\[({]at[\])}]\x20?|\x20?@\x20?", "@"), r"\x20?[\[({]dot[\])}]\x20?", ".")
    if kind == "ip":
        return F.regexp_replace(value, r"\[\.\]|\(\.\)|\x20\.\x20", ".")
    return value


def _loose_valid(kind: str, s: Column, inside: Column) -> Column:
    """What makes a loose candidate a real item; a part of a longer number (``inside``) is no phone."""
    if kind == "email":
        return _restored(kind, s["value"]).rlike(r"^[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}$")
    valid = _valid(kind, _restored(kind, s["value"]))
    if kind == "phone":
        return valid & ~inside
    return valid


def _checked(kind: str):
    return lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["value"].alias("value"), s["before"].alias("before"), _valid(kind, s["value"]).alias("ok"))


def with_spans(docs: DataFrame) -> DataFrame:
    """doc_id, ``held`` (the documents that calibrate) and, for each kind, ``<kind>_all`` (strict matches with their checks'
    result in ``ok``) and ``<kind>_loose``."""
    out = docs
    for kind in KINDS:
        out = out.withColumns({f"{kind}_h": _found(F.col("text"), STRICT[kind], NEEDS[kind]), f"{kind}_g": _found(F.col("text"), LOOSE[kind], NEEDS[kind])})
    columns = {}
    for kind in KINDS:
        strict = _placed(F.col("text"), STRICT[kind], F.col(f"{kind}_h"))
        columns[f"{kind}_all"] = F.transform(strict, _checked(kind))
        columns[f"{kind}_g2"] = _placed(F.col("text"), LOOSE[kind], F.col(f"{kind}_g"))
    out = out.select("doc_id", *[c.alias(n) for n, c in columns.items()])

    def checked(kind: str) -> Column:
        found = F.col(f"{kind}_g2")
        inside = _inside(found, [F.col("card_all"), F.col("card_g2")]) if kind == "phone" else F.transform(found, lambda s: F.lit(False))

        def one(s: Column, part: Column) -> Column:
            return F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["value"].alias("value"), s["before"].alias("before"), _loose_valid(kind, s, part).alias("ok"))

        return let(inside, lambda parts: F.zip_with(found, parts, one))

    return out.select("doc_id", held_out(F.col("doc_id"), 2).alias("held"), *[f"{k}_all" for k in KINDS], *[checked(k).alias(f"{k}_loose") for k in KINDS])


def features(kind: str, s: Column, loose: bool = False) -> list[Column]:
    """Format and context without the checks that make a span a base one, each from 0 to its width less 1."""
    groups = F.size(F.split(s["value"], "[^0-9A-Za-z]+"))
    near = F.when(s["before"].rlike(CONTEXT), 2).when(s["before"].rlike("[A-Za-z0-9]$"), 1).otherwise(0)
    raw = [F.lit(KINDS.index(kind)), F.length(_digits(s["value"])), groups, near, F.floor(F.length(s["value"]) / 4).cast("int"), F.lit(int(loose))]
    return [F.least(x, F.lit(w - 1)).cast("int") for x, w in zip(raw, WIDTHS, strict=True)]


@dataclass
class Leaf:
    value: float


@dataclass
class Split:
    feature: int
    at: int
    low: Leaf | Split  # feature <= at
    high: Leaf | Split


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> Leaf | Split:
    """A regression tree on cells: gradients and weights are summed, gains are those of second-order boosting."""
    total_g, total_h = g.sum(), h.sum()
    best = (1e-9, None)
    if depth:
        for f in range(x.shape[1]):
            for at in np.unique(x[:, f])[:-1]:
                low = x[:, f] <= at
                a, b = g[low].sum(), h[low].sum()
                gain = a * a / (b + 1) + (total_g - a) ** 2 / (total_h - b + 1) - total_g**2 / (total_h + 1)
                if gain > best[0]:
                    best = (gain, (f, int(at), low))
    if best[1] is None:
        return Leaf(float(-RATE * total_g / (total_h + 1)))
    f, at, low = best[1]
    return Split(f, at, _grow(x[low], g[low], h[low], depth - 1), _grow(x[~low], g[~low], h[~low], depth - 1))


def _apply(tree: Leaf | Split, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, Leaf):
        return np.full(len(x), tree.value)
    return np.where(x[:, tree.feature] <= tree.at, _apply(tree.low, x), _apply(tree.high, x))


def _column(tree: Leaf | Split, own: list[Column]) -> Column:
    if isinstance(tree, Leaf):
        return F.lit(tree.value)
    return F.when(own[tree.feature] <= tree.at, _column(tree.low, own)).otherwise(_column(tree.high, own))


@dataclass
class Model:
    trees: list[Leaf | Split]
    thresholds: dict[str, float]  # of strict candidates, by kind; infinity: nothing is added
    loose: dict[str, float]  # of the loose generators' candidates


def boost(cells: np.ndarray, counts: np.ndarray, positives: np.ndarray, held: np.ndarray | None = None, held_positives: np.ndarray | None = None) -> Model:
    """Trees for the cells' share of positives, and each kind's and generator's threshold.

    held, held_positives: counts of the calibrating half; a score that has no candidate there is judged by the other half.
    """
    score, trees = np.zeros(len(cells)), []
    for _ in range(TREES if len(cells) else 0):
        p = 1 / (1 + np.exp(-score))
        trees.append(_grow(cells, counts * p - positives, counts * p * (1 - p), 2))
        score += _apply(trees[-1], cells)
    from_loose = cells[:, 5] == 1 if len(cells) and cells.shape[1] > 5 else np.zeros(len(cells), bool)
    held, held_positives = (np.zeros(len(cells)), np.zeros(len(cells))) if held is None else (held, held_positives)

    def threshold(k: int, loose: bool) -> float:
        own = np.flatnonzero((cells[:, 0] == k) & (from_loose == loose)) if len(cells) else np.zeros(0, int)
        least = float("inf")
        for at in np.unique(np.round(score[own], 9))[::-1]:
            same = own[np.round(score[own], 9) == at]
            n, good = (held, held_positives) if held[same].sum() else (counts, positives)
            if good[same].sum() < PRECISION * n[same].sum():
                break
            least = float(at) - 1e-8
        return least

    return Model(trees, *({kind: threshold(k, loose) for k, kind in enumerate(KINDS)} for loose in (False, True)))


def _cell(kind: str, loose: bool):
    return lambda s: F.struct(*[x.alias(f"f{i}") for i, x in enumerate(features(kind, s, loose))], s["ok"].alias("base"))


def _written(kind: str):
    return lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["stop"].cast("string"))


def fit(spans: DataFrame) -> Model:
    """Counts of all candidates by cell and half; at most twice the product of WIDTHS rows reach the driver."""
    every = []
    for kind in KINDS:
        for source, loose in ((f"{kind}_all", False), (f"{kind}_loose", True)):
            every.append(F.transform(F.col(source), _cell(kind, loose)))
    names = [f"f{i}" for i in range(len(WIDTHS))]
    rows = spans.select("held", F.explode(F.concat(*every)).alias("c")).groupBy(*[F.col(f"c.{x}").alias(x) for x in names])
    half = lambda held, what: F.sum(F.when(F.col("held") == held, what).otherwise(0))
    valid = F.col("c.base").cast("int")
    cells = rows.agg(half(False, F.lit(1)).alias("n"), half(False, valid).alias("good"), half(True, F.lit(1)).alias("held_n"), half(True, valid).alias("held_good")).orderBy(*names).collect()
    table = np.array([list(c) for c in cells], float).reshape(-1, len(WIDTHS) + 4)
    return boost(table[:, : len(WIDTHS)].astype(int), *table[:, len(WIDTHS) :].T)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_added for every row.

    Spans are ``kind:start:end`` in code points, by kind, then start, comma-joined. Null and empty texts have none (the
    hash is that of the empty string); null and repeated ids are ordinary rows; spans of several kinds may overlap, and of
    two with equal kind and place one stays; very long texts are read whole, as single rows; other columns are ignored,
    whatever their names; an empty table gives an empty result.
    """
    spans = materialize(with_spans(id_text(docs, id_col, text_col)))  # places and values only, no texts
    model = fit(spans)
    based = {f"{k}_base": F.transform(F.filter(F.col(f"{k}_all"), lambda s: s["ok"]), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"))) for k in KINDS}
    out = spans.select("doc_id", *[f"{k}_loose" for k in KINDS], *[c.alias(n) for n, c in based.items()])
    out = out.withColumn("taken", F.concat(*[F.col(f"{k}_base") for k in KINDS]))

    def chosen(kind: str) -> Column:
        least = model.loose[kind]
        if least == float("inf"):
            return F.array().cast("array<struct<start:int,stop:int>>")

        def read(s: Column) -> Column:
            return F.struct(s["start"].alias("start"), s["stop"].alias("stop"), *[x.alias(f"f{i}") for i, x in enumerate(features(kind, s, True))])

        def passes(s: Column) -> Column:
            own = [s[f"f{i}"] for i in range(len(WIDTHS))]
            return sum((_column(tree, own) for tree in model.trees), F.lit(0.0)) >= least

        free = _free(F.filter(F.col(f"{kind}_loose"), lambda s: s["ok"]), F.col("taken"))
        scored = F.transform(free, read)  # a candidate's features are read once for all trees
        return F.array_distinct(F.transform(F.filter(scored, passes), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"))))

    out = out.withColumns({f"{k}_added": chosen(k) for k in KINDS})

    def written(columns: list[tuple[str, Column]]) -> Column:
        return F.array_join(F.concat(*[F.transform(c, _written(k)) for k, c in columns]), ",")

    base = written([(k, F.col(f"{k}_base")) for k in KINDS])
    both = written([(k, F.array_sort(F.concat(F.col(f"{k}_base"), F.col(f"{k}_added")))) for k in KINDS])
    added = sum((F.size(f"{k}_added") for k in KINDS), F.lit(0))
    return out.select("doc_id", *[F.size(f"{k}_base").cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(base, 256).alias("base_sha256"), both.alias("spans"), added.cast("long").alias("n_added"))


def redact(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, text with the spans of ``found`` (find()'s result) replaced by [KIND]; overlapping spans merge under the first's kind.

    Ids must be unique and not null, as spans are matched with texts by them; other tables are refused.
    """
    ids = docs.agg(F.count("*").alias("n"), F.count("doc_id").alias("known"), F.count_distinct("doc_id").alias("unique")).first()
    if not ids["n"] == ids["known"] == ids["unique"]:
        raise ValueError("ids must be unique and not null")

    def parsed(x: Column) -> Column:
        part = F.split(x, ":")
        return F.struct(part[1].cast("int").alias("start"), part[2].cast("int").alias("stop"), part[0].alias("kind"))

    spans = F.array_sort(F.transform(F.filter(F.split("spans", ","), lambda x: x != ""), parsed))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.when(fresh, F.concat(F.substr(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.concat(acc["out"], piece).alias("out"))

    folded = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    both = id_text(docs).join(found.select("doc_id", "spans"), "doc_id").withColumn("folded", folded)
    return both.select("doc_id", F.concat(F.col("folded.out"), F.expr("substr(text, folded.at + 1)")).alias("text"))
