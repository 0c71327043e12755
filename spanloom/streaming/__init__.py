"""The ordered progress stream: chunk results that arrive in any order leave in order, then events, done and eof.

Input rows (INPUT): kind is ``chunk``, ``image`` (a job of one still image) or ``error``; ``total`` chunks and the
``duration`` come with every row of a job, ``probs`` by class ordinal (null: missing), ``began_ms`` and ``ms`` from the
scorer's clock. Two further columns may be there, FURTHER: ``frames``, how many images the job's chunks have, and its
``windows``; the first message carries them. Output rows: (job, seq, type, body), body as JSON. Chunks wait in state until all before them have come;
after the last one the job's events are found by the same rules as in batch, once, at the end. A job that says nothing for
``expiry_sec`` seconds ends with an error, and its state goes; so does the mark of an ended job.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import CLASSES, EXPLANATIONS, Settings

INPUT = "job string, kind string, idx long, total long, duration double, probs array<double>, start_sec double, end_sec double, began_ms double, ms double, message string"
FURTHER = "frames long, windows array<array<double>>"
OUTPUT = "job string, seq long, type string, body string"


def median3(xs: list[float]) -> list[float]:
    """As the batch operator of width 3."""
    if len(xs) < 3:
        return xs
    inner = [sorted(xs[i - 1 : i + 2])[1] for i in range(1, len(xs) - 1)]
    return [(xs[0] + xs[1]) / 2, *inner, (xs[-2] + xs[-1]) / 2]


def job_events(chunks: list[tuple], s: Settings, classes: tuple[str, ...] = CLASSES) -> list[dict]:
    """Events of one finished job; chunks: (probs by class ordinal, start, end) in order."""
    xs = median3([1 - (c[0][0] or 0.0) for c in chunks])
    n, k = len(xs), s.t_open_chunks
    if not xs or max(xs) < s.t_video:
        return []
    merged: list[dict] = []
    at = 0
    while at < n:
        if xs[at] < s.t_low:
            at += 1
            continue
        stop = at
        while stop < n and xs[stop] >= s.t_low:
            stop += 1
        ahead = [i for i in range(at, stop) if (i + k <= n and min(xs[i : i + k]) >= s.t_high) or (n < k and xs[i] >= s.t_high)]
        if ahead:
            votes: dict[int, float] = {}
            for probs, _, _ in chunks[ahead[0] : stop]:
                for j, p in enumerate(probs):
                    if j and p is not None:
                        votes[j] = votes.get(j, 0.0) + p
            if votes:
                name = classes[min(votes, key=lambda j: (-votes[j], j))]
                event = {"class_name": name, "start_time_sec": round(chunks[ahead[0]][1], 2), "end_time_sec": round(chunks[stop - 1][2], 2), "confidence": max(xs[ahead[0] : stop])}
                last = merged[-1] if merged else None
                if last and last["class_name"] == name and event["start_time_sec"] - last["end_time_sec"] <= s.merge_gap_sec:
                    last |= {"end_time_sec": max(last["end_time_sec"], event["end_time_sec"]), "confidence": max(last["confidence"], event["confidence"])}
                else:
                    merged.append(event)
        at = stop
    good = [e for e in merged if e["end_time_sec"] - e["start_time_sec"] >= s.min_duration.get(e["class_name"], s.default_duration)]
    best = sorted(good, key=lambda e: (-e["confidence"], e["start_time_sec"]))[: s.max_events]
    return sorted(best, key=lambda e: e["start_time_sec"])


def image_events(probs: list, s: Settings, classes: tuple[str, ...] = CLASSES) -> list[dict]:
    """The event of a still image, without times, if it is anomalous enough."""
    if 1 - (probs[0] or 0.0) < s.t_level1 or all(p is None for p in probs[1:]):
        return []
    j = min(range(1, len(probs)), key=lambda j: (-(probs[j] if probs[j] is not None else -1.0), j))
    return [{"class_name": classes[j], "start_time_sec": None, "end_time_sec": None, "confidence": probs[j]}]


def answer(events: list[dict]) -> list[dict]:
    """Events as a message carries them: confidence to four places, and the explanation of the class."""
    return [e | {"confidence": round(e["confidence"], 4), "explanation": EXPLANATIONS.get(e["class_name"], "")} for e in events]


def top_classes(probs: list, n: int = 4, classes: tuple[str, ...] = CLASSES) -> list[dict]:
    known = sorted((-p, j) for j, p in enumerate(probs) if p is not None)[:n]
    return [{"cls": classes[j], "p": round(-p, 4)} for p, j in known]


def run_times(calls: list[tuple[float, float]], duration: float | None, image: bool = False) -> dict:
    """The runtime of a finished job from (began_ms, ms) of its calls."""
    wall = max(b + m for b, m in calls) - min(b for b, _ in calls)
    times = [m for _, m in calls]
    out = {"total_ms": round(wall, 1), "calls": len(calls), "p50_ms": round(float(np.percentile(times, 50)), 1)}
    if not image:
        out["p95_ms"] = round(float(np.percentile(times, 95)), 1)
    return out | {"rtf": round(wall / 1000 / duration, 3) if duration and not image else None}


def layout(row: Any, image: bool) -> dict:
    """What a client lays out its time line by: the number of images and, of a video, the windows."""
    frames, windows = getattr(row, "frames", None), getattr(row, "windows", None)
    out = {} if frames is None or pd.isna(frames) else {"frames": int(frames)}
    return out if image or windows is None else out | {"windows": [[round(float(x), 2) for x in w] for w in windows]}


#: Chunks of a job that are one value of its state.
BLOCK = 64
Chunk = tuple[list, float, float, float, float]  # probs, start, end, began, ms


class Blocks:
    """A job's chunks during one call: blocks are read when they are first asked for, and changed ones written at the end."""

    def __init__(self, state: Any, stored: bool) -> None:
        self.state, self.stored = state, stored
        self.read: dict[int, dict[int, Chunk]] = {}
        self.changed: set[int] = set()

    def _block(self, number: int) -> dict[int, Chunk]:
        if number not in self.read:
            value = self.state.getValue((number,)) if self.stored and self.state.containsKey((number,)) else None
            self.read[number] = {int(i): (plain(p), *map(float, t)) for i, p, t in zip(*value, strict=True)} if value else {}
        return self.read[number]

    def put(self, idx: int, chunk: Chunk) -> None:
        self._block(idx // BLOCK)[idx] = chunk
        self.changed.add(idx // BLOCK)

    def get(self, idx: int) -> Chunk | None:
        return self._block(idx // BLOCK).get(idx)

    def write(self) -> None:
        for number in self.changed:
            own = self.read[number]
            self.state.updateValue((number,), (list(own), [c[0] for c in own.values()], [list(c[1:]) for c in own.values()]))


def plain(probs: Any) -> list[float | None]:
    return [None if pd.isna(p) else float(p) for p in probs]


class OrderedProgress(StatefulProcessor):
    """State of a job: how many messages have left, whether it has ended, and its chunks in blocks of BLOCK places, so that the
    store is asked once for a block that a batch touches, not once for each chunk."""

    settings = Settings()
    classes: tuple[str, ...] = CLASSES
    expiry_sec: float | None = 600.0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "seq long, next long, ended boolean")
        self.chunks = handle.getMapState("blocks", "block long", "idx array<long>, probs array<array<double>>, times array<array<double>>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        known = self.place.exists()
        seq, after, ended = self.place.get() if known else (0, 0, False)
        chunks = Blocks(self.chunks, known and not ended)
        out: list[tuple] = []

        def say(kind: str, body: dict) -> None:
            nonlocal seq
            out.append((key[0], seq, kind, json.dumps(body)))
            seq += 1

        for frame in rows:
            for r in frame.itertuples(index=False):
                if ended:
                    continue
                image = r.kind == "image"
                if not seq:
                    say("meta", {"kind": "image" if image else "video", "chunks": int(r.total), "duration": None if pd.isna(r.duration) else round(float(r.duration), 2)} | layout(r, image))
                if r.kind == "error":
                    say("error", {"message": r.message})
                    say("eof", {})
                    ended = True
                    continue
                chunks.put(int(r.idx), (plain(r.probs), float(r.start_sec), float(r.end_sec), float(r.began_ms), float(r.ms)))
                while after < r.total and (one := chunks.get(after)) is not None:
                    probs, a, b, _, ms = one
                    say("chunk", {"idx": after, "start": round(a, 2), "end": round(b, 2), "p_anom": round(1 - (probs[0] or 0.0), 4), "top": top_classes(probs, classes=self.classes), "ms": round(ms, 1)})
                    after += 1
                if after >= r.total:
                    every = [chunks.get(i) for i in range(after)]
                    found = image_events(every[0][0], self.settings, self.classes) if image else job_events([c[:3] for c in every], self.settings, self.classes)
                    say("events", {"events": answer(found)})
                    say("done", {"runtime": run_times([c[3:] for c in every], None if pd.isna(r.duration) else float(r.duration), image)})
                    say("eof", {})
                    ended = True
        if not ended:
            chunks.write()
        elif chunks.stored:
            self.chunks.clear()
        self.place.update((seq, after, ended))
        self._wait(timerValues)
        yield pd.DataFrame(out, columns=["job", "seq", "type", "body"])

    def _wait(self, timerValues: Any) -> None:
        """One timer for each job, from its last row on; none without an expiry."""
        if self.expiry_sec is None:
            return
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.expiry_sec * 1000))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        seq, _, ended = self.place.get() if self.place.exists() else (0, 0, True)
        out = [] if ended else [(key[0], seq, "error", json.dumps({"message": "The job has expired."})), (key[0], seq + 1, "eof", "{}")]
        self.place.clear()
        if self.chunks.exists():
            self.chunks.clear()
        yield pd.DataFrame(out, columns=["job", "seq", "type", "body"])

    def close(self) -> None:
        pass


def processor(settings: Settings, classes: tuple[str, ...] = CLASSES, expiry_sec: float | None = 600.0) -> StatefulProcessor:
    own = OrderedProgress()
    own.settings, own.classes, own.expiry_sec = settings, classes, expiry_sec
    return own


def ordered_progress(stream: DataFrame, settings: Settings | None = None, classes: tuple[str, ...] = CLASSES, expiry_sec: float | None = 600.0) -> DataFrame:
    """Messages in order for each job of a streaming frame (needs the RocksDB state store).

    With an expiry, a query always has timers to wait for; without one (None) it ends when its input does, if its trigger
    says so, and unfinished jobs wait for the next run.
    """
    mode = "none" if expiry_sec is None else "processingTime"
    return stream.groupBy("job").transformWithStateInPandas(processor(settings or Settings(), classes, expiry_sec), OUTPUT, "append", mode)


def server_sent(messages: DataFrame) -> DataFrame:
    """Messages framed for an event stream."""
    from pyspark.sql import functions as F

    plain = F.concat(F.lit("data: "), "body", F.lit("\n\n"))
    return messages.withColumn("frame", F.when(F.col("type") == "eof", F.lit("event: eof\ndata: {}\n\n")).otherwise(plain))
