"""Best-fit packing of token sequences by bin completion.

Lengths are whole numbers up to the capacity, so the histogram of lengths (at most ``capacity`` numbers, whatever the
corpus) is the whole packing problem. The driver solves it by bin completion: for the largest length left it enumerates
undominated fillings of the remaining room, least waste first, with bit sets of reachable sums as exact waste bounds; the
best-fit descent is the incumbent, and where it misses the lower bound, a branch-and-bound over patterns goes on. The result is a
list of patterns. Pieces are numbered within their length in a distributed way (a count per task and length, then prefix
sums), and a piece's number in its length decides its pattern, sequence and offset.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import id_text, materialize
from .textkit import lean, release

END_ID = 2
#: Words kept by a worker, some 50 MB.
CACHE = 200_000
_runs = re.compile(r"\s\s")


def _ranks(tokenizer) -> dict[bytes, int]:
    """The tokenizer's vocabulary as byte strings, by its byte alphabet (printable bytes stand for themselves)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    alphabet = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    return {bytes(alphabet[c] for c in token): i for token, i in tokenizer.get_vocab().items() if token not in special}


class Encoder:
    """Ids as little-endian bytes. A text without neighbouring white space splits before its single blanks, where the
    tokenizer's own pre-splitting always cuts; each such word is merged once, by the same ranks, and then looked up."""

    def __init__(self, path: str, end_id: int = END_ID) -> None:
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.path, self.tokenizer = path, None  # loaded again for the few texts that need it
        tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.merge = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=_ranks(tokenizer), special_tokens={}).encode_ordinary
        self.words: dict[str, bytes] = {}
        self.end = np.array([end_id], "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        return array("I", self.merge(word)).tobytes()

    def _whole(self, text: str) -> bytes:
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if _runs.search(text) or any(s in text for s in self.special):
            return self._whole(text) + self.end
        head, *rest = text.split(" ")
        words = self.words
        try:
            tail = b"".join(map(words.__getitem__, rest))
        except KeyError:
            if len(words) > CACHE:
                words.clear()
            for w in rest:
                if w not in words:
                    words[w] = self._word(" " + w)
            tail = b"".join(map(words.__getitem__, rest))
        return (self._word(head) if head else b"") + tail + self.end


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int = END_ID) -> Encoder:
    """This process's encoder; its words stay from task to task."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and ``task`` and ``nth``: the piece's number among those of its length in its task.

    A document longer than ``capacity`` is cut so that only its first piece is shorter.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen = encoder(tokenizer_path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = encode(text.as_py())
                n, at, k = len(ids) // 4, 0, 0
                while at < n:
                    size = (n - at - 1) % capacity + 1 if not k else capacity
                    out.append((doc, k, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), task, seen[size]))
                    seen[size] += 1
                    at, k = at + size, k + 1
            cols = list(zip(*out, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return id_text(docs, id_col, text_col).mapInArrow(lean(run), schema)


@dataclass
class Pattern:
    lengths: dict[int, int]  # length -> how often in one sequence
    times: int


@dataclass
class Packing:
    patterns: list[Pattern]
    sequences: int
    bound: int  # no packing has fewer sequences
    optimal: bool  # the bound is met, or the search has seen that nothing less exists


def _sums(have: np.ndarray, counts: np.ndarray, room: int, most: int | None) -> list[list[int]]:
    """Bit sets: [k][j] holds the sums up to ``room`` of at most j of the first k lengths of ``have``, each at most as often
    as it is there; without ``most``, [k][0] those of any number."""
    mask = (1 << (room + 1)) - 1
    out = [[1] * (1 if most is None else most + 1)]
    for x in have.tolist():
        own = list(out[-1])
        for _ in range(min(int(counts[x]), room // x) if most is None else min(int(counts[x]), room // x, most)):
            if most is None:
                more = [(own[0] | own[0] << x) & mask]
            else:
                more = [own[0], *((own[j] | own[j - 1] << x) & mask for j in range(1, most + 1))]
            if more == own:
                break
            own = more
        out.append(own)
    return out


def fillings(room: int, counts: np.ndarray, allowed: int, most: int | None = None) -> Iterator[list[int]]:
    """The undominated fillings of ``room`` that waste at most ``allowed``, least waste first, then larger lengths first.

    Every filling (of at most ``most`` lengths) is found: bit sets of reachable sums say which branches lead to one, so
    none ends in vain. A filling is dominated, and left out, if two of its lengths could give way to a single one of their
    sum that is there as well.
    """
    have = np.flatnonzero(counts[: room + 1])
    reach = _sums(have, counts, room, most)

    def below(k: int, rest: int, chosen: tuple[int, ...]) -> Iterator[list[int]]:
        """Fillings of exactly ``rest`` by the first k lengths."""
        if not rest:
            yield list(chosen)
            return
        while k and have[k - 1] > rest:
            k -= 1
        free = rest if most is None else most - len(chosen)
        if not k or not reach[k][0 if most is None else free] >> rest & 1:
            return
        x = int(have[k - 1])
        for times in range(min(int(counts[x]), rest // x, free), -1, -1):
            if reach[k - 1][0 if most is None else free - times] >> (rest - times * x) & 1:
                yield from below(k - 1, rest - times * x, chosen + (x,) * times)

    for waste in range(min(allowed, room) + 1):
        if reach[-1][-1] >> (room - waste) & 1:
            for own in below(len(have), room - waste, ()):
                used = {x: own.count(x) for x in own}
                pairs = {x + y for i, x in enumerate(own) for y in own[i + 1 :]}
                if all(z > room or counts[z] <= used.get(z, 0) for z in pairs):
                    yield own


def least_sequences(histogram: dict[int, int], capacity: int) -> int:
    """The bound that waste cannot undercut: all tokens over the capacity, and all lengths over half of it."""
    return max(-(-sum(x * n for x, n in histogram.items()) // capacity), sum(n for x, n in histogram.items() if 2 * x > capacity))


def _pattern(counts: np.ndarray, filling: list[int], top: int) -> Pattern:
    """The pattern of the largest length and a filling, used as often as it lasts."""
    own = [top, *filling]
    lengths = {x: own.count(x) for x in own}
    return Pattern(lengths, max(1, min(int(counts[x]) // c for x, c in lengths.items())))


def _descent(counts: np.ndarray, capacity: int, most: int, slack: int | None = None) -> list[Pattern]:
    """For the largest length left its filling of least waste by at most ``most`` lengths, over and over; 0: the best-fit
    one, the largest length that fits, over and over. With ``slack``, the filling of the fewest lengths that wastes no more
    than that goes first, so that short lengths are kept for later."""
    counts, found = counts.copy(), []
    while counts.any():
        top = int(np.flatnonzero(counts)[-1])
        counts[top] -= 1
        left = capacity - top
        if slack is not None:
            few = (next(fillings(left, counts, min(slack, left), m), None) for m in range(most))
            best = next((f for f in few if f is not None), None)
            best = next(fillings(left, counts, left, most)) if best is None else best
        elif most:
            best = next(fillings(left, counts, left, most))
        else:
            best, rest = [], counts.copy()
            while len(fit := np.flatnonzero(rest[: left + 1])):
                best.append(int(fit[-1]))
                rest[fit[-1]] -= 1
                left -= int(fit[-1])
        counts[top] += 1
        p = _pattern(counts, best, top)
        if top < capacity and p.times > 8:
            p.times //= 2  # a part is left for other fillings
        for x, c in p.lengths.items():
            counts[x] -= c * p.times
        found.append(p)
    return found


#: Descents of solve(): (most lengths of a filling, slack), the most useful ones first.
DESCENTS = [(0, None), (5, None), (7, 7), (4, None), (7, 1), (3, None), (6, None), *((7, s) for s in range(2, 17) if s != 7), (2, None), (1, None)]


def solve(histogram: dict[int, int], capacity: int, nodes: int = 4000, effort: int = 8000) -> Packing:
    """Patterns that use every length exactly as often as the histogram says, by bin completion.

    The incumbent is the best of some descents: that by best fit, those that take for the largest length left the filling of
    least waste by up to 1, 2, ... lengths, and those that allow a little waste for fewer lengths. If it needs more sequences
    than the bound, the search branches: over all undominated fillings of the largest length, each used as often as it lasts
    or once, so that a leaf is only as many steps away as there are patterns; a branch is cut when what it has wasted leaves
    no packing below the incumbent. ``effort`` limits the patterns made by descents (the one begun is finished) and ``nodes``
    the steps of the search, for which no bounded method is known; ``optimal`` says whether the result is proven.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    bound, best, used = least_sequences(histogram, capacity), [], None
    made = 0
    for most, slack in DESCENTS:
        if made > effort:
            break
        found = _descent(counts, capacity, most, slack)
        made += len(found)
        n = sum(p.times for p in found)
        if used is None or n < used:
            best, used = found, n
        if used == bound:
            break
    total = int(counts @ np.arange(capacity + 1))

    def branches(counts: np.ndarray, wasted: int) -> Iterator[tuple[np.ndarray, int, Pattern]]:
        top = int(np.flatnonzero(counts)[-1])
        rest = counts.copy()
        rest[top] -= 1
        for own in fillings(capacity - top, rest, (used - 1) * capacity - total - wasted):
            p = _pattern(counts, own, top)
            for times in sorted({p.times, 1}, reverse=True):
                after = counts.copy()
                for x, c in p.lengths.items():
                    after[x] -= c * times
                yield after, wasted + times * (capacity - top - sum(own)), Pattern(p.lengths, times)

    steps, stack = 0, [(branches(counts, 0), None)] if used > bound and total else []
    while stack and used > bound and steps < nodes:
        steps += 1
        step = next(stack[-1][0], None)
        if step is None:
            stack.pop()
            continue
        after, wasted, p = step
        if wasted > (used - 1) * capacity - total:
            continue
        stack.append((branches(after, wasted) if after.any() else iter(()), p))
        if not after.any():
            best = [q for _, q in stack[1:]]
            used = sum(q.times for q in best)
    return Packing(best, used, bound, used == bound or not stack)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row.

    Every document ends with the end id, so null and empty texts are pieces of one token; rows with a null or repeated id
    are packed like others, and so are repeated rows; other columns are ignored, whatever their names. Very long texts are
    encoded whole and cut into pieces. An empty table gives an empty result. Sequences are gapless from offset 0.
    """
    spark = docs.sparkSession
    cut = materialize(pieces(docs, tokenizer_path, capacity, id_col, text_col))
    per_task = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    ranges, base, used = [], 0, {}
    found = solve(histogram, capacity)
    release()
    for p in found.patterns:
        offset = 0
        for length, c in sorted(p.lengths.items(), reverse=True):
            ranges.append((length, used.get(length, 0), c, base, offset))
            used[length] = used.get(length, 0) + p.times * c
            offset += length * c
        base += p.times
    ranges.sort()
    table = np.array(ranges or np.zeros((0, 5)), np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast((table[:, 0] * (1 << 50) + table[:, 1], table))  # patterns: bounded by the capacity, not the rows
    before = per_task.select("task", "length", (F.sum("n").over(W.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows = shared.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            own = rows[np.searchsorted(keys, length * (1 << 50) + rank, "right") - 1] if len(rank) else np.zeros((0, 5), np.int64)
            nth = rank - own[:, 1]
            made = [own[:, 3] + nth // np.maximum(own[:, 2], 1), own[:, 4] + nth % np.maximum(own[:, 2], 1) * length]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.record_batch([*(batch.column(c) for c in names), *map(pa.array, made)], [*names, "sequence_id", "offset"])

    ranked = cut.join(before, ["task", "length"]).withColumn("rank", F.col("nth") + F.col("before"))
    return ranked.mapInArrow(lean(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
