"""Packing of token sequences into near-equal windows by Karmarkar-Karp multiway differencing.

Each task packs its own documents, block by block, while it encodes them, so nothing is shuffled and a lost task is simply
run again. What fills a window alone (each full ``capacity`` of a long document) is a window. The rests gather until they
fill ``windows`` windows; differencing then spreads them: every rest is a partial partition of one part, and the two partial
partitions with the largest imbalance (largest less smallest part) merge, large parts with small ones, until one is left.
Its parts are the windows, and they are near-equal.

Where documents may be cut (``cut``), a window over the capacity hands its excess on to windows with room, so that a block's
windows are all full. What is over a whole number of windows at a task's end opens further windows of powers of two, whose
lengths need no padding. Without ``cut``, rests stay whole, and the number of windows rises, and differencing begins anew,
until no window exceeds the capacity.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import id_text
from .packing import encoder
from .textkit import lean

END_ID = 0
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Bits of a sequence id that number the windows of a task.
OWN_BITS = 33


def difference(lengths: np.ndarray, windows: int) -> np.ndarray:
    """The window, from 0 to ``windows`` - 1, of each length (positive whole numbers), with sums as near as differencing gets.

    A partial partition has the sums of its parts in ascending order and a node for each; parts not listed are empty. Of
    equal imbalances the earlier partition goes first, so equal inputs have equal results.
    """
    n = len(lengths)
    order = np.argsort(-lengths, kind="stable")
    heap = [(-int(lengths[i]), k, lengths[i : i + 1], np.array([i])) for k, i in enumerate(order)]
    low, high, made = [], [], n  # the children of the nodes from n on, in blocks
    heapq.heapify(heap)
    for k in range(n, 2 * n - 1):
        _, _, a, a_node = heapq.heappop(heap)
        _, _, b, b_node = heapq.heappop(heap)
        met = max(0, len(a) + len(b) - windows)  # the smallest parts of both, which share a window: one's least with the other's greatest
        sums = np.concatenate([a[met:], b[met:], a[:met] + b[:met][::-1]])
        node = np.concatenate([a_node[met:], b_node[met:], np.arange(made, made + met)])
        low.append(a_node[:met])
        high.append(b_node[:met][::-1])
        made += met
        rank = np.argsort(sums, kind="stable")
        sums, node = sums[rank], node[rank]
        spread = int(sums[-1]) - (int(sums[0]) if len(sums) == windows else 0)
        heapq.heappush(heap, (-spread, k, sums, node))
    window = np.zeros(made, np.int64)
    if n:
        root = heap[0][3]
        window[root] = np.arange(len(root))
    at = made
    for x, y in zip(reversed(low), reversed(high), strict=True):
        own = window[at - len(x) : at]
        window[x] = window[y] = own
        at -= len(x)
    return window[:n]


def level(lengths: np.ndarray, window: np.ndarray, windows: int, capacity: int) -> list[tuple[int, int, int, int]]:
    """(item, start within it, length, window) with no window over the capacity; the total must fit.

    A window over it gives up its excess from the ends of its largest items, to the windows with the most room.
    """
    sums = np.bincount(window, lengths, windows).astype(np.int64)
    keep = lengths.astype(np.int64).copy()
    order = np.lexsort((-lengths, window))
    first = np.searchsorted(window[order], np.arange(windows + 1))
    room = [(int(sums[w]) - capacity, int(w)) for w in np.flatnonzero(sums < capacity)]
    heapq.heapify(room)
    moved: list[tuple[int, int, int, int]] = []
    for w in np.flatnonzero(sums > capacity):
        excess = int(sums[w]) - capacity
        for i in order[first[w] : first[w + 1]]:
            while excess and keep[i]:
                free, to = heapq.heappop(room)
                part = min(excess, int(keep[i]), -free)
                keep[i] -= part
                excess -= part
                moved.append((int(i), int(keep[i]), part, to))
                if free + part < 0:
                    heapq.heappush(room, (free + part, to))
            if not excess:
                break
    return [(int(i), 0, int(keep[i]), int(window[i])) for i in order if keep[i]] + moved


def powers(total: int, capacity: int) -> list[int]:
    """The powers of two, largest first, that sum to ``total``; none is over the capacity."""
    most = 1 << (capacity.bit_length() - 1)
    return [most] * (total // most) + [1 << b for b in range(most.bit_length() - 2, -1, -1) if total % most >> b & 1]


def fitted(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The window of each length, and how many there are: the least number that could do, raised while one is over the capacity."""
    windows = max(1, -(-int(lengths.sum()) // capacity), int((2 * lengths > capacity).sum()))
    while True:
        window = difference(lengths, windows)
        over = np.bincount(window, lengths, windows) - capacity
        if not len(lengths) or over.max() <= 0:
            return window, windows
        windows += max(1, int(over[over > 0].sum()) // capacity)


def pack_balanced(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = END_ID, windows: int = 256, cut: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for every piece of every row.

    Every document ends with ``end_id``, so null and empty texts have one token. Rows with a null or repeated id are packed
    like others, and so are repeated rows; other columns are ignored, whatever their names. A very long text is encoded
    whole, in one task, and cut at every ``capacity`` tokens. An empty table gives an empty result. Sequences are gapless
    from offset 0. With ``cut``, all are full but at most one of each power of two in a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, end_id)
        made = TaskContext.get().partitionId() << OWN_BITS
        rows: list[tuple] = []
        rests: list[tuple] = []  # (doc_id, start, ids, doc_tokens), the next block
        gathered = 0

        def emit(item: tuple, start: int, length: int, sequence: int, offset: int) -> None:
            doc, at, ids, tokens = item
            rows.append((doc, at + start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), tokens, sequence, offset))

        def place(items: list[tuple], parts: list[tuple[int, int, int, int]], count: int) -> None:
            nonlocal made
            ends = [0] * count
            for i, start, length, w in parts:
                emit(items[i], start, length, made + w, ends[w])
                ends[w] += length
            made += count

        def split(items: list[tuple], total: int) -> tuple[list[tuple], list[tuple]]:
            """The first ``total`` tokens of the items, and the rest; one item is cut at most."""
            for k, (doc, at, ids, tokens) in enumerate(items):
                if total < len(ids) // 4:
                    head = [(doc, at, ids[: 4 * total], tokens)] if total else []
                    return items[:k] + head, [(doc, at + total, ids[4 * total :], tokens), *items[k + 1 :]]
                total -= len(ids) // 4
            return items, []

        def settle(items: list[tuple], count: int) -> None:
            if items:
                lengths = np.array([len(x[2]) // 4 for x in items])
                place(items, level(lengths, difference(lengths, count), count, capacity), count)

        def settle_whole(items: list[tuple]) -> None:
            if items:
                lengths = np.array([len(x[2]) // 4 for x in items])
                window, count = fitted(lengths, capacity)
                used, window = np.unique(window, return_inverse=True)
                place(items, [(i, 0, int(n), int(w)) for i, (n, w) in enumerate(zip(lengths, window, strict=True))], len(used))

        def written() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            out = pa.record_batch([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in SCHEMA.split(", ")])
            rows.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = encode(text.as_py())
                tokens = len(ids) // 4
                full = tokens // capacity * capacity
                for at in range(0, full, capacity):
                    place([(doc, at, ids[4 * at : 4 * (at + capacity)], tokens)], [(0, 0, capacity, 0)], 1)
                if full < tokens:
                    rests.append((doc, full, ids[4 * full :], tokens))
                    gathered += tokens - full
                if gathered >= windows * capacity:
                    if cut:
                        own, rests = split(rests, windows * capacity)
                        settle(own, windows)
                    else:
                        settle_whole(rests)
                        rests = []
                    gathered = sum(len(x[2]) // 4 for x in rests)
                    yield written()
        if cut:
            own, rests = split(rests, gathered // capacity * capacity)
            settle(own, gathered // capacity)
            for size in powers(gathered % capacity, capacity):
                own, rests = split(rests, size)
                place(own, [(i, 0, len(x[2]) // 4, 0) for i, x in enumerate(own)], 1)
        else:
            settle_whole(rests)
        yield written()

    return id_text(docs, id_col, text_col).mapInArrow(lean(run), SCHEMA)
