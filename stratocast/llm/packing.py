"""Packing token runs into fixed windows: non-negative least squares over shallow length combinations."""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratocast.llm.common import bounded
from stratocast.llm.tokens import encoder, with_end

RESULT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def combinations(histogram: np.ndarray, window: int, common: int = 48, depth: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shallow combinations of present lengths that fill the window exactly: (pattern, length, times) entries.

    m copies of one length with one filler (m up to depth), two and two, and triples with one of the common lengths.
    """
    present = np.flatnonzero(histogram)
    found: set[tuple[tuple[int, int], ...]] = set()

    def add(*lengths_times):
        times: dict[int, int] = defaultdict(int)
        for length, n in lengths_times:
            if n and length:
                times[length] += n
        if all(histogram[length] >= n for length, n in times.items()):
            found.add(tuple(sorted(times.items())))

    for m in range(1, depth + 1):
        for a in present[(present * m <= window) & (histogram[present] >= m)]:
            rest = window - int(a) * m
            if rest == 0 or (rest < window and histogram[rest]):
                add((int(a), m), (rest, 1))
            if rest and rest % 2 == 0 and histogram[rest // 2] >= 2:
                add((int(a), m), (rest // 2, 2))
    for a in present[np.argsort(-histogram[present], kind="stable")[:common]]:
        rest = window - int(a) - present
        for b in present[(rest > 0) & (histogram[np.clip(rest, 0, window)] > 0)]:
            add((int(a), 1), (int(b), 1), (window - int(a) - int(b), 1))
    patterns = sorted(found)
    entries = [(p, length, n) for p, lengths in enumerate(patterns) for length, n in lengths]
    return tuple(np.array(x, dtype=np.int64) for x in zip(*entries, strict=True)) if entries else (np.zeros(0, np.int64),) * 3


def repeat_counts(histogram: np.ndarray, pattern: np.ndarray, length: np.ndarray, times: np.ndarray, rounds: int = 60) -> np.ndarray:
    """How often to use each pattern: non-negative least squares against the histogram by multiplicative steps, rounded.

    Each step multiplies by A'h / A'Ax, which keeps counts non-negative and never raises the squared error. Rounding
    takes patterns by falling count, each up, but never beyond the pieces that are left.
    """
    n = int(pattern.max(initial=-1)) + 1
    if not n:
        return np.zeros(0, np.int64)
    h, w = histogram.astype(np.float64), times.astype(np.float64)
    x = np.ones(n)
    pull = np.bincount(pattern, weights=w * h[length], minlength=n)
    for _ in range(rounds):
        fit = np.bincount(length, weights=w * x[pattern], minlength=len(h))
        x *= pull / np.maximum(np.bincount(pattern, weights=w * fit[length], minlength=n), 1e-12)
    left, counts = histogram.copy(), np.zeros(n, np.int64)
    starts = np.searchsorted(pattern, np.arange(n + 1))
    for p in np.argsort(-x, kind="stable"):
        at = slice(starts[p], starts[p + 1])
        k = min(int(np.ceil(x[p])), int((left[length[at]] // times[at]).min()))
        if k > 0:
            counts[p] = k
            left[length[at]] -= k * times[at]
    return counts


class Packer:
    """Packs runs (key, length) into windows, chunk by chunk; placed pieces are (key, start, length, sequence, offset)."""

    def __init__(self, window: int):
        self.window, self.sequence, self.room = window, 0, 0  # room: left in the open sequence
        self.tail: list[tuple[object, int, int]] = []  # pieces of the open sequence

    def place(self, runs: list[tuple[object, int]], last: bool = False) -> list[tuple[object, int, int, int, int]]:
        out, by_length = [], defaultdict(list)
        window = self.window
        for key, length in runs:
            whole = length - length % window
            for start in range(0, whole, window):
                out.append((key, start, window, self._next(), 0))
            if length > whole:
                by_length[length - whole].append((key, whole))
        histogram = np.zeros(window + 1, dtype=np.int64)
        for length, members in by_length.items():
            histogram[length] = len(members)
        entries = combinations(histogram, window)
        counts = repeat_counts(histogram, *entries)
        starts = np.searchsorted(entries[0], np.arange(len(counts) + 1))
        for p in np.flatnonzero(counts):
            parts = [(int(n), int(t)) for n, t in zip(entries[1][starts[p] : starts[p + 1]], entries[2][starts[p] : starts[p + 1]], strict=True)]
            for _ in range(counts[p]):
                sequence, offset = self._next(), 0
                for length, times in parts:
                    for _ in range(times):
                        key, start = by_length[length].pop()
                        out.append((key, start, length, sequence, offset))
                        offset += length
        self._residuals([(n, key, start) for n, members in by_length.items() for key, start in members], out)
        if last:
            self._close(out)
        return out

    def _next(self) -> int:
        self.sequence += 1
        return self.sequence - 1

    def _residuals(self, pieces, out) -> None:
        """Largest that fits first; when none fits, the smallest piece is cut to fill the room."""
        pieces.sort(key=lambda x: x[0])
        sizes = [p[0] for p in pieces]
        while pieces:
            if not self.room:
                self._flush(out)
                self.room = self.window
            i = bisect.bisect_right(sizes, self.room) - 1
            if i >= 0:
                length, key, start = pieces.pop(i)
                sizes.pop(i)
                self.tail.append((key, start, length))
                self.room -= length
            else:
                length, key, start = pieces.pop(0)
                sizes.pop(0)
                self.tail.append((key, start, self.room))
                rest = (length - self.room, key, start + self.room)
                at = bisect.bisect_left(sizes, rest[0])
                pieces.insert(at, rest)
                sizes.insert(at, rest[0])
                self.room = 0

    def _flush(self, out) -> None:
        if self.tail:
            sequence, offset = self._next(), 0
            for key, start, length in self.tail:
                out.append((key, start, length, sequence, offset))
                offset += length
        self.tail = []

    def _close(self, out) -> None:
        """The last, partial sequence: cut into sequences whose lengths are powers of two, which need no padding."""
        pieces, self.tail, self.room = self.tail[::-1], [], 0
        total = sum(p[2] for p in pieces)
        while total:
            fill = 1 << (total.bit_length() - 1)
            total -= fill
            while fill:
                key, start, length = pieces.pop()
                taken = min(fill, length)
                self.tail.append((key, start, taken))
                if length > taken:
                    pieces.append((key, start + taken, length - taken))
                fill -= taken
            self._flush(out)


def pack(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, chunk_tokens: int = 3_000_000) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and end_id; null and empty texts are end_id alone. Whole windows are cut off long documents;
    the rest of each goes by its length into a histogram of up to chunk_tokens tokens, for which combinations that
    fill the window are weighed by non-negative least squares; what rounding leaves is packed greedily and cut to
    fit. A scan task packs what it reads, so nothing is shuffled, a task holds one chunk, a very long text or a hot
    source changes nothing, and a lost task is repeated with the same result. Only a task's last sequence can be
    partial; it is cut at powers of two and needs no padding either. Null ids stay null; repeated rows are packed
    each. An empty table gives no rows. Other columns are not read.
    """
    if window & (window - 1):
        raise ValueError("the window is a power of two")

    def run(batches):
        encode = encoder(tokenizer_path).batch
        base = TaskContext.get().partitionId() << 40
        packer = Packer(window)
        runs: list[tuple[int, int]] = []
        held: dict[int, tuple[int | None, np.ndarray]] = {}
        tokens, serial = 0, 0

        def rows(last: bool):
            nonlocal runs, tokens
            placed = packer.place(runs, last)
            runs, tokens = [], 0
            columns = [[] for _ in range(7)]
            for key, start, length, sequence, offset in placed:
                doc_id, ids = held[key]
                crc = zlib.crc32(ids[start : start + length].astype("<u4").tobytes())
                for column, value in zip(columns, (doc_id, start, length, crc, len(ids), base + sequence, offset), strict=True):
                    column.append(value)
            open_keys = {key for key, _, _ in packer.tail}
            for key in [k for k in held if k not in open_keys]:
                del held[key]
            names = RESULT.replace(" long", "").split(", ")
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        for batch in bounded(batches, "text", max_bytes=6 << 20, max_rows=1 << 13):
            flat, counts = with_end(*encode(batch.column(1)), end_id)
            for doc_id, ids in zip(batch.column(0).to_pylist(), np.split(flat, np.cumsum(counts)[:-1]), strict=True):
                held[serial] = (doc_id, ids)
                runs.append((serial, len(ids)))
                serial += 1
                tokens += len(ids)
                if tokens >= chunk_tokens:
                    yield rows(False)
        yield rows(True)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, RESULT)
