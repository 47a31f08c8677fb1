"""Periodic runs of words: online dyadic square catching.

A run is a stretch of consecutive words with smallest period q (words q apart are
identical) that no neighbouring word extends, of at least ``max(MIN_LENGTH, EXPONENT * q)``
words. ``SquareCatcher`` takes words as they are appended. At level k every completed
block of ``m = 2**k`` words is a catcher for the periods m .. 2m - 1: the window of m
words that begins p words after the block's begin is compared with the block, so each
appended word advances one comparison a level and ``n`` words cost ``n log n``
comparisons. An equal window is a square of period p; squares of neighbouring blocks
with one period belong to one run and are merged, the first of them is extended word by
word to both sides (exactly), and a run that reaches the last word grows with the
next appended words.

Why every run is caught: a run of period q in [m, 2m) and three periods or more holds a
whole block that begins at most m - 1 words after the run, and that block's window q
words on lies in the run too. Windows are compared by a rolling hash of 64 bits, so an equal pair is
never missed; the extension compares words, so an unequal pair never passes. A period
that is a multiple of the smallest one lies inside a run of a lower level and is dropped.

A task reads its texts in slices of ``SLICE_BYTES``; the texts of a slice run through one
catcher, separated by words that occur once, so that no run crosses texts. A longer text
has a slice for itself and is appended in pieces of ``PIECE`` words. Texts are never
gathered or shuffled: memory per task is the slice's, time a text's length times its logarithm.

Edge cases: a null text has no words (no runs, empty collapsed text), as an empty one or one of
white space; repeated rows and ids give one result each; of runs nothing is dropped or capped,
equally long ones are all listed by start and period; an empty table gives an empty result. Other columns
are kept as they are; a column named like the result (``out``) is replaced.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_LENGTH = 6
EXPONENT = 4
SLICE_BYTES = 4 << 20
PIECE = 1 << 20
#: An odd factor of the rolling hash and its inverse modulo 2^64.
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)

RESULT = "struct<n_words:bigint,runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"
_RUNS = pa.struct([pa.field(name, pa.int64()) for name in ("start", "length", "period")])


def _scattered(words: np.ndarray) -> np.ndarray:
    """Word numbers as 64-bit values whose sums rarely agree by chance."""
    x = words.astype(np.uint64) + np.uint64(_FACTOR)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, first: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = pow(base, first, 1 << 64)
    return np.cumprod(out, dtype=np.uint64)


class SquareCatcher:
    """Runs of a growing sequence of word numbers. ``longest`` bounds the length of a
    run if it is known (texts of a slice), which bounds the levels."""

    def __init__(self, min_length: int = MIN_LENGTH, exponent: int = EXPONENT, longest: int | None = None):
        if exponent < 3:
            raise ValueError("blocks catch runs of three periods or more")
        self.min_length, self.exponent, self.longest = min_length, exponent, longest
        self._words = np.empty(0, dtype=np.int64)
        self._sums = np.zeros(1, dtype=np.uint64)
        self._unscale = np.empty(0, dtype=np.uint64)
        self._next: list[int] = []           # by level: begin of the next window to compare
        self._waiting: list[np.ndarray] = []  # by level: squares whose run may still become long enough
        self._found: list[list[list[int]]] = []  # by level: [start, end, period]

    def append(self, words: np.ndarray) -> None:
        """Take the next words; runs that reach the last word stay open."""
        old, n = len(self._words), len(self._words) + len(words)
        self._words = np.concatenate((self._words, words.astype(np.int64)))
        scaled = _scattered(words) * _powers(_FACTOR, old, len(words))
        self._sums = np.concatenate((self._sums, self._sums[-1] + np.cumsum(scaled, dtype=np.uint64)))
        self._unscale = np.concatenate((self._unscale, _powers(_INVERSE, old, len(words))))
        for runs in self._found:
            for run in runs:
                if run[1] == old:
                    run[1] += self._equal_after(run[1] - run[2], run[2])
        level, bound = 0, n if self.longest is None else min(n, self.longest)
        while self.exponent << level <= bound:
            if level == len(self._next):
                self._next.append(1 << level)
                self._waiting.append(np.empty((0, 2), dtype=np.int64))
                self._found.append([])
            squares = np.concatenate((self._waiting[level], self._catch(level)))
            if len(squares):
                self._merge(level, squares)
            level += 1

    def runs(self) -> np.ndarray:
        """(start, length, period) of every run so far, by start, then period."""
        rows = sorted((start, end - start, period) for runs in self._found for start, end, period in runs)
        return np.array(rows, dtype=np.int64).reshape(-1, 3)

    def _window(self, begin, size):
        return (self._sums[begin + size] - self._sums[begin]) * self._unscale[begin]

    def _catch(self, level: int) -> np.ndarray:
        """(block begin, period) of the windows that completed since the last call
        and equal the block before theirs."""
        m = 1 << level
        first, last = self._next[level], len(self._words) - m + 1
        if last <= first:
            return np.empty((0, 2), dtype=np.int64)
        self._next[level] = last
        windows = (self._sums[first + m:last + m] - self._sums[first:last]) * self._unscale[first:last]
        blocks = np.arange(first // m - 1, (last - 1) // m) * m
        begin = first - m - blocks[0]
        hits = np.flatnonzero(windows == np.repeat(self._window(blocks, m), m)[begin:begin + len(windows)]) + first
        block = (hits // m - 1) * m
        return np.stack((block, hits - block), axis=1)

    def _merge(self, level: int, squares: np.ndarray) -> None:
        m, n = 1 << level, len(self._words)
        block, period = squares.T
        # what the first whole block of a run must match on after it, if the run is long enough
        match = np.maximum(self.min_length, self.exponent * period) - period - m + 1
        ready = block + period + match <= n
        self._waiting[level] = squares[~ready]
        block, period, match = block[ready], period[ready], match[ready]
        full = self._window(block, match) == self._window(block + period, match)
        block, period = block[full], period[full]
        lower = sorted((start, end) for runs in self._found[:level] for start, end, _ in runs)
        if lower and len(block):
            starts, ends = np.array(lower).T
            at = np.searchsorted(starts, block, "right")
            reach = np.concatenate(([-1], np.maximum.accumulate(ends)))[at]
            block, period = block[reach < block + period + m], period[reach < block + period + m]
        order = np.lexsort((block, period))
        block, period = block[order], period[order]
        for group in np.split(np.arange(len(block)), np.flatnonzero(np.diff(period)) + 1):
            if len(group):
                self._extend(level, int(period[group[0]]), block[group])

    def _extend(self, level: int, period: int, blocks: np.ndarray) -> None:
        """Add the runs of one period that hold the squares of ``blocks`` (ascending)."""
        m, at = 1 << level, 0
        known = sorted(run for run in self._found[level] if run[2] == period)
        while at < len(blocks):
            block = int(blocks[at])
            place = bisect_right(known, block, key=itemgetter(0))
            run = known[place - 1] if place else None
            if run is None or run[1] < block + period + m:
                run = None
                start = block - self._equal_before(block, period)
                end = block + period + self._equal_after(block, period)
                if end - start >= max(self.min_length, self.exponent * period):
                    run = [start, end, period]
                    self._found[level].append(run)
                elif end == len(self._words):  # may grow with the next words
                    self._waiting[level] = np.concatenate((self._waiting[level], [[block, period]]))
            at = at + 1 if run is None else max(at + 1, int(np.searchsorted(blocks, run[1] - period - m, "right")))

    def _equal_after(self, begin: int, period: int) -> int:
        """How many words from ``begin`` on equal those ``period`` later."""
        words, at, step, n = self._words, begin, 64, len(self._words)
        while at + period < n:
            size = min(step, n - at - period)
            differ = words[at:at + size] != words[at + period:at + period + size]
            if differ.any():
                return at - begin + int(differ.argmax())
            at, step = at + size, min(step * 2, 1 << 16)
        return at - begin

    def _equal_before(self, begin: int, period: int) -> int:
        words, at, step = self._words, begin, 64
        while at > 0:
            size = min(step, at)
            differ = (words[at - size:at] != words[at - size + period:at + period])[::-1]
            if differ.any():
                return begin - at + int(differ.argmax())
            at, step = at - size, min(step * 2, 1 << 16)
        return begin


def _slices(texts: list[bytes]) -> Iterator[list[bytes]]:
    batch: list[bytes] = []
    size = 0
    for text in texts:
        if batch and size + len(text) > SLICE_BYTES:
            yield batch
            batch, size = [], 0
        batch.append(text)
        size += len(text)
    if batch:
        yield batch


def _slice_runs(texts: list[bytes], min_length: int, exponent: int) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """(number of words, runs, kept words joined by a space) of each text of a slice."""
    split = [text.split() for text in texts]  # bytes split at 0x20 and 0x09 to 0x0D only
    numbers: dict[bytes, int] = {}
    catcher = SquareCatcher(min_length, exponent, max(map(len, split)))
    begins, n = [], 0
    row: list[int] = []
    for i, words in enumerate(split):
        begins.append(n)
        n += len(words) + 1
        for at in range(0, len(words), PIECE):
            row.extend(numbers.setdefault(w, len(numbers)) for w in words[at:at + PIECE])
            if len(row) >= PIECE:
                catcher.append(np.array(row, dtype=np.int64))
                row = []
        row.append(-1 - i)
    catcher.append(np.array(row, dtype=np.int64))
    runs = catcher.runs()
    bounds = np.searchsorted(runs[:, 0], [*begins, n])
    for i, words in enumerate(split):
        own = runs[bounds[i]:bounds[i + 1]] - (begins[i], 0, 0)
        if len(own):
            keep = np.ones(len(words), dtype=bool)
            for start, length, period in own:
                keep[start + period:start + length] = False
            yield len(words), own, b" ".join(words[j] for j in np.flatnonzero(keep))
        else:
            yield len(words), own, b" ".join(words)


def find_runs(docs: DataFrame, text: str = "text", out: str = "repeats", min_length: int = MIN_LENGTH,
              exponent: int = EXPONENT) -> DataFrame:
    """``docs`` with ``out``: the text's number of words, its runs (start word, length,
    period) by start and period, and the text without the words that a run holds after its first period."""

    @F.arrow_udf(RESULT)
    def runs_of(texts: pa.Array) -> pa.Array:
        counts, lengths, found, collapsed = [], [0], [], []
        for batch in _slices(texts.fill_null("").cast(pa.large_binary()).to_pylist()):
            for n_words, runs, kept in _slice_runs(batch, min_length, exponent):
                counts.append(n_words)
                lengths.append(lengths[-1] + len(runs))
                found.append(runs)
                collapsed.append(kept)
        flat = np.concatenate(found) if found else np.empty((0, 3), dtype=np.int64)
        rows = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(_RUNS))
        return pa.StructArray.from_arrays(
            [pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), rows),
             pa.array(collapsed, pa.binary()).cast(pa.string())], names=["n_words", "runs", "collapsed"])

    return docs.withColumn(out, runs_of(F.col(text)))
