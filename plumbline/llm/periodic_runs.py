"""Periodic runs of words, found by block convolution with an exact number-theoretic transform."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import buffers

#: A run has this many words at least, and two periods.
MIN_LENGTH = 12
#: Any run repeats a string of so many words at its period's distance: MIN_LENGTH - q words for q <= 6, q words beyond.
GRAM = MIN_LENGTH // 2

#: 7 * 2^20 + 1 with primitive root 3: products of two residues, and sums of 64 of them, are exact in doubles.
PRIME = 7340033
ROOT = 3
#: Transforms up to this length are one product with a matrix, longer ones go by rows and columns.
DIRECT = 64
#: Blocks are convolved by at most so many of their first words; the walk from a seed checks the others.
LONGEST = 1 << 12
#: Numbers in the work arrays of one batch of blocks.
BATCH = 1 << 20

RESULT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, up to one PRIME too many or one too few by rounding."""
    return x - np.floor(x * (1.0 / PRIME)) * PRIME


@cache
def powers(size: int, inverse: bool) -> np.ndarray:
    """The powers 0 to size - 1 of a root of unity of order size."""
    root, out = pow(ROOT, (PRIME - 1) // size, PRIME), [1]
    if inverse:
        root = pow(root, PRIME - 2, PRIME)
    while len(out) < size:
        out.append(out[-1] * root % PRIME)
    return np.array(out, dtype=np.float64)


@cache
def matrix(rows: int, columns: int, size: int, inverse: bool) -> np.ndarray:
    return powers(size, inverse)[np.outer(np.arange(rows), np.arange(columns)) % size]


def transform(x: np.ndarray) -> np.ndarray:
    """The transform of each row, in an order that only untransform() knows."""
    size = x.shape[-1]
    if size <= DIRECT:
        return reduced(x @ matrix(size, size, size, False))
    columns = x.reshape(*x.shape[:-1], DIRECT, size // DIRECT)
    turned = reduced(reduced(matrix(DIRECT, DIRECT, DIRECT, False) @ columns) * matrix(DIRECT, size // DIRECT, size, False))
    return transform(turned).reshape(x.shape)


def untransform(x: np.ndarray) -> np.ndarray:
    """Undoes transform(), up to a factor of the size."""
    size = x.shape[-1]
    if size <= DIRECT:
        return reduced(x @ matrix(size, size, size, True))
    turned = untransform(x.reshape(*x.shape[:-1], DIRECT, size // DIRECT))
    return reduced(matrix(DIRECT, DIRECT, DIRECT, True) @ reduced(turned * matrix(DIRECT, size // DIRECT, size, True))).reshape(x.shape)


def correlations(blocks: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """For each row, the sums of blocks[i] * texts[i + d] modulo PRIME for each d up to where the block meets the end."""
    size, k = texts.shape[1], blocks.shape[1]
    turned = np.zeros(texts.shape)
    turned[:, 0] = blocks[:, 0]
    turned[:, size - k + 1 :] = blocks[:, :0:-1]
    sums = untransform(reduced(transform(turned) * transform(texts)))[:, : size - k + 1]
    return reduced(reduced(sums) * pow(size, PRIME - 2, PRIME))


def occurrences(w: np.ndarray, starts: np.ndarray, k: int, lags: int) -> tuple[np.ndarray, np.ndarray]:
    """The places (of starts) and distances 1 .. lags at which the k words from there on occur again.

    The sum of squared differences to the words at a distance is zero, modulo PRIME, wherever they are equal. The
    other way round holds but for a chance of 1 in PRIME, which the walk from the seed finds out.
    """
    size = 1 << max(3, (lags + k - 1).bit_length())
    if k == LONGEST:
        size = min(size, 8 * k)
    found_at, found_d = [], []
    squares = (w * w) % PRIME
    sums = np.concatenate([[0], np.cumsum(squares)])
    value = (w % PRIME).astype(np.float64)
    span, dealt = size - k + 1, max(1, BATCH // size)
    for low in range(1, lags + 1, span):
        width = min(span, lags - low + 1)
        for first in range(0, len(starts), dealt):
            at = starts[first : first + dealt]
            at = at[at + low + k <= len(w)]
            if not len(at):
                continue
            here = at[:, None] + np.arange(k)
            there = at[:, None] + low + np.arange(size)
            texts = np.where(there < len(w), value[np.minimum(there, len(w) - 1)], 0.0)
            begin = at[:, None] + low + np.arange(width)
            inside = begin + k <= len(w)
            begin = np.minimum(begin, len(w) - k)
            own = sums[at + k] - sums[at]
            total = (own[:, None] + sums[begin + k] - sums[begin]) - 2 * correlations(value[here], texts)[:, :width].astype(np.int64)
            block, lag = np.nonzero((total % PRIME == 0) & inside)
            found_at.append(at[block])
            found_d.append(lag + low)
    if not found_at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_at), np.concatenate(found_d)


class Stretches:
    """Maximal stretches of words that are equal to those at a distance; each is walked once."""

    def __init__(self, w: np.ndarray):
        self.w, self.known = w, {}

    def ahead(self, i: int, d: int) -> int:
        w, limit, step = self.w, len(self.w) - d, 64
        while i < limit:
            j = min(i + step, limit)
            unequal = w[i:j] != w[i + d : j + d]
            if unequal.any():
                return i + int(unequal.argmax())
            i, step = j, 2 * step
        return limit

    def behind(self, i: int, d: int) -> int:
        w, step = self.w, 64
        while i > 0:
            j = max(0, i - step)
            unequal = w[j:i] != w[j + d : i + d]
            if unequal.any():
                return i - int(unequal[::-1].argmax())
            i, step = j, 2 * step
        return 0

    def ends(self, at: np.ndarray, d: np.ndarray) -> np.ndarray:
        """For each seed the end of its stretch, which is put down; of a false seed its own place."""
        out, order = np.empty(len(at), np.int64), np.lexsort((at, d))
        end, distance = -1, -1
        for k, i, of in zip(order.tolist(), at[order].tolist(), d[order].tolist(), strict=True):
            if of != distance or i >= end:
                distance, mine = of, self.known.setdefault(of, {})
                end = self.ahead(i, of)
                if end > i:
                    mine[self.behind(i, of)] = end
            out[k] = end
        return out


def near_repeats(w: np.ndarray) -> np.ndarray:
    """For each GRAM words the distance to the next equal ones, a very large one if there are none.

    Equal words have equal hashes; if unequal ones have too, the block there is looked at for nothing.
    """
    n = len(w) - GRAM + 1
    hashes = np.zeros(n, dtype=np.uint64)
    for k in range(GRAM):
        hashes = (hashes ^ w[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        hashes ^= hashes >> np.uint64(29)
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    out = np.full(n, 1 << 60, dtype=np.int64)
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def runs_of(w: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs of a sequence of small numbers that stand for words, as sorted (start, length, period).

    A run of period q and length l is a stretch of m = l - q words that equal those q further on. With L the largest
    power of two for which 2 * L - 1 <= m, a block of L words that begins at a multiple of L lies within, and as q <= m
    (or, for q < 6, m > 6), q is at most 4 * L - 2. So at each such scale each block is sought in the 4 * L - 2 places
    after its own; each distance found is a seed, which is walked to both sides. Blocks that can't be in a run, as
    their strings of GRAM words don't return within this distance, are passed over. Where a block of period d <= L / 2
    goes on with this period, multiples of d within are no periods of other runs.
    """
    n = len(w)
    if n < MIN_LENGTH:
        return []
    near = near_repeats(w)
    if near.min() == 1 << 60:
        return []
    stretches, length = Stretches(w), 2
    while 2 * length - 1 < n:
        lags, k = 4 * length - 2, min(length, LONGEST)
        starts = np.arange(0, n - length, length)
        good = np.concatenate([[0], np.cumsum(near <= lags)])
        if length >= GRAM:
            starts = starts[good[starts + length - GRAM + 1] - good[starts] == length - GRAM + 1]
        else:
            starts = starts[good[np.minimum(starts + 1, len(near))] - good[np.clip(starts + length - GRAM, 0, len(near))] > 0]
        at, d = occurrences(w, starts, k, lags)
        if len(at):
            order = np.lexsort((d, at))
            at, d = at[order], d[order]
            first = np.concatenate([[True], at[1:] != at[:-1]])
            tight = first & (d <= k // 2)
            ends = stretches.ends(at[tight], d[tight])
            group = np.cumsum(first) - 1
            step, until = np.zeros(group[-1] + 1, np.int64), np.zeros(group[-1] + 1, np.int64)
            step[group[tight]], until[group[tight]] = d[tight], ends + d[tight]
            step, until = step[group], until[group]
            again = (step > 0) & (d % np.maximum(step, 1) == 0) & (at + d + k <= until)
            rest = ~tight & ~again
            stretches.ends(at[rest], d[rest])
        length *= 2
    best: dict[tuple[int, int], int] = {}
    for d, found in stretches.known.items():
        for start, end in found.items():
            if end - start >= max(MIN_LENGTH - d, d):
                best[start, end + d] = min(d, best.get((start, end + d), d))
    return sorted((start, end - start, d) for (start, end), d in best.items())


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay: those in no run after its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def numbered(words: list[bytes]) -> np.ndarray:
    """For each word the place of the first equal one."""
    return np.fromiter(map({}.setdefault, words, count()), np.int64, len(words))


def digests(words: list[bytes]) -> tuple:
    """The columns of RESULT after doc_id."""
    runs = runs_of(numbered(words)) if len(words) >= MIN_LENGTH else []
    if not runs:
        return (0, None, None, None, None, hashlib.sha256().hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest())
    start, length, period = max(runs, key=lambda r: (r[1], -r[0], -r[2]))
    listed = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2]))).encode()).hexdigest()
    keep = kept_words(len(words), runs)
    return (len(runs), start, length, period, 1000 * length // period, listed, hashlib.sha256(b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k])).hexdigest())


def texts_of(column: pa.Array) -> Iterator[bytes]:
    data, at = buffers(column)
    for i in range(len(at) - 1):
        yield data[at[i] : at[i + 1]].tobytes()


def run_digests(docs: DataFrame, prepare=lambda doc_id, words: words) -> DataFrame:
    """One row per row of docs: RESULT, over the words (runs of bytes other than 0x20, 0x09 to 0x0D) of its whole text.

    prepare(doc_id, words) may change the words before. A null or empty text has no words, no runs, and the digests of
    nothing; four columns of its longest run are null then. Repeated rows are alike, a null doc_id stays null. Of runs of
    equal length that of least start, then least period, counts as longest. An empty table gives no rows. Extra columns of
    docs don't matter. Nothing is shuffled: a text's runs are found where the text is read.
    """

    def found(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            # bytes.split() splits at 0x20 and 0x09 to 0x0D
            rows = [digests(prepare(i, text.split())) for i, text in zip(ids, texts_of(batch.column("text")), strict=True)]
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], [f.split()[0] for f in RESULT.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(found, RESULT)
