"""Periodic runs of words by block convolution.

The words of many texts become one array of numbers, a separator of its own between any two texts. At each
scale B = 1, 2, 4, ... the array is cut into blocks of B words. The squared differences between a block and
the following window, at distances B to 2B - 1, come from one exact integer convolution (a number-theoretic
transform modulo a prime): a zero is an occurrence without mismatch. A run of period q with B <= q < 2B and at
least 4q words holds a whole block that occurs again q words on, so each run is seeded by a distance; the
seed is extended word by word in both directions, which also throws out sums that are only a multiple of the
prime. Blocks with a word that does not come back at such a distance cannot match and are not transformed.

Defined results: null, empty and blank texts have no words and no runs, and collapse to ''; texts of any length
are searched whole; repeated rows get equal results; the kept columns are in ``row``, so that no name
clashes; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

LEAST_WORDS, LEAST_PERIODS = 6, 4
PRIME, GENERATOR = 15 * 2**27 + 1, 31  # transforms of up to 2^27 terms; products stay below 2^62
MOST_TERMS = 1 << 20  # of one batch of transforms
SLICE_BYTES = 4 << 20  # of texts searched together; a longer text is searched alone
RUN = "struct<start:bigint,length:bigint,period:bigint>"
_RUN_ARROW = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _powers(base: int, count: int) -> np.ndarray:
    """``base ** 0 ... base ** (count - 1)`` modulo the prime, by doubling."""
    out = np.ones(count, dtype=np.int64)
    done, step = 1, base
    while done < count:
        more = min(done, count - done)
        out[done:done + more] = out[:more] * step % PRIME
        done, step = done + more, step * step % PRIME
    return out


class Transform:
    """Number-theoretic transforms of the rows of a matrix, ``size`` terms each (a power of two)."""

    def __init__(self, size: int):
        self.size = size
        root = pow(GENERATOR, (PRIME - 1) // size, PRIME)
        self._forward, self._back = _powers(root, size // 2), _powers(pow(root, PRIME - 2, PRIME), size // 2)
        self._scale = pow(size, PRIME - 2, PRIME)

    def forward(self, rows: np.ndarray) -> np.ndarray:
        """Terms in bit-reversed order, which ``back`` takes."""
        half = self.size // 2
        while half:
            pairs = rows.reshape(len(rows), -1, 2, half)
            first, second = pairs[:, :, 0], pairs[:, :, 1]
            rows = np.empty_like(pairs)
            rows[:, :, 0] = (first + second) % PRIME
            rows[:, :, 1] = (first - second) % PRIME * self._forward[::self.size // 2 // half] % PRIME
            half //= 2
        return rows.reshape(-1, self.size)

    def back(self, rows: np.ndarray) -> np.ndarray:
        half = 1
        while half < self.size:
            pairs = rows.reshape(len(rows), -1, 2, half)
            first, second = pairs[:, :, 0], pairs[:, :, 1] * self._back[::self.size // 2 // half] % PRIME
            rows = np.empty_like(pairs)
            rows[:, :, 0] = (first + second) % PRIME
            rows[:, :, 1] = (first - second) % PRIME
            half *= 2
        return rows.reshape(-1, self.size) * self._scale % PRIME


class Words:
    """The words of several texts as numbers from 1; the separators have numbers above all words."""

    def __init__(self, texts: list[list[bytes]]):
        known: dict[bytes, int] = {}
        codes: list[int] = []
        self.first = []
        gaps = []
        for words in texts:
            self.first.append(len(codes))
            codes += [known.setdefault(word, len(known) + 1) for word in words]
            gaps.append(len(codes))
            codes.append(0)
        self.codes = np.array(codes, dtype=np.int64)
        self.codes[gaps] = len(known) + 1 + np.arange(len(gaps))
        self.longest = max(map(len, texts), default=0)
        self._keys = np.sort(self.codes << 32 | np.arange(len(codes)))
        squares = self.codes * self.codes % PRIME
        self._squares = np.concatenate([[0], np.cumsum(squares)])

    def _comes_back(self, at: np.ndarray, block: int) -> np.ndarray:
        """Whether the word at each position comes again at a distance of ``block`` to ``2 * block - 1``."""
        low = (self.codes[at] << 32) + at + block
        found = np.searchsorted(self._keys, low)
        next_one = self._keys[np.minimum(found, len(self._keys) - 1)]
        return (found < len(self._keys)) & (next_one < low + block)

    def candidates(self, block: int) -> np.ndarray:
        """Starts of blocks all of whose words come back at a distance of this scale."""
        starts = np.arange(0, len(self.codes) - block + 1, block)
        for offset in dict.fromkeys((0, block // 2, block - 1)):
            starts = starts[self._comes_back(starts + offset, block)]
        out = []
        rows = max(1, MOST_TERMS // block)
        for at in range(0, len(starts), rows):
            some = starts[at:at + rows]
            every = (some[:, None] + np.arange(block)).ravel()
            out.append(some[self._comes_back(every, block).reshape(-1, block).all(axis=1)])
        return np.concatenate(out) if out else starts

    def seeds(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Block starts and the distances at which the blocks seem to occur again."""
        starts = self.candidates(block)
        if not len(starts):
            return starts, starts
        size, n = 2 * block, len(self.codes)
        transform = Transform(size)
        found_at, found_by = [], []
        rows = max(1, MOST_TERMS // size)
        for at in range(0, len(starts), rows):
            some = starts[at:at + rows]
            blocks = np.zeros((len(some), size), dtype=np.int64)
            blocks[:, :block] = self.codes[some[:, None] + np.arange(block)][:, ::-1]
            where = some[:, None] + np.arange(block, block + size - 1)
            windows = np.zeros((len(some), size), dtype=np.int64)
            # Beyond the end stands a number that no word has.
            windows[:, :-1] = np.where(where < n, self.codes[np.minimum(where, n - 1)], PRIME - 1)
            products = transform.back(transform.forward(blocks) * transform.forward(windows) % PRIME)[:, block - 1:size - 1]
            after = some[:, None] + np.arange(block, 2 * block)
            inside = after + block <= n
            upto = np.minimum(after + block, n)
            own = self._squares[some + block] - self._squares[some]
            differences = own[:, None] + self._squares[upto] - self._squares[np.minimum(after, n)] - 2 * products
            row, distance = np.nonzero(inside & (differences % PRIME == 0))
            found_at.append(some[row])
            found_by.append(distance + block)
        return np.concatenate(found_at), np.concatenate(found_by)

    def _equal_from(self, at: int, period: int) -> int:
        """First position from ``at`` on whose word differs from the one ``period`` further."""
        codes, size = self.codes, 16
        while True:
            later = codes[at + period:at + period + size]
            different = codes[at:at + len(later)] != later
            if different.any():
                return at + int(different.argmax())
            if len(later) < size:
                return at + len(later)
            at, size = at + size, min(4 * size, 1 << 16)

    def _equal_until(self, at: int, period: int) -> int:
        """Last position before which words differ: from there to ``at`` they equal those ``period`` further."""
        codes, size = self.codes, 16
        while at:
            low = max(0, at - size)
            different = codes[low:at] != codes[low + period:at + period]
            if different.any():
                return at - int(different[::-1].argmax())
            at, size = low, min(4 * size, 1 << 16)
        return 0

    def runs(self) -> list[tuple[int, int, int]]:
        """``(start, end, period)`` of all runs in the array, in no order."""
        found: dict[tuple[int, int], int] = {}
        block = 1
        while LEAST_PERIODS * block <= self.longest:
            at, by = self._unexplained(*self.seeds(block), block, found)
            start = end = period = -1
            for x, q in zip(at.tolist(), by.tolist()):
                if q == period and start <= x and x + q + block <= end:
                    continue
                stop = self._equal_from(x, q)
                if stop - x < block:
                    continue  # a multiple of the prime
                start, end, period = self._equal_until(x, q), stop + q, q
                if end - start >= max(LEAST_WORDS, LEAST_PERIODS * q):
                    found.setdefault((start, end), q)
            block *= 2
        return [(start, end, period) for (start, end), period in found.items()]

    @staticmethod
    def _unexplained(at: np.ndarray, by: np.ndarray, block: int, found: dict[tuple[int, int], int]) -> tuple[np.ndarray, np.ndarray]:
        """The seeds by distance and place, but for those inside a run whose period divides the distance.

        Such a seed extends to that same run, whose smallest period is known.
        """
        order = np.argsort(at, kind="stable")
        at, by = at[order], by[order]
        new = np.ones(len(at), dtype=bool)
        for (start, end), period in found.items():
            if end - start >= 2 * block:
                low, high = np.searchsorted(at, (start, end))
                inside = slice(low, high)
                new[inside] &= (at[inside] + by[inside] + block > end) | (by[inside] % period != 0)
        at, by = at[new], by[new]
        order = np.lexsort((at, by))
        return at[order], by[order]


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """``(start, length, period)`` of the runs of each text, by start, then period."""
    words = Words(texts)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if words.longest >= LEAST_WORDS:
        first = np.array(words.first)
        for start, end, period in words.runs():
            text = int(np.searchsorted(first, start, side="right")) - 1
            out[text].append((start - words.first[text], end - start, period))
    return [sorted(runs, key=lambda run: (run[0], run[2])) for runs in out]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run repeats, joined by one space."""
    if runs:
        edges = np.zeros(len(words) + 1, dtype=np.int64)
        for start, length, period in runs:
            edges[start + period] += 1
            edges[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]
    return b" ".join(words)


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of most periods; of equal ones that of smallest start, then period."""
    return min(runs, key=lambda run: (-Fraction(run[1], run[2]), run[0], run[2]), default=None)


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, list[str]]]:
    """First row and texts of stretches of at most ``most`` characters, or of one text."""
    some, size, first = [], 0, 0
    for row, text in enumerate(texts):
        text = text.as_py() or ""
        if some and size + len(text) > most:
            yield first, some
            some, size, first = [], 0, row
        some.append(text)
        size += len(text)
    if some:
        yield first, some


def periodic_runs(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` (the columns, or those of ``keep``), ``runs``, ``strongest`` and ``collapsed`` per row.

    ``runs`` are by start, then period; ``strongest`` is null without runs.
    """
    row = F.struct(*[F.col(c) for c in (keep if keep is not None else docs.columns)]).alias("row")
    narrow = docs.select(row, F.col(text).cast("string").alias("text"))
    schema = StructType([narrow.schema["row"], *StructType.fromDDL(f"runs array<{RUN}>, strongest {RUN}, collapsed string").fields])

    def records(found):
        return [None if r is None else dict(zip(("start", "length", "period"), r)) for r in found]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column(1)):
                # bytes.split cuts at exactly the six ASCII blanks
                words = [text.encode().split() for text in texts]
                runs = runs_of(words)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(texts)),
                        pa.array([records(found) for found in runs], pa.list_(_RUN_ARROW)),
                        pa.array(records(map(strongest, runs)), _RUN_ARROW),
                        pa.array([collapsed(*pair).decode() for pair in zip(words, runs)], pa.string()),
                    ],
                    names=["row", "runs", "strongest", "collapsed"],
                )

    return narrow.mapInArrow(search, schema)
