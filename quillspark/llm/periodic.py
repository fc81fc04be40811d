"""Periodic runs of words, found on harmonic grids.

A run of period p with three periods or more holds two neighbouring places of the grid 0, p, 2p, ... at which a word
equals the word p places on. All grids together have n * (1 + 1/2 + 1/3 + ...) places, so testing words there is cheap;
what passes is probed between the grid places and extended both ways by comparing arrays in growing pieces. Places
within a run that is already known are skipped: if a run's period q divides p, whatever has period p there is that run.

A document is one row and is worked on alone, so there is no shuffle; memory follows its own words.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, texts

OUT = "doc_id long, runs array<struct<start:long,length:long,period:long>>, strongest struct<start:long,length:long,period:long>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(_RUN)), ("strongest", _RUN), ("collapsed", pa.string())])

#: Grids of periods up to so many (or the root of n) are tested one period at a time, others one grid place at a time.
SINGLE = 32
#: Words of the first piece compared when a place is extended, and of the largest.
PIECE, LARGEST = 32, 1 << 16


def agreement(w: np.ndarray, i: int, p: int) -> tuple[int, int]:
    """The widest [s, t) around i in which w[x] == w[x + p]."""
    n, t, s = len(w) - p, i, i
    piece = PIECE
    while t < n:
        same = w[t : min(t + piece, n)] == w[t + p : min(t + piece, n) + p]
        if not same.all():
            t += int(same.argmin())
            break
        t, piece = t + len(same), min(2 * piece, LARGEST)
    piece = PIECE
    while s > 0:
        lo = max(0, s - piece)
        same = (w[lo:s] == w[lo + p : s + p])[::-1]
        if not same.all():
            s -= int(same.argmin())
            break
        s, piece = lo, min(2 * piece, LARGEST)
    return s, t


def _one_period(w: np.ndarray, p: int, least: int, exponent: int) -> np.ndarray:
    """Grid places of period p from which as many tests in a row hold as any run passes."""
    grid = w[::p]
    same = grid[:-1] == grid[1:]
    k = (max(least, exponent * p) - p) // p
    if len(same) < k:
        return np.zeros(0, np.int64)
    if k == 2:
        good = same[:-1] & same[1:]
    else:
        c = np.concatenate([[0], np.cumsum(same)])
        good = c[k:] - c[:-k] == k
    return np.flatnonzero(good) * p


def _many_periods(w: np.ndarray, lo: int, hi: int, tests: int) -> tuple[np.ndarray, np.ndarray]:
    """Periods and grid places of lo <= p < hi at which ``tests`` tests in a row hold, by period, then place."""
    n, periods, places = len(w), [], []
    for j in range(n // lo):
        top = min(hi, (n - 1) // (j + tests) + 1)
        if top <= lo:
            break
        good = np.ones(top - lo, bool)
        for m in range(j, j + tests):  # words at m * p, for all p at once
            here = w[m * lo : m * (top - 1) + 1 : m] if m else w[:1]
            good &= here == w[(m + 1) * lo : (m + 1) * (top - 1) + 1 : m + 1]
        p = np.flatnonzero(good) + lo
        periods.append(p)
        places.append(p * j)
    if not periods:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    p, i = np.concatenate(periods), np.concatenate(places)
    order = np.lexsort((i, p))
    return p[order], i[order]


class _Runs:
    """Runs found so far, by period."""

    def __init__(self, w: np.ndarray, least: int, exponent: int):
        self.w, self.least, self.exponent = w, least, exponent
        self.found: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, p: int, places: np.ndarray) -> None:
        """Extend what the grid of period p lets pass; periods come in ascending order."""
        for q, (starts, ends) in self.found.items():
            if p % q == 0 and len(places):
                k = np.searchsorted(starts, places, "right") - 1
                places = places[(k < 0) | (places + p >= ends[k])]
        if len(places) > 1:  # probes between the grid places; a run covers the stretch up to the next one
            for d in {1, p // 4, p // 2, p - p // 4} - {0, p}:
                places = places[self.w[places + d] == self.w[places + d + p]]
        new = []
        while len(places):
            s, t = agreement(self.w, int(places[0]), p)
            if t + p - s >= max(self.least, self.exponent * p):
                new.append((s, t + p))
            places = places[np.searchsorted(places, t) :]
        if new:
            self.found[p] = tuple(np.array(x, np.int64) for x in zip(*new, strict=True))


def periodic_runs_of(w: np.ndarray, least: int = 24, exponent: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run of an array of word numbers, by start, then period. A run has its
    smallest period, ``exponent`` (3 or more) periods and ``least`` words."""
    if exponent < 3:
        raise ValueError("a run needs three periods at least")
    n, runs = len(w), _Runs(w, least, exponent)
    top = n // exponent if n >= least else 0
    single = min(top, max(SINGLE, least, int(n**0.5)))
    for p in range(1, single + 1):
        if len(places := _one_period(w, p, least, exponent)):
            runs.add(p, places)
    lo = single + 1
    while lo <= top:
        hi = min(2 * lo, top + 1)
        periods, places = _many_periods(w, lo, hi, exponent - 1)
        cuts = np.flatnonzero(np.diff(periods)) + 1
        for at, until in zip([0, *cuts], [*cuts, len(periods)], strict=True):
            if until > at:
                runs.add(int(periods[at]), places[at:until])
        lo = hi
    return sorted((int(s), int(e - s), p) for p, (starts, ends) in runs.found.items() for s, e in zip(starts, ends, strict=True))


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with most periods, exactly; then the smallest start, then period."""
    return max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words no run holds behind its first period."""
    edge = np.zeros(n + 1, np.int64)
    for s, length, p in runs:
        edge[s + p] += 1
        edge[s + length] -= 1
    return np.cumsum(edge[:-1]) == 0


def numbered(words: list) -> np.ndarray:
    known: dict = {}
    return np.fromiter((known.setdefault(x, len(known)) for x in words), np.int32, len(words))


def _dicts(runs) -> list[dict]:
    return [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs]


def _scan(least: int, exponent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            runs, best, rest = [], [], []
            for t in b.column("text").to_pylist():
                words = t.encode().split()  # bytes split at ASCII white space alone
                found = periodic_runs_of(numbered(words), least, exponent)
                keep = kept_words(len(words), found) if found else None
                runs.append(_dicts(found))
                best.append(_dicts([strongest(found)])[0] if found else None)
                rest.append(b" ".join(words if keep is None else [words[i] for i in np.flatnonzero(keep).tolist()]).decode())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(runs, _SCHEMA.field("runs").type), pa.array(best, _RUN), pa.array(rest, pa.string())], schema=_SCHEMA)

    return run


def periodic_runs(docs: DataFrame, least: int = 24, exponent: int = 3) -> DataFrame:
    """doc_id, runs, strongest (null: no run) and collapsed (the words that no run holds behind its first period, joined
    by a space) of every row of ``docs`` (doc_id, text).

    Words are separated by ASCII white space and compared byte by byte. A null or empty text has no words, no runs and
    an empty collapsed text; rows that repeat a doc_id, or have none, each give a row; other columns are not read. Of
    overlapping runs with different periods each is reported."""
    return texts(docs).mapInArrow(_scan(least, exponent), OUT)
