"""Best-fit packing by length patterns and non-negative least squares.

Only the histogram of piece lengths (at most ``capacity`` numbers) reaches the driver. Patterns of few documents that
fill a sequence are enumerated, their repeat counts are fitted to the histogram by non-negative least squares and
rounded down, and what is left is packed best-fit, longest first, by counts. The plan is a table of intervals
"ranks lo..hi of length L go to sequences from s on, at offset o", so placing a document needs its rank within its
length and one look-up: no sequence is ever gathered in one task.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, texts, written
from .tokens import crc32, encoder, with_end

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, nth long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """Documents as ids, cut only where longer than ``capacity``. part and nth number the pieces of a length within
    their task, so ranks within a length need no gathering of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = encoder(tokenizer, False), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in slices(batches):
            ids, at = with_end(*enc.encode(b.column("text").to_pylist()), end_id)
            sizes = np.diff(at)
            cuts = -(-sizes // capacity)
            doc = np.repeat(np.arange(len(sizes)), cuts)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            length = np.minimum(capacity, sizes[doc] - piece * capacity)
            begin = at[doc] + piece * capacity
            order = np.argsort(length, kind="stable")
            first = np.searchsorted(length[order], length[order])
            nth = np.empty(len(doc), np.int64)
            nth[order] = seen[length[order]] + np.arange(len(doc)) - first
            np.add.at(seen, length, 1)
            out = {
                "doc_id": b.column("doc_id").take(pa.array(doc)).cast(pa.int64()), "piece": pa.array(piece, pa.int32()), "start": piece * capacity, "length": length,
                "ids_crc32": [crc32(ids[lo : lo + n]) for lo, n in zip(begin, length, strict=True)], "part": np.full(len(doc), part), "nth": nth,
            }
            if with_ids:
                out["ids"] = [ids[lo : lo + n].astype(np.int64) for lo, n in zip(begin, length, strict=True)]
            yield pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in out.items()})
        enc.rest()

    return texts(docs).mapInArrow(run, PIECES + ", ids array<long>" * with_ids)


def enumerate_patterns(hist: np.ndarray, most: int = 6, branches: int = 12) -> list[tuple[int, ...]]:
    """Patterns of up to ``most`` lengths, longest first. Each length is followed by the longest that fits and by up
    to ``branches`` others spread over those that fit; further places take the longest that still fits."""
    capacity = len(hist) - 1
    present = np.flatnonzero(hist)
    fits = np.searchsorted(present, np.arange(capacity + 1), side="right") - 1  # index of the longest that fits
    found = set()
    for a in present:
        firsts = {-1}
        top = fits[min(capacity - a, a)]
        if top >= 0:
            firsts |= set(np.linspace(0, top, branches).astype(int).tolist()) | {int(top)}
        for f in firsts:
            pattern, room = [int(a)], int(capacity - a)
            if f >= 0:
                pattern.append(int(present[f]))
                room -= pattern[-1]
            while len(pattern) < most and room > 0 and (i := fits[min(room, pattern[-1])]) >= 0:
                pattern.append(int(present[i]))
                room -= pattern[-1]
            found.add(tuple(pattern))
    return sorted(found)


def fit_counts(patterns: list[tuple[int, ...]], hist: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the squared error of A x against the histogram (accelerated projected
    gradient); A[l, p] is how often pattern p holds length l."""
    width = max(map(len, patterns))
    items = np.zeros((len(patterns), width), np.int64)
    for i, p in enumerate(patterns):
        items[i, : len(p)] = p
    used = items > 0
    h = hist.astype(float).copy()
    h[0] = 0
    forward = lambda x: np.bincount(items.ravel(), np.repeat(x, width) * used.ravel(), len(h))
    back = lambda r: (r[items] * used).sum(axis=1)
    v = np.ones(len(patterns))
    for _ in range(30):  # the largest eigenvalue of A'A
        v = back(forward(v))
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        nxt = np.maximum(0, y - back(forward(y) - h) / (1.05 * top))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = nxt + (t - 1) / t2 * (nxt - x)
        x, t = nxt, t2
    return x


def plan_sequences(hist: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences), covering the histogram exactly."""
    hist = np.asarray(hist, np.int64).copy()
    hist[0] = 0
    capacity = len(hist) - 1
    classes: list[tuple[tuple[int, ...], int]] = []
    left = hist.copy()
    if hist[capacity]:
        classes.append(((capacity,), int(hist[capacity])))
        left[capacity] = 0
    if left.any():
        patterns = enumerate_patterns(left)
        counts = fit_counts(patterns, left)
        for i in np.argsort(-counts, kind="stable"):
            p = patterns[i]
            n = int(counts[i] + 1e-9)
            if n < 1:
                break
            n = min([n, *(int(left[v]) // p.count(v) for v in set(p))])
            if n > 0 and sum(p) >= capacity - 2:  # only patterns that fill their sequence; the others go to the residual
                for v in p:
                    left[v] -= n
                classes.append((p, n))
    rooms: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for p, n in classes:
        rooms[capacity - sum(p)].append((p, n))
    for v in range(capacity, 0, -1):
        room = v
        while left[v] and room < capacity:
            if not rooms.get(room):
                room += 1
                continue
            p, n = rooms[room].pop()
            # As many copies into a sequence as fit, but no more sequences than needed.
            k = min(room // v, int(left[v]))
            take = min(n, int(left[v]) // k)
            if take < n:
                rooms[room].append((p, n - take))
            rooms[room - k * v].append((p + (v,) * k, take))
            left[v] -= k * take
        if left[v]:
            k = capacity // v
            full, rest = divmod(int(left[v]), k)
            if full:
                rooms[capacity - k * v].append(((v,) * k, full))
            if rest:
                rooms[capacity - rest * v].append(((v,) * rest, 1))
            left[v] = 0
    return [c for r in sorted(rooms) for c in rooms[r]]


def intervals(plan: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[str, np.ndarray]:
    """Per length and rank range: first rank, first sequence, copies in a sequence, offset of the first copy."""
    rows, given, first = [], np.zeros(capacity + 1, np.int64), 0
    for p, n in plan:
        at = 0
        for v in sorted(set(p), reverse=True):
            m = p.count(v)
            rows.append((v, given[v], first, m, at))
            given[v] += m * n
            at += m * v
        first += n
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "lo", "first", "copies", "at"), cols, strict=True))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A null or empty text is its end id alone. Repeated rows are packed as often as they occur. Order within a length
    is the order of the tasks that read it. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer, capacity, end_id, with_ids), "pieces")
    by_part = cut.groupBy("part", "length").count()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_part = written(by_part.withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))), "piece-counts")
    hist = np.zeros(capacity + 1, np.int64)
    for r in by_part.groupBy("length").agg(F.sum("count").alias("n")).collect():  # at most ``capacity`` rows
        hist[r["length"]] = r["n"]
    t = intervals(plan_sequences(hist), capacity)
    keys = t["length"] << 44 | t["lo"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (np.asarray(b.column(c)) for c in ("length", "rank"))
            i = np.searchsorted(keys, length << 44 | rank, side="right") - 1
            j = rank - t["lo"][i]
            seq, off = t["first"][i] + j // t["copies"][i], t["at"][i] + j % t["copies"][i] * length
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    # The bases grow with the number of tasks: joined by sorting, never broadcast.
    ranked = cut.join(by_part.select("part", "length", "base").hint("merge"), ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids + ", sequence_id long, offset long"
    return ranked.select(*names, "rank").mapInArrow(place, schema)
