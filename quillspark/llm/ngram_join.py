"""Jaccard join on word shingles with signature trees.

Documents with equal shingle sets are one class. Two classes with a Jaccard similarity of t at least share one of the
first n - ceil(t*n) + 1 shingles of each under any common order (prefix filter), and k of the first n - ceil(t*n) + k.
The order here puts shingles last that a count sketch of fixed size finds in many documents. Prefix shingles meet in
shards by range of hash; there a class stays in a shingle's group only if its size and the shingle's place leave it a
possible partner, and on the whole only if it stays in the groups of k shingles. Groups with the same members are one.

Groups are joined by signature trees: nodes hold the OR of their members' token bitmaps and their range of sizes, and a
dual traversal drops node pairs whose maximum possible overlap is too small. Two rounds look within blocks of a group
and give every class two of its likeliest partners, verified on whole sets, so a group of near copies becomes one
component without its pairs being formed. The last round forms every pair that may still link two components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytegrams import BASE, LOWER, Hashes, mix, shingles, utf8, words
from .common import bucketed, dropped, freed, removed, shuffle_partitions, slices, texts, written
from .components import components
from .language_model import from_numbers, numbers, packed, unpacked

#: Counters of the sketch of shingle frequencies (2**SKETCH); documents from which on a counter's shingles are dealt by
#: class; bits of the filter of the documents whose sets are needed (2**FILTER).
SKETCH, HOT, FILTER = 22, 1 << 17, 26
#: Members of a block in the first rounds and in the last one; the largest signature class.
BLOCK_FIRST, BLOCK_LAST, WIDEST = 256, 512, 9
#: Pairs of members that are held at a time.
PAIRS = 1 << 18
BLOCK = 6 << 20
NO_ID = -(1 << 63)
SEEDS = [np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)]


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every text, ascending, and how many come before each text."""
    data, off = utf8(column)
    s, e, first = words(data, off)
    v, at = shingles(Hashes(LOWER[data]).of(s, e), first, k)
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        v[lo:hi].sort()
    keep = np.ones(len(v), bool)
    keep[1:] = v[1:] != v[:-1]
    keep[at[:-1][np.diff(at) > 0]] = True
    count = np.concatenate([[0], np.cumsum(keep)])
    return v[keep], count[at]


def reduced(ufunc, v: np.ndarray, at: np.ndarray, empty) -> np.ndarray:
    out = np.full(len(at) - 1, empty, v.dtype)
    some = np.diff(at) > 0
    if some.any():
        out[some] = ufunc.reduceat(v, at[:-1][some])
    return out


def class_ids(v: np.ndarray, at: np.ndarray) -> np.ndarray:
    """An identifier of each set, whatever its order."""
    return mix(reduced(np.add, mix(v ^ np.uint64(0x1D8E4E27C47D124F)), at, 0) + np.diff(at).astype(np.uint64) * np.uint64(BASE)).view(np.int64)


def _describe(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH, np.int32)
        names = ["doc_id", "n", "cid", "sketch"]
        for b in slices(batches):
            v, at = shingle_sets(b.column("text"), k)
            np.add.at(sketch, (v >> np.uint64(64 - SKETCH)).astype(np.int64), 1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(at)), pa.array(class_ids(v, at)), pa.nulls(b.num_rows, pa.binary())], names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([flattened(sketch)], pa.binary())], names)

    return run


def flattened(sketch: np.ndarray) -> bytes:
    """Counters byte by byte, compressed, after the bytes that each has."""
    wide = 4 if int(sketch.max()) < 1 << 32 else 8
    planes = np.empty((wide, len(sketch)), np.uint8)
    for lo in range(0, len(sketch), 1 << 18):
        planes[:, lo : lo + (1 << 18)] = sketch[lo : lo + (1 << 18)].astype(f"<u{wide}").view(np.uint8).reshape(-1, wide).T
    return bytes([wide]) + pa.compress(planes, codec="zstd", asbytes=True)


def added(total: np.ndarray, blob: bytes) -> None:
    """Add the counters of ``blob`` to ``total``."""
    wide = blob[0]
    planes = np.frombuffer(pa.decompress(memoryview(blob)[1:], decompressed_size=wide << SKETCH, codec="zstd"), np.uint8).reshape(wide, -1)
    for lo in range(0, len(total), 1 << 18):
        total[lo : lo + (1 << 18)] += np.ascontiguousarray(planes[:, lo : lo + (1 << 18)].T).view(f"<u{wide}").ravel().astype(np.int64)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << SKETCH, np.int64)
    for b in batches:
        for x in b.column("sketch"):
            added(total, x.as_py())
    yield pa.RecordBatch.from_arrays([pa.array([flattened(total)], pa.binary())], ["sketch"])
    del total
    freed()


def frequency_levels(described: DataFrame) -> np.ndarray:
    """0 for counters that stay within the spread of a random filling, above that the logarithm of their excess in such
    spreads, and 128 more for those of ``HOT`` documents: one byte a counter."""
    parts = described.where("sketch is not null").select("sketch")
    fan = max(1, int(shuffle_partitions(described.sparkSession) ** 0.5))
    row = parts.repartition(fan).mapInArrow(_merged, "sketch binary").repartition(1).mapInArrow(_merged, "sketch binary").first()
    total = np.zeros(1 << SKETCH, np.int64)
    added(total, row.sketch)
    mean = max(1.0, total.mean())
    excess = (total - mean) / (4 * np.sqrt(mean) + 2)
    return np.where(excess > 1, 1 + np.log2(np.maximum(1, excess)), 0).astype(np.uint8) | np.where(total - mean > HOT, 128, 0).astype(np.uint8)


def least_common(percent: int) -> int:
    """Shingles that two different sets share at least if they link (o / (o + 1) reaches the threshold), up to three:
    so many must be among the prefix shingles of both."""
    return min(3, max(1, -(-percent // max(1, 100 - percent))))


def prefix_sizes(n: np.ndarray, percent: int) -> np.ndarray:
    return np.where(n > 0, np.minimum(n, n - -(-percent * n // 100) + least_common(percent)), 0)


ENTRY = "shard int, hot boolean, keys binary, cids binary, sizes binary, rests binary"


def _prefixes(k: int, percent: int, shards: int, levels):
    """The prefix shingles (48 bits of them) of each class with its size and its shingles from that one on. Shingles of
    very many documents are dealt by class as well, so no shard has to hold all of theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            keys, cids, n, rest, hot = (np.concatenate(x) for x in zip(*held, strict=True))
            dealt = np.where(hot, mix(keys ^ cids.view(np.uint64)), keys)
            shard = ((dealt >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64) * 2 + hot
            keys = keys >> np.uint64(16)
            order = np.lexsort((cids, keys, shard))
            keys, cids, n, rest, shard = (x[order] for x in (keys, cids, n, rest, shard))
            fresh = np.ones(len(keys), bool)
            fresh[1:] = (keys[1:] != keys[:-1]) | (cids[1:] != cids[:-1])
            keys, cids, n, rest, shard = (x[fresh] for x in (keys, cids, n, rest, shard))
            new = np.flatnonzero(np.diff(shard, prepend=-1))
            parts = [slice(a, b) for a, b in zip(new, [*new[1:], len(shard)], strict=True)]
            return pa.RecordBatch.from_arrays(
                [pa.array(shard[new] // 2, pa.int32()), pa.array(shard[new] % 2 == 1), pa.array([packed(keys[p]) for p in parts], pa.binary()), pa.array([cids[p].tobytes() for p in parts], pa.binary()), pa.array([numbers(n[p]) for p in parts], pa.binary()), pa.array([numbers(rest[p]) for p in parts], pa.binary())],
                ["shard", "hot", "keys", "cids", "sizes", "rests"],
            )

        for b in slices(batches):
            v, at = shingle_sets(b.column("text"), k)
            cid, n = class_ids(v, at), np.diff(at)
            p = prefix_sizes(n, percent)
            lev = level[(v >> np.uint64(64 - SKETCH)).astype(np.int64)]
            for i in np.flatnonzero(reduced(np.maximum, lev, at, 0)):
                part = slice(at[i], at[i + 1])
                order = np.argsort(lev[part], kind="stable")
                v[part], lev[part] = v[part][order], lev[part][order]
            nth = np.arange(p.sum()) - np.repeat(np.cumsum(p) - p, p)
            place = np.repeat(at[:-1], p) + nth
            held.append((v[place], np.repeat(cid, p), np.repeat(n, p), np.repeat(n, p) - nth, lev[place] >= 128))
            size += b.column("text").nbytes
            if size > BLOCK:
                yield flush()
                held, size = [], 0
        if sum(len(x[0]) for x in held):
            yield flush()

    return run


def partnered(group: np.ndarray, n: np.ndarray, rest: np.ndarray, percent: int) -> np.ndarray:
    """Of members (ordered by group, then size): whether the group has another member whose size lies where ``rest``
    common shingles can still meet the threshold: (100 + percent) * rest >= percent * (n + m)."""
    at = group << 32 | n
    low, high = -(-percent * n // 100), np.minimum((100 + percent) * rest // percent - n, (1 << 32) - 1)
    found = np.searchsorted(at, group << 32 | np.maximum(high, 0), side="right") - np.searchsorted(at, group << 32 | low)
    return found - ((low <= n) & (n <= high)) > 0


def _shared(percent: int):
    """Of one shard: the groups of classes that share a prefix shingle and may have partners there, named by members,
    and how many shingles have that group. A link shows in the groups of its first few common shingles, of which all but
    the last may stand before a shingle in question."""
    spare = least_common(percent) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list] = {False: [], True: []}
        for b in batches:
            for hot, k, c, n, r in zip(*(b.column(x) for x in ("hot", "keys", "cids", "sizes", "rests")), strict=True):
                held[hot.as_py()].append((unpacked(k.as_py()), np.frombuffer(c.as_py(), np.int64), from_numbers(n.as_py()), from_numbers(r.as_py())))
        for hot, parts in held.items():
            if not parts:
                continue
            k, c, n, r = (np.concatenate(x) for x in zip(*parts, strict=True))
            parts.clear()
            order = np.lexsort((c, k))
            k, c, n, r = (x[order] for x in (k, c, n, r))
            keep = np.ones(len(k), bool)
            keep[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
            k, c, n, r = (x[keep] for x in (k, c, n, r))
            if hot:
                g = mix(k ^ np.uint64(0x9FB21C651E98DF25))
            else:
                size = np.diff(np.append(first := np.flatnonzero(np.diff(k, prepend=~k[:1])), len(k)))
                keep = np.repeat(size > 1, size)
                k, c, n, r = (x[keep] for x in (k, c, n, r))
                for _ in range(3):
                    group = np.cumsum(np.diff(k, prepend=k[:1]) != 0)
                    order = np.lexsort((n, group))
                    k, c, n, r, group = (x[order] for x in (k, c, n, r, group))
                    some = partnered(group, n, np.minimum(n, r + spare), percent)
                    k, c, n, r = (x[some] for x in (k, c, n, r))
                first = np.flatnonzero(np.diff(k, prepend=~k[:1]))
                size = np.diff(np.append(first, len(k)))
                name = mix(np.add.reduceat(mix(c.view(np.uint64) ^ np.uint64(0x9FB21C651E98DF25)), first) + size.astype(np.uint64) * np.uint64(BASE)) if len(k) else k
                g = np.repeat(name, size)
            order = np.lexsort((c, g))
            g, c = g[order], c[order]
            keep = np.ones(len(g), bool)
            keep[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
            first = np.flatnonzero(keep)
            times = np.diff(np.append(first, len(g)))
            g, c = g[first].view(np.int64), c[first]
            for lo in range(0, len(g), 1 << 16):
                part = slice(lo, lo + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(g[part]), pa.array(c[part]), pa.array(times[part])], ["grp", "cid", "times"])
            del k, c, n, r, g, order, keep, first, times
        freed()

    return run


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bitmap of the document ids, or of the bitmaps, of a task."""
    bits = np.zeros(1 << FILTER - 3, np.uint8)
    for b in batches:
        if "bits" in b.schema.names:
            for x in b.column("bits"):
                bits |= np.frombuffer(pa.decompress(x.as_py(), decompressed_size=len(bits), codec="zstd", asbytes=True), np.uint8)
        else:
            place = spot(np.asarray(b.column("doc_id")))
            np.bitwise_or.at(bits, place >> 3, (1 << (place & 7)).astype(np.uint8))
    yield pa.RecordBatch.from_arrays([pa.array([pa.compress(bits.tobytes(), codec="zstd", asbytes=True)], pa.binary())], ["bits"])
    del bits
    freed()


def spot(doc_id: np.ndarray) -> np.ndarray:
    return (mix(doc_id.view(np.uint64) ^ np.uint64(0x8EBC6AF09C88C6E3)) >> np.uint64(64 - FILTER)).astype(np.int64)


def id_filter(wanted: DataFrame) -> bytes:
    """A bitmap of fixed size in which all ``wanted`` document ids are marked, and few others while they are few."""
    fan = max(1, int(shuffle_partitions(wanted.sparkSession) ** 0.5))
    return wanted.select("doc_id").coalesce(shuffle_partitions(wanted.sparkSession)).mapInArrow(_marked, "bits binary").repartition(fan).mapInArrow(_marked, "bits binary").repartition(1).mapInArrow(_marked, "bits binary").first().bits


def width_class(n: np.ndarray) -> np.ndarray:
    """Sets of up to 48 * 2**j items have bitmaps of 128 * 2**j bits."""
    return np.clip(np.ceil(np.log2(np.maximum(n, 1) / 48)), 0, WIDEST).astype(int)


def signatures(v: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Token bitmaps, as wide as the set's size asks for. A bit is named by the first bits of a hash, so OR-ing
    neighbouring bits makes a narrower bitmap."""
    place, out = mix(v), []
    for lo, hi, j in zip(at[:-1], at[1:], width_class(np.diff(at)), strict=True):
        bits = np.zeros(128 << int(j), bool)
        bits[(place[lo:hi] >> np.uint64(57 - int(j))).astype(np.int64)] = True
        out.append(np.packbits(bits).tobytes())
    return out


def folded(column: pa.Array, rows: np.ndarray, j: int) -> np.ndarray:
    """Bitmaps of class j, one row each, of ``rows`` of a column with bitmaps of that class or wider ones."""
    column = column.cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
    data = np.frombuffer(column.buffers()[2], np.uint8)
    out = np.zeros((len(rows), 16 << j), np.uint8)
    size = (off[1:] - off[:-1])[rows]
    for width in np.unique(size):
        own = np.flatnonzero(size == width)
        step = max(1, (1 << 20) // int(width))
        for x in range(0, len(own), step):
            part = own[x : x + step]
            b = data[off[rows[part]][:, None] + np.arange(width)]
            if width > 16 << j:
                b = np.packbits(np.unpackbits(b, axis=1).reshape(len(part), 128 << j, -1).any(axis=2), axis=1)
            out[part] = b
    return out


def _sets(k: int, wanted):
    """Whole sets and bitmaps of the documents that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(pa.decompress(wanted.value, decompressed_size=1 << FILTER - 3, codec="zstd", asbytes=True), np.uint8)

        def some():
            for b in batches:
                place = spot(np.asarray(b.column("doc_id")))
                yield b.filter(pa.array((bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)))

        for b in slices(some()):
            v, at = shingle_sets(b.column("text"), k)
            items = pa.array([v[lo:hi].tobytes() for lo, hi in zip(at[:-1], at[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(class_ids(v, at)), pa.array(np.diff(at)), pa.array(signatures(v, at), pa.binary()), items], ["doc_id", "cid", "n", "sig", "items"])

    return run


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets meet the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "x"):
            ok = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column("x"), b.column("y"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                same = int((x[at] == y).sum())
                ok[i] = 100 * same >= percent * (len(x) + len(y) - same)
            yield b.select(["a", "b"]).filter(pa.array(ok))

    x = sets.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("items").alias("x"))
    y = sets.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("items").alias("y"))
    fits = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return pairs.join(x, "a").join(y, "b").where(fits).select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


class SignatureForest:
    """Binary trees over the members of groups, in order of size. Level 0 are the members; a node holds the OR of its
    members' bitmaps, their least and greatest size, the most items that share a bit with another, and their component
    if one. ``start`` has the first member of each group and the end of the last."""

    def __init__(self, sig: np.ndarray, n: np.ndarray, comp: np.ndarray, start: np.ndarray):
        words_ = np.ascontiguousarray(sig).view(np.uint64)
        excess = n - np.bitwise_count(words_).sum(axis=1, dtype=np.int64)
        self.levels = [(words_, n, n, excess, comp, start)]
        while (np.diff(self.levels[-1][5]) > 1).any():
            s, lo, hi, ex, c, start = self.levels[-1]
            half = -(-np.diff(start) // 2)
            up = np.concatenate([[0], np.cumsum(half)])
            left = np.repeat(start[:-1], half) + 2 * (np.arange(up[-1]) - np.repeat(up[:-1], half))
            right = np.minimum(left + 1, np.repeat(start[1:], half) - 1)
            self.levels.append((s[left] | s[right], np.minimum(lo[left], lo[right]), np.maximum(hi[left], hi[right]), np.maximum(ex[left], ex[right]), np.where(c[left] == c[right], c[left], NO_ID), up))

    def pairs(self, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of members of one group and of different components that may meet the threshold, by dual traversal
        from the roots, and the greatest overlap they can have."""
        g = x = y = np.arange(len(self.levels[0][5]) - 1)
        most = np.zeros(len(g), np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            s, lo, hi, ex, c, start = self.levels[depth]
            if depth < len(self.levels) - 1:
                above = self.levels[depth + 1][5]
                a, b = start[g] + 2 * (x - above[g]), start[g] + 2 * (y - above[g])
                g, x, y = np.tile(g, 4), np.concatenate([a, a, a + 1, a + 1]), np.concatenate([b, b + 1, b, b + 1])
                ok = (x <= y) & (y < start[g + 1])
                if not depth:
                    ok &= x != y
                g, x, y = g[ok], x[ok], y[ok]
            keep, most = np.zeros(len(x), bool), np.zeros(len(x), np.int64)
            step = max(64, (4 << 20) // (8 * s.shape[1]))
            for i in range(0, len(x), step):
                p, q = x[i : i + step], y[i : i + step]
                apart = (c[p] != c[q]) | (c[p] == NO_ID)
                fit = np.flatnonzero(apart & (100 * np.minimum(hi[p], hi[q]) >= percent * np.maximum(lo[p], lo[q])))
                p, q = p[fit], q[fit]
                overlap = np.bitwise_count(s[p] & s[q]).sum(axis=1, dtype=np.int64) + np.minimum(ex[p], ex[q])
                overlap = np.minimum(overlap, np.minimum(hi[p], hi[q]))
                # 100*o >= percent*(a + b - o)
                keep[i + fit] = (100 + percent) * overlap >= percent * (lo[p] + lo[q])
                most[i + fit] = overlap
            g, x, y, most = g[keep], x[keep], y[keep], most[keep]
        some = x != y
        return x[some], y[some], most[some]


def candidates(t: pa.RecordBatch, group: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of a group (ascending numbers) that may link different components, and their greatest similarity.
    One forest for each class of sizes; a class takes in what may pair with its smallest members."""
    n, comp, sig = np.asarray(t.column("n")), np.asarray(t.column("comp")), t.column("sig")
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    # Widths are made for 75 percent: classes of sizes for another threshold begin where all members are as wide.
    for c in range(WIDEST + 1):
        least = 0 if c == 0 else 48 * 2 ** (c - 1)
        low, high = (least * 100 / percent if c else 0), (48 * 2**c * 100 / percent if c < WIDEST else np.inf)
        if not ((n > low) & (n <= high)).any():
            continue
        own = np.flatnonzero((n > least) & (n <= high))
        own = own[np.lexsort((n[own], group[own]))]
        start = np.flatnonzero(np.diff(group[own], prepend=-1))
        many = np.diff(np.append(start, len(own))) > 1
        own = own[np.repeat(many, np.diff(np.append(start, len(own))))]
        if not len(own):
            continue
        start = np.append(np.flatnonzero(np.diff(group[own], prepend=-1)), len(own))
        x, y, most = SignatureForest(folded(sig, own, c), n[own], comp[own], start).pairs(percent)
        x, y = own[x], own[y]
        found.append((x, y, most / (n[x] + n[y] - most)))
    return tuple(np.concatenate(v) for v in zip(*found, strict=True))


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows that are sorted by ``keys``, in runs of whole groups of about ``PAIRS`` pairs, with the number of each row's
    group."""

    def runs(t: pa.RecordBatch, whole: bool) -> tuple[list, pa.RecordBatch]:
        new = np.zeros(t.num_rows, bool)
        for k in keys:
            v = np.asarray(t.column(k))
            new[1:] |= v[1:] != v[:-1]
        ends = np.append(np.flatnonzero(new), t.num_rows) if whole else np.flatnonzero(new)
        if not len(ends):
            return [], t
        size = np.diff(ends, prepend=0)
        cut = ends[np.flatnonzero(np.append(np.diff(np.cumsum(size * size) // (2 * PAIRS)), 1))]
        return [(t.slice(lo, hi - lo), np.cumsum(new[lo:hi])) for lo, hi in zip([0, *cut[:-1]], cut, strict=True)], t.slice(cut[-1])

    rest = None
    for b in slices(batches, "sig"):
        done, rest = runs(b if rest is None else pa.Table.from_batches([rest, b]).combine_chunks().to_batches()[0], False)
        yield from done
    if rest is not None and rest.num_rows:
        yield from runs(rest, True)[0]


def _partners(percent: int):
    """For every member with candidates in its block, two of the likeliest (by twentieths of similarity, then by chance)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in grouped(batches, ["grp", "block"]):
            x, y, share = candidates(t, group, percent)
            if not len(x):
                continue
            cid, grp = np.asarray(t.column("cid")), np.asarray(t.column("grp"))
            src, dst, step = np.concatenate([x, y]), np.concatenate([y, x]), np.minimum(np.tile(share, 2) * 20, 19).astype(np.uint64)
            for i, seed in enumerate(SEEDS):
                chance = mix(mix(cid[src].view(np.uint64) ^ seed) ^ cid[dst].view(np.uint64))
                rank = (step << np.uint64(56) | chance >> np.uint64(8)).view(np.int64)
                order = np.lexsort((rank, src))
                last = order[np.flatnonzero(np.diff(src[order], append=-1))]
                yield pa.RecordBatch.from_arrays([pa.array(grp[src[last]]), pa.array(cid[src[last]]), pa.array(cid[dst[last]]), pa.array(np.full(len(last), i, np.int32)), pa.array(rank[last])], ["grp", "cid", "partner", "choice", "rank"])

    return run


def _pairs(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in grouped(batches, ["grp", "i", "j"]):
            x, y, _ = candidates(t, group, percent)
            cid = np.asarray(t.column("cid"))
            both = np.unique(np.stack([np.minimum(cid[x], cid[y]), np.maximum(cid[x], cid[y])], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    return run


def labelled(shared: DataFrame, labels: DataFrame | None) -> DataFrame:
    """grp, cid, comp of the groups that have members of several components."""
    if labels is None:
        return shared.withColumn("comp", F.col("cid"))
    comp = shared.join(labels.withColumnRenamed("node", "cid"), "cid", "left").select("grp", "cid", F.coalesce("label", "cid").alias("comp"))
    mixed = comp.groupBy("grp").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("grp")
    return comp.join(mixed, "grp", "left_semi")


def likely_partners(shared: DataFrame, labels: DataFrame | None, sets: DataFrame, percent: int, turn: int) -> tuple[DataFrame, DataFrame]:
    """grp, cid, partner, choice, rank: for each class of a group two candidates in its block; and the groups (grp,
    size) that have several blocks."""
    member = labelled(shared, labels)
    size = written(member.groupBy("grp").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > BLOCK_FIRST), f"large-groups{turn}")
    parts = F.ceil(F.coalesce("size", F.lit(1)) / BLOCK_FIRST).cast("int")
    rows = member.join(size, "grp", "left").select("grp", "cid", "comp", F.pmod(F.xxhash64("grp", "cid", F.lit(turn)), parts).cast("int").alias("block"))
    rows = rows.join(sets.select("cid", "n", "sig"), "cid")
    dealt = rows.repartition(shuffle_partitions(shared.sparkSession), "grp", "block").sortWithinPartitions("grp", "block").select("grp", "block", "cid", "comp", "n", "sig")
    return written(dealt.mapInArrow(_partners(percent), "grp long, cid long, partner long, choice int, rank long"), f"partners{turn}"), size


def all_pairs(shared: DataFrame, labels: DataFrame | None, sets: DataFrame, percent: int) -> DataFrame:
    """Every candidate pair (a, b) of classes of different components in a group. A large group is dealt in blocks; the
    members of its largest component are blocks of their own and meet the others only, not one another."""
    n = shuffle_partitions(shared.sparkSession)
    member = written(labelled(shared, labels), "members")
    large = member.groupBy("grp").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > BLOCK_LAST)
    of = member.join(large, "grp", "left_semi").groupBy("grp", "comp").agg(F.count(F.lit(1)).alias("m"))
    of = of.groupBy("grp").agg(F.max_by("comp", F.struct("m", "comp")).alias("top"), F.max("m").alias("m"), F.sum("m").alias("size"))
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(c / BLOCK_LAST)).cast("int")
    plan = written(of.select("grp", "top", blocks(F.col("m")).alias("tops"), blocks(F.col("size") - F.col("m")).alias("others")), "large-groups")
    small = member.join(plan.select("grp"), "grp", "left_anti").select("grp", F.lit(0).alias("i"), F.lit(0).alias("j"), "cid", "comp")
    big = member.join(plan, "grp").withColumn("in_top", F.col("comp") == F.col("top"))
    own = F.pmod(F.xxhash64("grp", "cid"), F.when(F.col("in_top"), F.col("tops")).otherwise(F.col("others"))).cast("int")
    # Blocks of the others are 0, 1, ...; those of the largest component -1, -2, ...
    big = big.withColumn("own", F.when(F.col("in_top"), -1 - own).otherwise(own))
    others = F.sequence(F.lit(0), F.col("others") - 1)
    meets = F.when(F.col("in_top"), others).otherwise(F.concat(others, F.transform(F.sequence(F.lit(1), F.col("tops")), lambda i: -i)))
    big = big.select("grp", "cid", "comp", "own", F.explode(meets).alias("other"))
    big = big.select("grp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "cid", "comp")
    rows = small.unionByName(big).join(sets.select("cid", "n", "sig"), "cid")
    dealt = rows.repartition(n, "grp", "i", "j").sortWithinPartitions("grp", "i", "j").select("grp", "i", "j", "cid", "comp", "n", "sig")
    out = written(dealt.mapInArrow(_pairs(percent), "a long, b long").distinct(), "pairs")
    removed(member, plan)
    return out


def joined(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components (node, label) of the links so far (``labels``) and more of them (a, b)."""
    if labels is None:
        return components(links)
    of = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"{side}_label"))
    bridges = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
    last = components(bridges)
    full = labels.join(last.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    out = written(full.unionByName(last.join(labels.select("node"), "node", "left_anti")), "labels")
    removed(last)
    return out


def jaccard_components(docs: DataFrame, words_in_shingle: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included) for every row.

    Words are runs of bytes without ASCII white space, A-Z lower-cased; a set holds the distinct shingles of
    ``words_in_shingle`` words, or the whole sequence of a shorter text as one. Two documents link when 100 *
    intersection >= ``percent`` * union. A text without words (null, empty, blank) has an empty set and links with
    nothing. Repeated rows link with one another. A null doc_id takes part in links but is no component's id unless
    alone. An empty table gives no rows; other columns are ignored. Shingles and sets are told apart by 64-bit
    identifiers.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    d = texts(docs)
    described = written(d.mapInArrow(_describe(words_in_shingle), "doc_id long, n long, cid long, sketch binary"), "described")
    info = described.where("sketch is null and n > 0")
    levels = spark.sparkContext.broadcast(frequency_levels(described))  # 2**SKETCH bytes
    entries = d.mapInArrow(_prefixes(words_in_shingle, percent, n, levels), ENTRY).repartitionById(n, F.col("shard"))
    met = written(entries.mapInArrow(_shared(percent), "grp long, cid long, times long").groupBy("grp", "cid").agg(F.sum("times").alias("times")), "met")
    # Only classes that share enough prefix shingles, and groups that still have two of them.
    enough = met.groupBy("cid").agg(F.sum("times").alias("times")).where(F.col("times") >= least_common(percent)).select("cid")
    some = written(met.join(enough, "cid", "left_semi").select("grp", "cid"), "met-enough")
    shared = written(some.join(some.groupBy("grp").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("grp"), "grp", "left_semi"), "shared")
    removed(met, some)
    classes = written(info.groupBy("cid").agg(F.min("doc_id").alias("least")), "classes")
    # Whole sets and bitmaps of the classes in some group, in buckets: joins on cid leave them where they are.
    wanted = written(classes.join(shared.select("cid").distinct(), "cid", "left_semi").select(F.coalesce("least", F.lit(NO_ID)).alias("doc_id"), "cid"), "wanted")
    bits = spark.sparkContext.broadcast(id_filter(wanted))  # 2**FILTER bits at most
    own = d.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text").mapInArrow(_sets(words_in_shingle, bits), "doc_id long, cid long, n long, sig binary, items binary")
    # Named so that it is no key of the join: rows are dealt by cid alone, as buckets are.
    same = F.least("doc_id", "least") == F.greatest("doc_id", "least")
    own = own.join(wanted.withColumnRenamed("doc_id", "least"), "cid").where(same)
    sets = bucketed(own.drop("doc_id", "least").dropDuplicates(["cid"]), "sets", "cid")
    labels, groups = None, shared
    for turn in range(2):
        partners, large = likely_partners(groups, labels, sets, percent, turn)
        best = partners.groupBy("cid", "choice").agg(F.max_by("partner", "rank").alias("partner"))
        links = verified(best.select(F.least("cid", "partner").alias("a"), F.greatest("cid", "partner").alias("b")).distinct(), sets, percent)
        before, labels = labels, joined(labels, links)
        # A group of one block goes on with its members that have candidates; larger ones as they are.
        kept = partners.join(large, "grp", "left_anti").select("grp", "cid").distinct().unionByName(groups.join(large, "grp", "left_semi"))
        old, groups = groups, written(kept, f"groups{turn}")
        removed(old, partners, large, *[before] * (before is not None))
    pairs = all_pairs(groups, labels, sets, percent)
    full = joined(labels, verified(pairs, sets, percent))
    named = written(classes.join(full, F.col("cid") == F.col("node"), "left").select("cid", "least", F.coalesce("label", "cid").alias("label")), "named")
    ids = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of_class = named.join(ids, "label").select("cid", "component_id")
    out = info.join(of_class, "cid").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    out = written(out.unionByName(described.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))), "components")
    removed(described, classes, wanted, groups, labels, pairs, full, named)
    dropped(sets)
    return out


def keep_representatives(docs: DataFrame, words_in_shingle: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``docs``, all columns, that are the least doc_id of their component. Rows without doc_id are judged
    together: they stay if one of them does."""
    stay = jaccard_components(docs, words_in_shingle, percent).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.struct("doc_id").alias("key")).distinct()
    whole = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id")).alias("key"), F.struct("*").alias("row"))
    # Joined by sorting at every size: what stays grows with the input.
    return whole.join(stay.hint("merge"), "key", "left_semi").select("row.*")
