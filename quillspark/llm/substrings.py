"""Removal of repeated substrings by bucket-pointer refinement over sampled suffixes.

Every window of ``length`` bytes holds an anchor: the position whose q-gram has the least hash among those inside the
window (ties: all of them). Anchors with the same q-gram form the initial buckets, and the q-gram's identifier is a
position's bucket pointer. Pointers are refined on those of later offsets: the pointer for twice the depth combines a
position's pointer with that of the position one depth later, and so on from what was refined before. For an anchor, the
windows around it are a range of offsets; a range has a core (the bytes that all its windows share) and a hull (the
bytes that any of them covers), and the pointers at the first and the last place of deepest fit name either. Members of a
bucket meet by sorting on these names. A core that occurs once rules its whole range out; a hull that occurs twice
settles its whole range; what lies between is split into smaller ranges and refined again, down to single windows.
Members of a settled bucket go on as one witness. All counting is by aggregates with map-side combination, and what they
say returns by equi-joins of which Spark can split skewed keys, so groups of any size spread over tasks; nothing is
compared pair by pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytegrams import BASE, Hashes, mix, utf8
from .common import bucketed, removed, slices, texts, written

Q = 50
#: Windows in a range at each level of refinement, below the whole range of an anchor.
STEPS = (38, 7, 1)
SLICE = 1_000_000
NO_ID = -(1 << 63)


def sliding(v: np.ndarray, w: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of every w consecutive values, from those of half as many."""
    if len(v) < w:
        return v[:0]
    size = 1
    while 2 * size <= w:
        v, size = best(v[:-size], v[size:]), 2 * size
    return best(v[: len(v) - (w - size)], v[w - size :]) if size < w else v


def anchors(grams: np.ndarray, off: np.ndarray, length: int) -> np.ndarray:
    """Positions that are the least (by the first 32 bits) of some window that lies within a text."""
    span = length - Q + 1
    if len(grams) < span:
        return np.zeros(0, np.int64)
    key = (grams >> np.uint64(32)).astype(np.uint32)
    least = sliding(key, span, np.minimum)
    for lo, hi in zip(np.maximum(off[:-1], off[1:] - length + 1).tolist(), off[1:].tolist(), strict=True):
        least[lo:hi] = 0
    # A position is an anchor if the greatest of the least values of the windows over it is its own.
    none = np.zeros(span - 1, np.uint32)
    return np.flatnonzero(sliding(np.concatenate([none, least, none]), span, np.maximum)[: len(grams)] == key)


def pointers(grams: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Bucket pointers of the positions ``at``, refined ``depth`` times: they tell substrings of Q * 2**depth bytes apart."""
    if not depth:
        return grams[at]
    return mix(pointers(grams, at, depth - 1) * np.uint64(BASE) + pointers(grams, at + (Q << depth - 1), depth - 1))


def region(grams: np.ndarray, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Identifier of the bytes [lo, lo+size): the deepest bucket pointers that fit at its first and its last place."""
    h = np.zeros(len(lo), np.uint64)
    depth = np.floor(np.log2(size / Q)).astype(int)
    for k in np.unique(depth):
        own = np.flatnonzero(depth == k)
        first, n = lo[own], size[own]
        h[own] = mix((n.astype(np.uint64) * np.uint64(BASE) + pointers(grams, first, k)) * np.uint64(BASE) + pointers(grams, first + n - (Q << int(k)), k))
    return h.view(np.int64)


def cells(grams, begin, end, p, a, b, length) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For ranges of offsets a..b before anchors p in texts begin..end: which have a core, its identifier, and the
    hull's identifier with whether there is one."""
    lo, size = p - a, length - (b - a)
    ok = (lo >= begin) & (lo + size <= end)
    core = np.zeros(len(p), np.int64)
    core[ok] = region(grams, lo[ok], size[ok])
    h_lo, h_hi = p - b, p - a + length
    has = ok & (h_lo >= begin) & (h_hi <= end)
    hull = np.zeros(len(p), np.int64)
    hull[has] = region(grams, h_lo[has], (h_hi - h_lo)[has])
    # The same bytes at another offset from the anchor are another range.
    turn = (mix((a * 1009 + b).astype(np.uint64))).view(np.int64)
    return ok, core ^ turn, hull, has


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id (null: the smallest 64-bit integer), rid (tells texts of a repeated doc_id apart), text."""
    return texts(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.xxhash64("doc_id", "text").alias("rid"), "text")


def _initial(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=SLICE):
            data, off = utf8(b.column("text"))
            grams = Hashes(data).grams(Q)
            p = anchors(grams, off, length)
            d = np.searchsorted(off, p, side="right") - 1
            reach = np.zeros(len(p), np.int64)
            _, _, hull, has = cells(grams, off[d], off[d + 1], p, reach, reach + length - Q, length)
            yield pa.RecordBatch.from_arrays(
                [grams[p].view(np.int64), pa.array(hull, mask=~has), b.column("doc_id").take(pa.array(d)), b.column("rid").take(pa.array(d)), (p - off[d]).astype(np.int32), np.zeros(len(p), np.int32), np.full(len(p), length - Q, np.int32)],
                ["core", "hull", "doc_id", "rid", "pos", "a", "b"],
            )

    return run


ROW = "core long, hull long, doc_id long, rid long, pos int, a int, b int"


def _refined(step: int, length: int):
    """mapInArrow over texts with their open ranges: the smaller ranges of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=SLICE):
            data, off = utf8(b.column("text"))
            grams = Hashes(data).grams(Q)
            lists = b.column("open")
            flat = lists.flatten()
            n = np.diff(np.asarray(lists.offsets)) if len(lists) else np.zeros(0, int)
            d = np.repeat(np.arange(len(n)), n)
            p, lo, hi = (np.asarray(flat.field(i)).astype(np.int64) for i in range(3))
            parts = -(-(hi - lo + 1) // step)
            i = np.repeat(np.arange(len(p)), parts)
            a = lo[i] + (np.arange(len(i)) - np.repeat(np.cumsum(parts) - parts, parts)) * step
            z = np.minimum(a + step - 1, hi[i])
            d, p = d[i], p[i] + off[d[i]]
            if step == 1:  # a window may be open under several anchors: keep it once, named by its start alone
                start = np.unique(p - a)
                p, a, z = start, np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
                d = np.searchsorted(off, start, side="right") - 1
            ok, core, hull, has = cells(grams, off[d], off[d + 1], p, a, z, length)
            d, p, a, z, core, hull, has = (x[ok] for x in (d, p, a, z, core, hull, has))
            yield pa.RecordBatch.from_arrays(
                [core, pa.array(hull, mask=~has), b.column("doc_id").take(pa.array(d)), b.column("rid").take(pa.array(d)), (p - off[d]).astype(np.int32), a.astype(np.int32), z.astype(np.int32)], ["core", "hull", "doc_id", "rid", "pos", "a", "b"]
            )

    return run


def judged(rows: DataFrame, tag: str) -> DataFrame:
    """Ranges whose core occurs twice: settled (their hull occurs twice) or open; one settled member of a bucket that
    also has open members stays open as their witness."""
    # Counts are written before they are joined, so neither side of a join is an aggregate and skewed keys can be split.
    rows = written(rows, f"{tag}-rows")
    twice = written(rows.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("core"), f"{tag}-buckets")
    alive = written(rows.join(twice, "core", "left_semi"), f"{tag}-alive")
    removed(rows, twice)
    me = F.struct("doc_id", "rid", "pos")
    classes = alive.where("hull is not null").groupBy("core", "hull").agg(F.count(F.lit(1)).alias("n"), F.min(me).alias("first")).where("n > 1").drop("n")
    classes = written(classes, f"{tag}-classes")
    out = alive.join(classes, ["core", "hull"], "left")
    settled = F.col("first").isNotNull()
    table = written(out.select("core", "doc_id", "rid", "pos", "a", "b", settled.alias("settled"), F.coalesce(F.col("first") == me, F.lit(False)).alias("first")), tag)
    removed(alive, classes)
    return table


def opened(table: DataFrame) -> DataFrame:
    """The open ranges, and a witness of each settled bucket with the same core."""
    bare = table.where("not settled")
    witness = table.where("first").join(bare.select("core").distinct(), "core", "left_semi")
    cols = ["doc_id", "rid", "pos", "a", "b"]
    return bare.select(*cols).unionByName(witness.select(*cols))


def _kept(with_kept: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=SLICE):
            out = []
            lists = b.column("spans")
            flat = lists.flatten()
            size = pc.fill_null(pc.list_value_length(lists), 0).to_pylist()
            lo, hi = (np.asarray(flat.field(i)).astype(np.int64) for i in range(2))
            first = 0
            for text, spans, n, sha in zip(b.column("text"), size, b.column("n_bytes").to_pylist(), b.column("sha").to_pylist(), strict=True):
                if not spans:
                    out.append((n, 0, 0, sha, text.as_buffer().to_pybytes() if with_kept else None))
                    continue
                data = np.frombuffer(text.as_buffer(), np.uint8)
                at, end = lo[first : first + spans], hi[first : first + spans]
                first += spans
                edge = np.bincount(at, minlength=len(data) + 1) - np.bincount(end, minlength=len(data) + 1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = data[~gone].tobytes()
                runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((n, int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept if with_kept else None))
            n, k, r, h, t = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(r, pa.int64()), pa.array(h, pa.string()), pa.array(t, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def substring_dedup(docs: DataFrame, length: int = 200, with_kept: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept: the remaining bytes).

    A byte is removed when a string of ``length`` bytes that covers it starts anywhere else too, overlaps and the same
    document included; strings are judged on the input. Texts are UTF-8 bytes, null is empty, and a text shorter than
    ``length`` loses nothing. Repeated rows repeat one another's strings. A null doc_id is a document like any other.
    An empty table gives no rows; other columns are ignored. Strings are told apart by 64-bit identifiers.
    """
    if length < 2 * Q:
        raise ValueError(f"length must be {2 * Q} at least")
    base = keyed(docs)
    found = judged(base.mapInArrow(_initial(length), ROW), "anchors")
    tables = [found]
    # Texts with anchors in common buckets are shuffled once, into buckets of their key; of the others only the digest.
    touched = found.select("doc_id", "rid", F.lit(True).alias("touched")).distinct()
    text = F.col("text") if with_kept else F.when(F.col("touched"), F.col("text"))
    digest = F.sha2("text", 256)
    table = bucketed(base.join(touched, ["doc_id", "rid"], "left").select("doc_id", "rid", text.alias("text"), F.octet_length("text").cast("long").alias("n_bytes"), digest.alias("sha")), "texts", "doc_id", "rid")
    for level, step in enumerate(STEPS):
        lists = opened(tables[-1]).groupBy("doc_id", "rid").agg(F.collect_set(F.struct("pos", "a", "b")).alias("open"))
        tables.append(judged(table.select("doc_id", "rid", "text").join(lists, ["doc_id", "rid"]).mapInArrow(_refined(step, length), ROW), f"level{level}"))
    span = F.struct((F.col("pos") - F.col("b")).alias("lo"), (F.col("pos") - F.col("a") + length).alias("hi"))
    every = [t.where("settled").select("doc_id", "rid", span.alias("span")) for t in tables]
    spans = written(reduce(DataFrame.unionByName, every).groupBy("doc_id", "rid").agg(F.collect_set("span").alias("spans")), "spans")
    removed(*tables)
    out = table.join(spans, ["doc_id", "rid"], "left").mapInArrow(_kept(with_kept), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    doc_id = F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id")
    return out.select(doc_id, "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_kept)
