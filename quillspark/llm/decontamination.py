"""Benchmark decontamination by the q-gram lemma.

A text region within k edits of a pattern of m bytes shares at least m - q + 1 - k*q of its q-grams, all within k of
one diagonal. Items are cut into segments of at most ``SEGMENT`` bytes. Shared q-grams are counted in overlapping
diagonal bands; bands that meet a segment's bound are verified by banded alignment. Items of less than ``SHORTEST``
bytes allow no edit and are found exactly, as whole words (in scripts without spaces: at every character). The items are a query set: blocks of at most ``block_bytes``
of them are sent to the tasks one block after the other, and what one block has found is written before the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytegrams import LOWER, SPACE, Hashes, utf8
from .common import slices, texts, written

Q, SEGMENT, SHORTEST = 8, 160, 30
BITS = 20
_B = np.arange(256)
#: ASCII letters and digits.
WORD = ((_B >= 48) & (_B < 58)) | ((_B >= 65) & (_B < 91)) | ((_B >= 97) & (_B < 123))
#: Fixed values, first two bytes of UTF-8: scripts without spaces between words (kana, Han, Thai, Lao, Myanmar, Khmer) and
#: punctuation beyond ASCII.
UNSPACED = [(0xE381, 0xE383), (0xE390, 0xE9BF), (0xEFA4, 0xEFAB), (0xF0A0, 0xF0B3), (0xE0B8, 0xE0BB), (0xE180, 0xE182), (0xE19E, 0xE19F)]
MARKS = [(0xC2A0, 0xC2A9), (0xC2AB, 0xC2B4), (0xC2B6, 0xC2B9), (0xC2BB, 0xC2BF), (0xE280, 0xE281), (0xE380, 0xE380), (0xEFBC, 0xEFBC)]


def edges(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether no word goes on at a place (as many as bytes, and the end): between characters of which one at least is no
    letter or of a script without spaces, and at either end of a text."""
    starts = (data & 0xC0) != 0x80
    second = np.append(data[1:], 0).astype(np.int32)
    two = data.astype(np.int32) << 8 | second
    letter = WORD[data] | (data >= 128)
    for low, high in UNSPACED + MARKS:
        letter &= (two < low) | (two > high)
    # Of each byte whether its character is a letter that words go on with.
    letter = letter[np.maximum.accumulate(np.where(starts, np.arange(len(data)), 0))]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = starts[1:] & ~(letter[1:] & letter[:-1])
    edge[off] = True
    return edge


def normal(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A-Z lower-cased, runs of ASCII white space one space, none at either end of a text."""
    space = SPACE[data]
    keep = ~space
    first = np.zeros(len(data) + 1, bool)
    first[off] = True
    keep[1:] |= space[1:] & ~space[:-1] & ~first[1:-1]
    out = LOWER[data]
    out[space] = 32
    count = np.concatenate([[0], np.cumsum(keep)])
    out, at = out[keep], count[off]
    # A space kept before the end of its text goes too.
    last = at[1:][np.diff(at) > 0] - 1
    last = last[out[last] == 32]
    mask = np.ones(len(out), bool)
    mask[last] = False
    count = np.concatenate([[0], np.cumsum(mask)])
    return out[mask], count[at]


#: Segments that may hold a q-gram before it counts as frequent, and pairs of hits and segments that are held at once.
FREQUENT, PAIRS = 256, 1 << 20


class Index:
    """The q-grams of the segments of benchmark items."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        data, off = normal(*utf8(pa.array([t for _, t in items], pa.string())))
        segments, owner, brief = [], [], {}
        whole = Hashes(data)
        for i, (lo, hi) in enumerate(zip(off[:-1], off[1:], strict=True)):
            if hi - lo >= SHORTEST:
                cuts = np.linspace(lo, hi, max(1, -(-(hi - lo) // SEGMENT)) + 1).astype(int)
                segments += list(zip(cuts[:-1], cuts[1:], strict=True))
                owner += [i] * (len(cuts) - 1)
            elif hi > lo:
                brief.setdefault(int(hi - lo), []).append(i)
        ids = np.array([x for x, _ in items], np.int64)
        # Of each short length: the items' hashes in order, their ids and bytes.
        self.brief = {}
        for size, own in brief.items():
            h = whole.of(off[own], off[own] + size)
            order = np.argsort(h, kind="stable")
            self.brief[size] = h[order], ids[own][order], data[off[own][order][:, None] + np.arange(size)]
        self.items = np.array([x for x, _ in items])[np.array(owner, int)] if owner else np.zeros(0, int)
        self.size = np.array([b - a for a, b in segments], int)
        self.bytes = np.zeros((len(segments), max(self.size, default=0)), np.uint8)
        for row, (a, b) in zip(self.bytes, segments, strict=True):
            row[: b - a] = data[a:b]
        self.budget = np.minimum((rate * self.size).astype(int), (self.size - Q) // Q)  # edits for which the lemma has a bound of 1 at least
        self.bound = self.size - Q + 1 - self.budget * Q
        grams = whole.grams(Q)
        hashes, seg, pos = [], [], []
        for i, (a, b) in enumerate(segments):
            hashes.append(grams[a : b - Q + 1])
            seg += [i] * (b - a - Q + 1)
            pos += range(b - a - Q + 1)
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hash, self.seg, self.pos = h[order], np.array(seg, int)[order], np.array(pos, int)[order]
        self._without_frequent()
        h = self.hash
        self.seen = np.zeros(1 << BITS, bool)
        self.seen[(h >> np.uint64(64 - BITS)).astype(np.int64)] = True

    def _without_frequent(self) -> None:
        """Leave out q-grams that more than FREQUENT segments hold (a template that many items share), and lower a
        segment's bound by as many: of the q-grams that a match keeps, at most these are not counted. Segments whose
        bound would fall to 0 keep theirs. Entries of a q-gram stand in the order of segments."""
        self.group = np.cumsum(np.concatenate([[0], self.hash[1:] != self.hash[:-1]])) if len(self.hash) else np.zeros(0, int)
        often = np.bincount(self.group)[self.group] > FREQUENT if len(self.hash) else np.zeros(0, bool)
        lower = self.bound - np.bincount(self.seg[often], minlength=len(self.size))
        drop = often & (lower > 0)[self.seg] if len(self.hash) else often
        self.bound = np.where(lower > 0, lower, self.bound)
        self.hash, self.seg, self.pos, self.group = (x[~drop] for x in (self.hash, self.seg, self.pos, self.group))
        self.place = self.group * (len(self.size) + 1) + self.seg  # ascending, so the entries of a q-gram can be cut by segments

    def found(self, data: np.ndarray, off: np.ndarray) -> list[tuple[int, int]]:
        """Distinct (text, item id) pairs."""
        pairs = self.matches(data, off)
        out = {(d, int(self.items[s])) for d, s in pairs.tolist()}
        if self.brief and len(data):
            edge = edges(data, off)
            start, hashes = np.flatnonzero(edge[:-1]), Hashes(data)
            end = off[np.searchsorted(off, start, side="right")]
            for size, (h, ids, whole) in self.brief.items():
                at = start[start + size <= end]
                at = at[edge[at + size]]
                own = hashes.of(at, at + size)
                lo, hi = np.searchsorted(h, own), np.searchsorted(h, own, side="right")
                for i in np.flatnonzero(hi > lo).tolist():
                    d = int(np.searchsorted(off, at[i], side="right")) - 1
                    same = (whole[lo[i] : hi[i]] == data[at[i] : at[i] + size]).all(axis=1)
                    out |= {(d, int(x)) for x in ids[lo[i] : hi[i]][same]}
        return sorted(out)

    def matches(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Distinct (text, segment) pairs in which some region is within the segment's edit budget."""
        none = np.zeros((0, 2), np.int64)
        if not len(self.size) or len(data) < Q:
            return none
        grams = Hashes(data).grams(Q)
        at = np.flatnonzero(self.seen[(grams >> np.uint64(64 - BITS)).astype(np.int64)])
        h = grams[at]
        lo = np.searchsorted(self.hash, h)
        at, lo, h = (v[real] for real in [self.hash[np.minimum(lo, len(self.hash) - 1)] == h] for v in (at, lo, h))
        doc = np.searchsorted(off, at, side="right") - 1
        inside = at + Q <= off[doc + 1]
        at, lo, h, doc = at[inside], lo[inside], h[inside], doc[inside]
        if not len(at):
            return none
        # Any pattern's bound needs so many hits within so many bytes; most texts end here.
        reach, least = int((self.size + self.budget).max()), max(1, int(self.bound.min()))
        if len(at) < least:
            return none
        tail = at[least - 1 :] - at[: len(at) - least + 1] <= reach
        edges = np.zeros(len(at) + 1, np.int64)
        starts = np.flatnonzero(tail)
        np.add.at(edges, starts, 1)
        np.add.at(edges, starts + least, -1)
        dense = np.cumsum(edges[:-1]) > 0
        at, lo, h, doc = at[dense], lo[dense], h[dense], doc[dense]
        if not len(at):
            return none
        copies = np.searchsorted(self.hash, h, side="right") - lo
        found = []
        step = max(1, (1 << 22) // max(1, int(copies.max())))
        bounds = [0]
        while bounds[-1] < len(at):  # blocks end between texts, so no band is cut
            end = min(len(at), bounds[-1] + step)
            bounds.append(int(np.searchsorted(doc, doc[end - 1], side="right")))
        for x, y in zip(bounds[:-1], bounds[1:], strict=True):
            parts = -(-int(copies[x:y].sum()) // PAIRS)
            if parts <= 1:
                found.append(self._bands(data, off, at[x:y], lo[x:y], copies[x:y], doc[x:y]))
                continue
            # Counts are by segment: with very many hits, some segments at a time.
            first = self.group[lo[x:y]] * (len(self.size) + 1)
            cuts = np.unique(np.linspace(0, len(self.size), parts + 1).astype(int))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                low, high = np.searchsorted(self.place, first + a), np.searchsorted(self.place, first + b)
                some = high > low
                if some.any():
                    found.append(self._bands(data, off, at[x:y][some], low[some], (high - low)[some], doc[x:y][some]))
        return np.unique(np.concatenate([none, *found]), axis=0)

    def _bands(self, data, off, at, lo, copies, doc) -> np.ndarray:
        i = np.arange(copies.sum()) + np.repeat(lo - (np.cumsum(copies) - copies), copies)
        seg, d = self.seg[i], np.repeat(doc, copies)
        diagonal = np.repeat(at - off[doc], copies) - self.pos[i]
        width = self.budget[seg] + 1
        # Bands are 2*width diagonals wide and begin every width diagonals: two diagonals within width share one.
        band = diagonal // width
        d, seg, band = np.concatenate([d, d]), np.concatenate([seg, seg]), np.concatenate([band, band - 1])
        order = np.lexsort((band, seg, d))
        d, seg, band = d[order], seg[order], band[order]
        new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (seg[1:] != seg[:-1]) | (band[1:] != band[:-1])]))
        count = np.diff(np.concatenate([new, [len(d)]]))
        keep = new[count >= self.bound[seg[new]]]
        d, seg, band = d[keep], seg[keep], band[keep]
        good = np.zeros(len(d), bool)
        for x in range(0, len(d), 4096):
            part = slice(x, x + 4096)
            good[part] = self._aligned(data, off, d[part], seg[part], band[part])
        return np.stack([d[good], seg[good]], axis=1)

    def _aligned(self, data, off, d, seg, band) -> np.ndarray:
        """Whether the segment aligns with a region of the text along the band within its budget: edit distance by rows,
        in band coordinates, with free ends in the text."""
        k = self.budget[seg]
        low = band * (k + 1) - k  # the band and k diagonals on either side
        width = int((4 * (k + 1)).max())
        col = np.arange(width)
        size, far = self.size[seg], 1 << 20
        base, end = off[d] + low, off[d + 1]
        # Diagonal c of row i stands before text place low + i + c; places outside the text cannot be reached.
        place = low[:, None] + col
        row = np.where((place >= 0) & (place <= (end - off[d])[:, None]), 0, far)
        best = np.full(len(d), far)
        for i in range(int(size.max())):
            byte = base[:, None] + i + col
            inside = (byte >= off[d][:, None]) & (byte < end[:, None])
            cost = np.where(inside, (data[np.clip(byte, 0, len(data) - 1)] != self.bytes[seg, i][:, None]).astype(int), far)
            nxt = row + cost
            nxt[:, :-1] = np.minimum(nxt[:, :-1], row[:, 1:] + 1)
            nxt = np.minimum.accumulate(nxt - col, axis=1) + col
            row = np.minimum(nxt, far)
            done = size == i + 1
            best[done] = row[done].min(axis=1)
        return best <= k


def item_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The items of the query set, in blocks of about half of ``block_bytes``."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null and item_id is not null").distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-2 * total // block_bytes))
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id").collect()
        yield [(r.item_id, r.text) for r in rows]


def contamination(docs: DataFrame, benchmark: DataFrame, rate: float = 0.08, block_bytes: int = 8 << 20) -> DataFrame:
    """One row per document: doc_id, contaminated, item_ids (ascending ids of the benchmark items found).

    A document holds an item if a region of its normalised text is within ``rate`` edits a byte of a segment of the
    item (an item of up to 160 bytes is one segment; a longer one has segments of 80 bytes at least); of an item of less
    than 30 bytes, if it stands there exactly, between ends of words (Han, kana, Thai, Lao, Myanmar and Khmer letters are
    words of their own). A null or empty text holds nothing. Items that are
    null or blank are never found; with no items nothing is. Repeated rows are judged alike; an empty table gives no
    rows. Other columns are ignored.
    """
    out = first = texts(docs).withColumn("item_ids", F.array().cast("array<long>"))
    for items in item_blocks(benchmark, block_bytes):
        if out is not first:  # of several blocks only one is held at a time
            out = written(out, "contamination")
        out = out.mapInArrow(_finder(items, rate), "doc_id long, text string, item_ids array<long>")
    ids = F.array_sort(F.array_distinct("item_ids"))
    return out.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), ids.alias("item_ids"))


def _finder(items: list[tuple[int, str]], rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(items, rate)
        for b in slices(batches):
            got = b.column("item_ids").to_pylist()
            for d, item in index.found(*normal(*utf8(b.column("text")))):
                got[d] = [*got[d], item]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array(got, pa.list_(pa.int64()))], ["doc_id", "text", "item_ids"])

    return run


def keep_clean(docs: DataFrame, benchmark: DataFrame, rate: float = 0.08, block_bytes: int = 8 << 20) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item (see ``contamination``)."""

    def cleaner(items: list[tuple[int, str]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(items, rate)
            for b in slices(batches):
                clean = np.ones(b.num_rows, bool)
                clean[[d for d, _ in index.found(*normal(*utf8(b.column("text"))))]] = False
                yield b.filter(pa.array(clean))

        return run

    out = docs
    for items in item_blocks(benchmark, block_bytes):
        if out is not docs:  # of several blocks only one is held at a time
            out = written(out, "clean")
        out = out.mapInArrow(cleaner(items), docs.schema)
    return out
