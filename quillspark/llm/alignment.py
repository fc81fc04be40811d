"""Tokens of two vocabularies aligned by their bytes, through a dictionary of groups.

A text's tokens under A and B are cut into groups at the byte offsets at which a token of either ends. The same groups
come again and again, so groups are interned: blocks of documents list their distinct groups once, the distinct groups of
all blocks are summed into one dictionary, links are made once for each distinct group and multiplied by its frequency,
and what a group is worth goes back to the blocks that hold it, by group key.

Texts are cut before a space or line feed that follows a character that is no white space, and between a Latin letter and
ASCII punctuation: no token of either vocabulary crosses such a place (B: checked when it is loaded), so a distinct chunk
is encoded once per worker.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freed, removed, slices, texts, written

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Bytes of text in a block, and chunks that a worker remembers.
BLOCK, REMEMBERED = 8 << 20, 300_000

_WHITE, _LETTER, _MARK = "\\s\u180e\u200b\ufeff", "A-Za-zÀ-ÖØ-öø-ɏ", "!-/:-@\\[-`{-~"
#: From one place where texts are cut to the next.
CHUNK = re.compile(f"(?s:.)(?:[^ \n{_MARK}]+|(?<=[{_WHITE}])[ \n]|(?<![{_LETTER}])[{_MARK}])*")
#: What no piece of B may have: letters before a space or line feed, or a letter before punctuation.
CROSSING = re.compile(f"[^▁]▁|\n|[{_LETTER}][{_MARK}]")


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [x for x in range(256) if x not in set(plain)]
    return {chr(x): x for x in plain} | {chr(0x100 + i): x for i, x in enumerate(rest)}


class Vocabularies:
    """Both encoders, and the bytes of every token."""

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        alphabet = byte_alphabet()
        size = 1 + max(self.a.get_vocab(with_added_tokens=True).values())
        entries = [self.a.id_to_token(i) or "" for i in range(size)]
        self.a_bytes = [bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for t in entries]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(CROSSING.search(p) for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))):
            raise ValueError("pieces of this vocabulary cross the places where texts are cut")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = list(map(len, self.a_bytes)), list(map(len, self.b_bytes))
        self.space = self.b.piece_to_id("▁")

    def encode(self, chunks: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of chunks as ``CHUNK`` cuts them. B puts a space before whatever it gets, which stands for a chunk's own
        first space. Other chunks are given to B behind a line feed, whose token joins no other; both are taken away."""
        a = [e.ids for e in self.a.encode_batch_fast(chunks, add_special_tokens=False)]
        extra = [0 if c[0] == " " else 1 if c[0] == "\n" else 2 for c in chunks]
        b = self.b.encode([c[1:] if n == 0 else c if n == 1 else "\n" + c for c, n in zip(chunks, extra, strict=True)], num_threads=1)
        return [(x, [self.space] if c == " " else y[n:]) for c, x, y, n in zip(chunks, a, b, extra, strict=True)]

    def groups(self, chunk: str, a: list[int], b: list[int]) -> list[str] | None:
        """The keys ``a1,a2|b1`` of the chunk's groups; None if the tokens of A or B do not spell it."""
        whole = chunk.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != whole or b"".join(map(self.b_bytes.__getitem__, b)) != whole:
            return None
        if len(a) == 1 or len(b) == 1:
            return [f"{','.join(map(str, a))}|{','.join(map(str, b))}"]
        out, j, ahead, first_b, held = [], 0, 0, 0, ""  # ahead: bytes that A has before B
        for i in a:
            ahead += self.a_size[i]
            while ahead > 0:
                ahead -= self.b_size[b[j]]
                j += 1
            held = f"{held},{i}" if held else str(i)
            if not ahead:
                out.append(f"{held}|{','.join(map(str, b[first_b:j]))}")
                first_b, held = j, ""
        return out


def grown(old: np.ndarray, size: int) -> np.ndarray:
    return old if size <= len(old) else np.resize(old, max(2 * len(old), size))


class GroupCache:
    """Chunks seen by this worker, with their groups. Over ``most`` chunks, or ``room`` bytes of them, it goes on with
    the half that it met first."""

    def __init__(self, vocabularies: Vocabularies, most: int = REMEMBERED, room: int = 64 << 20):
        self.v, self.most, self.room = vocabularies, most, room
        self.known: dict[str, int] = {}
        self.names: list[bytes] = []  # a chunk's groups, spelled out
        self.unspelled: set[int] = set()
        self.groups: dict[str, int] = {}
        self.members = np.zeros(1 << 16, np.int32)
        self.starts, self.sizes = np.zeros(1 << 14, np.int64), np.zeros((1 << 14, 2), np.int64)

    def trim(self) -> None:
        """Forget the later half, and the groups that only it has. Group numbers change what they mean, so a block must
        not be open."""
        while len(self.known) > self.most or sum(map(len, self.known)) > self.room:
            keep = min(self.most, len(self.known)) // 2
            self.known = dict(islice(self.known.items(), keep))
            del self.names[keep:]
            self.unspelled = {x for x in self.unspelled if x < keep}
            used = int(self.members[: self.starts[keep]].max(initial=-1)) + 1
            self.groups = dict(islice(self.groups.items(), used))

    def _learn(self, chunks: list[str]) -> None:
        first, new, at = len(self.names), [], int(self.starts[len(self.names)])
        last = first + len(chunks)
        self.starts = grown(self.starts, last + 1)
        if last > len(self.sizes):
            self.sizes = np.concatenate([self.sizes, np.zeros((max(len(self.sizes), last), 2), np.int64)])
        for number, (chunk, (a, b)) in enumerate(zip(chunks, self.v.encode(chunks), strict=True), first):
            found = self.v.groups(chunk, a, b)
            if found is None:
                self.unspelled.add(number)
            keys = found or []
            self.names.append(";".join(keys).encode())
            self.sizes[number] = len(a), len(b)
            new += [self.groups.setdefault(k, len(self.groups)) for k in keys]
            self.starts[number + 1] = at + len(new)
        self.members = grown(self.members, at + len(new))
        self.members[at : at + len(new)] = new

    def look_up(self, several: list[str]) -> list[np.ndarray | None]:
        """For each text the numbers of its chunks; None if it is empty or its tokens do not spell it."""
        parts = [CHUNK.findall(" " + t) if t else [] for t in several]
        known = self.known
        new = list(dict.fromkeys(c for p in parts for c in p if c not in known))
        if new:
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            self._learn(new)
        found = [np.fromiter(map(known.__getitem__, p), np.int64, len(p)) for p in parts]
        return [None if not len(x) or self.unspelled and not self.unspelled.isdisjoint(x.tolist()) else x for x in found]

    def members_of(self, at: np.ndarray) -> np.ndarray:
        """Group numbers of chunks, one after the other."""
        first, sizes = self.starts[at], self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(sizes)
        return self.members[np.arange(int(ends[-1])) + np.repeat(first - (ends - sizes), sizes)]


_BLOCKS = pa.schema([
    ("block", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())),
    ("sizes", pa.list_(pa.list_(pa.int64()))),  # n_a, n_b, n_groups, distinct groups
    ("digests", pa.list_(pa.string())),
    ("held", pa.binary()),  # which of the block's groups each document holds, and how often
    ("keys", pa.list_(pa.string())),
    ("links", pa.list_(pa.int64())),
    ("documents", pa.list_(pa.int64())),
])
_BLOCKS_SQL = "block long, doc_ids array<long>, sizes array<array<long>>, digests array<string>, held binary, keys array<string>, links array<long>, documents array<long>"


def _block_row(block: int, docs: list, cache: GroupCache) -> pa.RecordBatch:
    """A block as one row; its distinct groups are numbered anew, so that a document's groups are small ascending numbers."""
    every = np.concatenate([d[3] for d in docs])
    used, place = np.unique(every, return_inverse=True)
    times = np.concatenate([d[4] for d in docs])
    links = np.bincount(place, times, len(used)).astype(np.int64)
    held_by = np.bincount(place, minlength=len(used)).astype(np.int64)
    by_number = list(cache.groups)
    ends = np.cumsum([len(d[3]) for d in docs])
    steps = place.astype(np.int64)
    steps[1:] -= place[:-1]
    firsts = np.concatenate([[0], ends[:-1]])[[len(d[3]) > 0 for d in docs]]
    steps[firsts] = place[firsts]
    held = zlib.compress(np.stack([steps, times]).astype("<i4").tobytes(), 1)
    sizes = [[*d[1], d[2], len(d[3])] for d in docs]
    row = [[block], [[d[0] for d in docs]], [sizes], [[d[5] for d in docs]], [held], [[by_number[i] for i in used.tolist()]], [links], [held_by]]
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, _BLOCKS, strict=True)], schema=_BLOCKS)


_caches: dict = {}


def _encoded(a_path: str, b_path: str):
    none = np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (a_path, b_path)
        if key not in _caches:
            _caches[key] = GroupCache(Vocabularies(*key))
        cache, docs, held, number = _caches[key], [], 0, TaskContext.get().partitionId() << 32
        cache.trim()
        for b in slices(batches):
            several = b.column("text").to_pylist()
            for doc_id, t, at in zip(b.column("doc_id").to_pylist(), several, cache.look_up(several), strict=True):
                if at is None:
                    docs.append((doc_id, (0, 0), 0, none, none, ""))
                else:
                    members = cache.members_of(at)
                    groups, times = np.unique(members, return_counts=True)
                    digest = hashlib.sha256(b";".join(map(cache.names.__getitem__, at.tolist()))).hexdigest()
                    docs.append((doc_id, tuple(cache.sizes[at].sum(axis=0).tolist()), len(members), groups, times, digest))
                held += len(t) + 256
            if held >= BLOCK:
                yield _block_row(number, docs, cache)
                docs, held, number = [], 0, number + 1
                cache.trim()
        if docs:
            yield _block_row(number, docs, cache)
        freed()

    return run


OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_OUT = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", pa.string())])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with what their groups are worth, to documents."""
    for b in batches:
        for k in range(b.num_rows):
            doc_ids, digests = (b.column(c)[k].values for c in ("doc_ids", "digests"))
            sizes = b.column("sizes")[k].values.flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
            steps, times = np.frombuffer(zlib.decompress(b.column("held")[k].as_py()), "<i4").reshape(2, -1).astype(np.int64)
            ends = np.cumsum(sizes[:, 3])
            owner = np.repeat(np.arange(len(sizes)), sizes[:, 3])
            run = np.cumsum(steps)
            before = np.concatenate([[0], run])[ends - sizes[:, 3]]  # documents start from 0
            place = run - before[owner]
            got = b.column("worth")[k]
            worth = np.zeros((3, len(got) if got.is_valid else 0), np.int64)
            if got.is_valid:
                fields = got.values
                at = fields.field("place").to_numpy(zero_copy_only=False)
                for i, name in enumerate(("n_links", "n_best", "count_sum")):
                    worth[i, at] = fields.field(name).to_numpy(zero_copy_only=False)
            sums = [_per_document(owner, worth[i, place] * times, len(sizes)) for i in range(3)]
            yield pa.RecordBatch.from_arrays([doc_ids, *(pa.array(sizes[:, i]) for i in range(3)), *map(pa.array, sums), digests], schema=_OUT)
    freed()


def _per_document(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Exact sums of 64-bit integers."""
    out = np.zeros(n, np.int64)
    np.add.at(out, owner, values)
    return out


@dataclass
class Alignment:
    """``documents``: a row a document; ``groups``: key, links (occurrences), documents; ``pairs``: a, b, count, best."""

    documents: DataFrame
    groups: DataFrame
    pairs: DataFrame


def align(docs: DataFrame, a_path: str, b_path: str) -> Alignment:
    """Aligns the tokens of every text of ``docs`` (doc_id, text) under a byte-level BPE (A) and a SentencePiece model (B).

    A link joins a token of A and one of B whose byte ranges end together. Groups are cut at every such offset, so a
    group has one link, between its last tokens. ``pairs`` counts links by (a, b); ``best`` marks the pairs with the most
    links of their b. Texts that are null or empty, or that the tokens of A or B do not spell byte by byte (U+2581 in a
    text), have no tokens: zeros and an empty digest. Rows that repeat a doc_id, or have none, each give a row, and count.
    Other columns are not read. The written tables belong to the caller."""
    blocks = written(texts(docs).mapInArrow(_encoded(a_path, b_path), _BLOCKS_SQL), "alignment-blocks")
    held = blocks.select("block", F.posexplode(F.arrays_zip("keys", "links", "documents")).alias("place", "g")).select("block", "place", "g.keys", "g.links", "g.documents")
    groups = written(held.groupBy(F.col("keys").alias("key")).agg(F.sum("links").alias("links"), F.sum("documents").alias("documents")), "alignment-groups")
    last = lambda side: F.substring_index(F.split_part("key", F.lit("|"), F.lit(side)), ",", -1).cast("int")
    linked = groups.select("key", "links", last(1).alias("a"), last(2).alias("b"))
    counted = linked.groupBy("a", "b").agg(F.sum("links").alias("count"))
    top = counted.groupBy("b").agg(F.max("count").alias("top"))  # a row for each entry of B at most
    pairs = written(counted.join(F.broadcast(top), "b").select("a", "b", "count", (F.col("count") == F.col("top")).alias("best")), "alignment-pairs")
    worth = linked.join(pairs, ["a", "b"]).select(F.col("key").alias("keys"), F.lit(1).cast("long").alias("n_links"), F.col("best").cast("long").alias("n_best"), F.col("count").alias("count_sum"))
    back = held.select("block", "place", "keys").join(worth, "keys").groupBy("block").agg(F.collect_list(F.struct("place", "n_links", "n_best", "count_sum")).alias("worth"))
    whole = blocks.select("block", "doc_ids", "sizes", "digests", "held").join(back, "block", "left")
    documents = written(whole.select("doc_ids", "sizes", "digests", "held", "worth").mapInArrow(_summed, OUT), "alignment-documents")
    removed(blocks)
    return Alignment(documents, groups, pairs)
