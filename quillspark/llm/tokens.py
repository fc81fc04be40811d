"""Whole-text encoding with the ``tokenizers`` library, one library call per distinct chunk.

Both vocabularies used here pre-split a text so that no token crosses the place where a non-space is followed by
ASCII white space, or a letter by ASCII punctuation but the apostrophe. A text is cut there, every distinct chunk is encoded once by the library, and a batch becomes a
gather from a pool of ids. Texts with other white space (where the cut is not safe) go to the library whole.
"""

from __future__ import annotations

import os
import re
import zlib
from itertools import islice, repeat

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: White space beyond ASCII, and the ASCII separators that some regex engines count as white space.
OTHER_SPACE = re.compile("[\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200b\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]")
#: A run of letters before white space, ASCII punctuation or the end (not U+0130, whose lower case has a mark), or whatever
#: is no white space.
_WORD = "[A-Za-zÀ-ÖØ-öø-įı-ɏ]+(?=[ \t\n\x0b\x0c\r!-&(-/:-@\\[-`{-~]|\\Z)|[^ \t\n\x0b\x0c\r]+"
#: Chunks with the white space before them, and without white space.
CHUNK, BARE = re.compile(f"[ \t\n\x0b\x0c\r]*(?:{_WORD})|[ \t\n\x0b\x0c\r]+"), re.compile(_WORD)


class ChunkEncoder:
    """Encodes batches of texts; keeps up to ``most`` chunks, then goes on with the half that it met first, in which
    the frequent ones are.

    New chunks go to the library many at a time, joined by a mark that it always makes a token of its own: a line feed
    where white space is kept, else a control character between spaces. Chunks in which white space or the mark could
    join the mark's token go alone.
    """

    def __init__(self, path: str, keeps_space: bool, most: int = 600_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.keeps_space, self.most = keeps_space, most
        self.mark = "\n" if keeps_space else " \x01 "
        self.unsafe = re.compile(("(?s).[ \t\n\x0b\x0c\r]|^[\t\n\x0b\x0c\r]|^ ?$|" if keeps_space else "") + "[\x00-\x08]|" + OTHER_SPACE.pattern)
        marks = self.library.encode(f"a{self.mark}b", add_special_tokens=False).ids
        self.mark_id = marks[1] if len(marks) == 3 else None
        self._clear()

    def _clear(self) -> None:
        self.known: dict = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)

    def rest(self) -> None:
        """Between tasks: hold no more than a third."""
        if len(self.known) > self.most // 3:
            self._forget(self.most // 3)

    def _forget(self, keep: int) -> None:
        self.known = dict(islice(self.known.items(), keep))
        self.used = int((self.starts[:keep] + self.sizes[:keep]).max(initial=0))

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list) -> None:
        first = len(self.known) - len(chunks)
        if len(self.known) > len(self.starts):
            room = max(2 * len(self.starts), len(self.known))
            self.starts, self.sizes = np.resize(self.starts, room), np.resize(self.sizes, room)
        search = self.unsafe.search
        joined, alone = [], []
        for i, t in enumerate(chunks):
            (alone if self.mark_id is None or search(t) else joined).append(i)
        pools, order, sizes = [], [], []
        for at in range(0, len(joined), 1 << 14):
            part = joined[at : at + (1 << 14)]
            ids = np.array([x for i in self._library([self.mark.join([chunks[i] for i in part[j : j + 256]]) + self.mark for j in range(0, len(part), 256)]) for x in i], np.uint32)
            ends = np.flatnonzero(ids == self.mark_id)
            if len(ends) != len(part):
                raise ValueError("the mark is not a token of its own in this vocabulary")
            pools.append(np.delete(ids, ends))
            sizes.append(np.diff(ends, prepend=-1) - 1)
            order.append(np.array(part))
        if alone:
            ids = self._library([chunks[i] for i in alone])
            pools.append(np.array([x for i in ids for x in i], np.uint32))
            sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            order.append(np.array(alone))
        new, sizes, order = np.concatenate(pools), np.concatenate(sizes), np.concatenate(order) + first
        if self.used + len(new) > len(self.flat):
            self.flat = np.resize(self.flat, max(2 * len(self.flat), self.used + len(new)))
        self.flat[self.used : self.used + len(new)] = new
        self.starts[order] = self.used + np.cumsum(sizes) - sizes
        self.sizes[order] = sizes
        self.used += len(new)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the offsets at which each text begins (one more than texts)."""
        if len(self.known) > self.most:
            self._forget(self.most // 2)
        parts, counts = [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if OTHER_SPACE.search(t):
                got = [t]
            else:
                got = (CHUNK if self.keeps_space else BARE).findall(t)
            counts[i] = len(got)
            parts += got
        known = self.known
        index = np.fromiter(map(known.get, parts, repeat(-1)), np.int64, len(parts))
        if len(missing := np.flatnonzero(index < 0)):
            before = len(known)
            for i in missing.tolist():
                index[i] = known.setdefault(parts[i], len(known))
            self._learn(list(islice(known, before, None)))
        sizes = self.sizes[index].astype(np.int64)
        ends = np.cumsum(sizes)
        place = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[index] - (ends - sizes), sizes)
        at = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return self.flat[place], at


_encoders: dict = {}


def encoder(path: str, keeps_space: bool) -> ChunkEncoder:
    """One encoder per worker process."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path, keeps_space)
    return _encoders[path]


def with_end(ids: np.ndarray, at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Append ``end`` to each text's ids."""
    return np.insert(ids, at[1:], end).astype(np.uint32), at + np.arange(len(at))


def crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").data)
