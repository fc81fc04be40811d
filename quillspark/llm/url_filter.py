"""URL rules and glob lists, all tested at once by a bit-parallel wildcard automaton.

Every glob owns a stretch of bits in a row of 64-bit words: a start bit and a bit for each character. Reading a byte moves
all bits one place on where the byte fits (Shift-And, with carries between the words) and keeps the bits in front of a
wildcard. The tables have a row of words for each of the 256 byte values, so their size follows the rules alone.

In a glob, ``?`` stands for one character, ``*`` for any number of characters but ``/``, ``**`` for any number of
characters. A glob must fit the whole canonical URL: the host in lower case, then the path.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most words of state (rows by words) that a step of the automaton holds.
STATE_WORDS = 1 << 21

OUT = "page_id long, host string, path string, rule string, pattern string, verdict string"
_SCHEMA = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("pattern", pa.string()), ("verdict", pa.string())])


class GlobAutomaton:
    """All of ``globs`` in one row of bits. ``first`` gives the best fitting glob of each text; earlier globs are better."""

    def __init__(self, globs: list[str]):
        steps = [[x.encode() for x in re.findall(r"\*\*|\*|[^*]", g, re.S)] for g in globs]
        size = sum(1 + sum(len(x) for x in s if x[:1] != b"*") for s in steps)
        self.words = max(1, -(-size // 64))
        move, stay = np.zeros((256, size + 1), bool), np.zeros((256, size + 1), bool)
        begin, end = np.zeros(size + 1, bool), np.full(size + 1, -1, np.int64)
        every, inner, tail = np.ones(256, bool), np.ones(256, bool), np.zeros(256, bool)
        inner[ord("/")] = False
        tail[0x80:0xC0] = True  # bytes within a character
        at = 0
        for number, s in enumerate(steps):
            begin[at] = True
            for x in s:
                if x == b"**":
                    stay[every, at] = True
                elif x == b"*":
                    stay[inner, at] = True
                elif x == b"?":
                    at += 1
                    move[~tail, at] = stay[tail, at] = True
                else:
                    for byte in x:
                        at += 1
                        move[byte, at] = True
            if end[at] < 0:
                end[at] = number
            at += 1
        self.move, self.stay, self.begin = self._packed(move), self._packed(stay), self._packed(begin[None])[0]
        self.accept = self._packed((end >= 0)[None])[0]
        self.number, self.count = end, len(globs)

    def _packed(self, bits: np.ndarray) -> np.ndarray:
        """Rows of bits as rows of 64-bit words, the first bit lowest."""
        wide = np.zeros((len(bits), self.words * 64), bool)
        n = min(bits.shape[1], wide.shape[1])
        wide[:, :n] = bits[:, :n]
        return np.packbits(wide, axis=1, bitorder="little").view("<u8").astype(np.uint64)

    def _run(self, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Bits after the last byte of each text. Longest texts first, so the rows still read are the first ones."""
        state = np.repeat(self.begin[None], len(starts), axis=0)
        one, top = np.uint64(1), np.uint64(63)
        reading = np.searchsorted(-sizes, -np.arange(int(sizes[0]) if len(sizes) else 0), "left")  # rows longer than the place
        for place, rows in enumerate(reading.tolist()):
            now, byte = state[:rows], flat[starts[:rows] + place]
            next_ = now << one
            if self.words > 1:
                next_[:, 1:] |= now[:, :-1] >> top
            next_ &= self.move[byte]
            next_ |= now & self.stay[byte]
            state[:rows] = next_
        return state

    def first(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The number of the first glob that fits each text (``flat`` bytes cut at ``offsets``); -1 where none does."""
        sizes = np.diff(offsets)
        best = np.full(len(sizes), self.count, np.int64)
        order = np.argsort(-sizes, kind="stable")
        most = max(1, STATE_WORDS // self.words)
        for lo in range(0, len(order), most):
            rows = order[lo : lo + most]
            hits = self._run(flat, offsets[:-1][rows], sizes[rows]) & self.accept
            for word in np.flatnonzero(hits.any(axis=0)).tolist():
                some = np.flatnonzero(hits[:, word])
                for bit in range(64):
                    if (int(self.accept[word]) >> bit) & 1:
                        fit = some[(hits[some, word] >> np.uint64(bit)) & np.uint64(1) == 1]
                        best[rows[fit]] = np.minimum(best[rows[fit]], self.number[word * 64 + bit])
        return np.where(best < self.count, best, -1)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``,
    ``#`` or the end. Both empty for null and where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    whole = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(whole, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(whole, r"^[^/?#]*([^?#]*)", 1)


def rule_globs(rule: str) -> list[str]:
    """A rule (host, then a path that begins with ``/``) as globs: its host and all subdomains, the path as a prefix."""
    if "/" not in rule or set(rule) & set("*?"):
        raise ValueError(f"a rule is a host and a path without wildcards: {rule}")
    return [f"{rule}**", f"*.{rule}**"]


def _judge(rules: list[tuple[str, str]], globs: list[tuple[str, str]], usual: str):
    # Rules before globs; the longest first, of equal ones those that block.
    ranked = [(r, None, verdict, g) for verdict, r in sorted(rules, key=lambda x: (-len(x[1]), x[0] != "block")) for g in rule_globs(r)]
    ranked += [(None, g, verdict, g) for verdict, g in sorted(globs, key=lambda x: (-len(x[1].replace("*", "")), x[0] != "block"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = GlobAutomaton([x[3] for x in ranked])
        names = [pa.array([x[k] for x in ranked] + [None if k < 2 else usual], pa.string()) for k in range(3)]
        for b in slices(batches, "canonical"):
            data = [(x or "").encode() for x in b.column("canonical").to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
            found = automaton.first(np.frombuffer(b"".join(data), np.uint8), offsets)
            take = pa.array(np.where(found < 0, len(ranked), found))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("host"), b.column("path"), *(x.take(take) for x in names)], schema=_SCHEMA)

    return run


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str]], globs: list[tuple[str, str]] = (), usual: str = "allow") -> DataFrame:
    """page_id, host, path, rule, pattern (the glob that decided, if no rule did) and verdict (allow or block) of every row of ``pages`` (page_id, url).

    ``rules`` and ``globs`` are pairs (verdict, text). The longest fitting rule decides; without one, the fitting glob
    with most characters but wildcards; without one, ``usual``. Ties block. A null url, or one without ``://``, has an
    empty host and path, which fit a glob of wildcards only. Rows that repeat, or have no page_id, each give a row;
    other columns are not read."""
    host, path = host_and_path(F.col("url"))
    d = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("canonical", F.concat("host", "path"))
    return d.mapInArrow(_judge(list(rules), list(globs), usual), OUT)


#: Rules and lists of the registered query.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
GLOBS = [("block", "*spam*"), ("block", "*spam*/**"), ("block", "*casino*"), ("block", "*casino*/**"), ("block", "**/wp-admin/**"), ("block", "**.exe"), ("block", "ads?.*/**")]
