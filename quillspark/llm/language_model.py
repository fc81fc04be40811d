"""Language-model scoring with a weighted backoff automaton.

The model is an interpolated trigram model: absolute discounting gives words and the unknown word their share, and a
Dirichlet prior of weight ``mu`` smooths every history towards the next shorter one. As an automaton: the root, the
start of a text, every word and every pair of words (or of the start and a word) seen in training are states; an n-gram
seen in training is an arc from its history to the state of its last two words, with its log-probability; a failure arc
leads from a state to that of its history without the first word, with the weight mu / (count + mu). One left-to-right
traversal carries the state and adds up the weights of arcs and failure arcs.

The model grows with the corpus and is never held in one place. Texts are read in blocks of bounded size. Each block
sends the sorted identifiers of its distinct words, pairs and triples, with training counts, to shards by range of
identifier; a shard adds up its counts and answers every block; a block then builds the part of the automaton that
its own texts can walk, and walks it. So a frequent word costs one entry a block, not one a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc_
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytegrams import BASE, LOWER, Hashes, mix, utf8, words
from .common import freed, shuffle_partitions, slices, texts, written

#: Identifiers of the end and of the start of a text.
END, START = np.uint64(0xE0D0C0B0A0908071), np.uint64(0x517CC1B727220A95)
BLOCK = 3 << 20
#: Shards of a task: it holds one at a time.
SHARDS_A_TASK = 4


def packed(v: np.ndarray) -> bytes:
    """Ascending 64-bit numbers: differences, byte by byte, compressed."""
    d = np.diff(v, prepend=np.uint64(0))
    return len(v).to_bytes(8, "little") + bytes(pa.compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True) if len(v) else b"")


def unpacked(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    if not n:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(pa.decompress(b[8:], decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def numbers(v: np.ndarray) -> bytes:
    """Small counts, compressed."""
    raw = np.ascontiguousarray(v, "<u8").view(np.uint8).reshape(-1, 8).T
    return len(v).to_bytes(8, "little") + (pa.compress(np.ascontiguousarray(raw).tobytes(), codec="zstd", asbytes=True) if len(v) else b"")


def from_numbers(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.decompress(b[8:], decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.int64)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers of the tokens (lower-cased words, then the end) of all texts, and the tokens before each text."""
    data, off = utf8(column)
    s, e, first = words(data, off)
    h = Hashes(LOWER[data]).of(s, e)
    return np.insert(h, first[1:], END), first + np.arange(len(first))


def ngrams(t: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Identifiers (56 bits) of (token before, token), the start before the first; of (pair before, token) for every
    token but the first of a text; and the places of those tokens."""
    before = np.empty_like(t)
    before[1:] = t[:-1]
    before[at[:-1]] = START
    bits = np.uint64((1 << 64) - (1 << 8))
    pairs = (mix(before * np.uint64(BASE) + t) ^ np.uint64(0x2545F4914F6CDD1D)) & bits
    later = np.ones(len(t), bool)
    later[at[:-1]] = False
    place = np.flatnonzero(later)
    return pairs, (mix(pairs[place - 1] * np.uint64(BASE) + t[place]) ^ np.uint64(0x6A09E667F3BCC909)) & bits, place


def trained(doc_id: str = "doc_id"):
    """Rows that the model learns from: crc32(doc_id as text) mod 10 is not 0. A row without doc_id is one."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 10 != 0, F.lit(True))


def counted(ids: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct identifiers, ascending, and how often training texts have each."""
    keys, inverse = np.unique(ids, return_inverse=True)
    return keys, np.bincount(inverse, train, len(keys)).astype(np.int64)


def shards_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's range begins in ascending keys."""
    edges = np.array([(i << 64) // shards for i in range(shards)], np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))


def columns(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows, strict=True), types, strict=True)], list(names))


class Blocks:
    """Numbers the blocks of a task's rows, row by row: whatever batches they come in (their size is a setting, and need
    not be the same when a table is read again), the same rows make the same blocks. Both passes read the same table in
    the same tasks, so they agree; a shard's answer tells how many identifiers it is for, and a block that differs
    fails loudly."""

    def __init__(self):
        self.part, self.seq, self.size = TaskContext.get().partitionId(), 0, 0

    def cut(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, tuple[int, int]]]:
        """Slices of bounded size, each within one block: its number, and one that spreads blocks evenly."""
        for b in slices(batches, most=BLOCK // 4):
            lo = 0
            for i, size in enumerate(pc_.fill_null(pc_.binary_length(b.column("text")), 0).to_pylist()):
                if self.size and self.size + size > BLOCK:
                    if i > lo:
                        yield b.slice(lo, i - lo), self._now()
                    self.seq, self.size, lo = self.seq + 1, 0, i
                self.size += size
            yield b.slice(lo), self._now()

    def _now(self) -> tuple[int, int]:
        return self.part << 24 | self.seq, self.part + 7919 * self.seq


ASK = "shard int, block long, spread long, words binary, word_counts binary, grams binary, gram_counts binary, starts long"


def _ask(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, now, held = Blocks(), None, []

        def flush() -> pa.RecordBatch:
            w, p, train, p_train, starts = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            (wk, wc), (gk, gc) = counted(w, train), counted(p, p_train)
            wa, ga = shards_of(wk, shards), shards_of(gk, shards)
            rows, starts = [], int(starts.sum())
            for i in np.flatnonzero((np.diff(wa) > 0) | (np.diff(ga) > 0)).tolist():
                a, b = slice(wa[i], wa[i + 1]), slice(ga[i], ga[i + 1])
                rows.append((i, now[0], now[1], packed(wk[a]), numbers(wc[a]), packed(gk[b]), numbers(gc[b]), starts))
                starts = 0
            return columns(rows, ASK)

        for b, block in blocks.cut(batches):
            if now and now != block:
                yield flush()
            now = block
            t, at = tokens(b.column("text"))
            pairs, triples, place = ngrams(t, at)
            train = np.asarray(b.column("train").cast(pa.int8()))
            each = np.repeat(train, np.diff(at))
            held.append((t, np.concatenate([pairs, triples]), each, np.concatenate([each, each[place]]), train.astype(np.int64)))
        if now:
            yield flush()

    return run


ANSWER = "block long, spread long, shard int, n_words int, n_grams int, word_counts binary, gram_counts binary, n long, v long, once long, twice long, starts long"


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the shards in this task, one after the other: sums of the counts, for every block that asked."""

    def answered(asked: list[dict]) -> Iterator[pa.RecordBatch]:
        sums = []
        for k in ("word", "gram"):
            keys = [unpacked(r[f"{k}s"]) for r in asked]
            every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(inverse, np.concatenate([from_numbers(r[f"{k}_counts"]) for r in asked]), len(every)).astype(np.int64)
            sums.append((total[inverse], np.concatenate([[0], np.cumsum([len(x) for x in keys])]), total))
        (wc, wa, total), (gc, ga, _) = sums
        stats = [int(total.sum()), int((total > 0).sum()), int((total == 1).sum()), int((total == 2).sum()), sum(r["starts"] for r in asked)]
        out = []
        for i, r in enumerate(asked):
            out.append((r["block"], r["spread"], r["shard"], int(wa[i + 1] - wa[i]), int(ga[i + 1] - ga[i]), numbers(wc[wa[i] : wa[i + 1]]), numbers(gc[ga[i] : ga[i + 1]]), *(stats if i == 0 else [0] * 5)))
            if len(out) == 512:
                yield columns(out, ANSWER)
                out = []
        if out:
            yield columns(out, ANSWER)

    asked: list[dict] = []
    for b in batches:
        shard = np.asarray(b.column("shard"))
        cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1), len(shard)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi > lo and asked and asked[0]["shard"] != shard[lo]:
                yield from answered(asked)
                asked = []
            asked += b.slice(lo, hi - lo).to_pylist()
    if asked:
        yield from answered(asked)
    del asked
    freed()


class BackoffAutomaton:
    """The part of the automaton that the texts of a block can walk. ``end`` marks ends of texts among the tokens, ``at``
    has the tokens before each text; ``word``, ``pair`` and ``triple`` number the words and n-grams that end at each
    token (triples: at each of ``place``), with their training counts.

    States are numbered: 0 the root, 1 the start, then the words, then the n-grams (a triple is no state of its own).
    Arcs are numbered like the word or n-gram that they read: the first words are the root's arcs; the arc of an n-gram
    leaves the state of its history. As a block's n-grams are numbered once, an arc is found without a search.
    """

    def __init__(self, end: np.ndarray, at: np.ndarray, word: np.ndarray, pair: np.ndarray, place: np.ndarray, triple: np.ndarray, word_counts: np.ndarray, gram_counts: np.ndarray, stats: dict, mu: float):
        n, v = max(1, stats["n"]), stats["v"]
        discount = stats["once"] / (stats["once"] + 2 * stats["twice"]) if stats["once"] and stats["twice"] else 0.5
        share = np.where(word_counts > 0, (word_counts - discount) / n, discount * v / n if v else 1.0)  # of the unknown word: all of its share
        words_ = slice(2, 2 + len(word_counts))
        count = np.concatenate([[n, stats["starts"]], word_counts, gram_counts])
        self.at, self.place = at, place
        self.word, self.pair, self.triple = word + 2, pair + words_.stop, triple + words_.stop
        self.exists = count > 0
        self.failure_weight = np.log10(mu / (count + mu))
        self.failure = np.zeros(len(count), np.int64)  # of the start and of words: the root
        known = self.exists[self.word]
        self.failure[self.pair] = np.where(known, self.word, 0)
        p, self.target = np.zeros(len(count)), np.zeros(len(count), np.int64)
        p[words_] = share
        self.target[words_] = np.where(word_counts > 0, np.arange(words_.start, words_.stop), 0)
        seen = np.full(len(word), stats["starts"])  # training count of the history of one token
        seen[place] = word_counts[word[place - 1]]
        of_word, of_pair = share[word], gram_counts[pair]
        lower = (of_pair + mu * of_word) / (seen + mu)  # without the history: the word's share, as seen is 0
        p[self.pair] = lower
        self.target[self.pair] = np.where(end, 0, self.pair)
        p[self.triple] = (gram_counts[triple] + mu * lower[place]) / (of_pair[place - 1] + mu)
        self.target[self.triple] = np.where(end[place], 0, self.pair[place])
        self.weight = np.zeros(len(count))
        np.log10(p, out=self.weight, where=p > 0)

    def step(self, state: int, i: int) -> tuple[float, int]:
        """The weight of reading token ``i`` from ``state``, failure arcs included, and the state then."""
        total, arcs = 0.0, {0: self.word[i], 1: self.pair[i]}
        while True:
            order = 0 if not state else 1 if state < self.pair.min() else 2
            arc = self.triple[np.searchsorted(self.place, i)] if order == 2 else arcs[order]
            if not order or self.exists[arc]:
                return total + self.weight[arc], int(self.target[arc])
            total, state = total + self.failure_weight[state], int(self.failure[state])

    def walk(self) -> np.ndarray:
        """Log10 weight of every step of the left-to-right traversal of each text from its start. The state before a
        token is the longest of its last two tokens that is one, so all places are walked at once, longest state first:
        an arc where there is one, else the failure arc and on from the next shorter state."""
        total, left = np.zeros(len(self.word)), np.ones(len(self.word), bool)
        state = self.pair[self.place - 1]
        some = self.exists[state]
        hit = some & self.exists[self.triple]
        total[self.place] = np.where(hit, self.weight[self.triple], np.where(some, self.failure_weight[state], 0))
        left[self.place[hit]] = False
        state = np.ones(len(self.word), np.int64)
        state[self.place] = self.word[self.place - 1]
        left = np.flatnonzero(left)
        state, arc = state[left], self.pair[left]
        some = self.exists[state]
        total[left] += np.where(some & self.exists[arc], self.weight[arc], np.where(some, self.failure_weight[state], 0) + self.weight[self.word[left]])
        return total


def _walk(shards: int, stats: dict, mu: float):
    floor = stats["n"] + 0.1 * (stats["v"] + 1)

    def block_scores(answers: list[dict], rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        b = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        t, at = tokens(b.column("text"))
        pairs, triples, place = ngrams(t, at)
        wk, word = np.unique(t, return_inverse=True)
        gk, gram = np.unique(np.concatenate([pairs, triples]), return_inverse=True)
        wa, ga = np.diff(shards_of(wk, shards)), np.diff(shards_of(gk, shards))
        answers.sort(key=lambda r: r["shard"])
        if [(r["shard"], r["n_words"], r["n_grams"]) for r in answers] != [(i, wa[i], ga[i]) for i in np.flatnonzero(wa + ga)]:
            raise RuntimeError("the input was read in other blocks than before: pass a table that is read from storage")
        wc, gc = (np.concatenate([from_numbers(r[f"{k}_counts"]) for r in answers]) for k in ("word", "gram"))
        step = BackoffAutomaton(t == END, at, word, gram[: len(t)], place, gram[len(t) :], wc, gc, stats, mu).walk()
        count = wc[word]
        base = np.log10((count + 0.1) / floor)
        add = lambda v: np.add.reduceat(v, at[:-1])
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("train"), pa.array(np.diff(at)), pa.array(add((count > 0).astype(np.int64))), pa.array(add(base)), pa.array(add(step))], ["doc_id", "train", "n_tokens", "n_known", "base_score", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, answers, rows = None, [], []
        for b in batches:
            ids = np.asarray(b.column("block"))
            cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1), len(ids)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                part = b.slice(lo, hi - lo)
                if now is not None and ids[lo] != now:
                    yield block_scores(answers, rows)
                    answers, rows = [], []
                now = ids[lo]
                n = pc_.sum(pc_.is_valid(part.column("shard"))).as_py()
                answers += part.slice(0, n).select(["shard", "n_words", "n_grams", "word_counts", "gram_counts"]).to_pylist()
                if n < part.num_rows:
                    rows.append(part.slice(n).select(["doc_id", "train", "text"]))
        if now is not None:
            yield block_scores(answers, rows)
        del answers, rows
        freed()

    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    blocks = Blocks()
    for b, (block, spread) in blocks.cut(batches):
        n = b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array(np.full(n, spread)), *b.select(["doc_id", "train", "text"]).columns], ["block", "spread", "doc_id", "train", "text"])


def language_model_scores(docs: DataFrame, mu: float = 20.0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row and whole text.

    A null or empty text is the end alone. A row with a null doc_id is scored and learnt from. Repeated rows are
    learnt from as often as they occur. Without training rows every token is unknown. An empty table gives no rows;
    other columns are ignored. ``docs`` must be read from storage, as it is read twice in the same order.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    d = texts(docs).withColumn("train", trained())
    shards = SHARDS_A_TASK * n
    asked = d.mapInArrow(_ask(shards), ASK).repartitionById(n, (F.col("shard") / SHARDS_A_TASK).cast("int")).sortWithinPartitions("shard")
    answers = written(asked.mapInArrow(_answer, ANSWER), "answers")
    row = answers.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v", "once", "twice", "starts"))).first()
    stats = row.asDict()
    schema = "block long, spread long, doc_id long, train boolean, text string"
    numbered = d.mapInArrow(_numbered, schema)
    both = numbered.unionByName(answers.drop("n", "v", "once", "twice", "starts"), allowMissingColumns=True)
    dealt = both.repartitionById(n, F.pmod("spread", F.lit(n)).cast("int")).sortWithinPartitions("block", F.col("shard").asc_nulls_last())
    out = dealt.mapInArrow(_walk(shards, stats, mu), "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(stats["n"]).cast("long").alias("train_tokens"), "base_score", "score")
