"""Operators against brute force on a small table with nulls, empty and long texts, copies, ties and clashing columns."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quillspark.llm.bytegrams import utf8
from quillspark.llm.chat import chat_format, conversations
from quillspark.llm.components import components
from quillspark.llm.decontamination import Index, contamination, keep_clean, normal
from quillspark.llm.elias_fano import EliasFano
from quillspark.llm.exact_dedup import exact_dedup, keep_first
from quillspark.llm.language_model import END, BackoffAutomaton, counted, language_model_scores, ngrams
from quillspark.llm.language_model import tokens as tokens_of
from quillspark.llm.licences import TEMPLATES, licence_scan
from quillspark.llm.ngram_join import SignatureForest, candidates, folded, jaccard_components, keep_representatives, least_common, partnered, prefix_sizes, signatures
from quillspark.llm.packing import pack, plan_sequences
from quillspark.llm.quality import quality_scores
from quillspark.llm.substrings import substring_dedup
from quillspark.llm.token_files import read_token_files, token_files, write_token_files
from quillspark.llm.tokens import ChunkEncoder

SCHEMA = "doc_id long, text string, digest string, kept boolean, n long"


def corpus():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    texts = [" ".join(word() for _ in range(r.randint(6, 90))) for _ in range(24)]
    texts += [None, "", " \n", "one", "ONE  ", "a b c d", texts[0], texts[0].upper(), texts[1] + "\n", texts[2] + " tail", "x " + texts[3]]
    passage = " ".join(word() for _ in range(60))
    texts += [f"{word()} {passage} {word()}" for _ in range(4)] + [" ".join(["ha"] * 300)] * 2 + [" ".join(word() for _ in range(6000))]
    texts += [t.replace(" ", " z ", 1) for t in texts[4:8]]
    return [(i, t, "clash", False, 7) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('docs')}/documents.parquet"
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('empty')}/documents.parquet"
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


def test_exact_dedup(docs, rows):
    plain = {i: "".join((t or "").split()) for i, t, *_ in rows}
    size = {i: len(t or "") for i, t, *_ in rows}
    for r in exact_dedup(docs, k=2).collect():
        group = [i for i in plain if plain[i] == plain[r.doc_id]]
        best = min(group, key=lambda i: (-size[i], i))
        assert (r.keep_id, r.group_size, r.kept) == (best, len(group), r.doc_id == best)
        assert r.text_sha256 == hashlib.sha256(plain[r.doc_id].encode()).hexdigest()
    lowest = -(1 << 63)
    ends = docs.sparkSession.createDataFrame([(lowest, "same"), (5, "same"), (6, "other")], "doc_id long, text string")
    assert {(r.doc_id, r.keep_id) for r in exact_dedup(ends).collect()} == {(lowest, lowest), (5, lowest), (6, 6)}
    clash = docs.sparkSession.createDataFrame([(1, "a b", "mine", 9, 8), (2, "ab", "mine", 9, 8)], "doc_id long, text string, _digest string, key long, row long")
    assert [tuple(r) for r in keep_first(clash).collect()] == [(1, "a b", "mine", 9, 8)]
    kept = keep_first(docs.unionByName(docs))
    assert kept.count() == len(set(plain.values())) and kept.columns == docs.columns


def sets_of(rows):
    out = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        out[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return out


def test_jaccard_components(docs, rows):
    s = sets_of(rows)
    top = {i: i for i in s}
    for _ in s:
        for a, b in itertools.combinations(s, 2):
            if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b]):
                top[a] = top[b] = min(top[a], top[b])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()}
    assert got == {i: (len(s[i]), top[i]) for i in s}
    assert {r.doc_id for r in keep_representatives(docs).collect()} == {i for i in s if top[i] == i}


def similar_sets(seed):
    r = np.random.default_rng(seed)
    base = [np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 5, 40, 62, 200, 260, 3000)]
    return [np.unique(np.concatenate([b[: int(len(b) * r.uniform(0.7, 1))], r.integers(0, 1 << 63, max(1, len(b) // 30), dtype=np.uint64)])) for b in base for _ in range(6)]


def test_representatives_with_clashing_columns(spark):
    d = spark.createDataFrame([(2, "one two three four five six", "x", 1, 2), (1, "one two three four five six", "y", 3, 4)], "doc_id long, text string, _kept_id string, key long, row long")
    assert [tuple(r) for r in keep_representatives(d).collect()] == [(1, "one two three four five six", "y", 3, 4)]


@pytest.mark.parametrize("percent", [75, 60, 90])
def test_signature_forest_loses_no_pair(percent):
    sets = similar_sets(percent)
    at = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    n = np.diff(at)
    group = np.sort(np.random.default_rng(2).integers(0, 3, len(sets)))  # pairs stay within a group and between components
    comp = np.where(np.arange(len(sets)) % 7 == 0, 5, np.arange(len(sets)) + 100)
    t = pa.RecordBatch.from_pydict({"n": n, "comp": comp, "sig": pa.array(signatures(np.concatenate(sets), at), pa.binary())})
    x, y, share = candidates(t, group, percent)
    got = dict(zip(map(tuple, np.sort(np.stack([x, y], axis=1), axis=1).tolist()), share, strict=True))
    pairs = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if group[i] == group[j] and comp[i] != comp[j]]
    similarity = {(i, j): (c := len(np.intersect1d(sets[i], sets[j]))) / (n[i] + n[j] - c) for i, j in pairs}
    assert {p for p, s in similarity.items() if 100 * s >= percent} <= set(got) <= set(pairs) and len(got) < len(pairs) / 2
    assert all(got[p] >= similarity[p] - 1e-12 for p in got)
    whole = SignatureForest(folded(t.column("sig"), np.arange(6), 0), n[:6], comp[:6], np.array([0, 6]))
    assert whole.levels[-1][1] == n[:6].min() and whole.levels[-1][2] == n[:6].max()


def test_links_share_enough_prefix_shingles():
    for percent in (50, 60, 75, 90):
        k = least_common(percent)
        for a in range(1, 40):
            for b in range(a, 40):
                o = -(-percent * (a + b) // (100 + percent))  # the least overlap that links
                if o <= a and (a, b) != (o, o):
                    assert o >= k and all(prefix_sizes(np.array([n]), percent)[0] >= min(n, n - o + k) for n in (a, b))


def test_partners_within_a_group():
    r = np.random.default_rng(3)
    group, n = np.sort(r.integers(0, 40, 200)), r.integers(1, 60, 200)
    order = np.lexsort((n, group))
    group, n = group[order], n[order]
    rest = np.array([r.integers(-(-3 * x // 4), x + 1) for x in n])
    want = [any(i != j and group[i] == group[j] and 100 * n[j] >= 75 * n[i] and 175 * rest[i] >= 75 * (n[i] + n[j]) for j in range(200)) for i in range(200)]
    assert partnered(group, n, rest, 75).tolist() == want


@pytest.mark.parametrize("hot", [1 << 17, 20])
def test_jaccard_components_of_a_large_group(spark, tmp_path, monkeypatch, hot):
    """Copies so far from one another that about half of their pairs link, in blocks that are smaller than the group;
    also with shingles that are so frequent that they are dealt by class."""
    from quillspark.llm import ngram_join

    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "BLOCK_FIRST", 8)
    monkeypatch.setattr(ngram_join, "BLOCK_LAST", 8)
    r = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        t = list(base)
        for k in r.sample(range(120), r.choice([2, 3, 9])):
            t[k] = f"x{i}y{k}"
        rows.append((i, " ".join(t), "", False, 0))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"file://{tmp_path}/d.parquet")
    s = sets_of(rows)
    top = {i: i for i in s}
    for _ in s:
        for a, b in itertools.combinations(s, 2):
            if 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b]):
                top[a] = top[b] = min(top[a], top[b])
    got = {x.doc_id: x.component_id for x in jaccard_components(spark.read.parquet(f"file://{tmp_path}/d.parquet")).collect()}
    assert got == top and len(set(top.values())) > 2


def test_jaccard_components_below_75_percent(spark, tmp_path):
    text = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n + 4))
    rows = [(2 * i + side, text(i, n)) for i in range(150) for side, n in enumerate((190, 310))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{tmp_path}/d.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(spark.read.parquet(f"file://{tmp_path}/d.parquet"), percent=60).collect()}
    assert got == {2 * i + side: (n, 2 * i) for i in range(150) for side, n in enumerate((190, 310))}


def test_components(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


class PlainModel:
    """Interpolated trigrams by plain recursion."""

    def __init__(self, texts, mu):
        self.c = [Counter(), Counter(), Counter()]
        self.mu, self.starts = mu, len(texts)
        for t in texts:
            h = [b"\0start", *t]
            self.c[0].update(t)
            self.c[1].update(zip(h, t, strict=False))
            self.c[2].update(zip(h, h[1:], h[2:], strict=False))
        self.n, self.v = sum(self.c[0].values()), len(self.c[0])
        once, twice = (sum(x == k for x in self.c[0].values()) for k in (1, 2))
        self.discount = once / (once + 2 * twice) if once and twice else 0.5

    def p(self, history, w):
        if not history:
            return (self.c[0][w] - self.discount) / self.n if w in self.c[0] else self.discount * self.v / self.n
        seen = self.starts if history == (b"\0start",) else self.c[len(history) - 1][history[0] if len(history) == 1 else history]
        return (self.c[len(history)][*history, w] + self.mu * self.p(history[1:], w)) / (seen + self.mu)


def test_language_model(docs, rows):
    out = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    tokens = {i: [*(t or "").encode().lower().split(), b"\0end"] for i, t, *_ in rows}
    model = PlainModel([t for i, t in tokens.items() if not out(i)], 20.0)
    for history in ((), (b"\0start",), (tokens[0][0],), (b"\0start", tokens[0][0]), tuple(tokens[0][:2]), (b"ha", b"ha"), (b"never", b"seen")):
        assert np.isclose(sum(model.p(history, w) for w in [*model.c[0], b"unknown"]), 1)
    for r in language_model_scores(docs, mu=20.0).collect():
        t = tokens[r.doc_id]
        base = sum(np.log10((model.c[0][w] + 0.1) / (model.n + 0.1 * (model.v + 1))) for w in t)
        h = [b"\0start", *t]
        score = sum(np.log10(model.p(tuple(h[max(0, i - 1) : i + 1]), w)) for i, w in enumerate(t))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out(r.doc_id), len(t), sum(w in model.c[0] for w in t), model.n)
        assert np.isclose(r.base_score, base) and np.isclose(r.score, score)


def test_language_model_in_batches_of_any_size(spark, tmp_path):
    """Nine megabytes in one partition: the second reading gets its rows in other batches than the first."""
    r = random.Random(3)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(500)]
    spark.createDataFrame([(i, " ".join(r.choices(words, k=r.randint(1, 400)))) for i in range(7500)], "doc_id long, text string").coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    d = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        scores = language_model_scores(d)  # its first pass has run
        spark.conf.set(key, "700")
        got = {x.doc_id: (x.n_tokens, x.n_known) for x in scores.collect()}
    finally:
        spark.conf.set(key, before)
    assert got == {x.doc_id: (len(x.text.split()) + 1,) * 2 for x in d.collect()}


def test_automaton_walked_token_by_token():
    """The state that is carried from token to token gives the same weights as the walk of all places at once."""
    texts = ["a b a b c", "b a b", "", "a b c d a b", "x a b"]
    t, at = tokens_of(pa.array(texts))
    train = np.repeat([1, 1, 1, 0, 0], np.diff(at))
    pairs, triples, place = ngrams(t, at)
    grams = np.concatenate([pairs, triples])
    (words, word_counts), (keys, gram_counts) = counted(t, train), counted(grams, np.concatenate([train, train[place]]))
    stats = {"n": int(word_counts.sum()), "v": int((word_counts > 0).sum()), "once": int((word_counts == 1).sum()), "twice": int((word_counts == 2).sum()), "starts": 3}
    gram = np.searchsorted(keys, grams)
    m = BackoffAutomaton(t == END, at, np.searchsorted(words, t), gram[: len(t)], place, gram[len(t) :], word_counts, gram_counts, stats, 20.0)
    want, state, states = [], 1, set()
    for i in range(len(t)):
        state = 1 if i in at else state
        weight, state = m.step(state, i)
        want.append(weight)
        states.add(state)
    assert np.allclose(m.walk(), want)
    assert 0 in states and {int(m.pair[0]), int(m.pair[1])} <= states  # the root and pairs were reached
    assert m.failure[m.pair[1]] == m.word[1] and m.failure[m.word[1]] == 0 and (m.failure_weight <= 0).all()


@pytest.mark.parametrize("length", [200, 120])
def test_substrings(docs, rows, length):
    data = {i: (t or "").encode() for i, t, *_ in rows}
    seen = Counter(b[k : k + length] for b in data.values() for k in range(len(b) - length + 1))
    for r in substring_dedup(docs, length, with_kept=True).collect():
        b = data[r.doc_id]
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(b), gone.sum(), int((np.diff(gone.astype(int), prepend=0) == 1).sum()))
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest() and r.kept == kept


def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize(("name", "keeps"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_chunks_encode_as_the_library(name, keeps):
    r = random.Random(3)
    parts = [" ", "  ", "\n", "\t", " \n", "a", "B", "don't", "12", "!!", "\x01", "\x00", "中文", "é", "́x", "<|endoftext|>", "\xa0", " ", "\x1c", "\r\n", "İ", "🙂", "x" * 50, "word", "über", ",", "#", "'s", "\u0301", "ß"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(6000)]
    enc = ChunkEncoder(public_tokenizers.path(name), keeps, most=500)
    for lo in range(0, len(texts), 300):
        ids, at = enc.encode(texts[lo : lo + 300])
        want = [e.ids for e in library(name).encode_batch(texts[lo : lo + 300], add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want


def test_token_files(spark, docs, rows, tmp_path):
    t, start = library("byte_bpe_50k.json"), 0
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x, *_ in rows}
    got = {r.doc_id: r for r in token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), file_ids=2000).collect()}
    for i in sorted(ids):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids[i]), zlib.crc32(np.array(ids[i], "<u4").tobytes()))
        start += len(ids[i])
    write_token_files(docs, f"file://{tmp_path}/ids", public_tokenizers.path("byte_bpe_50k.json"))
    assert {r.doc_id: list(r.ids) for r in read_token_files(spark, f"file://{tmp_path}/ids", with_ids=True).collect()} == ids


def test_elias_fano():
    r = np.random.default_rng(2)
    for n, top in ((0, 1), (1, 1), (1000, 10), (1000, 1 << 30), (5000, 5000)):
        v = np.sort(r.integers(0, top, n))
        e = EliasFano.from_bytes(EliasFano.encode(v).to_bytes())
        assert (e.values() == v).all() and all(e.select(i) == v[i] for i in range(0, n, 7))
        assert all((e.select_range(lo, min(n, lo + k)) == v[lo : lo + k]).all() for lo in range(0, n, 97) for k in (0, 1, 255, 600))


def test_packing(docs, rows):
    t = library("word_bpe_49k.json")
    want = []
    for i, x, *_ in rows:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k // 256, k, len(ids[k : k + 256]), zlib.crc32(ids[k : k + 256].tobytes())) for k in range(0, len(ids), 256)]
    got = pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=256, with_ids=True).toPandas()
    assert sorted(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.offset == g.length.cumsum() - g.length).all() and g.length.sum() <= 256
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 256) + 1


def test_plans_cover_every_histogram():
    r = np.random.default_rng(4)
    for top in (3, 40, 100):
        hist = np.bincount(r.integers(1, top + 1, 5000), minlength=101)
        total = np.zeros(101, int)
        for p, n in plan_sequences(hist):
            assert sum(p) <= 100
            for v in p:
                total[v] += n
        assert (total == hist).all()


def test_quality(spark):
    good, bad = "The quick fox runs over the hill and rests. " * 12, "BUY!! NOW!! | CHEAP!! | " * 30
    docs = spark.createDataFrame([(i, good if i % 2 else bad, i % 2) for i in range(200)] + [(200, None, 1), (201, "", 1)], "doc_id long, text string, quality int")
    got = quality_scores(docs, docs.select("doc_id", "quality")).collect()
    assert len(got) == 202 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id < 200)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def distance(a, b):
    """Least edits of pattern a to a region of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_decontamination(spark):
    r = random.Random(9)
    prose = lambda n: " ".join("".join(r.choice("aeinorst") for _ in range(r.randint(2, 7))) for _ in range(n))
    items = [prose(22) for _ in range(3)] + ["short", None]
    edit = lambda t, k: "".join(c for i, c in enumerate(t) if i not in set(r.sample(range(len(t)), k)))
    # "short" is found as a whole word only.
    texts = [prose(40), f"{prose(9)} {items[0].upper()}\n{prose(9)}", f"{prose(5)} {edit(items[1], 4)} {prose(5)}", edit(items[2], 40), items[2].replace(" ", "  \n"), None, "", "short", f"{prose(3)} (Short) {prose(3)}", "shorts ashort éshort"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    squeezed = lambda t: " ".join((t or "").lower().split())
    want = {i: [k for k, q in enumerate(items[:3]) if distance(squeezed(q), squeezed(t)) <= 0.08 * len(squeezed(q))] + [3] * (i in (7, 8)) for i, t in enumerate(texts)}
    for block in (8 << 20, 200):
        got = {x.doc_id: list(x.item_ids) for x in contamination(docs, bench, block_bytes=block).collect()}
        assert got == want and want[1] == [0] and want[2] == [1] and want[4] == [2]
    assert {x.doc_id for x in keep_clean(docs, bench).collect()} == {i for i in want if not want[i]}


def test_decontamination_of_a_slice_with_few_hits():
    r = random.Random(4)
    item = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100))
    index = Index([(7, item)], 0.08)
    least = int(index.bound.min())
    for hits in range(least + 1):  # a document alone in its slice that shares so many q-grams with the item
        text = "#" * 20 + item[: hits + 7 if hits else 0] + "#" * 20
        assert index.matches(*normal(*utf8(pa.array([text], pa.string())))).tolist() == []
    assert index.matches(*normal(*utf8(pa.array([item], pa.string())))).tolist() == [[0, 0]]


def test_licences(spark):
    texts = ["Some prose.\nReleased under the MIT License.\nMore.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under the Qorvex License, version 4.", "Mit der Zeit.\nAll rights reserved.", None, ""]
    got = {r.doc_id: r for r in licence_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [list(got[i].licences) for i in range(6)] == [["mit"], ["gpl-3.0"], ["unknown"], [], [], []]


def test_licences_within_long_lines(spark):
    r = random.Random(6)
    prose = lambda n: " ".join("".join(r.choice("abdeklmnoprstuvz") for _ in range(r.randint(3, 8))) for _ in range(n))
    inside = lambda n, *notices: " ".join(x for t in notices for x in (prose(n), t)) + " " + prose(n)
    cases = [(inside(n, text), [family]) for family, text in TEMPLATES for n in (20, 60)]
    cases += [(inside(60, "Licensed under the Qorvex License, version 4."), ["unknown"]), (inside(60, "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."), ["apache-2.0", "mit"])]
    cases += [(prose(200), []), (inside(60, "The driver must hold a valid license to drive in this part of the village and all rights are reserved."), [])]
    got = {x.doc_id: list(x.licences) for x in licence_scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]


WRAPPED = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version."),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an \"AS IS\" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
]


@pytest.mark.parametrize("mark", ["", "# ", "// ", " * "])
def test_licences_of_wrapped_notices(spark, mark):
    around = "Plain words about the weather\nand the sea.\n{}\n\nint main() and more words"
    cases = [(f, around.format("\n".join(mark + x for x in t.split("\n")))) for f, t in WRAPPED]
    got = {r.doc_id: list(r.licences) for r in licence_scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(cases))] == [[f] for f, _ in cases]


def test_conversations(spark):
    rows = [(1, 0, "user", "First one here"), (1, 1, "user", "Second one here"), (1, 2, "bot", "> First one here\nTo the first"), (2, 0, "user", None), (None, 3, None, "lost"), (None, 3, None, "lost"), (1, 2, "bot", "> First one here\nTo the first")]
    d = chat_format(spark.createDataFrame([(*x, "clash") for x in rows], "conv_id long, turn long, role string, text string, size string"))
    short = sorted(((r.conv_id or 0, r.n_messages, r.n_linked, r.conversation) for r in conversations(d).collect()))
    lost = (0, 1, 0, "<|unknown|>\nlost")
    assert short == [lost, lost, (1, 4, 2, "<|user|>\nFirst one here\n\n<|bot|>\nTo the first\n\n<|bot|>\nTo the first\n\n<|user|>\nSecond one here"), (2, 1, 0, "<|user|>\n")]
    parts = sorted((r.part, r.root_turn, [m.turn for m in r.messages]) for r in conversations(d, 2).where("conv_id = 1").collect())
    assert parts == [(0, 0, [0, 2]), (1, 0, [2, 1])]


def test_frequent_grams(monkeypatch):
    """A template that all items share: the same pairs as without any q-gram left out, in bounded pieces."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 7)))
    phrase = "please choose the right answer of the four options"
    items = [(i, f"{phrase} {' '.join(word() for _ in range(r.choice([1, 12])))}") for i in range(600)]
    texts = [" ".join([phrase] * 40), *(f"{word()} {t.replace('right', 'rigth', 1)} {word()}" for _, t in items[::60]), "nothing of it"]
    data, off = normal(*utf8(pa.array(texts)))
    many = Index(items, 0.08)
    got = many.found(data, off)
    monkeypatch.setattr("quillspark.llm.decontamination.PAIRS", 1000)
    assert many.found(data, off) == got
    monkeypatch.setattr("quillspark.llm.decontamination.FREQUENT", 10**9)
    plain = Index(items, 0.08)
    assert plain.found(data, off) == got and len(many.hash) < len(plain.hash)
    assert {(k, i) for k, i in enumerate(range(0, 600, 60), 1)} <= set(got)


def test_long_conversations(spark):
    """Parts of one size, whatever threads, stretches of turns and repeated turns a conversation has."""
    plain = [(1, i, "user", f"message {i}") for i in range(257)]
    same = [(2, 7, "user", f"text {i:04}") for i in range(900)]
    r = random.Random(8)
    threads = [(3, i, "bot", "topic zero of all" if i == 0 else f"> topic zero of all\nanswer {i}" if r.random() < 0.5 else f"remark {i}") for i in range(1500)]
    d = chat_format(spark.createDataFrame(plain + same + threads, "conv_id long, turn long, role string, text string"))
    order = {}
    for x in d.collect():
        order.setdefault(x.conv_id, []).append((x.root_turn, x.turn, x.formatted))
    got = {}
    for x in conversations(d).collect():
        got.setdefault(x.conv_id, {})[x.part] = x
    for c, parts in got.items():
        assert sorted(parts) == list(range(-(-len(order[c]) // 256))) and all(parts[p].n_messages == 256 for p in range(len(parts) - 1))
        assert "\n\n".join(parts[p].conversation for p in sorted(parts)) == "\n\n".join(t for *_, t in sorted(order[c]))
    assert len(got[1]) == 2 and len({x[0] for x in order[3]}) > 300


def test_chat(spark):
    rows = [
        (1, 0, "user", "Hello there world\nsecond line here"), (1, 1, "assistant", "> Hello there world\n> second line here\nMy answer is this"), (1, 2, "user", ">> Hello there  world\n> My answer is THIS\nThanks a lot"),
        (1, 3, "user", "> second line here\nAnother thread"), (1, 4, "user", None), (1, 5, None, "> nobody said it\nok"), (None, 0, "user", "> x y"), (2, 0, "user", "> Hello there world"),
    ]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.parent_turn, r.root_turn, r.depth, r.n_quotes, r.n_linked, r.formatted.split("\n", 1)[1]) for r in chat_format(d).collect()}
    assert got == {
        (1, 0): (None, 0, 0, 0, 0, "Hello there world\nsecond line here"), (1, 1): (0, 0, 1, 1, 1, "My answer is this"), (1, 2): (1, 0, 2, 2, 2, "Thanks a lot"), (1, 3): (0, 0, 1, 1, 1, "Another thread"),
        (1, 4): (None, 4, 0, 0, 0, ""), (1, 5): (None, 5, 0, 1, 0, "ok"), (None, 0): (None, 0, 0, 1, 0, ""), (2, 0): (None, 0, 0, 1, 0, ""),
    }


def test_chat_links_passages_without_a_space(spark):
    rows = [
        (1, 0, "user", "Yes."), (1, 1, "assistant", "> Yes.\nGood to know"), (1, 2, "user", "今天天气很好"), (1, 3, "assistant", "> 今天天气很好\nIt is"), (1, 4, "user", "> \n>\t\nnothing quoted"),
        (1, 5, "user", "two words here"), (1, 6, "user", "> two words here\n> Yes.\nboth"), (1, 7, "user", "> not said\n> Yes.\none of them"),
    ]
    got = {r.turn: (r.parent_turn, r.root_turn, r.depth, r.n_quotes, r.n_linked) for r in chat_format(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {0: (None, 0, 0, 0, 0), 1: (0, 0, 1, 1, 1), 2: (None, 2, 0, 0, 0), 3: (2, 2, 1, 1, 1), 4: (None, 4, 0, 1, 0), 5: (None, 5, 0, 0, 0), 6: (5, 5, 1, 1, 1), 7: (0, 0, 1, 1, 1)}


def test_empty_tables(spark, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, item_id long, text string, conv_id long, turn long, role string")
    path = public_tokenizers.path
    for out in (
        exact_dedup(empty), jaccard_components(empty), language_model_scores(empty), substring_dedup(empty), token_files(empty, path("byte_bpe_50k.json")), pack(empty, path("word_bpe_49k.json")),
        quality_scores(empty, none), contamination(empty, none), licence_scan(empty), chat_format(none), conversations(chat_format(none)),
    ):
        assert out.count() == 0


def test_rows_without_an_id(spark, tmp_path):
    text = "some words that are the same in both of these rows " * 5
    spark.createDataFrame([(None, text), (3, text), (3, text), (None, None)], "doc_id long, text string").write.parquet(f"file://{tmp_path}/d.parquet")
    d = spark.read.parquet(f"file://{tmp_path}/d.parquet")
    for out in (exact_dedup(d), jaccard_components(d), language_model_scores(d), substring_dedup(d), token_files(d, public_tokenizers.path("byte_bpe_50k.json")), pack(d, public_tokenizers.path("word_bpe_49k.json")), licence_scan(d)):
        assert out.count() == 4
    assert {r.component_id for r in jaccard_components(d).where("n_shingles > 0").collect()} == {3}
    assert keep_first(d).where("text is not null").count() == 1
