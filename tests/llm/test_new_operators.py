"""URL rules, token alignment and periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from quillspark.llm import periodic
from quillspark.llm.alignment import GroupCache, Vocabularies, align, byte_alphabet
from quillspark.llm.periodic import kept_words, periodic_runs, periodic_runs_of, strongest
from quillspark.llm.queries import ORACLES, QUERIES
from quillspark.llm.url_filter import GlobAutomaton, rule_globs, url_verdicts

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# --- URL rules ----------------------------------------------------------------------------------------------------
def fits(glob, text):
    """By sets of places, a step of the glob at a time."""
    at = {0}
    for x in re.findall(r"\*\*|\*|[^*]", glob, re.S):
        if x[0] == "*":
            at |= {k for p in at for k in range(p, len(text) + 1) if x == "**" or "/" not in text[p:k]}
        else:
            at = {p + 1 for p in at if p < len(text) and x in ("?", text[p])}
    return len(text) in at


def first(automaton, texts):
    data = [t.encode() for t in texts]
    return automaton.first(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)).tolist()


def test_globs_equal_regular_expressions():
    r = random.Random(3)
    piece = lambda letters, n: "".join(r.choice(letters) for _ in range(r.randint(0, n)))
    for _ in range(60):
        globs = [piece(["a", "b", "/", "é", "*", "**", "?", "."], 9) for _ in range(r.randint(1, 40))]
        texts = [piece(["a", "b", "/", "é", "."], 10) for _ in range(40)] + ["", "ab" * 20]
        want = [next((i for i, g in enumerate(globs) if fits(g, t)), -1) for t in texts]
        assert first(GlobAutomaton(globs), texts) == want
    with pytest.raises(ValueError, match="wildcards"):
        rule_globs("a*.net/")


def test_states_are_worked_through_in_pieces(monkeypatch):
    monkeypatch.setattr("quillspark.llm.url_filter.STATE_WORDS", 7)
    globs = [f"*{x}*/**" for x in "abcdefghij" * 9]
    texts = [f"{x}.com/{y}" for x in "aqjzc" for y in ("", "b/c")]
    assert first(GlobAutomaton(globs), texts) == [next((i for i, g in enumerate(globs) if fits(g, t)), -1) for t in texts]


URLS = [
    None, "", "nothing", "://", "http://", "http://NET/", "http://net", "http://a.NET/x?y", "https://example.net/en/1", "https://m.example.net/en", "https://notexample.com/de/", "https://x.example.com/de/1#a",
    "http://b.org/fr/ü", "http://b.org?x=/fr/", "ftp://u@a.net:80/", "http://a.net/b://c.org/fr/", "x://y://z.net/", "https://spam.io", "https://spam.io/a", "https://a.io/spam", "http://ads1.io/x", "http://a.io/wp-admin/x", "http://a.io/y.exe",
    "http://a.net/\n/x", "http://" + "a" * 70_000 + ".org/fr/" + "b" * 70_000,
]


def test_url_verdicts(spark, tmp_path):
    d = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(URLS)] + [(None, "http://a.net/", "x", "x"), (3, "http://a.net/", "x", "x")], "page_id long, url string, host string, verdict string")
    d.repartition(2).write.parquet(f"file://{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    q = QUERIES["op11_url_filter"](spark, f"file://{tmp_path}")
    order = lambda rows: sorted(rows, key=repr)
    assert order(tuple(r) for r in q.collect()) == order(c.sql(f"select {', '.join(q.columns)} from ({ORACLES['op11_url_filter']})").fetchall())
    got = {r.page_id: r for r in q.where("page_id <> 3").collect()}
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("", "", None, "allow")
    assert (got[7].host, got[7].path, got[7].rule, got[7].verdict) == ("a.net", "/x", "net/", "block")
    assert [got[i].rule for i in (6, 8, 9, 10, 14, 15)] == [None, "example.net/en/", "net/", None, None, "net/"]
    assert url_verdicts(d.where("false"), [], []).count() == 0
    assert {r.verdict for r in url_verdicts(d, [], [], "block").collect()} == {"block"}


def test_op11_equals_duckdb(spark):
    c = duckdb.connect()
    c.sql(f"create view pages as select * from '{SF}/pages.parquet'")
    q = QUERIES["op11_url_filter"](spark, SF)
    assert sorted(map(tuple, q.collect()), key=repr) == sorted(c.sql(f"select {', '.join(q.columns)} from ({ORACLES['op11_url_filter']})").fetchall(), key=repr)


# --- Alignment ----------------------------------------------------------------------------------------------------
def aligned(rows):
    """Whole texts, no cutting and no dictionary."""
    a, b, alphabet = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B), byte_alphabet()
    a.encode_special_tokens = True
    spell = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    docs, count = [], Counter()
    for doc_id, t in rows:
        groups, links, n = [], [], (0, 0)
        if t:
            x = [(i, bytes(alphabet[c] for c in a.id_to_token(i))) for i in a.encode(" " + t, add_special_tokens=False).ids]
            y = [(i, spell(i)) for i in b.encode(t)]
            if b"".join(v for _, v in x) == b"".join(v for _, v in y) == (" " + t).encode():
                n = len(x), len(y)
                at_x, at_y = ({int(e): i for (i, _), e in zip(z, np.cumsum([len(v) for _, v in z]), strict=True)} for z in (x, y))
                part_x, part_y = [], []
                both = sorted({*at_x, *at_y})
                for e in both:
                    part_x += [str(at_x[e])] if e in at_x else []
                    part_y += [str(at_y[e])] if e in at_y else []
                    if e in at_x and e in at_y:
                        links.append((at_x[e], at_y[e]))
                        groups.append(f"{','.join(part_x)}|{','.join(part_y)}")
                        part_x, part_y = [], []
        count.update(links)
        docs.append((doc_id, *n, groups, links))
    top = {}
    for (_, q), v in count.items():
        top[q] = max(top.get(q, 0), v)
    return count, [(d, na, nb, len(g), len(k), sum(count[p] == top[p[1]] for p in k), sum(count[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, na, nb, g, k in docs]


ODD = [None, "", " ", "  ", "\n", "a", " a", "a ", "a\n b", "a\n  b \n\n c\n", "\n\na", "a\xa0 b", "x▁y", "▁", "<s> </s> <|endoftext|> <0x41>", "naïve ﬁ ﾊﾟ e\u0301", "\u200b \ufeff\n x", "a\tb\r\nc", "日本語のテキスト " * 40, "\0 \x1c x\x85 y", "word " * 3000, "q" * 20_000, "🙂 🙂🙂", "l'été d'où, (x). [y]"]


def test_alignment(spark, tmp_path):
    r = random.Random(9)
    alphabet = ["a", "b", "th", "e", " ", " ", "\n", "\t", "é", "'", ".", "\xa0", "\u3000", "\u200b", "7", "<s>", "日", "\x1c"]
    texts = ODD + ["".join(r.choice(alphabet) for _ in range(r.randint(1, 60))) for _ in range(600)]
    rows = list(enumerate(texts)) + [(None, "a word"), (5, "again"), (5, "again")]
    spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_a int, keys string").repartition(4).write.parquet(f"file://{tmp_path}/documents.parquet")
    count, want = aligned(rows)
    got = QUERIES["op12_cross_tokenizer_alignment"](spark, f"file://{tmp_path}")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    whole = align(spark.read.parquet(f"file://{tmp_path}/documents.parquet"), A, B)
    assert {(p.a, p.b): p["count"] for p in whole.pairs.collect()} == count
    assert sum(g.links for g in whole.groups.collect()) == sum(count.values())
    assert align(spark.createDataFrame([], "doc_id long, text string"), A, B).documents.count() == 0


def test_alignment_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    _, want = aligned([tuple(r) for r in docs.collect()])
    assert sorted(map(tuple, QUERIES["op12_cross_tokenizer_alignment"](spark, SF).collect())) == sorted(want)


def test_a_small_cache_changes_nothing(spark):
    v = Vocabularies(A, B)
    large, small = GroupCache(v), GroupCache(v, most=40, room=300)
    told = lambda c, t: None if (i := c.look_up([t])[0]) is None else (b";".join(c.names[k] for k in i), [list(c.groups)[k] for k in c.members_of(i)])
    for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect():
        assert told(large, r.text[:2000]) == told(small, r.text[:2000])
        small.trim()
        assert len(small.known) <= 40


# --- Periodic runs ------------------------------------------------------------------------------------------------
def plain_runs(w, least, exponent):
    out, n = [], len(w)
    for p in range(1, n):
        x = 0
        while x < n - p:
            s = x
            while x < n - p and w[x] == w[x + p]:
                x += 1
            part = w[s : x + p]
            if x > s and len(part) >= max(least, exponent * p) and not any(part[q:] == part[:-q] for q in range(1, p)):
                out.append((s, len(part), p))
            x += x == s
    return sorted(out)


@pytest.mark.parametrize("single", [2, 32])
def test_runs_equal_brute_force(monkeypatch, single):
    monkeypatch.setattr(periodic, "SINGLE", single)
    monkeypatch.setattr(periodic, "PIECE", 3)
    r = random.Random(single)
    for _ in range(700):
        n, k = r.randint(0, 150), r.choice([1, 2, 3, 5])
        w = [r.randrange(k) for _ in range(n)]
        for _ in range(r.randint(0, 3)):
            if n > 6:
                a, p = r.randrange(n), r.randint(1, n // 4 or 1)
                for i in range(a + p, r.randint(a, n)):
                    w[i] = w[i - p]
        least, exponent = r.choice([3, 5, 24]), r.choice([3, 4])
        assert periodic_runs_of(np.array(w, np.int32), least, exponent) == plain_runs(w, least, exponent)
    with pytest.raises(ValueError, match="three"):
        periodic_runs_of(np.zeros(9, np.int32), 3, 2)


def test_strongest_and_kept_words():
    assert strongest([]) is None
    assert strongest([(9, 30, 10), (4, 6, 2), (2, 9, 3), (2, 12, 4)]) == (2, 9, 3)
    assert kept_words(6, [(1, 4, 1)]).tolist() == [True, True, False, False, False, True]


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [x if i < a else words[a + (i - a) % p] for i, x in enumerate(words)]
    runs = plain_runs(words, 24, 3)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = strongest(runs)
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest("".join(f"{s},{k},{p}\n" for s, k, p in runs)), digest(" ".join(x for i, x in enumerate(words) if i not in gone)))


def test_periodic_runs(spark, tmp_path):
    r = random.Random(4)
    word = lambda: r.choice(["a", "A", "b", "é", "c\xa0d", "."])
    texts = [None, "", " \n\t", "ha", "ha " * 23, "ha " * 24, "\x0b".join(["ha"] * 25), "a b " * 12, "a b " * 11 + "a", " ".join("abcdefgh") * 3, ("x y z " * 9 + "q ") * 4]
    texts += [" ".join(word() for _ in range(r.randint(1, 300))) for _ in range(150)] + [" ".join(str(r.randrange(400)) for _ in range(r.randint(1, 900))) for _ in range(60)]
    rows = list(enumerate(texts)) + [(None, "ha " * 30), (7, "ha " * 30), (7, None)]
    spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id long, text string, runs int, _words string, start string").repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = QUERIES["op13_periodic_runs"](spark, f"file://{tmp_path}").collect()
    assert sorted(map(tuple, got), key=repr) == sorted((expected(i, t) for i, t in rows), key=repr)
    told = {x.doc_id: x for x in periodic_runs(spark.createDataFrame([(1, "go go " * 20 + "on"), (2, "nothing here")], "doc_id long, text string")).collect()}
    assert told[1].collapsed == "go on" and [tuple(x) for x in told[1].runs] == [(0, 40, 1)] and told[2].strongest is None and told[2].collapsed == "nothing here"
    assert periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_periodic_runs_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 4000").select("doc_id", "text")
    want = {d: expected(d, t) for d, t in docs.collect()}
    got = {x.doc_id: tuple(x) for x in QUERIES["op13_periodic_runs"](spark, SF).collect()}
    assert {d: got[d] for d in want} == want
    assert sum(x[1] > 0 for x in want.values()) > 5


def test_a_very_long_text(spark):
    n = 200_000
    told = periodic_runs(spark.createDataFrame([(1, " ".join(str(i % 5000) for i in range(n))), (2, "ha " * n)], "doc_id long, text string")).collect()
    assert [[tuple(y) for y in x.runs] for x in sorted(told)] == [[(0, n, 5000)], [(0, n, 1)]]
