"""Image headers, search providers, retrieval by counts, blocks of vectors and grounding, each against a plain version."""

import random
import re
import struct
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.config import Options
from quillspark.functions import sql
from quillspark.functions.images import image_header
from quillspark.operators import evaluation
from quillspark.operators import ranking as R
from quillspark.plans import answers, graph, planner, questions, retrieve
from quillspark.sources import documents as S
from quillspark.streaming import events


def segment(mark, data):
    return bytes([0xFF, mark]) + struct.pack(">H", len(data) + 2) + data


def tiff(order, *entries):
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "IH", 8, len(entries)) + b"".join(struct.pack(order + "HHI", t, k, 1) + (struct.pack(order + "I", v) if k == 4 else struct.pack(order + "HH", v, 0)) for t, k, v in entries)


WEBP = b"RIFF\0\0\0\0WEBP"
IMAGES = [
    (b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">IIBB", 640, 480, 8, 2), ("PNG", 640, 480, "RGB")),
    (b"\x89PNG\r\n\x1a\n\0\0", ("PNG", None, None, None)),
    (b"\xff\xd8" + segment(0xE0, b"JFIF" * 900) + b"\xff" + segment(0xC4, b"tables") + segment(0xC0, struct.pack(">BHHB", 8, 33, 44, 1)), ("JPEG", 44, 33, "L")),
    (b"\xff\xd8" + segment(0xDA, b"data") + segment(0xC0, struct.pack(">BHHB", 8, 33, 44, 1)), ("JPEG", None, None, None)),
    (b"\xff\xd8\xff", ("JPEG", None, None, None)),
    (b"GIF87a" + struct.pack("<HH", 7, 9), ("GIF", 7, 9, "P")),
    (b"BM" + b"\0" * 16 + struct.pack("<iiHH", 20, -30, 1, 32), ("BMP", 20, 30, "RGBA")),
    (tiff("<", (256, 3, 11), (257, 4, 70_000), (262, 3, 1)), ("TIFF", 11, 70_000, "L")),
    (tiff(">", (256, 4, 12), (257, 3, 13)), ("TIFF", 12, 13, None)),
    (WEBP + b"VP8 \0\0\0\0\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 5, 6), ("WEBP", 5, 6, "RGB")),
    (WEBP + b"VP8L\0\0\0\0\x2f" + struct.pack("<I", 99 | 49 << 14 | 1 << 28), ("WEBP", 100, 50, "RGBA")),
    (WEBP + b"VP8X\0\0\0\0\x10\0\0\0" + struct.pack("<I", 1999)[:3] + struct.pack("<I", 999)[:3], ("WEBP", 2000, 1000, "RGBA")),
    (b"%PDF-1.4", None), (b"", None), (None, None),
]


def test_image_headers(spark):
    d = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(IMAGES)], "i int, c binary").select("i", image_header(F.col("c")).alias("h"))
    assert {r.i: r.h and tuple(r.h) for r in d.collect()} == {i: want for i, (_, want) in enumerate(IMAGES)}
    files = spark.createDataFrame([("a.PNG", IMAGES[0][0]), ("b.txt", b"text"), ("c", IMAGES[5][0])], "filename string, content binary")
    assert {r.filename: (r.width, r.height) for r in S.images(files).collect()} == {"a.PNG": (640, 480), "c": (7, 9)}


def test_search(spark):
    def provider(text, most):
        if "broken" in text:
            raise OSError("down")
        return [{"title": f"{text} {i}", "snippet": "s", "link": f"https://example.org/{i}"} for i in range(9)]

    q = spark.createDataFrame([(1, "ships"), (2, "  "), (3, "broken"), (4, None)], "query_id long, text string")
    got = S.search(q, provider, most=2, block=2, attempts=2, pause=0.01).collect()
    assert sorted((r.query_id, r["rank"], r.title, r.search_error) for r in got) == [(1, 1, "ships 0", None), (1, 2, "ships 1", None), (3, 0, None, "OSError: down")]
    told = {r.query_id: r.text for r in S.search_results_text(S.search(q, provider, most=2, attempts=1)).collect()}
    assert told == {1: "1. ships 0\ns\nhttps://example.org/0\n\n2. ships 1\ns\nhttps://example.org/1"}
    stored = spark.createDataFrame([("ships", 1, "t", "s", "l"), ("ships", 9, "t", "s", "l")], "query string, rank int, title string, snippet string, link string")
    assert [(r.query_id, r["rank"]) for r in S.stored_search(q, stored).collect()] == [(1, 1)]


def test_dense_top_k_equals_a_sort(spark, monkeypatch):
    monkeypatch.setattr(R, "VECTORS", 7)
    monkeypatch.setattr(R, "QUERIES", 3)
    monkeypatch.setattr(R, "KEPT", 5)
    r = random.Random(2)
    vectors = [(f"v{i}", i % 3, [float(r.randint(-2, 2)) for _ in range(4)]) for i in range(60)] + [("none", 0, None), ("short", 1, [1.0])]
    asked = [(i, [float(r.randint(-2, 2)) for _ in range(4)]) for i in range(10)]
    v = spark.createDataFrame(vectors, "vec_id string, label int, embedding array<double>").repartition(3)
    q = spark.createDataFrame(asked, "query_id long, embedding array<double>").repartition(2)

    def score(a, b):
        a, b = (np.array([*(x or []), 0, 0, 0, 0][:4], float) for x in (a, b))
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return round(float(a @ b / n), 6) + 0.0 if n else 0.0

    for few in (16, 0):
        monkeypatch.setattr(R, "BROADCAST_BLOCKS", few)
        want = {(i, n, k) for i, e in asked for n, (k, *_) in enumerate(sorted(((k, score(e, x)) for k, _, x in vectors), key=lambda t: (-t[1], t[0]))[:5], 1)}
        assert {(x.query_id, x["rank"], x.vec_id) for x in R.dense_top_k(v, q, 5).collect()} == want
    want = {(i, g, n, k) for i, e in asked for g in range(3) for n, (k, *_) in enumerate(sorted(((k, score(e, x)) for k, h, x in vectors if h == g), key=lambda t: (-t[1], t[0]))[:2], 1)}
    assert {(x.query_id, x.label, x["rank"], x.vec_id) for x in R.dense_top_k(v, q, 2, by="label").collect()} == want
    assert R.dense_top_k(v, q.where("false"), 2).count() == 0 and R.dense_top_k(v.where("false"), q, 2).count() == 0


def test_dense_top_k_streams_vectors(spark, monkeypatch):
    """No task gets pairs of blocks, whose bytes grow with both sides; copies, groups (null too) and keys that are let go on the way change nothing."""
    r = random.Random(5)
    vectors = [(i, r.choice([None, 0, 1]), [float(r.randint(-1, 1)) for _ in range(r.choice([2, 3, 3, 5]))]) for i in range(150)]
    r.shuffle(vectors)
    v = spark.createDataFrame(vectors, "vec_id long, label int, embedding array<float>").repartition(3)
    asked = v.where("vec_id % 20 = 0").selectExpr("vec_id as query_id", "embedding")

    def score(a, b):
        n = np.linalg.norm(a) * np.linalg.norm(b)
        d = min(len(a), len(b))
        return round(float(np.dot(a[:d], b[:d]) / n), 6) + 0.0 if n else 0.0

    of = {i: e for i, _, e in vectors}
    for few, slice_, block in ((16, 1 << 16, 4096), (16, 4, 3), (0, 1 << 16, 4096), (0, 4, 3)):
        monkeypatch.setattr(R, "BROADCAST_BLOCKS", few)
        monkeypatch.setattr(R, "SLICE", slice_, raising=False)
        monkeypatch.setattr(R, "VECTORS", block)
        for by in (None, "label"):
            got = R.dense_top_k(v, asked, 4, by=by)
            assert not re.search("CartesianProduct|NestedLoopJoin", got._jdf.queryExecution().toString())
            want = set()
            for q in range(0, 150, 20):
                for g in [None, 0, 1] if by else [None]:
                    every = sorted((-score(of[q], e), i) for i, h, e in vectors if not by or h == g)
                    want |= {(q, g, n, i, -x) for n, (x, i) in enumerate(every[:4], 1)}
            assert {(x.query_id, x.label if by else None, x["rank"], x.vec_id, x.score) for x in got.collect()} == want


def test_dense_top_k_takes_little_beside_what_it_holds():
    """What a task takes for matrix products is bounded, however many queries and vectors meet in it."""
    r = np.random.default_rng(6)

    def peak(queries, vectors):
        asked = R._matrix(pa.array(list(r.standard_normal((queries, 16)))), 16, True)
        e = pa.array(list(r.standard_normal((vectors, 16)).astype(np.float32)))
        batch = pa.RecordBatch.from_arrays([pa.array(range(vectors)), pa.repeat(0, vectors), e], names=["key", "group", "embedding"])
        tracemalloc.start()
        try:
            assert sum(b.num_rows for b in R._searched(pa.array(range(queries)), asked, iter([batch, batch]), 8, True)) == 8 * queries
            return tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    assert peak(4096, 8192) < 16 << 20


def test_count_before(spark):
    r = random.Random(1)
    rows, marks = ([(r.randint(0, 2), r.randint(0, 30)) for _ in range(n)] for n in (300, 40))
    got = R.count_before(spark.createDataFrame(rows, "g int, x int"), spark.createDataFrame(marks + [(9, 1)], "g int, x int"), ["g"], F.col("x")).collect()
    assert {(x.g, x.mark): x.before for x in got} == {(g, m): sum(h == g and y < m for h, y in rows) for g, m in marks + [(9, 1)]}


@pytest.mark.parametrize("fusion", ["rrf", "weighted"])
@pytest.mark.parametrize("filters", [{}, {"filename": "f1", "page_from": 2}])
def test_corpus_retrieval_equals_a_product(spark, fusion, filters):
    """Few hits, ties, copies and questions without any shared term, so chunks without a score are among the results."""
    r = random.Random(7)
    words = ["ship", "cargo", "spice", "king", "night", "tale", "river", "stone"]
    chunks = [(f"c{i:02}", r.randint(0, 3), f"f{i % 2}", i % 4, [r.choice(words) for _ in range(r.randint(0, 6))], [float(r.randint(0, 3)) for _ in range(3)]) for i in range(40)]
    asked = [(1, ["ship", "king", "ship"], [1.0, 2.0, 0.0]), (2, ["absent"], [0.0, 1.0, 1.0]), (3, ["stone"], [0.0, 0.0, 0.0])]
    c = spark.createDataFrame([(*x, x[3], " ".join(x[4])) for x in chunks], "chunk_id string, ordinal int, filename string, page_start int, tokens array<string>, embedding array<double>, page_end int, text string")
    q = spark.createDataFrame([(*x, " ".join(x[1])) for x in asked], "query_id long, tokens array<string>, embedding array<double>, text string")
    options = Options(enable_rerank=False, fusion=fusion, candidate_multiplier=2)
    got = retrieve.retrieve(c, q, options, k=3, **filters).collect()

    n, avgdl, fetch = len(chunks), sum(len(x[4]) for x in chunks) / len(chunks), 6
    want = set()
    for i, tokens, e in asked:
        def bm25(x, tokens=tokens):
            total = 0.0
            for t in tokens:
                df, tf = sum(t in y[4] for y in chunks), x[4].count(t)
                if tf:
                    total += np.log1p(max(0, (n - df + 0.5) / (df + 0.5))) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * max(len(x[4]), 1) / avgdl))
            return round(total, 6)

        def cosine(x, e=e):
            m = np.linalg.norm(e) * np.linalg.norm(x[5])
            return round(float(np.dot(e, x[5]) / m), 6) if m else 0.0

        dense = {x[0]: k for k, x in enumerate(sorted(chunks, key=lambda x: (-cosine(x), x[0]))[:fetch], 1)}
        sparse = {x[0]: k for k, x in enumerate(sorted(chunks, key=lambda x: (-bm25(x), x[1], x[0])), 1)}
        lo, hi = min(map(bm25, chunks)), max(map(bm25, chunks))
        fused = {x[0]: (1 / (60 + dense[x[0]]) if x[0] in dense else 0) + 1 / (60 + sparse[x[0]]) if fusion == "rrf" else 0.7 * (cosine(x) if x[0] in dense else 0) + 0.3 * ((bm25(x) - lo) / (hi - lo) if hi > lo else 0) for x in chunks}
        fit = [x[0] for x in chunks if not filters or (x[2] == "f1" and (x[3] == 0 or x[3] >= 2))]
        best = sorted(fit, key=lambda k: (-round(fused[k], 12), dense.get(k, 10**9), sparse[k]))[:3]
        want |= {(i, k, b) for k, b in enumerate(best, 1)}
    assert {(x.query_id, x["rank"], x.chunk_id) for x in got} == want
    assert {(x.retrieval, x.fusion, x.reranked) for x in got} == {("hybrid-corpus", fusion, False)}


def test_grounded(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "AUTOMATON", 8)
    cases = spark.createDataFrame([(1, ["needle", "x"]), (2, ["absent"]), (3, ["", None]), (4, []), (5, ["ned", "edle"]), (6, ["سلام"]), (7, None)], "qid int, expect_any array<string>")
    texts = spark.createDataFrame([("a needle",), (None,), ("قال سلام",), ("a needle",)], "text string")
    assert {r.qid for r in evaluation.grounded(cases, texts).collect()} == {1, 5, 6}
    assert len(list(evaluation.token_blocks(spark.createDataFrame([("abcdef",), ("abcdef",), ("ghijkl",)], "token string"), 8))) == 2
    assert evaluation.grounded(cases.where("false"), texts).count() == 0


def test_stratified_cases(spark):
    d = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(100)], "qid int, kind string")
    first = {(r.qid, r.kind) for r in evaluation.stratified(d, "kind", 7).collect()}
    assert len(first) == 14 and first == {(r.qid, r.kind) for r in evaluation.stratified(d.repartition(5), "kind", 7).collect()}
    assert first != {(r.qid, r.kind) for r in evaluation.stratified(d, "kind", 7, seed=8).collect()}


def test_verdicts(spark):
    rows = ["### [2]\nText\nVerdict: RELEVANT\n### [1]\nverdict: not_relevant\nVerdict: RELEVANT\n### [9]\nVerdict: RELEVANT", 'x {"sources": [{"index": 3, "verdict": "relevant"}, {"index": "1", "verdict": "RELEVANT"}, 4]} y', "nothing", None, "### about\nVerdict: RELEVANT"]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, t string")
    assert [r.x for r in d.orderBy("i").select(answers.relevant_indexes(F.col("t"), F.lit(4)).alias("x")).collect()] == [[2], [1, 3], [], [], []]


def test_whole_questions(spark):
    page = lambda i, name, text: (f"{i:064x}", name, 1, text, "")
    pages = spark.createDataFrame([page(1, "ships.txt", "A ship crossed the ocean with a cargo of spices."), page(2, "cats.txt", "The cat purred.")], "fingerprint string, filename string, page_number int, text string, html string")
    index = retrieve.build_index(pages)
    q = spark.createDataFrame([(1, "Which ship had a cargo of spices?"), (2, " ")], "query_id long, question string")
    told = {r.query_id: r for r in questions.document_questions(index, q).collect()}
    assert "A ship crossed the ocean with a cargo of spices. [1]" in told[1].answer and told[1].used == [1] and told[2].used == []
    told = {r.query_id: r for r in questions.knowledge_questions(index, q).collect()}
    assert "cargo of spices. [1]" in told[1].answer and told[2].answer
    assert {r.used == [] for r in questions.knowledge_questions(None, q).collect()} == {True}


def test_turns_take_their_routes(spark):
    page = lambda i, name, text: (f"{i:064x}", name, 1, text, "")
    pages = spark.createDataFrame([page(1, "ships.txt", "A ship crossed the ocean. It had a cargo of spices. It came back. Then it sank.")], "fingerprint string, filename string, page_number int, text string, html string")
    index = retrieve.build_index(pages)
    rows = [(1, "Which cargo had the ship?", "eA==", f"{1:064x}", False), (2, "please summarize this", "eA==", f"{1:064x}", False), (3, "search the web for silk roads", "", None, False), (4, "hello", "", None, False), (5, "what was the cargo of spices?", "", None, True)]
    turns = spark.createDataFrame(rows, "query_id long, text string, pdf_data_base64 string, fingerprint string, use_knowledge_base boolean").withColumn("knowledge_available", F.col("query_id") == 5)
    found = lambda q: S.search(q, lambda text, most: [{"title": text, "snippet": "s", "link": "l"}])
    got = {r.query_id: (r.agent_route, r.answer) for r in graph.answer_turns(turns, pages, index, index, found, lambda t: F.concat(F.lit("you said "), t)).collect()}
    assert got[1][0] == "query_documents" and "cargo" in got[1][1]
    assert got[2] == ("summarize_document", "[Page 1]\nA ship crossed the ocean. It had a cargo of spices. It came back.")
    assert got[3] == ("web_search", "1. silk roads\ns\nl")
    assert got[4] == ("call_model", "you said hello")
    assert got[5][0] == "query_knowledge_base" and "spices" in got[5][1]
    bare = {r.query_id: r.answer for r in graph.answer_turns(turns).collect()}
    assert bare[3] == graph.NO_RESULTS and bare[4] is None and bare[1] and bare[2]


def test_a_reranker_has_the_last_word(spark):
    c = spark.createDataFrame([(f"c{i}", i, f"text {i}", "f", 1, 1, ["text"], [1.0, float(i)]) for i in range(6)], "chunk_id string, ordinal int, text string, filename string, page_start int, page_end int, tokens array<string>, embedding array<double>")
    q = spark.createDataFrame([(1, "text", ["text"], [1.0, 0.0])], "query_id long, text string, tokens array<string>, embedding array<double>")
    by_number = lambda question, text: F.when(text != "text 5", F.regexp_extract(text, r"(\d)", 1).cast("int"))
    got = retrieve.retrieve(c, q, k=6, reranker=by_number).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["c4", "c3", "c2", "c1", "c0", "c5"] and got[0].reranked


def test_sql_functions(spark):
    assert len(sql.register(spark)) == len(sql.FUNCTIONS) == len(sql.register(spark))
    r = spark.sql("SELECT quill_overlap(array('a', 'b'), array('b')) AS o, quill_overlap(array(), array('b')) AS z, quill_dot(array(1.0D, 2.0D), array(3.0D, 4.0D)) AS d, quill_language(NULL) AS l").first()
    assert (round(r.o, 6), r.z, r.d, r.l) == (0.707107, 0.0, 11.0, "en")
    assert [tuple(x) for x in spark.sql("SELECT page, content FROM quill_pages('abcdefg', 3)").collect()] == [(1, "abc"), (2, "def"), (3, "g")]
    assert spark.sql("SELECT * FROM quill_pages('', 3)").count() == 0 and spark.sql("SELECT * FROM quill_sentences(' ')").count() == 0


def test_steps_counts_and_engines(spark):
    d = spark.createDataFrame([("plan",), ("x",), (None,)], "n string")
    assert [r.s for r in d.select(events.step_of(F.col("n"), {"one": ["plan", "route"], "two": []}).alias("s")).collect()] == ["one", None, None]
    cases = spark.createDataFrame([("who is this",), ("a longer question about the trade routes of that century",), (None,)], "text string")
    assert evaluation.boosted_count(cases, planner.needs_boost(F.col("text"))) == 1
    assert Options(text_engine="DIGITAL").text_engine == "DIGITAL"
    with pytest.raises(ValueError, match="text engine"):
        Options(text_engine="ocr")
