import random
import re
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.config import Options, from_env
from quillspark.functions import text as T
from quillspark.functions import vectors as V
from quillspark.operators import chunking, evaluation
from quillspark.operators import ranking as R
from quillspark.plans import answers, planner, routing


def one(spark, make, *values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(make(F.col("v"))).collect()]


def test_spaced_letters_are_joined(spark):
    assert one(spark, T.collapse_spaced_letters, "ا ل ت ع", "كتاب", "ab c d") == ["التع", "كتاب", "ab c d"]


def test_reversed_words_are_turned(spark):
    turned = " ".join(w[::-1] for w in "المدرسة والمعلمون الكتابات".split())
    assert one(spark, T.repair_visual_order, turned) == ["المدرسة والمعلمون الكتابات"]


def test_normalisation_switches(spark):
    assert one(spark, T.normalize_arabic, "أحمد ذكرى مدرسة ـ", None, "") == ["احمد ذكري مدرسه", "", ""]
    assert one(spark, lambda c: T.normalize_arabic(c, teh=False), "مدرسة") == ["مدرسة"]


def test_compatibility_forms(spark):
    assert one(spark, T.nfkc, "ﻻ", "plain", None) == ["لا", "plain", None]


def test_tokens(spark):
    assert one(spark, T.tokenize, "The Cat's 12 الكتاب of x ١٢٣") == [["cat", "12", "كتاب", "123"]]


def test_languages(spark):
    assert one(spark, T.detect_language, "hello", "مرحبا", "hello مرحبا", " ", None, "ab مر") == ["en", "ar", "mixed", "en", "en", "ar"]


def test_file_names(spark):
    assert one(spark, T.sanitize_filename, "../a/b.txt", "c:\\x\\y?.pdf", "  ", None, "...") == ["b.txt", "y_.pdf", "uploaded.bin", "uploaded.bin", "uploaded.bin"]
    long = one(spark, T.sanitize_filename, "n" * 300 + ".pdf")[0]
    assert len(long) == 200 and long.endswith(".pdf")


def test_lines_that_repeat_go(spark):
    assert one(spark, T.dedupe_lines, "a\na\n\na\nb", "", None) == ["a\n\nb", "", ""]


def test_point_ids_are_uuids(spark):
    assert one(spark, T.uuid5, "abc:1:0:ff") == [str(uuid.uuid5(uuid.NAMESPACE_DNS, "abc:1:0:ff"))]


def brute_spans(text, size, overlap):
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            at = max(text.rfind("\n\n", start, end), text.rfind(" ", start, end))
            if at > start + size // 2:
                end = at + 1
        if text[start:end].strip():
            out.append(text[start:end].strip())
        if end >= len(text):
            break
        start = max(0, end - overlap)
    return out


@pytest.mark.parametrize(("size", "overlap"), [(50, 10), (50, 25), (200, 0)])
def test_spans(spark, size, overlap):
    text = "The cat sat on the mat. " * 20 + "x" * 130 + "\n\nend of it"
    assert one(spark, lambda c: chunking.split_text(c, size, overlap), text, "", "short") == [brute_spans(text, size, overlap), [], ["short"]]
    with pytest.raises(ValueError, match="overlap"):
        chunking.split_text(F.lit("x"), 50, 26)


def test_vectors(spark):
    d = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, z array<float>")
    r = d.select(V.normalized(F.col("a")), V.normalized(F.col("z")), V.cosine(F.col("a"), F.col("a")), V.cosine(F.col("a"), F.col("z"))).first()
    assert [round(x, 6) for x in r[0]] == [0.6, 0.8] and list(r[1]) == [0, 0] and round(r[2], 6) == 1 and r[3] == 0


def test_fusion_of_ties(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, id string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "query_id int, id string, rank int")
    got = {r.id: round(r.score, 9) for r in R.rrf([a, b], "id").collect()}
    assert got == {"x": round(1 / 61, 9), "y": round(1 / 61 + 1 / 62, 9), "z": round(1 / 62, 9)}


def test_equal_scores_scale_to_zero(spark):
    d = spark.createDataFrame([(1, 2.0), (1, 2.0)], "q int, s double")
    assert [r.o for r in R.min_max(d, "s", "o", "q").collect()] == [0, 0]


def test_trust_replies(spark):
    replies = ['{"sources":[{"index":1,"verdict":"RELEVANT"},{"index":"2","verdict":"relevant"},{"index":9,"verdict":"RELEVANT"}]}', '```json\n{"sources":[{"index":1,"verdict":"NOT_RELEVANT"}]}\n```\n### [1] Verdict: RELEVANT', "### [2] x\nVerdict: RELEVANT\n### [3]\nVerdict: NOT_RELEVANT", "", None, '{"sources":[]}\n### [1] Verdict: RELEVANT']
    assert one(spark, lambda c: answers.relevant_indexes(c, F.lit(3)), *replies) == [[1, 2], [], [2], [], [], [1]]


def test_spelling_and_plans(spark):
    assert one(spark, lambda c: planner.fix_spelling(c)["text"], "Sheherazade met SHAHRIYAR", "mySheherazade") == ["scheherazade met shahryar", "mySheherazade"]
    p = one(spark, planner.plan, "Who is the king?", "hello there", "")
    assert p[0].needs_database and p[0].boost_applied and len(p[0].query_notes) == 2 and p[0].keywords == ["king"]
    assert not p[1].needs_database and not p[2].needs_database


def test_corrections_must_be_safe(spark):
    reply = F.lit('{"corrected": "a cat sat", "confidence": 0.9, "sure": true, "changes": [{"from": "ct", "to": "cat"}]}')
    assert one(spark, lambda c: planner.correct(c, reply)["corrected"], "a ct sat", "something else entirely, much longer than that") == ["a cat sat", "something else entirely, much longer than that"]


def test_routes(spark):
    r = lambda **flags: one(spark, lambda c: routing.route(c, **flags), "what is the capital of France", "hi", "summarize it", "see example.com now please")
    assert r(knowledge=True) == ["query_knowledge_base", "call_model", "call_model", "web_search"]
    assert r(has_document=True) == ["query_documents", "query_documents", "summarize_document", "web_search"]
    assert r(use_knowledge=True) == ["call_model"] * 4
    assert r(use_web=True) == ["web_search"] * 4
    assert r(fresh=False) == ["call_model"] * 4


def test_options_from_the_environment():
    o = from_env(env={"QUILL_TOP_K": "5", "QUILL_RRF_K": "x", "QUILL_ENABLE_RERANK": "off"})
    assert (o.top_k, o.rrf_k, o.enable_rerank) == (5, 60, False)
    with pytest.raises(ValueError, match="overlap"):
        Options(chunk_size=100, chunk_overlap=60)


def test_plain_latin_texts_are_normalised_as_all_others(spark):
    """The short way for Latin texts gives what the whole way gives (here: with a letter beyond Latin at the end)."""
    texts = ["  a  b\t\tc ", "x\n\n\n\ny", "Über  Straße", "é\x0b\x0cè", "", " \n ", "a" * 3000 + "  b"]
    d = spark.createDataFrame([(i, t, t.rstrip() + " ‡") for i, t in enumerate(texts)], "i long, plain string, marked string")
    both = d.select("plain", T.normalize_arabic(F.col("plain"), diacritics=True).alias("a"), T.normalize_arabic(F.col("marked"), diacritics=True).alias("b")).collect()
    assert all(r.a == r.b.removesuffix("‡").rstrip() for r in both)


def test_unreliable_extraction_needs_lengths_alone(spark):
    """The same verdicts as over cleaned texts, without turning a word round."""
    r = random.Random(8)
    parts = ["ا", "ة", "لل", "المدرسة", "ةسردملا", "ـ", "كـ", "ت", " ", " ", " ", "\n\n\n\n", "\t", "‏", "ﻻ", "٣", "x", "é", "إ", "ً", " "]
    texts = [None, "", "ا ل ت ع", "م ن", *("".join(r.choices(parts, k=r.randint(1, 14))) for _ in range(1500))]
    d = T.settled(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "w", F.regexp_extract_all(T.clean_text(F.col("t")), F.lit(f"([{T.AR}]+)"), F.lit(1)))
    rows = d.select("t", "w", T.unreliable_extraction(F.col("t")).alias("bad")).collect()
    spaced = re.compile(rf"(?:[{T.AR}][\s]+){{2,}}[{T.AR}]")
    for t, w, bad in rows:
        arabic = re.search(f"[{T.AR}]", t or "")
        assert bad == bool(arabic and (spaced.search(t) or not w or sum(len(x) == 1 for x in w) / len(w) > 0.35 or sum(map(len, w)) / len(w) < 2.2)), (t, w, bad)
    assert 100 < sum(x.bad for x in rows) < 1400
    plan = spark.range(1).select(T.unreliable_extraction(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert "reverse(" not in plan


def test_semantic_chunks_move_no_vectors(spark):
    """Pages that stay whole rows give the chunks that rows of sentences do; one shuffle is left, of the pieces."""
    r = random.Random(2)
    sentence = lambda: " ".join(r.choices(["tree", "river", "الكتاب", "stone", "wind", "a"], k=r.randint(0, 9))) + r.choice([". ", "! ", "\n\n"])
    pages = spark.createDataFrame([(f"f{i % 5}", f"f{i % 5}.txt", i, "".join(sentence() for _ in range(r.randint(0, 30)))) for i in range(40)] + [("f9", "f9.txt", 1, None)], "fingerprint string, filename string, page_number int, text string")
    embed = V.hashed_embedding(16)
    got = chunking.semantic(pages, embed, 200, 0.5)
    key = lambda d: sorted((x.chunk_id, x.text) for x in d.collect())
    assert key(got) == key(chunking.semantic(pages, lambda t: embed(t), 200, 0.5))
    assert got.groupBy("fingerprint").count().where("count > 8").count()
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1


def test_text_postings_are_counts_of_tokens(spark):
    """Words cut over bytes are those of ``tokenize``, in any script, at every edge of a text."""
    r = random.Random(5)
    parts = ["the", "The", "a", "x", "Tree", "STONE", "é", "Übung", "ي", "ال", "الكتاب", "المدرسة", "من", "٣٤", "7", "42", " ", " ", " ", "-", "_", "'", "\n", "Ж", "中", "😀", "ﻻ", "ڀ", "܀", "İ"]
    texts = [None, "", " ", "a", "tree", "من", "الكتاب", *("".join(r.choices(parts, k=r.randint(1, 25))) for _ in range(800))]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = T.settled(d, "tokens", T.tokenize(F.col("text")))
    want = {x.doc_id: (len(x.tokens), Counter(x.tokens)) for x in rows.collect()}
    for made in (R.text_postings(d), R.postings(rows)):
        assert {x.doc_id: (x.dl, {t.term: t.tf for t in x.terms}) for x in made.collect()} == want


def test_scores_within_rows_keep_the_best(spark, monkeypatch):
    """Scores without a join are those of the join, and ``keep`` loses none of the best, in blocks of any size."""
    r = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    d = spark.createDataFrame([(i, r.choices(words, range(30, 0, -1), k=r.randint(0, 12))) for i in range(300)], "doc_id long, tokens array<string>").coalesce(2)
    q = spark.createDataFrame([(i, r.choices([*words, "none"], k=r.randint(0, 6))) for i in range(9)], "query_id long, tokens array<string>")
    best = lambda df, c: {(x.query_id, x.doc_id, x[c], x["rank"]) for x in R.top_k(df.withColumn(c, F.round(c, 6)), c, 5, "doc_id").collect()}
    every = {c: make(d, q) for c, make in (("bm25", R.bm25), ("overlap", R.overlap_scores))}
    rows = {c: df.count() for c, df in every.items()}
    assert not any("Join" in df._jdf.queryExecution().optimizedPlan().toString() for df in every.values())
    got = {c: best(df, c) for c, df in every.items()}
    monkeypatch.setattr(R, "CELLS", 450)
    assert got == {"bm25": best(R.bm25(d, q, keep=5), "bm25"), "overlap": best(R.overlap_scores(d, q, keep=5), "overlap")}
    monkeypatch.setattr(R, "BROADCAST_ROWS", 3)
    for c, make in (("bm25", R.bm25), ("overlap", R.overlap_scores)):
        joined = make(d, q)
        assert joined.count() == rows[c] and best(joined, c) == got[c]


def test_leading_tokens_are_the_first_of_all(spark):
    texts = [None, "", "the abc", "One two three THREE four five", "x" * 300 + " alpha beta gamma delta", "İstanbul Été Größe naïve words", "word " * 80 + "other third", "plain letters first " * 14 + "zero​width", "plain letters zero​width joined", "السلام عليكم plain word again", "alpha beta " + "ab " * 100 + "مرحبا gamma", "a1b2 c3d4مرحبا e5f6 g7h8", "KKelvin ﬁne ligature token word"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    whole = F.slice(F.array_distinct(F.filter(T.tokenize(F.col("text")), lambda t: F.length(t) >= 4)), 1, 3)
    for head in (8, 20, 256):
        assert [r for r in d.select("i", T.leading_tokens(F.col("text"), 3, 4, head).alias("a"), whole.alias("b")).collect() if r.a != r.b] == []


def test_trimming_and_squeezing(spark):
    texts = ["", " ", "a", " a", "a ", " a　", "a  b", "a \n b\tc", "\x85a  b ", "a b c", "\x1ca\x1c", None]
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    old = [F.regexp_replace("text", r"(?U)^\s+|\s+\z", ""), F.trim(F.regexp_replace("text", r"(?U)\s+", " "))]
    for r in d.select("text", T.strip(F.col("text")).alias("a"), old[0].alias("b"), T.squeeze(F.col("text")).alias("c"), old[1].alias("d"), T.blank(F.col("text")).alias("e")).collect():
        assert (r.a, r.c, r.e) == (r.b, r.d, not r.b), r.text


def test_challenge_cases_cut_a_text_once(spark):
    chunks = spark.createDataFrame([("c", 1, "text of some chunk")], "chunk_id string, page_start int, text string").repartition(1)
    plan = evaluation.challenge_cases(chunks)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if "Filter (" in line and "regexp_extract_all" in line]
