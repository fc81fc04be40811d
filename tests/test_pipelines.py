import base64
import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark.config import Options
from quillspark.functions import vectors as V
from quillspark.operators import evaluation
from quillspark.operators.collections import Collections, open_store
from quillspark.plans import planner, questions, retrieve
from quillspark.sources import documents as S
from quillspark.streaming import events, ingest


def docx(*lines):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in lines) + "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_payloads(spark):
    d = spark.createDataFrame([("",), (None,), ("***",), (base64.b64encode(b"hi").decode(),)], "c string").select(S.decode_payload(F.col("c"), 1 << 20).alias("p"))
    assert [r.p.error is None for r in d.collect()] == [False, False, False, True]


def test_files_become_pages_or_errors(spark):
    rows = [("a.txt", b"one line\n" * 900), ("b.docx", docx("Hello", "World")), ("c.png", b"\x89PNG...."), ("d.bin", b"\x00"), ("e.docx", b"broken"), ("f.txt", "سلام".encode("cp1256"))]
    got = {}
    for r in S.load(spark.createDataFrame(rows, "filename string, content binary")).collect():
        got.setdefault(r.filename, []).append((r.page_number, r.text, r.load_error))
    assert [p[0] for p in sorted(got["a.txt"])] == [1, 2, 3]
    assert got["b.docx"][0][1] == "Hello\nWorld\na | b"
    assert got["f.txt"][0][1] == "سلام"
    assert all(got[f][0][0] == 0 and got[f][0][2] for f in ("c.png", "d.bin", "e.docx"))


def test_collections_upsert_and_stay_idempotent(spark, tmp_path):
    store = Collections(spark, f"file://{tmp_path}", dims=2)
    rows = spark.createDataFrame([("k1", "one", [1.0, 0.0]), ("k2", "two", [0.0, 1.0])], "chunk_id string, text string, embedding array<float>")
    assert store.read("c") is None and store.count("c") == 0
    store.upsert("c", rows, 1)
    store.upsert("c", rows, 1)
    store.upsert("c", rows.where("chunk_id = 'k1'").withColumn("text", F.lit("new")), 2)
    assert {r.chunk_id: r.text for r in store.read("c").collect()} == {"k1": "new", "k2": "two"}


def test_ingest_stream_and_retrieval(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/cats.txt").write_text("The cat sat on the mat and purred loudly all day.")
    (tmp_path / "in/ships.txt").write_text("A ship crossed the ocean with a cargo of spices.")
    store, embed = Collections(spark, f"file://{tmp_path}/store"), V.hashed_embedding(32)
    for _ in range(2):  # the second run finds nothing new
        ingest.ingest_stream(spark, f"file://{tmp_path}/in", store, "kb", f"file://{tmp_path}/ck", embed=embed).awaitTermination(120)
    assert store.count("kb") == 2
    q = retrieve.prepare_queries(spark.createDataFrame([(1, "ship cargo"), (2, "purring cat")], "query_id int, text string"), embed)
    for scope in ("corpus", "candidates"):
        hits = retrieve.retrieve(store.read("kb"), q, Options(), scope=scope).where("rank = 1").collect()
        assert {r.query_id: r.filename for r in hits} == {1: "ships.txt", 2: "cats.txt"}
    weighted = retrieve.retrieve(store.read("kb"), q, Options(fusion="weighted", enable_rerank=False), k=1).collect()
    assert {r.query_id: r.filename for r in weighted} == {1: "ships.txt", 2: "cats.txt"}


def test_collections_record_their_size_and_compact(spark, tmp_path):
    store = open_store(spark, "parquet", folder=f"file://{tmp_path}", dims=2)
    rows = spark.createDataFrame([("k1", "a", 2, [1.0, 0.0]), ("k1", "b", 1, [1.0, 0.0])], "chunk_id string, text string, n int, embedding array<float>")
    store.upsert("c", rows, 1, order="n")
    store.append("d", rows, 1)
    store.append("d", rows, 1)
    assert store._rows("d", store.generation("d")[1]["parts"]).count() == 2
    store.upsert("c", rows.withColumn("chunk_id", F.lit("k2")), 2)
    store.compact("c")
    assert {r.chunk_id: r.text for r in store.read("c").collect()} == {"k1": "a", "k2": "b"}
    assert len(store.generation("c")[1]["parts"]) == 1
    with pytest.raises(ValueError, match="2 places"):
        Collections(spark, f"file://{tmp_path}", dims=3).create("c")
    with pytest.raises(ValueError, match="unknown store"):
        open_store(spark, "other")


def test_questions(spark):
    hits = spark.createDataFrame([(1, 1, "ships.txt", 1, 1, 0.4, "A ship crossed the ocean with a cargo of spices."), (1, 2, "cats.txt", 1, 1, 0.1, "The cat purred."), (3, 1, "cats.txt", 1, 1, 0.1, "The cat purred.")], "query_id long, rank int, filename string, page_start int, page_end int, score double, text string")
    q = spark.createDataFrame([(1, "Which ship had a cargo of spices?"), (2, "  "), (3, "quantum chromodynamics lagrangian")], "query_id long, question string")
    judge = lambda question, context: F.lit('{"sources": [{"index": 1, "verdict": "RELEVANT"}]}')
    reply = lambda question, analysis, language, places: F.concat(F.lit("By model, "), language, F.lit(": "), places, F.lit("\n\nSources: mine"))
    told = {r.query_id: r for r in questions.answered(hits, q, judge, reply).collect()}
    assert told[1].answer.startswith("By model, en: [1] ships.txt p.1, [2] cats.txt p.1") and "Sources: mine" not in told[1].answer
    assert told[2].answer.startswith("The answer cannot be determined") and told[2].used == []
    got = {r.query_id: r for r in questions.answered(hits, q).collect()}
    assert got[1].answer.startswith("A ship crossed the ocean with a cargo of spices. [1]") and "used: [1]" in got[1].answer and got[3].used == []


def test_plans_by_a_model_and_decisions(spark):
    d = spark.createDataFrame([("who is the king",), ("hello",), ("a longer question about the trade routes of that century",)], "text string")
    reply = lambda text: F.when(F.contains(text, F.lit("hello")), "no json").otherwise('{"needs_database": true, "search_query": "من هو الملك", "keywords": ["الملك", " "], "reason": ""}')
    got = [r.p for r in d.select(planner.plan(F.col("text"), reply=reply).alias("p")).collect()]
    assert got[0].search_query.startswith("من هو الملك\n") and got[0].keywords[0] == "الملك" and 1 < len(got[0].keywords) <= 12 and got[0].boost_applied
    assert not got[1].needs_database and got[1].reason == "small talk"
    assert got[2].keywords == ["الملك"] and got[2].reason == "READ-only Arabic retrieval plan"
    turns = spark.createDataFrame([("what is this", "eA==", False), ("hello", "", True)], "text string, pdf_data_base64 string, use_knowledge_base boolean")
    assert [r.task_plan_summary.split(" ")[0] + r.agent_route for r in questions.decisions(turns).collect()] == ["Retrievequery_documents", "Databasecall_model"]


def test_event_json_and_evaluation(spark):
    e = spark.createDataFrame([('{"metadata": {"langgraph_node": "plan"}, "name": "x", "data": {"output": {"a": 1}}}', '[{"text": "a"}, "b", {"x": 1}]'), ('{"name": "x", "data": {"output": [1]}}', '" hi "'), ("{}", "plain")], "e string, m string")
    got = e.select(events.event_node(F.col("e")).alias("n"), events.event_output(F.col("e")).alias("o"), events.message_text(F.col("m")).alias("t")).collect()
    assert [tuple(r) for r in got] == [("plan", '{"a":1}', "a\nb"), ("x", '{"output":[1]}', "hi"), (None, "{}", "plain")]
    cases = spark.createDataFrame([(1, ["spice"]), (2, ["spice"]), (3, ["x"])], "qid int, expect_any array<string>")
    hits = spark.createDataFrame([(1, 1, "no"), (1, 2, "spices"), (2, 1, "none")], "query_id int, rank int, text string")
    assert {r.qid: r.passed for r in evaluation.evaluated(cases, hits).collect()} == {1: True, 2: False, 3: False}


def test_run_events(spark):
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    rows = [("r", "plan", "start", t(1)), ("r", "plan", "start", t(1)), ("r", "plan", "end", t(2)), ("r", "query", "start", t(3))]
    e = events.unique_events(spark.createDataFrame(rows, "run_id string, node string, phase string, ts timestamp"), ["run_id", "node", "phase"])
    assert e.count() == 3
    steps = events.step_state(e)
    assert {r.node: r.status for r in steps.collect()} == {"plan": "completed", "query": "running"}
    assert events.progress(steps, 2).first().percent == 75
