"""Document and knowledge questions in one call: retrieve, judge, answer, cite.

Models are column functions given by the caller (an Arrow function, a remote model's UDF, a test double); without them
the offline rules of ``answers`` decide. A question's group holds its top k hits only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark import tables
from quillspark.config import Options
from quillspark.functions import constants as C
from quillspark.functions import text as T
from quillspark.operators import ranking as R
from quillspark.plans import answers, planner, retrieve

#: (question, context) to an analysis; (question, analysis, language, index map) to an answer.
Judge = Callable[[Column, Column], Column]
Answer = Callable[[Column, Column, Column, Column], Column]


def _offline_analysis(hits: DataFrame) -> DataFrame:
    verdict = F.concat(F.lit("### ["), F.col("rank").cast("string"), F.lit("]\nVerdict: "), F.when(F.col("used"), "RELEVANT").otherwise("NOT_RELEVANT"))
    rows = F.array_sort(F.collect_list(F.struct("rank", verdict.alias("v"))))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(rows, lambda x: x["v"]), "\n\n").alias("analysis"))


def answered(hits: DataFrame, questions: DataFrame, judge: Judge | None = None, answer: Answer | None = None, missing: dict = C.NOT_IN_DOCUMENTS, language: Column | None = None) -> DataFrame:
    """query_id, used (ranks judged relevant), answer (text, analysis and sources) of every question.

    ``hits``: query_id, rank, filename, page_start, page_end, score, text; ``questions``: query_id, question. A question
    without hits gets the message ``missing``, one without relevant hits the insufficient message."""
    asked = T.settled(questions.select("query_id", "question"), "lang", T.response_language(language if language is not None else F.lit(None).cast("string"), F.col("question")))
    # k rows a question, which several steps read: a table, so that retrieval runs once.
    h = hits.select("query_id", "rank", "filename", "page_start", "page_end", "score", "text").join(R.small(asked.select("query_id", "question")), "query_id")
    h = tables.written(answers.offline_trust(h), "hits")
    place = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("filename", F.lit("")), F.lit(" p."), F.coalesce(F.col("page_start").cast("string"), F.lit("0")))
    places = F.array_sort(F.collect_list(F.struct("rank", place.alias("p"))))
    sizes = h.groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("n"), F.array_join(F.transform(places, lambda x: x["p"]), ", ").alias("index_map"))
    q = asked.join(sizes, "query_id", "left")
    if judge is None:
        q = q.join(_offline_analysis(h), "query_id", "left")
    else:
        q = q.join(answers.format_context(h), "query_id", "left")
        q = T.settled(q, "analysis", F.when(F.col("n") > 0, T.strip(judge(F.col("question"), F.col("context")))))
    q = T.settled(q, "used", F.when(F.col("n") > 0, answers.relevant_indexes(F.col("analysis"), F.col("n"))).otherwise(F.array().cast("array<int>")))
    q = tables.written(q, "judged")  # models are asked once
    marked = h.drop("used").join(q.select("query_id", F.col("used").alias("_used")), "query_id").withColumn("used", F.array_contains("_used", F.col("rank").cast("int"))).drop("_used")
    q = q.join(answers.format_sources(marked, "used"), "query_id", "left")
    if answer is None:
        q = q.join(answers.best_sentences(marked), "query_id", "left")
    else:
        q = T.settled(q, "body", F.when(F.size("used") > 0, T.strip(answer(F.col("question"), F.col("analysis"), F.col("lang"), F.col("index_map")))))
    none = F.when(F.col("lang") == "ar", missing["ar"]).when(F.col("lang") == "mixed", f"{missing['en']} / {missing['ar']}").otherwise(missing["en"])
    numbers = F.array_join(F.transform("used", lambda i: F.concat(F.lit("["), i.cast("string"), F.lit("]"))), ", ")
    whole = F.concat(T.strip_sources_footer(F.col("body")), F.lit("\n\n---\nSource analysis (trust layer) — used: "), numbers, F.lit(":\n"), T.truncated(F.col("analysis"), 3500, "\n…"), F.lit("\n\n"), F.col("sources"))
    text = (
        F.when(F.coalesce("n", F.lit(0)) == 0, F.concat(none, F.lit("\n\n" + C.NO_SOURCES)))
        .when(F.size("used") == 0, answers.insufficient(F.col("lang"), F.col("analysis"), F.col("sources")))
        .otherwise(whole)
    )
    return q.select("query_id", "used", text.alias("answer"))


def none_found(questions: DataFrame, missing: dict = C.NOT_IN_DOCUMENTS) -> DataFrame:
    """What ``answered`` gives for questions without hits."""
    nothing = questions.sparkSession.createDataFrame([], "query_id long, rank int, filename string, page_start int, page_end int, score double, text string")
    return answered(nothing.withColumn("query_id", F.col("query_id").cast(questions.schema["query_id"].dataType)), questions, missing=missing)


def document_questions(chunks: DataFrame, questions: DataFrame, options: Options = Options(), embed=None, judge: Judge | None = None, answer: Answer | None = None, translate=None, **filters) -> DataFrame:
    """Answers (``answered``) to questions (query_id, question) from the chunks of documents."""
    q = retrieve.prepare_queries(questions.select("query_id", F.col("question").alias("text")), embed, translate)
    return answered(retrieve.retrieve(chunks, q, options, **filters), questions, judge, answer)


def knowledge_questions(chunks: DataFrame | None, questions: DataFrame, options: Options = Options(), embed=None, judge: Judge | None = None, answer: Answer | None = None, reply=None, translate=None) -> DataFrame:
    """Answers to questions from a shared collection (None: there is none): every question is planned, its notes and
    keywords are part of the search text. ``reply`` is a column function from a question to a model's plan."""
    planned = T.settled(questions, "_p", planner.plan(F.col("question"), options.booster_min_words, reply, translate))
    search = F.when(F.col("_p.search_query") != "", F.col("_p.search_query")).otherwise(F.col("question"))
    text = F.concat_ws(" ", search, F.array_join("_p.keywords", " "))
    if chunks is None:
        return none_found(questions, C.NOT_IN_KNOWLEDGE)
    hits = retrieve.retrieve(chunks, retrieve.prepare_queries(planned.select("query_id", text.alias("text")), embed), options, scope="candidates")
    return answered(hits, questions, judge, answer, C.NOT_IN_KNOWLEDGE)


def decisions(turns: DataFrame) -> DataFrame:
    """Adds agent_route, task_plan_summary and detected_language to turns (text; optional columns
    document_data_base64 or pdf_data_base64, summarize_only or pdf_summarize_only, use_web_search, use_knowledge_base,
    knowledge_available)."""
    from quillspark.plans import routing

    first = lambda *names: F.coalesce(*[F.when(F.col(c).cast("string") != "", F.col(c).cast("string")) for c in names if c in turns.columns], F.lit(""))
    flag = lambda *names: F.coalesce(*[F.when(F.col(c), True) for c in names if c in turns.columns], F.lit(False))
    doc, web, base, ready = first("document_data_base64", "pdf_data_base64") != "", flag("use_web_search"), flag("use_knowledge_base"), flag("knowledge_available")
    route = routing.route(F.col("text"), has_document=doc, summarize=flag("summarize_only", "pdf_summarize_only"), knowledge=ready, use_web=web, use_knowledge=base)
    d = turns.withColumn("agent_route", route)
    plans = F.create_map(*[F.lit(x) for kv in C.ROUTE_PLANS.items() for x in kv])
    known = F.try_element_at(plans, F.col("agent_route"))
    usual = F.when(web, F.coalesce(known, F.lit("Search Internet"))).when(base, F.coalesce(known, F.lit("Database lookup"))).otherwise(F.coalesce(known, F.lit("General conversation")))
    empty = base & (F.col("agent_route") == "call_model") & ~doc & ~ready
    return d.withColumns({"task_plan_summary": F.when(empty, C.EMPTY_KNOWLEDGE_PLAN).otherwise(usual), "detected_language": T.detect_language(F.col("text"))})
