"""Every turn of a batch on the route that was chosen for it: one plan a route, one table of answers."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark import tables
from quillspark.config import Options
from quillspark.functions import text as T
from quillspark.operators.chunking import full_text
from quillspark.plans import answers, questions
from quillspark.sources.documents import search_results_text

NO_RESULTS = "The web search found nothing."


def answer_turns(
    turns: DataFrame,
    pages: DataFrame | None = None,
    documents: DataFrame | None = None,
    knowledge: DataFrame | None = None,
    search: Callable[[DataFrame], DataFrame] | None = None,
    chat: Callable[[Column], Column] | None = None,
    summarize: Callable[[Column], Column] | None = None,
    options: Options = Options(),
    **providers,
) -> DataFrame:
    """query_id, agent_route, task_plan_summary, detected_language and answer of every turn (query_id, text, and the
    columns of ``questions.decisions``).

    ``documents``: the chunks that document questions search; ``pages`` (fingerprint, filename, page_number, text) and a
    column fingerprint of the turns: what is summarised; ``knowledge``: the chunks of the shared collection; ``search``:
    from (query_id, text) to results; ``chat`` and ``summarize``: column functions of a model, without which general
    conversation has no answer and summaries are extractive; ``providers``: embed, judge, answer, translate, reply. A
    route whose source is missing answers that nothing was found. Each route reads its own turns only, and routes
    without turns cost next to nothing."""
    decided = tables.written(questions.decisions(turns), "turns")
    of = lambda route: decided.where(F.col("agent_route") == route)
    asked = lambda route: of(route).select("query_id", F.col("text").alias("question"))
    wanted = {r.agent_route for r in decided.select("agent_route").distinct().collect()}  # five at most
    both = {k: v for k, v in providers.items() if k != "reply"}
    parts = []
    if "query_documents" in wanted:
        found = questions.none_found(asked("query_documents")) if documents is None else questions.document_questions(documents, asked("query_documents"), options, **both)
        parts.append(found.select("query_id", "answer"))
    if "query_knowledge_base" in wanted:
        parts.append(questions.knowledge_questions(knowledge, asked("query_knowledge_base"), options, **providers).select("query_id", "answer"))
    if "summarize_document" in wanted:
        d = of("summarize_document")
        if pages is None or "fingerprint" not in d.columns:
            parts.append(questions.none_found(asked("summarize_document")).select("query_id", "answer"))
        else:
            short = summarize or (lambda t: answers.summary(t, options.summary_chars))
            told = full_text(pages, "fingerprint").join(d.select("fingerprint").distinct(), "fingerprint", "left_semi")
            told = T.settled(told, "answer", short(F.col("full_text"))).select("fingerprint", "answer")
            parts.append(d.select("query_id", "fingerprint").join(told, "fingerprint", "left").select("query_id", "answer"))
    if "web_search" in wanted:
        d = of("web_search").select("query_id", T.search_query(F.col("text")).alias("text"))
        told = d.select("query_id").join(search_results_text(search(d)), "query_id", "left") if search else d.select("query_id", F.lit(None).cast("string").alias("text"))
        parts.append(told.select("query_id", F.coalesce("text", F.lit(NO_RESULTS)).alias("answer")))
    if "call_model" in wanted:
        reply = chat(F.col("text")) if chat else F.lit(None).cast("string")
        parts.append(T.settled(of("call_model").select("query_id", "text"), "answer", reply).select("query_id", "answer"))
    found = reduce(DataFrame.unionByName, parts) if parts else decided.select("query_id", F.lit(None).cast("string").alias("answer"))
    return decided.select("query_id", "agent_route", "task_plan_summary", "detected_language").join(found, "query_id", "left")
