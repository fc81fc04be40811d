"""Intent predicates and the route of a turn, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import constants as C
from quillspark.functions import text as T


def _raw(c: Column) -> Column:
    return T.strip(F.coalesce(c, F.lit("")))


def wants_summary(c: Column) -> Column:
    v = F.coalesce(c, F.lit(""))
    return T.contains_any(F.lower(v), C.SUMMARY_EN) | T.contains_any(v, C.SUMMARY_AR)


def small_talk(c: Column) -> Column:
    """Blank, or a marker anywhere in at most eight words."""
    raw = _raw(c)
    return (raw == "") | (T.contains_any(F.lower(raw), C.SMALL_TALK) & (F.size(T.words(raw)) <= 8))


def _asks(raw: Column) -> Column:
    return F.contains(raw, F.lit("?")) | F.contains(raw, F.lit("؟"))


def wants_knowledge(c: Column) -> Column:
    raw = _raw(c)
    return ~small_talk(raw) & (_asks(raw) | T.starts_with_any(F.lower(raw), C.QUESTION_STARTS) | (F.size(T.words(raw)) >= 4))


def wants_web(c: Column) -> Column:
    raw = _raw(c)
    low = F.lower(raw)
    profile = T.contains_any(low, C.PROFILE_EN) | T.contains_any(raw, C.PROFILE_AR)
    verb = T.contains_any(low, C.ASK_EN) | T.contains_any(raw, C.ASK_AR)
    pattern = raw.rlike("(?U)(?i)" + C.DOMAIN_PATTERN)
    for p in C.WEB_PATTERNS:
        pattern = pattern | low.rlike("(?U)(?i)" + p)
    return ~small_talk(raw) & (T.contains_any(low, C.WEB_DIRECT) | (profile & (verb | _asks(raw))) | pattern)


def route(text: Column, *, has_document=False, fresh=True, summarize=False, knowledge=False, use_web=False, use_knowledge=False) -> Column:
    """The route of a turn; flags are columns or constants."""
    doc, fresh, summarize, knowledge, use_web, use_knowledge = (x if isinstance(x, Column) else F.lit(x) for x in (has_document, fresh, summarize, knowledge, use_web, use_knowledge))
    web = wants_web(text)
    return (
        F.when(~fresh & ~doc, "call_model")
        .when(use_web | (doc & web), "web_search")
        .when(doc & (summarize | wants_summary(text) | (_raw(text) == "")), "summarize_document")
        .when(doc, "query_documents")
        .when(use_knowledge, F.when(knowledge, "query_knowledge_base").otherwise("call_model"))
        .when(web, "web_search")
        .when(knowledge & wants_knowledge(text), "query_knowledge_base")
        .otherwise("call_model")
    )
