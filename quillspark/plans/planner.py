"""Spelling, query expansion and the offline query plan, as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import constants as C
from quillspark.functions import text as T

CHANGE = "struct<from:string,to:string>"


def fix_spelling(c: Column) -> Column:
    """struct(text, changes): sure fixes only, longest first; Latin ones as whole words in any case."""
    out, changes = F.coalesce(c, F.lit("")), []
    for src, dst in sorted(C.SPELLING.items(), key=lambda kv: -len(kv[0])):
        if re.search("[A-Za-z]", src):
            new = F.regexp_replace(out, rf"(?U)(?i)(?<!\w){re.escape(src)}(?!\w)", dst)
        else:
            new = F.replace(out, F.lit(src), F.lit(dst))
        changes.append(F.when(new != out, F.struct(F.lit(src).alias("from"), F.lit(dst).alias("to"))))
        out = new
    return F.struct(out.alias("text"), F.filter(F.array(*changes), lambda x: x.isNotNull()).alias("changes"))


def safe_edit(original: Column, corrected: Column, changes: Column) -> Column:
    """Whether a correction is one of spelling: little drift in length, at most six changes, none blank, single words
    alike in length."""
    o, c = T.strip(original), T.strip(corrected)

    def good(x: Column) -> Column:
        a, b = T.strip(x["from"]), T.strip(x["to"])
        single = ~F.contains(a, F.lit(" ")) & ~F.contains(b, F.lit(" "))
        return (a != "") & (b != "") & ~(single & (F.abs(F.length(a) - F.length(b)) > 4))

    drift = F.abs(F.length(c) - F.length(o)) <= F.greatest(F.lit(12), F.floor(F.length(o) * 0.25).cast("int") + 1)
    return (c != "") & ((c == o) | (drift & (F.size(changes) <= 6) & F.forall(changes, good)))


def correct(c: Column, reply: Column | None = None, enabled: bool = True, least: float = 0.85) -> Column:
    """struct(original, corrected, confidence, sure, changes, applied). ``reply`` is a model's JSON answer
    {corrected, confidence, sure, changes}, taken only if sure, confident, safe and different."""
    return T.let(F.coalesce(c, F.lit("")), lambda raw: T.let(fix_spelling(T.strip(raw)), lambda fixed: _correct(raw, fixed, reply, enabled, least)))


def _correct(raw: Column, fixed: Column, reply: Column | None, enabled: bool, least: float) -> Column:
    trimmed = T.strip(raw)

    def result(corrected: Column, confidence, sure, changes: Column, applied) -> Column:
        as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(raw.alias("original"), corrected.alias("corrected"), as_col(confidence).cast("double").alias("confidence"), as_col(sure).alias("sure"), changes.alias("changes"), as_col(applied).alias("applied"))

    none = F.array().cast(f"array<{CHANGE}>")
    if not enabled:
        return result(trimmed, 0.0, False, none, False)
    changed = fixed["text"] != trimmed
    plain = result(fixed["text"], F.when(changed, 1.0).otherwise(0.0), changed, fixed["changes"], changed)
    if reply is None:
        return plain
    r = F.from_json(F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?s)\{.*\}", 0), f"corrected string, confidence double, sure boolean, changes array<{CHANGE}>")
    theirs = F.coalesce(r["changes"], none)
    take = F.coalesce(r["sure"] & (r["confidence"] >= least) & safe_edit(fixed["text"], r["corrected"], theirs) & (T.strip(r["corrected"]) != fixed["text"]), F.lit(False))
    return F.when(take, result(T.strip(r["corrected"]), r["confidence"], True, F.array_union(fixed["changes"], theirs), True)).otherwise(plain)


def needs_boost(c: Column, min_words: int = 6) -> Column:
    """Few words, or mostly generic ones."""
    return T.let(T.words(T.strip(F.coalesce(c, F.lit("")))), lambda w: _few_or_generic(w, min_words))


def _few_or_generic(w: Column, min_words: int) -> Column:
    generic = F.size(F.filter(w, lambda x: F.lower(F.regexp_replace(x, "^[?.!,،؟]+|[?.!,،؟]+$", "")).isin(C.GENERIC_WORDS)))
    n = F.size(w)
    return (n > 0) & ((n <= max(2, min_words)) | (generic >= F.greatest(F.lit(2), F.floor(n / 2))))


def context_notes(c: Column) -> Column:
    """Two context lines, by the first bucket with a marker in the text."""
    low = F.lower(F.coalesce(c, F.lit("")))
    lines = lambda pair: F.array(*map(F.lit, pair))
    *buckets, (_, default) = C.CONTEXT_NOTES
    return reduce(lambda rest, b: F.when(T.contains_any(low, b[0]), lines(b[1])).otherwise(rest), reversed(buckets), lines(default))


def expand(c: Column, min_words: int = 6, enabled: bool = True) -> Column:
    """struct(text, notes, applied): a short or generic question followed by its two context lines."""

    def of(q: Column) -> Column:
        boost = needs_boost(q, min_words) if enabled else F.lit(False)
        notes = F.when(boost, context_notes(q)).otherwise(F.array().cast("array<string>"))
        return F.struct(F.when(boost, F.concat_ws("\n", q, F.array_join(notes, "\n"))).otherwise(q).alias("text"), notes.alias("notes"), boost.alias("applied"))

    return T.let(T.strip(F.coalesce(c, F.lit(""))), of)


def arabic_form(c: Column, translation: Column | None = None) -> Column:
    """Arabic text stays; else the first line of a translation if it has Arabic, without quotes; else the text."""
    if translation is None:
        return c
    line = F.regexp_replace(T.strip(F.substring_index(T.strip(translation), "\n", 1)), "^[\"'«»“”]+|[\"'«»“”]+$", "")
    return F.when(~T.has_arabic(c) & T.has_arabic(line), line).otherwise(c)


REPLY = "needs_database boolean, search_query string, keywords array<string>, reason string"


def plan(c: Column, min_words: int = 6, reply=None, translate=None) -> Column:
    """The plan of a question: struct(needs_database, mode, search_query, keywords, query_notes, boost_applied, reason,
    original_query). ``reply``, a column function from the boosted question to a model's JSON, may plan; where it gives no
    object, and without it, the offline plan holds. ``translate``, a column function, gives a search text in Arabic where
    the model gave none. Notes come once and the original question is kept."""
    return T.let(T.strip(F.coalesce(c, F.lit(""))), lambda q: T.let(correct(q)["corrected"], lambda fixed: T.let(expand(fixed, min_words), lambda boosted: _either(q, fixed, boosted, reply, translate))))


def merged_keywords(own: Column, notes: Column, most: int = 12) -> Column:
    """``own``, then the words of the notes that are not among them, as long as there are fewer than ``most``."""
    every = F.array_union(own, T.keywords(F.array_join(notes, " ")))
    return F.when(F.size(notes) > 0, F.slice(every, 1, F.greatest(F.lit(most), F.size(own)))).otherwise(own)


def _either(q: Column, fixed: Column, boosted: Column, reply, translate) -> Column:
    offline = _plan(q, fixed, boosted)
    if reply is None:
        return offline
    r = F.from_json(F.regexp_extract(F.coalesce(reply(boosted["text"]), F.lit("")), r"(?s)\{.*\}", 0), REPLY)
    none = F.array().cast("array<string>")
    needs = F.coalesce(r["needs_database"], F.lit(False))
    asked = T.strip(F.coalesce(r["search_query"], F.lit("")))
    asked = F.when(T.has_arabic(asked), asked).otherwise(arabic_form(boosted["text"], translate(boosted["text"]) if translate else None))
    search = F.when(F.size(boosted["notes"]) > 0, F.concat(asked, F.lit("\n"), F.array_join(F.slice(boosted["notes"], 1, 2), "\n"))).otherwise(asked)
    words = F.slice(F.filter(F.transform(F.coalesce(r["keywords"], none), T.strip), lambda x: x != ""), 1, 8)
    words = F.when((F.size(words) > 0) & ~F.exists(words, T.has_arabic), T.keywords(search)).otherwise(words)
    reason = T.strip(F.coalesce(r["reason"], F.lit("")))
    usual = F.when(~needs, "No DB needed").when(boosted["applied"], "READ-only Arabic retrieval plan + query booster notes for ambiguity").otherwise("READ-only Arabic retrieval plan")
    theirs = F.struct(
        needs.alias("needs_database"), F.lit("read").alias("mode"), F.when(needs, search).otherwise("").alias("search_query"), F.when(needs, merged_keywords(words, boosted["notes"])).otherwise(none).alias("keywords"),
        F.when(needs, boosted["notes"]).otherwise(none).alias("query_notes"), (needs & boosted["applied"]).alias("boost_applied"), F.when(reason != "", reason).otherwise(usual).alias("reason"), q.alias("original_query"),
    )
    return F.when((q == "") | r.isNull() | (r["needs_database"].isNull() & r["search_query"].isNull()), offline).otherwise(theirs)


def _plan(q: Column, fixed: Column, boosted: Column) -> Column:
    chat = (q == "") | (T.contains_any(F.lower(q), C.PLANNER_SMALL_TALK) & (F.size(T.words(q)) <= 6))
    none = F.array().cast("array<string>")
    return F.struct(
        (~chat).alias("needs_database"), F.lit("read").alias("mode"), F.when(chat, F.lit("")).otherwise(boosted["text"]).alias("search_query"), F.when(chat, none).otherwise(T.keywords(fixed)).alias("keywords"),
        F.when(chat, none).otherwise(boosted["notes"]).alias("query_notes"), (~chat & boosted["applied"]).alias("boost_applied"), F.when(chat, "small talk").otherwise("heuristic").alias("reason"), q.alias("original_query"),
    )
