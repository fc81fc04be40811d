"""Trust verdicts, context and source formatting, and offline answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import constants as C
from quillspark.functions import text as T


def relevant_indexes(analysis: Column, chunk_count: Column) -> Column:
    """Ascending indexes 1..chunk_count judged RELEVANT: from the JSON object's ``sources``; without any entry there,
    from sections headed ``### [n]`` by the first verdict line of each. ``analysis`` must not hold an Arrow function."""
    text = T.strip(F.coalesce(analysis, F.lit("")))
    fence = lambda t: F.regexp_extract(F.regexp_replace(t, r"(?is)^```(?:json)?\s*(.*?)\s*```$", "$1"), r"(?s)\{.*\}", 0)
    items = lambda t: F.from_json(F.get_json_object(fence(t), "$.sources"), "array<string>")
    inside = lambda i: F.coalesce(i.between(1, chunk_count), F.lit(False))

    def listed(found: Column) -> Column:
        each = F.transform(found, lambda x: F.struct(F.get_json_object(x, "$.index").try_cast("int").alias("i"), F.upper(F.get_json_object(x, "$.verdict")).alias("v")))
        return F.transform(F.filter(each, lambda x: F.coalesce(x["v"] == "RELEVANT", F.lit(False)) & inside(x["i"])), lambda x: x["i"])

    def headed(t: Column) -> Column:
        """What stands behind ``###`` begins with ``[n]``; the next line that names a verdict decides."""
        parts = F.slice(F.split(t, "###"), F.lit(2), F.greatest(F.size(F.split(t, "###")) - 1, F.lit(0)))
        verdict = lambda p: F.upper(F.trim(F.substring_index(F.split_part(F.regexp_replace(p, "(?i)verdict:", "\x01"), F.lit("\x01"), F.lit(2)), "\n", 1)))
        each = F.transform(parts, lambda p: F.struct(F.substring_index(F.substring_index(F.ltrim(p), "]", 1), "[", -1).try_cast("int").alias("i"), F.startswith(F.ltrim(p), F.lit("[")).alias("headed"), verdict(p).alias("v")))
        return F.transform(F.filter(each, lambda x: x["headed"] & F.startswith(x["v"], F.lit("RELEVANT")) & inside(x["i"])), lambda x: x["i"])

    chosen = T.let(text, lambda t: T.let(items(t), lambda found: F.when(F.coalesce(F.size(found) > 0, F.lit(False)), listed(found)).otherwise(headed(t))))
    return F.when(chunk_count > 0, F.array_sort(F.array_distinct(chosen))).otherwise(F.array().cast("array<int>"))


def page_label(start: Column, end: Column, one: str, many: str, none: str) -> Column:
    s, e = F.coalesce(start, F.lit(0)), F.coalesce(end, F.lit(0))
    return F.when((s != 0) & (e != 0) & (s != e), F.format_string(f"{many} %d-%d", s, e)).when(s != 0, F.format_string(f"{one} %d", s)).otherwise(none)


def score_text(score: Column) -> Column:
    """Three decimals, ties to even."""
    return F.format_string("%.3f", F.bround(score, 3))


def format_context(hits: DataFrame) -> DataFrame:
    """query_id, context: hits (query_id, rank, filename, page_start, page_end, score, text) of a query in order. A
    query has its top k hits, so a group is small."""
    part = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("filename", F.lit("")), F.lit(" · "), page_label(F.col("page_start"), F.col("page_end"), "Page", "Pages", "Page ?"), F.lit(" · score="), score_text(F.col("score")), F.lit("\n"), F.col("text"))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", part.alias("p")))), lambda x: x["p"]), "\n\n---\n\n").alias("context"))


def format_sources(hits: DataFrame, used: str | None = None) -> DataFrame:
    """query_id, sources: one line a hit; ``used`` names a boolean column that marks hits USED or reviewed."""
    flag = F.when(F.col(used), ", USED").otherwise(", reviewed") if used else F.lit("")
    line = F.concat(F.lit("- ["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("filename", F.lit("")), F.lit(" (score="), score_text(F.col("score")), F.lit(", "), page_label(F.col("page_start"), F.col("page_end"), "page", "pages", "page n/a"), flag, F.lit(")"))
    rows = F.array_sort(F.collect_list(F.struct("rank", line.alias("p"))))
    head = F.concat(F.lit("Sources (top "), F.count(F.lit(1)).cast("string"), F.lit(" retrieved — model read each before answering):\n"))
    return hits.groupBy("query_id").agg(F.concat(head, F.array_join(F.transform(rows, lambda x: x["p"]), "\n")).alias("sources"))


def insufficient(lang: Column, analysis: Column, sources: Column) -> Column:
    """The message, in a language, for a question that the evidence does not answer."""
    body = F.when(lang == "ar", C.INSUFFICIENT["ar"]).when(lang == "mixed", C.INSUFFICIENT["mixed"]).otherwise(C.INSUFFICIENT["en"])
    cut = F.when(F.length(analysis) <= 3500, analysis).otherwise(F.concat(F.left(analysis, F.lit(3500)), F.lit("\n…")))
    return F.concat(body, F.lit("\n\n---\nSource analysis (trust layer):\n"), cut, F.lit("\n\n"), F.coalesce(sources, F.lit(C.NO_SOURCES)))


def with_tokens(hits: DataFrame) -> DataFrame:
    """Adds question_tokens and text_tokens to hits (question, text), each computed once."""
    if "text_tokens" in hits.columns:
        return hits
    return T.settled(T.settled(hits, "question_tokens", T.rerank_tokens(F.col("question"))), "text_tokens", T.rerank_tokens(F.col("text")))


def offline_trust(hits: DataFrame, least: float = 0.1) -> DataFrame:
    """Adds ``used``: hits whose tokens overlap those of the question (columns question, text) enough."""
    from quillspark.operators.ranking import lexical_overlap

    return with_tokens(hits).withColumn("used", lexical_overlap(F.col("question_tokens"), F.col("text_tokens")) >= least)


def best_sentences(hits: DataFrame, sentences_each: int = 1) -> DataFrame:
    """query_id, body: of every used hit the sentences that share most tokens with the question (then the least by
    text), with the hit's rank as citation, a line a hit; empty where no hit is used. A sentence is a row, so its tokens
    are found once; a hit's best sentences are kept before rows meet."""
    d = with_tokens(hits.where("used"))
    s = T.settled(d.select("query_id", "rank", "question_tokens", F.explode(T.sentences(F.col("text"))).alias("s")), "_t", T.rerank_tokens(F.col("s")))
    s = s.withColumn("n", F.size(F.array_intersect("question_tokens", "_t")))
    order = Window.partitionBy("query_id", "rank").orderBy(F.col("n").desc(), "s")
    top = s.withColumn("_i", F.row_number().over(order)).where(F.col("_i") <= sentences_each)
    lines = top.groupBy("query_id", "rank").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "s"))), lambda x: x["s"]), " ").alias("l"))
    rows = F.array_sort(F.collect_list(F.struct("rank", F.concat("l", F.lit(" ["), F.col("rank").cast("string"), F.lit("]")).alias("l"))))
    return lines.groupBy("query_id").agg(F.array_join(F.transform(rows, lambda x: x["l"]), "\n").alias("body"))


def offline_answers(hits: DataFrame, sentences_each: int = 1) -> DataFrame:
    """query_id, answer: ``best_sentences``, or the insufficient message where no hit is used."""
    q = hits.groupBy("query_id").agg(F.first("question").alias("question")).join(best_sentences(hits, sentences_each), "query_id", "left")
    return q.select("query_id", F.coalesce("body", F.when(T.detect_language(F.col("question")) == "ar", C.INSUFFICIENT["ar"]).otherwise(C.INSUFFICIENT["en"])).alias("answer"))


def summary(full_text: Column, chars: int = 48_000, sentences: int = 3) -> Column:
    """An extractive summary: the first sentences of the first ``chars`` characters (4000 at least)."""
    return F.array_join(F.slice(T.sentences(F.left(full_text, F.lit(max(4000, chars)))), 1, sentences), " ")
