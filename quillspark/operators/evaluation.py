"""Retrieval evaluation: pass rules, grounding and grouped reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T


def passes(blob: Column, expect_any: Column, fold: bool = False) -> Column:
    """Whether any expected token occurs in the text of the hits."""
    b = F.lower(blob) if fold else blob
    return F.exists(expect_any, lambda t: F.contains(b, F.lower(t) if fold else t))


def passes_fingerprint(blob: Column, fingerprint: Column, expect_any: Column) -> Column:
    """The fingerprint, its first 30 characters, or any expected token."""
    b, fp = T.squeeze(blob), T.squeeze(fingerprint)
    found = F.contains(b, fp) | F.contains(b, F.left(fp, F.lit(30)))
    return F.coalesce(F.when(F.length(fp) > 0, found), F.lit(False)) | passes(blob, expect_any)


#: Characters of the tokens of one automaton.
AUTOMATON = 4 << 20


def token_blocks(tokens: DataFrame, most: int = AUTOMATON) -> Iterator[list[str]]:
    """The distinct, non-empty texts of ``tokens`` (token) in blocks of at most ``most`` characters (one at least); the
    driver holds a block at a time."""
    block, size = [], 0
    for r in tokens.where(F.coalesce(F.length("token"), F.lit(0)) > 0).select("token").distinct().toLocalIterator():
        if block and size + len(r.token) > most:
            yield block
            block, size = [], 0
        block.append(r.token)
        size += len(r.token)
    if block:
        yield block


def found_tokens(chunks: DataFrame, tokens: list[str]) -> DataFrame:
    """token: those of ``tokens`` that some text holds. One automaton for all of them reads each text once; a task reports
    a token once, and stops looking for what it has found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, left = ahocorasick.Automaton(), set(range(len(tokens)))
        for i, t in enumerate(tokens):
            automaton.add_word(t, i)
        automaton.make_automaton()
        for b in batches:
            seen = set()
            for t in b.column("text").to_pylist():
                if left and t:
                    seen.update(i for _, i in automaton.iter(t) if i in left)
            left -= seen
            yield pa.RecordBatch.from_pydict({"token": pa.array([tokens[i] for i in seen], pa.string())})

    return chunks.select("text").mapInArrow(run, "token string").distinct()


def grounded(cases: DataFrame, chunks: DataFrame) -> DataFrame:
    """Cases (qid, expect_any) with an expected token in some chunk (text). Tokens go to the texts in blocks of bounded
    size, one automaton each; an empty or null token is in no text. A case set of many blocks reads the texts once for
    each."""
    tokens = cases.select("qid", F.explode("expect_any").alias("token"))
    found = reduce(DataFrame.unionByName, (found_tokens(chunks, block) for block in token_blocks(tokens)), tokens.select("token").where("false"))
    return cases.join(tokens.join(found, "token", "left_semi").select("qid").distinct(), "qid", "left_semi")


def evaluated(cases: DataFrame, hits: DataFrame, fold: bool = False) -> DataFrame:
    """Cases (qid, expect_any, ...) with ``passed``: whether any expected token is in the texts of the case's hits
    (query_id, rank, text). A case without hits has not passed. A case has its top k hits, so a group is small."""
    blob = hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n").alias("_blob"))
    d = cases.join(blob.withColumnRenamed("query_id", "qid"), "qid", "left")
    return d.withColumn("passed", F.coalesce(passes(F.col("_blob"), F.col("expect_any"), fold), F.lit(False))).drop("_blob")


def report(results: DataFrame, theme: str = "theme", ok: str = "passed", threshold: float = 0.9) -> DataFrame:
    """theme (null: overall), passed, total, score, ok."""
    n = F.count(F.lit(1))
    good = F.count_if(F.col(ok))
    return results.rollup(theme).agg(good.alias("passed"), n.alias("total"), (good / n).alias("score"), ((good / n) >= threshold).alias("ok"))


def stratified(cases: DataFrame, by: str, k: int, key: str = "qid", seed: int = 7) -> DataFrame:
    """``k`` cases of each kind: those with the least hash of seed and key, so the same ones from any order of rows. A
    task keeps k rows a kind before rows meet."""
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    w = Window.partitionBy(by).orderBy("_mark", key)
    return cases.withColumn("_mark", mark).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_mark", "_n")


def passage_cases(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """qid, kind, text, expect_any: questions made of the middle of each chunk (key: a number, text) that is long enough:
    the passage itself, its words in reverse, with words before it, and its first half. The passage is what a hit must hold."""
    d = T.settled(chunks.select(F.col(key).cast("long").alias("id"), "text"), "fp", T.mid_fingerprint(F.col("text"))).where("fp is not null")
    kinds = [("phrase", F.col("fp")), ("reversed", F.array_join(F.reverse(F.split("fp", " ")), " ")), ("noisy", F.concat(F.lit("please find "), "fp")), ("half", F.left("fp", F.lit(24)))]
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("kind"), t.alias("text")) for i, (k, t) in enumerate(kinds)]))
    return d.select("id", "fp", rows.alias("k")).select((F.col("id") * 10 + F.col("k.i")).alias("qid"), "k.kind", "k.text", F.array("fp").alias("expect_any"))


def boosted_count(cases: DataFrame, boosted: Column) -> int:
    """How many cases have a query that was boosted."""
    return cases.agg(F.count_if(F.coalesce(boosted, F.lit(False))).alias("n")).first().n


def retrieval_report(cases: DataFrame, retrieve: Callable[[DataFrame], DataFrame], by: str = "kind") -> DataFrame:
    """``report`` of cases (qid, kind, text, expect_any) by kind: each is retrieved and passes if a hit's text, white
    space aside, holds what it expects. ``retrieve``: from (query_id, text) to hits (query_id, rank, text)."""
    hits = retrieve(cases.select(F.col("qid").alias("query_id"), "text")).select("query_id", "rank", T.squeeze(F.col("text")).alias("text"))
    return report(evaluated(cases.withColumn("expect_any", F.transform("expect_any", T.squeeze)), hits), by)


def challenge_cases(chunks: DataFrame, seed: int = 7, n: int = 100) -> DataFrame:
    """Question cases made from chunk texts: a token, a phrase or a fingerprint of a chunk, in a seeded order. What a case
    asks is spelled out for the ``n`` cases that are left."""
    d = T.settled(chunks.select("chunk_id", F.col("page_start").alias("page_hint"), "text"), "fingerprint", T.mid_fingerprint(F.col("text"))).where("fingerprint is not null")
    d = T.settled(d, "expect_any", T.leading_tokens(F.col("text"), 3, 4)).where(F.size("expect_any") == 3).drop("text")
    tokens, kind = F.col("expect_any"), F.col("challenge")
    asked = (
        F.when(kind == "keyword", F.element_at(tokens, 1))
        .when(kind == "keywords", F.array_join(tokens, " "))
        .when(kind == "question", F.concat(F.lit("what is said about "), F.element_at(tokens, 2), F.lit("?")))
        .when(kind == "reversed", F.array_join(F.reverse(tokens), " "))
        .when(kind == "phrase", F.left("fingerprint", F.lit(30)))
        .otherwise(F.concat_ws(" ", F.lit("please find"), F.element_at(tokens, 3)))
    )
    kinds = F.array(*map(F.lit, ("keyword", "keywords", "question", "reversed", "phrase", "noisy")))
    rows = d.select("chunk_id", "page_hint", "fingerprint", "expect_any", F.explode(kinds).alias("challenge"))
    best = rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "chunk_id", "challenge")), "chunk_id", "challenge").limit(n)
    return best.withColumn("query", asked)
