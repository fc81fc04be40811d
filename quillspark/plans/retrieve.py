"""Hybrid retrieval for a batch of queries, over a document's chunks or a shared collection."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark import tables
from quillspark.config import Options
from quillspark.functions import text as T
from quillspark.functions import vectors as V
from quillspark.operators import ranking as R
from quillspark.operators.collections import Collections
from quillspark.plans import planner


def with_tokens(df: DataFrame, compat: bool = False) -> DataFrame:
    return T.settled(df, "tokens", T.tokenize(F.col("text"), compat))


def _finish(fused: DataFrame, chunks: DataFrame, queries: DataFrame, k: int, fetch: int, options: Options, filters: dict, scope: str, reranker=None) -> DataFrame:
    """Ranked rows of chunk data: filters, cut, threshold, then rerank or the first k; with the ways they were found."""
    hits = fused.join(chunks.drop("tokens", "embedding"), "chunk_id")
    hits = R.metadata_filter(hits, **filters) if filters else hits
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("dense_rank").asc_nulls_last(), "sparse_rank")
    hits = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(fetch, k))
    hits = R.min_score(hits, options.min_score)
    hybrid = options.retrieval_mode == "hybrid"
    hits = hits.withColumns({"retrieval": F.lit(f"hybrid-{scope}" if hybrid else "semantic"), "fusion": F.lit(options.fusion if hybrid else "none"), "reranked": F.lit(options.enable_rerank)})
    if reranker is not None:
        asked = queries.select("query_id", F.col("text").alias("_q"))
        hits = T.settled(hits.join(R.small(asked), "query_id"), "_by", reranker(F.col("_q"), F.col("text")).cast("double"))
        judged = hits.withColumns({"prior_rank": F.col("rank"), "score": F.coalesce("_by", F.lit(float("-inf"))), "reranked": F.lit(True)}).drop("rank", "_q", "_by")
        return R.top_k(judged, "score", k, "prior_rank").drop("prior_rank")
    if not options.enable_rerank:
        # Ranks close up after the threshold.
        return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("rank") <= k)
    q = queries.select("query_id", T.rerank_tokens(F.col("text")).alias("_q"))
    hits = hits.join(R.small(q), "query_id")
    return R.rerank(hits, k, R.lexical_overlap(F.col("_q"), T.rerank_tokens(F.col("text"))), options.rerank_semantic_weight, options.rerank_lexical_weight).drop("_q")


def _corpus_fusion(dense: DataFrame, chunks: DataFrame, queries: DataFrame, fetch: int, options: Options, filters: dict) -> DataFrame:
    """Fused scores of all chunks that can be among the first ``fetch``, as if every chunk stood in the second list:
    by BM25, then ordinal and chunk_id, those without a shared term last.

    Only chunks with a shared term are scored. A chunk's place in the second list is a count of what stands before it
    (``count_before``), so neither a product of chunks and questions nor a sort of all chunks is made. What is neither in
    the first list nor among the first 2 * fetch of the second cannot be among the first ``fetch`` of both."""
    known = ["chunk_id", "ordinal"]
    postings = R.indexed(chunks.select(*known, "tokens"), "chunk_id", "ordinal")
    scored = tables.written(R.bm25(postings, queries, "chunk_id", options.bm25_k1, options.bm25_b, ("ordinal",)).withColumn("bm25", F.round("bm25", R.DIGITS)), "scored")
    allowed = R.metadata_filter(chunks, **filters).select(*known) if filters else chunks.select(*known)
    best = scored.join(allowed.select("chunk_id"), "chunk_id", "left_semi") if filters else scored
    by_score = Window.partitionBy("query_id").orderBy(F.col("bm25").desc(), *known)
    first = best.withColumn("_n", F.row_number().over(by_score)).where(F.col("_n") <= 2 * fetch).select("query_id", *known)
    # Questions with few scored chunks also need the first of the others; 4 * fetch chunks hold enough of them.
    total = scored.groupBy("query_id").agg(F.count(F.lit(1)).alias("scored"), F.min("bm25").alias("lo"), F.max("bm25").alias("hi"))
    total = queries.select("query_id").join(total, "query_id", "left").select("query_id", F.coalesce("scored", F.lit(0)).alias("scored"), "lo", "hi")
    others = allowed.orderBy("ordinal", "chunk_id").limit(4 * fetch).withColumn("_all", F.lit(0))
    if filters:
        short = total.join(best.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n")), "query_id", "left").where(F.coalesce("_n", F.lit(0)) < 2 * fetch)
    else:
        short = total.where(F.col("scored") < 2 * fetch)
    others = short.select("query_id", F.lit(0).alias("_all")).join(F.broadcast(others), "_all").select("query_id", *known)
    near = dense.select("query_id", "chunk_id").join(chunks.select(*known), "chunk_id").select("query_id", *known)
    candidates = near.unionByName(first).unionByName(others).distinct().join(scored.select("query_id", "chunk_id", "bm25"), ["query_id", "chunk_id"], "left")
    candidates = tables.written(candidates, "candidates")

    n = postings.count()
    hit, rest = candidates.where("bm25 is not null"), candidates.where("bm25 is null")
    by_place, by_score = F.struct("ordinal", "chunk_id"), F.struct((-F.col("bm25")).alias("s"), "ordinal", "chunk_id")
    before = R.count_before(scored, hit, ["query_id"], by_score).select("query_id", F.col("mark.chunk_id").alias("chunk_id"), (F.col("before") + 1).alias("sparse_rank"))
    ranked = hit.join(before, ["query_id", "chunk_id"])
    # Of the others: all scored chunks, then the chunks before it that are not scored.
    smaller = chunks.groupBy("ordinal").agg(F.count(F.lit(1)).alias("_n")).withColumn("_smaller", F.sum("_n").over(Window.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)))
    same = R.count_before(chunks.select("ordinal", "chunk_id"), rest, ["ordinal"], F.col("chunk_id")).select("ordinal", F.col("mark").alias("chunk_id"), F.col("before").alias("_same"))
    taken = R.count_before(scored, rest, ["query_id"], by_place).select("query_id", F.col("mark.chunk_id").alias("chunk_id"), F.col("before").alias("_taken"))
    rest = rest.join(same, ["ordinal", "chunk_id"]).join(F.broadcast(smaller.select("ordinal", F.coalesce("_smaller", F.lit(0)).alias("_smaller"))), "ordinal").join(taken, ["query_id", "chunk_id"]).join(total.select("query_id", "scored"), "query_id")
    rest = rest.select("query_id", "chunk_id", "bm25", (F.col("scored") + 1 + F.col("_smaller") + F.col("_same") - F.col("_taken")).alias("sparse_rank"))
    sparse = ranked.select("query_id", "chunk_id", "bm25", "sparse_rank").unionByName(rest).join(dense.select("query_id", "chunk_id", "dense_rank", F.col("score").alias("dense")), ["query_id", "chunk_id"], "left")
    if options.fusion == "rrf":
        score = F.coalesce(1.0 / (options.rrf_k + F.col("dense_rank")), F.lit(0.0)) + 1.0 / (options.rrf_k + F.col("sparse_rank"))
        return sparse.select("query_id", "chunk_id", score.alias("score"), "dense_rank", "sparse_rank")
    lo, hi = F.when(F.col("scored") < n, 0.0).otherwise(F.col("lo")), F.coalesce("hi", F.lit(0.0))
    scaled = F.when(hi - lo < 1e-12, 0.0).otherwise((F.coalesce("bm25", F.lit(0.0)) - lo) / (hi - lo))
    score = options.semantic_weight * F.coalesce("dense", F.lit(0.0)) + options.bm25_weight * scaled
    return sparse.join(total, "query_id").select("query_id", "chunk_id", score.alias("score"), "dense_rank", "sparse_rank")


def retrieve(chunks: DataFrame, queries: DataFrame, options: Options = Options(), k: int | None = None, scope: str = "corpus", reranker=None, **filters) -> DataFrame:
    """query_id, rank, chunk data and score of the best k chunks, with retrieval, fusion and reranked: how they were found.

    ``chunks``: chunk_id, ordinal, text, filename, page_start, page_end, tokens, embedding; ``queries``: query_id, text,
    tokens, embedding. ``scope="corpus"``: BM25 over every chunk, fused with the dense candidates; ``"candidates"``:
    BM25 with the statistics of each query's dense candidates alone. ``filters``: filename, page_from, page_to,
    applied after fusion. ``reranker``: a column function (question, text) whose scores take the place of the others, as a
    model's do; those without one come last."""
    k = k or options.top_k
    fetch = max(k * options.candidate_multiplier, k)
    dense = tables.written(R.dense_top_k(chunks.select("chunk_id", "embedding"), queries, fetch, "chunk_id", rank="dense_rank"), "dense")
    if options.retrieval_mode != "hybrid":
        return _finish(dense.withColumn("sparse_rank", F.lit(0)), chunks, queries, k, fetch, options, filters, scope, reranker)
    if scope != "candidates":
        return _finish(_corpus_fusion(dense, chunks, queries, fetch, options, filters), chunks, queries, k, fetch, options, filters, scope, reranker)
    candidates = dense.select("query_id", "chunk_id").join(chunks.select("chunk_id", "tokens"), "chunk_id")
    sparse = R.bm25_of_candidates(candidates, queries, "chunk_id").join(dense.select("query_id", "chunk_id", "dense_rank"), ["query_id", "chunk_id"])
    sparse = sparse.withColumn("sparse_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("bm25").desc(), "dense_rank")))
    if options.fusion == "rrf":
        fused = R.rrf([dense.withColumnRenamed("dense_rank", "rank"), sparse.withColumnRenamed("sparse_rank", "rank")], "chunk_id", options.rrf_k)
    else:
        fused = R.weighted_fusion(dense, sparse, "chunk_id", options.semantic_weight, options.bm25_weight)
    return _finish(fused.join(sparse.select("query_id", "chunk_id", "dense_rank", "sparse_rank"), ["query_id", "chunk_id"]), chunks, queries, k, fetch, options, filters, scope, reranker)


def build_index(pages: DataFrame, options: Options = Options(), embed=None) -> DataFrame:
    """Chunks with tokens and vectors from cleaned pages."""
    from quillspark.operators.chunking import chunk

    embed = embed or V.hashed_embedding()
    clean = pages.withColumn("text", T.dedupe_lines(T.clean_text(F.col("text"))))
    rows = chunk(clean, options.chunk_strategy, options.chunk_size, options.chunk_overlap, embed)
    return with_tokens(rows).withColumn("embedding", embed(F.col("tokens")))


def refreshed(store: Collections, name: str, pages: DataFrame, options: Options = Options(), embed=None, embedder: str = "hashed") -> DataFrame | None:
    """The index of ``pages`` (files by fingerprint) in a collection that is kept: only files that it does not hold yet,
    chunked and embedded the same way (``embedder`` names how), are worked on. The rows of these files; None if there are none."""
    way = hashlib.sha256(f"{options.chunk_strategy}/{options.chunk_size}/{options.chunk_overlap}/{embedder}".encode()).hexdigest()[:16]
    held = store.read(name)
    new = pages if held is None else pages.join(held.where(F.col("index_way") == way).select("fingerprint").distinct(), "fingerprint", "left_anti")
    if not new.isEmpty():
        rows = build_index(new, options, embed).withColumns({"index_way": F.lit(way), "chunk_id": F.concat_ws("@", "chunk_id", F.lit(way))})
        store.upsert(name, rows, store.generation(name)[1]["next"], stream=f"index-{way}")
    held = store.read(name)
    return None if held is None else held.where(F.col("index_way") == way).join(pages.select("fingerprint").distinct(), "fingerprint", "left_semi")


def rewritten(c: Column, translate=None) -> Column:
    """A question for an Arabic corpus: Arabic or mixed text gives way to its Arabic form, other text is followed by it.
    ``translate`` is a column function; without it the text stays."""
    if translate is None:
        return c
    form = T.strip(planner.arabic_form(c, translate(c)))
    lang = T.detect_language(c)
    return F.when(F.coalesce(form, F.lit("")) == "", c).when(lang.isin("ar", "mixed"), form).when((lang == "en") & (form != c), F.concat_ws(" ", c, form)).otherwise(c)


def prepare_queries(queries: DataFrame, embed=None, translate=None) -> DataFrame:
    """query_id, text, tokens, embedding of raw questions (query_id, text), as a table that retrieval reads several
    times. Blank questions are left out: they find nothing."""
    embed = embed or V.hashed_embedding()
    q = T.settled(queries.select("query_id", "text"), "text", rewritten(F.coalesce("text", F.lit("")), translate))
    q = T.settled(q, "_form", T.normalize_arabic(F.col("text"))).where(T.strip(F.col("_form")) != "").drop("_form")
    return tables.written(with_tokens(q, compat=True).withColumn("embedding", embed(F.col("tokens"))), "questions")
