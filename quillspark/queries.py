"""Registry of the engine's queries and their DuckDB counterparts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.config import Options
from quillspark.functions import constants as C
from quillspark.functions import sql
from quillspark.functions import text as T
from quillspark.functions import vectors as V
from quillspark.operators import chunking, conversations, evaluation
from quillspark.operators import ranking as R
from quillspark.operators.collections import Collections, latest
from quillspark.plans import answers, planner, questions, retrieve, routing
from quillspark.sources import documents as S
from quillspark.streaming import events as E
from quillspark.tables import shared_root, spread, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return T.settled(d, "tokens", T.tokenize(F.col("text"))).drop("text")


def docs_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of ``documents``, made once for all scores of a query."""
    return written(R.text_postings(spread(read(spark, sf_dir, "documents").select("doc_id", "text"))), "postings")


def bench_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.settled(read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), "tokens", T.tokenize(F.col("text"), compat=True))


def pages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as pages of files."""
    p = chunking.split_pages(spread(read(spark, sf_dir, "documents").select("doc_id", "text")))
    return p.select(F.sha2(F.col("doc_id").cast("string"), 256).alias("fingerprint"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), "page_number", "text", F.lit("").alias("html"))


# --- SQL pieces -------------------------------------------------------------------------------------------------
_STOP = ", ".join(f"'{w}'" for w in C.STOPWORDS)
_TOK = rf"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\x{{0600}}-\x{{06FF}}]+'), lambda t: length(t) > 1 AND t NOT IN ({_STOP}))"
_BASE = f"""d AS (SELECT doc_id, {_TOK} AS tokens FROM documents), q AS (SELECT item_id AS query_id, {_TOK} AS tokens FROM benchmark)"""
_TF = "tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(tokens) AS dl, unnest(tokens) AS term FROM d) GROUP BY ALL)"
_BM25 = f"""{_BASE}, {_TF}, s AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM d), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(tokens) AS term FROM q) GROUP BY ALL),
    bm AS (SELECT query_id, doc_id, round(sum(qtf * ln(1 + greatest(0, (n - df + 0.5) / (df + 0.5))) * tf * 2.5 / greatest(tf + 1.5 * (0.25 + 0.75 * greatest(dl, 1) / greatest(avgdl, 1e-9)), 1e-9)), 6) AS bm25
           FROM qt JOIN tf USING (term) JOIN df USING (term), s GROUP BY ALL)"""
_OVER = """qs AS (SELECT query_id, list_distinct(tokens) AS t FROM q), ds AS (SELECT doc_id, list_distinct(tokens) AS t FROM d),
    ov AS (SELECT query_id, doc_id, round(count(*) / sqrt(any_value(nq) * any_value(nd)::DOUBLE), 6) AS overlap FROM (SELECT query_id, len(t) AS nq, unnest(t) AS term FROM qs) a JOIN (SELECT doc_id, len(t) AS nd, unnest(t) AS term FROM ds) b USING (term) GROUP BY ALL)"""


def _top(cte: str, score: str, k: int, out: str, by: str = "doc_id") -> str:
    return f"{out} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, {by}) AS rank FROM {cte}) WHERE rank <= {k})"


# --- Tokens and BM25 --------------------------------------------------------------------------------------------
@query(f"SELECT doc_id, len(tokens)::BIGINT AS n_tokens, array_to_string(tokens, ' ') AS tokens FROM (SELECT doc_id, {_TOK} AS tokens FROM documents)")
def tokenize_terms(spark, sf_dir):
    return docs_tokens(spark, sf_dir).select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


@query(f"WITH {_BASE}, {_TF} SELECT doc_id, term, tf FROM tf")
def term_freq(spark, sf_dir):
    return R.term_frequencies(docs_tokens(spark, sf_dir))


@query(f"WITH {_BASE}, {_TF} SELECT term, count(*) AS df FROM tf GROUP BY 1")
def doc_freq(spark, sf_dir):
    return R.document_frequencies(R.term_frequencies(docs_tokens(spark, sf_dir)))


@query(f"WITH {_BASE} SELECT count(*) AS n, round(avg(len(tokens)), 6) AS avgdl FROM d")
def corpus_stats(spark, sf_dir):
    return R.corpus_stats(docs_tokens(spark, sf_dir)).select("n", F.round("avgdl", 6).alias("avgdl"))


def _bm25(spark, sf_dir, keep=None, d=None):
    return R.bm25(d or docs_postings(spark, sf_dir), bench_queries(spark, sf_dir), keep=keep).withColumn("bm25", F.round("bm25", 6))


@query(f"WITH {_BM25}, {_top('bm', 'bm25', 8, 't')} SELECT query_id, doc_id, bm25, rank::BIGINT AS rank FROM t")
def bm25_topk(spark, sf_dir):
    return R.top_k(_bm25(spark, sf_dir, 8), "bm25", 8, "doc_id").withColumn("rank", F.col("rank").cast("long"))


def _overlap(spark, sf_dir, keep=None, d=None):
    return R.overlap_scores(d or docs_postings(spark, sf_dir), bench_queries(spark, sf_dir), keep=keep).withColumn("overlap", F.round("overlap", 6))


def _sparse_and_overlap(spark, sf_dir):
    """The best 120 by BM25 as a written table, and their overlaps, from one index."""
    d = docs_postings(spark, sf_dir)
    hits = written(R.top_k(_bm25(spark, sf_dir, 120, d), "bm25", 120, "doc_id"), "hits")
    return hits, _overlap(spark, sf_dir, d=d).join(R.small(hits.select("query_id", "doc_id")), ["query_id", "doc_id"], "left_semi")


@query(
    f"""WITH {_BASE}, {_OVER}, {_top('ov', 'overlap', 120, 'c')}, cd AS (SELECT query_id, doc_id, tokens, len(tokens) AS dl FROM c JOIN d USING (doc_id)),
    s AS (SELECT query_id, count(*) AS n, avg(dl) AS avgdl FROM cd GROUP BY 1), tf AS (SELECT query_id, doc_id, dl, term, count(*) AS tf FROM (SELECT query_id, doc_id, dl, unnest(tokens) AS term FROM cd) GROUP BY ALL),
    df AS (SELECT query_id, term, count(*) AS df FROM tf GROUP BY ALL), qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(tokens) AS term FROM q) GROUP BY ALL),
    b AS (SELECT query_id, doc_id, sum(qtf * ln(1 + greatest(0, (n - df + 0.5) / (df + 0.5))) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * greatest(dl, 1) / avgdl))) AS v FROM qt JOIN tf USING (query_id, term) JOIN df USING (query_id, term) JOIN s USING (query_id) GROUP BY ALL)
    SELECT query_id, doc_id, round(coalesce(v, 0), 6) AS bm25 FROM cd LEFT JOIN b USING (query_id, doc_id)"""
)
def bm25_candidates_scope(spark, sf_dir):
    cand = written(R.top_k(_overlap(spark, sf_dir, 120), "overlap", 120, "doc_id").select("query_id", "doc_id"), "candidates")
    d = read(spark, sf_dir, "documents").select("doc_id", "text").join(R.small(cand.select("doc_id").distinct()), "doc_id", "left_semi")
    cand = cand.join(T.settled(d, "tokens", T.tokenize(F.col("text"))).drop("text"), "doc_id")
    return R.bm25_of_candidates(cand, bench_queries(spark, sf_dir)).withColumn("bm25", F.round("bm25", 6))


# --- Fusion -----------------------------------------------------------------------------------------------------
@query(
    f"""WITH {_BM25}, {_OVER}, {_top('bm', 'bm25', 120, 'a')}, {_top('ov', 'overlap', 120, 'b')},
    f AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT query_id, doc_id, rank FROM a UNION ALL SELECT query_id, doc_id, rank FROM b) GROUP BY ALL), {_top('f', 'score', 8, 't')}
    SELECT query_id, doc_id, score, rank::BIGINT AS rank FROM t"""
)
def rrf_fuse_topk(spark, sf_dir):
    """The flagship: BM25 and lexical overlap for every benchmark passage, fused by reciprocal ranks."""
    d = docs_postings(spark, sf_dir)
    a = R.top_k(_bm25(spark, sf_dir, 120, d), "bm25", 120, "doc_id")
    b = R.top_k(_overlap(spark, sf_dir, 120, d), "overlap", 120, "doc_id")
    fused = R.rrf([a, b]).withColumn("score", F.round("score", 9))
    return R.top_k(fused, "score", 8, "doc_id").withColumn("rank", F.col("rank").cast("long"))


@query(
    f"""WITH {_BM25}, {_OVER}, {_top('bm', 'bm25', 120, 'a')}, m AS (SELECT query_id, doc_id, CASE WHEN max(bm25) OVER w - min(bm25) OVER w < 1e-12 THEN 0.0 ELSE (bm25 - min(bm25) OVER w) / (max(bm25) OVER w - min(bm25) OVER w) END AS s FROM a WINDOW w AS (PARTITION BY query_id)),
    f AS (SELECT query_id, doc_id, round(0.7 * coalesce(overlap, 0) + 0.3 * s, 6) AS score FROM m LEFT JOIN ov USING (query_id, doc_id)), {_top('f', 'score', 8, 't')}
    SELECT query_id, doc_id, score, rank::BIGINT AS rank FROM t"""
)
def weighted_fuse_topk(spark, sf_dir):
    sparse, overlap = _sparse_and_overlap(spark, sf_dir)
    f = R.weighted_fusion(overlap.withColumnRenamed("overlap", "score"), sparse).withColumn("score", F.round("score", 6))
    return R.top_k(f, "score", 8, "doc_id").withColumn("rank", F.col("rank").cast("long"))


@query(
    f"""WITH {_BM25} SELECT query_id, doc_id, round(CASE WHEN max(bm25) OVER w - min(bm25) OVER w < 1e-12 THEN 0.0 ELSE (bm25 - min(bm25) OVER w) / (max(bm25) OVER w - min(bm25) OVER w) END, 6) AS scaled FROM bm WINDOW w AS (PARTITION BY query_id)"""
)
def minmax_scores(spark, sf_dir):
    return R.min_max(_bm25(spark, sf_dir), "bm25", "scaled", "query_id").select("query_id", "doc_id", F.round("scaled", 6).alias("scaled"))


@query(
    f"""WITH {_BM25}, {_OVER}, {_top('bm', 'bm25', 120, 'a')}, {_top('a', 'bm25', 40, 'a2')}, f AS (SELECT query_id, doc_id, round(0.3 * bm25 + 0.7 * coalesce(overlap, 0), 6) AS score, a.rank AS prior FROM a LEFT JOIN ov USING (query_id, doc_id)), {_top('f', 'score', 8, 't', 'prior')}
    SELECT query_id, doc_id, score, rank::BIGINT AS rank FROM t""".replace(f"{_top('a', 'bm25', 40, 'a2')}, ", "")
)
def lexical_rerank(spark, sf_dir):
    hits, overlap = _sparse_and_overlap(spark, sf_dir)
    hits = hits.withColumnRenamed("bm25", "score").join(overlap, ["query_id", "doc_id"], "left")
    # Scores are rounded before they are ranked, so equal scores tie in every engine.
    blended = hits.select("query_id", "doc_id", F.col("rank").alias("prior"), F.round(0.3 * F.col("score") + 0.7 * F.coalesce("overlap", F.lit(0.0)), 6).alias("score"))
    return R.top_k(blended, "score", 8, "prior").select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query(
    f"""WITH {_BM25}, {_top('bm', 'bm25', 120, 'a')}, h AS (SELECT a.*, (doc_id % 7)::INT AS page_start, (doc_id % 7 + doc_id % 3)::INT AS page_end, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'file' || (doc_id % 4) END AS filename FROM a)
    SELECT query_id, doc_id, bm25, rank::BIGINT AS rank FROM h WHERE (filename = '' OR filename = 'file1') AND (page_end = 0 OR page_end >= 2) AND (page_start = 0 OR page_start <= 4)"""
)
def metadata_filter(spark, sf_dir):
    a = R.top_k(_bm25(spark, sf_dir, 120), "bm25", 120, "doc_id")
    i = F.col("doc_id")
    h = a.withColumns({"page_start": (i % 7).cast("int"), "page_end": (i % 7 + i % 3).cast("int"), "filename": F.when(i % 5 == 0, "").otherwise(F.concat(F.lit("file"), (i % 4).cast("string")))})
    return R.metadata_filter(h, "file1", 2, 4).select("query_id", "doc_id", "bm25", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_BM25}, {_top('bm', 'bm25', 120, 'a')} SELECT query_id, doc_id, bm25 FROM a WHERE bm25 >= 20")
def min_score_filter(spark, sf_dir):
    return R.min_score(R.top_k(_bm25(spark, sf_dir, 120), "bm25", 120, "doc_id"), 20, "bm25").select("query_id", "doc_id", "bm25")


@query(f"WITH {_BM25}, {_top('bm', 'bm25', 120, 'a')} SELECT query_id, doc_id, rank::BIGINT AS rank FROM a JOIN documents USING (doc_id) WHERE lang = 'en' AND rank <= 120")
def overfetch_then_filter(spark, sf_dir):
    a = R.top_k(_bm25(spark, sf_dir, 120), "bm25", 120, "doc_id")
    return a.join(read(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id"), "doc_id").select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"))


# --- Joins of the retrieval path --------------------------------------------------------------------------------
@query(f"WITH {_BM25}, {_top('bm', 'bm25', 8, 'a')}, b AS (SELECT doc_id, max(bm25) AS best FROM a GROUP BY 1) SELECT doc_id, coalesce(best, 0.0) AS best FROM documents LEFT JOIN b USING (doc_id)")
def left_default_zero(spark, sf_dir):
    best = R.top_k(_bm25(spark, sf_dir, 8), "bm25", 8, "doc_id").groupBy("doc_id").agg(F.max("bm25").alias("best"))
    return read(spark, sf_dir, "documents").select("doc_id").join(best, "doc_id", "left").select("doc_id", F.coalesce("best", F.lit(0.0)).alias("best"))


@query(f"WITH {_BM25}, {_top('bm', 'bm25', 8, 'a')} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM a)")
def anti_unseen(spark, sf_dir):
    seen = R.top_k(_bm25(spark, sf_dir, 8), "bm25", 8, "doc_id").select("doc_id").distinct()
    return read(spark, sf_dir, "documents").select("doc_id").join(seen, "doc_id", "left_anti")


@query("SELECT item_id AS qid FROM benchmark b WHERE EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text))")
def semi_grounded_cases(spark, sf_dir):
    cases = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.array("text").alias("expect_any"))
    return evaluation.grounded(cases, read(spark, sf_dir, "documents")).select("qid")


# --- Vectors ----------------------------------------------------------------------------------------------------
_VQ = "WITH q AS (SELECT vec_id AS query_id, embedding AS q, label AS query_label FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query_id, vec_id, label, query_label, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 6) AS score FROM embeddings, q)"


def _dense(spark, sf_dir, k, metric="cosine", by=None):
    """Every vector whose id is divisible by 20 is a query; all vectors are searched."""
    e = read(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return R.dense_top_k(e, q, k, metric=metric, by=by)


@query(f"{_VQ}, {_top('s', 'score', 8, 't', 'vec_id')} SELECT query_id, vec_id, score, rank::BIGINT AS rank FROM t")
def cosine_topk(spark, sf_dir):
    return _dense(spark, sf_dir, 8).withColumn("rank", F.col("rank").cast("long"))


@query(f"{_VQ.replace('list_cosine_similarity', 'list_inner_product')}, {_top('s', 'score', 8, 't', 'vec_id')} SELECT query_id, vec_id, score FROM t")
def inner_product_topk(spark, sf_dir):
    return _dense(spark, sf_dir, 8, "dot").select("query_id", "vec_id", "score")


@query(f"{_VQ}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, label, vec_id, score FROM t WHERE rank <= 3")
def cosine_topk_per_label(spark, sf_dir):
    return _dense(spark, sf_dir, 3, by="label").select("query_id", "label", "vec_id", "score")


@query("SELECT vec_id, i::INT AS i, round(embedding[i]::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS x FROM embeddings, range(1, 65) r(i)")
def l2_normalize(spark, sf_dir):
    d = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(V.normalized(F.col("embedding"))).alias("i", "x"))
    return d.select("vec_id", (F.col("i") + 1).alias("i"), F.round("x", 6).alias("x"))


@query(f"{_VQ}, {_top('(SELECT * FROM s WHERE vec_id <> query_id)', 'score', 10, 't', 'vec_id')}, v AS (SELECT query_id, label, count(*) AS votes FROM t GROUP BY ALL) SELECT query_id, label, votes FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, label) AS n FROM v) WHERE n = 1")
def knn_label_vote(spark, sf_dir):
    near = R.top_k(_dense(spark, sf_dir, 11).where("vec_id <> query_id").drop("rank"), "score", 10, "vec_id")
    votes = near.join(read(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id").groupBy("query_id", "label").agg(F.count(F.lit(1)).alias("votes"))
    best = F.max_by(F.struct("label", "votes"), F.struct("votes", (-F.col("label")).alias("l")))
    return votes.groupBy("query_id").agg(best.alias("b")).select("query_id", "b.label", "b.votes")


# --- Pages and chunks -------------------------------------------------------------------------------------------
_PAGES = r"p AS (SELECT doc_id, i, regexp_replace(substr(t, (i * 3500 + 1)::INT, 3500), '^\s+|\s+$', '', 'g') AS text FROM (SELECT doc_id, regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '^\s+|\s+$', '', 'g') AS t FROM documents), range(0, 200) r(i) WHERE i * 3500 < length(t)), pg AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i)::INT AS page_number, text FROM p WHERE text <> '')"


@query(f"WITH {_PAGES} SELECT doc_id, page_number, text FROM pg")
def page_split_3500(spark, sf_dir):
    return chunking.split_pages(read(spark, sf_dir, "documents"))


@query(f"WITH {_PAGES} SELECT doc_id, (i + 1)::INT AS page_number, length(text)::BIGINT AS n FROM p WHERE text <> ''")
def page_positional(spark, sf_dir):
    return chunking.split_pages(read(spark, sf_dir, "documents"), renumber=False).select("doc_id", "page_number", F.length("text").cast("long").alias("n"))


@query(f"WITH {_PAGES} SELECT doc_id, string_agg('[Page ' || page_number || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY page_number) AS full_text FROM pg GROUP BY 1")
def full_text_concat(spark, sf_dir):
    return chunking.full_text(chunking.split_pages(read(spark, sf_dir, "documents")), "doc_id")


def _cut(source: str, *keys: str) -> str:
    """The steps of the chunker over ``source`` (keys, t): pieces of the text in w, from step 1 on."""
    k = ", ".join(keys)
    return rf"""
    t0 AS (SELECT {k}, regexp_replace(regexp_replace(t, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM {source}),
    w({k}, t, step, start, piece, stop) AS (
      SELECT {k}, t, 0, 0, '', 0 FROM t0 WHERE t <> ''
      UNION ALL
      SELECT {k}, t, step + 1, CASE WHEN e >= length(t) THEN -1 ELSE greatest(0, e - 200) END, substr(t, start + 1, e - start), e
      FROM (SELECT *, CASE WHEN start + length(x) < length(t) AND brk > 600 THEN start + brk + 1 ELSE start + length(x) END AS e
            FROM (SELECT *, greatest(CASE WHEN contains(x, ' ') THEN length(x) - instr(reverse(x), ' ') ELSE -1 END, CASE WHEN contains(x, chr(10) || chr(10)) THEN length(x) - instr(reverse(x), chr(10) || chr(10)) - 1 ELSE -1 END) AS brk
                  FROM (SELECT *, substr(t, start + 1, 1200) AS x FROM w WHERE start >= 0)))),
    pieces AS (SELECT * FROM (SELECT {k}, step, regexp_replace(piece, '^\s+|\s+$', '', 'g') AS p FROM w WHERE step > 0) WHERE p <> '')"""


@query(f"WITH RECURSIVE {_cut('(SELECT doc_id, text AS t FROM documents)', 'doc_id')} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY step) - 1)::INT AS ordinal, p AS text FROM pieces")
def recursive_chunks(spark, sf_dir):
    return spread(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(chunking.split_text(F.col("text"))).alias("ordinal", "text"))


_MARKED = f"{_PAGES}, mk AS (SELECT doc_id, page_number, '[Page ' || page_number || ']' || chr(10) || text AS m FROM pg)"
_CHUNK = "sha256(doc_id::VARCHAR) AS fingerprint, 'doc-' || doc_id || '.txt' AS filename, substr(sha256(doc_id::VARCHAR), 1, 16) || ':' || page_start || ':' || ordinal || ':' || substr(sha256(p), 1, 8) AS chunk_id, ordinal::INT AS ordinal, page_start, page_end, p AS text"
_PAGE_CHUNKS = f"""{_MARKED}, {_cut("(SELECT doc_id, page_number, m AS t FROM mk WHERE length(m) > 1200)", 'doc_id', 'page_number')},
    every AS (SELECT doc_id, page_number, step, p FROM pieces UNION ALL SELECT doc_id, page_number, 1, m FROM mk WHERE length(m) <= 1200),
    ch AS (SELECT doc_id, page_number AS page_start, page_number AS page_end, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, step) - 1 AS ordinal, p FROM every)"""


@query(f"WITH RECURSIVE {_PAGE_CHUNKS} SELECT {_CHUNK}, 'page_aware' AS strategy FROM ch")
def page_aware_chunks(spark, sf_dir):
    return chunking.page_aware(pages_of(spark, sf_dir))


@query(
    rf"""WITH RECURSIVE {_MARKED}, ft AS (SELECT doc_id, string_agg(m, chr(10) || chr(10) ORDER BY page_number) AS t FROM mk GROUP BY 1), {_cut('ft', 'doc_id')},
    ch AS (SELECT *, coalesce(list_min(f), 0) AS page_start, coalesce(list_max(f), 0) AS page_end FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id ORDER BY step) - 1 AS ordinal, list_transform(regexp_extract_all(p, '\[Page\s+(\d+)\]', 1), lambda x: x::INT) AS f FROM pieces))
    SELECT {_CHUNK}, 'recursive' AS strategy FROM ch"""
)
def document_recursive_chunks(spark, sf_dir):
    return chunking.recursive(pages_of(spark, sf_dir))


@query("SELECT doc_id, substr(sha256(doc_id::VARCHAR), 1, 16) || ':1:' || doc_id || ':' || substr(sha256(text), 1, 8) AS chunk_id, sha256(text) AS fingerprint FROM documents")
def chunk_ids(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", T.chunk_id(F.sha2(F.col("doc_id").cast("string"), 256), F.lit(1), F.col("doc_id"), F.col("text")).alias("chunk_id"), F.sha2("text", 256).alias("fingerprint"))


@query("SELECT doc_id, regexp_replace(u, '^(.{8})(.{4}).(.{3}).(.{3})(.{12}).*$', '\\1-\\2-5\\3-' || lower(substr('89ab', (('0x' || substr(u, 17, 1))::INT & 3) + 1, 1)) || '\\4-\\5') AS point_id FROM (SELECT doc_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || ('doc-' || doc_id)::BLOB) AS u FROM documents)")
def point_ids(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.uuid5(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))).alias("point_id"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[\s\x{0085}\x{00A0}\x{0B}]+', ' ', 'g')) AS plain FROM pages")
def html_strip(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.html_strip(F.col("html")).alias("plain"))


@query(r"SELECT page_id, len(b)::BIGINT AS n_blocks, array_to_string(b, '|') AS blocks FROM (SELECT page_id, regexp_extract_all(html, '(?is)<(?:h[1-6]|p|li|tr|div|table)[^>]*>.*?</(?:h[1-6]|p|li|tr|div|table)>') AS b FROM pages)")
def html_blocks(spark, sf_dir):
    b = T.html_blocks(F.col("html"))
    return read(spark, sf_dir, "pages").select("page_id", F.size(b).cast("long").alias("n_blocks"), F.array_join(b, "|").alias("blocks"))


@query()
def layout_chunks(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select(F.sha2(F.col("page_id").cast("string"), 256).alias("fingerprint"), F.col("url").alias("filename"), F.lit(1).alias("page_number"), F.lit("").alias("text"), "html")
    return chunking.layout_aware(p)


@query(r"SELECT doc_id, unnest(list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?؟۔])\s+', '\1' || chr(1), 'g'), '\n\s*\n', chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')) AS sentence FROM documents")
def sentence_split(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(T.sentences(F.col("text"))).alias("sentence"))


@query()
def semantic_chunks(spark, sf_dir):
    return chunking.semantic(pages_of(spark, sf_dir), V.hashed_embedding())


@query(
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
    m AS (SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS s FROM l), n AS (SELECT *, lag(s) OVER (PARTITION BY doc_id, s = '' ORDER BY i) AS prev FROM m)
    SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM n WHERE s = '' OR prev IS NULL OR prev <> s GROUP BY 1"""
)
def dedupe_lines(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.dedupe_lines(F.col("text")).alias("text"))


# --- Text -------------------------------------------------------------------------------------------------------
_LATIN, _ARABIC = "abcdefghijklmnopqrstuvwxyz", "ابتثجحخدذرزسشصضطظعغفقكلمنه"
_AR = f"translate(lower(text), '{_LATIN}', '{_ARABIC}')"


def _arabic_docs(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.translate(F.lower("text"), _LATIN, _ARABIC).alias("text"))


@query()
def normalize_arabic(spark, sf_dir):
    return _arabic_docs(spark, sf_dir).select("doc_id", T.normalize_arabic(F.col("text"), diacritics=True).alias("text"))


@query(f"SELECT doc_id, trim(regexp_replace(text, '[\\s\\x{{0085}}\\x{{00A0}}\\x{{0B}}]+', ' ', 'g')) AS text FROM documents")
def collapse_whitespace(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.squeeze(F.col("text")).alias("text"))


@query(f"SELECT doc_id, translate(translate(text, '0123456789', '٠١٢٣٤٥٦٧٨٩'), '{C.DIGITS_FROM}', '{C.DIGITS_TO}') AS text FROM documents")
def digits_fold(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.translate(F.translate("text", "0123456789", C.DIGITS_FROM[:10]), C.DIGITS_FROM, C.DIGITS_TO).alias("text"))


_MIX = f"CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN {_AR} ELSE text || ' ' || {_AR} END"


def _mixed_docs(spark, sf_dir):
    """Whole texts in one script, the other, or both."""
    i, text, ar = F.col("doc_id") % 3, F.col("text"), F.translate(F.lower("text"), _LATIN, _ARABIC)
    return read(spark, sf_dir, "documents").select("doc_id", F.when(i == 0, text).when(i == 1, ar).otherwise(F.concat(text, F.lit(" "), ar)).alias("text"))


_COUNTS = rf"c AS (SELECT doc_id, text, len(regexp_extract_all(text, '[\x{{0600}}-\x{{06FF}}]'))::BIGINT AS ar, len(regexp_extract_all(text, '[A-Za-z]'))::BIGINT AS la, len(regexp_extract_all(text, '\p{{L}}'))::BIGINT AS al, length(text) AS n FROM (SELECT doc_id, {_MIX} AS text FROM documents))"


@query(f"WITH {_COUNTS} SELECT doc_id, CASE WHEN trim(text) = '' THEN 'en' WHEN ar >= 3 AND la >= 3 THEN 'mixed' WHEN ar > 0 AND la > 0 THEN CASE WHEN ar >= la THEN 'ar' ELSE 'en' END WHEN ar > 0 THEN 'ar' ELSE 'en' END AS lang FROM c")
def detect_language(spark, sf_dir):
    return _mixed_docs(spark, sf_dir).select("doc_id", T.detect_language(F.col("text")).alias("lang"))


@query(f"WITH {_COUNTS} SELECT doc_id, ar AS arabic, la AS latin, round(CASE WHEN al > 0 THEN ar / al ELSE 0 END, 6) AS ratio FROM c")
def script_ratio(spark, sf_dir):
    a, b = T.script_counts(F.col("text"))
    return _mixed_docs(spark, sf_dir).select("doc_id", a.cast("long").alias("arabic"), b.cast("long").alias("latin"), F.round(T.arabic_ratio(F.col("text")), 6).alias("ratio"))


@query(f"WITH {_COUNTS} SELECT doc_id, CASE WHEN n > 0 AND ar / n > 0.3 THEN 'rtl' ELSE 'ltr' END AS direction FROM c")
def text_direction(spark, sf_dir):
    return _mixed_docs(spark, sf_dir).select("doc_id", T.direction(F.col("text")).alias("direction"))


@query()
def unreliable_extraction(spark, sf_dir):
    return _mixed_docs(spark, sf_dir).select("doc_id", T.unreliable_extraction(F.col("text")).alias("unreliable"))


@query(r"""SELECT page_id, CASE WHEN b = '' THEN 'uploaded.bin' ELSE b END AS name FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_extract(regexp_replace(translate(trim(url), '\', '/'), '/+$', ''), '([^/]*)$', 1), '[\x00-\x1f\x7f<>:"|?*\\/]+', '_', 'g'), '^[ .]+|[ .]+$', '', 'g') AS b FROM pages)""")
def sanitize_filename(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.sanitize_filename(F.col("url")).alias("name"))


@query(r"SELECT page_id, unnest(list_distinct(list_transform(regexp_extract_all(html, 'https?://[^\s)]+'), lambda x: regexp_replace(x, '[.,;]+$', '')))) AS link FROM pages")
def extract_links(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.explode(T.links(F.col("html"))).alias("link"))


_QTEXT = "CASE turn % 4 WHEN 0 THEN 'Please search for ' || text WHEN 1 THEN 'what is ' || text || '?' WHEN 2 THEN text ELSE 'ابحث عن ' || text END"


@query(rf"""SELECT conv_id, turn, CASE WHEN q <> '' THEN q ELSE r END AS q FROM (SELECT conv_id, turn, r, trim(regexp_replace(regexp_replace(regexp_replace(r, '(?i)^(please\s+)?(search the web for|search online for|search for|look up|find|browse)\s*', ''), '^(من فضلك\s+)?(ابحث في الويب عن|ابحث عن|ابحث|تصفح)\s*', ''), '(?i)^(what is|who is|when is|where is)\s+', ''), ' ?؟.') AS q FROM (SELECT conv_id, turn, trim({_QTEXT}, ' ' || chr(10) || chr(9)) AS r FROM conversations))""")
def search_query_strip(spark, sf_dir):
    i = F.col("turn") % 4
    text = F.when(i == 0, F.concat(F.lit("Please search for "), "text")).when(i == 1, F.concat(F.lit("what is "), "text", F.lit("?"))).when(i == 2, F.col("text")).otherwise(F.concat(F.lit("ابحث عن "), "text"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", T.search_query(text).alias("q"))


@query("SELECT doc_id, sha256(CASE WHEN length(text) > 12000 THEN substr(text, 1, 12000) || chr(10) || '… [truncated]' ELSE text END) AS text_sha256 FROM documents")
def truncate_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(T.truncated(F.col("text")), 256).alias("text_sha256"))


@query(r"SELECT doc_id, CASE WHEN length(t) >= 60 AND length(f) >= 24 THEN f END AS fingerprint FROM (SELECT doc_id, t, trim(substr(t, greatest(length(t) // 2 - 24, 0) + 1, 48)) AS f FROM (SELECT doc_id, trim(regexp_replace(text, '[\s\x{0085}\x{00A0}\x{0B}]+', ' ', 'g')) AS t FROM documents))")
def mid_fingerprints(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.mid_fingerprint(F.col("text")).alias("fingerprint"))


_SQL_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?؟۔])\s+', '\1' || chr(1), 'g'), '\n\s*\n', chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"


@query(
    f"""WITH {_COUNTS} SELECT doc_id, CASE WHEN trim(text) = '' THEN 'en' WHEN ar >= 3 AND la >= 3 THEN 'mixed' WHEN ar > 0 AND la > 0 THEN CASE WHEN ar >= la THEN 'ar' ELSE 'en' END WHEN ar > 0 THEN 'ar' ELSE 'en' END AS lang,
    CASE WHEN n > 0 AND ar / n > 0.3 THEN 'rtl' ELSE 'ltr' END AS direction, sha256(trim(regexp_replace(text, '[\\s\\x{{0085}}\\x{{00A0}}\\x{{0B}}]+', ' ', 'g'))) AS squeezed, length(CASE WHEN n > 500 THEN left(text, 500) || chr(10) || '… [truncated]' ELSE text END)::BIGINT AS cut,
    round(ln(1 + greatest(0, (1000 - doc_id % 1000 + 0.5) / (doc_id % 1000 + 0.5))), 6) AS idf, round((1 + doc_id % 9) * 2.5 / (1 + doc_id % 9 + 1.5 * (0.25 + 0.75 * greatest(n, 1) / 900)), 6) AS saturation, round(1 / (60 + doc_id), 9) AS rrf,
    CASE doc_id % 4 WHEN 0 THEN 'Page ?' ELSE CASE WHEN doc_id % 2 = 1 THEN 'Pages ' || doc_id % 4 || '-' || (doc_id % 4 + 1) ELSE 'Page ' || doc_id % 4 END END AS label FROM c"""
)
def sql_scalars(spark, sf_dir):
    """The registered SQL functions, in SQL."""
    sql.register(spark)
    return spark.sql(
        """SELECT doc_id, quill_language(text) AS lang, quill_direction(text) AS direction, sha2(quill_squeeze(text), 256) AS squeezed, CAST(length(quill_truncated(text, 500)) AS BIGINT) AS cut, round(quill_idf(1000, doc_id % 1000), 6) AS idf,
        round(quill_saturation(1 + doc_id % 9, length(text), 900), 6) AS saturation, round(quill_rrf(doc_id), 9) AS rrf, quill_page_label(CAST(doc_id % 4 AS INT), CAST(doc_id % 4 + doc_id % 2 AS INT)) AS label FROM {docs}""",
        docs=_mixed_docs(spark, sf_dir),
    )


@query(f"SELECT doc_id, s.pos::INT AS pos, sentence FROM (SELECT doc_id, unnest(l) AS sentence, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, {_SQL_SENTENCES} AS l FROM documents)) s")
def sql_sentences(spark, sf_dir):
    sql.register(spark)
    return spark.sql("SELECT doc_id, pos, sentence FROM {docs}, LATERAL quill_sentences(text)", docs=read(spark, sf_dir, "documents").select("doc_id", "text"))


# --- Turns ------------------------------------------------------------------------------------------------------
def _any(col: str, markers) -> str:
    return "(" + " OR ".join(f"contains({col}, '{m}')" for m in markers) + ")"


_TURNS = f"""w AS (SELECT conv_id, turn, role, raw, lower(raw) AS low, len(list_filter(string_split_regex(raw, '\\s+'), lambda x: x <> ''))::BIGINT AS n FROM (SELECT conv_id, turn, role, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS raw FROM conversations)),
    s AS (SELECT *, raw = '' OR ({_any('low', C.SMALL_TALK)} AND n <= 8) AS chat, {_any('low', C.SUMMARY_EN)} OR {_any('raw', C.SUMMARY_AR)} AS wants_summary, contains(raw, '?') OR contains(raw, '؟') AS asks FROM w),
    i AS (SELECT *, NOT chat AND (asks OR {' OR '.join(f"starts_with(low, '{m}')" for m in C.QUESTION_STARTS)} OR n >= 4) AS knowledge,
      NOT chat AND ({_any('low', C.WEB_DIRECT)} OR (({_any('low', C.PROFILE_EN)} OR {_any('raw', C.PROFILE_AR)}) AND ({_any('low', C.ASK_EN)} OR {_any('raw', C.ASK_AR)} OR asks)) OR regexp_matches(raw, '(?i)\\b[a-z0-9-]+\\.[a-z]{{2,}}\\b')) AS web FROM s)"""


@query(f"WITH {_TURNS} SELECT conv_id, turn, chat AS small_talk, wants_summary, knowledge AS wants_knowledge FROM i")
def turn_intents(spark, sf_dir):
    t = F.col("text")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", routing.small_talk(t).alias("small_talk"), routing.wants_summary(t).alias("wants_summary"), routing.wants_knowledge(t).alias("wants_knowledge"))


@query(
    f"""WITH {_TURNS}, f AS (SELECT *, conv_id % 3 = 0 AS doc, conv_id % 5 <> 0 AS kb, conv_id % 7 = 0 AS uw, conv_id % 11 = 0 AS uk FROM i)
    SELECT conv_id, turn, CASE WHEN role <> 'user' AND NOT doc THEN 'call_model' WHEN uw OR (doc AND web) THEN 'web_search' WHEN doc AND (wants_summary OR raw = '') THEN 'summarize_document' WHEN doc THEN 'query_documents'
    WHEN uk THEN CASE WHEN kb THEN 'query_knowledge_base' ELSE 'call_model' END WHEN web THEN 'web_search' WHEN kb AND knowledge THEN 'query_knowledge_base' ELSE 'call_model' END AS route FROM f"""
)
def route_turns(spark, sf_dir):
    i = F.col("conv_id")
    r = routing.route(F.col("text"), has_document=i % 3 == 0, fresh=F.col("role") == "user", knowledge=i % 5 != 0, use_web=i % 7 == 0, use_knowledge=i % 11 == 0)
    return spread(read(spark, sf_dir, "conversations")).select("conv_id", "turn", r.alias("route"))


@query("SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY 1")
def last_user_turn(spark, sf_dir):
    return conversations.last_user_turns(read(spark, sf_dir, "conversations"))


@query("SELECT conv_id, arg_max(text, turn) FILTER (role = 'assistant' AND turn > u) AS answer FROM (SELECT *, max(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS u FROM conversations) WHERE u IS NOT NULL GROUP BY 1")
def answer_after_last_user(spark, sf_dir):
    return conversations.answers_after_last_user(read(spark, sf_dir, "conversations"))


@query("SELECT conv_id, turn, role, CASE WHEN role = 'assistant' AND length(text) > 1200 THEN substr(text, 1, 1200) || '…' ELSE text END AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE trim(text) <> '') WHERE n <= 8")
def session_memory_8(spark, sf_dir):
    return conversations.session_memory(read(spark, sf_dir, "conversations"))


# --- Planning ---------------------------------------------------------------------------------------------------
@query()
def query_plans(spark, sf_dir):
    p = planner.plan(F.col("text"))
    return read(spark, sf_dir, "benchmark").select("item_id", p.alias("p")).select("item_id", "p.needs_database", "p.search_query", F.array_join("p.keywords", ",").alias("keywords"), "p.boost_applied")


_GEN = ", ".join(f"'{w}'" for w in C.GENERIC_WORDS)


@query(f"SELECT conv_id, turn, n > 0 AND (n <= 6 OR g >= greatest(2, n // 2)) AS boost FROM (SELECT conv_id, turn, len(w)::BIGINT AS n, len(list_filter(w, lambda x: lower(trim(x, '?.!,،؟')) IN ({_GEN})))::BIGINT AS g FROM (SELECT conv_id, turn, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM conversations))")
def needs_boost(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", planner.needs_boost(F.col("text")).alias("boost"))


@query("SELECT item_id, 'x' || item_id || ' scheherazade and shahryar and dunyazad' AS corrected FROM benchmark")
def spelling_fix(spark, sf_dir):
    text = F.concat(F.lit("x"), F.col("item_id").cast("string"), F.lit(" Scheherazd and shahriyar and DUNYAZADE"))
    return read(spark, sf_dir, "benchmark").select("item_id", planner.fix_spelling(text)["text"].alias("corrected"))


# --- Answers ----------------------------------------------------------------------------------------------------
_JUDGED = "SELECT event_id, user_id, ts, (1 + event_id % 5)::INT AS i, event_type IN ('click', 'view') AS good, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events"


@query(f"SELECT user_id, unnest(list_sort(list_distinct(list(i)))) AS idx FROM ({_JUDGED}) WHERE n <= 9 AND good AND i <= 4 GROUP BY 1")
def trust_parse(spark, sf_dir):
    """Replies about the first events of a user, as a model may write them: an object, one in a fence, or sections."""
    e = read(spark, sf_dir, "events").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).where("n <= 9")
    i, good = (1 + F.col("event_id") % 5).cast("string"), F.col("event_type").isin("click", "view")
    entry = F.concat(F.lit('{"index": "'), i, F.lit('", "verdict": "'), F.when(good, "relevant").otherwise("NOT_RELEVANT"), F.lit('"}'))
    section = F.concat(F.lit("### ["), i, F.lit("] a page\nWhy: said so.\nVerdict: "), F.when(good, "RELEVANT").otherwise("NOT_RELEVANT"))
    r = e.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(entry)), ", ").alias("entries"), F.array_join(F.array_sort(F.collect_list(section)), "\n\n").alias("sections"))
    body = F.concat(F.lit('{"sources": ['), "entries", F.lit(", 7]}"))
    reply = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("Here it is: "), body)).when(F.col("user_id") % 3 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.col("sections"))
    return T.settled(r, "reply", reply).select("user_id", F.explode(answers.relevant_indexes(F.col("reply"), F.lit(4))).alias("idx"))


def _hits(spark, sf_dir):
    """The top 8 documents of every query, with their whole texts."""
    top = R.top_k(_bm25(spark, sf_dir, 8), "bm25", 8, "doc_id").withColumnRenamed("bm25", "score")
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    i = F.col("doc_id")
    return top.join(d, "doc_id").withColumns({"filename": F.concat(F.lit("doc-"), i.cast("string")), "page_start": (i % 4).cast("int"), "page_end": (i % 4 + i % 2).cast("int")})


def _label(one, many, none):
    return f"CASE WHEN ps <> 0 AND pe <> 0 AND ps <> pe THEN '{many} ' || ps || '-' || pe WHEN ps <> 0 THEN '{one} ' || ps ELSE '{none}' END"


_HITS = f"{_BM25}, {_top('bm', 'bm25', 8, 't')}, h AS (SELECT query_id, t.rank, doc_id % 4 AS ps, doc_id % 4 + doc_id % 2 AS pe, 'doc-' || doc_id AS f, text, bm25 FROM t JOIN documents USING (doc_id))"


@query(f"WITH {_HITS} SELECT query_id, string_agg('[' || rank || '] ' || f || ' · ' || {_label('Page', 'Pages', 'Page ?')} || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM h GROUP BY 1")
def format_context(spark, sf_dir):
    d = answers.format_context(_hits(spark, sf_dir))
    return d.select("query_id", F.regexp_replace("context", r" · score=[0-9.]+", "").alias("context"))


@query(f"WITH {_HITS} SELECT query_id, 'Sources (top ' || count(*) || ' retrieved — model read each before answering):' || chr(10) || string_agg('- [' || rank || '] ' || f || ' (' || {_label('page', 'pages', 'page n/a')} || ', ' || CASE WHEN rank <= 3 THEN 'USED' ELSE 'reviewed' END || ')', chr(10) ORDER BY rank) AS sources FROM h GROUP BY 1")
def format_sources(spark, sf_dir):
    d = answers.format_sources(_hits(spark, sf_dir).withColumn("used", F.col("rank") <= 3), "used")
    return d.select("query_id", F.regexp_replace("sources", r"score=[0-9.]+, ", "").alias("sources"))


_RTOK = r"list_distinct(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_\x{{0600}}-\x{{06FF}}]+'))"
_ANSWERED = f"""{_HITS}, a AS (SELECT query_id, h.rank, h.text, {_RTOK.format('b.text')} AS q, {_RTOK.format('h.text')} AS p, b.text AS question FROM h JOIN benchmark b ON item_id = query_id),
    o AS (SELECT *, len(list_intersect(q, p)) / sqrt(len(q)::DOUBLE * len(p)) >= 0.1 AS used FROM a),
    se AS (SELECT query_id, rank, len(list_intersect(q, {_RTOK.format('s')})) AS n, s FROM (SELECT query_id, rank, q, unnest(list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?؟۔])\\s+', '\\1' || chr(1), 'g'), '\\n\\s*\\n', chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')) AS s FROM o WHERE used)),
    be AS (SELECT query_id, string_agg(s || ' [' || rank || ']', chr(10) ORDER BY rank) AS body FROM (SELECT *, row_number() OVER (PARTITION BY query_id, rank ORDER BY n DESC, s) AS i FROM se) WHERE i = 1 GROUP BY 1)"""


@query(f"WITH {_ANSWERED} SELECT query_id, any_value(coalesce(body, '{C.INSUFFICIENT['en']}')) AS answer FROM o LEFT JOIN be USING (query_id) GROUP BY 1")
def offline_answers(spark, sf_dir):
    hits = _hits(spark, sf_dir).join(read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question")), "query_id")
    return answers.offline_answers(answers.offline_trust(hits))


@query()
def hybrid_retrieve(spark, sf_dir):
    """The whole path: chunks of all documents, hashed vectors, BM25, fusion and rerank for every benchmark passage."""
    index = written(retrieve.build_index(pages_of(spark, sf_dir)), "index")  # retrieval reads it several times
    q = retrieve.prepare_queries(read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"))
    return retrieve.retrieve(index, q, Options(), scope="candidates").select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"), "page_start", "page_end", "filename")


_PLACES = "aeinrstu"
_SHAPE = f"[{', '.join(f"length(lower(text)) - length(replace(lower(text), '{c}', ''))" for c in _PLACES)}]"


def _shaped(spark, sf_dir, table, key):
    """Texts with a vector of letter counts, which any engine can make."""
    low = F.lower("text")
    v = F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))).cast("double") for c in _PLACES])
    return T.settled(spread(read(spark, sf_dir, table)).select(F.col(key).alias("id"), "text", v.alias("embedding")), "tokens", T.tokenize(F.col("text"), compat=table == "benchmark"))


def _corpus_hits(spark, sf_dir, options, **filters):
    i = F.col("id")
    chunks = _shaped(spark, sf_dir, "documents", "doc_id").select(i.cast("string").alias("chunk_id"), (i % 5).cast("int").alias("ordinal"), "text", F.concat(F.lit("file"), (i % 4).cast("string")).alias("filename"), (i % 7).cast("int").alias("page_start"), (i % 7).cast("int").alias("page_end"), "tokens", "embedding")
    chunks = written(chunks, "chunks")  # retrieval reads them several times
    q = written(_shaped(spark, sf_dir, "benchmark", "item_id").withColumnRenamed("id", "query_id"), "questions")
    hits = retrieve.retrieve(chunks, q, options, **filters)
    return hits.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"), "retrieval", "fusion")


_RANKED = f"""{_BM25},
    e AS (SELECT doc_id, {_SHAPE}::DOUBLE[] AS v FROM documents), qe AS (SELECT item_id AS query_id, {_SHAPE}::DOUBLE[] AS w FROM benchmark),
    dn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, doc_id::VARCHAR) AS dr FROM (SELECT query_id, doc_id, round(CASE WHEN list_inner_product(v, v) > 0 AND list_inner_product(w, w) > 0 THEN list_inner_product(v, w) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(w, w))) ELSE 0 END, 6) AS dense FROM e, qe) QUALIFY dr <= 120),
    al AS (SELECT query_id, doc_id, coalesce(bm25, 0) AS bm25, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(bm25, 0) DESC, doc_id % 5, doc_id::VARCHAR) AS sr, min(coalesce(bm25, 0)) OVER (PARTITION BY query_id) AS lo, max(coalesce(bm25, 0)) OVER (PARTITION BY query_id) AS hi FROM (SELECT query_id, doc_id FROM qe, documents) LEFT JOIN bm USING (query_id, doc_id)),
    fu AS (SELECT query_id, doc_id, dr, sr, coalesce(1.0 / (60 + dr), 0) + 1.0 / (60 + sr) AS rrf, 0.7 * coalesce(dense, 0) + 0.3 * CASE WHEN hi - lo < 1e-12 THEN 0 ELSE (bm25 - lo) / (hi - lo) END AS mix FROM al LEFT JOIN dn USING (query_id, doc_id))"""


@query(f"WITH {_RANKED} SELECT query_id, doc_id::VARCHAR AS chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, dr NULLS LAST, sr) AS rank, round(rrf, 6) AS score, 'hybrid-corpus' AS retrieval, 'rrf' AS fusion FROM fu QUALIFY rank <= 8")
def retrieve_corpus(spark, sf_dir):
    """Hybrid retrieval over every document: each one has its place in both lists, though few are ranked."""
    return _corpus_hits(spark, sf_dir, Options(enable_rerank=False))


@query(f"WITH {_RANKED}, f AS (SELECT * FROM fu WHERE doc_id % 4 = 1 AND (doc_id % 7 = 0 OR doc_id % 7 >= 2)) SELECT query_id, doc_id::VARCHAR AS chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, dr NULLS LAST, sr) AS rank, round(rrf, 6) AS score, 'hybrid-corpus' AS retrieval, 'rrf' AS fusion FROM f QUALIFY rank <= 8")
def retrieve_corpus_filtered(spark, sf_dir):
    return _corpus_hits(spark, sf_dir, Options(enable_rerank=False), filename="file1", page_from=2)


@query(f"WITH {_RANKED} SELECT query_id, doc_id::VARCHAR AS chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(mix, 9) DESC, dr NULLS LAST, sr) AS rank, round(mix, 6) AS score, 'hybrid-corpus' AS retrieval, 'weighted' AS fusion FROM fu QUALIFY rank <= 8")
def retrieve_corpus_weighted(spark, sf_dir):
    return _corpus_hits(spark, sf_dir, Options(enable_rerank=False, fusion="weighted"))


@query(f"WITH {_ANSWERED} SELECT query_id, string_agg(CASE WHEN used THEN rank::VARCHAR END, ',' ORDER BY rank) AS used, any_value(coalesce(body, '{C.INSUFFICIENT['en']}')) AS body FROM o LEFT JOIN be USING (query_id) GROUP BY 1")
def question_answers(spark, sf_dir):
    """Every benchmark passage as a question: its hits are judged, the best sentence of each used one is cited."""
    q = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    d = questions.answered(_hits(spark, sf_dir), q).where(F.size("used") >= 0)
    return d.select("query_id", F.when(F.size("used") > 0, F.array_join("used", ",")).alias("used"), F.substring_index("answer", "\n\n---\nSource analysis", 1).alias("body"))


# --- Evaluation -------------------------------------------------------------------------------------------------
@query("SELECT coalesce(lang, 'overall') AS theme, count(*) FILTER (quality = 1) AS passed, count(*) AS total, round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END), 6) AS score, avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END) >= 0.9 AS ok FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (lang)")
def eval_by_theme(spark, sf_dir):
    d = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").select("lang", (F.col("quality") == 1).alias("passed"))
    return evaluation.report(d, "lang").select(F.coalesce("lang", F.lit("overall")).alias("theme"), "passed", "total", F.round("score", 6).alias("score"), "ok")


@query(f"WITH {_HITS}, b AS (SELECT query_id, string_agg(text, chr(10)) AS blob FROM h GROUP BY 1) SELECT item_id, contains(blob, text) AS passed FROM benchmark JOIN b ON item_id = query_id")
def eval_passes(spark, sf_dir):
    blob = _hits(spark, sf_dir).groupBy("query_id").agg(F.array_join(F.collect_list("text"), "\n").alias("blob"))
    b = read(spark, sf_dir, "benchmark").select("item_id", F.array("text").alias("expect"))
    return b.join(blob, F.col("item_id") == F.col("query_id")).select("item_id", evaluation.passes(F.col("blob"), F.col("expect")).alias("passed"))


_FP = r"fp AS (SELECT doc_id, CASE WHEN length(t) >= 60 AND length(f) >= 24 THEN f END AS fp FROM (SELECT doc_id, t, trim(substr(t, greatest(length(t) // 2 - 24, 0) + 1, 48)) AS f FROM (SELECT doc_id, trim(regexp_replace(text, '[\s\x{0085}\x{00A0}\x{0B}]+', ' ', 'g')) AS t FROM documents)))"
_CASES = f"""{_FP}, g AS (SELECT doc_id * 10 + i AS qid, kind, CASE i WHEN 0 THEN fp WHEN 1 THEN array_to_string(list_reverse(string_split(fp, ' ')), ' ') WHEN 2 THEN 'please find ' || fp ELSE left(fp, 24) END AS text, fp AS expect FROM fp, (VALUES (0, 'phrase'), (1, 'reversed'), (2, 'noisy'), (3, 'half')) k(i, kind) WHERE fp IS NOT NULL),
    cs AS (SELECT qid, kind, text, expect FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY md5('7:' || qid), qid) AS n FROM g) WHERE n <= 25 UNION ALL SELECT -1 - item_id, 'fixed', text, trim(regexp_replace(text, '[\\s\\x{{0085}}\\x{{00A0}}\\x{{0B}}]+', ' ', 'g')) FROM benchmark)"""
_CASE_BM25 = _BM25.replace("SELECT item_id AS query_id", "SELECT qid AS query_id").replace("FROM benchmark)", "FROM cs)")


@query(
    f"""WITH {_CASES}, {_CASE_BM25}, {_top('bm', 'bm25', 8, 't')}, b AS (SELECT query_id AS qid, string_agg(trim(regexp_replace(text, '[\\s\\x{{0085}}\\x{{00A0}}\\x{{0B}}]+', ' ', 'g')), chr(10) ORDER BY rank) AS blob FROM t JOIN documents USING (doc_id) GROUP BY 1),
    r AS (SELECT kind, coalesce(contains(blob, expect), false) AS passed FROM cs LEFT JOIN b USING (qid))
    SELECT coalesce(kind, 'overall') AS kind, count(*) FILTER (passed) AS passed, count(*) AS total, round(avg(passed::INT), 6) AS score, avg(passed::INT) >= 0.9 AS ok FROM r GROUP BY ROLLUP (kind)"""
)
def eval_retrieval(spark, sf_dir):
    """Cases made from all documents, 25 of each kind, and the fixed ones: retrieved by BM25 over all documents, scored by kind."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    fixed = read(spark, sf_dir, "benchmark").select((-1 - F.col("item_id")).alias("qid"), F.lit("fixed").alias("kind"), "text", F.array("text").alias("expect_any"))
    cases = written(evaluation.stratified(evaluation.passage_cases(docs), "kind", 25).unionByName(fixed), "cases")

    def hits(q):
        d = T.settled(q, "tokens", T.tokenize(F.col("text"), compat=True))
        return R.top_k(R.bm25(docs_postings(spark, sf_dir), d, keep=8).withColumn("bm25", F.round("bm25", 6)), "bm25", 8, "doc_id").join(docs, "doc_id")

    return evaluation.retrieval_report(cases, hits).select(F.coalesce("kind", F.lit("overall")).alias("kind"), "passed", "total", F.round("score", 6).alias("score"), "ok")


_CHUNK_TOKENS = _TOK.replace("coalesce(text, '')", "p")
_CHUNK_FP = r"(SELECT CASE WHEN length(t) >= 60 AND length(f) >= 24 THEN f END FROM (SELECT t, trim(substr(t, greatest(length(t) // 2 - 24, 0) + 1, 48)) AS f FROM (SELECT trim(regexp_replace(p, '[\s\x{0085}\x{00A0}\x{0B}]+', ' ', 'g')) AS t)))"


@query(
    f"""WITH RECURSIVE {_PAGE_CHUNKS}, c AS (SELECT {_CHUNK}, list_filter({_CHUNK_TOKENS}, lambda x: length(x) >= 4) AS long, {_CHUNK_FP} AS fingerprint_ FROM ch),
    u AS (SELECT chunk_id, page_start, fingerprint_ AS fp, list_slice(list_filter(long, lambda x, i: list_position(long, x) = i), 1, 3) AS t FROM c),
    k AS (SELECT chunk_id, page_start AS page_hint, fp AS fingerprint, array_to_string(t, ',') AS expect_any, kind AS challenge, CASE kind WHEN 'keyword' THEN t[1] WHEN 'keywords' THEN array_to_string(t, ' ') WHEN 'question' THEN 'what is said about ' || t[2] || '?' WHEN 'reversed' THEN array_to_string(list_reverse(t), ' ') WHEN 'phrase' THEN left(fp, 30) ELSE 'please find ' || t[3] END AS query
          FROM u, (VALUES ('keyword'), ('keywords'), ('question'), ('reversed'), ('phrase'), ('noisy')) n(kind) WHERE len(t) = 3 AND fp IS NOT NULL)
    SELECT * FROM k ORDER BY md5('7:' || chunk_id || ':' || challenge), chunk_id, challenge LIMIT 100"""
)
def challenge_cases(spark, sf_dir):
    return evaluation.challenge_cases(chunking.page_aware(pages_of(spark, sf_dir))).withColumn("expect_any", F.array_join("expect_any", ","))


# --- Collections and events -------------------------------------------------------------------------------------
@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1")
def upsert_latest(spark, sf_dir):
    return latest(read(spark, sf_dir, "events"), "user_id", "event_id").select("user_id", "event_type", "event_id")


@query("SELECT count(DISTINCT user_id) AS n FROM events")
def collection_count(spark, sf_dir):
    return latest(read(spark, sf_dir, "events"), "user_id", "event_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id::VARCHAR AS chunk_id, sha256(CASE WHEN doc_id % 3 = 0 THEN 'new: ' ELSE '' END || text) AS text_sha256 FROM documents WHERE length(text) >= 120")
def copy_to_knowledge(spark, sf_dir):
    """Documents go to a shared collection in two batches; a third of them once more with another text, after compaction."""
    d = read(spark, sf_dir, "documents").where(F.length("text") >= 120)
    chunks = d.select("doc_id", F.col("doc_id").cast("string").alias("chunk_id"), "text")
    store = Collections(spark, f"{shared_root(spark)}/collections-{uuid.uuid4().hex}")
    store.copy(chunks.where("doc_id % 2 = 0"), "knowledge", 0)
    store.copy(chunks.where("doc_id % 2 = 1"), "knowledge", 1)
    store.compact("knowledge")
    store.copy(chunks.where("doc_id % 3 = 0").withColumn("text", F.concat(F.lit("new: "), "text")), "knowledge", 2)
    return store.scan("knowledge", 120).select("chunk_id", F.sha2("text", 256).alias("text_sha256"))


def _run_events(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("run_id"), E.node_name(F.concat(F.lit("graph:"), "event_type", F.lit("|x"))).alias("node"), F.when(F.col("event_id") % 2 == 0, "start").otherwise("end").alias("phase"), "ts")


@query("SELECT user_id::VARCHAR AS run_id, event_type AS node, min(ts) FILTER (event_id % 2 = 0) AS started_at, max(ts) FILTER (event_id % 2 <> 0) AS completed_at, CASE WHEN count(*) FILTER (event_id % 2 <> 0) > 0 THEN 'completed' ELSE 'running' END AS status FROM events GROUP BY ALL")
def run_state(spark, sf_dir):
    return E.step_state(_run_events(spark, sf_dir))


@query("SELECT run_id, CASE WHEN b > 0 THEN least(p, 99) ELSE least(p, 100) END::INT AS percent FROM (SELECT run_id, b, round(100 * (c + CASE WHEN b > 0 THEN 0.5 ELSE 0 END) / 5) AS p FROM (SELECT run_id, count(*) FILTER (done) AS c, count(*) FILTER (NOT done) AS b FROM (SELECT user_id::VARCHAR AS run_id, event_type, count(*) FILTER (event_id % 2 <> 0) > 0 AS done FROM events GROUP BY ALL) GROUP BY 1))")
def run_progress(spark, sf_dir):
    return E.progress(E.step_state(_run_events(spark, sf_dir)), 5)


@query("SELECT DISTINCT user_id::VARCHAR AS run_id, event_type AS node, CASE WHEN event_id % 2 = 0 THEN 'start' ELSE 'end' END AS phase FROM events")
def dedupe_events(spark, sf_dir):
    return E.unique_events(_run_events(spark, sf_dir), ["run_id", "node", "phase"]).select("run_id", "node", "phase")


# --- Sources ----------------------------------------------------------------------------------------------------
@query("SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'the payload is not valid base64' WHEN doc_id % 10 = 1 THEN 'no document was given' END AS error, CASE WHEN doc_id % 10 > 1 THEN strlen(text)::BIGINT END AS n FROM documents")
def decode_payloads(spark, sf_dir):
    i = F.col("doc_id") % 10
    payload = F.when(i == 0, "***").when(i == 1, "").otherwise(F.base64(F.encode("text", "UTF-8")))
    return read(spark, sf_dir, "documents").select("doc_id", S.decode_payload(payload).alias("p")).select("doc_id", "p.error", F.octet_length("p.content").cast("long").alias("n"))


_HEADS = ["25504446", "89504E47", "FFD8FFE0", "424D0000", "49492A00", "4D4D002A", "474946383961", "524946460000000057454250", "504B0304", "00"]
_KINDS = ["application/pdf", "image/png", "image/jpeg", "image/bmp", "image/tiff", "image/tiff", "image/gif", "image/webp", "application/octet-stream", "application/octet-stream"]


@query("SELECT doc_id, CASE WHEN doc_id % 20 >= 10 THEN 'text/plain' ELSE [" + ", ".join(f"'{k}'" for k in _KINDS) + "][doc_id % 10 + 1] END AS mime FROM documents")
def mime_types(spark, sf_dir):
    head = F.element_at(F.array(*[F.unhex(F.lit(h)) for h in _HEADS]), (F.col("doc_id") % 10 + 1).cast("int"))
    name = F.when(F.col("doc_id") % 20 >= 10, "a.TXT").otherwise("blob")
    return read(spark, sf_dir, "documents").select("doc_id", S.mime(name, head).alias("mime"))


@query("SELECT doc_id, unnest([1, 2])::INT AS page_number, unnest(['Document ' || doc_id, trim(regexp_replace(text, '[^ -~]+', ' ', 'g'))]) AS text FROM documents")
def pdf_files(spark, sf_dir):
    """Documents as PDF files of two pages: a title, and the text's ASCII characters."""
    ascii_ = F.regexp_replace(F.regexp_replace("text", "[^ -~]+", " "), r"([\\()])", r"\\$1")
    name = F.col("doc_id").cast("string")
    page = lambda number, shown: F.concat(F.lit(f"{number} 0 obj << >>\nstream\nBT /F1 12 Tf 72 700 Td ("), shown, F.lit(f") Tj ET\nendstream endobj\n{number + 1} 0 obj << /Type /Page /Contents {number} 0 R >> endobj\n"))
    body = F.concat(F.lit("%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Count 2 /Kids [4 0 R 6 0 R] >> endobj\n"), page(3, F.concat(F.lit("Document "), name)), page(5, ascii_), F.lit("trailer << /Root 1 0 R >>"))
    d = S.load(spread(read(spark, sf_dir, "documents")).select(F.concat(name, F.lit(".pdf")).alias("filename"), F.encode(body, "UTF-8").alias("content")))
    return d.where("load_error is null").select(F.split_part("filename", F.lit("."), F.lit(1)).cast("long").alias("doc_id"), "page_number", "text")


@query("SELECT doc_id, ['PNG', 'JPEG', 'GIF', 'BMP', 'TIFF', 'WEBP'][doc_id % 6 + 1] AS kind, 1 + n_chars % 4000 AS width, 1 + doc_id % 3000 AS height, ['RGBA', 'RGB', 'P', 'RGB', 'CMYK', 'RGB'][doc_id % 6 + 1] AS mode FROM documents")
def image_headers(spark, sf_dir):
    """Image files whose sizes come from the documents: a header, then the document's text as its data."""
    w, h = 1 + F.col("n_chars") % 4000, 1 + F.col("doc_id") % 3000
    big = lambda c, n: F.lpad(F.hex(c), 2 * n, "0")
    little = lambda c, n: F.concat(*[F.substring(big(c, n), 2 * i + 1, 2) for i in reversed(range(n))])
    entry = lambda tag, c: F.concat(F.lit(tag + "000400000001"), big(c, 4))
    heads = [
        F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big(w, 4), big(h, 4), F.lit("0806000000")),
        F.concat(F.lit("FFD8FFE000104A46494600010100000100010000FFDB0005112233FFFFC2001108"), big(h, 2), big(w, 2), F.lit("03012200")),
        F.concat(F.lit("474946383961"), little(w, 2), little(h, 2), F.lit("F70000")),
        F.concat(F.lit("424D00000000000000003600000028000000"), little(w, 4), little(h, 4), F.lit("01001800")),
        F.concat(F.lit("4D4D002A000000080003"), entry("0100", w), entry("0101", h), F.lit("01060003000000010005000000000000")),
        F.concat(F.lit("52494646000000005745425056503820000000000000009D012A"), little(w, 2), little(h, 2)),
    ]
    content = F.concat(F.unhex(F.element_at(F.array(*heads), (F.col("doc_id") % 6 + 1).cast("int"))), F.encode("text", "UTF-8"))
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("filename"), content.alias("content"))
    return S.images(d).select(F.col("filename").cast("long").alias("doc_id"), "kind", "width", "height", "mode")


@query(f"WITH {_BM25}, {_top('bm', 'bm25', 5, 't')} SELECT query_id, string_agg(rank || '. doc-' || doc_id || chr(10) || text || chr(10) || 'https://example.org/' || doc_id, chr(10) || chr(10) ORDER BY rank) AS text FROM t JOIN documents USING (doc_id) GROUP BY 1")
def search_results(spark, sf_dir):
    """Stored results (the best documents of every passage) as a search source, put into text."""
    top = R.top_k(_bm25(spark, sf_dir, 8), "bm25", 8, "doc_id").join(read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("snippet")), "doc_id")
    q = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    name = F.col("doc_id").cast("string")
    stored = top.join(q, "query_id").select(F.col("text").alias("query"), "rank", F.concat(F.lit("doc-"), name).alias("title"), "snippet", F.concat(F.lit("https://example.org/"), name).alias("link"))
    return S.search_results_text(S.stored_search(q, stored.dropDuplicates(["query", "rank"])))


@query("SELECT 'doc-' || doc_id || '.txt' AS filename, count(*) AS pages FROM (SELECT doc_id FROM documents, range(0, 200) r(i) WHERE i * 3500 < length(text) AND trim(substr(text, (i * 3500 + 1)::INT, 3500), ' ' || chr(10)) <> '') GROUP BY 1")
def load_text_files(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), F.encode("text", "UTF-8").alias("content"))
    return S.load(d).where("load_error is null").groupBy("filename").agg(F.count(F.lit(1)).alias("pages"))
