"""Queries opN_<name> and their DuckDB counterparts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import settled

from .alignment import align
from .chat import chat_format, conversations
from .common import removed, table
from .decontamination import contamination
from .exact_dedup import exact_dedup
from .language_model import language_model_scores
from .licences import licence_scan
from .ngram_join import jaccard_components
from .packing import pack
from .periodic import periodic_runs
from .quality import quality_scores
from .substrings import substring_dedup
from .token_files import token_files
from .url_filter import GLOBS, LOWER, RULES, UPPER, url_verdicts


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(chat_format(table(spark, sf_dir, "conversations")))


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(table(spark, sf_dir, "documents"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(table(spark, sf_dir, "documents"))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"), RULES, GLOBS)


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    removed(found.groups, found.pairs)
    return found.documents


def repeating(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text), in which the words of every tenth text by crc32(doc_id) repeat from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    d = docs.select("doc_id", "text", F.floor(h / 10).alias("_g"), F.when(h % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")).alias("_all"))
    d = settled(d, "_words", F.col("_all"))
    n = F.size("_words")
    d = settled(d.withColumn("_n", n), "_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    d = settled(d, "_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8)))
    place = lambda i: F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p"))
    again = F.array_join(F.transform("_words", lambda x, i: F.get(F.col("_words"), place(i).cast("int"))), " ")
    return d.select("doc_id", F.when(F.col("_n") > 0, again).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = periodic_runs(repeating(table(spark, sf_dir, "documents")))
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return d.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "strongest.start", "strongest.length", "strongest.period", F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES = {f.__name__: f for f in (op3_exact_dedup, op5_best_fit_packing, op7_token_files, op8_quality_classifier, op9_decontamination, op4_chat_formatting, op10_licence_scan, op6_suffix_array_dedup, op2_language_model, op1_ngram_jaccard_join, op11_url_filter, op12_cross_tokenizer_alignment, op13_periodic_runs)}

ORACLES = {
    "op3_exact_dedup": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS size, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
        w AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY size DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w
    """,
    "op11_url_filter": rf"""
        WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        u AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
        j AS (SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
            WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
            WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
            WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
            CASE WHEN contains(host || path, '/wp-admin/') THEN '**/wp-admin/**' WHEN contains(host, 'casino') AND path <> '' THEN '*casino*/**' WHEN contains(host, 'casino') THEN '*casino*'
            WHEN contains(host, 'spam') AND path <> '' THEN '*spam*/**' WHEN regexp_matches(host || path, '^(?s)ads.\.[^/]*/') THEN 'ads?.*/**' WHEN contains(host, 'spam') THEN '*spam*' WHEN ends_with(host || path, '.exe') THEN '**.exe' END AS fits FROM u)
        SELECT page_id, host, path, rule, CASE WHEN rule IS NULL THEN fits END AS pattern, CASE WHEN rule IN ('net/', 'example.com/de/') OR rule IS NULL AND fits IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict FROM j
    """,
}
