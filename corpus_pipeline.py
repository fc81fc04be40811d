"""Training-data pipeline over ``documents``: quality, exact and near duplicates, benchmark leaks, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the
columns of ``docs``, the last one the packed pieces. An empty table passes through every stage. A null text counts as
empty, texts are read whole, and columns of any name pass through; what a stage does with ties, repeated rows and rows
without doc_id is said at its operator (``keep_good``, ``keep_first``, ``keep_representatives``, ``keep_clean``, ``pack``).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.common import table, written
from quillspark.llm.decontamination import keep_clean
from quillspark.llm.exact_dedup import keep_first
from quillspark.llm.ngram_join import keep_representatives
from quillspark.llm.packing import pack
from quillspark.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention classifier rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space, the longest, then the smallest doc_id stays."""
    return keep_first(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.75, the smallest doc_id stays."""
    return keep_representatives(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of ``benchmark`` go."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of 2048 tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("exact duplicates", exact_duplicates), ("near duplicates", near_duplicates), ("benchmark leaks", benchmark_leaks), ("packing", packing)]

#: The classifier and the alignment have no SQL; tests hold the operators against brute-force versions and the stages
#: against what must be gone or kept.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the last stage makes of ``documents``; every stage is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
