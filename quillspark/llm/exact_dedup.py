"""Exact deduplication with a heavy-hitter split.

A Misra-Gries summary of fixed size finds every digest that more than N/(k+1) rows share. The exact winner and
count of each candidate come from a map-side aggregate, are at most k rows, and are broadcast, so rows of frequent
digests are settled without a shuffle. All other digests, each of at most N/(k+1) rows, are settled by an ordinary
shuffle on the digest.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, shuffle_partitions, texts, written


def merge_counters(counters: dict, more: dict, k: int) -> dict:
    """Misra-Gries merge: add, then subtract the (k+1)-th largest count and keep what stays positive."""
    for key, n in more.items():
        counters[key] = counters.get(key, 0) + n
    if len(counters) > k:
        cut = sorted(counters.values(), reverse=True)[k]
        counters = {key: n - cut for key, n in counters.items() if n > cut}
    return counters


def summarise(k: int):
    """mapInArrow function: (digest, n) rows of a partition to at most k counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict = {}
        for b in batches:
            got = pa.table(b).group_by("digest").aggregate([("n", "sum")]).to_pydict()
            counters = merge_counters(counters, dict(zip(got["digest"], got["n_sum"], strict=True)), k)
        yield pa.RecordBatch.from_pydict({"digest": pa.array(list(counters), pa.string()), "n": pa.array(list(counters.values()), pa.int64())})

    return run


def heavy_candidates(digests: DataFrame, k: int) -> list[str]:
    """At most k digests; every digest of more than N/(k+1) rows is among them. Summaries merge in two levels."""
    schema = "digest string, n long"
    first = digests.select("digest", F.lit(1).cast("long").alias("n")).mapInArrow(summarise(k), schema)
    fan = max(1, int(shuffle_partitions(digests.sparkSession) ** 0.5))
    merged = first.repartition(fan).mapInArrow(summarise(k), schema).repartition(1).mapInArrow(summarise(k), schema)
    return [r.digest for r in merged.collect()]


def exact_dedup(docs: DataFrame, k: int = 256) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without ASCII white space; a null text is empty, and all empty texts are one
    group. Of equal texts the longest original (code points), then the smallest doc_id stays (a null doc_id comes
    last). Rows that repeat a doc_id and text carry the same decision, as nothing tells them apart. An empty table gives no rows. Other columns
    of the input are ignored.
    """
    spark = docs.sparkSession
    d = texts(docs)
    digests = written(
        d.select("doc_id", F.length("text").cast("long").alias("size"), F.sha2(F.translate("text", ASCII_SPACE, ""), 256).alias("digest")),
        "digests",
    )
    rank = F.struct(F.col("size"), F.col("doc_id").isNotNull().alias("has"), F.bitwise_not("doc_id").alias("back"))
    heavy = spark.createDataFrame([(x,) for x in heavy_candidates(digests, k)], "digest string")
    winners = (
        digests.join(F.broadcast(heavy), "digest")
        .groupBy("digest")
        .agg(F.max(rank).alias("best"), F.count(F.lit(1)).alias("group_size"))
        .select("digest", F.bitwise_not("best.back").alias("keep_id"), F.col("best.size").alias("keep_size"), "group_size")
    )
    winners = spark.createDataFrame(winners.collect(), "digest string, keep_id long, keep_size long, group_size long")  # k rows at most
    settled = digests.join(F.broadcast(winners), "digest")
    others = digests.join(F.broadcast(winners), "digest", "left_anti")
    best = others.groupBy("digest").agg(F.max(rank).alias("best"), F.count(F.lit(1)).alias("group_size"))
    rest = others.join(best, "digest").select("digest", "doc_id", "size", F.bitwise_not("best.back").alias("keep_id"), F.col("best.size").alias("keep_size"), "group_size")
    return settled.select(rest.columns).unionByName(rest).select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("size") == F.col("keep_size"))).alias("kept"), F.col("digest").alias("text_sha256")
    )


def keep_first(docs: DataFrame, k: int = 256) -> DataFrame:
    """The rows of ``docs``, all columns, that ``exact_dedup`` keeps; of rows that repeat a doc_id and text, one (that of
    the longest original; rows that agree in this too are told apart by nothing but chance)."""
    kept = exact_dedup(docs, k).where("kept").select(F.struct("doc_id", F.col("text_sha256").alias("digest")).alias("key")).distinct()
    text = F.coalesce("text", F.lit(""))
    # Key and row are structs, so no column of the input can clash.
    key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(F.translate(text, ASCII_SPACE, ""), 256).alias("digest"))
    stay = docs.select(key.alias("key"), F.length(text).alias("size"), F.struct("*").alias("row")).join(kept, "key", "left_semi")
    return stay.groupBy("key").agg(F.max_by("row", "size").alias("row")).select("row.*")
