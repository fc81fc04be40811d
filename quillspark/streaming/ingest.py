"""Incremental ingestion: new files are loaded, chunked, embedded and upserted once per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.config import Options
from quillspark.operators.collections import Collections
from quillspark.plans.retrieve import build_index
from quillspark.sources.documents import extract, load

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def ingest_batch(files: DataFrame, store: Collections, name: str, batch: int, options: Options = Options(), embed=None, stream: str = "") -> None:
    """Index the files of one batch of a stream; running a batch again replaces its own rows only."""
    pages = extract(load(files.select("filename", "content"), options.max_pages, options.page_chars)).where("load_error is null").drop("load_error")
    store.upsert(name, build_index(pages, options, embed), batch, stream=stream)


def ingest_stream(spark: SparkSession, folder: str, store: Collections, name: str, checkpoint: str, options: Options = Options(), embed=None, once: bool = True):
    """A streaming query from a folder of files into a collection. With ``once`` it ends when all files are in."""
    source = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true").load(folder)
    rows = source.select(F.regexp_extract("path", "([^/]+)$", 1).alias("filename"), "content")


    def each(batch: DataFrame, i: int) -> None:
        # The checkpoint holds the id, so a restarted query goes on with its batches and a fresh one has its own.
        own = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        ingest_batch(batch, store, name, i, options, embed, own)

    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(availableNow=True) if once else writer).start()
