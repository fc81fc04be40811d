"""Token-id files: a concatenated id array with Elias-Fano coded document boundaries.

A file holds consecutive documents in ascending doc_id order:
``QTOK1\\n``, five little-endian u64 (documents, ids, bytes an id, bytes of the boundary code, 0), doc_ids as i64,
the Elias-Fano code of the documents+1 boundaries, then the ids. Files hold at most ``file_ids`` ids, unless one
document is longer. They are written under a temporary name and moved, so a retried task replaces its own file.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_path, shuffle_partitions, slices, texts, written
from .elias_fano import EliasFano
from .tokens import crc32, encoder, with_end

MAGIC, HEAD = b"QTOK1\n", "<5Q"
MANIFEST = "part long, seq long, file string, docs long, ids long"
#: A manifest of up to so many files (about 10 MB) is broadcast; a longer one is joined by shuffle.
BROADCAST_FILES = 100_000
#: How a null doc_id is written.
NO_ID = -(1 << 63)


def encode_file(doc_ids: np.ndarray, bounds: np.ndarray, ids: np.ndarray) -> bytes:
    size = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    code = EliasFano.encode(bounds).to_bytes()
    return MAGIC + struct.pack(HEAD, len(doc_ids), len(ids), size, len(code), 0) + doc_ids.astype("<i8").tobytes() + code + ids.astype(f"<u{size}").tobytes()


class TokenFile:
    """Random access to the documents of one file's bytes."""

    def __init__(self, data):
        data = memoryview(data)
        if bytes(data[: len(MAGIC)]) != MAGIC:
            raise ValueError("not a token-id file")
        n, ids, size, code, _ = struct.unpack_from(HEAD, data, len(MAGIC))
        at = len(MAGIC) + struct.calcsize(HEAD)
        self.doc_ids = np.frombuffer(data, "<i8", n, at)
        self.bounds = EliasFano.from_bytes(data[at + 8 * n : at + 8 * n + code])
        self.ids = np.frombuffer(data, f"<u{size}", ids, at + 8 * n + code)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, file_ids: int = 8 << 20) -> DataFrame:
    """Encode every whole text and write files into ``folder`` in ascending doc_id order; returns the manifest
    (part, seq, file, docs, ids, start). A null doc_id is written as the smallest 64-bit integer."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer, True), TaskContext.get().partitionId()
        fs, root = pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", folder))
        fs.create_dir(root, recursive=True)
        held, names, sizes, n, seq = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, names, sizes, n, seq
            name = f"part-{part:06d}-{seq:06d}.ids"
            doc_ids = np.concatenate(names)
            data = encode_file(doc_ids, np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), np.concatenate(held))
            with fs.open_output_stream(tmp := f"{root}/_{name}.{uuid.uuid4().hex}") as out:
                out.write(data)
            fs.move(tmp, f"{root}/{name}")
            row = pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "file": name, "docs": len(doc_ids), "ids": n}])
            held, names, sizes, n, seq = [], [], [], 0, seq + 1
            return row

        for b in slices(batches):
            ids, at = with_end(*enc.encode(b.column("text").to_pylist()), end_id)
            keys = np.asarray(b.column("doc_id").cast(pa.int64()).fill_null(NO_ID))
            lo = 0
            while lo < len(keys):
                # As many documents as the file has room for; one at least into an empty file.
                hi = int(np.searchsorted(at, at[lo] + file_ids - n, side="right")) - 1
                if hi > lo or not n:
                    hi = max(hi, lo + 1)
                    held.append(ids[at[lo] : at[hi]])
                    names.append(keys[lo:hi])
                    sizes.append(np.diff(at[lo : hi + 1]))
                    n, lo = n + int(at[hi] - at[lo]), hi
                if lo < len(keys):
                    yield flush()
        if n:
            yield flush()
        enc.rest()

    ordered = texts(docs).repartitionByRange(shuffle_partitions(spark), F.col("doc_id")).sortWithinPartitions("doc_id")
    manifest = written(ordered.mapInArrow(run, MANIFEST), "manifest")  # one row a file
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Documents of the files in ``folder``: file, doc_id, local_start, n_tokens, ids_crc32 (and ids)."""
    schema = "file string, doc_id long, local_start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                f = TokenFile(data.as_buffer())
                name = path.rsplit("/", 1)[-1]
                for lo in range(0, len(f.doc_ids), 4096):
                    keys = f.doc_ids[lo : lo + 4096]
                    bounds = f.bounds.select_range(lo, lo + len(keys) + 1)
                    spans = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
                    out = [pa.array([name] * len(keys)), pa.array(keys, mask=keys == NO_ID), pa.array(bounds[:-1]), pa.array(np.diff(bounds)), pa.array([crc32(f.ids[x:y]) for x, y in spans], pa.int64())]
                    if with_ids:
                        out.append(pa.array([f.ids[x:y].astype(np.int64) for x, y in spans], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(out, [x.split()[0] for x in schema.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(folder)
    return files.select("path", "content").mapInArrow(run, schema)


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, file_ids: int = 8 << 20) -> DataFrame:
    """Write the files, read them back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    A null text is empty and has the end id alone. Rows that repeat a doc_id are written one after the other. An
    empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    folder = shared_path(spark, "token-files")
    manifest = write_token_files(docs, folder, tokenizer, end_id, file_ids).select("file", "start")
    files = manifest.count()
    if not files:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    manifest = F.broadcast(manifest) if files <= BROADCAST_FILES else manifest
    return read_token_files(spark, folder).join(manifest, "file").select("doc_id", (F.col("start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
