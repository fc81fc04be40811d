"""Chunk collections: Parquet parts behind a log of generations, with last-write-wins upsert by key.

A collection is a folder with ``data/`` (immutable parts) and ``_log/`` (one small file a generation, which lists the
parts that belong to it). Whoever changes a collection writes its part first and then the next generation, by a rename
that fails if that generation exists: readers see one generation or the next, a writer that dies in between leaves the
collection as it was, and of two writers the second tries again on top of the first.

Batches are known by stream and number and have a place in the order of writes. A batch that is written twice replaces
itself and keeps its place. ``compact`` folds parts into one whose rows keep their batches' places, so it can run at any
time, between batches of any numbers; ``vacuum`` removes what no recent generation names."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from quillspark.functions import text as T


def latest(rows: DataFrame, key: str = "chunk_id", version: str = "version", *ties: str) -> DataFrame:
    """The row of each key with the greatest version (then the greatest ``ties``)."""
    w = Window.partitionBy(key).orderBy(*(F.col(c).desc() for c in (version, *ties)))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def scalar_metadata(c: str = "metadata"):
    """A map without null values."""
    return F.map_filter(c, lambda k, v: v.isNotNull())


#: A collection without parts. ``next``: the place of the next batch; ``folded``: stream to (number, place) of the last
#: batch that ``compact`` took from it.
EMPTY = {"parts": [], "next": 0, "folded": {}}


class Collections:
    """Named collections below a folder."""

    def __init__(self, spark: SparkSession, folder: str, dims: int | None = None):
        self.spark, self.folder, self.dims = spark, folder.rstrip("/"), dims

    # --- Files ---------------------------------------------------------------------------------------------------
    def _path(self, name: str) -> str:
        if not self.spark.range(1).select(T.valid_collection_name(F.lit(name))).first()[0]:
            raise ValueError(f"invalid collection name: {name}")
        return f"{self.folder}/{name}"

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []

    def _load(self, path: str) -> dict:
        fs, p = self._fs(path)
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, path: str, value: dict) -> bool:
        """Write a file whole or not at all; False if it is there already."""
        fs, p = self._fs(path)
        temporary = self._fs(f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}")[1]
        out = fs.create(temporary, False)
        try:
            out.write(bytearray(json.dumps(value).encode()))
        finally:
            out.close()
        gateway = self.spark.sparkContext._gateway
        files = gateway.jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            files.rename(temporary, p, gateway.new_array(getattr(gateway.jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Py4JJavaError as e:
            fs.delete(temporary, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    # --- Generations ---------------------------------------------------------------------------------------------
    def generation(self, name: str) -> tuple[int, dict]:
        """Number and content of the newest generation; -1 where there is none."""
        numbers = [int(x.removesuffix(".json")) for x in self._names(f"{self._path(name)}/_log") if x.endswith(".json") and not x.startswith(".")]
        return (max(numbers), self._load(f"{self._path(name)}/_log/{max(numbers):020d}.json")) if numbers else (-1, EMPTY)

    def _commit(self, name: str, change: Callable[[dict], dict], attempts: int = 50) -> int:
        """Make the next generation from the newest one; again if another writer was faster."""
        for _ in range(attempts):
            number, state = self.generation(name)
            if self._put(f"{self._path(name)}/_log/{number + 1:020d}.json", change(state)):
                return number + 1
        raise RuntimeError(f"collection {name}: {attempts} other writers were faster")

    def create(self, name: str) -> None:
        """Create a collection if it is missing, with its vector size and metric; an error if it has another size."""
        path = f"{self._path(name)}/_collection.json"
        if not self._fs(path)[0].exists(self._fs(path)[1]) and self._put(path, {"dims": self.dims, "metric": "cosine"}):
            return
        known = self._load(path)["dims"]
        if None not in (known, self.dims) and known != self.dims:
            raise ValueError(f"collection {name} has vectors of {known} places, not {self.dims}")

    def _checked(self, rows: DataFrame) -> DataFrame:
        if self.dims is None or "embedding" not in rows.columns:
            return rows
        ok = F.assert_true(F.size("embedding") == self.dims, f"vectors must have {self.dims} places")
        return rows.where(F.coalesce(ok.cast("boolean"), F.lit(True)))

    # --- Writing -------------------------------------------------------------------------------------------------
    def _write(self, name: str, rows: DataFrame) -> str:
        part = uuid.uuid4().hex
        rows.write.parquet(f"{self._path(name)}/data/{part}")
        return part

    def _add(self, name: str, rows: DataFrame, batch: int, stream: str) -> int:
        part = self._write(name, rows)

        def change(state: dict) -> dict:
            same = [p for p in state["parts"] if (p["stream"], p["batch"]) == (stream, batch)]
            number, place = state["folded"].get(stream, (None, None))
            at = same[0]["place"] if same else place if number == batch else state["next"]
            others = [p for p in state["parts"] if p not in same]
            return state | {"parts": [*others, {"part": part, "stream": stream, "batch": batch, "place": at}], "next": max(state["next"], at + 1)}

        return self._commit(name, change)

    def upsert(self, name: str, rows: DataFrame, batch: int, order: str = "text", stream: str = "") -> int:
        """Add a batch (chunk_id, ..., embedding); of keys that a batch repeats the last by column ``order`` stays. The
        number of the new generation."""
        self.create(name)
        one = latest(self._checked(rows).withColumn("_one", F.lit(1)), "chunk_id", "_one", order).drop("_one")
        return self._add(name, one, batch, stream)

    def append(self, name: str, rows: DataFrame, batch: int, stream: str = "") -> int:
        """Add a batch without looking for repeated keys; running it again replaces it."""
        self.create(name)
        return self._add(name, self._checked(rows), batch, stream)

    def copy(self, rows: DataFrame, into: str, batch: int, order: str = "text", stream: str = "") -> int:
        """Upsert a document's rows into a shared collection; its new size."""
        self.upsert(into, rows, batch, order, stream)
        return self.count(into)

    def compact(self, name: str) -> int:
        """All parts of the newest generation as one. Batches that others add meanwhile stay beside it; if one of its own
        parts is replaced meanwhile, nothing changes and it is an error. The number of the newest generation."""
        number, state = self.generation(name)
        if len(state["parts"]) < 2:
            return number
        part = self._write(name, latest(self._rows(name, state["parts"]), "chunk_id", "_place"))

        def change(now: dict) -> dict:
            if any(p not in now["parts"] for p in state["parts"]):
                raise RuntimeError(f"collection {name}: a part was replaced while it was compacted")
            last: dict = {}
            for p in state["parts"]:
                if p["stream"] is not None and p["batch"] >= last.get(p["stream"], (p["batch"],))[0]:
                    last[p["stream"]] = (p["batch"], p["place"])
            others = [p for p in now["parts"] if p not in state["parts"]]
            return now | {"parts": [{"part": part, "stream": None, "batch": None, "place": None}, *others], "folded": now["folded"] | last}

        return self._commit(name, change)

    def vacuum(self, name: str, keep: int = 2, seconds: float = 86_400) -> None:
        """Delete generations but the newest ``keep``, and parts older than ``seconds`` that none of these names."""
        path = self._path(name)
        logs = sorted(x for x in self._names(f"{path}/_log") if x.endswith(".json") and not x.startswith("."))
        used = {p["part"] for x in logs[-keep:] for p in self._load(f"{path}/_log/{x}")["parts"]}
        for x in logs[:-keep]:
            fs, p = self._fs(f"{path}/_log/{x}")
            fs.delete(p, False)
        for x in self._names(f"{path}/data"):
            fs, p = self._fs(f"{path}/data/{x}")
            if x not in used and fs.getFileStatus(p).getModificationTime() / 1000 <= time.time() - seconds:
                fs.delete(p, True)

    # --- Reading -------------------------------------------------------------------------------------------------
    def _rows(self, name: str, parts: list[dict]) -> DataFrame:
        """All rows of parts with ``_place``, the place of the batch that wrote them. One scan of the batches, one of
        what was compacted."""
        path, out = self._path(name), []
        if own := [p for p in parts if p["place"] is not None]:
            places = F.create_map(*[F.lit(x) for p in own for x in (p["part"], p["place"])])
            part = F.regexp_extract(F.col("_metadata.file_path"), r"/data/([0-9a-f]{32})/", 1)
            d = self.spark.read.option("mergeSchema", "true").parquet(*(f"{path}/data/{p['part']}" for p in own))
            out.append(d.withColumn("_place", F.element_at(places, part).cast("long")))
        out += [self.spark.read.parquet(f"{path}/data/{p['part']}") for p in parts if p["place"] is None]
        rows = out[0]
        for d in out[1:]:
            rows = rows.unionByName(d, allowMissingColumns=True)
        return rows

    def read(self, name: str) -> DataFrame | None:
        """The latest rows of the newest generation, or None if there is no such collection; reading creates nothing."""
        parts = self.generation(name)[1]["parts"]
        return latest(self._rows(name, parts), "chunk_id", "_place").drop("_place") if parts else None

    def scan(self, name: str, least: int = 100, most: int | None = None) -> DataFrame | None:
        """Rows with texts of ``least`` characters or more, without vectors."""
        rows = self.read(name)
        if rows is None:
            return None
        rows = rows.drop("embedding").where(F.length("text") >= least)
        return rows.limit(most) if most else rows

    def count(self, name: str) -> int:
        rows = self.read(name)
        return 0 if rows is None else rows.select("chunk_id").count()

    def available(self, name: str) -> bool:
        rows = self.read(name)
        return rows is not None and not rows.isEmpty()


#: Stores by name; others register here.
STORES = {"parquet": Collections}


def open_store(spark: SparkSession, kind: str = "parquet", **options):
    """The store of a kind; an unknown kind is an error."""
    if kind.lower() not in STORES:
        raise ValueError(f"unknown store: {kind} (known: {', '.join(sorted(STORES))})")
    return STORES[kind.lower()](spark, **options)


class Sent(WriterCommitMessage):
    """How many points a task has sent."""

    def __init__(self, points: int):
        self.points = points


def point_sink(connect: Callable[[], Callable[[list[dict]], None]], batch: int, attempts: int, pause: float) -> type[DataSource]:
    """A data source that writes to an external vector store. Rows come as Arrow batches (id, vector, payload as JSON)."""

    class Writer(DataSourceArrowWriter):
        def write(self, batches):
            send, n = connect(), 0
            for b in batches:
                for lo in range(0, b.num_rows, batch):
                    points = [r | {"payload": json.loads(r["payload"])} for r in b.slice(lo, batch).to_pylist()]
                    for left in range(attempts - 1, -1, -1):
                        try:
                            send(points)
                            break
                        except Exception:
                            if not left:
                                raise
                            time.sleep(pause * 2 ** (attempts - 1 - left))
                    n += len(points)
            return Sent(n)

        def commit(self, messages):
            pass

        def abort(self, messages):
            pass

    class Points(DataSource):
        @classmethod
        def name(cls):
            return "quill_points"

        def writer(self, schema, overwrite):
            return Writer()

    return Points


def write_points(rows: DataFrame, connect: Callable[[], Callable[[list[dict]], None]], batch: int = 8, attempts: int = 5, pause: float = 0.5) -> None:
    """Send chunks to an external vector store: ``connect()`` is called in each task and gives a function that upserts a
    list of points {id (UUID of the chunk_id), vector, payload (all other columns but tokens)}.

    A call that fails is made again up to ``attempts`` times, after ``pause`` seconds, then twice that, and so on; then
    the task fails and Spark runs it again. Points have stable ids, so whatever is sent twice replaces itself. An error
    after that leaves the points sent so far in the store, and the same call completes them."""
    others = [c for c in rows.columns if c not in ("embedding", "tokens")]
    points = rows.select(T.uuid5(F.col("chunk_id")).alias("id"), F.col("embedding").alias("vector"), F.to_json(F.struct(*others)).alias("payload"))
    rows.sparkSession.dataSource.register(point_sink(connect, batch, attempts, pause))
    points.write.format("quill_points").mode("append").save()
