"""Collections: nothing is lost or doubled by compaction, several streams, fresh checkpoints, crashes and failing stores."""

import json
import os

import pytest
from pyspark.sql import functions as F

from quillspark.config import Options
from quillspark.functions import vectors as V
from quillspark.operators.collections import Collections, write_points
from quillspark.plans import retrieve
from quillspark.streaming import ingest


@pytest.fixture
def store(spark, tmp_path):
    return Collections(spark, f"file://{tmp_path}/store")


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "chunk_id string, text string")


def held(store, name="c"):
    return {r.chunk_id: r.text for r in store.read(name).collect()}


def test_compaction_between_batches_loses_nothing(spark, store):
    store.upsert("c", rows(spark, ("k1", "a")), 0)
    store.upsert("c", rows(spark, ("k2", "b"), ("k1", "a2")), 1)
    store.compact("c")
    store.upsert("c", rows(spark, ("k3", "c")), 2)
    assert held(store) == {"k1": "a2", "k2": "b", "k3": "c"}
    store.upsert("c", rows(spark, ("k2", "B"), ("k1", "a2")), 1)  # the last batch before compaction once more, in its own place
    store.upsert("c", rows(spark, ("k2", "late")), 3)
    store.compact("c")
    assert held(store) == {"k1": "a2", "k2": "late", "k3": "c"} and len(store.generation("c")[1]["parts"]) == 1


def test_streams_have_their_own_numbers(spark, store):
    store.upsert("c", rows(spark, ("k1", "one")), 0, stream="s")
    store.upsert("c", rows(spark, ("k2", "two")), 0, stream="t")
    store.upsert("c", rows(spark, ("k1", "again")), 0, stream="s")
    assert held(store) == {"k1": "again", "k2": "two"}


def test_a_crash_between_writing_and_switching(spark, store, monkeypatch):
    store.upsert("c", rows(spark, ("k1", "a")), 0)
    before = store.generation("c")
    with monkeypatch.context() as m:
        m.setattr(store, "_commit", lambda *a: (_ for _ in ()).throw(OSError("died")))
        with pytest.raises(OSError):
            store.upsert("c", rows(spark, ("k1", "b")), 1)
    assert store.generation("c") == before and held(store) == {"k1": "a"}
    store.upsert("c", rows(spark, ("k1", "b")), 1)
    store.vacuum("c", keep=1, seconds=0)
    assert held(store) == {"k1": "b"} and len(store._names(f"{store._path('c')}/data")) == 2


def test_two_writers(spark, store, monkeypatch):
    store.upsert("c", rows(spark, ("k1", "a")), 0)
    seen, real = [], store.generation

    def slow(name):
        found = real(name)
        if not seen:  # another writer commits after this one has looked
            seen.append(1)
            Collections(spark, store.folder).upsert("c", rows(spark, ("k2", "other")), 0, stream="other")
        return found

    monkeypatch.setattr(store, "generation", slow)
    store.upsert("c", rows(spark, ("k3", "mine")), 1)
    assert held(store) == {"k1": "a", "k2": "other", "k3": "mine"}


def test_a_replaced_part_stops_compaction(spark, store, monkeypatch):
    store.upsert("c", rows(spark, ("k1", "a")), 0)
    store.upsert("c", rows(spark, ("k2", "b")), 1)
    real = store._write

    def slow(name, d):
        part = real(name, d)
        Collections(spark, store.folder).upsert("c", rows(spark, ("k1", "new")), 0)
        return part

    monkeypatch.setattr(store, "_write", slow)
    with pytest.raises(RuntimeError, match="replaced"):
        store.compact("c")
    assert held(store) == {"k1": "new", "k2": "b"}


def test_repeated_keys_and_missing_columns(spark, store):
    store.upsert("c", spark.createDataFrame([("k1", "z", 1), ("k1", "a", 2)], "chunk_id string, text string, n int"), 0, order="n")
    store.copy(rows(spark, ("k2", "b")), "c", 1)
    assert held(store) == {"k1": "a", "k2": "b"} and store.count("c") == 2 and store.read("none") is None
    assert store.scan("c", least=1).count() == 2 and store.available("c") and not store.available("none")


def test_ingest_after_compaction_and_with_a_fresh_checkpoint(spark, store, tmp_path):
    (tmp_path / "in").mkdir()
    embed = V.hashed_embedding(8)

    def run(checkpoint):
        ingest.ingest_stream(spark, f"file://{tmp_path}/in", store, "kb", f"file://{tmp_path}/{checkpoint}", embed=embed).awaitTermination(120)

    for i, name in enumerate(("cats", "dogs", "ships")):
        (tmp_path / f"in/{name}.txt").write_text(f"Of {name} there is something to tell.")
        run("one")
        store.compact("kb")
        assert store.count("kb") == i + 1
    run("two")
    assert store.count("kb") == 3


def test_an_unchanged_index_is_not_built_again(spark, store):
    page = lambda i, text: (f"{i:064x}", f"f{i}.txt", 1, text, "")
    schema = "fingerprint string, filename string, page_number int, text string, html string"
    pages = spark.createDataFrame([page(1, "A ship of spices."), page(2, "A cat.")], schema)
    assert retrieve.refreshed(store, "ix", pages, embed=V.hashed_embedding(8)).count() == 2
    fails = lambda tokens: F.raise_error(F.lit("embedded again")).cast("array<float>")
    first = store.generation("ix")
    assert retrieve.refreshed(store, "ix", pages, embed=fails).count() == 2 and store.generation("ix") == first
    more = pages.unionByName(spark.createDataFrame([page(3, "A dog.")], schema))
    only_new = lambda tokens: F.when(F.array_contains(tokens, "dog"), F.array(F.lit(1.0))).otherwise(fails(tokens)).cast("array<float>")
    assert retrieve.refreshed(store, "ix", more, embed=only_new).count() == 3
    assert retrieve.refreshed(store, "ix", pages, Options(chunk_size=600, chunk_overlap=100), V.hashed_embedding(8)).count() == 2
    assert retrieve.refreshed(store, "ix", pages, embed=fails).count() == 2


def test_points_reach_a_store_that_fails(spark, tmp_path):
    folder = str(tmp_path)

    def connect():
        def send(points):
            mark = f"{folder}/tried-{points[0]['id']}"
            if not os.path.exists(mark):  # the first call for each batch fails, half way
                open(mark, "w").close()
                points, fail = points[:1], True
            else:
                fail = False
            for p in points:
                with open(f"{folder}/{p['id']}.json", "a") as f:
                    f.write(json.dumps(p) + "\n")
            if fail:
                raise OSError("unavailable")

        return send

    d = spark.createDataFrame([(f"k{i}", f"text {i}", ["t"], [float(i), 0.0]) for i in range(20)], "chunk_id string, text string, tokens array<string>, embedding array<double>").repartition(3)
    write_points(d, connect, batch=4, pause=0.01)
    stored = [json.loads((tmp_path / f).read_text().splitlines()[-1]) for f in os.listdir(folder) if f.endswith(".json")]
    assert sorted(p["payload"]["chunk_id"] for p in stored) == sorted(f"k{i}" for i in range(20))
    assert all(p["payload"] == {"chunk_id": p["payload"]["chunk_id"], "text": f"text {p['payload']['chunk_id'][1:]}"} for p in stored)
    with pytest.raises(Exception, match="never"):
        write_points(d, lambda: lambda points: (_ for _ in ()).throw(OSError("never")), attempts=1)
