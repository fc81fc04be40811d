"""The pipeline's stages keep what a plain version keeps, and every stage takes an empty table."""

import corpus_pipeline as P
from quillspark.llm.common import table, written

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    for name, stage in P.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), "test")
        assert docs.columns == columns, name
    rows = {r.doc_id: r.text for r in docs.collect()}
    assert len({"".join(t.split()) for t in rows.values()}) == len(rows)
    items = [" ".join(r.text.lower().split()) for r in table(spark, SF, "benchmark").collect()]
    assert not any(i in " ".join(t.lower().split()) for i in items for t in rows.values())
    bad = {r.doc_id for r in table(spark, SF, "labels").where("quality = 0").collect()}
    assert not bad & set(rows)
    packed = P.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == set(rows)


def test_empty(spark):
    docs = table(spark, SF, "documents").where("false")
    for _, stage in P.STAGES:
        docs = written(stage(spark, docs, SF), "test")
    assert docs.count() == 0
