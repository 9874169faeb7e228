import pytest
from pyspark.sql import functions as F

from gridlens.functions import tables, text
from gridlens.sources import scratch

DOCS = [(1, "a" * 30 + "\n\n" + "b" * 50, "x", 7), (2, None, None, None), (3, "", "y", 1), (4, "  short ", "z", 2), (5, "é" * 90 + "\n\n" + "c" * 5, None, 3)]


def test_chunks_from_sql(spark):
    tables.register(spark)
    df = spark.createDataFrame(DOCS, "id long, body string, piece string, Start int")
    want = sorted((r.id, r.chunk, r.start, r.end, r.text) for r in text.chunk(df, "id", "body", 60, 10).collect())
    got = spark.sql("SELECT * FROM chunk_table(TABLE(SELECT * FROM {df}), 'body', 60, 10)", df=df)
    assert got.columns == ["id", "body", "piece", "Start", "chunk", "start_", "end", "piece_"]
    rows = got.collect()
    assert sorted((r.id, r.chunk, r.start_, r.end, r.piece_) for r in rows) == want and len(want) == 5
    assert {(r.id, r.body, r.piece, r.Start) for r in rows} == {d for d in DOCS if (d[1] or "").strip()}
    named = spark.sql("SELECT count(*) AS n FROM chunk_table(text_col => 'body', rows => TABLE(SELECT * FROM {df}), size => 60, overlap => 10, separator => '\n\n')", df=df)
    assert named.first().n == len(want)
    beside = spark.sql("SELECT d.id, c.* FROM {df} AS d, LATERAL chunk_text(d.body, 60, 10) AS c", df=df)
    assert sorted(tuple(r) for r in beside.collect()) == want
    assert spark.sql("SELECT * FROM chunk_table(TABLE(SELECT * FROM {df} WHERE id > 9), 'body')", df=df).count() == 0


@pytest.mark.parametrize("call", ["chunk_table(TABLE(SELECT 1 AS a), 'body')", "chunk_table('body', 'body')", "chunk_table(TABLE(SELECT 'abc' AS a), 'a', 10, 9)"])
def test_wrong_calls(spark, call):
    tables.register(spark)
    with pytest.raises(Exception, match="body|table|overlap|TABLE"):
        spark.sql(f"SELECT * FROM {call}").collect()


def test_scratch_can_be_cleared(spark, monkeypatch):
    import os

    monkeypatch.setattr(scratch, "_given", [])
    held = scratch.written(spark.range(5).withColumn("x", F.lit(1)), "held")
    assert held.count() == 5
    folder = scratch._given[0].removeprefix("file:")
    assert os.path.isdir(folder)
    scratch.clear_scratch(spark)
    assert not os.path.exists(folder) and scratch._given == []
