"""Related texts: the terms of every text are made once."""

from __future__ import annotations

from veritab.operators import texts


def test_texts_are_read_once(spark, tmp_path):
    spark.createDataFrame([(1, "solar panels on roofs"), (2, "wind turbines"), (3, None)], "t int, text string").write.parquet(f"{tmp_path}/t")
    asked = spark.createDataFrame([(7, "do solar panels heat roofs"), (8, "wind")], "q int, question string")
    found = texts.related(spark.read.parquet(f"{tmp_path}/t"), asked, "t", "text", "q", "question")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(lower(text") == 0
    assert [(r["q"], r["t"], r["matched"]) for r in found.collect()] == [(7, 1, 3)]
