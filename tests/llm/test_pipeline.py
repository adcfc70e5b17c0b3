"""The corpus pipeline against plain Python, on odd rows and empty tables, and its registered queries."""

from __future__ import annotations

import zlib

import __spark_entry__ as entry
import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from test_operators import brute

from veritab.llm import langid, quality
from veritab.llm.queries import fold, tokenizer_path

SF = "/root/testdata/sf0.001"


def expected(docs, labels):
    """The documents that all stages but the last keep, and the ids of each, without Spark where a stage decides."""
    model = quality.train(docs, labels, fold(labels["doc_id"], 3) != 1)
    rows = [r for r in docs.collect()]
    scores = quality.Scorer(model).score([r["text"] or "" for r in rows])
    rows = [r for r, s in zip(rows, scores) if s >= 0.5]
    kept = docs.sparkSession.createDataFrame(rows, docs.schema)
    tongue = langid.train(kept, fold(kept["doc_id"], 5) != 0)
    classifier = langid.Classifier(tongue)
    found = [(r, *classifier.predict(r["text"])) for r in rows]
    rows = [r for r, lang, _, margin in found if lang != "und" and margin > 0 and margin >= tongue.min_margin]
    groups = {i: root for i, _, root in brute([(r["doc_id"], r["text"]) for r in rows], 5, 80)}
    return {r["doc_id"]: r["text"] or "" for r in rows if groups[r["doc_id"]] == r["doc_id"]}


def test_pipeline_equals_plain_python(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    kept = expected(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    packed = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        packed.setdefault(r["doc_id"], []).append(r)
    assert set(packed) == set(kept)
    for doc, text in kept.items():
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 1], "<u4")
        pieces = sorted(packed[doc], key=lambda r: r["piece"])
        assert [p["start"] for p in pieces] == list(range(0, len(ids), 4096))
        assert [p["ids_crc32"] for p in pieces] == [zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) for p in pieces]


def test_stages_keep_columns_and_only_drop(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        left = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert left <= kept
        kept = left
    packed = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == kept
    fill = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert fill.where("n > 4096 or n <> end").count() == 0


def test_odd_rows_and_empty_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(None, None, None, None, None), (10**9, None, "en", "s", 0), (10**9, "", None, "s", 0), (10**9 + 1, "x" * 50_000, "en", None, 1), (10**9 + 2, "word " * 40_000, "en", "s", 2), (None, "no id but words", "en", "s", 3)]
    more = docs.union(spark.createDataFrame(odd, docs.schema)).union(docs.where("doc_id < 20"))
    more = more.withColumns({"id": F.lit("x"), "n": F.lit(1), "score": F.lit(2.0), "rank": F.lit("y")})  # names that operators use
    more.write.parquet(f"{tmp_path}/a/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    labels.write.parquet(f"{tmp_path}/a/labels.parquet")
    labels.limit(0).write.parquet(f"{tmp_path}/b/labels.parquet")
    whole = {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()}
    found = corpus_pipeline.run(spark, f"{tmp_path}/a")
    assert {r["doc_id"] for r in found.collect()} & whole and found.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0


def test_every_operator_is_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = entry.queries()["op2_language_id"](spark, sf).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] >= 0.97
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scored = entry.queries()["op10_quality_classifier"](spark, sf).join(labels, "doc_id").where("held_out")
    assert scored.agg(F.avg((F.col("quality") == F.col("predicted")).cast("double"))).first()[0] >= 0.95


def test_pages_are_interleaved(spark):
    rows = entry.queries()["interleaved_pages"](spark, SF)
    assert rows.columns == ["page_id", "position", "kind", "text", "ref", "caption"]
    firsts = rows.groupBy("page_id").agg(F.min("position").alias("lo"), F.max("position").alias("hi"), F.count("*").alias("n"))
    assert firsts.where("lo <> 0 or hi <> n - 1").count() == 0 and firsts.count() > 0
