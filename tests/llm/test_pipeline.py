"""The pipeline's stages on odd rows and clashing columns, each against a plain version of
what it keeps."""

import pytest
from pyspark.sql import functions as F

from loamgraph.llm.mixing import mix_sources
from loamgraph.llm.near_dedup import keep_one, near_duplicates
from loamgraph.llm.quality import quality
from loamgraph.llm.toxicity import toxicity
from loamgraph.runtime import ship, table

pipeline = pytest.importorskip("corpus_pipeline")

LONG = "one two three four five six seven eight nine ten eleven twelve"


@pytest.fixture(scope="module")
def clashing(spark):
    ship(spark)
    rows = [(1, LONG, "a"), (1, LONG, "a"), (1, "other words here", "a"), (2, LONG, "b"), (3, None, None), (4, "", "a"), (None, LONG, "b"), (5, "w " * 20_000, "b"), (6, " \t", None), (None, "alone", "b")]
    names = "doc_id long, text string, source string"
    extra = ("size", "target", "copies", "taken", "kept_id", "score", "label", "mix_key", "key", "row_key", "rows")
    frame = spark.createDataFrame(rows, names)
    return frame.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))) for c in extra})


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_all_columns_as_they_are(spark, sf, clashing, stage):
    f = pipeline.STAGES[stage][1]
    out = f(spark, clashing, sf)
    assert out.columns == clashing.columns
    rows = {tuple(r) for r in clashing.collect()}
    assert {tuple(r) for r in out.collect()} <= rows
    assert f(spark, clashing.limit(0), sf).count() == 0


def test_near_copies_by_hand(spark, clashing):
    got = sorted((str(r["doc_id"]), (r["text"] or "")[:6]) for r in keep_one(clashing, width=5).collect())
    want = [(1, LONG), (1, "other words here"), (3, ""), (4, ""), (5, "w w w "), (6, " \t"), (None, "alone")]
    assert got == sorted((str(i), t[:6]) for i, t in want)


def test_near_copies_keep_one_row_of_each_class(spark, sf):
    docs = table(spark, sf, "documents")
    found = near_duplicates(docs, width=5)
    want = {r["component_id"] for r in found.where("n_shingles > 0").collect()}
    kept = [r["doc_id"] for r in keep_one(docs, width=5).where("text rlike '[^ \\\\t\\\\n]'").collect()]
    assert sorted(kept) == sorted(want)


def test_filters_keep_what_the_classifiers_pass(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    for stage, f in ((pipeline.drop_toxic, lambda: toxicity(docs, labels).where("predicted = 0")), (pipeline.drop_poor, lambda: quality(docs, labels).where("predicted = 1"))):
        assert {r["doc_id"] for r in stage(spark, docs, sf).collect()} == {r["doc_id"] for r in f().collect()}


def test_mix_repeats_rows_as_often_as_it_takes_them(spark, sf):
    docs = table(spark, sf, "documents")
    want = {r["doc_id"]: r["copies"] for r in mix_sources(docs).collect() if r["copies"]}
    got = {r["doc_id"]: r["count"] for r in pipeline.mix(spark, docs, sf).groupBy("doc_id").count().collect()}
    assert got == want
