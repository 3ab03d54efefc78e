import os

import pytest

import corpus_pipeline
from tidefeed.llm import common, decontaminate, exact_dedup, quality
from tidefeed.llm.registry import ORACLE, QUERIES

from test_similar import slow_components

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def test_stages_decide_what_their_operators_say(spark):
    docs = common.documents(spark, SF)
    ratings, items = quality.ratings_of(spark.read.parquet(f"{SF}/labels.parquet")), spark.read.parquet(f"{SF}/benchmark.parquet")
    says = [
        lambda d: quality.quality(d, ratings).where("selected"),
        lambda d: exact_dedup.duplicate_groups(d).where("kept"),
        lambda d: d.where(~d.doc_id.isin([i for i, x in slow_components([(r.doc_id, r.text) for r in d.collect()]).items() if i != x])),
        lambda d: decontaminate.contamination(d, items).where("not contaminated"),
    ]
    for (_, stage), want in zip(corpus_pipeline.STAGES, says):
        out = common.written(stage(spark, docs, SF), "test")
        assert out.columns == docs.columns
        assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in want(docs).collect())
        assert out.count() <= docs.count() and out.exceptAll(docs).count() == 0
        docs = out
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    whole = corpus_pipeline.run(spark, SF).collect()
    assert sorted(mixed) == sorted(whole) and {r.doc_id for r in mixed} == {r.doc_id for r in docs.collect()}


def test_all_operators_are_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14)) and set(ORACLE) <= set(QUERIES)


def test_odd_input_goes_through(make, spark, tmp_path):
    """Nulls everywhere, repeated rows, empty texts and clashing columns; then nothing at all."""
    rows = [(None, None, None), (1, "", "s"), (2, None, None), (3, "a b c d e f", "s"), (3, "a b c d e f", "s"), (None, "a b c d e f", "s"), (4, "w " * 30_000, "t")]
    docs = make(rows)
    spark.createDataFrame([(None, None, None), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(None, None), (1, "x")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for start, some in ((docs, True), (docs.where("false"), False)):
        out = start
        for _, stage in corpus_pipeline.STAGES:
            before = out
            out = common.written(stage(spark, out, str(tmp_path)), "odd")
            assert out.count() <= before.count() and (out.count() > 0) == some
    assert {r.doc_id for r in corpus_pipeline.exact_stage(spark, docs, "").collect()} == {1, 3, 4}


def test_intermediates_go_but_for_what_is_kept(spark):
    import os

    from tidefeed.llm import common

    def path(df):
        return df.inputFiles()[0].removeprefix("file://").removeprefix("file:")

    with common.scope() as keep:
        a = common.written(spark.range(3), "a")
        b = keep(common.written(a.selectExpr("id + 1 AS id"), "b"))
        gone, table = path(a), common.bucketed(spark.range(5), "c", "id")
        assert table.count() == 5
    assert not os.path.exists(gone) and os.path.exists(path(b)) and sorted(r.id for r in b.collect()) == [1, 2, 3]
