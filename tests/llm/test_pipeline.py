"""Each stage of the pipeline on what the one before it kept, against a plain restatement."""

import os
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from alertmill.llm import quality
from alertmill.llm.queries import ORACLE_SQL, QUERIES
from tests.llm import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """Rows after each stage, the input first."""
    base, out = tmp_path_factory.mktemp("stages"), []
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out.append(docs)
    for i, (_, step) in enumerate(pipeline.STAGES):
        step(spark, docs, SF).write.parquet(str(base / str(i)))
        docs = spark.read.parquet(str(base / str(i)))
        out.append(docs)
    return out


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_columns(kept):
    assert all(df.columns == kept[0].columns for df in kept[1:-1])


def test_quality_keeps_good_labels(spark, kept):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    ids = {r.doc_id for r in kept[1].select("doc_id").collect()}
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    bad = {r.doc_id for r in labels.where("quality = 0").collect()}
    assert len(good - ids) <= 0.02 * len(good) and len(bad & ids) <= 0.2 * len(bad)
    model = quality.train(kept[0], labels)
    assert ids == {r.doc_id for r in quality.score(kept[0], model).where(F.col("quality") >= quality.KEEP).collect()}


def test_lines_with_columns_of_clashing_names(spark):
    """Columns named as the operator names its own results pass through the stage."""
    rows = [(1, "a line of some length\nanother one here", "en", "s", 3, "k", 7, 9, "r", 5), (2, "a line of some length", "en", "s", 3, "K", 8, 9, "R", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, n_lines int, n_removed int, rest string, id long")
    got = {r.doc_id: r for r in pipeline.single_lines(spark, docs, SF).collect()}
    assert [(got[i].text, got[i].n_chars, got[i].kept, got[i].n_lines, got[i].n_removed, got[i].rest, got[i].id) for i in (1, 2)] == [(rows[0][1], 38, "k", 7, 9, "r", 5), ("", 0, "K", 8, 9, "R", 6)]
    assert pipeline.single_lines(spark, docs.select("text", "doc_id"), SF).columns == ["text", "doc_id"]


def test_lines(kept):
    assert dict(texts(kept[2])) == brute.lines(texts(kept[1]))
    assert kept[2].where("n_chars <> length(text)").count() == 0


def test_one_document_of_each_group(kept):
    before = texts(kept[2])
    assert {i for i, _ in texts(kept[3])} == {c for c, _ in brute.near(before).values()}
    assert set(texts(kept[3])) <= set(before)


def test_benchmark_is_gone(spark, kept):
    cut = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = lambda w: {tuple(w[a : a + 5]) for a in range(len(w) - 4)}
    items = [grams(cut(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaky = {i for i, t in texts(kept[3]) if any(g and len(g & grams(cut(t))) >= 0.8 * len(g) - 1e-9 for g in items)}
    assert {i for i, _ in texts(kept[4])} == {i for i, _ in texts(kept[3])} - leaky and leaky


def test_mix(kept):
    got = kept[5].toPandas()
    assert set(got.doc_id) == {i for i, _ in texts(kept[4])}
    by = got.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert (abs(by.taken - by.target) <= 0.25 * by.target + 60).all() and (got.taken <= 3 * got["size"]).all()


def test_registered():
    assert {re.match(r"op(\d+)_", q)[1] for q in QUERIES} == {str(i) for i in range(1, 14)} and set(ORACLE_SQL) <= set(QUERIES)
    assert [n for n, _ in pipeline.STAGES] == ["quality", "lines", "near_duplicates", "decontamination", "mixing"] and pipeline.ORACLE_SQL is None
