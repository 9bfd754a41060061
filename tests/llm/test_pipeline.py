"""The pipeline's stages against plain versions, each on what the stage before kept."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lightsieve.llm import quality
from lightsieve.session import materialize
from tests.llm import brute


def test_stages(spark, sf_mid):
    docs = spark.read.parquet(f"{sf_mid}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_mid}/labels.parquet").collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_mid}/benchmark.parquet").collect()]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        columns = docs.columns
        docs = materialize(stage(spark, docs, sf_mid), "stage")
        rows = docs.collect()
        ids = {r["doc_id"] for r in rows}
        kept[name] = ids
        if name == "mixing sources":
            assert ids == {i for i, _ in before} and len(rows) == len(before)
            continue
        assert docs.columns == columns and len(rows) == len(ids)
        if name == "exact dedup":
            assert ids == {i for i, r in brute.deduplicate(before).items() if r[2]}
        elif name == "simhash near-dedup":
            assert ids == {i for i, r in brute.near_components(before).items() if r[1] == i}
        elif name == "benchmark decontamination":
            assert ids == {i for i, r in brute.decontaminate(before, items).items() if not r[4]}
        else:
            good, bad = ([i in ids for i, y in labels.items() if y == label] for label in (1, 0))
            assert sum(good) > 0.95 * len(good) and sum(bad) < 0.35 * len(bad)
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf_mid).collect()} == kept["mixing sources"]


def test_extra_columns_and_nulls(spark):
    rows = [(1, None, "en", None, 5, "x"), (2, "", None, "s", None, "y"), (3, "a b c", "en", "s", 5, "z"), (4, "a b c", "en", "s", 5, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id string")
    for name, stage in corpus_pipeline.STAGES[1:3]:
        docs = materialize(stage(spark, docs, "/root/testdata/sf0.001"), "stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "component_id"]
    assert sorted(r["doc_id"] for r in docs.collect()) == [2, 4]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").count() == 2


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_null_and_repeated_ids(spark, sf_small, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    item = spark.read.parquet(f"{sf_small}/benchmark.parquet").orderBy(F.length("text").desc()).first()["text"]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    words = ["alpha beta gamma delta", "one two three four five", "red green blue black white", "north south east west far"]
    rows = [(None, words[0]), (None, words[1]), (None, words[1]), (5, words[2]), (5, words[2]), (None, words[2]), (7, words[3]), (7, item), (None, item)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], schema)
    if name == "quality classifier":
        docs = spark.read.parquet(f"{sf_small}/documents.parquet").withColumn("doc_id", F.expr("case doc_id % 3 when 0 then null when 1 then 1 else doc_id end"))
        scored = quality.score_quality(docs, spark.read.parquet(f"{sf_small}/labels.parquet"))
        wanted = sorted((-1 if r["doc_id"] is None else r["doc_id"]) for r in scored.filter("keep").collect())
        found = materialize(stage(spark, docs, sf_small), "stage")
        assert found.columns == docs.columns and -1 in wanted
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"]) for r in found.collect()) == wanted
        return
    found = materialize(stage(spark, docs, sf_small), "stage").collect()
    if name == "mixing sources":
        assert len(found) == len(rows)
        return
    kept = sorted(((r["doc_id"] or 0, r["text"]) for r in found))
    if name == "benchmark decontamination":
        assert kept == sorted((i or 0, t) for i, t in rows if t != item)
    else:
        assert kept == sorted([(0, words[0]), (0, words[1]), (5, words[2]), (7, words[3]), (7, item)])


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, _row string, key string, `a.b` string, doc struct<key: string>, `_key` int"


@pytest.mark.parametrize("from_files", [True, False])
def test_columns_of_any_name(spark, tmp_path, from_files):
    """Row keys and whole rows stand apart from the columns, so none clashes and none is lost."""
    text = "some words of a text that stays for all of the stages "
    rows = [(i, text + w, "en", "s", 60, f"r{i}", "k", f"dot{i}", ("x",), i) for i, w in enumerate(["alpha beta", "gamma delta", "one two", "alpha beta"])]
    docs = spark.createDataFrame(rows, CLASHING)
    if from_files:
        docs.write.parquet(f"{tmp_path}/docs")
        docs = spark.read.parquet(f"{tmp_path}/docs")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = materialize(stage(spark, docs, "/root/testdata/sf0.001"), "stage")
        assert docs.columns == columns
    left = {r["doc_id"]: r for r in docs.collect()}
    for i, r in left.items():
        assert (r["_row"], r["a.b"], r["doc"]["key"]) == (f"r{i}", f"dot{i}", "x")
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").count() == len(left)


def small_tables(spark, folder, rows, labels):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "an item of the test set")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(i, 0, 0) for i in range(9)]])
def test_tiny_and_empty_tables(spark, tmp_path, labels):
    rows = [(1, "one text", "en", "s", 8), (2, "another text", "en", None, 12), (None, None, None, None, None)]
    small_tables(spark, f"{tmp_path}/tiny", rows, labels)
    assert sorted(str(r["doc_id"]) for r in corpus_pipeline.run(spark, f"{tmp_path}/tiny").collect()) == ["1", "2", "None"]
    small_tables(spark, f"{tmp_path}/empty", [], labels)
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").collect() == []
