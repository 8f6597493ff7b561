"""The published index: what a search reads, and what readers see while it is published anew."""

import re

import pytest
from pyspark.sql import functions as F

from quillspark.operators import lexical
from quillspark.plans.tables import question, table
from quillspark.sources import files


@pytest.fixture(scope="module")
def corpus(spark, data, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "corpus")
    docs = table(spark, data, "documents").select("doc_id", "text")
    files.write_corpus(docs, lexical.index(docs, block=16), path)
    return path


def ranked(df):
    return [(r["doc"], r["score"]) for r in df.collect()]


@pytest.mark.parametrize("limit", [1, 5, 60, None])
@pytest.mark.parametrize("item", [0, 3, 11])
def test_same_as_without_an_index(spark, data, corpus, limit, item):
    q = question(spark, data, item)
    got = ranked(lexical.search(files.read_index(spark, corpus), q, limit))
    want = ranked(lexical.bm25(table(spark, data, "documents"), q, limit))
    assert sorted(got) == sorted(want)
    assert limit is None or got == want


def test_a_question_without_known_words(spark, corpus):
    for text in ("", "qqqqzz xxyyzz", None):
        q = spark.createDataFrame([(text,)], "text string")
        assert lexical.search(files.read_index(spark, corpus), q, 5).count() == 0


def scanned(df):
    """Rows that scans of postings put out, by the plan's own counts."""
    rows = df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found = []

    def walk(node):
        if node.getClass().getSimpleName() == "FileSourceScanExec" and "tf:" in node.simpleString(1000):
            found.append((node.metrics().apply("numOutputRows").value(), node.simpleString(1000)))
        if node.getClass().getSimpleName() in ("AdaptiveSparkPlanExec",):
            walk(node.executedPlan())
        elif hasattr(node, "plan") and node.getClass().getSimpleName().endswith("QueryStageExec"):
            walk(node.plan())
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    walk(plan)
    return rows, found


def test_terms_reach_the_scan(spark, tmp_path, data):
    """The scan is told the terms, and reads few of the postings."""
    docs = table(spark, data, "documents").select("doc_id", "text")
    path = str(tmp_path / "corpus")
    files.write_corpus(docs, lexical.index(docs, block=16), path)
    index = files.read_index(spark, path)
    rare = index.postings.groupBy("term").count().filter("count between 2 and 3").orderBy("term").first()["term"]
    q = spark.createDataFrame([(rare,)], "text string")
    df = lexical.search(index, q, None, stopwords=[])
    rows, found = scanned(df)
    total = index.postings.count()
    assert rows and found
    assert all(re.search(r"PushedFilters: \[[^]]*(In\(term|EqualTo\(term)", text) for _, text in found)
    assert total > 20_000 and sum(n for n, _ in found) <= 0.05 * total


def test_blocks_out_of_reach_are_not_read(spark, tmp_path):
    """A word that all texts have, and often in one block: the other blocks' bounds are lower than its scores."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id").between(160, 175), F.concat(F.lit("wolf wolf wolf wolf x"), "id")).otherwise(F.concat(F.lit("wolf hill moss fern x"), "id")).alias("text"))
    path = str(tmp_path / "corpus")
    files.write_corpus(docs, lexical.index(docs, block=16), path)
    q = spark.createDataFrame([("wolf",)], "text string")
    df = lexical.search(files.read_index(spark, path), q, 10)
    rows, found = scanned(df)
    assert [r["doc"] for r in rows] == list(range(160, 170))
    assert all("EqualTo(block,10)" in text for _, text in found)


def test_tables_are_published_as_one(spark, tmp_path):
    path = str(tmp_path / "corpus")
    one = lambda n: spark.range(n)
    assert files.current(spark, path) is None
    first = files.publish({"a": one(1), "b": one(1)}, path)
    held = files.published(spark, path, "a")
    with pytest.raises(OSError, match="without c"):
        files.publish({"a": one(2), "b": one(2)}, path, expected=["a", "b", "c"])
    assert files.current(spark, path).endswith(first.rsplit("/", 1)[1])

    def broken(_):
        raise ValueError("no")

    bad = spark.range(2).select(F.udf(broken, "long")("id").alias("id"))
    with pytest.raises(Exception, match="no"):
        files.publish({"a": one(3), "b": bad}, path)
    assert [files.published(spark, path, t).count() for t in "ab"] == [1, 1]
    files.publish({"a": one(4), "b": one(4)}, path)
    assert [files.published(spark, path, t).count() for t in "ab"] == [4, 4]
    assert held.count() == 1  # a reader of the version before
    files.publish({"a": one(5), "b": one(5)}, path)
    assert len(files.folders(spark, path)) == 2


def test_there_is_a_version_at_any_time(spark, tmp_path):
    """A reader that never stops sees whole versions, one after the other."""
    import threading

    path, seen, stop = str(tmp_path / "corpus"), [], threading.Event()
    made = [files.publish({"a": spark.range(1), "b": spark.range(1)}, path)]

    def read():
        while not stop.is_set():
            seen.append(files.current(spark, path))

    reader = threading.Thread(target=read)
    reader.start()
    try:
        made += [files.publish({"a": spark.range(n), "b": spark.range(n)}, path) for n in (2, 3, 4)]
    finally:
        stop.set()
        reader.join()
    last = [f.rsplit("/", 1)[1] for f in seen]
    assert last == sorted(last) and set(last) <= {m.rsplit("/", 1)[1] for m in made} and len(set(last)) >= 2


def test_what_a_killed_publication_left_goes_with_the_next(spark, tmp_path):
    path = str(tmp_path / "corpus")
    files.publish({"a": spark.range(1)}, path)
    spark.range(9).write.parquet(f"{path}/v-{9:020d}-abcdefgh/a")  # no marker
    assert files.published(spark, path, "a").count() == 1
    files.publish({"a": spark.range(2)}, path)
    assert len(files.folders(spark, path)) == 2
    assert files.published(spark, path, "a").count() == 2
