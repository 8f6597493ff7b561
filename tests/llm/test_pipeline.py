"""The corpus pipeline: each stage against a plain version over the same input."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from quillspark.llm import queries, toxicity

from test_corpus_operators import check_packing, lines_by_edits, near_by_force


@pytest.fixture(scope="module")
def stages(spark, data, tmp_path_factory):
    docs, out = spark.read.parquet(f"{data}/documents.parquet"), []
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        f(spark, docs, data).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"]
    assert "pipeline" in queries.QUERIES


def test_toxicity_drops_what_it_rejects(spark, data, stages):
    docs, out = stages[0]
    model = toxicity.train(docs, spark.read.parquet(f"{data}/labels.parquet"))
    want = {r["doc_id"] for r in toxicity.toxicity(docs, model).filter("not rejected").collect()}
    assert {i for i, _ in texts(out)} == want and out.columns == docs.columns


def test_lines(stages):
    docs, out = stages[1]
    assert dict(texts(out)) == lines_by_edits(texts(docs))


def test_near_duplicates(stages):
    docs, out = stages[2]
    low, _ = near_by_force(texts(docs), 5, 80)
    assert {i for i, _ in texts(out)} == {i for i, c in low.items() if i == c}


def test_mixing_repeats_documents(stages):
    docs, out = stages[3]
    had = dict(texts(docs))
    assert all(had[i] == t for i, t in texts(out))
    assert out.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3


def test_packing(stages):
    docs, out = stages[4]
    rows = out.collect()
    assert sum(r["piece"] == 0 for r in rows) == docs.count()
    used = {}
    for r in rows:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in used.values():
        end = 0
        for at, n in sorted(own):
            assert at == end
            end += n
        assert end <= 2048
    assert check_packing
