"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and returns what the next one reads."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import toxicity as tox
from quillspark.llm.base import drop_scratch, drop_tables, made_tables, materialize
from quillspark.llm.line_dedup import line_dedup
from quillspark.llm.mixing import mix
from quillspark.llm.near_dedup import near_dedup
from quillspark.llm.packing import pack, vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Scratch tables of the last stage. Its result may still read them, until it is written and the next stage begins.
_left: list = []


def _stage(work: Stage) -> Stage:
    """A stage that first deletes what the stage before it left: that one's result has been written by then."""

    @wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_tables(_left)
        _left.clear()
        before = made_tables()
        out = work(spark, docs, sf_dir)
        _left.extend(t for t in made_tables() if t not in before)
        return out

    return run


@_stage
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. The model is learned from the labelled ones among ``docs``. Rows
    with a null id stay; null texts are scored as empty; rows that repeat an id go together."""
    model = tox.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rejected = tox.toxicity(docs, model).filter("rejected").select("doc_id").distinct()
    return _without(docs, rejected)


def _without(docs: DataFrame, drop: DataFrame) -> DataFrame:
    """``docs`` without the ids of ``drop``, which is broadcast if it is small and joined by shuffling if not."""
    drop = materialize(drop, "dropped")
    if drop.limit(500_001).count() <= 500_000:
        drop = F.broadcast(drop)
    return docs.join(drop, "doc_id", "left_anti").select(*COLUMNS)


@_stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat others, short ones by equal forms, as ``op10_line_dedup`` does; all documents
    stay, some with less text. Null ids and null texts stay as they are; rows that repeat an id are one document."""
    out = line_dedup(docs.select(*COLUMNS), finer=True, short=True)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more. Rows with a null id stay;
    null, empty and blank texts are linked with nothing; rows that repeat an id are one document, and stay or go together."""
    return _without(docs, near_dedup(docs, words=5, percent=80).filter("not kept").select("doc_id").distinct())


@_stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: copies are rows with the same id. A text without words is
    taken once, unless its source has no words at all, which then goes; a null source is a source of its own."""
    taken = mix(docs).filter("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids that hold every document of the mix, a null text as an empty one. Rows that
    repeat an id are documents each."""
    return pack(docs, vocabulary())


STAGES = [("toxicity", toxicity), ("line_dedup", lines), ("near_dedup", near_duplicates), ("mixing", mixture), ("packing", packing)]

#: Models, hashes and tokens are not SQL's to state; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        read, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
            drop_scratch(read)
    return docs
