"""Exact deduplication by progressive refinement: length, then a hash of the prefix, then a hash of the whole text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import SPACE, materialize, only, text_of

#: Characters that the second level hashes.
PREFIX = 256


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, prefix: int = PREFIX) -> DataFrame:
    """Groups of documents with equal normalised text (every run of white space is one space), DataFrame functions only.

    Level 1 groups by length and drops lengths that occur once; level 2 groups what is left by length and a hash of the
    first ``prefix`` characters; level 3 groups what is left by the SHA-256 of the whole text. Each level's groups are
    counted with partial sums and written out, so that the next level's join sees two plain sides whose hot keys AQE can
    split. Only the narrow fingerprints are shuffled, never a text.

    ``digests=False`` hashes whole texts in a second scan, for surviving groups alone (while these are few enough to
    broadcast; else every row's hash is taken in the scan and the narrow rows are joined). ``digests=True`` returns the
    hash of every row, which takes them all in the first scan.

    Returns id, keep_id, group_size, kept and, with digests, text_sha256; one row for each input row. Null and empty
    texts are equal. Rows with a null id count in group_size; keep_id is null only if all ids of the group are. Rows
    that repeat an id and its text are all reported, as kept if theirs is the smallest id. An empty input gives no rows.
    """
    rows = only(docs, id=id_col, text=text_col)
    norm = F.regexp_replace(text_of("text"), SPACE, " ")
    prints = rows.select("id", norm.alias("t")).select("id", F.length("t").alias("n"), F.xxhash64(F.substring("t", 1, prefix)).alias("p"), *([F.sha2("t", 256).alias("h")] if digests else []))
    prints = materialize(prints, "prints")

    by_length = materialize(prints.groupBy("n").count().filter("count > 1").select("n"), "lengths")
    left = prints.join(by_length, "n", "left_semi")
    by_prefix = materialize(left.groupBy("n", "p").count().filter("count > 1").select("n", "p"), "prefixes")

    if digests:
        full = prints.join(by_prefix, ["n", "p"], "left_semi")
    else:
        again = rows.select("id", norm.alias("t")).withColumns({"n": F.length("t"), "p": F.xxhash64(F.substring("t", 1, prefix))})
        few = by_prefix.limit(500_001).count() <= 500_000
        if few:  # the filter runs in the scan, and only survivors are hashed whole
            full = again.join(F.broadcast(by_prefix), ["n", "p"], "left_semi").select("id", "n", "p", F.sha2("t", 256).alias("h"))
        else:
            full = again.select("id", "n", "p", F.sha2("t", 256).alias("h")).join(by_prefix, ["n", "p"], "left_semi")
        full = materialize(full, "hashes")
    groups = materialize(full.groupBy("h").agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("size")).filter("size > 1"), "groups")

    if digests:
        out = prints.join(groups, "h", "left")
    else:
        singles = prints.join(by_prefix, ["n", "p"], "left_anti").select("id", F.lit(None).cast("string").alias("h"))
        out = full.select("id", "h").unionByName(singles).join(groups, "h", "left")
    grouped = F.col("size").isNotNull()
    keep = F.when(grouped, F.col("keep")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        *([F.col("h").alias("text_sha256")] if digests else []),
    )


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact dedup of all documents: null texts count as empty, rows that repeat an id are one of a group each, an
    empty table gives no rows."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), digests=True)


OP1_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, CAST(count(*) OVER g AS BIGINT) AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""
