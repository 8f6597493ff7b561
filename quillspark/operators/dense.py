"""Dense search on unit vectors, and the fusion of rankings."""

from __future__ import annotations

import warnings
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import shingles

RRF_K = 60


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles, summed in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense(vectors: DataFrame, query: DataFrame, limit: int = 90, orders: DataFrame | None = None, max_order: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Best rows by cosine (unit vectors: inner product) with a one-row query (q); the reading limit applies before."""
    rows = vectors.select(F.col(id_col).alias("doc"), F.col(vector_col).alias("v"))
    if orders is not None and max_order:
        rows = rows.join(orders.filter(F.col("order") <= max_order).select("doc"), "doc", "left_semi")
    one = F.broadcast(query.select("q").limit(1))
    scored = rows.crossJoin(one).select("doc", F.round(dot(F.col("v"), F.col("q")), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "doc").limit(limit)


def vectors_usable(chunks: DataFrame, vectors: DataFrame) -> bool:
    """Whether there is a vector for each chunk; if not, search is lexical only."""
    return chunks.count() == vectors.count()


def search_pools(chunks: DataFrame, vectors: DataFrame, lexical: DataFrame, semantic: Callable[[], DataFrame]) -> list[tuple[str, DataFrame]]:
    """The rankings that a search fuses: both, or the lexical one alone, with a warning, where the vectors don't match the
    chunks. ``semantic`` is only called if they do."""
    if vectors_usable(chunks, vectors):
        return pools(lexical, semantic())
    warnings.warn("the vectors are out of step with the chunks: the search is lexical only", RuntimeWarning, stacklevel=2)
    return pools(lexical, None)


def ranks(hits: DataFrame, via: str) -> DataFrame:
    """Ranks from 0 of a limited result (doc, score)."""
    order = Window.orderBy(F.desc("score"), "doc")  # over the rows of a limit
    return hits.select("doc", (F.row_number().over(order) - 1).alias("rank"), F.lit(via).alias("via"))


def fuse(*branches: tuple[str, DataFrame], k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: doc, score = sum of 1 / (k + rank + 1), via, and the branches' ranks.

    Ties go to the first branch's rank, then the second's.
    """
    united = None
    for name, hits in branches:
        part = ranks(hits, name)
        united = part if united is None else united.unionByName(part)
    best = [F.min(F.when(F.col("via") == name, F.col("rank"))).alias(f"{name}_rank") for name, _ in branches]
    return united.groupBy("doc").agg(F.round(F.sum(1.0 / (k + 1 + F.col("rank"))), 9).alias("score"), F.array_sort(F.collect_set("via")).alias("via"), *best)


def fused_order(branches: list[str]) -> list[Column]:
    return [F.desc("score"), *[F.col(f"{b}_rank").asc_nulls_last() for b in branches], F.col("doc")]


def capped_walk(hits: DataFrame, limit: int = 14, per_chapter: int = 2, near: float = 0.45) -> DataFrame:
    """Walk ranked hits (pos, doc, order, chapter, text): skip chapters that are full, then texts whose shingles overlap
    a kept one's by more than ``near``; a suppressed hit doesn't fill its chapter. Returns doc, pos of what is kept.

    The walk is sequential over one search's hits (at most two pools of 90), which go to one task.
    """
    rows = hits.select(F.lit(1).alias("one"), "pos", "doc", "order", "chapter", shingles(F.col("text")).alias("grams"))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        kept, full, out = [], {}, []
        for r in pdf.sort_values("pos").itertuples(index=False):
            if len(out) >= limit:
                break
            key, grams = (r.order, r.chapter), set(r.grams)
            if full.get(key, 0) >= per_chapter:
                continue
            if any(g and grams and len(g & grams) / min(len(g), len(grams)) > near for g in kept):
                continue
            full[key] = full.get(key, 0) + 1
            kept.append(grams)
            out.append((r.doc, r.pos))
        return pd.DataFrame(out, columns=["doc", "pos"]).astype("int64")

    return rows.groupBy("one").applyInPandas(walk, "doc long, pos long")


def pools(lexical: DataFrame, semantic: DataFrame | None) -> list[tuple[str, DataFrame]]:
    return [("lexical", lexical)] + ([("semantic", semantic)] if semantic is not None else [])


def chapter_cap(hits: DataFrame, per_chapter: int = 2) -> DataFrame:
    """The cap alone, without the suppression of near twins: a window."""
    w = Window.partitionBy("order", "chapter").orderBy("pos")
    return hits.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= per_chapter).drop("rn")
