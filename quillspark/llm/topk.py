"""Exact top-k search by inner product: columnar branch-and-bound over blocks of dimensions."""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import materialize, only

#: Numbers in a block's vectors (so long vectors make blocks of fewer), bands of norms, dimensions added at a time.
VALUES, BANDS, STEP = 1 << 21, 16, 8
#: Room for rounding in bounds.
SLACK = 1 + 1e-9
#: Queries that share one pass over dense columns.
CHUNK = 64


def search_block(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, step: int = STEP, floors: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(query, candidate, score) of each query's k best of these candidates, ties to smaller ids, its own id left out.
    Scores below a query's floor, where that is known, are left out.

    Candidates lie in vertical layout. Inner products are summed ``step`` dimensions at a time; by Cauchy-Schwarz, what
    the remaining dimensions can add is at most the product of the two remaining norms. A candidate whose bound is below
    the k-th best of some scores known exactly is out; the survivors' columns are compacted once they are few.
    """
    order = np.argsort(c_ids, kind="stable")
    c_ids, c = c_ids[order], c[order]
    n, d = c.shape
    most = int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0)) * max(1, d)
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64 if most < 1 << 63 else object
    fq, fc = q.astype(np.float64), c.astype(np.float64)
    dims = np.argsort(-((fq**2).sum(0) * (fc**2).sum(0)), kind="stable")
    q, v = q[:, dims].astype(kind), np.ascontiguousarray(c[:, dims].T.astype(kind))
    tail = lambda m: np.sqrt(np.cumsum((m[:, dims] ** 2)[:, ::-1], axis=1)[:, ::-1]) * SLACK
    q_tail, c_tail = tail(fq), np.ascontiguousarray(tail(fc).T)
    out = []
    for lo in range(0, len(q), CHUNK):
        qs = q[lo : lo + CHUNK]
        score, at = np.zeros((len(qs), n), kind), 0
        floor = np.full(len(qs), -np.inf) if floors is None else floors[lo : lo + CHUNK].copy()
        alive = c_ids[None, :] != q_ids[lo : lo + CHUNK, None]
        while at < d:
            end = min(at + step, d)
            score = score + qs[:, at:end] @ v[at:end]
            at = end
            if at == step or at == d:
                for i in range(len(qs)):  # exact scores of the most promising give the first floor
                    live = np.flatnonzero(alive[i])
                    if len(live) > k:
                        part = score[i][live]
                        try_ = live[np.argpartition(-part, min(4 * k, len(part) - 1))[: 4 * k]]
                        exact = score[i][try_] + qs[i, at:] @ v[at:, try_] if at < d else score[i][try_]
                        floor[i] = max(floor[i], float(np.sort(exact)[-k]))
            if at < d:
                alive &= score + q_tail[lo : lo + CHUNK, at, None] * c_tail[at] >= floor[:, None]
                if alive.mean() < 0.3:
                    break
        for i in range(len(qs)):
            live, s, a = np.flatnonzero(alive[i]), score[i][alive[i]], at
            while a < d and len(live):
                end = min(a + step, d)
                s = s + qs[i, a:end] @ v[a:end, live]
                a = end
                if a < d:
                    stay = s + q_tail[lo + i, a] * c_tail[a, live] >= floor[i]
                    live, s = live[stay], s[stay]
            live, s = live[s >= floor[i]], s[s >= floor[i]]
            best = np.lexsort((c_ids[live], -s))[:k]
            out += [(int(q_ids[lo + i]), int(c_ids[live[b]]), int(s[b])) for b in best]
    return out


def top_k(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, values: int = VALUES, least_rows: int = 512) -> DataFrame:
    """The ``k`` best candidates of each query by inner product of floor(scale * x), over all rows but the query's own.

    ``is_query`` is a condition on the id column. Candidates are cut into bands by their norm and, by a hash, into cells of
    about ``values`` numbers. Each query first meets one cell of the largest norms, whose k-th best is a floor for the
    rest: as a score is at most the product of both norms, a query goes on to the bands alone that can still reach its
    floor. Queries that reach equally far share blocks, so a cell is sent to the blocks that need it and to no others. A
    task holds one cell and one block of queries, whatever the length of the vectors, and returns at most k rows for a
    query; a window takes the best of them. Vectors meet those of equal length only. Where all norms are alike, the floor
    still prunes inside the cells, but no band is ruled out.

    Returns query_id, rank (from 1), vec_id, score; fewer than k rows where there are fewer candidates. Rows with a null
    id or vector, an empty vector, or a null or non-finite component take no part. Rows that repeat an id are candidates
    and queries each: the others of its id are among a query's candidates, and each such query has its own ranks. A score beyond a 64-bit integer is an error.
    """
    rows = only(vectors, id=id_col, v=vector_col).filter("id is not null and v is not null and size(v) > 0")
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    square = lambda x: F.pow(F.floor(x.cast("double") * scale).cast("double"), F.lit(2.0))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + square(x)))
    rows = materialize(rows.withColumns({"d": F.size("v"), "norm": norm, "q": F.coalesce(is_query(F.col("id")), F.lit(False)), "row": F.monotonically_increasing_id()}), "vectors")
    total, edges = rows.agg(F.count(F.lit(1)), F.percentile_approx("norm", [i / BANDS for i in range(1, BANDS)], 1000)).first()
    cell = max(least_rows, ceil(total / rows.sparkSession.sparkContext.defaultParallelism))
    size = F.greatest(F.lit(1), F.least(F.lit(cell), F.floor(F.lit(values) / F.col("d"))))  # rows of a cell, queries of a block
    parts = F.ceil(F.col("n") / size).cast("int")
    mix = F.pmod(F.xxhash64("row"), F.lit(1 << 32))
    band = sum(((F.col("norm") <= e).cast("int") for e in sorted(set(edges or []))), F.lit(0))  # 0: the largest norms

    rows = rows.withColumn("band", band)
    bands = rows.groupBy("d", "band").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("top"))
    bands = materialize(bands.select("d", "band", "top", parts.alias("cells")), "bands")  # BANDS rows for a length at most
    lengths = bands.groupBy("d").agg(F.min("band").alias("first"), F.array_sort(F.collect_list(F.struct("band", "top", "cells"))).alias("bands"))
    placed = rows.join(bands.drop("top"), ["d", "band"]).join(lengths.drop("bands"), "d").withColumn("sub", (mix % F.col("cells")).cast("int"))
    seed = (F.col("band") == F.col("first")) & (F.col("sub") == 0)
    vector = ["d", "row", "id", "v"]

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        got = []
        if len(a) and len(b):
            b = b.sort_values(["id", "row"], ignore_index=True)  # places stand for ids from here on: ties go to the smaller
            own = {row: at for at, row in enumerate(b["row"])}
            ints = lambda x: np.floor(float(scale) * np.stack(x["v"].to_numpy()).astype(np.float64)).astype(np.int64)
            q_at = np.array([own.get(row, -1 - k) for k, row in enumerate(a["row"])], np.int64)
            ask_of = dict(zip(q_at.tolist(), zip(a["row"], a["id"], strict=True), strict=True))
            ids = b["id"].to_numpy(np.int64)
            got = [(*ask_of[q], ids[c], s) for q, c, s in search_block(q_at, ints(a), np.arange(len(b)), ints(b), k, floors=a["floor"].to_numpy(np.float64))]
        return pd.DataFrame(got, columns=["row", "query_id", "vec_id", "score"]).astype("int64")

    def met(ask: DataFrame, cand: DataFrame, *keys: str) -> DataFrame:
        ask = ask.select(*[F.col(c).alias(c) for c in ask.columns])  # both sides stem from one table
        return ask.groupBy(*keys).cogroup(cand.groupBy(*keys)).applyInPandas(meet, "row long, query_id long, vec_id long, score long")

    asks = rows.filter("q").drop("band")
    blocks = materialize(asks.groupBy("d").agg(F.count(F.lit(1)).alias("n")).select("d", parts.alias("blocks")), "blocks")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    begun = asks.join(blocks, "d").withColumns({"block": (mix % F.col("blocks")).cast("int"), "floor": F.lit(float("-inf"))})
    start = materialize(met(begun.select(*vector, "block", "floor"), placed.filter(seed).join(blocks, "d").select(*vector, each("blocks").alias("block")), "d", "block"), "start")

    floors = start.groupBy("row").agg(F.when(F.count(F.lit(1)) >= k, F.min("score").cast("double")).alias("floor"))
    # A score is a whole number; past 2**53 its double may be rounded up, so the floor gives way a little.
    floor = F.coalesce(F.col("floor") - F.abs("floor") * 1e-12, F.lit(float("-inf")))
    far = F.array_max(F.transform(F.filter("bands", lambda b: b["top"] * F.col("norm") * SLACK >= F.col("floor")), lambda b: b["band"]))
    left = asks.join(floors, "row", "left").withColumn("floor", floor).join(lengths, "d").withColumn("reach", far).filter("reach is not null")
    left = materialize(left.select(*vector, "floor", "reach"), "left")
    reaches = materialize(left.groupBy("d", "reach").agg(F.count(F.lit(1)).alias("n")).select("d", "reach", parts.alias("blocks")), "reaches")
    both = bands.join(reaches, "d").filter("band <= reach")
    to_cells = both.groupBy("d", "reach", "blocks").agg(F.collect_list(F.struct("band", "cells")).alias("to"))
    to_blocks = both.groupBy("d", "band").agg(F.collect_list(F.struct("reach", "blocks")).alias("to"))
    ask = left.join(to_cells, ["d", "reach"]).withColumn("block", (mix % F.col("blocks")).cast("int"))
    ask = ask.select(*vector, "floor", "reach", "block", F.explode("to").alias("t")).select(*vector, "floor", "reach", "block", "t.band", "t.cells")
    ask = ask.select(*vector, "floor", "reach", "block", "band", each("cells").alias("sub"))
    cand = placed.filter(~seed).join(to_blocks, ["d", "band"]).select(*vector, "band", "sub", F.explode("to").alias("t"))
    cand = cand.select(*vector, "band", "sub", "t.reach", "t.blocks").select(*vector, "band", "sub", "reach", each("blocks").alias("block"))
    rest = met(ask, cand, "d", "band", "sub", "reach", "block")

    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return start.unionByName(rest).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors for each vector whose id is divisible by 50; see :func:`top_k` for nulls, ties and
    repeated ids."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 50 == 0)


OP3_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.rid <> c.rid AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
