"""BM25: term statistics, scores and the reading limit."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS, deaccent, stem, tokenize
from .scratch import keep, numbered

K1, B = 1.2, 0.75


def terms_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stopwords: list[str] = STOPWORDS) -> DataFrame:
    """Index tokens as rows (doc, term): the rows of :func:`tokenize`, exploded first so that all of it is compiled."""
    words = docs.select(F.col(id_col).alias("doc"), F.explode(F.split(deaccent(F.lower(F.coalesce(F.col(text_col), F.lit("")))), "[^a-z0-9]+")).alias("w"))
    words = words.filter(F.length("w") >= 2)
    if stopwords:
        words = words.filter(~F.col("w").isin(stopwords))
    return words.select("doc", stem(F.col("w")).alias("term"))


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stopwords: list[str] = STOPWORDS) -> DataFrame:
    """Term frequencies (doc, term, tf)."""
    return terms_of(docs, id_col, text_col, stopwords).groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"))


def doc_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stopwords: list[str] = STOPWORDS) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc"), F.size(tokenize(F.col(text_col), stopwords)).cast("long").alias("len"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: n and avgdl."""
    return lengths.agg(F.count(F.lit(1)).alias("n"), (F.sum("len") / F.greatest(F.lit(1), F.count(F.lit(1)))).alias("avgdl"))


def _ranked(hits: DataFrame, n_docs: DataFrame, limit: int | None) -> DataFrame:
    """Scores of (doc, len, term, tf); ``n_docs`` is one row of n and avgdl. Rounded to 6 decimals, then ranked."""
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # a row for each term of the query
    scored = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(n_docs))
    out = scored.groupBy("doc").agg(F.round(F.sum(_idf() * _norm()), 6).alias("score"))
    return out.orderBy(F.desc("score"), "doc").limit(limit) if limit else out


def _wanted(query: DataFrame, stopwords: list[str]) -> DataFrame:
    """The distinct terms of a one-row query; a question has few words."""
    return F.broadcast(query.limit(1).select(F.explode(F.array_distinct(tokenize(F.col("text"), stopwords))).alias("term")))


def bm25(docs: DataFrame, query: DataFrame, limit: int | None = 60, id_col: str = "doc_id", text_col: str = "text", stopwords: list[str] = STOPWORDS) -> DataFrame:
    """Documents by BM25 for a one-row query (text); repeated query terms count once; ties by id.

    Without an index: one pass over the texts counts each document's tokens and those among them that are query terms,
    so what is shuffled are a few narrow rows a document. :func:`search` asks an index instead.
    """
    terms = _wanted(query, stopwords).withColumn("hit", F.col("term"))
    counted = terms_of(docs, id_col, text_col, stopwords).join(terms, "term", "left").groupBy("doc", "hit").agg(F.count(F.lit(1)).alias("tf"))
    found = F.collect_list(F.when(F.col("hit").isNotNull(), F.struct(F.col("hit").alias("term"), "tf")))
    own = counted.groupBy("doc").agg(F.sum("tf").alias("len"), found.alias("hits"))
    total = own.agg(F.sum("len").alias("total")).crossJoin(docs.agg(F.count(F.lit(1)).alias("n")))  # one row each
    stats = total.select("n", (F.coalesce("total", F.lit(0)) / F.greatest(F.lit(1), F.col("n"))).alias("avgdl"))
    hits = own.filter(F.size("hits") > 0).select("doc", "len", F.explode("hits").alias("h")).select("doc", "len", "h.*")
    return _ranked(hits, stats, limit)


class Index(NamedTuple):
    """What a search needs of the texts. ``postings``: doc, term, tf, len (of the document), df (of the term), block.
    ``blocks``: term, block, df, most (the highest share of the score that the term has in a document of the block).
    ``stats``: one row of n, avgdl. A block is a run of ``BLOCK`` documents in order of their ids, the same for all terms."""

    postings: DataFrame
    blocks: DataFrame
    stats: DataFrame


#: Documents in a block; blocks that a search may name in a filter, beyond which it joins with them.
BLOCK, NAMED = 512, 2000


def _norm() -> Column:
    return F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))


def _idf() -> Column:
    return F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stopwords: list[str] = STOPWORDS, block: int = BLOCK) -> Index:
    """The index of some documents (id, text; ids are distinct). ``files.write_corpus`` writes it."""
    found = keep(postings(docs, id_col, text_col, stopwords))
    have = found.groupBy("doc").agg(F.sum("tf").alias("len"))
    lengths = docs.select(F.col(id_col).alias("doc")).join(have, "doc", "left").select("doc", F.coalesce("len", F.lit(0)).cast("long").alias("len"))
    placed = keep(numbered(lengths, [F.col("doc")], "place", "long").select("doc", "len", F.expr(f"(place - 1) div {block}").alias("block")))
    stats = corpus_stats(placed)
    df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rows = keep(found.join(placed, "doc").join(df, "term").select("doc", "term", "tf", "len", "df", "block"))
    blocks = rows.crossJoin(F.broadcast(stats)).groupBy("term", "block").agg(F.first("df").alias("df"), F.max(_norm()).alias("most"))  # stats: one row
    return Index(rows, blocks, stats)


def search(found: Index, query: DataFrame, limit: int | None = 60, stopwords: list[str] = STOPWORDS) -> DataFrame:
    """:func:`bm25` on an index. The question's terms, a few words, become a filter that reaches the scan, which reads the
    pages of these terms only (term is the order on disk).

    With a ``limit``, what a document of a block can score is at most the sum of its terms' highest shares there. The
    blocks with the highest bounds are scored first, until they have ``limit`` documents or more; only blocks whose bound
    reaches the last of these scores are read then.
    """
    terms = [r[0] for r in query.limit(1).select(F.explode(F.array_distinct(tokenize(F.col("text"), stopwords)))).collect()]
    n_docs = F.broadcast(found.stats)  # one row
    mine = found.postings.filter(F.col("term").isin(terms))
    if limit:
        bounds = found.blocks.filter(F.col("term").isin(terms)).crossJoin(n_docs).groupBy("block").agg(F.sum(_idf() * F.col("most")).alias("bound"), F.count(F.lit(1)).alias("k"))
        bounds = keep(bounds)
        first = [r["block"] for r in bounds.orderBy(F.desc("bound"), "block").limit(max(1, limit // 8)).collect()]
        tried = _scores(mine.filter(F.col("block").isin(first)), n_docs).orderBy(F.desc("score"), "doc").limit(limit).collect()
        if len(tried) == limit:
            open_ = bounds.filter(F.col("bound") + 2e-6 >= tried[-1]["score"]).select("block")
            named = [r["block"] for r in open_.limit(NAMED + 1).collect()]
            mine = mine.filter(F.col("block").isin(named)) if len(named) <= NAMED else mine.join(open_, "block", "left_semi")
    out = _scores(mine, n_docs)
    return out.orderBy(F.desc("score"), "doc").limit(limit) if limit else out


def _scores(hits: DataFrame, n_docs: DataFrame) -> DataFrame:
    return hits.crossJoin(n_docs).groupBy("doc").agg(F.round(F.sum(_idf() * _norm()), 6).alias("score"))


def late_filter(ranked: DataFrame, orders: DataFrame, limit: int | None, keep: int = 90) -> DataFrame:
    """The reading limit of the lexical branch: on what the search returned (doc, score), then cut to ``keep``.

    ``orders`` has doc, order; no limit and 0 both mean all.
    """
    near = orders.join(ranked, "doc")
    if limit:
        near = near.filter(F.col("order") <= limit)
    return near.select("doc", "score").orderBy(F.desc("score"), "doc").limit(keep)
