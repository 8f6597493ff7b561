"""Greedy near-duplicate removal: the first of similar texts stays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS, tokenize, windows
from .scratch import keep

GRAM, SKETCH, BAND = 4, 16, 3
THRESHOLD, MIN_SHINGLES = 0.6, 60


def least_hashes(grams: list[str], n: int = SKETCH) -> np.ndarray:
    """The n smallest FNV-1a hashes (32 bits) of ASCII texts, worked out sign by sign for all of them."""
    size = np.array([len(g) for g in grams], np.int64)
    codes = np.frombuffer("".join(grams).encode("ascii", "replace"), np.uint8)
    start, h = np.cumsum(size) - size, np.full(len(grams), 2166136261, np.uint64)
    for k in range(int(size.max(initial=0))):
        on = np.flatnonzero(size > k)
        h[on] = (h[on] ^ codes[start[on] + k]) * np.uint64(16777619) & np.uint64(0xFFFFFFFF)
    return np.sort(h)[:n].astype(np.int64)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stopwords: list[str] = STOPWORDS) -> DataFrame:
    """id, grams (distinct shingles) and sketch (the smallest hashes, ascending)."""

    @F.pandas_udf("array<long>")
    def sketch(grams: pd.Series) -> pd.Series:
        return grams.map(lambda g: least_hashes(list(g)))

    grams = F.array_distinct(windows(tokenize(F.col(text_col), stopwords), GRAM))
    # written before Python sees them, so that lambdas and the Python step are never one expression
    rows = keep(docs.select(F.col(id_col).alias("id"), grams.alias("grams")))
    return rows.withColumn("sketch", sketch("grams"))


def band_keys(sketch):
    """Keys of consecutive threes of the sketch, with their number; the last hash is in none."""
    return F.filter(F.transform(F.sequence(F.lit(0), F.lit((SKETCH - BAND) // BAND)), lambda b: F.struct(b.alias("band"), F.slice(sketch, b * BAND + 1, BAND).alias("key"))), lambda x: F.size(x["key"]) == BAND)


def _classes(docs: DataFrame, least: int, id_col: str, text_col: str, stopwords: list[str]) -> tuple[DataFrame, DataFrame]:
    """The first text of each class with equal shingles (id, sketch, hs: its shingles' hashes), and the others as pairs
    (a first, b)."""
    mark = F.md5(F.concat_ws("\n", F.array_sort("grams")))
    long = sketches(docs, id_col, text_col, stopwords).filter(F.size("grams") >= least)
    long = keep(long.select("id", "sketch", mark.alias("mark"), F.transform("grams", lambda g: F.xxhash64(g)).alias("hs")))
    first = long.groupBy("mark").agg(F.min_by(F.struct("id", "sketch", "hs"), "id").alias("x")).select("mark", "x.*")
    copies = long.select("id", "mark").join(first.select("mark", F.col("id").alias("a")), "mark").filter("id <> a").select("a", F.col("id").alias("b"))
    return keep(first.drop("mark")), copies


def _refined(large: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Large buckets (bucket, id) cut by shingles: rows (bucket, id, rare).

    Of two sets that share ``threshold`` of the smaller one, some shingle among the smaller one's rarest is in the other:
    those that are left when it loses all it may. So only texts with such a shingle of one of them stay together. ``rare``
    marks the text whose rarest it is among.
    """
    mine = sets.join(large.select("id").distinct(), "id", "left_semi")
    tokens = keep(mine.select("id", F.size("hs").alias("size"), F.explode("hs").alias("t")))
    often = tokens.groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    first = F.row_number().over(Window.partitionBy("id").orderBy("df", "t"))  # a text's own shingles
    rare = keep(tokens.join(often, "t").withColumn("k", first).filter(F.col("k") <= F.col("size") - F.ceil(F.lit(threshold) * F.col("size") - 1e-9) + 1).select("id", "t"))
    keys = large.join(rare, "id").select("bucket", "t").distinct()
    rows = large.join(tokens.select("id", "t"), "id").join(keys, ["bucket", "t"])
    marked = rows.join(rare.withColumn("rare", F.lit(True)), ["id", "t"], "left")
    return marked.select(F.xxhash64("bucket", "t").alias("bucket"), "id", F.coalesce("rare", F.lit(False)).alias("rare"))


def _pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Candidates (a earlier, b later) of rows (bucket, id)."""
    t = a.select("bucket", "id").join(b.select("bucket", F.col("id").alias("y")), "bucket").filter("id <> y")
    return t.select(F.least("id", "y").alias("a"), F.greatest("id", "y").alias("b")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("hs").alias("ga")), "a").join(sets.select(F.col("id").alias("b"), F.col("hs").alias("gb")), "b")
    return both.filter(F.size(F.array_intersect("ga", "gb")) / F.least(F.size("ga"), F.size("gb")) >= threshold).select("a", "b")


def _settled(state: DataFrame, pairs: DataFrame, waiting: DataFrame | None = None) -> DataFrame:
    """State (id, kept, null where undecided) after the walk has gone as far as it can: an id goes if an earlier twin
    stays, and stays if all earlier twins go, unless it is ``waiting`` to be compared with more."""
    left = state.filter("kept is null").count()
    while left:
        s = state.select(F.col("id").alias("a"), F.col("kept").alias("ka"))
        seen = pairs.join(s, "a").groupBy(F.col("b").alias("id")).agg(F.bool_or(F.coalesce("ka", F.lit(False))).alias("out"), F.bool_and(F.coalesce(~F.col("ka"), F.lit(False))).alias("free"))
        t = state.join(seen, "id", "left")
        t = t.withColumn("waits", F.lit(None).cast("boolean")) if waiting is None else t.join(waiting.select("id", F.lit(True).alias("waits")), "id", "left")
        stays = F.coalesce("free", F.lit(True)) & F.col("waits").isNull()
        state = keep(t.select("id", F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("out"), False).when(stays, True).alias("kept")))
        now = state.filter("kept is null").count()
        if now == left:
            break
        left = now
    return state


def greedy(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """Keep in order: an id goes if an earlier one that stays is its twin (pairs a, b). Returns id, kept, same_as, the
    smallest kept twin. The result of the sequential walk, in a join for each link of a chain of twins."""
    pairs = keep(pairs.select("a", "b").distinct())
    state = _settled(keep(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct().withColumn("kept", F.lit(None).cast("boolean"))), pairs)
    same = pairs.join(state.filter("kept").select(F.col("id").alias("a")), "a").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("same_as"))
    out = ids.join(state, "id", "left").join(same, "id", "left")
    return out.select("id", F.coalesce("kept", F.lit(True)).alias("kept"), F.when(~F.coalesce("kept", F.lit(True)), F.col("same_as")).alias("same_as"))


#: Texts of a bucket that are compared with each other; in larger ones, how many first ones are compared with the rest.
SMALL, PROBES = 64, 8


def _keys(first: DataFrame) -> DataFrame:
    """(id, bucket, band): the keys of a text, each with the first band that has it."""
    return first.select("id", F.explode(band_keys(F.col("sketch"))).alias("k")).groupBy("id", F.xxhash64("k.key").alias("bucket")).agg(F.min("k.band").alias("band"))


def _walked(first: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The decisions (id, kept) on texts of different shingles, and the links (a, b) that they rest on.

    Buckets of up to ``SMALL`` texts are compared pair by pair. Larger ones are first cut by rare shingles, which leaves
    texts together that mostly are similar. Where a part still has many, its first undecided ones are compared with all
    after them, and these with no others: what they put out needs no more comparing. So a bucket costs rows in proportion
    to its size for each few texts of it that stay, never a row for each pair.
    """
    keyed = _keys(first).drop("band")
    sizes = keep(keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    shared = keep(keyed.join(sizes, "bucket"))
    small = shared.filter(F.col("n") <= SMALL).drop("n")
    pairs = _pairs(small, small)
    many = None
    large = shared.filter(F.col("n") > SMALL).drop("n")
    if not large.isEmpty():
        parts = keep(_refined(large, first, threshold))
        count = parts.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count_if("rare").alias("heads")).filter("n > 1")
        parts = keep(parts.join(keep(count), "bucket"))
        few = parts.filter(F.col("heads") <= SMALL)
        pairs = pairs.unionByName(_pairs(few.filter("rare"), few)).distinct()
        many = keep(parts.filter(F.col("heads") > SMALL).select("bucket", "id"))
    links = keep(_verified(keep(pairs), first, threshold))
    ids = shared.select("id").distinct()
    state = keep(ids.withColumn("kept", F.lit(None).cast("boolean")))
    while many is not None:
        live = keep(many.join(state.filter("kept is null").select("id"), "id", "left_semi"))
        if live.isEmpty():
            break
        ranked = Window.partitionBy("bucket").orderBy("id")
        probes = keep(live.withColumn("k", F.row_number().over(ranked)).filter(F.col("k") <= PROBES).drop("k"))
        new = _pairs(probes, live).join(links, ["a", "b"], "left_anti")
        links = keep(links.unionByName(_verified(keep(new), first, threshold)))
        waiting = keep(live.join(probes, ["bucket", "id"], "left_anti").select("id").distinct())
        state = _settled(state, links, waiting)
    return _settled(state, links), links


def dedupe(docs: DataFrame, threshold: float = THRESHOLD, least: int = MIN_SHINGLES, id_col: str = "doc_id", text_col: str = "text", stopwords: list[str] = STOPWORDS) -> DataFrame:
    """The walk over texts by id: id, kept, same_as. A text goes if an earlier one that stays shares a key of its sketch
    and ``threshold`` of the smaller one's shingles; ``same_as`` is the first such text, by the keys in their order, then
    by id. Texts of under ``least`` shingles stay. Only the first of texts with equal shingles is decided; the others go:
    as twins of that one if it stays, else of the first text that they meet."""
    first, copies = _classes(docs, least, id_col, text_col, stopwords)
    state, links = _walked(first, threshold)
    stay = keep(state.filter("kept").select(F.col("id").alias("t")))
    met = links.select(F.col("b").alias("id"), F.col("a").alias("t")).unionByName(links.select(F.col("a").alias("id"), F.col("b").alias("t"))).join(stay, "t", "left_semi")
    keys = keep(_keys(first))
    shared = met.join(keys, "id").join(keys.select(F.col("id").alias("t"), "bucket"), ["t", "bucket"])
    met = keep(shared.groupBy("id", "t").agg(F.min("band").alias("band")))
    same = met.filter(F.col("t") < F.col("id")).groupBy("id").agg(F.min_by("t", F.struct("band", "t")).alias("same_as"))
    gone = state.filter("not kept").join(same, "id").select("id", "same_as")
    over = copies.join(state.filter("not kept").select(F.col("id").alias("a")), "a")
    later = over.join(met.select(F.col("id").alias("a"), "t", "band"), "a").filter(F.col("t") < F.col("b")).groupBy(F.col("b").alias("id")).agg(F.min_by("t", F.struct("band", "t")).alias("same_as"))
    alike = copies.join(state.filter("not kept").select(F.col("id").alias("a")), "a", "left_anti").select(F.col("b").alias("id"), F.col("a").alias("same_as"))
    dropped = gone.unionByName(later).unionByName(alike)
    return docs.select(F.col(id_col).alias("id")).join(dropped, "id", "left").select("id", F.col("same_as").isNull().alias("kept"), "same_as")


def drops_by_book(result: DataFrame, books: DataFrame, limit: int = 6) -> DataFrame:
    """How many texts each book lost, most first; ``books`` has id, book."""
    gone = result.filter("not kept").join(books, "id").groupBy("book").agg(F.count(F.lit(1)).alias("drops"))
    return gone.orderBy(F.desc("drops"), "book").limit(limit)
