"""Chunks of paragraphs that never cross a chapter, and reading segments of books without chapters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import page_range
from .scan import previous, running
from .scratch import keep

TARGET, MOST, LEAST, CARRY, SEGMENT = 1400, 2100, 120, 600, 26_000


def group_paragraphs(lengths: list[int], target: int = TARGET, most: int = MOST, carry: int = CARRY) -> list[list[int]]:
    """Places of the paragraphs of each chunk of one chapter. A chunk closes before it would pass the target; a short
    last paragraph (under ``carry``) opens the next one too; a paragraph over ``most`` stands alone."""
    out: list[list[int]] = []
    held: list[int] = []
    for k, n in enumerate(lengths):
        if n > most:
            out += [held] * bool(held) + [[k]]
            held = []
            continue
        if held and sum(lengths[i] for i in held) + n > target:
            out.append(held)
            held = held[-1:] if lengths[held[-1]] < carry else []
        held = [*held, k]
    return out + [held] * bool(held)


def chunk(paragraphs: DataFrame, least: int = LEAST) -> DataFrame:
    """Chunks (book, n, chapter, page_start, page_end, pages, text) of paragraphs (book, pos, chapter, page, text).

    Chapters are chunked apart from each other, so each is one group; their stretches and the numbers of the finished
    chunks, without gaps in a book, are prefix scans. No book has to fit a task. Chunks under ``least`` signs are dropped
    before they are numbered.
    """
    given = previous(paragraphs, ["book"], ["pos"], before=F.col("chapter"))
    new = F.coalesce((F.col("before") != F.col("chapter")).cast("int"), F.lit(0))
    parts = running(given, ["book"], ["pos"], stretch=new)  # a chapter that comes back is a new stretch

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                for k, places in enumerate(group_paragraphs([len(p["text"]) for p in r.paragraphs])):
                    own = [r.paragraphs[i] for i in places]
                    text = "\n\n".join(p["text"] for p in own)
                    if len(text.strip()) >= least:
                        rows.append((r.book, r.stretch, k, r.chapter, own[0]["page"], own[-1]["page"], text))
            yield pd.DataFrame(rows, columns=["book", "stretch", "k", "chapter", "page_start", "page_end", "text"])

    kind = dict(paragraphs.dtypes)["book"]
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.col("page").cast("int").alias("page"), "text"))).alias("paragraphs")
    chapters = parts.groupBy("book", "stretch").agg(F.min(F.col("chapter").cast("int")).alias("chapter"), ordered)
    got = chapters.mapInPandas(run, f"book {kind}, stretch long, k int, chapter int, page_start int, page_end int, text string")
    got = running(got, ["book"], ["stretch", "k"], n=F.lit(1))
    return got.withColumns({"n": F.col("n").cast("int"), "pages": page_range(F.col("page_start"), F.col("page_end"))}).select("book", "n", "chapter", "page_start", "page_end", "pages", "text")


def cited(chunks: DataFrame, books: DataFrame, chapters: DataFrame) -> DataFrame:
    """Chunks with id, chapter_label and ref, the line that an answer cites. ``books`` has book, prefix and label;
    ``chapters`` has book, chapter and label; what stands in none is "Hors chapitre"."""
    number = F.col("n").cast("string")
    id_ = F.concat(F.col("prefix"), F.lit("-"), F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number))
    t = chunks.join(books.select("book", "prefix", F.col("label").alias("book_label")), "book").join(chapters.select("book", "chapter", F.col("label").alias("chapter_label")), ["book", "chapter"], "left")
    t = t.withColumn("chapter_label", F.coalesce("chapter_label", F.lit("Hors chapitre")))
    return t.select(id_.alias("id"), *chunks.columns, "chapter_label", F.concat_ws(", ", "book_label", "chapter_label", "pages").alias("ref"))


def segments(paragraphs: DataFrame, most: int = SEGMENT) -> DataFrame:
    """Segments of a book without chapters: a segment closes with the paragraph that brings it to ``most`` signs.

    With ``end`` as the running sum of lengths, a segment that begins at a paragraph ends at the first one whose ``end``
    is ``most`` beyond that of the paragraph before it: for all paragraphs at once, the number of smaller ends, a running
    count over both kinds of values in order. That is where each paragraph points to. The beginnings are what the first
    one points to, and so on; in each round the known ones grow by as many, as pointers are doubled.
    """
    t = running(paragraphs.select("book", "pos", "page", "text"), ["book"], ["pos"], place=F.lit(1), end=F.length("text"))
    t = keep(t)
    ends = t.select("book", F.col("end").alias("value"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("place"))
    asks = t.select("book", (F.col("end") - F.length("text") + most).alias("value"), F.lit(0).alias("kind"), "place")
    found = running(ends.unionByName(asks).withColumn("one", F.col("kind")), ["book"], ["value", "kind", "place"], smaller=F.col("one")).filter("kind = 0")
    jump = keep(found.select("book", "place", (F.col("smaller") + 2).alias("to")).join(t.select("book", F.col("place").alias("to")), ["book", "to"], "left_semi"))
    begun = keep(t.filter("place = 1").select("book", "place"))
    while not jump.isEmpty():
        new = begun.join(jump, ["book", "place"]).select("book", F.col("to").alias("place"))
        begun = keep(begun.unionByName(new).distinct())
        far = jump.select("book", F.col("place").alias("to"), F.col("to").alias("end"))
        jump = keep(jump.join(far, ["book", "to"]).select("book", "place", F.col("end").alias("to")))
    cut = t.join(begun.withColumn("begins", F.lit(1)), ["book", "place"], "left")
    parts = running(cut, ["book"], ["place"], segment=F.col("begins")).groupBy("book", "segment").agg(F.array_sort(F.collect_list(F.struct("place", "page", "text"))).alias("ps"))
    label = F.format_string("Pages %s à %s", F.col("ps")[0]["page"].cast("string"), F.element_at("ps", -1)["page"].cast("string"))
    return parts.select("book", (F.col("segment") - 1).cast("int").alias("segment"), F.col("ps")[0]["page"].cast("int").alias("page"), label.alias("label"), F.array_join("ps.text", "\n\n").alias("text"))


def manifest(chunks: DataFrame) -> DataFrame:
    """Chunks and signs by saga and book, with each saga's and the whole total."""
    t = chunks.rollup("saga", "book").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("text")).alias("chars"), F.grouping_id().alias("level"))
    return t
