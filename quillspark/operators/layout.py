"""From raw pages to chapters and paragraphs.

What looks only at a line and its page is a window or a column expression. What depends on all that came before is a
prefix scan: places, paragraphs and chapters are running sums of what opens them, page numbers are transitions of blocks of
pages, composed block by block. Paragraphs are then put together each by itself. No book has to fit a task.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import header_key, letters_only, overlap, trigrams
from .scan import running
from .scratch import keep

#: Fixed patterns of the page format.
FOLIO = r"^\s*[-–—]?\s*(\d{1,4})\s*[-–—]?\s*$"
ALONE = r"(?i)^\s{4,}(?:Chapitres?\s+)?(\d{1,3})\s*[.．]?\s*$"
INLINE = r"^\s{4,}(\d{1,3})\s*[.．]\s+(\S.{0,60})$"
PROLOGUE = r"(?i)^\s*(?:prologue|avant[-\s]?propos|[ée]pilogue)\s*$"
LOST_CAPITAL = r"^(?![AÀYOÔ]\s)([A-ZÀ-Ý])\s+(?=[a-zà-ÿ])"
#: Most chapters of a book; how far in a title under its number stands; prose that opens a book without headings.
MOST_CHAPTERS, CENTRED, PROSE_RUN, PROSE_CHARS, PARAGRAPH_CHARS = 99, 8, 3, 120, 25


def pages(texts: DataFrame, book: str = "book", text: str = "text") -> DataFrame:
    """(book, page_no, text) from whole texts with form feeds between pages."""
    return texts.select(F.col(book).alias("book"), F.posexplode(F.split(F.col(text), "\f")).alias("page_no", "text"))


def lines(page_rows: DataFrame) -> DataFrame:
    """(book, page_no, line_no, raw, text, indent), trailing space gone."""
    rows = page_rows.select("book", "page_no", F.posexplode(F.split("text", "\n")).alias("line_no", "raw")).withColumn("raw", F.regexp_replace("raw", r"\s+$", ""))
    text = F.trim(F.regexp_replace("raw", r"^\s+", ""))
    return rows.withColumns({"text": text, "indent": F.when(F.length("raw") > 0, F.length("raw") - F.length(text)).otherwise(0)})


def recurring_headers(line_rows: DataFrame) -> DataFrame:
    """(book, form): first lines of pages that recur on at least 6 % of the book's pages and on 8 of them."""
    w = Window.partitionBy("book", "page_no").orderBy("line_no")
    first = line_rows.filter("text <> ''").withColumn("rn", F.row_number().over(w)).filter("rn = 1")
    n_pages = first.groupBy("book").agg(F.count(F.lit(1)).alias("pages"))
    forms = first.withColumn("form", header_key(F.col("text"))).filter("form is not null").groupBy("book", "form").agg(F.count(F.lit(1)).alias("n"))
    return forms.join(n_pages, "book").filter(F.col("n") >= F.greatest(F.lit(8), F.floor(F.col("pages") * 0.06 + 0.5))).select("book", "form")


def without_headers(line_rows: DataFrame, forms: DataFrame) -> DataFrame:
    """Drop running headers: a known form at a page's top; there, indented, a distorted one (overlap of trigrams 0.6);
    anywhere, indented, one nearly equal (0.85)."""
    w = Window.partitionBy("book", "page_no").orderBy("line_no")
    top = F.sum(F.when(F.col("text") != "", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    known = forms.groupBy("book").agg(F.collect_set("form").alias("forms"))  # at most 1 / 0.06 forms for a book
    t = line_rows.withColumns({"at_top": F.coalesce(top, F.lit(0)) == 0, "key": header_key(F.col("text"))}).join(known, "book", "left")
    best = F.array_max(F.transform("forms", lambda f: overlap(trigrams(f), trigrams(F.col("key")))))
    header = F.col("key").isNotNull() & F.col("forms").isNotNull() & (
        (F.col("at_top") & F.array_contains("forms", F.col("key"))) | ((F.col("indent") >= 3) & ((F.col("at_top") & (best >= 0.6)) | (best >= 0.85))))
    return t.filter(~F.coalesce(header, F.lit(False))).drop("at_top", "key", "forms")


def body_indent(line_rows: DataFrame) -> DataFrame:
    """The most frequent indent of each book's lines; the one seen first on ties."""
    n = line_rows.filter("text <> ''").groupBy("book", "indent").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("page_no", "line_no")).alias("first"))
    return n.groupBy("book").agg(F.min_by("indent", F.struct((-F.col("n")).alias("m"), "first")).alias("base"))


def page_tops(line_rows: DataFrame, depth: int = 3) -> DataFrame:
    w = Window.partitionBy("book", "page_no").orderBy("line_no")
    return line_rows.filter("text <> ''").withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= depth).drop("rn")


def placed(line_rows: DataFrame) -> DataFrame:
    """Lines with their place in the book (pos, from 1) and among its lines with text (shown), if they have none yet."""
    if "pos" in line_rows.columns:
        return line_rows
    return running(line_rows, ["book"], ["page_no", "line_no"], pos=F.lit(1), shown=(F.col("text") != "").cast("int"))


def _ahead(some: DataFrame, line_rows: DataFrame, steps: int) -> DataFrame:
    """``some`` lines with those that follow (ahead: step, text, indent, in order; none beyond the book's end)."""
    want = some.select("book", "pos", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step")).withColumn("at", F.col("pos") + F.col("step"))
    there = line_rows.select("book", F.col("pos").alias("at"), "text", "indent")
    found = want.join(there, ["book", "at"]).groupBy("book", "pos").agg(F.array_sort(F.collect_list(F.struct("step", "text", "indent"))).alias("ahead"))
    return some.join(found, ["book", "pos"], "left")


def unnumbered_headings(line_rows: DataFrame) -> DataFrame:
    """Lines in capitals near a page's top, indented, short, without end punctuation and with a blank line after."""
    t = placed(line_rows)
    letters = F.regexp_replace("text", "[^A-Za-zÀ-ÿŒœ]", "")
    capitals = F.length(F.regexp_replace(letters, "[^A-ZÀ-ÝŒ]", ""))
    good = (F.col("indent") >= 6) & F.length("text").between(3, 50) & ~F.col("text").rlike(r'[.!?…,;:»"]$') & ~F.col("text").rlike("^[—–-]") & (F.length(letters) >= 3) & (capitals >= 0.7 * F.length(letters))
    found = _ahead(page_tops(t).filter(good), t, 1)
    return found.filter(F.coalesce(F.col("ahead")[0]["text"], F.lit("")) == "").select("book", "page_no", "line_no", "text")


def numbered_headings(line_rows: DataFrame) -> DataFrame:
    """Numbers near a page's top, with a title on the same line or centred on one of the next three."""
    t = placed(line_rows)
    inline, alone = F.regexp_extract("raw", INLINE, 1), F.regexp_extract("raw", ALONE, 1)
    number = F.try_to_number(F.nullif(F.when(inline != "", inline).otherwise(alone), F.lit("")), F.lit("999")).cast("int")
    tops = page_tops(t).withColumn("number", number).filter(F.col("number") <= MOST_CHAPTERS).join(body_indent(t), "book")
    below = F.filter("ahead", lambda x: x["text"] != "")[0]
    centred = (F.length(below["text"]) <= 70) & (below["indent"] >= F.col("base") + CENTRED)
    title = F.when(F.regexp_extract("raw", INLINE, 1) != "", F.regexp_extract("raw", INLINE, 2)).when(centred, below["text"]).otherwise("")
    return _ahead(tops, t, 3).select("book", "page_no", "line_no", "number", title.alias("title"))


def increasing(numbers: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence: the first end of that length, and before each member the
    earliest one a place shorter and smaller.

    Places are dealt by the length of the longest run that ends at them; within a length numbers never rise, so both the
    length of a new place and the earliest smaller one before it are found by bisection.
    """
    by_length: list[list[int]] = []
    for k, n in enumerate(numbers):
        at = bisect_left(by_length, n, key=lambda places: numbers[places[-1]])
        if at == len(by_length):
            by_length.append([])
        by_length[at].append(k)
    if not by_length:
        return []
    out = [by_length[-1][0]]
    for places in reversed(by_length[:-1]):
        out.append(places[bisect_right(places, -numbers[out[-1]], key=lambda k: -numbers[k])])
    return out[::-1]


def longest_run(headings: DataFrame) -> DataFrame:
    """Headings of each book whose numbers form the longest increasing subsequence."""
    schema = headings.schema

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["page_no", "line_no"], ignore_index=True)
        return pdf.iloc[increasing(pdf["number"].tolist())]

    return headings.groupBy("book").applyInPandas(pick, schema)


#: Pages in a block of the scan over a book's pages; how far a printed number may be off the count.
PAGES, SLACK = 256, 2


def page_transition(numbers: list[int | None]) -> tuple[dict[int, int], int]:
    """What a run of pages makes of the count before it: counts that meet a printed number with where they end, all
    others end so many pages further on. The second value is where a count of 0 ends, which takes any first number.

    With e = number - place, a count c goes on until the first page whose e is at most ``SLACK`` from c; from there it is
    that page's. So the pages are gone through from the last, keeping for each c the next page that it meets.
    """
    n = len(numbers)
    meets: dict[int, int] = {}
    end = first = n
    for k in range(n, 0, -1):
        if numbers[k - 1] is not None:
            e = numbers[k - 1] - k
            end = meets.get(e, e + n)
            meets.update({c: end for c in range(e - SLACK, e + SLACK + 1)})
        if k == 1:
            first = end if numbers[0] is not None else meets.get(0, n)
    return meets, first


def printed_pages(line_rows: DataFrame) -> DataFrame:
    """(book, page_no, folio line or -1, printed page): a page's last line is its number if it carries on the count by
    at most two off; else the count goes on by itself. Pages without text have none."""
    kind = dict(line_rows.dtypes)["book"]
    last = line_rows.filter("text <> ''").groupBy("book", "page_no").agg(F.max_by(F.struct("line_no", "raw"), "line_no").alias("x"))
    n = F.try_to_number(F.nullif(F.regexp_extract("x.raw", FOLIO, 1), F.lit("")), F.lit("9999")).cast("int")
    t = running(last.select("book", "page_no", "x.line_no", F.when(n.between(1, 1999), n).alias("n")), ["book"], ["page_no"], place=F.lit(1))
    t = keep(t.withColumn("block", F.expr(f"(place - 1) div {PAGES}")))
    numbers = lambda pdf: [None if pd.isna(x) else int(x) for x in pdf.sort_values("place")["n"]]

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        meets, first = page_transition(numbers(pdf))
        return pd.DataFrame([(pdf["book"].iloc[0], pdf["block"].iloc[0], len(pdf), first, list(meets), list(meets.values()))], columns=["book", "block", "n", "first", "met", "ends"])

    def composed(pdf: pd.DataFrame) -> pd.DataFrame:
        count, out = 0, []
        for r in pdf.sort_values("block").itertuples(index=False):
            out.append((r.book, r.block, count))
            count = r.first if r.block == 0 else dict(zip(r.met, r.ends, strict=True)).get(count, count + r.n)
        return pd.DataFrame(out, columns=["book", "block", "start"])

    def counted(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, out = pdf.sort_values("place", ignore_index=True), []
        count = int(pdf["start"].iloc[0])
        for book, page_no, line_no, n in pdf[["book", "page_no", "line_no", "n"]].itertuples(index=False):
            real = not pd.isna(n) and (count == 0 or abs(n - count - 1) <= SLACK)
            count = int(n) if real else count + 1
            out.append((book, page_no, line_no if real else -1, count))
        return pd.DataFrame(out, columns=["book", "page_no", "folio_line", "printed"])

    sums = t.groupBy("book", "block").applyInPandas(summed, f"book {kind}, block long, n int, first int, met array<int>, ends array<int>")
    starts = sums.groupBy("book").applyInPandas(composed, f"book {kind}, block long, start int")
    return t.join(starts, ["book", "block"]).groupBy("book", "block").applyInPandas(counted, f"book {kind}, page_no int, folio_line int, printed int")


def contents_cut(line_rows: DataFrame) -> DataFrame:
    """Lines before the table of contents: its heading is looked for in the last 40 % of a book."""
    t = placed(line_rows)
    n = t.groupBy("book").agg(F.count(F.lit(1)).alias("n"))
    marks = t.filter(letters_only(F.col("text")) == "tabledesmatieres").select("book", "pos").join(n, "book").filter((F.col("pos") - 1) > 0.6 * F.col("n"))
    return t.join(marks.groupBy("book").agg(F.max("pos").alias("cut")), "book", "left").filter("cut is null or pos < cut").select(*line_rows.columns)


def vocabulary(texts: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) of words that don't end a line, their outer signs trimmed; œ counts as such a sign."""
    line = F.explode(F.split(F.col(text), "\n")).alias("l")
    words = texts.select(line).select(F.filter(F.split(F.trim("l"), r"\s+"), lambda w: w != "").alias("ws"))
    inner = words.select(F.explode(F.slice("ws", 1, F.greatest(F.size("ws") - 1, F.lit(0)))).alias("w"))
    key = F.regexp_replace(F.lower("w"), "^[^a-zà-ÿ-]+|[^a-zà-ÿ-]+$", "")
    return inner.select(key.alias("word")).filter(F.length("word") >= 2).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def join_lines(first: str, then: str, counts: dict[str, int]) -> str:
    """Two lines of a paragraph as one. A hyphen at the end goes if the word is at least as frequent without it."""
    cut = re.search(r"([A-Za-zÀ-ÿ]+)[-‑¬­]$", first)
    rest = re.match(r"[A-Za-zÀ-ÿ]+", then)
    if not first or not cut or not rest:
        return f"{first} {then}" if first else then
    whole, split = (cut[1] + rest[0]).lower(), f"{cut[1]}-{rest[0]}".lower()
    return (first[:-1] if counts.get(whole, 0) >= counts.get(split, 0) else first) + then


def openers(body: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines that open chapters (book, pos, number, title), and lines (book, pos) that only repeat a heading's title under
    its number. Headings are the longest increasing run of numbers, or, if that has under five and there are more of them,
    the unnumbered ones, counted; prologue and epilogue lines open chapters without a number."""
    places = body.select("book", "page_no", "line_no", "pos", "shown", "raw")
    ruled = longest_run(numbered_headings(body)).withColumn("free", F.lit(False))
    nth = F.row_number().over(Window.partitionBy("book").orderBy("page_no", "line_no"))  # headings only
    free = unnumbered_headings(body).select("book", "page_no", "line_no", nth.alias("number"), F.col("text").alias("title"), F.lit(True).alias("free"))
    both = keep(ruled.unionByName(free))
    sizes = both.groupBy("book").agg(F.count_if(~F.col("free")).alias("ruled"), F.count_if("free").alias("loose"))
    use = sizes.select("book", ((F.col("ruled") < 5) & (F.col("loose") > F.col("ruled"))).alias("free"))
    heads = keep(both.join(use, ["book", "free"]).join(places, ["book", "page_no", "line_no"]).select("book", "pos", "shown", "raw", "number", "title"))
    under = heads.filter(F.col("raw").rlike(ALONE) & (F.col("title") != "")).select("book", (F.col("shown") + 1).alias("shown"), F.col("title").alias("text"))
    repeats = body.filter("text <> ''").select("book", "shown", "text", "pos").join(under, ["book", "shown", "text"], "left_semi").select("book", "pos")
    marked = body.filter(F.col("text").rlike(PROLOGUE)).select("book", "pos", F.lit(None).cast("int").alias("number"), F.col("text").alias("title"))
    marked = marked.join(heads, ["book", "pos"], "left_anti")
    return heads.select("book", "pos", "number", "title").unionByName(marked), repeats


def _assembled(parts: DataFrame, vocab: DataFrame, kind: str) -> DataFrame:
    """Paragraphs (book, pid, opened, page, text) from their lines (book, pid, opened, pos, printed, text)."""
    lines_ = F.array_sort(F.collect_list(F.struct("pos", "text", "printed")))
    whole = keep(parts.groupBy("book", "pid").agg(F.max("opened").alias("opened"), lines_.alias("ls")).select("book", "pid", "opened", F.col("ls")[0]["printed"].alias("page"), F.col("ls.text").alias("ls")))
    joints = whole.select("book", "pid", F.explode(F.arrays_zip(F.col("ls").alias("a"), F.slice("ls", 2, F.size("ls")).alias("b"))).alias("z"))
    head, tail = F.regexp_extract("z.a", "([A-Za-zÀ-ÿ]+)[-‑¬­]$", 1), F.regexp_extract("z.b", "^([A-Za-zÀ-ÿ]+)", 1)
    words = joints.select("book", "pid", head.alias("h"), tail.alias("t")).filter("h <> '' and t <> ''").select("book", "pid", F.explode(F.array(F.lower(F.concat("h", "t")), F.lower(F.concat_ws("-", "h", "t")))).alias("word")).distinct()
    known = words.join(vocab, "word").groupBy("book", "pid").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("counts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for ls, counts in zip(batch["ls"], batch["counts"], strict=True):
                text = ""
                for line in ls:
                    text = join_lines(text, line, counts or {})
                texts.append(re.sub(LOST_CAPITAL, r"\1", re.sub(r"\s+", " ", text).strip()))
            yield batch[["book", "pid", "opened", "page"]].assign(text=texts)

    return whole.join(known, ["book", "pid"], "left").mapInPandas(run, f"book {kind}, pid long, opened long, page int, text string")


def parse_books(texts: DataFrame, vocab: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """:func:`parse_pages` of whole texts (book, text) with form feeds between pages."""
    return parse_pages(pages(texts), vocabulary(texts) if vocab is None else vocab)


def parse_pages(page_rows: DataFrame, vocab: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Chapters (book, chapter, number, title, page) and paragraphs (book, pos, chapter, page, text) of books by pages
    (book, page_no, text). A paragraph ends at a blank line, at a line that is indented further than the body, and where a
    chapter opens; ``openers`` says where that is. Front matter before the first heading is left out. In a book without any
    numbers the text begins at three long paragraphs in a row, in chapter -1, or at its first opening line, whichever comes
    first.

    The number of breaks up to a line names its paragraph, the number of openings its chapter: both are running sums.
    """
    kind = dict(page_rows.dtypes)["book"]
    raw = lines(page_rows)
    printed = printed_pages(raw)
    body = without_headers(raw, recurring_headers(raw)).join(printed, ["book", "page_no"]).filter("line_no <> folio_line")
    body = keep(contents_cut(placed(body)))
    opens, repeats = openers(body)
    base = body_indent(body)
    marked = body.join(repeats, ["book", "pos"], "left_anti").join(opens.withColumn("opens", F.lit(1)), ["book", "pos"], "left").join(base, "book", "left")
    breaks = (F.col("text") == "") | F.col("opens").isNotNull() | (F.col("indent") > F.col("base") + 1)
    placed_ = running(marked.select("book", "pos", "text", "printed", "opens", "number", "title", breaks.cast("int").alias("breaks")), ["book"], ["pos"], pid=F.col("breaks"), opened=F.col("opens"))
    heads = placed_.filter("opens is not null")
    chapters = heads.select("book", (F.col("opened") - 1).cast("int").alias("chapter"), "number", "title", F.col("printed").alias("page"))

    about = heads.groupBy("book").agg(F.bool_or(F.col("number").isNotNull()).alias("numbered"), F.min("pid").alias("first"))
    found = _assembled(placed_.filter("opens is null and text <> ''"), vocabulary(page_rows) if vocab is None else vocab.select("word", "n"), kind)
    found = keep(found.join(about, "book", "left").withColumn("numbered", F.coalesce("numbered", F.lit(False))).filter("not numbered or opened > 0"))
    long = found.filter(~F.col("numbered") & (F.length("text") >= PROSE_CHARS) & (F.col("first").isNull() | (F.col("pid") < F.col("first")))).select("book", "pid")
    starts = long
    for k in range(1, PROSE_RUN):
        starts = starts.join(long.withColumn("pid", F.col("pid") - k), ["book", "pid"], "left_semi")
    begin = found.select("book", "first").distinct().join(starts.groupBy("book").agg(F.min("pid").alias("run")), "book", "left").select("book", F.least("first", "run").alias("begin"))
    kept = found.join(begin, "book").filter((F.col("pid") >= F.col("begin")) & (F.length("text") >= PARAGRAPH_CHARS))
    out = running(kept.select("book", "pid", "opened", "page", "text"), ["book"], ["pid"], pos=F.lit(1))
    return chapters, out.select("book", (F.col("pos") - 1).cast("int").alias("pos"), (F.col("opened") - 1).cast("int").alias("chapter"), "page", "text")


def chapter_label(number, title):
    """Number and title of a chapter as one label; titles that a scan garbled are left out."""
    from ..functions.text import readable_title

    return F.when(number.isNull(), title).when(readable_title(F.coalesce(title, F.lit(""))), F.concat(F.lit("Chapitre "), number.cast("string"), F.lit(" — "), title)).otherwise(F.concat(F.lit("Chapitre "), number.cast("string")))


def prose_start(paragraphs: DataFrame, run: int = PROSE_RUN, chars: int = PROSE_CHARS) -> DataFrame:
    """The first of ``run`` long paragraphs in a row, for each book: gaps and islands."""
    w = Window.partitionBy("book").orderBy("pos")
    t = paragraphs.withColumn("long", F.length("text") >= chars)
    t = t.withColumn("island", F.row_number().over(w) - F.sum(F.col("long").cast("int")).over(w)).filter("long")
    runs = t.groupBy("book", "island").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("start")).filter(F.col("n") >= run)
    return runs.groupBy("book").agg(F.min("start").alias("start"))
