"""Quality rules: a table of thresholds, compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import SPACE, only, text_of

#: Frequent function words of the languages that the stop-word rule judges.
STOP_WORDS = {
    "en": "the of and to in is that it as was for with on be by this at he are or had not but from which you his an a".split(),
    "fr": "de la le les des et en un une du que qui dans est pour pas par sur au ne se ce il elle plus avec".split(),
    "es": "el la los las de del y en un una que se por con para su al es lo como más o no".split(),
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass".split(),
}
#: Characters that count as symbols, starts of a list item, ends of a broken-off line.
SYMBOLS = "[#*$%&|<>]"
BULLET, ELLIPSIS = r"^[\x20\x09]*[-*•–]", r"(\.\.\.|…)[\x20\x09\x0D]*$"


@dataclass(frozen=True)
class Rule:
    """100 * ``part`` must lie between ``least`` and ``most`` times ``whole``; both are columns of :func:`measures`."""

    name: str
    part: str
    whole: str
    least: int | None = None
    most: int | None = None

    def broken(self) -> Column:
        part, whole = 100 * F.col(self.part), F.col(self.whole)
        bounds = [part < self.least * whole] * (self.least is not None) + [part > self.most * whole] * (self.most is not None)
        return bounds[0] if len(bounds) == 1 else bounds[0] | bounds[1]


#: What every text must meet, then the verdict on those that do. Percentages of words or of lines that hold a word.
BASE = (Rule("repeated_words", "n_repeat_words", "n_words", most=20),)
LEAST_WORDS = 10
RULES = (
    Rule("word_length", "word_chars", "n_words", least=200, most=3000),
    Rule("symbols", "n_symbols", "n_words", most=20),
    Rule("exclamations", "n_exclamations", "n_words", most=50),
    Rule("capitals", "n_capitals", "word_chars", most=40),
    Rule("stop_words", "n_stop_words", "n_judged_words", least=5),
    Rule("repeated_lines", "n_dup_lines", "n_lines", most=50),
    Rule("list_items", "n_list_lines", "n_lines", most=90),
    Rule("broken_off_lines", "n_broken_lines", "n_lines", most=30),
)


#: Each word of a text with single spaces, and the words behind it that make a window. Possessive, so linear in the text.
WINDOW = 5
WINDOWS = r"(?<!\S)(?=(\S++" + r" \S++" * (WINDOW - 1) + r"))\S++"


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id and the counts that rules speak of, as longs, one row for each row of ``docs``; no shuffle, no Python.

    A text's windows are compared in its own row, so cost and memory are those of the text: only where some are equal are
    they sorted, and neighbours compared. A step's columns are used by several expressions of the next, which keeps the
    steps apart and each column computed once.
    """
    count = lambda items, test: F.size(F.filter(items, test)).cast("long")
    t = only(docs, doc_id=id_col, text=text_col, lang=lang_col).withColumn("text", text_of())
    t = t.withColumns({"norm": F.trim(F.regexp_replace("text", SPACE, " ")), "lines": F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    bare = F.length(F.replace("norm", F.lit(" "), F.lit("")))
    t = t.withColumns({"word_chars": bare, "n": F.when(F.col("norm") == "", 0).otherwise(F.length("norm") - bare + 1), "windows": F.regexp_extract_all("norm", F.lit(WINDOWS), F.lit(1))})
    own = lambda words: lambda w: F.lower(w).isin(words)
    stop = F.coalesce(*[F.when(F.col("lang") == lang, count(F.split("norm", " "), own(words))) for lang, words in STOP_WORDS.items()], F.lit(0))
    placed = F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    t = t.select(
        "doc_id", F.col("n").cast("long").alias("n_words"), F.col("word_chars").cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"), F.regexp_count("text", F.lit("!")).cast("long").alias("n_exclamations"),
        F.length(F.regexp_replace("text", r"\P{Lu}+", "")).cast("long").alias("n_capitals"),
        stop.cast("long").alias("n_stop_words"), F.when(F.col("lang").isin(list(STOP_WORDS)), F.col("n")).otherwise(0).cast("long").alias("n_judged_words"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        count("lines", lambda x: x.rlike(BULLET)).alias("n_list_lines"), count("lines", lambda x: x.rlike(ELLIPSIS)).alias("n_broken_lines"),
        F.when(F.size(F.array_distinct("windows")) < F.size("windows"), placed).otherwise(F.array().cast("array<struct<x: string, i: int>>")).alias("placed"),
    )
    beside = F.arrays_zip(F.col("placed").alias("a"), F.slice("placed", 2, F.greatest(F.size("placed"), F.lit(1))).alias("b"))
    same = F.filter(beside, lambda z: z["a"]["x"] == z["b"]["x"])
    t = t.withColumn("starts", F.sort_array(F.array_distinct(F.flatten(F.transform(same, lambda z: F.array(z["a"]["i"], z["b"]["i"])))))).drop("placed")
    ahead = F.arrays_zip(F.col("starts").alias("a"), F.slice("starts", 2, F.greatest(F.size("starts"), F.lit(1))).alias("b"))
    covered = F.aggregate(ahead, F.lit(0).cast("long"), lambda acc, z: acc + F.least(F.lit(WINDOW), F.coalesce(z["b"] - z["a"], F.lit(WINDOW))))
    return t.withColumn("n_repeat_words", covered).drop("starts")


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row for each row of ``docs``, repeated ids and null ids too: doc_id, the counts of :func:`measures`,
    base_failed, failed (names of broken rules in order, joined by commas) and kept.

    A text fails the base with under ``LEAST_WORDS`` words or by ``BASE``; so do null, empty and blank texts. It is kept
    if neither the base nor a rule of the table is broken. The stop-word rule judges texts whose ``lang`` has a list in
    ``STOP_WORDS``; other and null languages pass it. An empty table gives an empty result; further columns of the input
    play no part, whatever their names.
    """
    t = measures(docs, id_col, text_col, lang_col)
    base = F.col("n_words") < LEAST_WORDS
    for rule in BASE:
        base = base | rule.broken()
    names = F.array_compact(F.array(*[F.when(r.broken(), F.lit(r.name)) for r in rules])) if rules else F.array().cast("array<string>")
    t = t.withColumns({"base_failed": base, "failed": F.array_join(names, ",")})
    return t.withColumn("kept", ~F.col("base_failed") & (F.col("failed") == ""))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`quality_rules` on all documents: the contract's columns, the line and stop-word counts, and the broken rules."""
    t = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return t.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words", "failed")


def _in(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


OP12_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, doc_id, lang, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), win AS (
  SELECT rid, i, array_to_string(words[i : i + 4], ' ') AS x FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM w)
), rep AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, x) AS k FROM win) WHERE k > 1
), cov AS (
  SELECT rid, CAST(sum(least(5, coalesce(nxt - i, 5))) AS BIGINT) AS n_repeat_words
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM rep) GROUP BY rid
), m AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '{SYMBOLS}')) AS BIGINT) AS n_symbols, len(regexp_extract_all(text, '!')) AS n_exclamations,
    length(regexp_replace(text, '\P{{Lu}}+', '', 'g')) AS n_capitals,
    CAST(CASE {" ".join(f"WHEN lang = '{k}' THEN len(list_filter(words, lambda x: lower(x) IN ({_in(v)})))" for k, v in STOP_WORDS.items())} ELSE 0 END AS BIGINT) AS n_stop_words,
    CASE WHEN lang IN ({_in(list(STOP_WORDS))}) THEN len(words) ELSE 0 END AS n_judged_words,
    CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '{BULLET}'))) AS n_list_lines, len(list_filter(lines, lambda x: regexp_matches(x, '{ELLIPSIS}'))) AS n_broken_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN cov USING (rid)
), v AS (
  SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 20 * n_words AS base_failed, concat_ws(',', {", ".join(
    "CASE WHEN " + " OR ".join([f"100 * {r.part} < {r.least} * {r.whole}"] * (r.least is not None) + [f"100 * {r.part} > {r.most} * {r.whole}"] * (r.most is not None)) + f" THEN '{r.name}' END"
    for r in RULES)}) AS failed
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed = '' AS kept, n_lines, n_stop_words, failed FROM v
"""
