"""The entity register: roll-up of mentions, name maps, matching of names in queries and passages, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import distinctive, fold, tokenize, windows
from .lexical import bm25
from .scratch import numbered

# --- roll-up of mentions (ord, chapter, name, kind, role) --------------------------------------------------------------


def roll_up(mentions: DataFrame) -> DataFrame:
    """Entities by folded name: key, canonical (most frequent variant, the first seen on ties), kind (first seen),
    variants (map of counts), books (sorted), notes (in order), n_notes, first_seen."""
    m = mentions.withColumn("key", fold(F.col("name"))).filter(F.length("key") > 0)
    order = F.struct("ord", "chapter", "name")
    by_form = m.groupBy("key", "name").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ord", "chapter")).alias("at"))
    forms = by_form.groupBy("key").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "n")))).alias("variants"),
        F.min_by("name", F.struct((-F.col("n")).alias("n"), "at", "name")).alias("canonical"),
    )
    rest = m.groupBy("key").agg(
        F.min_by("kind", order).alias("kind"), F.array_sort(F.collect_set("ord")).alias("books"),
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "chapter", "role"))), lambda x: x["role"]).alias("notes"),
        F.count(F.lit(1)).alias("n_notes"), F.min("ord").alias("first_seen"),
    )
    return forms.join(rest, "key")


def fold_headwords(entities: DataFrame, kinds: str = "kind") -> DataFrame:
    """key → target: "x de y" goes to "x" if there is an x of the same kind."""
    head = F.regexp_replace("key", r" (?:de|du|des|d|of) .*$", "")
    a = entities.select("key", F.col(kinds).alias("k"), head.alias("head")).filter("head <> key")
    b = entities.select(F.col("key").alias("target"), F.col(kinds).alias("k2"))
    return a.join(b, (F.col("head") == F.col("target")) & (F.col("k") == F.col("k2"))).select("key", "target")


def fold_plurals(entities: DataFrame, kinds: str = "kind") -> DataFrame:
    """key → target: a key that ends in s goes to the key without it, if that is of the same kind."""
    a = entities.filter(F.col("key").endswith("s")).select("key", F.col(kinds).alias("k"), F.substring("key", F.lit(1), F.length("key") - 1).alias("stem"))
    b = entities.select(F.col("key").alias("target"), F.col(kinds).alias("k2"))
    return a.join(b, (F.col("stem") == F.col("target")) & (F.col("k") == F.col("k2"))).select("key", "target")


def apply_merges(mentions: DataFrame, merges: DataFrame) -> DataFrame:
    """Mentions (key, ...) under their target's key: variants, books and notes then add up in the roll-up."""
    return mentions.join(merges, "key", "left").withColumn("key", F.coalesce("target", "key")).drop("target")


def merge_groups(groups: DataFrame, entities: DataFrame) -> DataFrame:
    """key → target from groups (canonical, members array): members of the canonical entity's kind only."""
    g = groups.select(F.col("canonical").alias("target"), F.explode("members").alias("key")).filter("key <> target")
    k = entities.select("key", "kind")
    t = entities.select(F.col("key").alias("target"), F.col("kind").alias("tkind"))
    return g.join(k, "key").join(t, "target").filter("kind = tkind").select("key", "target")


def supported(entities: DataFrame, least: int = 3) -> DataFrame:
    """Entities of enough mentions, most first."""
    return entities.filter(F.col("n_notes") >= least).orderBy(F.desc("n_notes"), "key")


def sample_evenly(rows: DataFrame, key: str, order: list[str], most: int = 60) -> DataFrame:
    """Every ceil(n / most)-th row of a key with over ``most`` rows."""
    w = Window.partitionBy(key)
    n = F.count(F.lit(1)).over(w)
    step = F.when(n > most, F.ceil(n / most)).otherwise(1)
    return rows.withColumns({"_r": F.row_number().over(w.orderBy(*order)) - 1, "_step": step}).filter("_r % _step = 0").drop("_r", "_step")


def evidence(rows: DataFrame, key: str, naming: str, order: list[str], most: int = 30) -> DataFrame:
    """Mentions that name the other side, all of them, then evenly spaced others up to ``most`` in all."""
    w = Window.partitionBy(key)
    named = F.count_if(F.col(naming)).over(w)
    others = F.count_if(~F.col(naming)).over(w)
    room = F.greatest(F.lit(0), most - named)
    r = F.row_number().over(Window.partitionBy(key, naming).orderBy(*order)) - 1
    t = rows.withColumns({"_room": room, "_others": others, "_r": r})
    filler = (F.col("_room") > 0) & (F.floor(F.col("_r") * F.col("_room") / F.col("_others")) > F.floor((F.col("_r") - 1) * F.col("_room") / F.col("_others")))
    return t.filter(F.col(naming) | filler).drop("_room", "_others", "_r")


# --- name maps of entries (idx, id, name, aliases, kind, books, ...) ---------------------------------------------------


def with_distinctive_aliases(entries: DataFrame) -> DataFrame:
    """Entries as they are used: aliases that name no one alone are filtered when read, not when built."""
    return entries.withColumn("aliases", F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: distinctive(a)))


def _names(entries: DataFrame) -> DataFrame:
    name = entries.select("idx", F.lit(0).alias("pos"), fold(F.col("name")).alias("key"))
    alias = entries.select("idx", F.posexplode("aliases").alias("pos", "alias")).select("idx", (F.col("pos") + 1).alias("pos"), fold(F.col("alias")).alias("key"))
    return name.unionByName(alias)


def search_names(entries: DataFrame) -> DataFrame:
    """key → idx for search: the first entry's name or alias wins, keys of three letters or more. An early alias beats a
    later name."""
    return _names(entries).filter(F.length("key") >= 3).groupBy("key").agg(F.min_by("idx", F.struct("idx", "pos")).alias("idx"))


def relation_names(entries: DataFrame) -> DataFrame:
    """key → idx for relations: names beat aliases; the last of equal names, the first of equal aliases."""
    n = _names(entries)
    rank = F.when(F.col("pos") == 0, F.struct(F.lit(0).alias("t"), (-F.col("idx")).alias("i"), F.lit(0).alias("p"))).otherwise(F.struct(F.lit(1).alias("t"), F.col("idx").alias("i"), F.col("pos").alias("p")))
    return n.groupBy("key").agg(F.min_by("idx", rank).alias("idx"))


def kin_names(entries: DataFrame) -> DataFrame:
    """key → idx for kinship: in entry order a name always takes the key, an alias only a free one. So the last name
    wins over any alias; without a name, the first alias."""
    return relation_names(entries)


def relation_targets(relations: DataFrame, entries: DataFrame) -> DataFrame:
    """Relations (idx, name, nature) with target, the id of the entry they name, or null."""
    names = relation_names(entries).select("key", F.col("idx").alias("t")).join(entries.select(F.col("idx").alias("t"), F.col("id").alias("target")), "t").drop("t")
    return relations.withColumn("key", fold(F.col("name"))).join(names, "key", "left").drop("key")


# --- matching -----------------------------------------------------------------------------------------------------------


def name_hits(query: str | Column, names: DataFrame) -> DataFrame:
    """Names in a query by whole words (100 + length), or one edit off a word (one-word names of five letters or more,
    90 + length). Of an entry's names the last in map order that matches sets its score: later ones overwrite."""
    q = fold(F.lit(query) if isinstance(query, str) else query)
    words = F.filter(F.split(q, " "), lambda w: w != "")
    whole = F.contains(F.concat(F.lit(" "), q, F.lit(" ")), F.concat(F.lit(" "), F.col("key"), F.lit(" ")))
    near = ~F.contains(F.col("key"), F.lit(" ")) & (F.length("key") >= 5) & F.exists(words, lambda w: (F.abs(F.length(w) - F.length("key")) <= 1) & (F.levenshtein(w, F.col("key"), 1) == 1))
    score = F.when(whole, 100 + F.length("key")).when(near, 90 + F.length("key"))
    hit = names.withColumn("score", score.cast("double")).filter("score is not null")
    return hit


def ordered_names(entries: DataFrame) -> DataFrame:
    """:func:`search_names` with ord, the place at which a key entered the map."""
    n = _names(entries).filter(F.length("key") >= 3)
    first = n.groupBy("key").agg(F.min(F.struct("idx", "pos")).alias("at"))
    return first.select("key", F.col("at.idx").alias("idx"), "at")


def search_cards(query: str, entries: DataFrame, limit: int = 4, max_order: int | None = None) -> DataFrame:
    """Entries for a query: names first, then BM25 over the cards' prose (card_text). Returns idx, score, exact."""
    hits = name_hits(query, ordered_names(entries)).groupBy("idx").agg(F.max_by("score", "at").alias("score")).withColumn("exact", F.lit(True))
    texts = entries.select("idx", card_text(entries.columns).alias("text"))
    spark = entries.sparkSession
    found = bm25(texts, spark.createDataFrame([(query,)], "text string"), limit * 3, "idx", "text").withColumnRenamed("doc", "idx").withColumn("exact", F.lit(False))
    out = hits.unionByName(found.join(hits, "idx", "left_anti"))
    if max_order:
        out = out.join(entries.filter(F.exists("books", lambda b: b <= max_order)).select("idx"), "idx", "left_semi")
    return out.orderBy(F.desc("score"), "idx").limit(limit)


def card_text(have: list[str] = ()) -> Column:
    """A card as prose; empty parts are left out. ``have`` names the columns there are of arc, relations (array of name,
    nature) and volumes (array with full, a volume's label)."""
    parts = [
        F.concat(F.col("name"), F.lit(" — "), F.col("kind")),
        F.when(F.size("aliases") > 0, F.concat(F.lit("Aussi appelé : "), F.array_join("aliases", ", "))),
        F.col("gloss"), F.col("description"),
    ]
    if "arc" in have:
        parts.append(F.when(F.length("arc") > 0, F.concat(F.lit("Évolution : "), F.col("arc"))))
    if "relations" in have:
        named = F.transform("relations", lambda r: F.concat(r["name"], F.lit(" ("), r["nature"], F.lit(")")))
        parts.append(F.when(F.size("relations") > 0, F.concat(F.lit("Liens : "), F.array_join(named, ", "))))
    if "volumes" in have:
        parts.append(F.concat(F.lit("Tomes : "), F.array_join(F.transform("volumes", lambda v: v["full"]), " · ")))
    return F.concat_ws("\n", *[F.when(F.length(p) > 0, p) for p in parts])


def volumes_within(volumes: Column, max_order: int | None) -> Column:
    """A card's volumes (array with order) up to the reading limit; without one, all."""
    return F.filter(volumes, lambda v: v["order"] <= max_order) if max_order else volumes


def few_relations(relations: Column, most: int = 4) -> Column:
    return F.slice(relations, 1, most)


def other_names(aliases: Column, name: Column) -> Column:
    """Aliases, each once and in order, without the entry's own name."""
    return F.filter(F.array_distinct(aliases), lambda a: a != name)


def reading_order(*sagas: DataFrame) -> DataFrame:
    """Book lists (pos, ...) of sagas, one after the other, with order, the place of a book from 1."""
    out = None
    for k, books in enumerate(sagas):
        part = books.withColumn("saga", F.lit(k + 1))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("order", F.row_number().over(Window.orderBy("saga", "pos")))  # a catalogue of some dozen books


def with_book(rows: DataFrame, books: DataFrame) -> DataFrame:
    """Rows (order) with their book's columns. A row of no known book is an error."""
    return rows.join(books.withColumn("_known", F.lit(True)), "order", "left").withColumn("_known", F.when(F.col("_known").isNull(), F.raise_error(F.concat(F.lit("no book at place "), F.col("order").cast("string")))).otherwise(True)).filter("_known").drop("_known")


def passage_counts(passages: DataFrame, names: DataFrame, least: int = 4) -> DataFrame:
    """How often names of four letters or more stand in folded passages (text), as whole words; idx, n.

    Instead of trying each name on each passage, the passages' runs of words up to the longest name's are joined with
    the names by equality.
    """
    long = names.filter(F.length("key") >= least).withColumn("w", F.size(F.split("key", " ")))
    widths = [r[0] for r in long.select("w").distinct().orderBy("w").collect()]  # a few numbers of words
    words = passages.select(F.split(fold(F.col("text")), " ").alias("ws"))
    runs = None
    for w in widths:
        part = words.select(F.explode(windows(F.col("ws"), w)).alias("key"))
        runs = part if runs is None else runs.unionByName(part)
    if runs is None:
        return names.select("idx", F.lit(0).cast("long").alias("n")).limit(0)
    return runs.groupBy("key").agg(F.count(F.lit(1)).alias("n")).join(long, "key").groupBy("idx").agg(F.sum("n").alias("n"))


def merge_hits(from_query: DataFrame, from_passages: DataFrame, limit: int = 6) -> DataFrame:
    """Exact hits of the query, then the passages' by count, then the query's rest; each entry once."""
    a = from_query.select("idx", "score", F.when(F.col("exact"), 0).otherwise(2).alias("prio"))
    b = from_passages.select("idx", F.col("n").cast("double").alias("score"), F.lit(1).alias("prio"))
    best = a.unionByName(b).groupBy("idx").agg(F.min(F.struct("prio", (-F.col("score")).alias("neg"))).alias("x"))
    return best.select("idx", "x.prio", (-F.col("x.neg")).alias("score")).orderBy("prio", F.desc("score"), "idx").limit(limit)


def expand_query(query: str, entries: DataFrame) -> DataFrame:
    """The query with up to three aliases of up to three entries it names; no reading limit applies here."""
    hits = search_cards(query, entries, 3).filter("exact")
    rank = Window.orderBy(F.desc("score"), "idx")  # three rows at most
    got = hits.join(entries.select("idx", F.slice("aliases", 1, 3).alias("a")), "idx").withColumn("r", F.row_number().over(rank))
    return got.agg(F.concat_ws(" ", F.lit(query), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("r", "a"))), lambda x: x["a"]))).alias("query"))


def visible(entries: DataFrame, max_order: int | None, strict: bool = False) -> DataFrame:
    """Entries of some book within the limit; strict: of no book beyond it."""
    if not max_order:
        return entries
    test = F.forall if strict else F.exists
    return entries.filter(test("books", lambda b: b <= max_order))


def browse(entries: DataFrame, max_order: int | None = None, kinds: list[str] | None = None, sagas: list[int] | None = None, needle: str = "") -> DataFrame:
    """The catalogue's filter box: each control left empty is no condition."""
    from ..functions.text import ui_fold

    out = entries
    if max_order:
        out = out.filter(F.col("first") <= max_order)
    if kinds:
        out = out.filter(F.col("kind").isin(kinds))
    if sagas:
        out = out.filter(F.arrays_overlap("sagas", F.array(*map(F.lit, sagas))))
    if needle:
        out = out.filter(F.contains(ui_fold(F.concat_ws(" ", "name", "gloss")), ui_fold(F.lit(needle))))
    return out


def card_index(entries: DataFrame) -> DataFrame:
    """Light rows with counts, numbered by first book (none: 999), then by name in French order."""
    light = entries.select("id", "name", "kind", "gloss", "first", F.size("aliases").alias("n_aliases"), F.size("books").alias("n_books"))
    return numbered(light, [F.coalesce("first", F.lit(999)), F.collate(F.col("name"), "fr"), F.col("id")], "number")


def kind_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def rejections(manual: DataFrame, automatic: DataFrame) -> DataFrame:
    """Rejected pairs (a, b, reason): manual ones first, one row for each folded pair."""
    both = manual.withColumn("prio", F.lit(0)).unionByName(automatic.withColumn("prio", F.lit(1)))
    both = both.withColumns({"ka": fold(F.col("a")), "kb": fold(F.col("b"))})
    return both.groupBy("ka", "kb").agg(F.min(F.struct("prio", "a", "b", "reason")).alias("x")).select("ka", "kb", "x.a", "x.b", "x.reason", "x.prio")


def rejections_for(rejected: DataFrame, name: str) -> DataFrame:
    """Rejections that touch an entity on either side."""
    k = fold(F.lit(name))
    return rejected.filter((F.col("ka") == k) | (F.col("kb") == k))


def unsupported(claims: DataFrame, notes: DataFrame) -> DataFrame:
    """Claims (a, b) none of whose mentions of a (key, note) names b."""
    c = claims.withColumns({"ka": fold(F.col("a")), "kb": fold(F.col("b"))})
    n = notes.select(F.col("key").alias("ka"), F.concat(F.lit(" "), fold(F.col("note")), F.lit(" ")).alias("said"))
    named = c.join(n, "ka").filter(F.contains("said", F.concat(F.lit(" "), F.col("kb"), F.lit(" "))))
    return c.join(named.select("ka", "kb").distinct(), ["ka", "kb"], "left_anti").drop("ka", "kb")


def verdict_totals(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("relation").agg(F.count_if(F.col("verdict") == "rejected").alias("rejected"), F.count_if(F.col("verdict") == "confirmed").alias("confirmed"), F.count(F.lit(1)).alias("total"))


def cost_estimate(texts: DataFrame, text_col: str = "text", per_token: float = 3.6, price_in: float = 1.0) -> DataFrame:
    """Characters, tokens at so many characters each, and their price per million."""
    chars = F.sum(F.length(text_col))
    return texts.agg(chars.alias("chars"), F.ceil(chars / per_token).alias("tokens"), F.round(chars / per_token * price_in / 1e6, 6).alias("cost"))


def added_places(detected: DataFrame, added: DataFrame) -> DataFrame:
    """Detected rows and those of the added ones whose id was not detected."""
    return detected.unionByName(added.join(detected.select("id"), "id", "left_anti"))


def token_hits(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.select("*", F.size(tokenize(F.col(text_col))).alias("n_tokens"))
