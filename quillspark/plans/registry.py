"""Every query of the engine by name, with the SQL that DuckDB runs beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import chunking, codex, dedup, dense, graph, layout, lexical, ocr, quality, raster, semantic, signal, space
from ..streaming import events as ev
from .tables import BM25, CHUNKS, COUPLES, DENSE, FAMILY, GRAMS, GREEDY, KIN, MENTIONS, NAMES, PARTS, SIBLINGS, SKETCHES, SUPPORT, chunks, couples, entries, family, kin_rows, mentions, question, sql_fold, sql_tokens, table, vector_question

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return bm25_topk(spark, d)


# --- text ---------------------------------------------------------------------------------------------------------------


@query("SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE lang = 'fr' AND n_chars > 500 GROUP BY source")
def scan_prune(spark, d):
    t = table(spark, d, "documents").filter((F.col("lang") == "fr") & (F.col("n_chars") > 500))
    return t.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query(f"SELECT doc_id, {sql_fold('text')} AS folded FROM documents")
def fold_names(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.fold(F.col("text")).alias("folded"))


@query(f"SELECT doc_id, CAST(len({sql_tokens('text')}) AS BIGINT) AS len FROM documents")
def doc_len_stats(spark, d):
    return lexical.doc_lengths(table(spark, d, "documents")).withColumnRenamed("doc", "doc_id")


@query(f"WITH w AS (SELECT unnest({sql_tokens('text', stop=False)}) AS term FROM documents) SELECT term, count(*) AS n FROM w GROUP BY term")
def tokenize_counts(spark, d):
    t = table(spark, d, "documents").select(F.explode(tx.tokenize(F.col("text"), [])).alias("term"))
    return t.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH w AS (SELECT DISTINCT doc_id, unnest({sql_tokens('text')}) AS term FROM documents) SELECT term, count(*) AS df FROM w GROUP BY term ORDER BY df DESC, term LIMIT 100")
def term_df_topk(spark, d):
    p = lexical.postings(table(spark, d, "documents"))
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("df")).orderBy(F.desc("df"), "term").limit(100)


@query(f"WITH s AS (SELECT doc_id, {sql_tokens('text')} AS ws FROM documents) SELECT doc_id, CAST(len(list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')))) AS BIGINT) AS n FROM s")
def shingle_sizes(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(tx.shingles(F.col("text"))).cast("long").alias("n"))


@query(r"""SELECT p_partkey, CASE WHEN length(f) > 0 THEN left(replace(f, ' ', '-'), 60) ELSE 'x' END AS slug, left(sha1(p_name), 10) AS print
FROM (SELECT p_partkey, p_name, """ + sql_fold("p_name") + " AS f FROM part)")
def slugs_and_prints(spark, d):
    return table(spark, d, "part").select("p_partkey", tx.slug(F.col("p_name")).alias("slug"), tx.fingerprint(F.col("p_name")).alias("print"))


@query(r"""WITH t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations),
s AS (SELECT conv_id, turn, role, text, trim(regexp_replace(regexp_replace(text, '\[\d+\]', '', 'g'), '\s+([.,;:!?])', '\1', 'g')) AS clean FROM t WHERE rn <= 6)
SELECT conv_id, turn, role, CASE WHEN role <> 'assistant' THEN text WHEN length(clean) > 0 THEN clean ELSE '(…)' END AS text FROM s""")
def last_six_turns(spark, d):
    return semantic.recent_turns(table(spark, d, "conversations").select("conv_id", "turn", "role", "text"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) > 50")
def json_props(spark, d):
    t = table(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "int").alias("k"))
    return t.filter("k > 50")


# --- search -------------------------------------------------------------------------------------------------------------


@query(f"WITH {BM25} SELECT doc, score FROM ranked ORDER BY score DESC, doc LIMIT 60")
def bm25_topk(spark, d):
    return lexical.bm25(table(spark, d, "documents"), question(spark, d), 60)


@query(f"WITH {BM25}, {CHUNKS}, top AS (SELECT doc, score FROM ranked ORDER BY score DESC, doc LIMIT 180) SELECT doc, score FROM top JOIN chunks ON doc = doc_id WHERE ord <= 8 ORDER BY score DESC, doc LIMIT 90")
def bm25_spoiler_late_filter(spark, d):
    hits = lexical.bm25(table(spark, d, "documents"), question(spark, d), 180)
    return lexical.late_filter(hits, chunks(spark, d).select(F.col("doc_id").alias("doc"), "order"), 8)


@query(f"WITH {DENSE} SELECT doc, score FROM dv ORDER BY score DESC, doc LIMIT 90")
def dense_topk(spark, d):
    return dense.dense(table(spark, d, "embeddings"), vector_question(spark, d))


@query(f"WITH {DENSE}, {CHUNKS} SELECT doc, score FROM dv JOIN chunks ON doc = doc_id WHERE ord <= 8 ORDER BY score DESC, doc LIMIT 90")
def dense_prefiltered_topk(spark, d):
    orders = chunks(spark, d).select(F.col("doc_id").alias("doc"), "order")
    return dense.dense(table(spark, d, "embeddings"), vector_question(spark, d), orders=orders, max_order=8)


def _fused(spark, d):
    lex = lexical.bm25(table(spark, d, "documents"), question(spark, d), 90)
    return dense.fuse(*dense.pools(lex, dense.dense(table(spark, d, "embeddings"), vector_question(spark, d))))


@query(f"""WITH {BM25}, {DENSE}, l AS (SELECT doc, row_number() OVER (ORDER BY score DESC, doc) - 1 AS r FROM ranked QUALIFY r < 90),
v AS (SELECT doc, row_number() OVER (ORDER BY score DESC, doc) - 1 AS r FROM dv QUALIFY r < 90),
u AS (SELECT doc, r, 'lexical' AS via FROM l UNION ALL SELECT doc, r, 'semantic' FROM v)
SELECT doc, round(sum(1.0 / (61 + r)), 9) AS score, array_to_string(list_sort(list(DISTINCT via)), '+') AS via FROM u GROUP BY doc""")
def rrf_fusion(spark, d):
    return _fused(spark, d).select("doc", "score", F.array_join("via", "+").alias("via"))


@query(f"""WITH RECURSIVE {BM25}, {DENSE}, {CHUNKS}, l AS (SELECT doc, row_number() OVER (ORDER BY score DESC, doc) - 1 AS r FROM ranked QUALIFY r < 90), v AS (SELECT doc, row_number() OVER (ORDER BY score DESC, doc) - 1 AS r FROM dv QUALIFY r < 90),
u AS (SELECT coalesce(l.doc, v.doc) AS doc, l.r AS lr, v.r AS vr, round(coalesce(1.0 / (61 + l.r), 0) + coalesce(1.0 / (61 + v.r), 0), 9) AS score FROM l FULL JOIN v ON l.doc = v.doc),
p AS (SELECT doc, row_number() OVER (ORDER BY score DESC, lr NULLS LAST, vr NULLS LAST, doc) AS pos FROM u),
h AS MATERIALIZED (SELECT row_number() OVER (ORDER BY pos) AS k, doc, pos, ord, {GRAMS.format("ws")} AS g FROM (SELECT p.doc, pos, ord, {sql_tokens("text")} AS ws FROM p JOIN chunks ON doc_id = p.doc)),
w AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(doc BIGINT, pos BIGINT, ord INTEGER, g VARCHAR[])[]) AS kept UNION ALL
  SELECT h.k, CASE WHEN len(kept) < 14 AND len(list_filter(kept, lambda x: x.ord = h.ord)) < 2 AND len(list_filter(kept, lambda x: len(x.g) > 0 AND len(h.g) > 0 AND len(list_intersect(x.g, h.g)) / least(len(x.g), len(h.g)) > 0.45)) = 0
    THEN list_append(kept, {{'doc': h.doc, 'pos': h.pos, 'ord': h.ord, 'g': h.g}}) ELSE kept END FROM w JOIN h ON h.k = w.k + 1),
e AS (SELECT unnest(kept) AS x FROM (SELECT kept FROM w ORDER BY k DESC LIMIT 1)) SELECT x.doc AS doc, x.pos AS pos FROM e""")
def hybrid_search(spark, d):
    f = _fused(spark, d)
    order = Window.orderBy(*dense.fused_order(["lexical", "semantic"]))  # two pools of 90
    c = chunks(spark, d).select(F.col("doc_id").alias("doc"), "order", F.lit(-1).alias("chapter"), "text")
    hits = f.withColumn("pos", F.row_number().over(order)).join(c, "doc").select("pos", "doc", "order", "chapter", "text")
    return dense.capped_walk(hits)


@query(f"WITH {BM25}, {CHUNKS}, r AS (SELECT doc, row_number() OVER (ORDER BY score DESC, doc) AS pos FROM ranked QUALIFY pos <= 90) SELECT doc, pos, ord AS \"order\" FROM r JOIN chunks ON doc = doc_id QUALIFY row_number() OVER (PARTITION BY ord ORDER BY pos) <= 2")
def chapter_cap(spark, d):
    hits = dense.ranks(lexical.bm25(table(spark, d, "documents"), question(spark, d), 90), "lexical").withColumn("pos", F.col("rank") + 1)
    c = chunks(spark, d).select(F.col("doc_id").alias("doc"), "order", F.lit(-1).alias("chapter"))
    return dense.chapter_cap(hits.join(c, "doc")).select("doc", "pos", "order")


# --- deduplication and corpus -------------------------------------------------------------------------------------------


def _dedup(spark, d):
    docs = table(spark, d, "documents")
    return dedup.dedupe(docs)


@query(f"WITH RECURSIVE {GREEDY} SELECT id, kept, same_as FROM dd")
def dedup_greedy(spark, d):
    return _dedup(spark, d)


@query(f"WITH {SKETCHES} SELECT sh.id, coalesce(array_to_string(sketch, ','), '') AS sketch FROM sh LEFT JOIN sk USING (id)")
def fnv_sketch(spark, d):
    return dedup.sketches(table(spark, d, "documents")).select("id", F.array_join("sketch", ",").alias("sketch"))


@query(f"WITH RECURSIVE {GREEDY} SELECT source AS book, count(*) AS drops FROM dd JOIN documents ON doc_id = id WHERE NOT kept GROUP BY source ORDER BY drops DESC, book LIMIT 6")
def dedup_drops_by_book(spark, d):
    return dedup.drops_by_book(_dedup(spark, d), table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("book")))


@query("SELECT lang AS saga, source AS book, count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(grouping(lang, source) AS BIGINT) AS level FROM documents GROUP BY ROLLUP (lang, source)")
def corpus_rollup(spark, d):
    return chunking.manifest(table(spark, d, "documents").select(F.col("lang").alias("saga"), F.col("source").alias("book"), "text"))


@query("SELECT lang, source, count(*) AS chunks, count(DISTINCT text) AS texts, CAST(max(length(text)) AS BIGINT) AS longest FROM documents GROUP BY lang, source")
def corpus_manifest(spark, d):
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("text").alias("texts"), F.max(F.length("text")).cast("long").alias("longest"))


@query(r"""WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents), w AS (SELECT list_filter(regexp_split_to_array(trim(line), '\s+'), lambda x: x <> '') AS ws FROM l),
k AS (SELECT regexp_replace(lower(unnest(ws[1:len(ws)-1])), '^[^a-zà-ÿ-]+|[^a-zà-ÿ-]+$', '', 'g') AS word FROM w WHERE len(ws) > 1) SELECT word, count(*) AS n FROM k WHERE length(word) >= 2 GROUP BY word""")
def vocab_skip_last(spark, d):
    return layout.vocabulary(table(spark, d, "documents"))


@query("WITH l AS (SELECT page_id, unnest(string_split(html, chr(10))) AS line FROM pages), s AS (SELECT line, count(DISTINCT page_id) AS pages FROM l WHERE trim(line) <> '' GROUP BY line) SELECT line, pages FROM s WHERE pages >= 8")
def recurring_lines(spark, d):
    t = table(spark, d, "pages").select("page_id", F.explode(F.split("html", "\n")).alias("line")).filter(F.trim("line") != "")
    return t.groupBy("line").agg(F.count_distinct("page_id").alias("pages")).filter("pages >= 8")


@query("WITH l AS (SELECT page_id, unnest(string_split(html, chr(10))) AS line FROM pages), i AS (SELECT page_id, CAST(length(line) - length(ltrim(line)) AS INT) AS indent FROM l WHERE trim(line) <> ''), c AS (SELECT page_id, indent, count(*) AS n FROM i GROUP BY ALL) SELECT page_id, max(n) AS n FROM c GROUP BY page_id")
def indent_mode(spark, d):
    t = table(spark, d, "pages").select("page_id", F.explode(F.split("html", "\n")).alias("line")).filter(F.trim("line") != "")
    t = t.withColumn("indent", F.length("line") - F.length(F.ltrim("line")))
    return t.groupBy("page_id", "indent").agg(F.count(F.lit(1)).alias("n")).groupBy("page_id").agg(F.max("n").alias("n"))


def _paragraphs(spark, d):
    t = chunks(spark, d).select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    pos = F.row_number().over(Window.partitionBy("source").orderBy("doc_id", "line"))
    return t.select(F.col("source").alias("book"), pos.alias("pos"), F.col("doc_id").cast("int").alias("chapter"), (F.col("line") + 1).alias("page"), "text")


_CHUNKED = r"""WITH RECURSIVE p AS MATERIALIZED (SELECT source AS book, doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
w AS (SELECT book, doc_id, i, length(t) AS n, CASE WHEN length(t) > 2100 THEN 1 ELSE 0 END AS own, 0 AS k, CASE WHEN length(t) > 2100 THEN 0 ELSE length(t) END AS held, CASE WHEN length(t) > 2100 THEN 0 ELSE 1 END AS cnt, 0 AS carry FROM p WHERE i = 1 UNION ALL
  SELECT p.book, p.doc_id, p.i, length(p.t), CASE WHEN length(p.t) > 2100 THEN 1 ELSE 0 END,
    w.k + w.own + CASE WHEN length(p.t) > 2100 THEN CASE WHEN cnt > 0 THEN 1 ELSE 0 END WHEN cnt > 0 AND held + length(p.t) > 1400 THEN 1 ELSE 0 END,
    CASE WHEN length(p.t) > 2100 THEN 0 WHEN cnt > 0 AND held + length(p.t) > 1400 THEN length(p.t) + CASE WHEN w.n < 600 THEN w.n ELSE 0 END ELSE held + length(p.t) END,
    CASE WHEN length(p.t) > 2100 THEN 0 WHEN cnt > 0 AND held + length(p.t) > 1400 THEN CASE WHEN w.n < 600 THEN 2 ELSE 1 END ELSE cnt + 1 END,
    CASE WHEN length(p.t) <= 2100 AND cnt > 0 AND held + length(p.t) > 1400 AND w.n < 600 THEN 1 ELSE 0 END
  FROM w JOIN p ON p.doc_id = w.doc_id AND p.book = w.book AND p.i = w.i + 1),
m AS (SELECT book, doc_id, k, i FROM w UNION ALL SELECT book, doc_id, k, i - 1 FROM w WHERE carry = 1),
c AS (SELECT m.book, m.doc_id, k, min(m.i) AS a, max(m.i) AS b, string_agg(t, chr(10) || chr(10) ORDER BY m.i) AS text FROM m JOIN p USING (book, doc_id, i) GROUP BY ALL)
SELECT book, CAST(row_number() OVER (PARTITION BY book ORDER BY doc_id, k) AS INT) AS n, CAST(doc_id AS INT) AS chapter, CAST(a AS INT) AS page_start, CAST(b AS INT) AS page_end, CASE WHEN a = b THEN 'p. ' || a ELSE 'p. ' || a || '-' || b END AS pages, text FROM c
WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 120"""


@query(_CHUNKED)
def chunk_lines(spark, d):
    return chunking.chunk(_paragraphs(spark, d))


@query("WITH p AS (SELECT source AS book, doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS l FROM documents), o AS (SELECT book, length(t) >= 120 AS big, row_number() OVER (PARTITION BY book ORDER BY doc_id, l) AS pos FROM p), i AS (SELECT book, pos, pos - row_number() OVER (PARTITION BY book ORDER BY pos) AS island FROM o WHERE big), r AS (SELECT book, min(pos) AS start, count(*) AS n FROM i GROUP BY book, island) SELECT book, CAST(min(start) AS INT) AS start FROM r WHERE n >= 3 GROUP BY book")
def prose_start(spark, d):
    return layout.prose_start(_paragraphs(spark, d))


@query()
def ocr_repair(spark, d):
    docs = table(spark, d, "documents")
    fixed, _ = ocr.repair(docs.select(F.col("source").alias("book"), F.col("doc_id").alias("id"), "text"), layout.vocabulary(docs))
    return fixed


@query("""WITH RECURSIVE h AS MATERIALIZED (SELECT 'b' || o_custkey % 100 AS book, CAST(o_orderkey AS INT) AS line_no, CAST(o_custkey AS INT) AS number, o_orderpriority AS title, row_number() OVER (PARTITION BY o_custkey % 100 ORDER BY o_orderkey) AS k FROM orders),
a AS MATERIALIZED (SELECT book, list(number ORDER BY k) AS nums, count(*) AS n FROM h GROUP BY book),
f AS (SELECT book, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS lens FROM a UNION ALL
  SELECT f.book, f.k + 1, list_append(lens, 1 + coalesce(list_max(list_transform(range(1, f.k + 1), lambda j: CASE WHEN nums[j] < nums[f.k + 1] THEN lens[j] ELSE 0 END)), 0)) FROM f JOIN a ON a.book = f.book AND f.k < n),
l AS MATERIALIZED (SELECT f.book, unnest(lens) AS len, generate_subscripts(lens, 1) AS k FROM f JOIN a ON a.book = f.book AND f.k = n),
e AS MATERIALIZED (SELECT l.book, l.k, len, number FROM l JOIN h ON h.book = l.book AND h.k = l.k),
t AS (SELECT book, min(k) AS k FROM e WHERE len = (SELECT max(x.len) FROM e x WHERE x.book = e.book) GROUP BY book UNION ALL
  SELECT t.book, (SELECT min(y.k) FROM e y JOIN e z ON z.book = y.book AND z.k = t.k WHERE y.book = t.book AND y.k < z.k AND y.len = z.len - 1 AND y.number < z.number) FROM t WHERE t.k IS NOT NULL)
SELECT h.book, CAST(0 AS INT) AS page_no, line_no, number, title FROM t JOIN h ON h.book = t.book AND h.k = t.k""")
def lis_headings(spark, d):
    t = table(spark, d, "orders").select(F.concat(F.lit("b"), F.pmod("o_custkey", F.lit(100))).alias("book"), F.lit(0).alias("page_no"), F.col("o_orderkey").cast("int").alias("line_no"), F.col("o_custkey").cast("int").alias("number"), F.col("o_orderpriority").alias("title"))
    return layout.longest_run(t)


# --- entities -----------------------------------------------------------------------------------------------------------


@query(f"""WITH {MENTIONS}, k AS (SELECT *, {sql_fold('name')} AS key FROM men), f AS (SELECT key, name, count(*) AS n, min((ord, chapter)) AS seen_at FROM k GROUP BY key, name)
, c AS (SELECT key, arg_min(name, (-n, seen_at, name)) AS canonical, count(*) AS forms FROM f GROUP BY key)
SELECT key, canonical, forms, arg_min(kind, (ord, chapter, name)) AS kind, array_to_string(list_sort(list(DISTINCT ord)), ',') AS books, count(*) AS n_notes, min(ord) AS first_seen FROM k JOIN c USING (key) GROUP BY key, canonical, forms""")
def entity_rollup(spark, d):
    e = codex.roll_up(mentions(spark, d))
    return e.select("key", "canonical", F.size("variants").cast("long").alias("forms"), "kind", F.array_join("books", ",").alias("books"), "n_notes", "first_seen")


@query(f"WITH {NAMES}, f AS (SELECT key, arg_min(idx, (idx, pos)) AS idx FROM nm WHERE length(key) >= 3 GROUP BY key) SELECT key, idx FROM f")
def name_map_first_wins(spark, d):
    return codex.search_names(entries(spark, d))


@query(f"WITH {NAMES} SELECT key, arg_min(idx, CASE WHEN pos = 0 THEN (0, -idx, 0) ELSE (1, idx, pos) END) AS idx FROM nm GROUP BY key")
def name_map_names_beat_aliases(spark, d):
    return codex.relation_names(entries(spark, d))


@query(f"""WITH {NAMES}, f AS (SELECT key, arg_min(idx, (idx, pos)) AS idx FROM nm WHERE length(key) >= 3 GROUP BY key), q AS (SELECT 'econmy small ring' AS q),
h AS (SELECT key, idx, CASE WHEN contains(' ' || q || ' ', ' ' || key || ' ') THEN 100 + length(key) WHEN NOT contains(key, ' ') AND length(key) >= 5 AND len(list_filter(string_split(q, ' '), lambda w: levenshtein(w, key) = 1)) > 0 THEN 90 + length(key) END AS score FROM f, q)
SELECT key, idx, CAST(score AS DOUBLE) AS score FROM h WHERE score IS NOT NULL""")
def fuzzy_name_match(spark, d):
    return codex.name_hits("Econmy, small ring!", codex.search_names(entries(spark, d)))


@query(f"""WITH f AS (SELECT item_id AS idx, string_split({sql_fold('text')}, ' ')[1] AS key FROM benchmark), n AS (SELECT key, min(idx) AS idx FROM f GROUP BY key HAVING length(key) >= 4),
w AS (SELECT unnest(string_split({sql_fold('text')}, ' ')) AS key FROM documents) SELECT idx, count(*) AS n FROM w JOIN n USING (key) GROUP BY idx""")
def name_in_passage_counts(spark, d):
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("idx"), F.element_at(F.split(tx.fold(F.col("text")), " "), 1).alias("key"))
    return codex.passage_counts(table(spark, d, "documents"), b.groupBy("key").agg(F.min("idx").alias("idx")))


@query(f"WITH {PARTS}, p AS (SELECT idx, 2 AS prio, CAST(first AS DOUBLE) AS score FROM ent WHERE kind = 'SMALL' UNION ALL SELECT idx, 1, CAST(first AS DOUBLE) FROM ent WHERE gloss = 'Brand#4'), b AS (SELECT idx, min((prio, -score)) AS x FROM p GROUP BY idx) SELECT idx, x[1] AS prio, -x[2] AS score FROM b ORDER BY x[1], x[2], idx LIMIT 6".replace("x[1]", "struct_extract(x, 1)").replace("x[2]", "struct_extract(x, 2)"))
def priority_merge(spark, d):
    e = entries(spark, d)
    a = e.filter("kind = 'SMALL'").select("idx", F.col("first").cast("double").alias("score"), F.lit(False).alias("exact"))
    return codex.merge_hits(a, e.filter("gloss = 'Brand#4'").select("idx", F.col("first").alias("n")))


@query("SELECT p_type AS kind, count(*) AS n FROM part GROUP BY p_type")
def kind_counts(spark, d):
    return codex.kind_counts(entries(spark, d))


@query(f"WITH {MENTIONS}, r AS (SELECT ord, chapter, name, row_number() OVER (PARTITION BY ord ORDER BY chapter) - 1 AS r, count(*) OVER (PARTITION BY ord) AS n FROM men) SELECT ord, chapter, name FROM r WHERE r % (CASE WHEN n > 20 THEN CAST(ceil(n / 20) AS BIGINT) ELSE 1 END) = 0")
def uniform_sample(spark, d):
    return codex.sample_evenly(mentions(spark, d), "ord", ["chapter"], 20).select("ord", "chapter", "name")


@query("SELECT p_partkey AS idx, p_size AS \"first\", p_name AS name FROM part WHERE p_size <= 20 AND p_type IN ('SMALL', 'ECONOMY') AND contains(lower(p_name || ' ' || p_brand), 'ring')")
def browse_catalogue(spark, d):
    return codex.browse(entries(spark, d), 20, ["SMALL", "ECONOMY"], None, "RING").select("idx", "first", "name")


@query(f"SELECT p_partkey AS idx, length(replace({sql_fold('p_brand')}, ' ', '')) >= 3 AS good FROM part")
def distinctive_aliases(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("idx"), tx.distinctive(F.col("p_brand")).alias("good"))


@query("SELECT doc_id % 25 AS nation, count(*) FILTER (WHERE toxic = 1) AS rejected, count(*) FILTER (WHERE toxic = 0) AS confirmed, count(*) AS total FROM labels GROUP BY 1")
def verdict_totals(spark, d):
    v = table(spark, d, "labels").select((F.col("doc_id") % 25).alias("relation"), F.expr("case toxic when 1 then 'rejected' when 0 then 'confirmed' end").alias("verdict"))
    return codex.verdict_totals(v).withColumnRenamed("relation", "nation")


# --- graph --------------------------------------------------------------------------------------------------------------


@query("""WITH RECURSIVE o AS (SELECT n_nationkey AS idx, n_regionkey AS owner FROM nation WHERE n_nationkey <> n_regionkey), w AS (SELECT n_nationkey AS idx, n_nationkey AS at FROM nation UNION SELECT w.idx, o.owner FROM w JOIN o ON o.idx = w.at)
SELECT w.idx, w.at AS canonical FROM w LEFT JOIN o ON o.idx = w.at WHERE o.idx IS NULL""")
def alias_chain_recursive(spark, d):
    n = table(spark, d, "nation")
    return graph.canonical(n.select(F.col("n_nationkey").alias("idx")), n.filter("n_nationkey <> n_regionkey").select(F.col("n_nationkey").alias("idx"), F.col("n_regionkey").alias("owner")))


@query(f"WITH {SUPPORT} SELECT * FROM sup")
def edge_support(spark, d):
    return graph.support(kin_rows(spark, d))


@query(f"WITH {SUPPORT} SELECT a.* FROM sup a LEFT JOIN sup b ON a.parent = b.child AND a.child = b.parent WHERE b.n IS NULL OR CASE WHEN a.self <> b.self THEN a.self ELSE a.n > b.n END")
def edge_contradictions(spark, d):
    return graph.resolve(graph.support(kin_rows(spark, d)))


@query(f"WITH {SUPPORT} SELECT a.parent, a.child, a.n AS n_forward, b.n AS n_back FROM sup a JOIN sup b ON a.parent = b.child AND a.child = b.parent AND a.parent < a.child")
def contradiction_report(spark, d):
    return graph.contradictions(graph.support(kin_rows(spark, d)))


@query(f"WITH {FAMILY}, {COUPLES}, {SIBLINGS} SELECT a, b FROM siblings")
def siblings_minus_closer(spark, d):
    return graph.siblings(family(spark, d), couples(spark, d))


@query(f"WITH {FAMILY} SELECT DISTINCT x.parent AS grandparent, y.child AS grandchild FROM family x JOIN family y ON x.child = y.parent WHERE x.parent <> y.child")
def two_hop_members(spark, d):
    return graph.two_hops(family(spark, d))


_TREES = f"""{FAMILY}, {COUPLES}, {SIBLINGS}, hop AS (SELECT DISTINCT x.parent AS g, y.child AS c FROM family x JOIN family y ON x.child = y.parent),
m AS (SELECT parent AS ego, parent AS person, 0 AS r FROM family UNION SELECT child, child, 0 FROM family UNION SELECT a, a, 0 FROM couples UNION SELECT a, b, 0 FROM couples UNION SELECT a, b, 0 FROM siblings
UNION SELECT child, parent, 1 FROM family UNION SELECT parent, child, 2 FROM family UNION SELECT c, g, 3 FROM hop UNION SELECT g, c, 4 FROM hop),
trees AS (SELECT ego, person, min(r) AS r FROM m GROUP BY ego, person)"""


@query(f"WITH {_TREES} SELECT ego, person, ['Génération', 'Parents', 'Enfants', 'Grands-parents', 'Petits-enfants'][r + 1] AS row FROM trees")
def ego_trees(spark, d):
    return graph.trees(family(spark, d), couples(spark, d))


@query(f"WITH {_TREES} SELECT ego, count(*) AS size FROM trees GROUP BY ego HAVING count(*) >= 3")
def tree_sizes(spark, d):
    return graph.tree_sizes(family(spark, d), couples(spark, d))


_LINKS = f"WITH {_TREES} SELECT t.ego, f.parent, f.child FROM family f JOIN trees t ON t.person = f.parent JOIN trees u ON u.ego = t.ego AND u.person = f.child"


@query(_LINKS)
def links_both_ends(spark, d):
    return graph.links_within(family(spark, d), couples(spark, d))


@query(_LINKS)
def links_both_ends_all(spark, d):
    """As links_both_ends, which once held nations' trees only."""
    return links_both_ends(spark, d)


@query(f"WITH {FAMILY}, {COUPLES}, {SIBLINGS}, u AS (SELECT child AS person, 1 AS p, 0 AS c, 0 AS s, 0 AS b FROM family UNION ALL SELECT parent, 0, 1, 0, 0 FROM family UNION ALL SELECT a, 0, 0, 1, 0 FROM couples UNION ALL SELECT a, 0, 0, 0, 1 FROM siblings) SELECT person, CAST(sum(p) AS BIGINT) AS parents, CAST(sum(c) AS BIGINT) AS children, CAST(sum(s) AS BIGINT) AS spouses, CAST(sum(b) AS BIGINT) AS siblings FROM u GROUP BY person")
def relation_counts(spark, d):
    return graph.relation_counts(family(spark, d), couples(spark, d))


# --- space, progress, findings ------------------------------------------------------------------------------------------


@query("SELECT DISTINCT l_partkey AS missing FROM lineitem WHERE l_partkey NOT IN (SELECT o_custkey FROM orders)")
def missing_refs_anti(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_partkey").alias("missing")).distinct()
    return t.join(table(spark, d, "orders").select(F.col("o_custkey").alias("missing")), "missing", "left_anti")


@query("WITH p AS (SELECT s_nationkey AS room, s_suppkey AS id, s_suppkey * 7 % 40 AS x, s_suppkey * 13 % 40 AS y FROM supplier) SELECT a.room, a.id AS a, b.id AS b, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) AS distance FROM p a JOIN p b ON a.room = b.room AND a.id < b.id WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) < 12")
def proximity_pairs(spark, d):
    p = table(spark, d, "supplier").selectExpr("s_nationkey AS room", "s_suppkey AS id", "s_suppkey * 7 % 40 AS x", "s_suppkey * 13 % 40 AS y")
    return space.near_pairs(p, 12.0, ["room"]).withColumn("distance", F.round("distance", 6))


@query("""WITH p AS (SELECT s_nationkey AS world, s_suppkey AS id, s_suppkey * 7 % 40 AS x, s_suppkey * 13 % 40 AS y FROM supplier), v AS (SELECT * FROM (VALUES ('down', 0, 1), ('left', -1, 0), ('right', 1, 0), ('up', 0, -1)) t(dir, dx, dy)),
b AS (SELECT a.world, a.id, b.id AS t, b.x - a.x AS ex, b.y - a.y AS ey, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM p a JOIN p b ON a.world = b.world AND a.id <> b.id)
SELECT world, id, dir, arg_min(t, (d, t)) AS "to" FROM b, v WHERE d > 0 AND (ex * dx + ey * dy) / d >= 0.5 GROUP BY world, id, dir""")
def nearest_by_direction(spark, d):
    return space.nearest_in_direction(table(spark, d, "supplier").selectExpr("s_nationkey AS world", "s_suppkey AS id", "s_suppkey * 7 % 40 AS x", "s_suppkey * 13 % 40 AS y"))


@query("WITH p AS (SELECT p_partkey AS id, p_size AS x, p_partkey % 50 AS y FROM part), z AS (SELECT n_nationkey AS ord, n_nationkey AS x0, n_nationkey + 10 AS x1, n_regionkey AS y0, n_regionkey + 20 AS y1, n_name AS zone FROM nation) SELECT p.id, coalesce(arg_min(zone, ord), 'none') AS zone FROM p LEFT JOIN z ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY p.id")
def zone_first_match(spark, d):
    z = table(spark, d, "nation").selectExpr("n_nationkey AS ord", "n_nationkey AS x0", "n_nationkey + 10 AS x1", "n_regionkey AS y0", "n_regionkey + 20 AS y1", "n_name AS zone")
    return space.zone_of(table(spark, d, "part").selectExpr("p_partkey AS id", "p_size AS x", "p_partkey % 50 AS y"), z, "none")


@query("SELECT user_id, event_id, max(value) OVER (PARTITION BY user_id ORDER BY event_id) AS reached FROM events")
def running_max_progress(spark, d):
    return space.progress(table(spark, d, "events"), "user_id", "event_id", "value").select("user_id", "event_id", "reached")


@query("SELECT o_custkey AS campaign, o_orderkey AS chapter, CAST(row_number() OVER w - 1 AS INT) AS rank, lead(o_orderkey) OVER w AS next FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def next_chapters(spark, d):
    return space.next_chapter(table(spark, d, "orders").select(F.col("o_custkey").alias("campaign"), F.struct("o_orderdate", "o_orderkey").alias("ord"), F.col("o_orderkey").alias("chapter")))


@query("""WITH m AS (SELECT user_id AS scene, event_type AS who, event_id AS step, CASE WHEN value > 10 THEN 1 ELSE -1 END AS change FROM events), l AS (SELECT *, lead(step) OVER (PARTITION BY scene, who ORDER BY step) AS until FROM m),
s AS (SELECT DISTINCT user_id AS scene, event_id AS step FROM events) SELECT s.scene, s.step, count(*) AS n FROM s JOIN l ON s.scene = l.scene AND s.step >= l.step AND (l.until IS NULL OR s.step < l.until) WHERE change > 0 GROUP BY s.scene, s.step""")
def replay_roster(spark, d):
    e = table(spark, d, "events")
    moves = e.select(F.col("user_id").alias("scene"), F.col("event_type").alias("who"), F.col("event_id").alias("step"), F.expr("case when value > 10 then 1 else -1 end").alias("change"))
    return space.roster(moves, e.select(F.col("user_id").alias("scene"), F.col("event_id").alias("step")).distinct(), ["scene"]).groupBy("scene", "step").agg(F.count(F.lit(1)).alias("n"))


@query("WITH b AS (SELECT c_custkey AS who, 'bal' AS stat, c_acctbal AS v FROM customer UNION ALL SELECT o_custkey, CASE WHEN o_orderstatus = 'F' THEN 'bal' ELSE 'open' END, o_totalprice FROM orders) SELECT who, stat, round(sum(v), 2) AS value FROM b GROUP BY who, stat")
def equipment_stats(spark, d):
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("who"), F.lit("bal").alias("stat"), F.col("c_acctbal").alias("value"))
    worn = table(spark, d, "orders").select(F.col("o_custkey").alias("who"), F.create_map(F.expr("case when o_orderstatus = 'F' then 'bal' else 'open' end"), F.col("o_totalprice")).alias("bonus"))
    return space.equipment_stats(base, worn).withColumn("value", F.round("value", 2))


@query("WITH i AS (SELECT 'i' || p_size AS id, CASE WHEN p_type = 'SMALL' THEN 'equipement' WHEN p_type = 'ECONOMY' THEN 'odd' ELSE 'objet' END AS cat FROM part), f AS (SELECT 'item twice' AS \"check\", id AS subject FROM i GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'unknown category', id FROM i WHERE cat = 'odd' UNION ALL SELECT 'equipment without slot', id FROM i WHERE cat = 'equipement' UNION ALL SELECT 'no icon', id FROM i WHERE CAST(substr(id, 2) AS INT) > 40) SELECT \"check\", subject, count(*) AS n FROM f GROUP BY ALL")
def item_census(spark, d):
    p = table(spark, d, "part")
    items = p.select(F.expr("concat('i', p_size)").alias("id"), F.expr("case p_type when 'SMALL' then 'equipement' when 'ECONOMY' then 'odd' end").alias("category"), F.lit(None).cast("string").alias("slot"))
    icons = p.filter("p_size <= 40").select(F.expr("concat('i', p_size)").alias("icon"))
    return quality.census(items, ["main"], icons).groupBy("check", "subject").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(floor(value + 0.5) AS BIGINT) AS rounded, count(*) AS n FROM events GROUP BY 1")
def half_up_rounding(spark, d):
    return table(spark, d, "events").groupBy(tx.round_half_up(F.col("value")).alias("rounded")).agg(F.count(F.lit(1)).alias("n"))


_PIXELS = "px AS (SELECT s AS image, CAST(l_linenumber AS INT) AS frame, r, g, b, a FROM (SELECT l_suppkey AS s, l_linenumber, CAST(l_quantity AS INT) * 5 AS r, CAST(l_discount * 100 AS INT) * 20 AS g, CAST(l_tax * 100 AS INT) * 20 AS b, CASE WHEN l_returnflag = 'A' THEN 0 ELSE 255 END AS a FROM lineitem))"


def _pixels(spark, d):
    return table(spark, d, "lineitem").selectExpr("l_suppkey AS image", "int(l_linenumber) AS frame", "int(l_orderkey) AS x", "int(l_partkey) AS y", "int(l_quantity) * 5 AS r", "int(round(l_discount * 100)) * 20 AS g", "int(round(l_tax * 100)) * 20 AS b", "case when l_returnflag = 'A' then 0 else 255 end AS a")


@query(f"WITH {_PIXELS}, h AS (SELECT image, r, g, b, count(*) AS n FROM px WHERE a >= 16 GROUP BY ALL), t AS (SELECT image, count(*) FILTER (WHERE a >= 16) AS opaque, count(*) FILTER (WHERE a < 16) AS transparent FROM px GROUP BY image) SELECT t.image, opaque, transparent, CAST(0 AS BIGINT) AS soft, count(*) AS colors, count(*) FILTER (WHERE n < greatest(2, opaque / 1000)) AS rare FROM t JOIN h USING (image) GROUP BY t.image, opaque, transparent")
def palette_stats(spark, d):
    return raster.palette_stats(_pixels(spark, d))


@query(f"WITH {_PIXELS}, h AS (SELECT image, frame, r, g, b, count(*) AS n FROM px WHERE a >= 16 GROUP BY ALL), f AS (SELECT *, sum(n) OVER (PARTITION BY image, frame) AS al FROM h), s AS (SELECT image, r, g, b, max(n / al) AS share FROM f GROUP BY ALL) SELECT image, r, g, b, round(share, 9) AS share FROM s QUALIFY row_number() OVER (PARTITION BY image ORDER BY share DESC, r, g, b) <= 16")
def color_shares(spark, d):
    return raster.color_shares(_pixels(spark, d)).select("image", "r", "g", "b", F.round("share", 9).alias("share"))


@query("SELECT user_id AS sound, max(abs(value)) AS peak, arg_max(value, event_id) AS last, abs(arg_max(value, event_id) - arg_min(value, event_id)) AS seam FROM events GROUP BY user_id")
def sound_measures(spark, d):
    return signal.measures(table(spark, d, "events").select(F.col("user_id").alias("sound"), F.col("event_id").alias("i"), F.col("value").alias("v")))


# --- event time, offered on top -----------------------------------------------------------------------------------------


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark, d):
    return ev.tumbling(table(spark, d, "events")).withColumn("total", F.round("total", 4))


@query("WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM e) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM s GROUP BY user_id, s")
def events_session(spark, d):
    return ev.sessions(table(spark, d, "events"))
