"""The driver's tables under the engine's names, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ACCENTED, PLAIN, STOPWORDS


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents as chunks: a source is a book, its number the place in reading order, a language a saga."""
    t = table(spark, d, "documents")
    return t.select("doc_id", "text", "lang", "source", F.expr("int(substring(source, 4)) + 1").alias("order"))


def question(spark: SparkSession, d: str, item: int = 0) -> DataFrame:
    return table(spark, d, "benchmark").filter(F.col("item_id") == item).select("text")


def vector_question(spark: SparkSession, d: str, vec: int = 7) -> DataFrame:
    return table(spark, d, "embeddings").filter(F.col("vec_id") == vec).select(F.col("embedding").alias("q"))


def entries(spark: SparkSession, d: str) -> DataFrame:
    """Parts as entities."""
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("idx"), F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.array("p_brand", "p_type").alias("aliases"), F.col("p_type").alias("kind"), F.array("p_size").alias("books"), F.col("p_brand").alias("gloss"), F.lit("").alias("description"), F.col("p_size").alias("first"))


def mentions(spark: SparkSession, d: str) -> DataFrame:
    """Customer segments as mentions: market segments are names, nations books."""
    c = table(spark, d, "customer")
    return c.select(F.col("c_nationkey").alias("ord"), F.col("c_custkey").cast("int").alias("chapter"), F.expr("case when c_acctbal < 0 then lower(c_mktsegment) else c_mktsegment end").alias("name"), F.expr("case when c_custkey % 2 = 0 then 'even' else 'odd' end").alias("kind"), F.col("c_name").alias("role"))


def family(spark: SparkSession, d: str) -> DataFrame:
    """Region → nation → customer as parents and children."""
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    a = n.select(F.expr("concat('R', n_regionkey)").alias("parent"), F.expr("concat('N', n_nationkey)").alias("child"))
    return a.unionByName(c.select(F.expr("concat('N', c_nationkey)").alias("parent"), F.expr("concat('C', c_custkey)").alias("child")))


def couples(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").filter("n_nationkey <> n_regionkey")
    s = n.select(F.expr("concat('N', n_nationkey)").alias("a"), F.expr("concat('N', n_regionkey)").alias("b"))
    return s.unionByName(s.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def kin_rows(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers and parts of line items as claims on parents and children."""
    t = table(spark, d, "lineitem").filter("l_suppkey <> l_partkey")
    return t.select(F.col("l_suppkey").alias("parent"), F.col("l_partkey").alias("child"), F.expr("l_returnflag = 'R'").alias("self"), F.expr("case when l_linenumber > 3 then l_linestatus end").alias("nature"), F.expr("l_orderkey * 10 + l_linenumber").alias("ord"))


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_MARKS = "".join(map(chr, range(0x300, 0x370)))
DEACCENT = "translate({0}, " + lit(ACCENTED + _MARKS) + ", " + lit(PLAIN) + ")"


def sql_fold(x: str) -> str:
    return f"trim(regexp_replace({DEACCENT.format(f'lower({x})')}, '[^a-z0-9]+', ' ', 'g'))"


def sql_tokens(x: str, stop: bool = True) -> str:
    words = f"list_filter(regexp_split_to_array({DEACCENT.format(f'lower({x})')}, '[^a-z0-9]+'), lambda w: length(w) >= 2)"
    if stop:
        words = f"list_filter({words}, lambda w: NOT list_contains([{', '.join(map(lit, STOPWORDS))}], w))"
    return f"list_transform({words}, lambda w: CASE WHEN length(w) > 4 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, length(w) - 1) ELSE w END)"


CHUNKS = "chunks AS (SELECT doc_id, text, lang, source, CAST(substr(source, 4) AS INT) + 1 AS ord FROM documents)"
FAMILY = "family AS (SELECT 'R' || n_regionkey AS parent, 'N' || n_nationkey AS child FROM nation UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey FROM customer)"
COUPLES = "half AS (SELECT 'N' || n_nationkey AS a, 'N' || n_regionkey AS b FROM nation WHERE n_nationkey <> n_regionkey), couples AS (SELECT a, b FROM half UNION SELECT b, a FROM half)"
KIN = "kin AS (SELECT l_suppkey AS parent, l_partkey AS child, l_returnflag = 'R' AS self, CASE WHEN l_linenumber > 3 THEN l_linestatus END AS nature, l_orderkey * 10 + l_linenumber AS ord FROM lineitem WHERE l_suppkey <> l_partkey)"
SUPPORT = KIN + ", sup AS (SELECT parent, child, count(*) AS n, bool_or(self) AS self, arg_min(nature, (ord, nature)) FILTER (WHERE nature IS NOT NULL) AS nature FROM kin GROUP BY ALL)"
SIBLINGS = "sib AS (SELECT DISTINCT x.child AS a, y.child AS b FROM family x JOIN family y ON x.parent = y.parent AND x.child <> y.child), closer AS (SELECT parent AS a, child AS b FROM family UNION SELECT child, parent FROM family UNION SELECT a, b FROM couples), siblings AS (SELECT a, b FROM sib EXCEPT SELECT a, b FROM closer)"
BM25 = f"""d AS (SELECT doc_id AS doc, {sql_tokens("text")} AS ws FROM documents),
q AS (SELECT DISTINCT unnest({sql_tokens("text")}) AS term FROM benchmark WHERE item_id = 0),
st AS (SELECT count(*) AS n, sum(len(ws)) / count(*) AS avgdl FROM d),
tf AS (SELECT doc, len(ws) AS dl, term, len(list_filter(ws, lambda w: w = term)) AS tf FROM d, q WHERE list_contains(ws, term)),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
ranked AS (SELECT doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN df USING (term), st GROUP BY doc)"""
DENSE = """qv AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 7),
dv AS (SELECT vec_id AS doc, round(list_dot_product(CAST(embedding AS DOUBLE[]), q), 6) AS score FROM embeddings, qv)"""
PARTS = "ent AS (SELECT p_partkey AS idx, 'p' || p_partkey AS id, p_name AS name, [p_brand, p_type] AS aliases, p_type AS kind, [p_size] AS books, p_brand AS gloss, p_size AS first FROM part)"
NAMES = PARTS + f", nm AS (SELECT idx, 0 AS pos, {sql_fold('name')} AS key FROM ent UNION ALL SELECT idx, i, {sql_fold('aliases[i]')} FROM ent, (SELECT unnest([1, 2]) AS i))"
MENTIONS = "men AS (SELECT c_nationkey AS ord, CAST(c_custkey AS INT) AS chapter, CASE WHEN c_acctbal < 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS name, CASE WHEN c_custkey % 2 = 0 THEN 'even' ELSE 'odd' END AS kind, c_name AS role FROM customer)"

GRAMS = "list_distinct(CASE WHEN len({0}) >= 4 THEN list_transform(range(1, len({0}) - 2), lambda i: array_to_string({0}[i:i+3], ' ')) ELSE [] END)"
FNV = "list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split({0}, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: CAST((xor(h, c) * 16777619) & 4294967295 AS BIGINT))"
SKETCHES = f"""sh AS (SELECT doc_id AS id, {GRAMS.format("ws")} AS grams FROM (SELECT doc_id, {sql_tokens("text")} AS ws FROM documents)),
ha AS (SELECT id, {FNV.format("g")} AS h FROM (SELECT id, unnest(grams) AS g FROM sh)),
sk AS MATERIALIZED (SELECT id, list_sort(list(h))[1:16] AS sketch FROM ha GROUP BY id)"""
#: The walk in order of ids, over texts that have an earlier twin: dropped ones can put out no later text.
GREEDY = SKETCHES + """, ks AS (SELECT id, min(b) AS band, sketch[3 * b + 1:3 * b + 3] AS key FROM (SELECT sk.id, sketch, unnest(range(5)) AS b FROM sk JOIN sh USING (id) WHERE len(grams) >= 60) WHERE len(sketch) >= 3 * b + 3 GROUP BY ALL),
cand AS (SELECT a.id AS a, b.id AS b, min(b.band) AS band FROM ks a JOIN ks b ON a.key = b.key AND a.id < b.id GROUP BY ALL),
tw AS (SELECT a, b, band FROM cand JOIN sh x ON x.id = a JOIN sh y ON y.id = b WHERE len(list_intersect(x.grams, y.grams)) / least(len(x.grams), len(y.grams)) >= 0.6),
late AS MATERIALIZED (SELECT b AS id, list(a) AS tw, row_number() OVER (ORDER BY b) AS k FROM tw GROUP BY b),
walk AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS gone UNION ALL
  SELECT late.k, CASE WHEN len(list_filter(tw, lambda t: NOT list_contains(gone, t))) > 0 THEN list_append(gone, id) ELSE gone END FROM walk JOIN late ON late.k = walk.k + 1),
out AS (SELECT unnest(gone) AS id FROM (SELECT gone FROM walk ORDER BY k DESC LIMIT 1)),
same AS (SELECT b AS id, arg_min(a, (band, a)) AS same_as FROM tw WHERE a NOT IN (SELECT id FROM out) AND b IN (SELECT id FROM out) GROUP BY b),
dd AS (SELECT doc_id AS id, doc_id NOT IN (SELECT id FROM out) AS kept, same_as FROM documents LEFT JOIN same ON same.id = doc_id)"""
