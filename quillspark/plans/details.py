"""Queries of single operators on descriptions, files, noise, pixels and providers, each with the SQL that DuckDB runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import codex, graph, layout, quality, raster, semantic, signal
from ..sources import files
from .parts import _LINES, _NOTES, _OKLAB, _PX, _px
from .registry import query
from .tables import DEACCENT, MENTIONS, lit, mentions, sql_fold, table

# --- descriptions: documents, each with a sentence about one of the nations -----------------------------------------------

#: Read by both engines: a sentence for each document, about its nation a and another, b.
_SAID = """CASE doc_id % 8 WHEN 0 THEN a.n_name || ' avait les cheveux ' || split_part('noirs,blonds,roux', ',', CAST(doc_id % 3 + 1 AS INT)) || ' et portait une tunique depuis ' || doc_id || ' jours.'
WHEN 1 THEN 'Le vieux ' || a.n_name || ' regarda la mer, ses yeux clairs et sa barbe grise au vent du soir ' || doc_id || '.'
WHEN 2 THEN a.n_name || ' était un colosse, dit une voix, aux yeux sombres et au teint pâle, ' || doc_id || '.'
WHEN 3 THEN 'On apporta alors vers ' || a.n_name || ' qui avait une cape et une armure le coffre ' || doc_id || '.'
WHEN 4 THEN a.n_name || ' suivait ' || b.n_name || ' et portait une cape, une robe et un manteau ' || doc_id || '.'
WHEN 5 THEN 'La ville de ' || a.n_name || ' se dressait sur une colline, avec ses tours de pierre et la cour ' || doc_id || '.'
WHEN 6 THEN 'Plus haut encore que le mont, ' || a.n_name || ' comptait une tour, un donjon et ' || doc_id || ' marches.'
ELSE 'Celle de ' || a.n_name || ' dominait la muraille, les remparts et les toits de la salle ' || doc_id || '.' END"""


def _described(spark, d):
    """Texts (text) and the nations' names (idx, key)."""
    n = table(spark, d, "nation")
    a, b = n.alias("a"), n.alias("b")
    t = table(spark, d, "documents").join(F.broadcast(a), F.expr("a.n_nationkey = doc_id % 25")).join(F.broadcast(b), F.expr("b.n_nationkey = doc_id * 7 % 25"))  # 25 rows
    return t.select(F.expr(f"text || ' ' || {_SAID}").alias("text")), n.select(F.col("n_nationkey").alias("idx"), tx.fold(F.col("n_name")).alias("key"))


def _candidates(low: int, high: int, words: list[str]) -> str:
    edge = lambda ws, end="": lit(rf"(?i)\b(?:{'|'.join(ws)}){end}")
    return rf"""nm AS (SELECT n_nationkey AS idx, {sql_fold('n_name')} AS key FROM nation),
tx AS (SELECT text || ' ' || {_SAID} AS text FROM documents JOIN nation a ON a.n_nationkey = doc_id % 25 JOIN nation b ON b.n_nationkey = doc_id * 7 % 25),
st AS (SELECT DISTINCT unnest(string_split(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS s FROM tx),
c AS MATERIALIZED (SELECT s, {sql_fold('s')} AS f FROM st WHERE length(s) BETWEEN {low} AND {high} AND regexp_matches(s, {edge(words)}) AND NOT regexp_matches(s, {edge(semantic.ACTIONS, chr(92) + 'b')}))"""


def _plain(words: list[str]) -> list[str]:
    return [semantic._plain(w) for w in words]


@query(rf"""WITH {_candidates(40, 300, semantic.LOOKS)}, hit AS (SELECT s, f, idx, key FROM c JOIN nm ON contains(f, key)),
alone AS (SELECT * FROM hit h WHERE NOT EXISTS (SELECT 1 FROM hit o WHERE o.s = h.s AND o.key <> h.key AND length(o.key) >= 4)),
t AS (SELECT *, list_filter([{', '.join(f"instr(f, {lit(w)})" for w in _plain(semantic.LOOKS))}], lambda p: p > 0) AS places, instr(f, key) AS place FROM alone
WHERE (regexp_matches(f, key || '[^.]{{0,30}}\b(?:{semantic.LOOK_VERBS})\b') OR regexp_matches(f, key || '[^.]{{0,60}}\b(?:ses|son|sa)\s+(?:{'|'.join(_plain(semantic.LOOKS))})')) AND NOT regexp_matches(f, '\b(?:{semantic.OBLIQUE})\s+' || key || '\b')),
u AS (SELECT *, list_min(list_transform(places, lambda p: abs(p - place))) AS near FROM t WHERE len(places) > 0),
r AS (SELECT idx, trim(s) AS text, CAST(100 * len(places) - near AS DOUBLE) - CAST(length(s) AS DOUBLE) / 10 AS score, s FROM u WHERE near <= 90)
SELECT idx, CAST(row_number() OVER (PARTITION BY idx ORDER BY score DESC, s) AS INT) AS rank, text, round(score, 6) AS score FROM r QUALIFY rank <= 5""")
def described_people(spark, d):
    """What the texts say that the nations look like, best first."""
    return semantic.appearances(*_described(spark, d)).withColumn("score", F.round("score", 6))


@query(rf"""WITH {_candidates(50, 300, semantic.PLACE_WORDS)}, ks AS (SELECT idx, key, min(pos) AS pos FROM (SELECT idx, key, 0 AS pos FROM nm UNION ALL SELECT idx, string_split(key, ' ')[1], 1 FROM nm) WHERE length(key) >= 4 GROUP BY ALL),
hit AS (SELECT s, f, idx, arg_min(key, pos) AS n FROM c JOIN ks ON contains(f, key) GROUP BY s, f, idx),
t AS (SELECT idx, s, CAST(100 * ({' + '.join(f"CAST(regexp_matches(f, {lit(chr(92) + 'b' + w)}) AS INT)" for w in _plain(semantic.PLACE_WORDS))}) AS DOUBLE) - CAST(length(s) AS DOUBLE) / 10 AS score FROM hit
WHERE NOT regexp_matches(f, '\b(?:plus|moins|aussi)\b[^.]{{0,40}}\bque\b') AND NOT regexp_matches(f, 'celle?s?\s+(?:du|de|des)\s+' || n)
AND (regexp_matches(f, n || '[^.]{{0,40}}\b(?:{semantic.PLACE_VERBS.replace("'", "''")})\b') OR regexp_matches(f, n || '[^.]{{0,50}}\b(?:ses|son|sa)\s+(?:{'|'.join(_plain(semantic.PLACE_WORDS))})')))
SELECT idx, CAST(row_number() OVER (PARTITION BY idx ORDER BY score DESC, s) AS INT) AS rank, trim(s) AS text, round(score, 6) AS score FROM t QUALIFY rank <= 5""")
def described_places(spark, d):
    return semantic.place_sentences(*_described(spark, d)).withColumn("score", F.round("score", 6))


# --- books: labels, capitals, headers ---------------------------------------------------------------------------------------


@query(r"""WITH t AS (SELECT doc_id, left(text, 1) || '  ' || substr(text, 2) AS t FROM documents)
SELECT doc_id, md5(CASE WHEN regexp_matches(t, '^[A-ZÀ-Ý]\s+[a-zà-ÿ]') AND NOT regexp_matches(t, '^[AÀYOÔ]\s') THEN left(t, 1) || regexp_replace(substr(t, 2), '^\s+', '') ELSE t END) AS print FROM t""")
def joined_drop_caps(spark, d):
    """Texts whose first letter stands apart."""
    t = F.concat(F.substring("text", 1, 1), F.lit("  "), F.expr("substr(text, 2)"))
    return table(spark, d, "documents").select("doc_id", F.md5(tx.drop_cap(t).cast("binary")).alias("print"))


@query(r"""WITH t AS (SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN p_size END AS n, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN 'xkcdf bcdfg' WHEN 2 THEN p_name || ' §' END AS title FROM part)
SELECT p_partkey, CASE WHEN n IS NULL THEN title WHEN p_partkey % 4 = 0 THEN 'Chapitre ' || n || ' — ' || title ELSE 'Chapitre ' || n END AS label FROM t""")
def chapter_labels(spark, d):
    """Titles that can be read, that have no vowel, that have an odd sign, and none."""
    t = table(spark, d, "part").selectExpr("p_partkey", "if(p_size % 3 > 0, p_size, null) AS n", "case p_partkey % 4 when 0 then p_name when 1 then 'xkcdf bcdfg' when 2 then concat(p_name, ' §') end AS title")
    return t.select("p_partkey", layout.chapter_label(F.col("n"), F.col("title")).alias("label"))


_KEY = f"CASE WHEN length(text) BETWEEN 1 AND 70 AND NOT regexp_matches(text, '[.!?…,;:»\"]$') AND length(regexp_replace(lower({DEACCENT.format('text')}), '[^a-z]', '', 'g')) >= 6 THEN regexp_replace(lower({DEACCENT.format('text')}), '[^a-z]', '', 'g') END"
_SHARE = "(SELECT max(len(list_intersect(a, b)) / least(len(a), len(b))) FROM (SELECT list_distinct(list_transform(range(1, length(x.key) - 1), lambda i: substr(x.key, i, 3))) AS a, list_distinct(list_transform(range(1, length(fo.form) - 1), lambda i: substr(fo.form, i, 3))) AS b FROM fo WHERE fo.book = x.book))"


#: Read by both engines, but for the first lines of a text: pages of five books with a running header, which is distorted,
#: missing, or in the middle of a page at times.
_HEADED = """CASE doc_id % 11 WHEN 3 THEN '     TNE ROAB OF ' WHEN 4 THEN 'TNE ROAB OF ' WHEN 5 THEN 'Nothing like it ' ELSE 'THE ROAD OF ' END || split_part('Aldmoor,Brenwick,Caldera,Dunmere,Eskdale', ',', CAST(doc_id % 5 + 1 AS INT))
|| chr(10) || {0} || CASE WHEN doc_id % 7 = 0 THEN chr(10) || '      THE ROAD OF ' || split_part('Aldmoor,Brenwick,Caldera,Dunmere,Eskdale', ',', CAST(doc_id % 5 + 1 AS INT)) || 'x' ELSE '' END"""


@query(rf"""WITH pages AS (SELECT doc_id AS page_id, {_HEADED.format("array_to_string(string_split(text, chr(10))[1:4], chr(10))")} AS html FROM documents), {_LINES},
x AS MATERIALIZED (SELECT *, {_KEY} AS key, coalesce(sum(CASE WHEN text <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY book, page_no ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS top FROM l),
p AS (SELECT book, count(DISTINCT page_no) AS pages FROM l WHERE text <> '' GROUP BY book),
fo AS MATERIALIZED (SELECT book, key AS form FROM x JOIN p USING (book) WHERE top AND text <> '' AND key IS NOT NULL GROUP BY book, key, pages HAVING count(*) >= greatest(8, floor(pages * 0.06 + 0.5))),
y AS (SELECT *, {_SHARE} AS share FROM x WHERE key IS NOT NULL)
SELECT book, page_no, CAST(line_no AS INT) AS line_no, text FROM x WHERE (book, page_no, line_no) NOT IN (SELECT (book, page_no, line_no) FROM y
WHERE (top AND EXISTS (SELECT 1 FROM fo WHERE fo.book = y.book AND fo.form = y.key)) OR (indent >= 3 AND ((top AND share >= 0.6) OR share >= 0.85)))""")
def lines_without_headers(spark, d):
    t = table(spark, d, "documents").selectExpr("doc_id % 5 AS book", "doc_id AS page_no", f"{_HEADED.format('array_join(slice(split(text, chr(10)), 1, 4), chr(10))')} AS text")
    lines = layout.lines(t)
    return layout.without_headers(lines, layout.recurring_headers(lines)).select("book", "page_no", "line_no", "text")


# --- JSON, files, findings ------------------------------------------------------------------------------------------------

_WRAPPED = """CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN 'said {"a": ' || props || ', "b": "} \\" {"} end }' WHEN 2 THEN 'no {json ' || props ELSE 'x ' || props || ' {} tail' END"""


@query(f"""WITH t AS (SELECT event_id, {_WRAPPED} AS t FROM events), p AS (SELECT *, instr(t, '{{') AS s FROM t)
SELECT event_id, CASE WHEN json_valid(t) THEN t ELSE (SELECT list_filter(list_transform(range(s, length(t) + 1), lambda e: substr(t, s, e - s + 1)), lambda x: json_valid(x))[1]) END AS json FROM p""")
def json_in_answers(spark, d):
    """The first JSON object in answers that hold JSON, wrap it, break off, or go on behind it."""
    wrapped = _WRAPPED.replace('\\"', '\\\\"')
    return table(spark, d, "events").selectExpr("event_id", f"{wrapped} AS t").select("event_id", tx.first_json_object(F.col("t")).alias("json"))


_NESTED = """'{"id": ' || event_id || ', "frames": [' || props || ', {"base64": "f' || event_id % 7 || '", "k": {"base64": "g"}}], "base64": ' || CASE WHEN event_id % 3 = 0 THEN 'null' ELSE '"top"' END || '}'"""


@query(f"SELECT event_id, t.fullkey AS path, t.value ->> '$' AS value FROM (SELECT event_id, {_NESTED} AS j FROM events) e, json_tree(e.j) t WHERE t.key = 'base64' AND t.type = 'VARCHAR'")
def base64_leaves(spark, d):
    return files.leaves(table(spark, d, "events").selectExpr("event_id", f"{_NESTED} AS j"), "j", "base64").select("event_id", "path", "value")


@query("""SELECT 'unknown nation' AS "check", count(*) FILTER (WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey > 0)) AS faults, CAST(0 AS BIGINT) AS notices, true AS failed FROM customer
UNION ALL SELECT 'low balance', CAST(0 AS BIGINT), count(*), false FROM customer WHERE c_acctbal < 0
UNION ALL SELECT NULL, count(*) FILTER (WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey > 0)), count(*) FILTER (WHERE c_acctbal < 0), true FROM customer""")
def findings_summary(spark, d):
    c = table(spark, d, "customer")
    lost = quality.unknown(c, "c_nationkey", table(spark, d, "nation").filter("n_regionkey > 0"), "n_nationkey", "unknown nation", "c_custkey")
    low = quality.finding(c.filter("c_acctbal < 0"), "low balance", F.col("c_custkey"), F.col("c_acctbal"), quality.NOTICE)
    return quality.summary(quality.united(lost, low))


@query(f"""WITH t AS (SELECT p_name AS name, p_type AS gloss, list(DISTINCT p_size % 4) AS sagas FROM part GROUP BY ALL)
SELECT name, gloss FROM t WHERE list_contains(sagas, 2) AND (contains({sql_fold('name')}, 'ring') OR contains({sql_fold('gloss')}, 'ring'))""")
def trees_browsed(spark, d):
    t = table(spark, d, "part").groupBy(F.col("p_name").alias("name"), F.col("p_type").alias("gloss")).agg(F.collect_set(F.col("p_size") % 4).alias("sagas"))
    return graph.browse(t, 2, " Ríng ").select("name", "gloss")


@query("""SELECT o_custkey, array_to_string(list_distinct_in_order, ' ') AS colors FROM (SELECT o_custkey, list_transform(list_sort(list(DISTINCT o_orderkey)), lambda k: printf('#%06x', CAST(k * 7919 % 16777216 AS BIGINT))) AS list_distinct_in_order FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderkey) >= 8)""")
def palettes_of_eight(spark, d):
    """Customers' orders as colours, read back from text; at least eight."""
    t = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderkey")).alias("k")).filter("size(k) >= 8")
    text = F.array_join(F.transform("k", lambda k: F.format_string("- `#%06x` tint", k * 7919 % 16777216)), "\n")
    return t.select("o_custkey", F.array_join(files.palette(text, 8), " ").alias("colors"))


# --- noise, tunes, sound files --------------------------------------------------------------------------------------------


@query("""WITH RECURSIVE g AS (SELECT s_suppkey AS sound, CAST(0 AS BIGINT) AS i, (CASE s_suppkey WHEN 0 THEN 1 ELSE s_suppkey END * 1664525 + 1013904223) % 4294967296 AS st, 20 + s_nationkey AS n FROM supplier
UNION ALL SELECT sound, i + 1, (st * 1664525 + 1013904223) % 4294967296, n FROM g WHERE i + 1 < n) SELECT sound, i, round(st / 4294967296.0 * 2 - 1, 9) AS v FROM g""")
def seeded_noise(spark, d):
    t = table(spark, d, "supplier").selectExpr("s_suppkey AS sound", "s_suppkey AS seed", f"(20 + s_nationkey) / {signal.RATE}D AS seconds")
    return signal.hiss(t).select("sound", "i", F.round("v", 9).alias("v"))


_HELD = "CASE WHEN event_id % 50 = 0 THEN 400 ELSE event_id % 5 * 4 + 4 END"


@query("WITH e AS (SELECT user_id AS tune, event_type AS voice, event_id AS ord, [" + ", ".join(map(lit, _NOTES)) + f"""][event_id % 63 + 1] AS name, {_HELD} AS n FROM events),
s AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY tune, voice ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, 440 * 2 ** ((CASE left(name, 1) WHEN 'C' THEN 0 WHEN 'D' THEN 2 WHEN 'E' THEN 4 WHEN 'F' THEN 5 WHEN 'G' THEN 7 WHEN 'A' THEN 9 ELSE 11 END + CASE substr(name, 2, 1) WHEN '#' THEN 1 WHEN 'b' THEN -1 ELSE 0 END + 12 * (CAST(right(name, 1) AS INT) - 4) - 9) / 12.0) AS hz FROM e),
k AS (SELECT *, unnest(range(CAST(n AS BIGINT))) AS k FROM s)
SELECT tune AS sound, CAST((start + k) % 300 AS BIGINT) AS i, round(sum(sin(2 * pi() * hz * k / 22050) * CASE WHEN k / 22050 < 0.005 THEN k / 22050 / 0.005 ELSE exp(-5 * (k / 22050 - 0.005) / (n / 22050 - 0.005)) * (1 - (k / 22050 - 0.005) / (n / 22050 - 0.005)) END), 6) AS v FROM k GROUP BY ALL""")
def tunes_in_a_loop(spark, d):
    """Events as notes of a voice for each kind of event, laid end to end in a loop of 300 samples."""
    name = F.element_at(F.array(*map(F.lit, _NOTES)), (F.col("event_id") % 63 + 1).cast("int"))
    t = table(spark, d, "events").select(F.col("user_id").alias("tune"), F.col("event_type").alias("voice"), F.col("event_id").alias("ord"), name.alias("name"), (F.expr(_HELD) / signal.RATE).alias("seconds"))
    return signal.sequence(t, F.lit(300)).select("sound", "i", F.round("v", 6).alias("v"))


_LE = "printf('%02x%02x', (({0}) + 65536) % 256, (({0}) + 65536) // 256 % 256)"


@query(f"""WITH s AS (SELECT user_id AS sound, count(*) AS n, string_agg({_LE.format("CAST(floor(least(1, greatest(-1, value / 100)) * 32767 + 0.5) AS BIGINT)")}, '' ORDER BY event_id) AS body FROM events GROUP BY user_id)
SELECT sound, n * 2 + 44 AS bytes, md5('52494646' || {_LE.format("36 + 2 * n")} || '0000' || '57415645666d7420' || '10000000' || '0100' || '0100' || '22560000' || '44ac0000' || '0200' || '1000' || '64617461' || {_LE.format("2 * n")} || '0000' || body) AS print FROM s""")
def wav_files(spark, d):
    t = table(spark, d, "events").select(F.col("user_id").alias("sound"), F.col("event_id").alias("i"), (F.col("value") / 100).alias("v"))
    return signal.wav(t).select("sound", F.length("wav").cast("long").alias("bytes"), F.md5(F.lower(F.hex("wav")).cast("binary")).alias("print"))


# --- pixels ---------------------------------------------------------------------------------------------------------------

_TINT = "l - s2 * least(l, 1 - l) * greatest(-1, least((({0} + 300 / 30.0) % 12) - 3, 9 - (({0} + 300 / 30.0) % 12), 1))"


@query(f"""WITH {_PX}, h0 AS (SELECT *, greatest(r, g, b) / 255.0 AS hi, least(r, g, b) / 255.0 AS lo FROM px), h1 AS (SELECT *, hi - lo AS d, (hi + lo) / 2 AS l FROM h0),
h2 AS (SELECT *, CASE WHEN d = 0 THEN 0 WHEN hi = r / 255.0 THEN (((g - b) / 255.0 / d) % 6 + 6) % 6 * 60 WHEN hi = g / 255.0 THEN ((b - r) / 255.0 / d + 2) * 60 ELSE ((r - g) / 255.0 / d + 4) * 60 END AS h, least(CASE WHEN d = 0 THEN 0 ELSE d / (1 - abs(2 * l - 1)) END, 0.4) AS s2 FROM h1),
h3 AS (SELECT *, h BETWEEN 61 AND 201 AND NOT (r BETWEEN 100 AND 150 AND g < 100) AND a >= 16 AS hit FROM h2)
SELECT image, frame, x, y, {", ".join(f"CAST(CASE WHEN hit THEN floor(({_TINT.format(k)}) * 255 + 0.5) ELSE {c} END AS INT) AS {c}" for c, k in (("r", 0), ("g", 8), ("b", 4)))} FROM h3""")
def retinted_pixels(spark, d):
    skin = F.col("r").between(100, 150) & (F.col("g") < 100)
    return raster.retint(_px(spark, d), 61, 201, 300, 0.4, skin).select("image", "frame", "x", "y", *[F.col(c).cast("int").alias(c) for c in "rgb"])


@query(f"""WITH RECURSIVE {_PX}, colors AS (SELECT DISTINCT r, g, b FROM px UNION SELECT n_nationkey * 10, n_regionkey * 50, n_nationkey * 7 FROM nation), {_OKLAB.replace('lab AS', 'lab AS MATERIALIZED')},
pal AS (SELECT n_nationkey AS idx, r AS pr, g AS pg, b AS pb, ok_l AS pl, ok_a AS pa, ok_b AS pb_ FROM nation JOIN lab ON r = n_nationkey * 10 AND g = n_regionkey * 50 AND b = n_nationkey * 7),
hist AS MATERIALIZED (SELECT image, frame, r, g, b, count(*) AS n FROM px WHERE a >= 16 GROUP BY ALL),
near AS (SELECT r, g, b, arg_min({{'d': sqrt((pl - ok_l) ** 2 + (pa - ok_a) ** 2 + (pb_ - ok_b) ** 2), 'r': pr, 'g': pg, 'b': pb, 'c': sqrt(ok_a ** 2 + ok_b ** 2)}}, (round((pl - ok_l) ** 2 + (pa - ok_a) ** 2 + (pb_ - ok_b) ** 2, 12), idx)) AS p FROM (SELECT DISTINCT r, g, b FROM hist) JOIN lab USING (r, g, b), pal GROUP BY r, g, b),
adopt AS (SELECT r, g, b, {", ".join(f"CASE WHEN p.c >= 0.05 AND p.d <= 0.12 THEN p.{c} ELSE {c} END AS n{c}" for c in "rgb")} FROM near),
mapped AS MATERIALIZED (SELECT image, frame, r, g, b, n, nr, ng, nb FROM hist JOIN adopt USING (r, g, b)), total AS (SELECT image, frame, sum(n) AS tot FROM hist GROUP BY ALL),
sh AS (SELECT image, nr, ng, nb, max(n / tot) AS share FROM (SELECT image, frame, nr, ng, nb, sum(n) AS n FROM mapped GROUP BY ALL) JOIN total USING (image, frame) GROUP BY ALL),
o AS MATERIALIZED (SELECT sh.*, ok_l, ok_a, ok_b, row_number() OVER (PARTITION BY image ORDER BY share DESC, nr, ng, nb) AS k FROM sh JOIN lab ON r = nr AND g = ng AND b = nb),
w AS (SELECT image, k, [{{'k': k, 'l': ok_l, 'a': ok_a, 'b': ok_b}}] AS kept, k AS goes FROM o WHERE k = 1 UNION ALL
SELECT z.image, z.k, CASE WHEN j IS NULL THEN list_append(kept, {{'k': z.k, 'l': z.ok_l, 'a': z.ok_a, 'b': z.ok_b}}) ELSE kept END, coalesce(j, z.k) FROM
(SELECT o.*, w.kept, list_filter(w.kept, lambda x: sqrt((x.l - o.ok_l) ** 2 + (x.a - o.ok_a) ** 2 + (x.b - o.ok_b) ** 2) <= 0.03)[1].k AS j FROM w JOIN o ON o.image = w.image AND o.k = w.k + 1) z),
stay AS (SELECT image, unnest(arg_max(kept, k)[1:16]).k AS k FROM w GROUP BY image),
away AS (SELECT w.image, w.k, arg_min(s.k, (sqrt((y.ok_l - x.ok_l) ** 2 + (y.ok_a - x.ok_a) ** 2 + (y.ok_b - x.ok_b) ** 2), s.k)) AS goes FROM w JOIN o x ON x.image = w.image AND x.k = w.k JOIN stay s ON s.image = w.image JOIN o y ON y.image = s.image AND y.k = s.k
WHERE (w.image, w.goes) NOT IN (SELECT (image, k) FROM stay) GROUP BY ALL),
goal AS (SELECT w.image, w.k, coalesce(away.goes, w.goes) AS goes FROM w LEFT JOIN away ON away.image = w.image AND away.k = w.k)
SELECT DISTINCT m.image, m.r, m.g, m.b, CAST(y.nr AS INT) AS to_r, CAST(y.ng AS INT) AS to_g, CAST(y.nb AS INT) AS to_b FROM mapped m JOIN o USING (image, nr, ng, nb) JOIN goal ON goal.image = m.image AND goal.k = o.k JOIN o y ON y.image = m.image AND y.k = goal.goes""")
def snapped_colors(spark, d):
    pal = table(spark, d, "nation").selectExpr("n_nationkey AS idx", "n_nationkey * 10 AS r", "n_regionkey * 50 AS g", "n_nationkey * 7 AS b")
    return raster.snap(_px(spark, d), pal)


@query(f"""WITH {_PX}, e AS (SELECT image, avg(x) AS ex, avg(y) AS ey FROM px WHERE r < 50 GROUP BY image), m AS (SELECT image, arg_max(y, (n, -y)) AS my FROM (SELECT image, y, count(*) AS n FROM px WHERE g >= 180 AND r >= 50 GROUP BY image, y) GROUP BY image),
t AS (SELECT px.*, abs(x - floor(ex + 0.5)) AS dx, ey, my FROM px LEFT JOIN e USING (image) LEFT JOIN m USING (image)),
i AS (SELECT *, coalesce(dx <= 4 AND ((dx >= 1 AND y = floor(ey - 2 + 0.5 * dx + 0.5)) OR y = floor(my + 2 * (1 - dx * dx / 16.0) + 0.5)), false) AND a >= 16 AS ink FROM t)
SELECT image, frame, x, y, {", ".join(f"CAST(CASE WHEN ink THEN 0 ELSE {c} END AS INT) AS {c}" for c in "rgb")} FROM i""")
def redrawn_faces(spark, d):
    t = _px(spark, d)
    marks = raster.face_marks(t, F.col("r") < 50, (F.col("g") >= 180) & (F.col("r") >= 50))
    return raster.expression(t, marks, 0.5, 2.0).select("image", "frame", "x", "y", *[F.col(c).cast("int").alias(c) for c in "rgb"])


# --- steps of a model, by providers without one ---------------------------------------------------------------------------


@query(r"""WITH m AS (SELECT source, doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{3,}')) AS name FROM documents), c AS (SELECT source, doc_id, name, count(*) AS n FROM m GROUP BY source, doc_id, name QUALIFY row_number() OVER (PARTITION BY source, doc_id ORDER BY n DESC, name) <= 10),
t AS (SELECT source, doc_id, string_agg(name, ',' ORDER BY n DESC, name) AS entities FROM c GROUP BY ALL)
SELECT d.source AS ord, d.doc_id AS chapter, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))[1] AS summary, entities FROM documents d LEFT JOIN t ON t.source = d.source AND t.doc_id = d.doc_id""")
def chapter_digests(spark, d):
    t = table(spark, d, "documents").selectExpr("source AS ord", "doc_id AS chapter", "text")
    names = t.select("ord", "chapter", F.explode(F.regexp_extract_all("text", F.lit("([A-Z][a-z]{3,})"), 1)).alias("name"))
    return semantic.digests(t, names).withColumn("entities", F.array_join("entities", ","))


@query(f"""WITH {MENTIONS}, k AS (SELECT *, {sql_fold('name')} AS key FROM men), f AS (SELECT key, name, count(*) AS n, min((ord, chapter)) AS seen_at FROM k GROUP BY key, name), c AS (SELECT key, arg_min(name, (-n, seen_at, name)) AS canonical FROM f GROUP BY key)
SELECT key, canonical AS name, arg_min(kind, (ord, chapter, name)) AS kind, array_to_string(list_sort(list(DISTINCT ord)), ',') AS books, md5(string_agg(role, ' ' ORDER BY ord, chapter, role)) AS print FROM k JOIN c USING (key) GROUP BY key, canonical""")
def cards_from_mentions(spark, d):
    t = semantic.cards(codex.roll_up(mentions(spark, d)))
    return t.select("key", "name", "kind", F.array_join("books", ",").alias("books"), F.md5(F.col("description").cast("binary")).alias("print"))


@query("SELECT CAST(doc_id AS VARCHAR) AS key, CASE WHEN text = '' THEN '.' ELSE string_split(text, '. ')[1] || '.' END AS answer FROM documents")
def answers_by_provider(spark, d):
    """Documents as prompts, answered in parallel by a provider without a model whose first try always fails."""
    t = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("key"), F.col("text").alias("prompt"))
    return semantic.ask(t, _once_more()).select("key", "answer")


def _once_more():
    tried = set()

    def call(prompt: str) -> str:
        if prompt not in tried:
            tried.add(prompt)
            raise ConnectionError("busy")
        tried.discard(prompt)
        return semantic.extractive(prompt)

    return lambda prompt: semantic.with_retry(call, prompt, sleep=lambda _: None)


_WORDS = "list_filter(string_split(text, ' '), lambda w: w <> '')"


@query(f"""WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents), m AS (SELECT doc_id, list_avg(list_transform(ws, lambda w: length(w))) AS a, list_avg(list_transform(ws, lambda w: unicode(w) % 13)) AS b, 1.0 AS c FROM w WHERE len(ws) > 0)
SELECT doc_id AS id, round(CAST(CAST(a / sqrt(a * a + b * b + 1) AS FLOAT) AS DOUBLE), 4) AS x, round(CAST(CAST(b / sqrt(a * a + b * b + 1) AS FLOAT) AS DOUBLE), 4) AS y, round(CAST(CAST(1 / sqrt(a * a + b * b + 1) AS FLOAT) AS DOUBLE), 4) AS z FROM m""")
def mean_pooled(spark, d):
    """Vectors of words (length, first sign, 1) in place of a model's, pooled and scaled."""
    model = lambda texts: [[[len(w), ord(w[0]) % 13, 1] for w in t.split(" ") if w] for t in texts]
    t = table(spark, d, "documents").selectExpr("doc_id AS id", "text").filter("translate(text, ' ', '') <> ''")
    return semantic.embed(t, model).select("id", *[F.round(F.col("embedding")[k].cast("double"), 4).alias(c) for k, c in enumerate("xyz")])
