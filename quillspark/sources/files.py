"""Sources and sinks of the corpus: page text, JSON cards, events, secrets, guarded writes."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import lexical
from ..operators.scratch import keep

#: Rows in a page of the index: pages without a query's terms are not read.
PAGE_ROWS = 1000


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def extracted(spark: SparkSession, path: str, extract: Callable[[bytes], str]) -> DataFrame:
    """(path, text) of binary files through an extractor (PDF to layout text), in the executors."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "text": [extract(c) for c in pdf["content"]]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, text string")


def missing(catalogue: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Catalogue rows without a file: a build stops on any."""
    return catalogue.join(files.select(key).distinct(), key, "left_anti")


def listing(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """Files below a folder by suffix; names that begin with a dot are skipped."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(path).select("path", "length")
    return found.filter(~F.col("path").rlike(r"/\.[^/]*$"))


def json_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON table, or none of its rows if the path is absent; broken records are left out."""
    fs, where = _there(spark, path)
    if not fs.exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_or_default(col: Column, default: str = "{}") -> Column:
    """Text as VARIANT, the default where it is no JSON."""
    return F.coalesce(F.try_parse_json(col), F.parse_json(F.lit(default)))


def leaves(rows: DataFrame, col: str, name: str) -> DataFrame:
    """(key..., path, value): all leaves called ``name`` of a JSON text column, with their paths. A level of the trees is
    one lateral join; levels follow one another until none has a leaf or branch left."""
    own = [c for c in rows.columns if c != col]
    level = rows.select(*own, F.lit("$").alias("path"), F.lit("").alias("key"), F.try_parse_json(col).alias("v"))
    found = None
    while found is None or not level.isEmpty():
        level.createOrReplaceTempView(view := f"quill_{uuid.uuid4().hex}")
        level = rows.sparkSession.sql(f"SELECT {', '.join([f'l.`{c}`' for c in own] + [''])} concat(l.path, coalesce(concat('.', x.key), concat('[', x.pos, ']'))) AS path, coalesce(x.key, '') AS key, x.value AS v FROM {view} l, LATERAL variant_explode(l.v) x")
        level = keep(level.withColumn("v", F.to_json("v"))).withColumn("v", F.try_parse_json("v"))
        hit = level.filter(F.col("key") == name).select(*own, "path", F.try_variant_get("v", "$", "string").alias("value")).filter("value is not null")
        found = hit if found is None else found.unionByName(hit)
    return found


def notes_by_entity(chapters: DataFrame) -> DataFrame:
    """Chapter digests (ord, chapter, entites array of nom, type, role) exploded and gathered by folded name."""
    from ..functions.text import fold

    e = chapters.select("ord", "chapter", F.explode("entites").alias("e")).select("ord", "chapter", fold(F.col("e.nom")).alias("key"), "e.role")
    return e.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "chapter", "role"))), lambda x: x["role"]).alias("notes"))


def settings(lines: DataFrame) -> DataFrame:
    """NAME=value lines (n, line): first definition wins; blanks and comments skipped; quotes taken off."""
    name, value = F.regexp_extract("line", r"^\s*(?:export\s+)?([A-Za-z_]\w*)\s*=", 1), F.trim(F.regexp_extract("line", r"^[^=]*=(.*)$", 1))
    t = lines.filter(~F.col("line").rlike(r"^\s*(#|$)")).select("n", name.alias("name"), F.regexp_replace(value, "^([\"'])(.*)\\1$", "$2").alias("value")).filter("name <> '' and value <> ''")
    return t.groupBy("name").agg(F.min_by("value", "n").alias("value"))


def palette(text: Column, least: int = 0) -> Column:
    """Distinct #rrggbb colours of a text, in order; fewer than ``least`` are an error."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(#[0-9A-Fa-f]{6})\b"), 1))
    if not least:
        return found
    return F.when(F.size(found) >= least, found).otherwise(F.raise_error(F.concat(F.size(found).cast("string"), F.lit(f" colours, {least} are needed"))))


#: Fixed patterns: keys that must not be published, and files that must not.
SECRETS = [r"sk-ant-[A-Za-z0-9_-]{20,}", r"gh[pousr]_[A-Za-z0-9]{30,}"]
FORBIDDEN = r"(?:^|/)(?:chunks\.json|bm25\.json|embeddings\.bin)$"


def secrets(files: DataFrame) -> DataFrame:
    """Files (path, text) with a secret, or that must not be published."""
    found = F.coalesce(*[F.when(F.col("text").rlike(p), F.lit(f"secret {k}")) for k, p in enumerate(SECRETS)], F.when(F.col("path").rlike(FORBIDDEN), F.lit("forbidden file")))
    return files.select("path", found.alias("why")).filter("why is not null")


def _there(spark: SparkSession, path: str):
    """The file system of a path, and the path itself."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def folders(spark: SparkSession, path: str, files_too: bool = False) -> list[str]:
    """Folders right below a path that are no hidden ones (and files, if asked for); none if there is no such path."""
    fs, where = _there(spark, path)
    if not fs.exists(where):
        return []
    return sorted(str(f.getPath().toString()) for f in fs.listStatus(where) if (files_too or f.isDirectory()) and f.getPath().getName()[0] not in "._")


def put(df: DataFrame, path: str) -> None:
    """Write a table aside and rename it to ``path``, over one that an earlier try left there."""
    spark = df.sparkSession
    parent, name = path.rstrip("/").rsplit("/", 1)
    aside = f"{parent}/.{name}-{uuid.uuid4().hex}"
    df.write.parquet(aside)
    fs, at = _there(spark, path)
    fs.delete(at, True)
    if not fs.rename(_there(spark, aside)[1], at):
        raise OSError(f"{aside} can't take the place of {path}")


_VERSION = r"/v-\d{20}-\w{8}$"


def publish(tables: dict[str, DataFrame], path: str, expected: list[str] | None = None, keep_versions: int = 2, options: dict[str, str] | None = None) -> str:
    """Publish tables as one: they are written into a new version's folder below ``path``, all of ``expected`` (the tables
    themselves by default) must be there and complete, and then a marker is put beside them. Creating that file is the
    only step that counts: until then readers get the version before, from then on this one, never tables of two and never
    none. A publication that fails leaves nothing behind; what one that was killed left goes with the next. The last
    ``keep_versions`` stay, for readers still at work. One writer at a time; a folder that holds anything else is an
    error. Returns the version's folder."""
    spark = next(iter(tables.values())).sparkSession
    there = folders(spark, path, files_too=True)
    strange = [f for f in there if not re.search(_VERSION, f)]
    if strange:
        raise FileExistsError(f"{strange[0]} is no version of a publication")
    folder = f"{path}/v-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    fs, where = _there(spark, folder)
    try:
        for name, df in tables.items():
            df.write.options(**(options or {})).parquet(f"{folder}/{name}")
        lacking = [n for n in (expected or tables) if not fs.exists(_there(spark, f"{folder}/{n}/_SUCCESS")[1])]
        if lacking:
            raise OSError(f"not published, without {', '.join(lacking)}")
        fs.create(_there(spark, f"{folder}/_PUBLISHED")[1], False).close()
    except BaseException:
        fs.delete(where, True)
        raise
    whole = [f for f in there if _complete(spark, f)]
    for old in there:
        if old not in whole or old in whole[: len(whole) + 1 - keep_versions]:
            fs.delete(_there(spark, old)[1], True)
    return folder


def _complete(spark: SparkSession, folder: str) -> bool:
    fs, where = _there(spark, f"{folder}/_PUBLISHED")
    return fs.exists(where)


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the version that is published at ``path`` now, None if there is none. A reader of several tables asks
    once and reads all of them below it."""
    return max((f for f in folders(spark, path) if re.search(_VERSION, f) and _complete(spark, f)), default=None)


def published(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One table of what is published at ``path`` now."""
    at = current(spark, path)
    if at is None:
        raise FileNotFoundError(f"nothing is published at {path}")
    return spark.read.parquet(f"{at}/{name}")


def replace(df: DataFrame, path: str) -> None:
    """Publish a single table, which :func:`latest` reads."""
    publish({"table": df}, path)


def latest(spark: SparkSession, path: str) -> DataFrame:
    return published(spark, path, "table")


def write_guarded(new: DataFrame, path: str, failed: bool) -> bool:
    """Publish a result; if pieces failed, not over one that has more entries. Returns whether it was. Only a path
    without a publication counts as empty; one that can't be read is an error, and stays."""
    spark = new.sparkSession
    if failed and current(spark, path) and latest(spark, path).count() > new.count():
        return False
    replace(new, path)
    return True


def write_by_id(df: DataFrame, path: str, id_col: str = "id", light: list[str] | None = None) -> None:
    """One JSON folder for each entity, and beside them the light index: the columns ``light`` (all plain ones by
    default), a row for each entity."""
    df.write.partitionBy(id_col).mode("overwrite").json(f"{path}/entries")
    plain = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("array", "map", "struct")]
    df.select(*(light or plain)).write.mode("overwrite").json(f"{path}/index")


def write_corpus(chunks: DataFrame, found: lexical.Index, path: str) -> str:
    """The corpus and its search index, published as one: chunks, postings by term, blocks by term and totals."""
    by_term = lambda df, *then: df.repartitionByRange("term", *then).sortWithinPartitions("term", *then)
    tables = {"chunks": chunks, "postings": by_term(found.postings, "block", "doc"), "blocks": by_term(found.blocks, "block"), "stats": found.stats}
    return publish(tables, path, options={"parquet.page.row.count.limit": str(PAGE_ROWS)})


def read_index(spark: SparkSession, path: str) -> lexical.Index:
    """The search index that is published at ``path`` now."""
    at = current(spark, path)
    return lexical.Index(*[spark.read.parquet(f"{at}/{name}") for name in ("postings", "blocks", "stats")])


def write_manifest(stats: DataFrame, path: str) -> None:
    stats.coalesce(1).write.mode("overwrite").json(path)


def write_vectors(vectors: DataFrame, path: str, dimensions: int) -> None:
    """Vectors with a sidecar row of their number and length."""
    vectors.write.mode("overwrite").parquet(path)
    vectors.agg(F.count(F.lit(1)).alias("n"), F.lit(dimensions).alias("dim")).write.mode("overwrite").json(f"{path}.meta")


def events_out(events: DataFrame) -> DataFrame:
    return events.select(F.to_json(F.struct(*events.columns)).alias("value"))


def whole_lines(parts: DataFrame) -> DataFrame:
    """Lines (source, line, value) of text that came in parts (source, seq, value): the end of one part and the start of
    the next are one line where no line break lies between them."""
    pieces = parts.withColumn("p", F.split("value", "\n", -1))
    before = F.sum(F.size("p") - 1).over(Window.partitionBy("source").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    t = pieces.withColumn("at", F.coalesce(before, F.lit(0))).select("source", "seq", "at", F.posexplode("p").alias("k", "piece"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "piece"))), lambda x: x["piece"]), "")
    return t.groupBy("source", (F.col("at") + F.col("k")).alias("line")).agg(whole.alias("value"))


def events_in(lines: DataFrame, schema: str) -> DataFrame:
    """NDJSON lines as events; blank and broken ones are skipped."""
    good = lines.filter((F.trim("value") != "") & F.try_parse_json("value").isNotNull())
    return good.select(F.from_json("value", schema).alias("e")).select("e.*")


def with_prefix(*folders: tuple[str, DataFrame]) -> DataFrame:
    """Assets (name) of several folders under their prefixes."""
    out = None
    for prefix, df in folders:
        part = df.withColumn("name", F.concat(F.lit(prefix), "name"))
        out = part if out is None else out.unionByName(part)
    return out


def absent(required: DataFrame, assets: DataFrame) -> DataFrame:
    """Required names that no folder has; a build stops on any."""
    return required.select("name").distinct().join(assets.select("name"), "name", "left_anti")


def local_first(wanted: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """The newest local folder of a name (last in text order, so v10 comes before v2), else the remote entry of that name
    whatever its case, idle ones preferred."""
    mine = local.groupBy("name").agg(F.max(F.struct("folder", "id")).alias("x")).select("name", F.col("x.id").alias("local_id"))
    far = remote.groupBy(F.lower("name").alias("k")).agg(F.min_by("id", F.struct(F.when(F.col("state") == "idle", 0).otherwise(1).alias("s"), "id")).alias("remote_id"))
    t = wanted.join(mine, "name", "left").withColumn("k", F.lower("name")).join(far, "k", "left")
    return t.select("name", F.coalesce("local_id", "remote_id").alias("id"))


def prompt_targets(orders: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Orders (name) with their entity by id, else by folded name; and the misses."""
    from ..functions.text import fold

    by_id = entries.select(F.col("id").alias("name"), F.col("id").alias("a"))
    by_name = entries.groupBy(fold(F.col("name")).alias("key")).agg(F.min("id").alias("b"))
    t = orders.join(by_id, "name", "left").withColumn("key", fold(F.col("name"))).join(by_name, "key", "left").select("name", F.coalesce("a", "b").alias("id"))
    return t.filter("id is not null"), t.filter("id is null").select("name")


def status(catalogue: DataFrame, chunks: DataFrame) -> DataFrame:
    """Volumes, volumes with chunks, and chunks."""
    have = chunks.groupBy("book").agg(F.count(F.lit(1)).alias("n"))
    return catalogue.join(have, "book", "left").agg(F.count(F.lit(1)).alias("volumes"), F.count("n").alias("indexed"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"))
