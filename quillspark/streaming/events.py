"""Structured Streaming: citation buffers, transcripts, incremental builds, saves, combat ticks; event-time windows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import files
from .processors import Citations, Saves, Transcript, WholeLines, with_state

def stream_lines(parts: DataFrame, first: int = 0, ttl: int | None = None) -> DataFrame:
    """Whole lines (source, line, value) of a stream of text parts (source, seq, value): see :class:`WholeLines`. A batch
    frame has all of its parts, so it needs no state."""
    if not parts.isStreaming:
        return _lines_at_once(parts, first)
    return with_state(parts, ["source"], WholeLines(first, ttl), WholeLines.SCHEMA, ttl)


def _lines_at_once(parts: DataFrame, first: int) -> DataFrame:
    """What :class:`WholeLines` gives for all parts in one batch. A source is dealt to a task once and sorted there; a
    null part counts as a line break that ends no empty line, and a line without an end is none."""
    by = Window.partitionBy("source").orderBy("seq")
    t = parts.select(F.col("source").cast("string").alias("source"), F.col("seq").cast("long").alias("seq"), "value").filter(F.col("seq") >= first)
    t = t.repartition("source").withColumn("before", F.lag("seq").over(by)).filter(F.col("before").isNull() | (F.col("seq") > F.col("before")))
    t = t.withColumn("place", F.row_number().over(by)).filter(F.col("seq") == F.col("place") - 1 + first)
    pieces = t.select("source", "seq", F.col("value").isNull().alias("ends"), F.when(F.col("value").isNull(), F.array(F.lit(""), F.lit(""))).otherwise(F.split("value", "\n", -1)).alias("p"))
    breaks = F.sum(F.size("p") - 1).over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = pieces.withColumn("at", F.coalesce(breaks, F.lit(0))).select("source", "seq", "ends", "at", F.size("p").alias("n"), F.posexplode("p").alias("k", "piece"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "piece"))), lambda x: x["piece"]), "")
    whole = rows.groupBy("source", (F.col("at") + F.col("k")).alias("slot")).agg(text.alias("value"), F.bool_or(F.col("k") < F.col("n") - 1).alias("done"), F.bool_or(F.col("ends") & (F.col("k") == 0)).alias("ends"))
    given = whole.filter("done and not (ends and value = '')")
    line = F.row_number().over(Window.partitionBy("source").orderBy("slot")).cast("long") - 1
    return given.select("source", line.alias("line"), "value")


def stream_events(parts: DataFrame, schema: str, first: int = 0, ttl: int | None = None) -> DataFrame:
    """Events of NDJSON that arrives in parts; blank and broken lines are skipped."""
    return files.events_in(stream_lines(parts, first, ttl), schema)


def citation_blocks(events: DataFrame, ttl: int | None = None) -> DataFrame:
    """Events (turn, block, seq, type, payload): ``citation`` payloads are numbers, kept apart for each block and given
    out, each once and in order, when its ``stop`` comes. A block that never stops gives nothing."""
    return with_state(events, ["turn", "block"], Citations(ttl), Citations.SCHEMA, ttl)


def transcript(events: DataFrame, first: int = 1, ttl: int | None = None) -> DataFrame:
    """Events (turn, seq, type, payload) as what each batch adds: see :class:`Transcript`. ``read_out`` puts it together."""
    return with_state(events, ["turn"], Transcript(first, ttl), Transcript.SCHEMA, ttl)


def read_out(pieces: DataFrame) -> DataFrame:
    """The transcripts so far (turn, text, thinking) from the rows that :func:`transcript` has put out."""
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", c))), lambda x: x[c]), "").alias(c)
    return pieces.groupBy("turn").agg(joined("text"), joined("thinking"))


def may_fall_back(events: DataFrame) -> DataFrame:
    """Turns (turn, type) that may be run a second time: they ended in an error and had put out nothing."""
    return events.groupBy("turn").agg((F.bool_or(F.col("type") == "error") & ~F.bool_or(F.col("type").isin("text", "thinking"))).alias("retry"))


def _prints(rows: DataFrame, key: str, content: list[str] | None) -> DataFrame:
    """Rows with a fingerprint of their content, one for each key (if a batch has several, the smallest print's)."""
    cols = content if content is not None else [c for c in rows.columns if c != key]
    printed = rows.withColumn("print", F.sha1(F.to_json(F.struct(F.lit(1).alias("v"), *cols)).cast("binary")))
    return printed.groupBy(key).agg(F.min_by(F.struct(*printed.columns), "print").alias("r")).select("r.*")


def built(spark: SparkSession, path: str, besides: int | None = None) -> DataFrame | None:
    """The last result of each key (key, result, print, batch) that incremental builds left at ``path``, or None before
    the first. ``besides`` leaves out what one batch wrote."""
    folders = [f for f in files.folders(spark, path) if re.search(r"/batch=\d+$", f) and not f.endswith(f"/batch={besides}")]
    if not folders:
        return None
    rows = spark.read.option("basePath", path).parquet(*folders)
    key = rows.columns[0]
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), "batch").alias("r")).select(key, "r.*")


def incremental(build: Callable[[DataFrame], DataFrame], path: str, key: str = "key", content: list[str] | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: builds what is new or has changed, and adds it. ``build`` takes rows and returns (key, result).

    A key is built again when the fingerprint of its content (the columns ``content``, or all but the key) is not that of
    its last result. Empty results are not kept, so they are tried again. A batch's results are one folder with its id,
    written aside and renamed: a batch that is replayed sees the cache as it was before it, and takes the place of what it
    left then. So each batch counts exactly once, wherever a run was stopped.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        todo = _prints(batch, key, content)
        have = built(spark, path, besides=batch_id)
        if have is not None:
            todo = todo.join(have.select(key, "print"), [key, "print"], "left_anti")
        done = build(todo.drop("print")).filter(F.col("result").isNotNull() & (F.col("result") != "")).select(key, "result")
        files.put(done.join(todo.select(key, "print"), key), f"{path}/batch={batch_id}")

    return run


def uncached(wanted: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    return wanted.join(cache.select(key), key, "left_anti")


def saves(events: DataFrame, ttl: int | None = None) -> DataFrame:
    """Play events (slot, seq, kind: reach / meet / take, value) as changes of a save: see :class:`Saves`."""
    return with_state(events, ["slot"], Saves(ttl), Saves.SCHEMA, ttl)


def save_now(changes: DataFrame) -> DataFrame:
    """Saves (slot, reached, met, bag) from the changes that :func:`saves` has put out."""
    whole = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return changes.groupBy("slot").agg(F.max("reached").alias("reached"), whole("met"), whole("bag"))


def combat(blows: DataFrame, grace: float = 0.45) -> DataFrame:
    """Blows (target, t, amount, life): what is left of each target's life. A blow within ``grace`` seconds of the last
    one that counted does nothing; life starts at the first blow's ``life``."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, life = state.get if state.exists else (-1e18, None)
        for r in pd.concat(list(batches)).sort_values("t").itertuples():
            life = r.life if life is None else life
            if r.t - last >= grace and life > 0:
                last, life = r.t, max(0.0, life - max(1.0, r.amount))
        state.update((float(last), float(life)))
        yield pd.DataFrame([(*key, float(life))], columns=["target", "life"])

    return blows.groupBy("target").applyInPandasWithState(run, "target string, life double", "last double, life double", "update", GroupStateTimeout.NoTimeout)


# --- offered on top: event time -----------------------------------------------------------------------------------------


def tumbling(events: DataFrame, size: str = "1 hour", late: str | None = None, slide: str | None = None) -> DataFrame:
    e = events.withWatermark("ts", late) if late else events
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return e.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
