"""Streaming operators, driven from files to the end."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from quillspark.streaming import events as ev
from quillspark.streaming.processors import Saves

CHAT = "turn string, block int, seq int, type string, payload string"


@pytest.fixture
def run(spark, tmp_path):
    def drive(batches, schema, op, mode):
        src, rows = tmp_path / "src", []
        for batch in batches:  # one run for each, so that they come in this order
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").json(str(src))
            stream = spark.readStream.schema(schema).json(str(src))
            q = op(stream).writeStream.outputMode(mode).foreachBatch(lambda df, _: rows.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            q.awaitTermination()
        return rows

    return drive


def test_citations_wait_for_their_stop(run):
    batches = [[("t", 1, 1, "citation", "4"), ("t", 2, 2, "citation", "7"), ("t", 1, 3, "citation", "4")], [("t", 1, 4, "citation", "2"), ("t", 1, 5, "stop", None)], [("t", 1, 6, "stop", None)]]
    assert [(r["block"], r["numbers"]) for r in run(batches, CHAT, ev.citation_blocks, "append")] == [(1, [4, 2])]


def test_transcript_puts_out_what_is_new(run):
    batches = [
        [("t", 0, 1, "text", "a"), ("t", 0, 2, "thinking", "z")], [("t", 0, 4, "text", "c"), ("t", 0, 2, "thinking", "again")],
        [("t", 0, 3, "text", "b"), ("t", 0, 5, "done", None)],
    ]
    rows = run(batches, CHAT, ev.transcript, "append")
    assert [(r["seq"], r["text"], r["thinking"]) for r in rows] == [(1, "a", "z"), (3, "bc", "")]


def test_read_out(spark):
    pieces = spark.createDataFrame([("t", 3, "bc", ""), ("t", 1, "a", "z")], "turn string, seq long, text string, thinking string")
    assert [tuple(r) for r in ev.read_out(pieces).collect()] == [("t", "abc", "z")]


def test_saves_put_out_changes_and_never_fall(run, spark):
    schema = "slot string, seq int, kind string, value string"
    batches = [[("s", 1, "reach", "4"), ("s", 2, "meet", "b")], [("s", 3, "reach", "2"), ("s", 4, "meet", "a"), ("s", 5, "take", "k"), ("s", 6, "meet", "b")], [("s", 7, "meet", "a"), ("s", 8, "reach", "3")]]
    rows = run(batches, schema, ev.saves, "append")
    assert [tuple(r) for r in rows] == [("s", 4, ["b"], []), ("s", 4, ["a"], ["k"])]
    now = ev.save_now(spark.createDataFrame(rows, Saves.SCHEMA)).first()
    assert tuple(now) == ("s", 4, ["a", "b"], ["k"])


PART = "source string, seq long, value string"


def test_a_line_over_two_batches_comes_out_once(run):
    batches = [[("s", 0, 'x\n{"k": '), ("r", 0, "{\"k\": 9}\n")], [("s", 1, "1}"), ("s", 1, "1}")], [("s", 2, '\n\nbroken {\n{"k": 2'), ("s", 4, "late\n")], [("s", 3, "}\n")], [("s", 5, '{"k": 3}'), ("s", 6, None)]]
    rows = run(batches, PART, lambda s: ev.stream_lines(s), "append")
    assert [(r["line"], r["value"]) for r in rows if r["source"] == "s"] == [(0, "x"), (1, '{"k": 1}'), (2, ""), (3, "broken {"), (4, '{"k": 2}'), (5, "late"), (6, '{"k": 3}')]
    assert [(r["line"], r["value"]) for r in rows if r["source"] == "r"] == [(0, '{"k": 9}')]


def test_events_of_a_stream(run):
    batches = [[("s", 0, 'x\n{"k": ')], [("s", 1, "1}\n \n")], [("s", 2, '{"k": 2}\n{"k'), ("s", 3, None)]]
    assert [r["k"] for r in run(batches, PART, lambda s: ev.stream_events(s, "k int"), "append")] == [1, 2]


def test_no_piece_waits_after_a_line_break(run, spark, tmp_path):
    run([[("s", 0, "a\nb")]], PART, ev.stream_lines, "append")
    held = lambda: spark.read.format("statestore").option("stateVarName", "rest").load(str(tmp_path / "cp")).count()
    assert held() == 1
    run([[("s", 1, "c\n")]], PART, ev.stream_lines, "append")
    assert held() == 0


def test_combat(run):
    schema = "target string, t double, amount double, life double"
    rows = run([[("x", 0.0, 3.0, 10.0), ("x", 0.2, 3.0, 10.0), ("x", 1.0, 0.2, 10.0)]], schema, ev.combat, "update")
    assert rows[-1]["life"] == 6.0


def upper(df):
    return df.select("key", F.when(F.col("key") != "bad", F.upper("text")).otherwise("").alias("result"))


def result(spark, path):
    return {r["key"]: r["result"] for r in ev.built(spark, path).collect()}


def test_incremental_builds_what_is_new_or_changed(spark, tmp_path):
    path, seen = str(tmp_path / "cache"), []

    def build(df):
        seen.append(sorted(r["key"] for r in df.select("key").collect()))
        return upper(df)

    step = ev.incremental(build, path)
    frame = lambda *rows: spark.createDataFrame(rows, "key string, text string")
    assert ev.built(spark, path) is None
    step(frame(("a", "x"), ("bad", "x")), 0)
    step(frame(("a", "x"), ("bad", "x"), ("c", "x")), 1)
    step(frame(("a", "y"), ("c", "x")), 2)
    step(frame(("a", "y"), ("c", "x")), 2)  # replayed: as if for the first time
    step(frame(("a", "x")), 3)  # back to what it was
    assert seen == [["a", "bad"], ["bad", "c"], ["a"], ["a"], ["a"]]
    assert result(spark, path) == {"a": "X", "c": "X"}
    assert spark.read.parquet(path).count() == 4


def test_a_run_stopped_before_its_commit_counts_once(spark, tmp_path):
    src, path, tries = str(tmp_path / "src"), str(tmp_path / "cache"), []
    spark.createDataFrame([("a", "x"), ("b", "y")], "key string, text string").coalesce(1).write.json(src)
    step = ev.incremental(upper, path)

    def once(df, batch):
        step(df, batch)
        tries.append(batch)
        if len(tries) == 1:
            raise RuntimeError("stopped after the build, before the commit")

    def start():
        stream = spark.readStream.schema("key string, text string").json(src)
        return stream.writeStream.foreachBatch(once).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()

    with pytest.raises(StreamingQueryException):
        start().awaitTermination()
    start().awaitTermination()
    assert tries == [0, 0]
    assert result(spark, path) == {"a": "X", "b": "Y"}
    assert spark.read.parquet(path).count() == 2


def test_fall_back(spark):
    rows = [("a", "error"), ("b", "text"), ("b", "error"), ("c", "text")]
    got = {r["turn"]: r["retry"] for r in ev.may_fall_back(spark.createDataFrame(rows, "turn string, type string")).collect()}
    assert got == {"a": True, "b": False, "c": False}


def test_late_events_are_dropped(run):
    schema = "event_type string, ts timestamp, value double"
    import datetime as dt

    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    batches = [[("a", at(1), 1.0)], [("a", at(9), 1.0)], [("a", at(1, 5), 1.0)], [("a", at(20), 1.0)]]
    rows = run(batches, schema, lambda s: ev.tumbling(s, late="1 hour"), "append")
    assert {(r["start"].hour, r["n"]) for r in rows} >= {(1, 1), (9, 1)}
