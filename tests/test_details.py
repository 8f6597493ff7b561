"""Noise in blocks, findings counted, trees browsed, palettes that are too small."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import graph, layout, quality, signal
from quillspark.plans import details, registry
from quillspark.sources import files


def test_noise_jumps_to_its_blocks(spark):
    state, want = 7, []
    for _ in range(signal.BLOCK + 50):
        state = (state * 1_664_525 + 1_013_904_223) % (1 << 32)
        want.append(state / (1 << 32) * 2 - 1)
    t = spark.createDataFrame([("a", 7, len(want) / signal.RATE), ("b", 0, 0.0), ("c", None, 1.0), (None, 1, 2 / signal.RATE)], "sound string, seed long, seconds double")
    got = signal.hiss(t).toPandas()
    a = got[got["sound"] == "a"].sort_values("i")
    assert a["i"].tolist() == list(range(len(want))) and np.array_equal(a["v"].to_numpy(), np.array(want))
    assert (got["sound"] == "b").sum() == 1 and (got["sound"] == "c").sum() == 0 and got["sound"].isna().sum() == 2
    assert signal.hiss(t.limit(0)).count() == 0


def test_summary_of_findings(spark):
    none = spark.createDataFrame([], "check string, severity string, subject string, detail string")
    assert [tuple(r) for r in quality.summary(none).collect()] == [(None, 0, 0, False)]
    some = spark.createDataFrame([("x", "notice", "1", ""), ("x", "fault", "2", ""), ("y", "notice", "3", "")], none.schema)
    got = {r["check"]: tuple(r)[1:] for r in quality.summary(some).collect()}
    assert got == {"x": (1, 1, True), "y": (0, 1, False), None: (1, 2, True)} and quality.failed(some) and not quality.failed(none)


def test_browsing_trees(spark):
    t = spark.createDataFrame([("Orvan", "un Roi déchu", [1, 2]), ("Mirel", None, [2]), (None, "roide", None)], "name string, gloss string, sagas array<int>")
    names = lambda df: {r["name"] for r in df.collect()}
    assert names(graph.browse(t)) == {"Orvan", "Mirel", None} and names(graph.browse(t, 2)) == {"Orvan", "Mirel"}
    assert names(graph.browse(t, needle=" DECHU ")) == {"Orvan"} and names(graph.browse(t, needle="roi")) == {"Orvan", None} and names(graph.browse(t, 1, "mirel")) == set()


def test_small_palettes_are_errors(spark):
    t = spark.createDataFrame([("#010203 #010203 #0a0b0c",)], "text string")
    assert t.select(files.palette(F.col("text"), 2)).first()[0] == ["#010203", "#0a0b0c"]
    with pytest.raises(Exception, match="2 colours, 8 are needed"):
        t.select(files.palette(F.col("text"), 8)).collect()


def test_headers_are_found_in_the_query(spark, data):
    """The query's lines hold headers of each kind, so its SQL tests something."""
    out = registry.QUERIES["lines_without_headers"](spark, data).toPandas()
    assert not out["text"].str.startswith("THE ROAD").any() and out["text"].str.startswith("Nothing like").any() and out["text"].str.startswith("TNE ROAB").any()
    assert details and layout
