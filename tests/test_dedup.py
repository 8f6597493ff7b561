"""Greedy near-duplicate removal against the plain walk, and buckets of many equal keys."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import dedup


def walk(rows):
    """(id, grams, sketch) in order of ids: the first kept text by key, then by id, that is similar enough."""
    kept, out = [], {}
    for i, grams, sketch in sorted(rows, key=lambda r: r[0]):
        g = set(grams)
        keys = [tuple(sketch[b : b + 3]) for b in range(0, len(sketch) - 2, 3)]
        same = None
        if len(g) >= dedup.MIN_SHINGLES:
            found = [(keys.index(k), j) for j, h, ks in kept for k in keys if k in ks and len(g & h) / min(len(g), len(h)) >= dedup.THRESHOLD]
            same = min(found)[1] if found else None
            if same is None:
                kept.append((i, g, set(keys)))
        out[i] = same
    return out


def families(r, groups, size, shared=0):
    """Texts in families of near copies; ``shared`` words at the start are those of all texts."""
    common = [f"c{k}q" for k in range(shared)]
    rows, i = [], 0
    for g in range(groups):
        words = [f"g{g}w{k}" for k in range(90)]
        for _ in range(size):
            own = list(words)
            for at in r.sample(range(90), r.choice([0, 1, 3, 8, 14])):
                own[at] = f"x{i}y{at}"
            rows.append((i, " ".join(common + own[: r.choice([90, 90, 75])])))
            i += 1
    r.shuffle(rows)
    return [(k, t) for k, (_, t) in enumerate(rows)]


@pytest.mark.parametrize("small,probes,shared", [(64, 8, 0), (4, 3, 30)])
def test_walk(spark, monkeypatch, small, probes, shared):
    monkeypatch.setattr(dedup, "SMALL", small)
    monkeypatch.setattr(dedup, "PROBES", probes)
    rows = families(random.Random(small * 10 + probes), 3, 12, shared) + [(900, "short text"), (901, "short text"), (902, None), (903, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sketched = [(r["id"], r["grams"], list(r["sketch"])) for r in dedup.sketches(docs).collect()]
    got = {r["id"]: r["same_as"] for r in dedup.dedupe(docs).collect()}
    assert got == walk(sketched)
    assert {r["id"] for r in dedup.dedupe(docs).filter("kept").collect()} == {i for i, s in got.items() if s is None}


def test_documents_of_the_test_tables(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    sketched = [(r["id"], r["grams"], list(r["sketch"])) for r in dedup.sketches(docs).collect()]
    assert {r["id"]: r["same_as"] for r in dedup.dedupe(docs).collect()} == walk(sketched)


def test_a_band_of_very_many_equal_keys(spark):
    """30,000 texts in one bucket: near copies of one another, but for a few that stand for themselves."""
    base = F.array(*[F.xxhash64(F.lit(f"s{k}")) for k in range(80)])
    own = F.transform(F.sequence(F.lit(1), F.lit(20)), lambda k: F.xxhash64("id", k))
    alone = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda k: F.xxhash64("id", k, F.lit("alone")))
    first = spark.range(30_000).select("id", F.array(*[F.lit(k).cast("long") for k in range(16)]).alias("sketch"), F.when(F.col("id") % 6_000 == 7, alone).otherwise(F.concat(base, own)).alias("hs"))
    first = dedup.keep(first)
    state, links = dedup._walked(first, dedup.THRESHOLD)
    assert sorted(r["id"] for r in state.filter("kept").collect()) == [0, 7, 6_007, 12_007, 18_007, 24_007]
    assert state.count() == 30_000 and links.count() < 600_000
