"""Search over several cells of candidates and blocks of queries against brute force."""

import numpy as np
import pytest

from quillspark.llm import topk


def force(rows, k):
    out = []
    for at, (i, v) in enumerate(rows):
        if i % 50 == 0:
            q = [int(np.floor(256 * x)) for x in v]
            best = sorted((-sum(a * int(np.floor(256 * x)) for a, x in zip(q, w, strict=True)), j) for n, (j, w) in enumerate(rows) if n != at and len(w) == len(v))[:k]
            out += [(i, n, j, -s) for n, (s, j) in enumerate(best, 1)]
    return sorted(out)


def vectors(kind):
    r = np.random.RandomState(5)
    x = r.normal(0, 0.1, (500, 8))
    if kind == "equal norms":
        x /= np.linalg.norm(x, axis=1)[:, None]
    if kind == "ties":
        x = np.round(x, 1)
    if kind == "few large":
        x *= np.where(r.rand(500) < 0.05, 30, 1)[:, None]
    if kind == "one direction":
        x = np.abs(x) * r.uniform(0.1, 9, 500)[:, None]
    if kind == "below zero":  # all scores are negative but those among queries
        x = np.abs(x) * np.where(np.arange(500) % 50 == 0, -1, 1)[:, None]
    ids = np.arange(500) if kind != "ties" else np.arange(500) // 2 * 2  # each id twice
    return [(int(i), [float(np.float32(c)) for c in (v[:5] if kind == "lengths" and i % 3 else v)]) for i, v in zip(ids, x, strict=True)]


@pytest.mark.parametrize("kind", ["plain", "equal norms", "ties", "few large", "one direction", "below zero", "lengths"])
def test_many_cells_and_blocks(spark, kind):
    rows = vectors(kind)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(df, lambda i: i % 50 == 0, values=8 * 6, least_rows=40)  # cells of 6 to 9, blocks of as many queries
    assert sorted(tuple(r) for r in got.collect()) == force(rows, 5)


def test_fewer_candidates_than_asked_for(spark):
    rows = [(0, [1.0, 2.0]), (1, [3.0, 1.0]), (2, [0.5, 0.0]), (50, [1.0, 1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), lambda i: i % 50 == 0, values=2, least_rows=1)
    assert sorted(tuple(r) for r in got.collect()) == force(rows, 5)


def test_bands_that_cannot_reach_are_left_out(spark, monkeypatch):
    """Large vectors in all queries' direction: what is short is never compared in the second pass."""
    seen = []
    plain = topk.materialize

    def watched(df, name):
        out = plain(df, name)
        if name == "left":
            seen.extend(r["reach"] for r in out.select("reach").collect())
        return out

    monkeypatch.setattr(topk, "materialize", watched)
    rows = [(k, [9.0 - k / 1000, 0.0]) if k < 120 else (k, [0.01, 0.0]) for k in range(600)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), lambda i: i % 50 == 0, values=2 * 50, least_rows=50)
    assert sorted(tuple(r) for r in got.collect()) == force(rows, 5)
    assert len(seen) <= 12 and max(seen, default=0) < 4


def test_very_long_vectors(spark):
    r = np.random.RandomState(1)
    rows = [(k, [float(np.float32(x)) for x in r.normal(0, 1, 5000)]) for k in range(60)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), lambda i: i % 50 == 0, values=20_000)
    assert sorted(tuple(r) for r in got.collect()) == force(rows, 5)
