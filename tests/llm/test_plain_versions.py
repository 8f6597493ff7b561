"""Operators against plain versions that share no code with them, and odd rows beside columns of clashing names."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import chat, language_id, licenses, near_dedup, packing, topk, toxicity

CLASH = ("id", "n", "d", "q", "v", "row", "text2", "held_out2", "part", "piece2", "threshold2", "comp", "digest", "words", "dice2")


@pytest.fixture(scope="module")
def odd(spark):
    long = "je suis une phrase " * 30_000
    rows = [(1, None), (2, ""), (3, long), (4, "same text here"), (4, "same text here"), (5, "same text here"), (None, "no id")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("fr"), "source": F.lit("s"), **{c: F.lit("clash") for c in CLASH}})


def test_convolution_equals_plain_loops(monkeypatch):
    model, r = toxicity.Model(), np.random.RandomState(2)
    model.bias = r.normal(0, 0.1, model.bias.shape).astype(np.float32)
    table = r.normal(0, 1, (50, toxicity.SIZE)).astype(np.float32)
    for n in (0, 1, 2, 3, 9, 57):
        codes = r.randint(0, 50, n)
        rows = [table[c].astype(float) for c in codes]
        rows += [np.zeros(toxicity.SIZE)] * (max(toxicity.WIDTHS) - n)
        want, at = 0.0, 0
        for w in toxicity.WIDTHS:
            for f in range(toxicity.FILTERS):
                best = max(sum(float(rows[t + k] @ model.filters[w][k, :, f]) for k in range(w)) for t in range(len(rows) - w + 1))
                want += max(0.0, best + float(model.bias[at])) * float(model.out[at])
                at += 1
        assert model.logit(table, codes, model.stacked()) == pytest.approx(want + model.out_bias, abs=1e-3)
        with monkeypatch.context() as m:
            m.setattr(toxicity, "PART", 4)
            assert model.logit(table, codes, model.stacked()) == pytest.approx(want + model.out_bias, abs=1e-3)


@pytest.mark.parametrize("words", [2, 5])
def test_near_dedup_equals_plain_sets(spark, data, words):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    sets = {}
    for r in docs.collect():
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"] or "").replace("\x0b", " ").replace("\x0c", " ").encode().split()
        sets[r["doc_id"]] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    low = {i: i for i in sets}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    moved = True
    while moved:
        moved = False
        for a, b in links:
            least = min(low[a], low[b])
            moved |= low[a] != least or low[b] != least
            low[a] = low[b] = least
    got = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in near_dedup.near_dedup(docs, words=words).collect()}
    assert got == {i: (low[i], len(sets[i])) for i in ids}


def test_odd_rows_of_scans(spark, odd):
    marks = spark.createDataFrame([(k, k % 2) for k in range(3, 6)], "doc_id long, toxic int").withColumn("y", F.lit("clash"))
    scored = toxicity.toxicity(odd, toxicity.train(odd, marks)).collect()
    assert len(scored) == 7 and all(0 <= r["score"] <= 1 for r in scored)
    assert len({r["score"] for r in scored if r["doc_id"] in (4, 5)}) == 1
    model = language_id.train(odd, packing.vocabulary(language_id.VOCABULARY))
    named = {r["doc_id"]: r["lang_pred"] for r in language_id.language_id(odd, model).collect()}
    assert named[1] == named[2] == "und" and named[4] == named[5]
    found = licenses.license_scan(odd).collect()
    assert len(found) == 7 and all(r["license"] is None for r in found)
    pieces = packing.pack(odd, packing.vocabulary()).collect()
    assert sum(r["piece"] == 0 for r in pieces) == 7 and max(r["length"] for r in pieces) <= 2048


def test_odd_rows_of_search_and_chat(spark):
    rows = [(0, [1.0] * 3), (0, [1.0] * 3), (50, None), (3, []), (4, [float("inf")] * 3)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in CLASH})
    assert sorted(tuple(r) for r in topk.top_k(vectors, lambda i: i % 50 == 0).collect()) == [(0, 1, 0, 3 * 65536)] * 2
    text = "mot " * 100_000
    talk = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", None), (1, 1, "assistant", "<s>")], "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("tree", "node", "parent", "score", "formatted", "loss")})
    out = chat.chat_format(chat.linear_trees(talk)).withColumn("turns", chat.read_back(F.col("formatted"))).first()
    assert [t["text"] for t in out["turns"]] == [text, "", "<s>"]
    assert hashlib.sha256(out["turns"][0]["text"].encode()).hexdigest() == hashlib.sha256(text.encode()).hexdigest()
