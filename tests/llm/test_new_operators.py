"""Whitening, quality rules and phrase mining against plain versions, and on odd rows."""

import re
from collections import Counter
from decimal import Decimal
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import phrases, quality_rules, whitening

DOCS = "doc_id long, text string, lang string"
CLASH = ("n", "n_words", "words", "norm", "windows", "lines", "id", "v", "d", "w", "phrase", "a", "rank", "h", "score", "component")


def clash(df):
    return df.withColumns({k: F.lit("clash") for k in CLASH if k not in df.columns})


# --- whitening ----------------------------------------------------------------------------------------------------------


def plain_whitening(vectors):
    x = np.floor(1024 * np.array(vectors, float)) + 100_000
    n, s = len(x), x.sum(0)
    v = (x - s / n).T @ (x - s / n) / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    whole = x.astype(np.int64).astype(object)
    deviation = ((n * whole - whole.sum(0)) ** 2).sum(1)
    return e, (x - s / n) @ u[:, :8] / np.sqrt(np.maximum(e[:8], 1e-300)), deviation


@pytest.mark.parametrize("d", [1, 2, 3, 11, 24])
def test_jacobi(d):
    r = np.random.RandomState(d)
    a = r.normal(size=(d, d))
    a = a @ np.diag(10.0 ** r.uniform(-3, 3, d)) @ a.T
    e, v = whitening.jacobi(a)
    assert np.allclose(e, np.sort(np.linalg.eigvalsh(a))[::-1], rtol=1e-9, atol=1e-9 * np.abs(a).max())
    assert np.allclose(v.T @ v, np.eye(d), atol=1e-13) and np.allclose(v * e @ v.T, a, atol=1e-12 * np.abs(a).max())


def test_small_eigenvalues_are_accurate():
    """A graded matrix: rotations keep what is far below the largest value's rounding."""
    scale = 10.0 ** -np.arange(0, 12, 2)
    a = (np.eye(6) + 0.1) * np.outer(scale, scale)
    e, _ = whitening.jacobi(a)
    least = 1 / np.linalg.eigvalsh(np.linalg.inv(np.eye(6) + 0.1) / np.outer(scale, scale))[-1]
    assert abs(e[-1] / least - 1) < 1e-9 and e[-1] < 1e-19 * e[0]
    assert abs(np.log(e).sum() - np.linalg.slogdet(np.eye(6) + 0.1)[1] - 2 * np.log(scale).sum()) < 1e-9


def test_a_matrix_without_off_diagonals():
    assert [list(x) for x in (whitening.jacobi(np.diag([1.0, 5.0, 0.0]))[0],)] == [[5.0, 1.0, 0.0]]


def test_whitening(spark):
    r = np.random.RandomState(0)
    vectors = (r.normal(size=(90, 12)) * np.linspace(1, 9, 12)).tolist()
    rows = [(i, v) for i, v in enumerate(vectors)] + [(500, None), (501, [None] + vectors[0][1:]), (502, [float("nan")] + vectors[0][1:]), (503, [float("inf")] + vectors[0][1:]), (504, [1.0, 2.0]), (505, [])]
    got = whitening.whitened(clash(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).repartition(5)).collect()
    e, w, deviation = plain_whitening(vectors)
    assert len(got) == 90 * 8 and {g["n"] for g in got} == {90}
    mine = np.zeros((90, 8))
    for g in got:
        mine[g["vec_id"], g["component"] - 1] = g["whitened"]
        assert g["deviation"] == Decimal(int(deviation[g["vec_id"]]))
        assert abs(g["explained"] / (e[g["component"] - 1] / e.sum()) - 1) < 1e-9 and g["identity_error"] < 1e-10
    assert np.allclose(mine * np.sign((mine * w).sum(0)), w, atol=1e-9)


def test_whitening_does_not_depend_on_partitions(spark):
    r = np.random.RandomState(1)
    rows = [(i, v) for i, v in enumerate(r.normal(size=(60, 5)).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    a, b = (sorted((g["vec_id"], g["component"], g["whitened"]) for g in whitening.whitened(df.repartition(k)).collect()) for k in (1, 9))
    assert a == b


def test_whitening_of_few_or_equal_rows(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [])]):
        assert whitening.whitened(spark.createDataFrame(rows, schema)).count() == 0
    got = whitening.whitened(spark.createDataFrame([(1, [0.5, 0.25])], schema)).collect()
    assert [(g["component"], g["n"], g["deviation"], g["whitened"], g["explained"], g["identity_error"]) for g in got] == [(1, 1, 0, None, 0.0, None), (2, 1, 0, None, 0.0, None)]
    got = whitening.whitened(spark.createDataFrame([(1, [0.5, 1.0]), (1, [0.5, 1.0]), (None, [0.25, 1.0])], schema)).orderBy("component", "vec_id").collect()
    assert [g["vec_id"] for g in got if g["component"] == 1] == [None, 1, 1]
    assert all(abs(abs(g["whitened"]) - (2**0.5 if g["vec_id"] is None else 0.5**0.5)) < 1e-12 for g in got if g["component"] == 1)
    assert all(g["whitened"] is None for g in got if g["component"] == 2) and got[0]["identity_error"] < 1e-12


def test_whitening_of_far_off_values(spark):
    """Sums beyond 53 bits stay exact; what no exact sum can hold is an error."""
    vectors = [[3e8 + i, -2e8 * i] for i in range(20)]
    got = whitening.whitened(spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")).collect()
    x = [[int(np.floor(1024 * c)) + 100_000 for c in v] for v in vectors]
    sums = [sum(c) for c in zip(*x, strict=True)]
    assert {g["vec_id"]: int(g["deviation"]) for g in got} == {i: sum((20 * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for i, v in enumerate(x)}
    with pytest.raises(Exception, match="exactly"):
        whitening.whitened(spark.createDataFrame([(1, [1e30]), (2, [1.0])], "vec_id long, embedding array<double>"))


# --- quality rules ------------------------------------------------------------------------------------------------------


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = {i + k for i in range(len(words) - 4) for k in range(5) if seen[tuple(words[i : i + 5])] > 1}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


ODD = [None, "", " \t\n\x0b\x0c\r ", "one", "a\x0bb\x0cc\rd\te f", "a b c d e f a b c d e", "a a a a a a", " x y é𝄞 ñ ", "l 1\nl 1\n \nl 1\nl 2", "ab" * 60_000, "w1 w2 w3 w4 w5\n" * 30, "#*$%&|<> !!", "İ ß ſ K", "x " * 9 + "y z"]


def test_quality_counts(spark, data):
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").limit(60).collect()] + [" ".join(f"w{k % 977}" for k in range(30_000))]
    df = clash(spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], DOCS))
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality_rules.quality_rules(df).collect()}
    assert got == {i: plain_counts(t) for i, t in enumerate(texts)}


def test_quality_verdicts(spark):
    prose = " ".join(f"the garden of house{k} is near to water{k}." for k in range(12))
    rows = [
        (1, prose, "en"), (2, prose, "xx"), (3, prose, None), (4, "too few words here", "en"), (5, None, "en"), (6, " ".join(f"{w} ###" for w in prose.split()), "en"),
        (7, " ".join(w.upper() + "!!" for w in prose.split()), "en"), (8, " ".join(f"zz{k} yy{k}" for k in range(40)), "en"), (9, "\n".join(["same line of the text is that"] * 9), "en"),
        (10, "\n".join(f"- the item{k} of the list{k}" for k in range(9)), "en"), (11, "\n".join(f"the part{k} of it{k} ..." for k in range(9)), "en"), (12, " ".join(["of"] + ["y" * (40 + k) for k in range(12)]), "en"), (1, prose, "en"), (None, prose, "en"),
    ]
    got = sorted((r["doc_id"] or 0, r["base_failed"], r["failed"], r["kept"]) for r in quality_rules.quality_rules(spark.createDataFrame(rows, DOCS)).collect())
    assert [g for g in got if g[0] in (0, 1, 2, 3)] == [(0, False, "", True), (1, False, "", True), (1, False, "", True), (2, False, "", True), (3, False, "", True)]
    failed = {i: (b, f) for i, b, f, _ in got}
    assert failed[4][0] and failed[5][0] and failed[9][0]
    assert [failed[k][1] for k in (6, 7, 10, 11, 12)] == ["symbols", "exclamations,capitals,stop_words", "list_items", "broken_off_lines", "word_length"]
    assert failed[8] == (False, "stop_words")
    assert all(k == (not b and not f) for _, b, f, k in got)


def test_quality_rules_are_a_table(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h i j k", "en"), (2, "aa bb cc dd ee ff gg hh ii jj kk", "en")], DOCS)
    only = (quality_rules.Rule("short", "word_chars", "n_words", least=150),)
    assert {r["doc_id"]: r["failed"] for r in quality_rules.quality_rules(df, only).collect()} == {1: "short", 2: ""}
    assert all(r["kept"] for r in quality_rules.quality_rules(df, ()).collect())
    assert quality_rules.quality_rules(df.limit(0)).count() == 0


def test_quality_is_one_projection(spark, data):
    plan = quality_rules.op12_quality_rules(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange|Pandas", plan)


def test_clean_labelled_documents_stay(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    t = quality_rules.op12_quality_rules(spark, d).join(labels, "doc_id").filter("not base_failed")
    n = {(r["quality"], r["kept"]): r["count"] for r in t.groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) <= 0.01 * n[1, True]
    assert n.get((0, True), 0) <= 0.1 * n[0, False]


# --- phrases ------------------------------------------------------------------------------------------------------------


def plain_phrases(rows, most_words=3, least=10, share=50, top=2000):
    f, n = {}, Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for _, text, lang in rows:
        c = f.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(ws)
            for k in range(1, most_words + 1):
                c.update(" ".join(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, c in f.items():
        found = []
        cand = {p: a for p, a in c.items() if " " in p and a >= least}
        for p, a in cand.items():
            ws = p.split(" ")
            if any(f" {p} " in f" {q} " and q != p and 100 * b >= share * a for q, b in cand.items()):
                continue
            cuts = [(10**6 * a * a // (c[" ".join(ws[:k])] * c[" ".join(ws[k:])]), k) for k in range(1, len(ws))]
            score, k = min(cuts)
            found.append((-score, -a, p.encode(), c[" ".join(ws[:k])], c[" ".join(ws[k:])]))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def mined(df, **kw):
    return sorted(tuple(r[c] for c in COLUMNS) for r in phrases.collocations(df, **kw).collect())


def made(seed, n=160):
    r = np.random.RandomState(seed)
    words = ["Aa", "bb", "cc", "dé", "ee", "ff\x1cx", "z z", "aa"]
    signs = [" ", "  ", "\t", " ", " ", ". ", ",", "\n", "\r", " ; "]
    rows = [(i, "".join(r.choice(words) + r.choice(signs) for _ in range(r.randint(0, 40))), r.choice(["en", "fr"])) for i in range(n)]
    return rows + [(900, None, "en"), (901, "", None), (902, "x y. x y, x y " * 9, None), (902, "x y. x y, x y " * 9, None), (None, "p q r " * 50, "de"), (903, "...,;", "pt")]


@pytest.mark.parametrize("kw", [{}, {"most_words": 2}, {"most_words": 4, "least": 6}, {"share": 100}, {"top": 3}, {"top": None, "least": 2}])
def test_phrases(spark, kw):
    rows = made(1)
    assert mined(clash(spark.createDataFrame(rows, DOCS)).repartition(5), **kw) == plain_phrases(rows, **kw)


def test_phrases_of_many_shards_and_prefix_runs(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD", 200)
    monkeypatch.setattr(phrases, "RUNS", 7)
    rows = made(2)
    data = [(lang or "und", text or "") for _, text, lang in rows]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([x for x, _ in data]), pa.array([t for _, t in data])], ["lang", "text"])
    got, everything = Counter(), [np.full(1, 0xFFFFFFFFFFFFFFFF, np.uint64)] * 2
    for parts in phrases.shards(iter([batch]), 200):
        shard = phrases.Shard(parts)
        for k in (1, 2, 3):
            for out in phrases.counted(shard, k, everything[: k - 1]):
                for x, p, a in zip(out["lang"].to_pylist(), out["phrase"].to_pylist(), out["a"].to_pylist(), strict=True):
                    got[x, p] += a
    want = Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in data:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text.translate(lower)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            want.update((lang, " ".join(ws[i : i + k])) for k in (1, 2, 3) for i in range(len(ws) - k + 1))
    assert got == want


def test_bitmaps():
    r = np.random.RandomState(7)
    items = r.choice([-1, 0, 1, 2, 3], 301)
    maps = phrases.Bitmaps(items)
    assert np.bitwise_count(maps.mask).sum() == (items >= 0).sum()
    owner, item, run, mask = maps.extend(maps.item, maps.run, maps.mask)
    got = Counter()
    for o, i, m in zip(owner, item, mask, strict=True):
        got[int(o), int(i)] += int(np.bitwise_count(m))
    assert got == Counter((int(a), int(b)) for a, b in pairwise(items) if a >= 0 and b >= 0)
    at = sorted((int(r) << 3) + k for r, m in zip(run, mask, strict=True) for k in range(8) if m >> k & 1)
    assert at == [k for k in range(1, 301) if items[k] >= 0 and items[k - 1] >= 0]


def test_long_piece_and_long_text(spark):
    text = " ".join(f"w{k % 501}" for k in range(60_000))
    rows = [(1, text, "en"), (2, text.replace("w500 ", "w500. "), "en")]
    assert mined(spark.createDataFrame(rows, DOCS)) == plain_phrases(rows)


def test_scores_beyond_64_bits(spark):
    a = 4_000_000_000
    found = spark.createDataFrame([("en", "x y", a)], "lang string, phrase string, a long")
    known = spark.createDataFrame([("en", "x", a + 7), ("en", "y", a + 1)], "lang string, phrase string, a long")
    assert phrases._scored(found, known, 2).first()["score"] == 10**6 * a * a // ((a + 7) * (a + 1))


def test_no_phrases(spark):
    assert phrases.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, "a b", "en")], DOCS)).count() == 0
