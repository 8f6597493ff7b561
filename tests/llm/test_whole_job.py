"""Cases that operators once left out."""

from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import language_id, licenses, line_dedup, packing, topk, toxicity
from quillspark.operators import dedup, graph
from quillspark.plans import registry
from quillspark.plans.tables import couples, family


def test_finer_links_equal_edit_similarity_alone(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(60)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    base = next(line for _, t in rows for line in t.split("\n") if 12 <= len(line.split()) <= 30)
    words = base.split()
    rows += [(10**6 + k, " ".join([*words[:k], "qq" + words[k], *words[k + 1 :]])) for k in range(4)]
    seen = [(i, k, f.decode()) for i, t in sorted(rows) for k, w in enumerate(line_dedup.normal_lines(t)) if len(f := b" ".join(w)) >= line_dedup.MIN_CHARS]
    forms = sorted({f for _, _, f in seen}, key=len)
    group = {f: f for f in forms}

    def root(f):
        while group[f] != f:
            f = group[f]
        return f

    for x, a in enumerate(forms):
        for b in forms[x + 1 :]:
            most = len(b) * (100 - line_dedup.PERCENT) // 100
            if len(b) - len(a) > most:
                break
            if line_dedup.edit_distance(a, b) <= most:
                group[root(a)] = root(b)
    met, gone = set(), {i: set() for i, _ in rows}
    for i, k, f in seen:
        if root(f) in met:
            gone[i].add(k)
        met.add(root(f))
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in rows}
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), finer=True).collect()
    assert {r["doc_id"]: r["text"] for r in got} == want
    assert all(want[10**6 + k] == "" for k in range(4))


def test_short_lines_repeat_by_exact_form(spark):
    rows = [(1, "All rights reserved.\n\n***\nAnd ornd."), (2, "all rights reserved\n\n***\nAnd ornf."), (3, "And ornd.\nAnd ornd.\nx")]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), finer=True, short=True).collect()
    assert {r["doc_id"]: r["text"] for r in got} == {1: rows[0][1], 2: "\n***\nAnd ornf.", 3: "x"}


def walk(spark, docs):
    """The walk in order of ids, with the first kept twin by key, then by id."""
    kept, out = [], {}
    for r in sorted(dedup.sketches(docs).collect(), key=lambda r: r["id"]):
        grams, sk = set(r["grams"]), list(r["sketch"])
        keys = [tuple(sk[b : b + 3]) for b in range(0, len(sk) - 2, 3)]
        same = [] if len(grams) < 60 else [(keys.index(x), i) for i, g, k in kept for x in keys if x in k and len(g & grams) / min(len(g), len(grams)) >= 0.6]
        out[r["id"]] = (not same, min(same)[1] if same else None)
        if not same and len(grams) >= 60:
            kept.append((r["id"], grams, set(keys)))
    return out


def test_copies_of_a_dropped_text_go_too(spark, data):
    words = [f"w{k}x" for k in range(90)]
    near = " ".join([*words[:80], "other"])
    rows = [(10**6, " ".join(words)), (10**6 + 1, near), (10**6 + 2, near), (10**6 + 3, near)]
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["id"]: (r["kept"], r["same_as"]) for r in dedup.dedupe(docs).collect()}
    assert got == walk(spark, docs)
    assert got[10**6 + 3] == (False, 10**6)


def test_links_of_every_tree(spark, data):
    links = [(r["parent"], r["child"]) for r in family(spark, data).collect()]
    members = {}
    for r in graph.trees(family(spark, data), couples(spark, data)).collect():
        members.setdefault(r["ego"], set()).add(r["person"])
    want = sorted((e, a, b) for e, m in members.items() for a, b in links if a in m and b in m)
    got = sorted((r["ego"], r["parent"], r["child"]) for r in registry.links_both_ends_all(spark, data).collect())
    assert got == want
    assert {e[0] for e, _, _ in got} == {"R", "N", "C"}


def test_whole_licences_and_reserved_rights():
    scan = licenses.Scanner(licenses.TEMPLATES, licenses.THRESHOLD)
    best = lambda text: min(((-d, -n, k) for k, d, _, n in scan(text)), default=None)
    name = lambda text: licenses.TEMPLATES[best(text)[2]][0]
    for want, form, text in licenses.TEMPLATES:
        if form != "line":
            assert name(f"Some words before. {text} and after") == want
    assert {"Apache-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "CC0-1.0", "0BSD", "Zlib", "BSL-1.0"} <= {n for n, form, t in licenses.TEMPLATES if form == "text"}
    assert name("Copyright 2020 Someone. All rights reserved, says the page.") == "All-Rights-Reserved"


def test_every_piece_of_the_vocabulary_counts():
    path = packing.vocabulary(language_id.VOCABULARY)
    pieces = language_id.pieces_of(path)
    assert pieces == language_id.pieces_of(path, 1000)
    assert max(map(len, pieces)) == language_id.LONGEST
    word = max((p for p in pieces if p[0] == "▁"), key=len)[1:]
    assert pieces["▁" + word] in language_id.lattice([word], pieces)


def test_every_language_is_learned(spark):
    rows = [(k, f"word{'abcdefghij'[k % 10]} text", f"l{k % 230:03}") for k in range(2300)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), packing.vocabulary(language_id.VOCABULARY), sample=2)
    assert model.langs == [f"l{k:03}" for k in range(230)]


def test_one_long_text_shuts_out_no_other(spark, monkeypatch):
    rows = [(k, "une ligne " * (500 if k % 20 == 3 else 1) + str(k), "fr", k % 2) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    taken = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, *_: taken.append(len(texts)))
    monkeypatch.setattr(language_id, "fit", lambda texts, *_: taken.append(len(texts)))
    short = docs.filter(F.length("text") < 100).filter(~toxicity.held_out("doc_id")).count()
    toxicity.train(docs.drop("toxic"), docs.select("doc_id", "toxic"), chars=4000)
    language_id.train(docs, packing.vocabulary(language_id.VOCABULARY), chars=4000)
    assert taken == [short, short]


def test_repeated_ids_are_queries_and_candidates_each(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.5, 0.0]), (1, [0.25, 0.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), lambda i: i % 50 == 0).collect()
    assert sorted(tuple(r) for r in got) == [(0, 1, 0, 32768), (0, 1, 0, 32768), (0, 2, 1, 8192), (0, 2, 1, 16384)]


def test_a_share_of_changed_lines_is_found(spark, data):
    """Lines of sf0.001 with one word changed, added or taken out: the links that edit similarity makes, without any
    filter of hashes."""
    docs = [r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").limit(80).collect()]
    lines = sorted({line for t in docs for line in t.split("\n") if 6 <= len(line.split()) <= 80})[:240]
    rows, pairs = [], 0
    for k, line in enumerate(lines):
        w = line.split()
        at = (7 * k) % len(w)
        changed = [[*w[:at], "zq" + w[at], *w[at + 1 :]], [*w[:at], "zqx", *w[at:]], [*w[:at], *w[at + 1 :]]][k % 3]
        a, b = (b" ".join(line_dedup.normal_lines(" ".join(x))[0]).decode() for x in (w, changed))
        if a != b and min(len(a), len(b)) >= line_dedup.MIN_CHARS and line_dedup.within([(a, b)], [max(len(a), len(b)) // 10])[0]:
            rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(changed))]
            pairs += 1
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for finer, least in ((True, 0.98), (False, 0.9)):
        got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(frame, finer=finer).collect()}
        assert pairs > 100 and sum(got[i] == "" for i in got if i % 2) >= least * pairs


def test_lines_that_share_a_passage_stay(spark):
    word = lambda n: "".join("abcdefghijklmnopqrstuvwxyz"[n * 7919 // 26**i % 26] for i in range(6))
    shared = " ".join(word(10_000 + k) for k in range(12))
    rows = [(k, " ".join(word(9 * k + j) for j in range(9)) + " " + shared) for k in range(60)]
    rows += [(100 + k, rows[k][1].replace(word(9 * k + 3), "zq" + word(9 * k + 3)[2:])) for k in range(30)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), finer=True).collect()}
    assert all(got[k] == rows[k][1] for k in range(60)) and all(got[100 + k] == "" for k in range(30))


def test_odd_input_of_pipeline_stages(spark, data):
    schema = "doc_id long, text string, lang string, source string, n_chars long, id int, n int, size int, taken int, text_sha string"
    rows = [(1, None, None, None, None), (2, "", "en", None, 0), (3, "a b " * 20_000, "en", "s", 9), (4, "same text of some words here\nsame text of some words here", "fr", "s", 1), (4, "same text of some words here\nsame text of some words here", "fr", "s", 1), (5, "same text of some words here", None, "t", 2)]
    odd = spark.createDataFrame([(*r, 7, 7, 7, 7, "x") for r in rows], schema)
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            got = stage(spark, docs, data).collect()
            assert bool(got) == bool(docs.count())
    kept = corpus_pipeline.near_duplicates(spark, odd, data).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 2, 3, 4, 4, 5]


def test_no_bucket_of_two_lines_is_lost(spark):
    """Pairs of lines that differ in a letter: each is linked, whatever the hashes of the two lines are."""
    import random

    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    rows = []
    for k in range(4000):
        words = [word() for _ in range(30)]
        at = r.randrange(30)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[:at], words[at][:-1] + "0", *words[at + 1 :]]))]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), finer=True).filter("lines_dropped > 0").select("doc_id").collect()
    assert {x["doc_id"] for x in got} == {2 * k + 1 for k in range(4000)}
