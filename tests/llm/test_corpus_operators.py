"""Small cases for each corpus operator: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import chat, language_id, licenses, line_dedup, linking, mixing, near_dedup, packing, topk, toxicity
from quillspark.llm.exact_dedup import exact_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{k % 977}" for k in range(30_000))
    rows = [(5, "a  b"), (3, "a\tb"), (4, None), (9, ""), (None, "a b"), (7, "x"), (7, "x"), (8, long), (6, long + " end")]
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS).withColumns({k: F.lit("clash") for k in ("id", "n", "h", "size", "keep", "row", "part", "digest", "line", "comp", "rate", "copies")})


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def pairs(df, *cols):
    return sorted(((tuple(r[c] for c in cols)) for r in df.collect()), key=str)


@pytest.mark.parametrize("digests", [False, True])
def test_exact_dedup(odd, nothing, digests):
    got = exact_dedup(odd, digests=digests)
    want = [(None, 3, 3, False), (3, 3, 3, True), (4, 4, 2, True), (5, 3, 3, False), (6, 6, 1, True), (7, 7, 2, True), (7, 7, 2, True), (8, 8, 1, True), (9, 4, 2, False)]
    assert pairs(got, "doc_id", "keep_id", "group_size", "kept") == sorted(want, key=str)
    if digests:
        assert got.filter("doc_id = 5").first()["text_sha256"] == hashlib.sha256(b"a b").hexdigest()
    assert exact_dedup(nothing, digests=digests).count() == 0


def test_prefix_alone_is_no_match(spark):
    same = "p" * 300
    rows = [(1, same + "a"), (2, same + "b"), (3, same + "a")]
    assert pairs(exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), prefix=16), "doc_id", "keep_id") == [(1, 1), (2, 2), (3, 1)]


def components_by_force(links, ids):
    low = {i: i for i in ids}
    moved = True
    while moved:
        moved = False
        for a, b in links:
            m = min(low[a], low[b])
            moved |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low


def test_components(spark):
    r = np.random.RandomState(3)
    links = [(int(a), int(b)) for a, b in r.randint(0, 120, (70, 2))] + [(k, k + 1) for k in range(200, 240)]
    got = {r["id"]: r["comp"] for r in linking.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = components_by_force(links, {i for p in links for i in p})
    assert got == {i: c for i, c in want.items() if any(i in p and p[0] != p[1] for p in links)}


def near_by_force(rows, words, percent):
    sets = {i: near_dedup.Shingles(words)(t) for i, t in rows}
    ids = sorted(sets)
    links = []
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(np.intersect1d(sets[a], sets[b]))
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                links.append((a, b))
    return components_by_force(links, ids), sets


@pytest.mark.parametrize("words", [2, 5])
def test_near_dedup_equals_force(docs, words):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want, sets = near_by_force(rows, words, 80)
    got = near_dedup.near_dedup(docs, words=words).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["n_shingles"] == len(sets[r["doc_id"]]) and r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_dedup_of_a_large_group(spark):
    """Many variants of one text, and outsiders that share buckets with them but not all links."""
    r = np.random.RandomState(1)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(150):
        t = list(base)
        for at in r.choice(120, r.randint(1, 26), replace=False):
            t[at] = f"v{k}x{at}"
        rows.append((k, " ".join(t)))
    want, _ = near_by_force(rows, 2, 80)
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), words=2)
    assert dict(pairs(got, "doc_id", "component_id")) == want


def test_near_dedup_odd_rows(odd, nothing):
    got = near_dedup.near_dedup(odd, words=2)
    assert pairs(got, "doc_id", "component_id", "kept") == sorted([(None, None, True), (3, 3, True), (4, 4, True), (5, 3, False), (6, 6, True), (7, 7, True), (7, 7, True), (8, 6, False), (9, 9, True)], key=str)
    assert near_dedup.near_dedup(nothing).count() == 0


def test_least_matches():
    assert near_dedup.least_matches(128, 80, 1e-6) < 0.8 * 128
    assert near_dedup.least_matches(16, 80, 1.0) == 16


def lines_by_edits(docs):
    """Texts (id, text) after fuzzy line dedup, by edit similarity of all pairs; lines with short forms by equal forms."""
    seen = [(i, k, b" ".join(w)) for i, t in sorted(docs) for k, w in enumerate(line_dedup.normal_lines(t)) if w]
    forms = sorted({f for _, _, f in seen}, key=len)
    size = np.array([len(f) for f in forms])
    letters = np.array([np.bincount(np.frombuffer(f, np.uint8), minlength=256) for f in forms], np.int32)
    group = {f: f for f in forms}

    def root(f):
        while group[f] != f:
            f = group[f]
        return f

    for x, a in enumerate(forms):
        if len(a) >= line_dedup.MIN_CHARS:
            most = size[x + 1 :] * (100 - line_dedup.PERCENT) // 100
            may = (size[x + 1 :] - len(a) <= most) & (np.abs(letters[x + 1 :] - letters[x]).sum(1) <= 2 * most)
            for y in np.flatnonzero(may) + x + 1:
                if root(a) != root(forms[y]) and line_dedup.edit_distance(a, forms[y]) <= len(forms[y]) * (100 - line_dedup.PERCENT) // 100:
                    group[root(a)] = root(forms[y])
    met, gone = set(), defaultdict(set)
    for i, k, f in seen:
        if root(f) in met:
            gone[i].add(k)
        met.add(root(f))
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in docs}


def lines_by_force(rows):
    seen, drop, forms = [], defaultdict(set), []
    for i, t in sorted(rows):
        for k, words in enumerate(line_dedup.normal_lines(t)):
            if len(f := b" ".join(words)) >= line_dedup.MIN_CHARS:
                seen.append((i, k, f))
                forms.append(f)
    forms = sorted(set(forms))
    sims = [int(line_dedup.simhash(h := np.array([line_dedup.xxhash.xxh64_intdigest(w) for w in f.split()], np.uint64), np.array([len(h)]))[0]) & (2**64 - 1) for f in forms]
    links = []
    for x in range(len(forms)):
        for y in range(x):
            if (sims[x] ^ sims[y]).bit_count() <= line_dedup.DISTANCE:
                a, b = forms[x].decode(), forms[y].decode()
                row = list(range(len(b) + 1))
                for i, p in enumerate(a):
                    new = [i + 1]
                    for j, q in enumerate(b):
                        new.append(min(row[j] + (p != q), row[j + 1] + 1, new[j] + 1))
                    row = new
                if row[-1] <= (100 - line_dedup.PERCENT) * max(len(a), len(b)) // 100:
                    links.append((x, y))
    group, met = components_by_force(links, range(len(forms))), set()
    place = {f: group[k] for k, f in enumerate(forms)}
    for i, k, f in seen:
        if place[f] in met:
            drop[i].add(k)
        met.add(place[f])
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop[i]) for i, t in rows}


def test_line_dedup_equals_force(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = line_dedup.line_dedup(docs)
    assert dict(pairs(got, "doc_id", "text")) == lines_by_force(rows)
    assert got.columns == [*docs.columns, "lines_total", "lines_dropped"]


def test_line_dedup_rows(spark, odd, nothing):
    line = "this very line comes again and again in many texts"
    rows = [(2, f"{line}\nown words of the second text are here"), (1, f"{line.upper()}!\nshort"), (3, "short"), (4, None), (None, line)]
    got = dict(pairs(line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "text"))
    assert got == {1: f"{line.upper()}!\nshort", 2: "own words of the second text are here", 3: "short", 4: None, None: line}
    assert line_dedup.line_dedup(odd).count() == 9
    assert line_dedup.line_dedup(nothing).count() == 0


def test_targets(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 100), ("c", 10), (None, 100)], "src string, total long")
    got = {r["src"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    weights, size = {"a": 5, "b": 2, "c": 1, None: 5}, {"a": 100, "b": 100, "c": 10, None: 100}
    want, fixed = {}, {}
    while True:
        free = [s for s in size if s not in fixed]
        rest = sum(size.values()) - sum(fixed.values())
        want = {s: rest * weights[s] / sum(weights[t] for t in free) for s in free} | fixed
        over = [s for s in free if want[s] > 3 * size[s] + 1e-9]
        if not over:
            break
        fixed |= {s: 3.0 * size[s] for s in over}
    assert got == pytest.approx(want)


def test_mixing(docs, odd, nothing):
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    assert {r["doc_id"]: r["copies"] for r in got} == {r["doc_id"]: r["copies"] for r in again}
    taken, target, largest = Counter(), {}, Counter()
    for r in got:
        assert 0 <= r["copies"] <= 3 and r["size"] == len((r["text"] or "").encode().split())
        taken[r["source"]] += r["copies"] * r["size"]
        target[r["source"]] = r["target"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)
    strange = mixing.mix(odd)
    assert strange.count() == 9 and strange.columns.count("size") == 1
    assert mixing.mix(nothing).count() == 0


def test_balance_is_the_dual(spark):
    cells = spark.createDataFrame([("a", 10, 5), ("a", 100, 3), ("a", 1000, 1)], "src string, size long, docs long")
    for target in (300.0, 1350.0, 3000.0, 4000.0):
        t = spark.createDataFrame([("a", 1350, target)], "src string, total long, target double")
        r = mixing.balance(cells, t).first()
        assert sum(s * n * min(3, np.exp(r["lam"] * s / r["mean"])) for _, s, n in cells.collect()) == pytest.approx(target, rel=1e-6)


def check_packing(rows, texts, capacity=packing.CAPACITY):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.vocabulary())
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for i, t in texts:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        pieces = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["start"] for r in pieces] == list(range(0, len(ids), capacity))
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in pieces)
    for own in by_seq.values():
        end = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == end
            end += r["length"]
        assert end <= capacity
    return len(by_seq)


def test_packing(docs, spark, nothing):
    got = packing.pack(docs, packing.vocabulary()).collect()
    n = check_packing(got, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert n <= 1.02 * sum(r["length"] for r in got) / packing.CAPACITY + 1
    rows = [(1, None), (2, ""), (3, "it's <|endoftext|>  İstanbul é é x\x1c'll 12"), (4, "word " * 5000)]
    check_packing(packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), packing.vocabulary()).collect(), rows)
    ids = packing.pack(spark.createDataFrame(rows[:1], "doc_id long, text string"), packing.vocabulary(), keep_ids=True).first()
    assert ids["ids"] == [0]
    assert packing.pack(nothing, packing.vocabulary()).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan(seed):
    r = np.random.RandomState(seed)
    counts = Counter(int(x) for x in r.randint(1, 101, 400))
    table = packing.plan(dict(counts), 100)
    bins, seen = defaultdict(list), Counter()
    for row in table.itertuples():
        assert row.first == seen[row.length]
        for j in range(row.count):
            bins[row.sequence + j // row.each].append((row.offset + j % row.each * row.length, row.length))
        seen[row.length] += row.count
    assert seen == counts
    for items in bins.values():
        assert sum(3 * n > 100 for _, n in items) <= 2
        end = 0
        for at, n in sorted(items):
            assert at == end
            end += n
        assert end <= 100


def search_by_force(rows, k):
    out = []
    for i, v in rows:
        if i % 50 == 0:
            best = sorted((-sum(int(np.floor(256 * x)) * int(np.floor(256 * y)) for x, y in zip(v, w, strict=True)), j) for j, w in rows if j != i and len(w) == len(v))[:k]
            out += [(i, n, j, -s) for n, (s, j) in enumerate(best, 1)]
    return sorted(out)


def test_topk(spark, data):
    r = np.random.RandomState(0)
    rows = [(k, [float(np.float32(x)) for x in r.normal(0, 0.1, 12)]) for k in range(300)]
    rows += [(k, rows[k % 3][1]) for k in range(300, 420)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert pairs(topk.top_k(df, lambda i: i % 50 == 0), "query_id", "rank", "vec_id", "score") == sorted(search_by_force(rows, 5), key=str)
    odd_rows = [(0, [1.0, 2.0]), (1, None), (2, [float("nan"), 1.0]), (3, [1.0, None]), (4, [3.0, 1.0]), (5, []), (None, [1.0, 1.0]), (6, [1.0]), (7, [float("inf"), 0.0])]
    odd = spark.createDataFrame(odd_rows, "vec_id long, embedding array<float>").withColumns({"v": F.lit(1), "q": F.lit(2), "d": F.lit(3)})
    assert pairs(topk.top_k(odd, lambda i: i % 50 == 0), "query_id", "rank", "vec_id", "score") == [(0, 1, 4, 256 * 256 * 5)]
    assert topk.top_k(odd.limit(0), lambda i: i % 50 == 0).count() == 0


def test_search_blocks_in_wide_numbers():
    r = np.random.RandomState(2)
    for most in (200, 1 << 20, 1 << 28, 1 << 40):
        c = r.randint(-most, most, (80, 9))
        got = topk.search_block(np.array([0, 1]), c[:2], np.arange(80), c, 3, step=2)
        want = []
        for q in (0, 1):
            s = sorted((-sum(int(x) * int(y) for x, y in zip(c[q], c[j], strict=True)), j) for j in range(80) if j != q)[:3]
            want += [(q, j, -v) for v, j in s]
        assert got == want


TOXIC = "doc_id long, quality int, toxic int"


def test_toxicity(spark, nothing):
    r = np.random.RandomState(4)
    word = lambda: "".join(r.choice(list("abcdefgh"), 5))
    rows, marks = [], []
    for k in range(600):
        bad = k % 4 == 0
        t = [word() for _ in range(40)]
        if bad:
            t[r.randint(40)] = "zorkvile" + str(k % 3)
        rows.append((k, " ".join(t), "en", "s", 1))
        marks.append((k, 1, int(bad)))
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame(marks, TOXIC)
    model = toxicity.train(docs, labels)
    out = toxicity.toxicity(docs, model).join(labels, "doc_id").filter("held_out").collect()
    assert len(out) > 80 and sum(r["predicted"] == r["toxic"] for r in out) >= 0.97 * len(out)
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("yy")})
    a, b = (dict(pairs(toxicity.toxicity(d, model), "doc_id", "score")) for d in (docs, other))
    assert a == b
    empty = toxicity.toxicity(spark.createDataFrame([(1, None, None, None, None), (2, "", None, None, None), (None, "x", None, None, None)], DOCS), model).collect()
    assert all(0 <= r["score"] <= 1 for r in empty)
    assert toxicity.toxicity(nothing, toxicity.train(nothing, spark.createDataFrame([], TOXIC))).count() == 0


def all_cuts(word, p):
    if not word:
        return 1.0
    return sum(p[word[:k]] * all_cuts(word[k:], p) for k in range(1, len(word) + 1) if word[:k] in p)


def test_forward_sums_all_cuts():
    pieces = {"▁": 1, "a": 2, "b": 3, "ab": 4, "▁a": 5, "ba": 6}
    p = np.append(np.random.RandomState(0).rand(7), 0)[:, None]
    for word in ("a", "ab", "abba", "c", "abcab"):
        by = {k: p[i, 0] for k, i in pieces.items()} | {"c": p[0, 0]}
        got = language_id.forward(language_id.lattice([word], pieces), p)[0][0, 0]
        assert np.exp(got) == pytest.approx(all_cuts("▁" + word, by))


def test_language_id(docs, spark, nothing):
    model = language_id.train(docs, packing.vocabulary(language_id.VOCABULARY))
    out = language_id.language_id(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.95 * len(out)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !? 3 ½ ²"), (4, "é" * 50_000), (None, "the")], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.language_id(odd, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] in model.langs
    none = language_id.language_id(odd, language_id.train(nothing, packing.vocabulary(language_id.VOCABULARY)))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}


def licences_by_force(text):
    words, best = licenses.words_of(text), []
    for k, (name, _, template) in enumerate(licenses.TEMPLATES):
        own = licenses.words_of(template)
        n = min(len(own), len(words))
        scores = [(licenses.dice(words[at : at + n], own), -at) for at in range(len(words) - n + 1)] if n > 1 else []
        if scores and max(scores)[0] >= licenses.THRESHOLD:
            best.append((-max(scores)[0], -n, k, name))
    return min(best)[3] if best else None


def test_licenses(docs, spark, nothing):
    head = "Some words before.\n"
    rows = [(k, head * (k % 3) + f"{t}\nand more words after it") for k, (_, _, t) in enumerate(licenses.TEMPLATES)]
    rows += [(100, None), (101, ""), (102, "license"), (103, licenses.TEMPLATES[0][2].replace("software", "program")), (104, licenses.TEMPLATES[0][2][:900])]
    got = {r["doc_id"]: r["license"] for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: licences_by_force(t) for i, t in rows}
    assert all(got[k] == name for k, (name, form, _) in enumerate(licenses.TEMPLATES) if form != "line")
    small = docs.filter(F.length("text") < 3000)
    found = {r["doc_id"]: r["license"] for r in licenses.license_scan(small).collect()}
    assert found == {r["doc_id"]: licences_by_force(r["text"]) for r in small.collect()}
    assert licenses.license_scan(nothing).count() == 0


NODES = "tree long, node long, parent long, score double, role string, text string"


def test_reply_trees(spark):
    rows = [
        (1, 1, None, 1.0, "user", "q"), (1, 2, 1, 1.0, "assistant", "a"), (1, 3, 1, 5.0, "assistant", "b"), (1, 4, 3, 0.0, "user", "c"), (1, 5, 2, 9.0, "user", "d"),
        (2, 1, 9, None, "user", None), (3, 1, 2, 1.0, "user", "x"), (3, 2, 1, 1.0, "user", "y"), (4, 1, None, 0.0, "user", "[INST]<s>\\"), (4, 2, 1, 0.0, "assistant", "\\<|end|>\\\\["),
    ]
    got = chat.chat_format(spark.createDataFrame(rows, NODES), top=2)
    out = {(r["tree"], r["path_rank"]): r for r in got.withColumns({"turns": chat.read_back(F.col("formatted")), "lost": chat.loss_text(F.col("formatted"), F.col("loss"))}).collect()}
    assert [t["text"] for t in out[1, 1]["turns"]] == ["q", "a", "d"]
    assert [t["text"] for t in out[1, 2]["turns"]] == ["q", "b", "c"]
    assert [t["text"] for t in out[2, 1]["turns"]] == [""]
    assert 3 not in {t for t, _ in out}
    assert [t["text"] for t in out[4, 1]["turns"]] == ["[INST]<s>\\", "\\<|end|>\\\\["] and out[4, 1]["lost"] == "\\<|end|>\\\\["
    assert not any(s in x["formatted"] for x in out.values() for s in ("<s>", "[INST]"))


def test_long_path(spark):
    rows = [(1, k, k - 1 if k else None, 0.0, "user", str(k)) for k in range(300)]
    got = chat.chat_format(spark.createDataFrame(rows, NODES)).select(chat.read_back(F.col("formatted")).alias("t")).first()["t"]
    assert [t["text"] for t in got] == [str(k) for k in range(300)]
    assert chat.chat_format(spark.createDataFrame([], NODES)).count() == 0


def test_linear_trees(spark):
    rows = [(1, 2, "user", "b"), (1, 1, None, None), (1, 1, "user", "a"), (None, None, "user", "z")]
    got = {r["tree"]: [t["text"] for t in r["t"]] for r in chat.chat_format(chat.linear_trees(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).select("tree", chat.read_back(F.col("formatted")).alias("t")).collect()}
    assert got == {1: ["", "a", "b"], None: ["z"]}
