"""Small literal cases with results worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.operators import chunking, codex, dedup, dense, graph, layout, ocr, quality, raster, semantic, signal, space
from quillspark.sources import files


def one(spark, value, col):
    return spark.createDataFrame([(value,)], "x string").select(col(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("text", "want"), [("Éléa d’Arko!", "elea d arko"), ("", ""), ("  A--B ", "a b"), ("Cœur", "c ur")])
def test_fold(spark, text, want):
    assert one(spark, text, tx.fold) == want


def test_tokens(spark):
    assert one(spark, "Les cavaliers du cœur, le boss glass", tx.tokenize) == ["cavalier", "ur", "boss", "glass"]
    h = 2166136261
    for c in b"orvan mirel":
        h = (h ^ c) * 16777619 % (1 << 32)
    assert one(spark, "orvan mirel", tx.fnv1a) == h
    assert one(spark, None, tx.tokenize) == []


def test_small_formats(spark):
    assert one(spark, "Vu [1] , puis [2].", tx.strip_markers) == "Vu, puis."
    assert one(spark, "[3]", tx.strip_markers) == "(…)"
    assert one(spark, "a [2] b [10] c [2]", tx.citations) == [2, 10]
    assert one(spark, "H élas", tx.drop_cap) == "Hélas"
    assert one(spark, "À demain", tx.drop_cap) == "À demain"
    assert one(spark, 'say {"a": {"b": "}"}} end', tx.first_json_object) == '{"a": {"b": "}"}}'
    assert one(spark, "none {", tx.first_json_object) is None
    assert spark.range(1).select(tx.roman(F.lit(14)), tx.book_id(F.lit(2), F.lit(7)), tx.round_half_up(F.lit(-2.5))).first() == ("XIV", "s2-t07", -2)


@pytest.mark.parametrize(("text", "want"), [("sa mère", True), ("frère d'armes", False), ("son épouse", False), ("epouse de", True), ("le roi", False)])
def test_kinship(spark, text, want):
    assert one(spark, text, tx.kinship) is want


@pytest.mark.parametrize(("text", "want"), [("La grande salle", True), ("Xqz Brt", False), ("lE gRaNd", False), ("ab", False), ("a | bcd", False)])
def test_readable_title(spark, text, want):
    assert one(spark, text, tx.readable_title) is want


def test_greedy_keeps_what_lost_its_twin(spark):
    ids = spark.createDataFrame([(k,) for k in range(4)], "id int")
    pairs = spark.createDataFrame([(0, 1), (1, 2)], "a int, b int")
    got = {r["id"]: (r["kept"], r["same_as"]) for r in dedup.greedy(ids, pairs).collect()}
    assert got == {0: (True, None), 1: (False, 0), 2: (True, None), 3: (True, None)}



def test_chunks(spark):
    assert chunking.group_paragraphs([700, 650, 100]) == [[0, 1], [2]]
    assert chunking.group_paragraphs([1000, 500, 100]) == [[0], [1, 2]]
    assert chunking.group_paragraphs([1000, 350, 100]) == [[0, 1], [1, 2]]
    assert chunking.group_paragraphs([100, 3000, 100]) == [[0], [1], [2]]
    rows = [("b", 0, 0, 1, "x" * 200), ("b", 1, 1, 2, "y" * 50), ("b", 2, 2, 3, "z" * 130)]
    got = chunking.chunk(spark.createDataFrame(rows, "book string, pos int, chapter int, page int, text string")).orderBy("n").collect()
    assert [(r["n"], r["chapter"], r["pages"]) for r in got] == [(1, 0, "p. 1"), (2, 2, "p. 3")]


def test_longest_run():
    assert layout.increasing([1, 2, 9, 3, 4]) == [0, 1, 3, 4]
    assert layout.increasing([]) == []
    assert layout.increasing([3, 2, 1]) == [0]


def test_join_lines():
    assert layout.join_lines("les compa-", "gnons", {}) == "les compagnons"
    assert layout.join_lines("peut-", "être", {"peut-être": 3}) == "peut-être"
    assert layout.join_lines("a", "b", {}) == "a b"


def book_text():
    pages = []
    for k in range(1, 13):
        head = "LE GRAND LIVRE"
        number = f"          {(k + 1) // 2}. Titre numéro {k}" if k % 2 else ""
        body = "\n".join([number, "", "     Un paragraphe assez long pour compter dans ce livre qui n'en", "finit pas de finir."]) if number else "     Encore un paragraphe qui compte bien assez de signes.\n"
        pages.append(f"{head}\n{body}\n\n          {k}")
    return "\f".join(pages)


def test_parse_book(spark):
    chapters, paragraphs = layout.parse_books(spark.createDataFrame([("b", book_text())], "book string, text string"))
    got = chapters.orderBy("chapter").collect()
    assert [r["number"] for r in got] == [1, 2, 3, 4, 5, 6]
    text = [r["text"] for r in paragraphs.orderBy("pos").collect()]
    assert len(text) == 12 and not any("GRAND LIVRE" in t for t in text)
    assert paragraphs.filter("page = 3").first()["chapter"] == 1


def test_repair(spark):
    vocab = spark.createDataFrame([("château", 9), ("maison", 40), ("raison", 10), ("c’est", 9), ("cheval", 5), ("rare", 3)], "word string, n int")
    tokens = spark.createDataFrame([("b", w) for w in ("Chateau", "maison", "Cest", "chevql", "taison", "rarf")], "book string, token string")
    got = {r["token"]: (r["fixed"], r["rule"]) for r in ocr.corrections(tokens, vocab).collect()}
    assert got["Chateau"] == ("Château", "accents")
    assert got["maison"] == ("maison", "known")
    assert got["Cest"] == ("C’est", "apostrophe")
    assert got["chevql"] == ("cheval", "distance1")
    assert got["taison"] == ("maison", "distance1")
    assert got["rarf"] == ("rarf", "unknown")
    fixed, stats = ocr.repair(spark.createDataFrame([("b", 1, "Le  chateau\nII dort")], "book string, id int, text string"), vocab)
    assert fixed.first()["text"] == "Le  château\nIl dort"
    assert {r["rule"]: r["n"] for r in stats.collect()}["accents"] == 1


def test_capped_walk(spark):
    a = " ".join(f"word{k}" for k in range(20))
    b = " ".join(f"other{k}" for k in range(20))
    c = " ".join(f"third{k}" for k in range(20))
    rows = [(1, 10, 1, 1, a), (2, 11, 1, 1, a), (3, 12, 1, 1, b), (4, 13, 1, 1, c), (5, 14, 2, -1, c)]
    hits = spark.createDataFrame(rows, "pos int, doc int, order int, chapter int, text string")
    assert [r["doc"] for r in dense.capped_walk(hits).orderBy("pos").collect()] == [10, 12, 14]


ENTRIES = [(0, "a", "Orvan", ["Roi", "Mirel"], "personnage", [1, 2]), (1, "b", "Mirel", ["Princesse"], "personnage", [3]), (2, "c", "Orvan", ["Tasken"], "lieu", [1])]


@pytest.fixture
def entries(spark):
    e = spark.createDataFrame(ENTRIES, "idx int, id string, name string, aliases array<string>, kind string, books array<int>")
    return e.withColumns({"gloss": F.lit("g"), "description": F.lit("d")})


def test_name_maps(entries):
    e = codex.with_distinctive_aliases(entries)
    assert {r["idx"]: r["aliases"] for r in e.collect()} == {0: ["Mirel"], 1: [], 2: ["Tasken"]}
    assert {r["key"]: r["idx"] for r in codex.search_names(e).collect()} == {"orvan": 0, "mirel": 0, "tasken": 2}
    assert {r["key"]: r["idx"] for r in codex.relation_names(e).collect()} == {"orvan": 2, "mirel": 1, "tasken": 2}


def test_search_cards(entries):
    e = codex.with_distinctive_aliases(entries)
    got = codex.search_cards("Qui est Tasen ?", e).collect()
    assert (got[0]["idx"], got[0]["score"], got[0]["exact"]) == (2, 96.0, True)
    assert codex.expand_query("Orvan ?", e).first()["query"].startswith("Orvan ? Mirel")


def test_passages_count_shared_spaces(spark):
    names = spark.createDataFrame([("abcd", 1), ("ab cd", 2)], "key string, idx int")
    texts = spark.createDataFrame([("abcd abcd ab cd",)], "text string")
    assert {r["idx"]: r["n"] for r in codex.passage_counts(texts, names).collect()} == {1: 2, 2: 1}


def test_folding_of_keys(spark):
    e = spark.createDataFrame([("roi", "p"), ("roi de coeur", "p"), ("reine de pique", "p"), ("chat", "x"), ("chats", "x")], "key string, kind string")
    assert [(r["key"], r["target"]) for r in codex.fold_headwords(e).collect()] == [("roi de coeur", "roi")]
    assert [(r["key"], r["target"]) for r in codex.fold_plurals(e).collect()] == [("chats", "chat")]


def test_contradictions(spark):
    rows = [("a", "b", 2, False, None), ("b", "a", 1, True, "x"), ("c", "d", 1, False, None), ("d", "c", 1, False, None), ("e", "f", 1, False, None)]
    got = graph.resolve(spark.createDataFrame(rows, "parent string, child string, n int, self boolean, nature string")).collect()
    assert sorted((r["parent"], r["child"]) for r in got) == [("b", "a"), ("e", "f")]


def test_chains_and_cycles(spark):
    ids = spark.createDataFrame([(k,) for k in range(8)], "idx int")
    owners = spark.createDataFrame([(0, 1), (1, 2), (4, 5), (5, 6), (6, 5), (7, 4)], "idx int, owner int")
    got = {r["idx"]: r["canonical"] for r in graph.canonical(ids, owners).collect()}
    assert (got[0], got[1], got[2], got[3]) == (2, 2, 2, 3)
    assert got[4] == got[5] == got[6] == got[7] == 5


def test_siblings_and_trees(spark):
    kin = spark.createDataFrame([("g", "p"), ("p", "x"), ("p", "y"), ("p", "z")], "parent string, child string")
    married = spark.createDataFrame([("x", "y"), ("y", "x")], "a string, b string")
    assert {(r["a"], r["b"]) for r in graph.siblings(kin, married).collect()} == {("x", "z"), ("z", "x"), ("y", "z"), ("z", "y")}
    tree = {r["person"]: r["row"] for r in graph.trees(kin, married).filter("ego = 'x'").collect()}
    assert tree == {"x": "Génération", "y": "Génération", "z": "Génération", "p": "Parents", "g": "Grands-parents"}


def test_rooms(spark):
    rooms = spark.createDataFrame([("a", 5, 5), ("b", 4, 4)], "id string, width int, height int")
    doors = spark.createDataFrame([("a", 0, 2, "b", 1, 1, True, ""), ("a", 2, 2, "c", 0, 0, False, None)], "room string, x int, y int, dst string, ax int, ay int, locked boolean, reason string")
    got = {r["check"] for r in quality.rooms(rooms, doors).collect()}
    assert got == {"door off the edge", "door to nowhere", "no way back", "locked without reason"}


def test_roster(spark):
    moves = spark.createDataFrame([("s", "a", -1, 1), ("s", "a", 1, -1), ("s", "b", 1, 1)], "scene string, who string, step int, change int")
    steps = spark.createDataFrame([("s", 0), ("s", 1)], "scene string, step int")
    assert {(r["step"], r["who"]) for r in space.roster(moves, steps, ["scene"]).collect()} == {(0, "a"), (1, "b")}


def test_hits_have_a_grace(spark):
    blows = spark.createDataFrame([("t", 0.0, 1.0), ("t", 0.3, 1.0), ("t", 0.5, 1.0)], "target string, t double, amount double")
    assert [r["t"] for r in space.hits(blows).orderBy("t").collect()] == [0.0, 0.5]


def test_near_pairs(spark):
    p = spark.createDataFrame([(1, 0, 0), (2, 2, 2), (3, 9, 9)], "id int, x int, y int")
    assert [(r["a"], r["b"]) for r in space.near_pairs(p).collect()] == [(1, 2)]


def test_images(spark):
    px = [("i", 0, x, y, (x // 2) * 50, (y // 2) * 50, 0, 255) for x in range(4) for y in range(4)]
    df = spark.createDataFrame(px, "image string, frame int, x int, y int, r int, g int, b int, a int")
    assert raster.block_size(df).first()["block"] == 2
    assert raster.palette_stats(df).first()["colors"] == 4
    pal = spark.createDataFrame([(0, 0, 0, 0), (1, 255, 255, 255)], "idx int, r int, g int, b int")
    got = {(r["r"], r["g"]): r["idx"] for r in raster.nearest_colors(spark.createDataFrame([(10, 10, 10), (250, 250, 250)], "r int, g int, b int"), pal).collect()}
    assert got == {(10, 10): 0, (250, 250): 1}
    assert raster.snap(df, pal).count() == 4
    assert raster.two_tone(df).count() == 4
    back = df.withColumns(raster.hsl(F.col("r"), F.col("g"), F.col("b")))
    assert back.withColumns({f"o_{k}": v for k, v in raster.rgb(F.col("h"), F.col("s"), F.col("l")).items()}).filter("o_r <> r or o_g <> g or o_b <> b").count() == 0


def test_sound(spark):
    n = signal.noise(1, 5)
    state, want = 1, []
    for _ in range(5):
        state = (state * 1_664_525 + 1_013_904_223) % (1 << 32)
        want.append(state / (1 << 32) * 2 - 1)
    assert n.tolist() == pytest.approx(want)
    assert spark.range(1).select(signal.note_hz(F.lit("A4")), signal.note_hz(F.lit("C5"))).first() == pytest.approx((440.0, 523.2511306))
    rows = spark.createDataFrame([("s", k, math.sin(k)) for k in range(50)], "sound string, i long, v double")
    assert signal.measures(signal.normalise(rows, 0.5)).first()["peak"] == pytest.approx(0.5)
    assert signal.low_pass(rows, 500).count() == 50
    wav = bytes(signal.wav(rows).first()["wav"])
    assert wav[:4] == b"RIFF" and len(wav) == 44 + 100


def test_settings(spark):
    lines = spark.createDataFrame([(1, "A='x'"), (2, "A=y"), (3, "# B=1"), (4, "C="), (5, 'export D="z"')], "n int, line string")
    assert {r["name"]: r["value"] for r in files.settings(lines).collect()} == {"A": "x", "D": "z"}


def test_json_leaves(spark):
    rows = spark.createDataFrame([(1, '{"a": [{"base64": "x"}], "base64": "y"}')], "id int, j string")
    assert {(r["path"], r["value"]) for r in files.leaves(rows, "j", "base64").collect()} == {("$.base64", "y"), ("$.a[0].base64", "x")}


def test_guarded_write(spark, tmp_path):
    path = str(tmp_path / "t")
    assert files.write_guarded(spark.range(5), path, failed=True)
    assert not files.write_guarded(spark.range(3), path, failed=True)
    assert files.latest(spark, path).count() == 5
    assert files.write_guarded(spark.range(3), path, failed=False)
    assert files.latest(spark, path).count() == 3


def test_events_in(spark):
    lines = spark.createDataFrame([('{"type": "text", "t": "a"}',), ("",), ('{"type": ',)], "value string")
    assert [r["t"] for r in files.events_in(lines, "type string, t string").collect()] == ["a"]


def test_retry():
    calls, waits = [], []

    def call(p):
        calls.append(p)
        if len(calls) < 3:
            raise ValueError
        return "ok"

    assert semantic.with_retry(call, "p", sleep=waits.append) == "ok" and waits == [1.5, 3.0]
    with pytest.raises(semantic.Fatal):
        semantic.with_retry(lambda p: (_ for _ in ()).throw(semantic.Fatal()), "p", sleep=waits.append)


def test_appearances(spark):
    names = spark.createDataFrame([("orvan", 1), ("mirel", 2)], "key string, idx int")
    texts = spark.createDataFrame([("Orvan avait de longs cheveux noirs et des yeux gris. Une femme aux cheveux blonds se jeta dans les bras de Mirel hier.",)], "text string")
    got = semantic.appearances(texts, names).collect()
    assert [(r["idx"], r["text"][:11]) for r in got] == [(1, "Orvan avait")]


ENTRY = "idx int, id string, name string, aliases array<string>, books array<int>"


def test_alias_owner_must_be_the_larger_card(spark):
    rows = [(0, "a", "Orvan", ["Mirel"], [1]), (1, "b", "Mirel", [], [1, 2, 3, 4]), (2, "c", "Tasken", [], [1]), (3, "d", "Kira", ["Tasken"], [1, 2]), (4, "e", "Onyx", ["Kira"], [1, 2]), (5, "f", "Sela", ["Nomar"], [1]), (6, "g", "Nomar", [], [2])]
    got = {r["idx"]: r["owner"] for r in graph.alias_owners(spark.createDataFrame(rows, ENTRY)).collect()}
    assert got == {2: 3, 6: 5}  # the card of four books stays; of equal ones the smaller id takes over


def test_long_alias_chains(spark):
    ids = spark.range(200).select(F.col("id").cast("int").alias("idx"))
    owners = spark.range(1, 200).select(F.col("id").cast("int").alias("idx"), (F.col("id") - 1).cast("int").alias("owner"))
    assert {r["canonical"] for r in graph.canonical(ids, owners).collect()} == {0}


@pytest.mark.parametrize(("text", "want"), [("ancêtre", True), ("descendant de", True), ("conjoint", True), ("une femme", False), ("femme de", True), ("ses enfants", False), ("jumeaux", False), ("frère d' arme", False), ("FRÈRE", True), ("l’enfant", True), ("mariée", True), ("sœur d’armes", False), ("aïeul", False), ("aieul", True), ("sépouse", True), ("lépouse", True)])
def test_kinship_terms(spark, text, want):
    assert one(spark, text, tx.kinship) is want


def test_names_with_accents(spark):
    rows = [("b", " ".join(["dit Hélène", "puis Océané", "et Élund"] * 12))]
    got = {r["word"] for r in ocr.names(spark.createDataFrame(rows, "book string, text string")).collect()}
    assert got == {"hélène", "océan"}
    assert one(spark, "GRANDE|ÉCOLE, né . Il", ocr.repair_glyphs) == "GRANDElÉCOLE, né . Il"


def test_card_text(spark):
    t = spark.sql("SELECT 'Orvan' AS name, 'personnage' AS kind, array('le Grand') AS aliases, 'un roi' AS gloss, '' AS description, 'il part' AS arc, array(named_struct('name', 'Mirel', 'nature', 'fille')) AS relations, array(named_struct('order', 1, 'full', 'Saga, tome I — Un')) AS volumes")
    assert t.select(codex.card_text(t.columns)).first()[0] == "Orvan — personnage\nAussi appelé : le Grand\nun roi\nÉvolution : il part\nLiens : Mirel (fille)\nTomes : Saga, tome I — Un"
    assert t.select(codex.card_text()).first()[0] == "Orvan — personnage\nAussi appelé : le Grand\nun roi"


def test_cited_chunks(spark):
    chunks = spark.createDataFrame([("b", 1, 0, "p. 3", "x"), ("b", 12345, -1, "p. 4-5", "y")], "book string, n int, chapter int, pages string, text string")
    got = chunking.cited(chunks, spark.createDataFrame([("b", "E2T07", "Saga, tome VII — T")], "book string, prefix string, label string"), spark.createDataFrame([("b", 0, "Chapitre 1")], "book string, chapter int, label string"))
    assert {(r["id"], r["ref"]) for r in got.collect()} == {("E2T07-0001", "Saga, tome VII — T, Chapitre 1, p. 3"), ("E2T07-12345", "Saga, tome VII — T, Hors chapitre, p. 4-5")}


def test_fighter_numbers(spark):
    t = spark.range(1).select(*[c.alias(k) for k, c in space.derived_stats(F.lit(6), F.lit(0), F.lit(3), F.lit(7), F.lit(11)).items()]).first()
    assert (t["life"], t["speed"], t["sword"], t["spell"], t["reduction"]) == (24, 10.0, 1, 7, 1)


def test_people_of_two_words_and_places(spark):
    texts = spark.createDataFrame([("Orvan le grand était un colosse aux cheveux noirs. Les enfants de la ville virent les yeux de la fanfare au loin. Le château des vents se dressait sur une colline, avec ses tours de pierre grise. Plus grand que le château des vents, le donjon était une forteresse de pierre bien haute.",)], "text string")
    names = spark.createDataFrame([("orvan le grand", 0), ("fan", 1)], "key string, idx int")
    got = semantic.appearances(texts, names).collect()
    assert [(r["idx"], r["text"]) for r in got] == [(0, "Orvan le grand était un colosse aux cheveux noirs.")]
    f = "orvan le grand etait un colosse aux cheveux noirs"
    assert got[0]["score"] == pytest.approx(300 - f.index("colosse") - 5.0)
    got = semantic.place_sentences(texts, spark.createDataFrame([("chateau des vents", 7)], "key string, idx int")).collect()
    assert [(r["idx"], r["text"][:20]) for r in got] == [(7, "Le château des vents")]


def test_lines_in_parts(spark):
    rows = [("s", 0, '{"a": 1}\n{"a"'), ("s", 1, ": 2}"), ("s", 2, "\n\n"), ("t", 0, "x")]
    got = {(r["source"], r["line"]): r["value"] for r in files.whole_lines(spark.createDataFrame(rows, "source string, seq int, value string")).collect()}
    assert got == {("s", 0): '{"a": 1}', ("s", 1): '{"a": 2}', ("s", 2): "", ("s", 3): "", ("t", 0): "x"}


def test_guarded_writes(spark, tmp_path):
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "part.parquet").write_text("no parquet")
    with pytest.raises(Exception, match="."):
        files.write_guarded(spark.range(3), str(bad), failed=True)
    assert (bad / "part.parquet").read_text() == "no parquet"
    rows = spark.createDataFrame([("a", "A", [1]), ("b", "B", [2])], "id string, name string, books array<int>")
    files.write_by_id(rows, str(tmp_path / "cards"))
    assert {(r["id"], r["name"]) for r in spark.read.json(str(tmp_path / "cards/index")).collect()} == {("a", "A"), ("b", "B")}


def test_jobs_are_awaited():
    left = {"a": 2, "b": 1}

    def check(i):
        left[i] -= 1
        return {"status": "completed", "cost": 0.5} if left[i] < 0 else {"status": "running"}

    waits = []
    done, cost = semantic.await_jobs(["a", "b"], check, wait=5.0, sleep=waits.append)
    assert set(done) == {"a", "b"} and cost == 1.0 and waits == [5.0, 5.0]
    with pytest.raises(TimeoutError):
        semantic.await_jobs(["a"], lambda i: {"status": "running"}, rounds=2, sleep=lambda s: None)


def test_near_twins_join_the_larger_colour(spark):
    px = [("i", 0, k, 0, 10, 10, 10, 255) for k in range(6)] + [("i", 0, k, 1, 12, 12, 12, 255) for k in range(4)] + [("i", 0, k, 2, 14, 14, 14, 255) for k in range(2)] + [("i", 0, 0, 3, 250, 250, 250, 255)]
    df = spark.createDataFrame(px, "image string, frame int, x int, y int, r int, g int, b int, a int")
    pal = spark.createDataFrame([(0, 255, 0, 0)], "idx int, r int, g int, b int")
    got = {r["r"]: r["to_r"] for r in raster.snap(df, pal).collect()}
    assert got == {10: 10, 12: 10, 14: 10, 250: 250}
    assert {r["to_r"] for r in raster.snap(df, pal, most=1).collect()} == {10}


def test_missing_book_is_an_error(spark):
    books = spark.createDataFrame([(1, "One")], "order int, title string")
    assert codex.with_book(spark.createDataFrame([(1,)], "order int"), books).first()["title"] == "One"
    with pytest.raises(Exception, match="no book at place 2"):
        codex.with_book(spark.createDataFrame([(2,)], "order int"), books).collect()


def test_cooldown(spark):
    rows = [("a", 0.0), ("a", 0.3), ("a", 0.5), ("a", 0.9), ("a", 1.2)]
    got = sorted(r["t"] for r in space.ready(spark.createDataFrame(rows, "who string, t double"), 0.5).collect())
    assert got == [0.0, 0.5, 1.2]


def test_repair_totals(spark):
    stats = spark.createDataFrame([("b", "known", 5), ("b", "accents", 2), ("b", "unknown", 1), ("b", "protected", 3)], "book string, rule string, n long")
    assert ocr.repair_totals(stats).first().asDict() == {"book": "b", "tokens": 8, "unknown_before": 3, "unknown_after": 1, "fixed": 2, "protected": 3}


def test_increasing_equals_the_plain_table():
    import random

    def plain(numbers):
        length = []
        for n in numbers:
            length.append(1 + max((length[k] for k in range(len(length)) if numbers[k] < n), default=0))
        if not length:
            return []
        at = length.index(max(length))
        out = [at]
        while length[at] > 1:
            at = next(k for k in range(at) if length[k] == length[at] - 1 and numbers[k] < numbers[at])
            out.append(at)
        return out[::-1]

    r = random.Random(3)
    for _ in range(400):
        numbers = [r.randint(0, 12) for _ in range(r.randint(0, 25))]
        assert layout.increasing(numbers) == plain(numbers)


def test_deep_json(spark):
    deep = '{"a": ' * 12 + '{"base64": "}{"}' + "}" * 12
    assert one(spark, f"so: {deep} and", tx.first_json_object) == deep
    assert one(spark, "[1, 2]", tx.first_json_object) == "[1, 2]"
    assert one(spark, "x {oops} {}", tx.first_json_object) is None
    rows = spark.createDataFrame([(1, deep), (2, "broken {")], "id int, j string")
    assert [(r["id"], r["value"]) for r in files.leaves(rows, "j", "base64").collect()] == [(1, "}{")]


def test_moving_cutoff(spark):
    rows = spark.range(400).select(F.lit("s").alias("sound"), F.col("id").alias("i"), F.when(F.col("id") % 2 == 0, 1.0).otherwise(-1.0).alias("v"))
    got = {r["i"]: r["v"] for r in signal.low_pass(rows, F.when(F.col("i") < 200, 20.0).otherwise(10_000.0)).collect()}
    assert max(abs(got[k]) for k in range(200)) < 0.01 < 0.5 < max(abs(got[k]) for k in range(300, 400))
    same = [r["v"] for r in signal.low_pass(rows, 500.0).orderBy("i").collect()]
    assert same == [r["v"] for r in signal.low_pass(rows, F.lit(500.0)).orderBy("i").collect()]


def test_search_is_lexical_where_vectors_do_not_match(spark):
    lexical_hits = spark.createDataFrame([(1, 2.0), (2, 1.0)], "doc long, score double")
    other = spark.createDataFrame([(2, 0.9)], "doc long, score double")
    assert [n for n, _ in dense.search_pools(spark.range(3), spark.range(3), lexical_hits, lambda: other)] == ["lexical", "semantic"]
    with pytest.warns(RuntimeWarning, match="lexical only"):
        pools = dense.search_pools(spark.range(3), spark.range(2), lexical_hits, lambda: 1 / 0)
    assert [n for n, _ in pools] == ["lexical"]
    assert [r["doc"] for r in dense.fuse(*pools).orderBy(*dense.fused_order(["lexical"])).collect()] == [1, 2]


def test_message_without_cards_or_passages(spark):
    cards = spark.createDataFrame([], "pos int, name string, kind string, aliases array<string>, gloss string, description string, arc string, relations array<struct<name: string, nature: string>>, volumes array<string>")
    passages = spark.createDataFrame([], "pos int, ref string, text string, volume string")
    rows = semantic.message("Qui ?", passages, cards).orderBy("n").collect()
    assert [(r["n"], r["type"], r["text"]) for r in rows] == [(0, "text", semantic.NO_PASSAGES), (1, "text", "QUESTION\nQui ?")]
    card = spark.createDataFrame([(0, "Mirel", "personnage", [], "g", None, None, None, ["I"])], cards.schema)
    assert semantic.message("?", passages, card).orderBy("n").first()["text"] == semantic.CARDS_HEAD + "\n\n### Mirel (personnage)\ng\nApparaît dans : I"


def test_spoiler_rule_names_volumes(spark):
    volumes = spark.createDataFrame([(1, "Un"), (2, "Deux"), (3, "Trois")], "order int, label string")
    rule = lambda k: semantic.spoiler_rule(volumes, k).first()["rule"]
    assert rule(None) == rule(0) == rule(3) == ""
    assert "« Deux » inclus" in rule(2) and "à partir de « Trois »" in rule(2)
    assert semantic.system_prompt("R", semantic.spoiler_rule(volumes, None)).first()["prompt"] == "R"
