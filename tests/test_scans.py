"""Prefix scans: groups cut into many tasks give what one task gives."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import chunking, graph, layout, raster, scan, signal, space


@pytest.fixture(autouse=True)
def many_tasks(spark):
    """Small ranges, so that each group lies in several tasks."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_running_sums_and_rows_before(spark):
    rows = [(g, i, v) for g in ("a", None, "c") for i, v in enumerate(random.Random(1).choices([0, 1, 2, None], k=60 if g else 9))]
    df = spark.createDataFrame(rows, "g string, i int, v int").repartition(5)
    got = {(r["g"], r["i"]): r["s"] for r in scan.running(df, ["g"], ["i"], s=F.col("v")).collect()}
    want = {(g, i): sum(v or 0 for h, k, v in rows if h == g and k <= i) for g, i, _ in rows}
    assert got == want
    got = {(r["g"], r["i"]): (r["w"], r["was"]) for r in scan.previous(df, ["g"], ["i"], w=F.col("v"), was=F.col("i")).collect()}
    by = {(g, i): v for g, i, v in rows}
    assert got == {(g, i): (by.get((g, i - 1)), i - 1 if i else None) for g, i, _ in rows}
    assert scan.running(df.limit(0), ["g"], ["i"], s=F.col("v")).count() == 0


def counts(numbers):
    out, count = [], 0
    for n in numbers:
        count = n if n is not None and (count == 0 or abs(n - count - 1) <= 2) else count + 1
        out.append(count)
    return out


@pytest.mark.parametrize("seed", range(40))
def test_page_transitions_compose(seed):
    r = random.Random(seed)
    numbers, at = [], r.randint(1, 9)
    for _ in range(30):
        at += r.choice([1, 1, 1, 2, 3, 0])
        numbers.append(r.choice([at, at, None, r.randint(1, 40)]))
    for size in (1, 3, 7, 30):
        count = 0
        for k in range(0, 30, size):
            meets, first = layout.page_transition(numbers[k : k + size])
            count = first if k == 0 else meets.get(count, count + len(numbers[k : k + size]))
            assert count == counts(numbers)[min(k + size, 30) - 1]


def test_printed_pages_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(layout, "PAGES", 4)
    r, rows, want = random.Random(3), [], {}
    for book in range(3):
        numbers = [r.choice([k + 5, k + 5, None, k + 6, 999]) for k in range(40)]
        rows += [(book, k, f"text {k}" if n is None else f"text\n      {n}\n\n") for k, n in enumerate(numbers)]
        want.update({(book, k): c for k, c in enumerate(counts(numbers))})
    got = layout.printed_pages(layout.lines(spark.createDataFrame(rows, "book int, page_no int, text string"))).collect()
    assert {(x["book"], x["page_no"]): x["printed"] for x in got} == want


def made_book(r, chapters=6, titled=True):
    """A book of known chapters and paragraphs, set in pages of ten lines: (text, chapters, paragraphs)."""
    words = ["maison", "compagnons", "lumière", "grand", "porte", "chemin", "soir", "rivière"]
    lines, heads, found = [["Une page de titre"]], [], []
    for c in range(chapters):
        page = len(lines)
        title = f"Titre {r.choice(words)}"
        head = [f"          {c + 1}. {title}", ""] if titled else []
        if titled:
            heads.append((c, c + 1, title, page + 1))
        lines.append(list(head))
        for p in range(r.randint(1, 4)):
            text = " ".join(r.choice(words) for _ in range(r.randint(9, 30))).capitalize() + "."
            rest, first, put = text, True, []
            while rest:
                room = r.randint(24, 38)
                cut = rest if len(rest) <= room else rest[: rest.rfind(" ", 0, room)]
                tail = rest[len(cut) :].lstrip()
                word = tail.split(" ")[0] if tail else ""
                if tail and word == "compagnons" and r.random() < 0.7:
                    cut, tail = cut + " compa-", "gnons" + tail[len(word) :]
                put.append(("     " if first else "") + cut)
                rest, first = tail, False
            for k, line in enumerate(put):
                if len(lines[-1]) >= 10:
                    lines.append([])
                if k == 0:
                    found.append((c if titled else -1, len(lines), text))
                lines[-1].append(line)
            if r.random() < 0.3:
                lines[-1].append("")
    pages = [page if k % 3 == 2 and k else [*page, f"          {k + 1}"] for k, page in enumerate(lines)]
    return "\f".join("\n".join(p) for p in pages), heads, found


def test_books_cut_into_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(layout, "PAGES", 3)
    r = random.Random(5)
    books = {f"b{k}": made_book(r) for k in range(4)}
    texts = spark.createDataFrame([(b, t[0]) for b, t in books.items()], "book string, text string")
    vocab = spark.createDataFrame([("compagnons", 9)], "word string, n long")
    chapters, paragraphs = layout.parse_books(texts, vocab)
    heads, found = chapters.collect(), paragraphs.collect()
    for b, (_, want_heads, want) in books.items():
        assert sorted((x["chapter"], x["number"], x["title"], x["page"]) for x in heads if x["book"] == b) == want_heads
        mine = sorted((x["pos"], x["chapter"], x["page"], x["text"]) for x in found if x["book"] == b)
        assert [m[1:] for m in mine] == want
        assert [m[0] for m in mine] == list(range(len(want)))


def test_a_book_without_headings_begins_with_three_long_paragraphs(spark):
    long = "Un paragraphe de prose assez long " * 4
    parts = ["Petit mot.", long, "Un autre mot qui coupe la suite des longs.", long + "a", long + "b", long + "c", "Un mot de la fin qui compte encore un peu."]
    text = "\n".join("     " + "\n".join(p.strip().split(" ", 2)) for p in parts)
    chapters, paragraphs = layout.parse_books(spark.createDataFrame([("b", text)], "book string, text string"))
    assert chapters.count() == 0
    assert [(r["chapter"], r["text"]) for r in paragraphs.orderBy("pos").collect()] == [(-1, p.strip()) for p in parts[3:]]
    chapters, paragraphs = layout.parse_books(spark.createDataFrame([("b", "     Petit mot.\nPrologue\n" + text)], "book string, text string"))
    assert [(r["number"], r["title"]) for r in chapters.collect()] == [(None, "Prologue")]
    assert paragraphs.count() == 6 and {r["chapter"] for r in paragraphs.collect()} == {0}


def test_empty_books(spark):
    for rows in ([], [("b", "")], [("b", "\f\f")], [("b", "\n \n")]):
        chapters, paragraphs = layout.parse_books(spark.createDataFrame(rows, "book string, text string"))
        assert chapters.count() == 0 and paragraphs.count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_segments_are_those_of_a_walk(spark, seed):
    r = random.Random(seed)
    rows = [(b, k, k + 1, "x" * r.choice([0, 3, 10, 60, 250])) for b in range(3) for k in range(r.choice([1, 40, 90]))]
    want = []
    for b in range(3):
        at, held = 0, 0
        for _, k, _, text in (x for x in rows if x[0] == b):
            want.append((b, at, k + 1))
            held += len(text)
            if held >= 200:
                at, held = at + 1, 0
    firsts = {(b, at): (min(k for x, y, k in want if (x, y) == (b, at)), max(k for x, y, k in want if (x, y) == (b, at))) for b, at, _ in want}
    got = chunking.segments(spark.createDataFrame(rows, "book int, pos int, page int, text string"), 200).collect()
    assert {(x["book"], x["segment"]): x["label"] for x in got} == {key: f"Pages {a} à {z}" for key, (a, z) in firsts.items()}


def test_filters_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(signal, "BLOCK", 50)
    r = np.random.RandomState(2)
    v, hz = r.normal(size=333), r.choice([20.0, 900.0, 9000.0], 333)
    df = spark.createDataFrame([(1, i, float(x), float(h)) for i, (x, h) in enumerate(zip(v, hz, strict=True))], "sound int, i long, v double, hz double")
    want, y = [], 0.0
    for x, h in zip(v, hz, strict=True):
        y += (1 - np.exp(-2 * np.pi * h / signal.RATE)) * (x - y)
        want.append(y)
    got = [x["v"] for x in signal.low_pass(df, F.col("hz")).orderBy("i").collect()]
    assert np.allclose(got, want, rtol=1e-12, atol=1e-12)
    assert np.allclose([x["v"] for x in signal.low_pass(df, F.col("hz"), high=True).orderBy("i").collect()], v - np.array(want), atol=1e-12)


@pytest.mark.parametrize("seed", range(3))
def test_cones_by_rings(spark, seed):
    """Clusters, repeated places and a lone stop far off: the nearest in each cone is the one that all pairs give."""
    r = random.Random(seed)
    spots = [(r.uniform(0, 9), r.uniform(0, 9)) for _ in range(70)] + [(5 + r.random() / 1000, 5 + r.random() / 1000) for _ in range(90)] + [(5.0, 5.0)] * 4 + [(900.0, -700.0)]
    rows = [(k % 2, k, *p) for k, p in enumerate(spots)] + [(7, 1000, 1.0, 1.0), (7, 1001, 1.0, 1.0), (8, 1002, 3.0, 3.0), (9, 1003, 0.0, 2.0), (9, 1004, 0.0, 5.0)]
    want = {}
    for w, i, x, y in rows:
        for name, dx, dy in (("down", 0, 1), ("left", -1, 0), ("right", 1, 0), ("up", 0, -1)):
            near = [(float(np.hypot(tx - x, ty - y)), j) for v, j, tx, ty in rows if v == w and (tx, ty) != (x, y) and ((tx - x) * dx + (ty - y) * dy) / float(np.hypot(tx - x, ty - y)) >= 0.5]
            if near:
                want[i, name] = min(near)[1]
    got = space.nearest_in_direction(spark.createDataFrame(rows, "world int, id int, x double, y double")).collect()
    assert {(g["id"], g["dir"]): g["to"] for g in got} == want
    assert space.nearest_in_direction(spark.createDataFrame([], "world int, id int, x double, y double")).count() == 0


def test_siblings_by_classes(spark):
    r = random.Random(6)
    links = sorted({(f"p{r.randint(0, 5)}", f"k{r.randint(0, 25)}") for _ in range(60)} | {("k1", "k2"), ("p0", "k2"), ("p0", "k1")})
    married = [("k3", "k4"), ("k4", "k3"), ("k5", "z"), ("z", "k5")]
    near = {x for a, b in links for x in ((a, b), (b, a))} | set(married)
    want = {(a, b) for p, a in links for q, b in links if p == q and a != b} - near
    rows, wed = spark.createDataFrame(links, "parent string, child string"), spark.createDataFrame(married, "a string, b string")
    got = [(x["a"], x["b"]) for x in graph.siblings(rows, wed).collect()]
    assert sorted(got) == sorted(want)
    some = spark.createDataFrame([("k1",), ("k7",), ("nobody",)], "a string")
    assert {(x["a"], x["b"]) for x in graph.siblings(rows, wed, some).collect()} == {(a, b) for a, b in want if a in ("k1", "k7")}
    counts = {x["person"]: x["siblings"] for x in graph.sibling_counts(rows, wed).collect()}
    assert counts == {a: len({b for x, b in want if x == a}) for a, _ in want}
    whole = {(x["person"], x["row"]) for x in graph.trees(rows, wed).filter("ego = 'k1'").collect()}
    assert {(x["person"], x["row"]) for x in graph.trees(rows, wed, some.filter("a = 'k1'")).collect()} == whole


def test_a_family_of_very_many(spark):
    """50,000 children of one parent: counts and one child's siblings without a row for each pair."""
    rows = spark.range(50_000).select(F.lit("p").alias("parent"), F.concat(F.lit("k"), "id").alias("child"))
    assert graph.sibling_counts(rows).groupBy("siblings").count().collect()[0] == (49_999, 50_000)
    assert graph.siblings(rows, None, spark.createDataFrame([("k9",)], "a string")).count() == 49_999


def plain_centres(colors, rounds=12):
    colors = sorted(colors)
    x, n = np.array([c[:3] for c in colors], float), np.array([c[3] for c in colors], float)
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    i, j = divmod(int(d.argmax()), len(x))
    centres = x[[i, j]]
    for _ in range(rounds):
        own = ((x[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
        centres = np.array([(x[own == k] * n[own == k, None]).sum(0) / n[own == k].sum() if (own == k).any() else centres[k] for k in (0, 1)])
    return {(int(a), int(b), int(c)): int(o) for (a, b, c), o in zip(x, own, strict=True)}


def test_two_tones(spark):
    r = np.random.RandomState(4)
    images = {0: r.randint(0, 256, (300, 3)), 1: r.randint(90, 99, (400, 3)), 2: np.array([[7, 7, 7]] * 5), 3: np.array([[0, 0, 0], [9, 0, 0], [0, 9, 0], [0, 0, 9]]), 4: r.randint(0, 3, (60, 3)) * 100}
    rows = [(k, *map(int, c), 255) for k, cs in images.items() for c in cs] + [(0, 255, 255, 255, 0), (9, 1, 1, 1, 3)]
    got = raster.two_tone(spark.createDataFrame(rows, "image int, r int, g int, b int, a int")).collect()
    for k, cs in images.items():
        counted = {}
        for c in cs:
            counted[tuple(map(int, c))] = counted.get(tuple(map(int, c)), 0) + 1
        assert {(x["r"], x["g"], x["b"]): x["centre"] for x in got if x["image"] == k} == plain_centres([(*c, m) for c, m in counted.items()])
        assert {(x["r"], x["g"], x["b"]): x["n"] for x in got if x["image"] == k} == counted
    assert {x["image"] for x in got} == set(images)
