"""Large buckets of lines are compared in cells: all links are found, and pairs of lines are no rows."""

import random

import numpy as np

from quillspark.llm import line_dedup, linking


def test_a_large_bucket_makes_no_row_for_each_pair(spark, monkeypatch):
    """200 lines around one passage, no two of them similar enough, and a near copy of every fourth."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    passage, lines = [word() for _ in range(60)], []
    for _ in range(200):
        own = list(passage)
        for k in r.sample(range(20, 60), 7):
            own[k] = word()
        lines.append(own)
    for k in range(0, 200, 4):
        at = r.randrange(20, 60)
        lines.append([*lines[k][:at], lines[k][at][:-1] + "q", *lines[k][at + 1 :]])
    texts = [" ".join(x) for x in lines]
    rows, write = {}, linking.materialize

    def counted(df, name):
        out = write(df, name)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(linking, "materialize", counted)
    monkeypatch.setattr(line_dedup, "CELL_CHARS", 20_000)  # several cells to a bucket
    monkeypatch.setattr(line_dedup, "AT_ONCE", 100)
    got = line_dedup.line_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), finer=True)
    dropped = {x["doc_id"] for x in got.filter("lines_dropped > 0").collect()}

    root = list(range(len(texts)))
    pairs = [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts))]
    for (a, b), near in zip(pairs, line_dedup.within([(texts[a], texts[b]) for a, b in pairs], [max(len(texts[a]), len(texts[b])) // 10 for a, b in pairs]), strict=True):
        if near:
            low, high = sorted((root[a], root[b]))
            root = [low if x == high else x for x in root]
    assert dropped == {k for k, x in enumerate(root) if x != k} and len(dropped) >= 50
    assert sum(rows.get(name, 0) for name in ("pairs1", "pairs2", "pairs3")) < 10 * len(texts)


def test_bounds_lose_no_pair():
    """Letters never ask for more edits than there are, and the band holds every path of few enough."""
    r = random.Random(5)
    pairs = []
    for _ in range(3000):
        a = "".join(r.choice("abc é") for _ in range(r.randrange(40)))
        b = list(a)
        for _ in range(r.randrange(10)):
            k = r.randrange(len(b) + 1)
            b[k : k + r.randrange(2)] = r.choice(("", "x", "é"))
        pairs.append((a, "".join(b)))
    true = np.array([line_dedup.edit_distance(a, b) for a, b in pairs])
    least = line_dedup.fewest_edits(*(line_dedup.letters([p[side] for p in pairs]) for side in (0, 1)))
    assert (least <= true).all()
    most = [r.randrange(12) for _ in pairs]
    assert (line_dedup.within(pairs, most) == (true <= most)).all()
