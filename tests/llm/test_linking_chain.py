"""Large buckets that hang together by shared ids are compared bucket by bucket."""

from pyspark.sql import functions as F

from quillspark.llm import linking


def test_chained_buckets(spark):
    """40 buckets of 50 ids; each shares one id with the next. Ids are linked if they are equal modulo 4 and in a bucket."""
    rows = [(b, b * 49 + k) for b in range(40) for k in range(50)]
    rows += [(1000, i) for _, i in rows[:50]] + [(1001, i) for _, i in rows[:50]]  # the first one's ids twice more
    live = linking.shared_buckets(spark.createDataFrame(rows, "bucket long, id long"))
    pairs = []

    def verify(p):
        return p.filter("a % 4 = b % 4")

    def cross(outside, inside):
        o = outside.select("grp", F.col("id").alias("a"), F.col("comp").alias("ca"))
        both = o.join(inside.select("grp", F.col("id").alias("b"), F.col("comp").alias("cb")), "grp")
        pairs.append(both.count())
        return both.filter("ca <> cb and a % 4 = b % 4").select("a", "b")

    got = {r["id"]: r["comp"] for r in linking.link_components(live, verify, cross).collect()}
    root = {i: i for _, i in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for b in range(40):
        for r in range(4):
            same = [b * 49 + k for k in range(50) if (b * 49 + k) % 4 == r]
            for i in same[1:]:
                x, y = sorted((find(same[0]), find(i)))
                root[y] = x
    assert got == {i: find(i) for i in root if i in got} and all(i in got or find(i) == i for i in root)
    assert sum(pairs) <= 40 * 50 * 50  # not 1,961 ids times as many, and equal buckets once
