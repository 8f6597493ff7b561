"""Connected groups from buckets of candidates, without all pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import drop_scratch, materialize, scratch_scope


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): returns id and comp (smallest id of the component) for each id with a link.

    Each round takes, for each id, the smallest label among its neighbours' and its own, then the label of that label.
    So labels jump along chains of labels, and stars of leaders settle in two rounds. Labels are written after each
    round; links and labels are plain tables, so AQE can split an id with very many links. The loop ends when a round
    changes nothing.
    """
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    with scratch_scope() as keep:
        return keep(_settle(materialize(links.filter("a <> b").select(F.explode(ways).alias("e")).select("e.a", "e.b").distinct(), "links")))


def _settle(both: DataFrame) -> DataFrame:
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("comp")), "labels")
    while True:
        around = labels.select(F.col("id").alias("b"), F.col("comp").alias("near"))
        least = both.join(around, "b").groupBy(F.col("a").alias("id")).agg(F.min("near").alias("near"))
        jump = labels.select(F.col("id").alias("near"), F.col("comp").alias("far"))
        low = labels.join(least, "id").select("id", "comp", F.least("comp", "near").alias("near")).join(jump, "near").select("id", F.least("near", "far").alias("comp"), (F.least("near", "far") < F.col("comp")).alias("moved"))
        nxt = materialize(low, "labels")
        drop_scratch(labels)
        labels = nxt.select("id", "comp")
        labels._scratch = nxt._scratch
        if nxt.filter("moved").isEmpty():
            return labels


def _with_comp(rows: DataFrame, comps: DataFrame, col: str) -> DataFrame:
    c = comps.select(F.col("id").alias("_i"), F.col("comp").alias("_c"))
    return rows.join(c, F.col(col) == F.col("_i"), "left").withColumn(f"{col}_comp", F.coalesce("_c", col)).drop("_i", "_c")


def _grown(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components with further links: only the components that these join are worked on."""
    links = materialize(links, "more")
    if links.isEmpty():
        return comps
    joins = _with_comp(_with_comp(links, comps, "a"), comps, "b").select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b"))
    merged = components(joins)
    ends = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    all_ids = comps.unionByName(_with_comp(ends, comps, "id").select("id", F.col("id_comp").alias("comp"))).distinct()
    return materialize(_with_comp(all_ids, merged, "comp").select("id", F.col("comp_comp").alias("comp")), "comps")


def _across(large: DataFrame, cross: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Links across components in large buckets (bucket, id, id_comp): ids outside a bucket's largest component meet all of
    that bucket, and of no other that shares ids with it. Buckets of the very same ids count once. Of the second
    frame's rows ``out`` tells which are in the first."""
    sizes = large.groupBy("bucket", "id_comp").agg(F.count(F.lit(1)).alias("k")).groupBy("bucket").agg(F.max_by("id_comp", F.struct("k", "id_comp")).alias("main"), F.count(F.lit(1)).alias("kinds"))
    mixed = materialize(large.join(sizes.filter("kinds > 1").drop("kinds"), "bucket"), "mixed")
    mark = lambda *salt: F.sum(F.xxhash64("id", *map(F.lit, salt)).cast("decimal(20,0)"))
    marks = mixed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), mark().alias("one"), mark(1).alias("two"))
    once = materialize(marks.groupBy("n", "one", "two").agg(F.min("bucket").alias("bucket")).select("bucket"), "once")
    met = mixed.join(once, "bucket", "left_semi").select(F.col("bucket").alias("grp"), "id", F.col("id_comp").alias("comp"), "main")
    inside = met.withColumn("out", F.col("comp") != F.col("main")).drop("main")
    return cross(inside.filter("out").drop("out"), inside).distinct()


def shared_buckets(members: DataFrame) -> DataFrame:
    """Rows (bucket, id) of buckets with two ids or more, with n, the bucket's size."""
    sizes = materialize(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    return materialize(members.join(sizes, "bucket"), "members")


#: Buckets up to this size are compared pair by pair in the last step, which bounds its rows by so many for each member.
SMALL = 24


def link_components(live: DataFrame, verify: Callable[[DataFrame], DataFrame], cross: Callable[[DataFrame, DataFrame], DataFrame] | None = None, near: Callable[[str, str], Column] | None = None) -> DataFrame:
    """Components of the true links among ids that share a bucket. ``live`` comes from :func:`shared_buckets`; ``verify``
    takes pairs (a, b) and returns those that are links.

    A bucket's ids need not be compared all with all: what counts is that no link between two components is missed.
    First each id is compared with one leader, the id that shares most with others in its buckets; then with the leaders
    of its other buckets, where these are in another component; then each id outside its bucket's largest component with
    all of the bucket that is in another component than its own. After that, two ids that share a bucket are either in
    one component or were compared. The last step's pairs are as many as such outsiders times their buckets' ids, not
    the square of a bucket, when a bucket is one large group. Where ``cross`` is given, it takes over the last step for
    buckets of over ``SMALL`` ids: it gets outside (grp, id, comp) and inside (grp, id, comp, out) of such buckets, and returns
    links between different components, without a row for each pair. ``near`` gives a
    condition that every link meets, on further columns of ``live`` under two prefixes; pairs that don't meet it are never
    rows.

    Returns id, comp for ids with a link.
    """
    more = [c for c in live.columns if c not in ("bucket", "id", "n")]
    weight = materialize(live.groupBy("id").agg(F.sum("n").alias("w")), "weights")
    chosen = F.max_by(F.struct("id", *more), F.struct("w", (-F.col("id")).alias("o"))).alias("x")
    leaders = live.join(weight, "id").groupBy("bucket").agg(chosen).select("bucket", F.col("x.id").alias("leader"), *[F.col(f"x.{c}").alias(f"l_{c}") for c in more])
    tries = live.join(materialize(leaders, "leaders"), "bucket").filter("id <> leader")
    tries = (tries.filter(near("", "l_")) if near else tries).groupBy("leader", "id").agg(F.count(F.lit(1)).alias("shared"))
    tries = materialize(tries, "tries")
    best = tries.groupBy("id").agg(F.max_by("leader", F.struct("shared", (-F.col("leader")).alias("o"))).alias("leader"))
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    comps = components(verify(materialize(best.select(*pair("id", "leader")).distinct(), "pairs1")))

    rest = _with_comp(_with_comp(tries.select("id", "leader"), comps, "id"), comps, "leader").filter("id_comp <> leader_comp")
    rest = materialize(rest.select(*pair("id", "leader")).distinct(), "pairs2")
    if not rest.isEmpty():
        comps = _grown(comps, verify(rest))

    placed = materialize(_with_comp(live, comps, "id"), "placed")
    sizes = placed.groupBy("bucket", "id_comp").agg(F.count(F.lit(1)).alias("k"))
    largest = sizes.groupBy("bucket").agg(F.max_by("id_comp", F.struct("k", "id_comp")).alias("main"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    largest = materialize(largest, "largest")
    mixed = placed.join(largest, "bucket")
    outside = materialize(mixed.filter("id_comp <> main").select("bucket", F.col("id").alias("o"), F.col("id_comp").alias("o_comp"), "n", *[F.col(c).alias(f"o_{c}") for c in more]), "outside")
    if outside.isEmpty():
        return comps
    inside = materialize(mixed.select("bucket", "id", "id_comp", (F.col("id_comp") == F.col("main")).alias("main"), "n", *more), "inside")
    small = lambda df: df.filter(F.col("n") <= SMALL) if cross else df
    pairs = small(outside).join(small(inside).drop("n"), "bucket").filter("o_comp <> id_comp and (main or o < id)")
    pairs = pairs.filter(near("o_", "")) if near else pairs
    comps = _grown(comps, verify(materialize(pairs.select(*pair("o", "id")).distinct(), "pairs3")))
    if cross:
        large = materialize(_with_comp(inside.filter(F.col("n") > SMALL).select("bucket", "id"), comps, "id"), "large")
        comps = _grown(comps, _across(large, cross))
    return comps
