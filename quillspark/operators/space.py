"""Rooms, maps and progress: spatial joins, replays, bags and numbers of play."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import keep


def near_pairs(points: DataFrame, reach: float = 3.0, by: list[str] | None = None) -> DataFrame:
    """Pairs (a, b) of points (id, x, y) nearer than ``reach``. Points meet in grid cells of that size and the eight
    around, so only neighbours are compared."""
    by = by or []
    cell = points.withColumns({"cx": F.floor(F.col("x") / reach), "cy": F.floor(F.col("y") / reach)})
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    spread = cell.select(*by, F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by_"), "cx", "cy", F.explode(steps).alias("s")).withColumns({"cx": F.col("cx") + F.col("s.i"), "cy": F.col("cy") + F.col("s.j")}).drop("s")
    both = cell.join(spread, [*by, "cx", "cy"]).filter(F.col("id") < F.col("b"))
    far = F.hypot(F.col("x") - F.col("bx"), F.col("y") - F.col("by_"))
    return both.select(*by, F.col("id").alias("a"), "b", far.alias("distance")).filter(F.col("distance") < reach)


def nearest(points: DataFrame, x: float, y: float, reach: float) -> DataFrame:
    """The point in reach that is nearest; ties to the smaller id."""
    d = F.hypot(F.col("x") - x, F.col("y") - y)
    return points.withColumn("distance", d).filter(F.col("distance") <= reach).agg(F.min(F.struct("distance", "id")).alias("m")).select("m.id", "m.distance").filter("id is not null")


#: Places that a cell of the first grid may hold.
CROWD = 64
_WAYS = [("down", 0, 1), ("left", -1, 0), ("right", 1, 0), ("up", 0, -1)]


def nearest_in_direction(stops: DataFrame, cos: float = 0.5) -> DataFrame:
    """For each stop (world, id, x, y) and each of four directions, the nearest other stop of its world that lies within
    the cone (cosine at least ``cos``); ties to the smaller id.

    A search over growing rings: a stop meets the places in its cell of a grid and the eight around it. What it finds
    within a cell's length is the nearest for certain; else it goes on to a grid of twice the size, until that covers its
    world. Places stand once however many stops they have, and the first grid is fine enough for the most crowded one.
    """
    p = stops.groupBy("world", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).agg(F.min("id").alias("to"))
    wide, high = F.max("x") - F.min("x"), F.max("y") - F.min("y")
    size = p.groupBy("world").agg(F.greatest(wide, high).alias("span"), F.greatest(F.sqrt(wide * high / F.count(F.lit(1))), F.greatest(wide, high) / F.count(F.lit(1))).alias("cell"))
    p = keep(p.join(size.filter("span > 0"), "world"))
    level = 0
    at = lambda c, k: F.floor(F.col(c) / (F.col("cell") * 2.0**k)).cast("long")
    while level > -40 and (p.groupBy("world", at("x", level), at("y", level)).count().agg(F.max("count")).first()[0] or 0) > CROWD:
        level -= 2
    ways = F.array(*[F.struct(F.lit(n).alias("dir"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for n, dx, dy in _WAYS])
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    left, found = p.select("world", "x", "y", "span", "cell", F.explode(ways).alias("v")), None
    while not (left := keep(left)).isEmpty():
        cells = p.select("world", at("x", level).alias("cx"), at("y", level).alias("cy"), F.col("x").alias("tx"), F.col("y").alias("ty"), "to")
        ask = left.withColumns({"cx": at("x", level), "cy": at("y", level), "s": F.explode(around)}).withColumns({"cx": F.col("cx") + F.col("s.i"), "cy": F.col("cy") + F.col("s.j")})
        d = F.hypot(F.col("tx") - F.col("x"), F.col("ty") - F.col("y"))
        dot = ((F.col("tx") - F.col("x")) * F.col("v.dx") + (F.col("ty") - F.col("y")) * F.col("v.dy")) / F.col("d")
        near = ask.join(cells, ["world", "cx", "cy"]).withColumn("d", d).filter((F.col("d") > 0)).filter(dot >= cos)
        best = near.groupBy("world", "x", "y", "v").agg(F.min(F.struct("d", "to")).alias("b"))
        t = keep(left.join(best, ["world", "x", "y", "v"], "left"))
        ring = F.col("cell") * 2.0**level
        sure = (F.col("b.d") <= ring * (1 - 1e-9)) | (ring > F.col("span"))
        got = t.filter(F.coalesce(sure, ring > F.col("span")) & F.col("b").isNotNull()).select("world", "x", "y", F.col("v.dir").alias("dir"), F.col("b.to").alias("to"))
        found = got if found is None else found.unionByName(got)
        left, level = t.filter(~F.coalesce(sure, ring > F.col("span"))).drop("b"), level + 1
    if found is None:
        found = p.select("world", "x", "y", F.lit("").alias("dir"), "to").limit(0)
    placed = stops.select("world", "id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return placed.join(found, ["world", "x", "y"]).select("world", "id", "dir", "to")


def zone_of(points: DataFrame, zones: DataFrame, default: str = "", cell: float = 16.0) -> DataFrame:
    """The first rectangle (ord, x0, y0, x1, y1, zone) that holds a point, or the default. Rectangles are dealt over the
    grid cells that they touch, so points meet only those of their cell."""
    span = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor(F.greatest(F.col(a), F.col(b)) / cell))
    dealt = zones.filter("x0 <= x1 and y0 <= y1").withColumn("cx", F.explode(span("x0", "x1"))).withColumn("cy", F.explode(span("y0", "y1")))
    placed = points.withColumns({"cx": F.floor(F.col("x") / cell), "cy": F.floor(F.col("y") / cell)})
    inside = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    hit = placed.join(dealt, ["cx", "cy"]).filter(inside).groupBy("id").agg(F.min_by("zone", "ord").alias("zone"))
    return points.select("id").distinct().join(hit, "id", "left").select("id", F.coalesce("zone", F.lit(default)).alias("zone"))


def nearest_edge(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Which side of a room a cell is nearest to; ties in the order left, right, top, bottom."""
    d = [x, w - 1 - x, y, h - 1 - y]
    least = F.least(*d)
    return F.when(d[0] == least, "left").when(d[1] == least, "right").when(d[2] == least, "top").otherwise("bottom")


def terrain_at(grid: DataFrame) -> DataFrame:
    """(x, y, terrain) of map rows (y, row)."""
    return grid.select(F.posexplode(F.filter(F.split("row", ""), lambda c: c != "")).alias("x", "terrain"), "y").select("x", "y", "terrain")


def terrain_lookup(row: Column, x: Column, default: str) -> Column:
    return F.when((x >= 0) & (x < F.length(row)), F.substr(row, x + 1, F.lit(1))).otherwise(default)


def coast(cells: DataFrame, water: str = "~") -> DataFrame:
    """Land cells (x, y) with water on one of four sides."""
    land, sea = cells.filter(F.col("terrain") != water), cells.filter(F.col("terrain") == water)
    near = F.explode(F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))])).alias("n")
    return land.join(sea.select(near).select("n.x", "n.y").distinct(), ["x", "y"], "left_semi").select("x", "y")


def roster(moves: DataFrame, steps: DataFrame, keys: list[str]) -> DataFrame:
    """Who is there after each step: the last of a character's moves (step, who, change +1 or -1) up to it is an entry.
    Moves of step -1 are who is there from the start. ``steps`` has the keys and step."""
    span = Window.partitionBy(*keys, "who").orderBy("step")
    m = moves.groupBy(*keys, "who", "step").agg(F.max("change").alias("change"))  # leaving comes before entering
    m = m.withColumn("until", F.lead("step").over(span)).filter("change > 0")
    on = [steps[k] == m[k] for k in keys] + [steps["step"] >= m["step"], m["until"].isNull() | (steps["step"] < m["until"])]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return steps.join(m, cond).select(*[steps[k] for k in keys], steps["step"], "who")


def progress(saves: DataFrame, key: str = "slot", order: str = "ts", value: str = "rank") -> DataFrame:
    """The furthest that was reached so far, which never falls."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return saves.withColumn("reached", F.max(value).over(w))


def next_chapter(chapters: DataFrame) -> DataFrame:
    """rank and next of chapters (campaign, ord, chapter)."""
    w = Window.partitionBy("campaign").orderBy("ord")
    return chapters.select("campaign", "chapter", (F.row_number().over(w) - 1).alias("rank"), F.lead("chapter").over(w).alias("next"))


def unlocked(doors: DataFrame, ranks: DataFrame, reached: int) -> DataFrame:
    """Doors (door, chapter) that are open: no threshold, or one that is reached."""
    r = ranks.select("chapter", "rank")
    return doors.join(r, "chapter", "left").withColumn("open", F.col("chapter").isNull() | F.coalesce(F.col("rank") <= reached, F.lit(False))).select("door", "open")


def next_line(lines: DataFrame, heard: DataFrame) -> DataFrame:
    """Each speaker's first unheard line (who, ord, line), else the last."""
    h = heard.select("who", "ord").distinct().withColumn("heard", F.lit(True))
    t = lines.join(h, ["who", "ord"], "left")
    return t.groupBy("who").agg(F.coalesce(F.min_by("line", F.when(F.col("heard").isNull(), F.col("ord"))), F.max_by("line", "ord")).alias("line"))


def fresh_loot(contents: DataFrame, bag: DataFrame) -> DataFrame:
    return contents.join(bag.select("item").distinct(), "item", "left_anti")


def bag_view(bag: DataFrame, items: DataFrame, worn: DataFrame, category: str | None = None) -> DataFrame:
    """Bag ⋈ catalogue, with the slot where an item is worn."""
    out = bag.join(items, "item").join(worn.select("item", F.col("slot").alias("worn_on")), "item", "left")
    return out.filter(F.col("category") == category) if category else out


def equipment_stats(base: DataFrame, worn: DataFrame) -> DataFrame:
    """base (who, stat, value) plus the bonuses (map) of what is worn."""
    bonus = worn.select("who", F.explode("bonus").alias("stat", "value"))
    return base.select("who", "stat", "value").unionByName(bonus.select("who", "stat", "value")).groupBy("who", "stat").agg(F.sum("value").alias("value"))


def leading_bonus(col: Column, default: str = "defense") -> Column:
    """The key of a map with the largest value, the first on ties."""
    entries = F.map_entries(col)
    best = F.array_max(F.transform(entries, lambda e: e["value"]))
    return F.coalesce(F.try_element_at(F.filter(entries, lambda e: e["value"] == best), F.lit(1))["key"], F.lit(default))


def direction(dx: Column, dy: Column) -> Column:
    return F.when(F.abs(dx) > F.abs(dy), F.when(dx > 0, "right").otherwise("left")).otherwise(F.when(dy > 0, "down").otherwise("up"))


#: What a point of each is worth, and the force that adds nothing.
LIFE_PER_VITALITY, PIXELS_PER_SPEED, FORCE_PER_DAMAGE, DEFENCE_PER_POINT, BASE_FORCE = 4, 10.0, 5, 6, 5


def derived_stats(vitality: Column, speed: Column, force: Column | None = None, wisdom: Column | None = None, defence: Column | None = None) -> dict[str, Column]:
    """Life, speed and, where they are given, damage of the sword (whole fives of force beyond the base), of spells, and
    the reduction (whole sixes of defence). Divisions cut towards zero."""
    whole = lambda c: c.cast("int")
    out = {"life": whole(vitality) * LIFE_PER_VITALITY, "speed": F.greatest(F.lit(1.0), speed.cast("double")) * PIXELS_PER_SPEED}
    if force is not None:
        out["sword"] = 1 + whole(whole(force - BASE_FORCE) / FORCE_PER_DAMAGE)
    if wisdom is not None:
        out["spell"] = whole(wisdom)
    if defence is not None:
        out["reduction"] = whole(whole(defence) / DEFENCE_PER_POINT)
    return out


def portrait(moods: Column, mood: Column, base: Column) -> Column:
    """The mood's picture if there is one, else the plain one, else none."""
    return F.when(F.array_contains(moods, mood), F.concat_ws("-", base, mood)).otherwise(F.coalesce(base, F.lit("")))


def damage(amount: Column, reduction: Column, magic: Column, immune: Column) -> Column:
    """At least 1 after the reduction; none of magic to those it cannot touch."""
    return F.when(magic & immune, 0).otherwise(F.greatest(F.lit(1), amount - reduction))


def hits(blows: DataFrame, grace: float = 0.45) -> DataFrame:
    """Blows (target, t, amount) that count: none within ``grace`` seconds of the last that did. Each target's blows are
    folded in order."""
    ordered = blows.groupBy("target").agg(F.array_sort(F.collect_list(F.struct("t", "amount"))).alias("b"))
    start = F.struct(F.lit(-1e18).alias("last"), F.array().cast("array<struct<t: double, amount: double>>").alias("got"))
    step = lambda s, b: F.when(b["t"] - s["last"] >= grace, F.struct(b["t"].cast("double").alias("last"), F.array_append(s["got"], F.struct(b["t"].cast("double").alias("t"), b["amount"].cast("double").alias("amount"))).alias("got"))).otherwise(s)
    return ordered.select("target", F.explode(F.aggregate("b", start, step)["got"]).alias("h")).select("target", "h.t", "h.amount")


def living(fighters: DataFrame) -> DataFrame:
    """Fighters left in each wave."""
    return fighters.groupBy("wave").agg(F.count_if(F.col("life") > 0).alias("alive"))


def speakers_left(lines: DataFrame, heard: DataFrame) -> DataFrame:
    """Speakers of a scene with something still unheard."""
    return lines.join(heard.select("who", "ord").distinct(), ["who", "ord"], "left_anti").groupBy("scene").agg(F.count_distinct("who").alias("left"))


def coverage(cards: DataFrame) -> DataFrame:
    return cards.agg(F.count(F.lit(1)).alias("cards"), F.count_if("portrait").alias("portraits"), F.count_if("sheet").alias("sheets"), F.count_if("tile").alias("tiles"))


def halo(d: Column) -> Column:
    """Falloff of a light: the square of what is left to the rim."""
    return F.pow(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - d)), F.lit(2.0))


def with_roles(stops: DataFrame, roles: DataFrame) -> DataFrame:
    """Stops of a world (place) with the role of their place; those without one stay, with an empty role."""
    return stops.join(roles.select("place", "role"), "place", "left").withColumn("role", F.coalesce("role", F.lit("")))


def known_by_rank(entries: DataFrame, met: DataFrame) -> DataFrame:
    """The entries (id, rank) that a player has met, in the order of their rank."""
    return entries.join(met.select("id").distinct(), "id", "left_semi").orderBy("rank", "id")


def ready(blows: DataFrame, cooldown: float) -> DataFrame:
    """Tries (who, t) that come off: the first, and each that comes ``cooldown`` seconds or more after the last one that
    did."""
    return hits(blows.select(F.col("who").alias("target"), "t", F.lit(0.0).alias("amount")), cooldown).select(F.col("target").alias("who"), "t")
