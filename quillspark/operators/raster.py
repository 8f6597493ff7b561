"""Pixel rows (image, frame, x, y, r, g, b, a): palettes, boxes, colour spaces, redrawing by rule."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import keep

SCALES = [16, 12, 10, 8, 6, 5, 4, 3, 2]


def palette_stats(pixels: DataFrame) -> DataFrame:
    """Opaque and transparent pixels (alpha under 16), colours, and colours rarer than 0.1 % of the opaque (2 at least)."""
    total = pixels.groupBy("image").agg(F.count_if(F.col("a") >= 16).alias("opaque"), F.count_if(F.col("a") < 16).alias("transparent"), F.count_if((F.col("a") > 16) & (F.col("a") < 240)).alias("soft"))
    hist = pixels.filter("a >= 16").groupBy("image", "r", "g", "b").agg(F.count(F.lit(1)).alias("n")).join(total, "image")
    rare = hist.groupBy("image").agg(F.count(F.lit(1)).alias("colors"), F.count_if(F.col("n") < F.greatest(F.lit(2), F.col("opaque") / 1000)).alias("rare"))
    return total.join(rare, "image", "left").select("image", "opaque", "transparent", "soft", F.coalesce("colors", F.lit(0)).alias("colors"), F.coalesce("rare", F.lit(0)).alias("rare"))


def color_shares(pixels: DataFrame, limit: int = 16) -> DataFrame:
    """The colours of an image with the largest share of some frame's opaque pixels."""
    hist = pixels.filter("a >= 16").groupBy("image", "frame", "r", "g", "b").agg(F.count(F.lit(1)).alias("n"))
    total = hist.groupBy("image", "frame").agg(F.sum("n").alias("all"))
    share = hist.join(total, ["image", "frame"]).groupBy("image", "r", "g", "b").agg(F.max(F.col("n") / F.col("all")).alias("share"))
    w = Window.partitionBy("image").orderBy(F.desc("share"), "r", "g", "b")
    return share.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def boxes(pixels: DataFrame) -> DataFrame:
    """Bounding box of the opaque pixels of each frame."""
    return pixels.filter("a >= 16").groupBy("image", "frame").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


def baseline_spread(pixels: DataFrame) -> DataFrame:
    return boxes(pixels).groupBy("image").agg((F.max("y1") - F.min("y1")).alias("spread"))


def mean_color(pixels: DataFrame, skip: Column) -> DataFrame:
    """Mean colour of opaque pixels, without those of a rim (condition ``skip``)."""
    return pixels.filter((F.col("a") >= 16) & ~skip).groupBy("image").agg(F.avg("r").alias("r"), F.avg("g").alias("g"), F.avg("b").alias("b"))


def block_size(pixels: DataFrame) -> DataFrame:
    """The largest factor by which an image looks enlarged: all its blocks of that size have one colour. Images of under
    four colours count as drawn at their size."""
    size = pixels.groupBy("image").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"), F.count_distinct(F.when(F.col("a") >= 16, F.struct("r", "g", "b"))).alias("distinct"))
    tries = pixels.join(size, "image").filter("distinct >= 4").withColumn("n", F.explode(F.array(*map(F.lit, SCALES)))).filter("w % n = 0 and h % n = 0")
    code = F.col("r").cast("long") * 16777216 + F.col("g") * 65536 + F.col("b") * 256 + F.col("a")
    blocks = tries.groupBy("image", "n", F.floor(F.col("x") / F.col("n")).alias("bx"), F.floor(F.col("y") / F.col("n")).alias("by")).agg((F.min(code) == F.max(code)).alias("flat"))
    flat = blocks.groupBy("image", "n").agg(F.bool_and("flat").alias("flat")).filter("flat").groupBy("image").agg(F.max("n").alias("block"))
    return size.join(flat, "image", "left").select("image", F.coalesce("block", F.lit(1)).alias("block"))


#: Matrices of the Oklab colour space.
TO_LMS = [[0.4122214708, 0.5363325363, 0.0514459929], [0.2119034982, 0.6806995451, 0.1073969566], [0.0883024619, 0.2817188376, 0.6299787005]]
TO_LAB = [[0.2104542553, 0.7936177850, -0.0040720468], [1.9779984951, -2.4285922050, 0.4505937099], [0.0259040371, 0.7827717662, -0.8086757660]]


def oklab(r: Column, g: Column, b: Column) -> list[Column]:
    lin = [F.when(c / 255.0 <= 0.04045, c / 255.0 / 12.92).otherwise(F.pow((c / 255.0 + 0.055) / 1.055, F.lit(2.4))) for c in (r, g, b)]
    lms = [F.cbrt(sum(k * c for k, c in zip(row, lin, strict=True))) for row in TO_LMS]
    return [sum(k * c for k, c in zip(row, lms, strict=True)) for row in TO_LAB]


def with_oklab(rows: DataFrame) -> DataFrame:
    names = ("ok_l", "ok_a", "ok_b")
    return rows.withColumns(dict(zip(names, oklab(F.col("r"), F.col("g"), F.col("b")), strict=True)))


def nearest_colors(colors: DataFrame, palette: DataFrame) -> DataFrame:
    """Each distinct colour's nearest palette colour (idx, r, g, b) in Oklab; ties to the smaller idx. The palette has
    some tens of rows and travels as one array."""
    p = with_oklab(palette).agg(F.array_sort(F.collect_list(F.struct("idx", "ok_l", "ok_a", "ok_b"))).alias("p"))
    d = F.transform("p", lambda x: F.struct((F.pow(x["ok_l"] - F.col("ok_l"), F.lit(2.0)) + F.pow(x["ok_a"] - F.col("ok_a"), F.lit(2.0)) + F.pow(x["ok_b"] - F.col("ok_b"), F.lit(2.0))).alias("d"), x["idx"].alias("idx")))
    return with_oklab(colors.select("r", "g", "b").distinct()).crossJoin(F.broadcast(p)).select("r", "g", "b", F.array_min(d)["idx"].alias("idx"), F.sqrt(F.array_min(d)["d"]).alias("distance"))


def snap(pixels: DataFrame, palette: DataFrame, neutral: float = 0.05, adopt: float = 0.12, merge: float = 0.03, most: int = 16) -> DataFrame:
    """(image, r, g, b) → the colour it becomes. Greys stay; others take the palette's colour if that is near. The colours
    that come of it are ranked by their largest share of a frame; one within ``merge`` of larger ones joins the first of
    these. The ``most`` largest stay, and any other goes to the nearest of them. Colours of one image go to one task:
    they are distinct colours, not pixels."""
    hist = pixels.filter("a >= 16").groupBy("image", "frame", "r", "g", "b").agg(F.count(F.lit(1)).alias("n"))
    near = nearest_colors(hist, palette).join(F.broadcast(palette.select("idx", F.col("r").alias("pr"), F.col("g").alias("pg"), F.col("b").alias("pb"))), "idx")  # some tens of rows
    own = with_oklab(near)
    take = (F.hypot("ok_a", "ok_b") >= neutral) & (F.col("distance") <= adopt)
    to = own.select("r", "g", "b", *[F.when(take, F.col(f"p{c}")).otherwise(F.col(c)).cast("int").alias(f"n{c}") for c in "rgb"])
    mapped = hist.join(to, ["r", "g", "b"])
    total = hist.groupBy("image", "frame").agg(F.sum("n").alias("all"))
    share = mapped.groupBy("image", "frame", "nr", "ng", "nb").agg(F.sum("n").alias("n")).join(total, ["image", "frame"]).groupBy("image", "nr", "ng", "nb").agg(F.max(F.col("n") / F.col("all")).alias("share"))
    share = share.withColumns(dict(zip(("ok_l", "ok_a", "ok_b"), oklab(F.col("nr"), F.col("ng"), F.col("nb")), strict=True)))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["share", "nr", "ng", "nb"], ascending=[False, True, True, True], ignore_index=True)
        lab = pdf[["ok_l", "ok_a", "ok_b"]].to_numpy()
        kept, joins = [], []
        for i in range(len(pdf)):
            close = np.flatnonzero(np.linalg.norm(lab[kept] - lab[i], axis=1) <= merge) if kept else []
            joins.append(kept[close[0]] if len(close) else i)
            if not len(close):
                kept.append(i)
        stay = kept[:most]
        end = [j if j in stay else stay[int(np.linalg.norm(lab[stay] - lab[i], axis=1).argmin())] for i, j in enumerate(joins)]
        out = pdf[["image", "nr", "ng", "nb"]].copy()
        for c in "rgb":
            out[f"to_{c}"] = pdf[f"n{c}"].to_numpy()[end]
        return out

    ends = share.groupBy("image").applyInPandas(fold, f"image {dict(pixels.dtypes)['image']}, nr int, ng int, nb int, to_r int, to_g int, to_b int")
    return mapped.select("image", "r", "g", "b", "nr", "ng", "nb").distinct().join(ends, ["image", "nr", "ng", "nb"]).select("image", "r", "g", "b", "to_r", "to_g", "to_b")


def hsl(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """Hue (degrees), saturation and lightness."""
    r, g, b = r / 255.0, g / 255.0, b / 255.0
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d, light = top - low, (top + low) / 2
    hue = F.when(d == 0, 0.0).when(top == r, F.pmod((g - b) / d, F.lit(6.0))).when(top == g, (b - r) / d + 2).otherwise((r - g) / d + 4) * 60
    return {"h": hue, "s": F.when(d == 0, 0.0).otherwise(d / (1 - F.abs(2 * light - 1))), "l": light}


def rgb(h: Column, s: Column, light: Column) -> dict[str, Column]:
    def part(n: int) -> Column:
        k = F.pmod(F.lit(float(n)) + h / 30, F.lit(12.0))
        v = light - s * F.least(light, 1 - light) * F.greatest(F.lit(-1.0), F.least(k - 3, 9 - k, F.lit(1.0)))
        return F.floor(v * 255 + 0.5).cast("int")

    return {"r": part(0), "g": part(8), "b": part(4)}


def retint(pixels: DataFrame, lo: float, hi: float, hue: float, most_saturation: float, skin: Column) -> DataFrame:
    """Pixels with a hue in a window take another hue and at most a saturation; skin stays."""
    t = pixels.withColumns(hsl(F.col("r"), F.col("g"), F.col("b")))
    hit = F.col("h").between(lo, hi) & ~skin & (F.col("a") >= 16)
    new = rgb(F.lit(float(hue)), F.least(F.col("s"), F.lit(most_saturation)), F.col("l"))
    return t.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in pixels.columns])


def corner_code(nw: Column, ne: Column, sw: Column, se: Column) -> Column:
    """Four corners' terrain bits as one number."""
    bit = lambda c, k: F.shiftleft(c.cast("int"), k)
    return bit(nw, 3).bitwiseOR(bit(ne, 2)).bitwiseOR(bit(sw, 1)).bitwiseOR(bit(se, 0))


def missing_codes(codes: DataFrame) -> DataFrame:
    return codes.groupBy("sheet").agg(F.array_sort(F.array_except(F.sequence(F.lit(0), F.lit(15)), F.collect_set("code"))).alias("missing"))


def missing_directions(frames: DataFrame) -> DataFrame:
    every = F.array(*map(F.lit, ["down", "left", "right", "up"]))
    return frames.groupBy("image").agg(F.array_except(every, F.collect_set("direction")).alias("missing"))


def _extremes(hist: DataFrame) -> DataFrame:
    """The colours of each image that can be an end of its longest distance. Distance is convex, so a colour between two
    others on a line along an axis is none; nor is one whose farthest corner of the image's box is nearer than some two
    colours are known to be apart."""
    t = hist.select("image", "r", "g", "b")
    for axis in "rgb":
        line = Window.partitionBy("image", *[c for c in "rgb" if c != axis])  # at most 256 colours
        t = t.withColumns({"lo": F.min(axis).over(line), "hi": F.max(axis).over(line)}).filter((F.col(axis) == F.col("lo")) | (F.col(axis) == F.col("hi"))).drop("lo", "hi")
    t = keep(t)
    looks = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if (x, y, z) > (0, 0, 0)]
    far = lambda a, b: sum((a[c] - b[c]) * (a[c] - b[c]) for c in "rgb")
    ends = []
    for x, y, z in looks:
        along = x * F.col("r") + y * F.col("g") + z * F.col("b")
        ends.append(far(F.max_by(F.struct("r", "g", "b"), along), F.min_by(F.struct("r", "g", "b"), along)))
    box = t.groupBy("image").agg(F.greatest(*ends).alias("apart"), *[f(c).alias(f"{n}{c}") for c in "rgb" for n, f in (("lo", F.min), ("hi", F.max))])
    corner = sum(F.pow(F.greatest(F.col(c) - F.col(f"lo{c}"), F.col(f"hi{c}") - F.col(c)), F.lit(2)) for c in "rgb")
    return t.join(box, "image").filter(corner >= F.col("apart")).select("image", "r", "g", "b")


def farthest(colors: pd.DataFrame) -> tuple[list[int], list[int]]:
    """The two colours farthest apart, the first such pair in order of (r, g, b)."""
    x = colors.sort_values(["r", "g", "b"])[["r", "g", "b"]].to_numpy(np.int64)
    best, pair = -1, (0, 0)
    for at in range(0, len(x), 256):  # rows of the table of distances at a time
        d = ((x[at : at + 256, None] - x[None]) ** 2).sum(-1)
        if d.max() > best:
            best, (i, j) = d.max(), divmod(int(d.argmax()), len(x))
            pair = (at + i, j)
    return x[pair[0]].tolist(), x[pair[1]].tolist()


def two_tone(pixels: DataFrame, rounds: int = 12) -> DataFrame:
    """Which of two centres each colour of an image belongs to (image, r, g, b, n, centre): k-means over the colours by
    their pixels, from the two farthest apart. A round is one aggregation that leaves two rows for each image; only the
    few colours at an image's edge meet in a task, for the first pair."""
    hist = keep(pixels.filter("a >= 16").groupBy("image", *[F.col(c).cast("int").alias(c) for c in "rgb"]).agg(F.count(F.lit(1)).alias("n")))
    kind = dict(pixels.dtypes)["image"]

    def seeds(pdf: pd.DataFrame) -> pd.DataFrame:
        pair = farthest(pdf)
        return pd.DataFrame({"image": [pdf["image"].iloc[0]] * 2, "centre": [0, 1], **{c: [float(p[k]) for p in pair] for k, c in enumerate("rgb")}})

    def owned(centres: DataFrame) -> DataFrame:
        two = centres.groupBy("image").agg(*[F.max(F.when(F.col("centre") == k, F.struct("r", "g", "b"))).alias(f"c{k}") for k in (0, 1)])
        d = lambda k: sum(F.pow(F.col(c) - F.col(f"c{k}.{c}"), F.lit(2)) for c in "rgb")
        return hist.join(two, "image").withColumn("centre", F.when(d(1) < d(0), 1).otherwise(0)).select("image", "r", "g", "b", "n", "centre")

    centres = keep(_extremes(hist).groupBy("image").applyInPandas(seeds, f"image {kind}, centre int, r double, g double, b double"))
    for k in range(rounds):
        last = owned(centres)
        if k < rounds - 1:
            moved = last.groupBy("image", "centre").agg(*[(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(f"new{c}") for c in "rgb"])
            centres = keep(centres.join(moved, ["image", "centre"], "left").select("image", "centre", *[F.coalesce(f"new{c}", c).alias(c) for c in "rgb"]))
    return last


def face_marks(pixels: DataFrame, eye: Column, mouth: Column) -> DataFrame:
    """Centroid of the eyes, the row with most of the mouth, and the most frequent skin colour."""
    eyes = pixels.filter(eye).groupBy("image").agg(F.avg("x").alias("eye_x"), F.avg("y").alias("eye_y"))
    row = pixels.filter(mouth).groupBy("image", "y").agg(F.count(F.lit(1)).alias("n")).groupBy("image").agg(F.max_by("y", F.struct("n", (-F.col("y")).alias("o"))).alias("mouth_y"))
    skin = pixels.filter((F.col("a") >= 16) & ~eye & ~mouth).groupBy("image", "r", "g", "b").agg(F.count(F.lit(1)).alias("n")).groupBy("image").agg(F.max_by(F.struct("r", "g", "b"), F.struct("n", "r", "g", "b")).alias("skin"))
    return eyes.join(row, "image", "full").join(skin, "image", "full")


def expression(pixels: DataFrame, marks: DataFrame, slope: float, curve: float, half: int = 4) -> DataFrame:
    """Redraws brows (a slope above the eyes) and mouth (a curve on its row) in black on pixel rows."""
    t = pixels.join(marks.select("image", "eye_x", "eye_y", "mouth_y"), "image", "left")
    dx = F.col("x") - F.floor(F.col("eye_x") + 0.5)
    brow = (F.abs(dx) <= half) & (F.abs(dx) >= 1) & (F.col("y") == F.floor(F.col("eye_y") - 2 + slope * F.abs(dx) + 0.5))
    mouth = (F.abs(dx) <= half) & (F.col("y") == F.floor(F.col("mouth_y") + curve * (1 - dx * dx / float(half * half)) + 0.5))
    ink = F.coalesce(brow | mouth, F.lit(False)) & (F.col("a") >= 16)
    return t.select(*[F.when(ink, F.lit(0)).otherwise(F.col(c)).alias(c) if c in "rgb" else F.col(c) for c in pixels.columns])


def cycle(frames: DataFrame, most: int = 4) -> DataFrame:
    """Evenly spaced frames of each animation, at most ``most``."""
    w = Window.partitionBy("image", "state")
    k, n = F.row_number().over(w.orderBy("frame")) - 1, F.count(F.lit(1)).over(w)
    t = frames.withColumns({"k": k, "n": n})
    return t.filter((F.col("n") <= most) | F.array_contains(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.floor(i * F.col("n") / most)), F.col("k").cast("long"))).drop("k", "n")


def state_order(state: Column) -> Column:
    return F.when(state == "idle", 0).when(state == "walk", 1).otherwise(2)


def canvas(spark, width: int, height: int) -> DataFrame:
    """All (x, y) of a canvas."""
    return spark.range(width * height).select((F.col("id") % width).cast("int").alias("x"), F.floor(F.col("id") / width).cast("int").alias("y"))


def shapes(cells: DataFrame, cx: float, cy: float, size: float) -> DataFrame:
    """Shapes by formula on a canvas: a disc (fireball), a ring (burst), an arc that tapers, a pool with a wavy rim, a
    hooded figure and a speech bubble, each a 0/1 column."""
    dx, dy = (F.col("x") - cx) / size, (F.col("y") - cy) / size
    d, angle = F.hypot(dx, dy), F.atan2(dy, dx)
    on = lambda c: c.cast("int")
    return cells.withColumns({
        "disc": on(d <= 1), "ring": on(d.between(0.7, 1.0)), "arc": on((angle.between(-2.5, -0.6)) & (F.abs(d - 1) <= 0.25 * F.sin((angle + 2.5) / 1.9 * 3.141592653589793))),
        "pool": on(d <= 0.85 + 0.12 * F.sin(angle * 5)), "hood": on(((dy < 0) & (d <= 0.6)) | ((dy >= 0) & (F.abs(dx) <= 0.35 + 0.4 * dy) & (dy <= 1))),
        "bubble": on(((F.abs(dx) <= 1) & (F.abs(dy) <= 0.6)) | ((dy > 0.6) & (dy <= 0.9) & (F.abs(dx + 0.5) <= (0.9 - dy)))),
    })


def png(pixels: pd.DataFrame, width: int, height: int) -> bytes:
    """A PNG file of pixel rows of one image."""
    import struct
    import zlib

    grid = np.zeros((height, width, 4), np.uint8)
    grid[pixels["y"].to_numpy(), pixels["x"].to_numpy()] = pixels[["r", "g", "b", "a"]].to_numpy()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + row.tobytes() for row in grid)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
