"""Data-quality findings: every check is a frame of check, severity (fault or notice), subject, detail."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAULT, NOTICE = "fault", "notice"


def finding(rows: DataFrame, check: str, subject: Column, detail: Column, severity: str = FAULT) -> DataFrame:
    return rows.select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail"))


def united(*findings: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, findings)


def failed(findings: DataFrame) -> bool:
    """Whether there is a fault; notices don't count."""
    return not findings.filter(F.col("severity") == FAULT).isEmpty()


def summary(findings: DataFrame) -> DataFrame:
    """Findings counted: faults and notices of each check, and of all (check null), and whether they stop a build. One row
    for all is there even without findings."""
    counts = [F.count_if(F.col("severity") == s).alias(f"{s}s") for s in (FAULT, NOTICE)]
    each = findings.groupBy("check").agg(*counts)
    return each.unionByName(findings.agg(F.lit(None).cast("string").alias("check"), *counts)).withColumn("failed", F.col("faults") > 0)


def unknown(rows: DataFrame, col: str, known: DataFrame, known_col: str, check: str, subject: str) -> DataFrame:
    """References to what is not there."""
    lost = rows.filter(F.col(col).isNotNull()).join(known.select(F.col(known_col).alias(col)).distinct(), col, "left_anti")
    return finding(lost, check, F.col(subject), F.col(col))


def duplicates(rows: DataFrame, col: str, check: str) -> DataFrame:
    n = rows.groupBy(col).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return finding(n, check, F.col(col), F.col("n"))


def census(items: DataFrame, slots: list[str], icons: DataFrame) -> DataFrame:
    """Items (id, category, slot): each id once, known categories, a slot for equipment and for nothing else, an icon."""
    c = items.withColumn("category", F.coalesce("category", F.lit("objet")))
    return united(
        duplicates(c, "id", "item twice"),
        finding(c.filter(~F.col("category").isin("objet", "equipement")), "unknown category", F.col("id"), F.col("category")),
        finding(c.filter((F.col("category") == "equipement") & ~F.coalesce(F.col("slot").isin(slots), F.lit(False))), "equipment without slot", F.col("id"), F.col("slot")),
        finding(c.filter((F.col("category") == "objet") & F.col("slot").isNotNull()), "object with slot", F.col("id"), F.col("slot")),
        unknown(c.withColumn("icon", F.col("id")), "icon", icons, "icon", "no icon", "id"),
    )


def rooms(rooms: DataFrame, doors: DataFrame) -> DataFrame:
    """Rooms (id, width, height) and doors (room, x, y, dst, ax, ay, locked, reason)."""
    d = doors.join(rooms.withColumnsRenamed({"id": "room", "width": "w", "height": "h"}), "room")
    inside = F.col("x").between(0, F.col("w") - 1) & F.col("y").between(0, F.col("h") - 1)
    edge = (F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == F.col("w") - 1) | (F.col("y") == F.col("h") - 1)
    target = d.join(rooms.withColumnsRenamed({"id": "dst", "width": "dw", "height": "dh"}), "dst")
    arrives = F.col("ax").between(0, F.col("dw") - 1) & F.col("ay").between(0, F.col("dh") - 1)
    other = doors.select(F.col("room").alias("dst"), F.col("x").alias("ax"), F.col("y").alias("ay")).distinct()
    back = doors.select(F.col("room").alias("dst"), F.col("dst").alias("room")).distinct()
    return united(
        finding(d.filter(~inside), "door outside", F.col("room"), F.concat_ws(",", "x", "y")),
        finding(d.filter(inside & ~edge), "door off the edge", F.col("room"), F.concat_ws(",", "x", "y")),
        unknown(doors, "dst", rooms, "id", "door to nowhere", "room"),
        finding(target.filter(~arrives), "arrival outside", F.col("room"), F.col("dst")),
        finding(target.join(other, ["dst", "ax", "ay"], "left_semi"), "arrival on a door", F.col("room"), F.col("dst")),
        finding(doors.join(back, ["room", "dst"], "left_anti").join(rooms.select(F.col("id").alias("dst")), "dst", "left_semi"), "no way back", F.col("room"), F.col("dst")),
        finding(doors.filter(F.col("locked") & F.coalesce(F.trim("reason") == "", F.lit(True))), "locked without reason", F.col("room"), F.col("dst")),
    )


def scenes(steps: DataFrame, roster: DataFrame, waves: DataFrame) -> DataFrame:
    """Steps (scene, step, last, speaker, required, wave, condition) against who is there (scene, step, who)."""
    said = steps.filter(F.col("speaker").isNotNull()).join(roster.select("scene", "step", F.col("who").alias("speaker")), ["scene", "step", "speaker"], "left_anti")
    w = steps.filter(F.col("wave").isNotNull()).join(waves.select("scene", "wave"), ["scene", "wave"], "left_anti")
    return united(
        finding(said.filter("required"), "required speaker absent", F.col("scene"), F.col("speaker")),
        finding(said.filter("not required"), "speaker absent", F.col("scene"), F.col("speaker"), NOTICE),
        finding(w, "unknown wave", F.col("scene"), F.col("wave")),
        finding(steps.filter(F.col("condition").isNull()), "step without condition", F.col("scene"), F.col("step")),
    )


def sounds(peaks: DataFrame) -> DataFrame:
    """Sounds (sound, peak, last, seam, loops): silence, a cut end, an audible seam."""
    return united(
        finding(peaks.filter("peak < 0.05"), "silent", F.col("sound"), F.col("peak")),
        finding(peaks.filter("not loops and abs(last) > 0.02"), "cut end", F.col("sound"), F.col("last")),
        finding(peaks.filter("loops and seam > 0.01"), "loop seam", F.col("sound"), F.col("seam")),
    )


def images(stats: DataFrame, most_colors: int = 16) -> DataFrame:
    """Images (image, opaque, transparent, colors, rare, soft, block)."""
    return united(
        finding(stats.filter("opaque = 0"), "empty", F.col("image"), F.lit("")),
        finding(stats.filter("block > 1"), "upscaled", F.col("image"), F.col("block")),
        finding(stats.filter(F.col("colors") > most_colors), "too many colours", F.col("image"), F.col("colors")),
        finding(stats.filter("rare > 0"), "residual tints", F.col("image"), F.col("rare"), NOTICE),
        finding(stats.filter("soft > 0"), "soft edges", F.col("image"), F.col("soft")),
        finding(stats.filter("transparent = 0"), "no transparency", F.col("image"), F.lit(""), NOTICE),
    )


def installation(chunks: DataFrame, vectors: DataFrame, cards: DataFrame) -> DataFrame:
    """Presence and agreement of the indexes."""
    n = chunks.agg(F.count(F.lit(1)).alias("chunks")).crossJoin(vectors.agg(F.count(F.lit(1)).alias("vectors"))).crossJoin(cards.agg(F.count(F.lit(1)).alias("cards")))  # one row each
    return united(
        finding(n.filter("chunks = 0"), "no chunks", F.lit("chunks"), F.col("chunks")),
        finding(n.filter("vectors <> chunks"), "vectors out of step", F.lit("vectors"), F.concat_ws("/", "vectors", "chunks"), NOTICE),
        finding(n.filter("cards = 0"), "no cards", F.lit("cards"), F.col("cards"), NOTICE),
    )
