"""Lines of a large bucket meet once: in the larger of their two length classes."""

from pyspark.sql import functions as F

from quillspark.llm import line_dedup


def test_lines_meet_once(spark):
    sizes = [*range(24, 140), *range(900, 1010)]
    own = line_dedup._size_class("size", 90)
    rows = spark.createDataFrame(list(enumerate(sizes)), "id long, size int").withColumn("class", F.explode(F.array(own, own + 1)))
    other = rows.select("class", F.col("class").alias("o_class"), F.col("id").alias("o_id"), F.col("size").alias("o_size"))
    met = rows.join(other, "class").filter("id < o_id").filter(line_dedup._here("", "o_", 90))
    got = [(r[0], r[1]) for r in met.select("id", "o_id").collect()]
    assert len(got) == len(set(got))
    want = {(a, b) for a, x in enumerate(sizes) for b, y in enumerate(sizes) if a < b and abs(x - y) <= max(x, y) * 10 // 100}
    assert want <= set(got)
