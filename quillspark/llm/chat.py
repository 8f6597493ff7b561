"""Chat formatting: root-to-leaf paths of reply trees, ranked by score, each formatted as one conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import drop_scratch, materialize, only

#: Marks of a turn's start, of its text's start and of its end.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
SALTS = 32


def escape(col: Column) -> Column:
    """Doubles backslashes and sets one after each ``<`` and ``[``, so that no control string stays whole in a text."""
    out = F.replace(col, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("<\\")), F.lit("["), F.lit("[\\"))


def unescape(col: Column) -> Column:
    out = F.replace(F.replace(col, F.lit("[\\"), F.lit("[")), F.lit("<\\"), F.lit("<"))
    return F.replace(out, F.lit("\\\\"), F.lit("\\"))


def reply_paths(nodes: DataFrame, top: int = 1) -> DataFrame:
    """The ``top`` root-to-leaf paths of each tree by the sum of their nodes' scores, ties to the smaller leaf.

    ``nodes`` has tree, node, parent, score. Self-joins double the distance that a node looks up the tree, so a tree of
    depth d takes about log2(d) of them; the jumps of each step are kept, and the chosen leaves walk up by them, which
    lists each node of a path once. Paths never meet in one row, so a deep tree costs no more than its rows.

    A parent that is not in its tree counts as none. Nodes on or below a cycle are on no path. Nodes with a null id are
    left out; of rows that repeat a node, that with the smallest parent and score counts. Null scores are 0.
    Returns tree, leaf, path_rank (from 1), path_score, node and position (0 at the root).
    """
    own = nodes.filter("node is not null").groupBy("tree", "node").agg(F.min(F.struct("parent", F.coalesce("score", F.lit(0)).cast("double").alias("score"))).alias("x")).select("tree", "node", "x.parent", "x.score")
    own = materialize(own, "nodes")
    up = own.select(F.col("tree").alias("t"), F.col("node").alias("p"))
    step = own.join(up, own["tree"].eqNullSafe(up["t"]) & (own["parent"] == up["p"]), "left").select("tree", "node", F.col("p").alias("jump"), F.col("score").alias("total"), F.when(F.col("p").isNull(), 0).otherwise(1).cast("long").alias("depth"))
    step = materialize(step, "jump")
    jumps, ended, left = [materialize(step.filter("jump is not null"), "jump")], step.filter("jump is null"), -1
    while (now := jumps[-1].count()) not in (0, left):  # nodes that still look further up; the others rest
        left = now
        a, b = jumps[-1].alias("a"), jumps[-1].unionByName(ended).alias("b")
        joined = a.join(b, F.col("a.tree").eqNullSafe(F.col("b.tree")) & (F.col("a.jump") == F.col("b.node")), "left")
        further = materialize(joined.select("a.tree", "a.node", F.col("b.jump").alias("jump"), (F.col("a.total") + F.coalesce("b.total", F.lit(0.0))).alias("total"), (F.col("a.depth") + F.coalesce("b.depth", F.lit(0))).alias("depth")), "jump")
        jumps.append(materialize(further.filter("jump is not null"), "jump"))
        ended = ended.unionByName(further.filter("jump is null"))
    known = ended
    parents = own.filter("parent is not null").select(F.col("tree").alias("t"), F.col("parent").alias("p")).distinct()
    leaves = known.join(parents, known["tree"].eqNullSafe(parents["t"]) & (known["node"] == parents["p"]), "left_anti")
    better = [F.desc("total"), "node"]
    salted = Window.partitionBy("tree", "salt").orderBy(*better)
    few = leaves.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS))).withColumn("r", F.row_number().over(salted)).filter(F.col("r") <= top)
    chosen = few.withColumn("path_rank", F.row_number().over(Window.partitionBy("tree").orderBy(*better))).filter(F.col("path_rank") <= top)
    paths = materialize(chosen.select("tree", F.col("node").alias("leaf"), "path_rank", F.col("total").alias("path_score"), "node", F.col("depth").alias("position")), "paths")
    for k in range(len(jumps) - 1, -1, -1):
        j = jumps[k].select(F.col("tree").alias("t"), F.col("node").alias("n"), "jump")
        higher = paths.join(j, paths["tree"].eqNullSafe(j["t"]) & (paths["node"] == j["n"])).select("tree", "leaf", "path_rank", "path_score", F.col("jump").alias("node"), (F.col("position") - (1 << k)).alias("position"))
        paths = materialize(paths.unionByName(higher), "paths")
    drop_scratch(*jumps)
    return paths


def format_turns(turns: DataFrame, keys: list[str], position: str = "position") -> DataFrame:
    """One conversation for each key: its turns (role, text, both may be null: empty) in order of position, then role,
    then text. Returns the keys, formatted (string), n_turns and loss (array of start and end, in characters of
    formatted): where the escaped texts of the role ``assistant`` lie."""
    piece = F.concat(F.lit(TURN), escape(F.coalesce("role", F.lit(""))), F.lit(TEXT), escape(F.coalesce("text", F.lit(""))), F.lit(END))
    order = Window.partitionBy(*keys).orderBy(F.col(position).asc_nulls_first(), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    t = turns.withColumn("piece", piece).withColumn("k", F.row_number().over(order))
    t = t.withColumn("at", F.coalesce(F.sum(F.length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    end = F.col("at") + F.length("piece") - len(END)
    span = F.when(F.col("role") == "assistant", F.struct((end - F.length(escape(F.coalesce("text", F.lit(""))))).alias("start"), end.alias("end")))
    got = t.withColumn("span", span).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "piece"))).alias("pieces"), F.array_sort(F.collect_list("span")).alias("loss"))
    return got.select(*keys, F.array_join(F.col("pieces.piece"), "").alias("formatted"), F.size("pieces").cast("long").alias("n_turns"), "loss")


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    parts = F.filter(F.split(formatted, r"\Q" + TURN + r"\E"), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(
        unescape(F.substring_index(x, TEXT, 1)).alias("role"),
        unescape(F.substring_index(F.substring_index(x, TEXT, -1), END, 1)).alias("text"),
    ))


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def chat_format(nodes: DataFrame, top: int = 1) -> DataFrame:
    """Format the best paths of reply trees (tree, node, parent, score, role, text) as conversations; see the parts."""
    nodes = materialize(nodes, "turns")
    paths = reply_paths(nodes.select("tree", "node", "parent", "score"), top)
    said = nodes.groupBy(F.col("tree").alias("t"), F.col("node").alias("n")).agg(F.min(F.struct("parent", "role", "text")).alias("x")).select("t", "n", "x.role", "x.text")
    turns = paths.join(said, paths["tree"].eqNullSafe(said["t"]) & (paths["node"] == said["n"])).select("tree", "leaf", "path_rank", "path_score", "position", "role", "text")
    return format_turns(turns, ["tree", "leaf", "path_rank", "path_score"])


def linear_trees(turns: DataFrame, tree: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations as reply trees of one path: each row answers the row before it (by turn, nulls first, role, text)."""
    rows = only(turns, tree=tree, turn=turn, role=role, text=text).withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    before = Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("node", F.row_number().over(before).cast("long"))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one made of control strings, formatted and read back; null texts count as empty."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    turns = turns.unionByName(spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], turns.schema))
    out = chat_format(linear_trees(turns))
    back = out.select(F.col("tree").alias("conv_id"), "formatted", read_back(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss")).alias("lost"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("lost").cast("long").alias("loss_chars"), F.sha2(F.col("lost"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


_ESC = r"replace(replace(replace({0}, '\', '\\'), '<', '<\'), '[', '[\')"
OP9_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), g AS (
  SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS told,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS lost,
         sum({len(TURN + TEXT + END)} + length({_ESC.format("role")}) + length({_ESC.format("text")})) AS chars
  FROM t GROUP BY conv_id
)
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, sha256(told) AS turns_sha256, CAST(length(lost) AS BIGINT) AS loss_chars,
       sha256(lost) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars
FROM g
"""
