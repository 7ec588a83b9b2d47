"""Chat formatting with cumulative-snapshot collapse.

Logged conversations are often snapshots of one another: each log holds all turns so far.  A rolling hash of every
turn prefix makes that visible: a conversation whose whole hash is a proper prefix hash of another one is a snapshot
of it.  Anti-joins keep the maximal conversations; of equal ones the smallest id stays.  What stays is rendered.

The rolling hash of a prefix is the sum of hashes of (position, role, text), so it is computed by running sums in two
levels: a conversation is cut into blocks of turns, and no task needs a whole one.  DataFrame expressions throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Turn numbers per block, and so turns of a rendered part (unless numbers repeat).
BLOCK = 256
_HASHES = ("h1", "h2", "h3")
BEGIN, AFTER_ROLE, END = "<|", "|>\n", "<|end|>\n"


def turn_prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, block, position, role, text, h1, h2, h3, n): turns in order with the rolling hash up to each."""
    t = turns.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-1)).cast("long"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = t.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("size"))
    sizes = sizes.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0))).withColumn("n", F.sum("size").over(Window.partitionBy("conv_id")))
    inside = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    t = t.withColumn("rank", F.row_number().over(inside)).join(sizes.drop("size"), ["conv_id", "block"])
    t = t.withColumn("position", F.col("offset") + F.col("rank"))
    # 42 bits of each hash: their sums over a conversation of two million turns fit 63 bits
    marks = [F.shiftrightunsigned(F.xxhash64(F.lit(i), "position", "role", "text"), 22).alias(h) for i, h in enumerate(_HASHES)]
    t = cut(t.select("conv_id", "block", "position", "role", "text", "n", *marks))
    sums = t.groupBy("conv_id", "block").agg(*[F.sum(h).alias(f"{h}_block") for h in _HASHES])
    sums = sums.select("conv_id", "block", *[F.coalesce(F.sum(f"{h}_block").over(before), F.lit(0)).alias(f"{h}_before") for h in _HASHES])
    running = Window.partitionBy("conv_id", "block").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    for h in _HASHES:
        t = t.withColumn(h, F.sum(h).over(running))
    t = t.join(sums, ["conv_id", "block"])
    return t.select("conv_id", "block", "position", "role", "text", "n", *[(F.col(h) + F.col(f"{h}_before")).alias(h) for h in _HASHES])


def maximal_conversations(prefixes: DataFrame) -> DataFrame:
    """Ids of conversations that are no proper prefix of another one; of equal ones the smallest."""
    whole = prefixes.where("position = n").groupBy("n", *_HASHES).agg(F.min("conv_id").alias("conv_id"))
    longer = prefixes.where("position < n").select(F.col("position").alias("n"), *_HASHES).distinct()
    return whole.join(longer, ["n", *_HASHES], "left_anti").select("conv_id")


def format_conversations(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv_id, part, first_position, n_turns, rendered) of the conversations that stay.

    A conversation is rendered in parts of a block of turns each; its text is that of its parts, in order.  Turns are
    ordered by number (null first, then role and text, so ties and repeated rows have one order).  Null role or text
    counts as empty; rows of a null conv_id belong to no conversation and are left out.  An empty table gives no rows.
    Other columns are not read.
    """
    turns = conversations.select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).where("conv_id is not null")
    prefixes = cut(turn_prefixes(turns))
    kept = maximal_conversations(prefixes)
    blocks = prefixes.select("conv_id", "block").distinct().join(kept, "conv_id")  # a long conversation stays spread over its blocks
    said = F.concat(F.lit(BEGIN), F.col("role"), F.lit(AFTER_ROLE), F.col("text"), F.lit("\n" + END))
    parts = prefixes.join(blocks, ["conv_id", "block"]).select("conv_id", "block", "position", said.alias("said"))
    parts = parts.groupBy("conv_id", "block").agg(
        F.min("position").alias("first_position"), F.count(F.lit(1)).alias("n_turns"), F.sort_array(F.collect_list(F.struct("position", "said"))).alias("turns")
    )
    return parts.select("conv_id", F.col("block").alias("part"), "first_position", "n_turns", F.array_join(F.col("turns.said"), "").alias("rendered"))
