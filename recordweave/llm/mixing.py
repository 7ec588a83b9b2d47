"""Mixing sources to target weights by weighted fair queueing.

Each document (and each repeat of it, for sources that are taken more than once) gets a virtual finish time:
the words of its source up to and with it, in shuffled order, divided by the source's share of the budget.
A global range sort by finish time, cut at the budget, then takes every source in proportion to its target.

All of it is DataFrame expressions.  Running sums are two-level: sums of hash ranges first (one small row per
source and range), then a window inside each (source, range); no task holds a whole source, however hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, unused, word_count

#: Weights of the sources in code-point order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: No source (and so no document) is taken more often than this.
MAX_REPEATS = 3
#: Hash ranges per source, and ranges of virtual time, for the two-level running sums: as many as give ranges of this many
#: rows, within these bounds.
RANGE_ROWS, LEAST_RANGES, MOST_RANGES = 1 << 16, 1024, 1 << 20


def _order_key(doc_id: str):
    """A pseudo-random 60-bit number of the id: the shuffled order, the same in every run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, weight, target) of ``sized`` (source, size).

    The total of all sizes is shared by weight.  A source's target stops at ``repeats`` times its size; what exceeds
    it is shared again among the others.  That fixed point is target = min(cap, level x weight) with one level for
    all, and the level follows from the sources in the order of cap / weight: one row per source, no iteration.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1).cast("double")
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", w)
    s = s.withColumn("cap", F.col("source_size").cast("double") * repeats)
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after, every = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    s = s.withColumn("total", F.sum("source_size").over(every).cast("double"))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    s = s.withColumn("first", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("cap") / F.col("weight"))).over(every))
    s = s.withColumn("level", F.max(F.when(F.col("cap") / F.col("weight") == F.col("first"), F.col("level"))).over(every))
    return s.select("source", "source_size", "weight", F.least("cap", F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight")).alias("target"), F.col("total").alias("budget"))


def mix_sources(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    repeats: int = MAX_REPEATS,
) -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken) of ``docs``, a row for each of its rows.

    Null text has size 0; null sources form one source, last in order; a null id is an id of its own.  Rows of one id
    are documents of their own.  A document of size 0 has nothing to take (taken 0).  An empty table gives no rows.
    Other columns are not read.  Reruns agree: the order depends on ids alone, ties are between alike rows.
    """
    return _times(docs, doc_id, text, source, weights, repeats).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"))


def mixed_documents(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    repeats: int = MAX_REPEATS,
) -> DataFrame:
    """The rows of ``docs`` as often as ``mix_sources`` takes each of them, whatever their ids; all columns stay.

    Empty and null texts have nothing to take and go.  Extra columns may have any name; an empty table stays empty.
    """
    row, place, times_name, copy = unused(docs, "__row", "__place", "__times", "__copy")
    rows = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    times = _times(rows, doc_id, text, source, weights, repeats, F.col(row)).where("times > 0").select(F.col("row").alias(place), F.col("times").alias(times_name))
    taken = rows.join(times, F.col(row) == F.col(place))
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.greatest(times_name, F.lit(1))))).select(*docs.columns)


def _times(docs: DataFrame, doc_id: str, text: str, source: str, weights: tuple[int, ...], repeats: int, row: Column | None = None) -> DataFrame:
    """(row, doc_id, size, source_size, target, times) of each row of ``docs``; ``row`` is null if none is given."""
    row = F.lit(None).cast("long") if row is None else row
    sized = cut(docs.select(row.alias("row"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), _order_key(doc_id).alias("h")))
    ranges_of = min(MOST_RANGES, max(LEAST_RANGES, sized.count() // RANGE_ROWS))
    targets = cut(source_targets(sized, weights, repeats).withColumn("share", F.coalesce(F.try_divide("target", "budget"), F.lit(0.0))))
    sized = sized.withColumn("range", (F.col("h") / F.lit(float(1 << 60) / ranges_of)).cast("int"))

    # Running words of each source: sums of earlier ranges plus a window inside the range.
    ranges = sized.groupBy("source", "range").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("words_before"))
    inside = Window.partitionBy("source", "range").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = sized.withColumn("words", F.sum("size").over(inside))
    queued = queued.join(ranges, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r"))).withColumn("words", F.col("words") + F.col("words_before")).drop("s", "r", "words_before")
    queued = queued.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")

    # A repeat finishes a whole source later; only repeats that can finish within the budget are made.
    passes = F.when((F.col("size") > 0) & (F.col("share") > 0), F.least(F.lit(repeats), F.ceil(F.try_divide("target", "source_size")).cast("int"))).otherwise(0)
    queued = cut(queued.select("row", "doc_id", "source", "size", "h", "source_size", "target", "budget", "share", "words", passes.alias("passes")))
    copies = _copies(queued, ranges_of)

    # The global sort by finish time, in slots: sums place whole slots, only the slot that holds the cut is sorted.
    slots = copies.groupBy("slot").agg(F.sum("size").alias("slot_words"), F.first("budget").alias("budget"))
    upto = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    slots = slots.withColumn("slot_upto", F.sum("slot_words").over(upto)).where("slot_upto > budget")
    slot = slots.agg(F.min(F.struct("slot", (F.col("slot_upto") - F.col("slot_words")).alias("before"))).alias("cut")).select("cut.*")
    at_cut = copies.join(F.broadcast(slot), "slot").select("slot", "before", "budget", "size", "place")
    peers = Window.partitionBy("slot").orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = at_cut.withColumn("upto", F.col("before") + F.sum("size").over(peers)).where("upto <= budget").agg(F.max("place").alias("last_place"))
    one = slot.agg(F.min("slot").alias("cut_slot")).crossJoin(last)  # aggregates without keys: one row each

    # Each row then counts the repeats that stand at or before the cut.
    finished = F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda c: F.when((c < F.col("passes")) & _before_cut(c, ranges_of), 1).otherwise(0))
    taken = F.aggregate(finished, F.lit(0), lambda x, y: x + y)
    return queued.crossJoin(F.broadcast(one)).select("row", "doc_id", "size", "source_size", "target", taken.alias("times"))


def _finish(copy):
    return F.try_divide(F.col("words") + copy * F.col("source_size"), F.col("share"))


def _slot(copy, ranges_of: int):
    return F.least(F.floor(F.try_divide(_finish(copy), F.col("budget")) * ranges_of), F.lit(2 * ranges_of)).cast("int")


def _place(copy):
    """What the global sort compares; only rows that are alike share a place."""
    return F.struct(_finish(copy).alias("finish"), F.col("source").isNull().alias("none"), F.col("source").alias("source"), F.col("h").alias("h"), F.col("doc_id").alias("doc_id"), F.col("size").alias("size"), copy.alias("copy"))


def _before_cut(copy, ranges_of: int):
    slot = _slot(copy, ranges_of)
    return F.col("cut_slot").isNull() | (slot < F.col("cut_slot")) | ((slot == F.col("cut_slot")) & F.coalesce(_place(copy) <= F.col("last_place"), F.lit(False)))


def _copies(queued: DataFrame, ranges_of: int) -> DataFrame:
    copies = queued.where("passes > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
    return copies.select("size", "budget", _slot(F.col("copy"), ranges_of).alias("slot"), _place(F.col("copy")).alias("place"))
