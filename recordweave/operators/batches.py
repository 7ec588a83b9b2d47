"""Greedy batches of ordered events, without going through the events one after another.

A batch closes with the event that reaches a limit, so where a batch begins tells where the next one begins: each event
points to the first event of the next batch, were a batch to begin with it.  Prefix sums give these pointers.  Which
events do begin batches follows by doubling pointers, first inside cells of consecutive events, then from cell to cell:
a cell is entered within its first events (no batch is longer than the limit), so few rows go into the second part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialised
from .blocks import ROWS, block, bounds, running, same

#: Least events of a cell: a row of arrays in memory.
CELL = 1 << 15


def _pointers(events: DataFrame, most_bytes: int, most_events: int, begins: list[float], cell: int) -> DataFrame:
    """(by, cell, at, to, n, bytes, first_seq, last_seq): events by place in their cell, and the batch that would begin with each.

    ``events`` (by, seq, size).  to: place of the next batch's first event, counted from the same cell; null where the
    events of ``by`` end with this batch.
    """
    sums = running(events, ("by",), "seq", {"__n": F.lit(1), "__upto": F.col("size")}, begins)
    rows = sums.select("by", "seq", (F.col("__n") - 1).alias("n"), (F.col("__upto") - F.col("size")).alias("before"), F.col("__upto").alias("upto"))
    # A cell also sees the first events of the next one: a batch that begins in it ends there at the latest.
    home = F.floor(F.col("n") / cell)
    cells = F.when((F.col("n") % cell <= most_events) & (home > 0), F.array(home, home - 1)).otherwise(F.array(home))
    seen = rows.select("*", F.explode(cells).alias("cell")).withColumn("at", (F.col("n") - F.col("cell") * cell).cast("int"))
    of_cell = Window.partitionBy("by", "cell")
    order = of_cell.orderBy("n")
    seen = seen.withColumn("here", F.struct("n", "before", F.lag("seq").over(order).alias("end")))
    full = F.lead("here", most_events).over(order)
    # The first event that at least so many bytes lie before, by a frame that grows from the end.
    heavy = F.min("here").over(of_cell.orderBy(F.desc("before")).rangeBetween(Window.unboundedPreceding, -most_bytes))
    # Where neither is reached the events end inside what the cell sees.
    last = F.max(F.struct("n", "upto", "seq")).over(of_cell)
    seen = seen.withColumns({"full": full, "heavy": heavy, "last": last}).where(F.col("at") < cell).withColumn("next", F.least("heavy", "full"))
    return seen.select(
        "by", "cell", "at", (F.col("next.n") - F.col("cell") * cell).cast("int").alias("to"), (F.coalesce(F.col("next.n"), F.col("last.n") + 1) - F.col("n")).alias("n"),
        (F.coalesce("next.before", "last.upto") - F.col("before")).alias("bytes"), F.col("seq").alias("first_seq"), F.coalesce("next.end", "last.seq").alias("last_seq"),
    )


def _onward(p: Column, pointers: Column) -> Column:
    """Where a pointer leads; places beyond the cell stay."""
    return F.when(p < F.size(pointers), F.get(pointers, p)).otherwise(p)


def _exits(pointers: Column, cell: int, entries: int) -> Column:
    """First place beyond the cell for each of the first entries, after doubling the pointers."""
    rounds = F.sequence(F.lit(0), F.lit(math.ceil(math.log2(cell))))
    return F.aggregate(rounds, pointers, lambda acc, _: F.transform(acc, lambda p: _onward(p, acc)), lambda acc: F.slice(acc, 1, entries))


def _heads(entry: Column, pointers: Column, cell: int) -> Column:
    """Places inside the cell that batches begin at, from ``entry`` on: each round doubles heads and pointers."""
    start = F.struct(F.array(entry).alias("heads"), pointers.alias("pointers"))

    def double(s: Column, _: Column) -> Column:
        new = F.filter(F.transform(s["heads"], lambda p: _onward(p, s["pointers"])), lambda p: p < F.size(s["pointers"]))
        return F.struct(F.concat(s["heads"], new).alias("heads"), F.transform(s["pointers"], lambda p: _onward(p, s["pointers"])).alias("pointers"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(math.ceil(math.log2(cell)))), start, double, lambda s: F.array_sort(s["heads"]))


def _entries(heads: DataFrame, links: DataFrame) -> DataFrame:
    """``heads`` (by, cell, at) and all that ``links`` (by, cell, at, to_cell, to_at) lead to from them, doubling links."""
    links = materialised(links)
    while links.limit(1).count():
        ahead = links.select(F.col("by").alias("b"), F.col("cell").alias("c"), F.col("at").alias("a"), F.col("to_cell").alias("tc"), F.col("to_at").alias("ta"))
        reached = heads.join(ahead, same(["by", "cell", "at"], ["b", "c", "a"])).select("by", F.col("tc").alias("cell"), F.col("ta").alias("at"))
        further = links.join(ahead, same(["by", "to_cell", "to_at"], ["b", "c", "a"])).select("by", "cell", "at", F.col("tc").alias("to_cell"), F.col("ta").alias("to_at"))
        heads, links = materialised(heads.unionByName(reached)), materialised(further)
    return heads


def batches_by_bytes(
    events: DataFrame, most_bytes: int, most_events: int, by: str, order: str = "seq", raw: str = "raw", interval_seconds: float = 0.0, ts: str = "ts", rows_per_block: int = ROWS, cell: int = CELL
) -> DataFrame:
    """Rows (by, batch, n, bytes, first_seq, last_seq): a batch closes with the event that reaches either limit.

    Each value of ``by`` (an output, a partition) is batched on its own, in the order of a whole number without ties.  With
    an interval, what is open is also flushed at each tick of a clock that runs in the events' time: a tick is a multiple
    of the interval, and events of different ticks are in different batches.  Null texts have no bytes.
    """
    if most_bytes < 1 or most_events < 1:
        raise ValueError("limits are 1 or more")
    cell = max(cell, 1 << math.ceil(math.log2(most_events + 1)))
    tick = F.floor(F.col(ts).cast("double") / interval_seconds) if interval_seconds > 0 else F.lit(0).cast("long")
    slim = events.select(F.struct(F.col(by).alias("key"), tick.alias("tick")).alias("by"), F.col(order).cast("long").alias("seq"), F.coalesce(F.octet_length(raw), F.lit(0)).cast("long").alias("size"))
    pointed = _pointers(slim, most_bytes, most_events, bounds(events, order, rows_per_block), cell)
    cells = materialised(pointed.groupBy("by", "cell").agg(F.sort_array(F.collect_list(F.struct("at", "to", "n", "bytes", "first_seq", "last_seq"))).alias("e")))
    nowhere = F.lit(1 << 30)
    cells = cells.withColumn("to", F.transform("e", lambda x: F.coalesce(x["to"], nowhere)))

    exits = cells.select("by", "cell", F.posexplode(_exits(F.col("to"), cell, most_events)).alias("at", "leaves")).where(F.col("leaves") < nowhere)
    links = exits.select("by", "cell", "at", (F.col("cell") + 1).alias("to_cell"), (F.col("leaves") - cell).alias("to_at"))
    heads = _entries(cells.where("cell = 0").select("by", "cell", F.lit(0).alias("at")), links)
    heads = heads.select(F.col("by").alias("b"), F.col("cell").alias("c"), F.col("at").alias("a"))
    batches = cells.join(heads, same(["by", "cell"], ["b", "c"])).select("by", "cell", "e", _heads(F.col("a"), F.col("to"), cell).alias("heads"))
    batches = materialised(batches.select("by", "cell", F.size("heads").alias("k"), F.transform("heads", lambda p: F.get("e", p)).alias("e")))
    # Batches are numbered through a key: those of ticks and cells before come first.
    earlier = Window.partitionBy("by.key").orderBy("by.tick", "cell").rowsBetween(Window.unboundedPreceding, -1)
    numbers = batches.select(F.col("by").alias("b"), F.col("cell").alias("c"), F.coalesce(F.sum("k").over(earlier), F.lit(0)).alias("earlier"))
    out = batches.join(numbers, same(["by", "cell"], ["b", "c"])).select("by", "earlier", F.posexplode("e").alias("pos", "x"))
    return out.select(F.col("by.key").alias("by"), (F.col("earlier") + F.col("pos")).cast("long").alias("batch"), "x.n", "x.bytes", "x.first_seq", "x.last_seq")
