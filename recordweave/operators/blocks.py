"""Blocks of an order column: what follows rows in order can then span many tasks.

A scan in order (ranks, running sums, open records) is made in two levels.  Bounds of blocks are quantiles of the
order column, found in one pass over it; inside a block a window does the scan, and a row for each key and block tells
what the block hands on.  Blocks are a function of a row alone, so every evaluation of a plan finds the same ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block, and the most blocks there are (a row each in the second level of a key).
ROWS, MOST = 1 << 20, 4096


def bounds(rows: DataFrame, order: str, rows_per_block: int = ROWS) -> list[float]:
    """Values of the order column (a number or a time) that begin blocks of about so many rows; none for a small table."""
    blocks = min(MOST, -(-rows.count() // max(rows_per_block, 1)))
    if blocks < 2:
        return []
    steps = F.array(*[F.lit(i / MOST) for i in range(1, MOST)])
    found = rows.agg(F.percentile_approx(F.col(order).cast("double"), steps, F.lit(8 * MOST))).first()[0]
    if not found:
        return []
    return sorted({found[i * MOST // blocks - 1] for i in range(1, blocks)})


def block(order: Column, begins: list[float]) -> Column:
    """Number of the block that a value of the order column is in; null is in the first one."""
    x = order.cast("double")
    if len(begins) <= 16:
        return sum((F.when(x >= b, 1).otherwise(0) for b in begins), F.lit(0)).cast("int")
    table = F.split(F.lit(",".join(map(repr, begins))), ",").cast("array<double>")
    middle = lambda s: F.floor((s["low"] + s["high"]) / 2).cast("int")
    pair = lambda low, high: F.struct(low.alias("low"), high.alias("high"))

    def halve(s: Column, _: Column) -> Column:
        after = F.get(table, middle(s)) <= x
        return F.when(s["low"] >= s["high"], s).when(after, pair(middle(s) + 1, s["high"])).otherwise(pair(s["low"], middle(s)))

    rounds = F.sequence(F.lit(0), F.lit(math.ceil(math.log2(len(begins) + 1))))
    return F.aggregate(rounds, pair(F.lit(0), F.lit(len(begins))), halve, lambda s: s["low"])


def same(a: list[str], b: list[str]) -> Column:
    """Join condition: columns are pairwise equal, nulls among themselves."""
    out = F.lit(True)
    for x, y in zip(a, b, strict=True):
        out = out & F.col(x).eqNullSafe(F.col(y))
    return out


def running(rows: DataFrame, by: tuple[str, ...], order: str, sums: dict[str, Column], begins: list[float], prefix: str = "__") -> DataFrame:
    """``rows`` with running sums (the row included) of ``sums`` in order within each ``by``, in blocks."""
    number = f"{prefix}block"
    t = rows.withColumn(number, block(F.col(order), begins))
    inside = Window.partitionBy(*by, number).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    if not begins:
        return t.withColumns({name: F.sum(x).over(inside) for name, x in sums.items()}).drop(number)
    keys = [f"{prefix}of_{c}" for c in (*by, number)]
    before = Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    of_blocks = t.groupBy(*by, number).agg(*[F.sum(x).alias(f"{prefix}sum_{name}") for name, x in sums.items()]).withColumnsRenamed(dict(zip((*by, number), keys, strict=True)))
    of_blocks = of_blocks.select(*keys, *[F.coalesce(F.sum(f"{prefix}sum_{name}").over(before), F.lit(0)).alias(f"{prefix}before_{name}") for name in sums])
    t = t.withColumns({name: F.sum(x).over(inside) for name, x in sums.items()}).join(of_blocks, same([*by, number], keys))
    return t.select(*rows.columns, *[(F.col(name) + F.col(f"{prefix}before_{name}")).alias(name) for name in sums])
