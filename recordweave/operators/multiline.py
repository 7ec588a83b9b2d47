"""Assembly of multi-line records, in order within each source."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.regexes import translate
from .blocks import ROWS, block, bounds, same


@dataclass(frozen=True)
class MultilineSpec:
    """A line that matches (or, negated, doesn't) starts a record."""

    pattern: str
    negate: bool = False
    match: str = "after"
    max_lines: int = 500
    timeout_seconds: float = 5.0


def _edges(marked: DataFrame, source: str, timeout: float) -> DataFrame:
    """(of_source, of_block, late, groups, open): what the blocks before hand to a block of a source.

    late: its first line comes later than the timeout after the last line before it; groups: starts before it; open:
    lines that the open record has by then.  A row for each source and block, scanned by windows.
    """
    last_start = F.max(F.when(F.col("__start"), F.col("__n")))
    b = marked.groupBy(source, "__block").agg(
        F.min_by(F.struct("__t", "__start"), "__n").alias("head"), F.max_by("__t", "__n").alias("last"), F.max("__n").alias("n"), F.count_if("__start").alias("starts"), last_start.alias("last_start")
    )
    order = Window.partitionBy(source).orderBy("__block")
    late = F.coalesce(F.col("head.__t") - F.lag("last").over(order) > timeout, F.lit(False))
    b = b.withColumn("late", late).withColumn("starts", F.col("starts") + F.when(F.col("late") & ~F.col("head.__start"), 1).otherwise(0))
    # Lines of the open record at a block's end: from its last start on, or what was open before and all of its lines.
    b = b.withColumn("tail", F.when(F.col("starts") == 0, F.col("n")).otherwise(F.col("n") - F.coalesce("last_start", F.lit(1)) + 1))
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("run", F.count_if(F.col("starts") > 0).over(upto)).withColumn("groups", F.coalesce(F.sum("starts").over(before), F.lit(0)))
    b = b.withColumn("open", F.sum("tail").over(Window.partitionBy(source, "run").orderBy("__block").rowsBetween(Window.unboundedPreceding, 0)))
    return b.select(F.col(source).alias("of_source"), F.col("__block").alias("of_block"), "late", "groups", F.coalesce(F.lag("open").over(order), F.lit(0)).alias("open"))


def assemble(lines: DataFrame, spec: MultilineSpec, source: str = "source", order: str = "seq", line: str = "line", ts: str = "ts", rows_per_block: int = ROWS) -> DataFrame:
    """(source, seq, ts, line, n_lines): one row per record; seq and ts are those of its first line.

    A record ends before a start line, before a line that comes later than the timeout after the one before it, and
    when it is full (fullness is only seen after a continuation, so a record has at least two lines then).  With match
    ``before`` continuations stand in reverse order before the start line.  Empty and null lines are errors and join
    nothing.  What is open at the end of the input is a record as well.

    The order column is a number or a time.  Sources are scanned in blocks of it: a window goes over the lines of a block, and
    over the blocks of a source go what they hand on (last time, starts, length of the open record).
    """
    filled = lines.where((F.col(line) != "") & F.col(line).isNotNull())
    begins = bounds(lines, order, rows_per_block)
    hit = F.col(line).rlike(translate(spec.pattern).java)
    rows = filled.select(source, F.col(order).alias("__order"), F.col(ts).alias("__ts"), F.col(line).alias("__line"), (~hit if spec.negate else hit).alias("__hit"), F.col(ts).cast("double").alias("__t"))
    rows = rows.withColumn("__block", block(F.col("__order"), begins))
    by = Window.partitionBy(source, "__block").orderBy("__order")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    # a record that starts by timeout takes whatever follows; so does an orphan continuation
    late = F.coalesce(F.col("__t") - F.lag("__t").over(by) > spec.timeout_seconds, F.lit(False))
    marked = rows.withColumn("__n", F.row_number().over(by).cast("long")).withColumn("__start", F.col("__hit") | late)
    if begins:
        marked = marked.join(_edges(marked, source, spec.timeout_seconds), same([source, "__block"], ["of_source", "of_block"]))
        marked = marked.withColumn("__start", F.col("__start") | ((F.col("__n") == 1) & F.col("late")))
    else:
        marked = marked.withColumns({"groups": F.lit(0), "open": F.lit(0)})
    inside = F.count_if("__start").over(upto)
    since = F.max(F.when(F.col("__start"), F.col("__n"))).over(upto)
    marked = marked.withColumn("__group", F.col("groups") + inside).withColumn("__place", F.coalesce(F.col("__n") - since, F.col("open") + F.col("__n") - 1))
    marked = marked.withColumn("__chunk", F.floor(F.col("__place") / max(spec.max_lines, 2)))
    entry = F.struct(F.col("__order").alias("seq"), F.col("__ts").alias("ts"), F.col("__line").alias("line"))
    records = marked.groupBy(source, "__group", "__chunk").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    said = F.col("e.line")
    return records.select(
        F.col(source).alias("source"),
        F.col("e")[0]["seq"].alias("seq"),
        F.col("e")[0]["ts"].alias("ts"),
        F.array_join(F.reverse(said) if spec.match == "before" else said, "\n").alias("line"),
        F.size("e").alias("n_lines"),
    )


def errors(lines: DataFrame, line: str = "line") -> DataFrame:
    """The empty lines, which belong to no record."""
    return lines.where(F.col(line).isNull() | (F.col(line) == ""))
