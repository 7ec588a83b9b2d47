"""Scans in order against sequential models: blocks, multi-line records, batches."""

import random

import pytest
from pyspark.sql import functions as F

from recordweave.operators.batches import batches_by_bytes
from recordweave.operators.blocks import block, bounds
from recordweave.operators.delivery import numbered
from recordweave.operators.multiline import MultilineSpec, assemble

from .test_sources_and_streams import model


@pytest.mark.parametrize("parts", [1, 5, 60])
def test_blocks_are_even_and_in_order(spark, parts):
    df = spark.range(3000).selectExpr("case when id < 1000 then id else id * id * 1000 end as x", "id")
    begins = bounds(df, "x", 3000 // parts)
    got = df.select("x", block(F.col("x"), begins).alias("b")).orderBy("x").collect()
    assert [r.b for r in got] == sorted(r.b for r in got)
    sizes = [sum(r.b == b for r in got) for b in {r.b for r in got}]
    assert len(sizes) == parts and max(sizes) <= 2 * 3000 // parts
    assert spark.range(1).select(block(F.lit(None).cast("long"), begins).alias("b")).first().b == 0


@pytest.mark.parametrize("rows_per_block", [10, 1000])
def test_ranks_of_sparse_orders(spark, rows_per_block):
    df = spark.range(500).selectExpr("id", "1700000000000000 + id * 1000003 as micros")
    got = numbered(df, "micros", rows_per_block=rows_per_block).collect()
    assert all(r["rank"] == r.id + 1 for r in got) and len(got) == 500


@pytest.mark.parametrize("match,negate,most,rows_per_block", [("after", False, 500, 1), ("after", False, 4, 7), ("before", False, 3, 30), ("after", True, 2, 11), ("after", False, 500, 100)])
def test_records_cross_blocks(spark, match, negate, most, rows_per_block):
    draw = random.Random(match + str(rows_per_block))
    spec = MultilineSpec("^S", negate=negate, match=match, max_lines=most, timeout_seconds=4.0)
    rows, wanted = [], []
    for source, n in (("hot", 300), ("b", 40), (None, 30), ("one", 1)):
        t, mine = 0, []
        for i in range(n):
            t += draw.choice([0, 1, 1, 1, 9])
            mine.append((t, draw.choice(["S", "x", "y", "z", "z"]) + str(i)))
        rows += [(source, i, t, line) for i, (t, line) in enumerate(mine)] + [(source, 150, t, "")]
        wanted += [(source or "", x) for x in model(mine, spec)]
    df = spark.createDataFrame(rows, "source string, seq long, t long, line string").withColumn("ts", F.timestamp_seconds("t"))
    got = assemble(df, spec, rows_per_block=rows_per_block).collect()
    assert sorted((r.source or "", r.line) for r in got) == sorted(wanted)


def greedy(events, most_bytes, most_events, interval=0.0):
    out, open_ = [], {}
    for key, seq, size, t in sorted(events, key=lambda e: e[1]):
        tick = t // interval if interval else 0
        state = open_.get(key)
        if state is None or state["closed"] or state["tick"] != tick:
            number = -1 if state is None else state["row"][1]
            state = open_[key] = {"tick": tick, "closed": False, "row": [key, number + 1, 0, 0, seq, seq]}
            out.append(state["row"])
        row = state["row"]
        row[2], row[3], row[5] = row[2] + 1, row[3] + size, seq
        state["closed"] = row[2] >= most_events or row[3] >= most_bytes
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("most_bytes,most_events,cell,rows_per_block", [(40, 5, 8, 50), (1, 3, 4, 1000), (1000, 7, 8, 9), (25, 1, 2, 100), (60, 1000, 8192, 100)])
def test_batches_are_the_greedy_ones(spark, most_bytes, most_events, cell, rows_per_block):
    draw = random.Random(most_bytes)
    events = [(draw.choice(["a", "a", "a", "b", None]), i * 3, draw.choice([0, 0, 1, 5, 9, 50]), i // 4) for i in range(400)]
    df = spark.createDataFrame([(k, seq, "x" * size if size or seq % 2 else None, t) for k, seq, size, t in events], "by string, seq long, raw string, t long").withColumn("ts", F.timestamp_seconds("t"))
    got = batches_by_bytes(df, most_bytes, most_events, "by", rows_per_block=rows_per_block, cell=cell).collect()
    assert sorted(map(tuple, got), key=str) == greedy(events, most_bytes, most_events)
    got = batches_by_bytes(df, most_bytes, most_events, "by", interval_seconds=10, rows_per_block=rows_per_block, cell=cell).collect()
    assert sorted(map(tuple, got), key=str) == greedy(events, most_bytes, most_events, 10)


def test_no_batches_of_no_events_and_no_python_worker(spark):
    kind = "by string, seq long, raw string, ts timestamp"
    assert batches_by_bytes(spark.createDataFrame([], kind), 10, 10, "by").collect() == []
    df = spark.range(100).selectExpr("'k' as by", "id as seq", "'raw' as raw", "current_timestamp() as ts")
    plan = batches_by_bytes(df, 10, 10, "by")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapInArrow" not in plan
