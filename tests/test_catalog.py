"""Every catalog query against its SQL in DuckDB, on the smallest tables."""

import os
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from recordweave import catalog
from recordweave.catalog.common import spread

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def shown(x):
    if x is None or x != x or str(x) in ("<NA>", "NaT"):
        return "null"
    return f"{float(x):.9g}" if isinstance(x, float | Decimal) else str(x)


def rows(df):
    return sorted(tuple(map(shown, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    found = catalog.queries()[name](spark, SF).toPandas()
    sql = catalog.oracle_sql().get(name)
    if not sql:
        return
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    con.execute(f"create view events as select * from '{SF}/events.parquet'")
    wanted = con.execute(sql).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


def _largest(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.sum("count"), F.max("count")).first()


def test_tasks_do_not_grow_with_the_table(spark):
    few = spread(spark.range(0, 3_000_000, 1, 2))
    uneven = spread(spark.range(0, 600_000, 1, 1).union(spark.range(600_000, 600_010, 1, 10)))
    assert (_largest(few)[0], _largest(uneven)[0]) == (3_000_000, 600_010)
    assert _largest(few)[1] < 300_000 and _largest(uneven)[1] < 300_000
    assert few.agg(F.count_distinct("id")).first()[0] == 3_000_000
    # small tables go over the cores, and stay where they are in more partitions than that
    assert [spread(spark.range(0, 1000, 1, n)).rdd.getNumPartitions() for n in (1, 30)] == [spark.sparkContext.defaultParallelism, 30]
    assert spread(spark.range(0)).count() == 0
