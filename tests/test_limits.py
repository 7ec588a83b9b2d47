"""Token buckets against a request-by-request model."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordweave.operators.limits import _Fold, rate_limited


def model(requests, rate, lifetime):
    out, states = [], {}
    for client, seq, t in sorted(requests, key=lambda r: r[1]):
        made, tokens, last = states.get(client, (None, 0.0, None))
        t = max((x for x in (t, last) if x is not None), default=None)
        if t is None:
            out.append((client, seq, 2 * rate >= 1))
            continue
        if made is None or t - made >= lifetime:
            made, tokens, last = t, 2 * rate, t
        tokens = min(2 * rate, tokens + (t - last) * rate)
        out.append((client, seq, tokens >= 1))
        states[client] = (made, tokens - (tokens >= 1), t)
    return sorted(out, key=str)


def drawn(seed, n, gaps):
    draw, t, out = random.Random(seed), 1.7e9, []
    for i in range(n):
        t += draw.choice(gaps)
        out.append((draw.choice(["hot"] * 5 + ["b", "c", None]), 2 * i, t))
    return out


@pytest.mark.parametrize("rate,lifetime,rows_per_block", [(1.0, 300.0, 1000), (0.7, 11.0, 40), (3.0, 5.0, 9), (0.3, 4.0, 100), (2.5, 1.0, 60), (20.0, 300.0, 5)])
def test_requests_pass_as_one_after_the_other(spark, rate, lifetime, rows_per_block):
    requests = drawn(rows_per_block, 600, [0.0, 0.0, 0.01, 0.1, 0.1, 0.5, 1.3, 2.0, 6.7])
    df = spark.createDataFrame([(c, s, round((t - 1.7e9) * 1e6)) for c, s, t in requests], "client string, seq long, us long").selectExpr("client", "seq", "timestamp_micros(1700000000000000 + us) AS ts")
    exact = [(r.client, r.seq, r.t) for r in df.selectExpr("client", "seq", "cast(ts AS double) AS t").collect()]
    got = rate_limited(df, rate, lifetime=lifetime, rows_per_block=rows_per_block).collect()
    assert sorted(map(tuple, got), key=str) == model(exact, rate, lifetime)


@pytest.mark.parametrize("seed", range(8))
def test_sessions_cross_batches_of_any_size(seed):
    draw = random.Random(seed)
    rate, lifetime = draw.choice([0.4, 1.0, 2.3, 5.0]), draw.choice([3.0, 7.5, 60.0])
    requests = [("one", s, t) for _, s, t in drawn(seed, 900, [0.0, 0.05, 0.1, 0.4, 0.9, 2.2, 3.1])]
    clock = np.array([t for _, _, t in requests])
    head = np.diff(clock, prepend=-np.inf) >= lifetime
    fold, got, a = _Fold(rate, lifetime), [], 0
    while a < len(clock):
        b = a + draw.choice([1, 1, 2, 5, 80, 400])
        got += fold.batch(clock[a:b], head[a:b]).tolist()
        a = b
    assert got == [r[2] for r in sorted(model(requests, rate, lifetime), key=lambda r: r[1])]


@pytest.mark.parametrize("rows_per_block", [2, 100])
def test_clocks_never_go_back(spark, rows_per_block):
    times = [None, None, 100.0, 99.0, None, 100.5, 50.0, 103.0, None, 500.0, 101.0, 500.0]
    requests = [(c, i, t) for c in ("a", None) for i, t in enumerate(times)]
    df = spark.createDataFrame([(c, i, None if t is None else round(t * 1e6)) for c, i, t in requests], "client string, seq long, us long").withColumn("ts", F.timestamp_micros("us"))
    assert sorted(map(tuple, rate_limited(df, 1.0, rows_per_block=rows_per_block).collect()), key=str) == model(requests, 1.0, 300.0)


def test_no_requests_and_no_limit(spark):
    df = spark.createDataFrame([(7, 1, 0)], "who long, seq long, ts long").withColumn("ts", F.timestamp_seconds("ts"))
    assert [tuple(r) for r in rate_limited(df, 0, "who").collect()] == [(7, 1, True)]
    assert rate_limited(df.where("seq > 1"), 1.0, "who").collect() == []
    assert rate_limited(df, 1.0, "who").schema["client"].dataType.simpleString() == "bigint"
