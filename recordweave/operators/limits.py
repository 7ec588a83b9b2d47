"""Token buckets of clients over a table of requests.

A client's bucket is made full, and made anew with the first request that comes ``lifetime`` seconds after it was made.
So a client that is quiet for that long starts afresh whatever was before: such gaps cut its requests into sessions, which
are limited in different tasks.  Gaps are found in blocks of the order column, not by a window over a client.  Inside a
session a bucket is also full after a gap that refills it and where it is made anew, and as many requests as it holds
then pass at once; only what follows these, while the bucket is short, is counted request by request.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import ROWS, block, bounds, running, same


def _sessions(requests: DataFrame, lifetime: float, begins: list[float]) -> DataFrame:
    """(client, seq, t) with ``t`` as a clock that never goes back, ``head`` and the number of the session."""
    t = requests.withColumn("block", block(F.col("seq"), begins))
    inside = Window.partitionBy("client", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("was", F.max("t").over(inside))
    if begins:
        of_blocks = t.groupBy("client", "block").agg(F.max("t").alias("latest"))
        before = Window.partitionBy("client").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        of_blocks = of_blocks.select(F.col("client").alias("of_client"), F.col("block").alias("of_block"), F.max("latest").over(before).alias("earlier"))
        t = t.join(of_blocks, same(["client", "block"], ["of_client", "of_block"])).withColumn("was", F.greatest("was", "earlier"))
    clock = F.greatest("t", "was")
    t = t.select("client", "seq", F.coalesce(clock, F.lit(0.0)).alias("t"), F.coalesce(clock - F.col("was") >= lifetime, F.lit(True)).alias("head"))
    return running(t, ("client",), "seq", {"session": F.col("head").cast("int")}, begins)


class _Fold:
    """The requests of sessions, one session after the other, in batches of any size."""

    def __init__(self, per_second: float, lifetime: float):
        self.rate, self.lifetime, self.full = per_second, lifetime, 2 * per_second
        self.made = self.last = self.tokens = 0.0

    def _made_anew(self, clock, a: int, b: int, made: float) -> tuple[list[int], float]:
        """Places in a session's part of a batch where its bucket is made anew, and when the last one was."""
        import numpy as np

        places, p = [], a
        while p < b:
            p += int(np.searchsorted(clock[p:b], made + self.lifetime))
            while p > a and clock[p - 1] - made >= self.lifetime:  # the sum above is rounded, differences are exact
                p -= 1
            while p < b and clock[p] - made < self.lifetime:
                p += 1
            if p < b:
                places.append(p)
                made = float(clock[p])
        return places, made

    def batch(self, clock, head):
        """Which requests pass."""
        import numpy as np

        n = len(clock)
        between = np.diff(clock, prepend=self.last)
        fresh = head | (between * self.rate >= self.full)
        firsts = np.unique(np.append(np.flatnonzero(head), 0))
        ends = np.append(firsts[1:], n)
        made = np.where(head[firsts], clock[firsts], self.made)
        for i in np.flatnonzero(clock[ends - 1] - made >= self.lifetime):
            places, made[i] = self._made_anew(clock, int(firsts[i]), int(ends[i]), float(made[i]))
            fresh[places] = True
        self.made = float(made[-1])

        starts = np.unique(np.append(np.flatnonzero(fresh), 0))
        sizes = np.diff(np.append(starts, n))
        at_once = int(self.full)
        passes = np.arange(n) - np.repeat(starts, sizes) < at_once
        short = sizes > at_once
        short[0] |= not fresh[0]
        short[-1] = True  # what it leaves goes on into the next batch
        for i in np.flatnonzero(short):
            a, b = int(starts[i]), int(starts[i] + sizes[i])
            tokens = self.full if fresh[a] else self.tokens
            for p, gap in enumerate(between[a:b].tolist(), a):
                if p > a or not fresh[a]:
                    tokens = min(self.full, tokens + gap * self.rate)
                passes[p] = tokens >= 1
                tokens -= tokens >= 1
            self.tokens = tokens
        self.last = float(clock[-1])
        return passes


def rate_limited(
    requests: DataFrame, per_second: float, client: str = "client", order: str = "seq", ts: str = "ts", lifetime: float = 300.0, rows_per_block: int = ROWS
) -> DataFrame:
    """Rows (client, seq, allowed): a token bucket for each client, burst twice the rate, made anew ``lifetime`` seconds
    after it was made.  A rate of 0 or less allows all.

    Requests come in the order of ``order``, a whole number without ties in a client.  Their times are a clock's: a time
    below an earlier one, or none, is the latest so far, and requests before a client's first time each find a full
    bucket.  Null is a client like others.  A client that is never quiet for ``lifetime`` seconds is one session, hence one task.
    """
    slim = requests.select(F.col(client).alias("client"), F.col(order).cast("long").alias("seq"), F.col(ts).cast("double").alias("t"))
    if per_second <= 0:
        return slim.select("client", "seq", F.lit(True).alias("allowed"))
    kind = dict(requests.dtypes)[client]

    def fold(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        state = _Fold(per_second, lifetime)
        for b in batches:
            if b.num_rows:
                passes = state.batch(b.column("t").to_numpy(zero_copy_only=False), np.asarray(b.column("head").to_numpy(zero_copy_only=False), bool))
                yield pa.RecordBatch.from_arrays([b.column("client"), b.column("seq"), pa.array(passes)], ["client", "seq", "allowed"])

    rows = _sessions(slim, lifetime, bounds(slim, "seq", rows_per_block)).repartition("client", "session").sortWithinPartitions("client", "session", "seq")
    return rows.select("client", "seq", "t", "head").mapInArrow(fold, f"client {kind}, seq long, allowed boolean")
