"""Delivery policies over ordered events: buffers, batches, write-ahead log, dead letters, roll-ups, breaker states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import ROWS, bounds, running


def numbered(events: DataFrame, order: str, name: str = "rank", rows_per_block: int = ROWS) -> DataFrame:
    """Adds the global rank (from 1) by a numeric order column without a single task: ranks inside blocks of the order
    column (however its values are spread), plus the sizes of the blocks before."""
    return running(events, (), order, {name: F.lit(1)}, bounds(events, order, rows_per_block))


def buffer_drop(events: DataFrame, capacity: int, order: str = "seq") -> DataFrame:
    """A burst into a full buffer that evicts the oldest: the last ``capacity`` events."""
    return events.orderBy(F.desc(order)).limit(capacity)


def buffer_block(events: DataFrame, capacity: int, order: str = "seq") -> DataFrame:
    """A burst into a buffer that blocks until its time-out: the first ``capacity`` events; the rest is refused."""
    return events.orderBy(order).limit(capacity)


def buffer_sample(events: DataFrame, capacity: int, rate: int = 10, order: str = "seq") -> DataFrame:
    """A burst into a buffer that samples when full: the first ``capacity`` events and every rate-th after them."""
    over = F.col("__rank") - capacity
    return numbered(events, order, "__rank").where((over <= 0) | (over % rate == 0)).drop("__rank")


def batches_by_count(events: DataFrame, size: int, order: str = "seq") -> DataFrame:
    """Adds ``batch`` (from 0): batches of ``size`` events in order."""
    return numbered(events, order, "__rank").withColumn("batch", F.floor((F.col("__rank") - 1) / size)).drop("__rank")


def write_ahead_log(events: DataFrame, order: str = "seq", segment_events: int = 1000) -> DataFrame:
    """Adds ``offset`` (from 0) and the ``segment`` that holds it."""
    out = numbered(events, order, "__rank").withColumn("offset", F.col("__rank") - 1).drop("__rank")
    return out.withColumn("segment", F.floor(F.col("offset") / segment_events))


def read_log(log: DataFrame, start: int, limit: int) -> DataFrame:
    return log.where(F.col("offset") >= start).orderBy("offset").limit(limit)


def truncate_log(log: DataFrame, offset: int) -> DataFrame:
    """Without the segments that begin before the offset."""
    firsts = log.groupBy("segment").agg(F.min("offset").alias("__first")).where(F.col("__first") >= offset)
    return log.join(firsts.select("segment"), "segment", "left_semi")


def compact_log(log: DataFrame, most_segments: int) -> DataFrame:
    """Only the newest segments."""
    newest = log.agg(F.max("segment").alias("__newest"))
    return log.join(F.broadcast(newest), F.col("segment") > F.col("__newest") - most_segments).drop("__newest")


def dead_letters(parsed: DataFrame, error: str = "parse error", now: str = "ts") -> DataFrame:
    """Error rows with the reason, time and number of retries; the other rows are ``delivered(parsed)``."""
    return parsed.where("is_error").withColumn("error", F.lit(error)).withColumn("failed_at", F.col(now)).withColumn("retries", F.lit(0))


def delivered(parsed: DataFrame) -> DataFrame:
    return parsed.where("NOT is_error")


def cap_dead_letters(letters: DataFrame, size: int, order: str = "seq") -> DataFrame:
    """The first ``size`` letters; later ones found the queue full and were dropped."""
    return letters.orderBy(order).limit(size)


def dequeue(letters: DataFrame, n: int, order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """The ``n`` oldest letters (one: what a peek shows), and those that stay, by a numeric order without ties."""
    last = letters.orderBy(order).limit(n).agg(F.max(order).alias("__last"))
    marked = letters.join(F.broadcast(last))  # an aggregate without keys: one row
    taken = F.coalesce(F.col(order) <= F.col("__last"), F.lit(False))
    return marked.where(taken).drop("__last"), marked.where(~taken).drop("__last")


def age_out(letters: DataFrame, now: Column, max_age_seconds: int, time: str = "failed_at") -> DataFrame:
    return letters.where(F.col(time) >= now - F.make_dt_interval(secs=F.lit(max_age_seconds)))


def retry_letters(letters: DataFrame, now: Column) -> DataFrame:
    return letters.withColumn("retries", F.col("retries") + 1).withColumn("failed_at", now)


#: Halvings after which a double is nothing: older batches have no weight in a mean that halves.
_HALVINGS = 1100


def halving_mean(rows: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """(by, mean): the mean that starts with the first value that isn't 0 and then goes half-way to each further one, in order.

    Steps that go half-way compose to a weighted sum: the newest value weighs 1/2, the one before 1/4, and the first one as
    much as the second.  Weights beyond the range of a double are 0, so the newest values of each group give the result,
    and Spark keeps no more than these before it shuffles.
    """
    newest = Window.partitionBy(by).orderBy(F.desc(order))
    ranked = rows.select(by, order, F.col(value).cast("double").alias("__x")).where("__x is not null").withColumn("__rank", F.row_number().over(newest)).where(F.col("__rank") <= _HALVINGS)
    weight = F.pow(F.lit(2.0), -F.col("__rank"))
    first = F.min_by(F.col("__x") * weight, F.when(F.col("__x") != 0, F.col(order)))
    return ranked.groupBy(by).agg((F.sum(F.col("__x") * weight) + F.coalesce(first, F.lit(0.0))).alias("mean"))


def output_metrics(batches: DataFrame, by: str = "output") -> DataFrame:
    """Per output: sums and averages of its batches (output, events, failed, bytes, latency_ms, seq)."""
    last_failed = F.when(F.col("error").isNotNull(), F.struct("sent_at", "seq"))
    sums = batches.groupBy(by).agg(
        F.sum("events").alias("events_sent"), F.sum("failed").alias("events_failed"), F.sum("bytes").alias("bytes_sent"), F.count(F.lit(1)).alias("batches_sent"),
        (F.sum("events") / F.count(F.lit(1))).alias("avg_batch_size"), F.max("sent_at").alias("last_sent"),
        F.max_by("error", last_failed).alias("last_error"), F.max(last_failed).alias("last_error_at"),
    ).withColumn("last_error_at", F.col("last_error_at.sent_at"))
    means = halving_mean(batches, by, "latency_ms", "seq").select(F.col(by).alias("__of"), F.col("mean").alias("avg_latency_ms"))
    return sums.join(means, F.col(by).eqNullSafe(F.col("__of")), "left").drop("__of")


def router_metrics(outputs: DataFrame, by: str = "output") -> DataFrame:
    """All outputs together: sums, the mean of their means, the latest send and error (of equal times the last output's)."""
    failed = F.when(F.col("last_error").isNotNull(), F.struct("last_error_at", by))
    return outputs.agg(
        F.sum("events_sent").alias("events_sent"), F.sum("events_failed").alias("events_failed"), F.sum("bytes_sent").alias("bytes_sent"), F.sum("batches_sent").alias("batches_sent"),
        F.avg("avg_batch_size").alias("avg_batch_size"), F.avg("avg_latency_ms").alias("avg_latency_ms"), F.max("last_sent").alias("last_sent"),
        F.max_by("last_error", failed).alias("last_error"),
    )


def overall_health(components: DataFrame, *by: str) -> DataFrame:
    """(by, status): the worst of all components of each group; without groups healthy when there is none."""
    severity = F.when(F.col("status") == "unhealthy", 2).when(F.col("status") == "degraded", 1).otherwise(0)
    names = F.array(F.lit("healthy"), F.lit("degraded"), F.lit("unhealthy"))
    return components.groupBy(*by).agg(F.element_at(names, F.coalesce(F.max(severity), F.lit(0)) + 1).alias("status"))


def breaker_states(calls: DataFrame, by: str, failed: Column, order: str = "seq", ts: str = "ts", trips: int = 5, timeout: float = 60.0, interval: float = 60.0, probes: int = 1) -> DataFrame:
    """Rows (by, seq, state, allowed): what a circuit breaker in front of each value of ``by`` would have done.

    Closed: ``trips`` failures in a row open it; counts start anew every ``interval`` seconds.  Open: calls are refused
    until ``timeout`` has passed, then it is half-open.  Half-open: ``probes`` successes close it, a failure opens it.
    state is the one before the call.
    """
    kind = dict(calls.dtypes)[by]

    def fold(batches):
        import pyarrow as pa

        key = state = None
        in_row = good = 0
        until = 0.0
        for batch in batches:
            out: list[tuple] = []
            for k, seq, t, bad in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != k or state is None:
                    key, state, in_row, good, until = k, "closed", 0, 0, t + interval
                if state == "closed" and interval > 0 and t > until:
                    in_row, until = 0, t + interval
                if state == "open" and t > until:
                    state, good = "half-open", 0
                allowed = state != "open"
                out.append((k, seq, state, allowed))
                if not allowed:
                    continue
                if state == "closed":
                    in_row = in_row + 1 if bad else 0
                    if in_row >= trips:
                        state, until = "open", t + timeout
                elif bad:
                    state, until = "open", t + timeout
                else:
                    good += 1
                    if good >= probes:
                        state, in_row, until = "closed", 0, t + interval
            if out:
                a, b, c, d = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, batch.schema.field(0).type), pa.array(b, pa.int64()), pa.array(c), pa.array(d)], ["by", "seq", "state", "allowed"])

    slim = calls.select(F.col(by).alias("by"), F.col(order).cast("long").alias("seq"), F.col(ts).cast("double").alias("t"), failed.alias("bad"))
    parts = int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return slim.repartition(parts, "by").sortWithinPartitions("by", "seq").mapInArrow(fold, f"by {kind}, seq long, state string, allowed boolean")
