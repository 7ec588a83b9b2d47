"""Series about the pipeline itself, observed while its queries run.

``observe`` adds counts to a plan that is evaluated anyway: nothing is scanned for them.  A listener adds up what every
micro-batch reports; batches report through an ``Observation``.  Counters add up, gauges are what was reported last,
histograms add up by bucket.
"""

from __future__ import annotations

import threading
from bisect import bisect_left
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..operators.metrics import exponential_buckets

#: Bounds of the histograms: seconds of a batch, events of a batch.
SECONDS, EVENTS = exponential_buckets(0.001, 2.0, 15), exponential_buckets(1.0, 2.0, 15)
#: Bounds of a parser's seconds for an event.
PARSE_SECONDS = exponential_buckets(0.00001, 2.0, 15)
_INPUT, _OUTPUT = ("input_name", "input_type"), ("output_name", "output_type")
_LABELS = {
    "input": _INPUT, "parser": ("parser_type",), "output": _OUTPUT, "dlq": (), "dlq_table": (),
    "input_dropped": (*_INPUT, "reason"), "input_limited": _INPUT, "input_connected": _INPUT, "parser_refused": ("parser_type", "reason"), "output_refused": (*_OUTPUT, "reason"), "parser_timed": ("parser_type",),
}
#: Counters of flagged rows: the subsystem and name of the series.
_FLAGGED = {
    "input_dropped": ("input", "events_dropped_total"), "input_limited": ("input", "rate_limited_total"), "input_connected": ("input", "connections_total"),
    "parser_refused": ("parser", "events_failed_total"), "output_refused": ("output", "events_failed_total"),
}
_PART = "|"


def _zero(total):
    return F.coalesce(total, F.lit(0)).cast("long")


def _measures(subsystem: str, text: str) -> list:
    size, n = _zero(F.sum(F.octet_length(text))), F.count(F.lit(1))
    failed = F.count_if(F.col("is_error"))
    return {
        "input": lambda: [n.alias("events_received_total"), size.alias("bytes_received_total")],
        "parser": lambda: [(n - failed).alias("events_processed_total"), failed.alias("events_failed_total")],
        "output": lambda: [n.alias("events_sent_total"), size.alias("bytes_sent_total")],
        "dlq": lambda: [n.alias("events_written_total")],
        "dlq_table": lambda: [size.alias("size_bytes")],
    }[subsystem]()


def counted(rows: DataFrame, what: str, flag: Column, *labels: str, observation: Observation | None = None) -> DataFrame:
    """``rows`` with the number of those that ``flag`` marks, as a counter.

    what: input_dropped (name, kind, reason), input_limited (name, kind; requests over their rate), input_connected (name,
    kind; first rows of connections), parser_refused (kind, reason) or output_refused (name, kind, reason).
    """
    if what not in _FLAGGED or len(labels) != len(_LABELS[what]):
        raise ValueError(f"{what} has the labels {_LABELS.get(what)}")
    return rows.observe(observation or _PART.join((what, *labels)), F.count_if(F.coalesce(flag, F.lit(False))).alias("n"))


def timed(lines: DataFrame, parser: Callable[[DataFrame], DataFrame], kind: str, observation: Observation | None = None) -> DataFrame:
    """``parser(lines)`` with a histogram of the seconds that each event took in it.

    The executor's clock is read for a row before and after its parse (rows go through a parse one by one), and buckets are
    counted with the rows: no row is gone through again.  ``parser`` keeps columns that it doesn't know.
    """
    clock = F.expr("cast(reflect('java.lang.System', 'nanoTime') AS bigint)")
    parsed = parser(lines.withColumn("__begun", clock)).withColumn("__took", (clock - F.col("__begun")) / 1e9)
    counts = [F.count_if(F.col("__took") <= b).alias(f"b{i}") for i, b in enumerate(PARSE_SECONDS)]
    seconds = F.coalesce(F.sum("__took"), F.lit(0.0)).alias("seconds")
    return parsed.observe(observation or _PART.join(("parser_timed", kind)), *counts, F.count(F.lit(1)).alias("n"), seconds).drop("__begun", "__took")


def observed(rows: DataFrame, subsystem: str, *labels: str, text: str = "raw", observation: Observation | None = None) -> DataFrame:
    """``rows`` with counts for a subsystem: input (name, kind), parser (kind), output (name, kind), dlq (letters that are
    written now) or dlq_table (all letters there are: their size is a gauge).

    Streams name their counts by subsystem and labels, for ``PipelineSeries``; a batch gives an Observation instead.
    """
    if len(labels) != len(_LABELS[subsystem]):
        raise ValueError(f"{subsystem} has the labels {_LABELS[subsystem]}")
    return rows.observe(observation or _PART.join((subsystem, *labels)), *_measures(subsystem, text))


class PipelineSeries(StreamingQueryListener):
    """Adds up what observed streams report; ``lines`` gives the exposition text.

    Per query there are also histograms of a batch's seconds and events, and its state as a health series.
    """

    def __init__(self):
        self.totals: dict[tuple[str, tuple[tuple[str, str], ...]], float] = {}
        self.histograms: dict[tuple[str, tuple[tuple[str, str], ...]], tuple[tuple[float, ...], list[int], list[float]]] = {}
        self.lock = threading.Lock()

    def add(self, name: str, labels: dict[str, str], value: float) -> None:
        with self.lock:
            key = name, tuple(sorted(labels.items()))
            self.totals[key] = self.totals.get(key, 0) + value

    def put(self, name: str, labels: dict[str, str], value: float) -> None:
        with self.lock:
            self.totals[name, tuple(sorted(labels.items()))] = value

    def merge(self, name: str, labels: dict[str, str], bounds: tuple[float, ...], counts: list[int], total: float) -> None:
        """Adds a histogram that was counted elsewhere: observations in each bucket (the last one is beyond all bounds)."""
        with self.lock:
            _, held, sums = self.histograms.setdefault((name, tuple(sorted(labels.items()))), (bounds, [0] * (len(bounds) + 1), [0.0]))
            held[:] = [a + b for a, b in zip(held, counts, strict=True)]
            sums[0] += total

    def measure(self, name: str, labels: dict[str, str], bounds: tuple[float, ...], value: float) -> None:
        with self.lock:
            _, counts, sums = self.histograms.setdefault((name, tuple(sorted(labels.items()))), (bounds, [0] * (len(bounds) + 1), [0.0]))
            counts[bisect_left(bounds, value)] += 1
            sums[0] += value

    def report(self, key: str, values: dict[str, float]) -> None:
        """Counts of one micro-batch, or of a batch's Observation, under the name that ``observed`` gives."""
        what, *labels = key.split(_PART)
        if what not in _LABELS or len(labels) != len(_LABELS[what]):
            return
        named = dict(zip(_LABELS[what], labels, strict=True))
        if what in _FLAGGED:
            self.add("_".join(_FLAGGED[what]), named, values["n"])
        elif what == "parser_timed":
            upto = [values[f"b{i}"] for i in range(len(PARSE_SECONDS))] + [values["n"]]
            self.merge("parser_duration_seconds", named, PARSE_SECONDS, [n - m for n, m in zip(upto, [0, *upto], strict=False)], values["seconds"])
        elif what == "dlq_table":
            self.put("dlq_size_bytes", named, values["size_bytes"])
        else:
            for name, value in values.items():
                self.add(f"{what}_{name}", named, value)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.put("health_status", {"component": event.name or str(event.id)}, 1)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        for key, row in (p.observedMetrics or {}).items():
            self.report(key, row.asDict())
        query = {"query": p.name or str(p.id)}
        self.measure("output_duration_seconds", query, SECONDS, p.durationMs.get("triggerExecution", 0) / 1000)
        self.measure("output_batch_size", query, EVENTS, p.numInputRows)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.put("health_status", {"component": str(event.id)}, 0 if event.exception else 1)

    def lines(self, prefix: str = "") -> list[str]:
        shown = lambda labels: "{" + ",".join(f'{k}="{v}"' for k, v in labels) + "}" if labels else ""
        with self.lock:
            out = [f"{prefix}{name}{shown(labels)} {value:.15g}" for (name, labels), value in sorted(self.totals.items())]
            for (name, labels), (bounds, counts, sums) in sorted(self.histograms.items()):
                total = 0
                for bound, n in zip((*(f"{b:.15g}" for b in bounds), "+Inf"), counts, strict=True):
                    total += n
                    out.append(f"{prefix}{name}_bucket{shown((*labels, ('le', bound)))} {total}")
                out += [f"{prefix}{name}_sum{shown(labels)} {sums[0]:.15g}", f"{prefix}{name}_count{shown(labels)} {total}"]
        return out
