"""Stateful streams: multi-line records and token buckets, one state per source or client."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.regexes import compile_python
from ..operators.multiline import MultilineSpec


def is_start(line: str, spec: MultilineSpec, compiled) -> bool:
    return (compiled.search(line) is not None) != spec.negate


class Records(StatefulProcessor):
    """The open record of a source; what is open leaves when the source has been idle for the timeout."""

    def __init__(self, spec: MultilineSpec):
        self.spec = spec

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.compiled = compile_python(self.spec.pattern)
        self.handle = handle
        self.state = handle.getValueState("open", "lines array<string>, last double")

    def _row(self, key, lines: list[str]) -> pd.DataFrame:
        said = lines[::-1] if self.spec.match == "before" else lines
        return pd.DataFrame({"source": [key[0]], "line": ["\n".join(said)], "n_lines": [len(lines)]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        lines, last = [], 0.0
        if self.state.exists():
            got = self.state.get()
            lines, last = list(got[0]), got[1]
        new = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for line, t in zip(new["line"], new["t"], strict=True):
            if not line:
                continue
            late = bool(lines) and t - last > self.spec.timeout_seconds
            if late or is_start(line, self.spec, self.compiled):
                if lines:
                    yield self._row(key, lines)
                lines = [line]
            else:
                lines.append(line)
                if len(lines) > 1 and len(lines) >= self.spec.max_lines:
                    yield self._row(key, lines)
                    lines = []
            last = t
        if lines:
            self.state.update((lines, last))
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.spec.timeout_seconds * 1000))
        else:
            self.state.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.state.exists():
            lines = list(self.state.get()[0])
            self.state.clear()
            yield self._row(key, lines)

    def close(self) -> None:
        pass


def multiline_stream(lines: DataFrame, spec: MultilineSpec) -> DataFrame:
    """(source, line, n_lines) of a stream of (source, seq, ts, line).  Needs the RocksDB state store."""
    compile_python(spec.pattern)  # refuses what only one engine reads
    slim = lines.selectExpr("source", "seq", "cast(ts AS double) AS t", "line")
    return slim.groupBy("source").transformWithStateInPandas(Records(spec), "source string, line string, n_lines int", "Append", "ProcessingTime")


class Bucket(StatefulProcessor):
    """A client's token bucket; it is made anew ``lifetime`` seconds after it was made, used or not."""

    def __init__(self, per_second: float, lifetime: float):
        self.rate, self.lifetime = per_second, lifetime

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("bucket", "tokens double, last double, made double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = self.state.get() if self.state.exists() else None
        new = pd.concat(list(rows)).sort_values("seq", kind="stable")
        allowed = []
        for t in new["t"].fillna(float("-inf")):
            t = max(t, state[1]) if state is not None else max(t, 0.0)  # a clock never goes back
            if state is None or t - state[2] >= self.lifetime:
                state = (2 * self.rate, t, t)
            tokens = min(2 * self.rate, state[0] + (t - state[1]) * self.rate)
            allowed.append(tokens >= 1)
            state = (tokens - (tokens >= 1), t, state[2])
        self.state.update(tuple(map(float, state)))
        yield pd.DataFrame({"client": key[0], "seq": new["seq"], "allowed": allowed})

    def close(self) -> None:
        pass


def rate_limited_stream(requests: DataFrame, per_second: float, lifetime: float = 300.0) -> DataFrame:
    """(client, seq, allowed) of a stream of (client, seq, ts)."""
    slim = requests.selectExpr("cast(client AS string) AS client", "seq", "cast(ts AS double) AS t")
    return slim.groupBy("client").transformWithStateInPandas(Bucket(per_second, lifetime), "client string, seq long, allowed boolean", "Append", "None")


class Batcher(StatefulProcessor):
    """The open batch of an output; it leaves when it has the events or bytes of a limit, or at the next tick of the clock."""

    def __init__(self, most_events: int, most_bytes: int, interval_seconds: float):
        self.most_events, self.most_bytes, self.interval = most_events, most_bytes, int(interval_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", "seqs array<long>, raws array<string>, bytes long")

    def _rows(self, key, full: list[tuple[list, list, int]], reason: str) -> pd.DataFrame:
        return pd.DataFrame({
            "by": [key[0]] * len(full), "n": [len(s) for s, _, _ in full], "bytes": [b for _, _, b in full], "first_seq": [s[0] for s, _, _ in full], "last_seq": [s[-1] for s, _, _ in full],
            "events": [r for _, r, _ in full], "reason": [reason] * len(full),
        })

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seqs, raws, size = [], [], 0
        if self.state.exists():
            got = self.state.get()
            seqs, raws, size = list(got[0]), list(got[1]), got[2]
        new = pd.concat(list(rows)).sort_values("seq", kind="stable")
        full = []
        for seq, raw in zip(new["seq"], new["raw"], strict=True):
            raw = raw or ""
            seqs.append(int(seq))
            raws.append(raw)
            size += len(raw.encode())
            if len(seqs) >= self.most_events or size >= self.most_bytes:
                full.append((seqs, raws, size))
                seqs, raws, size = [], [], 0
        timers = list(self.handle.listTimers())
        if seqs:
            self.state.update((seqs, raws, size))
            if not timers:
                now = timerValues.getCurrentProcessingTimeInMs()
                self.handle.registerTimer((now // self.interval + 1) * self.interval)
        else:
            self.state.clear()
            for timer in timers:
                self.handle.deleteTimer(timer)
        if full:
            yield self._rows(key, full, "full")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.state.exists():
            seqs, raws, size = self.state.get()
            self.state.clear()
            yield self._rows(key, [(list(seqs), list(raws), size)], "tick")

    def close(self) -> None:
        pass


def batched_stream(events: DataFrame, most_events: int, most_bytes: int, interval_seconds: float) -> DataFrame:
    """(by, n, bytes, first_seq, last_seq, events, reason) of a stream of (by, seq, raw): greedy batches of each output.

    A batch closes with the event that reaches a limit (reason full), or at a tick, a multiple of the interval in
    processing time (reason tick).  Its texts are in order.  The state of an output is one batch at most.  Null texts are
    empty.  Needs the RocksDB state store; ``operators.batches`` gives the batches of a finished table.
    """
    if most_events < 1 or most_bytes < 1 or interval_seconds <= 0:
        raise ValueError("limits are 1 or more, and the interval is above 0")
    slim = events.selectExpr("cast(by AS string) AS by", "seq", "raw")
    kind = "by string, n int, bytes long, first_seq long, last_seq long, events array<string>, reason string"
    return slim.groupBy("by").transformWithStateInPandas(Batcher(most_events, most_bytes, interval_seconds), kind, "Append", "ProcessingTime")
