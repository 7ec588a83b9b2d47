import os
import random
import socket
import time

import pytest
from pyspark.sql import functions as F

from recordweave.functions.names import writer_compression
from recordweave.operators.delivery import breaker_states
from recordweave.operators.limits import rate_limited
from recordweave.operators.multiline import MultilineSpec, assemble
from recordweave.plans.config import ConfigError, load_or_default, loads, plan, pruned
from recordweave.operators.parsers import ParserSpec, event_json
from recordweave.operators.transforms import TransformSpec
from recordweave.sources.files import generated_lines, text_lines
from recordweave.sources.sinks import RoutingError, router, text_output, write_objects
from recordweave.sources.syslog import SyslogReader, SyslogSource
from recordweave.sources.tail import TailReader, TailSource
from recordweave.streaming.reliability import Breaker, OpenError, RateCapped, retry
from recordweave.streaming.stateful import multiline_stream, rate_limited_stream


def test_config_expands_and_checks(monkeypatch):
    monkeypatch.setenv("LOG_DIR", "/data")
    c = loads("inputs:\n  files:\n    - paths: [$LOG_DIR/a.log]\nparser: {type: json, time_field: ts}\ntransforms:\n  - {type: filter, include_fields: [a]}\n")
    assert c.inputs["files"][0]["paths"] == ["/data/a.log"] and c.parser.kind == "json" and c.logging["level"] == "info"
    assert pruned(c.parser, c.transforms).keep == ("a",)
    for bad in ("{}", "inputs: {files: [{}]}", "inputs: {http: {name: x}}", "inputs: {files: [{paths: [x]}]}\nlogging: {level: loud}"):
        with pytest.raises(ConfigError):
            loads(bad)
    assert load_or_default("/nonexistent").inputs


def test_plan_from_config(spark):
    c = loads("inputs:\n  files: [{paths: [x]}]\nparser: {type: json}\ntransforms:\n  - {type: filter, include_fields: [a]}\n  - {type: add, add: {env: p}}\n")
    df = spark.createDataFrame([('{"a":"1","b":"2","msg":"m"}', "s")], "line string, source string").withColumn("ts", F.current_timestamp())
    assert plan(df, c).first().fields == {"a": "1", "env": "p"}


def model(lines, spec):
    """The buffer of one source, line by line."""
    import re

    out, held, last = [], [], None
    flush = lambda: out.append("\n".join(held[::-1] if spec.match == "before" else held))
    for t, line in lines:
        start = bool(re.search(spec.pattern, line)) != spec.negate
        if held and t - last > spec.timeout_seconds or start:
            if held:
                flush()
            held = [line]
        else:
            held.append(line)
            if len(held) > 1 and len(held) >= spec.max_lines:
                flush()
                held = []
        last = t
    if held:
        flush()
    return out


@pytest.mark.parametrize("match,negate,most", [("after", False, 500), ("before", False, 3), ("after", True, 2), ("after", False, 1)])
def test_multiline_is_the_sequential_buffer(spark, match, negate, most):
    draw = random.Random(match + str(most))
    spec = MultilineSpec("^S", negate=negate, match=match, max_lines=most, timeout_seconds=4.0)
    rows, wanted = [], []
    for source in ("a", "b", "c"):
        t, mine = 0, []
        for i in range(200):
            t += draw.choice([0, 1, 1, 9])
            mine.append((t, draw.choice(["S", "x", "y"]) + str(i)))
        rows += [(source, i, t, line) for i, (t, line) in enumerate(mine)] + [(source, 1000, t, "")]
        wanted += model(mine, spec)
    df = spark.createDataFrame(rows, "source string, seq long, t long, line string").withColumn("ts", F.timestamp_seconds("t"))
    assert sorted(r.line for r in assemble(df, spec).collect()) == sorted(wanted)


def test_streams_agree_with_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [("a", i, i, ("S" if i % 3 == 0 else "x") + str(i)) for i in range(12)] + [("a", 12, 100, "S12")]
    df = spark.createDataFrame(rows, "source string, seq long, t long, line string").withColumn("ts", F.timestamp_seconds("t")).withColumn("client", F.col("source"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    spec = MultilineSpec("^S", timeout_seconds=30.0)
    q = multiline_stream(stream, spec).writeStream.format("memory").queryName("records").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(120)
    found = {r.line for r in spark.table("records").collect()}
    assert found <= {r.line for r in assemble(df, spec).collect()} and len(found) >= 4
    q = rate_limited_stream(stream, 0.5).writeStream.format("memory").queryName("limits").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination(120)
    assert {(r.seq, r.allowed) for r in spark.table("limits").collect()} == {(r.seq, r.allowed) for r in rate_limited(df, 0.5).collect()}


def test_tail_reads_complete_lines_and_rotations(tmp_path):
    path = tmp_path / "a.log"
    path.write_text("one\ntwo\npart")
    reader = TailReader({"paths": str(tmp_path / "*.log"), "from": "start"})
    lines = lambda start, end: [r[2] for p in reader.partitions(start, end) for r in reader.read(p)]
    first = reader.latestOffset()
    assert lines(reader.initialOffset(), first) == ["one", "two"]
    with path.open("a") as f:
        f.write("ial\n")
    second = reader.latestOffset()
    assert lines(first, second) == ["partial"]
    os.rename(path, tmp_path / "a.old")
    path.write_text("new\n")
    assert lines(second, reader.latestOffset()) == ["new"]
    late = TailReader({"paths": str(path)})
    assert late.partitions(late.initialOffset(), late.latestOffset()) == []


def test_tail_as_a_stream(spark, tmp_path):
    (tmp_path / "a.log").write_text("x\ny\n")
    spark.dataSource.register(TailSource)
    df = spark.readStream.format("tail").option("paths", str(tmp_path / "*.log")).option("from", "start").load()
    q = df.writeStream.format("memory").queryName("tailed").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.line for r in spark.table("tailed").collect()) == ["x", "y"]


def _free_port() -> int:
    with socket.socket() as s:
        s.bind(("127.0.0.1", 0))
        return s.getsockname()[1]


def _send(port: int) -> None:
    with socket.create_connection(("127.0.0.1", port)) as s:
        s.sendall(b"<13>one\r\n<14>two\n")
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.sendto("<15>three\nlines \u00e9".encode(), ("127.0.0.1", port))


def test_syslog_reader_spools_lines_and_datagrams(tmp_path):
    port = _free_port()
    reader = SyslogReader({"spool": str(tmp_path), "protocol": "both", "host": "127.0.0.1", "port": str(port)})
    start = reader.initialOffset()
    _send(port)
    rows: list = []
    for _ in range(100):
        end = reader.latestOffset()
        rows = [r for p in reader.partitions(start, end) for r in reader.read(p)]
        if len(rows) == 3:
            break
        time.sleep(0.1)
    assert sorted(rows) == [("127.0.0.1", "<13>one"), ("127.0.0.1", "<14>two"), ("127.0.0.1", "<15>three\nlines \u00e9")]
    reader.commit(end)
    assert len(os.listdir(tmp_path)) == 1  # the file that is written to stays
    reader.spool.most = 0
    _send(port)
    while len(os.listdir(tmp_path)) < 4:
        time.sleep(0.1)
    reader.commit(end)
    assert not set(os.listdir(tmp_path)) & {os.path.basename(p) for p in end}  # read to its end and no longer written to
    reader.stop()
    with pytest.raises(ValueError):
        SyslogReader({"spool": str(tmp_path), "protocol": "sctp", "port": "0"}).initialOffset()


def test_syslog_as_a_stream(spark, tmp_path):
    spark.dataSource.register(SyslogSource)
    port = _free_port()
    df = spark.readStream.format("syslog").option("spool", str(tmp_path / "s")).option("protocol", "tcp").option("host", "127.0.0.1").option("port", str(port)).load()
    q = df.writeStream.format("memory").queryName("received").option("checkpointLocation", str(tmp_path / "c")).start()
    for _ in range(300):
        try:
            with socket.create_connection(("127.0.0.1", port)) as s:
                s.sendall(b"<13>hello\n")
            break
        except OSError:
            time.sleep(0.1)
    for _ in range(300):
        if spark.table("received").count():
            break
        time.sleep(0.1)
    q.stop()
    assert [tuple(r) for r in spark.table("received").collect()] == [("127.0.0.1", "<13>hello")]


def test_files_and_sinks(spark, tmp_path):
    lines = generated_lines(spark, 50)
    assert lines.count() == 50 and generated_lines(spark, 50).collect() == lines.collect()
    lines.select("line").write.text(str(tmp_path / "t"))
    assert text_lines(spark, str(tmp_path / "t")).count() == 50
    with pytest.raises(ValueError):
        writer_compression("lz4")
    event = spark.sql("SELECT timestamp'2024-01-15 10:30:00' AS timestamp, 'm' AS message, '' AS level, 's' AS source, map('b','2','a','1') AS fields")
    assert event.select(event_json(event)).first()[0] == '{"timestamp":"2024-01-15T10:30:00Z","message":"m","source":"s","fields":{"a":"1","b":"2"}}'
    write_objects(event, str(tmp_path / "o"), "gzip")
    assert (tmp_path / "o" / "year=2024" / "month=01" / "day=15" / "hour=10").is_dir()

    def broken(df, batch):
        raise OSError("down")

    good = text_output(str(tmp_path / "r"))
    send = router({"bad": broken, "good": good})
    send(event, 3)
    assert list(send.failures[0]) == ["bad"] and (tmp_path / "r" / "batch=3").is_dir()
    with pytest.raises(RoutingError):
        router({"bad": broken, "good": good}, parallel=False, on_error="stop")(event, 4)
    assert not (tmp_path / "r" / "batch=4").exists()


def test_retry():
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 4:
            raise OSError
        return "ok"

    assert retry(flaky, wait=waits.append) == "ok" and waits == [0.1, 0.2, 0.4]
    with pytest.raises(KeyError):
        retry(lambda: {}["x"], final=(KeyError,), wait=waits.append)


def test_breaker():
    now = [0.0]
    b = Breaker(trips=2, timeout=10, interval=0, clock=lambda: now[0])
    fail = lambda: 1 / 0
    for _ in range(2):
        with pytest.raises(ZeroDivisionError):
            b.call(fail)
    with pytest.raises(OpenError):
        b.call(lambda: 1)
    now[0] = 11
    assert b.state == "half-open" and b.call(lambda: 5) == 5 and b.state == "closed"
    late = b.allow()
    for _ in range(2):
        with pytest.raises(ZeroDivisionError):
            b.call(fail)
    late(None)
    assert b.state == "open"
    capped = RateCapped(Breaker(clock=lambda: now[0]), 1, 60)
    capped.call(lambda: 1)
    with pytest.raises(OpenError):
        capped.call(lambda: 1)


def test_breaker_states_offline(spark):
    rows = [(1, i, float(t), bad) for i, (t, bad) in enumerate([(0, True), (1, True), (2, False), (20, False), (21, True)])]
    df = spark.createDataFrame(rows, "k int, seq long, ts double, bad boolean")
    found = sorted((r.seq, r.state, r.allowed) for r in breaker_states(df, "k", F.col("bad"), trips=2, timeout=10.0, interval=0.0).collect())
    assert found == [(0, "closed", True), (1, "closed", True), (2, "open", False), (3, "half-open", True), (4, "closed", True)]


def test_specs_are_checked(spark):
    from recordweave.operators.metrics import MetricRule
    from recordweave.operators.transforms import transform

    with pytest.raises(ValueError):
        MetricRule("x", "summary", "f")
    with pytest.raises(ValueError):
        transform(spark.sql("SELECT 'm' AS message, map('a','b') AS fields"), TransformSpec("nope"))
    assert ParserSpec("grok", grok_pattern="java").name == "grok(java)"
