"""Configurations as plans and outputs, observed series, bulk requests."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from recordweave.plans import config as C
from recordweave.sources.sinks import send_bulk, topic_rows
from recordweave.streaming.observed import PipelineSeries, counted, observed, timed

TEXT = """
inputs: {{files: [{{paths: [/tmp/x]}}]}}
parser: {{type: regex, pattern: '^START (?P<id>\\d+)', multiline: {{pattern: '^START', timeout: 1h, max_lines: 10}}}}
metrics: {{enabled: true, extraction: {{enabled: true, rules: [{{name: ids, type: counter, field: id}}, {{name: h, type: histogram, field: id, buckets: [1, 10]}}]}}}}
output: {{type: multi, multi: {{parallel: true, failure_strategy: continue, outputs: [{{name: a, type: file, path: '{0}/a'}}, {{name: b, type: s3, s3: {{bucket: x, path: '{0}/b', compression: gzip, key_template: '{{{{.Year}}}}/{{{{.Hour}}}}/x.json'}}}}, {{name: c, type: elasticsearch, elasticsearch: {{addresses: ['http://127.0.0.1:9'], index: i}}}}]}}}}
"""


def test_configuration_to_outputs(spark, tmp_path):
    config = C.loads(TEXT.format(tmp_path))
    rows = [(1, "START 5"), (2, " more"), (3, "START 7"), (4, " tail")]
    lines = spark.createDataFrame(rows, "seq long, line string").selectExpr("seq", "line", "timestamp'2024-01-01 10:00:00' AS ts", "'s' AS source")
    events = C.plan(lines, config)
    assert sorted((r.fields["id"], r.raw) for r in events.collect()) == [("5", "START 5\n more"), ("7", "START 7\n tail")]
    found = {(r.metric, r.le): r.value for r in C.metrics(events.withColumn("seq", F.lit(1)), config).collect()}
    assert found["extracted_ids", None] == 12 and found["extracted_h", 10.0] == 2 and found["extracted_h_sum", None] == 12
    send = C.outputs(config)
    send(events, 0)
    assert list(send.failures[0]) == ["c"], send.failures  # nobody answers there
    assert spark.read.text(f"{tmp_path}/a/batch=0").count() == 2 and spark.read.text(f"{tmp_path}/b/2024/10").count() == 2


@pytest.mark.parametrize(("text", "value"), [("5s", 5), ("1m30s", 90), ("250ms", 0.25), (3, 3)])
def test_durations(text, value):
    assert C.seconds(text) == value


def test_bad_configurations():
    with pytest.raises(C.ConfigError):
        C.seconds("soon")
    with pytest.raises(C.ConfigError):
        C.output({"type": "pigeon"})


def _events(spark, n):
    return spark.range(n).selectExpr("timestamp'2024-01-01 00:00:00' AS timestamp", "concat('m', id) AS message", "'' AS level", "map('k', string(id)) AS fields", "'raw' AS raw")


def test_partition_strategies(spark):
    e = _events(spark, 40)
    assert topic_rows(e, "t").columns == ["topic", "key", "value"]
    assert {r.partition for r in topic_rows(e, "t", strategy="manual", partitions=3, partition_field="k").collect()} == {0, 1, 2}
    assert all(0 <= r.partition < 4 for s in ("random", "round-robin") for r in topic_rows(e, "t", strategy=s, partitions=4).collect())
    with pytest.raises(ValueError, match="unknown"):
        topic_rows(e, "t", strategy="other")


def test_bulk_items_have_their_own_status(spark):
    class Engine(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            lines = self.rfile.read(int(self.headers["Content-Length"])).decode().strip().split("\n")
            docs = [json.loads(x) for x in lines[1::2]]
            items = [{"index": {"status": 400, "error": {"type": "refused"}} if d["message"] == "m3" else {"status": 201}} for d in docs]
            body = json.dumps({"errors": True, "items": items}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Engine)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        found = send_bulk(_events(spark, 10).coalesce(1), [f"http://127.0.0.1:{server.server_port}"], "logs", batch=4).collect()
    finally:
        server.shutdown()
    assert len(found) == 10 and [json.loads(r.body.split("\n")[1])["message"] for r in found if r.status == 400] == ["m3"]
    assert all(r.error is None for r in found if r.status == 201)


def test_series_of_a_stream(spark, tmp_path):
    from recordweave.operators.parsers import parse

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.txt").write_text("2024-01-01T00:00:00Z INFO hello\n\nplain\n")
    series = PipelineSeries()
    spark.streams.addListener(series)
    try:
        lines = spark.readStream.text(str(tmp_path / "in")).selectExpr("value AS line", "current_timestamp() AS ts")
        lines = counted(lines, "input_dropped", F.col("line") == "", "files", "file", "empty")
        events = observed(timed(observed(lines, "input", "files", "file", text="line"), parse, "regex"), "parser", "regex")
        query = observed(events, "output", "memory", "memory").writeStream.format("memory").queryName("observed_rows").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(60)
        for _ in range(100):
            if any(x.startswith("output_duration_seconds_count") for x in series.lines()):
                break
            threading.Event().wait(0.1)
    finally:
        spark.streams.removeListener(series)
    said = series.lines("p_")
    for line in ('p_input_events_received_total{input_name="files",input_type="file"} 3', 'p_parser_events_processed_total{parser_type="regex"} 2', 'p_parser_events_failed_total{parser_type="regex"} 1', 'p_output_events_sent_total{output_name="memory",output_type="memory"} 3'):
        assert line in said, said
    assert 'p_input_events_dropped_total{input_name="files",input_type="file",reason="empty"} 1' in said
    buckets = [x for x in said if x.startswith('p_parser_duration_seconds_bucket{parser_type="regex",le="')]
    counts = [int(x.rpartition(" ")[2]) for x in buckets]
    assert len(buckets) == 16 and counts == sorted(counts) and counts[-1] == 3 and 'p_parser_duration_seconds_count{parser_type="regex"} 3' in said
    took = next(float(x.rpartition(" ")[2]) for x in said if x.startswith("p_parser_duration_seconds_sum"))
    assert 0 < took < 60
    with pytest.raises(ValueError, match="labels"):
        observed(events, "input", "only one")


def test_gauges_are_what_was_said_last(spark):
    from pyspark.sql import Observation

    series = PipelineSeries()
    for n in (5, 2):
        table, now = Observation("table"), Observation("now")
        rows = observed(observed(_events(spark, n), "dlq_table", observation=table), "dlq", observation=now)
        counted(rows, "output_refused", F.col("message") == "m1", "o", "s3", "full").collect()
        series.report("dlq_table", table.get)
        series.report("dlq", now.get)
    assert series.lines() == ["dlq_events_written_total 7", "dlq_size_bytes 6"]
    with pytest.raises(ValueError, match="labels"):
        counted(rows, "input_dropped", F.lit(True), "a")
