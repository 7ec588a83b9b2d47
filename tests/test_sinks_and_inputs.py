"""Repeatable sinks, partitions by hash, selectors, configured inputs, batches and quantiles of streams."""

import gzip
import json
import os
import random
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from recordweave.functions.hashes import fnv1a_32, hash_partition
from recordweave.functions.selectors import SelectorError, label_selector, terms
from recordweave.operators import metrics as M
from recordweave.operators.batches import batches_by_bytes
from recordweave.operators.delivery import halving_mean
from recordweave.operators.inputs import select_pods
from recordweave.plans import config as C
from recordweave.sources.inputs import expanded
from recordweave.sources.objects import read_manifest, write_batches
from recordweave.sources.sinks import deliver_bulk, topic_rows
from recordweave.streaming.stateful import batched_stream


def test_fnv_is_the_published_hash(spark):
    known = {"": 0x811C9DC5, "a": 0xE40C292C, "foobar": 0xBF9CF968}
    draw = random.Random(4)
    texts = [*known, *("".join(draw.choice("ab äß𝄞\0") for _ in range(draw.randint(1, 40))) for _ in range(60)), None]

    def plain(text):
        h = 0x811C9DC5
        for b in text.encode():
            h = (h ^ b) * 0x01000193 % (1 << 32)
        return h

    def dealt(text):
        h = plain(text)
        return abs((h - (1 << 32) if h >= 1 << 31 else h)) % 7  # the remainder keeps the sign, which goes

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: (r.h, r.p) for r in df.select("t", fnv1a_32(F.col("t")).alias("h"), hash_partition(F.col("t"), 7).alias("p")).collect()}
    assert got[None] == (None, None) and all(got[t][0] == h for t, h in known.items())
    assert all(got[t] == (plain(t), dealt(t)) for t in texts if t is not None)


def _events(spark, n, times=lambda i: i):
    rows = [(i, f"m{i}", times(i)) for i in range(n)]
    return spark.createDataFrame(rows, "seq long, message string, t long").select("seq", F.timestamp_seconds(F.col("t") + 1_704_103_200).alias("timestamp"), "message", F.create_map(F.lit("k"), F.col("message")).alias("fields"))


def test_no_partition_without_a_key(spark):
    got = topic_rows(_events(spark, 3), "t", key_field="none", partitions=5).collect()
    assert [r.partition for r in got] == [None] * 3


def _objects(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names if "_manifests" not in d and not f.endswith(".crc"))


def test_a_repeated_run_leaves_the_same_objects(spark, tmp_path):
    path = str(tmp_path / "out")
    e = _events(spark, 25, lambda i: i // 10).withColumn("batch", F.floor(F.col("seq") / 5))
    for _ in range(2):
        write_batches(e, path, "batch-0", "{{.Hour}}/{{.Timestamp}}.json", "p/", "gzip")
        assert _objects(path) == [f"p/10/{1_704_103_200 + t}{n}.json.gz" for t, n in [(0, "-1"), (0, ""), (1, "-1"), (1, ""), (2, "")]]
    first = gzip.decompress((tmp_path / "out/p/10/1704103200-1.json.gz").read_bytes()).decode().splitlines()
    assert [json.loads(x)["message"] for x in first] == [f"m{i}" for i in range(5, 10)]
    assert sum(x["lines"] for x in read_manifest(path, "batch-0")) == 25
    # the run again with fewer events: what it no longer writes goes; other runs stay
    write_batches(e.withColumn("batch", F.col("batch") + 100), path, "batch-1", "other/{{.Timestamp}}.json")
    write_batches(e.where("seq < 5"), path, "batch-0", "{{.Hour}}/{{.Timestamp}}.json", "p/", "gzip")
    assert [x for x in _objects(path) if x.startswith("p/")] == ["p/10/1704103200.json.gz"] and len(_objects(path)) == 6


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    e = _events(spark, 40).withColumn("batch", F.floor(F.col("seq") / 10))
    bad = e.withColumn("message", F.when(F.col("seq") == 35, F.raise_error(F.lit("broken"))).otherwise(F.col("message")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        write_batches(bad, path, "batch-0")
    assert not os.path.exists(f"{path}/_manifests/batch-0.json") and _objects(path) == []
    write_batches(e, path, "batch-0")
    before = _objects(path)
    with pytest.raises(Exception, match="broken"):
        write_batches(bad, path, "batch-0")
    assert len(before) == 4 and _objects(path) == before and len(read_manifest(path, "batch-0")) == 4


class Engine:
    """Answers bulk requests: 400 for some messages, 503 for some on their first try."""

    def __init__(self, bad=(), later=()):
        engine, self.seen, self.held = self, [], {}

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):  # noqa: N802
                said = self.rfile.read(int(self.headers["Content-Length"])).decode().strip().split("\n")
                items = []
                for action, doc in zip(said[::2], said[1::2], strict=True):
                    action, doc = json.loads(action)["index"], json.loads(doc)
                    again = doc["message"] in engine.seen
                    engine.seen.append(doc["message"])
                    status = 400 if doc["message"] in bad else 503 if doc["message"] in later and not again else 201
                    if status == 201:
                        engine.held[action.get("_id", len(engine.seen))] = doc
                    items.append({"index": {"status": status} | ({"error": {"type": "no"}} if status != 201 else {})})
                body = json.dumps({"items": items}).encode()
                self.send_response(200)
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *args):
                pass

        self.server = HTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.address = f"http://127.0.0.1:{self.server.server_port}"


def test_only_what_may_pass_later_is_sent_again(spark, tmp_path):
    engine = Engine(bad=("m3", "m4"), later=("m5",))
    letters = str(tmp_path / "letters")
    try:
        for _ in range(2):  # a batch that comes again
            assert deliver_bulk(_events(spark, 8), "7", [engine.address], "logs", batch=3, identity=("seq",), dead_letters=letters, wait=0.01) == 2
        assert len(engine.held) == 6 and engine.seen.count("m3") == 2 and engine.seen.count("m5") == 3
        found = spark.read.json(letters).collect()
        assert sorted(json.loads(r.body.split("\n")[1])["message"] for r in found) == ["m3", "m4"] and {r.status for r in found} == {400}
        with pytest.raises(RuntimeError, match="refused"):
            deliver_bulk(_events(spark, 8), "8", [engine.address], "logs", identity=("seq",), wait=0.01)
        with pytest.raises(RuntimeError, match="not accepted"):
            deliver_bulk(_events(spark, 2), "9", ["http://127.0.0.1:9"], "logs", attempts=2, wait=0.01)
    finally:
        engine.server.shutdown()


def test_selectors(spark):
    assert terms("a=b, c!=d,e in (x, y) ,f notin(z),!g, h/i.j ,k==") == [("a", "in", ("b",)), ("c", "notin", ("d",)), ("e", "in", ("x", "y")), ("f", "notin", ("z",)), ("g", "absent", ()), ("h/i.j", "exists", ()), ("k", "in", ("",))]
    for bad in ("a=b=c", "in (x)", "a in x", "a=b,", "!", "a b", "-a", "a in (b c)"):
        with pytest.raises(SelectorError):
            terms(bad)
    df = spark.createDataFrame([(0, {"a": "b"}), (1, {"a": "c", "old": ""}), (2, {}), (3, None)], "id int, labels map<string,string>")
    picked = lambda s: [r.id for r in df.where(label_selector(F.col("labels"), s)).orderBy("id").collect()]
    assert picked("") == [0, 1, 2, 3] and picked("a") == [0, 1] and picked("a!=b") == [1, 2, 3] and picked("a in (b,c),!old") == [0] and picked("a notin (b)") == [1, 2, 3] and picked("old=") == [1]


def test_pods_need_known_fields_and_runs(spark):
    rows = spark.createDataFrame([("n", "p", "c", "Running", {"a": "b"}, 1)], "namespace string, pod string, container string, phase string, labels map<string,string>, seq long")
    assert select_pods(rows, fields="metadata.name=p,status.phase!=Failed").count() == 1 and select_pods(rows, fields="metadata.name!=p").count() == 0
    for bad in ("spec.nodeName=x", "metadata.name"):
        with pytest.raises(SelectorError):
            select_pods(rows, fields=bad)
    with pytest.raises(ValueError, match="runs"):
        select_pods(rows, previous=True)


def test_unset_variables_are_empty():
    assert expanded("a ${X} $Y-$1 $ $$ ${ ${} ^x$", {"X": "1", "Y": "2"}) == "a 1 2- $   ^x$"
    os.environ.pop("NOT_SET_HERE", None)
    with pytest.raises(C.ConfigError):
        C.loads("inputs: {syslog: [{name: n, address: '${NOT_SET_HERE}'}]}")


CONFIGURATION = """
inputs:
  files: [{{name: logs, paths: ['{0}/logs/*.log'], from: start, parser: {{type: regex, pattern: '^S(?P<id>[0-9]+)', multiline: {{pattern: '^S', timeout: 1h}}}}}}]
  http: [{{name: web, address: ':1', landing: '{0}/web', batch_path: /many}}]
  kubernetes: [{{landing: '{0}/pods', tail_lines: 2, label_selector: app=x}}]
parser: {{type: json}}
transforms: [{{type: add, add: {{site: here}}}}]
output: {{type: multi, multi: {{outputs: [{{name: f, type: file, path: '{0}/out'}}, {{name: o, type: s3, s3: {{bucket: b, path: '{0}/objects', batch_size: 3}}}}]}}}}
"""


@pytest.fixture
def landed(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text("S1\n more\nS2\n")
    (tmp_path / "logs" / "b.log").write_text("S3\n")
    web = [("POST", "/logs", '{"message":"one","n":1}', "r", None, None, None), ("POST", "/many", '[{"message":"two"},{"message":"three"}]', "r", None, None, None), ("GET", "/logs", "x", "r", None, None, None)]
    spark.createDataFrame(web, "method string, path string, body string, remote_addr string, user_agent string, api_key string, authorization string").write.parquet(f"{tmp_path}/web")
    pods = [("n", "p", "c", "Running", {"app": "x" if i < 5 else "y"}, None, '{"message":"pod %d"}' % i, i) for i in range(6)]
    spark.createDataFrame(pods, "namespace string, pod string, container string, phase string, labels map<string,string>, annotations map<string,string>, message string, seq long").write.parquet(f"{tmp_path}/pods")
    return tmp_path


def test_a_configuration_from_inputs_to_outputs(spark, landed):
    config = C.loads(CONFIGURATION.format(landed))
    events = C.read(spark, config)
    got = sorted((r.input, r.message, r.fields.get("id"), r.fields["site"], r.fields.get("input_type")) for r in events.collect())
    assert got == [
        ("kubernetes-0", "pod 3", None, "here", "kubernetes"), ("kubernetes-0", "pod 4", None, "here", "kubernetes"),
        ("logs", "S1\n more", "1", "here", None), ("logs", "S2", "2", "here", None), ("logs", "S3", "3", "here", None),
        ("web", "one", None, "here", "http"), ("web", "three", None, "here", "http"), ("web", "two", None, "here", "http"),
    ]
    assert {r.source.rpartition("/")[2] for r in events.collect()} == {"web", "kubernetes-0", "a.log", "b.log"}
    send = C.outputs(config)
    for _ in range(2):
        send(events, 0)
    assert send.failures == [{}, {}] and spark.read.text(f"{landed}/out/batch=0").count() == 8
    held = read_manifest(f"{landed}/objects", "batch-0")
    assert sum(x["lines"] for x in held) == 8 and sorted(x["key"] for x in held) == _objects(f"{landed}/objects")


def test_inputs_as_streams(spark, landed):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    config = C.loads(CONFIGURATION.format(landed))
    q = C.read(spark, config, stream=True).writeStream.format("memory").queryName("from_inputs").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{landed}/c").start()
    q.awaitTermination(120)
    got = {(r.input, r.message) for r in spark.table("from_inputs").collect()}
    assert {("web", "two"), ("kubernetes-0", "pod 0"), ("kubernetes-0", "pod 4"), ("logs", "S1\n more")} <= got and ("kubernetes-0", "pod 5") not in got


def test_names_of_inputs_are_told_apart():
    for bad in ("inputs: {pigeon: [{}]}", "inputs: {files: [{name: a, paths: [x]}, {name: a, paths: [y]}]}", "inputs: {http: [{name: w}]}", "inputs: {files: [{paths: []}]}"):
        with pytest.raises(C.ConfigError):
            C.loads(bad)


def test_open_batches_leave_at_a_tick(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [("a", i, "x" * (i % 5)) for i in range(23)] + [("b", 100 + i, None) for i in range(3)]
    df = spark.createDataFrame(rows, "by string, seq long, raw string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = batched_stream(stream, 5, 9, 1.0).writeStream.format("memory").queryName("batched").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for _ in range(240):
            got = spark.table("batched").collect()
            if sum(r.n for r in got) == len(rows):
                break
            time.sleep(0.25)
    finally:
        q.stop()
    want = batches_by_bytes(df, 9, 5, "by").collect()  # all came in one micro-batch, before a tick
    assert sorted((r.by, r.n, r.bytes, r.first_seq, r.last_seq) for r in got) == sorted((r.by, r.n, r.bytes, r.first_seq, r.last_seq) for r in want)
    assert [r.reason for r in got if r.by == "b"] == ["tick"] and {r.reason for r in got if r.n == 5} == {"full"}
    assert all("".join(r.events) == "".join("x" * (i % 5) for i in range(r.first_seq, r.last_seq + 1)) for r in got if r.by == "a")


def test_quantiles_of_a_stream_are_those_of_the_table(spark, tmp_path):
    draw = random.Random(6)
    rows = [(i * 7, str(draw.choice([0.5, 3, 7, 40, 99, 600])), draw.choice(["GET", "POST"])) for i in range(400)] + [(100_000, "1", "GET")]
    df = spark.createDataFrame(rows, "t long, v string, m string").select(F.timestamp_seconds("t").alias("timestamp"), F.create_map(F.lit("v"), F.col("v"), F.lit("m"), F.col("m")).alias("fields"))
    df.write.parquet(str(tmp_path / "in"))
    rule = M.MetricRule("v", "histogram", "v", label_fields={"method": "m"}, buckets=(1.0, 5.0, 10.0, 50.0, 100.0))
    want = {tuple(r) for r in M.windowed_quantiles(df, rule, by=("method",)).collect()}
    stream = M.windowed_quantiles(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), rule, by=("method",), late="1 minute")
    q = stream.writeStream.format("memory").queryName("quantiles").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.table("quantiles").collect()}
    assert got == {w for w in want if w[1].year == 1970 and w[1].timestamp() < 90_000} and len(got) >= 18


def test_quantiles_at_the_edges(spark):
    rule = M.MetricRule("v", "histogram", "v", buckets=(10.0, 20.0))
    rows = spark.createDataFrame([(0, "30"), (1, "40"), (400, "5"), (401, "x"), (402, "15")], "t long, v string").select(F.timestamp_seconds("t").alias("timestamp"), F.create_map(F.lit("v"), F.col("v")).alias("fields"))
    got = {r.window_start.minute: (r.p50, r.p99, r.p0) for r in M.windowed_quantiles(rows, rule, qs=(0.5, 0.99, 0.0)).collect()}
    assert got[0] == (20.0, 20.0, 0.0) and got[5] == (10.0, pytest.approx(19.8), 0.0)


def test_counters_that_start_anew(spark):
    samples = [("a", 15 * i, v) for i, v in enumerate([10, 20, 5, 15, 2])] + [("b", 0, 7.0), ("c", 0, None), ("c", 10, 1), ("c", 20, 3), ("c", 20, 2), ("d", 290, 4), ("d", 295, 9)]
    df = spark.createDataFrame([(s, t, None if v is None else float(v)) for s, t, v in samples], "s string, t long, value double").withColumn("ts", F.timestamp_seconds("t"))
    got = {r.s: r.increase for r in M.counter_rate(df, by=("s",)).collect()}
    # a: last less first is -8, and 20 and 15 were lost: 27 in 60 s; it starts at the edge and is carried on for half of 15 s
    assert got["a"] == pytest.approx(27 * (60 + 7.5) / 60)
    # c: 2 in 10 s from 10 to 20; at the start no further than to 0 (5 s), at the end 5 s
    assert got["c"] == pytest.approx(2 * 20 / 10)
    assert got["d"] == pytest.approx(5 * (5 + 2.5 + 5) / 5) and "b" not in got


def test_halving_mean_is_the_fold(spark):
    draw = random.Random(9)
    rows, want = [], {}
    for key, n in (("a", 1), ("b", 7), ("c", 1500), ("z", 4)):
        values = [0.0 if key == "z" or (key == "b" and i < 2) else draw.randint(0, 400) / 4 for i in range(n)]
        mean = 0.0
        for x in values:
            mean = x if mean == 0 else (mean + x) / 2
        rows += [(key, i, x) for i, x in enumerate(values)]
        want[key] = mean
    got = {r.k: r["mean"] for r in halving_mean(spark.createDataFrame(rows, "k string, seq long, x double"), "k", "x", "seq").collect()}
    assert got == {k: pytest.approx(v, rel=1e-12) for k, v in want.items()}


@pytest.mark.parametrize("piece", [1, 3, 7, 1000])
def test_a_long_backlog_is_read_in_pieces(tmp_path, piece):
    from recordweave.sources.tail import TailReader

    lines = ["", "a", "bc", "", "long line äö", "x" * 20, "", "end"]
    (tmp_path / "a.log").write_bytes("\n".join([*lines, "open"]).encode())
    reader = TailReader({"paths": str(tmp_path / "*.log"), "from": "start", "piece_bytes": str(piece)})
    pieces = reader.partitions(reader.initialOffset(), reader.latestOffset())
    got = [row for p in pieces for row in reader.read(p)]
    assert [r[2] for r in got] == lines and [r[1] for r in got] == [len("\n".join([*lines[:i], ""]).encode()) for i in range(len(lines))]
    assert len(pieces) == -(-len(("\n".join(lines) + "\n").encode()) // piece)
