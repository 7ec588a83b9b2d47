import pytest
from pyspark.sql import functions as F

from recordweave.functions.grok import expand
from recordweave.functions.regexes import PatternError, translate
from recordweave.functions.times import java_layout
from recordweave.operators.parsers import DEFAULT, ParserSpec, parse

JSON = ParserSpec("json", time_field="timestamp", level_field="level", message_field="message")


def one(spark, line, spec):
    df = spark.createDataFrame([(line, "s")], "line string, source string").withColumn("ts", F.lit("2024-02-01").cast("timestamp"))
    return parse(df, spec).first()


def test_json_with_configured_fields(spark):
    r = one(spark, '{"timestamp":"2024-01-15T10:30:00Z","level":"INFO","message":"Application started","user":"admin"}', JSON)
    assert (r.message, r.level, r.fields, r.is_error) == ("Application started", "info", {"user": "admin"}, False)
    assert str(r.timestamp) == "2024-01-15 10:30:00"


def test_json_nested_and_scalars(spark):
    r = one(spark, '{"msg":"m","error":{"code":500,"message":"Internal error"},"count":42,"ok":true,"ratio":3.14,"big":1000000,"none":null}', ParserSpec("json"))
    assert r.fields == {"error": "map[code:500 message:Internal error]", "count": "42", "ok": "true", "ratio": "3.14", "big": "1e+06", "none": "<nil>"}


@pytest.mark.parametrize("line,error", [("This is not JSON", False), ("", True), ("[1]", False), (None, True)])
def test_json_fallback(spark, line, error):
    r = one(spark, line, ParserSpec("json", custom_fields={"a": "b"}))
    assert (r.message, r.fields, r.is_error) == (line or "", {}, error)


def test_json_unreadable_time_is_the_zero_time_and_stays(spark):
    df = spark.createDataFrame([('{"timestamp":"soon"}',)], "line string").withColumn("ts", F.lit("2024-02-01").cast("timestamp"))
    r = parse(df, ParserSpec("json", time_field="timestamp")).select(F.col("timestamp").cast("string").alias("t"), "fields").first()
    assert r.t.startswith("0001-01-01") and r.fields == {"timestamp": "soon"}


def test_custom_fields_win(spark):
    assert one(spark, '{"message":"m","user":"alice","env":"x"}', ParserSpec("json", custom_fields={"env": "prod"})).fields == {"user": "alice", "env": "prod"}


def test_default_parser_and_no_match(spark):
    r = one(spark, "2024-01-15T10:30:00Z INFO Application started", DEFAULT)
    assert (r.level, r.message, r.fields) == ("info", "Application started", {})
    r = one(spark, "nomatch", ParserSpec("regex", pattern=r"^(?P<a>\d+)$", custom_fields={"x": "y"}))
    assert (r.message, r.level, r.fields) == ("nomatch", "", {})


def test_groups_with_the_separator_inside(spark):
    r = one(spark, "a\u0001b 1 2 3", ParserSpec("regex", pattern=r"^(?P<w>\S+) (?P<x>\d) (?P<y>\d) (?P<z>\d)$"))
    assert r.fields == {"w": "a\u0001b", "x": "1", "y": "2", "z": "3"}


@pytest.mark.parametrize(
    "name,line,fields",
    [
        ("syslog", "Jan 15 10:30:00 server1 myapp[1234]: Application started successfully", {"program": "myapp", "pid": "1234"}),
        ("java", "2024-01-15T10:30:00.123Z INFO [main] com.example.App - Starting application", {"thread": "main", "logger": "com.example.App"}),
        ("python", "2024-01-15T10:30:00.123Z - myapp.module - ERROR - Database connection failed", {"logger": "myapp.module"}),
    ],
)
def test_grok_templates(spark, name, line, fields):
    r = one(spark, line, ParserSpec("grok", grok_pattern=name))
    assert r.fields == fields and line.endswith(r.message) and not r.is_error


def test_grok_apache_with_a_decimal_version_keeps_the_raw_request(spark):
    r = one(spark, '1.2.3.4 - bob [15/Jan/2024:10:30:00 -0700] "GET /x HTTP/1.0" 200 12', ParserSpec("grok", grok_pattern="apache"))
    assert r.fields["rawrequest"] == "GET /x HTTP/1.0" and r.fields["verb"] == ""


def test_grok_expand():
    assert expand("%{WORD}") == r"\b\w+\b"
    assert expand("%{WORD:action} %{INT:count}") == r"(?P<action>\b\w+\b) (?P<count>(?:[+-]?(?:[0-9]+)))"
    with pytest.raises(KeyError):
        expand("%{UNKNOWN}")


@pytest.mark.parametrize("pattern", [r"(?=a)", r"(a)\1", r"(?<!a)b", r"a++", "[a"])
def test_patterns_of_one_engine_only_are_refused(pattern):
    with pytest.raises(PatternError):
        translate(pattern)


def test_dollar_is_the_end_of_the_text(spark):
    df = spark.createDataFrame([("a\n",), ("a",)], "t string")
    assert [r[0] for r in df.select(F.col("t").rlike(translate("a$").java)).collect()] == [False, True]


def test_layouts():
    assert java_layout("02/Jan/2006:15:04:05 -0700").startswith("dd/MMM/yyyy:HH:mm:ss")


def test_ipv6_in_ip(spark):
    r = one(spark, "::1 up fe80::1:2", ParserSpec("grok", pattern="^%{IP:a} up %{IP:b}$"))
    assert (r.fields["a"], r.fields["b"]) == ("::1", "fe80::1:2")


def test_unknown_parser(spark):
    with pytest.raises(ValueError):
        one(spark, "x", ParserSpec("nope"))


def test_a_filter_or_explode_does_not_copy_the_parse(spark):
    from recordweave.operators.parsers import explode_fields

    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("props AS line", "ts", "event_id AS day")
    for spec, mark in ((ParserSpec("json"), "from_json"), (ParserSpec("regex", pattern=r"^(?P<a>\S+) (?P<b>\S+) (?P<c>\S+)$", level_field="a"), "regexp_replace(__line")):
        out = parse(df, spec)
        for used in (out.where("level = 'error' and size(fields) > 0 and not is_error and day = 7"), explode_fields(out, "raw"), out.selectExpr("explode(fields)")):
            plan = used._jdf.queryExecution().optimizedPlan().toString()
            assert plan.count(mark) == 1, plan[:2000]
    plan = parse(df, ParserSpec("json")).where("day = 5 and level = ''")
    assert "PushedFilters: [IsNotNull(event_id), EqualTo(event_id,5)]" in plan._jdf.queryExecution().toString()


def test_nested_values_of_any_depth(spark):
    line = '{"a":{"z":[1,2.50,{"q":{"r":{"s":[null,true,"x\\"y, {b}"]}}}],"b":1e21},"e":[],"o":{},"n":-0.00001}'
    df = spark.createDataFrame([(line,)], "line string").selectExpr("line", "current_timestamp() AS ts")
    fields = parse(df, ParserSpec("json")).first()["fields"]
    assert fields == {"a": 'map[b:1e+21 z:[1 2.5 map[q:map[r:map[s:[<nil> true x"y, {b}]]]]]]', "e": "[]", "o": "map[]", "n": "-1e-05"}


@pytest.mark.parametrize(("text", "value"), [("0x1p4", 16.0), ("-0X1.8p1", -3.0), ("0x.8p0", 0.5), ("0x1.fffffffffffffp1023", 1.7976931348623157e308), ("0x1p-1074", 5e-324), ("0x10", None), ("0xp1", None), ("0x0p9", 0.0)])
def test_hexadecimal_numbers(spark, text, value):
    from recordweave.functions.values import parse_float

    assert spark.createDataFrame([(text,)], "t string").select(parse_float(F.col("t"))).first()[0] == value


@pytest.mark.parametrize("pattern", [r"^\S+ end$", r"[[:alpha:]]+\d", r"(?i)START", r"a\z", r"\bx\b", r"[^\s]x"])
def test_streams_match_as_batches_do(spark, pattern):
    from recordweave.functions.regexes import compile_python, matches, translate

    texts = ["one end", "one end\n", "é end", "é1", "b1", "start", "START", "a", "a\n", "éxé", "x", "\x0bx", " x", "\xa0x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    batch = [r[0] for r in df.select(matches(F.col("t"), translate(pattern))).collect()]
    assert [compile_python(pattern).search(t) is not None for t in texts] == batch


def test_exposition_text(spark):
    from recordweave.operators.metrics import MetricRule, extract, prometheus_text, type_lines

    df = spark.createDataFrame([({"d": "3", "k": 'a"b\\c\nd'},), ({"d": "30000000", "k": 'a"b\\c\nd'},)], "fields map<string,string>").selectExpr("fields", "1L AS timestamp", "1L AS seq")
    rules = [MetricRule("d", "histogram", "d", label_fields={"kind": "k"}, buckets=(10.0, 1e7))]
    label = 'kind="a\\"b\\\\c\\nd"'
    assert sorted(r[0] for r in prometheus_text(extract(df, rules)).collect()) == sorted([
        f'extracted_d_bucket{{{label},le="10"}} 1', f'extracted_d_bucket{{{label},le="1e+07"}} 1', f'extracted_d_bucket{{{label},le="+Inf"}} 2', f"extracted_d_sum{{{label}}} 3.0000003e+07", f"extracted_d_count{{{label}}} 2",
    ])
    assert type_lines(rules)[-1] == "# TYPE extracted_d histogram"


def test_parser_counts(spark):
    from recordweave.operators.parsers import parser_stats

    df = spark.createDataFrame([("x y z",), ("",)], "line string").selectExpr("line", "current_timestamp() AS ts")
    assert parser_stats(parse(df)).first().asDict() == {"parsed": 1, "failed": 1}


def test_secrets_and_jitter(tmp_path, monkeypatch):
    import random

    from recordweave.functions.checks import jittered, secret

    monkeypatch.setenv("RW_TEST", "v")
    (tmp_path / "s").write_text(" hidden \n")
    assert [secret("env:RW_TEST"), secret(f"file:{tmp_path / 's'}"), secret("plain")] == ["v", "hidden", "plain"]
    with pytest.raises(KeyError):
        secret("env:RW_NOT_SET")
    waits = [jittered(10.0, random.Random(i)) for i in range(200)]
    assert 9 <= min(waits) < 9.3 and 10.7 < max(waits) <= 11
