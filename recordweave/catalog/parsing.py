"""Parsing: JSON, regular expressions, grok, timestamps, multi-line records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.grok import BASE, compile_grok
from ..functions.regexes import matches
from ..functions.times import infer_time
from ..operators.blocks import ROWS
from ..operators.multiline import MultilineSpec, assemble
from ..operators.parsers import DEFAULT, ParserSpec, event_json, explode_fields, normal_level, parse
from .common import ID, LEVEL, NORMAL, NUMBER, UPPER, USER, duck_line, duck_lines, events, lines, register, spark_line

JSON_LINE = f"""'{{{{"ts":"' || {{iso}} || '","level":"' || {LEVEL} || '","msg":"event ' || {ID} || '","user":"u' || {USER} || '","type":"' || event_type || '","k":' || CAST({NUMBER} AS STRING) || '}}}}'"""
JSON = ParserSpec("json", time_field="ts", time_format="2006-01-02T15:04:05Z07:00")


@register("json_level_counts", f"SELECT {NORMAL} AS level, count(*) AS n FROM events GROUP BY 1")
def json_level_counts(spark, sf_dir):
    return parse(lines(spark, sf_dir, JSON_LINE), JSON).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@register(
    "json_fields_long",
    f"""WITH l AS ({duck_lines(JSON_LINE)}), f AS (
  SELECT event_id, unnest(['user', 'type', 'k', 'env']) AS key, unnest([json_extract_string(line, '$.user'), json_extract_string(line, '$.type'), json_extract_string(line, '$.k'), 'prod']) AS value FROM l)
SELECT * FROM f""",
)
def json_fields_long(spark, sf_dir):
    spec = ParserSpec("json", time_field="ts", custom_fields={"env": "prod"})
    return explode_fields(parse(lines(spark, sf_dir, JSON_LINE), spec), "event_id")


_BAD = f"CASE WHEN event_id % 7 = 0 THEN 'broken ' || {JSON_LINE} WHEN event_id % 7 = 1 THEN '[' || {ID} || ']' WHEN event_id % 7 = 2 THEN '' ELSE {JSON_LINE} END"


@register(
    "json_fallback",
    f"SELECT event_id, CASE WHEN event_id % 7 > 2 THEN 'event ' || {ID} ELSE line END AS message, CASE WHEN event_id % 7 > 2 THEN {NORMAL} ELSE '' END AS level, line = '' AS is_error FROM ({duck_lines(_BAD, 'event_type')})",
)
def json_fallback(spark, sf_dir):
    return parse(lines(spark, sf_dir, _BAD), JSON).select("event_id", "message", "level", "is_error")


_PROBE = f"""CASE event_id % 4 WHEN 0 THEN '{{{{"severity":"ERROR","text":"t' || {ID} || '"}}}}' WHEN 1 THEN '{{{{"log_level":"WARN","severity":3,"log":"l' || {ID} || '","msg":""}}}}'
 WHEN 2 THEN '{{{{"level":"Info","severity":"ERROR","message":"m' || {ID} || '","text":"x"}}}}' ELSE '{{{{"n":' || {ID} || '}}}}' END"""


@register(
    "json_probe_order",
    f"""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'warn' WHEN 2 THEN 'Info' ELSE '' END AS level,
 COALESCE(nullif(json_extract_string(line, '$.msg'), ''), nullif(json_extract_string(line, '$.message'), ''), nullif(json_extract_string(line, '$.text'), ''), nullif(json_extract_string(line, '$.log'), ''), line) AS message
FROM ({duck_lines(_PROBE)})""",
)
def json_probe_order(spark, sf_dir):
    return parse(lines(spark, sf_dir, _PROBE), ParserSpec("json")).select("event_id", "level", "message")


_NESTED = f"""'{{{{"msg":"m","error":{{{{"message":"Internal error","code":' || CAST(event_id % 1000 AS STRING) || '}}}},"list":[1,"x",null,true],"none":null,"ratio":3.50,"one":1.0}}}}'"""


@register(
    "json_nested_text",
    """SELECT event_id, unnest(['error', 'list', 'none', 'ratio', 'one']) AS key, unnest(['map[code:' || (event_id % 1000) || ' message:Internal error]', '[1 x <nil> true]', '<nil>', '3.5', '1']) AS value FROM events""",
)
def json_nested_text(spark, sf_dir):
    return explode_fields(parse(lines(spark, sf_dir, _NESTED), ParserSpec("json")), "event_id")


_REGEX_LINE = f"CASE WHEN event_id % 11 = 0 THEN 'no match here ' || {ID} ELSE {{iso}} || ' [' || {UPPER} || '] user=' || {USER} || ' event ' || {ID} END"
_REGEX = r"^(?P<time>\S+) \[(?P<level>[A-Z]+)\] user=(?P<user_id>\d+) (?P<message>.*)$"


def _duck_group(i: int, pattern: str, text: str = "line") -> str:
    return f"regexp_extract({text}, '{pattern}', {i})"


_RX = r"^(\S+) \[([A-Z]+)\] user=(\d+) (.*)$"


@register(
    "regex_named",
    f"""WITH l AS ({duck_lines(_REGEX_LINE)}) SELECT event_id, CASE WHEN regexp_matches(line, '{_RX}') THEN {_duck_group(4, _RX)} ELSE line END AS message,
 CASE {_duck_group(2, _RX)} WHEN 'WARNING' THEN 'warn' ELSE lower({_duck_group(2, _RX)}) END AS level, nullif({_duck_group(3, _RX)}, '') AS user_id,
 strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM l""",
)
def regex_named(spark, sf_dir):
    spec = ParserSpec("regex", pattern=_REGEX, time_field="time", level_field="level", message_field="message")
    out = parse(lines(spark, sf_dir, _REGEX_LINE), spec)
    return out.select("event_id", "message", "level", F.try_element_at("fields", F.lit("user_id")).alias("user_id"), F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"))


@register("regex_nomatch", f"SELECT event_id, line AS message FROM ({duck_lines(_REGEX_LINE)}) WHERE event_id % 11 = 0")
def regex_nomatch(spark, sf_dir):
    spec = ParserSpec("regex", pattern=_REGEX, time_field="time", level_field="level", message_field="message", custom_fields={"env": "prod"})
    return parse(lines(spark, sf_dir, _REGEX_LINE), spec).where(F.size("fields") == 0).select("event_id", "message")


_OPTIONAL_LINE = f"CASE WHEN event_id % 2 = 0 THEN 'job ' || {ID} || ' took ' || CAST({NUMBER} AS STRING) || 'ms' ELSE 'job ' || {ID} END"


@register(
    "regex_optional_group",
    f"SELECT event_id, CAST(event_id AS VARCHAR) AS job, CASE WHEN event_id % 2 = 0 THEN {NUMBER}::VARCHAR ELSE '' END AS took FROM events",
)
def regex_optional_group(spark, sf_dir):
    spec = ParserSpec("regex", pattern=r"^job (?P<job>\d+)(?: took (?P<took>\d+)ms)?$")
    out = parse(lines(spark, sf_dir, _OPTIONAL_LINE), spec)
    return out.select("event_id", F.col("fields")["job"].alias("job"), F.col("fields")["took"].alias("took"))


@register("default_parser", f"SELECT event_id, {NORMAL} AS level, 'event ' || event_id AS message, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events")
def default_parser(spark, sf_dir):
    out = parse(lines(spark, sf_dir, f"{{iso}} || ' ' || {LEVEL} || ' event ' || {ID}"), DEFAULT)
    return out.select("event_id", "level", "message", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"))


_TIMES = "CASE event_id % 8 WHEN 0 THEN {iso} WHEN 1 THEN {plain} WHEN 2 THEN {plain} || '.250' WHEN 3 THEN {slash} WHEN 4 THEN {words} WHEN 5 THEN {http} || ' -0700' WHEN 6 THEN {http} ELSE 'yesterday' END"


@register(
    "ts_inference",
    """SELECT event_id, CASE WHEN event_id % 8 IN (0, 1, 3, 4) THEN strftime(ts, '%Y-%m-%d %H:%M:%S.000') WHEN event_id % 8 = 2 THEN strftime(ts, '%Y-%m-%d %H:%M:%S.250')
 WHEN event_id % 8 = 5 THEN strftime(ts + INTERVAL 7 HOUR, '%Y-%m-%d %H:%M:%S.000') END AS at FROM events""",
)
def ts_inference(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", F.date_format(infer_time(F.expr(spark_line(_TIMES))), "yyyy-MM-dd HH:mm:ss.SSS").alias("at"))


_SPELLINGS = ("DEBUG", "debug", "TRACE", "trace", "INFO", "info", "information", "INFORMATION", "WARN", "warn", "WARNING", "warning", "ERROR", "error", "ERR", "err", "FATAL", "fatal", "CRITICAL", "critical", "PANIC", "panic", "Info", "unknown")
_SPELLED = "element_at(array({}), CAST(event_id % {} AS INT) + 1)".format(", ".join(f"'{s}'" for s in _SPELLINGS), len(_SPELLINGS))


@register(
    "level_normalize",
    """WITH s AS (SELECT event_id, ([{}])[event_id % {} + 1] AS spelled FROM events)
SELECT spelled, CASE WHEN lower(spelled) IN ('debug', 'trace') THEN 'debug' WHEN spelled = 'Info' THEN 'Info' WHEN lower(spelled) IN ('info', 'information') THEN 'info' WHEN lower(spelled) IN ('warn', 'warning') THEN 'warn'
 WHEN lower(spelled) IN ('error', 'err') THEN 'error' WHEN lower(spelled) IN ('fatal', 'critical', 'panic') THEN 'fatal' ELSE spelled END AS level, count(*) AS n FROM s GROUP BY ALL""".format(", ".join(f"'{s}'" for s in _SPELLINGS), len(_SPELLINGS)),
)
def level_normalize(spark, sf_dir):
    s = events(spark, sf_dir).select(F.expr(_SPELLED).alias("spelled"))
    return s.groupBy("spelled", normal_level(F.col("spelled")).alias("level")).agg(F.count(F.lit(1)).alias("n"))


def _grok_query(name: str, template: str, expression: str, fields: dict[str, str], spec: ParserSpec | None = None):
    """``fields`` says in SQL what each field must be, by the columns that the line was made of."""

    @register(name, f"SELECT event_id, {', '.join(f'{sql} AS {f}' for f, sql in fields.items())} FROM (SELECT *, {duck_line(expression)} AS line FROM events)")
    def run(spark, sf_dir):
        out = parse(lines(spark, sf_dir, expression), spec or ParserSpec("grok", grok_pattern=template, time_field="none", level_field="none"))
        shown = [F.col("message") if f == "message" else F.nullif(F.try_element_at("fields", F.lit(f)), F.lit("")).alias(f) for f in fields]
        return out.select("event_id", *shown)

    return run


_grok_query(
    "grok_syslog", "syslog", f"{{syslog}} || ' web' || {USER} || ' ' || event_type || CASE WHEN event_id % 3 = 0 THEN '[' || CAST(event_id + 1 AS STRING) || ']' ELSE '' END || ': did ' || {ID}",
    {"program": "event_type", "pid": "CASE WHEN event_id % 3 = 0 THEN CAST(event_id + 1 AS VARCHAR) END", "message": f"'did ' || {ID}"},
)
_grok_query(
    "grok_java", "java", f"{{iso}} || ' ' || {UPPER} || ' [worker-' || {USER} || '] com.shop.' || event_type || ' - handled ' || {ID}",
    {"timestamp": duck_line("{iso}"), "level": UPPER, "thread": f"'worker-' || {USER}", "logger": "'com.shop.' || event_type", "message": f"'handled ' || {ID}"},
)
_grok_query(
    "grok_python", "python", f"{{plain}} || ' - shop.' || event_type || ' - ' || {UPPER} || ' - handled ' || {ID}",
    {"timestamp": duck_line("{plain}"), "level": UPPER, "logger": "'shop.' || event_type", "message": f"'handled ' || {ID}"},
)
_grok_query(
    "grok_go", "go", f"CASE WHEN event_id % 5 = 0 THEN 'panic: ' || {ID} ELSE {{iso}} || ' ' || {UPPER} || ' handled ' || {ID} END",
    {"timestamp": f"CASE WHEN event_id % 5 > 0 THEN {duck_line('{iso}')} END", "level": f"CASE WHEN event_id % 5 > 0 THEN {UPPER} END", "message": f"CASE WHEN event_id % 5 = 0 THEN 'panic: ' ELSE 'handled ' END || {ID}"},
)
_HTTP = "CASE event_id % 3 WHEN 0 THEN ' HTTP/1.1' WHEN 1 THEN ' HTTP/2' ELSE '' END"
#: A decimal version is no number of the dictionary: such requests stay whole.
_verb = lambda sql: f"CASE WHEN event_id % 3 > 0 THEN {sql} END"
_raw = lambda verb: f"CASE WHEN event_id % 3 = 0 THEN '{verb} /' || event_type || ' HTTP/1.1' END"
_grok_query(
    "grok_apache", "apache", f"'10.0.' || CAST(user_id % 200 AS STRING) || '.7 - u' || {USER} || ' [' || {{http}} || ' +0000] \"GET /' || event_type || {_HTTP} || '\" 200 ' || CASE WHEN event_id % 4 = 0 THEN '-' ELSE {ID} END",
    {"clientip": "'10.0.' || (user_id % 200) || '.7'", "auth": f"'u' || {USER}", "verb": _verb("'GET'"), "request": _verb("'/' || event_type"), "httpversion": "CASE WHEN event_id % 3 = 1 THEN '2' END", "rawrequest": _raw("GET"), "response": "'200'", "bytes": f"CASE WHEN event_id % 4 > 0 THEN {ID} END"},
)
_grok_query(
    "grok_nginx", "nginx", f"'host' || {USER} || '.example.com - u [' || {{http}} || ' +0000] \"POST /' || event_type || {_HTTP} || '\" 404 ' || {ID} || ' \"-\" \"agent/1\"'",
    {"clientip": f"'host' || {USER} || '.example.com'", "verb": _verb("'POST'"), "request": _verb("'/' || event_type"), "rawrequest": _raw("POST"), "response": "'404'", "bytes": ID, "referrer": "'-'", "agent": "'agent/1'"},
)
_CUSTOM = r"%{IP:client_ip} - %{USER:user} %{WORD:method} %{NOTSPACE:path} %{INT:status}"
_address = lambda sql: f"CASE WHEN user_id % 300 < 256 THEN {sql} END"  # noqa: E731  larger parts are no address
_grok_query(
    "grok_custom", _CUSTOM, f"'192.168.1.' || CAST(user_id % 300 AS STRING) || ' - u' || {USER} || ' GET /' || event_type || ' ' || CAST(200 + event_id % 5 AS STRING)",
    {"client_ip": _address("'192.168.1.' || (user_id % 300)"), "user": _address(f"'u' || {USER}"), "method": _address("'GET'"), "path": _address("'/' || event_type"), "status": _address("CAST(200 + event_id % 5 AS VARCHAR)")},
    ParserSpec("grok", pattern=_CUSTOM),
)

#: For each base pattern a text that it matches whole, and one that it doesn't.
_SAMPLES = {
    "USERNAME": ("a.b-c_9", "a b"), "USER": ("root", "ro ot"), "INT": ("-12", "1.5"), "NUMBER": ("+7", "x"), "WORD": ("abc_1", "a-b"), "NOTSPACE": ("a/b!", "a b"), "SPACE": ("  ", "x"),
    "DATA": ("any thing", "two\nlines"), "GREEDYDATA": ("any thing", "two\nlines"), "MONTHDAY": ("31", "32"), "MONTH": ("Sep", "Foo"), "YEAR": ("2024", "123"), "HOUR": ("23", "24"), "MINUTE": ("59", "60"),
    "SECOND": ("60.123", "61"), "TIME": ("12:30:01,5", "12-30"), "TIMESTAMP_ISO8601": ("2024-01-02T03:04:05.678Z", "2024-01-02"), "ISO8601_TIMEZONE": ("+02:00", "2"), "IP": ("10.0.0.1", "10.0.0.256"),
    "IPV4": ("255.255.255.0", "1.2.3"), "IPV6": ("2001:db8::1", "12345::"), "HOSTNAME": ("a.example-1.com", "-a"), "LOGLEVEL": ("WARNING", "warn"), "SYSLOGBASE": ("Jan 02 03:04:05 web1 sshd[12]:", "Jan 02 web1"),
    "COMMONAPACHELOG": ('1.2.3.4 - bob [02/Jan/2024:03:04:05 +0000] "GET /x" 200 -', "GET /x"), "HTTPDATE": ("02/Jan/2024:03:04:05 +0000", "2024"), "IPORHOST": ("::1", "_"), "POSINT": ("10", "0"),
}


@register("grok_dictionary", "SELECT unnest([" + ", ".join(f"'{n}'" for n in _SAMPLES) + "]) AS name, true AS matches, false AS rejects")
def grok_dictionary(spark, sf_dir):
    if set(_SAMPLES) != set(BASE):
        raise ValueError(f"no samples for {set(_SAMPLES) ^ set(BASE)}")
    found = None
    for name, (good, bad) in _SAMPLES.items():
        whole = compile_grok(f"^(?:%{{{name}}})$")
        row = spark.range(1).select(F.lit(name).alias("name"), matches(F.lit(good), whole).alias("matches"), matches(F.lit(bad), whole).alias("rejects"))
        found = row if found is None else found.unionByName(row)
    return found


@register(
    "event_json",
    f"""SELECT event_id, '{{"timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '","message":"event ' || event_id || '","level":"' || {NORMAL} || '","source":"app' || user_id || '","fields":{{"type":"' || event_type || '","user":"u' || user_id || '"}}}}' AS json FROM events""",
)
def event_json_lines(spark, sf_dir):
    spec = ParserSpec("json", time_field="ts", drop=("k",))
    out = parse(lines(spark, sf_dir, JSON_LINE), spec).drop("raw")
    return out.select("event_id", event_json(out).alias("json"))


@register("events_union_inputs", f"SELECT {NORMAL} AS level, 2 * count(*) AS n FROM events GROUP BY 1")
def events_union_inputs(spark, sf_dir):
    one = parse(lines(spark, sf_dir, JSON_LINE), JSON).select("level", "message")
    two = parse(lines(spark, sf_dir, f"{{iso}} || ' ' || {LEVEL} || ' event ' || {ID}"), DEFAULT).select("level", "message")
    return one.unionByName(two).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


_STACK = f"CASE WHEN event_type = 'click' THEN 'START ' || {ID} WHEN event_type = 'view' AND event_id % 9 = 0 THEN '' ELSE '  at ' || {ID} END"


def _multiline(name: str, spec: MultilineSpec, one_source: bool = False, rows_per_block: int = ROWS):
    start = "line LIKE 'START%'" if not spec.negate else "line NOT LIKE 'START%'"
    order = "DESC" if spec.match == "before" else "ASC"
    sql = f"""WITH l AS (SELECT event_id, ts, line, {"'all'" if one_source else 'source'} AS source FROM ({duck_lines(_STACK)}) WHERE line <> ''),
m AS (SELECT *, CASE WHEN {start} OR epoch(ts) - epoch(lag(ts) OVER w) > {spec.timeout_seconds} THEN 1 ELSE 0 END AS fresh FROM l WINDOW w AS (PARTITION BY source ORDER BY event_id)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY source ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS grp FROM m),
c AS (SELECT *, (row_number() OVER (PARTITION BY source, grp ORDER BY event_id) - 1) // {max(spec.max_lines, 2)} AS chunk FROM g)
SELECT source, min(event_id) AS seq, string_agg(line, chr(10) ORDER BY event_id {order}) AS line, count(*)::INT AS n_lines FROM c GROUP BY source, grp, chunk"""

    @register(name, sql)
    def run(spark, sf_dir):
        rows = lines(spark, sf_dir, _STACK)
        rows = rows.withColumn("source", F.lit("all")) if one_source else rows
        return assemble(rows, spec, order="event_id", rows_per_block=rows_per_block).drop("ts")

    return run


_multiline("multiline_after", MultilineSpec("^START", timeout_seconds=1e9))
_multiline("multiline_before", MultilineSpec("^START", match="before", timeout_seconds=1e9))
_multiline("multiline_negate", MultilineSpec("^START", negate=True, timeout_seconds=1e9))
_multiline("multiline_maxlines", MultilineSpec("^START", max_lines=3, timeout_seconds=1e9))
_multiline("multiline_timeout", MultilineSpec("^START", timeout_seconds=20_000.0))
#: All lines are one source's: it is scanned in blocks.
_multiline("multiline_one_source", MultilineSpec("^START", max_lines=4, timeout_seconds=600.0), one_source=True, rows_per_block=2048)


@register(
    "multiline_parsed",
    f"""WITH l AS (SELECT * FROM ({duck_lines(_STACK)}) WHERE line <> ''),
g AS (SELECT *, sum(CASE WHEN line LIKE 'START%' THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS grp FROM l),
c AS (SELECT *, (row_number() OVER (PARTITION BY source, grp ORDER BY event_id) - 1) // 500 AS chunk FROM g)
SELECT source, min(event_id) AS seq, nullif(regexp_extract(arg_min(line, event_id), '^\\w+ (\\d+)', 1), '') AS id, count(*)::INT AS n_lines FROM c GROUP BY source, grp, chunk""",
)
def multiline_parsed(spark, sf_dir):
    records = assemble(lines(spark, sf_dir, _STACK), MultilineSpec("^START", timeout_seconds=1e9), order="event_id")
    spec = ParserSpec("regex", pattern=r"^(?P<kind>\w+) (?P<id>\d+)")
    return parse(records, spec).select("source", "seq", F.try_element_at("fields", F.lit("id")).alias("id"), "n_lines")


@register(
    "parser_names",
    """SELECT parser, count(*) FILTER (event_id % 7 <> 2) AS parsed, count(*) FILTER (event_id % 7 = 2) AS failed, count(*) FILTER (parser = 'json' AND event_id % 7 > 2) AS structured
FROM events, (SELECT unnest(['json', 'regex', 'grok(java)']) AS parser) GROUP BY 1""",
)
def parser_names(spark, sf_dir):
    """What each parser made of the same lines, under the name that it goes by."""
    specs = (JSON, ParserSpec("regex", pattern=r"^nothing (?P<x>\d+)$"), ParserSpec("grok", grok_pattern="java"))
    rows = lines(spark, sf_dir, _BAD)

    def one(spec):
        parsed = parse(rows, spec)
        structured = F.count_if(F.try_element_at("fields", F.lit("user")).isNotNull())
        return parsed.agg(F.count_if(~F.col("is_error")).alias("parsed"), F.count_if("is_error").alias("failed"), structured.alias("structured")).select(F.lit(spec.name).alias("parser"), "*")

    out = [one(s) for s in specs]
    return out[0].unionByName(out[1]).unionByName(out[2])
