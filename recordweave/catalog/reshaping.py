"""Field transforms, redaction and validation functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.checks import next_power_of_two, percentage, success_rate, valid_field_name, valid_host_port, valid_ip, valid_path
from ..functions.values import number_text, parse_float
from ..operators.parsers import explode_fields
from ..operators.transforms import TransformSpec, is_sensitive, sanitized, transform, typed_view
from .common import ID, NUMBER, USER, duck_line, events, register, spark_line

_MESSAGE = f"'user=u' || {USER} || ' type=' || event_type || ' password=p' || {ID} || ' k=' || CAST({NUMBER} AS STRING) || ' flag user=last' || CASE WHEN event_id % 3 = 0 THEN ' note=a=b' ELSE '' END"
_FIELDS = f"map('user', 'u' || {USER}, 'type', event_type, 'password', 'p' || {ID}, 'auth_token', 't', 'author', 'me')"
_ALL = {"user": "'u' || user_id", "type": "event_type", "password": "'p' || event_id", "auth_token": "'t'", "author": "'me'"}


def _rows(spark, sf_dir):
    return events(spark, sf_dir).selectExpr("event_id", f"{spark_line(_MESSAGE)} AS message", f"{_FIELDS} AS fields")


def _long(df):
    return explode_fields(df, "event_id")


def _duck(pairs: dict[str, str]) -> str:
    return f"SELECT event_id, unnest([{', '.join(repr(k) for k in pairs)}]) AS key, unnest([{', '.join(pairs.values())}]) AS value FROM events"


def _case(name: str, pairs: dict[str, str], *specs: TransformSpec):
    @register(name, _duck(pairs))
    def run(spark, sf_dir):
        return _long(transform(_rows(spark, sf_dir), *specs))


_case("t_include", {k: _ALL[k] for k in ("user", "type")}, TransformSpec("filter", include=("user", "type", "missing"), exclude=("user",)))
_case("t_exclude", {k: v for k, v in _ALL.items() if k not in ("password", "author")}, TransformSpec("filter", exclude=("password", "author")))
_case("t_rename", {"type": "'u' || user_id", "secret": "'p' || event_id", "auth_token": "'t'", "author": "'me'"}, TransformSpec("rename", rename={"user": "type", "password": "secret", "missing": "x"}))
_case("t_add", _ALL | {"env": "'prod'", "type": "'fixed'"}, TransformSpec("add", add={"env": "prod", "type": "fixed"}))
_case("t_convert", _ALL, TransformSpec("convert", fields=("user",)))
_case("redact", _ALL | {k: "'***REDACTED***'" for k in ("password", "auth_token", "author")}, TransformSpec("redact"))
_case("t_pipeline", {"username": "'u' || user_id", "type": "event_type", "env": "'prod'"}, TransformSpec("rename", rename={"user": "username"}), TransformSpec("add", add={"env": "prod"}), TransformSpec("filter", include=("username", "type", "env")))


def _pairs(message: str, field: str, value: str, prefix: str = "") -> str:
    return f"""WITH m AS (SELECT event_id, {message} AS message FROM events),
t AS (SELECT event_id, unnest(string_split(message, '{field}')) AS token, generate_subscripts(string_split(message, '{field}'), 1) AS pos FROM m)
SELECT event_id, '{prefix}' || trim(string_split(token, '{value}')[1]) AS key, arg_max(trim(substr(token, strpos(token, '{value}') + {len(value)})), pos) AS value
FROM t WHERE strpos(token, '{value}') > 0 GROUP BY 1, 2"""


def _kv(name: str, expression: str, spec: TransformSpec):
    @register(name, _pairs(duck_line(expression), spec.field_split, spec.value_split, spec.prefix))
    def run(spark, sf_dir):
        rows = events(spark, sf_dir).selectExpr("event_id", f"{spark_line(expression)} AS message", "CAST(map() AS map<string,string>) AS fields")
        return _long(transform(rows, spec))


_kv("t_kv", _MESSAGE, TransformSpec("kv"))
_kv("t_kv_prefix", _MESSAGE, TransformSpec("kv", prefix="kv_"))
_kv("t_kv_separators", f"'user:u' || {USER} || ', role:' || event_type || ',active:true,a.b:1|2'", TransformSpec("kv", field_split=",", value_split=":"))
_kv("t_kv_dup", "'a=1 a=2 b=' || event_type || ' b= c=3'", TransformSpec("kv"))


@register("t_kv_pattern", _duck({"x_user": "'u' || user_id", "x_kind": "event_type"}))
def t_kv_pattern(spark, sf_dir):
    rows = events(spark, sf_dir).selectExpr("event_id", f"{spark_line(_MESSAGE)} AS message", "CAST(map() AS map<string,string>) AS fields")
    return _long(transform(rows, TransformSpec("kv", patterns=(r"nothing (?P<a>\d+)", r"user=(?P<user>\S+) type=(?P<kind>\w+)"), prefix="x_")))


@register("t_typed_view", f"SELECT event_id, {NUMBER} AS k, TRUE AS bad_is_null FROM events")
def t_typed_view(spark, sf_dir):
    rows = events(spark, sf_dir).selectExpr("event_id", f"map('k', CAST({NUMBER} AS STRING), 'bad', event_type) AS fields")
    return rows.select("event_id", typed_view(F.col("fields"), {"k": "int", "bad": "bigint"}).alias("v")).select("event_id", "v.k", F.col("v.bad").isNull().alias("bad_is_null"))


def _values(name: str, values: list[str | None], sql: str, expression):
    """A query over literal strings, spread over the events."""
    shown = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values)

    @register(name, f"WITH v AS (SELECT event_id, ([{shown}])[event_id % {len(values)} + 1] AS s FROM events) SELECT s, {sql} AS r, count(*) AS n FROM v GROUP BY ALL")
    def run(spark, sf_dir):
        literals = F.array(*[F.lit(v).cast("string") for v in values])
        v = events(spark, sf_dir).select(F.get(literals, (F.col("event_id") % len(values)).cast("int")).alias("s"))
        return v.groupBy("s").agg(F.count(F.lit(1)).alias("n")).select("s", expression(F.col("s")).alias("r"), "n")


_values("valid_ip", ["1.2.3.4", "255.255.255.255", "256.1.1.1", "01.002.3.4", "1.2.3", "a.b.c.d", "::1", ""], r"regexp_matches(s, '^[0-9]{1,3}(\.[0-9]{1,3}){3}$') AND COALESCE(list_max([TRY_CAST(x AS INT) for x in string_split(s, '.')]) <= 255, false)", valid_ip)
_values("valid_hostport", ["h:80", "h:0", "h:65535", "h:65536", "h", "a:b:1", "h:80x", ":1", "h:"], r"len(string_split(s, ':')) = 2 AND COALESCE(TRY_CAST(regexp_extract(string_split(s, ':')[2], '^([0-9]+)', 1) AS INT) BETWEEN 1 AND 65535, false)", valid_host_port)
_values("valid_path", ["/var/log/a.log", "../etc/passwd", "a..b", "", "/tmp/x"], "NOT contains(s, '..')", valid_path)
_values("valid_field", ["user.name", "a-b_c", "a b", "", "x!", "é"], r"regexp_full_match(s, '[a-zA-Z0-9_.-]+')", valid_field_name)
_values("sensitive_names", ["password", "X-Auth", "author", "api_key", "level", "PRIVATE_KEY", "name"], "regexp_matches(lower(s), 'password|passwd|secret|token|api_key|apikey|access_key|private_key|credential|auth')", is_sensitive)
_values("sanitize", ["  a b ", "\ta\n", "", "x"], r"regexp_replace(s, '^\s+|\s+$', '', 'g')", sanitized)
_values("parse_float", ["1", "-2.5e3", " 1", "1d", "0x", "", "abc", ".5", "5.", "+7"], r"CASE WHEN regexp_full_match(s, '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST(s AS DOUBLE) END", parse_float)
_values("number_text", ["1.0", "42", "3.14", "0.5", "123456", "-7.250", "0"], "regexp_replace(regexp_replace(CAST(CAST(s AS DOUBLE) AS VARCHAR), '\\.0$', ''), '^-0$', '0')", lambda s: number_text("double(s)"))


@register("power_of_two", "SELECT event_id, CASE WHEN event_id = 0 THEN 1024 WHEN event_id = 1 THEN 1 ELSE CAST(pow(2, ceil(log2(event_id))) AS BIGINT) END AS size FROM events")
def power_of_two(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", next_power_of_two(F.col("event_id")).alias("size"))


@register(
    "success_rates",
    "SELECT user_id % 7 AS grp, round(100.0 * count(*) FILTER (event_type <> 'error') / count(*), 6) AS success, round(100.0 * count(*) FILTER (event_type = 'error') / count(*), 6) AS errors FROM events GROUP BY 1",
)
def success_rates(spark, sf_dir):
    bad = F.count_if(F.col("event_type") == "error")
    g = events(spark, sf_dir).groupBy((F.col("user_id") % 7).alias("grp")).agg(F.count(F.lit(1)).alias("n"), bad.alias("bad"))
    return g.select("grp", F.round(success_rate(F.col("n") - F.col("bad"), F.col("n")), 6).alias("success"), F.round(percentage(F.col("bad"), F.col("n")), 6).alias("errors"))
