"""Network inputs over landing rows made of ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import inputs as I
from ..operators.parsers import DEFAULT, explode_fields, merge_input, parse
from .common import ID, NORMAL, USER, events, register

_BODY = f"""CASE event_id % 3 WHEN 0 THEN '{{"message":"m' || {ID} || '","n":' || {ID} || '}}' WHEN 1 THEN '{{"user":"u' || {USER} || '"}}' ELSE 'plain ' || {ID} END"""


def _requests(spark, sf_dir, body: str = _BODY):
    return events(spark, sf_dir).selectExpr(
        "event_id", "ts", "CASE WHEN event_id % 10 = 9 THEN 'GET' ELSE 'POST' END AS method", "CASE WHEN event_id % 20 = 0 THEN '/health' ELSE '/logs' END AS path",
        f"{body} AS body", f"'10.0.0.1:' || {USER} AS remote_addr", "'curl' AS user_agent",
        "CASE event_id % 4 WHEN 0 THEN 'k1' WHEN 1 THEN '' ELSE NULL END AS api_key", "CASE event_id % 4 WHEN 1 THEN 'Bearer k2' WHEN 2 THEN 'k1' ELSE NULL END AS authorization",
    )


@register(
    "http_events",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'm' || event_id WHEN 1 THEN '<nil>' ELSE 'plain ' || event_id END AS message, CASE event_id % 3 WHEN 1 THEN 'u' || user_id END AS user, '10.0.0.1:' || user_id AS remote_addr, 'http' AS input_type FROM events WHERE event_id % 10 <> 9""",
)
def http_events(spark, sf_dir):
    get = lambda k: F.try_element_at("fields", F.lit(k)).alias(k)
    return I.http_events(_requests(spark, sf_dir)).select("event_id", "message", get("user"), get("remote_addr"), get("input_type"))


_ARRAY = f"""CASE WHEN event_id % 5 = 0 THEN '{{"message":"no array"}}' ELSE '[{{"message":"a' || {ID} || '"}},{{"level":"info"}},{{"message":"c"}}]' END"""


@register(
    "http_batch_explode",
    "SELECT event_id, unnest([0, 1, 2]) AS item, unnest(['a' || event_id, '<nil>', 'c']) AS message, 'true' AS batch FROM events WHERE event_id % 10 <> 9 AND event_id % 5 <> 0",
)
def http_batch_explode(spark, sf_dir):
    return I.http_batch_events(_requests(spark, sf_dir, _ARRAY)).select("event_id", "item", "message", F.col("fields")["batch"].alias("batch"))


@register("http_auth", "SELECT event_id FROM events WHERE event_id % 20 = 0 OR event_id % 4 IN (0, 1, 2)")
def http_auth(spark, sf_dir):
    return I.authenticated(_requests(spark, sf_dir), ("k1", "k2")).select("event_id")


@register("http_auth_refused", "SELECT event_id FROM events WHERE NOT (event_id % 20 = 0 OR event_id % 4 IN (0, 1, 2))")
def http_auth_refused(spark, sf_dir):
    return I.authenticated(_requests(spark, sf_dir), ("k1", "k2"), accept=False).select("event_id")


@register("http_counters", "SELECT count(*) AS requests, count(*) FILTER (bad) AS unauthorised, count(*) FILTER (NOT bad AND event_id % 10 = 9) AS wrong_method, count(*) FILTER (NOT bad AND event_id % 10 <> 9) AS accepted FROM (SELECT event_id, event_id % 20 <> 0 AND event_id % 4 = 3 AS bad FROM events)")
def http_counters(spark, sf_dir):
    return I.http_counters(_requests(spark, sf_dir), ("k1", "k2"))


@register("input_merge", f"SELECT event_id, 'event ' || event_id AS message, {NORMAL} AS level, 'input' AS env, 'http' AS input_type FROM events")
def input_merge(spark, sf_dir):
    from .common import LEVEL, lines

    spec = DEFAULT.__class__(**{**DEFAULT.__dict__, "custom_fields": {"env": "parser"}})
    rows = lines(spark, sf_dir, f"{{iso}} || ' ' || {LEVEL} || ' event ' || {ID}", "map('env', 'input', 'input_type', 'http') AS input_fields")
    out = merge_input(parse(rows, spec))
    return out.select("event_id", "message", "level", F.col("fields")["env"].alias("env"), F.col("fields")["input_type"].alias("input_type"))


_SYSLOG = f"'<' || CAST(event_id % 192 AS STRING) || '>Jan 15 10:30:00 host{{0}} app: did ' || {ID}".replace("{0}", "")


def _messages(spark, sf_dir):
    return events(spark, sf_dir).selectExpr("event_id", f"{_SYSLOG} AS message", f"'10.0.0.' || CAST(user_id % 250 AS STRING) AS source_ip")


@register("syslog_fields", f"SELECT event_id, unnest(['source_ip', 'input_type', 'format', 'raw_message']) AS key, unnest(['10.0.0.' || (user_id % 250), 'syslog', 'rfc3164', {_SYSLOG}]) AS value FROM events")
def syslog_fields(spark, sf_dir):
    return explode_fields(I.syslog_events(_messages(spark, sf_dir)), "event_id")


@register("syslog_parsed", "SELECT event_id, (event_id % 192 // 8)::INT AS facility, (event_id % 8)::INT AS severity, 'host' AS host, 'app' AS tag, 'did ' || event_id AS content FROM events")
def syslog_parsed(spark, sf_dir):
    return I.syslog_parsed(_messages(spark, sf_dir)).select("event_id", "facility", "severity", "host", "tag", "content")


def _pods(spark, sf_dir):
    return events(spark, sf_dir).selectExpr(
        "event_id", "'ns' || CAST(user_id % 3 AS STRING) AS namespace", f"'pod-' || {USER} AS pod", "CASE WHEN event_id % 2 = 0 THEN 'web-main' ELSE 'sidecar' END AS container",
        "CASE WHEN event_id % 5 = 0 THEN 'Pending' ELSE 'Running' END AS phase", "map('app', event_type) AS labels", "CAST(NULL AS map<string,string>) AS annotations", f"'line ' || {ID} AS message",
    )


@register(
    "k8s_enrich",
    "SELECT event_id, unnest(['kubernetes.namespace', 'kubernetes.pod', 'kubernetes.container', 'input_type', 'kubernetes.labels.app']) AS key, unnest(['ns' || (user_id % 3), 'pod-' || user_id, 'web-main', 'kubernetes', event_type]) AS value FROM events WHERE event_id % 2 = 0 AND event_id % 5 <> 0",
)
def k8s_enrich(spark, sf_dir):
    return explode_fields(I.pod_events(_pods(spark, sf_dir), "main", metadata=True), "event_id")


@register("k8s_flat", "SELECT event_id, 'ns' || (user_id % 3) AS namespace, 'kubernetes' AS input_type FROM events WHERE event_id % 5 <> 0")
def k8s_flat(spark, sf_dir):
    return I.pod_events(_pods(spark, sf_dir)).select("event_id", F.col("fields")["namespace"].alias("namespace"), F.col("fields")["input_type"].alias("input_type"))


@register("k8s_paths", "SELECT event_id, 'ns' || (user_id % 3) AS namespace, 'pod-' || user_id AS pod, 'web' AS container FROM events")
def k8s_paths(spark, sf_dir):
    paths = events(spark, sf_dir).selectExpr("event_id", f"'/var/log/pods/ns' || CAST(user_id % 3 AS STRING) || '_pod-' || {USER} || '_0f/web/0.log' AS path")
    return I.with_pod_path(paths).drop("path")


def _pod_lines(spark, sf_dir):
    return events(spark, sf_dir).selectExpr(
        "event_id AS seq", "ts", "'ns' || CAST(user_id % 3 AS STRING) AS namespace", f"'pod-' || {USER} AS pod", "CASE WHEN event_id % 2 = 0 THEN 'web-main' ELSE 'sidecar' END AS container",
        "CASE WHEN event_id % 5 = 0 THEN 'Pending' ELSE 'Running' END AS phase", "CASE WHEN event_id % 7 = 0 THEN map('app', event_type) ELSE map('app', event_type, 'tier', 't' || CAST(user_id % 4 AS STRING)) END AS labels",
        "CAST(NULL AS map<string,string>) AS annotations", f"'line ' || {ID} AS message", "CAST(floor(event_id / 4000) AS INT) AS restart",
    )


@register(
    "k8s_selectors",
    "SELECT event_id, user_id FROM events WHERE event_type IN ('click', 'view', 'error') AND NOT (event_id % 7 <> 0 AND user_id % 4 = 1) AND event_id % 5 <> 0 AND user_id % 3 = 2",
)
def k8s_selectors(spark, sf_dir):
    rows = _pod_lines(spark, sf_dir).drop("restart").withColumn("user_id", F.regexp_extract("pod", "[0-9]+", 0).cast("long"))
    picked = I.select_pods(rows, labels="app in (click, view, error), tier != t1, !gone", fields="status.phase=Running,metadata.namespace==ns2")
    return picked.select(F.col("seq").alias("event_id"), "user_id")


@register(
    "k8s_tail_lines",
    """WITH p AS (SELECT event_id, 'pod-' || user_id AS pod, event_id % 2 AS c, event_id // 4000 AS restart FROM events),
l AS (SELECT *, max(restart) OVER (PARTITION BY pod, c) AS last FROM p)
SELECT event_id, pod FROM l WHERE restart = last QUALIFY row_number() OVER (PARTITION BY pod, c ORDER BY event_id DESC) <= 3""",
)
def k8s_tail_lines(spark, sf_dir):
    return I.select_pods(_pod_lines(spark, sf_dir), tail_lines=3).select(F.col("seq").alias("event_id"), "pod")


@register(
    "k8s_previous",
    "WITH p AS (SELECT event_id, user_id, event_id % 2 AS c, event_id // 4000 AS restart FROM events) SELECT event_id FROM (SELECT *, max(restart) OVER (PARTITION BY user_id, c) AS last FROM p) WHERE restart = last - 1",
)
def k8s_previous(spark, sf_dir):
    return I.select_pods(_pod_lines(spark, sf_dir), previous=True).select(F.col("seq").alias("event_id"))


_CONFIGURATION = """
inputs:
  http: [{name: web, address: ':8080', table: landed_requests, api_keys: [k1, k2], parser: {type: json}}]
  syslog: [{name: net, address: ':514', table: landed_messages, format: '3164', parser: {type: regex, pattern: '^<(?P<pri>[0-9]+)>.* did (?P<id>[0-9]+)$'}}]
  kubernetes: [{name: pods, table: landed_pods, namespace: ns1, label_selector: 'app in (click, error)', enrich_metadata: true}]
parser: {type: regex, pattern: '^line (?P<id>[0-9]+)$', custom_fields: {origin: pods}}
transforms: [{type: add, add: {seen: 'yes'}}]
output: {type: stdout}
"""


@register(
    "configured_inputs",
    f"""SELECT 'web' AS input, CASE event_id % 3 WHEN 0 THEN 'm' || event_id WHEN 1 THEN '<nil>' ELSE 'plain ' || event_id END AS said, NULL AS id, 'http' AS input_type, 'yes' AS seen FROM events
 WHERE event_id % 10 <> 9 AND event_id % 20 <> 0 AND event_id % 4 IN (0, 1, 2)
UNION ALL SELECT 'net', {_SYSLOG.replace('CAST(event_id % 192 AS STRING)', '(event_id % 192)').replace('CAST(event_id AS STRING)', 'event_id')}, event_id::VARCHAR, 'syslog', 'yes' FROM events
UNION ALL SELECT 'pods', 'line ' || event_id, event_id::VARCHAR, 'kubernetes', 'yes' FROM events WHERE user_id % 3 = 1 AND event_type IN ('click', 'error') AND event_id % 5 <> 0""",
)
def configured_inputs(spark, sf_dir):
    from ..plans.config import loads, read

    _requests(spark, sf_dir).createOrReplaceTempView("landed_requests")
    _messages(spark, sf_dir).createOrReplaceTempView("landed_messages")
    _pod_lines(spark, sf_dir).drop("restart").createOrReplaceTempView("landed_pods")
    get = lambda k: F.try_element_at("fields", F.lit(k)).alias(k)
    return read(spark, loads(_CONFIGURATION)).select("input", F.col("raw").alias("said"), get("id"), get("input_type"), get("seen"))
