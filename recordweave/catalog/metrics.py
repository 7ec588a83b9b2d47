"""Metric extraction, windowed rates and quantiles, roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import delivery as D
from ..operators import metrics as M
from .common import events, register

_FIELDS = "map('value', CAST(value AS STRING), 'type', event_type, 'text', 'took ' || CAST(event_id % 500 AS STRING) || 'ms', 'http_method', CASE WHEN event_id % 2 = 0 THEN 'GET' ELSE 'POST' END, 'response_time_ms', CAST(event_id % 6000 AS STRING), 'bad', 'x')"


def _events(spark, sf_dir):
    return events(spark, sf_dir).selectExpr("event_id AS seq", "ts AS timestamp", f"{_FIELDS} AS fields")


@register("metric_counter", "SELECT event_type AS kind, 'a' AS host, round(sum(value), 4) AS value FROM events GROUP BY 1")
def metric_counter(spark, sf_dir):
    rule = M.MetricRule("v", "counter", "value", labels={"host": "a"}, label_fields={"kind": "type"})
    return M.counter(_events(spark, sf_dir), rule).withColumn("value", F.round("value", 4))


@register("metric_gauge", "SELECT event_type AS kind, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1")
def metric_gauge(spark, sf_dir):
    return M.gauge(_events(spark, sf_dir), M.MetricRule("v", "gauge", "value", label_fields={"kind": "type"}))


_LE = "(VALUES (10.0), (25.0), (50.0), (100.0), (250.0), (500.0), (1000.0), (2500.0), (5000.0), (CAST('inf' AS DOUBLE)))"


@register(
    "metric_histogram",
    f"SELECT CASE WHEN event_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, '' AS path, '' AS status, CAST(le AS DOUBLE) AS le, count(*) FILTER (event_id % 6000 <= le) AS bucket_count, CAST(sum(event_id % 6000) AS DOUBLE) AS sum, count(*) AS count FROM events, {_LE} b(le) GROUP BY ALL",
)
def metric_histogram(spark, sf_dir):
    return M.histogram(_events(spark, sf_dir), M.RESPONSE_TIME)


@register("metric_pattern_value", "SELECT event_type AS kind, CAST(sum(event_id % 500) AS DOUBLE) AS value FROM events GROUP BY 1")
def metric_pattern_value(spark, sf_dir):
    return M.counter(_events(spark, sf_dir), M.MetricRule("took", "counter", "text", pattern=r"took (\d+)ms", label_fields={"kind": "type"}))


@register("metric_labels", "SELECT 'static' AS kind, '' AS none, CAST(count(*) AS DOUBLE) AS value FROM events")
def metric_labels(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("fields", F.map_concat("fields", F.create_map(F.lit("one"), F.lit("1"))))
    return M.counter(rows, M.MetricRule("n", "counter", "one", labels={"kind": "static"}, label_fields={"kind": "type", "none": "missing"}))


@register("metric_skips", "SELECT event_type AS kind, CAST(sum(event_id % 100) AS DOUBLE) AS value FROM events WHERE event_id % 3 = 0 GROUP BY 1")
def metric_skips(spark, sf_dir):
    mixed = F.when(F.col("seq") % 3 == 0, (F.col("seq") % 100).cast("string")).when(F.col("seq") % 3 == 1, F.lit("x"))
    rows = _events(spark, sf_dir).withColumn("fields", F.map_concat("fields", F.create_map(F.lit("mixed"), mixed)))
    return M.counter(rows, M.MetricRule("mixed", "counter", "mixed", label_fields={"kind": "type"}))


@register("metric_long", "SELECT 'extracted_n' AS metric, count(*)::DOUBLE AS value FROM events UNION ALL SELECT 'extracted_last', arg_max(value, (ts, event_id)) FROM events")
def metric_long(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("fields", F.map_concat("fields", F.create_map(F.lit("one"), F.lit("1"))))
    return M.extract(rows, [M.MetricRule("n", "counter", "one"), M.MetricRule("last", "gauge", "value")]).select("metric", "value")


@register(
    "prometheus_text",
    """WITH c AS (SELECT event_type, count(*) AS n, count(*) FILTER (event_id % 40 <= 10) AS low, sum(event_id % 40) AS total FROM events GROUP BY 1),
l AS (SELECT 'extracted_n{kind="' || event_type || '"} ' AS head, n AS v FROM c UNION ALL SELECT 'extracted_d_bucket{kind="' || event_type || '",le="10"} ', low FROM c
 UNION ALL SELECT 'extracted_d_bucket{kind="' || event_type || '",le="1e+07"} ', n FROM c UNION ALL SELECT 'extracted_d_bucket{kind="' || event_type || '",le="+Inf"} ', n FROM c
 UNION ALL SELECT 'extracted_d_count{kind="' || event_type || '"} ', n FROM c UNION ALL SELECT 'extracted_d_sum{kind="' || event_type || '"} ', total FROM c)
SELECT head || CASE WHEN v < 1000000 THEN v::VARCHAR ELSE regexp_replace(rtrim(substr(v::VARCHAR, 1, 1) || '.' || substr(v::VARCHAR, 2), '0'), '\\.$', '') || 'e+' || lpad((length(v::VARCHAR) - 1)::VARCHAR, 2, '0') END AS line FROM l""",
)
def prometheus_text(spark, sf_dir):
    d = (F.col("seq") % 40).cast("string")
    rows = _events(spark, sf_dir).withColumn("fields", F.map_concat("fields", F.create_map(F.lit("one"), F.lit("1"), F.lit("d"), d)))
    kind = {"kind": "type"}
    return M.prometheus_text(M.extract(rows, [M.MetricRule("n", "counter", "one", label_fields=kind), M.MetricRule("d", "histogram", "d", label_fields=kind, buckets=(10.0, 1e7))]))


_BUCKET = "time_bucket(INTERVAL '5 minutes', ts)"


@register("rate_5m", f"SELECT event_type, strftime({_BUCKET}, '%Y-%m-%d %H:%M:%S') AS at, round(sum(value) / 300, 8) AS rate FROM events GROUP BY ALL")
def rate_5m(spark, sf_dir):
    r = M.rate(events(spark, sf_dir), F.col("value"), ("event_type",))
    return r.select("event_type", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("at"), F.round("rate", 8).alias("rate"))


@register("sum_rate", f"SELECT strftime({_BUCKET}, '%Y-%m-%d %H:%M:%S') AS at, count(*) / 300.0::DOUBLE AS rate FROM events GROUP BY ALL")
def sum_rate(spark, sf_dir):
    return M.rate(events(spark, sf_dir), F.lit(1)).select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("at"), "rate")


_WINDOW = "time_bucket(INTERVAL '6 hours', ts)"
_SCRAPED = "(floor(epoch(ts) / 60)::BIGINT % 500)"
_COUNTER = f"""WITH s AS (SELECT event_type, {_WINDOW} AS w, ts, max({_SCRAPED})::DOUBLE AS v FROM events GROUP BY ALL),
l AS (SELECT *, lag(v) OVER (PARTITION BY event_type, w ORDER BY ts) AS was FROM s),
e AS (SELECT event_type, w, count(*) AS n, arg_min(v, ts) AS f, arg_max(v, ts) - arg_min(v, ts) + COALESCE(sum(was) FILTER (v < was), 0.0) AS grown, epoch(max(ts)) - epoch(min(ts)) AS sampled,
 epoch(min(ts)) - epoch(w) AS t0, epoch(w) + 21600 - epoch(max(ts)) AS t1 FROM l GROUP BY event_type, w HAVING count(*) > 1),
g AS (SELECT *, CASE WHEN t0 >= 1.1 * sampled / (n - 1) THEN sampled / (n - 1) / 2 ELSE t0 END AS s0, CASE WHEN t1 >= 1.1 * sampled / (n - 1) THEN sampled / (n - 1) / 2 ELSE t1 END AS s1 FROM e),
r AS (SELECT event_type, strftime(w, '%Y-%m-%d %H:%M:%S') AS "at", grown * (sampled + least(s0, CASE WHEN grown > 0 AND f >= 0 THEN sampled * f / grown END) + s1) / sampled AS increase FROM g)"""


@register("counter_rate_resets", f'{_COUNTER} SELECT event_type, "at", round(increase, 6) AS increase, round(increase / 21600, 8) AS rate FROM r')
def counter_rate_resets(spark, sf_dir):
    """A counter of minutes that falls back to 0 every 500 minutes, scraped at the events' times."""
    s = events(spark, sf_dir).withColumn("scraped", F.floor(F.col("ts").cast("double") / 60) % 500)
    r = M.counter_rate(s, "scraped", ("event_type",), seconds=21_600)
    return r.select("event_type", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("at"), F.round("increase", 6).alias("increase"), F.round("rate", 8).alias("rate"))


@register("sum_counter_rate", f'{_COUNTER} SELECT "at", round(sum(increase / 21600), 8) AS rate FROM r GROUP BY "at"')
def sum_counter_rate(spark, sf_dir):
    s = events(spark, sf_dir).withColumn("scraped", F.floor(F.col("ts").cast("double") / 60) % 500)
    r = M.counter_rate(s, "scraped", ("event_type",), seconds=21_600).groupBy("window_start").agg(F.round(F.sum("rate"), 8).alias("rate"))
    return r.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("at"), "rate")


@register("min_health", "SELECT user_id % 5 AS component, min(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) AS health FROM events GROUP BY 1")
def min_health(spark, sf_dir):
    return events(spark, sf_dir).groupBy((F.col("user_id") % 5).alias("component")).agg(F.min(F.when(F.col("event_type") == "error", 0).otherwise(1)).alias("health"))


_BOUNDS = (1.0, 5.0, 10.0, 50.0, 100.0, 250.0)
_Q = f"""WITH e AS (SELECT {{by}} AS grp, value FROM events), b AS (SELECT grp, le, count(*) FILTER (value <= le)::DOUBLE AS n, count(*)::DOUBLE AS total FROM e, (SELECT unnest([{', '.join(map(str, _BOUNDS))}, CAST('inf' AS DOUBLE)]) AS le) GROUP BY ALL),
c AS (SELECT *, COALESCE(lag(le) OVER w, 0.0) AS low, COALESCE(lag(n) OVER w, 0.0) AS below FROM b WINDOW w AS (PARTITION BY grp ORDER BY le)),
h AS (SELECT grp, arg_min({{{{'le': le, 'low': low, 'n': n, 'below': below, 'total': total}}}}, le) AS x FROM c WHERE n >= {{q}} * total GROUP BY grp)
SELECT grp, round(CASE WHEN isinf(x.le) THEN x.low ELSE x.low + (x.le - x.low) * ({{q}} * x.total - x.below) / (x.n - x.below) END, 6) AS quantile FROM h"""


def _quantile(name: str, q: float, by: str, label):
    @register(name, _Q.format(q=q, by=by))
    def run(spark, sf_dir):
        rows = events(spark, sf_dir).select(label().alias("grp"), F.create_map(F.lit("v"), F.col("value").cast("string"), F.lit("g"), label().cast("string")).alias("fields"))
        h = M.histogram(rows, M.MetricRule("h", "histogram", "v", label_fields={"grp": "g"}, buckets=_BOUNDS))
        return M.histogram_quantile(h, q, ("grp",)).select("grp", F.round("quantile", 6).alias("quantile"))


_quantile("hist_quantile_p50", 0.5, "event_type", lambda: F.col("event_type"))
_quantile("hist_quantile_p95", 0.95, "event_type", lambda: F.col("event_type"))
_quantile("hist_quantile_by_le", 0.99, "'all'", lambda: F.lit("all"))


def _window_quantiles(by: str, bucket: str) -> str:
    bounds = (0.0, *_BOUNDS)
    counts = ", ".join(f"count(*) FILTER (value <= {b}) AS b{i}" for i, b in enumerate(_BOUNDS, 1))
    cases = lambda q: " ".join(f"WHEN b{i} >= {q} * n THEN {bounds[i - 1]} + {bounds[i] - bounds[i - 1]} * ({q} * n - {f'b{i - 1}' if i > 1 else 0}) / (b{i} - {f'b{i - 1}' if i > 1 else 0})" for i in range(1, len(bounds)))
    shown = ", ".join(f"round(CASE {cases(q)} ELSE {bounds[-1]} END, 6) AS p{name}" for q, name in ((0.5, 50), (0.95, 95), (0.99, 99)))
    return f"WITH c AS (SELECT {by}{bucket} AS w, count(*) AS n, {counts} FROM events GROUP BY ALL) SELECT {'event_type, ' if by else ''}strftime(w, '%Y-%m-%d %H:%M:%S') AS at, round(n / 300.0, 8) AS rate, {shown} FROM c"


def _sampled(spark, sf_dir):
    return events(spark, sf_dir).select(F.col("ts").alias("timestamp"), F.create_map(F.lit("v"), F.col("value").cast("string"), F.lit("type"), F.col("event_type")).alias("fields"))


_LATENCY = M.MetricRule("latency", "histogram", "v", label_fields={"event_type": "type"}, buckets=_BOUNDS)


def _shown(q):
    return q.withColumn("at", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")).drop("window_start").withColumns({"rate": F.round("rate", 8), **{p: F.round(p, 6) for p in ("p50", "p95", "p99")}})


@register("rate_quantiles_5m", _window_quantiles("event_type, ", _BUCKET))
def rate_quantiles_5m(spark, sf_dir):
    return _shown(M.windowed_quantiles(_sampled(spark, sf_dir), _LATENCY, by=("event_type",)))


@register("rate_quantiles_by_le", _window_quantiles("", _BUCKET))
def rate_quantiles_by_le(spark, sf_dir):
    return _shown(M.windowed_quantiles(_sampled(spark, sf_dir), _LATENCY))


#: A batch of each output for each user; latency is a whole number, so both engines fold it alike.
_BATCHES = """b AS (SELECT event_type AS output, user_id AS seq, count(*) AS events, count(*) FILTER (event_id % 10 = 0) AS failed, sum(event_id)::BIGINT AS bytes, (sum(event_id) % 500 + 1)::DOUBLE AS latency_ms,
 max(ts) AS sent_at, CASE WHEN count(*) FILTER (event_id % 10 = 0) > 0 THEN 'error of ' || user_id END AS error FROM events GROUP BY 1, 2)"""
_OUTPUT_SQL = f"""WITH RECURSIVE {_BATCHES}, r AS (SELECT *, row_number() OVER (PARTITION BY output ORDER BY seq) AS rn FROM b),
f AS (SELECT output, rn, latency_ms AS folded FROM r WHERE rn = 1 UNION ALL SELECT r.output, r.rn, (f.folded + r.latency_ms) / 2 FROM f JOIN r ON r.output = f.output AND r.rn = f.rn + 1),
o AS (SELECT output, sum(events)::BIGINT AS events_sent, sum(failed)::BIGINT AS events_failed, sum(bytes)::BIGINT AS bytes_sent, count(*) AS batches_sent, sum(events) / count(*) AS avg_batch_size, max(sent_at) AS last_sent,
 arg_max(error, (sent_at, seq)) FILTER (error IS NOT NULL) AS last_error, arg_max(sent_at, (sent_at, seq)) FILTER (error IS NOT NULL) AS last_error_at FROM b GROUP BY 1),
m AS (SELECT o.*, f.folded AS avg_latency_ms FROM o JOIN (SELECT output, arg_max(folded, rn) AS folded FROM f GROUP BY 1) f USING (output))"""
_AT = "strftime({}, '%Y-%m-%d %H:%M:%S')"


@register(
    "output_metrics",
    f"{_OUTPUT_SQL} SELECT output, events_sent, events_failed, bytes_sent, batches_sent, round(avg_batch_size, 6) AS avg_batch_size, round(avg_latency_ms, 6) AS avg_latency_ms, {_AT.format('last_sent')} AS last_sent, last_error FROM m",
)
def output_metrics(spark, sf_dir):
    return _outputs(spark, sf_dir).select(
        "output", "events_sent", "events_failed", "bytes_sent", "batches_sent", F.round("avg_batch_size", 6).alias("avg_batch_size"), F.round("avg_latency_ms", 6).alias("avg_latency_ms"),
        F.date_format("last_sent", "yyyy-MM-dd HH:mm:ss").alias("last_sent"), "last_error",
    )


def _outputs(spark, sf_dir):
    e = events(spark, sf_dir)
    b = e.groupBy(F.col("event_type").alias("output"), F.col("user_id").alias("seq")).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("event_id") % 10 == 0).alias("failed"), F.sum("event_id").alias("bytes"), (F.sum("event_id") % 500 + 1).cast("double").alias("latency_ms"), F.max("ts").alias("sent_at")
    )
    return D.output_metrics(b.withColumn("error", F.when(F.col("failed") > 0, F.concat(F.lit("error of "), F.col("seq").cast("string")))))


@register(
    "router_rollup",
    f"""{_OUTPUT_SQL} SELECT sum(events_sent)::BIGINT AS events_sent, sum(events_failed)::BIGINT AS events_failed, sum(bytes_sent)::BIGINT AS bytes_sent, sum(batches_sent)::BIGINT AS batches_sent,
 round(avg(avg_batch_size), 6) AS avg_batch_size, round(avg(avg_latency_ms), 6) AS avg_latency_ms, {_AT.format('max(last_sent)')} AS last_sent, arg_max(last_error, (last_error_at, output)) AS last_error FROM m""",
)
def router_rollup(spark, sf_dir):
    return D.router_metrics(_outputs(spark, sf_dir)).select(
        "events_sent", "events_failed", "bytes_sent", "batches_sent", F.round("avg_batch_size", 6).alias("avg_batch_size"), F.round("avg_latency_ms", 6).alias("avg_latency_ms"),
        F.date_format("last_sent", "yyyy-MM-dd HH:mm:ss").alias("last_sent"), "last_error",
    )


_STATUS = "CASE event_type WHEN 'error' THEN 'unhealthy' WHEN 'view' THEN 'degraded' ELSE 'healthy' END"


@register(
    "health_rollup",
    f"""SELECT user_id, CASE max(CASE {_STATUS} WHEN 'unhealthy' THEN 2 WHEN 'degraded' THEN 1 ELSE 0 END) WHEN 2 THEN 'unhealthy' WHEN 1 THEN 'degraded' ELSE 'healthy' END AS status FROM events GROUP BY 1""",
)
def health_rollup(spark, sf_dir):
    c = events(spark, sf_dir).select("user_id", F.expr(_STATUS).alias("status"))
    return D.overall_health(c, "user_id")


@register("load_stats", "SELECT count(*) AS processed, round(count(*) / (epoch(max(ts)) - epoch(min(ts))), 8) AS per_second, round(100.0 * count(*) FILTER (event_type <> 'error') / count(*), 6) AS success FROM events")
def load_stats(spark, sf_dir):
    seconds = F.max("ts").cast("double") - F.min("ts").cast("double")
    n = F.count(F.lit(1))
    return events(spark, sf_dir).agg(n.alias("processed"), F.round(n / seconds, 8).alias("per_second"), F.round(100.0 * F.count_if(F.col("event_type") != "error") / n, 6).alias("success"))



