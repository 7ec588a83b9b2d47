"""Delivery policies: buffers, batches, log, dead letters, limits, breaker, names and sink projections."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.checks import constant_backoff, exponential_backoff, linear_backoff
from ..functions.names import index_name, object_key
from ..operators import delivery as D
from ..operators.batches import batches_by_bytes
from ..operators.limits import rate_limited
from ..operators.parsers import ParserSpec, parse
from ..sources.sinks import bulk_lines, topic_rows
from ..storage import shared_folder
from .common import NORMAL, events, lines, register
from .parsing import _BAD, JSON


def _seq(spark, sf_dir):
    return events(spark, sf_dir).select(F.col("event_id").alias("seq"), "ts", "user_id", "event_type", "value", F.col("props").alias("raw"))


@register("buffer_drop", "SELECT event_id AS seq FROM events ORDER BY event_id DESC LIMIT 1024")
def buffer_drop(spark, sf_dir):
    return D.buffer_drop(_seq(spark, sf_dir), 1024).select("seq")


@register("buffer_block", "SELECT event_id AS seq FROM events ORDER BY event_id LIMIT 1024")
def buffer_block(spark, sf_dir):
    return D.buffer_block(_seq(spark, sf_dir), 1024).select("seq")


@register("buffer_sample", "WITH r AS (SELECT event_id AS seq, row_number() OVER (ORDER BY event_id) AS rn FROM events) SELECT seq FROM r WHERE rn <= 1024 OR (rn - 1024) % 10 = 0")
def buffer_sample(spark, sf_dir):
    return D.buffer_sample(_seq(spark, sf_dir), 1024, 10).select("seq")


@register("batch_by_count", "WITH r AS (SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 333 AS batch FROM events) SELECT batch, count(*) AS n, min(event_id) AS first_seq FROM r GROUP BY 1")
def batch_by_count(spark, sf_dir):
    return D.batches_by_count(_seq(spark, sf_dir), 333).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))


@register(
    "batch_by_bytes",
    """WITH RECURSIVE e AS (SELECT event_type AS "by", event_id AS seq, strlen(props) AS size, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events),
f AS (SELECT "by", rn, seq, 0 AS batch, 1 AS n, size AS bytes, seq AS first_seq FROM e WHERE rn = 1
 UNION ALL SELECT e."by", e.rn, e.seq, CASE WHEN f.n >= 50 OR f.bytes >= 200 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.n >= 50 OR f.bytes >= 200 THEN 1 ELSE f.n + 1 END,
  CASE WHEN f.n >= 50 OR f.bytes >= 200 THEN e.size ELSE f.bytes + e.size END, CASE WHEN f.n >= 50 OR f.bytes >= 200 THEN e.seq ELSE f.first_seq END FROM f JOIN e ON e."by" = f."by" AND e.rn = f.rn + 1)
SELECT "by", batch::BIGINT AS batch, max(n)::BIGINT AS n, max(bytes)::BIGINT AS bytes, min(first_seq) AS first_seq, max(seq) AS last_seq FROM f GROUP BY 1, 2""",
)
def batch_by_bytes(spark, sf_dir):
    return batches_by_bytes(_seq(spark, sf_dir), 200, 50, "event_type")


_BATCHES = """WITH RECURSIVE e AS (SELECT {key} AS k, {tick} AS tick, event_id AS seq, strlen(props) AS size, row_number() OVER w AS rn, sum(strlen(props)) OVER w - strlen(props) AS before FROM events
 WINDOW w AS (PARTITION BY {key}, {tick} ORDER BY event_id)),
nx AS (SELECT a.k, a.tick, a.rn, min(b.rn) AS next FROM (SELECT *, unnest(range(1, {most} + 1)) AS d FROM e) a JOIN e b ON b.k = a.k AND b.tick = a.tick AND b.rn = a.rn + a.d
 WHERE b.before >= a.before + {bytes} OR a.d = {most} GROUP BY a.k, a.tick, a.rn),
h AS (SELECT DISTINCT k, tick, 1::BIGINT AS rn FROM e UNION ALL SELECT nx.k, nx.tick, nx.next FROM h JOIN nx ON nx.k = h.k AND nx.tick = h.tick AND nx.rn = h.rn),
b AS (SELECT k, tick, rn, row_number() OVER (PARTITION BY k ORDER BY tick, rn) - 1 AS batch FROM h)
SELECT e.k AS "by", b.batch, count(*) AS n, sum(e.size)::BIGINT AS bytes, min(e.seq) AS first_seq, max(e.seq) AS last_seq FROM e ASOF JOIN b ON e.k = b.k AND e.tick = b.tick AND e.rn >= b.rn GROUP BY 1, 2"""


@register("batch_by_bytes_one_key", _BATCHES.format(key="'all'", tick="0", most=40, bytes=300))
def batch_by_bytes_one_key(spark, sf_dir):
    return batches_by_bytes(_seq(spark, sf_dir).withColumn("all", F.lit("all")), 300, 40, "all", rows_per_block=2048, cell=1024)


@register("batch_by_interval", _BATCHES.format(key="event_type", tick="floor(epoch(ts) / 21600)::BIGINT", most=40, bytes=500))
def batch_by_interval(spark, sf_dir):
    return batches_by_bytes(_seq(spark, sf_dir), 500, 40, "event_type", interval_seconds=21_600)


def _log(spark, sf_dir):
    return D.write_ahead_log(_seq(spark, sf_dir), segment_events=1000)


_LOG = "WITH l AS (SELECT event_id AS seq, row_number() OVER (ORDER BY event_id) - 1 AS \"offset\" FROM events)"


@register("wal_read", f'{_LOG} SELECT seq, "offset" FROM l WHERE "offset" >= 500 ORDER BY "offset" LIMIT 100')
def wal_read(spark, sf_dir):
    return D.read_log(_log(spark, sf_dir), 500, 100).select("seq", "offset")


@register("wal_segments", f'{_LOG} SELECT "offset" // 1000 AS segment, count(*) AS n, min("offset") AS first FROM l GROUP BY 1')
def wal_segments(spark, sf_dir):
    return _log(spark, sf_dir).groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.min("offset").alias("first"))


@register("wal_truncate", f'{_LOG} SELECT "offset" // 1000 AS segment, count(*) AS n FROM l GROUP BY 1 HAVING min("offset") >= 2500')
def wal_truncate(spark, sf_dir):
    return D.truncate_log(_log(spark, sf_dir), 2500).groupBy("segment").agg(F.count(F.lit(1)).alias("n"))


@register("wal_compact", f'{_LOG} SELECT "offset" // 1000 AS segment, count(*) AS n FROM l WHERE "offset" // 1000 > (SELECT max("offset" // 1000) FROM l) - 3 GROUP BY 1')
def wal_compact(spark, sf_dir):
    return D.compact_log(_log(spark, sf_dir), 3).groupBy("segment").agg(F.count(F.lit(1)).alias("n"))


def _letters(spark, sf_dir):
    return D.dead_letters(parse(lines(spark, sf_dir, _BAD), JSON).withColumn("seq", F.col("event_id")))


@register("dlq_split", "SELECT event_id % 7 = 2 AS dead, count(*) AS n FROM events GROUP BY 1")
def dlq_split(spark, sf_dir):
    parsed = parse(lines(spark, sf_dir, _BAD), JSON)
    both = D.dead_letters(parsed).select(F.lit(True).alias("dead")).unionByName(D.delivered(parsed).select(F.lit(False).alias("dead")))
    return both.groupBy("dead").agg(F.count(F.lit(1)).alias("n"))


@register("dlq_cap", "SELECT event_id AS seq FROM events WHERE event_id % 7 = 2 ORDER BY 1 LIMIT 100")
def dlq_cap(spark, sf_dir):
    return D.cap_dead_letters(_letters(spark, sf_dir), 100).select("seq")


@register(
    "dlq_dequeue",
    """WITH l AS (SELECT event_id AS seq, row_number() OVER (ORDER BY event_id) <= 25 AS taken FROM events WHERE event_id % 7 = 2)
SELECT taken, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM l GROUP BY 1""",
)
def dlq_dequeue(spark, sf_dir):
    taken, rest = D.dequeue(_letters(spark, sf_dir), 25)
    both = taken.select(F.lit(True).alias("taken"), "seq").unionByName(rest.select(F.lit(False).alias("taken"), "seq"))
    return both.groupBy("taken").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@register("dlq_ageout", "SELECT event_id AS seq FROM events WHERE event_id % 7 = 2 AND ts >= TIMESTAMP '2024-01-29 00:00:00' - INTERVAL 24 HOUR")
def dlq_ageout(spark, sf_dir):
    return D.age_out(_letters(spark, sf_dir), F.lit("2024-01-29 00:00:00").cast("timestamp"), 86_400).select("seq")


@register("dlq_retry", "SELECT event_id AS seq, 1 AS retries, '2024-02-01 00:00:00' AS at FROM events WHERE event_id % 7 = 2")
def dlq_retry(spark, sf_dir):
    out = D.retry_letters(_letters(spark, sf_dir), F.lit("2024-02-01 00:00:00").cast("timestamp"))
    return out.select("seq", "retries", F.date_format("failed_at", "yyyy-MM-dd HH:mm:ss").alias("at"))


@register(
    "rate_limit",
    """WITH RECURSIVE e AS (SELECT user_id AS client, event_id AS seq, epoch(ts)::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
f AS (SELECT client, rn, seq, t, t AS made, 1.0::DOUBLE AS tokens, true AS allowed FROM e WHERE rn = 1
 UNION ALL SELECT client, rn, seq, t, made, CASE WHEN have >= 1 THEN have - 1 ELSE have END, have >= 1 FROM (
  SELECT e.client, e.rn, e.seq, e.t, CASE WHEN e.t - f.made >= 300 THEN e.t ELSE f.made END AS made, CASE WHEN e.t - f.made >= 300 THEN 2.0::DOUBLE ELSE least(2.0::DOUBLE, f.tokens + (e.t - f.t)) END AS have
  FROM f JOIN e ON e.client = f.client AND e.rn = f.rn + 1))
SELECT client, seq, allowed FROM f""",
)
def rate_limit(spark, sf_dir):
    return rate_limited(_seq(spark, sf_dir), 1.0, "user_id")


@register(
    "breaker_states",
    """WITH RECURSIVE e AS (SELECT user_id AS k, event_id AS seq, epoch(ts)::DOUBLE AS t, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
f AS (
 SELECT k, rn, seq, 'closed' AS state, true AS allowed, CASE WHEN bad THEN 1 ELSE 0 END AS in_row, 'closed' AS after, 0.0::DOUBLE AS until FROM e WHERE rn = 1
 UNION ALL
 SELECT k, rn, seq, state, state <> 'open', CASE WHEN state = 'closed' AND bad THEN in_row + 1 ELSE 0 END,
  CASE WHEN state = 'closed' AND bad AND in_row + 1 >= 2 THEN 'open' WHEN state = 'half-open' THEN CASE WHEN bad THEN 'open' ELSE 'closed' END ELSE state END,
  CASE WHEN (state = 'closed' AND bad AND in_row + 1 >= 2) OR (state = 'half-open' AND bad) THEN t + 20000.0 ELSE until END
 FROM (SELECT e.k, e.rn, e.seq, e.t, e.bad, f.in_row, f.until, CASE WHEN f.after = 'open' AND e.t > f.until THEN 'half-open' ELSE f.after END AS state FROM f JOIN e ON e.k = f.k AND e.rn = f.rn + 1))
SELECT k AS "by", seq, state, allowed FROM f""",
)
def breaker_states(spark, sf_dir):
    return D.breaker_states(_seq(spark, sf_dir), "user_id", F.col("event_type") == "error", trips=2, timeout=20_000.0, interval=0.0)


@register(
    "backoff_table",
    "SELECT n AS attempt, least(100.0::DOUBLE * pow(2, n), 5000.0) AS exponential, least(n * 100.0::DOUBLE, 5000.0) AS linear, 250.0::DOUBLE AS constant FROM (SELECT unnest(range(0, 101)) AS n)",
)
def backoff_table(spark, sf_dir):
    n = F.col("attempt")
    t = spark.range(101).select(F.col("id").alias("attempt"))
    return t.select("attempt", exponential_backoff(n, 100.0, 2.0, 5000.0).alias("exponential"), linear_backoff(n, 100.0, 5000.0).alias("linear"), constant_backoff(n, 250.0).alias("constant"))


_ROTATIONS = {"daily": "%Y.%m.%d", "monthly": "%Y.%m", "yearly": "%Y", "other": "%Y.%m.%d"}


@register(
    "index_name",
    "SELECT event_id, 'logs' AS none, " + ", ".join(f"'logs-' || strftime(ts, '{f}') AS {k}" for k, f in _ROTATIONS.items()) + ", 'logs-' || isoyear(ts) || '.' || lpad(week(ts)::VARCHAR, 2, '0') AS weekly, 'logs-' || strftime(ts, '%Y.%m') AS marked FROM events",
)
def index_names(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.select("event_id", *[index_name("logs", r, F.col("ts")).alias(r) for r in ("none", *_ROTATIONS, "weekly")], index_name("logs-%{+YYYY.MM}", "daily", F.col("ts")).alias("marked"))


@register(
    "s3_key",
    "SELECT event_id, 'p/' || strftime(ts, '%Y/%m/%d/%H-%M-%S') || '-' || CAST(floor(epoch(ts)) AS BIGINT) || '.json.gz' AS key, CAST(epoch_us(ts) AS VARCHAR) || '000' AS nano FROM events",
)
def s3_key(spark, sf_dir):
    template = "{{.Year}}/{{.Month}}/{{.Day}}/{{.Hour}}-{{.Minute}}-{{.Second}}-{{.Timestamp}}.json"
    return events(spark, sf_dir).select("event_id", object_key(F.col("ts"), template, "p/", "gzip").alias("key"), object_key(F.col("ts"), "{{.UnixNano}}").alias("nano"))


def _parsed(spark, sf_dir):
    from .parsing import JSON_LINE

    return parse(lines(spark, sf_dir, JSON_LINE), ParserSpec("json", time_field="ts", drop=("k",))).drop("raw")


_EVENT = f"""'{{"timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '","message":"event ' || event_id || '","level":"' || {NORMAL} || '","source":"app' || user_id || '","fields":{{"type":"' || event_type || '","user":"u' || user_id || '"}}}}'"""


@register("kafka_project", f"SELECT event_type AS topic, 'u' || user_id AS key, {_EVENT} AS value FROM events")
def kafka_project(spark, sf_dir):
    return topic_rows(_parsed(spark, sf_dir), "logs", topic_field="type", key_field="user")


@register("es_bulk", f"""SELECT 'logs-' || strftime(ts, '%Y.%m.%d') AS "index", '{{"index":{{"_index":"logs-' || strftime(ts, '%Y.%m.%d') || '"}}}}' || chr(10) || {_EVENT} || chr(10) AS body FROM events""")
def es_bulk(spark, sf_dir):
    return bulk_lines(_parsed(spark, sf_dir), "logs", "daily")


_FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(regexp_extract_all(hex(encode({})), '..'), lambda x: ('0x' || x)::BIGINT)), lambda h, b: (xor(h, b) * 16777619) & 4294967295)"


@register(
    "kafka_hash_partition",
    f"""WITH h AS (SELECT event_type AS topic, 'u' || user_id || 'é' AS key, {_FNV.format("'u' || user_id || 'é'")} AS h FROM events)
SELECT topic, key, abs((CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 12)::INT AS "partition" FROM h""",
)
def kafka_hash_partition(spark, sf_dir):
    keyed = _parsed(spark, sf_dir)
    keyed = keyed.withColumn("fields", F.transform_values("fields", lambda k, v: F.when(k == "user", F.concat(v, F.lit("é"))).otherwise(v)))
    return topic_rows(keyed, "logs", topic_field="type", key_field="user", partitions=12).drop("value")


@register(
    "object_batches",
    """WITH b AS (SELECT event_id, ts, (row_number() OVER (ORDER BY event_id) - 1) // 250 AS batch FROM events),
k AS (SELECT batch, count(*) AS n, 'p/' || strftime(arg_min(ts, event_id), '%Y/%m/%d/%H') AS plain FROM b GROUP BY 1)
SELECT batch, n, plain || CASE WHEN r > 0 THEN '-' || r ELSE '' END || '.json' AS key FROM (SELECT *, row_number() OVER (PARTITION BY plain ORDER BY batch) - 1 AS r FROM k)""",
)
def object_batches(spark, sf_dir):
    from ..sources.objects import keyed_batches

    e = D.batches_by_count(events(spark, sf_dir).selectExpr("event_id AS seq", "ts AS timestamp", "event_type AS message", "map('k', props) AS fields"), 250)
    return keyed_batches(e, "{{.Year}}/{{.Month}}/{{.Day}}/{{.Hour}}.json", "p/").groupBy("batch", "key").agg(F.count(F.lit(1)).alias("n"))


@register("router_fanout", f"SELECT output, {_EVENT} AS line FROM events, (SELECT unnest(['first', 'second']) AS output)")
def router_fanout(spark, sf_dir):
    """Every event goes to all outputs; one that fails doesn't keep it from the others, and a repeated batch replaces itself."""
    from ..sources.sinks import router, text_output

    folder = f"{shared_folder(spark)}/outputs-{uuid.uuid4().hex}"

    def down(df, batch):
        raise OSError("down")

    send = router({"first": text_output(f"{folder}/first"), "down": down, "second": text_output(f"{folder}/second")})
    for _ in range(2):
        send(_parsed(spark, sf_dir), 0)
    written = [spark.read.text(f"{folder}/{name}/batch=0").select(F.lit(name).alias("output"), F.col("value").alias("line")) for name in ("first", "second")]
    return written[0].unionByName(written[1])
