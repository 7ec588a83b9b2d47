"""Network inputs over landing tables: HTTP bodies, syslog messages, pod logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.selectors import field_selector, label_selector
from ..functions.values import value_texts
from .blocks import same

_NONE = "<nil>"
EXEMPT_PATHS = ("/health", "/metrics")


def authorised(api_key: Column, authorization: Column, path: Column, keys: tuple[str, ...]) -> Column:
    """Whether a request passes: X-API-Key, else Authorization with or without Bearer; health and metrics always pass."""
    if not keys:
        return F.lit(True)
    given = F.coalesce(F.nullif(api_key, F.lit("")), F.regexp_replace(authorization, r"\ABearer ", ""))
    return path.isin(*EXEMPT_PATHS) | F.coalesce(given.isin(*keys), F.lit(False))


def authenticated(requests: DataFrame, keys: tuple[str, ...], accept: bool = True) -> DataFrame:
    """Requests that pass (or, without ``accept``, those that are refused); columns api_key, authorization, path."""
    ok = authorised(F.col("api_key"), F.col("authorization"), F.col("path"), keys)
    return requests.where(ok if accept else ~ok)


def _http_fields(values: str, remote_addr: Column, user_agent: Column, batch: bool) -> Column:
    extra = F.create_map(
        F.lit("remote_addr"), F.coalesce(remote_addr, F.lit("")), F.lit("user_agent"), F.coalesce(user_agent, F.lit("")), F.lit("input_type"), F.lit("http"), *([F.lit("batch"), F.lit("true")] if batch else [])
    )
    return F.map_concat(value_texts(values), extra)


def http_events(requests: DataFrame, most_bytes: int = 10 << 20) -> DataFrame:
    """Single-event requests (method, body, remote_addr, user_agent, ts, ...): adds message, fields, raw.

    Only POST, bodies up to the limit.  A JSON object gives the fields (message is its ``message``, or <nil>); any other
    body is the message itself.
    """
    ok = requests.where((F.col("method") == "POST") & (F.octet_length("body") <= most_bytes))
    ok = ok.withColumn("__values", F.from_json("body", "map<string,variant>"))
    fields = F.coalesce(_http_fields("__values", F.col("remote_addr"), F.col("user_agent"), False), F.create_map(F.lit("message"), F.col("body"), F.lit("remote_addr"), F.coalesce("remote_addr", F.lit("")), F.lit("user_agent"), F.coalesce("user_agent", F.lit("")), F.lit("input_type"), F.lit("http")))
    out = ok.withColumn("fields", fields).drop("__values")
    return out.withColumn("message", F.coalesce(F.try_element_at("fields", F.lit("message")), F.lit(_NONE))).withColumn("raw", F.col("body"))


def http_batch_events(requests: DataFrame, most_bytes: int = 10 << 20) -> DataFrame:
    """Batch requests: one row per object of the JSON array, with its ``item`` number; other bodies are refused."""
    ok = requests.where((F.col("method") == "POST") & (F.octet_length("body") <= most_bytes) & F.col("body").rlike(r"\A\s*\["))
    items = F.from_json("body", "array<map<string,variant>>")
    rows = ok.select("*", F.posexplode(items).alias("item", "__values")).where("__values is not null")
    rows = rows.withColumn("fields", _http_fields("__values", F.col("remote_addr"), F.col("user_agent"), True)).drop("__values")
    return rows.withColumn("message", F.coalesce(F.try_element_at("fields", F.lit("message")), F.lit(_NONE)))


def http_counters(requests: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row: requests, refused by key, wrong method, accepted."""
    ok, post = authorised(F.col("api_key"), F.col("authorization"), F.col("path"), keys), F.col("method") == "POST"
    return requests.agg(F.count(F.lit(1)).alias("requests"), F.count_if(~ok).alias("unauthorised"), F.count_if(ok & ~post).alias("wrong_method"), F.count_if(ok & post).alias("accepted"))


def syslog_events(messages: DataFrame, format: str = "3164") -> DataFrame:
    """Received syslog lines (message, source_ip): adds the fields of the input; 3164 and 5424 name format and raw text."""
    base = [F.lit("source_ip"), F.col("source_ip"), F.lit("input_type"), F.lit("syslog")]
    known = {"3164": "rfc3164", "5424": "rfc5424"}
    if format in known:
        base += [F.lit("format"), F.lit(known[format]), F.lit("raw_message"), F.col("message")]
    return messages.withColumn("fields", F.create_map(*base))


def syslog_parsed(messages: DataFrame) -> DataFrame:
    """Extension: priority, facility, severity, host, tag and content of RFC 3164 and 5424 lines."""
    m, old = F.col("message"), r"\A<(\d{1,3})>([A-Z][a-z]{2} [ \d]\d \d\d:\d\d:\d\d) (\S+) ([^:\[\s]+)(?:\[\d+\])?: ?(.*)\z"
    new = r"\A<(\d{1,3})>\d+ (\S+) (\S+) (\S+) \S+ \S+ (?:-|(?:\[[^\]]*\])+) ?(.*)\z"
    is_new = m.rlike(new)
    part = lambda i: F.when(is_new, F.regexp_extract(m, new, i)).otherwise(F.regexp_extract(m, old, i))
    priority = part(1).try_cast("int")
    return messages.select("*", priority.alias("priority"), F.floor(priority / 8).cast("int").alias("facility"), (priority % 8).alias("severity"), part(2).alias("stamp"), part(3).alias("host"), part(4).alias("tag"), part(5).alias("content"))


def pod_events(lines: DataFrame, container: str = "", metadata: bool = False) -> DataFrame:
    """Pod log lines (namespace, pod, container, phase, labels, annotations, message): running pods, container names that
    contain the filter; enriched flat, or nested under ``kubernetes.`` with labels and annotations."""
    ok = lines.where((F.col("phase") == "Running") & F.col("container").contains(container))
    kind = [F.lit("input_type"), F.lit("kubernetes")]
    if not metadata:
        return ok.withColumn("fields", F.create_map(F.lit("namespace"), F.col("namespace"), F.lit("pod"), F.col("pod"), F.lit("container"), F.col("container"), *kind))
    names = [x for n in ("namespace", "pod", "container") for x in (F.lit(f"kubernetes.{n}"), F.col(n))]
    under = lambda c: F.transform_keys(F.coalesce(c, F.create_map().cast("map<string,string>")), lambda k, v: F.concat(F.lit(f"kubernetes.{c}."), k))
    return ok.withColumn("fields", F.map_concat(F.create_map(*names, *kind), under("labels"), under("annotations")))


#: What names a container's log.
_CONTAINER = ("namespace", "pod", "container")


def select_pods(
    lines: DataFrame, namespace: str = "", labels: str = "", fields: str = "", container: str = "", previous: bool = False, tail_lines: int = 0, order: str = "seq", restart: str = "restart"
) -> DataFrame:
    """The rows of pod log lines (namespace, pod, container, phase, labels) that a collector would read.

    ``labels`` and ``fields`` are selectors (fields: metadata.name, metadata.namespace, status.phase, and spec.nodeName
    where there is a column node); ``container`` is part of the container's name.  Where there is a column ``restart``, lines are
    those of each container's last run, or with ``previous`` of the run before it.  ``tail_lines`` keeps that many last lines
    of each container; Spark drops the others before it shuffles.
    """
    known = {"metadata.name": F.col("pod"), "metadata.namespace": F.col("namespace"), "status.phase": F.col("phase")}
    known |= {"spec.nodeName": F.col("node")} if "node" in lines.columns else {}
    ok = label_selector(F.col("labels"), labels) & field_selector(fields, known) & F.col("container").contains(container)
    out = lines.where(ok & (F.col("namespace") == namespace) if namespace else ok)
    if restart in lines.columns:
        of = [f"__of_{c}" for c in _CONTAINER]
        last = out.groupBy(*_CONTAINER).agg(F.max(restart).alias("__last")).withColumnsRenamed(dict(zip(_CONTAINER, of, strict=True)))
        out = out.join(last, same(list(_CONTAINER), of)).where(F.col(restart) == F.col("__last") - int(previous)).select(*lines.columns)
    elif previous:
        raise ValueError("the run before needs a column that numbers runs")
    if tail_lines > 0:
        from_end = Window.partitionBy(*_CONTAINER).orderBy(F.desc(order))
        out = out.withColumn("__rank", F.row_number().over(from_end)).where(F.col("__rank") <= tail_lines).drop("__rank")
    return out


def with_pod_path(lines: DataFrame, path: str = "path") -> DataFrame:
    """namespace, pod and container out of a node's log path."""
    pattern = r"/var/log/pods/([^_/]+)_([^_/]+)_[^/]*/([^/]+)/[^/]*\.log\z"
    return lines.select("*", *[F.regexp_extract(path, pattern, i + 1).alias(n) for i, n in enumerate(("namespace", "pod", "container"))])
