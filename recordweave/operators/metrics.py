"""Metrics from event fields: counters, gauges, histograms, windowed rates and quantiles."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.regexes import translate
from ..functions.values import number_text, parse_float

# Bucket bounds.
DEFAULT_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
RESPONSE_BUCKETS = (10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0, 2500.0, 5000.0)
NAME_PREFIX = "extracted_"
# End of the fixed values.


@dataclass(frozen=True)
class MetricRule:
    """A metric of ``kind`` (counter, gauge, histogram) from a field: its number, or that of group 1 of ``pattern``."""

    name: str
    kind: str
    field: str
    pattern: str = ""
    labels: dict[str, str] = field(default_factory=dict)
    label_fields: dict[str, str] = field(default_factory=dict)
    buckets: tuple[float, ...] = ()

    def __post_init__(self):
        if self.kind not in ("counter", "gauge", "histogram"):
            raise ValueError(f"unknown metric type: {self.kind}")
        if self.pattern:
            translate(self.pattern)

    @property
    def metric(self) -> str:
        return NAME_PREFIX + self.name


def exponential_buckets(start: float, factor: float, count: int) -> tuple[float, ...]:
    return tuple(start * factor**i for i in range(count))


RESPONSE_TIME = MetricRule("http_response_time", "histogram", "response_time_ms", label_fields={"method": "http_method", "status": "http_status", "path": "http_path"}, buckets=RESPONSE_BUCKETS)
REQUEST_COUNT = MetricRule("http_requests", "counter", "request_count", label_fields={"method": "http_method", "status": "http_status"})
ERROR_COUNT = MetricRule("errors", "counter", "error_count", label_fields={"level": "level", "service": "service"})


def metric_value(fields: Column, rule: MetricRule) -> Column:
    """The field as a number; null (the event doesn't count) where it is missing or none."""
    text = F.try_element_at(fields, F.lit(rule.field))
    value = parse_float(text)
    if rule.pattern:
        # group 1 carries the number, so plain groups capture here
        value = F.coalesce(value, parse_float(F.regexp_extract(text, translate(rule.pattern, capture_all=True).java, 1)))
    return value


def metric_labels(fields: Column, rule: MetricRule) -> list[Column]:
    """Label columns: dynamic ones ('' where the field is missing), static ones over them."""
    return [F.lit(rule.labels[n]).alias(n) if n in rule.labels else F.coalesce(F.try_element_at(fields, F.lit(rule.label_fields[n])), F.lit("")).alias(n) for n in sorted({*rule.labels, *rule.label_fields})]


def measured(events: DataFrame, rule: MetricRule, order: tuple[str, ...] = ()) -> DataFrame:
    """Labels, value and ordering columns of the events that count for a rule."""
    labels = metric_labels(F.col("fields"), rule)
    return events.select(*labels, metric_value(F.col("fields"), rule).alias("value"), *order).where("value is not null")


def label_names(rule: MetricRule) -> list[str]:
    return sorted({*rule.labels, *rule.label_fields})


def counter(events: DataFrame, rule: MetricRule) -> DataFrame:
    return measured(events, rule).groupBy(*label_names(rule)).agg(F.sum("value").alias("value"))


def gauge(events: DataFrame, rule: MetricRule, order: tuple[str, ...] = ("timestamp", "seq")) -> DataFrame:
    """The last value by the ordering columns."""
    return measured(events, rule, order).groupBy(*label_names(rule)).agg(F.max_by("value", F.struct(*order)).alias("value"))


def histogram(events: DataFrame, rule: MetricRule) -> DataFrame:
    """Rows (labels, le, bucket_count, sum, count): cumulative counts for each bound and infinity, in one aggregation."""
    bounds = (*(rule.buckets or DEFAULT_BUCKETS), float("inf"))
    names = label_names(rule)
    counts = [F.count_if(F.col("value") <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    wide = measured(events, rule).groupBy(*names).agg(*counts, F.sum("value").alias("sum"), F.count(F.lit(1)).alias("count"))
    rows = F.explode(F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("bucket_count")) for i, b in enumerate(bounds)]))
    return wide.select(*names, rows.alias("b"), "sum", "count").select(*names, "b.le", "b.bucket_count", "sum", "count")


def extract(events: DataFrame, rules: list[MetricRule], order: tuple[str, ...] = ("timestamp", "seq")) -> DataFrame:
    """Long table (metric, labels, le, value) of all rules; a histogram also has the series <metric>_sum and <metric>_count."""
    out = None
    for rule in rules:
        labels = F.create_map(*[x for n in label_names(rule) for x in (F.lit(n), F.col(n))]) if label_names(rule) else F.create_map().cast("map<string,string>")
        if rule.kind == "histogram":
            one = F.struct(F.lit(rule.metric).alias("metric"), "le", F.col("bucket_count").cast("double").alias("value"))
            series = [F.struct(F.lit(f"{rule.metric}_{n}").alias("metric"), F.lit(None).cast("double").alias("le"), F.col(n).cast("double").alias("value")) for n in ("sum", "count")]
            rows = F.explode(F.when(F.col("le") == float("inf"), F.array(one, *series)).otherwise(F.array(one))).alias("m")
            df = histogram(events, rule).select(labels.alias("labels"), rows).select("m.metric", "labels", "m.le", "m.value")
        else:
            df = (counter(events, rule) if rule.kind == "counter" else gauge(events, rule, order)).select(F.lit(rule.metric).alias("metric"), labels.alias("labels"), F.lit(None).cast("double").alias("le"), "value")
        out = df if out is None else out.unionByName(df)
    return out


def rate(samples: DataFrame, value: Column, by: tuple[str, ...] = (), time: str = "ts", seconds: int = 300, slide: int | None = None) -> DataFrame:
    """Per-second increase in windows: (labels, window_start, rate).  Samples are increments, not scraped counters."""
    window = F.window(time, f"{seconds} seconds", f"{slide or seconds} seconds")
    return samples.groupBy(*by, window.alias("w")).agg((F.sum(value) / seconds).alias("rate")).select(*by, F.col("w.start").alias("window_start"), "rate")


def windowed_quantiles(
    events: DataFrame, rule: MetricRule, qs: tuple[float, ...] = (0.5, 0.95, 0.99), by: tuple[str, ...] = (), time: str = "timestamp", seconds: int = 300, slide: int | None = None, late: str = ""
) -> DataFrame:
    """(labels ``by``, window_start, rate, p50, p95, p99): quantiles of what a histogram rule counts in each window.

    That is the quantile of the buckets' rates, summed over all labels but ``by``: linear inside a bucket, the first one
    from 0; beyond the highest bound it is that bound.  ``rate`` is observations per second.  One aggregation, so it
    also runs on a stream; there ``late`` is the watermark's delay (``10 minutes``), and a window comes out when it is past.
    """
    bounds = tuple(sorted(rule.buckets or DEFAULT_BUCKETS))
    labels = [c for c in metric_labels(F.col("fields"), rule)]
    rows = events.withWatermark(time, late) if late else events
    rows = rows.select(*labels, metric_value(F.col("fields"), rule).alias("__value"), F.col(time).alias("__time")).where("__value is not null")
    counts = [F.count_if(F.col("__value") <= b).alias(f"__b{i}") for i, b in enumerate(bounds)]
    wide = rows.groupBy(*by, F.window("__time", f"{seconds} seconds", f"{slide or seconds} seconds").alias("__w")).agg(*counts, F.count(F.lit(1)).alias("__n"))

    def quantile(q: float) -> Column:
        wanted, below, low = F.col("__n") * q, F.lit(0), 0.0
        cases = []
        for i, b in enumerate(bounds):
            n = F.col(f"__b{i}")
            # only an empty first bucket can be reached without observations in it (q of 0)
            cases.append(F.when(n >= wanted, F.coalesce(F.lit(low) + F.lit(b - low) * F.try_divide(wanted - below, (n - below).cast("double")), F.lit(low))))
            below, low = n, b
        return F.coalesce(*cases, F.lit(bounds[-1]))

    names = [f"p{100 * q:g}".replace(".", "_") for q in qs]
    return wide.select(*by, F.col("__w.start").alias("window_start"), (F.col("__n") / seconds).alias("rate"), *[quantile(q).alias(n) for q, n in zip(qs, names, strict=True)])


def counter_rate(samples: DataFrame, value: str = "value", by: tuple[str, ...] = (), time: str = "ts", seconds: int = 300, slide: int | None = None) -> DataFrame:
    """(labels ``by``, window_start, increase, rate) of scraped counters, which grow and fall back to 0 when their process restarts.

    ``by`` names all labels of a series: rates are taken of each series and summed afterwards.  In a window of a series the
    increase is the last value less the first one, and the value before each fall.  It is carried on to the window's edges
    where these are nearer than 1.1 times the mean distance of samples, else for half of that distance, and at the start
    never below 0.  A window with fewer than two times has no rate.  Samples of one time count as one, the largest.
    """
    w = F.window(time, f"{seconds} seconds", f"{slide or seconds} seconds")
    s = samples.where(F.col(value).isNotNull() & F.col(time).isNotNull()).groupBy(*by, w.alias("__w"), F.col(time).alias("__time")).agg(F.max(F.col(value).cast("double")).alias("__v"))
    order = Window.partitionBy(*by, "__w").orderBy("__time")  # the samples of a series in one window
    s = s.withColumn("__was", F.lag("__v").over(order))
    e = s.groupBy(*by, "__w").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("__v", "__time").alias("first"), F.max_by("__v", "__time").alias("last"), F.coalesce(F.sum(F.when(F.col("__v") < F.col("__was"), F.col("__was"))), F.lit(0.0)).alias("lost"),
        F.min("__time").cast("double").alias("t0"), F.max("__time").cast("double").alias("t1"),
    ).where("n > 1")
    grown, sampled = F.col("last") - F.col("first") + F.col("lost"), F.col("t1") - F.col("t0")
    between = sampled / (F.col("n") - 1)
    near = lambda gap: F.when(gap >= between * 1.1, between / 2).otherwise(gap)
    to_zero = F.when((grown > 0) & (F.col("first") >= 0), sampled * F.try_divide("first", grown))
    before = F.least(near(F.col("t0") - F.col("__w.start").cast("double")), to_zero)
    after = near(F.col("__w.end").cast("double") - F.col("t1"))
    increase = grown * (sampled + before + after) / sampled
    return e.select(*by, F.col("__w.start").alias("window_start"), increase.alias("increase"), (increase / seconds).alias("rate"))


def histogram_quantile(buckets: DataFrame, q: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(labels, quantile) from cumulative buckets (labels, le, bucket_count): linear inside the bucket, the first one
    from 0, the infinite one gives the highest finite bound, no observations give NaN."""
    summed = buckets.groupBy(*by, "le").agg(F.sum("bucket_count").cast("double").alias("n"))
    w = Window.partitionBy(*by).orderBy("le")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    b = summed.withColumn("low", F.coalesce(F.lag("le").over(w), F.lit(0.0))).withColumn("below", F.coalesce(F.lag("n").over(w), F.lit(0.0)))
    b = b.withColumn("wanted", F.max("n").over(every) * q)
    hit = b.groupBy(*by).agg(
        F.max("n").alias("total"), F.min_by(F.struct("le", "low", "n", "below", "wanted"), F.when(F.col("n") >= F.col("wanted"), F.col("le"))).alias("x")
    )
    inside = F.col("x.low") + (F.col("x.le") - F.col("x.low")) * F.try_divide(F.col("x.wanted") - F.col("x.below"), F.col("x.n") - F.col("x.below"))
    value = F.when(F.coalesce("total", F.lit(0.0)) == 0, F.lit(float("nan"))).when(F.col("x.le") == float("inf"), F.col("x.low")).otherwise(F.coalesce(inside, F.col("x.low")))
    return hit.select(*by, value.alias("quantile"))


def _escaped(value: Column) -> Column:
    """A label value for the exposition: backslash, quote and line end are escaped."""
    return F.replace(F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def prometheus_text(metrics: DataFrame) -> DataFrame:
    """(line) of the exposition format for a long metric table; numbers are the shortest text (10, 0.5, 1e+07)."""
    m = metrics.withColumns({"__le": number_text("le"), "__value": number_text("value")})
    bound = F.when(F.col("le").isNotNull(), F.array(F.struct(F.lit("le").alias("key"), F.col("__le").alias("value")))).otherwise(F.array().cast("array<struct<key:string,value:string>>"))
    pairs = F.concat(F.map_entries("labels"), bound)
    shown = F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(p["key"], F.lit('="'), _escaped(p["value"]), F.lit('"'))), ",")
    name = F.concat("metric", F.when(F.col("le").isNotNull(), "_bucket").otherwise(""))
    return m.select(F.concat(name, F.when(shown != "", F.concat(F.lit("{"), shown, F.lit("}"))).otherwise(""), F.lit(" "), F.col("__value")).alias("line"))


def type_lines(rules: list[MetricRule]) -> list[str]:
    """What the exposition says before the series of each metric: its help and its kind."""
    return [x for r in rules for x in (f"# HELP {r.metric} Extracted metric: {r.name}", f"# TYPE {r.metric} {r.kind}")]
