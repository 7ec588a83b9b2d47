"""Sink projections and writers: JSON lines, topic rows, bulk text, partitioned objects, fan-out."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashes import hash_partition
from ..functions.names import index_name, writer_compression
from ..operators.parsers import event_json
from ..storage import materialised

Output = Callable[[DataFrame, int], None]


def json_lines(events: DataFrame) -> DataFrame:
    """One column ``value``: an event per line."""
    return events.select(event_json(events).alias("value"))


def topic_rows(events: DataFrame, topic: str, topic_field: str = "", key_field: str = "", strategy: str = "hash", partitions: int = 0, partition_field: str = "") -> DataFrame:
    """(topic, key, value) for a message broker: topic and key from fields where they are set and not empty.

    There is a column partition where the number of partitions is given, or the strategy isn't hash: by the key's hash
    (null, and so the client's choice, without a key), at random, in turn (round-robin), or the number in a field
    (manual; 0 where there is none).
    """
    n = max(partitions, 1)
    field = lambda n: F.nullif(F.try_element_at("fields", F.lit(n)), F.lit("")) if n else F.lit(None).cast("string")
    dealt = {
        "hash": (lambda: hash_partition(field(key_field), n)) if partitions else None,
        "random": lambda: F.floor(F.rand() * n).cast("int"),
        "round-robin": lambda: F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int"),
        "manual": lambda: F.pmod(F.coalesce(field(partition_field).try_cast("int"), F.lit(0)), F.lit(n)),
    }
    if strategy not in dealt:
        raise ValueError(f"unknown partition strategy: {strategy}")
    more = [dealt[strategy]().alias("partition")] if dealt[strategy] else []
    return events.select(F.coalesce(field(topic_field), F.lit(topic)).alias("topic"), field(key_field).alias("key"), event_json(events).alias("value"), *more)


def bulk_lines(events: DataFrame, index: str, rotation: str = "daily", pipeline: str = "", identity: tuple[str, ...] = ()) -> DataFrame:
    """(index, body): action and document lines for a search engine's bulk request.

    With ``identity`` (columns that tell events apart, such as source and offset) documents have an id made of them, so
    one that is sent again replaces itself.
    """
    name = index_name(index, rotation, F.col("timestamp"))
    told = F.sha2(F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in identity])), 256) if identity else None
    action = F.struct(name.alias("_index"), *([told.alias("_id")] if identity else []), *([F.lit(pipeline).alias("pipeline")] if pipeline else []))
    return events.select(name.alias("index"), F.concat(F.to_json(F.struct(action.alias("index"))), F.lit("\n"), event_json(events), F.lit("\n")).alias("body"))


def send_bodies(bodies: DataFrame, addresses: list[str], batch: int = 1000, headers: dict[str, str] | None = None, timeout: float = 30.0) -> DataFrame:
    """Sends the column ``body`` as bulk requests from the executors; (body, status, error) of each item.

    A request that fails as a whole gives all its items its status (0 where there was no answer).
    """
    sent_headers = {"Content-Type": "application/x-ndjson"} | (headers or {})

    def run(batches):
        import json
        import urllib.error
        import urllib.request

        import pyarrow as pa

        turn = 0
        for rows in batches:
            bodies, out = rows.column(0).to_pylist(), []
            for i in range(0, len(bodies), batch):
                part = bodies[i : i + batch]
                url = addresses[turn % len(addresses)].rstrip("/") + "/_bulk"
                turn += 1
                try:
                    with urllib.request.urlopen(urllib.request.Request(url, "".join(part).encode(), sent_headers), timeout=timeout) as answer:
                        items = [next(iter(x.values())) for x in json.load(answer)["items"]]
                    out += [(int(x.get("status", 0)), json.dumps(x["error"]) if "error" in x else None) for x in items]
                except urllib.error.HTTPError as e:
                    out += [(e.code, str(e))] * len(part)
                except OSError as e:
                    out += [(0, str(e))] * len(part)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([s for s, _ in out], pa.int32()), pa.array([e for _, e in out], pa.string())], ["body", "status", "error"])

    return bodies.select("body").mapInArrow(run, "body string, status int, error string")


def send_bulk(
    events: DataFrame, addresses: list[str], index: str, rotation: str = "daily", pipeline: str = "", batch: int = 1000, headers: dict[str, str] | None = None, timeout: float = 30.0, identity: tuple[str, ...] = ()
) -> DataFrame:
    """Sends the events; (body, status, error) of each, so failed items can go to dead letters."""
    return send_bodies(bulk_lines(events, index, rotation, pipeline, identity), addresses, batch, headers, timeout)


def deliver_bulk(
    events: DataFrame, run: str, addresses: list[str], index: str, rotation: str = "daily", pipeline: str = "", batch: int = 1000, identity: tuple[str, ...] = (), dead_letters: str = "", attempts: int = 3, wait: float = 1.0
) -> int:
    """Sends the events until each is accepted or refused, and gives the number of refused ones.

    Only items that may pass later (429, 500 and above, no answer) are sent again; if some are left after all attempts,
    that is an error, and the batch comes again: with ``identity`` its accepted documents then replace themselves.  Refused
    items are written under ``dead_letters`` in a folder of the run, which a repeated run overwrites; without that
    folder they are an error as well.
    """
    passing = (F.col("status") == 429) | (F.col("status") >= 500) | (F.col("status") < 200)
    waiting, refused = bulk_lines(events, index, rotation, pipeline, identity), []
    for attempt in range(attempts):
        if attempt:
            time.sleep(wait * 2 ** (attempt - 1))
        # Materialised: reading an answer again would send again.
        failed = materialised(send_bodies(waiting, addresses, batch).where("status < 200 OR status >= 300"))
        refused.append(failed.where(~passing))
        waiting = failed.where(passing)
        if not waiting.limit(1).count():
            break
    else:
        raise RuntimeError(f"items not accepted: { {r['status']: r['count'] for r in waiting.groupBy('status').count().collect()} }")  # a row a status
    letters = reduce(DataFrame.unionByName, refused)
    n = letters.count()
    if n and not dead_letters:
        raise RuntimeError(f"items refused: { {r['status']: r['count'] for r in letters.groupBy('status').count().collect()} }")
    if dead_letters:
        letters.write.mode("overwrite").json(f"{dead_letters}/batch={run}")
    return n


def write_objects(events: DataFrame, path: str, compression: str = "none") -> None:
    """JSON lines under year/month/day/hour folders."""
    parts = {"year": "yyyy", "month": "MM", "day": "dd", "hour": "HH"}
    rows = events.select(event_json(events).alias("value"), *[F.date_format("timestamp", f).alias(n) for n, f in parts.items()])
    rows.write.mode("append").partitionBy(*parts).option("compression", writer_compression(compression)).text(path)


def text_output(path: str) -> Output:
    """A batch's JSON lines under a folder of its own, so a repeated batch overwrites itself."""
    return lambda df, batch: json_lines(df).write.mode("overwrite").text(f"{path}/batch={batch}")


class RoutingError(RuntimeError):
    """Outputs that failed, by name."""

    def __init__(self, failed: dict[str, Exception]):
        super().__init__("; ".join(f"{k}: {v}" for k, v in failed.items()))
        self.failed = failed


def router(outputs: dict[str, Output], parallel: bool = True, on_error: str = "continue") -> Output:
    """A foreachBatch function that gives every batch to all outputs.

    ``continue`` keeps failures to itself (they are in ``.failures``); ``stop`` raises: at once when sequential, after
    all are done when parallel.
    """
    if on_error not in ("continue", "stop"):
        raise ValueError(f"unknown failure policy: {on_error}")

    def send(df: DataFrame, batch: int) -> None:
        failed: dict[str, Exception] = {}
        df.persist()
        try:

            def one(name: str) -> None:
                try:
                    outputs[name](df, batch)
                except Exception as e:  # noqa: BLE001  the policy decides
                    failed[name] = e
                    if on_error == "stop" and not parallel:
                        raise RoutingError(failed) from e

            if parallel:
                with ThreadPoolExecutor(len(outputs)) as pool:
                    list(pool.map(one, outputs))
            else:
                for name in outputs:
                    one(name)
        finally:
            df.unpersist()
        send.failures.append(failed)
        if failed and on_error == "stop":
            raise RoutingError(failed)

    send.failures = []
    return send
