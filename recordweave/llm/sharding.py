"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Each shard draws a number u in (0, 1) from a hash of the record's key and its own number; the shard with the least
-ln(u) / weight takes the record.  A shard wins a share of the keys in proportion to its weight, and another shard
only takes records to itself: the draws of the others stay as they are.  Nothing but the key and the shards decides,
so any task of any run can place any record, and no table of places is kept.

Slots number the records of a shard without gaps.  Records are range-partitioned by shard and place, sorted inside the
partitions and numbered there; the counts of the partitions (a row for each partition and shard) give the offsets.
Rows that share a key are told apart by a row number in that order, so a key that very many rows hold is spread as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, unused

#: Shards of the registered query, of equal weight.
WEIGHTS = (1.0,) * 16
#: Bits of a draw.
_BITS = 52


def _draw(key: Column, shard: Column) -> Column:
    """A whole number of 52 bits from a record's key and a shard's number."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("shard:"), shard.cast("string"), key)), 1, 13), 16, 10).cast("long")


def rendezvous(key: Column, weights: tuple[float, ...]) -> Column:
    """The draws of all shards for a key as an array of (score, shard, draw); the least one wins, ties go to the lower shard.

    A null key is a key of its own.
    """
    if not weights or not all(0 < w < float("inf") for w in weights):
        raise ValueError("shards need finite weights above 0")
    text = F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit(""))
    shares = F.array(*map(F.lit, map(float, weights)))

    def drawn(shard: Column) -> Column:
        draw = _draw(text, shard)
        score = -F.ln((draw + F.lit(0.5)) / F.lit(float(1 << _BITS))) / F.get(shares, shard)
        return F.struct(score.alias("score"), shard.alias("shard"), draw.alias("draw"))

    return F.transform(F.sequence(F.lit(0), F.lit(len(weights) - 1)), drawn)


def shard_records(rows: DataFrame, key: str, weights: tuple[float, ...] = WEIGHTS, ties: tuple[str, ...] = (), another: float = 1.0) -> DataFrame:
    """``rows`` with shard, slot and grown_shard (the shard if one of weight ``another`` were added).

    Slots follow the draws, a fixed pseudo-random order; rows of one key follow the columns ``ties``, and rows that agree
    in these as well are in no fixed order.  A null key is a key of its own; rows of one key share a shard, each with a
    slot of its own.  An empty table stays empty.  Columns of ``rows`` named shard, slot or grown_shard are replaced; others
    stay, whatever their names.
    """
    rows = rows.drop("shard", "slot", "grown_shard")
    all_name, row, place, part, first, before = unused(rows, "__drawn", "__row", "__place", "__part", "__first", "__before")
    names = rows.columns
    drawn = rows.withColumn(all_name, rendezvous(F.col(key), (*weights, another)))
    best = F.array_min(F.slice(all_name, 1, len(weights)))
    # Materialised: the range partitioner reads its input twice, the first time for a sample of bounded size.
    drawn = cut(drawn.select(*names, best.alias(all_name), F.array_min(all_name)["shard"].alias("grown_shard"), F.monotonically_increasing_id().alias(row)))
    drawn = drawn.select(*names, F.col(all_name)["shard"].alias("shard"), F.col(all_name)["draw"].alias(all_name), "grown_shard", row)
    order = ["shard", all_name, key, *ties, row]
    placed = cut(drawn.repartitionByRange(*order).sortWithinPartitions(*order).select(*names, "shard", "grown_shard", F.monotonically_increasing_id().alias(place)))
    placed = placed.withColumn(part, F.shiftright(place, 33))
    # At most a row for each partition and one more for each shard, so Spark broadcasts them after measuring.
    runs = placed.groupBy(F.col(part).alias("p"), F.col("shard").alias("s")).agg(F.min(place).alias(first), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("s").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(F.col("p").alias(f"{part}_p"), F.col("s").alias(f"{part}_s"), first, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before))
    out = placed.join(runs, (F.col(part) == F.col(f"{part}_p")) & (F.col("shard") == F.col(f"{part}_s")))
    return out.select(*names, "shard", (F.col(before) + F.col(place) - F.col(first)).alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", weights: tuple[float, ...] = WEIGHTS, rows_per_file: int = 0) -> None:
    """Writes ``docs`` under ``path`` with a folder for each shard (shard=0 ...), its files sorted by slot."""
    sharded = shard_records(docs, key, weights).drop("grown_shard")
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)


def shard_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard), one for each row of ``docs``.

    size is the UTF-8 bytes of the text and 1, text_crc32 its unsigned CRC; null text counts as empty.  Null ids are one
    key.  An empty table gives no rows.  Other columns are not read.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(t) + F.lit(1)).cast("long").alias("size"), F.crc32(F.encode(t, "UTF-8")).cast("long").alias("text_crc32"))
    out = shard_records(rows, "doc_id", weights, ties=("text_crc32", "size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.col("grown_shard").cast("int").alias("grown_shard"))
