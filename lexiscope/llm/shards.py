"""Sharding by sampled splitters: ranges of a key that hold nearly the same number of bytes.

Records are ordered by a hash of their text and by their id, so equal texts stand side by side.
Splitters are the quantiles of a sample of that order, drawn with a chance in proportion to the
size of a record. They cut the order into many more ranges than there are shards; a range that
turns out overfull is cut again by a sample of its own records. The exact sizes of the ranges and
the order inside each give the place of every record among all bytes, and shard ``s`` takes the
records whose first byte lies in the ``s``-th of equal parts of them. So the shards differ by less
than two records whatever was sampled, and a text that is a third of all rows spreads over as many
shards as it fills.

Law: ``bytes``. Defined results: a null text counts as the empty one (size 16, checksum 0); records
of equal text and id are ordered by where they were read; a null id comes first; an empty table
gives an empty one. The sample on the driver holds about ``SAMPLE_PER_RANGE`` keys for each range,
and there is a range for every ``RANGE_RECORDS`` records or ``RANGES_PER_SHARD`` for each shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiscope.sources.shared import write_and_reread

HEAD_BYTES = 16  # counted for every record beside its text
RANGES_PER_SHARD = 32
RANGE_RECORDS = 1_000_000
SAMPLE_PER_RANGE = 40
OVERFULL = 2.0  # times the mean size of a range
ROUNDS = 4
KEY = np.dtype([("hash", "i8"), ("doc_id", "i8"), ("read_at", "i8")])
NO_ID = -(2**63)


def record_sizes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """What sharding needs to know of each record; the text itself goes no further."""
    content = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(key).cast("bigint").alias("doc_id"),
        (F.octet_length(content) + HEAD_BYTES).cast("bigint").alias("size"),
        F.crc32(content).alias("text_crc32"),
        F.xxhash64(content).alias("hash"),
        F.monotonically_increasing_id().alias("read_at"),
    )


def _keys(hashes, ids, places) -> np.ndarray:
    keys = np.empty(len(hashes), KEY)
    keys["hash"], keys["doc_id"], keys["read_at"] = hashes, ids, places
    return keys


def _sampled(records: DataFrame, rate: float, seed: int) -> list[tuple[int, int, int]]:
    """Sorted keys of a sample; a record is drawn with a chance of ``rate`` times its size."""
    draw = F.pmod(F.xxhash64("read_at", "hash", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    drawn = records.filter(draw < F.col("size") * F.lit(rate))
    rows = drawn.select("hash", F.coalesce("doc_id", F.lit(NO_ID)), "read_at").collect()
    return sorted(tuple(row) for row in rows)


def _quantiles(sample: list, parts: int) -> list:
    return [sample[len(sample) * i // parts] for i in range(1, parts)] if sample else []


def _in_ranges(records: DataFrame, splitters: list) -> DataFrame:
    """Add the number of the range each record belongs to."""
    bounds = np.array(sorted(set(splitters)), KEY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").fill_null(NO_ID)
            keys = _keys(batch.column("hash"), ids, batch.column("read_at"))
            place = np.searchsorted(bounds, keys, side="right")
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(place, pa.int64())], names=[*batch.schema.names, "range"]
            )

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in records.schema)
    return records.mapInArrow(run, f"{schema}, range bigint")


def assign_shards(
    docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Shard and slot of every record, with its size and the checksum of its text."""
    records = write_and_reread(record_sizes(docs, key, text), "record-sizes")
    total, count = records.agg(
        F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))
    ).first()
    ranges = max(shards * RANGES_PER_SHARD, -(-count // RANGE_RECORDS))
    ideal = max(total / ranges, 1.0)
    splitters = _quantiles(_sampled(records, SAMPLE_PER_RANGE / ideal, 0), ranges)
    for seed in range(1, ROUNDS + 1):
        ranged = _in_ranges(records, splitters)
        sizes = ranged.groupBy("range").agg(
            F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")
        )
        held = sorted(tuple(row) for row in sizes.collect())
        overfull = [r for r, size, rows in held if size > OVERFULL * ideal and rows > 1]
        if not overfull or seed == ROUNDS:
            break
        inside = ranged.filter(F.col("range").isin(overfull))
        more = _sampled(inside, SAMPLE_PER_RANGE / ideal, seed)
        bounds = np.array(sorted(set(splitters)), KEY)
        place = np.searchsorted(bounds, np.array(more, KEY), side="right") if more else []
        for r, size, _ in (h for h in held if h[0] in set(overfull)):
            own = [k for k, p in zip(more, place) if p == r]
            splitters = splitters + _quantiles(own, int(-(-size // ideal)))
    before, rows_before, starts = 0, 0, []
    for r, size, rows in held:
        starts.append((r, before, rows_before))
        before, rows_before = before + size, rows_before + rows
    spark = docs.sparkSession
    offsets = spark.createDataFrame(starts, "range bigint, before bigint, rows_before bigint")
    inside = Window.partitionBy("range").orderBy("hash", F.col("doc_id").asc_nulls_first(), "read_at")
    running = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    # one row per range, as many as were counted above
    placed = ranged.join(F.broadcast(offsets), "range").select(
        "doc_id",
        "size",
        "text_crc32",
        (F.col("before") + running - F.col("size")).alias("first_byte"),
        (F.col("rows_before") + F.row_number().over(inside) - 1).alias("place"),
    )
    shard = F.floor(
        F.col("first_byte").cast("decimal(38,0)") * F.lit(shards) / F.lit(max(total, 1))
    )
    stored = write_and_reread(placed.withColumn("shard", shard.cast("int")), "record-places")
    firsts = stored.groupBy("shard").agg(F.min("place").alias("first_place"))
    # one row per shard
    return stored.join(F.broadcast(firsts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("place") - F.col("first_place")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(
    docs: DataFrame, path: str, shards: int, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Write the records, one folder per shard, and give the table of shards and slots.

    The id must be unique here: it tells which record goes where.
    """
    assigned = assign_shards(docs, shards, key, text)
    where = assigned.select(F.col("doc_id").alias("__key"), F.col("shard").alias("__shard"))
    joined = docs.join(where, F.col(key).eqNullSafe(F.col("__key"))).drop("__key")
    joined.repartition("__shard", F.xxhash64(key) % 16).write.partitionBy("__shard").parquet(path)
    return assigned
