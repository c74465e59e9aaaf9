"""Samples and splits that do not depend on how the table is partitioned."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiscope.functions.text import hash_bucket, hash_order

PARTS = ("train", "validation", "test")


def _bucket_share(fraction: float, buckets: int) -> int:
    share = round(fraction * buckets)
    if abs(share - fraction * buckets) > 1e-9:
        raise ValueError(f"{fraction} is not a whole number of {buckets} buckets; use more buckets")
    return share


def sample_rows(
    df: DataFrame, fraction: float, seed: int = 42, key: str | None = None, buckets: int = 100
) -> DataFrame:
    """A sample without replacement.

    With a ``key`` the same rows are taken however the table is partitioned. Without one Spark's
    own sampler is used, whose choice depends on the partitions.
    """
    if key is None:
        return df.sample(withReplacement=False, fraction=fraction, seed=seed)
    return df.filter(hash_bucket(F.col(key), seed, buckets) < _bucket_share(fraction, buckets))


def split_rows(
    df: DataFrame,
    key: str,
    weights: Sequence[float] = (0.70, 0.15, 0.15),
    names: Sequence[str] = PARTS,
    seed: int = 42,
    buckets: int = 100,
    out: str = "part",
) -> DataFrame:
    """Add the part each row belongs to. With the text as ``key`` equal articles stay together."""
    if len(weights) != len(names) or abs(sum(weights) - 1.0) > 1e-9:
        raise ValueError("give one weight per part, adding up to 1")
    bounds = [_bucket_share(round(total, 9), buckets) for total in accumulate(weights)]
    bucket = hash_bucket(F.col(key), seed, buckets)
    part = F.lit(names[-1])
    for name, bound in reversed(list(zip(names[:-1], bounds[:-1]))):
        part = F.when(bucket < bound, F.lit(name)).otherwise(part)
    return df.withColumn(out, part)


def part_sizes(df: DataFrame, part: str = "part") -> DataFrame:
    return df.groupBy(part).agg(F.count(F.lit(1)).alias("articles"))


def pick_per_group(
    df: DataFrame, group: str, key: str, n: int = 10, seed: int = 42, out: str = "row_num"
) -> DataFrame:
    """Up to ``n`` rows per group in seeded random order, with their rank.

    The filter sits on the rank itself, so each task keeps only its own first ``n`` per group
    before the shuffle: a group of any size costs ``n`` rows per task.
    """
    order = Window.partitionBy(group).orderBy(hash_order(F.col(key), seed), F.col(key))
    return (
        df.withColumn(out, F.row_number().over(order))
        .filter(F.col(out) <= n)
        .withColumn(out, F.col(out).cast("bigint"))
    )
