"""Looking at a table: its size, its first rows and its schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def preview(df: DataFrame, n: int, order: Sequence[str | Column]) -> DataFrame:
    """The first ``n`` rows in the given order (a top-n per partition, not a full sort)."""
    return df.orderBy(*order).limit(n)


def schema_report(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, nullability and how many values are present."""
    present = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)])
    rows = [
        F.struct(
            F.lit(i).cast("bigint").alias("position"),
            F.lit(field.name).alias("column_name"),
            F.lit(field.dataType.simpleString()).alias("data_type"),
            F.lit(field.nullable).alias("nullable"),
            F.col(f"c{i}").alias("present"),
        )
        for i, field in enumerate(df.schema.fields)
    ]
    return present.select(F.inline(F.array(*rows)))


def is_local(df: DataFrame) -> bool:
    """Whether the rows can be had without running anything on executors."""
    return df.isLocal()
