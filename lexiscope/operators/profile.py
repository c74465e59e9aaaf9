"""Column profile: distinct values, cardinality, nulls and empty strings, in one job.

A table that grows by slices need not be read again: each slice has a sketch of its own, of fixed
size, and sketches add up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOTAL_ROWS = "TOTAL_ROWS"
PRECISION = 12  # a sketch has 2 ** 12 registers for each column


def _percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole) * 100


def _distinct(df: DataFrame, field: T.StructField, approximate: bool) -> Column:
    value = F.col(f"`{field.name}`")
    if approximate:
        return F.approx_count_distinct(value)
    if isinstance(field.dataType, T.StringType):
        # 32 bytes per value travel through the shuffle instead of a whole article.
        value = F.unhex(F.sha2(value.cast("binary"), 256))
    return F.count_distinct(value)


def profile_columns(df: DataFrame, approximate: bool = False) -> DataFrame:
    """One row per column with all counts and percentages.

    Nulls are no distinct value. Only strings can be empty; other types have null there. With
    ``approximate`` the distinct counts are estimates that need no shuffle of the values.
    """
    fields = df.schema.fields
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i, field in enumerate(fields):
        value = F.col(f"`{field.name}`")
        aggregates.append(_distinct(df, field, approximate).alias(f"distinct_{i}"))
        aggregates.append(F.count_if(value.isNull()).alias(f"nulls_{i}"))
        if isinstance(field.dataType, T.StringType):
            aggregates.append(F.count_if(value == "").alias(f"empties_{i}"))
        else:
            aggregates.append(F.max(F.lit(None).cast("bigint")).alias(f"empties_{i}"))
    rows = [
        F.struct(
            F.lit(field.name).alias("column_name"),
            F.col(f"distinct_{i}").alias("distinct_values"),
            F.col(f"nulls_{i}").alias("nulls"),
            F.col(f"empties_{i}").alias("empties"),
            F.col("rows").alias("total_rows"),
        )
        for i, field in enumerate(fields)
    ]
    unsuitable = F.col("nulls") + F.coalesce("empties", F.lit(0))
    return (
        df.agg(*aggregates)
        .select(F.inline(F.array(*rows)))
        .select(
            "column_name",
            "total_rows",
            "distinct_values",
            _percent(F.col("distinct_values"), F.col("total_rows")).alias("cardinality_pct"),
            "nulls",
            _percent(F.col("nulls"), F.col("total_rows")).alias("null_pct"),
            "empties",
            _percent(F.col("empties"), F.col("total_rows")).alias("empty_pct"),
            unsuitable.alias("unsuitable"),
            _percent(unsuitable, F.col("total_rows")).alias("unsuitable_pct"),
        )
    )


def distinct_counts(df: DataFrame) -> DataFrame:
    """Exact distinct count of every column in a single row."""
    return df.agg(*[_distinct(df, f, False).alias(f.name) for f in df.schema.fields])


def column_report(df: DataFrame, approximate: bool = False) -> DataFrame:
    """The short report: one row per column and a last row with the number of rows."""
    profile = profile_columns(df, approximate)
    column = F.struct("column_name", "distinct_values", "cardinality_pct", "nulls", "empties")
    total = F.struct(
        F.lit(TOTAL_ROWS).alias("column_name"),
        F.col("total_rows").alias("distinct_values"),
        F.lit(None).cast("double").alias("cardinality_pct"),
        F.lit(None).cast("bigint").alias("nulls"),
        F.lit(None).cast("bigint").alias("empties"),
    )
    # The first column's row also carries the total, so the table is read once.
    first = F.col("column_name") == df.columns[0]
    rows = F.when(first, F.array(column, total)).otherwise(F.array(column))
    return profile.select(F.inline(rows))


def sketch_profile(df: DataFrame, precision: int = PRECISION) -> DataFrame:
    """One row per column of a slice: ``rows``, ``nulls``, ``empties`` and a ``sketch`` of its values.

    Store it beside the slice. A task sends one sketch per column, whatever it has read.
    """
    fields = df.schema.fields
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i, field in enumerate(fields):
        value = F.col(f"`{field.name}`")
        text = isinstance(field.dataType, T.StringType)
        # the sketch takes few types; other values count by how they are written
        plain = isinstance(field.dataType, (T.StringType, T.BinaryType, T.IntegerType, T.LongType))
        known = value if plain else value.cast("string")
        aggregates += [
            F.count_if(value.isNull()).alias(f"nulls_{i}"),
            (F.count_if(value == "") if text else F.max(F.lit(None).cast("bigint"))).alias(f"empties_{i}"),
            F.hll_sketch_agg(known, precision).alias(f"sketch_{i}"),
        ]
    rows = [
        F.struct(
            F.lit(field.name).alias("column_name"),
            "rows",
            F.col(f"nulls_{i}").alias("nulls"),
            F.col(f"empties_{i}").alias("empties"),
            F.col(f"sketch_{i}").alias("sketch"),
        )
        for i, field in enumerate(fields)
    ]
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def merge_profiles(sketches: DataFrame, precision: int = PRECISION) -> DataFrame:
    """The profile of all slices from the stored sketches of each, whose tables are not read again.

    Rows, nulls and empties are exact. ``distinct_values`` is an estimate whose standard error is
    ``relative_error``; at most ``least_distinct`` to ``most_distinct``, three times as much on both
    sides, hold the true number in all but a few of a thousand cases. A profile of slices can itself
    be stored and merged: its ``sketch`` is that of all of them.
    """
    error = 1.04 / 2 ** (precision / 2)
    merged = sketches.groupBy("column_name").agg(
        F.sum("rows").alias("rows"),
        F.sum("nulls").alias("nulls"),
        F.sum("empties").alias("empties"),
        F.hll_union_agg("sketch").alias("sketch"),
    )
    estimate = F.hll_sketch_estimate("sketch")
    empty = F.when(F.col("empties") > 0, 1).otherwise(0)  # a sketch doesn't take the empty string
    return merged.select(
        "column_name", "rows", "nulls", "empties", "sketch",
        (estimate + empty).alias("distinct_values"),
        F.lit(error).alias("relative_error"),
        (F.floor(estimate * (1 - 3 * error)) + empty).alias("least_distinct"),
        (F.ceil(estimate * (1 + 3 * error)) + empty).alias("most_distinct"),
    )
