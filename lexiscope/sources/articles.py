"""Article tables: CSV and Parquet in, managed table out."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lexiscope.functions.text import first_line
from lexiscope.sources.shared import write_and_reread

ARTICLE_COLUMNS = ("title", "summary", "body", "category")

# The field texts that a CSV reader with pandas defaults takes for a missing value.
MISSING_MARKERS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def read_articles_csv(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | Mapping[str, str] = ARTICLE_COLUMNS,
    missing_markers: Sequence[str] = MISSING_MARKERS,
) -> DataFrame:
    """Read the named columns of article CSV files as strings, whatever their order in the files.

    ``columns`` lists the names, or maps the names in the header to those wanted. Other columns,
    such as an unnamed index in front, are left out; a name that the header lacks is an error.
    Quoted fields may hold line breaks, so a single file is read by a single task: give the
    corpus as many files, or convert it to Parquet once.
    """
    wanted = dict(columns) if isinstance(columns, Mapping) else {c: c for c in columns}
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    lacking = [name for name in wanted if name not in raw.columns]
    if lacking:
        raise ValueError(f"the header has no {lacking}, only {raw.columns}")
    markers = list(missing_markers)
    named = [(raw[f"`{name}`"], alias) for name, alias in wanted.items()]
    return raw.select(*[F.when(~c.isin(markers), c).alias(alias) for c, alias in named])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``documents`` table seen as articles: doc_id, title, summary, body, category, grp."""
    documents = read_table(spark, sf_dir, "documents")
    return documents.select(
        "doc_id",
        F.concat_ws("-", "source", "doc_id").alias("title"),
        first_line(F.col("text")).alias("summary"),
        F.col("text").alias("body"),
        F.col("lang").alias("category"),
        F.col("source").alias("grp"),
    )


def with_row_id(df: DataFrame, out: str = "doc_id") -> DataFrame:
    """Give every row a unique integer. Store the table before using the ids more than once:
    reading the source again may number the rows differently.
    """
    return df.withColumn(out, F.monotonically_increasing_id())


def with_row_number(df: DataFrame, order: Sequence[str], out: str = "row_number") -> DataFrame:
    """Number all rows from 0 on, without gaps, in the order of some columns.

    The numbers depend on these columns alone, not on the partitions, so two tables with the same
    values there are numbered alike and can be put side by side. Rows that are equal in all of them
    are numbered in any order. No task sees more than a range: ranges are sorted on their own, and
    each begins with the number of rows in those before it.
    """
    names = [c for c in ("__range", "__place", "__before") if c in df.columns]
    if names:
        raise ValueError(f"the table has columns named {names}")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = write_and_reread(
        dealt.select("*", F.spark_partition_id().alias("__range"), place.alias("__place")), "ranges"
    )
    # one row per range
    sizes = placed.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).collect()
    before, total = [], 0
    for row in sorted(sizes, key=lambda row: row["__range"]):
        before.append((row["__range"], total))
        total += row["n"]
    starts = df.sparkSession.createDataFrame(before, "__range int, __before bigint")
    numbered = placed.join(F.broadcast(starts), "__range")
    return numbered.select(*df.columns, (F.col("__before") + F.col("__place")).alias(out))


def save_table(
    df: DataFrame, name: str, bucket_key: str | None = None, buckets: int | None = None
) -> DataFrame:
    """Store a managed table, replacing an older one of the same name, and return it.

    The rows are first stored under a fresh name and counted. Only then do the names change: the
    older table steps aside, the new one takes its name, and the older one goes. So a write that
    fails leaves the older table as it was, and ``df`` may read from it.

    With a ``bucket_key`` the rows are stored in buckets of that key, one file each. Joins and
    groupings on the key then move no articles, which pays off for a corpus that goes through
    several language operators. A bucket is read by one task, so ``buckets`` must be given and
    should grow with the table.
    """
    if (bucket_key is None) != (buckets is None):
        raise ValueError("give a bucket key and the number of buckets together")
    spark, mark = df.sparkSession, uuid.uuid4().hex
    new, old = f"{name}__new_{mark}", f"{name}__old_{mark}"
    written = Observation()
    counted = df.observe(written, F.count(F.lit(1)).alias("rows"))
    try:
        if bucket_key is None:
            counted.write.saveAsTable(new)
        else:
            placed = counted.repartition(buckets, bucket_key)
            placed.write.bucketBy(buckets, bucket_key).saveAsTable(new)
        stored = spark.table(new).count()
        if stored != written.get["rows"]:
            raise OSError(f"{stored} of {written.get['rows']} rows are in {new}")
    except BaseException:
        spark.sql(f"DROP TABLE IF EXISTS {new}")
        raise
    replaced = spark.catalog.tableExists(name)
    if replaced:
        spark.sql(f"ALTER TABLE {name} RENAME TO {old}")
    try:
        spark.sql(f"ALTER TABLE {new} RENAME TO {name}")
    except BaseException:
        if replaced:
            spark.sql(f"ALTER TABLE {old} RENAME TO {name}")
        spark.sql(f"DROP TABLE IF EXISTS {new}")
        raise
    if replaced:
        spark.sql(f"DROP TABLE {old}")
    return spark.table(name)
