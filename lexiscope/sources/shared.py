"""Tables written to the folder that every executor can reach."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, or else one in the session's warehouse.

    Both are places that all executors share; nothing is ever put into a folder of one machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_intermediate"


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    for made in _OPEN:
        made.append(path)
    return path


def write_and_reread(df: DataFrame, label: str) -> DataFrame:
    """Store a table in the shared folder and return it as read back, with its lineage cut."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def finished_shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Let Spark remove the shuffle files of each query that ends inside, not at its next collection.

    For tables that are stored and read again: one that runs a second time is shuffled anew.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


_OPEN: list[list[str]] = []


@contextmanager
def intermediate_files(spark: SparkSession) -> Iterator[list[str]]:
    """Delete, at the end, the intermediate files that were made inside, and no others.

    Results must have been stored or collected by then: tables that read these files are gone.
    """
    made: list[str] = []
    _OPEN.append(made)
    try:
        yield made
    finally:
        _OPEN.remove(made)
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in made:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)
