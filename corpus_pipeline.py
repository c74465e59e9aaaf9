"""The corpus pipeline: from the raw documents to token ids, in stages.

Each stage reads what the one before has kept, as Parquet, and calls one operator. All but the last
give the columns of ``documents``:

1. quality: documents that the classifier rejects go. It is fitted on the labelled documents that
   are not held out.
2. lines: lines that nearly repeat an earlier one go; documents that lose their last word by it go.
3. near_duplicates: of each group of near-duplicate documents the one with the smallest id stays.
4. decontamination: documents that hold a passage of a benchmark item go.
5. piece_codec: the ids of every text, their number, and what they decode to.

Null and empty texts pass stages 2 to 4 as they are, and have no ids in the end. SQL can express
neither the classifier nor the codec, so there is no SQL for the whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiscope.llm import line_join, piece_codec, quality, seeds, shingle_join
from lexiscope.llm.queries import PIECE_MODEL, table
from lexiscope.llm.ship import ship_package
from lexiscope.plans.query import Query
from lexiscope.sources.shared import write_and_reread

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train_quality(docs, table(spark, sf_dir, "labels"))
    return quality.keep_quality(docs, model)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = line_join.remove_repeated_lines(docs)
    removed = line_join.count_columns(docs)[1]
    lost = (F.col(removed) > 0) & (F.trim(F.translate("text", "\n\t\r", "   ")) == "")
    columns = [
        F.when(F.col(removed) > 0, F.length("text").cast(docs.schema[c].dataType))
        .otherwise(F.col(c))
        .alias(c)
        if c == "n_chars"
        else F.col(c)
        for c in docs.columns
    ]
    return cleaned.filter(~F.coalesce(lost, F.lit(False))).select(*columns)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return shingle_join.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return seeds.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return piece_codec.encode_and_decode(docs, PIECE_MODEL)


STAGES: list[tuple[str, Stage]] = [
    ("quality", good_documents),
    ("lines", without_repeated_lines),
    ("near_duplicates", one_of_near_duplicates),
    ("decontamination", without_benchmark),
    ("piece_codec", token_ids),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_and_reread(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": Query(run, ORACLE_SQL)}
