"""Categorise articles that arrive as files, with a classifier trained beforehand.

Every stage of a trained classifier works row by row, so the stream needs no state.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lexiscope.operators.classify import categorize


def arriving_articles(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def store_categories(
    articles: DataFrame, model: PipelineModel, folder: str, checkpoint: str
) -> StreamingQuery:
    """Append every arriving article with its predicted category to ``folder``; stops when done.

    ``checkpoint`` is a folder of this stream; run it again with the same one to continue where it
    stopped, so that no article is stored twice.
    """
    return (
        categorize(articles, model)
        .drop("probability")
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(folder)
    )
