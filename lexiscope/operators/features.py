"""From text to TF-IDF vectors: tokens, vocabulary, weights and labels."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    SQLTransformer,
    StringIndexerModel,
)
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiscope.functions.text import space_tokens
from lexiscope.operators.frequent import TRACKED, frequent_items, most_frequent, summary_error
from lexiscope.sources.shared import write_and_reread

MAX_TERMS = 2_000
MIN_DF = 0.01
MAX_DF = 0.80
BROADCAST_TERMS = 1_000_000
SUMMARY_FROM = 5_000_000  # articles


@dataclass(frozen=True)
class CorpusModel:
    """What one pass over the corpus learns: vocabulary, document frequencies and labels."""

    terms: tuple[str, ...]
    term_counts: tuple[int, ...]
    document_counts: tuple[int, ...]
    documents: int
    labels: tuple[str, ...]
    label_counts: tuple[int, ...]

    @property
    def idf(self) -> list[float]:
        return [math.log((self.documents + 1) / (df + 1)) for df in self.document_counts]

    def vocabulary_rows(self, like: DataFrame) -> DataFrame:
        """The vocabulary as a table of at most ``max_terms`` rows."""
        rows = zip(
            range(len(self.terms)), self.terms, self.term_counts, self.document_counts, self.idf
        )
        schema = "idx bigint, term string, tf bigint, df bigint, idf double"
        return like.sparkSession.createDataFrame(list(rows), schema)

    def weights_to_join(self, like: DataFrame) -> DataFrame:
        """Term and IDF; a vocabulary of at most ``BROADCAST_TERMS`` is broadcast to the tokens."""
        rows = self.vocabulary_rows(like).select("term", "idf")
        return F.broadcast(rows) if len(self.terms) <= BROADCAST_TERMS else rows

    def label_rows(self, like: DataFrame) -> DataFrame:
        rows = [
            (label, float(i), n) for i, (label, n) in enumerate(zip(self.labels, self.label_counts))
        ]
        schema = "category string, label double, articles bigint"
        return like.sparkSession.createDataFrame(rows, schema)


def combine_text(
    df: DataFrame, summary: str = "summary", body: str = "body", out: str = "combined_text"
) -> DataFrame:
    return df.withColumn(out, F.concat_ws(" ", F.col(summary), F.col(body)))


def tokenize(df: DataFrame, text: str = "combined_text", out: str = "tokens") -> DataFrame:
    """Split on every single space; case and punctuation stay, empty tokens count."""
    return df.withColumn(out, space_tokens(F.col(text)))


def _document_bound(limit: float, documents: int) -> float:
    """Below 1 a limit is a share of the documents, from 1 on a number of documents."""
    return limit if limit >= 1 else limit * documents


def fit_corpus(
    df: DataFrame,
    text: str = "combined_text",
    category: str = "category",
    max_terms: int = MAX_TERMS,
    min_df: float = MIN_DF,
    max_df: float = MAX_DF,
    summary_from: int = SUMMARY_FROM,
    tracked: int = TRACKED,
) -> CorpusModel:
    """Learn vocabulary, document frequencies and label order.

    A first pass counts the articles of each category, which takes no tokens. The second counts
    every token and every different token of an article before the shuffle, and what is stored of
    it are the terms within the limits of document frequency. Only the vocabulary, of at most
    ``max_terms``, and the labels reach the driver, where the stages of a model need them. Equal
    frequencies are in term order, equal label counts in label order.

    From ``summary_from`` articles on, a pass before that finds the terms that can reach the lower
    limit (see ``may_be_common``), and only those are counted: the shuffle then holds these few
    from each task in place of all its different terms. The result is the same.
    """
    sizes = df.groupBy(F.col(category).cast("string").alias("label")).agg(
        F.count(F.lit(1)).alias("n")
    )
    found = sizes.collect()
    documents = sum(row["n"] for row in found)
    low, high = _document_bound(min_df, documents), _document_bound(max_df, documents)

    tokens = F.coalesce(space_tokens(F.col(text)), F.array().cast("array<string>"))
    rows = df.select(tokens.alias("tokens")).select(
        F.size("tokens").alias("n"),
        F.posexplode(F.concat("tokens", F.array_distinct("tokens"))).alias("place", "term"),
    )
    if documents >= summary_from:
        candidates = may_be_common(df.select(tokens.alias("tokens")), low, tracked)
        if candidates is not None:
            rows = rows.join(candidates, "term", "left_semi")
    counted = (
        rows.groupBy("term")
        .agg(
            F.count_if(F.col("place") < F.col("n")).alias("tf"),
            F.count_if(F.col("place") >= F.col("n")).alias("df"),
        )
        .filter(F.col("df").between(low, high))
    )
    common = write_and_reread(counted, "common-terms")
    vocabulary = most_frequent(common, "tf", max_terms, "term").collect()
    labels = sorted(
        ((row["label"], row["n"]) for row in found if row["label"] is not None),
        key=lambda pair: (-pair[1], pair[0]),
    )
    return CorpusModel(
        terms=tuple(row["term"] for row in vocabulary),
        term_counts=tuple(row["tf"] for row in vocabulary),
        document_counts=tuple(row["df"] for row in vocabulary),
        documents=documents,
        labels=tuple(label for label, _ in labels),
        label_counts=tuple(n for _, n in labels),
    )


def may_be_common(rows: DataFrame, least: float, tracked: int) -> DataFrame | None:
    """The terms that at least ``least`` rows may have in their ``tokens``, or None for any.

    Every task summarises the different terms of its rows with ``tracked`` counters. The summaries
    can't miss a term above twice their error; where ``least`` is not above it they decide nothing.
    """
    different = rows.select(F.explode(F.array_distinct("tokens")).alias("term"))
    found = write_and_reread(frequent_items(different, "term", tracked=tracked), "frequent-terms")
    total = found.agg(F.max("rows")).first()[0]
    if total is None or least <= 2 * summary_error(tracked) * total:
        return None
    # at most ``tracked`` terms
    return F.broadcast(found.filter(F.col("at_most") >= least).select("term"))


def feature_stages(model: CorpusModel, text: str = "combined_text") -> PipelineModel:
    """Fitted stages from text to ``features``, each a per-row function without a shuffle.

    The document frequencies are known from the vocabulary pass, so the inverse document
    frequency is a fixed weight per term and needs no further pass over the corpus.
    """
    split = SQLTransformer(
        statement=f"SELECT *, coalesce(split(`{text}`, ' '), array()) AS tokens FROM __THIS__"
    )
    counts = CountVectorizerModel.from_vocabulary(
        list(model.terms), inputCol="tokens", outputCol="raw_features"
    )
    weigh = ElementwiseProduct(
        scalingVec=Vectors.dense(model.idf), inputCol="raw_features", outputCol="features"
    )
    return PipelineModel(stages=[split, counts, weigh])


def label_stage(
    model: CorpusModel, category: str = "category", handle_invalid: str = "error"
) -> StringIndexerModel:
    """Category to label number, the most frequent category being 0."""
    return StringIndexerModel.from_labels(
        list(model.labels), inputCol=category, outputCol="label", handleInvalid=handle_invalid
    )


def term_weights(
    df: DataFrame, model: CorpusModel, text: str = "combined_text", key: str = "doc_id"
) -> DataFrame:
    """The TF-IDF vectors in long form: key, term, tf, tfidf for the terms of the vocabulary."""
    tokens = df.select(key, F.explode(space_tokens(F.col(text))).alias("term"))
    return (
        tokens.join(model.weights_to_join(df), "term")
        .groupBy(key, "term")
        .agg(F.count(F.lit(1)).alias("tf"), F.first("idf").alias("idf"))
        .select(key, "term", "tf", (F.col("tf") * F.col("idf")).alias("tfidf"))
    )
