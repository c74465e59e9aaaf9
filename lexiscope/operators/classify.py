"""Training the two article classifiers and categorising articles with them."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.feature import IndexToString
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiscope.functions.text import space_tokens
from lexiscope.operators.features import CorpusModel, feature_stages, fit_corpus, label_stage
from lexiscope.sources.shared import write_and_reread

ALGORITHMS = ("naive_bayes", "logistic_regression")
ITERATIONS = 10
SMOOTHING = 1.0


def _estimator(algorithm: str, iterations: int):
    if algorithm == "naive_bayes":
        return NaiveBayes(
            featuresCol="features", labelCol="label", smoothing=SMOOTHING, modelType="multinomial"
        )
    if algorithm == "logistic_regression":
        return LogisticRegression(featuresCol="features", labelCol="label", maxIter=iterations)
    raise ValueError(f"unknown algorithm {algorithm!r}, expected one of {ALGORITHMS}")


def fit_on_scope(df: DataFrame, part: str = "part", fit_scope: str = "train", **options):
    """The corpus model of the training rows, or with ``fit_scope="all"`` of all rows.

    Learning the vocabulary from all rows lets the held-out parts leak into the features.
    """
    if fit_scope not in ("train", "all"):
        raise ValueError(f"unknown fit scope {fit_scope!r}")
    return fit_corpus(df if fit_scope == "all" else df.filter(F.col(part) == "train"), **options)


def train_classifier(
    train: DataFrame,
    corpus: CorpusModel,
    algorithm: str = "naive_bayes",
    text: str = "combined_text",
    category: str = "category",
    iterations: int = ITERATIONS,
) -> PipelineModel:
    """A fitted chain from text to ``predicted_category``, usable on any table with that text.

    A regression takes at most ``iterations`` steps.
    """
    features = feature_stages(corpus, text)
    labelled = label_stage(corpus, category).transform(features.transform(train))
    classifier = _estimator(algorithm, iterations).fit(labelled.select("features", "label"))
    name = IndexToString(
        inputCol="prediction", outputCol="predicted_category", labels=list(corpus.labels)
    )
    return PipelineModel(stages=[*features.stages, classifier, name])


def categorize(texts: DataFrame, model: PipelineModel) -> DataFrame:
    """Add prediction, its category name, and the probability of each category, row by row."""
    return model.transform(texts).drop("tokens", "raw_features", "features", "rawPrediction")


def with_top_probability(predictions: DataFrame, out: str = "confidence") -> DataFrame:
    """The probability of the predicted category as a plain number."""
    return predictions.withColumn(out, F.array_max(vector_to_array("probability")))


def predict(
    df: DataFrame, model: PipelineModel, corpus: CorpusModel, category: str = "category"
) -> DataFrame:
    """Categorise articles whose category is known; adds its ``label`` for the evaluation.

    A category the model has not learnt gets a label of its own, which no prediction can match.
    """
    return label_stage(corpus, category, "keep").transform(categorize(df, model))


def predict_with_features(
    df: DataFrame, model: PipelineModel, corpus: CorpusModel, category: str = "category"
) -> DataFrame:
    """``features``, ``probability`` and ``label`` of articles whose category is known."""
    found = label_stage(corpus, category, "keep").transform(model.transform(df))
    return found.select("features", "probability", "label")


def naive_bayes_weights(
    train: DataFrame,
    corpus: CorpusModel,
    text: str = "combined_text",
    category: str = "category",
) -> DataFrame:
    """The naive Bayes model as a table: category, term, log weight, and the category's log prior.

    The summed TF-IDF of a term in a category is its count there times its IDF, so counting
    (category, term) pairs, combined before the shuffle, is all the work on the corpus. A null
    term counts the articles themselves, those with a null text too. The counts are stored: they
    are as many as there are pairs of a category and a vocabulary term. Categories and terms are
    put side by side by their numbers, so the plan is the same for any number of either.
    """
    vocabulary = corpus.vocabulary_rows(train).select("idx", "term", "idf")
    known = corpus.weights_to_join(train)
    tokens = F.coalesce(space_tokens(F.col(text)), F.array().cast("array<string>"))
    entries = F.concat(tokens, F.array(F.lit(None).cast("string")))
    pairs = (
        train.select(category, F.explode(entries).alias("term"))
        .join(known, "term", "left")
        .filter(F.col("idf").isNotNull() | F.col("term").isNull())
        .groupBy(category, "term")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    stored = write_and_reread(pairs, "category-term-counts")
    articles = stored.filter(F.col("term").isNull() & F.col(category).isNotNull())
    found = articles.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("categories")
    ).first()
    total = found["n"] + SMOOTHING * found["categories"]
    numbered = articles.select(
        category,
        (F.row_number().over(Window.orderBy(category)) - 1).alias("class"),
        F.ln((F.col("n") + SMOOTHING) / F.lit(float(total or 1))).alias("prior"),
    )
    terms = len(corpus.terms)
    cells = train.sparkSession.range(found["categories"] * terms).select(
        (F.col("id") % terms).alias("idx") if terms else F.col("id").alias("idx"),
        F.floor(F.col("id") / max(terms, 1)).cast("int").alias("class"),
    )
    grid = cells.join(vocabulary, "idx").join(numbered, "class").drop("idx", "class")
    weight = F.coalesce("n", F.lit(0)) * F.col("idf")
    in_category = F.sum(weight).over(Window.partitionBy(category))
    share = (weight + SMOOTHING) / (in_category + SMOOTHING * terms)
    return grid.join(stored, [category, "term"], "left").select(
        category, "term", F.ln(share).alias("weight"), "prior"
    )
