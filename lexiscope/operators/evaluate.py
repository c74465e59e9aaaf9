"""Confusion counts and the scores that follow from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(
    predictions: DataFrame,
    by: Sequence[str] = (),
    label: str = "category",
    prediction: str = "predicted_category",
) -> DataFrame:
    """How many rows of each true class were given each class."""
    return predictions.groupBy(*by, label, prediction).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(
    predictions: DataFrame,
    classes: Sequence[str],
    label: str = "category",
    prediction: str = "predicted_category",
) -> DataFrame:
    """The square form: a row per true class and a column per predicted class."""
    cells = [
        F.count_if(F.col(prediction) == name).alias(f"predicted_{name}") for name in classes
    ]
    return predictions.groupBy(label).agg(*cells).orderBy(label)


def scores(
    counts: DataFrame,
    by: Sequence[str] = (),
    label: str = "category",
    prediction: str = "predicted_category",
) -> DataFrame:
    """Accuracy, F1, precision and recall, the last three weighted by class size.

    Works on the confusion counts, whose number of rows depends on the classes alone.
    """
    hit = F.when(F.col(label) == F.col(prediction), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("bigint")

    def role(name: str, support: Column, given: Column, hits: Column) -> Column:
        return F.struct(
            F.col(name).alias("class"),
            support.alias("support"),
            given.alias("given"),
            hits.alias("hits"),
        )

    # Every cell counts once for its true class and once for the class it was given.
    roles = F.array(role(label, F.col("n"), zero, hit), role(prediction, zero, F.col("n"), zero))
    per_class = (
        counts.select(*by, F.inline(roles))
        .groupBy(*by, "class")
        .agg(*[F.sum(c).alias(c) for c in ("support", "given", "hits")])
    )
    # 2pr / (p + r) is 2 hits / (given + support); a class nothing was given to has precision 0.
    precision = F.when(F.col("given") > 0, F.col("hits") / F.col("given")).otherwise(0.0)
    f1 = 2 * F.col("hits") / (F.col("given") + F.col("support"))

    def weighted(value: Column) -> Column:
        return F.sum(value * F.col("support")) / F.sum("support")

    accuracy = F.sum("hits") / F.sum("support")
    return per_class.groupBy(*by).agg(
        accuracy.alias("accuracy"),
        weighted(f1).alias("f1"),
        weighted(precision).alias("weighted_precision"),
        accuracy.alias("weighted_recall"),
    )


def accuracy_by_part(
    predictions: DataFrame,
    part: str = "part",
    label: str = "category",
    prediction: str = "predicted_category",
) -> DataFrame:
    correct = F.count_if(F.col(label) == F.col(prediction))
    total = F.count(F.lit(1))
    return predictions.groupBy(part).agg(
        total.alias("articles"), (correct / total).alias("accuracy")
    )


def check_predictions(
    predictions: DataFrame, labels: Sequence[str], tolerance: float = 1e-6
) -> DataFrame:
    """Three things that hold of every right prediction, whatever the classifier has learnt.

    ``adds_up``: the probabilities are one per label, not negative, and add up to 1 within
    ``tolerance``. ``is_first_maximum``: the prediction is the place of the first greatest one.
    ``name_matches``: the predicted category is the label of that number.
    """
    shares = vector_to_array("probability")
    total = F.aggregate(shares, F.lit(0.0), lambda a, x: a + x)
    number = F.col("prediction").cast("int")
    names = F.array(*[F.lit(name) for name in labels])
    return predictions.withColumns(
        {
            "adds_up": (F.size(shares) == len(labels))
            & (F.array_min(shares) >= 0)
            & (F.abs(total - 1) <= tolerance),
            "is_first_maximum": F.array_position(shares, F.array_max(shares)) - 1 == number,
            "name_matches": F.get(names, number) == F.col("predicted_category"),
        }
    )


def regression_certificate(predictions: DataFrame, classes: int) -> DataFrame:
    """How near a logistic regression is to the least loss on these rows, in one pass over them.

    One row: ``loss``, the mean logarithmic loss; ``null_loss``, that of the class shares without any
    feature; ``slope``, the greatest part of the gradient of the loss by the coefficients; and
    ``null_slope``, that of the gradient at the class shares. At the optimum of an unregularised fit
    the slope is 0. ``predictions`` has ``features``, ``probability`` and ``label``; rows of a class
    that the model doesn't know take no part.
    """
    shares, number = vector_to_array("probability"), F.col("label").cast("int")
    rows = predictions.filter(F.col("label") < classes).select(
        "features", shares.alias("shares"), number.alias("number")
    )
    given = [Summarizer.sum(F.col("features"), F.get("shares", F.lit(k))) for k in range(classes)]
    true = [Summarizer.sum(F.col("features"), (F.col("number") == k).cast("double")) for k in range(classes)]
    summed = rows.agg(
        F.count(F.lit(1)).alias("articles"),
        F.avg(-F.ln(F.greatest(F.get("shares", "number"), F.lit(1e-300)))).alias("loss"),
        F.array(*[F.count_if(F.col("number") == k) / F.count(F.lit(1)) for k in range(classes)]).alias("share"),
        F.array(*[vector_to_array(v) for v in given]).alias("given"),
        F.array(*[vector_to_array(v) for v in true]).alias("true"),
    )
    zero = F.lit(0.0)

    def steepest(a: Column, b: Column) -> Column:
        apart = F.zip_with(a, b, lambda x, y: F.array_max(F.zip_with(x, y, lambda p, q: F.abs(p - q))))
        return F.array_max(apart) / F.col("articles")

    every = F.aggregate(
        F.slice("true", 2, classes), F.get("true", F.lit(0)), lambda a, x: F.zip_with(a, x, lambda p, q: p + q)
    )
    at_shares = F.transform("share", lambda part: F.transform("every", lambda x: x * part))
    entropy = F.aggregate("share", zero, lambda a, p: a - F.when(p > 0, p * F.ln(p)).otherwise(zero))
    return summed.withColumn("every", every).select(
        "articles",
        "loss",
        entropy.alias("null_loss"),
        steepest(F.col("given"), F.col("true")).alias("slope"),
        steepest(at_shares, F.col("true")).alias("null_slope"),
    )
