"""Features, classifiers and evaluation against Spark ML's own estimators."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IDF, CountVectorizer, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from lexiscope.operators import classify, evaluate, features
from lexiscope.plans import model_queries
from lexiscope.plans.model_queries import prepared, unseen_texts
from lexiscope.streaming.arriving import arriving_articles, store_categories


@pytest.fixture(scope="module")
def rows(spark, small):
    return prepared(spark, small)


@pytest.fixture(scope="module")
def corpus(rows):
    return classify.fit_on_scope(rows, fit_scope="all")


@pytest.fixture(scope="module")
def train(rows):
    return rows.filter("part = 'train'")


@pytest.fixture(scope="module")
def bayes(train, corpus):
    return classify.train_classifier(train, corpus, "naive_bayes")


# --- features ------------------------------------------------------------------------------------


def test_combined_text_and_tokens(few):
    combined = features.tokenize(features.combine_text(few))
    found = {r["doc_id"]: (r["combined_text"], r["tokens"]) for r in combined.collect()}
    assert found[1] == ("", [""])
    assert found[2] == (" ", ["", ""])
    assert found[5] == ("a  b", ["a", "", "b"])
    assert found[6] == (" a\nb c", ["", "a\nb", "c"])


def test_vocabulary_limits_and_order(spark):
    # "all" is in every row, "rare" in one of 200, "b" and "a" are equally frequent.
    rows = spark.range(200).selectExpr(
        "if(id < 150, 'x', 'y') AS category",
        "concat('all', if(id = 0, ' rare', ''), if(id % 2 = 0, ' b a', ' '), "
        "if(id % 4 = 0, ' c c c', '')) AS combined_text",
    )
    corpus = features.fit_corpus(rows)
    assert corpus.terms == ("c", "", "a", "b")
    assert corpus.term_counts == (150, 100, 100, 100)
    assert corpus.document_counts == (50, 100, 100, 100)
    assert corpus.documents == 200
    assert (corpus.labels, corpus.label_counts) == (("x", "y"), (150, 50))
    assert features.fit_corpus(rows, max_terms=2).terms == ("c", "")
    # From 1 on a limit is a number of articles.
    assert "rare" in features.fit_corpus(rows, min_df=1.0).terms
    assert features.fit_corpus(rows, max_df=60).terms == ("c",)


def test_labels_of_equal_size_are_alphabetical_and_null_is_none(spark):
    data = [("b", "t u"), ("a", "t"), (None, "t"), ("c", None), ("c", "u")]
    rows = spark.createDataFrame(data, "category string, combined_text string")
    corpus = features.fit_corpus(rows, min_df=0, max_df=1e9)
    assert corpus.labels == ("c", "a", "b") and corpus.documents == 5
    indexer = StringIndexer(inputCol="category", outputCol="label")
    assert indexer.fit(rows.filter("category IS NOT NULL")).labels == list(corpus.labels)


def test_features_equal_count_vectorizer_and_idf(rows, corpus):
    tokens = features.tokenize(rows)
    counter = CountVectorizer(
        inputCol="tokens", outputCol="raw", vocabSize=1 << 18, minDF=0.01, maxDF=0.80
    ).fit(tokens)
    top = set(corpus.terms)
    least = corpus.term_counts[-1]
    theirs = IDF(inputCol="raw", outputCol="weighted").fit(counter.transform(tokens))
    idf = dict(zip(counter.vocabulary, theirs.idf.toArray()))
    assert top <= set(counter.vocabulary)
    assert len(corpus.terms) == min(2000, len(counter.vocabulary))
    assert list(corpus.term_counts) == sorted(corpus.term_counts, reverse=True) and least > 0
    for term, weight in zip(corpus.terms, corpus.idf):
        assert weight == pytest.approx(idf[term], abs=1e-12)


def test_vectors_equal_the_long_form(rows, corpus):
    vectors = features.feature_stages(corpus).transform(rows)
    long = features.term_weights(rows, corpus)
    index = {term: i for i, term in enumerate(corpus.terms)}
    found = {}
    for row in long.collect():
        found.setdefault(row["doc_id"], {})[index[row["term"]]] = row["tfidf"]
    for row in vectors.select("doc_id", "features").collect():
        cells = {int(i): v for i, v in zip(row["features"].indices, row["features"].values)}
        assert cells == pytest.approx(found.get(row["doc_id"], {}))


def test_fit_scope(rows, corpus):
    learnt = classify.fit_on_scope(rows)
    assert learnt.documents == rows.filter("part = 'train'").count() < corpus.documents
    with pytest.raises(ValueError):
        classify.fit_on_scope(rows, fit_scope="test")


def test_a_large_vocabulary_is_joined_and_not_broadcast(rows, corpus, monkeypatch):
    expected = sorted(features.term_weights(rows.limit(20), corpus).collect())
    monkeypatch.setattr(features, "BROADCAST_TERMS", 10)
    assert sorted(features.term_weights(rows.limit(20), corpus).collect()) == expected


def test_any_number_of_categories(spark):
    rows = spark.range(10_050).selectExpr("concat('c', id) AS category", "'t' AS combined_text")
    corpus = features.fit_corpus(rows, max_df=1e9)
    assert len(corpus.labels) == 10_050 and corpus.terms == ("t",)


# --- classifiers ---------------------------------------------------------------------------------


def test_articles_without_text_count_for_the_prior(spark):
    data = [("a", "t u"), ("a", None), ("b", "t v"), ("b", None), ("b", None)]
    rows = spark.createDataFrame(data, "category string, combined_text string")
    corpus = features.fit_corpus(rows, min_df=0, max_df=1e9)
    fitted = classify.train_classifier(rows, corpus, "naive_bayes").stages[-2]
    found = {r["category"]: r["prior"] for r in classify.naive_bayes_weights(rows, corpus).collect()}
    for name, prior in zip(corpus.labels, fitted.pi.toArray()):
        assert found[name] == pytest.approx(prior, abs=1e-12)


def test_wrong_predictions_do_not_pass_the_checks(spark, rows, corpus, bayes):
    right = evaluate.check_predictions(classify.categorize(rows, bayes), corpus.labels)
    checks = "adds_up AND is_first_maximum AND name_matches"
    assert right.filter(f"NOT ({checks})").count() == 0
    turned = corpus.labels[1:] + corpus.labels[:1]
    assert evaluate.check_predictions(classify.categorize(rows, bayes), turned).filter(
        "name_matches"
    ).count() == 0
    moved = classify.categorize(rows, bayes).withColumn("prediction", (F.col("prediction") + 1) % 4)
    assert evaluate.check_predictions(moved, corpus.labels).filter("is_first_maximum").count() == 0


def test_a_model_of_shuffled_labels_is_seen_to_be_inaccurate(spark, monkeypatch):
    small = "/root/testdata/sf0.01"
    rows = model_queries.prepared(spark, small)
    names = ["de", "en", "es", "fr"]
    mixed = F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % 4 + 1).cast("int"))
    wrong = rows.filter("part = 'train'").withColumn("category", mixed)
    whole = classify.train_classifier

    def train(train_rows, corpus, algorithm):
        return whole(wrong if algorithm == "logistic_regression" else train_rows, corpus, algorithm)

    monkeypatch.setattr(classify, "train_classifier", train)
    found = model_queries.lr_accuracy_by_part(spark, small).collect()
    assert any(not r["accurate"] for r in found)


def test_bayes_table_equals_the_fitted_model(train, corpus, bayes):
    fitted = next(s for s in bayes.stages if type(s).__name__ == "NaiveBayesModel")
    theta, prior = fitted.theta.toArray(), fitted.pi.toArray()
    label = {name: i for i, name in enumerate(corpus.labels)}
    index = {term: i for i, term in enumerate(corpus.terms)}
    found = classify.naive_bayes_weights(train, corpus).collect()
    assert len(found) == len(corpus.labels) * len(corpus.terms)
    for row in found:
        c = label[row["category"]]
        assert row["weight"] == pytest.approx(theta[c][index[row["term"]]], abs=1e-10)
        assert row["prior"] == pytest.approx(prior[c], abs=1e-12)


def test_a_text_without_known_words_gets_the_most_likely_category(spark, corpus, bayes):
    texts = spark.createDataFrame(
        [("a", ""), ("b", "@@@ ###"), ("c", None)], "text_id string, combined_text string"
    )
    found = classify.categorize(texts, bayes).collect()
    assert {r["predicted_category"] for r in found} == {corpus.labels[0]}
    assert all(sum(r["probability"]) == pytest.approx(1.0) for r in found)


@pytest.mark.parametrize("algorithm", classify.ALGORITHMS)
def test_new_texts_are_categorised_row_by_row(spark, small, train, corpus, algorithm):
    model = classify.train_classifier(train, corpus, algorithm)
    scored = classify.with_top_probability(classify.categorize(unseen_texts(spark, small), model))
    assert scored.count() == unseen_texts(spark, small).count()
    confident = scored.filter("confidence BETWEEN 0.25 AND 1.0000001").count()
    assert confident == scored.count()
    plan = classify.categorize(
        spark.read.parquet(f"{small}/benchmark.parquet").withColumnRenamed("text", "combined_text"),
        model,
    )._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_logistic_regression_equals_a_plain_chain(rows, train, corpus):
    """The same coefficients as with Spark's own IDF stage on the same vocabulary."""
    model = classify.train_classifier(train, corpus, "logistic_regression")
    ours = next(s for s in model.stages if type(s).__name__ == "LogisticRegressionModel")
    counted = features.feature_stages(corpus).transform(rows).drop("features")
    weigh = IDF(inputCol="raw_features", outputCol="features").fit(counted)
    labelled = StringIndexer(inputCol="category", outputCol="label").fit(rows).transform(
        weigh.transform(counted)
    )
    theirs = LogisticRegression(maxIter=10).fit(labelled.filter("part = 'train'"))
    difference = ours.coefficientMatrix.toArray() - theirs.coefficientMatrix.toArray()
    assert abs(difference).max() < 1e-6


def test_a_category_only_in_the_test_part_counts_as_missed(rows, train):
    known = train.filter("category <> 'es'")
    corpus = classify.fit_on_scope(known)
    model = classify.train_classifier(known, corpus)
    tested = classify.predict(rows.filter("part = 'test'"), model, corpus)
    assert "es" not in corpus.labels
    missed = tested.filter("category = 'es'")
    assert missed.count() > 0 and missed.filter("label = prediction").count() == 0
    assert evaluate.confusion(tested).agg(F.sum("n")).first()[0] == tested.count()


def test_unknown_algorithm(train, corpus):
    with pytest.raises(ValueError):
        classify.train_classifier(train, corpus, "forest")


def test_model_survives_saving(spark, small, bayes, tmp_path):
    bayes.write().save(str(tmp_path / "model"))
    loaded = PipelineModel.load(str(tmp_path / "model"))
    texts = unseen_texts(spark, small)
    one, two = (
        sorted(tuple(r) for r in classify.categorize(texts, m).select("text_id", "prediction").collect())
        for m in (bayes, loaded)
    )
    assert one == two


def test_arriving_articles_are_categorised_like_a_table(spark, small, bayes, tmp_path):
    texts = unseen_texts(spark, small)
    incoming, done, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    texts.write.parquet(incoming)
    stream = arriving_articles(spark, incoming, texts.schema)
    store_categories(stream, bayes, done, progress).awaitTermination()
    wanted = classify.categorize(texts, bayes).select("text_id", "predicted_category")
    assert sorted(spark.read.parquet(done).select(*wanted.columns).collect()) == sorted(wanted.collect())
    # A second run with the same progress handles only what came in since.
    texts.limit(5).write.mode("append").parquet(incoming)
    store_categories(stream, bayes, done, progress).awaitTermination()
    assert spark.read.parquet(done).count() == texts.count() + 5


# --- evaluation ----------------------------------------------------------------------------------

KNOWN = [("a", "a", 5), ("a", "b", 1), ("b", "a", 2), ("b", "b", 3), ("c", "a", 1)]


def test_scores_of_a_known_matrix(spark):
    counts = spark.createDataFrame(KNOWN, "category string, predicted_category string, n bigint")
    found = evaluate.scores(counts).first()
    f1 = {"a": 2 * 5 / (6 + 8), "b": 2 * 3 / (5 + 4), "c": 0.0}
    precision = {"a": 5 / 8, "b": 3 / 4, "c": 0.0}
    size = {"a": 6, "b": 5, "c": 1}
    assert found["accuracy"] == pytest.approx(8 / 12) == found["weighted_recall"]
    assert found["f1"] == pytest.approx(sum(f1[k] * size[k] for k in f1) / 12)
    assert found["weighted_precision"] == pytest.approx(sum(precision[k] * size[k] for k in f1) / 12)


def test_scores_equal_the_evaluator(rows, corpus, bayes):
    predicted = classify.predict(rows, bayes, corpus)
    by_part = {r["part"]: r for r in evaluate.scores(evaluate.confusion(predicted, ["part"]), ["part"]).collect()}
    accuracy = {r["part"]: r["accuracy"] for r in evaluate.accuracy_by_part(predicted).collect()}
    names = {
        "accuracy": "accuracy", "f1": "f1",
        "weightedPrecision": "weighted_precision", "weightedRecall": "weighted_recall",
    }
    for part in ("train", "validation", "test"):
        some = predicted.filter(F.col("part") == part)
        for theirs, ours in names.items():
            value = MulticlassClassificationEvaluator(metricName=theirs).evaluate(some)
            assert by_part[part][ours] == pytest.approx(value, abs=1e-12)
        assert accuracy[part] == pytest.approx(by_part[part]["accuracy"])


def test_confusion_adds_up_to_all_rows(rows, corpus, bayes):
    predicted = classify.predict(rows, bayes, corpus)
    counts = evaluate.confusion(predicted)
    assert counts.agg(F.sum("n")).first()[0] == rows.count()
    square = evaluate.confusion_matrix(predicted, sorted(corpus.labels))
    cells = {(r["category"], r["predicted_category"]): r["n"] for r in counts.collect()}
    for row in square.collect():
        for name in corpus.labels:
            assert row[f"predicted_{name}"] == cells.get((row["category"], name), 0)


def test_predictions_do_not_depend_on_partitions(rows, corpus, bayes):
    one, many = (
        sorted(
            tuple(r) for r in classify.predict(rows.repartition(n), bayes, corpus)
            .select("doc_id", "prediction", vector_to_array("probability")[0]).collect()
        )
        for n in (1, 8)
    )
    assert one == many
    assert all(not math.isnan(r[2]) for r in one)


def test_spark_naive_bayes_settings(bayes):
    fitted = next(s for s in bayes.stages if type(s).__name__ == "NaiveBayesModel")
    assert fitted.getOrDefault("smoothing") == 1.0
    assert fitted.getOrDefault("modelType") == "multinomial"


def test_shuffled_labels_are_seen_in_parts_of_few_articles(spark, small, monkeypatch):
    mixed = F.element_at(
        F.array(*map(F.lit, ["de", "en", "es", "fr"])), (F.col("doc_id") % 4 + 1).cast("int")
    )
    whole = classify.train_classifier

    def train(rows, corpus, algorithm):
        wrong = rows.withColumn("category", mixed)
        return whole(wrong if algorithm == "logistic_regression" else rows, corpus, algorithm)

    monkeypatch.setattr(classify, "train_classifier", train)
    found = model_queries.lr_accuracy_by_part(spark, small).collect()
    few = [r for r in found if r["articles"] < model_queries.FEW_ARTICLES]
    assert few and not any(r["accurate"] for r in few)


def test_a_wrong_diagonal_or_recall_is_seen(spark, small, monkeypatch):
    matrix, scores = evaluate.confusion_matrix, evaluate.scores

    def turned(predictions, classes):
        right = matrix(predictions, classes)
        names = right.columns[1:]
        return right.select("category", *[F.col(a).alias(b) for a, b in zip(names, names[1:] + names[:1])])

    monkeypatch.setattr(evaluate, "confusion_matrix", turned)
    found = model_queries.lr_confusion_matrix(spark, small).collect()
    assert any(r["articles"] is None for r in found)
    halved = lambda *given: scores(*given).withColumns(
        {"accuracy": F.col("accuracy") / 2, "weighted_recall": F.col("weighted_recall") / 2}
    )
    monkeypatch.setattr(evaluate, "scores", halved)
    assert not model_queries.lr_metrics(spark, small).first()["recall_is_accuracy"]


def scaled(predicted, factor):
    """Predictions as from coefficients and intercepts times a factor."""
    raised = F.transform(vector_to_array("probability"), lambda p: F.pow(p, F.lit(factor)))
    total = F.aggregate("raised", F.lit(0.0), lambda a, x: a + x)
    shares = F.transform("raised", lambda x: x / F.col("total"))
    return predicted.withColumn("raised", raised).withColumn("total", total).select(
        "features", array_to_vector(shares).alias("probability"), "label"
    )


def test_the_certificate_of_the_regression(rows, corpus, monkeypatch):
    train = rows.filter("part = 'train'")
    model = classify.train_classifier(train, corpus, "logistic_regression")
    predicted = classify.predict_with_features(train, model, corpus)
    found = predicted.collect()
    labels = np.array([int(r["label"]) for r in found])
    x = np.array([r["features"].toArray() for r in found])
    p = np.array([r["probability"].toArray() for r in found])
    true = np.eye(len(corpus.labels))[labels]
    row = evaluate.regression_certificate(predicted, len(corpus.labels)).first()
    share = true.mean(axis=0)
    assert row["articles"] == len(found)
    assert row["loss"] == pytest.approx(-np.log(p[np.arange(len(p)), labels]).mean())
    assert row["null_loss"] == pytest.approx(-(share[share > 0] * np.log(share[share > 0])).sum())
    assert row["slope"] == pytest.approx(np.abs(x.T @ (p - true)).max() / len(p), abs=1e-12)
    assert row["null_slope"] == pytest.approx(np.abs(x.T @ (share - true)).max() / len(p))
    near = model_queries._near_optimum(rows, corpus, model)
    assert near["loss_below_null"] and near["gradient_small"]
    plain = classify.predict_with_features
    monkeypatch.setattr(classify, "predict_with_features", lambda *a: scaled(plain(*a), 0.5))
    halved = model_queries._near_optimum(rows, corpus, model)
    assert not halved["loss_below_null"] and not halved["gradient_small"]


def test_the_certificate_leaves_out_unknown_classes(spark, rows, corpus):
    train = rows.filter("part = 'train'").limit(40)
    model = classify.train_classifier(train, corpus, "logistic_regression")
    more = train.unionAll(train.limit(5).withColumn("category", F.lit("other")))
    pairs = [classify.predict_with_features(t, model, corpus) for t in (train, more)]
    one, two = [evaluate.regression_certificate(p, len(corpus.labels)).first() for p in pairs]
    assert tuple(one) == pytest.approx(tuple(two))


def test_a_fit_that_ends_too_early_goes_on(spark, small, monkeypatch):
    rows = prepared(spark, small)
    monkeypatch.setattr(classify, "ITERATIONS", 2)
    whole, taken = classify.train_classifier, []

    def train(rows, corpus, algorithm, iterations=2):
        taken.append(iterations)
        return whole(rows, corpus, algorithm, iterations=iterations)

    monkeypatch.setattr(classify, "train_classifier", train)
    corpus, model = model_queries._trained(rows, "logistic_regression")
    assert not all(model_queries._near_optimum(rows, corpus, model).values())
    taken.clear()
    found = model_queries.lr_metrics(spark, small).first()
    assert found["loss_below_null"] and found["gradient_small"]
    assert taken[:2] == [2, 8] and len(taken) <= 3
