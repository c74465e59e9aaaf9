"""Every registered query against its SQL, and the driver contract."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from lexiscope.operators import classify, evaluate
from lexiscope.plans import model_queries
from lexiscope.plans.registry import REGISTRY

WITH_SQL = sorted(name for name, query in REGISTRY.items() if query.sql)
WITHOUT_SQL = sorted(name for name, query in REGISTRY.items() if not query.sql)


UNWANTED = (
    "CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
    "MapInPandas", "FlatMapGroups",
)


def built(name, spark, small):
    """The query's result, after a look at its plan: no cross join and no Python in it."""
    result = REGISTRY[name].run(spark, small)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert not [operator for operator in UNWANTED if operator in plan]
    return result


def in_name_order(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", WITH_SQL)
def test_query_equals_its_sql(spark, duck, small, name):
    ours = built(name, spark, small)
    cursor = duck.execute(REGISTRY[name].sql)
    columns = [column[0] for column in cursor.description]
    assert sorted(ours.columns) == sorted(columns)
    assert in_name_order(ours.columns, ours.collect()) == in_name_order(columns, cursor.fetchall())


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_query_without_sql_has_rows(spark, small, name):
    assert built(name, spark, small).count() > 0


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    first, second = contract.entry(spark), contract.entry(spark)
    assert first.schema == second.schema
    assert first.count() == 4


def test_logistic_regression_separates_the_languages(spark):
    """On 1,000 documents; the smallest data set has 32 test rows, too few to judge by."""
    rows = model_queries.prepared(spark, "/root/testdata/sf0.01")
    corpus = classify.fit_on_scope(rows, fit_scope="all")
    train = rows.filter("part = 'train'")
    model = classify.train_classifier(train, corpus, "logistic_regression")
    tested = classify.predict(rows.filter("part = 'test'"), model, corpus)
    found = evaluate.scores(evaluate.confusion(tested)).first()
    assert found["accuracy"] > 0.9
    assert found["weighted_recall"] == pytest.approx(found["accuracy"])
