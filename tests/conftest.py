from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("lexiscope-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def duck():
    connection = duckdb.connect()
    for path in Path(SMALL).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


ARTICLE_SCHEMA = "doc_id bigint, title string, summary string, body string, category string"


@pytest.fixture(scope="session")
def few(spark):
    """Hand-made articles with every awkward case of missing, empty and oddly spaced text."""
    rows = [
        (1, "one", None, None, "a"),
        (2, "two", "", "", "a"),
        (3, "three", "word", "word", "a"),
        (4, "four", "x", "  a b ", "b"),
        (5, "five", None, "a  b", "b"),
        (6, "six", "", "a\nb c", "b"),
        (7, "seven", "w", " ".join(["w"] * 24), "c"),
        (8, "eight", "v", " ".join(["v"] * 25), "c"),
        (9, "eight", "v", " ".join(["v"] * 25), "d"),
        (10, None, "only blanks", "   ", "e"),
    ]
    return spark.createDataFrame(rows, ARTICLE_SCHEMA)


@pytest.fixture(scope="session")
def profile(spark, small):
    from lexiscope.operators.language import learn_profile
    from lexiscope.sources.articles import articles

    return learn_profile(articles(spark, small))
