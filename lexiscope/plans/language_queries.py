"""Queries that identify languages and cut off headers in a foreign language.

The profile is learnt from the training part of the documents, whose ``lang`` column serves as
the known language, and applied to all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiscope.functions.text import first_line
from lexiscope.operators import language, language_split, sampling
from lexiscope.plans.query import ARTICLES_SQL, Query, part_sql
from lexiscope.sources.articles import articles, read_table, with_row_number
from lexiscope.sources.shared import fresh_path

LANGUAGES = ("de", "en", "es", "fr")

# Put in front of every English document to give it a header in another language.
OPENING = "Quelle belle aventure pour les gens du pays que la vieille ville de la Meuse. "


def _profile(spark: SparkSession, sf_dir: str) -> language.LanguageProfile:
    known = sampling.split_rows(articles(spark, sf_dir), "doc_id")
    return language.learn_profile(known.filter(F.col("part") == "train"))


def _languages(spark: SparkSession, sf_dir: str, text: str, out: str = "detected") -> DataFrame:
    rows = articles(spark, sf_dir)
    return language.score_languages(rows, _profile(spark, sf_dir), text, ["doc_id"], out)


def language_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile(spark, sf_dir).weight_rows()


def language_id_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _languages(spark, sf_dir, "summary")


def language_id_stored_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn a profile, store it, and identify languages with what is loaded again.

    Few weights are broadcast here, so that most trigrams take the way by a join.
    """
    known = sampling.split_rows(articles(spark, sf_dir), "doc_id").filter(F.col("part") == "train")
    path = fresh_path(spark, "language-profile")
    language.learn_profile(known, head_cells=1_000).save(path)
    profile = language.LanguageProfile.load(spark, path)
    return language.score_languages(articles(spark, sf_dir), profile, "summary", ["doc_id"])


def language_id_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _languages(spark, sf_dir, "body")


def language_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_distribution(_languages(spark, sf_dir, "body"))


def language_distribution_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_distribution(_languages(spark, sf_dir, "summary"))


def language_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary and body each give one detected language; flattened to a row per language."""
    listed = language.detect_languages(
        articles(spark, sf_dir).select("doc_id", "title", "summary", "body"),
        _profile(spark, sf_dir),
        ("summary", "body"),
        out="langs",
    )
    return language.flatten_languages(listed.select("doc_id", "title", "langs"), "langs")


def language_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_count(_languages(spark, sf_dir, "body"))


def non_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = language.detect_language(articles(spark, sf_dir), _profile(spark, sf_dir), out="lang")
    return language.other_languages(rows).select("doc_id", "title", "lang")


def minority_language_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    languages = _languages(spark, sf_dir, "summary", "lang")
    sample = language.minority_sample(articles(spark, sf_dir), languages)
    return sample.select("lang", "summary", "row_num")


def bilingual_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, the English ones with a foreign opening in front."""
    documents = read_table(spark, sf_dir, "documents")
    text = F.when(F.col("lang") == "en", F.concat(F.lit(OPENING), "text")).otherwise(F.col("text"))
    return documents.select("doc_id", first_line(text).alias("summary"), text.alias("body"))


def _split(spark: SparkSession, sf_dir: str, texts: tuple[str, ...]) -> DataFrame:
    return language_split.split_on_language_change(
        bilingual_articles(spark, sf_dir), _profile(spark, sf_dir), texts
    )


def _split_rows(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return _split(spark, sf_dir, (text,)).select(
        "doc_id", f"split_{text}.header", F.md5(f"split_{text}.body").alias("body_md5")
    )


def language_change_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split_rows(spark, sf_dir, "body")


def language_change_split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split_rows(spark, sf_dir, "summary")


def combined_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of summary and body without their headers, joined by a space."""
    split = _split(spark, sf_dir, ("summary", "body")).select(
        "doc_id",
        F.col("split_summary.body").alias("body_summary"),
        F.col("split_body.body").alias("body_documents"),
    )
    joined = language_split.join_texts(split, "body_summary", "body_documents")
    return joined.select(
        "doc_id",
        F.length("combined_text").cast("bigint").alias("chars"),
        F.md5("combined_text").alias("text_md5"),
    )


def keyed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two frames of texts put side by side by their key, then joined into one text."""
    rows = articles(spark, sf_dir)
    both = language_split.join_tables_on_key(
        rows.select("doc_id", "summary"), rows.select("doc_id", "body")
    )
    joined = language_split.join_texts(both, "summary", "body")
    return joined.select("doc_id", F.md5("combined_text").alias("text_md5"))


def numbered_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two frames put side by side by row numbers that each of them was given on its own."""
    rows = articles(spark, sf_dir)
    left = with_row_number(rows.select("doc_id", "summary"), ["doc_id"])
    right = with_row_number(rows.select("doc_id", "body"), ["doc_id"]).drop("doc_id")
    both = language_split.join_tables_on_key(left, right, "row_number")
    joined = language_split.join_texts(both, "summary", "body")
    return joined.select("doc_id", "row_number", F.md5("combined_text").alias("text_md5"))


NUMBERED_JOIN_SQL = f"""
WITH {ARTICLES_SQL}
SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_number,
       md5(concat_ws(' ', summary, body)) AS text_md5
FROM articles
"""

KEYED_JOIN_SQL = f"""
WITH {ARTICLES_SQL}
SELECT a.doc_id, md5(concat_ws(' ', a.summary, b.body)) AS text_md5
FROM articles a JOIN articles b ON a.doc_id = b.doc_id
"""


# --- SQL -----------------------------------------------------------------------------------------


def _trigrams_sql(source: str, text: str, keys: str) -> str:
    """One row per position of a text of at least three characters, with its trigram."""
    return f"""
  SELECT {keys}, pos, lower(a || b || c) AS trigram FROM (
    SELECT {keys}, unnest(range(0, len(ch) - 2)) AS pos, unnest(ch[1:len(ch) - 2]) AS a,
           unnest(ch[2:len(ch) - 1]) AS b, unnest(ch[3:len(ch)]) AS c
    FROM (SELECT {keys}, string_split({text}, '') AS ch FROM {source}) WHERE len(ch) >= 3
  )"""


_COUNTS = ", ".join(f"count(*) FILTER (category = '{x}') AS n_{x}" for x in LANGUAGES)
_SIZES = ", ".join(f"CAST(sum(n_{x}) + count(*) AS DOUBLE) AS size_{x}" for x in LANGUAGES)


def _weight_sql(count: str, lang: str) -> str:
    return f"CAST(round(ln(({count} + 1) / size_{lang}) * 1000) AS BIGINT)"


_WEIGHTS = ", ".join(f"{_weight_sql('n_' + x, x)} AS w_{x}" for x in LANGUAGES)
_FLOORS = ", ".join(f"{_weight_sql('0', x)} AS f_{x}" for x in LANGUAGES)

PROFILE_SQL = f"""
{ARTICLES_SQL},
known AS (SELECT * FROM articles WHERE {part_sql("doc_id")} = 'train'),
counted AS (
  SELECT trigram, {_COUNTS} FROM ({_trigrams_sql("known", "body", "category")}) GROUP BY trigram
),
sizes AS (SELECT {_SIZES} FROM counted),
weights AS (
  SELECT trigram, {_WEIGHTS} FROM counted, sizes
),
floors AS (SELECT {_FLOORS} FROM sizes)"""

_LOOKED_UP = ", ".join(f"coalesce(w_{x}, f_{x}) AS s_{x}" for x in LANGUAGES)
_SUMS = ", ".join(f"sum(s_{x}) AS s_{x}" for x in LANGUAGES)
_BEST = (
    "CASE WHEN known = 0 THEN 'unknown' "
    + " ".join(
        f"WHEN s_{x} = greatest({', '.join('s_' + y for y in LANGUAGES)}) THEN '{x}'"
        for x in LANGUAGES
    )
    + " END"
)


def _scored_sql(name: str, source: str, text: str) -> str:
    """CTEs ending in ``name`` with doc_id and detected, for texts that have a trigram."""
    return f"""
{name}_rows AS ({_trigrams_sql(source, text, "doc_id")}),
{name}_sums AS (
  SELECT doc_id, count(w_en) AS known, {_SUMS}
  FROM (SELECT doc_id, w_en, {_LOOKED_UP}
        FROM {name}_rows LEFT JOIN weights USING (trigram), floors)
  GROUP BY doc_id
),
{name} AS (SELECT doc_id, {_BEST} AS detected FROM {name}_sums)"""


def _detected_sql(text: str, select: str) -> str:
    return f"""
WITH {PROFILE_SQL}, {_scored_sql("scored", "articles", text)},
d AS (
  SELECT articles.*, coalesce(detected, 'unknown') AS detected
  FROM articles LEFT JOIN scored USING (doc_id)
)
{select}
"""


LANGUAGE_PROFILE_SQL = f"WITH {PROFILE_SQL} " + " UNION ALL ".join(
    f"SELECT '{x}' AS lang, trigram, w_{x} AS weight FROM weights" for x in LANGUAGES
)

LANGUAGE_ROWS_SQL = f"""
WITH {PROFILE_SQL}, {_scored_sql("by_summary", "articles", "summary")},
{_scored_sql("by_body", "articles", "body")}
SELECT doc_id, title, coalesce(detected, 'unknown') AS lang
FROM articles LEFT JOIN by_summary USING (doc_id)
UNION ALL
SELECT doc_id, title, coalesce(detected, 'unknown') AS lang
FROM articles LEFT JOIN by_body USING (doc_id)
"""

MINORITY_SQL = _detected_sql(
    "summary",
    """SELECT detected AS lang, summary,
    row_number() OVER (PARTITION BY detected ORDER BY md5('42:' || doc_id), doc_id) AS row_num
    FROM d WHERE detected <> 'en' QUALIFY row_num <= 10""",
)

BILINGUAL_SQL = f"""
bilingual AS (
  SELECT doc_id, string_split(t, chr(10))[1] AS summary, t AS body FROM (
    SELECT doc_id, CASE WHEN lang = 'en' THEN '{OPENING}' || text ELSE text END AS t
    FROM documents)
)"""


def _cuts_sql(name: str, text: str) -> str:
    """CTEs ending in ``name`` with doc_id, header and body of every text."""
    window = "OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 22 FOLLOWING)"
    sums = ", ".join(f"sum(s_{x}) {window} AS s_{x}" for x in LANGUAGES)
    strip = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
    return f"""
{name}_openings AS (
  SELECT doc_id, substr({text}, 1, 25) AS opening FROM bilingual WHERE length({text}) >= 25
),
{_scored_sql(name + "_first", name + "_openings", "opening")},
{name}_todo AS (
  SELECT doc_id, {text} AS t FROM bilingual
  WHERE doc_id IN (SELECT doc_id FROM {name}_first WHERE detected <> 'en')
),
{name}_weighted AS (
  SELECT doc_id, pos, CASE WHEN w_en IS NULL THEN 0 ELSE 1 END AS known, {_LOOKED_UP}
  FROM ({_trigrams_sql(name + "_todo", "t", "doc_id")}) LEFT JOIN weights USING (trigram), floors
),
{name}_windows AS (
  SELECT doc_id, pos, count(*) {window} AS n, sum(known) {window} AS known, {sums}
  FROM {name}_weighted
),
{name}_cuts AS (
  SELECT doc_id, min(pos) AS cut FROM {name}_windows
  WHERE n = 23 AND pos % 5 = 0 AND pos > 0 AND {_BEST} = 'en' GROUP BY doc_id
),
{name} AS (
  SELECT doc_id,
    CASE WHEN cut IS NULL THEN '' ELSE {strip.format(f"substr({text}, 1, cut)")} END AS header,
    CASE WHEN cut IS NULL THEN {text} ELSE {strip.format(f"substr({text}, cut + 1)")} END AS rest
  FROM bilingual LEFT JOIN {name}_cuts USING (doc_id)
)"""


def _split_sql(text: str) -> str:
    return f"""
WITH {PROFILE_SQL}, {BILINGUAL_SQL}, {_cuts_sql("parts", text)}
SELECT doc_id, header, md5(rest) AS body_md5 FROM parts
"""


COMBINED_SQL = f"""
WITH {PROFILE_SQL}, {BILINGUAL_SQL}, {_cuts_sql("by_summary", "summary")},
{_cuts_sql("by_body", "body")},
joined AS (
  SELECT doc_id, s.rest || ' ' || b.rest AS t FROM by_summary s JOIN by_body b USING (doc_id)
)
SELECT doc_id, length(t) AS chars, md5(t) AS text_md5 FROM joined
"""

_DISTRIBUTION = "SELECT detected AS lang, count(*) AS articles FROM d GROUP BY 1"

QUERIES = {
    "language_profile": Query(language_profile, LANGUAGE_PROFILE_SQL),
    "language_id_summary": Query(
        language_id_summary, _detected_sql("summary", "SELECT doc_id, detected FROM d")
    ),
    "language_id_stored_profile": Query(
        language_id_stored_profile, _detected_sql("summary", "SELECT doc_id, detected FROM d")
    ),
    "language_id_body": Query(
        language_id_body, _detected_sql("body", "SELECT doc_id, detected FROM d")
    ),
    "language_distribution": Query(language_distribution, _detected_sql("body", _DISTRIBUTION)),
    "language_distribution_summary": Query(
        language_distribution_summary, _detected_sql("summary", _DISTRIBUTION)
    ),
    "language_rows": Query(language_rows, LANGUAGE_ROWS_SQL),
    "language_count": Query(
        language_count, _detected_sql("body", "SELECT count(DISTINCT detected) AS languages FROM d")
    ),
    "non_english": Query(
        non_english,
        _detected_sql("body", "SELECT doc_id, title, detected AS lang FROM d WHERE detected <> 'en'"),
    ),
    "minority_language_sample": Query(minority_language_sample, MINORITY_SQL),
    "language_change_split": Query(language_change_split, _split_sql("body")),
    "language_change_split_summary": Query(language_change_split_summary, _split_sql("summary")),
    "combined_bodies": Query(combined_bodies, COMBINED_SQL),
    "keyed_join": Query(keyed_join, KEYED_JOIN_SQL),
    "numbered_join": Query(numbered_join, NUMBERED_JOIN_SQL),
}
