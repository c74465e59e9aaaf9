"""The registered queries of this subpackage, with the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiscope.llm import (
    bilinear,
    divergence,
    ftrl_language,
    line_join,
    phrases,
    piece_codec,
    prefix_forest,
    prefix_trie,
    quality,
    seeds,
    shards,
    shingle_join,
    token_files,
)
from lexiscope.llm.ship import ship_package
from lexiscope.plans.query import Query

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SHARDS = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.token_digests(table(spark, sf_dir, "documents"), PIECE_MODEL)


def passage_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_table(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )


def repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.repeat_digests(table(spark, sf_dir, "documents"))


def byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign_shards(table(spark, sf_dir, "documents"), SHARDS)


def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bilinear.score_texts(table(spark, sf_dir, "documents"))


def near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_forest.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_and_read_tokens(table(spark, sf_dir, "documents"), WORD_TOKENIZER)


def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lines, removed = line_join.count_columns(docs)
    return line_join.remove_repeated_lines(docs).select(
        "doc_id",
        F.col(lines).cast("bigint").alias("n_lines"),
        F.col(removed).cast("bigint").alias("n_removed"),
        F.md5("text").alias("kept_md5"),
    )


LINES_SQL = f"""
WITH lines AS (
  SELECT doc_id, line_no, line, list_distinct(list_filter(string_split(lower(
           replace(replace(line, chr(9), ' '), chr(13), ' ')), ' '), lambda w: w <> '')) AS words
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS line_no
        FROM documents)
),
classes AS (
  SELECT words, len(words) AS n, min((doc_id, line_no)) AS first,
         list_reduce(list_transform(words, lambda w: 1::UBIGINT << (hash(w) % 60)::INT),
                     lambda x, y: xor(x, y)) AS odd
  FROM (SELECT doc_id, line_no, list_sort(words) AS words FROM lines WHERE len(words) > 0)
  GROUP BY words
),
matched AS (
  SELECT DISTINCT a.first
  FROM classes a JOIN classes b
    ON b.first < a.first AND b.n * 100 >= a.n * {line_join.SIMILARITY}
   AND a.n * 100 >= b.n * {line_join.SIMILARITY}
   -- sets whose odd bits differ in k places differ in k words at least
   AND bit_count(xor(a.odd, b.odd)) * {100 + line_join.SIMILARITY}
       <= (a.n + b.n) * {100 - line_join.SIMILARITY}
   AND len(list_intersect(a.words, b.words)) * {100 + line_join.SIMILARITY}
       >= (a.n + b.n) * {line_join.SIMILARITY}
),
kept AS (SELECT first FROM classes WHERE first NOT IN (SELECT first FROM matched)),
marked AS (
  SELECT doc_id, line_no, line,
         len(words) > 0 AND (doc_id, line_no) NOT IN (SELECT first FROM kept) AS gone
  FROM lines
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
       md5(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT gone), ''))
         AS kept_md5
FROM marked GROUP BY doc_id"""


def near_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.near_duplicates(table(spark, sf_dir, "documents")).drop("version")


SHINGLES_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM documents
),
sets AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i:
           array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words
),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
),
reached AS (
  SELECT doc_id, doc_id AS other FROM sets
  UNION
  SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.other = l.a
)
SELECT s.doc_id, len(s.s) AS n_shingles, min(r.other) AS component_id
FROM sets s JOIN reached r ON r.doc_id = s.doc_id GROUP BY s.doc_id, len(s.s)"""


def benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return seeds.find_leaks(docs, items).drop("version")


LEAKS_SQL = f"""
WITH doc_words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'),
                             lambda w: w <> '') AS w FROM documents
),
item_words AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'),
                              lambda w: w <> '') AS w FROM benchmark
),
d AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM doc_words),
b AS (SELECT item_id, len(w) AS m, unnest(w) AS word, generate_subscripts(w, 1) AS j
      FROM item_words WHERE len(w) >= {seeds.SHORTEST}),
same AS (SELECT doc_id, item_id, n, m, i, i - j AS shift, least({seeds.WINDOW}, m) AS size
         FROM d JOIN b USING (word)),
dense AS (
  SELECT * FROM same
  QUALIFY count(*) OVER (PARTITION BY doc_id, item_id, shift) >= size -
          CASE WHEN m < {seeds.WINDOW} THEN 0 ELSE {seeds.SUBSTITUTIONS} END
),
starts AS (
  SELECT doc_id, item_id, shift, size, m, unnest(range(i - size + 1, i + 1)) AS s, n FROM dense
),
windows AS (
  SELECT doc_id, item_id, s, size FROM starts
  WHERE s >= 1 AND s > shift AND s + size - 1 <= n AND s + size - 1 - shift <= m
  GROUP BY doc_id, item_id, shift, s, size, m
  HAVING count(*) >= size - CASE WHEN m < {seeds.WINDOW} THEN 0 ELSE {seeds.SUBSTITUTIONS} END
),
places AS (
  SELECT DISTINCT doc_id, item_id, unnest(range(s - 1, s + size - 1)) AS place FROM windows
)
SELECT doc_id, item_id, min(place) AS first_word, max(place) AS last_word, count(*) AS n_words
FROM places GROUP BY doc_id, item_id"""


def predicted_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ftrl_language.language_table(table(spark, sf_dir, "documents"))


def divergent_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


DIVERGENCE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
),
found AS (SELECT doc, lang, source, unnest(terms) AS term FROM docs),
vocabulary AS (
  SELECT lang, term, count(*) AS n FROM found GROUP BY lang, term
  HAVING count(DISTINCT doc) >= 10
),
kept AS (
  SELECT f.lang, f.source, f.term, count(*) AS n
  FROM found f JOIN vocabulary v ON v.lang = f.lang AND v.term = f.term
  GROUP BY f.lang, f.source, f.term
),
groups AS (SELECT DISTINCT lang, source FROM docs),
sizes AS (SELECT lang, source, sum(n) AS size FROM kept GROUP BY lang, source),
wholes AS (SELECT lang, sum(n) AS size, count(*) AS v FROM vocabulary GROUP BY lang),
shares AS (
  SELECT g.lang, g.source, v.term, coalesce(k.n, 0) AS n,
         (1 + 1000000000 * (coalesce(k.n, 0)::HUGEINT + 2)
              // (coalesce(s.size, 0) + 2 * w.v)::HUGEINT) AS p,
         (1 + 1000000000 * (v.n::HUGEINT + 2) // (w.size + 2 * w.v)::HUGEINT) AS q
  FROM groups g JOIN vocabulary v ON v.lang = g.lang JOIN wholes w ON w.lang = g.lang
  LEFT JOIN sizes s ON s.lang = g.lang AND s.source = g.source
  LEFT JOIN kept k ON k.lang = g.lang AND k.source = g.source AND k.term = v.term
),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source
  GROUP BY a.lang, a.source, b.source
),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value,
       (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM parts QUALIFY part = 'pair' OR rank <= 10"""


def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


TRIE_SQL = r"""
WITH ordered AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
           md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS place
  FROM conversations WHERE conv_id IS NOT NULL
),
own AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY place) AS turns
        FROM ordered GROUP BY conv_id),
bits AS (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k:
           CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS entry
  FROM (SELECT unnest(range(256)) AS i)
),
crc AS (SELECT list(entry ORDER BY i) AS t FROM bits),
heads AS (
  SELECT conv_id, turns, conv_id - conv_id % 20 AS base,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
               string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
             lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) % 4 AS h
  FROM own, crc
),
built AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) AS turns
  FROM heads c LEFT JOIN own b ON b.conv_id = c.base
),
prefixes AS (SELECT conv_id, len(turns) AS n, d, turns[1:d] AS prefix
             FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM built)),
nodes AS (
  SELECT prefix, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)
                         FILTER (WHERE n = d), '')) AS ends_sha256,
         CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * len(list_filter(
           regexp_split_to_array(prefix[d].text, '[\x20\x09-\x0D]+'), lambda w: w <> '')) END AS saved
  FROM prefixes GROUP BY prefix, d
),
counted AS (
  SELECT n.prefix, n.depth, n.conv_id, n.n_convs, n.ends_sha256, n.saved, count(c.prefix) AS n_children
  FROM nodes n LEFT JOIN nodes c ON c.depth = n.depth + 1 AND c.prefix[1:n.depth] = n.prefix
  GROUP BY ALL
),
below AS (
  SELECT prefix[1:d] AS prefix, sum(saved)::BIGINT AS saved_tokens,
         count(*) FILTER (WHERE n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(depth + 1)) AS d FROM counted) GROUP BY prefix[1:d]
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, b.n_leaves,
       b.saved_tokens, n.ends_sha256
FROM counted n JOIN below b ON b.prefix = n.prefix
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[1:n.depth - 1]"""


QUERIES = {
    "op1_piece_codec": Query(piece_tokens),
    "op2_passage_quality": Query(passage_quality),
    "op3_phrases": Query(repeated_bytes),
    "op4_shards": Query(byte_shards),
    "op10_line_join": Query(repeated_lines, LINES_SQL),
    "op5_bilinear": Query(model_scores),
    "op6_prefix_forest": Query(near_vectors),
    "op7_seeds": Query(benchmark_leaks, LEAKS_SQL),
    "op8_shingle_join": Query(near_documents, SHINGLES_SQL),
    "op9_token_files": Query(token_id_files),
    "op11_ftrl_language": Query(predicted_languages),
    "op12_source_divergence": Query(divergent_sources, DIVERGENCE_SQL),
    "op13_prefix_trie": Query(conversation_trie, TRIE_SQL),
}
