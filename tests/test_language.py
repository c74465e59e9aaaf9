"""Language identification and the cut at a language change, against plain Python."""

from __future__ import annotations

import math
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiscope.functions.text import pieces, trigrams
from lexiscope.operators import language, language_split
from lexiscope.plans.language_queries import OPENING, bilingual_articles
from lexiscope.sources.articles import articles

SLOW = settings(
    max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
ENGLISH = "the nation that is in the end one of the best and that was on the other hand"
FRENCH = "la vieille ville et les gens du pays que nous aimons beaucoup dans notre maison"


class Plain:
    """The same rules, one text at a time in Python."""

    def __init__(self, profile):
        self.languages, self.floors = profile.languages, profile.floors
        self.weights = {r["trigram"]: list(r)[1:] for r in profile.weights.collect()}

    def detect(self, text):
        found = [text[i : i + 3].lower() for i in range(len(text) - 2)]
        if not any(t in self.weights for t in found):
            return "unknown"
        sums = [
            sum(self.weights[t][i] if t in self.weights else floor for t in found)
            for i, floor in enumerate(self.floors)
        ]
        return self.languages[sums.index(max(sums))]

    def split(self, text, window=25, step=5):
        if text is None:
            return "", ""
        starts = range(0, len(text) - window + 1, step)
        if len(starts) == 0 or self.detect(text[:window]) == "en":
            return "", text
        for start in starts[1:]:
            if self.detect(text[start : start + window]) == "en":
                return text[:start].strip(), text[start:].strip()
        return "", text


@pytest.fixture(scope="module")
def plain(profile):
    return Plain(profile)


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, body string")


def splits(df, profile, **options):
    found = language_split.split_on_language_change(df, profile, **options)
    rows = found.select("doc_id", "split_body.header", "split_body.body").collect()
    return {r["doc_id"]: (r["header"], r["body"]) for r in rows}


ODD_TEXTS = [
    None, "", "ab", FRENCH[:24], FRENCH[:25], ENGLISH, FRENCH, f"  {ENGLISH}  ", f"  {FRENCH} \n",
    f"{ENGLISH} {FRENCH}", f"{FRENCH} {ENGLISH}", f"{FRENCH}\n\n{ENGLISH}\n", "0" * 30 + ENGLISH,
    "0" * 60, f"{FRENCH} 😀😀 {ENGLISH}", f"İİİ {FRENCH} İ {ENGLISH}", f"😀{FRENCH[:29]}{ENGLISH}",
    f"{FRENCH * 40} {ENGLISH * 3}", "😀a" * 200 + ENGLISH, "ΑΣ ΟΣ " * 20 + ENGLISH,
]


# --- pieces of text ------------------------------------------------------------------------------


@pytest.mark.parametrize("size, overlap", [(10, 2), (25, 24), (1000, 2), (1, 2)])
def test_pieces_and_trigrams_lose_nothing(spark, size, overlap):
    texts = [t for t in ODD_TEXTS if t]
    rows = table(spark, texts).select(
        "doc_id", "body", pieces(F.col("body"), size, overlap).alias("p"),
        trigrams(F.col("body")).alias("t"),
    )
    for row in rows.collect():
        text = row["body"]
        assert row["p"] == [text[i : i + size + overlap] for i in range(0, len(text), size)]
        assert row["t"] == [text[i : i + 3] for i in range(len(text) - 2)]


def test_trigram_rows_do_not_depend_on_the_piece_size(spark, monkeypatch):
    rows = table(spark, ODD_TEXTS)
    whole = language.explode_trigrams(rows, "body", ["doc_id"]).filter("trigram IS NOT NULL")
    expected = sorted(whole.collect())
    monkeypatch.setattr(language, "PIECE_CHARS", 7)
    cut = language.explode_trigrams(rows, "body", ["doc_id"]).filter("trigram IS NOT NULL")
    assert sorted(cut.collect()) == expected
    # A text without trigrams keeps one row.
    kept = language.explode_trigrams(rows, "body", ["doc_id"]).select("doc_id").distinct()
    assert kept.count() == len(ODD_TEXTS)


# --- profile -------------------------------------------------------------------------------------


def test_profile_weights_follow_the_formula(spark):
    rows = [("a", "abcabc"), ("b", "abcd"), ("b", "xy"), (None, "zzzz")]
    learnt = language.learn_profile(
        spark.createDataFrame(rows, "category string, body string").filter("category IS NOT NULL")
    )
    counts = {"a": Counter(["abc", "bca", "cab", "abc"]), "b": Counter(["abc", "bcd"])}
    different = len(set().union(*counts.values()))
    assert learnt.languages == ("a", "b")

    def weight(n, name):
        return round(math.log((n + 1) / (counts[name].total() + different)) * 1000)

    found = {(r["lang"], r["trigram"]): r["weight"] for r in learnt.weight_rows().collect()}
    assert len(found) == 2 * different
    for (name, trigram), value in found.items():
        assert value == weight(counts[name][trigram], name)
    assert learnt.floors == (weight(0, "a"), weight(0, "b"))


@pytest.fixture(scope="module")
def tailed(spark, small):
    """The same profile with a head of 50 trigrams; most go through the tail."""
    short = language.learn_profile(articles(spark, small), head_cells=200)
    assert short.head.count() == 50 and short.tail.count() == short.weights.count() - 50
    return short


def test_the_head_changes_no_weight(profile, tailed):
    assert profile.tail is None and tailed.floors == profile.floors
    assert sorted(tailed.weights.collect()) == sorted(profile.weights.collect())


def test_a_tail_changes_no_result(spark, small, profile, tailed):
    texts = [r["body"] for r in articles(spark, small).limit(60).collect()] + ODD_TEXTS
    rows = table(spark, texts)
    whole, short = [
        sorted(language.detect_language(rows, p).select("doc_id", "detected").collect())
        for p in (profile, tailed)
    ]
    assert whole == short
    some = rows.filter("length(body) < 3000 OR body IS NULL")
    assert splits(some, profile) == splits(some, tailed)


def test_the_tail_is_not_broadcast(spark, small, tailed):
    rows = articles(spark, small)
    plan = language.score_languages(rows, tailed, "body", ["doc_id"])._jdf.queryExecution()
    text = plan.executedPlan().toString()
    assert text.count("BroadcastHashJoin") == 1 and "SortMergeJoin" in text


def test_a_hundred_and_one_languages(spark):
    names = [f"l{i:03}" for i in range(101)]
    rows = [(name, f"{name} text of its own {name}") for name in names]
    learnt = language.learn_profile(
        spark.createDataFrame(rows, "category string, body string"), head_cells=2_000
    )
    assert learnt.tail is not None
    found = language.detect_language(table(spark, [body for _, body in rows]), learnt)
    assert [r["detected"] for r in found.orderBy("doc_id").collect()] == names


def test_no_labelled_rows_is_an_error(spark, small):
    with pytest.raises(ValueError):
        language.learn_profile(articles(spark, small).filter("false"))


def test_a_profile_is_saved_and_loaded(spark, small, profile, tailed, tmp_path):
    rows = articles(spark, small).limit(40)
    expected = sorted(language.score_languages(rows, profile, "body", ["doc_id"]).collect())
    for i, known in enumerate((profile, tailed)):
        known.save(str(tmp_path / str(i)))
        loaded = language.LanguageProfile.load(spark, str(tmp_path / str(i)))
        assert (loaded.languages, loaded.floors) == (known.languages, known.floors)
        assert (loaded.tail is None) == (known.tail is None)
        assert sorted(language.score_languages(rows, loaded, "body", ["doc_id"]).collect()) == expected


def test_several_columns_are_detected_together(spark, profile, plain):
    rows = spark.createDataFrame(
        [(1, FRENCH, ENGLISH), (2, None, FRENCH), (3, ENGLISH, "")],
        "doc_id bigint, summary string, body string",
    )
    found = language.detect_languages(rows, profile, ("summary", "body"))
    for row in found.collect():
        assert row["languages"] == [plain.detect(row["summary"] or ""), plain.detect(row["body"] or "")]


# --- detection -----------------------------------------------------------------------------------


def test_detection_equals_plain_python(spark, small, profile, plain):
    texts = [r["body"] for r in articles(spark, small).collect()] + ODD_TEXTS
    found = language.detect_language(table(spark, texts), profile)
    rows = found.collect()
    assert len(rows) == len(texts)
    for row in rows:
        assert row["detected"] == plain.detect(row["body"] or "")


def test_most_documents_are_detected(spark, small, profile):
    found = language.detect_language(articles(spark, small), profile)
    assert found.filter("detected = category").count() / found.count() > 0.95


def test_equal_scores_go_to_the_first_language(spark):
    rows = [("b", "abcd"), ("a", "abcd")]
    learnt = language.learn_profile(spark.createDataFrame(rows, "category string, body string"))
    found = language.detect_language(table(spark, ["abcd"]), learnt).first()
    assert found["detected"] == "a"


def test_one_language_only(spark):
    rows = spark.createDataFrame([("a", "abcd")], "category string, body string")
    found = language.detect_language(table(spark, ["bcd", "xyz"]), language.learn_profile(rows))
    assert {r["doc_id"]: r["detected"] for r in found.collect()} == {0: "a", 1: "unknown"}


def test_flattening_distribution_and_count(spark):
    rows = [(1, ["en", "fr"]), (2, ["en"]), (3, []), (4, None), (5, ["de"])]
    table_ = spark.createDataFrame(rows, "doc_id int, langs array<string>")
    flat = language.flatten_languages(table_, "langs")
    assert sorted(tuple(r) for r in flat.collect()) == [(1, "en"), (1, "fr"), (2, "en"), (5, "de")]
    assert [tuple(r) for r in language.language_distribution(table_, "langs").collect()] == [
        ("en", 2), ("de", 1), ("fr", 1)
    ]
    assert language.language_count(table_, "langs").first()["languages"] == 3
    assert sorted(r["lang"] for r in language.other_languages(flat).collect()) == ["de", "fr"]
    plain_ = spark.createDataFrame([(1, "en"), (2, None), (3, "fr")], "doc_id int, detected string")
    assert language.language_count(plain_).first()["languages"] == 2
    assert language.other_languages(plain_, lang="detected").count() == 1


def test_minority_sample_moves_no_text(spark):
    rows = spark.range(200).selectExpr(
        "id AS doc_id", "concat('text ', id) AS body",
        "CASE WHEN id % 2 = 0 THEN 'en' WHEN id < 8 THEN 'de' ELSE 'fr' END AS lang",
    )
    sample = language.minority_sample(rows.drop("lang"), rows.select("doc_id", "lang"))
    found = [(r["lang"], r["row_num"]) for r in sample.collect()]
    assert found == [("de", i) for i in range(1, 5)] + [("fr", i) for i in range(1, 11)]
    plan = sample._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


# --- split ---------------------------------------------------------------------------------------


def test_split_of_odd_texts_equals_plain_python(spark, profile, plain):
    found = splits(table(spark, ODD_TEXTS), profile)
    for i, text in enumerate(ODD_TEXTS):
        assert found[i] == plain.split(text), text


def test_split_rules(spark, profile):
    found = splits(table(spark, ODD_TEXTS), profile)
    by_text = {text: found[i] for i, text in enumerate(ODD_TEXTS)}
    assert by_text[None] == ("", "") and by_text[""] == ("", "")
    assert by_text[FRENCH[:25]] == ("", FRENCH[:25])
    assert by_text[f"  {FRENCH} \n"] == ("", f"  {FRENCH} \n")
    assert by_text[f"{ENGLISH} {FRENCH}"] == ("", f"{ENGLISH} {FRENCH}")
    header, body = by_text[f"{FRENCH} {ENGLISH}"]
    assert header and header.startswith("la vieille") and body.endswith("hand")
    assert by_text["0" * 30 + ENGLISH][0] != ""


def test_split_of_all_documents_equals_plain_python(spark, small, profile, plain):
    rows = bilingual_articles(spark, small)
    found = splits(rows, profile)
    texts = {r["doc_id"]: r["body"] for r in rows.collect()}
    assert len(texts) == len(found) == 200
    for key, text in texts.items():
        assert found[key] == plain.split(text)
    put_in_front = [k for k, text in texts.items() if text.startswith(OPENING)]
    assert sum(found[k][0] != "" for k in put_in_front) / len(put_in_front) > 0.9


@pytest.mark.parametrize("piece_steps", [1, 3, 7, 1000])
def test_cuts_do_not_depend_on_the_piece_size(spark, small, profile, piece_steps):
    rows = bilingual_articles(spark, small).filter("length(body) < 3000")
    cuts = language_split.language_cuts(rows, profile, piece_steps=piece_steps)
    expected = language_split.language_cuts(rows, profile)
    assert sorted(cuts.collect()) == sorted(expected.collect())


@pytest.mark.parametrize("window, step", [(25, 5), (12, 5), (10, 8), (20, 3), (30, 7), (7, 1)])
def test_other_windows_and_steps(spark, small, profile, plain, window, step):
    rows = bilingual_articles(spark, small).filter("length(body) < 1500")
    found = splits(rows, profile, window=window, step=step)
    for row in rows.collect():
        assert found[row["doc_id"]] == plain.split(row["body"], window, step)


def test_window_must_exceed_the_step(spark, profile):
    with pytest.raises(ValueError):
        language_split.language_cuts(table(spark, ["x"]), profile, window=6, step=5)


def test_no_character_is_lost_and_partitions_do_not_matter(spark, small, profile):
    rows = bilingual_articles(spark, small)
    one, many = splits(rows.repartition(1), profile), splits(rows.repartition(8), profile)
    assert one == many
    for row in rows.collect():
        header, body = one[row["doc_id"]]
        assert "".join((header + body).split()) == "".join(row["body"].split())


@SLOW
@given(st.lists(st.text(alphabet="abéßİ😀 \nthe", max_size=60), min_size=1, max_size=15))
def test_split_of_random_texts_equals_plain_python(spark, profile, plain, texts):
    found = splits(table(spark, texts), profile)
    assert [found[i] for i in range(len(texts))] == [plain.split(t) for t in texts]


def test_two_columns_are_split_on_one_row(spark, profile, plain):
    rows = spark.createDataFrame(
        [(1, f"{FRENCH} {ENGLISH}", f"{FRENCH} {FRENCH} {ENGLISH}"), (2, None, ENGLISH)],
        "doc_id bigint, summary string, body string",
    )
    found = language_split.split_on_language_change(rows, profile, ("summary", "body"))
    assert found.columns == ["doc_id", "summary", "body", "split_summary", "split_body"]
    for row in found.collect():
        assert tuple(row["split_summary"]) == plain.split(row["summary"])
        assert tuple(row["split_body"]) == plain.split(row["body"])


def test_texts_are_joined_by_a_space(spark):
    rows = spark.createDataFrame([(1, None, "b"), (2, "", "b"), (3, "a", "b")], "doc_id int, s string, b string")
    joined = language_split.join_texts(rows, "s", "b").orderBy("doc_id")
    assert [r["combined_text"] for r in joined.collect()] == ["b", " b", "a b"]
    both = language_split.join_tables_on_key(rows.select("doc_id", "s"), rows.select("doc_id", "b"))
    assert sorted(tuple(r) for r in both.filter("doc_id = 3").collect()) == [(3, "a", "b")]


def test_units_and_blocks_give_the_same_windows(spark, small, profile, monkeypatch):
    rows = bilingual_articles(spark, small).filter("length(body) < 1500")
    blocks = sorted(language_split.language_cuts(rows, profile).collect())
    monkeypatch.setattr(language_split, "BLOCK_SUMS", 0)
    assert sorted(language_split.language_cuts(rows, profile).collect()) == blocks


def test_equal_hashes_of_trigrams_change_no_result(spark, small, monkeypatch):
    learnt = language.learn_profile(articles(spark, small))
    rows = articles(spark, small).limit(40)
    assert learnt.hashes_differ
    found = sorted(language.score_languages(rows, learnt, "body", ["doc_id"]).collect())
    learnt.__dict__["hashes_differ"] = False
    assert sorted(language.score_languages(rows, learnt, "body", ["doc_id"]).collect()) == found


def test_the_caller_may_use_the_names_of_inner_columns(spark, profile):
    rows = spark.createDataFrame([(1, FRENCH), (2, ENGLISH)], "chars int, position string")
    found = language.score_languages(rows, profile, "position", ["chars"])
    assert {r["chars"]: r["detected"] for r in found.collect()} == {1: "fr", 2: "en"}


def test_trigrams_are_counted_as_numbers(spark):
    """Alike in few and in many counts, with many characters, and never across pieces."""
    odd = "".join(chr(c) for c in range(0x4E00, 0x4E00 + 300))
    texts = [t for t in ODD_TEXTS if t] + ["a\0b\0\0c", odd, odd[::-1], "x" * 30_000]
    rows = [(i % 2, text.encode()) for i, text in enumerate(texts)]
    expected = Counter()
    for i, text in enumerate(texts):
        expected.update((i % 2, text[j : j + 3]) for j in range(len(text) - 2))
    given_ = spark.createDataFrame(rows, "number int, piece binary")
    for chars in (1, 500, 10_000_000):
        found = Counter()
        for r in given_.mapInArrow(language.trigram_counter(chars), "number int, trigram string, n bigint").collect():
            found[r["number"], r["trigram"]] += r["n"]
        assert found == expected


def test_learning_shuffles_few_rows_and_groups_no_row_per_trigram(spark, small, monkeypatch):
    stored = []
    keep = language.write_and_reread
    monkeypatch.setattr(language, "write_and_reread", lambda df, label: stored.append(df) or keep(df, label))
    language.learn_profile(articles(spark, small))
    plan = stored[0]._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "trigram" not in plan[plan.index("Generate") :]


def test_letters_whose_lower_case_depends_on_their_place_take_the_way_by_rows(spark, monkeypatch):
    """Sigma and the dotted capital I, in scores and in the search, against plain Python."""
    greek = "ΟΔΥΣΣΕΥΣ ΚΑΙ Ο ΛΟΓΟΣ ΤΗΣ ΠΟΛΗΣ ΜΑΣ, ΘΕΣ ΝΑ ΜΑΣ ΠΕΙΣ Σ ΑΥΤΟΣ"
    turkish = "İSTANBUL VE İZMİR İÇİN İYİ BİR YOL, ÇİÇEK İLE İNCİR"
    rows = [(1, greek, "el"), (2, turkish, "tr"), (3, ENGLISH.upper(), "en"), (4, FRENCH, "fr")]
    known = spark.createDataFrame(rows, "doc_id bigint, body string, category string")
    learnt = language.learn_profile(known)
    own = Plain(learnt)
    texts = [greek, greek.lower(), turkish, turkish.lower(), ENGLISH, greek + " " + ENGLISH]
    texts += [turkish + " " + ENGLISH.upper(), "ΣΣΣ", "İİİ", "日本語" * 9, "Σ" * 40 + ENGLISH, FRENCH + ENGLISH]
    found = language.score_languages(table(spark, texts), learnt, "body", ["doc_id"]).collect()
    assert {r["doc_id"]: r["detected"] for r in found} == {i: own.detect(t) for i, t in enumerate(texts)}
    expected = [own.split(t) for t in texts]
    for sums in (language_split.BLOCK_SUMS, 0):
        monkeypatch.setattr(language_split, "BLOCK_SUMS", sums)
        parts = splits(table(spark, texts), learnt)
        assert [parts[i] for i in range(len(texts))] == expected


def test_scoring_makes_no_row_for_a_trigram_of_the_head(spark, small, profile):
    """they are looked up where the piece is, so few rows go on."""
    rows = articles(spark, small)
    scored = language.score_languages(rows, profile, "body", ["doc_id"])
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "explode(sequence" not in plan and "trigram_at" not in plan
    names = ["doc_id", "rest", "times", *["known", *profile.weight_columns]]
    pieces_ = rows.selectExpr("doc_id", "cast(body AS binary) AS piece").filter("length(body) < 8000")
    schema = "doc_id bigint, rest string, " + ", ".join(f"{n} bigint" for n in names[2:])
    weighed = pieces_.mapInArrow(language._piece_weigher(profile, 1, names), schema)
    assert weighed.count() == pieces_.count()


def test_the_languages_of_a_table_are_stored_by_key(spark, small, profile, monkeypatch):
    """the join with the table repeats no scoring and knows how small one side is."""
    stored = []
    keep = language.write_and_reread
    monkeypatch.setattr(language, "write_and_reread", lambda df, label: stored.append(label) or keep(df, label))
    rows = articles(spark, small)
    found = language.detect_language(rows, profile)
    assert stored == ["languages-by-key"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "Exchange hashpartitioning" not in plan
    monkeypatch.setattr(language, "BROADCAST_ROWS", 0)
    joined = language.detect_language(rows, profile)
    assert sorted(joined.collect()) == sorted(found.collect())


@pytest.mark.parametrize("text", ["body", "summary"])
def test_the_search_passes_no_text_on(spark, small, profile, monkeypatch, text):
    """nothing is left for blocks and their sort, but pieces with an odd letter."""
    seen, blocks = [], language_split._windows_of_blocks

    def spy(cut_up, *more):
        seen.append(cut_up)
        return blocks(cut_up, *more)

    monkeypatch.setattr(language_split, "_windows_of_blocks", spy)
    rows = bilingual_articles(spark, small).select("doc_id", text)
    cuts = language_split.language_cuts(rows, profile, (text,))
    assert cuts.count() > 100 and len(seen) == 2
    assert seen[0].count() > 100
    assert [pieces_.filter("part IS NOT NULL").count() for pieces_ in seen] == [0, 0]
