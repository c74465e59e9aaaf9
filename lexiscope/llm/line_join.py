"""Removal of lines that nearly repeat an earlier one, as an exact set-similarity join.

A line is the set of its words (between spaces, tabs and carriage returns, in lower case). Two
lines match when the Jaccard similarity of their sets is at least ``similarity``; a line goes if
one that matches it stands earlier, in a document of a smaller id or higher up in the same one,
whether or not that one goes too. Lines without words stay.

Lines with the same set are one class, which its first line stands for, so copies cost a partial
aggregate and never a join. The words of a class are ordered by rarity, which a table of counts
over all documents gives, and only a prefix of the rarest is joined on: sets that match share a
word of their prefixes. Length, the position of the shared word, and parity bits of the sets
discard most meetings inside a semi join that ends at the first one left. Lines that may match are
numbered by place and verified word by word in pairs: each with the first line of each of its rare
words, and what that does not settle with every earlier line that it may match.

All is built-in expressions. Defined results: a null text has no lines and stays null; rows of one
id and text are the same lines; rows of one id and different texts do not order each other; a null
id comes first; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiscope.llm.arrow import free_names
from lexiscope.sources.shared import finished_shuffles_removed, write_and_reread

SIMILARITY = 75  # percent
COUNTERS = 1 << 17  # of the table of word counts, a byte each in the plan and its descriptions
CODE_BITS = 56
LOWEST = 33  # first printable character; levels of frequency are printable characters
ONCE = LOWEST + 3  # level of a counter that has counted one word
NO_ID = -(2**63)
BROADCAST_ROWS = 200_000  # of 16 bytes each

def _plain(text: Column) -> Column:
    spaced = F.replace(F.replace(text, F.lit("\t"), F.lit(" ")), F.lit("\r"), F.lit(" "))
    return F.lower(spaced)


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(
        F.coalesce(F.col(key).cast("bigint"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64(text).alias("version"),
        F.col(text).alias("text"),
    )


def _counter(hashed: Column, counters: int) -> Column:
    return F.shiftright(hashed, 3).bitwiseAND(F.lit(counters - 1))


def frequency_levels(docs: DataFrame, text: str = "text", counters: int = COUNTERS) -> bytes:
    """How frequent words are, over all documents: a level for each hash value of a word.

    The table has a fixed size; words that share a counter seem as frequent as all of them
    together, which changes the order of words and so the cost, but no result.
    """
    spark = docs.sparkSession
    across = 1 << (counters.bit_length() // 2)
    words = docs.select(
        F.explode(F.split(F.replace(_plain(F.col(text)), F.lit("\n"), F.lit(" ")), " ")).alias("word")
    )
    counted = (
        words.groupBy(_counter(F.xxhash64("word"), counters).alias("counter"))
        .count()
        .unionAll(spark.range(counters).select("id", F.lit(0).cast("bigint")))
        .groupBy("counter")
        .agg(F.sum("count").alias("n"))
    )
    level = F.lit(LOWEST) + F.least(F.lit(93), F.floor(F.log2(F.col("n") + 1) * 3))
    strips = (
        counted.select(
            F.floor(F.col("counter") / across).alias("strip"),
            F.struct(F.col("counter"), F.chr(level.cast("bigint")).alias("level")).alias("cell"),
        )
        .groupBy("strip")
        .agg(F.array_join(F.array_sort(F.collect_list("cell"))["level"], "").alias("levels"))
    )
    rows = sorted(tuple(row) for row in strips.collect())
    return "".join(levels for _, levels in rows).encode()


def line_sets(rows: DataFrame, levels: bytes, marked: DataFrame | None = None) -> DataFrame:
    """Every line with words: where it is, and its set as codes with the rarest word first.

    Of the lines in ``marked`` only, where given, with its columns; no codes are made for others.
    """
    # eight levels a number: folded into one array, where a level is found without a string a word
    cells = [int.from_bytes(levels[i : i + 8]) for i in range(0, len(levels), 8)]
    table = F.split(F.lit(",".join(map(str, cells))), ",").cast("array<bigint>")

    def code(hashed: Column) -> Column:
        # a cell is always there; arrays that can't hold nulls are sorted as plain numbers
        at = F.shiftright(_counter(hashed, len(levels)), 3).cast("int")
        cell = F.coalesce(F.get(table, at), F.lit(0).cast("bigint"))
        # eight times the place in the cell, which are the last three bits of the counter
        place = hashed.bitwiseAND(F.lit(56)).cast("int")
        level = F.call_function("shiftleft", cell, place).bitwiseAND(127 << CODE_BITS)
        return level.bitwiseOR(F.shiftrightunsigned(hashed, 64 - CODE_BITS))

    lines = rows.select(
        "doc", "version", F.posexplode(F.split(_plain(F.col("text")), "\n")).alias("line", "words")
    ).filter(F.trim("words") != "")
    if marked is not None:
        lines = lines.join(marked, [*PLACE])
    hashes = F.array_distinct(F.transform(F.split("words", " "), lambda word: F.xxhash64(word)))
    no_word = F.xxhash64(F.lit(""))
    coded = F.transform(F.array_remove(hashes, no_word), code)
    given = [c for c in lines.columns if c != "words"]
    return lines.select(*given, F.sort_array(coded).alias("codes"))


PLACE = ("doc", "version", "line")
SKETCH = ("bits", "odd_bits")


def _parity(codes: Column, odd: bool = False) -> Column:
    """64 bits of a set: whether an odd number of its words hash to each.

    Sets with different bits in ``k`` places differ in at least ``k`` words. ``odd``: of the half of
    the words with a certain bit; with the bits of the other half, which the two tell, they are 128.
    """

    def turned(bits: Column, code: Column) -> Column:
        place = code.bitwiseAND(F.lit(63)).cast("int")
        one = F.shiftright(code, 6).bitwiseAND(F.lit(1)) if odd else F.lit(1)
        return bits.bitwiseXOR(F.call_function("shiftleft", one.cast("bigint"), place))

    return F.aggregate(codes, F.lit(0).cast("bigint"), turned)


def _prefix_size(n: Column, similarity: int) -> Column:
    return n - F.ceil(n * similarity / 100) + 1


def _described(lines: DataFrame, similarity: int, *more: str) -> DataFrame:
    """Size, sketch and prefix of each line, and its columns ``more``."""
    size = F.size("codes")
    return lines.select(
        *more,
        size.alias("n"),
        _parity(F.col("codes")).alias("bits"),
        _parity(F.col("codes"), odd=True).alias("odd_bits"),
        F.slice("codes", F.lit(1), _prefix_size(size, similarity).cast("int")).alias("prefix"),
    )


def _may_match(similarity: int) -> Column:
    """Length, position and parity filters for two lines that share a word of their prefixes."""
    n, m = F.col("a.n"), F.col("b.n")
    both = n + m
    shared = 1 + F.least(n - F.col("a.pos") - 1, m - F.col("b.pos") - 1)
    turned, odd = (F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}")) for c in SKETCH)
    unlike = F.bit_count(odd) + F.bit_count(turned.bitwiseXOR(odd))
    return (
        # the words in one set alone are at most both less twice the words they must share
        (unlike * (100 + similarity) <= both * (100 - similarity))
        & (F.greatest(n, m) * similarity <= F.least(n, m) * 100)
        & (shared * (100 + similarity) >= both * similarity)
    )


def _postings(lines: DataFrame, key: str) -> DataFrame:
    """A row for each word of a prefix, but for words that occur only once: none can share them."""
    # in the order of the table, so that both sides of a join with itself are one shuffle
    wanted = [c for c in lines.columns if c in (key, "n", *SKETCH)]
    rows = lines.select(*wanted, F.posexplode("prefix").alias("pos", "code"))
    return rows.filter(F.shiftrightunsigned("code", CODE_BITS) > ONCE)


def kept_lines(
    docs: DataFrame, similarity: int = SIMILARITY, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Places (``doc``, ``version``, ``line``) of the lines with words that match no earlier one."""
    rows = _rows(docs, key, text)
    with finished_shuffles_removed(docs.sparkSession):
        levels = frequency_levels(rows)
        own = (F.xxhash64("codes").alias("set0"), F.hash("codes").alias("set1"))
        described = _described(
            line_sets(rows, levels).select(*PLACE, "codes", *own), similarity, *PLACE, "set0", "set1"
        )
        first = F.min(F.struct(*PLACE, *SKETCH, "prefix")).alias("first")
        grouped = described.groupBy("set0", "set1", "n").agg(first)
        numbered = grouped.select("first.*", "n", F.monotonically_increasing_id().alias("id"))
        classes = write_and_reread(numbered, "line-classes")
        # a set can match another one only if it could lose a word and still match what it was
        joined = classes.filter(F.col("n") * 100 >= (F.col("n") + 1) * similarity)
        likely = write_and_reread(_meeting(joined, similarity), "likely-lines")
        sets = write_and_reread(_likely_sets(rows, likely, levels, similarity), "likely-sets")
        spots = _postings(sets, "at")
        found = write_and_reread(_verified(_pivots(spots, similarity), sets, similarity), "matched-lines")
        others = _verified(_pairs(spots, found, similarity), sets, similarity)
        later = write_and_reread(others, "matched-later")
    matched = likely.join(found.unionAll(later), ["at"], "left_semi").select(*PLACE)
    return classes.select(*PLACE).join(matched, [*PLACE], "left_anti")


def _meeting(classes: DataFrame, similarity: int) -> DataFrame:
    """Lines that may match another one, by the filters of the prefix join, numbered by place."""
    spots = _postings(classes, "id")
    # the filters are the same for both lines of a pair; which is first counts when verifying
    condition = (F.col("a.code") == F.col("b.code")) & (F.col("a.id") != F.col("b.id"))
    met = spots.alias("a").join(spots.alias("b"), condition & _may_match(similarity), "left_semi")
    places = classes.select("id", *PLACE).join(met.select("id").distinct(), ["id"], "left_semi")
    return places.orderBy(*PLACE).select(*PLACE, F.monotonically_increasing_id().alias("at"))


def _likely_sets(rows: DataFrame, likely: DataFrame, levels: bytes, similarity: int) -> DataFrame:
    """The words themselves of the likely lines."""
    small = likely.count() <= BROADCAST_ROWS
    marked = F.broadcast(likely) if small else likely
    owners = likely.select("doc", "version").distinct()
    texts = rows.join(F.broadcast(owners) if small else owners, ["doc", "version"], "left_semi")
    # rows of one id and text give the same lines twice, which have one number
    return _described(line_sets(texts, levels, marked), similarity, "at", "codes")


def _pivots(spots: DataFrame, similarity: int) -> DataFrame:
    """Each line ``a`` with the first line ``b`` that has the same word, where they may match.

    One pair a word, so that a group of many near copies is settled without all of its pairs.
    """
    by_word = Window.partitionBy("code").orderBy("at")
    own = F.struct(*spots.columns)
    pairs = spots.select(own.alias("a"), F.first(own).over(by_word).alias("b"))
    later = F.col("b.at") < F.col("a.at")
    return pairs.filter(later & _may_match(similarity)).select(F.col("a.at").alias("a"), F.col("b.at").alias("b")).distinct()


def _pairs(spots: DataFrame, found: DataFrame, similarity: int) -> DataFrame:
    """Lines ``a`` that are not found yet, with every earlier line ``b`` that they may match."""
    rest = spots.join(found, ["at"], "left_anti")
    condition = (F.col("a.code") == F.col("b.code")) & (F.col("b.at") < F.col("a.at"))
    met = rest.alias("a").join(spots.alias("b"), condition & _may_match(similarity))
    return met.select(F.col("a.at").alias("a"), F.col("b.at").alias("b")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Numbers of the lines ``a`` that match a line ``b`` of their pairs, by the words themselves."""
    words = sets.select("at", "codes")
    both = F.size("x.codes") + F.size("y.codes")
    same = F.size(F.array_intersect("x.codes", "y.codes"))
    first = pairs.join(words.alias("x"), F.col("a") == F.col("x.at"))
    matches = same * (100 + similarity) >= both * similarity
    met = first.join(words.alias("y"), (F.col("b") == F.col("y.at")) & matches, "left_semi")
    return met.select(F.col("a").alias("at")).distinct()


def count_columns(docs: DataFrame) -> list[str]:
    """The names of the two columns that ``remove_repeated_lines`` adds to a table."""
    return free_names(docs, "__lines", "__removed")


def remove_repeated_lines(
    docs: DataFrame, similarity: int = SIMILARITY, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The table with these lines taken out of ``text``, and two more columns about each row.

    ``__lines`` is how many lines a text had and ``__removed`` how many went; a null text has none.
    Where the table has such columns, they stay and these have other names (``count_columns``).
    """
    own = free_names(docs, "__doc", "__version", "__kept", "__all", "__stay")
    doc, version, stays, every, left = own
    kept = (
        kept_lines(docs, similarity, key, text)
        .groupBy(F.col("doc").alias(doc), F.col("version").alias(version))
        .agg(F.collect_list("line").alias(stays))
    )
    # the lines go through the join in place of the text, so they are cut once
    marked = docs.select(
        *[F.split(text, "\n").alias(every) if c == text else F.col(c) for c in docs.columns],
        F.coalesce(F.col(key).cast("bigint"), F.lit(NO_ID)).alias(doc),
        F.xxhash64(text).alias(version),
    )
    whole = marked.join(kept, [doc, version], "left")
    # only the blanks in front are looked at: a line of words is not gone through again
    numbers = F.transform(every, lambda x, i: F.when(F.ltrim(x, F.lit(" \t\r")) == "", i))
    blank = F.array_compact(numbers)
    some = F.coalesce(stays, F.array().cast("array<int>"))
    placed = whole.withColumn(left, F.array_sort(F.array_union(some, blank)))
    size = F.coalesce(F.size(every), F.lit(0))
    lines, removed = count_columns(docs)
    return placed.select(
        *[
            F.array_join(F.transform(left, lambda i: F.get(every, i)), "\n").alias(text)
            if c == text
            else F.col(c)
            for c in docs.columns
        ],
        F.when(F.col(every).isNull(), 0).otherwise(size).alias(lines),
        F.when(F.col(every).isNull(), 0).otherwise(size - F.size(left)).alias(removed),
    )
