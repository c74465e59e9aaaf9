"""Language identification with character-trigram profiles.

A profile holds one integer weight per trigram and language, learnt from labelled rows. The score
of a text is the sum of the weights of its trigrams; integer sums are the same in any order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiscope.functions.text import characters, pieces, trigram_at
from lexiscope.operators.frequent import most_frequent
from lexiscope.operators.sampling import pick_per_group
from lexiscope.sources.shared import write_and_reread

UNKNOWN = "unknown"
WEIGHT_SCALE = 1000
PIECE_CHARS = 8_000
HEAD_CELLS = 1_000_000
COUNTED_CHARS = 2_000_000
TAIL_SALTS = 16
BROADCAST_ROWS = 200_000  # of a key and a language each
WEIGHED_CELLS = 2_500_000  # weights that a task looks up at a time
FINAL_SIGMA = 0x3A3  # the one letter whose lower case depends on what stands around it


@dataclass(frozen=True)
class LanguageProfile:
    """``weights`` has a column ``trigram`` and columns ``w0, w1, ..``, one per language.

    ``floors`` are the weights of a trigram that is not in the table. The table is as large as the
    learnt corpus has different trigrams. Its most frequent ones, at most ``HEAD_CELLS`` weights,
    are the ``head``, which scoring broadcasts; the others are the ``tail``, which it joins. The
    tail is None where the head is all.
    """

    languages: tuple[str, ...]
    floors: tuple[int, ...]
    weights: DataFrame
    head: DataFrame
    tail: DataFrame | None

    @cached_property
    def hashes_differ(self) -> bool:
        """Whether no two trigrams of the head have the same 64-bit hash."""
        hashes = self.head.select(F.xxhash64("trigram").alias("h"))
        seen = hashes.agg(F.count("h").alias("all"), F.count_distinct("h").alias("different")).first()
        return seen["all"] == seen["different"]

    @cached_property
    def packed(self) -> dict:
        """The head as arrays, for tasks that look trigrams up as numbers.

        ``letters`` are the head's trigrams of three characters, ``weights`` the number 1 and their
        weights; the last two rows are those of an unknown trigram and of none. ``upper`` and
        ``lower`` are the letters that Spark lowers to one other letter wherever they stand, and
        ``odd`` all others that it changes.
        """
        rows = self.head.select("trigram", *self.weight_columns).toArrow()
        trigrams = rows.column("trigram").to_pylist()
        plain = np.array([len(t) == 3 for t in trigrams], bool)
        letters = np.array([[ord(c) for c in t] for t in trigrams if len(t) == 3], np.int64)
        weights = [rows.column(w).to_numpy() for w in self.weight_columns]
        table = np.stack([np.ones(len(trigrams), np.int64), *weights], axis=1)[plain]
        ends = np.zeros((2, table.shape[1]), np.int64)
        ends[0, 1:] = self.floors
        spark = self.head.sparkSession
        numbers = spark.range(0x110000).filter("id < 55296 OR id > 57343")
        letter = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
        changed = (
            numbers.select("id", letter.alias("letter"))
            .select("id", "letter", F.lower("letter").alias("lowered"))
            .filter("letter <> lowered")
            .collect()
        )
        alone = [len(r["lowered"]) == 1 and r["id"] != FINAL_SIGMA for r in changed]
        pairs = [(r["id"], ord(r["lowered"])) for r, one in zip(changed, alone) if one]
        return {
            "letters": letters.reshape(-1, 3),
            "weights": np.concatenate([table, ends]),
            "upper": np.array([a for a, _ in pairs], np.int64),
            "lower": np.array([b for _, b in pairs], np.int64),
            "odd": np.array([r["id"] for r, one in zip(changed, alone) if not one], np.int64),
        }

    @property
    def weight_columns(self) -> tuple[str, ...]:
        return tuple(f"w{i}" for i in range(len(self.languages)))

    def weight_rows(self) -> DataFrame:
        """The profile in long form: language, trigram, weight."""
        entries = [
            F.struct(F.lit(language).alias("lang"), F.col("trigram"), F.col(w).alias("weight"))
            for language, w in zip(self.languages, self.weight_columns)
        ]
        return self.weights.select(F.inline(F.array(*entries)))

    def save(self, path: str) -> None:
        """Store the weights and, beside them, the languages with their floors."""
        stored = self.weights.withColumn("in_head", F.lit(True))
        if self.tail is not None:
            marks = self.head.select("trigram", F.lit(True).alias("in_head"))
            stored = self.weights.join(marks, "trigram", "left").fillna(False, ["in_head"])
        stored.write.mode("overwrite").parquet(f"{path}/weights")
        rows = list(zip(range(len(self.languages)), self.languages, self.floors))
        known = self.weights.sparkSession.createDataFrame(rows, "idx int, lang string, floor bigint")
        known.coalesce(1).write.mode("overwrite").parquet(f"{path}/languages")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LanguageProfile:
        """A profile as it was saved, without learning anything again."""
        rows = spark.read.parquet(f"{path}/languages").orderBy("idx").collect()
        stored = spark.read.parquet(f"{path}/weights")
        tail = stored.filter("NOT in_head").drop("in_head")
        return cls(
            tuple(row["lang"] for row in rows),
            tuple(row["floor"] for row in rows),
            stored.drop("in_head"),
            stored.filter("in_head").drop("in_head"),
            None if tail.isEmpty() else tail,
        )


def learn_profile(
    labelled: DataFrame,
    text: str = "body",
    label: str = "category",
    head_cells: int = HEAD_CELLS,
) -> LanguageProfile:
    """Learn a profile from rows whose language is known, in one pass over their text.

    The weight of a trigram is ``round(1000 * ln((n + 1) / (T + V)))`` with ``n`` its count and
    ``T`` all counts in that language, and ``V`` the number of different trigrams. All trigrams
    are kept. They are counted as numbers inside the tasks, and few rows per task are shuffled;
    ``head_cells`` says how many weights may be broadcast, and changes no result.
    """
    found = labelled.select(label).filter(F.col(label).isNotNull()).distinct().orderBy(label)
    languages = tuple(row[0] for row in found.collect())
    if not languages:
        raise ValueError("no labelled rows to learn from")

    counted = [f"n{i}" for i in range(len(languages))]
    number = F.array_position(F.array(*[F.lit(language) for language in languages]), F.col(label))
    parts = labelled.filter(F.col(label).isNotNull()).select(
        (number - 1).cast("int").alias("number"),
        F.explode(pieces(F.col(text), PIECE_CHARS, 2).cast("array<binary>")).alias("piece"),
    )
    some = parts.mapInArrow(trigram_counter(), "number int, trigram string, n bigint")
    counts = write_and_reread(
        some.groupBy(F.lower("trigram").alias("trigram")).agg(
            F.sum("n").alias("total"),
            *[
                F.sum(F.when(F.col("number") == i, F.col("n")).otherwise(0)).alias(n)
                for i, n in enumerate(counted)
            ],
        ),
        "trigram-counts",
    )
    seen = counts.agg(
        F.count(F.lit(1)).alias("different"), *[F.sum(n).alias(n) for n in counted]
    ).first()
    sizes = [(seen[n] or 0) + seen["different"] for n in counted]

    def weighed(rows: DataFrame) -> DataFrame:
        return rows.select(
            "trigram",
            *[
                _weight(F.col(n), size).alias(f"w{i}")
                for i, (n, size) in enumerate(zip(counted, sizes))
            ],
        )

    weights = weighed(counts)
    head, tail = weights, None
    rows = max(1, head_cells // len(languages))
    if seen["different"] > rows:
        head = write_and_reread(
            weighed(most_frequent(counts, "total", rows, "trigram")), "profile-head"
        )
        tail = write_and_reread(
            weights.join(head.select("trigram"), "trigram", "left_anti"), "profile-tail"
        )
    spark = labelled.sparkSession
    unseen = spark.range(1).select(*[_weight(F.lit(0), size) for size in sizes]).first()
    return LanguageProfile(languages, tuple(unseen), weights, head, tail)


def _weight(n: Column, size: int) -> Column:
    return F.round(F.ln((n + 1) / F.lit(float(size))) * WEIGHT_SCALE).cast("bigint")


def trigram_counter(chars: int = COUNTED_CHARS) -> Callable:
    """For ``mapInArrow``: pieces of text as UTF-8, by their number, to the counts of their trigrams.

    About ``chars`` bytes are counted at a time, so one trigram may have several counts. Characters are
    numbered, and the trigrams of all pieces are counted as numbers made of those.
    The pieces are held apart by a character that no UTF-8 text has.
    """

    def count(batches):  # pickled whole, so that executors need no copy of this package
        import numpy as np
        import pyarrow as pa

        apart = 0xD800

        def counted(number, pieces):
            text = (2 * chr(apart)).join(p.decode("utf-8", "replace") for p in pieces)
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
            if len(codes) < 3:
                return
            often = np.bincount(codes)
            alphabet = np.flatnonzero(often)
            # frequent characters first: what they make is counted in few places of memory
            alphabet = alphabet[np.argsort(-often[alphabet], kind="stable")]
            numbers = np.zeros(len(often), np.int32)
            size = len(alphabet)
            numbers[alphabet] = np.arange(size)
            ids = numbers[codes].astype(np.int64)
            keys = (ids[:-2] * size + ids[1:-1]) * size + ids[2:]
            if size**3 <= 8 * len(keys):
                n = np.bincount(keys, minlength=size**3)
                keys = np.flatnonzero(n)
                n = n[keys]
            else:
                keys, n = np.unique(keys, return_counts=True)
            places = np.stack([keys // size**2, keys // size % size, keys % size], axis=1)
            found = alphabet[places]
            inside = (found != apart).all(axis=1)
            rows = [f"{chr(a)}{chr(b)}{chr(c)}" for a, b, c in found[inside].tolist()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(rows), number, np.int32)),
                    pa.array(rows, pa.string()),
                    pa.array(n[inside].astype(np.int64)),
                ],
                names=["number", "trigram", "n"],
            )

        waiting, sizes = {}, {}
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                for number, piece in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    waiting.setdefault(number, []).append(piece)
                    sizes[number] = sizes.get(number, 0) + len(piece)
                    if sizes[number] >= chars:
                        yield from counted(number, waiting.pop(number))
                        del sizes[number]
        for number, left in waiting.items():
            yield from counted(number, left)

    return count


def explode_trigrams(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """One row per trigram of the whole text, lower-cased; a null one for a text without any.

    Long texts go through in pieces, so that a task never holds all trigrams of one text.
    """
    cut = df.select(*keys, F.explode_outer(pieces(F.col(text), PIECE_CHARS, 2)).alias("piece"))
    chars = cut.select(*keys, characters(F.col("piece")).alias("__chars"))
    last = F.size("__chars") - 3
    starts = F.when(last >= 0, F.sequence(F.lit(0), last))
    rows = chars.select(*keys, "__chars", F.explode_outer(starts).alias("__position"))
    return rows.select(*keys, trigram_at(F.col("__chars"), F.col("__position")).alias("trigram"))


def sum_weights(rows: DataFrame, profile: LanguageProfile, by: Sequence[str]) -> DataFrame:
    """Per group of trigram rows: ``n`` of them, ``known`` ones, and the sum of each weight.

    Every trigram counts as the floor, and the known ones as what they differ from it, so a sum
    needs no row for the unknown. Trigrams of the head meet a broadcast table and are summed inside
    their task. The others are counted per group first and joined to the tail; as one that is rare
    in the learnt corpus may be frequent here, that join is spread over ``TAIL_SALTS`` copies.
    """
    columns = profile.weight_columns
    floors = dict(zip(columns, profile.floors))
    total = [F.sum(m).alias(m) for m in ("known", *columns)]
    met = meet_head(rows, profile)
    if profile.tail is None:
        sums = met.groupBy(*by).agg(F.count("trigram").alias("n"), *total)
    else:
        rest = F.when(F.col("known").isNull(), F.col("trigram")).alias("trigram")
        counted = met.groupBy(*by, rest).agg(F.count(met["trigram"]).alias("n"), *total)
        sums = _with_tail(counted, profile, by)
    return sums.select(
        *by,
        "n",
        F.coalesce("known", F.lit(0)).alias("known"),
        *[(F.coalesce(w, F.lit(0)) + F.col("n") * floors[w]).alias(w) for w in columns],
    )


def _with_tail(counted: DataFrame, profile: LanguageProfile, by: Sequence[str]) -> DataFrame:
    """Sums per group of what its rows have, and of the weights of the tail for ``n`` times ``trigram``."""
    columns = profile.weight_columns
    measures = ("known", *columns)
    floors = dict(zip(columns, profile.floors))
    salt = F.pmod(F.xxhash64(*by), F.lit(TAIL_SALTS)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.lit(TAIL_SALTS - 1))).alias("__salt")
    tail = profile.tail.select(
        "trigram",
        copies,
        F.lit(1).cast("bigint").alias("t_known"),
        *[(F.col(w) - floors[w]).alias(f"t_{w}") for w in columns],
    )
    looked_up = counted.withColumn("__salt", salt).join(tail.hint("merge"), ["trigram", "__salt"], "left")
    zero = F.lit(0).cast("bigint")
    return looked_up.groupBy(*by).agg(
        F.sum("n").alias("n"),
        *[
            F.sum(F.coalesce(m, zero) + F.coalesce(F.col("n") * F.col(f"t_{m}"), zero)).alias(m)
            for m in measures
        ],
    )


def meet_head(rows: DataFrame, profile: LanguageProfile, trigram: str = "trigram") -> DataFrame:
    """The rows with ``known`` and how the weights of their trigram differ from the floors.

    These are null where the head has no such trigram. Rows meet the head by a hash, as a table
    keyed by one number is read several times faster than one keyed by strings; the trigrams are
    compared after that. A head in which two hashes agree is met by its trigrams.
    """
    measures = ("known", *profile.weight_columns)
    # at most HEAD_CELLS weights
    head = F.broadcast(
        profile.head.select(
            F.xxhash64("trigram").alias("__hash") if profile.hashes_differ else F.col("trigram").alias("__hash"),
            F.col("trigram").alias("__trigram"),
            F.lit(1).cast("bigint").alias("__known"),
            *[(F.col(w) - floor).alias(f"__{w}") for w, floor in zip(profile.weight_columns, profile.floors)],
        )
    )
    key = F.xxhash64(trigram) if profile.hashes_differ else F.col(trigram)
    same = F.col("__trigram") == F.col(trigram)
    met = rows.join(head, key == F.col("__hash"), "left")
    return met.select(*rows.columns, *[F.when(same, F.col(f"__{m}")).alias(m) for m in measures])


def best_language(profile: LanguageProfile, scores: Sequence[Column], known: Column) -> Column:
    """The language with the greatest score, the alphabetically first of equals.

    ``unknown`` if the profile knows none of the trigrams.
    """
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    choice = F.coalesce(
        *[F.when(s == best, F.lit(name)) for s, name in zip(scores, profile.languages)]
    )
    return F.when(known > 0, choice).otherwise(F.lit(UNKNOWN))


def trigram_finder(packed: dict) -> Callable:
    """For tasks: a function that makes a function of texts, which finds all their trigrams.

    That gives, for every character and two that part each text from the next, the row of ``weights``
    of the trigram that begins there, and whether the trigram holds an odd letter and is not in the
    head; then the lowered characters, and where each text begins and how long it is.
    """

    def make():  # pickled whole, so that executors need no copy of this package
        import numpy as np

        apart, letters = 0xD800, packed["letters"]
        unknown = len(letters)
        none = unknown + 1
        lower = np.arange(0x110000, dtype=np.int32)
        lower[packed["upper"]] = packed["lower"]
        odd = np.zeros(0x110000, bool)
        odd[packed["odd"]] = True
        alphabet, often = np.unique(letters, return_counts=True)
        # frequent letters first: what they make is found in few places of memory
        alphabet = alphabet[np.argsort(-often, kind="stable")]
        numbers = np.zeros(0x110000, np.int32)
        numbers[alphabet] = np.arange(1, len(alphabet) + 1)
        size = len(alphabet) + 1
        keys = numbers[letters].astype(np.int64) @ np.array([size * size, size, 1])
        dense = size**3 <= max(1 << 21, 8 * len(letters))
        if dense:
            places = np.full(size**3, unknown, np.int32)
            places[keys] = np.arange(len(letters))
        else:
            order = np.argsort(keys)
            keys = keys[order]

        def find(texts):
            text = "".join(t + 2 * chr(apart) for t in texts)
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
            lengths = np.array([len(t) for t in texts], np.int64)
            starts = np.cumsum(lengths + 2) - lengths - 2
            lowered = lower[codes]
            small = numbers[lowered].astype(np.int64)
            wanted = (small[:-2] * size + small[1:-1]) * size + small[2:]
            found = np.full(len(codes), none, np.int32)
            if dense:
                found[:-2] = places[wanted]
            elif len(keys):
                near = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                found[:-2] = np.where(keys[near] == wanted, order[near], unknown)
            else:
                found[:-2] = unknown
            ends = np.append(starts[1:], len(codes))
            for back in (1, 2, 3, 4):
                at = ends - back
                found[at[at >= starts]] = none
            marked = np.append(odd[codes], [False, False])
            strange = (marked[:-2] | marked[1:-1] | marked[2:]) & (found == unknown)
            return found, strange, lowered, starts, lengths

        return find

    return make


def text_slices(cells: int) -> Callable:
    """For tasks: a function that gives the rows of a batch, and the texts in them, in small runs."""

    def slices(batch, column):
        texts, first, held = [], 0, 0
        for row, value in enumerate(batch.column(column)):
            texts.append((value.as_py() or b"").decode("utf-8", "replace"))
            held += len(texts[-1]) + 2
            if held >= cells:
                yield batch.slice(first, row + 1 - first), texts
                texts, first, held = [], row + 1, 0
        if texts:
            yield batch.slice(first), texts

    return slices


def _piece_weigher(profile: LanguageProfile, n_keys: int, names: list[str]) -> Callable:
    """For ``mapInArrow``: keys and pieces of text to the sums of the weights of all trigrams.

    A row for each piece, and rows for the trigrams that must still be looked for as strings: those
    that are not in the head and may be in the tail, or hold an odd letter. In the sums they count
    as unknown.
    """
    packed, has_tail = profile.packed, profile.tail is not None
    finder = trigram_finder(packed)
    slices = text_slices(max(1, WEIGHED_CELLS // packed["weights"].shape[1]))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        find, weights = finder(), packed["weights"]
        unknown = len(weights) - 2
        for batch in batches:
            for part, texts in slices(batch, n_keys):
                found, strange, lowered, starts, _ = find(texts)
                sums = np.add.reduceat(weights[found], starts, axis=0)
                at = np.flatnonzero(found == unknown if has_tail else strange)
                owner = np.searchsorted(starts, at, side="right") - 1
                rest = np.stack([owner, lowered[at], lowered[at + 1], lowered[at + 2]], axis=1)
                rest, times = np.unique(rest, axis=0, return_counts=True)
                rows = np.concatenate([np.arange(len(texts)), rest[:, 0]])
                words = [chr(a) + chr(b) + chr(c) for a, b, c in rest[:, 1:].tolist()]
                sums = np.concatenate([sums, np.zeros((len(rest), sums.shape[1]), np.int64)])
                times = np.concatenate([np.zeros(len(texts), np.int64), times])
                taken = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [
                        *[taken.column(i) for i in range(n_keys)],
                        pa.array([None] * len(texts) + words, pa.string()),
                        pa.array(times),
                        *[pa.array(np.ascontiguousarray(c)) for c in sums.T],
                    ],
                    names=names,
                )

    return run


def score_languages(
    df: DataFrame, profile: LanguageProfile, text: str, keys: Sequence[str], out: str = "detected"
) -> DataFrame:
    """The keys and the language of each text; ``keys`` identify a row.

    The trigrams of a piece of text are looked up as numbers and summed inside its task, so one row
    per text is shuffled. Only trigrams that the head lacks and that may be in the tail, or whose
    lower case depends on their surroundings, become rows that meet the tables as strings. Long
    texts go through in pieces, so that a task never holds all trigrams of one text.
    """
    measures = ["known", *profile.weight_columns]
    added = {m: f"__sum_{m}" for m in measures}
    cut = df.select(*keys, F.explode_outer(pieces(F.col(text), PIECE_CHARS, 2)).alias("__piece"))
    cut = cut.withColumn("__piece", F.col("__piece").cast("binary"))
    bigint = T.LongType()
    fields = [T.StructField(c, bigint) for c in ("__times", *added.values())]
    schema = T.StructType([*cut.schema.fields[:-1], T.StructField("__rest", T.StringType()), *fields])
    found = cut.mapInArrow(_piece_weigher(profile, len(keys), schema.names), schema)
    rows = found.withColumn("__rest", F.lower("__rest"))
    met = meet_head(rows, profile, "__rest")
    zero = F.lit(0).cast("bigint")
    total = {m: F.col(a) + F.coalesce(F.col("__times") * F.col(m), zero) for m, a in added.items()}
    if profile.tail is None:
        sums = met.groupBy(*keys).agg(*[F.sum(c).alias(m) for m, c in total.items()])
    else:
        rest = F.when(F.col("known").isNull(), F.col("__rest")).alias("trigram")
        counted = met.groupBy(*keys, rest).agg(
            F.sum("__times").alias("n"), *[F.sum(c).alias(m) for m, c in total.items()]
        )
        sums = _with_tail(counted, profile, keys)
    scores = [F.col(w) for w in profile.weight_columns]
    return sums.select(*keys, best_language(profile, scores, F.col("known")).alias(out))


def text_rows(df: DataFrame, texts: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """A row for each text column: the keys, its name as ``column``, and its ``text``."""
    entries = [F.struct(F.lit(c).alias("column"), F.col(c).alias("text")) for c in texts]
    return df.select(*keys, F.inline(F.array(*entries)))


def detect_languages(
    df: DataFrame,
    profile: LanguageProfile,
    texts: Sequence[str],
    key: str = "doc_id",
    out: str = "languages",
) -> DataFrame:
    """The table with an array of the languages of several columns, in the order given.

    All columns are scored in one pass, then joined once; ``key`` must be unique.
    """
    scored = score_languages(text_rows(df, texts, [key]), profile, "text", [key, "column"])
    listed = scored.groupBy(key).agg(
        *[F.max(F.when(F.col("column") == c, F.col("detected"))).alias(f"__{i}") for i, c in enumerate(texts)]
    )
    arrays = listed.select(key, F.array(*[f"__{i}" for i in range(len(texts))]).alias(out))
    return df.join(arrays, key)


def detect_language(
    df: DataFrame,
    profile: LanguageProfile,
    text: str = "body",
    key: str = "doc_id",
    out: str = "detected",
) -> DataFrame:
    """The table with the language of one of its columns; ``key`` must be unique.

    The languages are stored by their keys first, so Spark knows how many there are, and a table in
    buckets of the key stays where it is. The join carries only the columns that are used later on:
    a count per language moves no text.
    """
    scored = write_and_reread(score_languages(df, profile, text, [key], out), "languages-by-key")
    few = scored.count() <= BROADCAST_ROWS
    return df.join(F.broadcast(scored) if few else scored, key)


def flatten_languages(df: DataFrame, languages: str = "detected", out: str = "lang") -> DataFrame:
    """One row per detected language; an array column is exploded, empty and null ones vanish."""
    if isinstance(df.schema[languages].dataType, T.ArrayType):
        rows = df.withColumn(out, F.explode(languages))
    else:
        rows = df.filter(F.col(languages).isNotNull()).withColumn(out, F.col(languages))
    return rows if out == languages else rows.drop(languages)


def language_distribution(df: DataFrame, languages: str = "detected") -> DataFrame:
    return (
        flatten_languages(df.select(languages), languages, "lang")
        .groupBy("lang")
        .agg(F.count(F.lit(1)).alias("articles"))
        .orderBy(F.desc("articles"), "lang")
    )


def language_count(df: DataFrame, languages: str = "detected") -> DataFrame:
    rows = flatten_languages(df.select(languages), languages, "lang").distinct()
    return rows.agg(F.count(F.lit(1)).alias("languages"))


def other_languages(df: DataFrame, main: str = "en", lang: str = "lang") -> DataFrame:
    """Rows in another language than the main one; rows without a language are dropped."""
    return df.filter(F.col(lang) != main)


def minority_sample(
    df: DataFrame,
    languages: DataFrame,
    n: int = 10,
    main: str = "en",
    lang: str = "lang",
    key: str = "doc_id",
    seed: int = 42,
) -> DataFrame:
    """Up to ``n`` random rows of every language but the main one, by language and rank.

    ``languages`` holds the key and language of each row of ``df``. Ranking works on these alone.
    The picked keys are stored, so Spark knows how few they are when it joins them to the table,
    and no text is shuffled.
    """
    ranked = pick_per_group(other_languages(languages, main, lang), lang, key, n, seed)
    picked = write_and_reread(ranked.select(key, lang, "row_num"), "picked-keys")
    return df.join(picked, key).orderBy(lang, "row_num")
