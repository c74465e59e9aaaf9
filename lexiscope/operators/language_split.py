"""Cutting off a header in a foreign language where the text turns to the main language."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexiscope.functions.text import characters, pieces, strip_space, trigram_at, trigrams
from lexiscope.operators.language import (
    WEIGHED_CELLS,
    LanguageProfile,
    best_language,
    meet_head,
    score_languages,
    sum_weights,
    text_rows,
    text_slices,
    trigram_finder,
)
from lexiscope.sources.shared import write_and_reread

WINDOW_CHARS = 25
STEP_CHARS = 5
OPENING_STEPS = 40
PIECE_STEPS = 1_000
PARTITION_CHARS = 4_000_000
BLOCK_SUMS = 80  # sums that a row of a block may hold while it meets the head


def first_main_window(
    df: DataFrame,
    profile: LanguageProfile,
    text: str,
    keys: Sequence[str],
    main: str,
    window: int,
    step: int,
    piece_steps: int = PIECE_STEPS,
    chars: int | None = None,
) -> DataFrame:
    """The keys and ``cut``, the start of the first later window in the main language, or null.

    Windows of ``window`` characters start at every ``step``-th character of the whole text. Texts
    are handled in overlapping pieces, however long a text is. For a profile that is all head, the
    trigrams of a piece are looked up as numbers where it is, and running sums give its windows, so
    nothing is sorted and one row without text goes on. Pieces with a letter whose lower case
    depends on what stands around it, and all pieces for a profile with a tail, go on as texts: a
    window's score is a sum over its trigrams, so trigrams are summed once per block of ``step``
    positions and a window adds up whole blocks and the head of the next one. Pieces are dealt out
    before that, as they are smaller than their blocks.

    Blocks take many times the room of their text. So the pieces are dealt to as many partitions as
    ``PARTITION_CHARS`` asks for: one task holds the blocks of so many characters, whatever the size
    of the table. ``chars`` is how many characters ``df`` has at most; without it they are counted.
    """
    if (window - 2) // step < 1:
        raise ValueError("the window must be at least two characters longer than the step")
    if chars is None:
        chars = df.agg(F.sum(F.length(text))).first()[0]
    least = df.sparkSession.sparkContext.defaultParallelism
    partitions = max(least, math.ceil((chars or 0) / PARTITION_CHARS))
    cut_up = df.select(
        *keys, F.posexplode(pieces(F.col(text), piece_steps * step, window - 1)).alias("piece", "part")
    )
    if profile.tail is None and main in profile.languages:
        cut_up = cut_up.withColumn("part", F.col("part").cast("binary"))
        schema = T.StructType(
            [
                *cut_up.schema.fields[:-1],
                T.StructField("part", T.StringType()),
                T.StructField("settled", T.LongType()),
            ]
        )
        search = _piece_searcher(profile, schema.names, main, window, step)
        cut_up = cut_up.mapInArrow(search, schema)
    else:
        cut_up = cut_up.withColumn("settled", F.lit(None).cast("bigint"))
    cut_up = cut_up.repartition(partitions, *keys, "piece")
    in_rows = profile.tail is None and step * (len(profile.languages) + 1) <= BLOCK_SUMS
    windows = _windows_of_blocks if in_rows else _windows_of_units
    found = windows(cut_up, profile, [*keys, "piece", "settled"], window, step)
    scores = [F.col(w) for w in profile.weight_columns]
    in_main = best_language(profile, scores, F.col("known")) == main
    place = F.coalesce("settled", F.when(in_main, F.col("block") * step))
    start = F.col("piece") * (piece_steps * step) + place
    cut = F.when(start > 0, start)
    by_piece = found.groupBy(*keys, "piece").agg(F.min(cut).alias("cut"))
    return by_piece.groupBy(*keys).agg(F.min("cut").cast("int").alias("cut"))


def _piece_searcher(
    profile: LanguageProfile, names: list[str], main: str, window: int, step: int
) -> Callable:
    """For ``mapInArrow``: keys, numbered pieces and their texts to the places of main windows.

    ``settled`` is where the first window in ``main`` begins in its piece, the window at the
    beginning of the whole text left out, or null. The text goes on only where a trigram must be
    looked for as a string.
    """
    finder = trigram_finder(profile.packed)
    weights, wanted = profile.packed["weights"], profile.languages.index(main)
    slices = text_slices(max(1, WEIGHED_CELLS // weights.shape[1]))
    n_keys = len(names) - 2

    def run(batches):
        import numpy as np
        import pyarrow as pa

        find = finder()
        for batch in batches:
            for part, texts in slices(batch, n_keys):
                found, strange, _, starts, lengths = find(texts)
                sums = np.zeros((len(found) + 1, weights.shape[1]), np.int64)
                np.cumsum(weights[found], axis=0, out=sums[1:])
                counts = np.maximum(0, (lengths - window) // step + 1)
                owner = np.repeat(np.arange(len(texts)), counts)
                first = np.cumsum(counts) - counts
                inside = (np.arange(len(owner)) - first[owner]) * step
                begins = starts[owner] + inside
                scores = sums[begins + window - 2] - sums[begins]
                # argmax gives the first of equal languages, as they are in order
                hit = (scores[:, 0] > 0) & (scores[:, 1:].argmax(axis=1) == wanted)
                pieces = part.column(n_keys - 1).to_numpy()
                hit &= (inside > 0) | (pieces[owner] > 0)
                hit = np.flatnonzero(hit)
                hits, at = np.unique(owner[hit], return_index=True)
                place = np.zeros(len(texts), np.int64)
                place[hits] = inside[hit[at]]
                missing = np.ones(len(texts), bool)
                missing[hits] = False
                owners = np.searchsorted(starts, np.flatnonzero(strange), side="right") - 1
                open_ = np.zeros(len(texts), bool)
                open_[owners] = True
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(i) for i in range(n_keys)],
                        pa.array([t if o else None for t, o in zip(texts, open_.tolist())], pa.string()),
                        pa.array(place, mask=missing | open_),
                    ],
                    names=names,
                )

    return run


def _windows_of_blocks(
    cut_up: DataFrame, profile: LanguageProfile, keys: Sequence[str], window: int, step: int
) -> DataFrame:
    """``block``, ``known`` and the weights of every whole window, for a profile that is all head.

    A block is one row from the start: each of its trigrams meets the head on its own, so nothing is
    grouped. Texts shorter than a window have no window. A null text has one row without a block.
    """
    blocks_per_window, head = divmod(window - 2, step)
    measures = ["known", *profile.weight_columns]
    last = F.floor((F.size("__chars") - 1) / step).cast("int")
    rows = (
        cut_up.select(*keys, characters(F.col("part")).alias("__chars"))
        .select(*keys, "__chars", F.explode_outer(F.sequence(F.lit(0), last)).alias("block"))
        .select(
            *keys,
            "block",
            (F.col("block") * step + window <= F.size("__chars")).alias("whole"),
            *[trigram_at(F.col("__chars"), F.col("block") * step + i).alias(f"t{i}") for i in range(step)],
        )
    )
    zero = F.lit(0).cast("bigint")
    sums = {m: zero for m in measures}
    for i in range(step):
        left = [f"t{j}" for j in range(i + 1, step)]
        met = meet_head(rows, profile, f"t{i}")
        sums = {m: sums[m] + F.coalesce(F.col(m), zero) for m in measures}
        heads = [f"head_{m}" for m in measures if i >= head > 0]
        if i + 1 == head:
            heads = [sums[m].alias(f"head_{m}") for m in measures]
        rows = met.select(
            *keys, "block", "whole", *left, *heads, *[sums[m].alias(f"sum_{m}") for m in measures]
        )
        sums = {m: F.col(f"sum_{m}") for m in measures}

    in_order = Window.partitionBy(*keys).orderBy("block")
    blocks = in_order.rowsBetween(0, blocks_per_window - 1)
    added = {m: F.sum(f"sum_{m}").over(blocks) for m in measures}
    if head:
        added = {m: c + F.lead(f"head_{m}", blocks_per_window).over(in_order) for m, c in added.items()}
    floors = dict(zip(profile.weight_columns, profile.floors))
    return rows.select(
        *keys,
        "block",
        "whole",
        *[(c + floors.get(m, 0) * (window - 2)).alias(m) for m, c in added.items()],
    ).filter("whole OR block IS NULL")


def _windows_of_units(
    cut_up: DataFrame, profile: LanguageProfile, keys: Sequence[str], window: int, step: int
) -> DataFrame:
    """The same for any profile, from a row per trigram that is grouped by its unit of a block."""
    blocks_per_window, head = divmod(window - 2, step)
    # A block has two parts, the head that a window may end with and the rest, numbered in turn.
    block = F.floor(F.col("position") / step) * 2
    rest = (F.col("position") % step >= head).cast("int") if head else F.lit(0)
    rows = cut_up.select(*keys, F.posexplode_outer(trigrams(F.col("part"))).alias("position", "trigram")).select(
        *keys, (block + rest).alias("unit"), F.lower("trigram").alias("trigram")
    )
    units = sum_weights(rows, profile, [*keys, "unit"])
    last = 2 * blocks_per_window - (0 if head else 1)
    in_window = Window.partitionBy(*keys).orderBy("unit").rangeBetween(0, last)
    measures = ["n", "known", *profile.weight_columns]
    return (
        units.select(*keys, "unit", *[F.sum(m).over(in_window).alias(m) for m in measures])
        .filter((F.col("unit") % 2 == 0) & (F.col("n") == window - 2) | F.col("unit").isNull())
        .withColumn("block", (F.col("unit") / 2).cast("bigint"))
    )


def language_cuts(
    df: DataFrame,
    profile: LanguageProfile,
    texts: Sequence[str] = ("body",),
    key: str = "doc_id",
    main: str = "en",
    window: int = WINDOW_CHARS,
    step: int = STEP_CHARS,
    opening_steps: int = OPENING_STEPS,
    piece_steps: int = PIECE_STEPS,
) -> DataFrame:
    """``(key, column, cut)`` for every text to cut: the characters before its first window in
    ``main``. All text columns go through together.

    Only texts whose first window is in another language can be cut, and most headers are short.
    So the first window decides from the scan which texts go on, their openings are searched
    without going back to the table, and only texts still without a cut are searched as a whole.

    Both steps run at once and are stored as tables of keys and positions. Spark thus knows their
    size when it joins them to the texts, and broadcasts them only if they are small.
    """
    keys = [key, "column"]
    rows = text_rows(df, texts, [key])
    opening_chars = opening_steps * step + window - 1
    openings = rows.filter(F.length("text") >= window).select(
        *keys,
        F.substring("text", 1, opening_chars).alias("opening"),
        F.substring("text", 1, window).alias("first"),
        F.length("text").alias("length"),
    )
    # The opening is part of the grouping, so that it needs no join to come back to its key.
    candidates = write_and_reread(
        score_languages(openings, profile, "first", [*keys, "opening", "length"])
        .filter(F.col("detected") != main)
        .select(*keys, "opening", "length"),
        "openings",
    )
    size = candidates.agg(
        F.sum(F.length("opening")).alias("near"),
        F.sum(F.when(F.col("length") > opening_chars, F.col("length"))).alias("far"),
    ).first()
    near = write_and_reread(
        first_main_window(
            candidates, profile, "opening", keys, main, window, step, opening_steps, size["near"] or 0
        ),
        "opening-cuts",
    )
    remaining = rows.filter(F.length("text") > opening_chars).join(
        near.filter(F.col("cut").isNull()), keys, "left_semi"
    )
    far = first_main_window(
        remaining, profile, "text", keys, main, window, step, piece_steps, size["far"] or 0
    )
    found = near.unionByName(far).filter(F.col("cut").isNotNull())
    return write_and_reread(found, "language-cuts")


def split_on_language_change(
    df: DataFrame,
    profile: LanguageProfile,
    texts: Sequence[str] = ("body",),
    key: str = "doc_id",
    main: str = "en",
    window: int = WINDOW_CHARS,
    step: int = STEP_CHARS,
) -> DataFrame:
    """Add ``split_<text>``, a struct of header and body, for each of the text columns.

    A text that is not cut has an empty header and its own text as body; a null text has both
    empty. ``key`` must be unique. The cuts are found first (see ``language_cuts``); what remains
    is one join of a table of keys and positions. Over a table stored in buckets of the key that
    join never moves the texts.
    """
    found = language_cuts(df, profile, texts, key, main, window, step)
    cuts = found.groupBy(key).agg(
        *[
            F.max(F.when(F.col("column") == text, F.col("cut"))).alias(f"__cut{i}")
            for i, text in enumerate(texts)
        ]
    )
    stored = write_and_reread(cuts, "cuts-by-key")
    result = df.join(stored, key, "left")
    for i, text in enumerate(texts):
        value, cut = F.col(text), F.col(f"__cut{i}")
        split = F.when(
            cut.isNotNull(),
            F.struct(
                strip_space(F.substring(value, F.lit(1), cut)).alias("header"),
                strip_space(F.substring(value, cut + 1, F.length(value))).alias("body"),
            ),
        ).otherwise(
            F.struct(F.lit("").alias("header"), F.coalesce(value, F.lit("")).alias("body"))
        )
        result = result.withColumn(f"split_{text}", split)
    return result.drop(*[f"__cut{i}" for i in range(len(texts))])


def join_texts(df: DataFrame, left: str, right: str, out: str = "combined_text") -> DataFrame:
    """Two texts of a row joined by a space; a null one is skipped, an empty one is kept."""
    return df.withColumn(out, F.concat_ws(" ", F.col(left), F.col(right)))


def join_tables_on_key(left: DataFrame, right: DataFrame, key: str = "doc_id") -> DataFrame:
    return left.join(right, key, "inner")
