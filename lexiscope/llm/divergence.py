"""How far the word use of the sources of a language diverges, in exact integers.

Terms are runs of ASCII letters and of all characters beyond ASCII, with A-Z lower-cased; a language
keeps those in at least ``MIN_DOCS`` of its documents. A group (language and source) gives a kept term
the share ``p = 1 + floor(SCALE * (count + 2) / (N + 2 * V))``, N the group's kept terms in its texts,
V how many terms are kept. Two shares differ by ``f = floor((p - q)^2 / (p + q))``.

All pairs of sources are summed row by row, as in Gustavson's sparse product. The kept terms form a
term-major index, dealt out in slices of whole terms. In a slice each group walks over its own terms
and scatters what it shares with the peers that the index lists there into one dense accumulator of
a cell per peer, so no pair of postings ever becomes a row. That leaves out terms that one or both
lack. What they add depends on counts alone: for a group, each different count of its terms meets the
zero share of every peer once (``zero_baseline``), and terms that both have are corrected in the
scatter.

Counting is combined inside tasks, so a source with a third of all rows costs its tasks' terms. The
sums of groups are joined to the index by key; Spark broadcasts them only if they are small. A slice
has about ``SLICE`` postings, and never less than one term, whose postings are one per source.

Defined results: null text, language and source are read as empty, and the empty one is a language or
source like others; each row is a document, whatever its id; a group without terms has pairs; without
kept terms all values are 0; a language with one source has no pairs; an empty table gives an empty
one. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiscope.llm.arrow import small_slices, utf8_of
from lexiscope.llm.hashing import lower_ascii
from lexiscope.sources.shared import write_and_reread

MIN_DOCS = 10
SCALE = 1_000_000_000
TOP_TERMS = 10
SLICE = 200_000  # postings
PEERS = 4  # groups of a block
CELLS = 1 << 20  # cells worked on at a time
PART = "lang string, source string, part string, item string, value bigint"


def terms_of(data: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of texts, lower-cased, and the text that each is from."""
    small = lower_ascii(data)
    inside = (small >= 128) | ((small >= 97) & (small <= 122))
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    begins = bounds[:-1][bounds[:-1] < bounds[1:]]
    starts[begins] = inside[begins]
    at = np.flatnonzero(starts)
    packed = small[inside]
    offsets = np.append((np.cumsum(inside) - 1)[at], len(packed)).astype(np.int64)
    found = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(packed))
    return found, np.searchsorted(bounds, at, side="right") - 1


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term``, its occurrences ``n`` there and the ``docs`` that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in small_slices(batch, "text"):
                lang, source = (some.column(c).dictionary_encode() for c in ("lang", "source"))
                pair = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary)
                pair += source.indices.to_numpy()
                _, first, which = np.unique(pair, return_index=True, return_inverse=True)
                group = first[which]  # the first row of the same language and source
                found, owner = terms_of(*utf8_of(some.column("text")))
                coded = found.dictionary_encode()
                if not len(coded.dictionary):
                    continue
                width = np.int64(len(coded.dictionary))
                codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                in_doc, n = np.unique(owner * width + codes, return_counts=True)
                keys = group[in_doc // width] * width + in_doc % width
                kinds, which, docs_with = np.unique(keys, return_inverse=True, return_counts=True)
                total = np.bincount(which, n).astype(np.int64)
                at = pa.array(kinds // width)
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("lang").take(at),
                        some.column("source").take(at),
                        coded.dictionary.take(pa.array(kinds % width)).cast(pa.string()),
                        pa.array(total),
                        pa.array(docs_with.astype(np.int64)),
                    ],
                    names=["lang", "source", "term", "n", "docs"],
                )

    counted = docs.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    return counted.groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs")
    )


def term_index(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The kept terms of each language, with a posting for every source that has them."""
    return (
        counts.groupBy("lang", "term")
        .agg(
            F.sum("docs").alias("docs"),
            F.sum("n").alias("in_lang"),
            F.collect_list(F.struct("source", "n")).alias("postings"),
        )
        .filter(F.col("docs") >= min_docs)
        .select("lang", "term", "in_lang", "postings")
    )


def share(n: Column, size: Column, vocabulary: Column) -> Column:
    """``1 + floor(SCALE * (n + 2) / (size + 2 * vocabulary))``, exact for counts of any size."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)")
    bottom = (size + 2 * vocabulary).cast("decimal(20,0)")
    # the least remainder is subtracted first, so that the quotient is whole
    whole = ((top - top % bottom) / bottom).cast("bigint")
    return F.when(vocabulary > 0, 1 + whole).otherwise(F.lit(1).cast("bigint"))


def difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    apart = p - q
    return apart * apart // (p + q)


def group_sizes(docs: DataFrame, index: DataFrame) -> DataFrame:
    """Every group with its sums, those of its language, and ``zero``, its share of an absent term."""
    found = docs.select("lang", "source").distinct()
    own = (
        index.select("lang", F.inline("postings"))
        .groupBy("lang", "source")
        .agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("terms"))
    )
    whole = index.groupBy("lang").agg(
        F.sum("in_lang").alias("lang_size"), F.count(F.lit(1)).alias("vocabulary")
    )
    blocks = found.groupBy("lang").agg((F.floor(F.count(F.lit(1)) / PEERS) + 1).alias("blocks"))
    return (
        found.join(own, ["lang", "source"], "left")
        .join(whole, "lang", "left")
        .join(blocks, "lang")
        .fillna(0, ["size", "terms", "lang_size", "vocabulary"])
        .withColumn("zero", share(F.lit(0).cast("bigint"), F.col("size"), F.col("vocabulary")))
    )


def _runs(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The positions of all runs, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def _scatter(table: pa.Table, top: int) -> Iterator[pa.Table]:
    """What the groups of a slice share with their peers, and the terms they have more of."""
    for lang in pc.unique(table.column("lang")):
        some = table.filter(pc.equal(table.column("lang"), lang)).combine_chunks()
        some = some.sort_by([("term", "ascending"), ("source", "ascending")])  # term-major
        names = pc.unique(some.column("source")).sort()
        source = pc.index_in(some.column("source"), names).to_numpy()
        term = some.column("term").combine_chunks().dictionary_encode()
        p, zero, q = (some.column(c).to_numpy() for c in ("p", "zero", "q"))
        begins = np.flatnonzero(np.diff(term.indices.to_numpy(), prepend=-1))
        length = np.diff(np.append(begins, len(p)))
        of_term = np.repeat(np.arange(len(begins)), length)
        by_source = np.argsort(source, kind="stable")
        limits = np.searchsorted(source[by_source], np.arange(len(names) + 1))
        more = np.where(p > q, difference(p, q), -1)
        for me in range(len(names)):
            mine = by_source[limits[me] : limits[me + 1]]
            cells = np.zeros(len(names), np.int64)
            ahead = np.cumsum(length[of_term[mine]])
            for low in range(0, int(ahead[-1]), CELLS):
                part = mine[np.searchsorted(ahead, low, "right") : np.searchsorted(ahead, low + CELLS, "right")]
                lengths = length[of_term[part]]
                peers = _runs(lengths, begins[of_term[part]])
                own, own_zero = np.repeat(p[part], lengths), zero[mine[0]]
                add = difference(own, p[peers]) - difference(own, zero[peers])
                add += difference(own_zero, zero[peers]) - difference(own_zero, p[peers])
                np.add.at(cells, source[peers], add)
            peers = np.flatnonzero(cells)
            peers = peers[peers != me]
            yield _part(lang, names[me], "pair", names.take(pa.array(peers)), cells[peers])
            best = mine[np.argsort(-more[mine], kind="stable")[:top]]  # terms are in order already
            best = best[more[best] >= 0]
            yield _part(lang, names[me], "term", some.column("term").take(pa.array(best)), more[best])


def _part(lang, source, part: str, item, value: np.ndarray) -> pa.Table:
    rows = len(value)
    item = item.combine_chunks() if isinstance(item, pa.ChunkedArray) else item
    repeated = [pa.repeat(pa.scalar(str(x), pa.string()), rows) for x in (lang, source, part)]
    return pa.table([*repeated, item.cast(pa.string()), pa.array(value, pa.int64())],
                    ["lang", "source", "part", "item", "value"])


def _empty() -> pa.Table:
    return _part("", "", "", pa.array([], pa.string()), np.zeros(0, np.int64))


def zero_baseline(groups: DataFrame, index: DataFrame) -> DataFrame:
    """What pairs differ by in terms that one of them lacks or both lack, over all terms.

    A group's terms are taken together by count. Terms that both have are in it as if each lacked
    what the other has; the scatter corrects that. The peers of a language go to each of its blocks.
    """
    peers = groups.withColumn("block", F.explode(F.sequence(F.lit(1), F.col("blocks"))))
    alike = index.select("lang", F.inline("postings")).groupBy("lang", "source", "n").count()
    own = groups.join(alike, ["lang", "source"], "left").withColumn(
        "block", F.pmod(F.xxhash64("source"), F.col("blocks")) + 1
    )
    own = own.withColumn("p", share(F.coalesce("n", F.lit(0)), F.col("size"), F.col("vocabulary")))

    def run(own: pa.Table, peers: pa.Table) -> pa.Table:
        if not own.num_rows or not peers.num_rows:
            return _empty()
        lang = peers.column("of")[0]
        peers = peers.sort_by("peer")
        own = own.sort_by("source")
        names = peers.column("peer").combine_chunks()
        zeros, terms = peers.column("zero").to_numpy(), peers.column("terms").to_numpy()
        vocabulary = int(peers.column("vocabulary")[0].as_py())
        p, many = own.column("p").to_numpy(), pc.fill_null(own.column("count"), 0).to_numpy()
        place = pc.index_in(own.column("source"), names).to_numpy()
        begins = np.flatnonzero(np.diff(place, prepend=-1))
        step = max(1, CELLS // len(zeros))
        found = [_empty()]
        for begin, end in zip(begins, np.append(begins[1:], len(place))):
            me, lacking = int(place[begin]), np.zeros(len(zeros), np.int64)
            for low in range(begin, end, step):
                high = min(low + step, end)
                met = difference(p[low:high, None], zeros[None, :]) * many[low:high, None]
                lacking += met.sum(axis=0)
            neither = (vocabulary - terms[me] - terms) * difference(zeros[me], zeros)
            other = np.arange(len(zeros)) != me
            item, source = names.filter(pa.array(other)), names[me]
            found.append(_part(lang, source, "pair", item, (lacking + neither)[other]))
            back = _part(lang, source, "pair", item, lacking[other])
            back = back.select(["lang", "item", "part", "source", "value"])
            found.append(back.rename_columns(["lang", "source", "part", "item", "value"]))
        return pa.concat_tables(found)

    left = own.select("lang", "block", "source", "p", "count")
    right = peers.select(
        F.col("lang").alias("of"), F.col("block").alias("to"), F.col("source").alias("peer"),
        "zero", "terms", "vocabulary",
    )
    cogrouped = left.groupBy("lang", "block").cogroup(right.groupBy("of", "to"))
    return cogrouped.applyInArrow(run, PART)


def source_divergence(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    min_docs: int = MIN_DOCS,
    top: int = TOP_TERMS,
) -> DataFrame:
    """``lang, source, part, item, value, rank``.

    Part ``pair`` has every other source of the language and how far it is; part ``term`` the ``top``
    terms that the source has more of than the language as a whole.
    """
    rows = docs.select(
        *[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))]
    )
    index = write_and_reread(term_index(term_counts(rows), min_docs), "term-index")
    groups = write_and_reread(group_sizes(rows, index), "groups")
    postings = index.agg(F.sum(F.size("postings")).alias("n")).first().n or 0
    slices = 1 + postings // SLICE
    listed = (
        index.select("lang", "term", "in_lang", F.inline("postings"))
        .join(groups, ["lang", "source"])
        .select(
            "lang", "term", "source", "zero",
            share(F.col("n"), F.col("size"), F.col("vocabulary")).alias("p"),
            share(F.col("in_lang"), F.col("lang_size"), F.col("vocabulary")).alias("q"),
            F.pmod(F.xxhash64("lang", "term"), F.lit(slices)).alias("slice"),
        )
    )

    def run(table: pa.Table) -> pa.Table:
        return pa.concat_tables([_empty(), *_scatter(table, top)])

    scattered = listed.groupBy("slice").applyInArrow(run, PART)
    stored = write_and_reread(scattered, "scattered")
    pairs = (
        stored.filter("part = 'pair'")
        .unionAll(zero_baseline(groups, index))
        .groupBy("lang", "source", "part", "item")
        .agg(F.sum("value").alias("value"))
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(order))
    terms = stored.filter("part = 'term'").withColumn("rank", F.row_number().over(order))
    return ranked.unionAll(terms.filter(F.col("rank") <= top))
