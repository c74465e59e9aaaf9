"""Near-duplicate documents by the Jaccard similarity of word shingles, with adaptive prefixes.

A document is the set of its distinct runs of five words (letters A to Z in lower case, words
between ASCII white space); one with fewer words is its whole sequence. Two documents link when
the Jaccard similarity of their sets is at least ``similarity``. Each gets the smallest id that it
reaches by links.

A set that links with another shares at least ``l`` shingles with it among the first
``n - ceil(t * n) + l`` shingles of either, in any common order, for every ``l``.

1. In the order of hash values, and with ``l`` an eighth of the set, the shingles of these prefixes
   are counted over all documents, packed by ranges of values. Documents without enough shingles
   that occur elsewhere link with nothing; that is most of a corpus.
2. The sets of the others are collapsed to distinct ones and their shingles counted exactly. Now
   the order is by rarity, and every set lengthens its prefix, choosing the ``l`` for which the
   lengths of the posting lists it would meet, and the verifications expected from them, cost
   least. Two sets are a candidate when they share the smaller of their two ``l``.
3. Large groups of near copies are joined first to pivots, the sets with the fewest shingles of
   their own, which is linear and repeated ``PIVOT_ROUNDS`` times; candidates are only made between
   sets that these links have not already connected.
4. Candidates are verified with the whole sets, and the links' components give the answer.

Shingles are 64-bit hashes. Defined results: documents without words have an empty set and link
with nothing; rows of one id each have the component of their own text; a null id is reported as
null and links through its text; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiscope.llm.arrow import free_names, keyed_text, small_slices, utf8_of
from lexiscope.llm.components import connected_components
from lexiscope.llm.hashing import lower_ascii, mix, run_hashes, span_hashes, word_spans
from lexiscope.sources.shared import write_and_reread

SIZE = 5
SIMILARITY = 75  # percent
RANGE_BYTES = 64 << 20  # of text, for each range of hash values counted together
PACK_SHINGLES = 250_000  # held by a task until they are dealt to their ranges
TEXT_BYTES = 1 << 20  # of text whose shingles a task makes at a time
BROADCAST_ROWS = 500_000  # of 8 bytes each
PIVOT_ROUNDS = 2
PARITY_WORDS = 16
NO_ID = -(2**63)


def shingle_sets(texts: pa.Array, size: int = SIZE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, bounds = utf8_of(texts)
    data = lower_ascii(data)
    starts, ends, first = word_spans(data, bounds)
    words = span_hashes(data, starts, ends)
    runs = run_hashes(words, size)
    for begin, close in zip(first[:-1].tolist(), first[1:].tolist()):
        if close - begin >= size:
            yield np.unique(runs[begin : close - size + 1])
        elif close > begin:
            yield run_hashes(words[begin:close], close - begin)
        else:
            yield np.zeros(0, np.uint64)


def _needed(n, similarity: int):
    """How many shingles a set of ``n`` must share with one that it links with."""
    return -(-n * similarity // 100)


def _first_l(n: int) -> int:
    return max(1, n // 8)


def _set_id(values: np.ndarray) -> bytes:
    spread = mix(values)
    total, other = spread.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(spread), initial=0)
    return np.array([total, other, len(values)], np.uint64).tobytes()


PACKED = (
    "doc_id bigint, version bigint, n bigint, set_id binary, "
    "bucket int, owners binary, counts binary, shingles binary"
)


def _pack(docs: DataFrame, buckets: int, similarity: int) -> DataFrame:
    """One row for each document, and rows that hold prefix shingles by range of hash values."""
    names = ["doc_id", "version", "n", "set_id", "bucket", "owners", "counts", "shingles"]
    types = [
        pa.int64(), pa.int64(), pa.int64(), pa.binary(),
        pa.int32(), pa.binary(), pa.binary(), pa.binary(),
    ]

    def packed(owners: list, prefixes: list) -> pa.RecordBatch:
        values = mix(np.concatenate(prefixes))
        owner = np.repeat(np.array(owners, np.int64), [len(p) for p in prefixes])
        bucket = (values >> np.uint64(32)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
        rows = []
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            inside = order[cuts[b] : cuts[b + 1]]
            own = owner[inside]
            change = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            counts = np.diff(np.append(change, len(own))).astype(np.uint32)
            some = values[inside].astype(np.uint32)
            rows.append((b, own[change].tobytes(), counts.tobytes(), some.tobytes()))
        empty = [pa.nulls(len(rows), kind) for kind in types[:4]]
        full = [pa.array(c, kind) for c, kind in zip(zip(*rows), types[4:])]
        return pa.RecordBatch.from_arrays(empty + full, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners, prefixes, held = [], [], 0
        for batch in batches:
            for some in small_slices(batch, "text", TEXT_BYTES):
                sizes, ids = [], []
                for key, values in zip(
                    some.column("key").to_pylist(), shingle_sets(some.column("text"))
                ):
                    n = len(values)
                    sizes.append(n)
                    ids.append(_set_id(values) if n else None)
                    if n:
                        owners.append(NO_ID if key is None else key)
                        prefixes.append(values[: n - _needed(n, similarity) + _first_l(n)])
                        held += len(prefixes[-1])
                described = [
                    some.column("key"), some.column("version"), pa.array(sizes, types[2]),
                    pa.array(ids, types[3]),
                ]
                nothing = [pa.nulls(some.num_rows, kind) for kind in types[4:]]
                yield pa.RecordBatch.from_arrays(described + nothing, names=names)
                if held >= PACK_SHINGLES:
                    yield packed(owners, prefixes)
                    owners, prefixes, held = [], [], 0
        if owners:
            yield packed(owners, prefixes)

    return docs.mapInArrow(run, PACKED)


def _shared_counts(packed: DataFrame) -> DataFrame:
    """How many prefix shingles of each document occur in another one too, by range."""

    def run(table: pa.Table) -> pa.Table:
        read = lambda name, kind: [
            np.frombuffer(v.as_py(), kind) for v in table.column(name)
        ]
        owners = np.concatenate(read("owners", np.int64))
        counts = np.concatenate(read("counts", np.uint32))
        values = np.concatenate(read("shingles", np.uint32))
        order = np.argsort(values)
        ordered = values[order]
        same = ordered[1:] == ordered[:-1]
        shared = np.zeros(len(values), bool)
        shared[order[1:][same]] = True
        shared[order[:-1][same]] = True
        at = np.repeat(np.arange(len(owners)), counts)
        found = np.bincount(at[shared], minlength=len(owners))
        some = found > 0
        return pa.table({"doc_id": owners[some], "shared": found[some].astype(np.int64)})

    ranges = packed.filter("bucket is not null").select("bucket", "owners", "counts", "shingles")
    by_range = ranges.groupBy("bucket").applyInArrow(run, "doc_id bigint, shared bigint")
    return by_range.groupBy("doc_id").agg(F.sum("shared").alias("shared"))


def _parity(values: np.ndarray) -> np.ndarray:
    """Whether an odd number of shingles hash to each of some bits, in 64-bit words.

    Sets whose words differ in ``k`` bits differ in at least ``k`` shingles.
    """
    size = 64 * PARITY_WORDS
    odd = np.bincount((mix(values) >> np.uint64(40)).astype(np.int64) % size, minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _whole_sets(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in small_slices(batch, "text", TEXT_BYTES):
                sets = list(shingle_sets(some.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("key"),
                        pa.array([_set_id(s) for s in sets], pa.binary()),
                        pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                        pa.array([_parity(s) for s in sets], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "set_id", "shingles", "parity"],
                )

    schema = "doc_id bigint, set_id binary, shingles array<bigint>, parity array<bigint>"
    return docs.mapInArrow(run, schema)


def _adaptive_prefixes(sets: DataFrame, similarity: int) -> DataFrame:
    """Posting rows (``token``, ``node``, ``n``, ``l``, ``own``) of the prefix each set chooses.

    ``own`` is how many in a thousand of its shingles no other set has.
    """
    tokens = sets.select("node", "n", F.explode("shingles").alias("token"))
    frequent = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    ranked = (
        tokens.join(frequent, "token")
        .groupBy("node", "n")
        .agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("ranked"))
        .select("node", "n", F.col("ranked.df").alias("df"), F.col("ranked.token").alias("token"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for node, n, df, token in zip(
                batch.column("node").to_pylist(),
                batch.column("n").to_pylist(),
                batch.column("df"),
                batch.column("token"),
            ):
                spent = np.cumsum(np.append(0, df.values.to_numpy()))
                needed = _needed(n, similarity)
                rare = n - (len(spent) - 1)  # shingles of no other set come first in the order
                best = (np.inf, 1, 0)
                step = 1
                while step <= needed:
                    use = min(max(n - needed + step - rare, 0), len(spent) - 1)
                    # lists to be read, and candidates that come out of them, n/8 units each
                    cost = spent[use] * (1 + n / (8 * step))
                    best = min(best, (cost, step, use))
                    step *= 2
                chosen = token.values.to_numpy()[: best[2]]
                out.append((node, n, best[1], rare * 1000 // n, chosen))
            lengths = [len(o[4]) for o in out]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([o[4] for o in out]) if out else [], pa.int64()),
                    *[
                        pa.array(np.repeat(np.array([o[i] for o in out], np.int64), lengths))
                        for i in range(4)
                    ],
                ],
                names=["token", "node", "n", "l", "own"],
            )

    return ranked.mapInArrow(run, "token bigint, node bigint, n bigint, l bigint, own bigint")


def _sizes_allow(a: str, b: str, similarity: int) -> Column:
    return F.greatest(a, b) * similarity <= F.least(a, b) * 100


def _verified(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs (``a``, ``b``) whose whole sets are as similar as asked for."""
    side = lambda name: sets.select(
        F.col("node").alias(name), F.col("shingles").alias(f"of_{name}")
    )
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    same = F.size(F.array_intersect("of_a", "of_b"))
    return both.filter(
        same * (100 + similarity) >= (F.size("of_a") + F.size("of_b")) * similarity
    ).select("a", "b")


def _labelled(postings: DataFrame, labels: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Postings of the lists that more than one component is in, and each list's largest one."""
    if labels is None:
        marked = postings.withColumn("label", F.col("node"))
    else:
        marked = postings.join(labels, "node", "left").withColumn(
            "label", F.coalesce("label", "node")
        )
    parts = marked.groupBy("token", "label").count()
    largest = parts.groupBy("token").agg(
        F.max_by("label", F.struct("count", "label")).alias("largest"),
        F.max("count").alias("most"),
        F.count(F.lit(1)).alias("parts"),
    )
    return marked, largest.filter("parts > 1")


def _to_pivots(
    postings: DataFrame, labels: DataFrame | None, tested: DataFrame | None, similarity: int
) -> DataFrame:
    """A pair of every set and the pivot, of another component, that it shares most with.

    The pivot of a list is the set of its largest component, or of the whole list where none has
    two sets in it, with the smallest share of shingles of its own: in a group of near copies that
    is the one nearest to what they are copies of.
    """
    marked, lists = _labelled(postings, labels)
    some = write_and_reread(marked.join(lists.drop("parts"), "token"), "pivot-lists")
    order = F.struct("own", F.xxhash64("node"), "node", "n", "label")
    eligible = (F.col("label") == F.col("largest")) | (F.col("most") == 1)
    pivots = some.filter(eligible).groupBy("token").agg(F.min(order).alias("p"))
    pairs = (
        some.select("token", "node", "n", "label")
        .join(pivots, "token")
        .filter(F.col("label") != F.col("p.label"))
        .filter(_sizes_allow("n", "p.n", similarity))
        .groupBy(F.col("node").alias("a"), F.col("p.node").alias("b"))
        .count()
    )
    if tested is not None:
        pairs = pairs.join(tested, ["a", "b"], "left_anti")
    return pairs.groupBy("a").agg(F.max_by("b", F.struct("count", "b")).alias("b"))


def _candidates(
    postings: DataFrame, sets: DataFrame, labels: DataFrame, similarity: int
) -> DataFrame:
    """Pairs that share enough of their prefixes and are not connected yet.

    The parity bits of the two sets discard most of the others inside the join.

    In every list, sets outside its largest component meet all others; those inside do not meet
    each other, so a list of near copies costs no more than its length.
    """
    marked, lists = _labelled(postings, labels)
    names = [f"bits{i}" for i in range(PARITY_WORDS)]
    bits = sets.select("node", *[F.get("parity", i).alias(c) for i, c in enumerate(names)])
    open_lists = marked.join(lists.drop("parts", "most"), "token").join(bits, "node")
    some = write_and_reread(open_lists, "postings")
    unlike = reduce(
        Column.__add__, [F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in names]
    )
    alike = unlike * (100 + similarity) <= (F.col("x.n") + F.col("y.n")) * (100 - similarity)
    left = some.filter("label <> largest").alias("x")
    met = left.join(
        some.alias("y"),
        (F.col("x.token") == F.col("y.token"))
        & (F.col("x.label") != F.col("y.label"))
        & ((F.col("y.label") == F.col("y.largest")) | (F.col("x.node") < F.col("y.node")))
        & _sizes_allow("x.n", "y.n", similarity)
        & alike,
    )
    return (
        met.groupBy(
            F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")
        )
        .agg(F.count(F.lit(1)).alias("shared"), F.min(F.least("x.l", "y.l")).alias("l"))
        .filter("shared >= l")
        .select("a", "b")
    )


def near_duplicates(
    docs: DataFrame, similarity: int = SIMILARITY, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: ``doc_id``, ``n_shingles`` and ``component_id``, the smallest id it reaches.

    ``version``, a hash of the text, tells rows of one id apart.
    """
    rows = keyed_text(docs, key, text).withColumn("version", F.xxhash64("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(16, -(-total // RANGE_BYTES))
    packed = write_and_reread(_pack(rows, buckets, similarity), "packed-shingles")
    described = packed.filter("bucket is null").select("doc_id", "version", "n", "set_id")

    # enough of a prefix must occur elsewhere, for the smallest set that may link with this one
    n = F.col("n")
    smallest = F.ceil(n * similarity / 100).cast("bigint")
    needed = F.greatest(F.lit(1), F.floor(smallest / 8))
    key_of = F.coalesce("doc_id", F.lit(NO_ID))
    shared = _shared_counts(packed).withColumnRenamed("doc_id", "key_of")
    likely = write_and_reread(
        described.filter("n > 0")
        .withColumn("key_of", key_of)
        .join(shared, "key_of")
        .filter(F.col("shared") >= needed)
        .select("key_of")
        .distinct(),
        "likely-near",
    )
    marked = F.broadcast(likely) if likely.count() <= BROADCAST_ROWS else likely
    texts = rows.withColumn("key_of", F.coalesce("key", F.lit(NO_ID)))
    texts = texts.join(marked, "key_of", "left_semi").select("key", "text")
    classes = (
        _whole_sets(texts)
        .groupBy("set_id")
        .agg(
            F.min("doc_id").alias("first_id"),
            F.first("shingles").alias("shingles"),
            F.first("parity").alias("parity"),
        )
        .filter(F.size("shingles") > 0)
    )
    numbered = classes.select(
        F.monotonically_increasing_id().alias("node"),
        "*",
        F.size("shingles").cast("bigint").alias("n"),
    )
    sets = write_and_reread(numbered, "shingle-sets")

    postings = write_and_reread(_adaptive_prefixes(sets, similarity), "postings")
    tested = labels = direct = None
    for _ in range(PIVOT_ROUNDS):
        pairs = write_and_reread(_to_pivots(postings, labels, tested, similarity), "pivot-pairs")
        linked = _verified(pairs, sets, similarity)
        tested = pairs if tested is None else tested.unionAll(pairs)
        direct = linked if direct is None else direct.unionAll(linked)
        direct = write_and_reread(direct, "links")
        labels = connected_components(direct)
    further = _verified(_candidates(postings, sets, labels, similarity), sets, similarity)
    links = write_and_reread(direct.unionAll(further), "links")
    labels = connected_components(links)

    whole = sets.select("node", "set_id", "first_id").join(labels, "node", "left")
    whole = whole.withColumn("label", F.coalesce("label", "node"))
    smallest_id = whole.groupBy("label").agg(F.min("first_id").alias("component_id"))
    answer = whole.join(smallest_id, "label").select("set_id", "component_id")
    return described.join(answer, "set_id", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        "version",
    )


def one_of_each(
    docs: DataFrame, similarity: int = SIMILARITY, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The rows with the smallest id of their component, each once, with all their columns.

    Rows without words stay; so do rows without id that link with no row that has one.
    """
    row, version = free_names(docs, "__id", "__version")
    found = near_duplicates(docs, similarity, key, text)
    stay = found.filter(F.coalesce("doc_id", F.lit(NO_ID)) == F.coalesce("component_id", F.lit(NO_ID)))
    marks = stay.select(F.coalesce("doc_id", F.lit(NO_ID)).alias(row), F.col("version").alias(version))
    marked = docs.withColumns(
        {
            row: F.coalesce(F.col(key).cast("bigint"), F.lit(NO_ID)),
            version: F.xxhash64(F.coalesce(F.col(text), F.lit(""))),
        }
    )
    kept = marked.join(marks.distinct(), [row, version], "left_semi")
    return kept.dropDuplicates([row, version]).select(*docs.columns)
