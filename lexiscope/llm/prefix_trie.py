"""The prefix trie of conversations: which ones share their first turns, and what sharing saves.

A conversation is rebuilt first: it takes the first ``h`` turns of the conversation whose id is its own
without the remainder by ``FAMILY``, and then its own turns after its first ``h``, where ``h`` is the
CRC-32 of its id in decimals modulo ``HEADS``. A node of the trie is a different sequence of first
turns, role and text; its members are the rebuilt conversations that start with it.

A rebuilt conversation is a string of 16 bytes a turn, an MD5 of role and text. Equal ones are one
row, and the rows are sorted over all ranges of a range partitioning, so that members of a node stand
side by side. In a range, the longest common prefixes of neighbours (LCPs) go into a sparse table of
minima. Each candidate prefix, a row and a depth beyond the LCP with the row before, then searches
the left and the right end of its members by itself, by halving steps through that table; there is no
stack and no order in which candidates must be seen. Counts over the members, the nodes below and
their leaves are differences of running sums, because nodes in the order of rows and depths are in
depth-first order.

A node that holds the first or the last row of its range may go on in the next one. Only such nodes,
the prefixes of two rows a range, are merged over ranges: their counts are added by prefix, and one
task sums them upwards, as many rows as ranges times turns of one conversation. So a first turn that
a third of all conversations have is spread over as many ranges as its rows need.

The ids that end at a node are digested in order from pieces of at most ``PIECE_IDS`` ids, made where
the sorted ids are; only SHA-256 itself, which can't be split, runs over the pieces one by one.

Bounds: a conversation is one row, 20 bytes a turn, without its texts.

Defined results: turns of one conversation are in the order of their number, null first, equal ones by
role and then by the MD5 of role and text; repeated rows are turns of their own; null role and text
are empty; rows without ``conv_id`` belong to no conversation and are left out; a conversation whose
rebuilt form has no turn is a member of the root alone and ends there; an empty table has no node.
Other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiscope.sources.shared import write_and_reread

FAMILY = 20
HEADS = 4
TURN = 16  # bytes of a turn in a sequence
WORD = r"[^\x20\x09-\x0D]+"
PIECE_IDS = 4_096
RANGE_TURNS = 500_000
SMALL = 100_000  # rows that may be broadcast
NO_ENDS = hashlib.sha256(b"").hexdigest()


def first_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its family."""
    return (F.crc32(conv_id.cast("string")) % HEADS).cast("int")


def rebuilt(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``conv_id``, its rebuilt ``sequence`` and the ``words`` of each of its turns."""
    said, by = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    mark = F.md5(F.concat(F.length(by).cast("string"), F.lit(":"), by, said).cast("binary"))
    own = (
        turns.filter(F.col(conv).isNotNull())
        .select(
            F.col(conv).cast("bigint").alias("conv_id"),
            F.struct(
                F.col(turn).alias("turn"), by.alias("role"), mark.alias("mark"),
                F.regexp_count(said, F.lit(WORD)).cast("int").alias("words"),
            ).alias("one"),
        )
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("one")).alias("own"))
        .select("conv_id", F.transform("own", lambda x: F.struct(x["mark"], x["words"])).alias("own"))
    )
    own = write_and_reread(own, "conversations")
    heads = own.filter(F.col("conv_id") % FAMILY == 0).select(
        F.col("conv_id").alias("base"), F.slice("own", 1, HEADS - 1).alias("head")
    )
    h = first_turns(F.col("conv_id"))
    head = F.slice(F.coalesce("head", F.slice("own", 1, 0)), F.lit(1), h)
    rest = F.slice("own", h + 1, F.greatest(F.size("own") - h, F.lit(0)))
    joined = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).join(heads, "base", "left")
    turned = joined.select("conv_id", F.concat(head, rest).alias("all"))
    return turned.select(
        "conv_id",
        F.unhex(F.array_join("all.mark", "")).alias("sequence"),
        F.col("all.words").alias("words"),
    )


def different_sequences(conversations: DataFrame, ranges: int) -> DataFrame:
    """One row per different sequence: its words, smallest id, number of ids and their digest."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, PIECE_IDS):
                some = batch.slice(low, PIECE_IDS)
                sequence, ids = some.column("sequence"), some.column("conv_id").to_numpy()
                coded = sequence.dictionary_encode().indices.to_numpy()
                begin = np.flatnonzero(np.diff(coded, prepend=-1))
                end = np.append(begin[1:], len(coded))
                at = pa.array(begin)
                yield pa.RecordBatch.from_arrays(
                    [
                        sequence.take(at),
                        some.column("words").take(at),
                        pa.array(ids[begin]),
                        pa.array(end - begin),
                        pa.array([",".join(map(str, ids[a:b])) for a, b in zip(begin, end)]),
                    ],
                    names=["sequence", "words", "conv_id", "n", "ids"],
                )

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, n, words, digest = None, 0, 0, None, None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if row["sequence"] != now or digest is None:
                    if digest is not None:
                        done.append((now, words, first, n, digest.hexdigest()))
                    now, words, first, n = row["sequence"], row["words"], row["conv_id"], 0
                    digest = hashlib.sha256()
                digest.update((("," if n else "") + row["ids"]).encode())
                n += row["n"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(list(zip(*done)) or [()] * 5, kinds)], names=names
            )
        if digest is not None:
            row = (now, words, first, n, digest.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], k) for x, k in zip(row, kinds)], names=names
            )

    names = ["sequence", "words", "conv_id", "n", "ends"]
    kinds = [pa.binary(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.string()]
    common = "sequence binary, words array<int>, conv_id bigint, n bigint"
    cut = (
        conversations.repartitionByRange(ranges, "sequence", "conv_id")
        .sortWithinPartitions("sequence", "conv_id")
        .mapInArrow(pieces, f"{common}, ids string")
    )
    together = cut.repartition(ranges, "sequence").sortWithinPartitions("sequence", "conv_id")
    return together.mapInArrow(digests, f"{common}, ends string")


class Minima:
    """Least values of any stretch of an array, from a table of those of lengths that double."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels = [values]
        width = 1
        while 2 * width <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The least between two places, both included."""
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        found = np.empty(len(first), self.levels[0].dtype)
        for at in np.unique(level):
            some = level == at
            values = self.levels[at]
            found[some] = np.minimum(values[first[some]], values[last[some] - (1 << at) + 1])
        return found

    def reach_right(self, start: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The last place up to which all values after ``start`` are at least ``least``."""
        at = start.copy()
        for level in range(len(self.levels) - 1, -1, -1):
            values = self.levels[level]
            inside = at + 1 < len(values)
            wide = inside.copy()
            wide[inside] = values[at[inside] + 1] >= least[inside]
            at[wide] += 1 << level
        return at

    def reach_left(self, start: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The first place from which on all values up to ``start`` are at least ``least``.

        A place's own value is that between it and the one before.
        """
        at = start.copy()
        for level in range(len(self.levels) - 1, -1, -1):
            values, width = self.levels[level], 1 << level
            inside = at - width + 1 >= 0
            wide = inside.copy()
            wide[inside] = values[at[inside] - width + 1] >= least[inside]
            at[wide] -= width
        return at


def common_prefixes(marks: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """How many turns each sequence shares with the one before it; -1 for the first."""
    shared = np.full(len(length), -1, np.int64)
    most = np.minimum(length[1:], length[:-1])
    total = int(most.sum())
    owner = np.repeat(np.arange(len(most)), most)
    step = np.arange(total) - np.repeat(np.cumsum(most) - most, most)
    same = (marks[begin[1:][owner] + step] == marks[begin[:-1][owner] + step]).all(axis=1)
    stop = np.full(len(most), -1, np.int64)
    other = np.flatnonzero(~same)[::-1]
    stop[owner[other]] = step[other]
    shared[1:] = np.where(stop < 0, most, stop)
    return shared


def range_nodes(
    marks: np.ndarray, words: np.ndarray, begin: np.ndarray, n: np.ndarray, ids: np.ndarray
) -> dict[str, np.ndarray]:
    """The nodes of sorted, different sequences: where each is, its members and what is below it.

    ``open`` nodes are prefixes of the first or the last sequence. They count as no leaf and save
    nothing here, for what they are is known only with the neighbouring ranges.
    """
    length = np.diff(begin)
    rows = len(length)
    shared = common_prefixes(marks, begin[:-1], length)
    new = length - shared  # the depths at which a row begins a node
    row = np.repeat(np.arange(rows), new)
    node_of_row = np.cumsum(new) - new
    depth = np.arange(len(row)) - node_of_row[row] + shared[row] + 1
    table = Minima(shared)
    left, right = table.reach_left(row, depth), table.reach_right(row, depth)
    edge = (left == 0) | (right == rows - 1)

    sums = lambda x: np.concatenate(([0], np.cumsum(x)))
    members = sums(n)
    count = members[right + 1] - members[left]
    before = np.lexsort((np.arange(rows), shared))  # rows by what they share, then by place
    key = shared[before] * (rows + 1) + before
    branches = np.searchsorted(key, depth * (rows + 1) + right, "right")
    branches -= np.searchsorted(key, depth * (rows + 1) + left, "right")
    children = branches + (length[left] > depth)
    last_word = np.where(depth > 0, words[np.maximum(begin[row] + depth - 1, 0)] if len(words) else 0, 0)
    end = np.append(node_of_row[1:], len(row))[right]
    first = np.arange(len(row))
    leaf, saved = sums((children == 0) & ~edge), sums(np.where(edge, 0, (count - 1) * last_word))
    above = depth - 1
    home = table.reach_left(row, above)
    parent = np.where(depth > 0, node_of_row[home] + above - shared[home] - 1, -1)
    inner = np.bincount(parent[edge & (depth > 0)], minlength=len(row)) if len(row) else children
    return {
        "row": row, "depth": depth, "open": edge, "parent": parent, "n": count, "words": last_word,
        "conv_id": Minima(ids).of(left, right), "children": children - np.where(edge, inner, 0),
        "leaves": leaf[end] - leaf[first], "saved": saved[end] - saved[first],
        "ends": depth == length[row],
    }


NODE = (
    "conv_id bigint, depth bigint, n bigint, children bigint, leaves bigint, saved bigint, "
    "words bigint, ends string, open boolean, prefix binary, parent_prefix binary, parent_id bigint"
)


def _prefix_names(sequence: bytes) -> list[bytes]:
    """A name for each prefix of a sequence, from the root on."""
    names, digest = [hashlib.md5(b"").digest()], hashlib.md5()
    for at in range(0, len(sequence), TURN):
        digest.update(sequence[at : at + TURN])
        names.append(digest.copy().digest())
    return names


def _nodes_of_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    whole = [b for b in batches if b.num_rows]
    if not whole:
        return
    table = pa.Table.from_batches(whole).combine_chunks()
    sequences = table.column("sequence").combine_chunks()
    data = np.frombuffer(b"".join(sequences.to_pylist()), np.uint8)
    words = table.column("words").combine_chunks()
    length = pc.list_value_length(words).to_numpy()
    begin = np.concatenate(([0], np.cumsum(length))).astype(np.int64)
    ids = table.column("conv_id").to_numpy()
    found = range_nodes(
        data.reshape(-1, TURN), words.flatten().to_numpy().astype(np.int64), begin,
        table.column("n").to_numpy(), ids,
    )
    rows = len(ids)
    names = {at: _prefix_names(sequences[at].as_py()) for at in {0, rows - 1}}
    edge, parent, depth = found["open"], found["parent"], found["depth"]
    home = np.maximum(parent, 0)
    open_above = (parent >= 0) & edge[home]
    ends = table.column("ends").combine_chunks()

    def named(which: np.ndarray, node: np.ndarray) -> pa.Array:
        """The names of open nodes: prefixes of the first row, if they begin there, or of the last."""
        at = np.full(len(which), None, object)
        for i in np.flatnonzero(which):
            path = names[0 if found["row"][node[i]] == 0 else rows - 1]
            at[i] = path[depth[node[i]]]
        return pa.array(at, pa.binary())

    columns = [
        pa.array(found["conv_id"]), pa.array(depth), pa.array(found["n"]), pa.array(found["children"]),
        pa.array(found["leaves"]), pa.array(found["saved"]), pa.array(found["words"]),
        pc.if_else(pa.array(found["ends"]), ends.take(pa.array(found["row"])), None),
        pa.array(edge), named(edge, np.arange(len(edge))), named(open_above, home),
        pa.array(found["conv_id"][home], mask=(parent < 0) | open_above),
    ]
    yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in NODE.split(", ")])


def _merge_open(table: pa.Table) -> pa.Table:
    """Sum open nodes upwards, one depth after the other, when all ranges are added up."""
    table = table.sort_by([("depth", "ascending"), ("prefix", "ascending")])
    prefix = table.column("prefix").combine_chunks()
    above = pc.index_in(table.column("parent_prefix"), prefix).combine_chunks()
    parent = above.fill_null(-1).to_numpy()
    at = {c: table.column(c).to_numpy().copy() for c in ("depth", "n", "children", "leaves", "saved", "words", "conv_id")}
    np.add.at(at["children"], parent[parent >= 0], 1)
    # of the other nodes below each, leaves and saved tokens are counted already
    own = {"leaves": (at["children"] == 0).astype(np.int64), "saved": (at["n"] - 1) * at["words"]}
    for depth in range(int(at["depth"].max()), 0, -1):
        here = np.flatnonzero(at["depth"] == depth)
        for total in own.values():
            np.add.at(total, parent[here], total[here])
    for name, total in own.items():
        at[name] += total
    at["parent_id"] = at["conv_id"][parent]
    changed = {c: pa.array(v) for c, v in at.items()}
    changed["parent_id"] = pa.array(at["parent_id"], mask=parent < 0)
    columns = [changed.get(c, table.column(c)) for c in OPEN_COLUMNS]
    return pa.table(columns, list(OPEN_COLUMNS))


OPEN = (
    "prefix binary, parent_prefix binary, depth bigint, conv_id bigint, n bigint, children bigint, "
    "leaves bigint, saved bigint, words bigint, ends string, parent_id bigint"
)
OPEN_COLUMNS = tuple(c.split()[0] for c in OPEN.split(", "))


def prefix_trie(turns: DataFrame, **names: str) -> DataFrame:
    """Every node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256``. ``names`` are those of the columns, as ``rebuilt`` takes them."""
    conversations = write_and_reread(rebuilt(turns, **names), "rebuilt")
    total = conversations.agg(F.sum(F.size("words") + 1)).first()[0] or 0
    ranges = 1 + total // RANGE_TURNS
    classes = write_and_reread(different_sequences(conversations, ranges), "sequences")
    sorted_rows = classes.repartitionByRange(ranges, "sequence").sortWithinPartitions("sequence")
    nodes = write_and_reread(sorted_rows.mapInArrow(_nodes_of_range, NODE), "nodes")
    added = (
        nodes.filter("open")
        .groupBy("prefix")
        .agg(
            F.first("parent_prefix", ignorenulls=True).alias("parent_prefix"),
            F.first("depth").alias("depth"),
            F.min("conv_id").alias("conv_id"),
            *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")],
            F.max("words").alias("words"),
            F.max("ends").alias("ends"),
            F.lit(None).cast("bigint").alias("parent_id"),
        )
    )
    shared = write_and_reread(
        added.groupBy().applyInArrow(_merge_open, OPEN), "nodes-of-several-ranges"
    )
    above = shared.select(F.col("prefix").alias("parent_prefix"), F.col("conv_id").alias("above"))
    if shared.count() <= SMALL:
        above = F.broadcast(above)
    inner = nodes.filter("NOT open").join(above, "parent_prefix", "left")
    inner = inner.withColumn("parent_id", F.coalesce("parent_id", "above"))
    common = [
        "conv_id", "depth", F.col("parent_id").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
    ]
    return inner.select(*common).unionAll(shared.select(*common))
