"""Approximate nearest neighbours by a hash-prefix forest.

Every tree gives a vector a long hash string: the sides of ``BITS`` random planes through the mean
of all vectors on which it lies. In a tree the strings are a sorted array, kept in cells by their
first bits; a cell that is too full, such as that of one vector with very many copies, is divided
by the hash of the ids, so no task holds more than a bounded part of a tree.

A query descends a few trees first: the rows beside its place in a sorted array are those with the
longest prefixes in common with it, of whatever length these are. The distances of the best found
there say how likely a neighbour is to share one more bit, and so to which prefix length all trees
must ascend together for the neighbours to be met in one of them with a chance of ``target``. All
rows with that prefix, in every tree, are measured, and the nearest are the answer. In clustered
data this stops at long prefixes; without structure it ascends until enough has been read.

Distances are Euclidean, in double precision, on the vectors as given. Vectors that are null, zero,
of another length than most, or hold null or non-finite components take no part. Defined results:
ties go to the smaller id; rows that share an id count once, by the nearest, and are no neighbours
of each other; a null id takes no part; with fewer rows than asked for, all are found; an empty table gives an
empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiscope.sources.shared import write_and_reread

TREES = 32
DESCENDED = 8  # trees that a query descends first
BITS = 60
NEIGHBOURS = 10
BESIDE = 16  # rows looked at on either side of a query's place in a tree
TARGET = 0.95
CELL_ROWS = 4_096
FULL_CELL = 16_384  # rows beyond which a cell is divided
BROADCAST_ROWS = 100_000
INDEXED = "tree int, cell bigint, code bigint, id bigint, vector binary"


def usable_vectors(table: DataFrame, key: str, vector: str) -> DataFrame:
    """Ids and double vectors of the rows that take part."""
    rows = table.select(
        F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")
    ).filter("id is not null and v is not null")
    sound = rows.filter(
        F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0)
    )
    size = sound.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return sound.filter(F.size("v") == (size.n if size else 0))


def _planes(width: int, trees: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(trees, width, bits))


def _codes(vectors: np.ndarray, mean: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Hash strings of vectors in one tree, the first bit highest."""
    sides = (vectors - mean) @ planes > 0
    return sides @ (np.int64(1) << np.arange(planes.shape[1] - 1, -1, -1, dtype=np.int64))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy().reshape(len(column), -1)


def _from_binary(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, width)


def _index(
    rows: DataFrame, mean: np.ndarray, trees: range, depth: int, bits: int, seed: int
) -> DataFrame:
    """A row for each tree and vector, with its hash string and the cell of its first bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = _planes(len(mean), trees.stop, bits, seed)
        for whole in batches:
            for low in range(0, whole.num_rows, 2_000):
                batch = whole.slice(low, 2_000)
                vectors = _matrix(batch.column("v"))
                packed = pa.array([v.tobytes() for v in vectors], pa.binary())
                for tree in trees:
                    codes = _codes(vectors, mean, planes[tree])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(codes), tree, np.int32)),
                            pa.array(codes >> (bits - depth)),
                            pa.array(codes),
                            batch.column("id"),
                            packed,
                        ],
                        names=["tree", "cell", "code", "id", "vector"],
                    )

    return rows.mapInArrow(run, INDEXED)


def _divided(index: DataFrame, full: DataFrame) -> DataFrame:
    """Index rows with the part of their cell; cells that are not full have one part."""
    joined = index.join(full, ["tree", "cell"], "left")
    return joined.withColumn(
        "part", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int")
    ).drop("parts")


def _routed(asked: DataFrame, full: DataFrame) -> DataFrame:
    """Queries to every part of the cells they ask for."""
    joined = asked.join(full, ["tree", "cell"], "left")
    parts = F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)).cast("int") - 1)
    return joined.withColumn("part", F.explode(parts)).drop("parts")


FOUND = "query bigint, vec bigint, score double, agree double"


def _measured(index: DataFrame, asked: DataFrame, mean: np.ndarray, k: int, beside: int) -> DataFrame:
    """The nearest rows of every part of a cell to the queries that ask for it.

    A query asks for the strings from ``low`` to ``high``, or, where ``low`` is null, for those
    beside its own place. ``agree`` is the chance that a plane has the two on the same side.
    """
    width = len(mean)

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and queries.num_rows:
            code = rows.column("code").to_numpy()
            order = np.argsort(code, kind="stable")
            code = code[order]
            ids = rows.column("id").to_numpy()[order]
            vectors = _from_binary(rows.column("vector"), width)[order]
            wanted = _from_binary(queries.column("vector"), width)
            place = np.searchsorted(code, queries.column("code").to_numpy())
            low, high = queries.column("low"), queries.column("high")
            for at, query in enumerate(queries.column("id").to_pylist()):
                if low[at].is_valid:
                    i = int(np.searchsorted(code, low[at].as_py()))
                    j = int(np.searchsorted(code, high[at].as_py()))
                else:
                    i, j = max(int(place[at]) - beside, 0), int(place[at]) + beside
                some = np.arange(i, min(j, len(code)))
                some = some[ids[some] != query]
                if not len(some):
                    continue
                away = ((vectors[some] - wanted[at]) ** 2).sum(axis=1)
                if len(some) > k:
                    limit = np.partition(away, k - 1)[k - 1]
                    near = away <= limit
                    some, away = some[near], away[near]
                best = np.lexsort((ids[some], away))[:k]
                some, away = some[best], away[best]
                a, b = wanted[at] - mean, vectors[some] - mean
                size = np.linalg.norm(a) * np.linalg.norm(b, axis=1)
                cosine = np.divide(b @ a, size, out=np.ones(len(size)), where=size > 0)
                agree = 1 - np.arccos(np.clip(cosine, -1, 1)) / math.pi
                out.append((np.full(len(some), query), ids[some], np.sqrt(away), agree))
        kinds = (np.int64, np.int64, np.float64, np.float64)
        parts = zip(*out) if out else [[]] * 4
        joined = [np.concatenate(p) if len(p) else np.zeros(0, t) for p, t in zip(parts, kinds)]
        return pa.table(dict(zip(("query", "vec", "score", "agree"), joined)))

    key = ["tree", "cell", "part"]
    return index.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(run, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest different rows of each query, in order."""
    once = found.groupBy("query", "vec").agg(
        F.min("score").alias("score"), F.min("agree").alias("agree")
    )
    order = Window.partitionBy("query").orderBy("score", "vec")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest_neighbours(
    table: DataFrame,
    every: int = 100,
    k: int = NEIGHBOURS,
    trees: int = TREES,
    bits: int = BITS,
    target: float = TARGET,
    seed: int = 5,
    key: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """The ``k`` nearest found for every row whose id is divisible by ``every``.

    ``query_id``, ``rank`` from 1, ``vec_id`` and ``score``, the distance.
    """
    rows = write_and_reread(usable_vectors(table, key, vector), "vectors")
    count = rows.count()
    centre = rows.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(F.avg("x").alias("x"))
    mean = np.array([r.x for r in sorted(centre.collect(), key=lambda r: r.at)])
    depth = max(0, math.ceil(math.log2(max(count, 1) / CELL_ROWS)))
    depth = min(depth, bits)
    queries = rows.filter(F.col("id") % every == 0)
    index = _index(rows, mean, range(trees), depth, bits, seed)
    counted = index.groupBy("tree", "cell").count()
    full = write_and_reread(
        counted.filter(F.col("count") > FULL_CELL).select(
            "tree", "cell", F.ceil(F.col("count") / FULL_CELL).cast("int").alias("parts")
        ),
        "full-cells",
    )
    if full.count() <= BROADCAST_ROWS:
        full = F.broadcast(full)
    placed = _divided(index, full)

    # descend: the rows beside the query's place in the first trees
    some = range(min(DESCENDED, trees))
    own = _index(queries, mean, some, depth, bits, seed)
    nothing = F.lit(None).cast("bigint")
    asked = own.withColumns({"low": nothing, "high": nothing})
    first = _divided(_index(rows, mean, some, depth, bits, seed), full)
    begun = _best(_measured(first, _routed(asked, full), mean, k, BESIDE), k)

    # ascend: as far as the last of these needs to be met in one of the trees
    needed = math.log(1 - (1 - target) ** (1 / trees))
    agree = F.least(F.min("agree"), F.lit(1 - 1e-9))
    level = F.floor(F.lit(needed) / F.ln(F.greatest(agree, F.lit(1e-9))))
    levels = begun.groupBy(F.col("query").alias("id")).agg(
        F.when(F.count(F.lit(1)) >= k, F.greatest(F.lit(0), F.least(F.lit(bits), level)))
        .otherwise(0)
        .cast("int")
        .alias("level")
    )
    levels = write_and_reread(levels, "levels")
    strings = _index(queries, mean, range(trees), depth, bits, seed)
    known = strings.join(levels, "id", "left").withColumn("level", F.coalesce("level", F.lit(0)))
    shift = F.lit(bits) - F.col("level")
    low = F.call_function("shiftleft", F.call_function("shiftright", F.col("code"), shift), shift)
    span = F.call_function("shiftleft", F.lit(1).cast("bigint"), shift)
    ranged = known.withColumn("low", low).withColumn("high", F.col("low") + span)
    unit = F.lit(bits - depth)
    cells = F.sequence(
        F.call_function("shiftright", F.col("low"), unit),
        F.call_function("shiftright", F.col("high") - 1, unit),
    )
    ascended = ranged.withColumn("cell", F.explode(cells)).drop("level")
    found = _best(_measured(placed, _routed(ascended, full), mean, k, BESIDE), k)
    return found.select(
        F.col("query").alias("query_id"),
        F.col("rank").cast("int"),
        F.col("vec").alias("vec_id"),
        "score",
    )
