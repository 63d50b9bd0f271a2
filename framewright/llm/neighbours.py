"""The k most similar vectors of every vector.

Bit vectors (``nearest_hashes``) are searched exactly; real vectors
(``nearest_vectors``) by multiprobe p-stable hashing.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions.numbers import small_side
from framewright.operators import hamming
from framewright.session import checkpointed, mapped

#: Queries ranked against all rows in one pass, and at once within it.
QUERY_BLOCK, QUERY_STEP = 1_024, 256
#: Rows and queries of a bucket that are compared in one place.
CELL_ROWS, CELL_QUERIES = 50_000, 5_000


def _first_rows(rows: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """The first k rows of each group; map tasks pass on k rows of a group at most."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n")


def nearest_hashes(df: DataFrame, *, bits: int, most: int, k: int, id_col: str = "hash_id", hash_col: str = "hash") -> DataFrame:
    """(hash_a, hash_b), a < b, once each: pairs in which one is among the k nearest others of the other.

    Nearest by (differing bits, id), at most most bits apart; exact. Rows with
    a null or differently long hash, a null within it or a null id are left
    out; ids are unique. Copies of a hash meet as one: of its rows the k + 1
    smallest ids are all that can be anybody's neighbour, so a hash that very
    many rows share costs those rows one join, not their pairs.
    """
    rows = hamming.packed(df, id_col, hash_col, bits)
    codes = checkpointed(
        _first_rows(rows, ["code"], ["id"], k + 1)
        .groupBy("code")
        .agg(F.sort_array(F.collect_list("id")).alias("ids"))
        .select("code", "ids", F.col("ids")[0].alias("rep"))
    )
    inner = codes.select(F.lit(0).cast("bigint").alias("part"), F.col("rep").alias("id"), "code", F.lit(True).alias("flag"))
    pairs = checkpointed(hamming.near_pairs(inner, bits=bits, most=most, nearest=k).select("a", "b", "d"))
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("rep"), F.col("b").alias("v"), "d"), F.struct(F.col("b").alias("rep"), F.col("a").alias("v"), "d"))).alias("p")).select("p.*")
    near = _first_rows(both, ["rep"], ["d", "v"], k)
    several = codes.filter(F.size("ids") > 1)  # a hash of one row is its representative
    beside = near.join(several.select(F.col("rep").alias("v"), "ids"), "v", "left").groupBy("rep").agg(
        F.flatten(F.collect_list(F.transform(F.slice(F.coalesce("ids", F.array("v")), 1, k), lambda i: F.struct(F.col("d").alias("d"), i.alias("id"))))).alias("others")
    )
    lists = several.select("rep", "ids").join(beside, "rep", "full").withColumn("ids", F.coalesce("ids", F.array("rep")))
    kind = "array<struct<d:int,id:bigint>>"
    own = F.transform("ids", lambda i: F.struct(F.lit(0).alias("d"), i.alias("id"))).cast(kind)
    ranked = F.slice(F.array_sort(F.concat(own, F.coalesce("others", F.array().cast(kind)))), 1, 2 * k + 1)
    listed = lists.select(F.explode("ids").alias("id"), ranked.alias("ranked"))
    nearest = listed.select("id", F.slice(F.transform(F.filter("ranked", lambda x: x["id"] != F.col("id")), lambda x: x["id"]), 1, k).alias("others"))
    # further rows of a hash that k + 1 rows share have the first k of them nearest
    full = small_side(codes.filter(F.size("ids") > k).select("code", "ids"))
    further = rows.join(full, "code").filter(F.col("id") > F.element_at("ids", -1)).select("id", F.slice("ids", 1, k).alias("others"))
    found = nearest.unionByName(further).select("id", F.explode("others").alias("o"))
    return found.select(F.least("id", "o").alias("hash_a"), F.greatest("id", "o").alias("hash_b")).distinct()


def _perturbations(k: int, probes: int) -> list[tuple[int, ...]]:
    """The likeliest sets of shifts, as places in a query's list of its 2k shifts by distance to the border.

    By the expected squares of those distances, taken in ascending order from
    a heap; a set does not shift one projection both ways.
    """
    square = [(j * (j + 1)) / (4 * (k + 1) * (k + 2)) for j in range(1, k + 1)]
    square += [1 - (2 * k + 1 - j) / (k + 1) + (2 * k + 1 - j) * (2 * k + 2 - j) / (4 * (k + 1) * (k + 2)) for j in range(k + 1, 2 * k + 1)]
    heap, out = [(square[0], (0,))], [()]
    while heap and len(out) < probes:
        score, places = heapq.heappop(heap)
        if not any(2 * k - 1 - p in places for p in places):
            out.append(places)
        last = places[-1]
        if last + 1 < 2 * k:
            heapq.heappush(heap, (score - square[last] + square[last + 1], (*places[:-1], last + 1)))
            heapq.heappush(heap, (score + square[last + 1], (*places, last + 1)))
    return out


class PStable:
    """L tables of k Gaussian projections cut into slots of a width: floor((a . v + b) / width)."""

    def __init__(self, size: int, width: float, *, tables: int, projections: int, probes: int, seed: int = 7):
        r = np.random.default_rng(seed)
        self.a = r.normal(size=(tables, projections, size))
        self.b = r.uniform(0, width, (tables, projections))
        self.width, self.tables, self.k = width, tables, projections
        self.sets = _perturbations(projections, probes)
        self.mix = r.integers(1, 2**62, projections, dtype=np.int64) | 1

    def places(self, vectors: np.ndarray, table: int) -> np.ndarray:
        return (vectors @ self.a[table].T + self.b[table]) / self.width

    def keys(self, slots: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (slots.astype(np.int64) * self.mix).sum(-1)
            return x ^ (x >> 29)

    def probe_keys(self, vectors: np.ndarray, table: int) -> np.ndarray:
        """(vectors, probes): the keys of the own bucket and of the perturbed ones, likeliest first."""
        at = self.places(vectors, table)
        slot = np.floor(at).astype(np.int64)
        low = at - slot
        border = np.concatenate([low, 1 - low], 1)  # distance down, then up
        order = np.argsort(border, 1)
        shift = np.where(order < self.k, -1, 1)
        which = order % self.k
        rows = np.arange(len(vectors))
        out = np.empty((len(vectors), len(self.sets)), np.int64)
        for n, places in enumerate(self.sets):
            moved = slot.copy()
            for p in places:
                moved[rows, which[:, p]] += shift[:, p]
            out[:, n] = self.keys(moved)
        return out


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _usable(df: DataFrame, id_col: str, vector_col: str, size: int) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    known = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.filter(F.col(id_col).isNotNull() & (F.size(vector_col) == size) & known).select(F.col(id_col).cast("bigint").alias("id"), v.alias("v"))


def fitted_width(vectors: DataFrame, size: int, k: int, sample: int = 2_000) -> float:
    """A slot width from the distances within a sample of at most sample rows (the rows of least digest): 1.3 times the median distance to the k-th nearest.

    Copies of a vector count as one, so that many of them do not make it 0.
    The width only sets how many candidates are met; every row is indexed.
    """
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    x = np.unique(_matrix(rows["v"].combine_chunks(), size), axis=0)
    if len(x) < 2:
        return 1.0
    squares = (x * x).sum(1)
    apart = np.sqrt(np.maximum(squares[:, None] + squares[None] - 2 * x @ x.T, 0))
    near = np.sort(apart, 1)[:, min(k, len(x) - 1)]
    return max(float(np.median(near)) * 1.3, 1e-9)


def _closest(v: np.ndarray, q: np.ndarray, x: np.ndarray, rows: np.ndarray, k: int) -> list[tuple[np.ndarray, ...]]:
    """(q, id, d) of at least the k nearest of some rows for each query, other than itself."""
    squares, own = (x * x).sum(1), (v * v).sum(1)[:, None]
    same = q[:, None] == rows[None]
    about = np.where(same, np.inf, own + squares[None] - 2 * v @ x.T)
    # rounding of these squares must not decide: what is as near as the k-th but for it is measured
    limit = np.partition(about, min(k, len(x)) - 1, 1)[:, min(k, len(x)) - 1, None] + 1e-9 * (own + squares.max())
    n, m = np.nonzero(~(about > limit) & ~same)
    out = []
    for i, found in enumerate(np.split(m, np.searchsorted(n, np.arange(1, len(q))))):
        d = np.sqrt(((x[found] - v[i]) ** 2).sum(1))
        best = np.lexsort((rows[found], d))[:k]
        out.append((np.full(len(best), q[i]), rows[found][best], d[best]))
    return out


def _nearest_of_block(vectors: DataFrame, ids: np.ndarray, w: np.ndarray, k: int) -> DataFrame:
    """(q, id, d): at least the k nearest rows of each of some queries, by their distances to all rows."""
    size = w.shape[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, rows = _matrix(batch.column(1), size), batch.column(0).to_numpy()
            for at in range(0, len(ids) if len(x) else 0, QUERY_STEP):
                found = _closest(w[at : at + QUERY_STEP], ids[at : at + QUERY_STEP], x, rows, k)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["q", "id", "d"])

    return mapped(vectors, run, "q bigint, id bigint, d double")


def _blocks(queries: DataFrame, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of queries, a block at a time."""
    rows = queries.select("id", "v").toLocalIterator()
    while block := list(islice(rows, QUERY_BLOCK)):
        yield np.array([r["id"] for r in block], np.int64), np.array([r["v"] for r in block], np.float64).reshape(-1, size)


def _nearest_in_buckets(met: DataFrame, size: int, k: int) -> DataFrame:
    """(q, id, d): in each bucket of (t, key, cell, row, id, v), row telling rows from queries, the k nearest rows of each query.

    Queries come first; the rows of a bucket are gone through in blocks, and
    each query keeps its k nearest, so a task holds the queries of a cell.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, queries, best = None, [], {}

        def answer() -> Iterator[pa.RecordBatch]:
            if best:
                q = np.repeat(np.fromiter(best, np.int64), [len(b[0]) for b in best.values()])
                yield pa.RecordBatch.from_arrays([pa.array(q), *(pa.array(np.concatenate([b[c] for b in best.values()])) for c in (0, 1))], names=["q", "id", "d"])

        for whole in batches:
            keys = [whole.column(c).to_numpy() for c in range(4)]
            cuts = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in keys], axis=0), True]) if len(whole) else []
            for a, b in zip(cuts[:-1], cuts[1:]):
                here, ids, x = tuple(c[a] for c in keys[:3]), whole.column(4).to_numpy()[a:b], _matrix(whole.column(5).slice(a, b - a), size)
                if here != place:
                    yield from answer()
                    place, queries, best = here, [], {}
                if not keys[3][a]:
                    queries.append((ids, x))
                    continue
                for q, v in queries:
                    for at in range(0, len(q), QUERY_STEP):
                        for one, near, d in _closest(v[at : at + QUERY_STEP], q[at : at + QUERY_STEP], x, ids, k):
                            if len(one):
                                had = best.get(one[0])
                                if had is not None:
                                    near, d = np.r_[had[0], near], np.r_[had[1], d]
                                    first = np.lexsort((near, d))[:k]
                                    near, d = near[first], d[first]
                                best[one[0]] = near, d
        yield from answer()

    return mapped(met.repartition("t", "key", "cell").sortWithinPartitions("t", "key", "cell", "row"), run, "q bigint, id bigint, d double")


def nearest_vectors(
    df: DataFrame, *, size: int, k: int, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, tables: int = 12, projections: int = 6, probes: int = 60, width: float | None = None
) -> DataFrame:
    """(id_col, neighbour, distance, place): for each row whose id is divisible by every, the k nearest other rows met.

    Multiprobe p-stable hashing: all rows are put into the buckets of some
    tables; a query looks into its own bucket of each and into those whose
    slots it nearly fell in, likeliest first; the rows met in any table are
    ranked by their exact Euclidean distance (ties: smaller id). More tables
    or probes find more. Ranking begins in the bucket, which lets k rows of it
    pass for a query; buckets of many rows or queries are split. Queries that met fewer than k rows are ranked against
    all rows, a block of queries at a time. Vectors that are null, of another size or with
    unknown or infinite numbers are left out.
    """
    vectors = _usable(df, id_col, vector_col, size)
    width = fitted_width(vectors, size, k) if width is None else width
    family = PStable(size, width, tables=tables, projections=projections, probes=probes)

    def placed_in(probing: bool):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, len(whole), QUERY_BLOCK):
                    batch = whole.slice(at, QUERY_BLOCK)
                    x = _matrix(batch.column(1), size)
                    for t in range(tables):
                        keys = family.probe_keys(x, t) if probing else family.keys(np.floor(family.places(x, t)))[:, None]
                        n = keys.shape[1]
                        copies = pa.array(np.repeat(np.arange(len(batch)), n))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(keys.size, t, np.int32)), pa.array(keys.ravel()), *(c.take(copies) for c in batch.columns)], names=["t", "key", "id", "v"])

        return run

    schema = "t int, key bigint, id bigint, v array<double>"
    queries = vectors.filter(F.col("id") % every == 0)
    indexed, asked = mapped(vectors, placed_in(False), schema), mapped(queries, placed_in(True), schema)
    # a bucket without a query is not gone into; one of many rows or queries is split into cells
    wanted = asked.groupBy("t", "key").agg(F.count(F.lit(1)).alias("nq"))
    sizes = indexed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).join(wanted, ["t", "key"])
    cells = checkpointed(sizes.select("t", "key", F.ceil(F.col("n") / CELL_ROWS).cast("int").alias("r"), F.ceil(F.col("nq") / CELL_QUERIES).cast("int").alias("c")))
    piece = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every_cell = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    rows = indexed.join(cells, ["t", "key"]).withColumn("cell", F.explode(F.transform(every_cell("c"), lambda j: piece(F.col("r")) * F.col("c") + j)))
    probing = asked.join(cells, ["t", "key"]).withColumn("cell", F.explode(F.transform(every_cell("r"), lambda i: i * F.col("c") + piece(F.col("c")))))
    both = [x.select("t", "key", "cell", F.lit(kind).alias("row"), "id", "v") for x, kind in ((probing, 0), (rows, 1))]
    ranked = _nearest_in_buckets(both[0].unionByName(both[1]), size, k).dropDuplicates(["q", "id"])
    w = Window.partitionBy("q").orderBy("d", "id")
    placed = lambda rows: rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
    found = checkpointed(placed(ranked))
    full = found.filter(F.col("place") == k).select(F.col("q").alias("id"))
    short = checkpointed(queries.join(full, "id", "left_anti"))
    exact = [_nearest_of_block(vectors, ids, v, k) for ids, v in _blocks(short, size)]
    if exact:
        found = found.join(full.withColumnRenamed("id", "q"), "q", "left_semi").unionByName(placed(reduce(DataFrame.unionByName, exact)))
    return found.select(F.col("q").alias(id_col), F.col("id").alias("neighbour"), F.col("d").alias("distance"), "place")
