"""Checking new batches against everything accepted before.

A segment index for a bounded edit distance: every vector is cut into a fixed
number of segments, stored by length and position. With one segment more than
half the bits allowed to differ, two vectors that close agree on a segment but
for one bit of its neighbour, so probing the same positions finds them all.
Bits only change in place, so the edit distance is the Hamming distance and a
probe looks at its own position alone.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators import greedy, hamming
from framewright.session import checkpointed, removed, shared_folder

#: Ranges of segments that a scan of the index is told to read; nearer ones are joined.
MOST_RANGES = 128

_PLACES = "array<struct<batch:int,id:bigint>>"
_RUN = "run int, bits int, most int"


def _rows(df: DataFrame, bits: int, id_col: str, hash_col: str, cache_col: str, batch_col: str) -> DataFrame:
    """(id, code, cache, batch) of the usable rows; a null cache is the empty text, others begin with ``=``."""
    cache = F.coalesce(F.concat(F.lit("="), F.col(cache_col).cast("string")), F.lit(""))
    named = df.filter(F.col(batch_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(hash_col).alias("h"), cache.alias("cache"), F.col(batch_col).cast("int").alias("batch"))
    return hamming.packed(named, "id", "h", bits, ("cache", "batch"))


def _nodes(rows: DataFrame) -> DataFrame:
    """Copies within a cache as one node: old is its smallest id of batch 0, new its first row of a later batch."""
    old = F.col("batch") == 0
    return (
        rows.groupBy("cache", "code")
        .agg(F.min(F.when(old, F.col("id"))).alias("old"), F.min(F.when(~old, F.struct("batch", "id"))).alias("new"))
        .select(F.xxhash64("cache").alias("part"), F.hash("cache").alias("check"), "cache", "code", "old", "new", F.coalesce("old", "new.id").alias("id"))
    )


def _flagged(nodes: DataFrame) -> DataFrame:
    return nodes.select("part", "check", "id", "code", F.col("new").isNotNull().alias("flag"))


def _resolved(rows: DataFrame, nodes: DataFrame, near: DataFrame) -> DataFrame:
    """(kept_id, dup_id) of the rows of later batches, given their nodes and the near pairs of these with each other and with accepted rows."""
    ends = [nodes.select(F.col("id").alias(s), F.struct("old", "new").alias(f"node_{s}")) for s in ("a", "b")]
    accepted = [F.struct(F.col(s).alias("old"), F.lit(None).cast("struct<batch:int,id:bigint>").alias("new")) for s in ("a", "b")]
    pairs = near.join(ends[0], "a", "left").join(ends[1], "b", "left")
    pairs = checkpointed(pairs.select("a", "b", *[F.coalesce(f"node_{s}", node).alias(f"node_{s}") for s, node in zip("ab", accepted)]))

    def link(x: str, y: str):
        return F.struct(F.col(x).alias("id"), F.col(f"node_{x}").alias("node"), F.col(y).alias("other"), F.col(f"node_{y}").alias("peer"))

    links = pairs.select(F.explode(F.array(link("a", "b"), link("b", "a"))).alias("l")).select("l.*").filter("node.new IS NOT NULL")
    beaten = links.filter("node.old IS NULL AND peer.old IS NOT NULL").select("id").distinct()
    open_links = links.filter("node.old IS NULL AND peer.old IS NULL AND peer.new < node.new").select(F.col("other").alias("lo"), F.col("id").alias("hi"))
    edges = open_links.join(beaten.withColumnRenamed("id", "lo"), "lo", "left_anti").join(beaten.withColumnRenamed("id", "hi"), "hi", "left_anti")
    rejected = beaten.unionByName(greedy.dropped(edges))
    first = nodes.filter("old IS NULL").join(rejected, "id", "left_anti").select("id", "new")  # accepted rows of new batches
    # what a node's rows can repeat: of history the smallest id, of new batches each accepted row with its place in the order
    by_history = links.groupBy("id").agg(F.min("peer.old").alias("old_near"))
    by_new = links.join(first.select(F.col("id").alias("other"), F.col("new").alias("acc")), "other").groupBy("id").agg(F.collect_list("acc").alias("new_near"))
    none = F.array().cast(_PLACES)
    targets = (
        nodes.filter("new IS NOT NULL")
        .join(by_history, "id", "left")
        .join(by_new, "id", "left")
        .join(first.select("id", F.col("new").alias("own")), "id", "left")
        .select("cache", "code", F.least("old", "old_near").alias("history"), F.concat(F.coalesce("new_near", none), F.when(F.col("own").isNull(), none).otherwise(F.array("own"))).alias("accepted"))
    )
    found = rows.filter("batch <> 0").join(targets, ["cache", "code"])
    earlier = F.array_min(F.transform(F.filter("accepted", lambda x: x < F.struct("batch", "id")), lambda x: x["id"]))
    return found.select(F.least("history", earlier).alias("kept_id"), F.col("id").alias("dup_id")).filter("kept_id IS NOT NULL")


def _ranges(places: np.ndarray, most: int = MOST_RANGES) -> list[tuple[int, int]]:
    """Ascending numbers as ranges (first, last), most at most: what lies nearest is joined."""
    if not len(places):
        return []
    gaps = np.diff(places)
    cuts = np.sort(np.argsort(-gaps, kind="stable")[: most - 1])
    cuts = cuts[gaps[cuts] > 1]
    return list(zip(places[np.r_[0, cuts + 1]].tolist(), places[np.r_[cuts, len(places) - 1]].tolist()))


class SegmentIndex:
    """The accepted vectors, cut to segments, in a folder that all executors share.

    A run reads the segments that its vectors can meet and adds its own
    accepted ones; history is neither cut again nor compared with itself. The
    stored segments are sorted, and their scan is given the ranges wanted, so
    it passes over the others. A run counts once its record is written, last
    of all; adding a run again replaces it, so a failed one may be repeated.
    Runs are added in ascending order. Everything goes through Spark's
    readers and writers, so any file system will do.
    """

    def __init__(self, spark: SparkSession, folder: str, *, bits: int, most: int):
        self.spark, self.folder, self.bits, self.most = spark, folder, bits, most
        try:
            runs = spark.read.schema(_RUN).parquet(f"{folder}/runs/*").collect()  # one row a run
        except AnalysisException:  # nothing was added yet
            runs = []
        if any((r["bits"], r["most"]) != (bits, most) for r in runs):
            raise ValueError(f"{folder} was made for other bits or another threshold")
        self.runs = {r["run"] for r in runs}

    def segments(self, run: int, buckets: np.ndarray) -> DataFrame:
        """The stored segments of runs before run that lie in some buckets (ascending)."""
        done = [f"{self.folder}/segments/{n}" for n in sorted(self.runs) if n < run]
        stored = self.spark.read.schema(hamming.SEGMENT).parquet(*done) if done else self.spark.createDataFrame([], hamming.SEGMENT)
        wanted = [F.col("bucket").between(a, b) for a, b in _ranges(buckets)]
        exact = self.spark.createDataFrame(pa.table({"bucket": buckets}), "bucket bigint")  # halves * 2 ** bits of a half at most
        return stored.filter(reduce(lambda x, y: x | y, wanted, F.lit(False))).join(F.broadcast(exact), "bucket", "left_semi").select("bucket", "n", "data")

    def _append(self, nodes: DataFrame, run: int) -> None:
        if run in self.runs:  # it is replaced, and counts for nothing until it is whole
            removed(self.spark, f"{self.folder}/runs/{run}")
            self.runs.remove(run)
        cut = hamming.segments(_flagged(nodes).withColumn("flag", F.lit(False)), bits=self.bits, most=self.most)
        cut.repartition("bucket").sortWithinPartitions("bucket").write.mode("overwrite").option("compression", "zstd").parquet(f"{self.folder}/segments/{run}")
        self.spark.createDataFrame([(run, self.bits, self.most)], _RUN).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/runs/{run}")
        self.runs.add(run)

    def add(self, df: DataFrame, run: int, *, id_col: str = "hash_id", hash_col: str = "hash", cache_col: str = "cache_name", batch_col: str | None = None, keep: bool = True) -> DataFrame:
        """(kept_id, dup_id) of the rejected rows of one run; its accepted rows join the index, unless it is only to be looked up.

        A run has one batch, of its own number, or those of batch_col. Run 0
        is history and accepted whole. Caches are told apart by 96 bits of
        digests, so that the index need not hold their names.
        """
        named = df if batch_col else df.withColumn("_batch", F.lit(run))
        rows = _rows(named, self.bits, id_col, hash_col, cache_col, batch_col or "_batch")
        if run == 0:
            self._append(_nodes(rows), run)
            return self.spark.createDataFrame([], "kept_id bigint, dup_id bigint")
        fresh = checkpointed(_nodes(rows))
        shape = {"bits": self.bits, "most": self.most}
        sizes = hamming.bucket_sizes(fresh, **shape).toArrow()
        met = self.segments(run, np.sort(sizes["bucket"].to_numpy()))
        heavy = hamming.heavy_buckets(met.select("bucket", F.col("n").cast("bigint").alias("n")).unionByName(self.spark.createDataFrame(sizes, "bucket bigint, n bigint")))
        near = hamming.pairs_of(hamming.segments(_flagged(fresh), **shape).unionByName(met), heavy, **shape)
        found = checkpointed(_resolved(rows, fresh, near))
        if keep:
            self._append(_nodes(rows.join(found.select(F.col("dup_id").alias("id")), "id", "left_anti")), run)
        return found


def repeats(
    df: DataFrame, *, bits: int, most: int, id_col: str = "hash_id", hash_col: str = "hash", cache_col: str = "cache_name", batch_col: str = "batch_no"
) -> DataFrame:
    """(kept_id, dup_id): each rejected row with the smallest accepted id it repeats.

    All of batch 0 is accepted. Then rows go by (batch, id); a row is rejected
    if an accepted row of its cache differs in at most most bits. A null cache
    is a cache of its own. Rows with a null or differently long hash, a null
    within it, a null id or a null batch are left out.

    An index is made of batch 0 in the shared folder; the later batches, as
    one run, are looked up in it and in each other. It is taken away at the
    end; a SegmentIndex of one's own stays for the next run.
    """
    folder = f"{shared_folder(df.sparkSession)}/segment-index-{uuid.uuid4().hex}"
    index = SegmentIndex(df.sparkSession, folder, bits=bits, most=most)
    names = {"id_col": id_col, "hash_col": hash_col, "cache_col": cache_col, "batch_col": batch_col}
    try:
        index.add(df.filter(F.col(batch_col) == 0), 0, **names)
        return index.add(df.filter(F.col(batch_col) != 0), 1, **names, keep=False)
    finally:
        removed(df.sparkSession, folder)
