"""Order-dependent elimination over a graph of near pairs.

An item is dropped if an earlier item that was kept is near. This is not the
closure of nearness: of a chain a-b-c with a, c apart, a and c stay.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.session import checkpointed, mapped

#: Rounds after which what they dropped is put together, so that the plan stays short.
FOLD = 16


def settled(lo: np.ndarray, hi: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(items, whether dropped) of the his that these edges decide; free: whether an edge's lo is kept for certain.

    A hi is dropped as soon as one of its los is kept, and kept once all are
    dropped. One that hangs on a lo decided elsewhere stays open.
    """
    names, place = np.unique(np.concatenate([lo, hi]), return_inverse=True)
    low, high = place[: len(lo)], place[len(lo) :]
    order = np.argsort(low, kind="stable")
    ends = np.searchsorted(low[order], np.arange(len(names) + 1)).tolist()
    later = high[order].tolist()
    waiting = np.bincount(high, minlength=len(names)).tolist()
    status = [-1] * len(names)
    ready = np.unique(low[free]).tolist()
    for x in ready:
        status[x] = 0
    while ready:
        x = ready.pop()
        for y in later[ends[x] : ends[x + 1]]:
            if status[y] < 0:
                if status[x] == 0:
                    status[y] = 1
                    ready.append(y)
                else:
                    waiting[y] -= 1
                    if not waiting[y]:
                        status[y] = 0
                        ready.append(y)
    own = np.unique(high)
    state = np.array(status, np.int8)[own]
    return names[own[state >= 0]], state[state >= 0] == 1


def _round(left: DataFrame, partitions: int | None) -> DataFrame:
    """(id, gone) of the items that one round decides: edges with their neighbours in the order, each task as far as it gets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if held:
            table = pa.Table.from_batches(held)
            ids, gone = settled(*(table.column(c).to_numpy() for c in ("lo", "hi", "free")))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(gone)], names=["id", "gone"])

    later = left.select(F.col("hi").alias("lo"), F.lit(False).alias("_free")).distinct()
    flagged = left.join(later, "lo", "left").select("lo", "hi", F.coalesce("_free", F.lit(True)).alias("free"))
    near = flagged.repartitionByRange("hi") if partitions is None else flagged.repartitionByRange(partitions, "hi")
    return mapped(near, run, "id bigint, gone boolean")


def dropped(edges: DataFrame, partitions: int | None = None) -> DataFrame:
    """(id): items dropped by the elimination. edges: (lo, hi), lo being earlier in the order, without cycles.

    Goes in rounds, whatever the size. Edges are cut into ranges of their
    later item (partitions of them, else as the session has it); each task
    decides what follows from its own edges and from the items without an
    earlier neighbour left, and the next round goes on with the rest. A round
    decides at least all that is next to such items, so it ends. What a round
    decided and what it leaves are checkpointed, so a lost executor costs that
    round only. Items in no edge are kept.
    """
    left, gone, parts = checkpointed(edges.select("lo", "hi").distinct()), None, 0
    while gone is None or not left.isEmpty():
        decided = checkpointed(_round(left, partitions))
        out = decided.filter("gone").select("id")
        left = checkpointed(left.join(decided.select(F.col("id").alias("hi")), "hi", "left_anti").join(out.withColumnRenamed("id", "lo"), "lo", "left_anti").select("lo", "hi"))
        gone = out if gone is None else gone.unionByName(out)
        parts += 1
        if parts % FOLD == 0:
            gone = checkpointed(gone)
    return gone
