"""Long exact spans shared between records.

A character is shared if it lies in a window of ``span`` characters that also
occurs verbatim in another record. Every window is assigned to the smallest
gram hash within it, its anchor. Equal windows have equal anchors at the same
place in the window, so only windows of equal anchors can be equal:

1. one scan gives the anchors of each record; those of a single record drop out;
2. the records are joined with their shared anchors and give, for each, the
   text beside the anchor that its windows span;
3. per anchor the windows are compared by content and the shared ones merged.

Paragraph MinHash with bands and similarity checks is not used: it finds
similar paragraphs with high recall, while the result here is every window,
exactly, wherever paragraphs begin.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.session import mapped, spread

#: Characters of a window and of the gram that anchors it.
SPAN, GRAM = 200, 50
#: Characters handled at once; a longer text is cut into overlapping pieces.
PIECE = 1 << 19
#: Anchors in more records than this are compared over the cluster, not within one task.
HOT_RECORDS = 20_000
#: Windows compared at once in a task.
BLOCK_WINDOWS = 500_000

_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def rolling(points: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each n consecutive code points."""
    size = len(points)
    if size < n:
        return np.empty(0, np.uint64)
    up, down = _power_tables(size + 1)
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum(_scramble(points.astype(np.uint64) + np.uint64(1)) * up[:size], out=sums[1:])
    return _scramble((sums[n:] - sums[:-n]) * down[: size - n + 1])


def _window_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each width consecutive values."""
    done = 1
    while done * 2 <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    rest = width - done
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def anchors(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchors of texts laid end to end: (text number, hash, place, first window, last window)."""
    none = (np.empty(0, np.int64),) * 5
    if len(points) < span:
        return none
    grams = rolling(points, gram)
    low = np.uint64((1 << 20) - 1)  # a piece has fewer places than that; the leftmost of equals wins
    packed = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    place = (_window_min(packed, span - gram + 1) & low).astype(np.int64)
    counts = np.maximum(ends - starts - span + 1, 0)
    if not counts.sum():
        return none
    owner = np.repeat(np.arange(len(starts)), counts)
    window = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)
    at = place[window]
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])])
    last = np.r_[new[1:], len(at)] - 1
    return owner[new], grams[at[new]], at[new], window[new], window[last]


def _laid(batch: pa.RecordBatch, span: int) -> Iterator[tuple[list[int], list[int], str, np.ndarray, np.ndarray]]:
    """Texts of a batch in pieces laid end to end: row numbers, offsets in their texts, the text, starts and ends."""
    rows, offsets, parts, sizes, total = [], [], [], [], 0
    for i, value in enumerate(batch.column(1)):
        data = value.as_py()
        text = data.decode("utf-8", "surrogateescape") if data else ""
        if len(text) < span:
            continue
        for start in range(0, len(text) - span + 1, PIECE):
            part = text[start : start + PIECE + span - 1]
            if total and total + len(part) >= 2 * PIECE - span:
                ends = np.cumsum(sizes)
                yield rows, offsets, "".join(parts), ends - sizes, ends
                rows, offsets, parts, sizes, total = [], [], [], [], 0
            rows.append(i)
            offsets.append(start)
            parts.append(part)
            sizes.append(len(part))
            total += len(part)
    if total:
        ends = np.cumsum(sizes)
        yield rows, offsets, "".join(parts), ends - sizes, ends


def _anchor_rows(df: DataFrame, span: int, gram: int) -> DataFrame:
    """(fp, id), each anchor of a record once or, by the cut of long texts, a few times."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for rows, _, text, starts, ends in _laid(batch, span):
                owner, fp, *_ = anchors(points_of(text), starts, ends, span, gram)
                pair = np.unique(np.rec.fromarrays([fp.view(np.int64), ids[np.asarray(rows)[owner]]], names="fp,id")) if len(fp) else None
                if pair is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pair.fp)), pa.array(np.ascontiguousarray(pair.id))], names=["fp", "id"])

    return mapped(spread(df), run, "fp bigint, id bigint")


_BESIDE = "fp bigint, hot boolean, id bigint, first bigint, lead int, n int, beside binary"
_BESIDE_NAMES = ["fp", "hot", "id", "first", "lead", "n", "beside"]
_GROUPED = ["fp", "id", "first", "lead", "n", "beside"]


def _beside_rows(df: DataFrame, span: int, gram: int) -> DataFrame:
    """For each shared anchor of (id, text, fps, hots): the text beside it that its windows span.

    first is the offset of the first of n windows, lead the anchor's place after
    it; the gram itself, equal for equal anchors, is left out of the text.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            wanted, hots = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for rows, offsets, text, starts, ends in _laid(batch, span):
                owner, fp, place, first, last = anchors(points_of(text), starts, ends, span, gram)
                fp, first, last, place = fp.view(np.int64).tolist(), first.tolist(), last.tolist(), place.tolist()
                out: list[list] = [[] for _ in _BESIDE_NAMES]
                cuts = np.searchsorted(owner, np.arange(len(rows) + 1)).tolist()
                for k, row in enumerate(rows):
                    keep = dict(zip(wanted[row], hots[row]))
                    shift = offsets[k] - int(starts[k])
                    for i in range(cuts[k], cuts[k + 1]):
                        if fp[i] in keep:
                            s, p = first[i], place[i]
                            beside = text[s:p] + text[p + gram : last[i] + span]
                            for to, v in zip(out, (fp[i], keep[fp[i]], ids[row], s + shift, p - s, last[i] - s + 1, beside.encode("utf-8", "surrogateescape"))):
                                to.append(v)
                if out[0]:
                    kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)], names=_BESIDE_NAMES)

    return mapped(df, run, _BESIDE)


def _windows(fp: np.ndarray, lead: np.ndarray, beside: list[bytes], span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window of the given anchors: (key by anchor, place and content, row, number in the row)."""
    texts = [b.decode("utf-8", "surrogateescape") for b in beside]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    side = span - gram
    hashes = rolling(points_of("".join(texts)), side)
    counts = sizes - side + 1
    row = np.repeat(np.arange(len(texts)), counts)
    number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    start = np.repeat(np.cumsum(sizes) - sizes, counts) + number
    offset = (lead[row] - number).astype(np.uint64)
    key = hashes[start] ^ _scramble(fp.view(np.uint64)[row] + offset * np.uint64(_BASE))
    return key, row.astype(np.int32), number.astype(np.int32)


def _blocks(fp: np.ndarray, lead: np.ndarray, beside: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(a row of each different anchor, place and text; which of them each row is)."""
    text = beside.combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    order = np.lexsort((text, lead, fp))
    f, le, t = fp[order], lead[order], text[order]
    new = np.r_[True, (f[1:] != f[:-1]) | (le[1:] != le[:-1]) | (t[1:] != t[:-1])]
    block = np.empty(len(fp), np.int64)
    block[order] = np.cumsum(new) - 1
    return order[new], block


def _within_groups(rows: DataFrame, span: int, gram: int) -> DataFrame:
    """(id, a, b) of shared stretches; rows come sorted by fp, all of an fp in one partition.

    Anchors with equal text beside them are one block: of two records, all its
    windows are shared. Windows are compared between different blocks only.
    """

    def compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
        fp, ids, first, lead, n = (table.column(c).to_numpy() for c in ("fp", "id", "first", "lead", "n"))
        of, block = _blocks(fp, lead, table.column("beside"))
        low, high = np.full(len(of), np.iinfo(np.int64).max), np.full(len(of), np.iinfo(np.int64).min)
        np.minimum.at(low, block, ids)
        np.maximum.at(high, block, ids)
        several = low != high
        whole = several[block]
        yield _stretches(ids[whole], first[whole], first[whole] + n[whole] - 1 + span)
        kinds = np.unique(fp[of], return_counts=True)
        mixed = np.flatnonzero(np.isin(fp[of], kinds[0][kinds[1] > 1]))  # blocks whose anchor has others
        if not len(mixed):
            return
        texts = table.column("beside").take(pa.array(of[mixed])).to_pylist()
        parts = []
        at = 0
        while at < len(mixed):  # the hashes of a bounded text at a time
            to, size = at, 0
            while to < len(mixed) and size < BLOCK_WINDOWS:
                size += len(texts[to])
                to += 1
            key, row, number = _windows(fp[of[mixed[at:to]]], lead[of[mixed[at:to]]], texts[at:to], span, gram)
            parts.append((key, row + np.int32(at), number))
            at = to
        key, row, number = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(key, kind="stable")
        sorted_key, owner = key[order], mixed[row[order]]
        new = np.flatnonzero(np.r_[True, sorted_key[1:] != sorted_key[:-1]])
        shared = np.minimum.reduceat(low[owner], new) != np.maximum.reduceat(high[owner], new)
        hit = np.zeros(len(key), bool)
        hit[order] = np.repeat(shared, np.diff(np.r_[new, len(key)]))
        hit &= ~several[mixed[row]]
        row, number = row[hit], number[hit]
        if len(row):
            start = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (number[1:] != number[:-1] + 1)])
            last = np.r_[start[1:], len(row)] - 1
            runs = {}  # of a block of one record, which may have it more than once
            for b, s, e in zip(mixed[row[start]].tolist(), number[start].tolist(), number[last].tolist()):
                runs.setdefault(b, []).append((s, e))
            own = np.flatnonzero(np.isin(block, list(runs)))
            out = [(ids[i], first[i] + s, first[i] + e + span) for i, b in zip(own.tolist(), block[own].tolist()) for s, e in runs[b]]
            yield _stretches(*(np.array(c, np.int64) for c in zip(*out)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for whole in batches:
            for at in range(0, len(whole), 2_000):
                batch = whole.slice(at, 2_000)
                held.append(batch)
                size += batch.column(5).nbytes
                if size < 2 * BLOCK_WINDOWS:
                    continue
                table = pa.Table.from_batches(held)
                fp = table.column("fp").to_numpy()
                cut = int(np.searchsorted(fp, fp[-1]))  # the last anchor may go on
                if cut:
                    yield from compare(table.slice(0, cut))
                    rest = table.slice(cut).combine_chunks()
                    held, size = rest.to_batches(), rest.column("beside").nbytes
        if held:
            yield from compare(pa.Table.from_batches(held))

    return mapped(rows, run, "id bigint, a bigint, b bigint")


def _stretches(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(a), pa.array(b)], names=["id", "a", "b"])


def _over_cluster(rows: DataFrame, span: int, gram: int) -> DataFrame:
    """The same for anchors that very many records have, by joins instead of groups.

    Equal blocks are counted with partial aggregates; only blocks of one
    record, and one of each other, are taken apart to windows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["fp", "lead", "beside", "id", "first", "x", "y"]
        for whole in batches:
            for at in range(0, len(whole), 2_000):
                fp, lead, beside, ids, first, x, y = (whole.column(c).slice(at, 2_000) for c in range(len(names)))
                ids, first, x, y = (v.to_numpy() for v in (ids, first, x, y))
                key, row, number = _windows(fp.to_numpy(), lead.to_numpy(), beside.to_pylist(), span, gram)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (key.view(np.int64), ids[row], first[row] + number, x[row], y[row])], names=["key", "id", "a", "x", "y"])

    marked = rows.withColumn("block", F.xxhash64("lead", "beside"))
    counts = marked.groupBy("fp", "block").agg(F.min("id").alias("x"), F.max("id").alias("y"))
    joined = marked.join(counts, ["fp", "block"]).persist(StorageLevel.MEMORY_AND_DISK)
    whole = joined.filter("x < y").select("id", F.col("first").alias("a"), (F.col("first") + F.col("n") - 1 + span).alias("b"))
    apart = joined.filter("x = y").unionByName(joined.filter("x < y AND id = x").dropDuplicates(["fp", "block"]))
    windows = mapped(apart.select("fp", "lead", "beside", "id", "first", "x", "y"), run, "key bigint, id bigint, a bigint, x bigint, y bigint").persist(StorageLevel.MEMORY_AND_DISK)
    shared = windows.groupBy("key").agg(F.min("x").alias("lo"), F.max("y").alias("hi")).filter("lo < hi").select("key")
    single = windows.filter("x = y").join(shared, "key").select("id", "a", (F.col("a") + span).alias("b"))
    return whole.unionByName(single)


def shared_spans(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, gram: int = GRAM, hot_records: int = HOT_RECORDS) -> DataFrame:
    """(id_col, span_start, span_end): each maximal run of shared characters of each record.

    Offsets count code points from 0, the end is exclusive. Whole texts count,
    however long. Null, empty and shorter texts share nothing, rows without an
    id are left out, and a span that a record only repeats within itself, or
    in a further row of its own id, is not shared. Other columns are ignored.
    """
    docs = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("t")).filter(f"id IS NOT NULL AND length(t) >= {span}")
    found = _anchor_rows(docs, span, gram).persist(StorageLevel.MEMORY_AND_DISK)
    several = found.groupBy("fp").agg(F.min("id").alias("x"), F.max("id").alias("y"), F.count(F.lit(1)).alias("n")).filter("x < y").select("fp", (F.col("n") > hot_records).alias("hot")).persist(StorageLevel.MEMORY_AND_DISK)
    by_record = found.join(several, "fp").groupBy("id").agg(F.collect_list("fp").alias("fps"), F.collect_list("hot").alias("hots"))
    beside = _beside_rows(docs.join(by_record, "id"), span, gram)
    spans = _within_groups(_grouped(beside), span, gram)
    if not several.filter("hot").isEmpty():
        beside = beside.persist(StorageLevel.MEMORY_AND_DISK)
        spans = _within_groups(_grouped(beside), span, gram).unionByName(_over_cluster(beside.filter("hot").select(*_GROUPED), span, gram))
    return merged(spans).select(F.col("id").alias(id_col), F.col("a").alias("span_start"), F.col("b").alias("span_end"))


def _grouped(beside: DataFrame) -> DataFrame:
    return beside.filter("NOT hot").select(*_GROUPED).repartition("fp").sortWithinPartitions("fp")


def merged(spans: DataFrame) -> DataFrame:
    """(id, a, b): stretches that overlap or touch become one. A record's stretches are no more than its text has characters."""
    by = Window.partitionBy("id").orderBy("a", "b")
    so_far = F.max("b").over(by.rowsBetween(Window.unboundedPreceding, -1))
    fresh = spans.select("id", "a", "b", F.when(so_far >= F.col("a"), 0).otherwise(1).alias("new"))
    numbered = fresh.select("id", "a", "b", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    return numbered.groupBy("id", "run").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("run")


def shared_share(df: DataFrame, spans: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, shared_chars, share) of every record; share is null without text."""
    total = spans.groupBy(id_col).agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    chars = F.length(text_col)
    return df.select(id_col, chars.alias("_n")).join(total, id_col, "left").select(
        id_col, F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"), (F.coalesce("shared_chars", F.lit(0)) / F.when(F.col("_n") > 0, F.col("_n"))).alias("share")
    )
