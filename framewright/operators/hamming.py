"""Exact Hamming-distance joins of bit vectors, without comparing all pairs.

The bits are cut into blocks of two halves. If two vectors differ in at most
2 * blocks - 1 bits, some block differs in at most one, so one of its halves is
equal and the other differs in one bit or none. Rows therefore meet on (half,
its bits), their bucket, and are narrowed by the other half before any distance
is computed. Rows of a bucket travel packed, many to a record.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.session import mapped

#: Pairs whose distances are computed at once, and rows gathered before whole buckets are joined.
BLOCK_PAIRS, BLOCK_ROWS = 1_000_000, 200_000
#: Rows cut into segments at once.
CUT_ROWS = 50_000
#: A bucket of more rows is split into pieces of that size; a cell of two pieces is what one task compares.
HEAVY_ROWS = 500_000
#: Candidates of a row, on average over a group, from which the group is narrowed by its other bits first.
DENSE = 256


def threshold_bits(core_size: int, percent: float) -> int:
    """Percent of core_size**2 bits, cut to an integer."""
    if not 0 <= percent <= 100:
        raise ValueError("the threshold is a percentage from 0 to 100")
    return int(core_size**2 * (percent / 100))


def packed(df: DataFrame, id_col: str, hash_col: str, bits: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, code, *keep): arrays of booleans as binary; other lengths, nulls within and null ids are left out."""
    size = -(-bits // 64) * 64

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if (values := batch.column(1).flatten()).null_count:
                whole = ~values.is_null().to_numpy(zero_copy_only=False).reshape(-1, bits).any(1)
                batch = batch.filter(pa.array(whole))
                values = batch.column(1).flatten()
            flat = values.to_numpy(zero_copy_only=False).astype(bool).reshape(-1, bits)
            if size != bits:
                flat = np.pad(flat, ((0, 0), (0, size - bits)))
            codes = np.packbits(flat, axis=1)
            made = pa.FixedSizeBinaryArray.from_buffers(pa.binary(size // 8), len(codes), [None, pa.py_buffer(np.ascontiguousarray(codes))])
            yield pa.RecordBatch.from_arrays([batch.column(0), made.cast(pa.binary()), *batch.columns[2:]], names=["id", "code", *keep])

    good = F.col(id_col).isNotNull() & (F.size(hash_col) == bits)
    types = "".join(f", `{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    rows = df.filter(good).select(F.col(id_col).cast("bigint").alias("id"), F.col(hash_col).alias("h"), *keep)
    return mapped(rows, run, f"id bigint, code binary{types}")


def blocks_for(bits: int, most: int) -> int:
    """The fewest blocks that leave one with at most one differing bit and halves of 16 bits at most."""
    return max(1, -(-bits // 32), min(bits // 2, (most + 2) // 2))


def _layout(bits: int, blocks: int) -> list[tuple[int, int, int, int]]:
    """(first bit, bits) of each half and of the other half of its block."""
    cuts = [round(i * bits / blocks) for i in range(blocks + 1)]
    out = []
    for a, b in zip(cuts, cuts[1:]):
        m = (a + b + 1) // 2
        out += [(a, m - a, m, b - m), (m, b - m, a, m - a)]
    return out


def _field(codes: np.ndarray, first: int, size: int) -> np.ndarray:
    """Bits first to first + size - 1 (16 at most) of codes (rows x bytes) as numbers."""
    if not size:
        return np.zeros(len(codes), np.int64)
    at, n = first // 8, codes.shape[1]
    three = codes[:, at].astype(np.int64) << 16
    for k in (1, 2):
        if at + k < n:
            three |= codes[:, at + k].astype(np.int64) << (16 - 8 * k)
    return three >> (24 - first % 8 - size) & ((1 << size) - 1)


def _bytes(codes: pa.Array) -> np.ndarray:
    """Codes as rows x bytes."""
    return np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(len(codes), -1)


_ROW = [("part", "<i8"), ("id", "<i8"), ("check", "<i4"), ("flag", "u1"), ("side", "u1")]


def _row_type(size: int) -> np.dtype:
    """A row as it travels: side is 0, or 1 and 2 for the two pieces of a cell, of which only pairs across count."""
    return np.dtype([*_ROW, ("code", "u1", (size,))])


def _chunks(rows: np.ndarray, keys: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(key, rows, packed rows) for each key."""
    order = np.argsort(keys, kind="stable")
    rows, keys = rows[order], keys[order]
    cuts = np.r_[np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]), len(keys)]
    data, width = rows.tobytes(), rows.itemsize
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield int(keys[a]), b - a, data[a * width : b * width]


def _size(bits: int) -> int:
    return -(-bits // 64) * 8


#: Schema of segments, as they are stored.
SEGMENT = "bucket bigint, n int, data binary"


def _segment_batch(found: list[tuple]) -> pa.RecordBatch:
    bucket, n, data = zip(*found)
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(n, pa.int32()), pa.array(data, pa.binary())], names=["bucket", "n", "data"])


def segments(rows: DataFrame, *, bits: int, most: int) -> DataFrame:
    """(bucket, n, data): rows (part, id, code, flag) by the position and bits of each half, n of them packed in data. May be stored and added to.

    Where part is a digest, a column check (int) may hold a further one.
    """
    layout, kind = _layout(bits, blocks_for(bits, most)), _row_type(_size(bits))

    def cut(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        raw = _bytes(table.column("code"))
        packed_rows = np.zeros(len(raw), kind)
        packed_rows["part"], packed_rows["id"] = table.column("part").to_numpy(), table.column("id").to_numpy()
        packed_rows["flag"], packed_rows["code"] = table.column("flag").to_numpy(), raw
        packed_rows["check"] = table.column("check").to_numpy()
        for k, (a, na, *_) in enumerate(layout):
            yield _segment_batch(list(_chunks(packed_rows, _field(raw, a, na) | (k << 32))))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if len(batch):
                held.append(batch)
                size += len(batch)
            if size >= CUT_ROWS:
                yield from cut(held)
                held, size = [], 0
        if held:
            yield from cut(held)

    check = F.col("check") if "check" in rows.columns else F.lit(0)
    return mapped(rows.select("part", "id", "code", "flag", check.alias("check")), run, SEGMENT)


def bucket_sizes(rows: DataFrame, *, bits: int, most: int) -> DataFrame:
    """(bucket, n): how many rows (code) have each half, added up within each task first."""
    layout = _layout(bits, blocks_for(bits, most))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(1 << na, np.int64) for _, na, *_ in layout]
        for batch in batches:
            if len(batch):
                raw = _bytes(batch.column(0))
                for (a, na, *_), n in zip(layout, counts):
                    n += np.bincount(_field(raw, a, na), minlength=len(n))
        for k, n in enumerate(counts):
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(used | (k << 32)), pa.array(n[used])], names=["bucket", "n"])

    return mapped(rows.select("code"), run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def heavy_buckets(sizes: DataFrame) -> dict[int, int]:
    """The pieces of each bucket of more than HEAVY_ROWS rows. sizes: (bucket, n), each bucket once or more.

    A row has one bucket for each half, so there are at most halves * rows /
    HEAVY_ROWS of them.
    """
    big = sizes.groupBy("bucket").agg(F.sum("n").alias("n")).filter(F.col("n") > HEAVY_ROWS).toArrow()
    return {b: -(-n // HEAVY_ROWS) for b, n in zip(big["bucket"].to_pylist(), big["n"].to_pylist())}


def _first_match(xor: np.ndarray, layout: list[tuple[int, int, int, int]]) -> np.ndarray:
    """For differing bits (pairs x bytes): the first half in which the pair meets."""
    out = np.full(len(xor), len(layout))
    for k in range(len(layout) - 1, -1, -1):
        a, na, b, nb = layout[k]
        out[(_field(xor, a, na) == 0) & (np.bitwise_count(_field(xor, b, nb)) <= 1)] = k
    return out


def _expanded(left: np.ndarray, low: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of each left with low .. low + counts - 1, about BLOCK_PAIRS at a time."""
    some = counts > 0
    left, low, counts = left[some], low[some], counts[some]
    ends = np.cumsum(counts)
    at = 0
    while at < len(left):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK_PAIRS, "right")))
        n = counts[at:to]
        yield np.repeat(left[at:to], n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[at:to], n)
        at = to


def _met(keys: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places whose keys are equal or differ in one of the lowest width bits, each pair once."""
    if (keys[1:] < keys[:-1]).any():
        order = np.argsort(keys, kind="stable")
        for i, j in _met(keys[order], width):
            yield order[i], order[j]
        return
    k = keys
    start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    count = np.diff(np.r_[start, len(k)])
    run = np.repeat(np.arange(len(start)), count)
    own = np.arange(len(k))
    yield from _expanded(own, own + 1, (start + count)[run] - own - 1)
    distinct = k[start]
    for bit in range(width):
        clear = np.flatnonzero(distinct >> bit & 1 == 0)
        wanted = distinct[clear] | 1 << bit
        at = np.minimum(np.searchsorted(distinct, wanted), len(distinct) - 1)
        hit = distinct[at] == wanted
        partner = np.full(len(distinct), -1)
        partner[clear[hit]] = at[hit]
        left = np.flatnonzero(partner[run] >= 0)
        other = partner[run[left]]
        yield from _expanded(left, start[other], count[other])


def _narrowed(raw: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that may differ in at most most bits, by blocks of the bits that vary most among these rows; some more than once."""
    bits = np.unpackbits(raw, axis=1)
    ones = bits.mean(0)
    vary = np.flatnonzero((ones > 0) & (ones < 1))
    vary = vary[np.argsort(np.abs(ones[vary] - 0.5), kind="stable")]
    blocks = (most + 2) // 2
    if len(vary) < 2 * blocks:
        yield from _met(np.zeros(len(raw), np.int64), 0)
        return
    for b in range(blocks):
        own = vary[b::blocks][:40]  # fewer bits only let more pairs through
        yield from _met(bits[:, own].astype(np.int64) @ (1 << np.arange(len(own), dtype=np.int64)), len(own))


def near_pairs(rows: DataFrame, *, bits: int, most: int, nearest: int | None = None) -> DataFrame:
    """(part, a, b, d) with a < b: all pairs of a part that differ in at most most bits, once each.

    rows: (part bigint, id bigint, code binary, flag boolean), see pairs_of.
    They are gone over twice, once to count their buckets.
    """
    heavy = heavy_buckets(bucket_sizes(rows, bits=bits, most=most))
    return pairs_of(segments(rows, bits=bits, most=most), heavy, bits=bits, most=most, nearest=nearest)


def _celled(met: DataFrame, heavy: dict[int, int], bits: int) -> DataFrame:
    """Segments with the cell each is compared in; rows of a heavy bucket go to a cell for each other piece of it."""
    kind = _row_type(_size(bits))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for bucket, n, data in zip(*(c.to_pylist() for c in batch.columns)):
                pieces = heavy.get(bucket, 1)
                rows = np.frombuffer(data, kind).copy()
                piece = (rows["id"].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % pieces
                for i in np.unique(piece).tolist():
                    own = rows[piece == i]
                    for j in range(pieces):
                        own["side"] = 0 if i == j else 1 if i < j else 2
                        out.append((bucket, min(i, j) * pieces + max(i, j), len(own), own.tobytes()))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["bucket", "cell", "n", "data"])

    schema = "bucket bigint, cell bigint, n int, data binary"
    split = F.col("bucket").isin(list(heavy))
    return met.filter(~split).select("bucket", F.lit(0).cast("bigint").alias("cell"), "n", "data").unionByName(mapped(met.filter(split).select("bucket", "n", "data"), run, schema))


def pairs_of(met: DataFrame, heavy: dict[int, int], *, bits: int, most: int, nearest: int | None = None) -> DataFrame:
    """Near pairs of segments, by (part, a, b, d). heavy: see heavy_buckets.

    Codes should be distinct within a part (collapse copies first: they would
    all meet). Pairs of two rows without the flag are left out. With nearest, a task gives of every
    row's pairs only those to the nearest others by (d, id); whatever is among
    a row's nearest over all is among them in the one task that gives it.
    Buckets are streamed from a sort. A bucket that many rows have is split
    into pieces and its pairs of pieces are spread over tasks, so a task holds
    2 * HEAVY_ROWS rows at most. Within a task, rows that are too much alike
    in a block are narrowed by the other bits in which they differ.
    """
    if most >= bits:
        raise ValueError("the threshold takes in all pairs")
    layout, kind = _layout(bits, blocks_for(bits, most)), _row_type(_size(bits))
    width = max(nb for *_, nb in layout)

    def near(rows: np.ndarray, words: np.ndarray, half: np.ndarray, pairs: Iterable) -> Iterator[tuple[np.ndarray, ...]]:
        flag, side, check = rows["flag"], rows["side"], rows["check"]
        mixed, all_count = bool(side.any()), bool(flag.all())
        for i, j in pairs:
            if not all_count or mixed:
                good = flag[i] | flag[j] > 0
                if mixed:
                    good &= (side[i] + side[j]) % 3 == 0
                i, j = i[good], j[good]
            d = np.bitwise_count(words[i] ^ words[j]).sum(1, dtype=np.int64)
            close = d <= most
            i, j, d = i[close], j[close], d[close]
            close = check[i] == check[j]
            i, j, d = i[close], j[close], d[close]
            if len(i):
                keep = _first_match((words[i] ^ words[j]).view(np.uint8), layout) == half[i]
                yield i[keep], j[keep], d[keep]

    def compare(buckets: np.ndarray, cells: np.ndarray, counts: np.ndarray, data: list[bytes]) -> Iterator[pa.RecordBatch]:
        rows = np.frombuffer(b"".join(data), kind)
        number = np.cumsum(np.r_[0, (buckets[1:] != buckets[:-1]) | (cells[1:] != cells[:-1])])
        half, bucket = np.repeat(buckets >> 32, counts), np.repeat(number, counts)
        cuts = np.flatnonzero(np.r_[True, half[1:] != half[:-1], True])  # buckets come in order, so halves do
        other = np.concatenate([_field(rows["code"][a:b], *layout[half[a]][2:]) for a, b in zip(cuts[:-1], cuts[1:])])
        order = np.lexsort((other, rows["part"], bucket))  # by group, then the other half
        rows, half, other, bucket = (x[order] for x in (rows, half, other, bucket))
        code = np.ascontiguousarray(rows["code"])
        words = code.view(np.uint64)
        part = rows["part"]
        first = np.r_[True, (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])]
        group = np.cumsum(first) - 1
        starts = np.flatnonzero(first)
        sizes = np.diff(np.r_[starts, len(rows)])
        alike = np.flatnonzero(np.r_[True, first[1:] | (other[1:] != other[:-1])])
        alone = np.diff(np.r_[alike, len(rows)])
        crowd = np.bincount(group[alike], weights=alone.astype(float) * alone / 2, minlength=len(sizes))
        dense = crowd > DENSE * sizes
        found = []
        plain = np.flatnonzero(~dense[group])
        if len(plain):
            met_here = _met(group[plain] << width | other[plain], width)
            found += near(rows, words, half, met_here if len(plain) == len(rows) else ((plain[i], plain[j]) for i, j in met_here))
        for g in np.flatnonzero(dense).tolist():
            here = np.arange(starts[g], starts[g] + sizes[g])
            some = list(near(rows, words, half, ((here[i], here[j]) for i, j in _narrowed(code[here], most))))
            if some:
                i, j, d = (np.concatenate(x) for x in zip(*some))
                _, once = np.unique(np.minimum(i, j) * len(rows) + np.maximum(i, j), return_index=True)
                found.append((i[once], j[once], d[once]))
        if not found:
            return
        i, j, d = (np.concatenate(x) for x in zip(*found))
        ids = rows["id"]
        if nearest is not None and len(i):
            pair = np.arange(len(i))
            u, v, dd, pair = np.r_[i, j], np.r_[j, i], np.r_[d, d], np.r_[pair, pair]
            # a row has a place in each of its buckets, of which this task may hold several
            order = np.lexsort((ids[v], dd, ids[u], part[u]))
            u = u[order]
            start = np.flatnonzero(np.r_[True, (ids[u[1:]] != ids[u[:-1]]) | (part[u[1:]] != part[u[:-1]])])
            rank = np.arange(len(u)) - np.repeat(start, np.diff(np.r_[start, len(u)]))
            kept = np.unique(pair[order[rank < nearest]])
            i, j, d = i[kept], j[kept], d[kept]
        x, y = ids[i], ids[j]
        yield pa.RecordBatch.from_arrays([pa.array(part[i]), pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(d.astype(np.int32))], names=["part", "a", "b", "d"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def taken(table: pa.Table) -> tuple:
            return *(table.column(c).to_numpy() for c in ("bucket", "cell", "n")), table.column("data").to_pylist()

        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                held.append(batch)
                size += int(batch.column(2).to_numpy().sum())
                if size < BLOCK_ROWS:
                    continue
                table = pa.Table.from_batches(held)
                bucket, cell = table.column("bucket").to_numpy(), table.column("cell").to_numpy()
                differs = np.flatnonzero((bucket != bucket[-1]) | (cell != cell[-1]))
                cut = int(differs[-1]) + 1 if len(differs) else 0  # the last bucket may go on
                if cut:
                    yield from compare(*taken(table.slice(0, cut)))
                    rest = table.slice(cut).combine_chunks()
                    held, size = rest.to_batches(), int(rest.column("n").to_numpy().sum())
        if held:
            yield from compare(*taken(pa.Table.from_batches(held)))

    celled = _celled(met, heavy, bits) if heavy else met.select("bucket", F.lit(0).cast("bigint").alias("cell"), "n", "data")
    return mapped(celled.repartition("bucket", "cell").sortWithinPartitions("bucket", "cell"), run, "part bigint, a bigint, b bigint, d int")
