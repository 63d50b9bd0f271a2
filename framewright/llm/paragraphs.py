"""Near-duplicate paragraphs by MinHash with bands, exact verification and components.

Paragraphs are compared as sets of runs of words. Equal texts are one node;
different ones meet where a band of their MinHash values is equal, are
compared exactly, and the links make the classes.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.functions.numbers import small_side
from framewright.llm.leakage import gram_hashes, words
from framewright.session import checkpointed, mapped, removed, spread, stored

#: Words of a shingle, and the least share of common shingles of near paragraphs.
SHINGLE, SIMILAR = 5, 0.8
#: Bands and values in each: a pair at 0.8 meets with probability 0.9987, one at 0.9 with 1 - 1e-7.
BANDS, ROWS = 17, 5
#: A bucket of more paragraphs is split into pieces of that size, of which a task compares two.
PIECE = 20_000
#: Paragraphs that a worker remembers to have hashed.
MOST_SEEN = 500_000
#: Sets of shingles that a worker keeps, and handles of paragraphs that are sent to every executor (8 bytes each); more are joined by a shuffle.
MOST_KNOWN, MOST_SENT = 50_000, 500_000

_BLANK = re.compile(r"\n[ \t\r]*\n")


def shingles(tokens: list[str]) -> np.ndarray:
    """The different hashes of each SHINGLE consecutive words, ascending."""
    return np.unique(gram_hashes(tokens, SHINGLE))


def _family(seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def band_keys(found: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The key of each band of a set of shingles; those of different bands differ too."""
    mixed = (found[:, None] ^ family[1]) * family[0]
    mixed ^= mixed >> np.uint64(31)
    low = (mixed * np.uint64(0x9E3779B97F4A7C15)).min(0).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = (key ^ low[:, k]) * np.uint64(0xFF51AFD7ED558CCD)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def _cut(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, no, digest, bands, words) of each paragraph with a shingle; a worker gives the last two once for a text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        family, seen = _family(), set()
        kinds = {"id": pa.int64(), "no": pa.int32(), "digest": pa.binary(), "bands": pa.list_(pa.int64()), "words": pa.binary()}
        for batch in batches:
            out: list[tuple] = []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = value.as_py()
                for no, part in enumerate(_BLANK.split(data.decode("utf-8", "surrogateescape")) if data else ()):
                    tokens = words(part)
                    if len(tokens) < SHINGLE:
                        continue
                    plain = " ".join(tokens).encode("utf-8", "surrogatepass")
                    digest = xxhash.xxh3_128_digest(plain)
                    if digest in seen:
                        out.append((key, no, digest, None, None))
                        continue
                    if len(seen) >= MOST_SEEN:
                        seen.clear()
                    seen.add(digest)
                    out.append((key, no, digest, band_keys(shingles(tokens), family), plain))
                if len(out) > 5_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds.values())], names=list(kinds))
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds.values())], names=list(kinds))

    rows = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("t"))
    return mapped(spread(rows), run, "id bigint, no int, digest binary, bands array<bigint>, words binary")


def linked(sets: list[np.ndarray], similar: float = SIMILAR) -> list[tuple[int, int]]:
    """Pairs of similar sets that connect just what all similar pairs connect.

    All are measured against a leader. What is near it is one class; as one
    minus the similarity is a metric, only what lies within twice the reach of
    the leader can be near those, and is compared with them. Then the rest
    goes on without them.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    every = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    starts = np.cumsum(sizes) - sizes
    reach = 1 - similar

    def apart(leader: int, rest: np.ndarray) -> np.ndarray:
        own = sets[leader]
        places = np.arange(sizes[rest].sum()) - np.repeat(np.cumsum(sizes[rest]) - sizes[rest], sizes[rest]) + np.repeat(starts[rest], sizes[rest])
        x = every[places]
        at = np.minimum(np.searchsorted(own, x), len(own) - 1)
        common = np.bincount(owner[places][own[at] == x], minlength=len(sets))[rest]
        return 1 - common / (sizes[rest] + len(own) - common)

    out, rest = [], np.arange(len(sets))
    while len(rest) > 1:
        leader, rest = int(rest[0]), rest[1:]
        d = apart(leader, rest)
        near = rest[d <= reach + 1e-12]
        ring = rest[(d > reach + 1e-12) & (d <= 2 * reach + 1e-9)]
        out += [(leader, int(x)) for x in near]
        rest = rest[d > reach + 1e-12]
        for x in near:
            if not len(ring):
                break
            hit = apart(int(x), ring) <= reach + 1e-12
            out += [(int(x), int(y)) for y in ring[hit]]
            ring = ring[~hit]  # joined already; it goes on as a leader later
    return out


def _links(rows: DataFrame) -> DataFrame:
    """(a, b): links between the paragraphs of each cell of (key, cell, digest, words)."""
    known: dict[bytes, np.ndarray] = {}  # a text has a place in several bands

    def sets_of(table: pa.Table, digests: list[bytes]) -> list[np.ndarray]:
        if len(known) > MOST_KNOWN:
            known.clear()
        for digest, text in zip(digests, table.column("words").to_pylist()):
            if digest not in known:
                known[digest] = shingles(text.decode("utf-8", "surrogatepass").split(" "))
        return [known[d] for d in digests]

    def compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
        place = [table.column(c).to_numpy() for c in ("key", "cell")]
        cuts = np.flatnonzero(np.r_[True, np.any([p[1:] != p[:-1] for p in place], axis=0), True])
        digests = table.column("digest").to_pylist()
        sets = sets_of(table, digests)
        flat, offsets = np.concatenate(sets), np.r_[0, np.cumsum([len(x) for x in sets])]
        # all groups at once: how far each row is from the first of its group
        members = np.diff(cuts)
        group, sizes = np.repeat(np.arange(len(members)), members), np.diff(offsets)
        first = cuts[:-1][group]
        owner = np.repeat(np.arange(len(group)), sizes)
        marked = flat ^ (group[owner].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        own = np.sort(marked[first[owner] == owner])
        common = np.bincount(owner[own[np.minimum(np.searchsorted(own, marked), len(own) - 1)] == marked], minlength=len(group))
        near = common >= SIMILAR * (sizes + sizes[first] - common) - 1e-9
        pairs = [(int(x), int(y)) for x, y in zip(first, np.arange(len(group))) if x != y and near[y]]
        # one that is not near the first may be near others
        far = np.bincount(group, weights=~near, minlength=len(members))
        again = (far > 0) & (members > 2)
        pairs = [p for p in pairs if not again[group[p[0]]]]
        for g in np.flatnonzero(again).tolist():
            a = int(cuts[g])
            pairs += [(a + i, a + j) for i, j in linked(sets[a : int(cuts[g + 1])])]
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array([digests[p[k]] for p in pairs], pa.binary()) for k in (0, 1)], names=["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if len(batch):
                held.append(batch)
                size += len(batch)
            if size < PIECE:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            last = [table.column(c).to_numpy() for c in ("key", "cell")]
            differs = np.flatnonzero(np.any([p != p[-1] for p in last], axis=0))
            cut = int(differs[-1]) + 1 if len(differs) else 0  # the last cell may go on
            if cut:
                yield from compare(table.slice(0, cut).combine_chunks())
                rest = pa.Table.from_batches(table.slice(cut).to_batches()).combine_chunks()
                held, size = rest.to_batches(), len(rest)
        if held:
            yield from compare(pa.Table.from_batches(held).combine_chunks())

    return mapped(rows.repartition("key", "cell").sortWithinPartitions("key", "cell").select("key", "cell", "digest", "words"), run, "a binary, b binary")


def _crowded(placed: DataFrame) -> DataFrame:
    """The different rows of (key, handle) whose key others have too; sorted and streamed, as nearly all keys have one row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, again = None, False  # the row that waits for the next one, and whether the one before it had its key
        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch] if last is None else [last, batch]).combine_chunks()
            key, handle = table.column("key").to_numpy(), table.column("handle").to_numpy()
            fresh = np.r_[True, (key[1:] != key[:-1]) | (handle[1:] != handle[:-1])]
            table, key = table.filter(pa.array(fresh)).combine_chunks(), key[fresh]
            same = key[1:] == key[:-1]
            hit = np.r_[again, same] | np.r_[same, False]
            last, again = table.slice(len(table) - 1).combine_chunks().to_batches()[0], bool(hit[-1])
            yield from table.slice(0, len(table) - 1).filter(pa.array(hit[:-1])).to_batches()
        if again:
            yield last

    return mapped(placed.repartition("key").sortWithinPartitions("key", "handle").select("key", "handle"), run, "key bigint, handle bigint")


def components(edges: DataFrame) -> DataFrame:
    """(id, root): every end of edges (a, b) with the smallest end that it is connected with.

    Large and small stars by turns, each checkpointed, until nothing changes:
    edges lead to ever smaller ends, in about log(n) turns.
    """

    def starred(stars: DataFrame, to: DataFrame, keep_centre: bool) -> DataFrame:
        out = to.join(stars, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        if keep_centre:
            out = out.unionByName(stars.select("u", F.col("m").alias("v")))
        return out.filter("u <> v").distinct()

    def stamp(rows: DataFrame) -> tuple:
        return tuple(rows.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    now = checkpointed(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while (mark := stamp(now)) != before:
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = checkpointed(starred(least, both.filter("v > u"), False))
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        now = checkpointed(starred(down.groupBy("u").agg(F.min("v").alias("m")), down, True))
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def paragraph_classes(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, paragraph, class_doc, class_paragraph): each paragraph with the first one of its class.

    Paragraphs are parted by blank lines and counted from 0; those of fewer
    than five words are left out, and do not end a class. Two are near if
    they have 0.8 or more of their different five-word runs in common; near
    ones, directly or over others, are a class, of which the first by (id,
    number) stays. Equal texts are always near; of others a pair that is just
    near is missed with probability 0.0013. Null and empty texts have no paragraphs,
    rows without an id are left out, rows of one id count each.
    """
    cut, folder = stored(_cut(df, id_col, text_col))
    handle = F.xxhash64("digest").alias("handle")  # 64 bits of the digest: different texts of one handle, hardly ever any, pass for one only where bands are counted
    new = cut.filter("bands IS NOT NULL")
    crowded = checkpointed(_crowded(new.select(F.explode("bands").alias("key"), handle)))
    counts = crowded.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    met = crowded.join(counts, "key").select("handle", "key", F.ceil(F.col("n") / PIECE).cast("int").alias("pieces"))
    texts = new.select("digest", "words", handle).join(small_side(crowded.select("handle").distinct(), MOST_SENT), "handle", "left_semi").dropDuplicates(["digest"])
    own = F.pmod("handle", F.col("pieces")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), lambda j: F.least(own, j) * F.col("pieces") + F.greatest(own, j))
    links = _links(met.join(texts, "handle").select("key", "digest", "words", F.explode(cells).alias("cell")))
    roots = components(links).withColumnRenamed("id", "digest")
    classed = cut.select("id", "no", "digest").join(roots, "digest", "left").select("id", "no", F.coalesce("root", "digest").alias("root"))
    first = classed.groupBy("root").agg(F.min(F.struct("id", "no")).alias("f"))
    found = checkpointed(classed.join(first, "root").select(F.col("id").alias(id_col), F.col("no").alias("paragraph"), F.col("f.id").alias("class_doc"), F.col("f.no").alias("class_paragraph")))
    removed(df.sparkSession, folder)
    return found
