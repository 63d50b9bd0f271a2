"""Evaluation texts that leaked into a training corpus, found by winnowing.

Both sides are reduced to fingerprints: the smallest k-gram hash of every
window of consecutive k-grams. Two texts that share a run of window + k - 1
words share a fingerprint there, whatever stands around it, so joining the
fingerprints misses no such run; each hit is then extended over the words
themselves.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.session import mapped, spread

#: Words of a k-gram, and consecutive words that make a leak.
K, RUN = 6, 12
#: Words of 64 bits (a power of two) of the filter of test fingerprints that goes to every executor: 16 MB, however many tests there are.
FILTER_WORDS = 1 << 21
#: Words of one text handled at a time, and distinct words remembered per worker.
PIECE_WORDS, MOST_WORDS = 200_000, 500_000

_SALTS = np.array([0x9E3779B97F4A7C15 * (i + 1) % 2**64 for i in range(64)], np.uint64)
_hashes: dict[str, int] = {}
_split = None


def words(text: str) -> list[str]:
    """Maximal runs of Unicode letters and numbers of the lower-cased text."""
    global _split
    if _split is None:
        import regex

        _split = regex.compile(r"[\p{L}\p{N}]+")
    return _split.findall(text.lower())


def _word_hashes(tokens: list[str]) -> np.ndarray:
    import xxhash

    if len(_hashes) > MOST_WORDS:
        _hashes.clear()
    known = _hashes
    for w in set(tokens).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
    return np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))


def gram_hashes(tokens: list[str], k: int) -> np.ndarray:
    """A hash of each k consecutive words."""
    h = _word_hashes(tokens)
    n = len(h) - k + 1
    grams = np.zeros(max(n, 0), np.uint64)
    for i in range(k if n > 0 else 0):
        grams = (grams ^ (h[i : i + n] + _SALTS[i % len(_SALTS)])) * np.uint64(0xFF51AFD7ED558CCD)
        grams ^= grams >> np.uint64(29)
    return grams


def fingerprints(tokens: list[str], k: int = K, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) that winnowing selects of a word list; none if it is shorter than run."""
    if len(tokens) < run:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    grams = gram_hashes(tokens, k)
    view = np.lib.stride_tricks.sliding_window_view(grams, run - k + 1)
    at = np.unique(view.argmin(axis=1) + np.arange(len(view)))
    return grams[at], at


def _pieces(tokens: list[str], run: int) -> Iterator[tuple[int, list[str]]]:
    """Pieces of a long word list; each run of words lies whole in one of them."""
    for start in range(0, max(1, len(tokens) - run + 1), PIECE_WORDS):
        yield start, tokens[start : start + PIECE_WORDS + run - 1]


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        data = text.as_py()
        if key is not None and data:
            yield key, words(data.decode("utf-8", "surrogateescape"))


def _scan(df: DataFrame, id_col: str, text_col: str, k: int, run: int, wanted=None) -> DataFrame:
    """(id, fp, left, right) of every fingerprint, or of those that the broadcast filter wanted lets pass.

    left and right are the words around the k-gram that a run can take in, the
    nearest first, without the k-gram's own in left and with them in right.
    """

    def go(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = None if wanted is None else wanted.value
        for batch in batches:
            ids, fps, left, right = [], [], [], []
            for key, tokens in _texts(batch):
                for start, piece in _pieces(tokens, run):
                    hashes, at = fingerprints(piece, k, run)
                    if keep is not None and len(hashes):
                        slot = hashes >> np.uint64(6) & np.uint64(len(keep) - 1)
                        hit = (keep[slot] >> (hashes & np.uint64(63)) & np.uint64(1)).astype(bool)
                        hashes, at = hashes[hit], at[hit]
                    ids += [key] * len(at)
                    fps.append(hashes)
                    for p in (at + start).tolist():
                        left.append(tokens[max(0, p - (run - k)) : p][::-1])
                        right.append(tokens[p : p + run])
                if len(ids) > 50_000:
                    yield _found(ids, fps, left, right)
                    ids, fps, left, right = [], [], [], []
            if ids:
                yield _found(ids, fps, left, right)

    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("t"))
    return mapped(spread(rows), go, "id bigint, fp bigint, left array<string>, right array<string>")


def _found(ids: list, fps: list, left: list, right: list) -> pa.RecordBatch:
    kind = pa.list_(pa.string())
    columns = [pa.array(ids, pa.int64()), pa.array(np.concatenate(fps).view(np.int64)), pa.array(left, kind), pa.array(right, kind)]
    return pa.RecordBatch.from_arrays(columns, names=["id", "fp", "left", "right"])


def _filter(prints: DataFrame, words_of: int) -> np.ndarray:
    """A bit set for each fingerprint, words_of words; put together before it comes to the driver."""
    place = F.shiftrightunsigned("fp", 6).bitwiseAND(F.lit(words_of - 1))
    bit = F.expr("shiftleft(1L, CAST(fp & 63 AS INT))")
    rows = prints.groupBy(place.alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(words_of, np.uint64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def _common(a: str, b: str):
    """Length of the common beginning of two arrays of words."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(differs > 0, differs - 1).otherwise(F.least(F.size(a), F.size(b)))


def _pairs_nearby(corpus: DataFrame, tests: DataFrame, run: int) -> DataFrame:
    """Hits joined on the fingerprint and extended to both sides over their own words."""
    t = tests.select(F.col("id").alias("item"), "fp", F.col("left").alias("tl"), F.col("right").alias("tr"))
    c = corpus.select(F.col("id").alias("doc"), "fp", "left", "right")
    length = _common("left", "tl") + _common("right", "tr")
    return c.join(t, "fp").filter(length >= run).select("doc", "item").distinct()


def leaked(
    corpus: DataFrame,
    tests: DataFrame,
    *,
    corpus_id: str = "doc_id",
    test_id: str = "item_id",
    text_col: str = "text",
    k: int = K,
    run: int = RUN,
    filter_words: int = FILTER_WORDS,
) -> DataFrame:
    """(corpus_id, test_id): each document with each test item of which it holds run consecutive words.

    A filter of the test fingerprints, of a fixed size, goes to the executors,
    where one scan of the corpus lets its hits pass with the words beside
    them; they are joined with the fingerprints and extended. More tests than
    the filter was made for let more hits pass that the join then drops. Texts that are null, empty or
    shorter than run words hold nothing; rows without an id are left out;
    repeated rows give one pair. Other columns are ignored.
    """
    spark = corpus.sparkSession
    prints = _scan(tests, test_id, text_col, k, run).distinct()
    wanted = spark.sparkContext.broadcast(_filter(prints.select("fp"), filter_words))
    found = _pairs_nearby(_scan(corpus, corpus_id, text_col, k, run, wanted), prints, run)
    return found.select(F.col("doc").alias(corpus_id), F.col("item").alias(test_id))
