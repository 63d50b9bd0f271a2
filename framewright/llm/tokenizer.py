"""Encoding a corpus with a public byte-level BPE vocabulary.

The merges are compiled into a finite-state transducer that is determinised
lazily: a state is what the encoding of the bytes read so far can still depend
on, and a transition gives the next state and the tokens that are certain by
then. Two facts carry it. A token sequence is the encoding of its bytes if and
only if each adjacent pair is the encoding of the pair's bytes, so the encoding
of a prefix ends in the one suffix token that goes with the encoding before
it. And only positions from which some vocabulary token can still run up to
the present matter, so the lookahead is bounded by the longest token.
"""

from __future__ import annotations

import base64
import codecs
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.session import mapped, spread

#: Where the vocabularies lie, unless a caller says otherwise.
BYTE_BPE_50K = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published split pattern of that vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Kept per worker; beyond that the tables are emptied and filled anew.
MOST_STATES, MOST_WORDS = 100_000, 400_000
#: Bytes that may be read without making states.
SHORT = 64
#: Code points put into one output batch, texts being whole.
BATCH_CHARS = 2_000_000

_START = -1
_NEVER = 1 << 60
_BYTE = [bytes((b,)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, from a file of base64 token and rank lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    """Bytes to token ids, one byte at a time, tokens leaving as soon as they are certain."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.size_of = {i: len(t) for t, i in ranks.items()}
        self.prefixes = {t[:n] for t in ranks for n in range(1, len(t) + 1)}
        self.usable: dict[bytes, int | None] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.readings: dict[bytes, tuple] = {}
        self.left_of: dict[int, list] = {}
        self.right_of: dict[int, list] = {}
        self.reset()

    def reset(self) -> None:
        # state: (suffix that may become a token, last token at each offset since the certain point)
        self.states: list[tuple[bytes, tuple]] = [(b"", (_START,))]
        self.index = {self.states[0]: 0}
        self.next: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.asked: set[int] = set()
        self.rest: dict[int, tuple[int, ...]] = {}

    def merge(self, data: bytes) -> list[int]:
        """The definition: merge the adjacent pair of lowest rank until none is left."""
        parts, rank, none = [data[i : i + 1] for i in range(len(data))], self.ranks.get, _NEVER
        ranks = [rank(data[i : i + 2], none) for i in range(len(data) - 1)]  # of each adjacent pair
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank(parts[i] + parts[i + 1], none)
            if i:
                ranks[i - 1] = rank(parts[i - 1] + parts[i], none)
        return [self.ranks[p] for p in parts]

    def token(self, data: bytes) -> int | None:
        """The id of data if its encoding is that one token."""
        if data not in self.usable:
            i = self.ranks.get(data)
            self.usable[data] = i if i is not None and self.merge(data) == [i] else None
        return self.usable[data]

    def _edge(self, token: int, left: bool) -> list[tuple[int, bytes]]:
        """How the outermost part of a token grows as it is merged: (rank reached by then, part)."""
        data, rank, none = self.bytes_of[token], self.ranks.get, _NEVER
        parts, level = [data[i : i + 1] for i in range(len(data))], -1
        out = [(level, parts[0 if left else -1])]
        while len(parts) > 1:
            best, i = min((rank(x + y, none), i) for i, (x, y) in enumerate(zip(parts, parts[1:])))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            level = max(level, best)
            if i == (0 if left else len(parts) - 1):
                out.append((level, parts[i]))
        return out

    def fits(self, a: int, b: int) -> bool:
        """Whether token b can follow token a: no merge across the border comes before those within."""
        key = (a, b)
        good = self.pairs.get(key)
        if good is not None:
            return good
        if len(self.pairs) > 10 * MOST_STATES:
            self.pairs.clear()
        if (x := self.right_of.get(a)) is None:
            x = self.right_of[a] = self._edge(a, False)
        if (y := self.left_of.get(b)) is None:
            y = self.left_of[b] = self._edge(b, True)
        i = j = 0
        while True:
            across = self.ranks.get(x[i][1] + y[j][1], _NEVER)
            then_x = x[i + 1][0] if i + 1 < len(x) else _NEVER
            then_y = y[j + 1][0] if j + 1 < len(y) else _NEVER
            if across < then_x and across <= then_y and across != _NEVER:
                good = False
                break
            if then_x == then_y == _NEVER:
                good = True
                break
            if then_x <= then_y:  # of equal ranks the left one is merged first
                i += 1
            else:
                j += 1
        self.pairs[key] = good
        return good

    def _chain(self, nodes: tuple, at: int) -> list[int]:
        """Offsets of the encoding that ends at an offset, back to the certain point."""
        out, size = [at], self.size_of
        while at > 0:
            at -= size[nodes[at]]
            out.append(at)
        return out

    def _reading(self, data: bytes) -> tuple[list[tuple[int, int]], bytes, list[int]]:
        """Of the bytes that count: the tokens they end in, longest first; what still counts after them; where in that a token can begin."""
        ends = [(n, t) for n in range(len(data), 0, -1) if (t := self.token(data[len(data) - n :])) is not None]
        while data and data not in self.prefixes:
            data = data[1:]
        begins = [n for n in range(1, len(data) + 1) if data[len(data) - n :] in self.prefixes]
        return ends, data, begins

    def step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The next state and the tokens that have become certain."""
        suffix, nodes = self.states[state]
        data = suffix + _BYTE[byte]
        reading = self.readings.get(data) or self.readings.setdefault(data, self._reading(data))
        ends, data, begins = reading
        here, last, pairs = len(nodes), None, self.pairs  # here: the offset after this byte
        for n, t in ends:
            if n <= here and (before := nodes[here - n]) is not None:
                good = before == _START or pairs.get((before, t))
                if good or (good is None and self.fits(before, t)):
                    last = t
                    break
        nodes = (*nodes, last)
        # a later token can only begin where the bytes since then begin some token
        chain = self._chain(nodes, here)
        others = [self._chain(nodes, here - n) for n in begins if n <= here and nodes[here - n] is not None]
        if others:
            certain = max(set(chain).intersection(*others))
            needed = {o for c in (chain, *others) for o in c}
            kept = tuple([nodes[o] if o in needed else None for o in range(certain, here + 1)])
        else:
            certain, kept = here, (last,)
        key = (data, kept)
        to = self.index.get(key)
        if to is None:
            to = self.index[key] = len(self.states)
            self.states.append(key)
        return to, tuple([nodes[o] for o in reversed(chain) if 0 < o <= certain])

    def flush(self, state: int) -> tuple[int, ...]:
        """The tokens still open at the end of the bytes."""
        got = self.rest.get(state)
        if got is None:
            nodes = self.states[state][1]
            got = self.rest[state] = tuple(nodes[o] for o in reversed(self._chain(nodes, len(nodes) - 1)) if o > 0)
        return got

    def _follow(self, state: int, data: bytes) -> list[int]:
        """The tokens of a state and the bytes after it, without making states."""
        suffix, nodes = self.states[state]
        nodes, readings, pairs = list(nodes), self.readings, self.pairs
        for byte in data:
            suffix += _BYTE[byte]
            reading = readings.get(suffix)
            if reading is None:
                if len(readings) > 3 * MOST_STATES:
                    readings.clear()
                reading = readings[suffix] = self._reading(suffix)
            ends, suffix, _ = reading
            here, last = len(nodes), None
            for n, t in ends:
                if n <= here and (before := nodes[here - n]) is not None:
                    good = before == _START or pairs.get((before, t))
                    if good or (good is None and self.fits(before, t)):
                        last = t
                        break
            nodes.append(last)
        return [nodes[o] for o in reversed(self._chain(nodes, len(nodes) - 1)) if o > 0]

    def encode(self, data: bytes) -> tuple[int, ...]:
        """The encoding of the bytes of one piece.

        A transition is made when it is asked for a second time; what follows a
        first asking is read once without leaving states behind.
        """
        if len(self.states) > MOST_STATES or len(self.asked) > 10 * MOST_STATES:
            self.reset()
        state, out, table = 0, [], self.next
        for i, byte in enumerate(data):
            got = table.get(state << 8 | byte)
            if got is None:
                key = state << 8 | byte
                if len(data) - i <= SHORT and key not in self.asked:
                    self.asked.add(key)
                    out.extend(self._follow(state, data[i:]))
                    return tuple(out)
                if len(self.states) > 2 * MOST_STATES:  # within a very long piece: only the state itself still counts
                    kept = self.states[state]
                    self.reset()
                    table, state = self.next, self.index.setdefault(kept, len(self.states))
                    if state == len(self.states):
                        self.states.append(kept)
                    key = state << 8 | byte
                got = table[key] = self.step(state, byte)
            state, tokens = got
            if tokens:
                out.extend(tokens)
        out.extend(self.flush(state))
        return tuple(out)


class Encoder:
    """Texts to ids: the split pattern, the transducer and a table of pieces met before."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import regex

        self.split = regex.compile(pattern)
        self.transducer = Transducer(ranks)
        self.pieces: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str, out: array) -> None:
        """Appends the ids of a text; bytes that are no UTF-8 come as surrogate escapes."""
        parts, known = self.split.findall(text), self.pieces
        got = list(map(known.get, parts))
        if None in got:
            for i, ids in enumerate(got):
                if ids is None:
                    got[i] = known.get(parts[i]) or self._new(parts[i])
        out.extend(chain.from_iterable(got))

    def _new(self, piece: str) -> tuple[int, ...]:
        ids = self.transducer.encode(piece.encode("utf-8", "surrogateescape"))
        if len(piece) <= SHORT:
            if len(self.pieces) >= MOST_WORDS:
                self.pieces.clear()
            self.pieces[piece] = ids
        return ids


def stream_decode(ids: Iterable[int], bytes_of: dict[int, bytes]) -> Iterator[str]:
    """Text of a stream of ids; a character leaves when its last byte has come."""
    machine = codecs.getincrementaldecoder("utf-8")("surrogateescape")
    for i in ids:
        if part := machine.decode(bytes_of[i]):
            yield part
    if part := machine.decode(b"", True):
        yield part


_encoders: dict[str, Encoder] = {}


def _encoder(name: str, ranks: dict[bytes, int]) -> Encoder:
    if name not in _encoders:
        _encoders[name] = Encoder(ranks)
    return _encoders[name]


def _ids(texts: Iterable[bytes | None], encoder: Encoder) -> Iterator[tuple[int, pa.ListArray]]:
    """Arrays of ids for consecutive texts, with how many texts each covers."""
    flat, ends, chars = array("i"), [0], 0
    for text in texts:
        if text:
            string = text.decode("utf-8", "surrogateescape")
            encoder.encode(string, flat)
            chars += len(string)
        ends.append(len(flat))
        if chars >= BATCH_CHARS:
            yield len(ends) - 1, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32)))
            flat, ends, chars = array("i"), [0], 0
    if len(ends) > 1:
        yield len(ends) - 1, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32) if flat else np.empty(0, np.int32)))


def encode(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = BYTE_BPE_50K) -> DataFrame:
    """(id_col, ids) of every row: the ids of the whole text, without special tokens.

    An empty and a null text give an empty list; a text that spells a special
    token is ordinary text; bytes that are no valid UTF-8 are encoded as bytes.
    A null id stays null, repeated rows stay repeated, other columns are
    ignored. Narrow: no shuffle. The vocabulary file is read on the driver and
    sent out once (its size is fixed).
    """
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary, ranks.value)
        for batch in batches:
            done = 0
            for n, ids in _ids((v.as_py() for v in batch.column(1)), encoder):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, n), ids], names=["id", "ids"])
                done += n

    kind = df.schema[id_col].dataType.simpleString()
    texts = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")))
    return mapped(texts, run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = BYTE_BPE_50K) -> DataFrame:
    """(id_col, text): the text of a list of ids, as a stream; null ids give a null text."""
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = {i: t for t, i in ranks.value.items()}
        for batch in batches:
            texts = [None if v.as_py() is None else "".join(stream_decode(v.as_py(), bytes_of)).encode("utf-8", "surrogateescape") for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], names=["id", "text"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = mapped(df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")), run, f"id {kind}, text binary")
    return rows.select(F.col("id").alias(id_col), F.col("text").cast("string").alias("text"))
