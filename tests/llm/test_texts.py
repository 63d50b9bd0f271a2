"""Tokenizer, leaked passages and shared spans against plain versions."""

import base64
import random
import re
import subprocess
import sys
from array import array
from pathlib import Path

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from framewright.llm import leakage, paragraphs, shared_spans, tokenizer

RANKS = tokenizer.read_ranks(tokenizer.BYTE_BPE_50K)
PLAIN = tiktoken.Encoding("plain", pat_str=tokenizer.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER = tokenizer.Encoder(RANKS)
ODD = ["", " ", "\n\n  \n", "a" * 5000, "ab" * 3000 + "!" * 900, "<|endoftext|>", "naïve café ẞ İ", "\U0001f600‍\U0001f469 é", "日本語のテキスト", "\x00\x01", "don't I'LL we've", "0123456789" * 50, " 　x", "\r\n"]


def ids_of(text):
    out = array("i")
    ENCODER.encode(text, out)
    return list(out)


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    assert ids_of(text) == PLAIN.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    assert ids_of(text) == PLAIN.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.text("abcdehint -'19éß", max_size=120))
def test_merging_text(text):
    assert ids_of(text) == PLAIN.encode_ordinary(text)


def test_transducer_alone(monkeypatch):
    monkeypatch.setattr(tokenizer, "MOST_STATES", 30)  # emptied again and again
    monkeypatch.setattr(tokenizer, "SHORT", 0)  # nothing is read without states
    t, r = tokenizer.Transducer(RANKS), random.Random(3)
    for _ in range(200):
        data = "".join(r.choice("abcing the éß\U0001f600") for _ in range(r.randint(0, 60))).encode()[: r.randint(0, 90)]
        assert list(t.encode(data)) == t.merge(data)


def test_tokens_leave_after_bounded_lookahead():
    t = tokenizer.Transducer(RANKS)
    state, waiting, seen = 0, 0, 0
    for byte in b"the cat sat on the mat and then internationally " * 40:
        state, out = t.step(state, byte)
        seen += sum(len(t.bytes_of[i]) for i in out)
        waiting = max(waiting, len(t.states[state][1]) - 1)
    assert waiting <= 2 * max(map(len, RANKS)) and seen > 1800


def test_stream_decode():
    bytes_of = {i: b for b, i in RANKS.items()}
    for text in ODD:
        parts = list(tokenizer.stream_decode(ids_of(text), bytes_of))
        assert "".join(parts) == text and all(parts)


def test_encode_frame(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(98, None, "x"), (None, "a", "x"), (98, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = tokenizer.encode(df).collect()
    assert sorted((str(r["doc_id"]), r["ids"]) for r in got) == sorted((str(i), PLAIN.encode_ordinary(t or "")) for i, t, _ in rows)
    assert tokenizer.encode(df.limit(0)).count() == 0
    back = {r["doc_id"]: r["text"] for r in tokenizer.decode(tokenizer.encode(df.filter("doc_id < 90"))).collect()}
    assert back == dict(enumerate(ODD))


def test_broken_bytes(spark):
    df = spark.sql("SELECT 1 AS doc_id, CAST(X'61FF62C3' AS STRING) AS text")
    t = tokenizer.Transducer(RANKS)
    ids = tokenizer.encode(df).first()["ids"]
    assert b"".join(t.bytes_of[i] for i in ids) == b"a\xffb\xc3"


def brute_leaks(docs, items, run):
    grams: dict = {}
    for i, t in items:
        w = leakage.words(t or "")
        for k in range(len(w) - run + 1):
            grams.setdefault(tuple(w[k : k + run]), set()).add(i)
    out = set()
    for d, t in docs:
        w = leakage.words(t or "")
        for k in range(len(w) - run + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + run]), ()) if d is not None and i is not None}
    return out


@pytest.mark.parametrize("filter_words", [leakage.FILTER_WORDS, 2])  # nearly every fingerprint passes two words
def test_leaked(spark, monkeypatch, filter_words):
    monkeypatch.setattr(leakage, "PIECE_WORDS", 40)
    r = random.Random(6)
    vocabulary = ["Anna", "über", "x1", "naïve", "ß", "42", "日本", "o'clock", "mid-way", "İx"]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, say(r.randint(5, 40))) for i in range(12)] + [(90, None), (91, ""), (92, "too short"), (93, " ".join(["same"] * 30)), (None, say(30)), (94, items_text := say(20)), (95, items_text)]
    docs = []
    for d in range(60):
        w = items[r.randrange(12)][1].split()
        a = r.randrange(max(1, len(w) - 8))
        cut = w[a : a + r.randint(8, 18)]
        docs.append((d, say(r.randint(0, 50)) + " " + r.choice([" ", ", ", "\n> "]).join(x.upper() if r.random() < 0.3 else x for x in cut) + " " + say(r.randint(0, 50))))
    docs += [(100, None), (101, ""), (102, "same " * 500), (103, items_text * 3), (103, items_text), (None, items_text), (104, say(300))]
    frames = [spark.createDataFrame([(i, t, "x") for i, t in rows], f"{name} long, text string, fp string") for rows, name in ((docs, "doc_id"), (items, "item_id"))]
    got = [tuple(x) for x in leakage.leaked(*frames, filter_words=filter_words).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_leaks(docs, items, 12)
    assert leakage.leaked(frames[0], frames[1].limit(0), filter_words=filter_words).count() == 0
    assert leakage.leaked(frames[0].limit(0), frames[1], filter_words=filter_words).count() == 0


def brute_spans(docs, span):
    owners: dict = {}
    for i, t in docs:
        for k in range(len(t or "") - span + 1):
            owners.setdefault(t[k : k + span], set()).add(i)
    out = set()
    for i, t in docs:
        marks = [False] * len(t or "")
        for k in range(len(marks) - span + 1):
            if len(owners[t[k : k + span]]) > 1:
                marks[k : k + span] = [True] * span
        start = None
        for k, m in enumerate([*marks, False]):
            if m and start is None:
                start = k
            elif not m and start is not None:
                out.add((i, start, k))
                start = None
    return out


@pytest.mark.parametrize("span, gram, piece", [(40, 10, 1 << 19), (30, 25, 70), (40, 10, 60), (25, 1, 1 << 19)])
@pytest.mark.parametrize("hot", [10**6, 4])
def test_shared_spans(spark, monkeypatch, span, gram, piece, hot):
    monkeypatch.setattr(shared_spans, "PIECE", piece)
    monkeypatch.setattr(shared_spans, "BLOCK_WINDOWS", 500)
    r = random.Random(span + hot)
    base = ["".join(r.choice("ab é\U0001f600\n") for _ in range(r.randint(20, 70))) for _ in range(8)] + ["-" * 60, "xyxyxy" * 9, ""]
    docs = [(k, "".join(r.choice([*base, "a", "b"]) for _ in range(r.randint(0, 9)))) for k in range(90)]
    docs += [(200, None), (201, ""), (202, "q" * 300), (203, base[0] * 5), (204, "x" * (span - 1))]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, id int")
    extra = spark.createDataFrame([(None, base[0] * 9, 1), (202, "q" * 300, 1)], df.schema)  # no id; a further row of the same id
    got = [tuple(x) for x in shared_spans.shared_spans(df.unionByName(extra), span=span, gram=gram, hot_records=hot).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_spans(docs, span)


def test_shared_spans_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    spans = shared_spans.shared_spans(df)
    assert spans.count() == 0 and shared_spans.shared_share(df, spans).count() == 0


def classes_of(links, items):
    root = {x: x for x in items}
    for a, b in links:
        old, new = root[a], root[b]
        root = {k: new if r == old else r for k, r in root.items()}
    return {frozenset(k for k in items if root[k] == r) for r in root.values()}


@pytest.mark.parametrize("seed", range(6))
def test_linked_sets_connect_what_is_similar(seed):
    r = np.random.default_rng(seed)
    base = [r.choice(1_000, r.integers(1, 30), replace=False) for _ in range(4)]
    sets = []
    for _ in range(50):
        x = set(base[r.integers(4)].tolist())
        for _ in range(r.integers(0, 6)):
            x ^= {int(r.integers(0, 1_000)) if r.random() < 0.6 or not x else r.choice(sorted(x))}
        sets.append(np.array(sorted(x) or [1], np.uint64))
    alike = lambda a, b: len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) - 1e-9
    every = [(i, j) for i in range(50) for j in range(i) if alike(sets[i], sets[j])]
    got = paragraphs.linked(sets)
    assert all(alike(sets[i], sets[j]) for i, j in got) and classes_of(got, range(50)) == classes_of(every, range(50))
    assert paragraphs.linked([]) == [] and paragraphs.linked(sets[:1]) == []


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(90), r.randrange(90)) for _ in range(60)] + [(200 + i, 201 + i) for i in range(40)] + [(300, 301 + i) for i in range(20)] + [(5, 5)]
    got = dict(map(tuple, paragraphs.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    items = {x for e in edges if e[0] != e[1] for x in e}
    want = {x: min(c) for c in classes_of(edges, sorted(items | {5})) for x in c}
    assert {k: v for k, v in want.items() if k in items} == got
    assert paragraphs.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("piece", [20_000, 7])
def test_paragraph_classes(spark, monkeypatch, piece):
    monkeypatch.setattr(paragraphs, "PIECE", piece)
    r = random.Random(piece)
    vocabulary = [f"w{i}" for i in range(300)] + ["Über", "日本", "é"]
    base = [[r.choice(vocabulary) for _ in range(60)] for _ in range(4)] + [["same"] * 9]
    docs, texts = [], {}
    for d in range(60):
        parts = []
        for _ in range(r.randint(0, 4)):
            w = list(r.choice(base))
            for _ in range(r.choice([0, 0, 1, 1, 2, 8])):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            parts.append(r.choice([" ", ", ", "\n"]).join(x.upper() if r.random() < 0.2 else x for x in w[: r.choice([3, 60, 60, 60])]))
        docs.append((d, r.choice(["\n\n", "\n \t\n", "\r\n\r\n"]).join(parts)))
    docs += [(100, None), (101, ""), (102, "\n\n\n"), (None, docs[0][1])]
    for d, t in docs:
        for no, part in enumerate(re.split(r"\n[ \t\r]*\n", t) if t else ()):
            if d is not None and len(w := leakage.words(part)) >= 5:
                texts[d, no] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    keys = sorted(texts)
    links = [(a, b) for k, a in enumerate(keys) for b in keys[:k] if len(texts[a] & texts[b]) >= 0.8 * len(texts[a] | texts[b]) - 1e-9]
    want = {x: min(c) for c in classes_of(links, keys) for x in c}
    df = spark.createDataFrame([(d, t, 0, "x") for d, t in docs], "doc_id long, text string, no int, digest string")
    got = {(a, b): (c, e) for a, b, c, e in map(tuple, paragraphs.paragraph_classes(df).collect())}
    assert got == want and len(set(want.values())) < len(want)
    assert paragraphs.paragraph_classes(df.limit(0)).count() == 0


def test_shared_share(spark):
    df = spark.createDataFrame([(1, "a" * 300), (2, "a" * 250 + "bcd" * 90), (3, None), (4, "")], "doc_id long, text string")
    got = {r["doc_id"]: (r["shared_chars"], r["share"]) for r in shared_spans.shared_share(df, shared_spans.shared_spans(df)).collect()}
    assert got == {1: (300, 1.0), 2: (250, 250 / 520), 3: (0, None), 4: (0, None)}


def test_core_does_not_need_llm():
    root = Path(__file__).resolve().parents[2]
    code = "import sys; sys.modules['framewright.llm'] = None; import __spark_entry__ as e; assert e.queries() and not [k for k in e.queries() if k.startswith('p8')]"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
    assert not [p for p in (root / "framewright").rglob("*.py") if "llm" not in p.parts and "framewright.llm" in p.read_text()]


def test_vocabulary_file(tmp_path):
    path = tmp_path / "v"
    path.write_bytes(b"\n".join(base64.b64encode(bytes([i])) + b" %d" % i for i in range(256)) + b"\n" + base64.b64encode(b"ab") + b" 256\n")
    assert list(tokenizer.Transducer(tokenizer.read_ranks(str(path))).encode(b"aabab")) == [97, 256, 256]
