"""Orphan references, failing records, changed files and nested records, case by case."""

import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from framewright.operators import changes, references, rejects, shred

T0 = datetime(2025, 1, 1)


def at(h):
    return None if h is None else T0 + timedelta(hours=h)


REFS = "row_id long, path string, im_path string, loaded_at timestamp, seen_at int, _key string"
PARENTS = "path string, seen_at timestamp, deleted_at timestamp, row_id int, _t int"


def state_of(parents, key, t):
    rows = [(s, d) for k, s, d in parents if k == key]
    seen = [s is not None and t is not None and s <= t for s, _ in rows]
    if any(ok and (d is None or d > t) for ok, (s, d) in zip(seen, rows)):
        return None
    return "missing" if not rows else "deleted" if any(seen) else "late"


def run_references(spark, refs, a, b):
    df = spark.createDataFrame([(i, p, q, at(t), 0, "x") for i, p, q, t in refs], REFS)
    frames = [spark.createDataFrame([(k, at(s), at(d), 0, 0) for k, s, d in rows], PARENTS) for rows in (a, b)]
    out = references.orphan_references(df, {"path": frames[0], "im_path": frames[1]}, id_col="row_id", at_col="loaded_at")
    return sorted((r["row_id"], r["ref_field"], r["state"]) for r in out.collect())


def expected_references(refs, a, b):
    out = []
    for i, p, q, t in refs:
        for field, key, rows in (("path", p, a), ("im_path", q, b)):
            if key is not None and (s := state_of(rows, key, t)):
                out.append((i, field, s))
    return sorted(out)


def test_orphans_random(spark):
    r = random.Random(5)
    pick = lambda *x: r.choice(x)
    rows = lambda n: [(pick(None, "a", "b", "c", ""), pick(None, *range(6)), pick(None, None, *range(8))) for _ in range(n)]
    a, b = rows(12), rows(9)
    refs = [(i % 90, pick(None, "a", "b", "c", "d", ""), pick(None, "a", "b", "e"), pick(None, *range(9))) for i in range(120)]
    assert run_references(spark, refs, a, b) == expected_references(refs, a, b)


def test_orphans_boundaries(spark):
    parents = [("a", 2, 5), ("b", 3, 3), ("c", None, None)]
    refs = [(t, "a", None, t) for t in range(1, 7)] + [(10, "b", None, 3), (11, "c", None, 4)]
    got = run_references(spark, refs, parents, [])
    assert got == [(1, "path", "late"), (5, "path", "deleted"), (6, "path", "deleted"), (10, "path", "deleted"), (11, "path", "late")]


def test_orphans_hot_key_is_split(spark, monkeypatch):
    monkeypatch.setattr(references, "HOT_ROWS", 10)
    monkeypatch.setattr(references, "PART_ROWS", 5)
    a = [("hot", 3, 6), ("hot", 8, None)]
    refs = [(i, "hot", "x", i % 10) for i in range(80)] + [(200, "cold", None, 1)]
    assert run_references(spark, refs, a, []) == expected_references(refs, a, [])


def test_orphans_empty(spark):
    assert run_references(spark, [], [], []) == []
    assert run_references(spark, [(1, "a", None, 1)], [], []) == [(1, "path", "missing")]


CLASSES = [("0", "van"), ("1", "traffic cone"), (None, None)]


@pytest.mark.parametrize(
    "line, reason",
    [
        (None, "columns"), ("", "columns"), (" \t", "columns"), ("0 .1 .2 .3 .4", None), ("\t0  .1\t.2 .3 1e-1 \r", None), ("van 0 1 1. +.5", None),
        ('"traffic cone" .1 .2 .3 .4', None), ("traffic cone .1 .2 .3 .4", "columns"), ('"van .1 .2 .3 .4', "quoting"), ("0 .1 .2 .3", "columns"),
        ("0 .1 .2 .3 .4 .5", "columns"), ("7 .1 .2 .3 .4", "value"), ("0 1.1 .2 .3 .4", "value"), ("0 -.1 .2 .3 .4", "value"), ("0 nan .2 .3 .4", "value"),
        ("0 0_1 .2 .3 .4", "value"), ("0 ٠.٥ .2 .3 .4", "value"), ("0\xa0.1 .2 .3 .4", "columns"), ("0 . .2 .3 .4", "value"), ("0 1e .2 .3 .4", "value"),
        ('0 ".1" .2 .3 .4', "value"), ('0 .1 .2 .3 .4 "', "quoting"), ("0 \0 .2 .3 .4", "value"), ('" van" .1 .2 .3 .4', "value"), ("0 .1\n.2 .3 .4 .5", "value"),
    ],
)
def test_yolo_reasons(line, reason):
    parser = rejects.YoloLines(frozenset({"0", "1", "van", "traffic cone"}))
    assert parser.strict(line)[0] == reason
    around = ["0 .1 .2 .3 .4"] * 7
    got = list(parser.parse([*around, line, *around]))
    assert [r[0] for r in got] == [None] * 7 + [reason] + [None] * 7
    assert got[0] == (None, "0", 0.1, 0.2, 0.3, 0.4)


def voc(objects, head=""):
    return f"{head}<annotation><filename>a.jpg</filename>{objects}</annotation>"


BOX = "<bndbox><xmin> 1 </xmin><ymin>2</ymin><xmax>3.5</xmax><ymax>1e1</ymax></bndbox>"


@pytest.mark.parametrize(
    "body, reason",
    [
        (None, "markup"), ("", "markup"), ("  ", "markup"), ("text", "markup"), (voc(""), None), (voc(f"<object><name> van </name>{BOX}</object>"), None),
        (voc(f"<object>{BOX}</object>"), None), (voc(f"<object><name/>{BOX}</object>"), "name"), (voc(f"<object><name>cart</name>{BOX}</object>"), "name"),
        (voc("<object><name>van</name></object>"), "box"), (voc(f"<object><name>van</name>{BOX.replace('2', 'x')}</object>"), "box"),
        (voc("<object><bndbox><xmin>1</xmin></bndbox></object>"), "box"), (voc(f"<object><name>van</nam>{BOX}</object>"), "markup"), ("<annotation>", "markup"),
        ("</annotation>", "markup"), (voc("") + voc(""), "markup"), (voc("") + "x", "markup"), ("x" + voc(""), "markup"), ("<!-- " + voc(""), "markup"), (voc("&nothing;"), "markup"),
        (voc("", '<?xml version="1.0" encoding="utf-8"?>'), None), (voc("", ' <?xml version="1.0"?>'), "markup"), (voc(f"<object><name>c</name></object><object>{BOX}</object>"), "box"),
        (voc("<![CDATA[<object>]]>"), None), ("<next/>", None),
    ],
)
def test_voc_reasons(body, reason):
    parser = rejects.VocBodies(frozenset({"van"}))
    assert parser.strict(body)[0] == reason
    good = voc(f"<object><name>van</name>{BOX}</object>")
    assert [r[0] for r in parser.parse([good] * 5 + [body] + [good] * 5)] == [None] * 5 + [reason] + [None] * 5


def test_rejects_frames(spark):
    classes = spark.createDataFrame(CLASSES, "class_id string, class_name string")
    raw = spark.createDataFrame([(1, "0 .1 .2 .3 .4", "x"), (2, None, None), (2, None, None)], "line_id long, line string, reason string")
    parsed = rejects.parse_yolo(raw, classes)
    assert sorted(map(tuple, rejects.rejected(parsed, "t").collect())) == [("t", 2, "columns")] * 2
    assert [tuple(r) for r in rejects.loaded(parsed).collect()] == [(1, "0", 0.1, 0.2, 0.3, 0.4)]
    assert rejects.parse_yolo(raw.limit(0), classes).count() == 0
    bodies = spark.createDataFrame([(1, voc(f"<object><name>van</name>{BOX}</object>")), (2, "<a")], "doc_no long, body string")
    got = {r["rec_id"]: r for r in rejects.parse_voc(bodies, classes).collect()}
    assert got[2]["reason"] == "markup" and got[1]["object"][0]["xmax"] == 3.5 and got[1]["filename"] == "a.jpg"


SWALLOWING = [["<a/>", "<a/><!--", "--><next/><b/>"], ["<a/>", "<a/><?p ", "?><next/><b/>"], ["<a/>", "<a/><![CDATA[", "]]><b/>"], ["<a>", "<b/></a><c/>", "<d/>"], ["<a/><b/>", "<c>", "</c>"], ["<a x='", "'/>"]]


@pytest.mark.parametrize("bodies", SWALLOWING)
@pytest.mark.parametrize("block", [1, 2, 3, 64])
def test_bodies_do_not_hide_in_each_other(monkeypatch, bodies, block):
    monkeypatch.setattr(rejects, "BLOCK", block)
    voc = rejects.VocBodies(frozenset(["car"]))
    for case in (bodies, ["<z/>", *bodies], [*bodies, "<z/>"]):
        assert list(voc.parse(case)) == [voc.strict(b) for b in case]


PIECES = ["<a>", "</a>", "<a/>", "<!--", "-->", "<?p ", "?>", "<![CDATA[", "]]>", "<next/>", "<object>", "</object>", "<name>car</name>", "<name>x</name>", " ", "t", "&amp;", "&", "'", "<a b='", "'/>", '<?xml version="1.0"?>']


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=5).map("".join) | st.none(), max_size=9))
def test_blocks_of_bodies_read_as_single_ones(bodies):
    voc = rejects.VocBodies(frozenset(["car"]))
    assert list(voc.parse(bodies)) == [voc.strict(b) for b in bodies]


FIELD = st.sampled_from(["car", "0", '"car"', '"big car"', "big", "0.5", "+0.5", "-0.1", "1", "1.0001", ".5", "1.", "1e-3", "1e999", "nan", "inf", "0x1", "1_0", "٣", '"', ""])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.tuples(FIELD, st.sampled_from([" ", "\t", "  ", "\r", "\n", ""])).map("".join), max_size=7).map("".join) | st.none(), max_size=30))
def test_blocks_of_lines_read_as_single_ones(lines):
    yolo = rejects.YoloLines(frozenset(["car", "0", "big car"]))
    assert list(yolo.parse(lines)) == [yolo.strict(x) for x in lines]


def test_bytes_that_are_no_text(spark):
    raw = spark.sql("SELECT 1L AS line_id, CAST(X'C32830' AS STRING) AS line, CAST(X'3C612F3EC328' AS STRING) AS body UNION ALL SELECT 2L, '0 0.5 0.5 0.5 0.5', '<a/>'")
    classes = spark.createDataFrame([("0", "car")], "class_id string, class_name string")
    assert {r["rec_id"]: r["reason"] for r in rejects.parse_yolo(raw, classes).collect()} == {1: "columns", 2: None}
    assert {r["rec_id"]: r["reason"] for r in rejects.parse_voc(raw, classes, id_col="line_id").collect()} == {1: "markup", 2: None}


def test_class_list_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(rejects, "MOST_CLASSES", 2)
    with pytest.raises(ValueError):
        rejects.parse_yolo(spark.createDataFrame([], "line_id long, line string"), spark.createDataFrame(CLASSES, "class_id string, class_name string"))


def test_changes(spark):
    listing = spark.createDataFrame(
        [("a", at(1), at(1), 1, None), ("a", at(2), at(3), 2, None), ("b", at(1), at(1), 3, None), ("c", None, at(1), 4, None), ("d", at(1), at(1), 5, at(2)),
         ("e", at(5), at(1), 6, None), ("e", at(4), at(1), 7, None), (None, at(1), at(1), 8, None), ("f", None, at(1), 9, None), ("g", at(1), None, 10, None)],
        "path string, mtime timestamp, seen_at timestamp, file_id long, deleted_at timestamp",
    )
    runs = spark.createDataFrame([(1, "success"), (1, "success"), (2, "failed"), (3, "success"), (None, "success"), (4, None)], "run_id int, status string")
    results = spark.createDataFrame(
        [("a", at(1), 1, "x"), ("b", at(0), 1, "x"), ("b", at(1), 3, "x"), ("b", at(9), 2, "x"), ("c", None, 1, "x"), ("e", at(4), 2, "x"), ("f", at(1), 1, "x"), (None, None, 1, "x")],
        "path string, mtime timestamp, run_id int, status string",
    )
    current = changes.current_versions(listing, "path", "mtime", order=["seen_at", "file_id"], deleted="deleted_at")
    assert sorted((r[0], r[1]) for r in current.collect()) == sorted({"a": at(2), "b": at(1), "c": None, "e": at(4), "f": None, "g": at(1)}.items())
    got = changes.changed_keys(current, changes.processed_ledger(results, runs, "path", "mtime"), "path", "mtime")
    assert sorted(map(tuple, got.collect())) == [("a", "changed"), ("e", "new"), ("f", "changed"), ("g", "new")]
    empty = changes.processed_ledger(results.limit(0), runs, "path", "mtime")
    assert {r["change"] for r in changes.changed_keys(current, empty, "path", "mtime").collect()} == {"new"}
    assert changes.changed_keys(current.limit(0), empty, "path", "mtime").count() == 0


def test_reread_from(spark):
    runs = spark.createDataFrame(
        [(1, at(1), at(2), "success"), (2, at(3), None, "failed"), (3, at(4), at(5), "success"), (4, at(6), None, "running")], "run_id int, started_at timestamp, finished_at timestamp, status string"
    )
    assert changes.reread_from(runs).first()[0] == at(3)
    assert changes.reread_from(runs.filter("run_id = 1")).first()[0] is None
    assert changes.reread_from(runs.limit(0)).first()[0] is None


BOXES = "struct<xmin:string>"


def test_shred(spark):
    schema = f"ann_id long, object_no int, size struct<width:string>, object array<struct<name:string,bndbox:{BOXES},part:array<struct<name:string,bndbox:{BOXES}>>>>, tags array<string>"
    df = spark.createDataFrame(
        [(1, 7, ("5",), [("a", ("1",), [("p", ("2",)), None, (None, None)]), None, (None, None, None)], ["x", None]), (2, None, None, None, None), (3, None, (None,), [], []), (None, 1, None, [("n", None, [])], None)],
        schema,
    )
    t = shred.shred(df, "ann_id", "annotation")
    assert set(t) == {"annotation", "object", "part", "bndbox", "tags"}
    assert sorted(map(tuple, t["annotation"].select("ann_id", "size_width").collect()), key=str) == [(1, "5"), (2, None), (3, None), (None, None)]
    assert sorted(map(tuple, t["object"].select("ann_id", "object_no", "name").collect()), key=str) == [(1, 1, "a"), (1, 3, None), (None, 1, "n")]
    assert sorted(map(tuple, t["part"].select("ann_id", "object_no", "part_no", "name").collect()), key=str) == [(1, 1, 1, "p"), (1, 1, 3, None)]
    assert sorted(map(tuple, t["bndbox"].select("parent", "ann_id", "object_no", "part_no", "xmin").collect()), key=str) == [("object", 1, 1, None, "1"), ("part", 1, 1, 1, "2")]
    assert [tuple(r) for r in t["tags"].collect()] == [(1, 1, "x")]
    assert all(x.count() == 0 for x in shred.shred(df.limit(0), "ann_id").values())


def test_shred_names_and_sharing(spark):
    box = "array<struct<x:int>>"
    df = spark.createDataFrame([(1, ([(1,), (2,)],), ([(3,)],), ([4],), ([5],), ([6],))], f"k long, a struct<box:{box}>, b struct<box:{box}>, c struct<tag:array<int>>, d struct<tag:array<int>>, e struct<tag:array<int>>")
    t = shred.shred(df, "k", "r")
    assert sorted(map(tuple, t["box"].collect())) == [("r.a", 1, 1, 1), ("r.a", 1, 2, 2), ("r.b", 1, 1, 3)]
    assert {n: [r["value"] for r in t[n].collect()] for n in t if "tag" in n} == {"tag": [4], "r_d_tag": [5], "r_e_tag": [6]}
