"""The dataset operators on small literal inputs."""

import os
import random
import re
import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from framewright import registry, report, session
from framewright.functions import geometry, paths, raster
from framewright.operators import cache_merge, convert, dedup, features, frames, greedy, hamming, projection, quantiles, statistics
from framewright.plans import object_queries
from framewright.session import checkpointed
from framewright.sources import voc

SMALL = "/root/testdata/sf0.001"
OBJ = "array<struct<name:string,bndbox:struct<xmin:string,ymin:string,xmax:string,ymax:string>>>"
DOC = f"path string, size struct<width:string,height:string,depth:string>, object {OBJ}, class_name int"


def docs(spark, *rows):
    return spark.createDataFrame([(p, s, o, 0) for p, s, o in rows], DOC)


def features_of(spark, box, size=("100", "100", "3"), margin=5):
    rows = features.voc_features(docs(spark, ("a.xml", size, [("car", box)])), margin=margin).collect()
    return rows[0].asDict() if rows else None


@pytest.mark.parametrize(
    "box, expected",
    [
        (("40", "40", "60", "60"), {"object_in_center": 1, "object_in_right_side": 0, "object_in_left_top": 0, "object_relative_area": 0.04, "has_neighbors": 0}),
        (("5", "5", "20", "20"), {"object_in_left_top": 1, "object_in_center": 0, "truncated_left": 0}),
        (("2", "20", "30", "50"), {"truncated_left": 1, "truncated_right": 0}),
        (("0", "10", "20", "50"), {"truncated_left": 1, "truncated_right": 0}),
        (("-90", "10", "-20", "50"), {c: 0 for c in geometry.SECTOR_COLUMNS}),
        (("10", "50", "20", "50"), {"object_aspect_ratio": 0.0, "object_area": 0}),
        (("0", "0", "100", "100"), {"full_size": 1, "object_in_center": 1}),
        (("40", "50", "20", "60"), {"object_width": -20, "object_area": -200}),
    ],
)
def test_features(spark, box, expected):
    got = features_of(spark, box)
    assert {k: got[k] for k in expected} == pytest.approx(expected)


def test_feature_rows(spark):
    box = ("1", "2", "3", "4")
    df = docs(
        spark,
        ("two", ("10", "10", None), [("car", box), (None, box), None]),
        ("zero", ("0", "0", "3"), [("car", box)]),
        ("none", None, [("car", box)]),
        ("broken", ("10", "10", "3"), [("car", box), ("dog", ("40.5", "1", "2", "3"))]),
        ("unboxed", ("10", "10", "3"), [("car", None)]),
        ("empty", ("10", "10", "3"), []),
        ("null", ("10", "10", "3"), None),
    )
    rows = features.voc_features(df).collect()
    assert [(r["path"], r["class_name"], r["objects_count"], r["has_neighbors"], r["im_depth"]) for r in rows] == [("two", "car", 2, 1, 0), ("two", "unfilled", 2, 1, 0)]
    assert dict(map(tuple, features.broken_files(df).collect())) == {"zero": "size", "none": "size", "broken": "box", "unboxed": "box", "empty": "empty", "null": "empty"}
    assert features.voc_features(df.limit(0)).count() == 0


def test_yolo_to_pixels(spark):
    texts = spark.createDataFrame([("d/a.txt", "0 0.5 0.5 0.2 0.2\n\n7 0.05 0.5 0.1 0.2\n0 0.5 0.5 0.2 0.2\nbad\n0 x 1 1 1"), ("d/b.txt", "0 .5 .5 .1 .1"), ("d/c.txt", None)], "path string, value string")
    lines = convert.yolo_lines(texts)
    assert sorted((r["line"], r["line_no"], r["first_no"]) for r in lines.filter("path = 'd/a.txt'").collect())[0] == ("0 0.5 0.5 0.2 0.2", 3, 0)
    sizes = spark.createDataFrame([("d/a.txt", 100, 100)], "path string, im_width int, im_height int")
    classes = spark.createDataFrame([("0", "car"), ("0", "bus")], "class_id string, class_name string")
    pixels = convert.to_pixels(convert.yolo_boxes(lines.select("path", "line")), sizes, classes)
    got = sorted(tuple(r)[1:2] + tuple(r)[4:] for r in pixels.collect())
    assert got == [("car", 40, 40, 60, 60, 0), ("object_7", 0, 40, 10, 60, 1)]
    record = convert.voc_records(pixels).first()
    assert record["folder"] == "d" and record["filename"] == "a.txt" and len(record["object"]) == 2
    back = voc.parsed(voc.to_text(convert.voc_records(pixels))).first()["doc"]
    assert back["object"] == sorted(back["object"], key=lambda o: o["name"]) and back["size"]["width"] == "100"


def test_voc_text_shapes(spark):
    box = "<bndbox><xmin>1</xmin><ymin>2</ymin><xmax>3</xmax><ymax>4</ymax></bndbox>"
    texts = [f"<annotation>{f'<object><name>a</name>{box}</object>' * n}</annotation>" for n in (0, 1, 2)] + ["no xml", None]
    got = voc.parsed(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, value string")).orderBy("i").select(F.size("doc.object")).collect()
    assert [r[0] if r[0] != -1 else None for r in got] == [None, 1, 2, None, None]


def test_voc_to_yolo_text(spark):
    r = random.Random(2)
    sizes = [(640, 480), (1280, 720), (333, 777)]
    rows, want = [], []
    for i in range(300):
        w, h = r.choice(sizes)
        x0, y0 = r.randint(-5, w - 1), r.randint(0, h - 1)
        x1, y1 = r.randint(x0, w + 5), r.randint(y0, h)
        rows.append((str(i), (str(w), str(h), "3"), [("a", (str(x0), str(y0), str(x1), str(y1)))]))
        held = lambda v: min(max(v, 0.0), 1.0)
        want.append(f"{i}:0 " + " ".join("%.6f" % held(v) for v in ((x0 + x1) / 2 / w, (y0 + y1) / 2 / h, (x1 - x0) / w, (y1 - y0) / h)))
    classes = spark.createDataFrame([("a", 0)], "class_name string, class_id int")
    got = {f"{x['path']}:{x['line']}" for x in convert.voc_to_yolo(docs(spark, *rows), classes).collect()}
    assert got == set(want)
    odd = docs(spark, ("x", ("0", "9", "3"), [("a", ("1", "1", "2", "2"))]), ("y", ("9", "9", "3"), [("b", ("1", "1", "2", "2")), ("a", ("q", "1", "2", "2")), None]))
    assert convert.voc_to_yolo(odd, classes).count() == 0


def test_classes(spark):
    lines = spark.createDataFrame([(0, "car"), (1, ""), (2, "dog"), (3, "car")], "line_no int, line string")
    assert dict(map(tuple, features.class_map(lines).collect())) == {"car": 3, "dog": 2}
    names = spark.createDataFrame([("b",), ("a",), ("B",), (None,), ("a",)], "class_name string")
    assert dict(map(tuple, features.class_ids(names).collect())) == {"B": 0, "a": 1, "b": 2}


def test_outliers(spark):
    spike = [100, 102, 98, 101, 105, 95, 100, 103, 99, 1000]
    tank, cloud = [10, 11, 9, 10, 12, 8, 10, 11, 9, 100], [500, 510, 490, 500, 520, 480, 500, 510, 490, 500]
    df = spark.createDataFrame([(i, "one", float(x)) for i, x in enumerate(spike)], "i int, class_name string, x double")
    assert [r["i"] for r in statistics.mark_outliers(df, ["x"]).filter("outlier_any = 1").collect()] == [9]
    df = spark.createDataFrame([(i, "tank" if i < 10 else "cloud", float(x)) for i, x in enumerate(tank + cloud)] + [(50, None, 1e9), (51, "tank", float("nan")), (52, "tank", None)], "i int, class_name string, x double")
    marked = statistics.mark_outliers(df.withColumn("outlier_any", F.lit(1)), ["x"])
    assert [r["i"] for r in marked.filter("outlier_any = 1").collect()] == [9]
    assert dict(marked.dtypes)["outlier_x"] == dict(marked.dtypes)["outlier_any"] == "tinyint"
    two = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0), (100.0, 1.0), (2.0, 1.0), (0.0, 1.0), (2.0, 1.0)], "a double, b double").withColumn("class_name", F.lit("c"))
    assert [r["a"] for r in statistics.mark_outliers(two, ["a", "b"]).filter("outlier_any = 1").collect()] == [100.0]
    assert statistics.mark_outliers(df.limit(0), ["x"]).count() == 0


def test_exact_percentiles(spark):
    r = random.Random(4)
    rows = [(r.choice("ab"), r.choice([0.0, 1.0, -2.5, 1e300, 1e-300, -1e-9, float("inf"), r.gauss(0, 1e6), r.random()])) for _ in range(500)]
    values = spark.createDataFrame([(k, "f", x) for k, x in rows] + [("n", "f", 3.0), (None, "f", 1.0)], "k string, feature string, x double")
    got = {(x["k"], x["quantile"]): x["value"] for x in quantiles.exact_percentiles(values, ["k"], [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    for k in "ab":
        xs = np.array(sorted(x for g, x in rows if g == k))
        for q in (0.0, 0.25, 0.5, 0.9, 1.0):
            with np.errstate(invalid="ignore"):
                want = float(np.percentile(xs, q * 100))
            assert np.isnan(want) or got[k, q] == pytest.approx(want, rel=1e-9)
    assert got["n", 0.5] == 3.0 and (None, 0.5) not in got


@pytest.mark.parametrize("rows, parts", [(200_000, 1_024), (3, 2), (1, 5)])
def test_exact_percentiles_of_wide_ranges(spark, monkeypatch, rows, parts):
    monkeypatch.setattr(quantiles, "RANGE_ROWS", rows)
    monkeypatch.setattr(quantiles, "PARTS", parts)
    r = np.random.default_rng(2)
    groups = {"a": r.normal(size=60) * 1e-3 + 5, "b": np.array([7.0] * 30 + [7.0000001, -1e308, 1e308, -3.0]), "c": np.array([np.inf, -np.inf, 0.0, -0.0, 1.0, 5e-324, -5e-324])}
    df = spark.createDataFrame([(g, "f", float(x)) for g, xs in groups.items() for x in xs], "g string, feature string, x double")
    got = {(x["g"], x["quantile"]): x["value"] for x in quantiles.exact_percentiles(df, ["g"], [0.0, 0.25, 0.5, 0.9]).collect()}
    for g, xs in groups.items():
        xs = np.sort(xs)
        for q in (0.0, 0.25, 0.5, 0.9):
            at = q * (len(xs) - 1)
            lo, hi = xs[int(np.floor(at))], xs[int(np.ceil(at))]
            want = lo if lo == hi and np.isfinite(lo) else lo + (hi - lo) * (at - np.floor(at))
            assert got[g, q] == pytest.approx(want, rel=1e-12, nan_ok=True)


def test_statistics(spark):
    df = spark.createDataFrame(
        [("a", "i", 1.0, 2.0, 1), ("a", "i", 2.0, 4.0, 0), ("a", "j", 3.0, 6.0, 1), ("b", "j", 5.0, 1.0, None), ("b", None, 5.0, None, 1), (None, "k", 7.0, 0.0, 1)],
        "class_name string, im_path string, x double, y double, f int",
    )
    assert [(r["class_name"], r["objects"]) for r in statistics.class_counts(df).collect()] == [("a", 3), ("b", 2)]
    d = statistics.density(df).first()
    assert (d["images"], d["objects"]) == (3, 6) and d["mean_objects"] == pytest.approx(5 / 3) and d["std_objects"] == pytest.approx(np.std([2, 2, 1], ddof=1))
    corr = {r["class_name"]: r["corr"] for r in statistics.class_correlations(df, ["x", "y"]).collect()}
    assert corr == {"a": pytest.approx(1.0)}
    bias = {(r["class_name"], r["feature"]): r["corr"] for r in statistics.bias_matrix(df, ["x"]).collect()}
    xs = np.array([1, 2, 3, 5, 5, 7.0])
    assert bias["a", "x"] == pytest.approx(np.corrcoef([1, 1, 1, 0, 0, 0], xs)[0, 1])
    share = {(r["class_name"], r["flag"]): (r["set_count"], r["share"]) for r in statistics.binary_shares(df, ["class_name"], ["f"]).collect()}
    assert share == {("a", "f"): (2, pytest.approx(200 / 3)), ("b", "f"): (1, 50.0)}
    hist = sorted(map(tuple, statistics.histogram(df, "x", [2, 5]).collect()))
    assert hist == [("a", 0, 1), ("a", 1, 2), ("b", 2, 2)]
    assert [r["class_a"] for r in statistics.one_hot(df, ["a"]).collect()] == [1, 1, 1, 0, 0, 0]
    sample = statistics.stratified_sample(df.withColumn("id", F.monotonically_increasing_id()), "id", per_class=2, least=3)
    assert sample.groupBy("class_name").count().filter("count > 2").count() == 0 and sample.count() == 4
    assert statistics.stratified_sample(df, "x", per_class=2, least=10).count() == 0


def test_projection(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(200, 2))
    rows = [(float(a), float(2 * a + 0.01 * b), float(b), 1.0, "c") for a, b in base]
    df = spark.createDataFrame(rows, "p double, q double, s double, one double, class_name string")
    assert projection.numeric_features(df) == ["p", "q", "s", "one"]
    assert projection.varying(df, ["p", "q", "s", "one"]) == ["p", "q", "s"]
    z = projection.standardised(df, ["p", "one"]).agg(F.avg("p_z"), F.stddev_pop("p_z")).first()
    assert z[0] == pytest.approx(0, abs=1e-9) and z[1] == pytest.approx(1)
    out = projection.projected(df, ["p", "q", "s", "one"]).agg(F.var_pop("proj_x"), F.var_pop("proj_y"), F.corr("proj_x", "proj_y")).first()
    assert out[0] == pytest.approx(2, abs=0.2) and out[1] == pytest.approx(1, abs=0.2) and abs(out[2]) < 1e-6
    assert projection.projected(df, ["one"]).filter("proj_x IS NOT NULL").count() == 0


def test_paths(spark):
    df = spark.createDataFrame([("/a/b.c.jpg",), ("x",), (".hidden",), ("/d/",), (None,), ("A.JPG",)], "p string")
    got = [tuple(r) for r in df.select(paths.name(F.col("p")), paths.stem(F.col("p")), paths.suffix(F.col("p")), paths.has_extension(F.col("p"), [".jpg"])).collect()]
    assert got == [("b.c.jpg", "b.c", ".jpg", True), ("x", "x", "", False), (".hidden", ".hidden", "", False), ("", "", "", False), (None, None, None, None), ("A.JPG", "A", ".JPG", True)]
    assert df.select(paths.safe_name(F.lit("..my images.. "), 5)).first()[0] == "my_im"


def test_orphans_and_pairs(spark):
    a = spark.createDataFrame([("/a/x.xml",), ("/a/y.xml",), ("/a/classes.txt",), (None,), ("/a/y.xml",)], "path string")
    i = spark.createDataFrame([("/i/x.JPG",), ("/i/x.png",), ("/i/z.gif",), (None,)], "path string")
    assert [r[0] for r in features.orphan_annotations(a, i).collect()] == ["/a/y.xml"]
    with pytest.raises(ValueError):
        features.orphan_annotations(a, i.limit(0))
    look = features.image_lookup(i)
    assert [tuple(r) for r in look.collect()] == [("x", "/i/x.png")]
    assert features.with_image(a, look, "inner").count() == 1 and features.with_image(a, look, "left").count() == 5


def test_cache_merge(spark):
    now = spark.createDataFrame([("same", 1), ("newer", 2), ("fresh", 1), ("null", None)], "path string, mtime int")
    old = spark.createDataFrame([("same", 1), ("same", 1), ("newer", 1), ("gone", 1), ("null", None)], "path string, mtime int")
    assert sorted(r[0] for r in cache_merge.to_update(now, old).collect()) == ["fresh", "newer"]
    assert sorted(r[0] for r in cache_merge.still_valid(old, now).collect()) == ["null", "same", "same"]
    assert dict(map(tuple, cache_merge.reconciled(now, old).collect())) == {"same": "kept", "newer": "kept", "fresh": "missing", "gone": "obsolete", "null": "kept"}
    assert cache_merge.combined(old, now.withColumn("x", F.lit(1))).columns == ["path", "mtime", "x"]


def test_threshold_bits():
    assert [hamming.threshold_bits(16, p) for p in (0.1, 10, 1)] == [0, 25, 2] and hamming.threshold_bits(8, 10) == 6
    with pytest.raises(ValueError):
        hamming.threshold_bits(8, 101)


def bits(n, *ones):
    return [i in ones for i in range(n)]


@pytest.mark.parametrize(
    "hashes, most, dropped",
    [
        ([bits(64), bits(64, 0, 1, 2, 3)], 6, [1]),
        ([bits(64), bits(64, *range(10))], 6, []),
        ([bits(64), bits(64, 0, 1), bits(64, 5, 6, 7)], 6, [1, 2]),
        ([[True, True, False], [True, True, False], [False] * 3], 0, [1]),
        ([bits(64), bits(64, *range(5)), bits(64, *range(10))], 6, [1]),
        ([bits(64), None, bits(32), [None] * 64, bits(64)], 6, [4]),
        ([], 6, []),
    ],
)
def test_duplicates(spark, hashes, most, dropped):
    df = spark.createDataFrame([(i, h, "x") for i, h in enumerate(hashes)], "hash_id long, hash array<boolean>, code string")
    got = dedup.duplicates(df, bits=len(hashes[0]) if hashes else 64, most=most)
    assert sorted(r[0] for r in got.collect()) == dropped


@pytest.mark.parametrize("n, most", [(64, 6), (64, 0), (64, 1), (70, 20), (256, 25), (16, 14)])
def test_near_pairs_are_exact(spark, n, most):
    r = np.random.default_rng(n + most)
    centres = r.integers(0, 2, (8, n)).astype(bool)
    rows = [c ^ (r.random(n) < p) for c in centres for p in (0, 0.02, 0.05, 0.05, 0.1, 0.3)]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)], "hash_id long, hash array<boolean>")
    first = {}
    for i, x in enumerate(rows):
        first.setdefault(x.tobytes(), i)
    ids = sorted(first.values())
    want = {(a, b, int((rows[a] ^ rows[b]).sum())) for k, a in enumerate(ids) for b in ids[k + 1 :] if (rows[a] ^ rows[b]).sum() <= most}
    got = [tuple(x) for x in dedup.near_pairs(df, bits=n, most=most).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def alike(n, count, flat, seed=4):
    """A third of the rows without a bit set in the first flat ones, and near rows to each third one."""
    r = np.random.default_rng(seed)
    rows = r.random((count, n)) < 0.5
    rows[::3, :flat] = False
    rows[1::7] = rows[::7][: len(rows[1::7])] ^ (r.random(rows[1::7].shape) < 0.05)
    return [x.tolist() for x in rows]


@pytest.mark.parametrize("flat", [10, 20, 128])
@pytest.mark.parametrize("heavy, dense, block", [(500_000, 256, 200_000), (40, 256, 100), (500_000, 2, 100), (40, 2, 200_000)])
def test_near_pairs_of_skewed_hashes(spark, monkeypatch, flat, heavy, dense, block):
    for name, value in (("HEAVY_ROWS", heavy), ("DENSE", dense), ("BLOCK_ROWS", block)):
        monkeypatch.setattr(hamming, name, value)
    rows = alike(256, 420, flat)
    x = np.array(rows)
    apart = (x[:, None] ^ x[None]).sum(-1)
    want = {(a, b, int(apart[a, b])) for a in range(len(x)) for b in range(a + 1, len(x)) if apart[a, b] <= 25}
    df = spark.createDataFrame(list(enumerate(rows)), "hash_id long, hash array<boolean>")
    got = [tuple(r) for r in dedup.near_pairs(df, bits=256, most=25).collect()]
    assert len(want) > 40 and len(got) == len(set(got)) and set(got) == want


def test_greedy_rounds(spark):
    r = random.Random(8)
    for _ in range(6):
        n = 30
        edges = sorted({tuple(sorted(r.sample(range(n), 2))) for _ in range(r.choice((20, 60)))})
        gone = set()
        for hi in range(n):
            if any(b == hi and a not in gone for a, b in edges):
                gone.add(hi)
        for partitions in (1, 5, None):
            got = greedy.dropped(spark.createDataFrame(edges, "lo long, hi long"), partitions)
            assert sorted(x[0] for x in got.collect()) == sorted(gone)
    assert greedy.dropped(spark.createDataFrame([], "lo long, hi long")).count() == 0


def test_greedy_chain_over_many_rounds(spark, monkeypatch):
    monkeypatch.setattr(greedy, "FOLD", 3)
    order = list(range(0, 40, 2)) + list(range(1, 40, 2))  # neighbours in the chain lie in other ranges
    edges = list(zip(order, order[1:])) + [(0, 39)]
    gone = set()
    for k, x in enumerate(order):
        if any(b == x and a not in gone for a, b in edges):
            gone.add(x)
    got = greedy.dropped(spark.createDataFrame(edges, "lo long, hi long"), 8)
    assert sorted(x[0] for x in got.collect()) == sorted(gone)


def test_frames(spark):
    df = spark.createDataFrame([("v", i, 2.5) for i in range(21)] + [("w", i, 0.1) for i in range(3)], "video string, frame_id long, fps double")
    got = sorted((x["video"], x["frame_id"], x["number"]) for x in frames.sampled(df, 4).collect())
    assert got == [("v", 0, 0), ("v", 10, 1), ("v", 20, 2), ("w", 0, 0), ("w", 1, 1), ("w", 2, 2)]


def test_raster(spark):
    ramp = np.tile(np.arange(100), (100, 1)).astype(np.uint8)
    assert raster.difference_hash(ramp, 8).all() and not raster.difference_hash(ramp[:, ::-1], 8).any()
    assert len(raster.difference_hash(ramp, 16)) == 256
    flat = np.full((50, 40), 7, np.uint8)
    assert raster.quality(flat) == (7.0, 0.0, 0.0)
    assert (raster.area_resized(np.array([[0, 10], [20, 30]]), 1, 1) == 15).all()
    r = np.random.default_rng(1).random((8, 8))
    p = np.pad(r, 1, mode="reflect")
    lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * r
    df = spark.createDataFrame([(1, [float(x) for x in r.ravel()]), (2, None), (3, [1.0]), (4, [None] * 64)], "i int, c array<double>")
    assert df.filter("i = 1").select(raster.raster_bits(F.col("c"), 8, 8)).first()[0] == (r[:, 1:] > r[:, :-1]).ravel().tolist()
    got = raster.small_raster_quality(df, "i", "c", 8, 8).collect()
    assert len(got) == 1 and tuple(got[0]) == pytest.approx((1, r.mean(), r.std(), lap.var()))


def test_report_text(spark):
    df = spark.createDataFrame([("a", "i", 1.0, 1), ("a", "i", 3.0, 0), ("b", "j", 5.0, 1)], "class_name string, im_path string, x double, f int")
    schema = [{"title": "IMAGE QUALITY", "type": "numeric", "columns": ["x"]}, {"title": "SPATIAL", "type": "binary", "columns": ["f"]}]
    text = report.text_report(statistics.mark_outliers(df, ["x"]), "voc", schema)
    assert "voc dataset: 2 images, 3 objects" in text and "class a (66.7 % of the objects)" in text and "f  set=1  percent=50.0" in text
    assert "x  median=2.00  mean=2.00  deviation=1.41  from=1.00  to=3.00" in text and "deviation=?" in text
    assert text.index("IMAGE QUALITY, all classes") < text.index("SPATIAL, class a") < text.index("IMAGE QUALITY, class b")


def test_registry():
    registry.register("report", "own", len)
    assert registry.lookup("report", "own") is len
    with pytest.raises(ValueError, match="dhash"):
        registry.lookup("duplicates", "phash")


def test_spread(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    wide = session.spread(one.filter("id < 50"))
    assert wide.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and wide.count() == 50
    joined = one.join(one, "id")
    assert session.spread(joined) is joined


def test_package_reaches_workers():
    code = """
import os, sys
sys.path.insert(0, {root!r})
from framewright.session import local_session
from framewright.operators import hamming
spark = local_session(cores="2", memory="1g")
df = spark.createDataFrame([(1, [True] * 64)], "i long, h array<boolean>")
assert hamming.packed(df, "i", "h", 64).count() == 1
""".format(root=str(Path(__file__).resolve().parents[1]))
    subprocess.run([sys.executable, "-c", code], cwd="/", check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_checkpoint_uses_configured_folder(spark):
    assert checkpointed(spark.range(3)).count() == 3 and spark.sparkContext.getCheckpointDir()


def yolo_by_hand(folder):
    """(line_id, class id, four numbers) of a table's lines, without Spark."""
    number = re.compile(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?")
    for r in pq.read_table(f"{folder}/yolo_raw.parquet", columns=["line_id", "line"]).to_pylist():
        f = re.split(r"[ \t]+", (r["line"] or "").strip(" \t\n\x0b\f\r"))
        if len(f) == 5 and all(number.fullmatch(x) for x in f[1:]):
            yield r["line_id"], f[0], *map(float, f[1:])


def test_yolo_queries_read_every_line(spark):
    want = list(yolo_by_hand(SMALL))
    assert len(want) > 380
    assert sorted(tuple(r) for r in object_queries.yolo_parse(spark, SMALL).collect()) == sorted(want)
    names = {r["class_id"]: r["class_name"] for r in pq.read_table(f"{SMALL}/class_list.parquet").to_pylist()}
    boxes = []
    for i, c, x, y, w, h in want:
        x0, y0, x1, y1 = (round(v) for v in ((x - w / 2) * 640, (y - h / 2) * 480, (x + w / 2) * 640, (y + h / 2) * 480))
        boxes.append((i, names.get(c, f"object_{c}"), x0, y0, x1, y1, int(x0 <= 0 or y0 <= 0 or x1 >= 640 or y1 >= 480)))
    assert sorted(tuple(r) for r in object_queries.yolo_to_pixels(spark, SMALL).collect()) == sorted(boxes)


def test_yolo_numbers(spark):
    lines = [("a", "\tvan  +.5 5e-1\t0.2 2.e-1 \r"), ("b", "0 nan .5 .1 .1"), ("c", "0 .5 .5 inf .1"), ("d", "0 .5d .5 .1 .1"), ("e", "0 1e999 .5 .1 .1"), ("f", "0 -1e300 .5 .1 .1"), ("g", None)]
    boxes = convert.yolo_boxes(spark.createDataFrame(lines, "path string, line string"))
    assert sorted(tuple(r) for r in boxes.collect()) == [("a", "van", 0.5, 0.5, 0.2, 0.2), ("f", "0", -1e300, 0.5, 0.1, 0.1)]
    sizes = spark.createDataFrame([(p, 100, 100) for p, _ in lines], "path string, im_width int, im_height int")
    pixels = convert.to_pixels(boxes, sizes, spark.createDataFrame([("0", "car")], "class_id string, class_name string"))
    assert [r["path"] for r in pixels.collect()] == ["a"]


def test_manifold_sample_is_placed_by_the_whole_table(spark, tmp_path):
    r = np.random.default_rng(5)
    rows = [(i, "often", float(a), float(a + b)) for i, (a, b) in enumerate(r.normal(size=(2_300, 2)))] + [(5_000 + i, "seldom", 40.0 + i, float(-i)) for i in range(20)]
    spark.createDataFrame(rows, "row_id long, class_name string, u double, v double").write.parquet(str(tmp_path / "object_stats.parquet"))
    whole = {x["row_id"]: (x["proj_x"], x["proj_y"]) for x in object_queries.pca_projection(spark, str(tmp_path)).collect()}
    sample = object_queries.manifold_sample(spark, str(tmp_path)).collect()
    assert len(sample) == 2_020
    assert all((x["proj_x"], x["proj_y"]) == pytest.approx(whole[x["row_id"]], abs=1e-9) for x in sample)


def test_pairs_and_members_name_every_row(spark):
    r = np.random.default_rng(6)
    centres = r.integers(0, 2, (5, 64)).astype(bool)
    rows = [(c ^ (r.random(64) < p)).tolist() for c in centres for p in (0, 0, 0.05, 0, 0.05)] + [None, [True] * 32, [None] * 64]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)] + [(None, rows[0])], "hash_id long, hash array<boolean>")
    usable = {i: np.array(x) for i, x in enumerate(rows[:25])}
    members = [tuple(x) for x in dedup.members(df, bits=64).collect()]
    assert sorted(members) == [(i, min(k for k, y in usable.items() if (x == y).all())) for i, x in usable.items()]
    of, near = dict(members), {(a, b): d for a, b, d in map(tuple, dedup.near_pairs(df, bits=64, most=9).collect())}
    got = {(a, b): 0 if of[a] == of[b] else near.get(tuple(sorted((of[a], of[b])))) for a in usable for b in usable if a < b}
    assert {k: d for k, d in got.items() if d is not None} == {(a, b): d for a in usable for b in usable if a < b and (d := int((usable[a] != usable[b]).sum())) <= 9}


def test_feature_queries_cover_every_numeric_feature(spark):
    stats = pq.read_table(f"{SMALL}/object_stats.parquet")
    no_features = {"row_id", "objects_count", "has_neighbors", "full_size", "run_id"}
    x = {f.name: np.nan_to_num(stats[f.name].cast("float64").fill_null(0).to_numpy()) for f in stats.schema if (pa.types.is_integer(f.type) or pa.types.is_floating(f.type)) and f.name not in no_features}
    vary = {f for f, v in x.items() if v.std() > 0}
    assert {"im_width", "im_height", "im_depth", "object_area"} <= vary
    assert {r[0] for r in object_queries.variance_filter(spark, SMALL).collect()} == vary
    got = object_queries.standardize(spark, SMALL).toPandas().set_index("row_id").sort_index()
    order = np.argsort(stats["row_id"].to_numpy())
    assert set(got.columns) == {f"{f}_z" for f in vary}
    for f in vary:
        assert got[f"{f}_z"].to_numpy() == pytest.approx(((x[f] - x[f].mean()) / x[f].std())[order], abs=1e-5, rel=1e-5)


def test_success_counts_the_outcome(spark):
    rows = [("a", ("9", "9", "3"), [("car", ("1", "2", "3", "4"))]), ("b", ("0", "9", "3"), [("car", ("1", "2", "3", "4"))]), ("c", ("9", "9", "3"), []), ("d", ("9", "x", "3"), [])]
    files = docs(spark, *rows)
    assert tuple(convert.success_counts(files, convert.sized(files), "path").first()) == (4, 2)
    assert tuple(convert.success_counts(files.limit(0), convert.sized(files.limit(0)), "path").first()) == (0, 0)


def test_yolo_files_keep_the_order_of_objects(spark):
    box = lambda x: ("1", "1", str(x), "3")
    files = docs(spark, ("/f/a.xml", ("8", "8", "3"), [("z", box(7)), ("a", box(3)), ("z", box(3))]), ("/f/b.xml", ("8", "8", "3"), []), ("/f/c.xml", None, [("a", box(2))]), ("/e/b.xml", ("8", "8", "3"), [("a", box(3))]))
    classes = spark.createDataFrame([("a", 0), ("z", 1)], "class_name string, class_id int")
    got = dict(map(tuple, convert.yolo_files(convert.voc_to_yolo(files, classes), convert.sized(files)).collect()))
    assert [x.split()[0] for x in got["a"].splitlines()] == ["1", "0", "1"] and got["a"].endswith("\n")
    assert got["b"] == "" and set(got) == {"a", "b"}
    pixels = spark.createDataFrame([("p", 2, "a"), ("p", 1, "z"), ("p", 3, "a")], "path string, no int, class_name string").selectExpr("*", "8 AS im_width", "8 AS im_height", "1 AS xmin", "1 AS ymin", "2 AS xmax", "2 AS ymax", "0 AS truncated")
    assert [o["name"] for o in convert.voc_records(pixels).first()["object"]] == ["z", "a", "a"]


def test_one_hot_covers_every_class(spark):
    stats = pq.read_table(f"{SMALL}/object_stats.parquet", columns=["row_id", "class_name"]).to_pylist()
    number = {c: i for i, c in enumerate(sorted({r["class_name"] for r in stats} - {None}))}
    want = [(r["row_id"], number[r["class_name"]], r["class_name"], 1) for r in stats if r["class_name"] is not None]
    assert {"van", "Van", "crate"} < set(number)
    assert sorted(tuple(r) for r in object_queries.one_hot(spark, SMALL).collect()) == sorted(want)
