"""Commands, files, caches and streams in temporary folders."""

import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright import commands
from framewright.functions import raster
from framewright.sinks import files
from framewright.sources import cache, config, scan, video
from framewright.streaming import poll
from tests.pictures import png

XML = "<annotation><filename>{0}.png</filename><size><width>90</width><height>60</height><depth>3</depth></size>{1}</annotation>"
OBJECT = "<object><name>{0}</name><bndbox><xmin>{1}</xmin><ymin>{2}</ymin><xmax>{3}</xmax><ymax>{4}</ymax></bndbox></object>"


@pytest.fixture
def dataset(tmp_path):
    r = np.random.default_rng(0)
    for i, name in enumerate("abc"):
        png(tmp_path / f"{name}.png", r.integers(0, 255, (60, 90, 3)))
        (tmp_path / f"{name}.xml").write_text(XML.format(name, "".join(OBJECT.format(c, 10 + i, 10, 40 + i, 50) for c in ("car", "dog")[: i % 2 + 1])))
    (tmp_path / "orphan.xml").write_text(XML.format("orphan", ""))
    return tmp_path


def settings(tmp_path, **given):
    return config.load(str(tmp_path / "none.json"), cache_file_path=str(tmp_path / "cache"), report_path=str(tmp_path / "reports"), **given)


def test_scan(spark, tmp_path):
    for n in ("1.mp4", "2.MP4", "3.avi", "clip.mp4.avi", "n.txt"):
        (tmp_path / n).write_text("x")
    got = scan.listing(spark, str(tmp_path), [".mp4", ".avi"])
    assert sorted(Path(r["path"]).name for r in got.collect()) == ["1.mp4", "3.avi", "clip.mp4.avi"]
    assert scan.next_report_folder(str(tmp_path)).name == "1"
    for n in ("3", "x", "12"):
        (tmp_path / n).mkdir()
    assert scan.next_report_folder(str(tmp_path)).name == "13"


def test_move_and_delete(spark, tmp_path):
    src, dst = tmp_path / "s", tmp_path / "d"
    src.mkdir()
    for n in ("a.jpg", "b.jpg", "c.txt"):
        (src / n).write_text(n)
    s = settings(tmp_path, pattern=(".jpg",))
    assert commands.move(spark, s, str(src), str(dst)).count() == 2 and len(list(src.iterdir())) == 3
    assert commands.move(spark, s, str(src), str(dst), act=True).filter("done").count() == 2
    assert sorted(p.name for p in dst.iterdir()) == ["a.jpg", "b.jpg"]
    done = commands.delete(spark, s, str(dst), act=True)
    assert done.filter("done").count() == 2 and not list(dst.iterdir())
    gone = files.carry_out(files.delete_plan(files.paths_frame(spark, [str(dst / "a.jpg")])))
    assert [r["done"] for r in gone.collect()] == [True]
    with pytest.raises(TypeError):
        files.paths_frame(spark, 5)
    with pytest.raises(FileNotFoundError):
        commands.move(spark, s, str(tmp_path / "nowhere"), str(dst))
    with pytest.raises(ValueError):
        commands.delete(spark, settings(tmp_path), str(src))


def test_images(spark, tmp_path):
    r = np.random.default_rng(2)
    rgb, gray = r.integers(0, 255, (40, 50, 3)).astype(np.uint8), r.integers(0, 255, (33, 20)).astype(np.uint8)
    png(tmp_path / "rgb.png", rgb)
    png(tmp_path / "gray.png", gray)
    (tmp_path / "bad.png").write_text("no image")
    got = {Path(x["path"]).name: x for x in raster.image_features(scan.images(spark, str(tmp_path)), 8).collect()}
    want = raster.luma(rgb[..., ::-1])
    assert (got["rgb.png"]["im_brightness"], got["rgb.png"]["im_contrast"], got["rgb.png"]["im_blur_score"]) == raster.quality(want)
    assert got["rgb.png"]["hash"] == raster.difference_hash(want, 8).tolist() and got["rgb.png"]["im_width"] == 50
    assert got["gray.png"]["hash"] == raster.difference_hash(gray, 8).tolist()
    assert got["bad.png"]["hash"] is None and got["bad.png"]["im_width"] is None


def test_dedup_command(spark, tmp_path):
    src = tmp_path / "s"
    src.mkdir()
    r = np.random.default_rng(1)
    base = r.integers(0, 255, (64, 64))
    for name, x in {"a": base, "b": base, "c": np.clip(base + 1, 0, 255), "d": r.integers(0, 255, (64, 64))}.items():
        png(src / f"{name}.png", x)
    (src / "e.png").write_text("broken")
    s = settings(tmp_path, core_size=8, hash_threshold=10, remove=True)
    plan = commands.dedup_images(spark, s, str(src))
    assert sorted(Path(r["path"]).name for r in plan.collect()) == ["b.png", "c.png"]
    png(src / "f.png", base)
    assert sorted(Path(r["path"]).name for r in commands.dedup_images(spark, s, str(src)).collect()) == ["b.png", "c.png", "f.png"]
    commands.dedup_images(spark, s, str(src), act=True)
    assert sorted(p.name for p in src.iterdir()) == ["a.png", "d.png", "e.png"]


def test_clean_annotations(spark, dataset):
    s = settings(dataset, pattern=(".png",), a_suffix=(".xml",))
    assert [Path(r["path"]).name for r in commands.clean_annotations(spark, s, str(dataset)).collect()] == ["orphan.xml"]
    commands.clean_annotations(spark, s, str(dataset), act=True)
    assert not (dataset / "orphan.xml").exists() and (dataset / "a.xml").exists()


def test_convert_and_back(spark, dataset, tmp_path):
    (dataset / "orphan.xml").unlink()
    yolo, voc_again = tmp_path / "yolo", tmp_path / "voc"
    assert commands.convert_annotations(spark, settings(dataset, destination_type="yolo"), str(dataset), str(yolo)) == 3
    assert (yolo / "classes.txt").read_text().split() == ["car", "dog"]
    assert (yolo / "a.txt").read_text() == "0 0.277778 0.500000 0.333333 0.666667\n"
    assert len((yolo / "b.txt").read_text().splitlines()) == 2
    assert commands.convert_annotations(spark, settings(dataset, destination_type="voc"), str(yolo), str(voc_again), str(dataset), "yolo") == 3
    assert "<xmin>10</xmin>" in (voc_again / "a.xml").read_text() and "<name>dog</name>" in (voc_again / "b.xml").read_text()
    with pytest.raises(ValueError):
        commands.convert_annotations(spark, settings(dataset), str(dataset), str(yolo))


def test_stats_command(spark, dataset):
    text = commands.stats(spark, settings(dataset), str(dataset), str(dataset))
    assert "4 objects" in text and "class car (75.0 % of the objects)" in text
    stored = spark.read.parquet(str(dataset / "reports" / "1" / "features"))
    assert {"outlier_any", "proj_x", "im_brightness", "im_path"} <= set(stored.columns) and stored.filter("im_brightness IS NULL").count() == 0
    commands.convert_annotations(spark, settings(dataset, destination_type="yolo"), str(dataset), str(dataset / "y"))
    assert commands.feature_matrix(spark, settings(dataset), str(dataset / "y"), str(dataset), "yolo").count() == 4


def test_slice_command(spark, tmp_path):
    src, dst = tmp_path / "s", tmp_path / "d"
    src.mkdir()
    np.save(src / "v.npy", np.arange(60 * 2 * 2 * 3, dtype=np.uint8).reshape(60, 2, 2, 3))
    (src / "broken.npy").write_text("x")
    s = settings(tmp_path, step_sec=1.0, suffix=".npy", remove=True)
    commands.slice_videos(spark, s, str(src), str(dst), act=True)
    assert sorted(p.name for p in dst.iterdir()) == ["v_0.npy", "v_1.npy", "v_2.npy"]
    assert [p.name for p in src.iterdir()] == ["broken.npy"]


def test_half_read_videos_stay(spark, tmp_path):
    src, dst = tmp_path / "s", tmp_path / "d"
    src.mkdir()
    np.save(src / "whole.npy", np.zeros((3, 2, 2, 3), np.uint8))
    np.save(src / "none.npy", np.zeros((0, 2, 2, 3), np.uint8))
    (src / "x.mp4").write_text("no video")
    rows = list(video.VideoFrames({"path": str(src)}).reader(None).read(video.InputPartition(str(src / "whole.npy"))))
    assert [r[1] for r in rows] == [0, 1, 2, None] and [r[-1] for r in rows] == [None, None, None, "done"]
    plan = commands.slice_videos(spark, settings(tmp_path, suffix=".npy", remove=True), str(src), str(dst), act=True)
    assert [Path(r["path"]).name for r in plan.collect()] == ["whole.npy"]
    assert sorted(p.name for p in src.iterdir()) == ["none.npy", "x.mp4"]
    torn = video._Reader({"path": str(src)})
    video.DECODERS[".torn"] = lambda path: (_ for _ in [1, 0] if 1 / _ for _ in [(0, 25.0, b"", 0, 0, 3)])
    assert [(r[1], (r[-1] or "")[:12]) for r in torn.read(video.InputPartition("a.torn"))][-1] == (None, "ZeroDivision")
    del video.DECODERS[".torn"]


def opened(monkeypatch):
    """The names of the images that are read from here on, a list for each time."""
    seen, images_at = [], scan.images_at
    monkeypatch.setattr(scan, "images_at", lambda df: (seen.append(sorted(Path(r["path"]).name for r in df.collect())), images_at(df))[1])
    return seen


def test_only_new_and_changed_images_are_read(spark, dataset, monkeypatch):
    monkeypatch.setattr(scan, "images", None)  # nobody reads a whole folder
    seen, s = opened(monkeypatch), settings(dataset)
    first = {r["path"]: r["hash"] for r in commands.hash_cache(spark, s, str(dataset)).collect()}
    assert {r["path"]: r["hash"] for r in commands.hash_cache(spark, s, str(dataset)).collect()} == first and len(first) == 3
    png(dataset / "b.png", np.random.default_rng(7).integers(0, 255, (60, 90, 3)))
    png(dataset / "[d] *.png", np.random.default_rng(8).integers(0, 255, (60, 90, 3)))
    (dataset / "a.png").unlink()
    again = {Path(r["path"]).name: r["hash"] for r in commands.hash_cache(spark, s, str(dataset)).collect()}
    assert set(again) == {"b.png", "c.png", "[d] *.png"} and all(again.values())
    assert seen == [["a.png", "b.png", "c.png"], [], ["[d] *.png", "b.png"]]


def test_statistics_read_the_images_of_changed_files(spark, dataset, monkeypatch):
    monkeypatch.setattr(scan, "images", None)
    png(dataset / "alone.png", np.zeros((9, 9, 3)))
    (dataset / "b.xml").rename(dataset / "b + %41.xml")
    (dataset / "b.png").rename(dataset / "b + %41.png")
    seen, s = opened(monkeypatch), settings(dataset)
    assert commands.cached_matrix(spark, s, str(dataset), str(dataset)).filter("im_brightness IS NOT NULL").count() == 4
    (dataset / "a.xml").write_text(XML.format("a", OBJECT.format("van", 1, 1, 9, 9)))
    assert commands.cached_matrix(spark, s, str(dataset), str(dataset)).filter("im_brightness IS NOT NULL").count() == 4
    assert seen == [["a.png", "b + %41.png", "c.png"], ["a.png"]]


def test_unknown_methods_are_refused(spark, dataset):
    for make in (
        lambda: commands.dedup_images(spark, settings(dataset, method="phash"), str(dataset)),
        lambda: commands.convert_annotations(spark, settings(dataset, destination_type="coco"), str(dataset), str(dataset / "x")),
        lambda: commands.stats(spark, settings(dataset, datatype="sound"), str(dataset)),
    ):
        with pytest.raises(ValueError):
            make()


def test_confirmation(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("APP_LOG_PATH", str(tmp_path / "log"))
    (tmp_path / "a.jpg").write_text("x")
    for answer, left in (("no", True), (" YES ", False)):
        commands.run(spark, ["delete", str(tmp_path), "-p", ".jpg"], str(tmp_path / "none.json"), ask=lambda question: answer)
        assert (tmp_path / "a.jpg").exists() == left


def test_cache(spark, tmp_path):
    assert cache.file_name("/x/my images..", method="dhash", size=16).endswith("_my_images_method_dhash_size_16.parquet")
    assert cache.file_name("/x", "custom_export", size=32) == "custom_export__size_32.parquet"
    folder, schema = str(tmp_path / "c"), "path string, hash array<boolean>"
    assert cache.load(spark, folder, schema).count() == 0
    df = spark.createDataFrame([("a", [True])], schema)
    cache.save(df, folder)
    cache.save(cache.load(spark, folder, schema).unionByName(df), folder)
    assert cache.load(spark, folder, schema).count() == 2 and len(cache.versions(folder)) == 2
    assert cache.save(df.limit(0), folder) is None
    with pytest.raises(TypeError):
        cache.save([1], folder)


def test_settings(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"core_size": 16, "unknown": 1, "a_suffix": [".xml"]}))
    s = config.load(str(path), hash_threshold=20, core_size=None)
    assert (s.core_size, s.hash_threshold, s.a_suffix) == (16, 20, (".xml",))
    path.write_text("{broken")
    assert config.load(str(path)).core_size == 8
    for bad in ({"core_size": 12}, {"core_size": 4}, {"hash_threshold": 101}, {"sleep": -1}, {"step_sec": 0.01}, {"margin_threshold": 200}):
        with pytest.raises(ValueError):
            config.load(str(path), **bad)


def test_feature_cache(spark, dataset):
    s = settings(dataset)
    first = commands.cached_matrix(spark, s, str(dataset), str(dataset))
    assert first.count() == 4 and "mtime" in first.columns
    (dataset / "a.xml").write_text(XML.format("a", OBJECT.format("van", 1, 1, 9, 9) * 3))
    (dataset / "c.xml").unlink()
    again = commands.cached_matrix(spark, s, str(dataset), str(dataset))
    assert sorted((Path(r["path"]).name, r["class_name"]) for r in again.collect()) == [("a.xml", "van")] * 3 + [("b.xml", "car"), ("b.xml", "dog")]


def test_environment_and_log(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("APP_CORE_SIZE", "32")
    monkeypatch.setenv("APP_EXTENSIONS", '[".bmp"]')
    monkeypatch.setenv("APP_LOG_PATH", str(tmp_path / "log"))
    s = config.load(str(tmp_path / "none.json"), core_size=16)
    assert (s.core_size, s.extensions) == (16, (".bmp",)) and config.load(str(tmp_path / "none.json")).core_size == 32
    commands.run(spark, ["move", str(tmp_path), "-p", ".none", "--dst", str(tmp_path / "d")], str(tmp_path / "none.json"))
    assert "is done" in (tmp_path / "log" / "move.log").read_text()


def test_command_line(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("APP_LOG_PATH", str(tmp_path / "log"))
    (tmp_path / "a.jpg").write_text("x")
    plan = commands.run(spark, ["delete", str(tmp_path), "-p", ".jpg"], str(tmp_path / "none.json"))
    assert plan.count() == 1 and (tmp_path / "a.jpg").exists()
    with pytest.raises(SystemExit):
        commands.run(spark, ["unknown"])


def test_watch(spark, tmp_path):
    src, seen = tmp_path / "s", []
    src.mkdir()
    work = lambda df, n: seen.append(sorted(Path(r["path"]).name for r in df.collect()))
    for names in (("a.txt", "b.txt"), ("c.txt",)):
        for n in names:
            (src / n).write_text(n)
        q = poll.watch(spark, str(src), work, str(tmp_path / "check"), pattern="*.txt")
        q.awaitTermination(60)
    assert seen == [["a.txt", "b.txt"], ["c.txt"]]
    docs = spark.createDataFrame([(str(src / "a.txt"), ("9", "9", "3"), [("car", ("1", "1", "2", "2"))])], "path string, size struct<width:string,height:string,depth:string>, object array<struct<name:string,bndbox:struct<xmin:string,ymin:string,xmax:string,ymax:string>>>")
    poll.watch(spark, str(src), poll.appended_features(docs, str(tmp_path / "out")), str(tmp_path / "check2")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).filter(F.col("class_name") == "car").count() == 1
