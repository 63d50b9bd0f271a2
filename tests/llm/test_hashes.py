"""Nearest hashes, batch deduplication and vector search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.llm import batch_dedup, neighbours

SCHEMA = "hash_id long, hash array<boolean>, cache_name string, batch_no int, code string, part int"


def near_rows(seed, n=160, bits=64, centres=9):
    r = np.random.default_rng(seed)
    base = r.integers(0, 2, (centres, bits)).astype(bool)
    out = []
    for i in range(n):
        x = base[r.integers(centres)] ^ (r.random(bits) < r.choice([0, 0, 0.02, 0.05, 0.08, 0.3]))
        out.append((i * 3 + 1, x, r.choice([None, "a", "a", "b", ""]), int(r.choice([0, 0, 1, 2, 5]))))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, None if x is None else [None if b is None else bool(b) for b in x], None if c is None else str(c), b, "x", 1) for i, x, c, b in rows], SCHEMA)


def brute_nearest(rows, most, k):
    out = set()
    for i, x, *_ in rows:
        d = sorted((int((x ^ y).sum()), j) for j, y, *_ in rows if j != i)[:k]
        out |= {(min(i, j), max(i, j)) for n, j in d if n <= most}
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("most, k", [(6, 5), (12, 2)])
def test_nearest_hashes(spark, seed, most, k):
    rows = near_rows(seed)
    got = [tuple(r) for r in neighbours.nearest_hashes(frame(spark, rows), bits=64, most=most, k=k).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_nearest(rows, most, k)


def test_nearest_hashes_copies_and_dirt(spark):
    x, y = np.zeros(64, bool), np.ones(64, bool)
    rows = [(i, x, None, 0) for i in range(40)] + [(i, y, None, 0) for i in range(40, 43)] + [(50, x ^ (np.arange(64) < 3), None, 0)]
    dirty = [*rows, (60, None, None, 0), (61, np.zeros(32, bool), None, 0), (62, [None] * 64, None, 0), (None, x, None, 0)]
    got = [tuple(r) for r in neighbours.nearest_hashes(frame(spark, dirty), bits=64, most=6, k=5).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_nearest(rows, 6, 5)
    assert neighbours.nearest_hashes(frame(spark, []), bits=64, most=6, k=5).count() == 0
    assert neighbours.nearest_hashes(frame(spark, dirty[-4:]), bits=64, most=6, k=5).count() == 0


def brute_repeats(rows, most):
    accepted, out = [], set()
    for i, x, c, b in sorted(rows, key=lambda r: (r[3], r[0])):
        hit = [j for j, y, d in accepted if d == c and int((x ^ y).sum()) <= most] if b else []
        if hit:
            out.add((min(hit), i))
        else:
            accepted.append((i, x, c))
    return out


@pytest.mark.parametrize("seed", range(5))
def test_repeats(spark, seed):
    rows = near_rows(seed + 10)
    shuffled = [(i, x, c, b) for (_, x, c, b), i in zip(rows, np.random.default_rng(seed).permutation(len(rows)).tolist())]  # ids not in batch order
    for case in (rows, shuffled):
        got = [tuple(r) for r in batch_dedup.repeats(frame(spark, case), bits=64, most=6).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_repeats(case, 6)


def test_repeats_dirt(spark):
    x = np.zeros(64, bool)
    rows = [(1, x, "", 0), (2, x, None, 1), (3, x, None, 1), (4, x, "", 1), (5, x, "a", 2)]
    dirty = [*rows, (6, None, "a", 1), (7, [None] * 64, "a", 1), (None, x, "a", 1), (8, x, "a", None), (9, np.zeros(8, bool), "a", 1)]
    assert {tuple(r) for r in batch_dedup.repeats(frame(spark, dirty), bits=64, most=6).collect()} == {(2, 3), (1, 4)}
    assert batch_dedup.repeats(frame(spark, []), bits=64, most=6).count() == 0


def test_segment_index(spark, tmp_path):
    rows = near_rows(33)
    df = frame(spark, rows)
    index = batch_dedup.SegmentIndex(spark, str(tmp_path / "index"), bits=64, most=6)
    got = []
    for b in (0, 1, 2, 2, 5):  # a batch is added again as if its run had failed
        part = [tuple(r) for r in index.add(df.filter(F.col("batch_no") == b), b).collect()]
        got = [*got, *part] if b != 2 or not set(part) & set(got) else got
    assert set(got) == brute_repeats(rows, 6) and len(got) == len(set(got))
    with pytest.raises(ValueError):
        batch_dedup.SegmentIndex(spark, str(tmp_path / "index"), bits=64, most=7)


def test_index_reads_what_a_batch_can_meet(spark, tmp_path):
    rows = near_rows(34, n=400, centres=60)
    df = frame(spark, rows)
    index = batch_dedup.SegmentIndex(spark, str(tmp_path / "index"), bits=64, most=6)
    index.add(df, 0)
    few = df.filter("hash_id IN (1, 4)").selectExpr("0L AS part", "hash_id AS id", "hash")
    codes = batch_dedup.hamming.packed(few, "id", "hash", 64)
    wanted = np.array(sorted(r["bucket"] for r in batch_dedup.hamming.bucket_sizes(codes, bits=64, most=6).collect()))
    met = index.segments(1, wanted)
    assert {r["bucket"] for r in met.collect()} == set(wanted.tolist()) and len(wanted) <= 16
    everything = spark.read.parquet(str(tmp_path / "index" / "segments" / "0"))
    assert 0 < met.count() < everything.count() / 10
    plan = met._sc._jvm.PythonSQLUtils.explainString(met._jdf.queryExecution(), "formatted")
    assert "GreaterThanOrEqual(bucket," in plan and "LessThanOrEqual(bucket," in plan


def test_ranges():
    r = np.random.default_rng(3)
    for n, most in ((0, 4), (1, 4), (50, 1), (50, 7), (400, 400)):
        places = np.unique(r.integers(0, 1_000, n))
        got = batch_dedup._ranges(places, most)
        assert len(got) <= most and all(any(a <= x <= b for a, b in got) for x in places.tolist())
        assert all(b < c for (_, b), (c, _) in zip(got, got[1:])) and {x for ab in got for x in ab} <= set(places.tolist())


def test_caches_of_one_digest_are_told_apart(spark, monkeypatch):
    nodes = batch_dedup._nodes
    monkeypatch.setattr(batch_dedup, "_nodes", lambda rows: nodes(rows).withColumn("part", F.lit(5).cast("bigint")))
    rows = near_rows(35)
    assert {tuple(r) for r in batch_dedup.repeats(frame(spark, rows), bits=64, most=6).collect()} == brute_repeats(rows, 6)


def test_nearest_vectors(spark):
    r = np.random.default_rng(5)
    centres = r.normal(size=(20, 16)) * 4
    x = np.concatenate([centres[i % 20] + r.normal(size=16) for i in range(600)]).reshape(600, 16)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    dirt = [(1000, None), (1050, [1.0]), (1100, [float("nan")] * 16), (1150, [None] * 16), (None, [0.0] * 16)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + dirt], "vec_id long, embedding array<double>, v int")
    got: dict = {}
    for row in neighbours.nearest_vectors(df, size=16, k=5, every=20).collect():
        got.setdefault(row["vec_id"], []).append((row["place"], row["neighbour"], row["distance"]))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    hits = [len({n for _, n, _ in got.get(q, [])} & set(np.argsort(d[q])[:5].tolist())) / 5 for q in range(0, 600, 20)]
    assert np.mean(hits) >= 0.9 and set(got) <= set(range(0, 600, 20))
    for q, found in got.items():
        assert all(dist == pytest.approx(d[q, n]) for _, n, dist in found) and [p for p, *_ in sorted(found)] == list(range(1, len(found) + 1))
    assert neighbours.nearest_vectors(df.limit(0), size=16, k=5).count() == 0


def test_perturbations_ascend():
    for k in (3, 6, 10):
        sets = neighbours._perturbations(k, 50)
        assert sets[0] == () and sets[1] == (0,) and len(set(sets)) == len(sets)
        assert all(2 * k - 1 - p not in s for s in sets for p in s)


def nearest_by_hand(x, q, k):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    return [int(i) for i in np.lexsort((np.arange(len(x)), d)) if i != q][:k]


def test_vectors_with_many_copies(spark):
    r = np.random.default_rng(12)
    x = r.normal(size=(1_500, 16))
    x[np.arange(1_500) % 5 < 3] = r.normal(size=(3, 16))[np.arange(900) % 3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for row in neighbours.nearest_vectors(df, size=16, k=10, every=7).orderBy("place").collect():
        found.setdefault(row["vec_id"], []).append(row["neighbour"])
    lone = [q for q in range(0, 1_500, 7) if q % 5 > 2]
    assert np.mean([len(set(found.get(q, [])) & set(nearest_by_hand(x, q, 10))) / 10 for q in lone]) >= 0.9


def test_vectors_in_split_buckets(spark, monkeypatch):
    r = np.random.default_rng(15)
    x = np.concatenate([r.normal(size=(200, 8)), np.ones((150, 8)) + r.normal(size=(150, 8)) * 1e-3, r.normal(size=(100, 8)) + 9])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, neighbours.nearest_vectors(df, size=8, k=4, every=3).collect()))
    monkeypatch.setattr(neighbours, "CELL_ROWS", 20)
    monkeypatch.setattr(neighbours, "CELL_QUERIES", 7)
    assert sorted(map(tuple, neighbours.nearest_vectors(df, size=8, k=4, every=3).collect())) == whole and len(whole) == 600


def test_vectors_that_met_too_few_are_ranked_against_all(spark):
    x = np.random.default_rng(13).normal(size=(700, 8)).round(1)
    x[::90] += 1e6
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for row in neighbours.nearest_vectors(df, size=8, k=4, every=3, width=1e-9).orderBy("place").collect():
        found.setdefault(row["vec_id"], []).append(row["neighbour"])
    assert found == {q: nearest_by_hand(x, q, 4) for q in range(0, 700, 3)}
    assert neighbours.nearest_vectors(df.limit(0), size=8, k=4).count() == 0
