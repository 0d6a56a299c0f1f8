"""Neighbour search and balancing against brute force."""

import random

import numpy as np
import pytest

from packetloom.operators import neighbours as nb
from packetloom.operators.hashed import Hashing, buckets, recall


def _points(n=120, copies=40, seed=2):
    rnd = random.Random(seed)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(4)], rnd.randint(0, 2)) for i in range(n)]
    hot = [0.5, 0.5, 0.5, 0.5]
    rows += [(n + i, hot, i % 2) for i in range(copies)]  # a third of the rows are copies
    rows += [(900, [9.0, 9.0, 9.0, 9.0], 7)]  # a class of one
    return rows


def _brute(rows, k, within):
    out = {}
    for i, v, c in rows:
        near = sorted((float(np.linalg.norm(np.subtract(v, w))), j) for j, w, d in rows if j != i and (not within or c == d))
        out[i] = near[:k]
    return out


@pytest.mark.parametrize("block,qblock", [(2048, 16384), (7, 11)])
@pytest.mark.parametrize("within", [True, False])
def test_nearest(spark, monkeypatch, block, qblock, within):
    monkeypatch.setattr(nb, "_BLOCK", block)
    monkeypatch.setattr(nb, "_QUERY_BLOCK", qblock)
    rows = _points()
    df = spark.createDataFrame(rows, "id bigint, v array<double>, label int").repartition(5)
    got = {}
    for r in nb.nearest(df, "id", "v", 3, "label" if within else None).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbour"], r["distance"]))
    want = _brute(rows, 3, within)
    for i, near in want.items():
        mine = sorted(got.get(i, []))
        assert [m[1] for m in mine] == [j for _, j in near]
        assert [m[2] for m in mine] == pytest.approx([d for d, _ in near])


def test_oversample_reaches_its_targets(spark):
    rows = _points()
    df = spark.createDataFrame(rows, "id bigint, v array<double>, label int")
    sizes = {c: sum(1 for r in rows if r[2] == c) for c in {r[2] for r in rows}}
    targets = {0: sizes[0] + 37, 1: 3 * sizes[1], 2: 1, 7: 5}
    got = nb.oversample(df, "id", "v", "label", targets).collect()
    made = {c: sum(1 for r in got if r["label"] == c) for c in targets}
    assert made == {0: 37, 1: 2 * sizes[1], 2: 0, 7: 4}
    vec = {i: np.array(v) for i, v, _ in rows}
    near = _brute(rows, 3, True)
    for r in got:
        a, b = vec[r["base"]], vec[r["neighbour"]]
        assert np.allclose(r["v"], a + r["u"] * (b - a)) and 0 <= r["u"] <= 1
        assert r["neighbour"] in [j for _, j in near[r["base"]]] or r["label"] == 7
    none = nb.oversample(df, "id", "v", "label", {2: 1})
    assert none.count() == 0 and none.columns == ["label", "base", "copy", "neighbour", "u", "v"]


def test_hashed_neighbours_recall_and_bounds(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(40, 24)) * 3
    vectors = [centres[i % 40] + rng.normal(size=24) for i in range(3000)] + [rng.normal(size=24) for _ in range(1000)]
    vectors += [centres[0] + 1e-3 * rng.normal(size=24) for _ in range(1500)] + [vectors[5]] * 300  # a dense spot, and copies
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>, label int").repartition(6)
    h = Hashing(tables=12, bucket=256)
    found = nb.nearest(df, "id", "v", 5, "label", h).cache()
    exact = nb.nearest(df, "id", "v", 5, "label").cache()
    assert found.count() == exact.count() == 5 * len(rows)
    assert recall(found, exact, ["id"]).first()["recall"] >= 0.9
    worse = recall(nb.nearest(df, "id", "v", 5, "label", Hashing(tables=1, bucket=64)), exact, ["id"]).first()["recall"]
    assert worse < recall(found, exact, ["id"]).first()["recall"]
    vecs = df.selectExpr("cast(label as string) as g", "id as vid", "v")
    sizes = buckets(vecs, h).groupBy("g", "t", "bits", "prefix", "part").count()
    assert sizes.groupBy().max("count").first()[0] <= 2 * 256  # parts of equal vectors are dealt by hash
    assert sizes.filter("part = 0").groupBy("t").count().count() == 12
    true = {r["id"]: r["v"] for r in df.collect()}
    for r in found.filter("id % 97 = 0").collect():
        assert r["distance"] == pytest.approx(float(np.linalg.norm(np.subtract(true[r["id"]], true[r["neighbour"]]))), abs=1e-9)
    assert nb.nearest(df.limit(0), "id", "v", 5, hashing=h).count() == 0


def test_balanced_classes_come_back_without_links(spark):
    rows = [(-1, [0.0], 0), (-2, [0.1], 1), (3, [5.0], 0), (4, [9.0], 1), (5, [5.2], 0), (6, [9.3], 1)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>, label int")
    assert sorted(r["id"] for r in nb.oversample_and_clean(df, "id", "v", "label").collect()) == [3, 4, 5, 6]
    more = nb.oversample_and_clean(df.union(spark.createDataFrame([(7, [5.1], 0), (8, [4.9], 0)], df.schema)), "id", "v", "label", 1)
    ids = [r["id"] for r in more.collect()]
    assert len(ids) == len(set(ids)) and min(ids) < -2


def test_tomek_links_and_removal(spark):
    rows = [(1, [0.0], 0), (2, [0.1], 1), (3, [5.0], 0), (4, [5.1], 0), (5, [9.0], 1), (6, [9.3], 0), (7, [9.4], 0)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>, label int")
    links = nb.tomek_links(df, "id", "v", "label").collect()
    assert [(r["first"], r["second"]) for r in links] == [(1, 2)]
    assert sorted(r["id"] for r in nb.drop_tomek(df, "id", "v", "label").collect()) == [3, 4, 5, 6, 7]


def test_oversample_and_clean(spark):
    rows = _points(copies=0)
    df = spark.createDataFrame([r for r in rows if r[2] != 7], "id bigint, v array<double>, label int")
    out = nb.oversample_and_clean(df, "id", "v", "label", 3)
    top = max(sum(1 for r in rows if r[2] == c) for c in (0, 1, 2))
    counts = {r["label"]: r["count"] for r in out.groupBy("label").count().collect()}
    assert all(0 < n <= top for n in counts.values()) and out.select("id").distinct().count() == out.count()
