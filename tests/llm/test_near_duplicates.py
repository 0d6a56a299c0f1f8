"""SimHash index, components and cover trees against brute force."""

import re

import numpy as np
import pytest
import xxhash

from packetloom.llm import covertree, simhash
from packetloom.llm.components import components

SCHEMA = "doc_id long, text string, fp string, component string"


def brute_print(text, k=4):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    parts = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs, nodes):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    return {n: top(n) for n in nodes}


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    words = [f"w{i}É{i % 7}" for i in range(400)]
    base = [list(rng.choice(words, rng.integers(1, 300))) for _ in range(150)]
    rows = [" ".join(t) for t in base]
    for t in base[:60]:  # near copies, chained
        for n in (1, 2):
            t = [*t]
            t[int(rng.integers(len(t)))] = "changed" * n
            rows.append("\t".join(t).upper() if n == 2 else "  ".join(t))
    rows += [rows[0]] * 40 + [None, "", " \n", " ", "One two", "one TWO", "x " * 30000]
    return [(i * 3 + 5, t, "clash", "clash") for i, t in enumerate(rows)]


def test_simhash_equals_brute_force(spark, texts):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(spark.createDataFrame(texts, SCHEMA)).collect()}
    want = {i: brute_print(t) for i, t, *_ in texts}
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == want
    ids = sorted(want)
    pairs = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if (want[a] ^ want[b]).bit_count() <= 4]
    assert {i: r["component_id"] for i, r in got.items()} == brute_components(pairs, ids)
    assert len({r["component_id"] for r in got.values()}) < len(ids) - 50


def test_simhash_empty_nulls_and_repeats(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(7, "a b c d e f", "", ""), (7, "q r s t u v w x", "", ""), (3, "q r s t u v w x", "", ""), (None, "q r s t u v w x", "", ""), (None, "alone in here", "", "")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in got) == [(0, 0), (0, 3), (3, 3), (7, 3), (7, 3)]


@pytest.mark.parametrize("block", [16, 8192])
def test_index_in_blocks_finds_every_link(spark, block):
    rng = np.random.default_rng(block)
    centres = rng.integers(0, 2**63, 20, dtype=np.uint64)
    near = [c ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(0, 7), dtype=np.uint64)) if i else c for c in centres for i in range(40)]
    fps = np.unique(np.array(near, np.uint64))
    frame = spark.createDataFrame([(int(x), i) for i, x in enumerate(fps.view(np.int64))], "fp long, id long")
    links = [(r["a"], r["b"]) for r in simhash.near_links(frame, "fp", "id", block=block).collect()]
    apart = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    pairs = [(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(apart, 1)))]
    nodes = range(len(fps))
    assert brute_components(links, nodes) == brute_components(pairs, nodes)
    sides = rng.integers(0, 2, len(fps)).astype(np.int8)
    order = np.argsort(fps)
    root = simhash.search(fps[order], sides[order], 4)
    cross = [(a, b) for a, b in pairs if sides[a] != sides[b]]
    place = {int(o): i for i, o in enumerate(order)}
    assert brute_components([(place[a], place[b]) for a, b in cross], nodes) == brute_components(enumerate(root.tolist()), nodes)


def test_components_of_chains_hubs_and_loops(spark):
    pairs = [(i, i + 1) for i in range(0, 60)] + [(1000, i) for i in range(100, 400)] + [(5000, 5000), (9, 2), (2, 9)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs + [(None, 4)], "a long, b long"), "a", "b").collect()}
    real = [p for p in pairs if p[0] != p[1]]
    assert got == brute_components(real, {n for p in real for n in p})
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def brute_vectors(rows, threshold=0.93):
    good = [(i, np.array(v, float), lab) for i, v, lab in rows if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, pairs = {i: 0 for i, *_ in rows}, []
    for k, (i, a, la) in enumerate(good):
        for j, b, lb in good[k + 1 :]:
            if la == lb and len(a) == len(b) and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= threshold:
                n[i] += 1
                n[j] += 1
                pairs.append((i, j))
    return n, brute_components(pairs, n)


@pytest.mark.parametrize("block", [8, 1024])
def test_cover_trees_equal_brute_force(spark, block):
    rng = np.random.default_rng(block)
    centres = rng.standard_normal((12, 6))
    rows = [(i, (centres[i % 12] + rng.standard_normal(6) * rng.choice([0.02, 0.2, 0.6])).tolist(), int(i % 3)) for i in range(240)]
    rows += [(300 + i, rows[0][1], 0) for i in range(30)]
    rows += [(400, None, 0), (401, [0.0] * 6, 0), (402, [float("nan")] + [1.0] * 5, 0), (403, [None] + [1.0] * 5, 0), (404, [], 0), (405, rows[0][1], None), (406, [1.0, 2.0], 0), (407, [2.0, 4.0], 0), (408, [float("inf")] * 6, 1)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, node string, cell int")
    got = {r["vec_id"]: r for r in covertree.near_duplicates(frame, block=block, pivots=8).collect()}
    n, component = brute_vectors(rows)
    assert {i: r["n_links"] for i, r in got.items()} == n
    assert {i: r["component_id"] for i, r in got.items()} == component
    assert all(r["kept"] == (i == component[i]) for i, r in got.items())


def test_cover_trees_of_nothing(spark):
    ddl = "vec_id long, embedding array<float>, label int"
    assert covertree.near_duplicates(spark.createDataFrame([], ddl)).count() == 0
    one = covertree.near_duplicates(spark.createDataFrame([(None, [1.0], 1), (2, [1.0], 1)], ddl)).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"]) for r in one) == [(0, 0), (2, 0)]
