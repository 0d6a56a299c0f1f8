"""Near-duplicate embeddings by dual traversal of cover trees.

Unit vectors whose cosine is ``threshold`` lie within a chord of
``sqrt(2 - 2 * threshold)``. Vectors are compared within their label only. A label
is cut into blocks around shared pivots; block pairs whose balls are too far apart
are dropped, and each other pair is one task: a cover tree per block (nested
levels, radii halving), both walked together, node pairs dropped where
distance - covering radius - covering radius exceeds the chord. What is left is
compared by cosine in double precision, so the pairs are exact.

Equal vectors are folded first. A search returns one row per vector (how many it
is linked to, and a link towards a spanning forest), never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.functions.dims import attach
from packetloom.functions.scratch import materialize
from packetloom.llm.components import components
from packetloom.llm.simhash import unite

#: Added to every bound, far above the rounding of a distance.
SLACK = 1e-6


@dataclass
class Level:
    """Nodes of one radius: centre row, covering radius, first child (or first row of ``order``)."""

    centre: np.ndarray
    cover: np.ndarray
    first: np.ndarray


class CoverTree:
    """Nested levels over unit vectors; the last level's nodes hold runs of ``order``."""

    def __init__(self, vectors: np.ndarray, smallest: float):
        far = chord(vectors @ vectors.T)
        self.levels: list[Level] = []
        nodes, centres, radius = [np.arange(len(vectors))], [0], 2.0
        while True:
            cover = np.array([far[c, rows].max() for c, rows in zip(centres, nodes)])
            if radius <= smallest or not cover.any():
                break
            radius /= 2
            below, inner, first = [], [], [0]
            for c, rows in zip(centres, nodes):
                while len(rows):
                    near = far[c, rows] <= radius
                    below.append(rows[near])
                    inner.append(c)
                    rows = rows[~near]
                    c = rows[0] if len(rows) else c
                first.append(len(below))
            self.levels.append(Level(np.array(centres), cover, np.array(first)))
            nodes, centres = below, inner
        sizes = np.array([len(rows) for rows in nodes])
        self.levels.append(Level(np.array(centres), cover, np.r_[0, np.cumsum(sizes)]))
        self.order = np.concatenate(nodes)

    def level(self, i: int) -> Level:
        return self.levels[min(i, len(self.levels) - 1)]


def chord(cosines: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cosines, 0))


def _product(a: np.ndarray, b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of what nodes ``a`` and ``b`` hold, node pair by node pair."""
    n_a, n_b = first_a[a + 1] - first_a[a], first_b[b + 1] - first_b[b]
    n = n_a * n_b
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    wide = np.repeat(n_b, n)
    return np.repeat(first_a[a], n) + at // wide, np.repeat(first_b[b], n) + at % wide


def _own(level: Level) -> np.ndarray:
    return np.arange(len(level.centre) + 1)


def near_pairs(x: np.ndarray, y: np.ndarray | None, threshold: float, step: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of two sets of unit vectors with cosine at ``threshold`` or above, in bounded batches.

    Without ``y``: pairs of different rows of ``x``, each once.
    """
    reach = float(chord(np.float64(threshold))) + SLACK
    one = y is None
    tree_x = CoverTree(x, reach / 2)
    tree_y = tree_x if one else CoverTree(y, reach / 2)
    y = x if one else y
    cosines = x @ y.T
    depth = max(len(tree_x.levels), len(tree_y.levels))
    stack = [(0, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        i, a, b = stack.pop()
        level_x, level_y = tree_x.level(i), tree_y.level(i)
        away = chord(cosines[level_x.centre[a], level_y.centre[b]]) - level_x.cover[a] - level_y.cover[b]
        a, b = a[away <= reach], b[away <= reach]
        if len(a) == 0:
            continue
        last = i == depth - 1
        first_x = level_x.first if last or i < len(tree_x.levels) - 1 else _own(level_x)
        first_y = level_y.first if last or i < len(tree_y.levels) - 1 else _own(level_y)
        made = np.cumsum((first_x[a + 1] - first_x[a]) * (first_y[b + 1] - first_y[b]))
        cuts = np.unique(np.r_[0, np.searchsorted(made, np.arange(step, made[-1], step)), len(a)])
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            p, q = _product(a[lo:hi], b[lo:hi], first_x, first_y)
            if not last:
                if one:
                    p, q = p[p <= q], q[p <= q]
                stack.append((i + 1, p, q))
                continue
            p, q = tree_x.order[p], tree_y.order[q]
            if one:
                # a node met with itself gives each pair twice, two nodes give it once
                twice = np.repeat(a[lo:hi] == b[lo:hi], np.diff(np.r_[0, made])[lo:hi])
                p, q = p[~twice | (p < q)], q[~twice | (p < q)]
            hit = cosines[p, q] >= threshold
            yield p[hit], q[hit]


def search(node: np.ndarray, weight: np.ndarray, vectors: np.ndarray, side: np.ndarray | None, threshold: float) -> pd.DataFrame:
    """(node, n, other): linked vectors of each row within one task, and a link of the spanning forest."""
    count, root = np.zeros(len(node), np.int64), np.arange(len(node))
    rows_x = np.arange(len(node)) if side is None else np.flatnonzero(side == 0)
    rows_y = rows_x if side is None else np.flatnonzero(side == 1)
    if len(rows_x) and len(rows_y):
        for p, q in near_pairs(vectors[rows_x], None if side is None else vectors[rows_y], threshold):
            p, q = rows_x[p], rows_y[q]
            count += np.bincount(p, weight[q], len(node)).astype(np.int64) + np.bincount(q, weight[p], len(node)).astype(np.int64)
            unite(root, p, q)
    some = count > 0
    return pd.DataFrame({"node": node[some], "n": count[some], "other": node[root[some]]})


def unit(rows: list) -> np.ndarray:
    x = np.stack([np.asarray(r, np.float64) for r in rows])
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def near_duplicates(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    threshold: float = 0.93,
    block: int = 1024,
    pivots: int = 256,
) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``vectors``.

    * Linked: equal labels, equal lengths, cosine at ``threshold`` or above. A vector
      that is NULL, empty, zero, or holds NULL or a non-finite number, and a row whose
      label or vec_id is NULL, links with nothing (n_links 0, its own component).
    * n_links counts rows, copies of the vector among them, without itself.
    * component_id is the smallest vec_id reachable; rows that repeat a vec_id are
      vectors of their own. Other columns are ignored; an empty table gives an empty
      result.
    * ``block`` bounds the vectors of one side of a task, ``pivots`` the centres the
      cells of a label are formed around.
    """
    e = F.col("embedding")
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"), F.col(label).alias("label"))
    odd = F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    sound = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & ~odd & F.exists(e, lambda v: v != 0), F.lit(False))
    good = rows.filter(sound)
    folded = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight"))
    folded = materialize(folded.select("*", F.monotonically_increasing_id().alias("node"), F.size("embedding").alias("dim")), "vectors")

    parts = folded.groupBy("label", "dim").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    placed = attach(folded, parts, ["label", "dim"])
    centres = [np.asarray(r[0], np.float64) for r in folded.orderBy(F.xxhash64("node")).select("embedding").limit(pivots).collect()]
    centres = [c / np.linalg.norm(c / np.abs(c).max()) / np.abs(c).max() for c in centres]

    @F.pandas_udf("cell int, away double")
    def cell(v: pd.Series, parts: pd.Series) -> pd.DataFrame:
        found = np.zeros(len(v), np.int32), np.full(len(v), 2.0)
        sizes = v.map(len).to_numpy() if len(v) else np.zeros(0)
        for dim in np.unique(sizes):
            own, near = np.flatnonzero(sizes == dim), [c for c in centres if len(c) == dim]
            if near:
                far = chord(unit(v.iloc[own].tolist()) @ np.stack(near).T)
                far[np.arange(len(near))[None, :] >= parts.to_numpy()[own][:, None]] = np.inf
                found[0][own], found[1][own] = far.argmin(1), far.min(1)
        return pd.DataFrame({"cell": found[0], "away": found[1]})

    placed = materialize(placed.withColumn("c", cell("embedding", "parts")).select("label", "dim", "node", "weight", "embedding", "c.cell", "c.away"), "vectors")
    cells = placed.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("subs"), F.max("away").alias("cover"))
    cut = attach(placed, cells.select("label", "dim", "cell", "subs"), ["label", "dim", "cell"])
    cut = cut.withColumn("blk", F.col("cell").cast("long") * (1 << 32) + F.pmod(F.xxhash64("node"), F.col("subs")))

    blocks = cells.select("label", "dim", "cell", "cover", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"))
    blocks = blocks.select("label", "dim", "cell", "cover", (F.col("cell").cast("long") * (1 << 32) + F.col("sub")).alias("blk"))
    spread = vectors.sparkSession.createDataFrame(_between(centres), "dim int, cell_a int, cell_b int, between double")
    other = blocks.select("label", "dim", F.col("cell").alias("cell_b"), F.col("cover").alias("cover_b"), F.col("blk").alias("hi"))
    pairs = blocks.select("label", "dim", F.col("cell").alias("cell_a"), F.col("cover").alias("cover_a"), F.col("blk").alias("lo")).join(other, ["label", "dim"]).filter(F.col("lo") <= F.col("hi"))
    reach = float(chord(np.float64(threshold))) + SLACK
    pairs = pairs.join(F.broadcast(spread), ["dim", "cell_a", "cell_b"], "left").filter((F.coalesce("between", F.lit(0.0)) - F.col("cover_a") - F.col("cover_b")) <= reach)
    tasks = pairs.select("label", "dim", "lo", "hi", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("blk"))
    tasks = cut.select("label", "dim", "blk", "node", "weight", "embedding").join(tasks, ["label", "dim", "blk"])

    def link(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = key[2], key[3]
        pdf = pdf.sort_values("node")
        side = None if lo == hi else (pdf["blk"] == hi).to_numpy().astype(np.int8)
        return search(pdf["node"].to_numpy(), pdf["weight"].to_numpy(), unit(pdf["embedding"].tolist()), side, threshold)

    found = materialize(tasks.groupBy("label", "dim", "lo", "hi").applyInPandas(link, "node long, n long, other long"), "vectors")
    whole = components(found, "node", "other")
    named = folded.select("node", "first", "weight").join(whole, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    links = found.groupBy("node").agg(F.sum("n").alias("n"))
    named = named.join(least, "component").join(links, "node", "left")
    named = named.select("node", "component_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    named = folded.select("node", "label", "embedding").join(named, "node").drop("node")
    linked = good.join(named, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("*", (F.col("vec_id") == F.col("component_id")).alias("kept"))


def _between(centres: list[np.ndarray]) -> list[tuple[int, int, int, float]]:
    """Distances of the pivots, numbered among those of their length."""
    out = [(-1, 0, 0, 0.0)]
    for dim in sorted({len(c) for c in centres}):
        own = np.stack([c for c in centres if len(c) == dim])
        far = chord(own @ own.T)
        out += [(dim, i, j, float(far[i, j])) for i in range(len(own)) for j in range(len(own))]
    return out
