"""Approximate nearest neighbours by hashed buckets, for more vectors than exact search can visit.

Each of several tables cuts space by its own random projections, along the
differences of sampled vectors and at the median of the sample. The sides a vector
falls on are its code, and vectors with an equal beginning of the code share a bucket.
A bucket above the bound takes more of the code, so dense regions are cut finer and
no bucket grows with the data. All vectors of a bucket are compared, the best of all
tables are ranked by exact distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from packetloom.functions.dims import attach
from packetloom.functions.scratch import materialize


class Hashing(NamedTuple):
    """How many tables, vectors in a bucket at most, and vectors the projections are drawn from."""

    tables: int = 16
    bucket: int = 1024
    sample: int = 4096
    seed: int = 42


_BITS = 48


def _planes(vecs: DataFrame, h: Hashing) -> tuple[np.ndarray, np.ndarray]:
    """Directions (tables, bits, dim) and cuts (tables, bits) out of a bounded sample."""
    rows = vecs.orderBy(F.xxhash64(F.lit(h.seed), "vid")).select("v").limit(h.sample).toArrow()["v"].to_pylist()
    known = np.array(rows, "float64")
    rng = np.random.default_rng(h.seed)
    ends = rng.integers(0, len(known), (2, h.tables * _BITS))
    ways = known[ends[0]] - known[ends[1]] + 1e-9 * rng.normal(size=(h.tables * _BITS, known.shape[1]))
    cuts = np.array([np.median(known @ w) for w in ways])
    return ways.reshape(h.tables, _BITS, -1), cuts.reshape(h.tables, _BITS)


def _coded(vecs: DataFrame, h: Hashing) -> DataFrame:
    """(g, vid, t, code): the code of each vector in each table."""
    shared = vecs.sparkSession.sparkContext.broadcast(_planes(vecs, h))

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ways, cuts = shared.value
        powers = 1 << np.arange(_BITS - 1, -1, -1, dtype=np.int64)
        for pdf in batches:
            if len(pdf):
                v = np.stack(pdf["v"].to_numpy())
                codes = np.stack([(v @ w.T > c).astype(np.int64) @ powers for w, c in zip(ways, cuts)], axis=1)
                yield pd.DataFrame({"g": np.repeat(pdf["g"].to_numpy(), h.tables), "vid": np.repeat(pdf["vid"].to_numpy(), h.tables), "t": np.tile(np.arange(h.tables, dtype="int32"), len(pdf)), "code": codes.ravel()})

    return vecs.select("g", "vid", "v").mapInPandas(code, "g string, vid bigint, t int, code bigint")


def buckets(vecs: DataFrame, h: Hashing) -> DataFrame:
    """(g, vid, t, bits, prefix, part): the bucket of each vector (g, vid, v) in each table, none above ``h.bucket``."""
    rows = materialize(_coded(vecs, h).withColumn("bits", F.lit(0)), "codes")
    key = ["g", "t", "bits", "prefix"]
    prefix = F.expr(f"shiftright(code, {_BITS} - bits)")
    while True:
        rows = rows.withColumn("prefix", prefix)
        counts = rows.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > h.bucket)
        heavy = materialize(counts, "heavy")
        if heavy.filter(F.col("bits") < _BITS).isEmpty():
            break
        more = heavy.select(*key, F.greatest(F.lit(1), F.ceil(F.log2(F.col("n") / h.bucket))).cast("int").alias("more"))
        rows = attach(rows, more, key, "left").withColumn("bits", F.least(F.lit(_BITS), F.col("bits") + F.coalesce("more", F.lit(0)))).drop("more", "prefix")
        rows = materialize(rows, "codes")
    # what no projection tells apart is dealt into parts
    parts = heavy.select(*key, F.ceil(F.col("n") / h.bucket).cast("int").alias("parts"))
    dealt = attach(rows, parts, key, "left").withColumn("part", F.pmod(F.xxhash64("vid"), F.coalesce("parts", F.lit(1))))
    return dealt.select("g", "vid", "t", "bits", "prefix", "part")


def _compare(k: int):
    """The ``k`` nearest of each vector of one bucket: picked by products, measured by differences."""
    names = ["g", "vid", "nvid", "distance"]

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        vid = pdf["vid"].to_numpy()
        if len(vid) < 2:
            return pd.DataFrame({c: [] for c in names}).astype({"g": "str", "vid": "int64", "nvid": "int64", "distance": "float64"})
        v = np.stack(pdf["v"].to_numpy())
        squares = np.einsum("ij,ij->i", v, v)
        few = min(len(vid) - 1, k + 4)
        near = np.empty((len(vid), few), np.int64)
        for i in range(0, len(vid), 2048):
            d = squares - 2 * v[i : i + 2048] @ v.T
            d[np.arange(len(d)), i + np.arange(len(d))] = np.inf
            near[i : i + 2048] = np.argpartition(d, few - 1, axis=1)[:, :few]
        gap = v[:, None, :] - v[near]
        distance = np.sqrt(np.einsum("ijk,ijk->ij", gap, gap))
        order = np.lexsort((vid[near], distance), axis=1)[:, :k]
        rows = np.arange(len(vid))[:, None]
        return pd.DataFrame({"g": pdf["g"].iloc[0], "vid": np.repeat(vid, order.shape[1]), "nvid": vid[near[rows, order]].ravel(), "distance": distance[rows, order].ravel()})

    return compare


def hashed_neighbours(vecs: DataFrame, k: int, h: Hashing) -> DataFrame:
    """(g, vid, nvid, distance): near to the ``k`` nearest other vectors of each (g, vid, v); distances are exact."""
    if vecs.isEmpty():
        return vecs.select("g", "vid", F.col("vid").alias("nvid"), F.lit(0.0).alias("distance")).filter(F.lit(False))
    placed = buckets(vecs, h).join(vecs.select("g", "vid", "v"), ["g", "vid"])
    hits = placed.groupBy("g", "t", "bits", "prefix", "part").applyInPandas(_compare(k), "g string, vid bigint, nvid bigint, distance double")
    once = hits.groupBy("g", "vid", "nvid").agg(F.min("distance").alias("distance"))
    w = W.partitionBy("g", "vid").orderBy("distance", "nvid")
    return once.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("rank")


def recall(found: DataFrame, exact: DataFrame, key: list[str]) -> DataFrame:
    """(recall): the share of the exact neighbour rows whose distance the found list of the same rank reaches.

    Both hold ``key``, rank and distance. Compared by distance, so equally near neighbours count.
    """
    told = exact.join(found.select(*key, "rank", F.col("distance").alias("got")), [*key, "rank"], "left")
    return told.agg(F.avg(F.coalesce((F.col("got") <= F.col("distance") * (1 + 1e-9)).cast("int"), F.lit(0))).alias("recall"))
