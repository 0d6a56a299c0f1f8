"""Exact nearest neighbours and the balancing operators built on them.

Equal vectors are folded into one first. The remaining distinct vectors are put
into cells around a few pivots; distance bounds then tell which cells can hold a
neighbour of a point, and only those are searched. A search works on one block of
points against one block of candidates and keeps ``k`` rows per point, so pairs
never become rows and a crowded cell is simply more blocks. Pairs of blocks are not stored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from packetloom.functions.dims import attach
from packetloom.functions.ordering import digest, digest_int, digest_unit, mark_quota, numbered, repeat_rows
from packetloom.functions.scratch import materialize
from packetloom.operators.hashed import Hashing, hashed_neighbours

_PIVOTS = 512
_BLOCK = 8_192
#: Points that are held against a block at once.
_QUERY_BLOCK = 1_024
_MAX_CELLS = 200_000
#: Tasks' shares of the blocks: one side in up to so many parts, the other in parts of so many blocks.
_MAX_PARTS = 256
_PART_BLOCKS = 16


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Plain difference form in slices: exact for equal and near points."""
    out = np.empty((len(a), len(b)))
    step = max(1, 4_000_000 // max(1, b.size))
    for i in range(0, len(a), step):
        d = a[i : i + step, None, :] - b[None, :, :]
        out[i : i + step] = np.sqrt(np.einsum("ijk,ijk->ij", d, d))
    return out


def _nearest_pairs(a: np.ndarray, b: np.ndarray, k: int, same: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``a``, row of ``b``, distance) of the ``k`` nearest of each row, by distance and place, none where ``same``.

    Matrix products in single precision give each squared distance with a bound on its
    error; what may be among the ``k`` nearest is measured in double precision.
    """
    centre = b.mean(0)
    a0, b0 = a - centre, b - centre
    na, nb = (np.einsum("ij,ij->i", x, x) for x in (a0, b0))
    top = max(na.max(), nb.max())
    if np.isfinite(top) and top < 1e30 and k < len(b):
        about = a0.astype(np.float32) @ (-2 * b0.astype(np.float32)).T
        about += na.astype(np.float32)[:, None]
        about += nb.astype(np.float32)
        about[same] = np.inf
        slack = 8 * (a.shape[1] + 8) * np.finfo(np.float32).eps * (na + nb.max()) + 1e-30
        kth = about.min(1) if k == 1 else np.partition(about, k - 1, axis=1)[:, k - 1]
        row, col = np.nonzero(about <= np.nextafter((kth + 2 * slack).astype(np.float32), np.float32(np.inf))[:, None])
    else:
        row, col = np.nonzero(~same)
    far = np.empty(len(row))
    step = max(1, 4_000_000 // max(1, a.shape[1]))
    for i in range(0, len(row), step):
        d = a[row[i : i + step]] - b[col[i : i + step]]
        far[i : i + step] = np.sqrt(np.einsum("ik,ik->i", d, d))
    fine = np.isfinite(far) & ~same[row, col]
    row, col, far = row[fine], col[fine], far[fine]
    order = np.lexsort((col, far, row))
    row, col, far = row[order], col[order], far[order]
    first = np.searchsorted(row, np.arange(len(a)))
    kept = np.arange(len(row)) - first[row] < k
    return row[kept], col[kept], far[kept]


def _few_of_each(row: np.ndarray, vid: np.ndarray, far: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` nearest found of each row, ties to the smaller id."""
    order = np.lexsort((vid, far, row))
    row, vid, far = row[order], vid[order], far[order]
    first = np.r_[0, np.flatnonzero(row[1:] != row[:-1]) + 1] if len(row) else np.zeros(0, int)
    kept = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)])) < k
    return row[kept], vid[kept], far[kept]


def _search(a: np.ndarray, aid: np.ndarray, b: np.ndarray, bid: np.ndarray, k: int, step: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Nearest ``k`` candidates ``b``, in the order of their ids, of each point, slice by slice."""
    found = []
    for i in range(0, len(a), step):
        row, col, far = _nearest_pairs(a[i : i + step], b, k, aid[i : i + step, None] == bid[None, :])
        found.append((row + i, bid[col], far))
    return found


def _search_group(k: int):
    """Nearest ``k`` other vectors of each vector of one small group."""
    step = _QUERY_BLOCK

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vid")
        v, vid = np.stack(rows["v"].to_numpy()), rows["vid"].to_numpy()
        row, near, far = (np.concatenate(x) for x in zip(*_search(v, vid, v, vid, k, step)))
        return pd.DataFrame({"g": rows["g"].iloc[0], "vid": vid[row], "nvid": near, "distance": far})

    return search


def _search_blocks(k: int):
    """Nearest ``k`` of each point of a block (q) among those of the blocks (c) it is paired with, for pairs that come block by block."""
    step = _QUERY_BLOCK

    def told(g: str, ids: np.ndarray, best) -> pa.RecordBatch:
        row, near, far = best
        return pa.RecordBatch.from_pydict({"g": pa.array([g] * len(row), pa.string()), "vid": ids[row], "nvid": near, "distance": far})

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, g, ids, best = None, None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                read = lambda c, kind: np.frombuffer(batch[c][i].as_buffer(), kind)  # noqa: E731, B023
                if batch["q"][i].as_py() != last:
                    if best is not None:
                        yield told(g, ids, best)
                    last, g = batch["q"][i].as_py(), batch["g"][i].as_py()
                    ids = read("q_ids", np.int64).copy()
                    points = read("q_v", np.float64).reshape(len(ids), -1).copy()
                    asks = read("q_asks", np.uint8).reshape(len(ids), -1).copy()
                    best = (np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0))
                bid, at = read("c_ids", np.int64), read("c_at", np.int32)
                b = read("c_v", np.float64).reshape(len(bid), -1)
                found = [best]
                for cell in np.unique(at):  # candidates stand cell by cell
                    mine = np.flatnonzero(asks[:, cell >> 3] & (1 << (cell & 7)))
                    lo, hi = np.searchsorted(at, [cell, cell + 1])
                    found += [(mine[row], near, far) for row, near, far in _search(points[mine], ids[mine], b[lo:hi], bid[lo:hi], k, step)]
                best = _few_of_each(*(np.concatenate(x) for x in zip(*found)), k)
        if best is not None:
            yield told(g, ids, best)

    return search


def _vector_neighbours(vecs: DataFrame, k: int) -> DataFrame:
    """(g, vid, nvid, distance): the ``k`` nearest other distinct vectors of a group.

    Groups of up to ``_BLOCK`` vectors are searched whole. The vectors of larger ones are
    packed into blocks; pairs of blocks are made where they are searched and stored
    nowhere, so what moves and lies on disk grows with the vectors, not with the pairs.
    """
    spark = vecs.sparkSession
    large = vecs.groupBy("g").agg(F.count("*").alias("n")).filter(F.col("n") > _BLOCK).collect()
    out = "g string, vid bigint, nvid bigint, distance double"
    if not large:
        return vecs.groupBy("g").applyInPandas(_search_group(k), out)
    names = spark.createDataFrame([(r["g"],) for r in large], "g string")
    small = attach(vecs, names, ["g"], "left_anti").groupBy("g").applyInPandas(_search_group(k), out)
    vecs = attach(vecs, names, ["g"], "left_semi")
    n_pivots = max(1, min(_PIVOTS, sum(r["n"] for r in large) // _BLOCK, _MAX_CELLS // len(large)))
    found = vecs.orderBy(F.md5(F.col("vid").cast("string"))).select("g", "vid", "v").limit(n_pivots).collect()
    pivots = spark.sparkContext.broadcast(np.array([r["v"] for r in found], dtype="float64"))
    pivot_group, pivot_id = np.array([r["g"] for r in found]), np.array([r["vid"] for r in found])

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                d = _distances(np.stack(pdf["v"].to_numpy()), pivots.value)
                cell = d.argmin(axis=1)
                yield pdf.assign(cell=cell.astype("int32"), r=d[np.arange(len(d)), cell])

    placed = materialize(
        vecs.select("g", "vid", "v").mapInPandas(assign, "g string, vid bigint, v array<double>, cell int, r double"), "cells"
    )
    stats = placed.groupBy("g", "cell").agg(F.count("*").alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi"))
    table: dict[str, pd.DataFrame] = {g: t.sort_values("cell") for g, t in sorted(stats.toPandas().groupby("g"))}
    # the cells of a group one after the other, cut into blocks; cells have numbers of their own over all groups
    known, where, blocks, places = {}, [], 0, 0
    for g, t in table.items():
        cell, n, lo, hi = (t[c].to_numpy() for c in ("cell", "n", "lo", "hi"))
        known[g] = (cell, n, lo, hi, places)
        where += [(g, int(c), i, int(m), int(before), blocks) for i, (c, m, before) in enumerate(zip(cell, n, np.cumsum(n) - n))]
        blocks, places = blocks + int(-(-n.sum() // _BLOCK)), places + len(cell)
    cells = spark.sparkContext.broadcast(known)

    def asked(g: str, v: np.ndarray, vid: np.ndarray) -> np.ndarray:
        """Which cells of the group may hold one of the ``k`` nearest of each point."""
        cell, n, lo, hi, _ = cells.value[g]
        mine = pivot_group == g
        out = np.empty((len(v), len(cell)), bool)
        step = max(1, 50_000 // len(cell))
        for i in range(0, len(v), step):
            every = _distances(v[i : i + step], pivots.value)
            d = every[:, cell]
            # at least k others lie this near: by the cells' extents, or among the pivots
            upper = d + hi
            order = np.argsort(upper, axis=1)
            enough = np.cumsum(n[order], axis=1) >= k + 1
            at = enough.argmax(axis=1)
            bound = np.take_along_axis(np.take_along_axis(upper, order, 1), at[:, None], 1)[:, 0]
            bound = np.where(enough.any(axis=1), bound, np.inf)
            if mine.sum() > k:
                others = np.where(vid[i : i + step, None] == pivot_id[mine], np.inf, every[:, mine])
                bound = np.minimum(bound, np.partition(others, k - 1, axis=1)[:, k - 1])
            bound = bound * (1 + 1e-9) + 1e-9
            out[i : i + step] = np.maximum(np.maximum(d - hi, lo - d), 0.0) <= bound[:, None]
        return out

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["at", "vid"])
        g, v, vid, at = rows["g"].iloc[0], np.stack(rows["v"].to_numpy()), rows["vid"].to_numpy(), rows["at"].to_numpy()
        asks, first = asked(g, v, vid), cells.value[g][4]
        bits = np.packbits(asks, axis=1, bitorder="little")
        return pd.DataFrame({
            "q": [rows["blk"].iloc[0]], "g": [g], "ids": [vid.astype(np.int64).tobytes()], "v": [v.astype(np.float64).tobytes()], "at": [at.astype(np.int32).tobytes()],
            "asks": [bits.tobytes()], "visits": [first + np.flatnonzero(asks.any(axis=0))], "holds": [first + np.unique(at)],
        })

    parts = spark.createDataFrame(where, "g string, cell int, at int, n bigint, before bigint, base bigint")
    dealt = attach(placed, parts, ["g", "cell"], max_rows=_MAX_CELLS)
    block = F.col("base") + F.expr(f"(before + pmod(xxhash64(vid), n)) div {_BLOCK}")
    packed = dealt.select(block.alias("blk"), "g", "vid", "v", "at").groupBy("blk").applyInPandas(
        pack, "q bigint, g string, ids binary, v binary, at binary, asks binary, visits array<bigint>, holds array<bigint>"
    )
    packed = materialize(packed, "blocks")
    points = packed.select("q", "g", "visits", *[F.col(c).alias(f"q_{c}") for c in ("ids", "v", "asks")]).repartition(min(blocks, _MAX_PARTS))
    others = packed.select("holds", *[F.col(c).alias(f"c_{c}") for c in ("ids", "v", "at")]).repartition(-(-blocks // _PART_BLOCKS))
    pairs = points.join(others, F.arrays_overlap("visits", "holds")).drop("visits", "holds")
    hits = small.unionByName(pairs.mapInArrow(_search_blocks(k), out))
    w = W.partitionBy("g", "vid").orderBy("distance", "nvid")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("rank")


def nearest(df: DataFrame, id_col: str, vector: str, k: int, by: str | None = None, hashing: Hashing | None = None) -> DataFrame:
    """The ``k`` nearest other rows of each row, Euclidean, ties to the smaller id.

    ``by`` searches inside the row's own class. Exact, or with ``hashing`` among those
    that share a bucket in one of its tables: work then grows with the rows, not with
    their square, and some neighbours are missed (see ``hashed.recall``). Columns: id,
    (by,) rank, neighbour, distance.
    """
    group = F.col(by).cast("string") if by else F.lit("all")
    points = df.select(
        F.col(id_col).cast("bigint").alias("id"), group.alias("g"), F.col(vector).cast("array<double>").alias("v")
    ).filter(F.col("g").isNotNull() & F.col("v").isNotNull())
    # the first k + 1 copies of a vector are all that any neighbour list can need
    copies = W.partitionBy("g", "v").orderBy("id")
    firsts = points.withColumn("__rn", F.row_number().over(copies)).filter(F.col("__rn") <= k + 1)
    vecs = materialize(
        firsts.groupBy("g", "v").agg(F.min("id").alias("vid"), F.sort_array(F.collect_list("id")).alias("ids")), "vectors"
    )
    near = hashed_neighbours(vecs, k, hashing) if hashing else _vector_neighbours(vecs, k)
    ids = vecs.select("g", F.col("vid").alias("nvid"), "ids")
    own = vecs.select("g", "vid", F.lit(0.0).alias("distance"), F.explode("ids").alias("neighbour"))
    others = near.join(ids, ["g", "nvid"]).select("g", "vid", "distance", F.explode("ids").alias("neighbour"))
    lists = (
        own.unionByName(others)
        .groupBy("g", "vid")
        .agg(F.slice(F.sort_array(F.collect_list(F.struct("distance", "neighbour"))), 1, k + 1).alias("near"))
    )
    lists = vecs.select("g", "v", "vid").join(lists, ["g", "vid"]).drop("vid")
    ranked = points.join(lists, ["g", "v"]).select(
        "id", "g", F.posexplode(F.slice(F.filter("near", lambda x: x["neighbour"] != F.col("id")), 1, k))
    )
    out = [F.col("id").alias(id_col)]
    if by:
        out.append(F.col("g").cast(df.schema[by].dataType).alias(by))
    return ranked.select(*out, (F.col("pos") + 1).alias("rank"), F.col("col.neighbour").alias("neighbour"), F.col("col.distance").alias("distance"))


def oversample(
    df: DataFrame, id_col: str, vector: str, label: str, targets: dict, k: int = 3, seed: int = 42, hashing: Hashing | None = None
) -> DataFrame:
    """Synthetic rows that bring each listed class up to its target size.

    Every row of the class is a base equally often (the remainder is drawn); a
    synthetic point lies between its base and one of the base's ``k`` nearest
    neighbours of the class. Choice and position follow from digests. Classes that
    have their size already get no row.
    Columns: label, base id, copy number, neighbour id, u, vector.
    """
    classes = df.filter(F.col(label).isin(list(targets)))
    counts = {r[label]: r["n"] for r in classes.groupBy(label).agg(F.count("*").alias("n")).collect()}
    wanted = {c: targets[c] - n for c, n in counts.items() if targets[c] > n}
    if not wanted:
        kind = df.schema[label].dataType.simpleString()
        return df.sparkSession.createDataFrame([], f"`{label}` {kind}, base bigint, copy bigint, neighbour bigint, u double, `{vector}` array<double>")
    part = df.filter(F.col(label).isin(list(wanted))).select(
        F.col(id_col).cast("bigint").alias("id"), label, F.col(vector).cast("array<double>").alias("v")
    )
    per = df.sparkSession.createDataFrame(
        [(c, m // counts[c], m % counts[c]) for c, m in wanted.items()],
        f"{label} {df.schema[label].dataType.simpleString()}, each bigint, rest bigint",
    )
    sized = attach(part, per, [label])
    drawn = mark_quota(sized, [label, "rest"], lambda n, _: F.col("rest"), ["id"], seed, "drawn")
    base = repeat_rows(
        drawn.withColumn("times", F.col("each") + F.col("drawn").cast("bigint")).select("id", label, "v", "times"), "times", "copy"
    ).drop("times")
    near = nearest(part, "id", "v", k, label, hashing).select("id", "rank", "neighbour")
    lists = near.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "neighbour"))).alias("near"))  # at most k
    tag = F.concat_ws(":", "id", "copy", F.lit(seed))
    picked = (
        base.join(lists, "id", "left")
        .withColumn("near", F.coalesce("near", F.array(F.struct(F.lit(1).alias("rank"), F.col("id").alias("neighbour")))))
        .withColumn("at", digest_int(F.concat(tag, F.lit(":n")), F.size("near")))
        .withColumn("neighbour", F.get(F.col("near"), F.col("at").cast("int"))["neighbour"])
        .withColumn("u", digest_unit(F.concat(tag, F.lit(":u"))))
        .drop("near", "at")
    )
    ends = part.select(F.col("id").alias("neighbour"), F.col("v").alias("nv"))
    mixed = F.expr("transform(arrays_zip(v, nv), p -> p.v + u * (p.nv - p.v))")
    return picked.join(ends, "neighbour").select(
        label, F.col("id").alias("base"), "copy", "neighbour", "u", mixed.alias(vector)
    )


def tomek_links(df: DataFrame, id_col: str, vector: str, label: str, hashing: Hashing | None = None) -> DataFrame:
    """Pairs of rows of different class that are each other's nearest neighbour."""
    near = nearest(df, id_col, vector, 1, hashing=hashing)
    labels = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(label).alias("lab"))
    one = near.select(F.col(id_col).alias("id"), "neighbour", "distance").join(labels, "id")
    other = one.select(F.col("id").alias("neighbour"), F.col("neighbour").alias("id"), F.col("lab").alias("other_lab"))
    return one.join(other, ["id", "neighbour"]).filter((F.col("lab") != F.col("other_lab")) & (F.col("id") < F.col("neighbour"))).select(
        F.col("id").alias("first"), F.col("neighbour").alias("second"), F.col("lab").alias("first_label"), F.col("other_lab").alias("second_label"), "distance"
    )


def drop_tomek(df: DataFrame, id_col: str, vector: str, label: str, hashing: Hashing | None = None) -> DataFrame:
    """Rows that are in no such pair."""
    links = tomek_links(df, id_col, vector, label, hashing)
    ends = links.select(F.explode(F.array("first", "second")).alias("__end"))
    return df.join(ends, df[id_col] == ends["__end"], "left_anti")


def oversample_and_clean(df: DataFrame, id_col: str, vector: str, label: str, k: int = 5, seed: int = 42, hashing: Hashing | None = None) -> DataFrame:
    """Every class raised to the size of the largest, then linked pairs removed.

    Synthetic rows are numbered downwards from below the smallest id (and below 0).
    """
    sizes = {r[label]: r["n"] for r in df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n")).collect()}
    top = max(sizes.values(), default=0)
    rows = df.select(F.col(id_col).cast("bigint").alias(id_col), F.col(vector).cast("array<double>").alias(vector), label)
    small = {c: top for c, n in sizes.items() if n < top}
    if small:
        extra = materialize(oversample(df, id_col, vector, label, small, k, seed, hashing), "synthetic")
        low = min(0, rows.agg(F.min(id_col)).first()[0] or 0)
        extra = numbered(extra, digest(["base", "copy"], seed), ["base", "copy"], "__no")
        rows = rows.unionByName(extra.select((F.lit(low) - 1 - F.col("__no")).cast("bigint").alias(id_col), vector, label))
    return drop_tomek(materialize(rows, "balanced"), id_col, vector, label, hashing)
