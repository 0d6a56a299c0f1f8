"""SimHash near-duplicates by a Gray-order hierarchical index.

A text's words are lower-cased (A-Z), cut into shingles and hashed; a bit of the
fingerprint is the majority of that bit over the shingles' hashes. Fingerprints
within ``radius`` bits are linked.

The index sorts fingerprints by Gray rank, so that neighbours share long masked bit
patterns, and keeps in each upper node the bits all fingerprints below it share.
Two nodes whose shared bits differ in more than ``radius`` places are dropped with
all that is below them. The top level is what Spark partitions by: the index is
kept in ``radius + 1`` Gray orders, each led by another segment of the fingerprint,
and fingerprints within ``radius`` bits agree on the whole leading segment of at
least one of them. So each pair meets below one top node, and the top nodes are
searched apart from one another, in as many tasks as there are.

A top node above ``block`` fingerprints is cut into hashed blocks and searched
block against block. Links inside a search come back as a spanning forest, and
node pairs already in one tree are skipped, so that near copies of one text cost
rows, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.dims import attach
from packetloom.functions.scratch import materialize
from packetloom.llm.components import components

LEAF, FAN = 16, 8


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """64-bit SimHash of a UTF-8 text; 0 without words. Whole text, repeats included."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(p, 42) for p in parts), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        block = hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little", signed=True)


def fingerprints(text: Column, shingle: int = 4) -> Column:
    """Fingerprint of a text column as a signed bigint; NULL and empty texts give 0."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return of(text.cast("binary"))


# ---------------------------------------------------------------- the index in one task


def _levels(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(shared mask, pattern) of each node, leaves first, of fingerprints in Gray order."""
    ones = np.bitwise_and.reduceat(fps, np.arange(0, len(fps), LEAF))
    some = np.bitwise_or.reduceat(fps, np.arange(0, len(fps), LEAF))
    out = [(~(ones ^ some), ones)]
    while len(ones) > 1:
        at = np.arange(0, len(ones), FAN)
        ones, some = np.bitwise_and.reduceat(ones, at), np.bitwise_or.reduceat(some, at)
        out.append((~(ones ^ some), ones))
    return out


def _children(nodes: np.ndarray, other: np.ndarray, fan_a: int, fan_b: int, n_a: int, n_b: int) -> tuple[np.ndarray, np.ndarray]:
    a = (nodes[:, None, None] * fan_a + np.arange(fan_a)[None, :, None]).repeat(fan_b, 2).ravel()
    b = (other[:, None, None] * fan_b + np.arange(fan_b)[None, None, :]).repeat(fan_a, 1).ravel()
    keep = (a < n_a) & (b < n_b)
    return a[keep], b[keep]


def unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of the pairs in a forest of smallest members, in place."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root[:] = up


def search(fps: np.ndarray, side: np.ndarray | None, radius: int, step: int = 1024) -> np.ndarray:
    """Row number of the smallest row linked to each row, for fingerprints of one top node in Gray order.

    With ``side`` (0 and 1) only pairs across the sides are looked for.
    """
    root = np.arange(len(fps))
    parts = [root] if side is None else [np.flatnonzero(side == 0), np.flatnonzero(side == 1)]
    if not all(len(p) for p in parts):
        return root
    trees = [_levels(fps[p]) for p in parts]
    one = side is None
    rows_a, rows_b = parts[0], parts[-1]
    tree_a, tree_b = trees[0], trees[-1]
    depth_a, depth_b = len(tree_a) - 1, len(tree_b) - 1
    stack = [(depth_a, depth_b, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        la, lb, a, b = stack.pop()
        if len(a) > step:
            stack += [(la, lb, a[i : i + step], b[i : i + step]) for i in range(0, len(a), step)]
            continue
        (mask_a, bits_a), (mask_b, bits_b) = tree_a[la], tree_b[lb]
        near = np.bitwise_count((bits_a[a] ^ bits_b[b]) & mask_a[a] & mask_b[b]) <= radius
        a, b = a[near], b[near]
        if la or lb:
            down_a, down_b = la > 0 and la >= lb, lb > 0 and lb >= la
            la, lb = la - down_a, lb - down_b
            a, b = _children(a, b, FAN if down_a else 1, FAN if down_b else 1, len(tree_a[la][0]), len(tree_b[lb][0]))
            if one:
                a, b = a[a <= b], b[a <= b]
            if len(a):
                stack.append((la, lb, a, b))
            continue
        if len(a) == 0:
            continue
        # leaves in one tree of the forest have nothing to add
        low_a, high_a = _root_range(root[rows_a], a)
        low_b, high_b = _root_range(root[rows_b], b)
        new = ~((low_a == high_a) & (low_b == high_b) & (low_a == low_b))
        i, j = _children(a[new], b[new], LEAF, LEAF, len(rows_a), len(rows_b))
        if one:
            i, j = i[i < j], j[i < j]
        i, j = rows_a[i], rows_b[j]
        hit = np.bitwise_count(fps[i] ^ fps[j]) <= radius
        unite(root, i[hit], j[hit])
    return root


def _root_range(root: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(0, len(root), LEAF)
    return np.minimum.reduceat(root, at)[leaf], np.maximum.reduceat(root, at)[leaf]


def _small(fps: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked row pairs of many groups that are single leaves, all groups at once."""
    left, right = [], []
    for shift in range(1, LEAF):
        same = np.flatnonzero(group[shift:] == group[:-shift])
        if len(same) == 0:
            break
        hit = same[np.bitwise_count(fps[same] ^ fps[same + shift]) <= radius]
        left.append(hit)
        right.append(hit + shift)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _search_groups(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links of sorted rows (node, lo, hi, blk, fp, id); holds one open group at a time."""

    def done(rows: list[np.ndarray]) -> pa.RecordBatch:
        node, lo, hi, blk, fp, ident = rows
        fp = fp.view(np.uint64)
        new = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]) if len(node) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[new, len(node)])
        group = np.repeat(np.arange(len(new)), sizes)
        plain = (sizes <= LEAF) & (lo[new] == hi[new])
        rest = np.flatnonzero(plain[group])
        i, j = _small(fp[rest], group[rest], radius)
        ends = [(ident[rest[i]], ident[rest[j]])]
        for g in np.flatnonzero(~plain):
            own = slice(new[g], new[g] + sizes[g])
            side = None if lo[new[g]] == hi[new[g]] else (blk[own] == hi[new[g]]).astype(np.int8)
            root = search(fp[own], side, radius)
            child = np.flatnonzero(root != np.arange(len(root)))
            ends.append((ident[own][child], ident[own][root[child]]))
        return pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*ends)], names=["a", "b"])

    names, held = ["node", "lo", "hi", "blk", "fp", "id"], None
    for batch in batches:
        rows = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
        rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows)]
        if len(rows[0]) == 0:
            continue
        same = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1]) & (rows[2] == rows[2][-1])
        cut = int(np.argmax(same))  # rows are sorted: the open group is what follows
        held = [x[cut:] for x in rows]
        if cut:
            yield done([x[:cut] for x in rows])
    if held is not None:
        yield done(held)


# ---------------------------------------------------------------- the index on the cluster


def _gray_rank(code: Column) -> Column:
    for k in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, k))
    return code


def near_links(prints: DataFrame, fp: str, ident: str, radius: int = 4, block: int = 8192) -> DataFrame:
    """(a, b): links that join all fingerprints within ``radius`` bits of one another.

    ``prints`` holds each fingerprint once, with a number to name it. The links are
    enough to connect what is linked; not every pair is written.
    """
    width = [64 // (radius + 1) + (i < 64 % (radius + 1)) for i in range(radius + 1)]
    orders = []
    for i, w in enumerate(width):
        at = sum(width[:i])
        turned = F.shiftleft(F.col("fp"), at).bitwiseOR(F.shiftrightunsigned(F.col("fp"), 64 - at)) if at else F.col("fp")
        orders.append(F.struct((F.shiftrightunsigned(turned, 64 - w) * (radius + 1) + i).alias("node"), _gray_rank(turned).alias("rank")))
    rows = prints.select(F.col(fp).alias("fp"), F.col(ident).cast("long").alias("id")).withColumn("o", F.explode(F.array(*orders))).select("o.node", "o.rank", "fp", "id")
    large = rows.groupBy("node").count().filter(F.col("count") > block).select("node", F.ceil(F.col("count") / block).cast("int").alias("parts"))
    rows = attach(rows, large, ["node"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("blk", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("node", F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi"), "blk", "rank", "fp", "id")
    rows = rows.repartition("node", "lo", "hi").sortWithinPartitions("node", "lo", "hi", "rank")
    return rows.mapInArrow(lambda batches: _search_groups(batches, radius), "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """``doc_id``, fingerprint (16 hex digits) and component_id of every row of ``docs``.

    * A NULL or empty text has fingerprint 0 and is linked like any other.
    * component_id is the smallest ``doc_id`` reachable; rows that repeat a
      ``doc_id`` count as one document. A NULL ``doc_id`` links nothing and is no
      component's name: such a row gets the component of its fingerprint, or NULL.
    * Equal fingerprints are folded before the search, so exact copies of a text
      cost one row. An empty table gives an empty result. Other columns are ignored.
    """
    prints = materialize(docs.select(F.col(doc_id).alias("doc_id"), fingerprints(F.col(text), shingle).alias("fp")), "fingerprints")
    unique = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    named = unique.filter(F.col("first").isNotNull())
    again = prints.select("fp", F.col("doc_id").alias("b")).join(unique, "fp").filter(F.col("first") != F.col("b")).select(F.col("first").alias("a"), "b")
    # a repeated doc_id with unlike texts ties its fingerprints together
    repeated = prints.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter(F.col("low") != F.col("high")).select(F.col("doc_id").alias("b"))
    again = again.join(repeated, "b", "left_semi").select("a", "b")
    whole = components(near_links(named, "fp", "first", radius).unionByName(again), "a", "b")
    of = unique.join(whole, unique["first"] == whole["node"], "left").select("fp", F.coalesce("component", "first").alias("component_id"))
    return prints.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
