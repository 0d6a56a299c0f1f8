"""Lines that several documents hold, by sharded minimal perfect hashes.

A line's key is the line without blanks at its ends, A-Z lower-cased, hashed to 96
bits: ``h`` (64) and ``f`` (32). The distinct keys are dealt into shards by ``h``. Each
shard is one row of the index: a minimal perfect hash that numbers its keys without
gaps, and arrays by that number - the fingerprint ``f``, a count that stops at 2, and
for keys of two documents or more the smallest doc_id. Documents send their keys to
the shard's arrays and get back which of them they lose; lines are never joined with
lines.

A shard met by more keys than others (a line in a third of all documents) is copied,
and its probes are dealt over the copies by doc_id. Shards grow in number with the
keys, not in size.
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

#: Distinct keys of one shard, about.
PER_SHARD = 1 << 18
#: Shortest key that is looked at, in code points.
LEAST = 10
BLANKS = b" \t\n\x0b\x0c\r"
_KEY = np.dtype([("h", "<i8"), ("f", "<i4")])
_INDEX = "shard long, seed long, sizes binary, bits binary, prints binary, counts binary, firsts binary"


def line_key(line: bytes, least: int = LEAST) -> bytes | None:
    """The 12 bytes that name a UTF-8 line, None if its key is too short."""
    key = line.strip(BLANKS).lower()
    if len(key) < least or (len(key) < 4 * least and sum(b & 0xC0 != 0x80 for b in key) < least):
        return None
    return xxhash.xxh3_128_digest(key)[:12]


# ---------------------------------------------------------------- minimal perfect hash


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _blend(h: np.ndarray, f: np.ndarray, seed: int) -> np.ndarray:
    return _mix(h.astype(np.int64).view(np.uint64) + np.uint64(seed)) ^ _mix(f.astype(np.int64).view(np.uint64) * np.uint64(2 * seed + 1) + np.uint64(1))


def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return _mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % np.uint64(size)


class MinimalHash:
    """Numbers 0 to n - 1 for n distinct (h, f), in about four bits a key.

    A key is set in the first level where no other key left shares its place; its
    number is the rank of that bit. Each level has two places for a key left over.
    """

    def __init__(self, seed: int, sizes: np.ndarray, bits: np.ndarray):
        self.seed, self.sizes, self.bits = seed, sizes, bits
        self.starts = np.cumsum(sizes // 64) - sizes // 64
        self.ranks = np.cumsum(np.bitwise_count(bits), dtype=np.int64) - np.bitwise_count(bits)

    @classmethod
    def build(cls, h: np.ndarray, f: np.ndarray) -> MinimalHash:
        seed = 0
        while len(np.unique(left := _blend(h, f, seed))) < len(left):
            seed += 1
        sizes, bits = [], []
        while len(left):
            size = -(-2 * len(left) // 64) * 64
            at = _places(left, len(sizes), size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            bits.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[~alone[at]]
        return cls(seed, np.array(sizes, np.int64), np.concatenate([np.zeros(0, "<u8"), *bits]))

    def number(self, h: np.ndarray, f: np.ndarray) -> np.ndarray:
        """Number of each key; -1 for some that are not in the set, any number for others."""
        out = np.full(len(h), -1, np.int64)
        left, keys = np.arange(len(h)), _blend(h, f, self.seed)
        for level, (size, start) in enumerate(zip(self.sizes, self.starts)):
            at = _places(keys, level, size)
            word, bit = start + (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            found = (self.bits[word] >> bit) & np.uint64(1) == 1
            below = self.bits[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[found]] = (self.ranks[word] + np.bitwise_count(below))[found]
            left, keys = left[~found], keys[~found]
        return out


# ---------------------------------------------------------------- the index on the cluster


def _entries(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, h, f) of each distinct key of each text."""
    for batch in batches:
        ids, keys = [], []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            found = {line_key(line, least) for line in text.split(b"\n")} if text else set()
            found.discard(None)
            keys += found
            ids.append(np.full(len(found), doc, np.int64))
        flat = np.frombuffer(b"".join(keys), _KEY)
        yield pa.record_batch([pa.array(np.concatenate([np.zeros(0, np.int64), *ids])), pa.array(flat["h"].copy()), pa.array(flat["f"].copy())], names=["doc_id", "h", "f"])


def _build(keys: pd.DataFrame) -> pd.DataFrame:
    h, f = keys["h"].to_numpy(), keys["f"].to_numpy()
    hashed = MinimalHash.build(h, f)
    order = np.argsort(hashed.number(h, f))
    several = (keys["low"] != keys["high"]).to_numpy()[order]
    firsts = keys["low"].to_numpy()[order][several]
    row = [keys["shard"].iloc[0], hashed.seed, hashed.sizes.tobytes(), hashed.bits.tobytes(), f[order].astype("<i4").tobytes(), (1 + several).astype(np.uint8).tobytes(), firsts.astype("<i8").tobytes()]
    return pd.DataFrame([row], columns=[c.split()[0] for c in _INDEX.split(", ")])


def _first_holder(index: pd.Series, h: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is held by several documents, and then the first of them."""
    hashed = MinimalHash(index["seed"], np.frombuffer(index["sizes"], np.int64), np.frombuffer(index["bits"], "<u8"))
    prints, counts = np.frombuffer(index["prints"], "<i4"), np.frombuffer(index["counts"], np.uint8)
    firsts = np.frombuffer(index["firsts"], "<i8")
    number = hashed.number(h, f)
    several = (number >= 0) & (prints[number] == f) & (counts[number] > 1)
    rank = np.cumsum(counts > 1) - 1
    return several, firsts[rank[number[several]]]


def _probe(probes: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """(doc_id, keys): the keys each document loses in one shard."""
    if probes.empty or index.empty:
        return pd.DataFrame({"doc_id": np.zeros(0, np.int64), "keys": np.zeros(0, object)})
    doc, h, f = (probes[c].to_numpy() for c in ("doc_id", "h", "f"))
    several, first = _first_holder(index.iloc[0], h, f)
    lost = np.flatnonzero(several)[first != doc[several]]
    lost = lost[np.argsort(doc[lost], kind="stable")]
    keys = np.zeros(len(lost), _KEY)
    keys["h"], keys["f"] = h[lost], f[lost]
    ids, starts = np.unique(doc[lost], return_index=True)
    return pd.DataFrame({"doc_id": ids, "keys": [part.tobytes() for part in np.split(keys, starts[1:])] if len(ids) else []})


def line_entries(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(doc_id, h, f) of the distinct keys of every document, stored once. Rows without a ``doc_id`` have none."""
    rows = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return materialize(rows.mapInArrow(lambda batches: _entries(batches, least), "doc_id long, h long, f int"), "lines")


def line_index(entries: DataFrame, shards: int) -> DataFrame:
    """The index over ``entries``: one row of arrays a shard, stored once."""
    keys = entries.groupBy("h", "f").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).withColumn("shard", _shard(shards))
    return materialize(keys.groupBy("shard").applyInPandas(_build, _INDEX), "index")


def _shard(shards: int) -> Column:
    return F.pmod(F.col("h"), F.lit(shards).cast("long"))


def lost_keys(entries: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """(doc_id, keys): for each document the keys that an earlier one holds, 12 bytes each.

    ``entries`` may be of other documents than the index. A shard with more than twice
    the mean of probes is copied, so that no task has many more than the others.
    """
    probes = entries.withColumn("shard", _shard(shards))
    mean = max(1.0, entries.count() / shards)
    copies = probes.groupBy("shard").agg(F.ceil(F.count("*") / (2 * mean)).cast("int").alias("copies"))
    copies = materialize(copies, "copies")
    probes = attach(probes, copies, ["shard"]).withColumn("copy", F.pmod(F.xxhash64("doc_id"), F.col("copies")))
    dealt = index.join(copies, "shard").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies").cast("long") - 1)))
    asked = probes.groupBy("shard", "copy").cogroup(dealt.groupBy("shard", "copy")).applyInPandas(_probe, "doc_id long, keys binary")
    return asked.groupBy("doc_id").agg(F.collect_list("keys").alias("keys"))


def _without(text: Column, keys: Column, least: int) -> Column:
    @F.pandas_udf("text string, n_lines long, n_dropped long")
    def of(texts: pd.Series, lost: pd.Series) -> pd.DataFrame:
        out = []
        for t, k in zip(texts, lost):
            lines = (t or b"").split(b"\n")
            n = len(lines)
            if k is not None:
                flat = b"".join(k)
                gone = {flat[i : i + 12] for i in range(0, len(flat), 12)}
                lines = [line for line in lines if line_key(line, least) not in gone]
            out.append((b"\n".join(lines).decode("utf-8", "replace"), n, n - len(lines)))
        return pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"])

    return of(text.cast("binary"), keys)


def drop_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """``doc_id``, text, n_lines and n_dropped of every row of ``docs``.

    Lines whose key has ``least`` code points or more and is in two documents or more
    stay only in the document with the smallest ``doc_id``, there wherever they stand.
    All other lines stay as they are.

    * A NULL or empty text is one empty line, and comes back empty.
    * Rows that share a ``doc_id`` are one document: a line that no other document
      holds stays in all of them. Rows without a ``doc_id`` are no document: their lines
      count nowhere and stay.
    * A text is split as a whole, however long. Tables without a row, or without a
      line that is long enough, give every text back. Other columns are ignored.
    """
    entries = line_entries(docs, doc_id, text, least)
    spark = docs.sparkSession
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-entries.count() // PER_SHARD))
    lost = lost_keys(entries, line_index(entries, shards), shards)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    lost = lost.withColumnRenamed("doc_id", "of").hint("shuffle_hash")
    # the texts move once, to meet what they lose
    return rows.join(lost, F.col("doc_id") == F.col("of"), "left").select("doc_id", _without(F.col("text"), F.col("keys"), least).alias("kept")).select("doc_id", "kept.*")
