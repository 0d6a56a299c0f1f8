"""Stable shards by weighted rendezvous hashing.

Each shard draws an exponential variate from the hash of (key, shard), divided by
the shard's weight; the row goes to the smallest draw. A new shard can only win
rows for itself, a removed one only gives its own rows away, and shares follow the
weights. All of it is native columns in one pass over the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from packetloom.functions.scratch import materialize


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Shard number of a key among ``len(weights)`` shards; NULL keys share one shard.

    Keys and shard numbers alone decide. Ties go to the smaller number.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a positive weight")
    draws = []
    for shard, weight in enumerate(weights):
        unit = (F.shiftrightunsigned(F.xxhash64(F.lit(shard), key), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
        draws.append(F.struct((-F.log(unit) / F.lit(float(weight))).alias("draw"), F.lit(shard).alias("shard")))
    return (F.least(*draws) if len(draws) > 1 else draws[0])["shard"]


def assign(docs: DataFrame, weights: Sequence[float], key: str = "doc_id", shard: str = "shard") -> DataFrame:
    """``docs`` with its shard number; a column of that name is replaced."""
    return docs.withColumn(shard, rendezvous(F.col(key), weights))


def with_slots(rows: DataFrame, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """``rows``, stored once, with a gapless number from 0 within each shard.

    Rows are numbered within (file, shard) and shifted by what earlier files hold of
    that shard, so no task sees more of a shard than one file has.
    """
    stored = materialize(rows, "shards")
    placed = stored.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    before = placed.groupBy("__file", shard).agg(F.count("*").alias("__n"))
    earlier = W.partitionBy(shard).orderBy("__file").rowsBetween(W.unboundedPreceding, -1)
    before = before.select("__file", shard, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__base"))
    inside = F.row_number().over(W.partitionBy("__file", shard).orderBy("__row")) - 1
    numbered = placed.withColumn("__inside", inside).join(before, ["__file", shard])
    return numbered.select(*rows.columns, (F.col("__base") + F.col("__inside")).alias(slot))


def write_shards(docs: DataFrame, weights: Sequence[float], path: str, key: str = "doc_id", rows_per_file: int = 1_000_000) -> None:
    """Write ``docs`` as one Parquet folder per shard, in files of bounded size.

    Rows are written where they are read, without a shuffle.
    """
    assign(docs, weights, key).write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)


def shard_plan(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Where each row goes by the law ``key``: shard among ``shards`` equal ones, and among one more.

    size is the UTF-8 length of the text plus 1, text_crc32 its checksum; a NULL text
    counts as empty. Rows that repeat a ``doc_id`` share a shard and get slots of
    their own; so do rows whose ``doc_id`` is NULL. Other columns are ignored; an
    empty table gives an empty plan.
    """
    key, body = F.col(doc_id), F.coalesce(F.col(text), F.lit(""))
    plan = docs.select(
        key.alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(key, [1.0] * shards).alias("shard"),
        rendezvous(key, [1.0] * (shards + 1)).alias("grown_shard"),
    )
    return with_slots(plan).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
