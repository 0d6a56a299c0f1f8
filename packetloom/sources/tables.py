"""Flow-table readers and report writers."""

from __future__ import annotations

import bz2
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.functions.files import open_file
from packetloom.functions.ordering import digest_normal, digest_unit
from packetloom.functions.scratch import materialize
from packetloom.operators.schema import trim_names

CORRUPT = "_corrupt_record"


def _csv(spark: SparkSession, schema: T.StructType | str | None):
    reader = (
        spark.read.option("header", True)
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .option("positiveInf", "Infinity")
        .option("negativeInf", "-Infinity")
        .option("nanValue", "NaN")
    )
    return reader.schema(schema) if schema is not None else reader.option("inferSchema", True)


def read_csv(
    spark: SparkSession,
    paths: str | list[str],
    schema: T.StructType | str | None = None,
    glob: str | None = None,
    recursive: bool = False,
) -> DataFrame:
    """CSV files with a header; names trimmed.

    Give a schema for known sources: inference costs a pass over the data and
    reads a lower-case ``inf`` as text. A folder is read whole, ``glob`` keeps
    the matching file names.
    """
    reader = _csv(spark, schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    return trim_names(reader.csv(paths))


def read_csv_tagged(
    spark: SparkSession,
    files: dict[str, str],
    schema: T.StructType | str | None = None,
    tag: str = "day",
) -> DataFrame:
    """``{tag: path}`` read in one scan; each row carries the tag of its file.

    A path may be a file or a folder: the longest listed path that begins the
    name of a row's file decides.
    """
    df = _csv(spark, schema).csv(list(files.values()))
    name = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    expr = None
    for key, path in sorted(files.items(), key=lambda kv: -len(kv[1])):
        hit = F.contains(name, F.lit(path.split("://")[-1].rstrip("/")))
        expr = F.when(hit, key) if expr is None else expr.when(hit, key)
    return trim_names(df.select("*", expr.alias(tag)))


def read_csv_tolerant(spark: SparkSession, paths: str | list[str], schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Rows that fit the schema, and a status row per file.

    Unreadable files and rows that break the schema do not stop the job. The status
    table (file, status, rows, bad_rows, empty_cells) starts from the listing of the
    files, so none is lost unseen: ``unreadable`` and ``cut off`` compressed files,
    ``empty`` ones, ``partly bad`` and ``ok``.
    """
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    raw = (
        _csv(spark, full)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("columnPruning", False)  # a row is judged by all its columns
        .option("ignoreCorruptFiles", True)
        .option("ignoreMissingFiles", True)
        .csv(paths)
    )
    good = trim_names(raw.filter(F.col(CORRUPT).isNull()).drop(CORRUPT))
    fits = F.col(CORRUPT).isNull()
    empty = sum((F.col(f"`{f.name}`").isNull().cast("bigint") for f in schema), F.lit(0))
    counts = raw.groupBy(_plain_path(F.col("_metadata.file_path")).alias("path")).agg(
        F.count_if(fits).alias("rows"), F.count_if(~fits).alias("bad_rows"), F.sum(F.when(fits, empty)).alias("empty_cells")
    )
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    packed = files.filter(F.lower("path").rlike(r"\.(gz|bz2)$")).select("path").mapInArrow(_packing_state, "path string, state string")
    # the names the planner holds anyway, files without a byte among them
    listed = spark.createDataFrame([(p,) for p in raw.inputFiles()], "path string").select(_plain_path(F.col("path")).alias("path"))
    states = packed.select(_plain_path(F.col("path")).alias("path"), "state")
    seen = listed.join(counts, "path", "left").join(states, "path", "left").fillna(0, ["rows", "bad_rows", "empty_cells"])
    verdict = F.when(F.col("state") != "ok", F.col("state")).when(F.col("rows") + F.col("bad_rows") == 0, "empty").when(F.col("bad_rows") > 0, "partly bad").otherwise("ok")
    name = F.element_at(F.split("path", "/"), -1).alias("file")
    return good, seen.select(name, verdict.alias("status"), "rows", "bad_rows", "empty_cells")


def _plain_path(path: Column) -> Column:
    """One spelling of a file's path, whichever reader gave it."""
    return F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^file:/+", "/")


def _packing_state(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Does a compressed file open to its end? Such a file is one unit of work for any reader."""
    for batch in batches:
        yield pa.record_batch([batch.column("path"), pa.array([unpacks(p) for p in batch.column("path").to_pylist()], pa.string())], names=["path", "state"])


def unpacks(path: str, step: int = 1 << 20) -> str:
    """``ok``, ``cut off`` or ``unreadable``. Reads and unpacks about ``step`` bytes at a time, whatever the size."""
    packed_by_zlib = path.lower().endswith(".gz")
    make = (lambda: zlib.decompressobj(31)) if packed_by_zlib else bz2.BZ2Decompressor
    try:
        with open_file(path) as file:
            opened, began, left = make(), False, b""
            while True:
                data = left or file.read(step)
                if not data:
                    # nothing of a member that has begun may be missing
                    return "ok" if opened.eof or not began else "cut off"
                if opened.eof:  # another member follows
                    opened = make()
                began = True
                opened.decompress(data, step)
                if opened.eof:
                    left = opened.unused_data
                elif packed_by_zlib:
                    left = opened.unconsumed_tail
                else:
                    left = b""
                    while not opened.needs_input and not opened.eof:
                        opened.decompress(b"", step)
                    if opened.eof:
                        left = opened.unused_data
    except (zlib.error, OSError, EOFError):
        return "unreadable"


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    """Several Parquet files or folders of one schema as one table."""
    return trim_names(spark.read.parquet(*paths))


def preview(df: DataFrame, n: int = 5, order: list[str] | None = None) -> DataFrame:
    """First ``n`` rows; with ``order`` the same rows every time."""
    return (df.orderBy(*order) if order else df).limit(n)


def file_inventory(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """One row per file below ``path``: folder, file, bytes. No content is read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(path)
        .select("path", "length")
    )
    return files.select(
        F.regexp_extract("path", r"([^/]*)/[^/]*$", 1).alias("folder"),
        F.regexp_extract("path", r"([^/]*)$", 1).alias("file"),
        F.col("length").alias("bytes"),
    )


def folder_summary(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("folder").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Checkpoint of a dataset, partitioned by low-cardinality columns such as the source."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def as_json(df: DataFrame, out: str = "json") -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias(out))


def synthetic_flows(
    stats: DataFrame, rows: str, features: list[str], by: list[str], seed: int = 42, chunk: int = 100_000
) -> DataFrame:
    """Random rows shaped like real ones: normal(mean, sd) per feature and class.

    ``stats`` holds one row per class with ``<feature>_mean``, ``<feature>_sd``
    and the number of rows to draw. Rows are made in chunks that spread over the
    cluster, whatever the largest class is. Values follow from the class, row
    number and feature, so a task that runs again makes the same rows.
    """
    stats = materialize(stats, "stats")
    # few small rows stand for all chunks: a number of partitions of its own keeps them from being put together
    parts = stats.agg(F.sum(F.ceil(F.col(rows) / chunk))).first()[0] or 1
    blocks = stats.withColumn("__blk", F.explode(F.sequence(F.lit(0), F.ceil(F.col(rows) / chunk).cast("int") - 1)))
    start = F.col("__blk").cast("bigint") * chunk
    size = F.least(F.lit(chunk), F.col(rows) - start).cast("int")
    out = blocks.repartition(int(parts), *by, "__blk").withColumn("__i", F.explode(F.sequence(F.lit(1), size)))
    text = [F.concat_ws(":", *by, (start + F.col("__i")).cast("string"), F.lit(c), F.lit(seed)) for c in features]
    return out.select(
        *by,
        (start + F.col("__i")).alias("no"),
        *[(digest_normal(t) * F.col(f"{c}_sd") + F.col(f"{c}_mean")).alias(c) for c, t in zip(features, text)],
    )


def uniform_flows(spark: SparkSession, n: int, features: list[str], seed: int = 42) -> DataFrame:
    """``n`` rows of uniform [0, 1) features."""
    return spark.range(n).select("id", *[(digest_unit(F.concat_ws(":", F.col("id"), F.lit(c), F.lit(seed))) * (1 - 2**-32)).alias(c) for c in features])


def lookup_by_key(rows: DataFrame, table: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Columns of ``table`` for the rows of ``rows``, found by key.

    Both sides may be large, so the planner chooses the join from their sizes.
    """
    return rows.join(table.select(*key, *columns), key, "inner")


__all__ = [
    "as_json", "file_inventory", "folder_summary", "lookup_by_key", "preview", "read_csv",
    "read_csv_tagged", "read_csv_tolerant", "read_parquet", "synthetic_flows", "uniform_flows",
    "write_csv", "write_json", "write_parquet",
]
