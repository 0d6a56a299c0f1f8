"""Loaders for the four public flow-dataset families.

Each returns the dataset's own columns plus ``label`` (0 normal, 1 attack) and,
where the dataset names its classes, ``label_text``. ``align`` then gives the
shared 12-feature rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.operators.schema import BOTIOT_MAP, CIC_MAP, FEATURES, TON_MAP, UNSW_MAP, SchemaMap, flag_label, resolve, text_label
from packetloom.sources.tables import read_csv, read_parquet

# Identifier and text columns of the Bot-IoT files that are no features.
BOTIOT_DROPPED = [
    "pkSeqID", "stime", "ltime", "flgs", "proto", "saddr", "sport", "daddr", "dport", "state",
    "smac", "dmac", "soui", "doui", "sco", "dco", "subcategory",
]

MAPS = {"cic": CIC_MAP, "botiot": BOTIOT_MAP, "unsw": UNSW_MAP, "ton": TON_MAP}

Schema = T.StructType | str | None


def _named(df: DataFrame, flag: str | None, text: str | None, normal: str = "BENIGN") -> DataFrame:
    """Source label columns become ``label`` and ``label_text``; names differ in case only, so old ones go."""
    label = flag_label(df[f"`{flag}`"]) if flag else text_label(df[f"`{text}`"], normal)
    cols = [F.col(f"`{c}`") for c in df.columns if c not in (flag, text)]
    named = [F.trim(df[f"`{text}`"]).alias("label_text")] if text else []
    return df.select(*cols, label.alias("label"), *named)


def load_cic(spark: SparkSession, folder: str, schema: Schema = None) -> DataFrame:
    """All CSV files of a folder; every class but BENIGN is an attack."""
    df = read_csv(spark, folder, schema, glob="*.csv")
    return _named(df, None, resolve(df, "Label"))


def load_botiot(spark: SparkSession, folder: str, schema: Schema = None) -> DataFrame:
    df = read_csv(spark, folder, schema, glob="*.csv").drop(*BOTIOT_DROPPED)
    return _named(df, resolve(df, "attack"), resolve(df, "category"))


def load_unsw(spark: SparkSession, *files: str) -> DataFrame:
    df = read_parquet(spark, *files)
    return _named(df, resolve(df, "label"), next((c for c in df.columns if c == "attack_cat"), None))


def load_ton(spark: SparkSession, file: str, schema: Schema = None) -> DataFrame:
    df = read_csv(spark, file, schema)
    return _named(df, resolve(df, "label"), next((c for c in df.columns if c == "type"), None))


def align(df: DataFrame, family: str, factor: dict[str, float] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Shared feature columns and ``label`` of a loaded dataset; the rest is never read."""
    return SchemaMap(MAPS[family], factor or {}).apply(df, FEATURES, ["label", *(keep or [])])
