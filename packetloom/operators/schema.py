"""Names, column sets, labels and the shared 12-feature schema."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.missing import is_missing, numeric_columns, text_columns

# The shared feature names of the aligned schema, in model order,
# with the snake_case column each one becomes.
UNIFIED = {
    "Flow Duration": "flow_duration",
    "Total Fwd Packets": "total_fwd_packets",
    "Total Backward Packets": "total_backward_packets",
    "Total Length of Fwd Packets": "total_length_of_fwd_packets",
    "Total Length of Bwd Packets": "total_length_of_bwd_packets",
    "Flow Packets/s": "flow_packets_s",
    "Fwd Packets/s": "fwd_packets_s",
    "Bwd Packets/s": "bwd_packets_s",
    "Min Packet Length": "min_packet_length",
    "Max Packet Length": "max_packet_length",
    "Packet Length Mean": "packet_length_mean",
    "Packet Length Std": "packet_length_std",
}
FEATURES = list(UNIFIED.values())

# Source column -> shared column, per dataset family.
CIC_MAP = dict(UNIFIED)
BOTIOT_MAP = {
    "dur": "flow_duration",
    "spkts": "total_fwd_packets",
    "dpkts": "total_backward_packets",
    "sbytes": "total_length_of_fwd_packets",
    "dbytes": "total_length_of_bwd_packets",
    "rate": "flow_packets_s",
    "srate": "fwd_packets_s",
    "drate": "bwd_packets_s",
    "min": "min_packet_length",
    "max": "max_packet_length",
    "mean": "packet_length_mean",
    "stddev": "packet_length_std",
}
UNSW_MAP = {
    "dur": "flow_duration",
    "spkts": "total_fwd_packets",
    "dpkts": "total_backward_packets",
    "sbytes": "total_length_of_fwd_packets",
    "dbytes": "total_length_of_bwd_packets",
    "rate": "flow_packets_s",
    "sload": "fwd_packets_s",
    "dload": "bwd_packets_s",
    "smean": "min_packet_length",
    "dmean": "max_packet_length",
    "sjit": "packet_length_mean",
    "djit": "packet_length_std",
}
TON_MAP = {
    "duration": "flow_duration",
    "src_pkts": "total_fwd_packets",
    "dst_pkts": "total_backward_packets",
    "src_bytes": "total_length_of_fwd_packets",
    "dst_bytes": "total_length_of_bwd_packets",
    "src_ip_bytes": "flow_packets_s",
    "dst_ip_bytes": "bwd_packets_s",
    "missed_bytes": "fwd_packets_s",
    "src_port": "min_packet_length",
    "dst_port": "max_packet_length",
    "http_request_body_len": "packet_length_mean",
    "http_response_body_len": "packet_length_std",
}

# Feature of one source -> candidate features of another, for review by hand.
SEMANTIC_CANDIDATES = {
    "pkts": ["Total Fwd Packets", "Total Backward Packets"],
    "bytes": ["Total Length of Fwd Packets", "Total Length of Bwd Packets"],
    "rate": ["Flow Packets/s", "Flow Bytes/s"],
    "dur": ["Flow Duration"],
    "sbytes": ["Total Length of Fwd Packets"],
    "dbytes": ["Total Length of Bwd Packets"],
    "spkts": ["Total Fwd Packets"],
    "dpkts": ["Total Backward Packets"],
    "min": ["Min Packet Length"],
    "max": ["Max Packet Length"],
    "mean": ["Packet Length Mean"],
    "stddev": ["Packet Length Std"],
}


class MissingColumns(ValueError):
    """Raised before any work when a table lacks required columns."""


def trim_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def resolve(df: DataFrame, *names: str) -> str:
    """The column that carries one of ``names``, blanks and case aside."""
    have = {c.strip().lower(): c for c in df.columns}
    for n in names:
        if n.strip().lower() in have:
            return have[n.strip().lower()]
    raise MissingColumns(f"none of {list(names)} in {df.columns}")


def require(df: DataFrame, columns: list[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise MissingColumns(f"missing columns: {missing}")


def select_numeric(df: DataFrame) -> DataFrame:
    return df.select(*numeric_columns(df))


def select_text(df: DataFrame) -> DataFrame:
    return df.select(*text_columns(df))


def drop_text(df: DataFrame, keep: list[str]) -> DataFrame:
    """Drop text columns except the label columns in ``keep``."""
    return df.drop(*[c for c in text_columns(df) if c not in keep])


def column_types(df: DataFrame) -> dict[str, str]:
    return dict(df.dtypes)


def cast_float32(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("float") for c in columns})


def text_label(label: str | Column, normal: str = "BENIGN", normalize: bool = True) -> Column:
    """1 for every class but ``normal``. A missing label stays missing."""
    c = F.col(label) if isinstance(label, str) else label
    if normalize:
        c, normal = F.upper(F.trim(c)), normal.upper()
    return F.when(c.isNotNull(), (c != normal).cast("int"))


def flag_label(label: str | Column) -> Column:
    """1 for every flag but zero, whether stored as a number or as text."""
    c = F.col(label) if isinstance(label, str) else label
    return F.when(c.isNotNull(), (F.trim(c.cast("string")) != "0").cast("int"))


@dataclass(frozen=True)
class SchemaMap:
    """How one source becomes a row of the shared schema.

    ``rename`` maps its columns to shared ones. ``factor`` multiplies a shared
    column, for sources that store it in another unit.
    """

    rename: dict[str, str]
    factor: dict[str, float] = field(default_factory=dict)

    def apply(self, df: DataFrame, features: list[str], keep: list[str] | None = None) -> DataFrame:
        """Shared features as doubles, then the ``keep`` columns; others are pruned."""
        back = {new: old for old, new in self.rename.items() if old in df.columns}
        source = {f: back.get(f, f) for f in features}
        require(df, [*source.values(), *(keep or [])])
        cols = []
        for f in features:
            c = F.col(f"`{source[f]}`").cast("double")
            cols.append((c * self.factor[f] if f in self.factor else c).alias(f))
        return df.select(*cols, *(keep or []))


def union_sources(aligned: dict[str, DataFrame], tag: str = "source") -> DataFrame:
    """Aligned tables under one another, each row naming its source."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in aligned.items()]
    return reduce(DataFrame.unionByName, tagged)


def union_all(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def union_outer(*tables: DataFrame) -> DataFrame:
    """Union of tables with different columns; absent ones are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def _present_counts(df: DataFrame, columns: list[str], out: str) -> DataFrame:
    """(column, non-missing rows) in one aggregate."""
    counts = df.agg(*[F.count_if(~is_missing(df, c)).alias(c) for c in columns])
    return counts.unpivot([], columns, "column", out)


def schema_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """Column names both tables have, blanks and case aside, with their filled rows."""
    a = {c.strip().lower(): c for c in left.columns}
    b = {c.strip().lower(): c for c in right.columns}
    both = sorted(a.keys() & b.keys())
    if not both:
        return left.sparkSession.createDataFrame([], "column string, left_rows bigint, right_rows bigint")
    lc = _present_counts(left.select(*[F.col(a[n]).alias(n) for n in both]), both, "left_rows")
    rc = _present_counts(right.select(*[F.col(b[n]).alias(n) for n in both]), both, "right_rows")
    return lc.join(F.broadcast(rc), "column")  # one row per common name


def semantic_candidates(df: DataFrame, target: list[str], candidates: dict[str, list[str]]) -> DataFrame:
    """Each source feature with its target candidates, for review.

    Shows whether the target schema has the candidate, and how many filled rows
    and which mean the source feature has in ``df`` (NULL where it is absent).
    """
    have = [c for c in candidates if c in df.columns]
    pairs = [(s, t, t in target) for s, ts in candidates.items() for t in ts]
    table = df.sparkSession.createDataFrame(pairs, "feature string, candidate string, in_target boolean")
    if not have:
        return table.withColumns({"rows": F.lit(None).cast("bigint"), "mean": F.lit(None).cast("double")})
    seen = df.agg(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("feature"),
                    F.count_if(~is_missing(df, c)).alias("rows"),
                    F.avg(F.when(~is_missing(df, c), F.col(c))).alias("mean"),
                )
                for c in have
            ]
        ).alias("s")
    ).select(F.inline("s"))
    return table.join(F.broadcast(seen), "feature", "left")  # one row per feature


def feature_presence(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, status OK or MISSING, mean) for each required feature."""
    have = [f for f in features if f in df.columns]
    rows = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                F.lit("OK" if f in have else "MISSING").alias("status"),
                (F.avg(F.when(~is_missing(df, f), F.col(f))) if f in have else F.lit(None)).cast("double").alias("mean"),
            )
            for f in features
        ]
    )
    return df.agg(rows.alias("r")).select(F.inline("r"))


