"""Queries over packets, flows and captures."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.functions.scratch import scratch_path
from packetloom.operators import flows as fl
from packetloom.operators.schema import FEATURES
from packetloom.plans.registry import query
from packetloom.plans.views import FEATURES_SQL, PACKETS, Views, rounded
from packetloom.sources import captures as cap
from packetloom.sources.captures import capture_bytes, split_captures
from packetloom.sources.tables import as_json, preview
from packetloom.streaming.flows import session_features, start

_F = f"WITH {PACKETS}, {FEATURES_SQL}"
_FEATURE_COLS = (
    "flow_key, proto, duration, pkt_count, total_bytes, mean_pkt_len, std_pkt_len, "
    "mean_iat, std_iat, bytes_per_sec, pkts_per_sec, has_syn, has_fin"
)


@query(f"WITH {PACKETS} SELECT pkt_seq, flow_key FROM keyed")
def flow_key(v: Views):
    return fl.flow_key(v.packets()).select("pkt_seq", fl.flow_key_text().alias("flow_key"))


@query(f"{_F} SELECT {_FEATURE_COLS} FROM features")
def flow_features(v: Views):
    return fl.flow_features(v.packets())


@query(f"WITH {PACKETS} SELECT pkt_seq, round(ts - lag(ts) OVER (PARTITION BY flow_key ORDER BY pkt_seq), 6) AS gap FROM keyed")
def inter_arrival(v: Views):
    return rounded(fl.inter_arrival(fl.flow_key(v.packets())).select("pkt_seq", "gap"))


@query(f"""WITH {PACKETS} SELECT flow_key, CASE WHEN (bit_or(flags) & 2) <> 0 THEN 1 ELSE 0 END AS has_syn,
    CASE WHEN (bit_or(flags) & 1) <> 0 THEN 1 ELSE 0 END AS has_fin FROM keyed GROUP BY flow_key""")
def flow_flags(v: Views):
    return fl.flow_flags(v.packets())


@query(f"""{_F} SELECT flow_key, duration AS flow_duration, pkt_count::DOUBLE AS total_fwd_packets, pkt_count::DOUBLE AS total_backward_packets,
    total_bytes::DOUBLE AS total_length_of_fwd_packets, total_bytes::DOUBLE AS total_length_of_bwd_packets,
    pkts_per_sec AS flow_packets_s, bytes_per_sec AS fwd_packets_s, bytes_per_sec AS bwd_packets_s,
    round(greatest(mean_pkt_len - std_pkt_len, 0), 6) AS min_packet_length, round(mean_pkt_len + std_pkt_len, 6) AS max_packet_length,
    mean_pkt_len AS packet_length_mean, std_pkt_len AS packet_length_std FROM features""")
def flow_to_unified(v: Views):
    return rounded(fl.to_unified(fl.flow_features(v.packets()), ["flow_key"]), 6, FEATURES)


@query(f"{_F} SELECT {_FEATURE_COLS} FROM features ORDER BY flow_key LIMIT 5")
def flow_json_preview(v: Views):
    lines = as_json(preview(fl.flow_features(v.packets()), 5, ["flow_key"]))
    ddl = (
        "flow_key string, proto int, duration double, pkt_count bigint, total_bytes bigint, mean_pkt_len double, std_pkt_len double, "
        "mean_iat double, std_iat double, bytes_per_sec double, pkts_per_sec double, has_syn int, has_fin int"
    )
    return lines.select(F.from_json("json", ddl).alias("r")).select("r.*")


@query(f"""WITH {PACKETS} SELECT CAST(pkt_seq // 500 AS BIGINT) AS file_no,
    CAST(row_number() OVER (PARTITION BY pkt_seq // 500 ORDER BY pkt_seq) - 1 AS BIGINT) AS pkt_seq, ts, length AS orig_len, length AS raw_len FROM packets""")
def packets_from_captures(v: Views):
    rows = split_captures(capture_bytes(v.wire_packets()))
    return rows.select(F.regexp_extract("file", r"(\d+)", 1).cast("bigint").alias("file_no"), "pkt_seq", "ts", "orig_len", F.length("raw").cast("bigint").alias("raw_len"))


def captured(v: Views, per_file: int = 5000):
    """The packets written as capture files: their folder."""
    folder = scratch_path(v.spark, "captures")
    cap.write_captures(capture_bytes(v.wire_packets(), per_file), folder)
    return folder


@query(f"""WITH {PACKETS} SELECT CAST(pkt_seq // 5000 AS BIGINT) AS file_no,
    CAST(row_number() OVER (PARTITION BY pkt_seq // 5000 ORDER BY pkt_seq) - 1 AS BIGINT) AS pkt_seq, ts, length AS orig_len, length AS raw_len FROM packets""")
def captures_by_ranges(v: Views):
    """Capture files read in ranges smaller than most of them, each range by a task that finds its first packet."""
    rows = cap.read_captures(v.spark, captured(v), range_bytes=1 << 19)
    return rows.select(F.regexp_extract("file", r"capture-(\d+)", 1).cast("bigint").alias("file_no"), "pkt_seq", "ts", "orig_len", F.length("raw").cast("bigint").alias("raw_len"))


@query(f"""WITH {PACKETS} SELECT ts, proto, length, length - 34 AS payload_len, src_ip, dst_ip, src_port, dst_port, flags FROM packets""")
def parse_packets(v: Views):
    rows = v.off_the_wire(cap.parse_packets(split_captures(capture_bytes(v.wire_packets()))))
    return rows.select("ts", "proto", "length", "payload_len", "src_ip", "dst_ip", "src_port", "dst_port", "flags")


def _directions(order: str) -> str:
    return f"""WITH {PACKETS}, o AS (SELECT *, first_value(src) OVER (PARTITION BY flow_key ORDER BY {order}, pkt_seq) = src AS fwd FROM keyed),
d AS (SELECT flow_key, greatest(max(ts) - min(ts), 1e-9) AS d, count(*) FILTER (WHERE fwd) AS fp, count(*) FILTER (WHERE NOT fwd) AS bp,
  coalesce(sum(length) FILTER (WHERE fwd), 0)::BIGINT AS fb, coalesce(sum(length) FILTER (WHERE NOT fwd), 0)::BIGINT AS bb, min(length) AS lo, max(length) AS hi FROM o GROUP BY flow_key)
SELECT flow_key, round(d, 6) AS duration, fp AS fwd_packets, bp AS bwd_packets, fb AS fwd_bytes, bb AS bwd_bytes, lo AS len_min, hi AS len_max,
  round(fp / d, 2) AS fwd_per_sec, round(bp / d, 2) AS bwd_per_sec FROM d"""


@query(_directions("pkt_seq"))
def flow_directional(v: Views):
    return fl.flow_directions(v.packets())


@query(_directions("ts"))
def flow_directional_by_time(v: Views):
    return fl.flow_directions(v.packets(), order="ts")


_DAY, _IDLE, _SLICES = 86400, 3 * 86400, 6
# Slices of equal time. Packets of the last day of a slice that draw the number 7 come with
# the next slice, which the watermark allows; old ones that draw 13 come last and too late: in a
# trigger of their own, since late packets are judged by the watermark of the trigger before.
_ARRIVALS = f"""{PACKETS}, span AS (SELECT min(ts) AS t0, (max(ts) - min(ts)) / {_SLICES} AS w FROM packets),
cut AS (SELECT k.*, least(floor((ts - t0) / w), {_SLICES - 1}) AS own, t0, w FROM keyed k, span),
arrived AS (SELECT * FROM cut WHERE NOT (pkt_seq % 50 = 13 AND ts < t0 + {_SLICES - 1} * w - 8 * {_DAY}))"""
_SESSIONS = f"""g0 AS (SELECT *, ts - lag(ts) OVER (PARTITION BY flow_key ORDER BY ts) AS gap0 FROM arrived),
s AS (SELECT *, sum(CASE WHEN gap0 > {_IDLE} THEN 1 ELSE 0 END) OVER (PARTITION BY flow_key ORDER BY ts) AS flow_no FROM g0),
f AS (SELECT flow_key, flow_no, proto, greatest(max(ts) - min(ts), 1e-9) AS d, max(ts) AS last_ts, count(*) AS n, sum(length)::BIGINT AS tb, avg(length) AS ml,
  stddev_pop(length) AS sl, bit_or(flags) AS fl, stddev_pop(CASE WHEN gap0 <= {_IDLE} THEN gap0 END) AS si FROM s GROUP BY ALL HAVING count(*) >= 2),
closed AS (SELECT * FROM f WHERE last_ts + {_IDLE} <= (SELECT max(ts) - {_DAY} FROM arrived))"""
_SESSION_COLS = """flow_key, proto, round(d, 6) AS duration, n AS pkt_count, tb AS total_bytes, round(ml, 2) AS mean_pkt_len, round(sl, 2) AS std_pkt_len,
  round(d / (n - 1), 6) AS mean_iat, round(si, 6) AS std_iat, round(tb / d, 2) AS bytes_per_sec, round(n / d, 2) AS pkts_per_sec,
  CASE WHEN (fl & 2) <> 0 THEN 1 ELSE 0 END AS has_syn, CASE WHEN (fl & 1) <> 0 THEN 1 ELSE 0 END AS has_fin"""


def arriving(v: Views, base: str, slices=range(_SLICES + 1)):
    """The packets as a stream of one file per trigger, some late, some too late; ``slices`` are written now."""
    packets = v.packets()
    t0, t1 = packets.agg(F.min("ts"), F.max("ts")).first()
    width = (t1 - t0) / _SLICES
    own = F.least(F.floor((F.col("ts") - t0) / width), F.lit(_SLICES - 1))
    draw = F.col("pkt_seq") % 50
    late = (draw == 7) & (F.col("ts") >= t0 + (own + 1) * width - _DAY)
    lost = (draw == 13) & (F.col("ts") < t0 + (_SLICES - 1) * width - 8 * _DAY)
    number = F.when(lost, _SLICES).when(late, F.least(own + 1, F.lit(_SLICES - 1))).otherwise(own)
    numbered = packets.withColumn("slice", number.cast("int"))
    for i in slices:
        numbered.filter(F.col("slice") == i).drop("slice").coalesce(1).write.mode("append").parquet(f"{base}/in")
    return v.spark.readStream.schema(packets.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")


@query(f"WITH {_ARRIVALS}, {_SESSIONS} SELECT {_SESSION_COLS} FROM closed")
def stream_flow_features(v: Views):
    """Flows the watermark has passed, out of several triggers with late packets."""
    base = scratch_path(v.spark, "stream")
    flows = session_features(arriving(v, base), f"{_IDLE} seconds", "1 day")
    start(flows, f"{base}/out", f"{base}/checkpoint", once=True).awaitTermination()
    return v.spark.read.parquet(f"{base}/out")


@query(f"WITH {PACKETS}, arrived AS (SELECT * FROM keyed), {_SESSIONS} SELECT {_SESSION_COLS} FROM closed")
def stream_sessions(v: Views):
    """Sessions the watermark has passed when all packets came in one trigger."""
    base = scratch_path(v.spark, "sessions")
    v.packets().write.parquet(f"{base}/in")
    packets = v.spark.readStream.schema(v.packets().schema).parquet(f"{base}/in")
    flows = session_features(packets, f"{_IDLE} seconds", "1 day")
    start(flows, f"{base}/out", f"{base}/checkpoint", once=True).awaitTermination()
    return v.spark.read.parquet(f"{base}/out")
