"""Folding packets into bidirectional flows with statistical features.

Packets are reduced in two steps. First each flow is cut into parts of at most
``chunk`` consecutive packets, and every part is reduced to one row; then the few
parts of a flow are joined up in order. Part rows carry mergeable moments, so the
result is exact, and a flow holding a third of all packets is spread over as many
tasks as it has parts. A part is also the state of an open flow on a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

SYN, FIN = 0x02, 0x01
MIN_DURATION = 1e-9
KEY = ["lo", "hi", "proto"]

#: Most packets of one flow that a single task ever orders.
CHUNK = 1_000_000


def flow_key(packets: DataFrame) -> DataFrame:
    """Adds endpoints ``lo`` <= ``hi`` (ip, port), equal for both directions."""
    src = F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port"))
    dst = F.struct(F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port"))
    return packets.withColumns({"lo": F.least(src, dst), "hi": F.greatest(src, dst)})


def flow_key_text() -> Column:
    """The key as text: both endpoints and the protocol."""
    end = lambda c: F.concat(F.lit("('"), F.col(f"{c}.ip"), F.lit("', "), F.col(f"{c}.port"), F.lit(")"))
    return F.concat(F.lit("("), end("lo"), F.lit(", "), end("hi"), F.lit(", "), F.col("proto"), F.lit(")"))


def inter_arrival(packets: DataFrame, by: list[str] | None = None, seq: str = "pkt_seq", chunk: int = CHUNK) -> DataFrame:
    """Adds ``gap``: seconds since the packet before it in its flow, NULL for the first.

    Within a chunk the packet before is the window neighbour; the first packet of
    a chunk takes the last packet of the flow's chunk before, from a table with
    one row per flow and chunk.
    """
    key = [*(by or []), *KEY]
    cut = packets.withColumn("__chunk", F.expr(f"{seq} div {chunk}"))
    ends = cut.groupBy(*key, "__chunk").agg(F.max_by("ts", seq).alias("__last"))
    ends = ends.withColumn("__prev", F.lag("__last").over(W.partitionBy(*key).orderBy("__chunk"))).drop("__last")
    local = F.lag("ts").over(W.partitionBy(*key, "__chunk").orderBy(seq))
    return (
        cut.withColumn("__near", local)
        .join(ends, [*key, "__chunk"])
        .withColumn("gap", F.col("ts") - F.coalesce("__near", "__prev"))
        .drop("__near", "__prev", "__chunk")
    )


def flow_parts(
    packets: DataFrame,
    by: list[str] | None = None,
    seq: str = "pkt_seq",
    chunk: int = CHUNK,
    idle: float | None = None,
) -> DataFrame:
    """One row per stretch of a flow's packets inside one chunk of the capture.

    With ``idle`` a pause of more than that many seconds also ends a part.
    """
    key = [*(by or []), *KEY, "__chunk"]
    near = W.partitionBy(*key).orderBy(seq)
    rows = (
        packets.select(*key[:-1], seq, "ts", "length", "flags", F.expr(f"cast(floor({seq}) as bigint) div {chunk}").alias("__chunk"))
        .withColumn("__gap", F.col("ts") - F.lag("ts").over(near))
    )
    if idle is not None:
        starts = F.sum((F.coalesce("__gap", F.lit(0.0)) > idle).cast("int")).over(near)
        rows = rows.withColumn("__stretch", starts)
        rows = rows.withColumn("__gap", F.when(F.col("__gap") <= idle, F.col("__gap")))
    else:
        rows = rows.withColumn("__stretch", F.lit(0))
    return rows.groupBy(*key, "__stretch").agg(
        F.min(seq).alias("first_seq"),
        F.max(seq).alias("last_seq"),
        F.min_by("ts", seq).alias("first_ts"),
        F.max_by("ts", seq).alias("last_ts"),
        F.count("*").alias("n"),
        F.sum("length").alias("len_sum"),
        F.avg("length").alias("len_mean"),
        F.var_pop("length").alias("len_var"),
        F.count("__gap").alias("gaps"),
        F.sum("__gap").alias("gap_sum"),
        F.var_pop("__gap").alias("gap_var"),
        F.bit_or("flags").alias("flags"),
        F.min("length").alias("len_min"),
        F.max("length").alias("len_max"),
    ).drop("__chunk", "__stretch")


def _pooled_var(weight: str, mean: Column, var: str, total_mean: Column) -> Column:
    """Population variance of joined groups; exact copy of the part's own when alone."""
    w = F.col(weight)
    pooled = F.sum(w * (F.col(var) + (mean - total_mean) * (mean - total_mean))) / F.sum(w)
    return F.when(F.count_if(w > 0) == 1, F.max(F.when(w > 0, F.col(var)))).otherwise(pooled)


def join_parts(parts: DataFrame, by: list[str] | None = None, idle: float | None = None) -> DataFrame:
    """Parts of one flow joined in arrival order: again part rows, one per flow.

    With ``idle`` a pause between parts starts a new flow (``flow_no``).
    """
    key = [*(by or []), *KEY]
    order = W.partitionBy(*key).orderBy("first_seq")
    rows = parts.withColumn("__join", F.col("first_ts") - F.lag("last_ts").over(order))
    if idle is not None:
        new = F.coalesce((F.col("__join") > idle).cast("int"), F.lit(0))
        rows = rows.withColumn("flow_no", F.sum(new).over(order))
        rows = rows.withColumn("__join", F.when(F.col("__join") <= idle, F.col("__join")))
        key = [*key, "flow_no"]
    # the gap between two parts is a gap group of its own
    group = W.partitionBy(*key)
    rows = rows.withColumns(
        {
            "__n": F.sum("n").over(group),
            "__sum": F.sum("len_sum").over(group),
            "__g": (F.sum("gaps").over(group) + F.count("__join").over(group)),
            "__gs": F.sum(F.coalesce("gap_sum", F.lit(0.0)) + F.coalesce("__join", F.lit(0.0))).over(group),
        }
    )
    len_mean, gap_mean = F.col("__sum") / F.col("__n"), F.try_divide("__gs", "__g")
    own = F.try_divide("gap_sum", "gaps")
    inside = F.sum(F.col("gaps") * (F.col("gap_var") + (own - gap_mean) * (own - gap_mean)))
    between = F.sum((F.col("__join") - gap_mean) * (F.col("__join") - gap_mean))
    gap_var = F.when(
        (F.count("__join") == 0) & (F.count_if(F.col("gaps") > 0) == 1), F.max("gap_var")
    ).otherwise(F.try_divide(F.coalesce(inside, F.lit(0.0)) + F.coalesce(between, F.lit(0.0)), F.max("__g")))
    out = rows.groupBy(*key).agg(
        F.min("first_seq").alias("first_seq"),
        F.max("last_seq").alias("last_seq"),
        F.min_by("first_ts", "first_seq").alias("first_ts"),
        F.max_by("last_ts", "first_seq").alias("last_ts"),
        F.max("__n").alias("n"),
        F.max("__sum").alias("len_sum"),
        F.max(len_mean).alias("len_mean"),
        _pooled_var("n", F.col("len_mean"), "len_var", len_mean).alias("len_var"),
        F.max("__g").alias("gaps"),
        F.when(F.max("__g") > 0, F.max("__gs")).alias("gap_sum"),
        gap_var.alias("gap_var"),
        F.bit_or("flags").alias("flags"),
        F.min("len_min").alias("len_min"),
        F.max("len_max").alias("len_max"),
    )
    return out


def features_of(parts: DataFrame, by: list[str] | None = None, digits: tuple[int, int] | None = (6, 2)) -> DataFrame:
    """Feature columns of joined parts; flows of a single packet are dropped.

    ``digits`` rounds times and the rest; None keeps full precision for chaining.
    """
    extra = [c for c in (*(by or []), "flow_no") if c in parts.columns]
    duration = F.greatest(F.col("last_ts") - F.col("first_ts"), F.lit(MIN_DURATION))

    def t(c: Column) -> Column:
        return F.round(c, digits[0]) if digits else c

    def v(c: Column) -> Column:
        return F.round(c, digits[1]) if digits else c

    return parts.filter(F.col("n") >= 2).select(
        *extra,
        flow_key_text().alias("flow_key"),
        "proto",
        t(duration).alias("duration"),
        F.col("n").alias("pkt_count"),
        F.col("len_sum").alias("total_bytes"),
        v(F.col("len_mean")).alias("mean_pkt_len"),
        v(F.sqrt("len_var")).alias("std_pkt_len"),
        t(F.try_divide("gap_sum", "gaps")).alias("mean_iat"),
        t(F.sqrt("gap_var")).alias("std_iat"),
        v(F.col("len_sum") / duration).alias("bytes_per_sec"),
        v(F.col("n") / duration).alias("pkts_per_sec"),
        (F.col("flags").bitwiseAND(SYN) != 0).cast("int").alias("has_syn"),
        (F.col("flags").bitwiseAND(FIN) != 0).cast("int").alias("has_fin"),
    )


def flow_features(
    packets: DataFrame,
    by: list[str] | None = None,
    seq: str = "pkt_seq",
    chunk: int = CHUNK,
    idle: float | None = None,
    digits: tuple[int, int] | None = (6, 2),
) -> DataFrame:
    """Packets to one feature row per flow of two or more packets.

    Packets count in arrival order (``seq``), also where their times run
    backwards; ``seq="ts"`` counts them in time order (a chunk is then that many
    seconds: give one that holds a bounded number of packets). ``by`` keeps captures
    apart, whose packet numbers begin anew in each file; packets with a ``file``
    column need it. By default a flow never ends; ``idle`` seconds of silence split it.
    """
    if "file" in packets.columns and not by:
        raise ValueError("packets of several capture files: give by=['file']")
    parts = flow_parts(flow_key(packets), by, seq, chunk, idle)
    return features_of(join_parts(parts, by, idle), by, digits)


def flow_flags(packets: DataFrame, by: list[str] | None = None) -> DataFrame:
    """SYN / FIN seen per flow."""
    keyed = flow_key(packets).groupBy(*(by or []), *KEY).agg(F.bit_or("flags").alias("flags"))
    return keyed.select(
        *(by or []),
        flow_key_text().alias("flow_key"),
        (F.col("flags").bitwiseAND(SYN) != 0).cast("int").alias("has_syn"),
        (F.col("flags").bitwiseAND(FIN) != 0).cast("int").alias("has_fin"),
    )


def to_unified(flows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Flow features to the shared 12-feature row.

    Bidirectional totals stand for both directions, byte rate for the directed
    packet rates, and mean -/+ sd for the smallest and largest length.
    """
    d = {c: F.col(c).cast("double") for c in flows.columns}
    mean, sd = d["mean_pkt_len"], d["std_pkt_len"]
    return flows.select(
        *(keep or []),
        d["duration"].alias("flow_duration"),
        d["pkt_count"].alias("total_fwd_packets"),
        d["pkt_count"].alias("total_backward_packets"),
        d["total_bytes"].alias("total_length_of_fwd_packets"),
        d["total_bytes"].alias("total_length_of_bwd_packets"),
        d["pkts_per_sec"].alias("flow_packets_s"),
        d["bytes_per_sec"].alias("fwd_packets_s"),
        d["bytes_per_sec"].alias("bwd_packets_s"),
        F.greatest(mean - sd, F.lit(0.0)).alias("min_packet_length"),
        (mean + sd).alias("max_packet_length"),
        mean.alias("packet_length_mean"),
        sd.alias("packet_length_std"),
    )


def flow_directions(packets: DataFrame, by: list[str] | None = None, order: str = "pkt_seq") -> DataFrame:
    """Packets, bytes and rates of either direction, and true smallest and largest length.

    Forward is the direction of the first packet in ``order``, ``ts`` for captures
    whose packets are not in time order. One aggregation, combined before the shuffle.
    """
    by = by or []
    keyed = flow_key(packets)
    up = F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port")) == F.col("lo")
    flows = keyed.groupBy(*by, *KEY).agg(
        F.min_by(up, F.struct(order, "pkt_seq")).alias("up"),
        (F.max("ts") - F.min("ts")).alias("span"),
        F.count_if(up).alias("n_up"),
        F.count_if(~up).alias("n_down"),
        F.coalesce(F.sum(F.when(up, F.col("length"))), F.lit(0)).alias("b_up"),
        F.coalesce(F.sum(F.when(~up, F.col("length"))), F.lit(0)).alias("b_down"),
        F.min("length").alias("len_min"),
        F.max("length").alias("len_max"),
    )
    pick = lambda a, b: F.when(F.col("up"), F.col(a)).otherwise(F.col(b))
    span = F.greatest(F.col("span"), F.lit(MIN_DURATION))
    flows = flows.select(*by, flow_key_text().alias("flow_key"), span.alias("duration"), pick("n_up", "n_down").alias("fwd_packets"), pick("n_down", "n_up").alias("bwd_packets"), pick("b_up", "b_down").alias("fwd_bytes"), pick("b_down", "b_up").alias("bwd_bytes"), "len_min", "len_max")
    return flows.withColumns({"fwd_per_sec": F.round(F.col("fwd_packets") / F.col("duration"), 2), "bwd_per_sec": F.round(F.col("bwd_packets") / F.col("duration"), 2), "duration": F.round("duration", 6)})
