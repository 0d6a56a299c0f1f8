"""Flow features and verdicts over a stream of packets.

Flows are session windows: a flow closes after ``idle`` seconds of silence behind
the watermark. State, late packets and recovery are the engine's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from packetloom.operators.evaluate import score_summary
from packetloom.operators.flows import FIN, KEY, MIN_DURATION, SYN, flow_key, flow_key_text, to_unified
from packetloom.operators.models import predict, verdict


def session_features(packets: DataFrame, idle: str = "2 minutes", delay: str = "1 minute", by: list[str] | None = None) -> DataFrame:
    """Flow features of a packet stream by session windows and built-in aggregates only.

    Packets count in time order here, so the mean gap is the duration over the gaps.
    The spread of the gaps needs the packets in order, which late ones upset: the state
    of an open flow holds a handful of numbers and the times of its packets (eight bytes
    each), which are put in order when it closes. Late packets go by the watermark;
    append mode gives a flow once the watermark has passed it.

    Flows of several captures are told apart by ``by``; packets with a ``file``
    column need it.
    """
    by = by or []
    if "file" in packets.columns and not by:
        raise ValueError("packets of several capture files: give by=['file']")
    keyed = flow_key(packets.withColumn("event_time", F.timestamp_micros((F.col("ts") * 1e6).cast("bigint"))))
    flows = (
        keyed.withWatermark("event_time", delay)
        .groupBy(F.session_window("event_time", idle).alias("session"), *by, *KEY)
        .agg(
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
            F.count("*").alias("n"),
            F.sum("length").alias("total_bytes"),
            F.avg("length").alias("mean_len"),
            F.stddev_pop("length").alias("sd_len"),
            F.bit_or("flags").alias("flags"),
            F.sort_array(F.collect_list("ts")).alias("times"),
        )
        .filter(F.col("n") >= 2)
    )
    duration = F.greatest(F.col("last_ts") - F.col("first_ts"), F.lit(MIN_DURATION))
    gaps = F.expr("transform(slice(times, 2, size(times) - 1), (t, i) -> t - times[i])")
    mean = (F.col("last_ts") - F.col("first_ts")) / (F.col("n") - 1)
    spread = F.sqrt(F.aggregate(F.transform(gaps, lambda g: (g - mean) * (g - mean)), F.lit(0.0), lambda a, x: a + x) / (F.col("n") - 1))
    return flows.select(
        *by,
        flow_key_text().alias("flow_key"),
        "proto",
        F.round(duration, 6).alias("duration"),
        F.col("n").alias("pkt_count"),
        "total_bytes",
        F.round("mean_len", 2).alias("mean_pkt_len"),
        F.round("sd_len", 2).alias("std_pkt_len"),
        F.round(duration / (F.col("n") - 1), 6).alias("mean_iat"),
        F.round(spread, 6).alias("std_iat"),
        F.round(F.col("total_bytes") / duration, 2).alias("bytes_per_sec"),
        F.round(F.col("n") / duration, 2).alias("pkts_per_sec"),
        (F.col("flags").bitwiseAND(SYN) != 0).cast("int").alias("has_syn"),
        (F.col("flags").bitwiseAND(FIN) != 0).cast("int").alias("has_fin"),
    )


def score_sessions(model: PipelineModel, flows: DataFrame) -> DataFrame:
    """Verdict per closed flow; ``model`` takes the shared flow features."""
    rows = to_unified(flows, ["flow_key", "pkt_count"])
    return predict(model, rows).withColumn("prediction", verdict())


def start(flows: DataFrame, out: str, checkpoint: str, once: bool = False, every: str = "30 seconds") -> StreamingQuery:
    """Append closed flows to Parquet files: until stopped, or with ``once`` over what is there now."""
    writer = flows.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def verdict_sink(out: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: verdicts below ``out/verdicts`` and their counts below ``out/counts``, a folder a batch.

    A batch that comes again after a failure replaces its own folders, so each verdict
    is there once, and sums over the counts stay right.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark, told = batch.sparkSession, f"{out}/verdicts/batch={number}"
        batch.write.mode("overwrite").parquet(told)
        counts = score_summary(spark.read.schema(batch.schema).parquet(told))
        counts.select("total", "benign", "attack").write.mode("overwrite").parquet(f"{out}/counts/batch={number}")

    return put


def start_scoring(model: PipelineModel, flows: DataFrame, out: str, checkpoint: str, once: bool = False, every: str = "30 seconds") -> StreamingQuery:
    """Score closed flows into ``verdict_sink``; started again with the same ``checkpoint`` it goes on where it stopped."""
    writer = score_sessions(model, flows).writeStream.outputMode("append").foreachBatch(verdict_sink(out)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def running_counts(spark: SparkSession, out: str) -> DataFrame:
    """(batches, total, benign, attack) of all that was scored so far."""
    counts = spark.read.parquet(f"{out}/counts")
    return counts.agg(F.count("*").alias("batches"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "benign", "attack")])
