"""Session windows over several triggers: open state, late packets, the watermark."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from packetloom.streaming.flows import running_counts, session_features, start, start_scoring, verdict_sink

COLS = "pkt_seq bigint, ts double, src_ip string, src_port int, dst_ip string, dst_port int, proto int, length bigint, flags int"


def _packet(i, ts, host, length=100, flags=0):
    return (i, ts, f"1.1.1.{host}", 9, "2.2.2.2", 8, 6, length, flags)


def _run(spark, base, slices):
    for i, rows in enumerate(slices):
        spark.createDataFrame(rows, COLS).coalesce(1).write.mode("append").parquet(f"{base}/in")
    packets = spark.readStream.schema(COLS).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    flows = session_features(packets, "20 seconds", "10 seconds")
    start(flows, f"{base}/out", f"{base}/checkpoint", once=True).awaitTermination()
    return {(r["flow_key"], r["pkt_count"]): r for r in spark.read.parquet(f"{base}/out").collect()}


def test_flows_span_triggers_and_late_packets_follow_the_watermark(spark, tmp_path):
    slices = [
        [_packet(0, 100.0, 1, 50, 2), _packet(1, 105.0, 1, 70), _packet(2, 104.0, 2)],
        # 103 comes late within the delay; host 1 goes on in this trigger
        [_packet(3, 118.0, 1, 90, 1), _packet(4, 103.0, 2), _packet(5, 119.0, 3)],
        [_packet(6, 300.0, 4)],
        # a late packet is judged by the watermark of the trigger before
        [_packet(10, 302.0, 4)],
        # far behind the watermark by now: left out
        [_packet(7, 101.0, 1), _packet(8, 301.0, 4)],
        [_packet(9, 500.0, 5)],
    ]
    got = _run(spark, str(tmp_path), slices)
    counts = sorted((k[0].split("'")[1], k[1]) for k in got)
    assert counts == [("1.1.1.1", 3), ("1.1.1.2", 2), ("1.1.1.4", 3)]
    for key, times in ((("1.1.1.1", 3), [100.0, 105.0, 118.0]), (("1.1.1.4", 3), [300.0, 301.0, 302.0])):
        row = next(r for (k, n), r in got.items() if key[0] in k and n == key[1])
        assert row["std_iat"] == pytest.approx(np.diff(times).std(), abs=1e-6)
    one = next(r for (k, n), r in got.items() if n == 3 and "1.1.1.1" in k)
    assert (one["duration"], one["total_bytes"], one["mean_iat"], one["has_syn"], one["has_fin"]) == (18.0, 210, 9.0, 1, 1)


def test_several_captures_need_by(spark):
    packets = spark.createDataFrame([_packet(0, 1.0, 1)], COLS).withColumn("file", F.lit("a"))
    with pytest.raises(ValueError):
        session_features(packets)
    assert "file" in session_features(packets, by=["file"]).columns


def test_scoring_goes_on_after_a_stop_and_a_batch_that_comes_again_counts_once(spark, tmp_path):
    base = str(tmp_path)
    rule = PipelineModel([SQLTransformer(statement="SELECT *, double(total_fwd_packets >= 3) AS prediction FROM __THIS__")])
    slices = [
        [_packet(0, 100.0, 1), _packet(1, 105.0, 1), _packet(2, 104.0, 2)],
        [_packet(3, 118.0, 1), _packet(4, 103.0, 2)],
        [_packet(5, 300.0, 4)],
        [_packet(6, 302.0, 4), _packet(7, 301.0, 4)],
        [_packet(8, 500.0, 5)],
        [_packet(9, 900.0, 5)],
    ]
    seen = []
    for part in (slices[:2], slices[2:3], slices[3:]):  # stopped twice, once with flows still open
        for rows in part:
            spark.createDataFrame(rows, COLS).coalesce(1).write.mode("append").parquet(f"{base}/in")
        packets = spark.readStream.schema(COLS).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        start_scoring(rule, session_features(packets, "20 seconds", "10 seconds"), f"{base}/out", f"{base}/checkpoint", once=True).awaitTermination()
        seen.append(running_counts(spark, f"{base}/out").first()["total"])
    got = running_counts(spark, f"{base}/out").first()
    assert (got["total"], got["benign"], got["attack"]) == (3, 1, 2) and seen[0] < 3
    told = spark.read.parquet(f"{base}/out/verdicts")
    assert told.count() == 3 and told.select("flow_key").distinct().count() == 3
    number = told.first()["batch"]
    rows = told.filter(F.col("batch") == number).drop("batch")
    verdict_sink(f"{base}/out")(spark.createDataFrame(rows.collect(), rows.schema), number)
    again = running_counts(spark, f"{base}/out").first()
    assert again == got and spark.read.parquet(f"{base}/out/verdicts").count() == 3
