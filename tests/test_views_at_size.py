"""Queries over events that only larger tables hold: users past 65,535, late packets of open flows."""

import datetime as dt

import duckdb
import pytest
from pyspark.errors import PySparkException

import __spark_entry__ as entry
from packetloom.sources.captures import capture_bytes

_T0 = dt.datetime(2024, 1, 1)


def _both(spark, folder, name, rows):
    """A query's rows and those of its SQL over a table of events (id, day, user)."""
    rows = [(i, _T0 + dt.timedelta(days=day), user, "view", 5.5, '{"k": 7}') for i, day, user in rows]
    ddl = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * REPLACE (ts::TIMESTAMP AS ts) FROM '{folder}/events.parquet/*.parquet'")
    got = entry.queries()[name](spark, str(folder))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    return sorted(tuple(r) for r in got.collect()), sorted(want)


def test_addresses_past_four_bytes_come_back_from_captures(spark, tmp_path):
    rows = [(i, i / 100, user) for i, user in enumerate([0, 300, 65_535, 65_536, 90_000, 540_000] * 2)]
    got, want = _both(spark, tmp_path, "parse_packets", rows)
    assert got == want and any("10.0.351.144" in r for r in got)


def test_an_address_past_four_bytes_is_no_capture(spark):
    row = [(1, 1, "10.0.256.1", "10.0.0.2", 5, 6, 6, 2, 80)]
    packets = spark.createDataFrame(row, "pkt_seq long, ts_us long, src_ip string, dst_ip string, src_port int, dst_port int, proto int, flags int, length long")
    with pytest.raises(PySparkException, match="not an IPv4 address"):
        capture_bytes(packets).collect()


@pytest.mark.parametrize("name", ["stream_flow_features", "stream_score_summary"])
def test_packets_that_come_last_are_too_late(spark, tmp_path, name):
    # 13 comes last, three days before the mark of the fourth slice; its flow has another packet in that slice
    rows = [(1, 0, 1), (13, 16.25, 2), (42, 18.5, 2), (20, 16, 3), (22, 17, 3), (28, 29.9, 4), (30, 30, 4)]
    rows += [(102 + 2 * i, i + 0.5, 500 + i) for i in range(0, 30)]
    rows += [(302 + 2 * i, 6 + i / 100, 7) for i in range(5)]
    got, want = _both(spark, tmp_path, name, rows)
    assert got == want and len(got) > 0
