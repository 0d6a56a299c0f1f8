"""Every file of a tolerant scan is reported, whatever its state."""

import gzip

import pytest

from packetloom.operators import flows, sampling
from packetloom.sources import tables


def test_states_of_files(spark, tmp_path):
    text = "a,b\n" + "".join(f"{i},{i}.5\n" for i in range(5000))
    packed = gzip.compress(text.encode())
    (tmp_path / "good.csv.gz").write_bytes(packed)
    (tmp_path / "two.csv.gz").write_bytes(gzip.compress(b"a,b\n1,1.0\n") + gzip.compress(b"2,2.0\n"))
    (tmp_path / "cut.csv.gz").write_bytes(packed[: len(packed) // 2])
    (tmp_path / "junk.csv.gz").write_bytes(b"this is no gzip file")
    (tmp_path / "empty.csv").write_bytes(b"")
    (tmp_path / "odd name+1.csv").write_text("a,b\n1,2.0\nx,3.0\n,4.0\n")
    schema = spark.createDataFrame([], "a int, b double").schema
    good, status = tables.read_csv_tolerant(spark, str(tmp_path), schema)
    got = {r["file"]: (r["status"], r["rows"], r["bad_rows"], r["empty_cells"]) for r in status.collect()}
    assert got.pop("cut.csv.gz")[0] == "cut off"
    assert got == {
        "good.csv.gz": ("ok", 5000, 0, 0),
        "two.csv.gz": ("ok", 2, 0, 0),
        "junk.csv.gz": ("unreadable", 0, 0, 0),
        "empty.csv": ("empty", 0, 0, 0),
        "odd name+1.csv": ("partly bad", 2, 1, 1),
    }
    assert good.filter("a < 5000").count() >= 5004


def test_exact_sizes_with_repeated_keys(spark):
    rows = spark.range(1000).selectExpr("id % 5 as k", "id as x", "id % 2 as label")
    assert sampling.sample_n(rows, ["k"], 100).count() == 100
    train, test = sampling.stratified_split(rows, "label", ["k"])
    assert (train.count(), test.count()) == (800, 200)
    assert {r["label"]: r["count"] for r in sampling.sample_capped(rows, "label", ["k"], 70).groupBy("label").count().collect()} == {0: 70, 1: 70}
    copies = spark.range(50).selectExpr("1 as k", "2 as x")
    assert sampling.sample_n(copies, ["k"], 7).count() == 7


def test_flows_of_files_and_in_time_order(spark):
    cols = "file string, pkt_seq bigint, ts double, src_ip string, src_port int, dst_ip string, dst_port int, proto int, length bigint, flags int"
    rows = [(f, i, base + 2.0 - i, "a", 1, "b", 2, 6, 10, 0) for f, base in (("x", 0.0), ("y", 1000.0)) for i in range(3)]
    packets = spark.createDataFrame(rows, cols)
    with pytest.raises(ValueError):
        flows.flow_features(packets)
    got = flows.flow_features(packets, by=["file"], seq="ts", chunk=600).collect()
    assert sorted((r["file"], r["duration"], r["mean_iat"], r["pkt_count"]) for r in got) == [("x", 2.0, 1.0, 3), ("y", 2.0, 1.0, 3)]


def test_directions_follow_time(spark):
    cols = "pkt_seq bigint, ts double, src_ip string, src_port int, dst_ip string, dst_port int, proto int, length bigint, flags int"
    rows = [(0, 9.0, "b", 2, "a", 1, 6, 10, 0), (1, 1.0, "a", 1, "b", 2, 6, 300, 0), (2, 3.0, "a", 1, "b", 2, 6, 20, 0)]
    packets = spark.createDataFrame(rows, cols)
    first = flows.flow_directions(packets).first()
    timed = flows.flow_directions(packets, order="ts").first()
    assert (first["fwd_packets"], first["bwd_packets"], first["fwd_bytes"]) == (1, 2, 10)
    assert (timed["fwd_packets"], timed["bwd_packets"], timed["fwd_bytes"], timed["len_min"], timed["len_max"], timed["duration"]) == (2, 1, 320, 10, 300, 8.0)


def test_unpacking_in_small_steps(tmp_path):
    import bz2

    text = bytes(range(256)) * 4000
    good = {"a.gz": gzip.compress(text) + gzip.compress(b"more") * 3, "b.bz2": bz2.compress(text) + bz2.compress(b"more") * 3}
    for name, packed in good.items():
        path = tmp_path / name
        for body, want in ((packed, "ok"), (packed[:-3], "cut off"), (packed[: len(packed) // 3], "cut off"), (b"no such thing" * 9, "unreadable"), (packed + b"x" * 40, "unreadable"), (b"", "ok")):
            path.write_bytes(body)
            for step in (7, 100, 1 << 20):
                assert tables.unpacks(str(path), step) == want, (name, want, step)
    assert tables.unpacks(f"file://{tmp_path}/gone.gz") == "unreadable"
