"""Flow folding against a plain loop, whatever the chunk size."""

import math
import random

import pytest
from pyspark.sql import functions as F

from packetloom.operators.flows import flow_features, flow_flags, flow_key, flow_key_text, inter_arrival, to_unified

COLS = "pkt_seq bigint, ts double, src_ip string, src_port int, dst_ip string, dst_port int, proto int, length bigint, flags int"


def _packets(n=400, hot=0.4, seed=1):
    rnd = random.Random(seed)
    rows, ts = [], 1000.0
    for i in range(n):
        ts += rnd.choice([-0.5, 0.0, 0.25, 1.0, 30.0])  # times may run backwards
        host = 1 if rnd.random() < hot else rnd.randint(2, 40)
        a, b = (f"10.0.0.{host}", 5000 + host), ("10.9.9.9", 80)
        if rnd.random() < 0.5:
            a, b = b, a
        rows.append((i, ts, a[0], a[1], b[0], b[1], rnd.choice([6, 6, 6, 17]), rnd.randint(60, 1500), rnd.choice([0, 1, 2, 16])))
    return rows


def _loop(rows, idle=None):
    flows, current = {}, {}
    for r in rows:
        key = (*sorted([(r[2], r[3]), (r[4], r[5])]), r[6])
        no, last = current.get(key, (0, None))
        if idle is not None and last is not None and r[1] - last > idle:
            no += 1
        current[key] = (no, r[1])
        flows.setdefault((key, no), []).append(r)
    out = {}
    for (key, no), ps in flows.items():
        if len(ps) < 2:
            continue
        ts, ln = [p[1] for p in ps], [p[7] for p in ps]
        gaps = [b - a for a, b in zip(ts, ts[1:])]
        d = max(ts[-1] - ts[0], 1e-9)
        sd = lambda x: math.sqrt(sum((v - sum(x) / len(x)) ** 2 for v in x) / len(x))
        fl = 0
        for p in ps:
            fl |= p[8]
        out[(str(key), no)] = (d, len(ps), sum(ln), sum(ln) / len(ln), sd(ln), sum(gaps) / len(gaps), sd(gaps), sum(ln) / d, len(ps) / d, int(bool(fl & 2)), int(bool(fl & 1)))
    return out


@pytest.mark.parametrize("chunk", [1, 3, 50, 1_000_000])
@pytest.mark.parametrize("idle", [None, 20.0])
def test_features_equal_a_plain_loop(spark, chunk, idle):
    rows = _packets()
    df = spark.createDataFrame(rows, COLS).repartition(5)
    got = flow_features(df, chunk=chunk, idle=idle, digits=None).collect()
    want = _loop(rows, idle)
    assert len(got) == len(want)
    for r in got:
        w = want[(r["flow_key"], r["flow_no"] if idle else 0)]
        g = (r["duration"], r["pkt_count"], r["total_bytes"], r["mean_pkt_len"], r["std_pkt_len"], r["mean_iat"], r["std_iat"], r["bytes_per_sec"], r["pkts_per_sec"], r["has_syn"], r["has_fin"])
        assert g == pytest.approx(w, rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("chunk", [2, 1_000_000])
def test_gaps(spark, chunk):
    rows = _packets(200)
    df = flow_key(spark.createDataFrame(rows, COLS))
    got = {r["pkt_seq"]: r["gap"] for r in inter_arrival(df, chunk=chunk).collect()}
    last = {}
    for r in rows:
        key = (*sorted([(r[2], r[3]), (r[4], r[5])]), r[6])
        want = r[1] - last[key] if key in last else None
        assert got[r[0]] == want
        last[key] = r[1]


def test_single_packets_equal_times_and_both_directions(spark):
    rows = [
        (0, 5.0, "1.1.1.1", 9, "2.2.2.2", 8, 6, 100, 2),
        (1, 5.0, "2.2.2.2", 8, "1.1.1.1", 9, 6, 200, 1),
        (2, 6.0, "3.3.3.3", 1, "2.2.2.2", 8, 6, 100, 0),
        (3, 7.0, "1.1.1.1", 9, "2.2.2.2", 8, 17, 100, 0),
    ]
    df = spark.createDataFrame(rows, COLS)
    r = flow_features(df).collect()
    assert len(r) == 1
    assert (r[0]["flow_key"], r[0]["pkt_count"], r[0]["duration"], r[0]["has_syn"], r[0]["has_fin"]) == ("(('1.1.1.1', 9), ('2.2.2.2', 8), 6)", 2, 0.0, 1, 1)
    assert r[0]["pkts_per_sec"] == pytest.approx(2e9)
    assert flow_flags(df).count() == 3
    same_host = spark.createDataFrame([(0, 1.0, "1.1.1.1", 90, "1.1.1.1", 8, 6, 1, 0)], COLS)
    assert flow_key(same_host).select(flow_key_text()).first()[0] == "(('1.1.1.1', 8), ('1.1.1.1', 90), 6)"


def test_captures_stay_apart(spark):
    rows = [(i, float(i), "1.1.1.1", 9, "2.2.2.2", 8, 6, 100, 0) for i in range(4)]
    df = spark.createDataFrame(rows, COLS).withColumn("file", (F.col("pkt_seq") % 2).cast("string"))
    assert [r["pkt_count"] for r in flow_features(df, ["file"]).collect()] == [2, 2]


def test_unified_row(spark):
    df = spark.createDataFrame([(2.0, 4, 40, 10.0, 12.0, 2.0, 20.0)], "duration double, pkt_count bigint, total_bytes bigint, mean_pkt_len double, std_pkt_len double, pkts_per_sec double, bytes_per_sec double")
    assert tuple(to_unified(df).first()) == (2.0, 4.0, 4.0, 40.0, 40.0, 2.0, 20.0, 20.0, 0.0, 22.0, 10.0, 12.0)
