"""Cleaning, labels, alignment, scaling and readers on small tables."""

import pytest
from pyspark.sql import functions as F

from packetloom.operators import clean, prep, profile, schema
from packetloom.sources import datasets as ds
from packetloom.sources import tables as src

INF, NAN = float("inf"), float("nan")


@pytest.fixture(scope="module")
def dirty(spark):
    rows = [(1.0, 1, "A"), (INF, 2, "A"), (-INF, 3, "B"), (NAN, 4, None), (None, 5, "B"), (4.0, None, "A"), (NAN, 4, None)]
    return spark.createDataFrame(rows, "rate double, n int, label string")


def test_missing_and_infinite(dirty):
    assert {r["column"]: r["missing"] for r in profile.missing_profile(dirty).collect()} == {"rate": 3, "n": 1, "label": 2}
    assert {r["column"]: r["infinite"] for r in profile.inf_profile(dirty).collect()} == {"rate": 2, "n": 0}
    assert profile.duplicate_count(dirty).first()[0] == 1
    assert [r["rate"] for r in clean.inf_to_null(dirty).collect()] == [1.0, None, None, None, None, 4.0, None]
    assert clean.drop_missing(dirty).count() == 3
    assert clean.keep_finite(dirty, ["rate", "n"]).count() == 1
    report = {(r["metric"], r["column"]): r["value"] for r in profile.quality_report(dirty, "label", "A").collect()}
    assert report[("missing", "rate")] == 3 and report[("attack", "label")] == 2 and report[("duplicates", None)] == 1


def test_median_is_interpolated(dirty):
    fixed = clean.median_impute(dirty)
    assert [r["rate"] for r in fixed.collect()] == [1.0, 2.5, 2.5, 2.5, 2.5, 4.0, 2.5]
    assert fixed.collect()[5]["n"] == 3.5


def test_labels(spark):
    names = ["  BENIGN ", "Web Attack \x96 XSS", "Web Attack \x96 Sql Injection", "DoS", "Heartbleed"]
    df = spark.createDataFrame([(n,) for n in names], "label string")
    fixed = clean.normalize_label(df, "label", clean.LABEL_REPAIRS)
    assert [r[0] for r in fixed.collect()] == ["BENIGN", "Web Attack XSS", "Web Attack Sql Injection", "DoS", "Heartbleed"]
    ruled = clean.apply_label_rules(df, "label", clean.LABEL_RULES)
    assert [r[0] for r in ruled.collect()] == ["  BENIGN ", "Web Attack XSS", "Web Attack Sql", "DoS", "Heartbleed"]
    merged = clean.merge_classes(ruled, "label", clean.RARE_LABELS)
    assert [r[0] for r in merged.collect()][2:] == ["Other Attack", "DoS", "Other Attack"]
    flags = spark.createDataFrame([(" benign",), ("x",), (None,)], "l string")
    assert [r[0] for r in flags.select(schema.text_label("l")).collect()] == [0, 1, None]
    nums = spark.createDataFrame([("0",), ("1",), (None,)], "l string")
    assert [r[0] for r in nums.select(schema.flag_label("l")).collect()] == [0, 1, None]


def test_rare_classes_and_codes(spark):
    df = spark.createDataFrame([("b",)] * 12 + [("a",)] * 10 + [("c",)] * 9 + [(None,)], "label string")
    kept = clean.drop_rare_classes(df, "label", 10)
    assert kept.count() == 22
    codes = prep.label_codes(kept, "label")
    assert sorted(map(tuple, codes.collect())) == [("a", 0), ("b", 1)]
    back = prep.label_decode(prep.label_encode(df, "label", codes), "label_code", codes)
    assert {(r["label"], r["label_code"], r["label_text"]) for r in back.collect()} == {("a", 0, "a"), ("b", 1, "b"), ("c", None, None), (None, None, None)}
    w = {r["label"]: r["weight"] for r in prep.class_weights(kept, "label").collect()}
    assert w == {"a": 22 / 20, "b": 22 / 24}


def test_alignment(spark):
    bot = spark.createDataFrame([(1.0, 2, "x")], "dur double, spkts int, extra string")
    two = schema.SchemaMap(schema.BOTIOT_MAP, {"flow_duration": 1000.0}).apply(bot, ["flow_duration", "total_fwd_packets"])
    assert tuple(two.first()) == (1000.0, 2.0)
    with pytest.raises(schema.MissingColumns, match="rate|flow_packets_s"):
        schema.SchemaMap(schema.BOTIOT_MAP).apply(bot, ["flow_duration", "flow_packets_s"])
    cic = spark.createDataFrame([(3.0, 4.0)], "`Flow Duration` double, `Flow Packets/s` double")
    assert schema.SchemaMap(schema.CIC_MAP).apply(cic, ["flow_duration", "flow_packets_s"]).columns == ["flow_duration", "flow_packets_s"]
    assert all(set(m.values()) == set(schema.FEATURES) for m in (schema.CIC_MAP, schema.BOTIOT_MAP, schema.UNSW_MAP, schema.TON_MAP))
    assert schema.resolve(cic, "flow duration ") == "Flow Duration"


def test_scaler(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("a", 3.0, 5.0), ("b", 10.0, 1.0)], "g string, x double, c double")
    s = prep.Scaler.fit(df.filter("g = 'a'"), ["x", "c"])
    assert [(r["x"], r["c"]) for r in s.transform(df).collect()] == [(-1.0, 0.0), (1.0, 0.0), (8.0, -4.0)]
    s.save(str(tmp_path / "s"))
    assert prep.Scaler.load(spark, str(tmp_path / "s")).transform(df).collect() == s.transform(df).collect()
    grouped = prep.Scaler.fit(df, ["x"], ["g"]).transform(df)
    assert sorted((r["g"], r["x"]) for r in grouped.collect()) == [("a", -1.0), ("a", 1.0), ("b", 0.0)]
    with pytest.raises(ValueError):
        prep.preprocess(df, ["x", "g"], "g", ["x"])


def test_readers(spark, tmp_path):
    (tmp_path / "mon.csv").write_text(" a ,b\n1,x\n2,y\n")
    (tmp_path / "tue.csv").write_text(" a ,b\n3,z\nbad,w\n")
    ddl = "a int, b string"
    good, status = src.read_csv_tolerant(spark, [str(tmp_path / "mon.csv"), str(tmp_path / "tue.csv")], spark.createDataFrame([], ddl).schema)
    assert sorted(r["b"] for r in good.collect()) == ["x", "y", "z"]
    assert sorted(map(tuple, status.collect())) == [("mon.csv", "ok", 2, 0, 0), ("tue.csv", "partly bad", 1, 1, 0)]
    tagged = src.read_csv_tagged(spark, {"Monday": str(tmp_path / "mon.csv"), "Tuesday": str(tmp_path / "tue.csv")}, "a string, b string")
    assert sorted((r["day"], r["a"]) for r in tagged.collect()) == [("Monday", "1"), ("Monday", "2"), ("Tuesday", "3"), ("Tuesday", "bad")]
    assert src.read_csv(spark, str(tmp_path), None, glob="m*.csv").dtypes == [("a", "int"), ("b", "string")]
    inv = src.file_inventory(spark, str(tmp_path), "*.csv")
    assert {(r["file"], r["bytes"]) for r in inv.collect()} == {("mon.csv", 14), ("tue.csv", 16)}
    assert src.folder_summary(inv).first()["files"] == 2
    assert src.uniform_flows(spark, 10, ["x"]).filter((F.col("x") >= 0) & (F.col("x") < 1)).count() == 10


def test_dataset_loaders(spark, tmp_path):
    cic = tmp_path / "cic"
    cic.mkdir()
    head = ", ".join([*schema.UNIFIED, "Label"])
    for i, label in enumerate([" BENIGN", "DDoS"]):
        (cic / f"{i}.csv").write_text(head + "\n" + ",".join(["1.5"] * 12) + f",{label}\n")
    df = ds.load_cic(spark, str(cic))
    assert sorted((r["label"], r["label_text"]) for r in df.collect()) == [(0, "BENIGN"), (1, "DDoS")]
    assert ds.align(df, "cic").columns == [*schema.FEATURES, "label"]

    bot = tmp_path / "bot"
    bot.mkdir()
    names = ["pkSeqID", "saddr", *schema.BOTIOT_MAP, "attack", "category", "subcategory "]
    (bot / "a.csv").write_text(",".join(names) + "\n" + ",".join(["7", "1.1.1.1", *["2"] * 12, "1", "DoS", "TCP"]) + "\n")
    df = ds.load_botiot(spark, str(bot))
    assert "saddr" not in df.columns and "subcategory" not in df.columns
    assert tuple(ds.align(df, "botiot", {"flow_duration": 1e6}).first())[:2] == (2e6, 2.0) and df.first()["label"] == 1

    row = spark.createDataFrame([(*[3.0] * 12, 0, "Normal")], [*schema.UNSW_MAP, "label", "attack_cat"])
    row.write.parquet(str(tmp_path / "u1"))
    row.write.parquet(str(tmp_path / "u2"))
    df = ds.load_unsw(spark, str(tmp_path / "u1"), str(tmp_path / "u2"))
    assert df.count() == 2 and {r["label_text"] for r in df.collect()} == {"Normal"} and ds.align(df, "unsw").first()["label"] == 0

    (tmp_path / "ton.csv").write_text(",".join([*schema.TON_MAP, "label"]) + "\n" + ",".join(["4"] * 12 + ["1"]) + "\n")
    assert ds.align(ds.load_ton(spark, str(tmp_path / "ton.csv")), "ton").first()["label"] == 1
