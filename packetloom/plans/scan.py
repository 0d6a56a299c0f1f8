"""Queries over readers and writers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.functions.scratch import scratch_path
from packetloom.operators.profile import class_balance
from packetloom.operators.sampling import mark_split
from packetloom.plans.registry import query
from packetloom.plans.views import DIRTY, FLOWS, KEY, MD5_KEY, NUM, SCORED, Views, rounded
from packetloom.sources import tables as src

_COLS = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, label"
_DDL = "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, l_extendedprice double, l_discount double, l_tax double, label string"


@query("SELECT l_returnflag AS label, l_quantity, l_extendedprice FROM lineitem")
def scan_parquet(v: Views):
    """Two folders read as one table."""
    path = scratch_path(v.spark, "folders")
    rows = v.table("lineitem").select(F.col("l_returnflag").alias("label"), "l_quantity", "l_extendedprice")
    src.write_parquet(rows.filter("label = 'N'"), f"{path}/a")
    src.write_parquet(rows.filter("label <> 'N' or label is null"), f"{path}/b")
    return src.read_parquet(v.spark, f"{path}/a", f"{path}/b")


@query(f"WITH {FLOWS} SELECT * FROM flows ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 5")
def preview_limit(v: Views):
    return src.preview(v.flows(), 5, KEY)


@query(f"WITH {FLOWS} SELECT {_COLS} FROM flows")
def csv_roundtrip(v: Views):
    path = scratch_path(v.spark, "csv")
    src.write_csv(v.flows(), path)
    return src.read_csv(v.spark, path, _DDL)


@query(f"WITH {FLOWS} SELECT {_COLS} FROM flows")
def parquet_roundtrip(v: Views):
    path = scratch_path(v.spark, "parquet")
    src.write_parquet(v.flows(), path, ["label"])
    return src.read_parquet(v.spark, path)


@query(f"WITH {FLOWS} SELECT {_COLS} FROM flows WHERE label <> 'N'")
def scan_glob(v: Views):
    path = scratch_path(v.spark, "glob")
    for name in ("A", "R"):
        src.write_csv(v.flows().filter(F.col("label") == name), f"{path}/{name}")
    src.write_json(v.flows().filter(F.col("label") == "N"), f"{path}/N")
    return src.read_csv(v.spark, path, _DDL, glob="*.csv", recursive=True)


@query(f"""WITH {FLOWS} SELECT {_COLS.replace(', label', '')},
    CASE label WHEN 'A' THEN 'monday' WHEN 'N' THEN 'tuesday' ELSE 'friday' END AS day FROM flows""")
def scan_tagged_union(v: Views):
    path = scratch_path(v.spark, "tagged")
    v.flows().write.partitionBy("label").option("header", True).csv(path)
    files = {"monday": f"{path}/label=A", "tuesday": f"{path}/label=N", "friday": f"{path}/label=R"}
    return src.read_csv_tagged(v.spark, files, _DDL.replace(", label string", ""), "day")


@query(f"WITH {FLOWS} SELECT {_COLS} FROM flows WHERE l_linenumber <> 7")
def scan_tolerant(v: Views):
    path = scratch_path(v.spark, "tolerant")
    text = v.flows().withColumn("l_quantity", F.when(F.col("l_linenumber") == 7, "n/a?").otherwise(F.col("l_quantity").cast("string")))
    src.write_csv(text, path)
    good, _ = src.read_csv_tolerant(v.spark, path, v.spark.createDataFrame([], _DDL).schema)
    return good


@query("""SELECT CASE WHEN l_returnflag = 'N' THEN 'ok' ELSE 'partly bad' END AS status, count(*) FILTER (WHERE l_returnflag = 'N' OR l_linenumber <> 7) AS rows,
  count(*) FILTER (WHERE l_returnflag <> 'N' AND l_linenumber = 7) AS bad_rows, 0 AS empty_cells FROM lineitem GROUP BY 1""")
def scan_status(v: Views):
    """A clean file, and one with rows that break the schema."""
    path = scratch_path(v.spark, "status")
    clean = F.col("label") == "N"
    text = v.flows().withColumn("l_quantity", F.when(~clean & (F.col("l_linenumber") == 7), "n/a?").otherwise(F.col("l_quantity").cast("string")))
    src.write_csv(text.filter(clean), f"{path}/a")
    src.write_csv(text.filter(~clean), f"{path}/b")
    _, status = src.read_csv_tolerant(v.spark, [f"{path}/a", f"{path}/b"], v.spark.createDataFrame([], _DDL).schema)
    return status.filter("status <> 'empty'").groupBy("status").agg(F.sum("rows").alias("rows"), F.sum("bad_rows").alias("bad_rows"), F.sum("empty_cells").alias("empty_cells"))


_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows, 0 AS unlisted FROM {t}" for t in _TABLES))
def file_inventory(v: Views):
    """Rows of every table by the listing of its files; a file that holds rows and is not listed would show."""
    listed = src.file_inventory(v.spark, v.dir, "*.parquet").select("file", F.lit(1).alias("seen")).distinct()
    where = F.col("_metadata.file_path")
    rows = reduce(DataFrame.unionByName, [v.table(t).select(F.lit(t).alias("name"), F.element_at(F.split(where, "/"), -1).alias("file")).groupBy("name", "file").agg(F.count("*").alias("n")) for t in _TABLES])
    return rows.join(listed, "file", "left").groupBy("name").agg(F.sum("n").alias("rows"), F.count_if(F.col("seen").isNull()).cast("int").alias("unlisted"))


@query(f"""WITH {DIRTY} SELECT count(*) AS total, count(*) FILTER (WHERE label = 'N') AS normal,
    count(*) FILTER (WHERE label <> 'N') AS attack FROM dirty""")
def json_summary(v: Views):
    path = scratch_path(v.spark, "json")
    src.write_json(class_balance(v.dirty(), "label", "N").select("total", "normal", "attack"), path)
    return v.spark.read.schema("total bigint, normal bigint, attack bigint").json(path)


_UNITS = ", ".join(f"md5(label || ':' || no || ':{c}:42') AS h_{c}" for c in NUM)
_DRAW = ", ".join(
    f"round(sqrt(-2 * ln((CAST('0x' || substr(h_{c}, 1, 8) AS BIGINT) + 1) / 4294967296.0)) "
    f"* cos(CAST('0x' || substr(h_{c}, 9, 8) AS BIGINT) / 4294967296.0 * 2 * pi()) * {c}_sd + {c}_mean, 4) + 0.0 AS {c}"
    for c in NUM
)


@query(f"""WITH {FLOWS}, s AS (SELECT label, count(*) AS rows, {', '.join(f'avg({c}) AS {c}_mean, stddev_pop({c}) AS {c}_sd' for c in NUM)} FROM flows GROUP BY label),
r AS (SELECT *, unnest(range(1, rows + 1)) AS no FROM s), h AS (SELECT *, {_UNITS} FROM r)
SELECT label, no, {_DRAW} FROM h""")
def synthetic_flows(v: Views):
    aggs = [f(c).alias(f"{c}_{n}") for c in NUM for f, n in ((F.avg, "mean"), (F.stddev_pop, "sd"))]
    stats = v.flows().groupBy("label").agg(F.count("*").alias("rows"), *aggs)
    return rounded(src.synthetic_flows(stats, "rows", NUM, ["label"]), 4)


@query(f"""WITH {FLOWS}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY {MD5_KEY}) AS rn, count(*) OVER (PARTITION BY label) AS n FROM flows)
SELECT r.l_orderkey, r.l_linenumber, r.l_partkey, r.l_suppkey, l.l_linestatus
FROM ranked r JOIN lineitem l USING (l_orderkey, l_linenumber, l_partkey, l_suppkey) WHERE r.rn <= round(0.2 * r.n)""")
def lookup_by_key(v: Views):
    held_out = mark_split(v.flows(), "label", KEY).filter("is_test").select(*KEY)
    return src.lookup_by_key(held_out, v.table("lineitem"), KEY, ["l_linestatus"])


@query(f"WITH {SCORED} SELECT source, count(*) AS rows, round(1000.0 * count(*) / sum(score), 6) AS rows_per_s FROM scored GROUP BY source")
def throughput(v: Views):
    from packetloom.operators.summaries import rows_per_second

    per = v.scored().groupBy("source").agg(F.count("*").alias("rows"), F.sum("score").alias("ms"))
    return rounded(per.select("source", "rows", rows_per_second(F.col("rows"), F.col("ms")).alias("rows_per_s")))
