"""Queries over alignment, unions, samples, splits, scaling, weights and balancing."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.functions.scratch import materialize
from packetloom.operators import neighbours as nb
from packetloom.operators import prep, sampling, schema
from packetloom.operators.hashed import Hashing, recall
from packetloom.operators.models import permutation_importance as permute
from packetloom.plans.registry import query
from packetloom.plans.views import FLOWS, KEY, MD5_KEY, NOISY, NUM, SHARED, SOURCES, Views, rounded

_KEYS = ", ".join(KEY)
_RANKED = f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {MD5_KEY}) AS rn,
  count(*) OVER (PARTITION BY label) AS n, count(*) OVER () AS total FROM flows)"""


@query(f"WITH {SOURCES} SELECT * FROM aligned WHERE source = 'B'")
def align_schema(v: Views):
    return v.aligned()["B"].withColumn("source", F.lit("B"))


@query(f"WITH {SOURCES} SELECT * FROM aligned")
def union_sources(v: Views):
    return schema.union_sources(v.aligned())


@query("SELECT l_returnflag AS label, l_quantity FROM lineitem")
def union_all(v: Views):
    li = v.table("lineitem").select(F.col("l_returnflag").alias("label"), "l_quantity", "l_linenumber")
    return schema.union_all(*[li.filter(F.col("l_linenumber") == i).drop("l_linenumber") for i in range(1, 8)])


@query(f"WITH {SOURCES} SELECT dur::DOUBLE AS dur, rate, mean, label, NULL AS sjit FROM raw_a UNION ALL SELECT dur, rate, NULL, label, sjit FROM raw_c")
def union_outer(v: Views):
    a = v.raw_a().select("dur", "rate", "mean", "label")
    c = v.raw_c().select(F.col("dur").cast("double").alias("dur"), "rate", "label", "sjit")
    return schema.union_outer(a, c)


@query(f"""WITH {SOURCES} SELECT source, count(*) AS rows, sum(label)::BIGINT AS attacks,
  {', '.join(f'round(avg({c}), 6) AS {c}' for c in SHARED)} FROM aligned GROUP BY source""")
def source_profile(v: Views):
    df = schema.union_sources(v.aligned())
    return rounded(df.groupBy("source").agg(F.count("*").alias("rows"), F.sum("label").alias("attacks"), *[F.avg(c).alias(c) for c in SHARED]))


_Z = ", ".join(f"round((a.{c} - m.{c}_mean) / CASE WHEN m.{c}_sd = 0 THEN 1 ELSE m.{c}_sd END, 4) + 0.0 AS {c}" for c in SHARED)
_STATS = ", ".join(f"avg({c}) AS {c}_mean, stddev_pop({c}) AS {c}_sd" for c in SHARED)


@query(f"WITH {SOURCES}, m AS (SELECT {_STATS} FROM aligned) SELECT a.source, a.rid, {_Z} FROM aligned a, m")
def pooled_scale(v: Views):
    pooled = schema.union_sources(v.aligned())
    scaled = prep.Scaler.fit(pooled, SHARED).transform(pooled)
    return rounded(scaled.select("source", "rid", *SHARED), 4)


@query(f"WITH {SOURCES}, m AS (SELECT source, {_STATS} FROM aligned GROUP BY source) SELECT a.source, a.rid, {_Z} FROM aligned a JOIN m USING (source)")
def scale_by_source(v: Views):
    pooled = schema.union_sources(v.aligned())
    scaled = prep.Scaler.fit(pooled, SHARED, ["source"]).transform(pooled)
    return rounded(scaled.select("source", "rid", *SHARED), 4)


@query(f"""WITH {FLOWS}, m AS (SELECT {', '.join(f'avg({c}) AS {c}_mean, stddev_pop({c}) AS {c}_sd' for c in NUM)} FROM flows)
SELECT {_KEYS}, {', '.join(f'round(({c} - {c}_mean) / {c}_sd, 4) + 0.0 AS {c}' for c in NUM)} FROM flows, m""")
def standard_scale(v: Views):
    df = v.flows().drop("label")
    return rounded(prep.Scaler.fit(df, NUM).transform(df), 4)


@query(f"WITH {FLOWS}, {_RANKED} SELECT {_KEYS}, label, rn <= round(0.2 * n) AS is_test FROM ranked")
def stratified_split(v: Views):
    return sampling.mark_split(v.flows(), "label", KEY).select(*KEY, "label", "is_test")


@query(f"""WITH {FLOWS} SELECT count(*) AS rows, count(*) FILTER (WHERE CAST('0x' || substr({MD5_KEY}, 1, 8) AS BIGINT) / 4294967296.0 < 0.2) AS test_rows FROM flows""")
def hash_split(v: Views):
    train, test = sampling.hash_split(v.flows(), KEY)
    n = train.agg(F.count("*").alias("n")).select("n").scalar()
    return test.agg(F.count("*").alias("test_rows")).select((n + F.col("test_rows")).alias("rows"), "test_rows")


@query(f"WITH {FLOWS}, {_RANKED} SELECT {_KEYS}, label FROM ranked WHERE rn <= least(n, floor(5000.0 * n / total))")
def sample_proportional(v: Views):
    return sampling.sample_proportional(v.flows(), "label", KEY, 5000).select(*KEY, "label")


@query(f"WITH {FLOWS}, {_RANKED} SELECT {_KEYS}, label FROM ranked WHERE rn <= 2000")
def sample_capped(v: Views):
    return sampling.sample_capped(v.flows(), "label", KEY, 2000).select(*KEY, "label")


@query(f"WITH {FLOWS} SELECT {_KEYS} FROM flows ORDER BY {MD5_KEY} LIMIT 3000")
def sample_n(v: Views):
    return sampling.sample_n(v.flows(), KEY, 3000).select(*KEY)


@query(f"WITH {FLOWS}, {_RANKED} SELECT {_KEYS}, label FROM ranked WHERE rn <= greatest(1, floor(greatest(floor(0.25 * total), 100) * n / total))")
def sample_fraction(v: Views):
    return sampling.sample_fraction(v.flows(), "label", KEY, 0.25).select(*KEY, "label")


@query(f"""WITH {FLOWS}, c AS (SELECT label, count(*) AS class_rows FROM flows GROUP BY label)
SELECT label, class_rows, round((SELECT sum(class_rows) / count(*) FROM c) / class_rows, 6) AS weight FROM c""")
def class_weights(v: Views):
    return rounded(prep.class_weights(v.flows(), "label"))


@query(f"""WITH {FLOWS}, ok AS (SELECT * FROM flows WHERE l_tax < 0.08),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {MD5_KEY}) <= round(0.2 * count(*) OVER (PARTITION BY label)) AS is_test FROM ok),
m AS (SELECT {', '.join(f'avg({c}) AS {c}_mean, stddev_pop({c}) AS {c}_sd' for c in NUM)} FROM r WHERE NOT is_test)
SELECT {_KEYS}, label, is_test, {', '.join(f'round(({c} - {c}_mean) / {c}_sd, 4) + 0.0 AS {c}' for c in NUM)} FROM r, m""")
def preprocess(v: Views):
    bad = v.flows().withColumn("l_tax", F.when(F.col("l_tax") < 0.08, F.col("l_tax")).otherwise(F.lit(float("inf"))))
    return rounded(prep.preprocess(bad, NUM, "label", KEY).rows, 4)


_RULE = "CASE WHEN {q} * 2 + {d} * 100 + {t} * 50 > 60 THEN 1 ELSE 0 END"


def _rule(df):
    hit = F.col("l_quantity") * 2 + F.col("l_discount") * 100 + F.col("l_tax") * 50 > 60
    return df.withColumn("pred", hit.cast("int"))


@query("SELECT l_returnflag AS label, least(count(*), 1000) AS rows FROM lineitem GROUP BY 1")
def sample_repeated_keys(v: Views):
    """Exact sizes although the key, the order alone, repeats."""
    rows = v.table("lineitem").select("l_orderkey", F.col("l_returnflag").alias("label"), "l_quantity")
    return sampling.sample_capped(rows, "label", ["l_orderkey"], 1000).groupBy("label").agg(F.count("*").alias("rows"))


_LINEAR = _RULE.format(q="l_quantity", d="l_discount", t="l_tax")


@query(f"""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax,
  CASE WHEN {NOISY} THEN 1 - {_LINEAR} ELSE {_LINEAR} END AS y FROM lineitem),
a AS (SELECT *, row_number() OVER (ORDER BY {MD5_KEY}, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, y) - 1 AS pos FROM s),
base AS (SELECT avg(CASE WHEN y = {_LINEAR} THEN 1 ELSE 0 END) AS acc FROM s),
runs AS (SELECT run, feature, n, coalesce(list_filter(list_transform(range(0, 64), lambda i: CAST('0x' || substr(md5('42:' || run || ':' || feature || ':' || i), 1, 15) AS BIGINT) % n), lambda a: gcd(a, n) = 1)[1], 1) AS a,
  CAST('0x' || substr(md5('42:' || run || ':' || feature || ':b'), 1, 15) AS BIGINT) % n AS b
  FROM (SELECT unnest(range(0, 10)) AS run), (SELECT unnest(['l_quantity', 'l_discount', 'l_tax']) AS feature), (SELECT count(*) AS n FROM s)),
c AS (SELECT a.*, run, feature, (runs.a * pos + b) % n AS other FROM a, runs),
x AS (SELECT run, feature, c.y, CASE WHEN feature = 'l_quantity' THEN d.l_quantity ELSE c.l_quantity END AS q,
  CASE WHEN feature = 'l_discount' THEN d.l_discount ELSE c.l_discount END AS d, CASE WHEN feature = 'l_tax' THEN d.l_tax ELSE c.l_tax END AS t FROM c JOIN a d ON d.pos = c.other),
p AS (SELECT feature, run, avg(CASE WHEN y = {_RULE.format(q='q', d='d', t='t')} THEN 1 ELSE 0 END) AS acc FROM x GROUP BY ALL)
SELECT feature, round(avg((SELECT acc FROM base) - acc), 6) AS importance, round(stddev_pop((SELECT acc FROM base) - acc), 6) AS sd FROM p GROUP BY feature""")
def permutation_importance(v: Views):
    """Accuracy that a linear rule loses on its own verdicts, one in sixteen of them turned round."""
    told = _rule(v.ruled_flows())
    df = told.withColumn("y", F.when(v.noisy(), 1 - F.col("pred")).otherwise(F.col("pred"))).drop("pred")
    return rounded(permute(_rule, df, ["l_quantity", "l_discount", "l_tax"], "y", KEY, repeats=10))


_PTS = "pts AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"
_WITHIN = f"""{_PTS}, near AS (
  SELECT a.vec_id, a.label, b.vec_id AS neighbour, list_distance(a.v, b.v) AS distance,
         row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS rank
  FROM pts a JOIN pts b ON a.label = b.label AND a.vec_id <> b.vec_id QUALIFY rank <= 3)"""


@query(f"WITH {_WITHIN} SELECT vec_id, label, rank, neighbour, round(distance, 6) AS distance FROM near")
def knn_within_class(v: Views):
    return rounded(nb.nearest(v.points(), "vec_id", "v", 3, "label"))


@query(f"WITH {_PTS} SELECT label, count(*) AS points, least(3, count(*) - 1) * count(*) AS neighbours, 1 AS recalled FROM pts GROUP BY label")
def knn_hashed(v: Views):
    """Approximate neighbours of every point: how many each class has, and whether nine tenths of the exact ones are found."""
    found = materialize(nb.nearest(v.points(), "vec_id", "v", 3, "label", Hashing()), "hashed")
    exact = nb.nearest(v.points(), "vec_id", "v", 3, "label")
    share = recall(found, exact, ["vec_id"]).first()["recall"]
    per = found.groupBy("label").agg(F.countDistinct("vec_id").alias("points"), F.count("*").alias("neighbours"))
    return per.withColumn("recalled", F.lit(int(share >= 0.9)))


@query(f"""WITH {_PTS}, near AS (
  SELECT a.vec_id AS first, b.vec_id AS second, a.label AS first_label, b.label AS second_label, list_distance(a.v, b.v) AS distance
  FROM pts a JOIN pts b ON a.vec_id <> b.vec_id
  QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) = 1)
SELECT n.first, n.second, n.first_label, n.second_label, round(n.distance, 6) AS distance
FROM near n JOIN near m ON n.first = m.second AND n.second = m.first WHERE n.first_label <> n.second_label AND n.first < n.second""")
def tomek_links(v: Views):
    return rounded(nb.tomek_links(v.points(), "vec_id", "v", "label"))


@query(f"""WITH {_WITHIN}, sizes AS (SELECT label, count(*) AS n FROM pts GROUP BY label), top AS (SELECT max(n) + 10 AS target FROM sizes),
need AS (SELECT label, n, target - n AS m FROM sizes, top WHERE label <= 2),
based AS (SELECT p.vec_id, p.label, p.v, m // n + CASE WHEN row_number() OVER (PARTITION BY p.label ORDER BY md5(p.vec_id || ':42')) <= m % n THEN 1 ELSE 0 END AS times
  FROM pts p JOIN need USING (label)),
copies AS (SELECT vec_id AS base, label, v, unnest(range(1, times + 1)) AS copy FROM based),
drawn AS (SELECT *, 1 + CAST('0x' || substr(md5(base || ':' || copy || ':42:n'), 1, 8) AS BIGINT) % 3 AS rank,
  CAST('0x' || substr(md5(base || ':' || copy || ':42:u'), 1, 8) AS BIGINT) / 4294967295.0 AS u FROM copies)
SELECT d.label, d.base, d.copy, n.neighbour, round(d.u, 6) AS u, CAST(i - 1 AS INTEGER) AS dim, round(d.v[i] + d.u * (q.v[i] - d.v[i]), 6) + 0.0 AS x
FROM drawn d JOIN near n ON n.vec_id = d.base AND n.rank = d.rank JOIN pts q ON q.vec_id = n.neighbour, (SELECT unnest(range(1, 65)) AS i)""")
def smote_targeted(v: Views):
    sizes = v.points().groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    rows = nb.oversample(v.points(), "vec_id", "v", "label", {0: sizes + 10, 1: sizes + 10, 2: sizes + 10}, 3)
    return rounded(rows.select("label", "base", "copy", "neighbour", "u", F.posexplode("v").alias("dim", "x")))


@query(f"""WITH {_WITHIN}, sizes AS (SELECT label, count(*) AS n FROM pts GROUP BY label),
need AS (SELECT label, n, (SELECT max(n) FROM sizes) - n AS m FROM sizes),
based AS (SELECT p.vec_id, p.label, p.v, m // n + CASE WHEN row_number() OVER (PARTITION BY p.label ORDER BY md5(p.vec_id || ':42')) <= m % n THEN 1 ELSE 0 END AS times
  FROM pts p JOIN need USING (label) WHERE m > 0),
copies AS (SELECT vec_id AS base, label, v, unnest(range(1, times + 1)) AS copy FROM based),
drawn AS (SELECT *, 1 + CAST('0x' || substr(md5(base || ':' || copy || ':42:n'), 1, 8) AS BIGINT) % 3 AS rank,
  CAST('0x' || substr(md5(base || ':' || copy || ':42:u'), 1, 8) AS BIGINT) / 4294967295.0 AS u FROM copies),
made AS (SELECT least(0, (SELECT min(vec_id) FROM pts)) - row_number() OVER (ORDER BY md5(d.base || '|' || d.copy || ':42'), d.base, d.copy) AS vec_id,
  list_transform(range(1, len(d.v) + 1), lambda i: d.v[i] + d.u * (q.v[i] - d.v[i])) AS v, d.label
  FROM drawn d JOIN near n ON n.vec_id = d.base AND n.rank = d.rank JOIN pts q ON q.vec_id = n.neighbour),
pool AS (SELECT vec_id, v, label FROM pts UNION ALL SELECT vec_id, v, label FROM made),
nn AS (SELECT a.vec_id, a.label, b.vec_id AS other, b.label AS other_label FROM pool a JOIN pool b ON a.vec_id <> b.vec_id
  QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) = 1),
gone AS (SELECT n.vec_id FROM nn n JOIN nn m ON n.vec_id = m.other AND n.other = m.vec_id WHERE n.label <> n.other_label)
SELECT vec_id, label, CAST(i - 1 AS INTEGER) AS dim, round(v[i], 6) + 0.0 AS x FROM pool, (SELECT unnest(range(1, 65)) AS i) WHERE vec_id NOT IN (SELECT vec_id FROM gone)""")
def oversample_and_clean(v: Views):
    return rounded(nb.oversample_and_clean(v.points(), "vec_id", "v", "label", 3).select("vec_id", "label", F.posexplode("v").alias("dim", "x")))


