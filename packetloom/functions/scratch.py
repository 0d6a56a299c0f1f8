"""Shared scratch space for tables that must outlive a lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CONF = "spark.checkpoint.dir"
_LOCAL: dict[str, str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder path below the cluster's shared checkpoint folder.

    Only where all tasks run in the driver's process (``local[...]``, as in tests) may
    ``spark.checkpoint.dir`` be unset: then one folder of this machine serves the application.
    """
    context = spark.sparkContext
    root = spark.conf.get(_CONF, None) or context.getConf().get(_CONF, None) or _LOCAL.get(context.applicationId)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError(f"set {_CONF} to a folder all executors can reach")
        root = _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="spark-packetloom-")
    return f"{root.rstrip('/')}/packetloom/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """At least one partition per core, for a stored table that is read many times over.

    Large tables have that many already and are left alone. Counting the partitions
    of anything but a plain read would run its plan: store it first.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


#: Rows a task of a learner holds, some 350 bytes each there, whatever they take in a file.
TASK_ROWS = 1_000_000


def spread_rows(df: DataFrame) -> DataFrame:
    """Stored rows dealt over tasks by their number, where ``TASK_ROWS`` a core are not enough.

    Files of few distinct values hold so many rows in a split that a learner's task
    would read several GB of its cached rows. Fewer rows stay as they are read.
    """
    tasks = -(-df.count() // TASK_ROWS)
    if tasks <= df.sparkSession.sparkContext.defaultParallelism:
        return df
    return df.repartition(tasks, F.monotonically_increasing_id())  # equal rows do not meet


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage like ``checkpoint()`` but keeps column pruning and
    statistics, so several consumers reuse the result and a lost executor only
    costs a re-read.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
