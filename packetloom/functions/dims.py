"""Joining per-class tables to rows without shuffling the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A per-class table up to this many rows is broadcast, a larger one is shuffled.
MAX_BROADCAST_ROWS = 20_000


def bounded(dim: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """``dim`` as a local table if it has at most ``max_rows`` rows.

    At most ``max_rows + 1`` rows reach the driver. The flag tells whether the
    bound held; if not, the distributed ``dim`` comes back unchanged.
    """
    rows = dim.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows:
        return dim, False
    if rows.num_rows == 0:
        # a list, an empty one too, would be read by Python workers of its own on every executor
        return dim.sparkSession.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in dim.schema]), True
    return dim.sparkSession.createDataFrame(rows, schema=dim.schema), True


def attach(
    df: DataFrame,
    dim: DataFrame,
    on: list[str],
    how: str = "inner",
    max_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Join a per-class table to ``df``; NULL keys match NULL keys.

    The table is broadcast only after its size was checked. Past the bound the
    join stays a shuffle join, whose skewed partitions AQE splits.
    """
    side, small = bounded(dim, max_rows)
    side = side.select(*[F.col(c).alias(f"__k_{c}") if c in on else F.col(c) for c in side.columns])
    if small:
        side = F.broadcast(side)
    cond = reduce(lambda a, b: a & b, [df[c].eqNullSafe(side[f"__k_{c}"]) for c in on])
    joined = df.join(side, cond, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"__k_{c}" for c in on])
