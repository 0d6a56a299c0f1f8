"""Deterministic random order, exact quotas and running totals without hot tasks.

Nothing here sorts a whole class or a whole table in one task: an order is cut
into ranges first, counts per range are summed up in a small table, and only the
rows of a single range are ever ranked.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType
from pyspark.sql.window import Window as W

from packetloom.functions.dims import attach, bounded

#: Rows of one range of an order that is worked through range by range.
RANGE_ROWS = 100_000
#: 4 hex digits of the digest: 65,536 ranges of a uniform key.
_RANGE_DIGITS = 4


def digest(key: list[str], seed: int | str) -> Column:
    """Random-looking 32-digit key of a row, equal on every engine and run.

    ``key`` columns should be integers or text, whose string form is portable.
    """
    return F.md5(F.concat(F.concat_ws("|", *[F.col(k).cast("string") for k in key]), F.lit(f":{seed}")))


def digest_unit(text: Column) -> Column:
    """Number in [0, 1] out of the first 8 hex digits of the md5 of ``text``."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967295.0)


def digest_normal(text: Column) -> Column:
    """Standard normal number out of the md5 of ``text`` (polar form of two uniforms)."""
    h = F.md5(text)
    u = (F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") + 1) / F.lit(4294967296.0)
    w = F.conv(F.substring(h, 9, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
    return F.sqrt(-2 * F.log(u)) * F.cos(w * 2 * F.pi())


def digest_int(text: Column, n: Column | int) -> Column:
    """Integer in [0, n) out of the md5 of ``text``."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % n


def repeat_rows(df: DataFrame, times: str, number: str = "__no") -> DataFrame:
    """Each row ``times`` times, numbered from 1; the copies are made in two bounded steps."""
    step = 4096
    blocks = F.ceil(F.col(times) / step).cast("int")
    return (
        df.filter(F.col(times) > 0)
        .withColumn("__blk", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumn("__in", F.least(F.lit(step), F.col(times) - F.col("__blk") * step).cast("int"))
        .withColumn("__rep", F.explode(F.sequence(F.lit(1), F.col("__in"))))
        .withColumn(number, F.col("__blk").cast("bigint") * step + F.col("__rep"))
        .drop("__blk", "__in", "__rep")
    )


def mark_quota(
    df: DataFrame,
    by: list[str],
    quota: Callable[[Column, Column], Column],
    key: list[str],
    seed: int = 42,
    out: str = "picked",
    unique_key: bool = False,
) -> DataFrame:
    """Flag exactly ``quota(class_rows, all_rows)`` rows of each class.

    The rows with the smallest digest of ``key`` are taken. A histogram of digest
    prefixes per class (a small shuffle) finds the prefix in which the quota
    ends, the rows of that single prefix give the cut-off digest, and the flag
    is then a comparison on the rows in place. The rows are never shuffled or
    sorted, so a class holding most rows costs no more than any other.

    Rows sharing a cut-off digest, because their keys are equal, are told apart by
    all their columns and counted as copies, so sizes are exact for any key.
    ``unique_key=True`` skips looking for them.
    """
    spark_cols = df.columns
    whole = not by
    if whole:
        df = df.withColumn("__all", F.lit(0))
        by = ["__all"]
    keyed = df.withColumn("__h", digest(key, seed))
    slim = keyed.select(*by, "__h").withColumn("__b", F.substring("__h", 1, _RANGE_DIGITS))

    hist = slim.groupBy(*by, "__b").agg(F.count("*").alias("__n"))
    totals = hist.groupBy(*by).agg(F.sum("__n").alias("__nc"))
    total = totals.agg(F.sum("__nc").alias("__nt"))
    in_class = W.partitionBy(*by).orderBy("__b")
    ends = (
        hist.select(
            *by,
            "__b",
            (F.sum("__n").over(in_class) - F.col("__n")).alias("__before"),
            F.sum("__n").over(in_class).alias("__upto"),
            F.sum("__n").over(W.partitionBy(*by)).alias("__nc"),
        )
        .withColumn("__q", quota(F.col("__nc"), total.scalar()).cast("bigint"))
        .withColumn("__q", F.least("__q", "__nc"))
        .filter((F.col("__before") < F.col("__q")) & (F.col("__upto") >= F.col("__q")))
        .select(*by, "__b", (F.col("__q") - F.col("__before")).alias("__left"))
    )
    edge = attach(slim, ends, [*by, "__b"])
    run = W.partitionBy(*by).orderBy("__h")
    cuts = (
        edge.groupBy(*by, "__h", "__left")
        .agg(F.count("*").alias("__n"))
        .withColumn("__upto", F.sum("__n").over(run))
        .filter((F.col("__upto") >= F.col("__left")) & (F.col("__upto") - F.col("__n") < F.col("__left")))
        .select(*by, F.col("__h").alias("__cut"), (F.col("__left") - F.col("__upto") + F.col("__n")).alias("__take"), F.col("__n").alias("__same"))
    )
    if whole:  # a single cut-off, as literals
        cut = cuts.first()
        unique_key = unique_key or cut is None or cut["__same"] == 1
        cut, take = (cut["__cut"], cut["__take"]) if cut else (None, 0)
        marked = keyed.withColumns({"__cut": F.lit(cut).cast("string"), "__take": F.lit(take).cast("bigint")})
    else:
        cuts, small = bounded(cuts)
        unique_key = unique_key or (small and not cuts.filter(F.col("__same") > 1).head(1))
        marked = attach(keyed, cuts.drop("__same"), by, "left")
    if unique_key:
        return marked.select(*spark_cols, F.coalesce(F.col("__h") <= F.col("__cut"), F.lit(False)).alias(out))

    sure = marked.filter(~F.coalesce(F.col("__h") == F.col("__cut"), F.lit(False))).select(
        *spark_cols, F.coalesce(F.col("__h") < F.col("__cut"), F.lit(False)).alias(out)
    )
    tied = marked.filter(F.col("__h") == F.col("__cut")).groupBy(*by, *[c for c in spark_cols if c not in by], "__take")
    tied = tied.agg(F.count("*").alias("__n"))
    order = W.partitionBy(*by).orderBy(*[c for c in spark_cols if c not in by])
    tied = tied.withColumn("__before", F.sum("__n").over(order) - F.col("__n")).withColumn(
        "__in", F.least(F.greatest(F.col("__take") - F.col("__before"), F.lit(0)), F.col("__n"))
    )
    yes = repeat_rows(tied, "__in").select(*spark_cols, F.lit(True).alias(out))
    no = repeat_rows(tied.withColumn("__out", F.col("__n") - F.col("__in")), "__out").select(
        *spark_cols, F.lit(False).alias(out)
    )
    return sure.unionByName(yes).unionByName(no)


def range_splits(df: DataFrame, col: str, parts: int) -> list[float]:
    """About ``parts`` equally filled ranges of ``col``: a few numbers."""
    qs = [i / parts for i in range(1, parts)]
    found = df.agg(F.percentile_approx(col, qs, 1000).alias("s")).first()["s"] or []
    return [float("-inf"), *sorted({float(v) for v in found}), float("inf")]


def running_totals(
    df: DataFrame,
    by: list[str],
    order: str,
    sums: list[str],
    descending: bool = True,
    parts: int | None = None,
) -> DataFrame:
    """Cumulative ``sums`` in the order of the distinct numeric column ``order``.

    Two levels: totals per range of ``order`` give each range its start value,
    the sums inside a range run locally. ``df`` must hold one row per
    (``by``, ``order``), which is what aggregating first gives. Without ``parts``
    a range holds about ``RANGE_ROWS`` of its rows: store it first.
    """
    parts = parts or min(max(8, df.count() // RANGE_ROWS), 10_000)
    splits = range_splits(df, order, parts)
    if len(splits) > 2:
        cut = Bucketizer(splits=splits, inputCol=order, outputCol="__r", handleInvalid="keep")
        df = cut.transform(df)
    else:
        df = df.withColumn("__r", F.lit(0.0))
    sort = F.desc if descending else F.asc
    before = W.partitionBy(*by).orderBy(sort("__r")) if by else W.orderBy(sort("__r"))
    starts = df.groupBy(*by, "__r").agg(*[F.sum(c).alias(f"__t_{c}") for c in sums])
    starts = starts.select(
        *by, "__r", *[(F.sum(f"__t_{c}").over(before) - F.col(f"__t_{c}")).alias(f"__s_{c}") for c in sums]
    )
    local = W.partitionBy(*by, "__r").orderBy(sort(order))
    out = attach(df, starts, [*by, "__r"])
    for c in sums:
        out = out.withColumn(f"cum_{c}", F.sum(c).over(local) + F.col(f"__s_{c}"))
    return out.drop("__r", *[f"__s_{c}" for c in sums])


def numbered(df: DataFrame, order: Column, ties: list[str], out: str, by: list[str] | None = None) -> DataFrame:
    """Numbers rows from 0 in the order of a digest, within ``by``.

    Ranges of the digest are counted first; a task orders the rows of one range and
    starts where the ranges before it end. ``df`` is read twice: store it first.
    """
    by = by or []
    digits = 1
    while df.count() > RANGE_ROWS * 16**digits and digits < 6:
        digits += 1
    keyed = df.withColumn("__h", order).withColumn("__b", F.substring("__h", 1, digits))
    counts = keyed.groupBy(*by, "__b").agg(F.count("*").alias("__n"))
    before = W.partitionBy(*by).orderBy("__b") if by else W.orderBy("__b")
    starts = counts.select(*by, "__b", (F.sum("__n").over(before) - F.col("__n")).alias("__start"))
    local = F.row_number().over(W.partitionBy(*by, "__b").orderBy("__h", *ties)) - 1
    placed = attach(keyed.withColumn(out, local), starts, [*by, "__b"])
    return placed.withColumn(out, F.col(out) + F.col("__start")).drop("__h", "__b", "__start")


def below_quotas(df: DataFrame, order: Column, ties: list[str], by: list[str], quotas: dict[str, Column]) -> DataFrame:
    """Adds a flag per quota: whether the row ranks below it, within ``by``, in the order of a digest.

    Quotas are made of ``n``, the rows of the class. Ranges of the digest are counted; only
    rows of a range in which a quota ends are ranked, all others stay where they are.
    ``df`` is read three times: store it first.
    """
    digits = 1
    while df.count() > RANGE_ROWS * 16**digits and digits < _RANGE_DIGITS:
        digits += 1
    keyed = df.withColumn("__h", order).withColumn("__b", F.substring("__h", 1, digits))
    counts = keyed.groupBy(*by, "__b").agg(F.count("*").alias("__n"))
    before = W.partitionBy(*by).orderBy("__b")
    starts = counts.select(*by, "__b", "__n", (F.sum("__n").over(before) - F.col("__n")).alias("__start"), F.sum("__n").over(W.partitionBy(*by)).alias("n"))
    ends = {f"__q{i}": q.cast("bigint") for i, q in enumerate(quotas.values())}
    starts = starts.withColumns(ends)
    split = F.lit(False)
    for c in ends:
        split = split | ((F.col(c) > F.col("__start")) & (F.col(c) < F.col("__start") + F.col("__n")))
    starts, _ = bounded(starts.select(*by, "__b", "__start", split.alias("__split"), *ends))
    placed = attach(keyed, starts, [*by, "__b"])
    local = F.row_number().over(W.partitionBy(*by, "__b").orderBy("__h", *ties)) - 1
    near = placed.filter("__split").withColumn("__start", F.col("__start") + local)
    flagged = placed.filter("NOT __split").unionByName(near)
    return flagged.select(*df.columns, *[(F.col("__start") < F.col(c)).alias(name) for name, c in zip(quotas, ends)])


#: Consecutive rows of an order that are handed over together.
BLOCK_ROWS = 256


def in_blocks(df: DataFrame, at: str) -> DataFrame:
    """Rows numbered from 0 by ``at`` as (blk, rows): arrays of ``BLOCK_ROWS`` consecutive rows."""
    packed = F.sort_array(F.collect_list(F.struct(at, *[c for c in df.columns if c != at])))
    return df.groupBy(F.expr(f"{at} div {BLOCK_ROWS}").alias("blk")).agg(packed.alias("rows"))


def handed_round(blocks: DataFrame, n: int, hands: list[tuple[int, list[str]]]) -> DataFrame:
    """Each of ``n`` rows with numbers of other rows: (blk, row, h0, h1, ...).

    For each hand (steps, columns), the row at place ``i`` gets these columns of the row
    at ``(i + steps) % n`` as an array of doubles. Blocks are sent in whole stretches, so what
    moves is little more than the numbers themselves; the result is dealt by ``blk``.
    ``blocks`` (see ``in_blocks``) is read twice: store it first.
    """
    size = BLOCK_ROWS
    hand = F.explode(F.array(*[F.struct(F.lit(i).alias("hand"), F.lit(steps % n).cast("bigint").alias("steps")) for i, (steps, _) in enumerate(hands)])).alias("h")
    sent = blocks.select((F.col("blk") * size).alias("from"), F.size("rows").cast("bigint").alias("len"), *[F.col(f"rows.{c}").cast("array<double>").alias(f"v_{c}") for c in sorted({c for _, cs in hands for c in cs})], hand).select("*", "h.*")
    values = None
    for i, (_, columns) in enumerate(hands):
        own = F.array(*[F.col(f"v_{c}") for c in columns])
        values = F.when(F.col("hand") == i, own) if values is None else values.when(F.col("hand") == i, own)
    # a stretch ends with the block it is for, and with the last row: three at most
    sent = sent.select("hand", "len", values.alias("v"), F.pmod(F.col("from") - F.col("steps"), F.lit(n)).alias("r0"), F.lit(0).cast("bigint").alias("o0"))
    for i in range(3):
        room = F.least(F.col("len") - F.col(f"o{i}"), size - F.col(f"r{i}") % size, n - F.col(f"r{i}"))
        sent = sent.withColumn(f"l{i}", room).withColumns({f"o{i + 1}": F.col(f"o{i}") + F.col(f"l{i}"), f"r{i + 1}": (F.col(f"r{i}") + F.col(f"l{i}")) % n})
    parts = F.array(*[F.struct(F.col(f"r{i}").alias("r"), F.col(f"o{i}").alias("o"), F.col(f"l{i}").alias("l")) for i in range(3)])
    sent = sent.select("hand", "v", F.explode(F.filter(parts, lambda x: x["l"] > 0)).alias("x"))
    cut = F.transform("v", lambda a: F.slice(a, (F.col("x.o") + 1).cast("int"), F.col("x.l").cast("int")))
    sent = sent.select(F.expr(f"x.r div {size}").alias("blk"), F.struct("hand", F.col("x.r").alias("r"), cut.alias("v")).alias("piece"))
    got = sent.groupBy("blk").agg(F.sort_array(F.collect_list("piece")).alias("got"))
    met = blocks.join(got, "blk")

    def values_of(i: int, j: int) -> Column:
        return F.flatten(F.transform(F.filter("got", lambda x: x["hand"] == i), lambda x: x["v"][j]))

    lists = {f"h{i}_{j}": values_of(i, j) for i, (_, columns) in enumerate(hands) for j in range(len(columns))}
    flat = met.select("blk", "rows", *[c.alias(name) for name, c in lists.items()])
    rows = flat.select("blk", F.inline(F.arrays_zip("rows", *lists)))
    return rows.select("blk", F.col("rows").alias("row"), *[F.array(*[f"h{i}_{j}" for j in range(len(columns))]).alias(f"h{i}") for i, (_, columns) in enumerate(hands)])


#: A missing number on its way in a block.
_MISSING = np.uint64(0x7FF8_0000_0BAD_0BAD)


def handed_across(rows: DataFrame, at: str, n: int, hands: list[tuple[int, int, str]]) -> DataFrame:
    """Each of ``n`` rows numbered from 0 by ``at`` with numbers of other rows in ``handed``, an array of doubles.

    For each hand (a, b, column), a without a factor in common with ``n``, the row at place
    ``i`` gets the column of the row at ``(a i + b) % n``. The numbers go from block to block,
    eight bytes each: both sides know by arithmetic which row a number is for.
    ``rows`` is read twice: store it first.
    """
    size = max(BLOCK_ROWS, math.isqrt(64 * n))  # what one block sends another is some 64 numbers
    columns = sorted({c for _, _, c in hands})

    def moved(a: int, b: int, places: np.ndarray) -> np.ndarray:
        if n > 3_000_000_000:  # the product passes 64 bits
            return ((places.astype(object) * a + b) % n).astype(np.int64)
        return (a * places % n + b) % n

    def send(block: pa.Table) -> pa.Table:
        places = block[at].to_numpy()
        parts = []
        for i, (a, b, c) in enumerate(hands):
            back = pow(a, -1, n)
            to = moved(back, -b * back % n, places)
            order = np.argsort(to)
            values = block[c].to_numpy().copy()
            values.view(np.uint64)[block[c].is_null().to_numpy()] = _MISSING
            blk, values = to[order] // size, values[order]
            first = np.flatnonzero(np.r_[True, blk[1:] != blk[:-1]])
            ends = np.r_[first, len(blk)].astype(np.int32) * 8
            cut = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(values.tobytes())])
            parts.append(pa.table({"__blk": blk[first], "hand": np.full(len(first), i, np.int32), "source": np.full(len(first), places[0] // size), "v": cut}))
        return pa.concat_tables(parts)

    def receive(block: pa.Table, got: pa.Table) -> pa.Table:
        places = block[at].to_numpy()
        got = got.sort_by([("hand", "ascending"), ("source", "ascending")])
        values = np.frombuffer(b"".join(got["v"].to_pylist()), np.float64).reshape(len(hands), len(places))
        block = block.drop_columns(["__blk"]).take(pa.array(np.argsort(places)))
        places = np.sort(places)
        handed = np.empty((len(places), len(hands)))
        for i, (a, b, _) in enumerate(hands):
            # of one source the numbers come in the order of the places they are for
            handed[np.argsort(moved(a, b, places) // size, kind="stable"), i] = values[i]
        flat = handed.ravel()
        ends = np.arange(len(places) + 1, dtype=np.int32) * len(hands)
        return block.append_column("handed", pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, mask=flat.view(np.uint64) == _MISSING)))

    blocks = rows.withColumn("__blk", F.expr(f"{at} div {size}"))
    slim = blocks.select("__blk", at, *[F.col(c).cast("double").alias(c) for c in columns])
    sent = slim.groupBy("__blk").applyInArrow(send, "__blk long, hand int, source long, v binary")
    out = StructType([*rows.schema.fields, StructField("handed", ArrayType(DoubleType()))])
    return blocks.groupBy("__blk").cogroup(sent.groupBy("__blk")).applyInArrow(receive, out)
