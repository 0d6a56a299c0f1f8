"""Exact interpolated quantiles of any number of columns.

``median`` and ``percentile`` keep every distinct value of a column in one
buffer. Here a sketch brackets the wanted rank, counting narrows the bracket, and
only the few values inside it are ordered.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from packetloom.functions.missing import finite_or_null

#: Bracket size that may be ordered as one list of distinct values.
_MAX_BRACKET = 1_000_000
_ACCURACY = 10_000


def exact_quantiles(df: DataFrame, cols: list[str], qs: list[float]) -> dict[str, dict[float, float | None]]:
    """``{column: {q: value}}`` over the finite values, linear interpolation.

    Each round is one aggregate over the needed columns only and narrows a bracket to
    about a thirtieth, until what is in it may be ordered. The driver holds a few numbers per column and quantile.
    """
    cols = list(dict.fromkeys(cols))
    data = df.select(*[finite_or_null(c).cast("double").alias(c) for c in cols])
    names = [(c, q, f"{i}_{j}") for i, c in enumerate(cols) for j, q in enumerate(qs)]

    margin = 2.0 / _ACCURACY
    aggs = []
    for i, c in enumerate(cols):
        probes = [p for q in qs for p in (max(q - margin, 0.0), min(q + margin, 1.0))]
        aggs += [F.count(c).alias(f"n{i}"), F.percentile_approx(c, probes, _ACCURACY).alias(f"p{i}")]
        aggs += [F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}")]
    first = data.agg(*aggs).first()

    result: dict[str, dict[float, float | None]] = {c: {} for c in cols}
    open_: dict[str, dict] = {}
    for c, q, tag in names:
        i, j = (int(x) for x in tag.split("_"))
        n = first[f"n{i}"]
        if not n:
            result[c][q] = None
            continue
        pos = q * (n - 1)
        lo, hi = first[f"p{i}"][2 * j], first[f"p{i}"][2 * j + 1]
        open_[tag] = {
            "c": c, "q": q, "k": math.floor(pos), "frac": pos - math.floor(pos), "n": n,
            "lo": lo, "hi": hi, "min": first[f"lo{i}"], "max": first[f"hi{i}"],
        }

    while open_:
        checks = []
        for tag, s in open_.items():
            inside = (F.col(s["c"]) >= s["lo"]) & (F.col(s["c"]) <= s["hi"])
            checks += [
                F.count_if(F.col(s["c"]) < s["lo"]).alias(f"below_{tag}"),
                F.count_if(inside).alias(f"in_{tag}"),
                F.percentile_approx(F.when(inside, F.col(s["c"])), [i / 64 for i in range(65)], _ACCURACY).alias(f"p_{tag}"),
            ]
        seen = data.agg(*checks).first()
        again = False
        for tag, s in open_.items():
            below, inside = seen[f"below_{tag}"], seen[f"in_{tag}"]
            top = min(s["k"] + 1, s["n"] - 1)
            s["below"] = below
            if s["k"] < below or top >= below + inside:
                # the sketch missed: widen to the whole column on that side
                s["lo"] = s["min"] if s["k"] < below else s["lo"]
                s["hi"] = s["max"] if top >= below + inside else s["hi"]
                # a bracket that misses again is not narrowed any more
                s["missed"] = s.get("missed", 0) + 1
                s["stuck"] = s["missed"] > 1
                again = True
            elif inside > _MAX_BRACKET and s["lo"] < s["hi"] and not s.get("stuck"):
                marks = seen[f"p_{tag}"]
                at = lambda r: (r - below) / inside * 64
                lo = marks[max(math.floor(at(s["k"])) - 1, 0)]
                hi = marks[min(math.ceil(at(top)) + 1, 64)]
                s["stuck"] = (lo, hi) == (s["lo"], s["hi"])
                s["lo"], s["hi"] = lo, hi
                again = True
        if not again:
            break
    # order the distinct values of each bracket; hot values are one counted row
    if open_:
        hits = F.array(
            *[
                F.when(
                    (F.col(s["c"]) >= s["lo"]) & (F.col(s["c"]) <= s["hi"]),
                    F.struct(F.lit(tag).alias("tag"), F.col(s["c"]).alias("v")),
                )
                for tag, s in open_.items()
            ]
        )
        inside = data.select(F.explode(F.array_compact(hits)).alias("h")).select("h.tag", "h.v")
        ranks = inside.groupBy("tag", "v").agg(F.count("*").alias("n"))
        ranks = ranks.withColumn("upto", F.sum("n").over(W.partitionBy("tag").orderBy("v")))
        wanted = None
        for tag, s in open_.items():
            for k in {s["k"], min(s["k"] + 1, s["n"] - 1)}:
                k_in = k - s["below"]
                test = (F.col("tag") == tag) & (F.col("upto") > k_in) & (F.col("upto") - F.col("n") <= k_in)
                wanted = test if wanted is None else wanted | test
        rows = ranks.filter(wanted).collect()  # at most two values per quantile
        for tag, s in open_.items():
            mine = sorted((r["upto"] - r["n"], r["upto"], r["v"]) for r in rows if r["tag"] == tag)
            pick = lambda k: next(v for a, b, v in mine if a <= k - s["below"] < b)  # noqa: E731, B023
            lo, hi = pick(s["k"]), pick(min(s["k"] + 1, s["n"] - 1))
            result[s["c"]][s["q"]] = lo + (hi - lo) * s["frac"]
    return result
