"""Documents that are alike word for word: exact similarity over word shingles.

Two texts are alike if their sets of five-word shingles (A-Z lower-cased) have a
Jaccard similarity of at least 4/5. SimHash links tie near copies cheaply; each link
is verified on the texts. What they miss is found by prefixes: shingles have one
order, rare ones first, and two alike texts of at most n shingles share one among
the first n - ceil(4n/5) + 1 of either. Pairs already in one group, and pairs whose
sizes, places of the shingle or signatures of the hashes rule it out, are left; the others are
verified on their texts, so the groups are those of brute force. What travels is
numbers: a shingle's hash, a text's id, place and counts. Before all pairs of a shingle
are made, its texts are held against a few leaders: the copies of a large group are
linked by about one pair a text, and pairs within one group are no longer made. Of the
pairs left the best one of each text is verified first, the others only if their texts
are still in two groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from packetloom.functions.dims import attach
from packetloom.functions.scratch import materialize
from packetloom.llm.components import components
from packetloom.llm.simhash import fingerprints, near_links

WORDS = 5
#: Least similarity as a fraction of integers.
LEAST = (4, 5)
#: A shingle in the prefixes of more texts than this comes last in the order, up to so many of them.
COMMON, MOST_COMMON = 32, 200_000
#: Ids of compared texts are broadcast up to this many: one whole number each, 8 MB.
MOST_IDS = 1_000_000
#: Texts that share one shingle are compared in blocks of this many.
BLOCK = 512
#: Orders of the texts; the first text of a shingle in each of them leads it. One is by the share of repeated shingles.
LEADERS = 3
#: Bits of a text's signature.
_BITS = 1024


def shingles(text: bytes | None) -> set[bytes]:
    """Shingles of a UTF-8 text; a shorter text is one shingle, without words too."""
    words = text.lower().split() if text else []
    if len(words) < WORDS:
        return {b" ".join(words)}
    return set(map(b" ".join, zip(*(words[i:] for i in range(WORDS)))))


def alike(a: bytes | None, b: bytes | None) -> bool:
    x, y = shingles(a), shingles(b)
    common = len(x & y)
    return common * LEAST[1] >= (len(x) + len(y) - common) * LEAST[0]


def _prefix(text: bytes | None, late: np.ndarray) -> tuple[int, np.ndarray, bytes]:
    """How many shingles there are, the hashes of the first ones in the order, and the signature.

    A bit of the signature tells whether an odd number of hashes falls on it. A shingle
    that only one of two texts holds turns one bit: these are no fewer than the bits
    in which the signatures differ, however long the texts are.
    """
    hashes = np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles(text)), np.uint64).view(np.int64))
    n = len(hashes)
    bits = np.packbits(np.bincount(hashes & (_BITS - 1), minlength=_BITS) & 1)
    if len(late):
        last = late[np.minimum(np.searchsorted(late, hashes), len(late) - 1)] == hashes
        hashes = np.concatenate([hashes[~last], hashes[last]])
    return n, hashes[: n + LEAST[0] * -n // LEAST[1] + 1], bits.tobytes()


def _prefixes(text: Column, late: np.ndarray) -> Column:
    @F.pandas_udf("n int, prefix array<long>, bits binary")
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_prefix(t, late) for t in texts], columns=["n", "prefix", "bits"])

    return of(text.cast("binary"))


def copy_of(text: Column) -> Column:
    """Digest of a text's words: equal for copies up to blanks and A-Z case.

    Declared non-deterministic, which it is not, so that joins on it do not make the
    planner work it out twice, by two Python workers a task.
    """

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([xxhash.xxh128_hexdigest(b" ".join((t or b"").lower().split())) for t in texts], dtype=object)

    return of.asNondeterministic()(text.cast("binary"))


def _verified(a: Column, b: Column) -> Column:
    @F.pandas_udf("boolean")
    def of(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([alike(x, y) for x, y in zip(xs, ys)], dtype=bool)

    return of(a, b)


def _texts_of(ids: DataFrame, unique: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, text) of the texts with these ids."""
    wanted = materialize(unique.join(ids, "id", "left_semi").select("id", "copy", "first"), "wanted")
    found = attach(docs, wanted.select(F.col("first").alias("doc_id")).distinct(), ["doc_id"], "left_semi", MOST_IDS)
    # of the rows with such a doc_id those whose text is meant
    found = found.select(F.col("doc_id").alias("first"), copy_of(F.col("text")).alias("copy"), F.col("text").cast("binary").alias("text"))
    return found.join(wanted, ["first", "copy"]).groupBy("id").agg(F.min("text").alias("text"))


def _true(pairs: DataFrame, docs: DataFrame, unique: DataFrame) -> DataFrame:
    """The pairs (a, b) of ids whose texts are alike."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = materialize(_texts_of(ids, unique, docs), "texts")
    both = pairs.join(texts.toDF("a", "x").hint("merge"), "a").join(texts.toDF("b", "y").hint("merge"), "b")
    return materialize(both.filter(_verified(F.col("x"), F.col("y"))).select("a", "b"), "alike")


def _share(x: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """What pairs (i, j) of rows can have in common at most, of all their hashes."""
    both = x["n"][i] + x["n"][j]
    return (both - _apart(x["bits"][i], x["bits"][j])) / 2 / both


def _can_be_alike(x: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs (i, j) of rows pass every bound that needs no text."""
    n, m = x["n"][i], x["n"][j]
    need = LEAST[0] * (n + m)
    # where the first shared shingle stands bounds how many there can be
    ok = (x["c"][i] != x["c"][j]) & (LEAST[1] * np.minimum(n, m) >= LEAST[0] * np.maximum(n, m))
    ok &= sum(LEAST) * np.minimum(n - x["at"][i], m - x["at"][j]) >= need
    left = np.flatnonzero(ok)
    for s in range(0, len(left), 1 << 16):
        p = left[s : s + (1 << 16)]
        ok[p] = _enough(n[p], m[p], x["bits"][i[p]], x["bits"][j[p]])
    return ok


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits the signatures (rows of x and y) differ."""
    return np.bitwise_count(x ^ y).sum(1, dtype=np.int64)


def _enough(n: np.ndarray, m: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the signatures (rows of x and y) leave room for what texts of n and m shingles need in common."""
    return sum(LEAST) * (n + m - _apart(x, y)) >= 2 * LEAST[0] * (n + m)


def _signatures(bits: pd.Series | list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, bits)), "<u8").reshape(-1, _BITS // 64)


def _not_ruled_out(n: Column, m: Column, x: Column, y: Column) -> Column:
    @F.pandas_udf("boolean")
    def of(n: pd.Series, m: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(_enough(n.to_numpy(np.int64), m.to_numpy(np.int64), _signatures(x), _signatures(y)))

    return of(n, m, x, y)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, share) of sorted rows (h, lo, hi, blk, id, c, n, at, bits); holds one open group at a time."""

    def done(x: dict[str, np.ndarray]) -> pa.RecordBatch:
        new = np.r_[True, (x["h"][1:] != x["h"][:-1]) | (x["lo"][1:] != x["lo"][:-1]) | (x["hi"][1:] != x["hi"][:-1])]
        group = np.cumsum(new)
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        shift = 1
        rows = np.arange(len(group))
        while len(rows):  # each row with the one `shift` further on, while that is of its group
            rows = rows[rows + shift < len(group)]
            rows = rows[group[rows + shift] == group[rows]]
            i, j = rows, rows + shift
            across = (x["lo"][i] == x["hi"][i]) | (x["blk"][i] != x["blk"][j])
            i, j = i[across], j[across]
            fit = _can_be_alike(x, i, j)
            i, j = i[fit], j[fit]
            a, b = x["id"][i], x["id"][j]
            out.append((np.minimum(a, b), np.maximum(a, b), _share(x, i, j)))
            shift += 1
        return pa.record_batch([pa.array(np.concatenate(y)) for y in zip(*out)], names=["a", "b", "share"])

    names, held = ["h", "lo", "hi", "blk", "id", "c", "n", "at"], None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        x = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names}
        x["bits"] = _signatures(batch.column("bits").to_pylist())
        x = x if held is None else {c: np.concatenate([held[c], x[c]]) for c in x}
        same = (x["h"] == x["h"][-1]) & (x["lo"] == x["lo"][-1]) & (x["hi"] == x["hi"][-1])
        cut = int(np.argmax(same))  # rows are sorted: the open group is what follows
        held = {c: v[cut:] for c, v in x.items()}
        if cut:
            yield done({c: v[:cut] for c, v in x.items()})
    if held is not None:
        yield done(held)


def groups(docs: DataFrame) -> DataFrame:
    """(copy, first, component): each text of ``docs`` (doc_id, text) once, its smallest doc_id, and the number of its group.

    NULL texts, empty ones and those of blanks are one text without words. Rows without
    a doc_id are left out; rows that share one are told apart by their texts. An empty
    table gives an empty result. Texts are compared whole, however long.
    """
    docs = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull())
    text = F.col("text")
    prints = docs.select("doc_id", copy_of(text).alias("copy"), fingerprints(text, WORDS).alias("fp"), _prefixes(text, np.zeros(0, np.int64)).alias("p"))
    prints = prints.groupBy("copy").agg(F.min("doc_id").alias("first"), F.first("fp").alias("fp"), F.first("p").alias("p"))
    # a number a text, given once and stored
    unique = materialize(prints.select(F.monotonically_increasing_id().alias("id"), "copy", "first", "fp", "p.n", "p.prefix", "p.bits"), "unique")

    heads = materialize(unique.groupBy("fp").agg(F.min("id").alias("head")), "heads")
    same = unique.join(heads, "fp").filter(F.col("head") != F.col("id")).select(F.col("head").alias("a"), F.col("id").alias("b"))
    near = near_links(heads, "fp", "head")
    links = _true(materialize(same.unionByName(near).distinct(), "pairs"), docs, unique)

    rows = _rows(unique, docs)
    links = links.unionByName(_true(materialize(_led(rows, links, unique), "led"), docs, unique))
    pairs = materialize(_shared(unique, links, docs, rows), "pairs")
    best = materialize(_best(pairs), "best")
    links = links.unionByName(_true(best, docs, unique))
    left = materialize(_across(pairs, links).join(best.hint("merge"), ["a", "b"], "left_anti"), "left")
    whole = components(links.unionByName(_true(left, docs, unique)), "a", "b").withColumnRenamed("node", "id")
    return unique.select("id", "copy", "first").join(whole, "id", "left").select("copy", "first", F.coalesce("component", "id").alias("component"))


def _best(pairs: DataFrame) -> DataFrame:
    """For each text the pair with the greatest share: most texts of a group are linked by it."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other"), "share"), F.struct(F.col("b").alias("id"), F.col("a").alias("other"), "share"))).alias("e")).select("e.*")
    best = ends.groupBy("id").agg(F.max(F.struct("share", "other")).alias("best"))
    return best.select(F.least("id", "best.other").alias("a"), F.greatest("id", "best.other").alias("b")).distinct()


def _across(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """The pairs whose texts are still in two groups."""
    of = materialize(components(links, "a", "b"), "of")
    both = pairs.select("a", "b").join(of.toDF("a", "c").hint("merge"), "a", "left").join(of.toDF("b", "d").hint("merge"), "b", "left")
    return both.filter(F.coalesce("c", "a") != F.coalesce("d", "b")).select("a", "b")


def _rows(unique: DataFrame, docs: DataFrame) -> DataFrame:
    """(h, id, n, at): the shingles in the prefixes of two texts or more, with their places."""
    prefix = unique.select("id", "n", F.posexplode("prefix").alias("at", "h"))
    seen = prefix.groupBy("h").count().filter(F.col("count") > COMMON)
    late = np.sort(seen.orderBy(F.desc("count"), "h").limit(MOST_COMMON).toArrow().column("h").to_numpy())
    if len(late):
        # common shingles go last: only prefixes that hold one change
        spark = unique.sparkSession
        common = F.broadcast(spark.createDataFrame(pa.table({"h": late})))
        ids = materialize(prefix.join(common, "h", "left_semi").select("id").distinct(), "common")
        anew = _texts_of(ids, unique, docs).select("id", _prefixes(F.col("text"), late).alias("p")).select("id", "p.n", "p.prefix")
        anew = materialize(anew, "prefixes")
        stay = unique.select("id", "n", "prefix").join(ids.hint("merge"), "id", "left_anti")
        prefix = stay.unionByName(anew).select("id", "n", F.posexplode("prefix").alias("at", "h"))
    often = prefix.groupBy("h").count().filter(F.col("count") > 1).select("h")
    return materialize(prefix.join(often.hint("merge"), "h"), "rows")


def _grouped(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` with c, the group so far of each text."""
    of = components(links, "a", "b").withColumnRenamed("node", "id")
    return rows.join(of.hint("merge"), "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")


def _led(rows: DataFrame, links: DataFrame, unique: DataFrame) -> DataFrame:
    """(a, b): for each text and order the leader of most of its shingles, if of another group and no bound rules it out."""
    # a copy with few edits has few shingles of its own: it leads first
    met = F.count("*").over(W.partitionBy("id")) / (F.col("n") - F.ceil(F.col("n") * LEAST[0] / LEAST[1]) + 1)
    rows = materialize(_grouped(rows, links).withColumn("met", met), "grouped")
    leads = [F.struct((F.lit(0.0) if i else -F.col("met")).alias("rare"), F.xxhash64(F.lit(i), "id").alias("o"), F.col("id").alias("leader"), F.col("c").alias("d"), F.col("n").alias("m"), F.col("at").alias("to")) for i in range(LEADERS)]
    first = rows.groupBy("h").agg(*[F.min(x).alias(f"l{i}") for i, x in enumerate(leads)])
    led = rows.join(first.hint("merge"), "h").select("id", "c", "n", "at", F.posexplode(F.array(*[f"l{i}" for i in range(LEADERS)])).alias("order", "l"))
    led = led.select("id", "c", "n", "at", "order", "l.leader", "l.d", "l.m", "l.to").filter(
        (F.col("c") != F.col("d"))
        & (LEAST[1] * F.least("n", "m") >= LEAST[0] * F.greatest("n", "m"))
        & (sum(LEAST) * F.least(F.col("n") - F.col("at"), F.col("m") - F.col("to")) >= LEAST[0] * (F.col("n") + F.col("m")))
    )
    shared = led.groupBy("order", "id", "leader").count()
    best = shared.groupBy("order", "id").agg(F.max(F.struct("count", "leader")).alias("l"))
    pairs = best.select(F.least("id", "l.leader").alias("a"), F.greatest("id", "l.leader").alias("b")).distinct()
    counts = unique.select("id", "n", "bits")
    pairs = pairs.join(counts.toDF("a", "n", "x").hint("merge"), "a").join(counts.toDF("b", "m", "y").hint("merge"), "b")
    return pairs.filter(_not_ruled_out(F.col("n"), F.col("m"), F.col("x"), F.col("y"))).select("a", "b")


def _shared(unique: DataFrame, links: DataFrame, docs: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """(a, b, share): texts not yet in one group that share a shingle of their prefixes and can be alike, and what they can share."""
    rows = materialize(_grouped(_rows(unique, docs) if rows is None else rows, links), "grouped")
    # a shingle met in one group only makes no pair
    mixed = rows.groupBy("h").agg(F.count("*").alias("count"), F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high")
    mixed = mixed.select("h", F.ceil(F.col("count") / BLOCK).cast("int").alias("parts"))
    rows = rows.join(mixed.hint("merge"), "h").join(unique.select("id", "bits").hint("merge"), "id")
    rows = materialize(rows, "shared")
    rows = rows.withColumn("blk", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("h", F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi"), "blk", "id", "c", "n", "at", "bits")
    dealt = rows.repartition("h", "lo", "hi").sortWithinPartitions("h", "lo", "hi")
    return dealt.mapInArrow(_candidates, "a long, b long, share double").distinct()
