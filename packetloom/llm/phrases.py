"""Collocations: frequent phrases whose words keep together, by multikey quicksort.

Every word starts one suffix: itself and what follows it in its piece, cut at the
greatest depth. A task sorts the suffix pointers of its texts by multikey three-way
quicksort and passes each distinct suffix on once, with its count. Suffixes are then
routed by their leading words: Spark partitions them by ranges of (language, suffix),
so a leading word with many suffixes is cut where its second or third word changes.

A partition sorts its suffixes the same way. The size of an equal-partition at depth d
is the count of a phrase of d words, and a partition smaller than the least count is
abandoned. Only the phrases at either end of a range can go on in the next one; these
are passed on with what was counted here, and added up by Spark.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from packetloom.functions.dims import attach
from packetloom.functions.scratch import materialize

#: Bytes of text whose suffixes are sorted together, and bytes of text a range is meant to hold suffixes of.
BATCH, PER_RANGE = 6_000_000, 8_000_000
#: Partitions up to this size are ordered at once.
SMALL = 1 << 16
_FOLD = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n\n\n\n\n\n\n\n\n ")
_SUFFIX = "lang string, suffix string, n long"
_PHRASE = "lang string, size int, phrase string, n long"


def equal_partitions(keys: list[np.ndarray], weight: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, depth, weight) of every group of rows with equal keys 0 to depth that weighs ``least`` or more.

    Multikey three-way quicksort over row pointers: at depth d the rows go before,
    with or after a pivot's key d; those with it go on at depth d + 1. What weighs
    less than ``least`` holds no such group and is left.
    """
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 3]
    stack = [(np.arange(len(weight)), 0)] if len(weight) else []
    while stack:
        at, d = stack.pop()
        if len(at) <= SMALL:
            found += _ordered(keys, weight, least, at, d)
            continue
        key = keys[d][at]
        pivot = np.sort(key[:: len(key) // 64])[32]
        equal = at[key == pivot]
        for part in (at[key < pivot], at[key > pivot]):
            if weight[part].sum() >= least:
                stack.append((part, d))
        if (w := weight[equal].sum()) >= least:
            found.append((equal[:1], np.array([d]), np.array([w])))
            if d + 1 < len(keys):
                stack.append((equal, d + 1))
    return tuple(np.concatenate(x) for x in zip(*found))


def _ordered(keys: list[np.ndarray], weight: np.ndarray, least: int, at: np.ndarray, d: int) -> Iterator[tuple]:
    left = [k[at] for k in keys[d:]]
    bits = [int(k.max()).bit_length() for k in left]
    if sum(bits) < 64:  # the keys side by side in one number
        packed = np.zeros(len(at), np.int64)
        for k, b in zip(left, bits):
            packed = (packed << b) | k
        at = at[np.argsort(packed)]
    else:
        at = at[np.lexsort(left[::-1])]
    new = np.zeros(len(at), bool)
    new[:1] = True
    for depth in range(d, len(keys)):
        key = keys[depth][at]
        new = new | np.r_[True, key[1:] != key[:-1]]
        starts = np.flatnonzero(new)
        w = np.add.reduceat(weight[at], starts)
        heavy = w >= least
        if not heavy.any():
            return
        yield at[starts[heavy]], np.full(heavy.sum(), depth), w[heavy]


def _tokens(text: bytes) -> list[bytes]:
    """Words, with a line feed where a piece ends; empty strings stand between blanks."""
    return text.lower().translate(_FOLD).replace(b"\n", b" \n ").split(b" ")


def _suffixes(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """(lang, suffix, n): each distinct suffix of the texts of a task, some texts at a time."""
    vocab: dict[str, dict[bytes, int]] = {}
    runs: list[np.ndarray] = []
    size, number = 0, count(1)

    def done() -> pa.RecordBatch:
        words = np.concatenate([*runs, np.zeros(depth, np.int64)])
        words = words[words >= 0]
        names = np.empty(next(number), object)
        names[0] = b""
        langs = np.zeros(len(names), np.int32)
        for i, own in enumerate(vocab.values()):
            ids = np.fromiter(own.values(), np.int64, len(own))
            names[ids[2:]], langs[ids[2:]] = list(own)[2:], i
        at = np.flatnonzero(words)
        keys = [words[at]]
        for d in range(1, depth):
            keys.append(np.where(keys[-1] > 0, words[at + d], 0))
        row, level, n = equal_partitions(keys, np.ones(len(at), np.int64), 1)
        row, n = row[level == depth - 1], n[level == depth - 1]
        table = pa.array(names, pa.binary())
        parts = [pc.take(table, pa.array(k[row])) for k in keys]
        joined = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary()))
        lang = pc.take(pa.array(list(vocab), pa.string()), pa.array(langs[keys[0][row]]))
        return pa.record_batch([lang, joined.view(pa.string()), pa.array(n)], names=["lang", "suffix", "n"])

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            if not text:
                continue
            if lang not in vocab:
                vocab[lang] = defaultdict(number.__next__, {b"": -1, b"\n": 0})
            words = _tokens(text)
            words.append(b"\n")
            runs.append(np.fromiter(map(vocab[lang].__getitem__, words), np.int64, len(words)))
            size += len(text)
            if size >= BATCH:
                yield done()
                vocab, runs, size, number = {}, [], 0, count(1)
    if runs:
        yield done()


def _frequent(batches: Iterator[pa.RecordBatch], depth: int, least: int) -> Iterator[pa.RecordBatch]:
    """(lang, size, phrase, n) of one range; size 0 counts the words of a language.

    Phrases that the range's first or last suffix begins with may go on outside and
    come with any count.
    """
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    table = pa.Table.from_batches(got)
    weight = table["n"].to_numpy()
    parts = pc.split_pattern(table["suffix"].cast(pa.binary()), b" ")
    words = pc.list_flatten(parts).combine_chunks().dictionary_encode()
    # numbers in the order of the words, the empty one that ends a phrase first
    order = pc.sort_indices(words.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    ended = words.dictionary[int(order[0])].as_py() == b""
    flat = (rank[words.indices.to_numpy()] + (not ended)).reshape(-1, depth)
    langs = table["lang"].combine_chunks().dictionary_encode()
    lang_order = np.argsort(np.array(langs.dictionary.to_pylist(), object), kind="stable")
    lang_rank = np.empty(len(lang_order), np.int64)
    lang_rank[lang_order] = np.arange(len(lang_order))
    keys = [lang_rank[langs.indices.to_numpy()], *np.ascontiguousarray(flat.T)]

    row, level, n = equal_partitions(keys, weight, least)
    whole = np.ones(len(row), bool)
    ends = []
    for edge in _edges(keys):
        same_row, same_group = np.ones(len(weight), bool), np.ones(len(row), bool)
        for d, key in enumerate(keys):
            same_row &= key == key[edge]
            same_group &= key[row] == key[edge]
            whole &= ~(same_group & (level == d))
            ends.append((edge, d, int(weight[same_row].sum())))
    seen = {}
    for edge, d, w in ends:
        seen[tuple(int(k[edge]) for k in keys[: d + 1])] = (edge, d, w)
    row = np.r_[row[whole], [e for e, _, _ in seen.values()]].astype(np.int64)
    level = np.r_[level[whole], [d for _, d, _ in seen.values()]].astype(np.int64)
    n = np.r_[n[whole], [w for _, _, w in seen.values()]].astype(np.int64)
    real = (level == 0) | (np.stack(keys)[level, row] > 0)
    row, level, n = row[real], level[real], n[real]
    names = words.dictionary.take(pa.array(order))
    phrase = np.full(len(row), b"", object)
    for d in range(1, depth + 1):
        has = np.flatnonzero(level >= d)
        word = names.take(pa.array(keys[d][row[has]] - (not ended))).to_pylist()
        phrase[has] = [a + b" " + b if a else b for a, b in zip(phrase[has], word)]
    lang = langs.dictionary.take(pa.array(lang_order[keys[0][row]]))
    yield pa.record_batch([lang, pa.array(level.astype(np.int32)), pa.array(phrase, pa.binary()).view(pa.string()), pa.array(n)], names=["lang", "size", "phrase", "n"])


def _edges(keys: list[np.ndarray]) -> list[int]:
    """The first and the last row in the order of the keys."""
    out = []
    for pick in (np.min, np.max):
        left = np.arange(len(keys[0]))
        for key in keys:
            left = left[key[left] == pick(key[left])]
        out.append(int(left[0]))
    return out


def frequent_phrases(docs: DataFrame, lang: str = "lang", text: str = "text", words: int = 3, least: int = 10) -> DataFrame:
    """(lang, size, phrase, n): phrases of 1 to ``words`` words that occur ``least`` times or more in a language, stored once.

    Size 0 holds the number of words of each language. A-Z count as a-z; phrases do
    not pass ``.,;:!?`` and line ends.
    """
    rows = docs.select(F.coalesce(lang, F.lit("und")).alias("lang"), F.col(text).cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PER_RANGE))
    suffixes = rows.mapInArrow(lambda batches: _suffixes(batches, words), _SUFFIX)
    counted = suffixes.repartitionByRange(ranges, "lang", "suffix").mapInArrow(lambda batches: _frequent(batches, words, least), _PHRASE)
    return materialize(counted.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n")).filter(F.col("n") >= least), "phrases")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", words: int = 3, least: int = 10, most: int = 2000) -> DataFrame:
    """The ``most`` best phrases of 2 to ``words`` words of each language: lang, rank, phrase, a, l, r, n, score.

    a is how often the phrase occurs; it is cut in two where floor(10^6 a^2 / (l r)) is
    lowest, l and r being the counts of both parts (of equal cuts the first). n is the
    number of words of the language. Phrases that make up at least half of the
    occurrences of a part of them put that part out. Order: score and a falling,
    phrase by its bytes.

    * NULL or empty texts have no word. A NULL lang is the language ``und``.
    * Repeated rows count each time. Texts are taken whole, however long. Other
      columns are ignored; an empty table gives an empty result.
    """
    counts = frequent_phrases(docs, lang, text, words, least)
    phrases = counts.filter("size >= 1").select("lang", "size", "phrase", "n")
    candidates = phrases.filter("size >= 2").withColumn("w", F.split("phrase", " "))

    inner = F.expr("flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), i -> array_join(slice(w, i, m), ' '))))")
    longer = candidates.filter("size >= 3").select("lang", "n", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    left = candidates.join(longer, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("longer") < 50 * F.col("n"), F.lit(True)))

    cuts = left.select("lang", "phrase", "w", "size", F.col("n").alias("a"), F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("head"), F.expr("array_join(slice(w, k + 1, size - k), ' ')").alias("tail"))
    parts = phrases.select("lang", "phrase", "n")
    cuts = cuts.join(parts.toDF("lang", "head", "l"), ["lang", "head"]).join(parts.toDF("lang", "tail", "r"), ["lang", "tail"])
    # whole numbers of up to 38 digits; div cuts off the fraction
    score = F.expr("CAST(a AS DECIMAL(38, 0)) * a * 1000000 div (CAST(l AS DECIMAL(38, 0)) * r)")
    worst = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    order = W.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    best = worst.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    total = counts.filter("size = 0").select("lang", F.col("n").alias("total"))
    return attach(best, total, ["lang"]).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("total").alias("n"), F.col("cut.score").alias("score"))
