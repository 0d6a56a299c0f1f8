"""Words of many texts as numbers, and hashed character features of words, a batch at a time."""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from packetloom.functions.dims import attach

_LETTERS = re.compile(r"[^\W\d_]+")
_PRIME = np.uint64(1099511628211)


class Batch:
    """Texts as runs of word numbers: text i has ``words[ends[i - 1]:ends[i]]``; ``vocab`` lists the distinct words."""

    def __init__(self, texts: Iterable[str | None], split: Callable[[str], list[str]] = _LETTERS.findall):
        vocab: dict[str, int] = {}
        number = vocab.setdefault
        runs = [np.fromiter((number(w, len(vocab)) for w in split(t.lower())), np.int64) if t else np.zeros(0, np.int64) for t in texts]
        self.lengths = np.array([len(r) for r in runs], np.int64)
        self.ends = np.cumsum(self.lengths)
        self.words = np.concatenate(runs) if runs else np.zeros(0, np.int64)
        self.vocab = list(vocab)


def bounded_batches(texts: Iterable[str | None], chars: int = 2_000_000, split: Callable[[str], list[str]] = _LETTERS.findall) -> Iterator[Batch]:
    """Whole texts in batches of about ``chars`` characters."""
    held: list[str | None] = []
    size = 0
    for t in texts:
        held.append(t)
        size += len(t or "")
        if size >= chars:
            yield Batch(held, split)
            held, size = [], 0
    if held:
        yield Batch(held, split)


class Codes:
    """Characters of a list of words, framed by ^ and $."""

    def __init__(self, words: list[str]):
        self.lens = np.array([len(w) for w in words], np.int64) + 2
        flat = "".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass")
        self.chars = np.frombuffer(flat, "<u4").astype(np.uint64)
        self.first = np.cumsum(self.lens) - self.lens

    def prefix(self, k: int) -> np.ndarray:
        """Hash of the frame and the first ``k`` characters (all of a shorter word)."""
        return self._run(self.first, np.minimum(k + 1, self.lens), 1)

    def suffix(self, k: int) -> np.ndarray:
        return self._run(self.first + self.lens - 1, np.minimum(k + 1, self.lens), -1)

    def whole(self) -> np.ndarray:
        at = np.arange(len(self.chars)) - np.repeat(self.first, self.lens)
        powers = np.cumprod(np.full(max(1, int(self.lens.max(initial=1))), _PRIME, np.uint64))
        return np.add.reduceat(self.chars * powers[at], self.first) if len(self.lens) else np.zeros(0, np.uint64)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(word, hash) of every run of ``n`` characters, frames included."""
        counts = np.maximum(self.lens - n + 1, 0)
        word = np.repeat(np.arange(len(self.lens)), counts)
        at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + self.first[word]
        h = np.zeros(len(at), np.uint64)
        for i in range(n):
            h = h * _PRIME + self.chars[at + i]
        return word, h

    def _run(self, at: np.ndarray, lens: np.ndarray, step: int) -> np.ndarray:
        h = np.zeros(len(at), np.uint64)
        for i in range(int(lens.max(initial=0))):
            more = lens > i
            h[more] = h[more] * _PRIME + self.chars[at[more] + step * i]
        return h


def bucket(hashes: np.ndarray, kind: int, bits: int) -> np.ndarray:
    """Table row of a hashed feature; ``kind`` keeps features of different sorts apart."""
    h = (hashes ^ np.uint64(kind * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xFF51AFD7ED558CCD)
    return ((h ^ (h >> np.uint64(32))) & np.uint64((1 << bits) - 1)).astype(np.int64)


def fold(doc_id: Column, folds: int) -> Column:
    """The contract's fold of a row: crc32 of the id as text, modulo ``folds``."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)).cast("int")


def sample(rows: DataFrame, by: str, most: int, key: str = "doc_id") -> DataFrame:
    """At most ``most`` rows per value of ``by``, the first in the order of a hash of ``key``.

    A count per value tells how much of the hash's range is needed, so that only about
    three times ``most`` rows are moved and ordered; each task keeps ``most`` before that.
    """
    unit = F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 30))
    share = rows.groupBy(by).agg((F.lit(3.0 * most * (1 << 30)) / F.count("*")).alias("__share"))
    few = attach(rows, share, [by]).filter(unit < F.col("__share")).drop("__share")
    rank = F.row_number().over(W.partitionBy(by).orderBy(unit, key))
    return few.withColumn("__rank", rank).filter(F.col("__rank") <= most).drop("__rank")


def with_texts(chosen: DataFrame, docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of the documents of a bounded set of ids, which is broadcast.

    Of rows that repeat an id the largest values stand for it.
    """
    found = docs.join(F.broadcast(chosen), "doc_id")
    return found.groupBy(*chosen.columns).agg(*[F.max(c).alias(c) for c in columns])


def fit_in_task(rows: DataFrame, fit: Callable[[pd.DataFrame], object]) -> dict:
    """The fields of what ``fit`` makes of a bounded sample, worked out in one task of the cluster."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = list(parts)
        if got:
            yield pd.DataFrame({"model": [pickle.dumps(vars(fit(pd.concat(got, ignore_index=True))))]})

    made = rows.repartition(1).mapInPandas(run, "model binary").first()
    return pickle.loads(bytes(made[0])) if made else vars(fit(pd.DataFrame({c: [] for c in rows.columns})))
