"""Benchmark passages in documents by SimHash over item-sized windows.

A document is compared with an item of n words through its windows of n words. The
window's fingerprint (SimHash of its word shingles, from running bit sums) is looked
up in a multi-index of the items of that length: 64 bits in four blocks of 16, so
that a fingerprint within ``RADIUS`` bits has a block within ``RADIUS // 4`` bits of
the window's. Candidates are verified by the exact similarity of weighted shingles,
sum of the smaller over sum of the larger counts.

Only windows that hold at least one shingle of some item of that length are
fingerprinted: the similarity of all others is zero. At a similarity of 0.8
fingerprints differ in 10 bits on average with a deviation of 3, so the radius of
23 loses about one window in a million, and a passage has several windows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.words import Batch, bounded_batches

_WORDS = re.compile(r"[^\W_]+").findall
_MULT = np.uint64(0x9E3779B97F4A7C15)
BLOCKS, RADIUS = 4, 23


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _word_hashes(vocab: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in vocab), np.uint64, len(vocab))


def _shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each position on that has as many."""
    n = len(words) - k + 1
    h = np.zeros(max(n, 0), np.uint64)
    for i in range(k if n > 0 else 0):
        h = h * _MULT + words[i : n + i]
    return _mixed(h)


def _window_prints(h: np.ndarray, m: int) -> np.ndarray:
    """SimHash of each run of ``m`` hashes."""
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)
    total = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, 0, dtype=np.int32)])
    ones = total[m:] - total[:-m]
    return np.packbits(2 * ones > m, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


@dataclass
class _Size:
    """Items of one length in words: numbers, fingerprints and, by block, bucket values with the items in them."""

    items: np.ndarray
    prints: np.ndarray
    buckets: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, items: list[int], prints: list[int]) -> _Size:
        fps = np.array(prints, np.uint64)
        buckets = []
        for b in range(BLOCKS):
            part = (fps >> np.uint64(16 * b)) & np.uint64(0xFFFF)
            order = np.argsort(part, kind="stable")
            values, first = np.unique(part[order], return_index=True)
            buckets.append((values, np.r_[first, len(order)], order))
        return cls(np.array(items), fps, buckets)

    def near(self, prints: np.ndarray, step: int = 1 << 22) -> Iterator[tuple[int, int]]:
        """(window, item) with fingerprints within the radius."""
        rows = max(1, step // max(len(self.prints), 1))
        for at in range(0, len(prints), rows):
            own = prints[at : at + rows]
            found = set()
            for b, (values, first, order) in enumerate(self.buckets):
                part = (own >> np.uint64(16 * b)) & np.uint64(0xFFFF)
                w, v = np.nonzero(np.bitwise_count(part[:, None] ^ values[None, :]) <= RADIUS // BLOCKS)
                for i, j in zip(w.tolist(), v.tolist()):
                    found.update((i, int(x)) for x in order[first[j] : first[j + 1]])
            for i, x in sorted(found):
                if int(own[i] ^ self.prints[x]).bit_count() <= RADIUS:
                    yield at + i, int(self.items[x])


class Index:
    """The items of one bounded part of a benchmark."""

    def __init__(self, ids: list, texts: list[str | None], k: int = 5, least: float = 0.8):
        self.k, self.least, self.ids = k, least, ids
        batch = Batch(texts, _WORDS)
        hashes = _word_hashes(batch.vocab)[batch.words] if len(batch.words) else np.zeros(0, np.uint64)
        self.bags: list[tuple[np.ndarray, np.ndarray]] = []
        sizes: dict[int, tuple[list[int], list[int]]] = defaultdict(lambda: ([], []))
        owners: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))  # shingle length, hash, item lengths
        for i, (end, n) in enumerate(zip(batch.ends.tolist(), batch.lengths.tolist())):
            h = _shingles(hashes[end - n : end], self.width(n)) if n else np.zeros(0, np.uint64)
            self.bags.append(np.unique(h, return_counts=True))
            if n:
                items, prints = sizes[n]
                items.append(i)
                prints.append(int(_window_prints(h, len(h))[0]))
                for x in h.tolist():
                    owners[self.width(n)][x].add(n)
        self.sizes = {n: _Size.of(*v) for n, v in sizes.items()}
        self.known = {}
        for width, by in owners.items():
            keys = np.array(sorted(by), np.uint64)
            mask = np.zeros(1 << 20, bool)
            mask[keys & np.uint64((1 << 20) - 1)] = True
            self.known[width] = (mask, keys, [sorted(by[int(x)]) for x in keys])

    def width(self, n: int) -> int:
        """Words of a shingle: an item shorter than ``k`` words is one shingle."""
        return min(n, self.k)

    def matches(self, texts: Iterable[str | None]) -> Iterator[dict[int, tuple[float, int]]]:
        """For each text: item number to (similarity, first word) of its best window."""
        for batch in bounded_batches(texts, split=_WORDS):
            hashes = _word_hashes(batch.vocab)[batch.words] if len(batch.words) else np.zeros(0, np.uint64)
            found: list[dict[int, tuple[float, int]]] = [{} for _ in batch.lengths]
            for width, (mask, keys, lengths) in self.known.items():
                h = _shingles(hashes, width)
                at = np.flatnonzero(mask[h & np.uint64((1 << 20) - 1)])
                place = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
                same = keys[place] == h[at]
                at, place = at[same], place[same]
                doc = np.searchsorted(batch.ends, at, "right")
                inside = at + width <= batch.ends[doc] if len(at) else np.zeros(0, bool)
                at, place, doc = at[inside], place[inside], doc[inside]
                for d in np.unique(doc):
                    on = doc == d
                    begin = int(batch.ends[d] - batch.lengths[d])
                    self._document(hashes[begin : int(batch.ends[d])], width, at[on] - begin, [lengths[p] for p in place[on]], found[d])
            yield from found

    def _document(self, words: np.ndarray, width: int, at: np.ndarray, lengths: list[list[int]], found: dict[int, tuple[float, int]]) -> None:
        h = _shingles(words, width)
        by: dict[int, list[int]] = defaultdict(list)
        for p, sizes in zip(at.tolist(), lengths):
            for n in sizes:
                by[n].append(p)
        for n, anchors in by.items():
            m = min(n - width + 1, len(h))  # a text shorter than the item is one window
            spots = np.array(anchors)
            low, high = np.maximum(spots - m + 1, 0), np.minimum(spots, len(h) - m)
            # anchors ascend, so windows come in runs
            new = np.flatnonzero(np.r_[True, low[1:] > high[:-1] + 1])
            for i, j in zip(new, np.r_[new[1:], len(low)]):
                first, last = int(low[i]), int(high[j - 1])
                for part in range(first, last + 1, 1 << 16):
                    stop = min(last, part + (1 << 16) - 1)
                    run = h[part : stop + m]
                    for w, item in self.sizes[n].near(_window_prints(run, m)):
                        like = self._similarity(run[w : w + m], item)
                        if like >= self.least and (-like, part + w) < (lambda b: (-b[0], b[1]))(found.get(item, (-1.0, 0))):
                            found[item] = (like, part + w)

    def _similarity(self, h: np.ndarray, item: int) -> float:
        keys, counts = self.bags[item]
        own, n = np.unique(h, return_counts=True)
        _, a, b = np.intersect1d(keys, own, assume_unique=True, return_indices=True)
        common = np.minimum(counts[a], n[b]).sum()
        return float(common / (counts.sum() + n.sum() - common))


def parts(items: DataFrame, item_id: str = "item_id", text: str = "text", most_bytes: int = 16 << 20) -> Iterator[Index]:
    """The benchmark as indexes of about ``most_bytes`` of text each, which is what tasks are handed.

    Its size is counted first; a larger benchmark is taken part by part, each
    compared with all documents.
    """
    rows = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // most_bytes))
    for i in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        got = sorted(part.collect(), key=lambda r: (str(r["item_id"]), r["text"]))
        yield Index([r["item_id"] for r in got], [r["text"] for r in got])


def contaminated(text: Column, index: Index) -> Column:
    """Does the text hold a passage of the index?"""

    @F.pandas_udf("boolean")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([bool(m) for m in index.matches(texts)], dtype=bool)

    return of(text)


def clean(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a benchmark passage; all columns stay. NULL texts stay."""
    for index in parts(items):
        docs = docs.filter(~contaminated(F.col(text), index))
    return docs


def find(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, similarity and start_word of every benchmark item found in a row of ``docs``.

    * The best window of each item and row, the first of equals; similarity 0.8 or
      more over shingles of five words (letters and digits, case folded). An item
      shorter than that is one shingle of all its words; an item or text without
      words matches nothing, as do NULLs. A text shorter than an item is compared whole.
    * Rows that repeat a doc_id are searched each for itself, and items that repeat a
      text are all reported. Other columns are ignored; an empty table on either side
      gives an empty result.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kinds = rows.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    ddl = f"doc_id {kinds[0]}, item_id {kinds[1]}, similarity double, start_word long"

    def searched(index: Index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0)
                out = [(i, item, *best) for i, m in enumerate(index.matches(batch.column(1).to_pylist())) for item, best in sorted(m.items())]
                at, item, like, start = zip(*out) if out else [()] * 4
                cols = [ids.take(pa.array(at, pa.int64())), pa.array([index.ids[x] for x in item]), pa.array(like, pa.float64()), pa.array(start, pa.int64())]
                cols[1] = cols[1].cast(pa.int64()) if kinds[1] == "bigint" else cols[1]
                yield pa.record_batch(cols, names=["doc_id", "item_id", "similarity", "start_word"])

        return rows.mapInArrow(run, ddl)

    found = None
    for index in parts(items):
        found = searched(index) if found is None else found.unionByName(searched(index))
    return found
