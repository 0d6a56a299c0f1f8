"""Runs: stretches of words that repeat with a period, by seeds on diagonals.

A run of period q holds at least max(24, 3 q) words, so at least max(16, 2 q) words
in a row equal the word q further on. For periods below 16 that overlap holds a
16-gram; for periods from 2^j up to 2^(j + 1), j >= 4, one of 2^(j + 1) words. These
k-grams are indexed by exact numbers (equal grams share one), the longer ones by
doubling and only where the shorter ones repeat. A gram at least as long as the
period does not come back sooner than a period later inside a run, so the
occurrence pairs to look at are neighbours in the list of one gram's places: at
most one a place.

A pair at lag q is a seed on the diagonal of that lag. A table of how far each lag
has been covered skips seeds inside what was extended before; others are extended
both ways, word by word, to the whole run.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST, TIMES, GRAM = 24, 3, 16
#: Words looked at together, of one text or many.
BATCH = 1 << 20
_STEP = 256


def _numbers(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].reshape(-1).astype(np.int64)


def _hashes(words: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 16-gram at each place."""
    h = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    for span in (1, 2, 4, 8):
        h = h ^ (h >> np.uint64(29))
        h = h[:-span] * np.uint64(0xBF58476D1CE4E5B9) + (h[span:] ^ (h[span:] >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return h


def _repeated(values: np.ndarray) -> np.ndarray:
    """Places whose value occurs more than once, in rising order."""
    order = np.argsort(values, kind="stable")
    same = values[order[1:]] == values[order[:-1]]
    return np.sort(order[np.r_[same, False] | np.r_[False, same]]) if len(values) else order


def _gram_numbers(words: np.ndarray, at: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """One number for equal 16-grams: by hash, if all grams of a hash are found equal, or else by their words."""
    order = np.argsort(hashes, kind="stable")
    grams = words[at[order][:, None] + np.arange(GRAM)].astype(np.int32)
    new = np.r_[True, hashes[order][1:] != hashes[order][:-1]]
    if np.array_equal(grams[1:][~new[1:]], grams[:-1][~new[1:]]):
        number = np.empty(len(at), np.int64)
        number[order] = np.cumsum(new)
        return number
    return np.unique(words[at[:, None] + np.arange(GRAM)], axis=0, return_inverse=True)[1].reshape(-1)


def seeds(words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, lags) of neighbouring occurrences of one gram, a class of periods at a time."""
    if len(words) < GRAM:
        return
    hashes = _hashes(words)
    at = _repeated(hashes)  # a hash only leaves out what stands once; numbers below are exact
    if len(at) == 0:
        return
    number = _gram_numbers(words, at, hashes[at])
    k, low = GRAM, 1
    while True:
        order = np.lexsort((at, number))
        place, gram = at[order], number[order]
        lag = np.diff(place)
        fit = (gram[1:] == gram[:-1]) & (lag >= low) & (lag < k)
        if fit.any():
            yield place[:-1][fit], lag[fit]
        # the next class: grams of twice the length, where both halves repeat
        low, k = k, 2 * k
        again = np.flatnonzero(np.r_[gram[1:] == gram[:-1], False] | np.r_[False, gram[1:] == gram[:-1]])
        back = np.sort(again)
        place, gram = place[back], gram[back]
        inner = np.argsort(place)
        place, gram = place[inner], gram[inner]
        half = np.searchsorted(place, place + k // 2)
        both = half < len(place)
        both[both] = place[half[both]] == place[both] + k // 2
        if not both.any():
            return
        at = place[both]
        number = _numbers(gram[both] * (int(gram.max()) + 1) + gram[half[both]])


def _extent(words: np.ndarray, i: int, q: int, low: int, high: int) -> tuple[int, int]:
    """The longest stretch around ``i`` inside [low, high) whose words equal those ``q`` further on."""
    end, step = i, _STEP
    while end + q < high:
        n = min(step, high - q - end)
        differ = np.flatnonzero(words[end : end + n] != words[end + q : end + q + n])
        if len(differ):
            end += int(differ[0])
            break
        end, step = end + n, 2 * step
    start, step = i, _STEP
    while start > low:
        n = min(step, start - low)
        differ = np.flatnonzero(words[start - n : start] != words[start - n + q : start + q])
        if len(differ):
            start += int(differ[-1]) + 1 - n
            break
        start, step = start - n, 2 * step
    return start, end


def find_runs(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows (start, length, period), by start and period, of texts laid end to end.

    ``ends`` holds where each text ends; before every end stands one word that occurs
    nowhere else, so that no gram spans two texts. Starts count from the first text.
    """
    found, covered = [], {}
    for places, lags in seeds(words):
        order = np.lexsort((places, lags))
        places, lags = places[order], lags[order]
        text = np.searchsorted(ends, places, "right")
        # seeds in a row on one diagonal are one seed
        first = np.r_[True, (np.diff(places) != 1) | (np.diff(lags) != 0)]
        for i, q, t in zip(places[first].tolist(), lags[first].tolist(), text[first].tolist()):
            if i + q >= ends[t] or covered.get(q, -1) >= i:
                continue
            a, b = _extent(words, i, q, int(ends[t - 1]) if t else 0, int(ends[t]))
            covered[q] = b  # as far as the diagonal of this lag is known
            if b + q - a >= max(LEAST, TIMES * q):
                found.append((a, b + q - a, q))
    return np.array(sorted(found), np.int64).reshape(-1, 3)


def _kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words are in no run after its first period."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(depth)[:n] == 0


def _best(runs: list[list[int]]) -> int | None:
    """Number of the run with the greatest length / period, ties by start and period."""
    best = None
    for i, (_, length, period) in enumerate(runs):
        if best is None or length * runs[best][2] > runs[best][1] * period:
            best = i
    return best


def _texts(texts: list[bytes | None]) -> list[tuple]:
    """(n_words, runs, number of the best run, collapsed text) of each text."""
    out: list[tuple] = []
    held: list[list[bytes]] = []

    def flush() -> None:
        vocab = defaultdict(count().__next__)
        lengths = np.array([len(w) + 1 for w in held], np.int64)
        ends = np.cumsum(lengths)
        words = np.zeros(int(lengths.sum()), np.int64)
        for w, e in zip(held, ends):
            words[e - len(w) - 1 : e - 1] = np.fromiter(map(vocab.__getitem__, w), np.int64, len(w))
        words[ends - 1] = len(vocab) + np.arange(len(held))
        runs = find_runs(words, ends)
        cut = np.searchsorted(runs[:, 0], ends)
        for i, w in enumerate(held):
            own = runs[cut[i - 1] if i else 0 : cut[i]] - np.array([ends[i] - lengths[i], 0, 0])
            if len(own):
                left = [x for x, keep in zip(w, _kept(len(w), own).tolist()) if keep]
            else:
                left = w
            rows = own.tolist()
            out.append((len(w), rows, _best(rows), b" ".join(left)))
        held.clear()

    size = 0
    for t in texts:
        held.append(t.split() if t else [])
        size += len(held[-1])
        if size >= BATCH:
            flush()
            size = 0
    flush()
    return out


def collapse(text: Column) -> Column:
    """Runs of a text column: n_words, runs (start, length, period), best (number of the run, or NULL), collapsed.

    Words are what stands between ASCII blanks; the collapsed text joins by one blank
    the words that no run holds after its first period.
    """

    @F.pandas_udf("n_words long, runs array<array<long>>, best int, collapsed string")
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = _texts(list(texts))
        return pd.DataFrame({
            "n_words": [r[0] for r in rows], "runs": [r[1] for r in rows],
            "best": pd.array([r[2] for r in rows], "Int32"), "collapsed": [r[3].decode("utf-8", "replace") for r in rows],
        })

    return of(text.cast("binary"))


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, n_words, runs (array of start, length, period), best (the run that repeats most) and collapsed of every row.

    A run is a stretch of at least 24 words, and of at least three periods, in which
    words one period apart are equal, that no neighbour extends; its period is the
    smallest it has. Runs come by start, then period. best has the greatest length /
    period, of equal ones the first.

    * A NULL or empty text, or one of blanks, has no word, no run and an empty collapsed text.
    * Whole texts are searched, however long; memory follows the longest text.
    * Rows are searched each for itself: repeated rows and NULL ids make no
      difference. Other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), collapse(F.col(text)).alias("r")).select("doc_id", "r.*")
    run = F.transform("runs", lambda r: F.struct(r[0].alias("start"), r[1].alias("length"), r[2].alias("period")))
    rows = rows.withColumn("runs", run)
    return rows.withColumn("best", F.get("runs", F.col("best")))


def repeat_tails(doc_id: Column, text: Column) -> Column:
    """The texts of the query: of a tenth of all ids, words after a point repeat what follows that point.

    With h the crc32 of the id as text and g = floor(h / 10): if h % 10 is 0, each word
    i >= a becomes word a + (i - a) % p, a = g % n, p = 1 + floor((n - a) / (3 + g % 8)).
    Texts without a word and rows without an id stay.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))

    @F.pandas_udf("string")
    def of(hs: pd.Series, texts: pd.Series) -> pd.Series:
        out = []
        for x, t in zip(hs, texts):
            words = t.split() if t is not None else []
            n = len(words)
            if n and x is not None and x == x and int(x) % 10 == 0:
                g = int(x) // 10
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                part = words[a : a + p]
                t = b" ".join(words[:a] + (part * (-(-(n - a) // len(part))))[: n - a])
            out.append(None if t is None else t.decode("utf-8", "replace"))
        return pd.Series(out, dtype=object)

    return of(h, text.cast("binary"))


def digest(rows: DataFrame) -> DataFrame:
    """What the query returns of ``periodic_runs``."""
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col("best")[c].alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", line), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
