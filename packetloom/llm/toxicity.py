"""Toxicity by a convolutional text classifier, trained in numpy.

A word's embedding is the sum of hashed rows for the word, its openings and its end,
so that unseen forms of a stem are met too. Filters of several widths run over
the words of the whole text; the largest response of each filter feeds a logistic
output. Thresholds are calibrated by language, which a small word model tells from
the text itself; scores are shifted so that 0.5 is the threshold of that language.
All labelled rows are learned from: shards of them train side by side, and their
models are put together after each round.
"""

from __future__ import annotations

import copy
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.dims import attach
from packetloom.functions.scratch import materialize
from packetloom.llm.words import Batch, Codes, bounded_batches, bucket, fold

BITS, WIDTH, FILTERS, SPANS = 15, 16, 16, (1, 2, 3)
#: Labels of this fold of the documents are never learned from.
FOLDS, HELD = 5, 0


@dataclass
class Model:
    """``table``: hashed embeddings, ``filters[k]``: (k, embedding, filter), ``shift``: filter biases by width,
    ``out``: weights of the pooled responses and the bias; ``tongues``: word model of the languages;
    ``cuts``: threshold of the raw output by language, the last one for any other."""

    table: np.ndarray
    filters: dict[int, np.ndarray]
    shift: dict[int, np.ndarray]
    out: np.ndarray
    languages: list[str] = field(default_factory=list)
    tongues: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS, 0), np.float32))
    cuts: np.ndarray = field(default_factory=lambda: np.zeros(1))
    steep: float = 1.0


def _rows(batch: Batch) -> np.ndarray:
    """Table rows of each word: the word, its first three to five letters, its last three; worked out once a batch."""
    if "rows" not in vars(batch):
        codes = Codes(batch.vocab)
        kinds = [codes.whole(), codes.prefix(3), codes.prefix(4), codes.prefix(5), codes.suffix(3)]
        batch.rows = np.stack([bucket(h, 40 + i, BITS) for i, h in enumerate(kinds)], 1)
    return batch.rows


def _padded(batch: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers with room for the widest filter after each text (number ``len(vocab)``), starts, real positions."""
    gap = max(SPANS)
    lens = batch.lengths + gap
    start = np.cumsum(lens) - lens
    seq = np.full(int(lens.sum()) + gap, len(batch.vocab))
    text = np.repeat(np.arange(len(lens)), batch.lengths)
    at = np.arange(len(batch.words)) + text * gap
    seq[at] = batch.words
    return seq, start, at


def _forward(model: Model, batch: Batch) -> tuple[np.ndarray, dict, np.ndarray, np.ndarray]:
    """Pooled responses of each text, and what the backward pass needs."""
    seq, start, real = _padded(batch)
    words = np.concatenate([model.table[_rows(batch)].sum(1), np.zeros((1, WIDTH), np.float32)])
    pooled, won = [], {}
    n = len(seq) - max(SPANS)
    blank = np.ones(n, bool)
    blank[real] = False
    for k in SPANS:
        reply = np.broadcast_to(model.shift[k], (n, FILTERS)).copy()
        for j in range(k):
            reply += (words @ model.filters[k][j])[seq[j : n + j]]
        reply[blank] = -np.inf
        top = np.maximum.reduceat(reply, start, axis=0) if len(start) else np.zeros((0, FILTERS), np.float32)
        won[k] = (reply, top)
        pooled.append(np.maximum(top, 0))
    return np.concatenate(pooled, 1), won, seq, start


def _argmax(reply: np.ndarray, top: np.ndarray, start: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, filter, first position) of the winning positive responses."""
    hit = (reply == top[text]) & (reply > 0)
    at, f = np.nonzero(hit)
    cell = text[at] * FILTERS + f
    _, first = np.unique(cell, return_index=True)
    return text[at[first]], f[first], at[first]


def raw_scores(model: Model, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Output before calibration and language number (-1: none) of each text."""
    z, tongue = [np.zeros(0)], [np.zeros(0, np.int64)]
    for batch in bounded_batches(texts, 1_000_000):
        pooled = _forward(model, batch)[0]
        z.append(pooled @ model.out[:-1] + model.out[-1])
        tongue.append(_tongue(model, batch))
    return np.concatenate(z), np.concatenate(tongue)


def _tongue(model: Model, batch: Batch) -> np.ndarray:
    size = len(model.languages)
    if size == 0 or len(batch.words) == 0:
        return np.full(len(batch.lengths), -1)
    per_word = model.tongues[bucket(Codes(batch.vocab).whole(), 60, BITS)][batch.words]
    text = np.repeat(np.arange(len(batch.lengths)), batch.lengths)
    total = np.stack([np.bincount(text, per_word[:, j], len(batch.lengths)) for j in range(size)], 1)
    return np.where(batch.lengths > 0, total.argmax(1), -1)


def predict(model: Model, texts: Iterable[str | None]) -> np.ndarray:
    """Calibrated score of each text."""
    z, tongue = raw_scores(model, texts)
    return 1 / (1 + np.exp(-np.clip(model.steep * (z - model.cuts[tongue]), -30, 30)))


def _begin(seed: int) -> Model:
    rng = np.random.default_rng(seed)
    return Model(
        (rng.standard_normal((1 << BITS, WIDTH)) * 0.02).astype(np.float32),
        {k: (rng.standard_normal((k, WIDTH, FILTERS)) * 0.3).astype(np.float32) for k in SPANS},
        {k: np.zeros(FILTERS, np.float32) for k in SPANS},
        np.r_[rng.standard_normal(FILTERS * len(SPANS)) * 0.3, 0.0].astype(np.float32),
    )


def _params(model: Model) -> dict[str, np.ndarray]:
    return {"table": model.table, "out": model.out} | {f"f{k}": model.filters[k] for k in SPANS} | {f"s{k}": model.shift[k] for k in SPANS}


def _constant(model: Model, clean: float, toxic: float) -> bool:
    """Without rows of both classes nothing is learned: the output says the only class there is."""
    if clean and toxic:
        return False
    model.out[:-1] = 0
    model.out[-1] = 8 * (bool(toxic) - bool(clean))
    return True


def _learn(model: Model, texts: list[str], toxic: np.ndarray, weight: np.ndarray, passes: int, least_steps: int, batch_texts: int, rate: float, rng: np.random.Generator) -> np.ndarray:
    """Adam over the rows, in place; in how many steps each row of the table moved."""
    params = _params(model)
    first = {n: np.zeros_like(p) for n, p in params.items()}
    second = {n: np.zeros_like(p) for n, p in params.items()}
    moved = np.zeros(1 << BITS, np.float32)
    order = rng.permutation(len(texts))
    parts = [order[i : i + batch_texts] for i in range(0, len(order), batch_texts)]
    ready = [Batch([texts[j] for j in own]) for own in parts]
    steps = 0
    for _ in range(max(passes, -(-least_steps // max(1, len(parts))))):
        for i in rng.permutation(len(parts)):
            own = parts[i]
            grads = _gradient(model, ready[i], toxic[own], weight[own] / len(own))
            steps += 1
            for n, p in params.items():
                g = grads[n]
                rows = np.flatnonzero(np.abs(g).sum(1)) if n == "table" else slice(None)
                if n == "table":
                    moved[rows] += 1
                first[n][rows] = 0.9 * first[n][rows] + 0.1 * g[rows]
                second[n][rows] = 0.99 * second[n][rows] + 0.01 * g[rows] ** 2
                scale = rate * np.sqrt(1 - 0.99**steps) / (1 - 0.9**steps)
                p[rows] -= scale * first[n][rows] / (np.sqrt(second[n][rows]) + 1e-6)
    return moved


def fit(texts: list[str], toxic: np.ndarray, langs: list[str | None], passes: int = 4, least_steps: int = 160, batch_texts: int = 32, rate: float = 0.01, held: int = 5, seed: int = 11) -> Model:
    """Train by Adam on four fifths of the rows at hand, calibrate on the others; ``train`` does so on tables."""
    rng = np.random.default_rng(seed)
    model = _begin(seed)
    toxic = np.asarray(toxic, np.float32)
    if _constant(model, (toxic == 0).sum(), (toxic == 1).sum()):
        return model
    model.languages = sorted({x for x in langs if x is not None})
    known = [i for i, x in enumerate(langs) if x is not None]
    model.tongues = _shares(_word_counts([texts[i] for i in known], [langs[i] for i in known], model.languages))
    order = rng.permutation(len(texts))
    own, check = order[np.arange(len(order)) % held > 0], order[np.arange(len(order)) % held == 0]
    _learn(model, [texts[i] for i in own], toxic[own], _weights(toxic, (toxic == 0).sum(), toxic.sum())[own], passes, least_steps, batch_texts, rate, rng)
    z, tongue = raw_scores(model, [texts[i] for i in check])
    cells = pd.DataFrame({"tongue": tongue, "z": z, "up": toxic[check] == 1, "down": toxic[check] == 0})
    _calibrate(model, cells.groupby(["tongue", "z"], as_index=False).sum())
    return model


def _weights(toxic: np.ndarray, clean: float, bad: float) -> np.ndarray:
    """Both classes weigh alike."""
    return np.where(toxic == 1, (clean + bad) / 2 / bad, (clean + bad) / 2 / clean).astype(np.float32)


def _gradient(model: Model, batch: Batch, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    pooled, won, seq, start = _forward(model, batch)
    z = pooled @ model.out[:-1] + model.out[-1]
    slope = (weight * (1 / (1 + np.exp(-z)) - y)).astype(np.float32)
    grads = {"out": np.r_[pooled.T @ slope, slope.sum()].astype(np.float32), "table": np.zeros_like(model.table)}
    n = len(seq) - max(SPANS)
    text = np.repeat(np.arange(len(start)), np.diff(np.r_[start, n]))
    rows = np.concatenate([_rows(batch), np.full((1, 5), -1)])
    embedded = np.concatenate([model.table[rows[:-1]].sum(1), np.zeros((1, WIDTH), np.float32)])
    for i, k in enumerate(SPANS):
        t, f, at = _argmax(*won[k], start, text)
        g = slope[t] * model.out[i * FILTERS + f]
        grads[f"s{k}"] = np.bincount(f, g, FILTERS).astype(np.float32)
        grads[f"f{k}"] = np.zeros_like(model.filters[k])
        for j in range(k):
            word = seq[at + j]
            np.add.at(grads[f"f{k}"][j].T, f, g[:, None] * embedded[word])
            real = word < len(batch.vocab)
            push = (g[:, None] * model.filters[k][j][:, f].T)[real]
            for c in range(rows.shape[1]):
                np.add.at(grads["table"], rows[word[real], c], push)
    return grads


def _word_counts(texts: list[str], langs: list[str], languages: list[str]) -> np.ndarray:
    """How often each hashed word is met in each language."""
    size = len(languages)
    batch = Batch(texts)
    owner = np.repeat(np.searchsorted(languages, langs), batch.lengths) if size else np.zeros(0, np.int64)
    rows = bucket(Codes(batch.vocab).whole(), 60, BITS)[batch.words] if batch.vocab else np.zeros(0, np.int64)
    return np.bincount(rows * size + owner, minlength=(1 << BITS) * size).reshape(-1, size) if size else np.zeros((1 << BITS, 0))


def _shares(count: np.ndarray) -> np.ndarray:
    """Log share of each hashed word in each language."""
    return np.log((count + 0.1) / (count.sum(0) + 0.1 * (1 << BITS))).astype(np.float32)


def _cut(z: np.ndarray, up: np.ndarray, down: np.ndarray) -> float:
    """Threshold with the fewest weighted errors, classes weighing alike; the middle of the widest such gap.

    ``up`` and ``down`` count the rows of either class at the outputs ``z``, which ascend.
    """
    up, down = up / max(up.sum(), 1), down / max(down.sum(), 1)
    wrong = np.r_[0, np.cumsum(up)] + down.sum() - np.r_[0, np.cumsum(down)]
    edges = np.r_[z[0] - 1, z, z[-1] + 1]
    gap = np.diff(edges)
    best = np.flatnonzero((wrong <= wrong.min() + 1e-9) & (gap > 0))
    i = best[gap[best].argmax()]
    return float((edges[i] + edges[i + 1]) / 2)


def _calibrate(model: Model, cells: pd.DataFrame, least: int = 15) -> None:
    """A threshold for each language with ``least`` rows of either class, and one for the rest.

    ``cells``: tongue, z, and the rows of either class there, up and down.
    """
    whole = cells.groupby("z", as_index=False)[["up", "down"]].sum().sort_values("z")
    overall = _cut(*(whole[c].to_numpy(float) for c in ("z", "up", "down"))) if whole["up"].sum() and whole["down"].sum() else 0.0
    cuts = np.full(len(model.languages) + 1, overall)
    for i in range(len(model.languages)):
        own = cells[cells["tongue"] == i].sort_values("z")
        if min(own["up"].sum(), own["down"].sum()) >= least:
            cuts[i] = _cut(*(own[c].to_numpy(float) for c in ("z", "up", "down")))
    model.cuts = cuts


# ---------------------------------------------------------------- training on the cluster

#: Rows a shard learns from before the shards' models are put together.
SHARD_ROWS = 4000
#: Ids of labelled rows are broadcast up to this many.
MOST_IDS = 200_000
_ROUNDS, _PIECES, _FEW = 2, 64, 64
#: Outputs are counted at multiples of ``_GRID`` up to ``_FAR`` either way.
_GRID, _FAR = 1 / 1024, 64.0
_PIECE = "piece int, shard long, seen binary, total binary"


def _pieces(model: Model, moved: np.ndarray, rows: int) -> list[tuple[int, bytes, bytes]]:
    """(piece, weights, weighted values): stretches of the table, and all else as the last piece."""
    step = (1 << BITS) // _PIECES
    out = [(i, moved[i * step : (i + 1) * step, None], model.table[i * step : (i + 1) * step]) for i in range(_PIECES)]
    rest = np.concatenate([p.ravel() for n, p in _params(model).items() if n != "table"])
    out.append((_PIECES, np.full((1, 1), rows), rest[None]))
    return [(i, w.astype(np.float64).tobytes(), (w.astype(np.float64) * v).tobytes()) for i, w, v in out]


def _sum(got: pd.DataFrame, shard: int) -> pd.DataFrame:
    got = got.sort_values("shard")
    seen, total = (sum(np.frombuffer(x) for x in got[c]) for c in ("seen", "total"))
    return pd.DataFrame({"piece": [got["piece"].iloc[0]], "shard": [shard], "seen": [seen.tobytes()], "total": [total.tobytes()]})


def _together(made: DataFrame, model: Model) -> Model:
    """The shards' mean model; a row of the table counts by the steps that moved it, and stays where none did."""
    some = made.withColumn("few", F.expr(f"shard div {_FEW}")).groupBy("piece", "few").applyInPandas(lambda key, got: _sum(got, int(key[1])), _PIECE)
    whole = some.groupBy("piece").applyInPandas(lambda got: _sum(got, 0), _PIECE).collect()
    step = (1 << BITS) // _PIECES
    for r in whole:
        seen, total = np.frombuffer(bytes(r["seen"])), np.frombuffer(bytes(r["total"]))
        if r["piece"] < _PIECES:
            on = np.flatnonzero(seen > 0)
            model.table[r["piece"] * step + on] = (total.reshape(step, -1)[on] / seen[on, None]).astype(np.float32)
            continue
        at = 0
        for n, p in _params(model).items():
            if n != "table":
                p[...] = (total[at : at + p.size] / seen[0]).reshape(p.shape)
                at += p.size
    return model


def _shard_round(rows: DataFrame, shards: int, model: Model, turn: int, clean: int, bad: int, passes: int, least_steps: int, batch_texts: int, rate: float, seed: int) -> DataFrame:
    def run(got: pd.DataFrame) -> pd.DataFrame:
        got = got.sort_values(["doc_id", "text", "toxic"])
        own = copy.deepcopy(model)  # a task may hold several shards
        toxic = got["toxic"].to_numpy(np.float32)
        shard = int(got["shard"].iloc[0])
        rng = np.random.default_rng([seed, turn, shard])
        moved = _learn(own, got["text"].tolist(), toxic, _weights(toxic, clean, bad), passes, least_steps, batch_texts, rate, rng)
        return pd.DataFrame([(i, shard, w, v) for i, w, v in _pieces(own, moved, len(got))], columns=["piece", "shard", "seen", "total"])

    return rows.repartition(shards, "shard").groupBy("shard").applyInPandas(run, _PIECE)


def _counted_words(rows: DataFrame, languages: list[str]) -> np.ndarray:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(((1 << BITS), len(languages)), np.int64)
        for got in parts:
            total += _word_counts(got["text"].tolist(), got["lang"].tolist(), languages)
        row, lang = np.nonzero(total)
        yield pd.DataFrame({"row": row, "lang": lang, "n": total[row, lang]})

    count = np.zeros(((1 << BITS), len(languages)))
    if languages:
        got = rows.select("text", "lang").filter(F.col("lang").isNotNull()).mapInPandas(run, "row long, lang long, n long").groupBy("row", "lang").agg(F.sum("n").alias("n")).toPandas()
        count[got["row"].to_numpy(), got["lang"].to_numpy()] = got["n"].to_numpy()
    return count


def _counted_outputs(rows: DataFrame, model: Model) -> pd.DataFrame:
    """Rows of either class by language and output, in steps of ``_GRID``: a bounded table of all rows."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for got in parts:
            z, tongue = raw_scores(model, got["text"])
            yield pd.DataFrame({"tongue": tongue, "z": np.round(np.clip(z, -_FAR, _FAR) / _GRID) * _GRID, "toxic": got["toxic"].to_numpy()})

    out = rows.select("text", "toxic").mapInPandas(run, "tongue long, z double, toxic int")
    return out.groupBy("tongue", "z").agg(F.count_if(F.col("toxic") == 1).alias("up"), F.count_if(F.col("toxic") == 0).alias("down")).toPandas()


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", toxic: str = "toxic", passes: int = 1, least_steps: int = 160, batch_texts: int = 32, rate: float = 0.01, held: int = 5, seed: int = 11) -> Model:
    """Fit on the whole texts of all labelled rows, none of the held-out fold.

    Four fifths of the rows are dealt by a hash over shards of about ``SHARD_ROWS``. In
    each of two rounds every shard goes over its rows, from the same model on, and the
    shards' models are put together; few rows are gone over several times. The words of
    the languages are counted on all rows, thresholds on the outputs of the other fifth.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(toxic).cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1)).distinct()
    known = known.filter(fold(F.col("doc_id"), FOLDS) != HELD)
    found = attach(rows.filter(fold(F.col("doc_id"), FOLDS) != HELD), known, ["doc_id"], max_rows=MOST_IDS)
    # of rows that repeat an id the largest values stand for it
    found = found.groupBy("doc_id", "toxic").agg(F.max("text").alias("text"), F.max("lang").alias("lang"))
    found = materialize(found.withColumn("aside", F.pmod(F.xxhash64(F.lit("aside"), "doc_id"), F.lit(held)) == 0), "labelled")
    model = _begin(seed)
    sizes = {(r["toxic"], r["aside"]): r["count"] for r in found.groupBy("toxic", "aside").count().collect()}
    clean, bad = (sizes.get((y, False), 0) for y in (0, 1))
    if _constant(model, clean + sizes.get((0, True), 0), bad + sizes.get((1, True), 0)):
        return model
    own = found.filter(~F.col("aside")) if clean and bad else found
    if not (clean and bad):  # a class stands aside only
        clean, bad = (sum(n for (y, _), n in sizes.items() if y == k) for k in (0, 1))
    model.languages = sorted(r["lang"] for r in found.select("lang").distinct().collect() if r["lang"] is not None)
    model.tongues = _shares(_counted_words(found, model.languages))
    shards = -(-(clean + bad) // SHARD_ROWS)
    dealt = own.withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "doc_id"), F.lit(shards)))
    for turn in range(_ROUNDS):
        model = _together(_shard_round(dealt, shards, model, turn, clean, bad, passes, -(-least_steps // _ROUNDS), batch_texts, rate, seed), model)
    _calibrate(model, _counted_outputs(found.filter("aside"), model))
    return model


def score(text: Column, model: Model) -> Column:
    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(predict(model, texts))

    return of(text)


def toxic_scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``.

    * Learns from the labelled rows whose fold (crc32 of doc_id, modulo 5) is not 0;
      lang is only what the word model of the languages is trained towards. Nothing
      but the text enters a score.
    * NULL and empty texts get the score of a text without words. Rows without any
      label to learn from score 0.5 all. Repeated rows get equal scores; a doc_id with
      two labels counts as both. Other columns are ignored; an empty table gives an
      empty result.
    """
    held = fold(F.col(doc_id), FOLDS) == HELD
    model = train(docs, labels, doc_id, text, lang)
    rows = docs.select(F.col(doc_id).alias("doc_id"), held.alias("held_out"), score(F.col(text), model).alias("score"))
    return rows.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))
