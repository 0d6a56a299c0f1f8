"""Document quality by co-training two views of a document.

One classifier sees the words of the text, the other only what a page says about
itself: source, language tag, length and line layout. They start from the labelled
rows of a bounded sample. In every round both score all unlabelled rows, and each
hands guesses it is confident of to the other as pseudo-labels: up to a stated number
of either class, drawn by hash from all rows that are confident enough, wherever they
are. Both are calibrated on labelled rows kept aside, and the calibrated views are
combined to score all rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.scratch import materialize
from packetloom.llm.words import Batch, Codes, bounded_batches, bucket, fit_in_task, fold, sample, with_texts

BITS, META_BITS = 14, 8
#: A view is confident of a guess from this log odds on.
SURE = 2.0
#: Labels of this fold of the documents are never learned from.
FOLDS, HELD = 5, 0
META = ["source", "lang", "n_chars", "n_lines"]


@dataclass
class Model:
    """Linear weights of the two views, and the weights (text, page, bias) that combine their outputs."""

    text: np.ndarray
    page: np.ndarray
    mix: np.ndarray


def text_rows(texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sparse features (row, column, value) of the text view, a batch at a time.

    Hashed words, word openings and word ends, averaged over the text, and a few shares:
    repeated words, capitals, word length.
    """
    base = 0
    for batch in bounded_batches(texts, 1_000_000, str.split):
        n, size = len(batch.lengths), np.maximum(batch.lengths, 1)
        owner = np.repeat(np.arange(n), batch.lengths)
        codes = Codes(batch.vocab)
        kinds = [codes.whole(), codes.prefix(2), codes.suffix(2), codes.suffix(3)]
        table = np.stack([bucket(h, 70 + i, BITS) for i, h in enumerate(kinds)], 1) if batch.vocab else np.zeros((0, 4), np.int64)
        lens = codes.lens - 2
        # one entry per (text, word): long texts of few words stay short
        cell, count = np.unique(owner * max(len(batch.vocab), 1) + batch.words, return_counts=True)
        doc, word = cell // max(len(batch.vocab), 1), cell % max(len(batch.vocab), 1)
        share = count / size[doc]
        distinct = np.bincount(doc, minlength=n) / size
        mean_len = np.bincount(owner, lens[batch.words], n) / size
        extra = np.stack([np.ones(n), 1 - distinct, np.log1p(mean_len), batch.lengths == 0, np.log1p(batch.lengths) / 8], 1)
        rows = np.concatenate([np.repeat(doc, 4), np.repeat(np.arange(n), extra.shape[1])])
        cols = np.concatenate([table[word].ravel(), np.tile((1 << BITS) + np.arange(extra.shape[1]), n)])
        vals = np.concatenate([np.repeat(share, 4) * 8, extra.ravel()])
        yield ((rows + base).astype(np.int32), cols.astype(np.int32), vals.astype(np.float32))
        base += n


TEXT_SIZE = (1 << BITS) + 5


def page_rows(source: Iterable, lang: Iterable, n_chars: Iterable, n_lines: Iterable) -> np.ndarray:
    """Dense features of the page view; missing values have a place of their own."""
    source, lang = list(source), list(lang)
    chars = np.array([np.nan if x is None else float(x) for x in n_chars], float)
    lines = np.array([np.nan if x is None else float(x) for x in n_lines], float)
    half = 1 << (META_BITS - 1)
    out = np.zeros((len(source), (1 << META_BITS) + 7))
    at = np.arange(len(source))
    out[at, [zlib.crc32(str(x).encode()) % half if isinstance(x, str) else 0 for x in source]] = 1
    out[at, [half + zlib.crc32(str(x).encode()) % half if isinstance(x, str) else half for x in lang]] = 1
    size, rows = np.log1p(np.nan_to_num(np.maximum(chars, 0))), np.log1p(np.nan_to_num(lines))
    extra = [np.ones(len(at)), size / 8, (size / 8) ** 2, rows / 4, (size - rows) / 6, np.isnan(chars), size < 4.5]
    out[:, 1 << META_BITS :] = np.stack(extra, 1)
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(score, slope, size: int, y: np.ndarray, weight: np.ndarray, decay: float = 1e-4, steps: int = 150, rate: float = 0.3) -> np.ndarray:
    """Weighted logistic regression by Adagrad; ``score`` and ``slope`` are products with the features and back."""
    w, seen = np.zeros(size), np.full(size, 1e-8)
    weight = weight / weight.sum()
    for _ in range(steps):
        g = slope(weight * (_sigmoid(score(w)) - y)) + decay * w
        seen += g * g
        w -= rate * g / np.sqrt(seen)
    return w


def _balanced(y: np.ndarray) -> np.ndarray:
    ones = max(y.sum(), 1)
    return np.where(y == 1, len(y) / 2 / ones, len(y) / 2 / max(len(y) - ones, 1))


class _Sparse:
    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int):
        self.row, self.col, self.val = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3))
        self.n = n

    def take(self, keep: np.ndarray) -> _Sparse:
        place = np.full(self.n, -1, np.int32)
        place[keep] = np.arange(len(keep))
        on = place[self.row] >= 0
        return _Sparse([(place[self.row[on]], self.col[on], self.val[on])], len(keep))

    def score(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * w[self.col], self.n)

    def slope(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.val * g[self.row], TEXT_SIZE)


def fit(frame: pd.DataFrame, kept: int = 5) -> Model:
    """Both views from a frame of text, META, quality (1, 0 or missing) and the pseudo-labels for_text and for_page, if it has them."""
    texts = [t if isinstance(t, str) else None for t in frame["text"]]
    words = _Sparse(list(text_rows(texts)), len(texts))
    page = page_rows(frame["source"], frame["lang"], frame["n_chars"], frame["n_lines"])
    y = frame["quality"].to_numpy(float)
    known = np.flatnonzero(~np.isnan(y))
    aside = known[np.arange(len(known)) % kept == 0] if len(known) >= 2 * kept else known
    learn = np.setdiff1d(known, aside) if len(known) >= 2 * kept else known
    if len(learn) == 0 or len(np.unique(y[learn])) < 2:
        sure = 0.0 if len(learn) == 0 else (6.0 if y[learn[0]] == 1 else -6.0)
        return Model(np.zeros(TEXT_SIZE), np.zeros(page.shape[1]), np.array([0.0, 0.0, sure]))

    def lesson(view: str) -> tuple[np.ndarray, np.ndarray]:
        told = frame[f"for_{view}"].to_numpy(float) if f"for_{view}" in frame else np.full(len(frame), np.nan)
        extra = np.flatnonzero(~np.isnan(told) & np.isnan(y))
        return np.r_[learn, extra], np.r_[y[learn], told[extra]]

    rows, goal = lesson("text")
    part = words.take(rows)
    w_text = _logistic(part.score, part.slope, TEXT_SIZE, goal, _balanced(goal))
    rows, goal = lesson("page")
    own = page[rows]
    w_page = _logistic(lambda w: own @ w, lambda g: own.T @ g, page.shape[1], goal, _balanced(goal))
    both = np.stack([words.score(w_text)[aside], (page @ w_page)[aside], np.ones(len(aside))], 1)
    mix = _logistic(lambda w: both @ w, lambda g: both.T @ g, 3, y[aside], np.ones(len(aside)), 1e-3, 300)
    return Model(w_text, w_page, mix)


def views(model: Model, texts: Iterable[str | None], source, lang, n_chars, n_lines) -> tuple[np.ndarray, np.ndarray]:
    """Uncombined output of either view for each row."""
    texts = [t if isinstance(t, str) else None for t in texts]
    z = np.zeros(len(texts))
    for row, col, val in text_rows(texts):
        z += np.bincount(row, val * model.text[col], len(texts))
    return z, page_rows(source, lang, n_chars, n_lines) @ model.page


def _columns(docs: DataFrame, doc_id: str, text: str, source: str, lang: str, n_chars: str) -> list[Column]:
    body = F.col(text)
    lines = F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + 1
    return [F.col(doc_id).alias("doc_id"), body.alias("text"), F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang"), F.col(n_chars).cast("double").alias("n_chars"), lines.cast("double").alias("n_lines")]


def _both_views(model: Model) -> Column:
    """The output of either view, for rows with the columns text and META."""

    @F.pandas_udf("z_text double, z_page double")
    def of(text: pd.Series, source: pd.Series, lang: pd.Series, n_chars: pd.Series, n_lines: pd.Series) -> pd.DataFrame:
        a, b = views(model, text, source, lang, n_chars, n_lines)
        return pd.DataFrame({"z_text": a, "z_page": b})

    return of("text", *META)


def _guesses(model: Model, pool: DataFrame, each: int, labelled: DataFrame | None = None) -> DataFrame:
    """(doc_id, for_text, for_page): up to ``each`` confident guesses of either class by each view, for the other one.

    The rows with a label leave after scoring: numbers are shuffled, never texts.
    """
    told = materialize(pool.withColumn("z", _both_views(model)).groupBy("doc_id").agg(*[F.avg(f"z.z_{v}").alias(v) for v in ("text", "page")]), "views")
    if labelled is not None:
        told = told.join(labelled.hint("merge"), "doc_id", "left_anti")
    guess = [F.struct(F.lit(pupil).alias("pupil"), F.col(teacher).alias("z")) for teacher, pupil in (("text", "page"), ("page", "text"))]
    sure = told.select("doc_id", F.inline(F.array(*guess))).filter(F.abs("z") > SURE)
    sure = sure.select("doc_id", F.concat("pupil", F.when(F.col("z") > 0, "1").otherwise("0")).alias("slot"))
    drawn = sample(sure, "slot", each)
    value = lambda v: F.max(F.when(F.col("slot") == f"{v}1", 1).when(F.col("slot") == f"{v}0", 0)).alias(f"for_{v}")
    return drawn.groupBy("doc_id").agg(value("text"), value("page"))


def train(
    docs: DataFrame, labels: DataFrame, per_class: int = 1000, each: int = 100, rounds: int = 2,
    doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", n_chars: str = "n_chars", quality: str = "quality",
) -> Model:
    """Fit on at most ``per_class`` labelled rows of either class, whole texts, none of the held-out fold.

    Each of ``rounds`` scores every row without a label by both views, and each view hands
    the other up to ``each`` guesses of either class; those of all rounds stay, a later one
    for the same row counts.
    """
    rows = docs.select(*_columns(docs, doc_id, text, source, lang, n_chars)).filter(F.col("doc_id").isNotNull())
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(quality).cast("int").alias("quality")).filter(F.col("quality").isin(0, 1)).distinct()
    known = known.filter(fold(F.col("doc_id"), FOLDS) != HELD)
    chosen = materialize(sample(known, "quality", per_class).withColumns({"for_text": F.lit(None).cast("int"), "for_page": F.lit(None).cast("int")}), "chosen")
    pool = rows.filter(fold(F.col("doc_id"), FOLDS) != HELD)
    labelled = known.select("doc_id").distinct()

    def fitted(taught: DataFrame) -> Model:
        got = with_texts(taught, rows, ["text", *META])
        return Model(**fit_in_task(got, lambda pdf: fit(pdf.sort_values(["doc_id", "text", "quality"], ignore_index=True))))

    model = fitted(chosen)
    guesses = None
    for turn in range(rounds if model.mix[:2].any() else 0):
        new = _guesses(model, pool, each, labelled).withColumn("turn", F.lit(turn))
        guesses = materialize(new if guesses is None else guesses.unionByName(new), "guesses")
        last = guesses.groupBy("doc_id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("turn"))).alias(c) for c in ("for_text", "for_page")])
        model = fitted(chosen.unionByName(last.select("doc_id", F.lit(None).cast("int").alias("quality"), "for_text", "for_page")))
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, text_score, page_score, score and predicted of every row of ``docs``.

    * Learns labels from the rows whose fold (crc32 of doc_id, modulo 5) is not 0; all
      rows of those folds without a label are the pool for pseudo-labels.
    * text_score and page_score are the views by themselves, score their calibrated
      combination (0 to 1, higher: better), predicted is 1 from 0.5 on.
    * NULL texts count as empty, missing page data has a place of its own. Without
      labels all rows score 0.5. Repeated rows get equal scores; a doc_id with two
      labels counts as both. Other columns are ignored; an empty table gives an empty
      result.
    """
    held = fold(F.col(doc_id), FOLDS) == HELD
    model = train(docs, labels, doc_id=doc_id)

    @F.pandas_udf("text_score double, page_score double, score double")
    def scored(text: pd.Series, source: pd.Series, lang: pd.Series, n_chars: pd.Series, n_lines: pd.Series) -> pd.DataFrame:
        a, b = views(model, text, source, lang, n_chars, n_lines)
        return pd.DataFrame({"text_score": _sigmoid(a), "page_score": _sigmoid(b), "score": _sigmoid(model.mix[0] * a + model.mix[1] * b + model.mix[2])})

    rows = docs.select(*_columns(docs, doc_id, "text", "source", "lang", "n_chars"), held.alias("held_out"))
    rows = rows.select("doc_id", "held_out", scored("text", *META).alias("s")).select("doc_id", "held_out", "s.*")
    return rows.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))
