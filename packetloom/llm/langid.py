"""Language identification by a linear-chain conditional random field over words.

Every word of a text gets a label; its features are hashed affixes, hashed character
n-grams and membership in learned lexicons, and neighbouring labels are tied by
learned transitions. Forward-backward gives each word's label probabilities, which
hold up in texts that switch language; a text's language is read off their means
over its four quarters.

The field is trained on a bounded sample: sampled texts are cut into runs of words,
and runs of different languages are strung together so that switches are learned.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.words import Batch, Codes, bounded_batches, bucket, fit_in_task, fold, sample

BITS = 15
CHUNK = 64
QUARTERS = 4


@dataclass
class Model:
    """``weights``: hashed features by language, ``lexicon`` and ``lexical``: word lists and their weights,
    ``moves``: log transition scores, ``head``: weights of the quarters."""

    languages: list[str]
    weights: np.ndarray
    lexicon: dict[str, int]
    lexical: np.ndarray
    moves: np.ndarray
    head: np.ndarray


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, table row) of all hashed features."""
    codes = Codes(words)
    every = np.arange(len(words))
    out = [(every, bucket(codes.prefix(k), k, BITS)) for k in (1, 2, 3)]
    out += [(every, bucket(codes.suffix(k), 10 + k, BITS)) for k in (1, 2, 3)]
    out += [(w, bucket(h, 20 + n, BITS)) for n in (2, 3) for w, h in [codes.grams(n)]]
    word, row = (np.concatenate(x) for x in zip(*out))
    return word, row


def _sum_by(word: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(word, values[:, j], n) for j in range(values.shape[1])], 1)


def emissions(model: Model, words: list[str]) -> np.ndarray:
    """Score of each label for each word."""
    if not words:
        return np.zeros((0, len(model.languages)))
    word, row = _features(words)
    lists = np.fromiter((model.lexicon.get(w, -1) for w in words), np.int64, len(words))
    return _sum_by(word, model.weights[row], len(words)) + model.lexical[lists]


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / x.sum(-1, keepdims=True)


def marginals(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Label probabilities of every word, exactly, for many texts at once.

    Texts are cut into chunks; a chunk's transfer matrix carries messages across it,
    so the number of sequential steps is the chunk length plus the number of chunks.
    """
    n, size = len(scores), scores.shape[1]
    local = np.exp(scores - scores.max(1, keepdims=True))
    step = np.exp(moves - moves.max())
    chunks = -(-lengths // CHUNK)
    owner = np.repeat(np.arange(len(lengths)), chunks)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    first = (np.cumsum(lengths) - lengths)[owner] + nth * CHUNK
    count = np.minimum(CHUNK, lengths[owner] - nth * CHUNK)
    transfer = np.broadcast_to(np.eye(size), (len(owner), size, size)).copy()
    for k in range(int(count.max(initial=0))):
        on = np.flatnonzero(count > k)
        moved = (transfer[on].reshape(-1, size) @ step).reshape(-1, size, size) * local[first[on] + k][:, None, :]
        transfer[on] = moved / moved.max((1, 2), keepdims=True)
    start = np.cumsum(chunks) - chunks
    ahead = np.full((len(owner), size), 1 / size)  # message into each chunk
    behind = np.full((len(owner), size), 1 / size)  # message from what follows it
    for j in range(1, int(chunks.max(initial=0))):
        at = (start + j)[chunks > j]
        ahead[at] = _scaled(np.einsum("ni,nij->nj", ahead[at - 1], transfer[at - 1]))
    for j in range(int(chunks.max(initial=0)) - 2, -1, -1):
        at = (start + j)[chunks > j + 1]
        behind[at] = _scaled(np.einsum("nij,nj->ni", transfer[at + 1], behind[at + 1]))
    forward, out = np.empty((n, size)), np.empty((n, size))
    for k in range(int(count.max(initial=0))):
        on = np.flatnonzero(count > k)
        ahead[on] = _scaled((ahead[on] @ step) * local[first[on] + k])
        forward[first[on] + k] = ahead[on]
    for k in range(int(count.max(initial=0)) - 1, -1, -1):
        on = np.flatnonzero(count > k)
        out[first[on] + k] = _scaled(forward[first[on] + k] * behind[on])
        behind[on] = _scaled((behind[on] * local[first[on] + k]) @ step.T)
    return out


def _quarters(batch: Batch, probs: np.ndarray) -> np.ndarray:
    """Mean label probabilities of the four quarters of each text: (text, quarter, label)."""
    text = np.repeat(np.arange(len(batch.lengths)), batch.lengths)
    at = np.arange(len(text)) - np.repeat(batch.ends - batch.lengths, batch.lengths)
    quarter = at * QUARTERS // np.maximum(batch.lengths[text], 1)
    cell = text * QUARTERS + quarter
    n = len(batch.lengths) * QUARTERS
    total = _sum_by(cell, probs, n) / np.maximum(np.bincount(cell, minlength=n), 1)[:, None]
    total = total.reshape(-1, QUARTERS, probs.shape[1])
    # a text shorter than four words repeats what it has
    empty = total.sum(2) == 0
    mean = total.sum(1) / np.maximum((~empty).sum(1), 1)[:, None]
    return np.where(empty[:, :, None], mean[:, None, :], total)


def _softmax(x: np.ndarray) -> np.ndarray:
    return _scaled(np.exp(x - x.max(-1, keepdims=True)))


def predict(model: Model, texts: Iterable[str | None]) -> tuple[list[str], list[float]]:
    """Language and probability of each text; ``und`` and 0 for a text without a letter."""
    names, scores = [], []
    for batch in bounded_batches(texts, 500_000):
        local = emissions(model, batch.vocab)[batch.words]
        probs = marginals(local, batch.lengths, model.moves)
        doc = _softmax(np.einsum("q,nql->nl", model.head, _quarters(batch, probs)))
        letters = np.array([any(map(str.isalpha, w)) for w in batch.vocab], bool)
        has = np.bincount(np.repeat(np.arange(len(batch.lengths)), batch.lengths), letters[batch.words].astype(float), len(batch.lengths)) > 0
        best = doc.argmax(1)
        names += [model.languages[b] if h else "und" for b, h in zip(best, has)]
        scores += [float(doc[i, b]) if h else 0.0 for i, (b, h) in enumerate(zip(best, has))]
    return names, scores


def word_labels(model: Model, text: str) -> list[tuple[str, str, float]]:
    """(word, language, probability) along one text."""
    batch = Batch([text])
    probs = marginals(emissions(model, batch.vocab)[batch.words], batch.lengths, model.moves)
    return [(batch.vocab[w], model.languages[p.argmax()], float(p.max())) for w, p in zip(batch.words, probs)]


def fit(texts: list[str], labels: list[str], for_field: int = 60, rounds: int = 20, rate: float = 0.4, words_per_list: int = 1000, seed: int = 7) -> Model:
    """Train the field by gradient ascent on the log likelihood of the sampled texts' words.

    At most ``for_field`` texts, and three in five, of a language train the field; the
    others, which it has not seen, set the weights of the quarters.
    """
    whole, languages = (texts, labels), sorted(set(labels))
    size = len(languages)
    most = {y: min(for_field, -(-3 * n // 5)) for y, n in Counter(labels).items()}
    taken: Counter = Counter()
    chosen = []
    for y in labels:
        taken[y] += 1
        chosen.append(taken[y] <= most[y])
    texts = [t for t, c in zip(whole[0], chosen) if c]
    labels = [y for y, c in zip(whole[1], chosen) if c]
    batch = Batch(texts)
    truth = np.repeat(np.searchsorted(languages, labels), batch.lengths) if size else np.zeros(0, np.int64)
    counts = [Counter() for _ in languages]
    for w, y in zip(batch.words.tolist(), truth.tolist()):
        counts[y][w] += 1
    total = Counter()
    for c in counts:
        total.update(c)
    lexicon: dict[str, int] = {}
    for y, c in enumerate(counts):
        own = [(n, batch.vocab[w]) for w, n in c.items() if n >= 3 and n * 2 > total[w]]
        lexicon |= {w: y for _, w in sorted(own, key=lambda x: (-x[0], x[1]))[:words_per_list]}
    model = Model(languages, np.zeros((1 << BITS, size)), lexicon, np.zeros((size + 1, size)), np.zeros((size, size)), np.full(QUARTERS, 2.0))
    if len(batch.words) == 0:
        return model

    # runs of 8 to 40 words, shuffled and strung together
    rng = np.random.default_rng(seed)
    cuts = np.unique(np.r_[0, batch.ends, np.cumsum(rng.integers(8, 41, len(batch.words) // 8 + 1))])
    cuts = cuts[cuts <= len(batch.words)]
    runs = [np.arange(a, b) for a, b in zip(cuts[:-1], cuts[1:])]
    order = np.concatenate([runs[i] for i in rng.permutation(len(runs))])
    words, truth_run = batch.words[order], truth[order]
    n = len(words)
    lengths = np.full(-(-n // CHUNK), CHUNK)
    lengths[-1] = n - CHUNK * (len(lengths) - 1)
    inside = np.ones(n, bool)
    inside[::CHUNK] = False  # words with a word before them

    feature_word, feature_row = _features(batch.vocab)
    lists = np.fromiter((lexicon.get(w, -1) for w in batch.vocab), np.int64, len(batch.vocab))
    goal = np.eye(size)[truth_run]
    seen_moves = np.zeros((size, size))
    np.add.at(seen_moves, (truth_run[:-1][inside[1:]], truth_run[1:][inside[1:]]), 1)
    squares = [np.full(p.shape, 1e-8) for p in (model.weights, model.lexical, model.moves)]
    for _ in range(rounds):
        scores = (_sum_by(feature_word, model.weights[feature_row], len(batch.vocab)) + model.lexical[lists])[words]
        probs, moves = _expect(scores, lengths, model.moves, inside)
        per_word = _sum_by(words, goal - probs, len(batch.vocab)) / n
        grads = [_sum_by(feature_row, per_word[feature_word], 1 << BITS), _sum_by(lists % (size + 1), per_word, size + 1), (seen_moves - moves) / n]
        for p, g, s in zip((model.weights, model.lexical, model.moves), grads, squares):
            s += g * g
            p += rate * g / np.sqrt(s)
        model.weights *= 1 - 1e-3
    rest = [i for i, c in enumerate(chosen) if not c]
    if rest:
        model.head = _fit_head(model, Batch([whole[0][i] for i in rest]), np.searchsorted(languages, [whole[1][i] for i in rest]))
    return model


def _expect(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities, and expected counts of label pairs of neighbours."""
    local, step = np.exp(scores - scores.max(1, keepdims=True)), np.exp(moves - moves.max())
    size, n = scores.shape[1], len(scores)
    first = np.arange(0, n, CHUNK)
    ahead, behind = np.full((len(first), size), 1 / size), np.full((len(first), size), 1 / size)
    forward, backward, after = np.empty((n, size)), np.empty((n, size)), np.empty((n, size))
    for k in range(CHUNK):
        on = np.flatnonzero(lengths > k)
        ahead[on] = _scaled((ahead[on] @ step) * local[first[on] + k])
        forward[first[on] + k] = ahead[on]
    for k in range(CHUNK - 1, -1, -1):
        on = np.flatnonzero(lengths > k)
        after[first[on] + k] = behind[on]
        backward[first[on] + k] = behind[on] * local[first[on] + k]
        behind[on] = _scaled(backward[first[on] + k] @ step.T)
    probs = _scaled(forward * after)
    later = np.flatnonzero(inside)
    pairs = forward[later - 1][:, :, None] * step[None] * backward[later][:, None, :]
    return probs, (pairs / pairs.sum((1, 2), keepdims=True)).sum(0)


def _fit_head(model: Model, batch: Batch, truth: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Weights of the quarters, by softmax regression with weights shared by the languages."""
    probs = marginals(emissions(model, batch.vocab)[batch.words], batch.lengths, model.moves)
    quarters = _quarters(batch, probs)[batch.lengths > 0]
    goal = np.eye(len(model.languages))[truth[batch.lengths > 0]]
    head = np.full(QUARTERS, 2.0)
    for _ in range(rounds if len(goal) else 0):
        slope = np.einsum("nl,nql->q", goal - _softmax(np.einsum("q,nql->nl", head, quarters)), quarters) / len(goal)
        head = np.clip(head + 4.0 * (slope - 0.002 * (head - 2.0)), 0.25, 12.0)
    return head


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = 200) -> Model:
    """Fit on at most ``per_language`` whole texts of every language of ``docs``."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(key).alias("doc_id"))
    rows = rows.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())

    def fitted(got: pd.DataFrame) -> Model:
        got = got.sort_values(["lang", "doc_id", "text"])
        return fit(got["text"].tolist(), got["lang"].tolist())

    return Model(**fit_in_task(sample(rows, "lang", per_language), fitted))


def label(text: Column, model: Model) -> Column:
    """Struct of lang_pred and score of a text column.

    Declared non-deterministic, which it is not, so that filters on it do not make the
    planner work it out twice.
    """

    @F.pandas_udf("lang_pred string, score double")
    def of(texts: pd.Series) -> pd.DataFrame:
        names, scores = predict(model, texts)
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return of.asNondeterministic()(text)


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs``.

    * Learns from text and lang of the rows whose fold (crc32 of doc_id, modulo 4) is
      not 2; only the text enters a prediction.
    * ``und`` with score 0 for a NULL text and one without a letter, and for all rows
      if there is nothing to learn from. Repeated rows get equal answers. Other
      columns are ignored; an empty table gives an empty result.
    """
    held = fold(F.col(doc_id), 4) == 2
    model = train(docs.filter(~held), text, lang, doc_id)
    if not model.languages:
        return docs.select(F.col(doc_id).alias("doc_id"), held.alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), held.alias("held_out"), label(F.col(text), model).alias("p"))
    return rows.select("doc_id", "held_out", "p.lang_pred", "p.score")
