"""The near-duplicate stage against brute-force similarity over five-word shingles."""

import random

import numpy as np
import pytest

import corpus_pipeline as pipeline
from packetloom.functions.dims import bounded
from packetloom.llm import alike
from tests.llm.test_near_duplicates import brute_components

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def brute_set(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def kept(rows):
    """(doc_id, text) that stay, by brute force over all pairs of rows."""
    sets = [brute_set(t) for _, t in rows]
    n = range(len(rows))
    pairs = [(i, j) for i in n for j in n if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    of = brute_components(pairs, n)
    return sorted(min(rows[i] for i in n if of[i] == c) for c in set(of.values()))


@pytest.mark.parametrize("common", [32, 2])
def test_stage_equals_brute_force_at_four_fifths(spark, monkeypatch, common):
    monkeypatch.setattr(alike, "COMMON", common)
    rng = np.random.default_rng(7)
    words = [f"w{i}é" for i in range(500)]
    passage = list(rng.choice(words, 40))
    base = [list(rng.choice(words, rng.integers(3, 200))) for _ in range(80)]
    texts = [t + passage * (i % 3 == 0) for i, t in enumerate(base)]
    for t in texts[:60]:  # edits on both sides of the bound
        for edits in (1, 2, 3, 4):
            t = [*t]
            for at in rng.integers(0, len(t), edits):
                t[at] = f"new{edits}"
            texts.append(t)
    rows = [(int(i), " ".join(t)) for i, t in zip(rng.permutation(len(texts)), texts)]
    rows += [(1000 + i, rows[0][1].upper()) for i in range(30)]
    frame = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], DDL)
    got = sorted((r["doc_id"], r["text"]) for r in pipeline.near_duplicates(spark, frame, "").collect())
    assert got == kept(rows) and 80 < len(got) < 300


def test_unlike_texts_under_one_id_each_stay(spark):
    rows = [(7, "a b c d e f"), (7, "q r s t u v w x"), (3, "q r s t u v w x"), (7, "one two three four five six"), (7, "A  b c d e f")]
    frame = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], DDL)
    got = sorted((r["doc_id"], r["text"]) for r in pipeline.near_duplicates(spark, frame, "").collect())
    assert got == [(3, "q r s t u v w x"), (7, "A  b c d e f"), (7, "one two three four five six")]


def test_texts_that_share_one_line_make_few_pairs(spark):
    """2,000 unlike texts of 42 words with one line of 30 in common: two million pairs, none of which is compared."""
    rng = np.random.default_rng(9)
    line = " ".join(f"common{i}" for i in range(30))
    rows = [(i, line + " " + " ".join(f"w{j}" for j in rng.integers(0, 3000, 12))) for i in range(2000)]
    rows += [(5000 + i, rows[i][1].replace("common10 ", "changed ", 1)) for i in range(3)]  # unlike: 33 of 43 shingles
    rows += [(6000 + i, rows[i][1] + " tail") for i in range(3)]  # alike
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    unique = docs.select(docs.doc_id.alias("id"), alike.copy_of(docs.text).alias("copy"), docs.doc_id.alias("first"), alike._prefixes(docs.text, np.zeros(0, np.int64)).alias("p"))
    unique = unique.select("id", "copy", "first", "p.*")
    pairs = alike._shared(unique, spark.createDataFrame([], "a long, b long"), docs).collect()
    assert {(i, 6000 + i) for i in range(3)} <= {(r["a"], r["b"]) for r in pairs} and len(pairs) < 100
    of = {r["first"]: r["component"] for r in alike.groups(docs).collect()}
    assert len(set(of.values())) == 2003 and all(of[i] == of[6000 + i] for i in range(3))


def test_signature_never_rules_out_a_pair_that_is_alike():
    rng = np.random.default_rng(10)
    texts = []
    for n in (8, 60, 400):
        base = [f"w{i}" for i in rng.integers(0, 900, n)]
        texts += [" ".join(base)] + [" ".join(w if rng.random() > 0.03 else "x" for w in base) for _ in range(30)]
    found = [alike._prefix(t.encode(), np.zeros(0, np.int64)) for t in texts]
    x = {"n": np.array([n for n, *_ in found]), "c": np.arange(len(texts)), "at": np.zeros(len(texts), np.int64), "bins": np.stack([np.frombuffer(b, "<u2") for *_, b in found])}
    i, j = np.triu_indices(len(texts), 1)
    fit = alike._can_be_alike(x, i, j)
    true = np.array([alike.alike(texts[a].encode(), texts[b].encode()) for a, b in zip(i, j)])
    assert true.sum() > 50 and not (true & ~fit).any() and fit.sum() < len(i) / 2


def test_texts_that_are_not_quite_alike_make_few_pairs(spark, monkeypatch):
    """Texts of which none is alike to another, all with some two thirds in common."""
    rnd, made = random.Random(6), []
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(f"x{rnd.random()}" if i in own else w for i, w in enumerate(base)) for own in (set(rnd.sample(range(400), 9)) for _ in range(150))]
    store = alike.materialize

    def counted(df, name):
        out = store(df, name)
        if name in ("led", "pairs"):
            made.append(out.count())
        return out

    monkeypatch.setattr(alike, "materialize", counted)
    got = alike.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas()
    assert got["component"].nunique() == 150 and sum(made) < 150


def test_texts_of_ids_go_to_python_once(spark):
    docs = spark.createDataFrame([(i, f"a b c d e f {i}") for i in range(9)], "doc_id long, text string")
    unique = docs.select(docs.doc_id.alias("id"), alike.copy_of(docs.text).alias("copy"), docs.doc_id.alias("first"))
    texts = alike._texts_of(spark.createDataFrame([(2,), (5,)], "id long"), unique, docs)
    assert texts._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted((r["id"], bytes(r["text"])) for r in texts.collect()) == [(2, b"a b c d e f 2"), (5, b"a b c d e f 5")]


def test_an_empty_side_of_a_join_needs_no_python(spark):
    ddl = "k bigint, v array<string>, w decimal(9,2)"
    side, small = bounded(spark.createDataFrame([(1, ["a"], None)], ddl).filter("k > 1"))
    assert small and side.count() == 0 and [(f.name, f.dataType) for f in side.schema] == [(f.name, f.dataType) for f in spark.createDataFrame([], ddl).schema]
    assert "RDD" not in side._jdf.queryExecution().executedPlan().toString()
