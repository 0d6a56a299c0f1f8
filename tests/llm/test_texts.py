"""Operators over texts: labels, scores, passages, pages, personal data."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from packetloom.llm import cotrain, decontam, extract, langid, pii, toxicity
from packetloom.llm.words import Batch

SF = "/root/testdata/sf0.01"
DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, vocab string"


def fold(ids, n):
    return np.array([zlib.crc32(str(i).encode()) % n for i in ids])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


# ------------------------------------------------------------------ language


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    old, langid.CHUNK = langid.CHUNK, 3  # several chunks per text
    try:
        lengths = np.array([1, 7, 0, 3, 5])
        scores, moves = rng.standard_normal((16, 3)), rng.standard_normal((3, 3))
        got = langid.marginals(scores, lengths, moves)
    finally:
        langid.CHUNK = old
    at = 0
    for n in lengths:
        total = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            # what stands before the first word is uniform
            weight = sum(np.exp(moves[s, path[0]]) for s in range(3)) if n else 1
            weight *= np.exp(sum(scores[at + i, y] for i, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
            for i, y in enumerate(path):
                total[i, y] += weight
        if n:
            assert np.allclose(got[at : at + n], total / total.sum(1, keepdims=True))
        at += n


def test_language_of_held_out_rows(spark, docs):
    got = langid.identify(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    assert (got["held_out"] == (fold(got["doc_id"], 4) == 2)).all()
    held = got[got["held_out"]]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.97 and got["score"].between(0, 1).all()


def test_language_of_odd_rows(spark, docs):
    odd = [(-1, None, None, None, None, 1.0, "x"), (-2, "", "en", "s", 0, 1.0, "x"), (-3, "123 ²³ !!", "en", "s", 9, 1.0, "x"), (-4, "the " * 40000, None, None, None, 1.0, "x"), (None, "the and of", "en", "s", 9, 1.0, "x")]
    rows = docs.selectExpr("*", "1.0d as score", "'x' as vocab").unionByName(spark.createDataFrame(odd, DOC))
    got = {r["doc_id"]: r for r in langid.identify(rows).filter("doc_id < 0 or doc_id is null").collect()}
    assert [got[i]["lang_pred"] for i in (-1, -2, -3)] == ["und"] * 3 and got[-1]["score"] == 0
    assert got[-4]["lang_pred"] == "en" and got[None]["lang_pred"] == "en"
    empty = spark.createDataFrame([], DOC)
    assert langid.identify(empty).count() == 0
    assert langid.identify(spark.createDataFrame(odd[:1], DOC)).first()["lang_pred"] == "und"


def test_words_of_switched_text(docs):
    got = docs.filter("length(text) > 300").toPandas().groupby("lang").head(40)
    model = langid.fit(got["text"].tolist(), got["lang"].tolist())
    by = got.groupby("lang")["text"].first()
    cut = {k: " ".join(v.split()[:25]) for k, v in by.items()}
    words = langid.word_labels(model, f"{cut['de']} {cut['es']}")
    n = len(langid.Batch([cut["de"]]).words)
    assert Counter(x[1] for x in words[:n]).most_common(1)[0][0] == "de"
    assert Counter(x[1] for x in words[n:]).most_common(1)[0][0] == "es"


# ------------------------------------------------------------------ toxicity and quality


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    # a mark that only one labelled row in sixty bears is learned too, from shards of few rows
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 600)
    seen = []
    learn = toxicity._counted_outputs
    monkeypatch.setattr(toxicity, "_counted_outputs", lambda rows, model: seen.append(learn(rows, model)) or seen[-1])
    rng = random.Random(3)
    rows, marks = [], []
    for i in range(3600):
        bad = i % 60 == 0
        text = rng.choices("ba ce di fo gu ha ko".split(), k=6) + (["vexlo"] if bad else ["miro"] if i % 2 else [])
        rows.append((i, " ".join(text), None, None, None, 0.0, "x"))
        marks.append((i, int(bad)))
    got = toxicity.toxic_scores(spark.createDataFrame(rows, DOC), spark.createDataFrame(marks, "doc_id long, toxic int")).toPandas()
    assert (got["predicted"] == (got["doc_id"] % 60 == 0)).mean() > 0.99
    learned = sum(f != 0 for f in fold(range(3600), 5))
    assert 0.7 * learned < learned - seen[0][["up", "down"]].sum().sum() < 0.9 * learned


def test_toxicity_gradient_is_the_slope():
    model = toxicity.fit(["a b c d", "e f g"] * 4, np.array([1, 0] * 4), ["x"] * 8, passes=1, least_steps=1)
    batch, y, w = Batch(["a b c x y", "e q", ""]), np.array([1.0, 0.0, 1.0], np.float32), np.ones(3, np.float32)

    def loss():
        z = toxicity._forward(model, batch)[0] @ model.out[:-1] + model.out[-1]
        return float(np.sum(w * (np.logaddexp(0, z) - y * z)))

    grads = toxicity._gradient(model, batch, y, w)
    for name, array in (("out", model.out), ("f2", model.filters[2]), ("table", model.table)):
        flat, slope = array.reshape(-1), grads[name].reshape(-1)
        for i in np.argsort(-np.abs(slope))[:4]:
            keep = flat[i]
            flat[i] = keep + 1e-2
            up = loss()
            flat[i] = keep - 1e-2
            down = loss()
            flat[i] = keep
            assert abs((up - down) / 2e-2 - slope[i]) < 0.05 * max(0.05, abs(slope[i]))


def test_toxicity_of_held_out_rows(spark):
    rng = random.Random(5)
    plain = [f"{p}{s}" for p in "ba ce di fo gu".split() for s in "n r s t lo ma".split()]
    rows, marks = [], []
    for i in range(700):
        bad = i % 4 == 0
        text = rng.choices(plain, k=rng.randint(5, 80)) + ([f"vex{rng.choice(plain)}"] * 2 if bad else [])
        rng.shuffle(text)
        rows.append((i, " ".join(text), None, None, None, 0.0, "x"))
        marks.append((i, int(bad), "x"))
    rows += [(900, None, None, None, None, 0.0, "x"), (901, "", None, None, None, 0.0, "x"), (902, "ban " * 50000, None, None, None, 0.0, "x")]
    got = toxicity.toxic_scores(spark.createDataFrame(rows, DOC), spark.createDataFrame(marks + [(None, 1, "x"), (3, None, "x")], "doc_id long, toxic int, text string")).toPandas().set_index("doc_id")
    held = got[got["held_out"] & (got.index < 700)]
    assert (held["predicted"] == [int(i % 4 == 0) for i in held.index]).mean() > 0.97
    assert (got["predicted"] == (got["score"] >= 0.5)).all() and got.loc[[900, 901, 902], "predicted"].sum() == 0
    assert (got["held_out"] == (fold(got.index, 5) == 0)).all()
    none = toxicity.toxic_scores(spark.createDataFrame(rows[:2], DOC), spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r["score"] for r in none.collect()] == [0.5, 0.5]
    assert toxicity.toxic_scores(spark.createDataFrame([], DOC), spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


def test_quality_of_held_out_rows(spark, docs, labels):
    got = cotrain.quality_scores(docs, labels).toPandas()
    known = got[got["held_out"]].merge(labels.toPandas(), on="doc_id")
    assert len(got) == docs.count() and got["score"].between(0, 1).all()
    assert (known["predicted"] == known["quality"]).mean() >= max(0.88, known["quality"].mean())
    odd = [(5, None, None, None, None, 1.0, "x"), (5, "a", "en", "s", 1, 1.0, "x"), (None, "", "en", "s", 1, 1.0, "x")]
    assert [r["score"] for r in cotrain.quality_scores(spark.createDataFrame(odd, DOC), labels.limit(0)).collect()] == [0.5] * 3
    assert cotrain.quality_scores(spark.createDataFrame([], DOC), labels).count() == 0


def test_pseudo_labels_teach_the_other_view(spark):
    rng = np.random.default_rng(1)
    good = rng.integers(0, 2, 600)
    frame = pd.DataFrame({
        "doc_id": range(600),
        "text": [" ".join(rng.choice(["fine", "clear", "calm"] if g else ["junk", "spam", "noise"], 12)) for g in good],
        "source": [f"s{rng.integers(0, 6) if rng.random() < 0.2 else (g * 3 + rng.integers(0, 3))}" for g in good],
        "lang": ["en"] * 600, "n_chars": [60.0] * 600, "n_lines": [1.0] * 600,
    })
    table = spark.createDataFrame(frame[["doc_id", "text", "source", "lang", "n_chars"]])
    marks = spark.createDataFrame([(i, int(good[i])) for i in range(600) if i < 10 or fold([i], 5)[0] == 0], "doc_id long, quality int")
    model = cotrain.train(table, marks)
    alone = cotrain.train(table, marks, rounds=0)
    taught = [((cotrain.views(m, frame["text"], frame["source"], frame["lang"], frame["n_chars"], frame["n_lines"])[1] > 0) == good).mean() for m in (alone, model)]
    assert taught[1] > max(0.85, taught[0])
    # every row that is confident enough can be drawn, each view and class up to its number
    pool = table.withColumn("n_lines", F.lit(1.0))
    drawn = cotrain._guesses(model, pool, 40).toPandas()
    assert all((drawn[f"for_{v}"] == c).sum() == 40 for v in ("page",) for c in (0, 1))
    assert all((drawn["for_text"] == c).sum() <= 40 for c in (0, 1))
    every = cotrain._guesses(model, pool, 10_000).toPandas()
    sure = np.abs(cotrain.views(model, frame["text"], frame["source"], frame["lang"], frame["n_chars"], frame["n_lines"])[0]) > cotrain.SURE
    assert sorted(every.loc[every["for_page"].notna(), "doc_id"]) == np.flatnonzero(sure).tolist() and sure.sum() > 200
    a, b = cotrain.views(model, frame["text"], frame["source"], frame["lang"], frame["n_chars"], frame["n_lines"])
    assert ((a > 0) == good).mean() > 0.98 and ((b > 0) == good).mean() > 0.85


# ------------------------------------------------------------------ benchmark passages


def brute_passages(text, items, k=5, least=0.8):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    found = {}
    for item, body in items:
        own = re.findall(r"[^\W_]+", (body or "").lower())
        width = min(len(own), k)
        if not own or len(words) < width:
            continue
        bag = lambda w: Counter(tuple(w[i : i + width]) for i in range(len(w) - width + 1))  # noqa: B023, E731
        n, best = min(len(own), len(words)), (0.0, 0)
        for s in range(len(words) - n + 1):
            x, y = bag(own), bag(words[s : s + n])
            common = sum((x & y).values())
            like = common / (sum(x.values()) + sum(y.values()) - common)
            best = max(best, (like, -s))
        if best[0] >= least:
            found[item] = (round(best[0], 9), -best[1])
    return found


def test_passages_equal_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 5, 12, 40, 70])))) for i in range(25)] + [(30, None), (31, ""), (32, "  !! ")]
    items.append((33, items[4][1]))
    rows = []
    for i in range(120):
        text = rng.choices(words, k=rng.randint(0, 150))
        if i % 2:
            passage = items[rng.randrange(25)][1].split()
            for _ in range(rng.randint(0, 2)):
                passage[rng.randrange(len(passage))] = "other"
            at = rng.randint(0, len(text))
            text[at:at] = passage[: len(passage) - rng.choice([0, 0, 3])] or passage
        rows.append((i, ", ".join(text).upper() if i % 3 else "\n".join(text), "x"))
    rows += [(500, None, "x"), (501, "", "x"), (502, " ".join(words * 900), "x"), (7, rows[7][1], "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, doc_id int")
    got = [(r["doc_id"], r["item_id"], round(r["similarity"], 9), r["start_word"]) for r in decontam.find(frame, bench).collect()]
    want = [(d, i, *best) for d, text, _ in rows for i, best in brute_passages(text, items).items()]
    assert sorted(got) == sorted(want)
    dirty = {d for d, *_ in want}
    assert {r["doc_id"] for r in decontam.clean(frame, bench).collect()} == {r[0] for r in rows} - dirty
    several = list(decontam.parts(bench, most_bytes=300))
    assert len(several) > 3 and sum(len(p.ids) for p in several) == 28
    assert decontam.find(frame.limit(0), bench).count() == 0 and decontam.find(frame, bench.limit(0)).count() == 0


# ------------------------------------------------------------------ pages

LONG = "The harbour opened again on Monday after three weeks of repairs, and the first boats left before dawn."
MORE = "Crews said that the new lights could be seen from the far side of the bay, even in the thick fog."
PAGES = {
    "named parts": (
        f'<html><head><title>x</title></head><body><header><a href=/>Site</a><p>Tagline</p></header><div class="cookie-notice"><p>{MORE}</p></div>'
        f'<div class="wrap has-sidebar"><div id="content"><h1>Harbour</h1><p>{LONG}</p><div class="advert">{MORE} Buy now!</div><p>{MORE}<p>Short end.'
        f'<form><label>Mail</label><input><button>Go</button></form></div><div class="sidebar"><h3>Most read</h3><p>{MORE} Other.</p></div></div>'
        f'<section id="comments"><p>{LONG} I agree!</p></section><footer>&copy; 2020 Company &middot; {LONG}</footer></body></html>',
        ["Harbour", LONG, MORE, "Short end."],
    ),
    "plain page": (f"<ul><li><a href=a>Home</a><li><a href=b>News</a></ul><h1>Title &amp; more</h1><p>{LONG}</p>\n<p>a &lt;\n b&nbsp;c</p><p>x<br>y</p><p><a href=x>Terms</a></p>", ["Title & more", LONG, "a < b c", "x y"]),
    "article": (
        f'<main><article><header><h1>T</h1></header><p>{LONG}</p><aside>no</aside><p>E<p><a href=q>linked</a></p><table><tr><td>1<td>2</tr></table>'
        f'<script>if (a<b) x("</p>")</script><!-- <p>no</p> --><div class="comments"><article class="comment">bad {MORE}</article></div></article></main>',
        ["T", LONG, "E", "linked", "1 2"],
    ),
    "cut off": (f'<article><p>{LONG}<div class="x', [LONG]),
    "short": ("<p>hello <b>wor</b>ld</p>", ["hello world"]),
    "menu only": ("<nav>a</nav>", []),
    "no markup": ("just text", ["just text"]),
    "blank": (" \n ", []),
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name):
    page, blocks = PAGES[name]
    assert extract.main_text(page) == "\n\n".join(blocks)


def test_long_and_broken_pages_end():
    assert extract.main_text("<p>" * 50000 + "x") == "x"
    assert extract.main_text("<div>" * 3000 + "y" + "</span>" * 3000) == "y"
    body = "\n\n".join([LONG] * 3000)
    assert extract.main_text("<article>" + "".join(f"<p>{LONG}</p>" for _ in range(3000)) + "</article>") == body


def test_every_page_gives_its_document(spark, docs):
    texts = {" ".join(r["text"].split()) for r in docs.collect()}
    got = extract.extract(spark.read.parquet(f"{SF}/pages.parquet").selectExpr("*", "1 as text")).collect()
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert all(" ".join("\n\n".join(r["text"].split("\n\n")[1:]).split()) in texts for r in got)
    odd = spark.createDataFrame([(1, None, None), (None, "u", "")], "page_id long, url string, html string")
    assert [(r["text"], r["n_chars"]) for r in extract.extract(odd).collect()] == [("", 0), ("", 0)]
    assert extract.extract(odd.limit(0)).count() == 0


# ------------------------------------------------------------------ personal data

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute_spans(text):
    out = []
    for order, (kind, rule) in enumerate(RULES.items()):
        for m in re.finditer(rule, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if good:
                out.append((m.start(), order, kind, m.end()))
    return sorted(out)


@pytest.fixture(scope="module")
def private():
    rng = random.Random(1)
    alphabet = "0123456789" * 3 + "..--  ()++@@abcé𝒳_%\n"
    rows = [(i, "".join(rng.choices(alphabet, k=rng.choice([5, 40, 300])))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, "a@b.c_d@e.f.g"), (903, "x 4111 1111 1111 1111 y +1 (917) 555-2670 z"), (904, "1.2.3.4.5.6.7.8 256.1.1.1 007.1.1.255"), (5, "dup@x.org")]
    return [(*r, "x") for r in rows]


def test_base_spans_equal_brute_force(spark, private):
    frame = spark.createDataFrame(private, "doc_id long, text string, spans string")
    got = Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"], r["spans"]) for r in pii.find(frame, model=pii.Model()).collect())
    want = Counter()
    for i, text, _ in private:
        spans = brute_spans(text)
        joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
        want[(i, *(sum(s[2] == k for s in spans) for k in RULES), hashlib.sha256(joined.encode()).hexdigest(), joined)] += 1
    assert got == want


def test_trees_add_spans_and_keep_base(spark):
    rng = random.Random(4)
    rows = []
    for i in range(1500):
        n = f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
        rows.append((i, f"call +1 {n} now" if i % 2 else f"code {rng.randint(10**9, 10**10)} and 2020-01-{rng.randint(10, 30)}"))
    rows.append((5000, "call +1 (917) 555-2670 4234 5678 1234 5678 99 now"))  # the base rule drops the whole run
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.train(frame)
    assert "phone" in model.cuts
    got = {r["doc_id"]: r for r in pii.find(frame, model=model).collect()}
    assert "phone:5:22" in got[5000]["spans"].split(",") and got[5000]["n_phone"] == 0
    for i, text in rows:
        base = {f"{k}:{a}:{b}" for a, _, k, b in brute_spans(text)}
        assert base <= set(got[i]["spans"].split(","))
    assert not any(got[i]["spans"] for i in range(0, 1500, 2) if not brute_spans(rows[i][1]))


def test_redaction_and_hard_texts(spark):
    rows = [(1, "mail a.b@c.de or +1 (917) 555-2670.", 7), (2, None, 7), (3, "nothing", 7), (4, "1" * 100000, 7), (5, "a." * 50000 + "@b", 7), (6, "+1" + "(" * 100000, 7), (7, "10.0.0.1é10.0.0.2", 7)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, base int")
    got = {r["doc_id"]: r for r in pii.redact(frame, pii.Model()).collect()}
    assert got[1]["text"] == "mail [EMAIL] or [PHONE]." and got[2]["text"] is None and got[3]["text"] == "nothing"
    assert got[4]["text"] == rows[3][1] and got[5]["text"] == rows[4][1] and got[7]["text"] == "[IP]é[IP]" and got[7]["base"] == 7
    assert pii.find(frame.limit(0)).count() == 0
