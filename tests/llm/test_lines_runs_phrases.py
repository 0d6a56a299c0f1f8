"""Line dedup, periodic runs and collocations against brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from packetloom.llm import lines, phrases, queries, runs

UPPER = {i: i + 32 for i in range(65, 91)}


# ---------------------------------------------------------------- runs


def brute_runs(words):
    out, n = [], len(words)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q) and not any(q % p == 0 and all(words[x] == words[x + p] for x in range(i, j + q - p)) for p in range(1, q)):
                out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def laid_out(texts):
    """Texts end to end, as the search takes them."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    flat, stop = [], 10_000_000
    for t in texts:
        flat += [*t, stop]
        stop += 1
    return np.array(flat, np.int64), ends


def check(texts):
    words, ends = laid_out(texts)
    got = [tuple(r) for r in runs.find_runs(words, ends).tolist()]
    want, at = [], 0
    for t in texts:
        want += [(i + at, n, q) for i, n, q in brute_runs(t)]
        at += len(t) + 1
    assert got == sorted(want, key=lambda r: (r[0], r[2]))
    return got


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=40), st.integers(1, 9), st.integers(0, 30)), min_size=1, max_size=8))
def test_runs_equal_brute_force(pieces):
    text = [w for part, times, cut in pieces for w in (part * times)[: max(1, len(part) * times - cut)]]
    check([text[: len(text) // 2], [], text, text[::-1]])


def test_runs_in_long_and_nested_texts():
    rng = np.random.default_rng(3)
    noise = rng.integers(0, 5000, 3000).tolist()
    inner = [7] * 30 + rng.integers(0, 50, 90).tolist()
    text = noise + inner * 4 + noise[:500] + (noise[100:400] * 3) + [1, 2] * 40 + noise
    found = check([text])
    assert {q for *_, q in found} >= {1, 2, 120, 300}
    fib = [0], [0, 1]
    while len(fib[1]) < 1200:
        fib = fib[1], fib[1] + fib[0]
    check([fib[1], [0] * 500, [0, 1, 1, 0, 1, 0, 0, 1] * 50])


def test_equal_hashes_change_nothing(monkeypatch):
    monkeypatch.setattr(runs, "_hashes", lambda words: np.zeros(len(words) - 15, np.uint64))
    rng = np.random.default_rng(4)
    check([rng.integers(0, 2, 400).tolist(), [1, 2, 3] * 20, (rng.integers(0, 9, 33).tolist() * 5)[:150]])


def test_runs_query_columns(spark):
    words = [f"w{i}" for i in range(50)]
    body = "Café " + " ".join(["a", "b", "c"] * 12) + "\n" + " \t".join(words)
    rows = [(i, body if i % 3 else " ".join(words)) for i in range(40)] + [(50, None), (51, " \n"), (52, ""), (None, body), (None, None), (3, "x " * 3000), (3, "x " * 3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 as runs", "'y' as best", "1 as start")
    got = runs.digest(runs.periodic_runs(frame.withColumn("text", runs.repeat_tails(frame.doc_id, frame.text)))).collect()
    want = []
    for doc, text in rows:
        w = (text or "").encode().split()
        n, h = len(w), None if doc is None else zlib.crc32(str(doc).encode())
        if n and h is not None and h % 10 == 0:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        rs = brute_runs(w)
        gone = {i for s, m, q in rs for i in range(s + q, s + m)}
        best = min(rs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        sha = hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in rs).encode()).hexdigest()
        left = hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()
        want.append((doc, len(rs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha, left))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert any(r["n_runs"] for r in got) and runs.periodic_runs(frame.limit(0)).count() == 0


# ---------------------------------------------------------------- lines


def brute_lines(rows, least=10):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    first, holders = {}, defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= least:
                holders[key(line)].add(doc)
    first = {k: min(v) for k, v in holders.items() if len(v) > 1}
    out = []
    for doc, text in rows:
        all_lines = (text or "").split("\n")
        kept = [x for x in all_lines if doc is None or first.get(key(x), doc) == doc]
        out.append((doc, "\n".join(kept), len(all_lines), len(all_lines) - len(kept)))
    return sorted(map(str, out))


def test_lines_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lines, "PER_SHARD", 16)
    rng = np.random.default_rng(5)
    pool = [f"Line number {i} of the pool" for i in range(60)] + ["short", "ten chars!", "nine char", "ééééééééé", "éééééééééé", "ÉCOLE NORMALE", "école normale"]
    rows = []
    for i in range(300):
        picked = [pool[j] for j in rng.integers(0, len(pool), rng.integers(0, 6))] + [f"only here {i}"]
        picked = [x.upper() if x.isascii() and rng.random() < 0.2 else f" \t{x}\r" if rng.random() < 0.2 else x for x in picked]
        rows.append((int(rng.integers(-5, 250)), "\n".join(["a line that all of them hold", *picked, ""])))
    rows += [(None, rows[0][1]), (None, None), (400, None), (401, ""), (402, "\n\n"), (403, "a line that all of them hold"), (404, ("word " * 50 + "\n") * 2000), (405, "word " * 50)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as keys", "'x' as h", "2 as shard", "3 as of")
    got = sorted(str(tuple(r)) for r in lines.drop_repeated_lines(frame).collect())
    assert got == brute_lines(rows)
    assert lines.drop_repeated_lines(frame.limit(0)).count() == 0
    short = frame.filter("doc_id in (400, 401, 402)")
    assert sorted(tuple(r) for r in lines.drop_repeated_lines(short).collect()) == [(400, "", 1, 0), (401, "", 1, 0), (402, "\n\n", 3, 0)]


def test_a_line_of_all_documents_is_dealt_over_copies(spark):
    entries = spark.range(4000).selectExpr("id as doc_id", "explode(array(5L, id * 7919)) as h", "1 as f")
    index = lines.line_index(entries, 8)
    got = {r["doc_id"]: r["keys"] for r in lines.lost_keys(entries, index, 8).collect()}
    assert set(got) == set(range(1, 4000)) and all(len(k) == 1 and len(k[0]) == 12 for k in got.values())


@pytest.mark.parametrize("n", [0, 1, 2, 63, 1000, 50_000])
def test_minimal_hash_numbers_all_keys(n):
    rng = np.random.default_rng(n)
    h, f = rng.integers(-(2**63), 2**63 - 1, n), rng.integers(-(2**31), 2**31 - 1, n, dtype=np.int32)
    if n > 10:
        h[: n // 2] = h[0]  # told apart by f
        f[: n // 2] = np.arange(n // 2)
    made = lines.MinimalHash.build(h, f)
    assert sorted(made.number(h, f).tolist()) == list(range(n))
    again = lines.MinimalHash(made.seed, made.sizes, made.bits)
    assert np.array_equal(again.number(h, f), made.number(h, f))
    assert 8 * made.bits.nbytes <= 6 * n + 64 * 12
    others = again.number(rng.integers(0, 2**62, 500), np.zeros(500, np.int32))
    assert others.max(initial=-1) < n


# ---------------------------------------------------------------- phrases


def brute_phrases(rows, most=2000, depth=3, least=10):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = (text or "").translate(UPPER)
        for c in ".,;:!?\x0b\x0c\r":
            text = text.replace(c, "\n")
        for piece in text.split("\n"):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            n[lang] += len(w)
            for m in range(1, depth + 1):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in cand.items():
            if any(100 * b >= 50 * a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cand.items()):
                continue
            cuts = [(1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:most], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("batch, small, depth, most", [(6_000_000, 4096, 3, 2000), (4000, 65, 3, 7), (20_000, 65, 4, 2000)])
def test_phrases_equal_brute_force(spark, monkeypatch, batch, small, depth, most):
    rng = np.random.default_rng(6)
    words = ["the", "The", "of", "café", "Été", "中", "x\x01", "x", "y\x01z"] + [f"w{i}" for i in range(30)]
    weight = 1 / np.arange(1, len(words) + 1)
    rows = []
    for i in range(300):
        text = [words[j] for j in rng.choice(len(words), rng.integers(1, 80), p=weight / weight.sum())]
        seps = rng.choice([" ", "  ", "\t", ". ", ",", "\n", "\r\n", "? ", "\x0b"], len(text), p=[0.7, 0.05, 0.05, 0.05, 0.05, 0.03, 0.03, 0.02, 0.02])
        rows.append((["en", "de", None, "und", ""][i % 5], "".join(a + b for a, b in zip(text, seps))))
    rows += [("en", None), ("fr", ""), ("fr", " .. \n"), ("es", "el la " * 3000)] + [("en", "the same text here")] * 40
    monkeypatch.setattr(phrases, "BATCH", batch)
    monkeypatch.setattr(phrases, "SMALL", small)
    frame = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 as n", "'s' as suffix", "2 as size", "'p' as phrase")
    got = sorted(map(tuple, phrases.collocations(frame, words=depth, most=most).collect()))
    assert got == brute_phrases(rows, most, depth) and len(got) > 20
    assert phrases.collocations(frame.limit(0)).count() == 0


def test_equal_partitions_equal_counts():
    rng = np.random.default_rng(8)
    keys = [rng.zipf(1.3, 20_000) % 300 for _ in range(3)]
    weight = rng.integers(1, 4, 20_000)
    row, depth, w = phrases.equal_partitions(keys, weight, 10)
    got = {tuple(int(k[r]) for k in keys[: d + 1]): int(x) for r, d, x in zip(row, depth, w)}
    want = Counter()
    for i in range(20_000):
        for d in range(3):
            want[tuple(int(k[i]) for k in keys[: d + 1])] += int(weight[i])
    assert got == {k: v for k, v in want.items() if v >= 10} and len(row) == len(got)


def test_scores_pass_64_bits(spark):
    a = 3_000_000_000_000
    expr = "CAST(a AS DECIMAL(38, 0)) * a * 1000000 div (CAST(l AS DECIMAL(38, 0)) * r) AS score"
    got = spark.createDataFrame([(a, a + 1, a + 7)], "a long, l long, r long").selectExpr(expr).first()["score"]
    assert got == 1000000 * a * a // ((a + 1) * (a + 7))


def test_new_queries_are_registered():
    assert {"op11_phrase_collocations", "op12_periodic_runs", "op13_line_dedup"} <= set(queries.QUERIES)
    assert {"op11_phrase_collocations", "op13_line_dedup"} <= set(queries.ORACLES)
