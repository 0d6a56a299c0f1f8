"""What the neighbour search stores grows with the vectors, not with the pairs of blocks."""

import numpy as np

from packetloom.operators import neighbours as nb


def test_vectors_are_stored_once_whatever_is_searched(spark, monkeypatch):
    monkeypatch.setattr(nb, "_BLOCK", 40)
    monkeypatch.setattr(nb, "_PART_BLOCKS", 3, raising=False)
    stored = []
    real = nb.materialize

    def kept(df, name):
        out = real(df, name)
        stored.append((name, out.count(), sum(len(r["ids"]) // 8 for r in out.select("ids").collect()) if name == "blocks" else None))
        return out

    monkeypatch.setattr(nb, "materialize", kept)
    # no structure: bounds rule nothing out, so all blocks meet; and one group that is searched whole
    x = np.random.default_rng(3).normal(size=(700, 24))
    g = np.where(np.arange(700) < 30, "few", "many")
    df = spark.createDataFrame([(i, str(g[i]), x[i].tolist()) for i in range(700)], "id bigint, g string, v array<double>")
    got = {(r["id"], r["rank"]): r["neighbour"] for r in nb.nearest(df, "id", "v", 2, "g").collect()}
    for i in range(700):
        d = np.where((g == g[i]) & (np.arange(700) != i), np.linalg.norm(x - x[i], axis=1), np.inf)
        assert [got[i, 1], got[i, 2]] == list(np.argsort(d, kind="stable")[:2])
    assert {name for name, *_ in stored} == {"vectors", "cells", "blocks"}
    assert all(n <= 700 for _, n, _ in stored) and [held for name, _, held in stored if name == "blocks"] == [670]
