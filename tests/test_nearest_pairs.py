"""Nearest rows of a block by bounded products against plain differences."""

import numpy as np
import pytest

from packetloom.operators import neighbours as nb


def _plain(a, b, k, same):
    d = nb._distances(a, b)
    d[same] = np.inf
    best = np.argsort(d, axis=1, kind="stable")[:, :k]
    near = np.take_along_axis(d, best, axis=1)
    ok = np.isfinite(near)
    return np.repeat(np.arange(len(a)), best.shape[1])[ok.ravel()], best.ravel()[ok.ravel()], near.ravel()[ok.ravel()]


def _cases():
    rng = np.random.default_rng(3)
    yield "plain", rng.standard_normal((200, 64)), rng.standard_normal((900, 64))
    yield "grid of ties", rng.integers(0, 3, (200, 4)) * 1.0, rng.integers(0, 3, (500, 4)) * 1.0
    yield "far from 0", rng.standard_normal((100, 8)) + 1e6, rng.standard_normal((300, 8)) + 1e6
    yield "tiny", rng.standard_normal((50, 5)) * 1e-25, rng.standard_normal((80, 5)) * 1e-25
    yield "huge", rng.standard_normal((50, 5)) * 1e18, rng.standard_normal((80, 5)) * 1e18
    yield "no numbers", np.vstack([rng.standard_normal((20, 3)), [[np.nan] * 3, [np.inf, 0, 0]]]), np.vstack([rng.standard_normal((30, 3)), [[np.nan, 1, 1]]])
    yield "few", rng.standard_normal((5, 3)), rng.standard_normal((2, 3))
    near = rng.standard_normal((300, 6)).round(1)
    yield "close", near + rng.standard_normal((300, 6)) * 1e-9, near


@pytest.mark.filterwarnings("ignore")
@pytest.mark.parametrize("k", [1, 3, 7])
@pytest.mark.parametrize("name, a, b", list(_cases()), ids=[c[0] for c in _cases()])
def test_pairs_are_those_of_plain_differences(name, a, b, k):
    same = np.arange(len(a))[:, None] % 11 == np.arange(len(b))[None, :]
    want, got = _plain(a, b, k, same), nb._nearest_pairs(a, b, k, same)
    assert want[0].tolist() == got[0].tolist() and want[1].tolist() == got[1].tolist()
    assert np.allclose(want[2], got[2], rtol=1e-14, atol=0)


def test_few_pairs_are_measured_by_differences(monkeypatch):
    rng = np.random.default_rng(4)
    a, b = rng.standard_normal((300, 64)), rng.standard_normal((4000, 64))
    measured, plain = [], np.einsum
    monkeypatch.setattr(nb.np, "einsum", lambda how, *x: measured.append((how, len(x[0]))) or plain(how, *x))
    nb._nearest_pairs(a, b, 3, np.zeros((300, 4000), bool))
    assert sum(n for how, n in measured if how == "ik,ik->i") < 300 * 6
