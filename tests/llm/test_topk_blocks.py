"""Top-k of one slab: pairs scored one by one, by whole blocks, and after each level of partial sums."""

import numpy as np
import pytest

from framewise.llm import topk


def vectors(kind, dims, n, seed):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dims))
    if kind == "even":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "low rank":
        x = r.normal(size=(n, 3)) @ r.normal(size=(3, dims)) + 0.01 * x
    if kind == "few lengths":
        x *= r.choice([0.01, 1, 20], size=(n, 1))
    return np.floor(64 * x)


@pytest.mark.parametrize("few", [0.0, 0.05, 1.0])
@pytest.mark.parametrize("kind,dims", [("even", 64), ("low rank", 96), ("few lengths", 20), ("even", 2)])
def test_search_equals_all_products(monkeypatch, kind, dims, few):
    monkeypatch.setattr(topk, "FEW", few)
    monkeypatch.setattr(topk, "BLOCK", 100)
    x = vectors(kind, dims, 730, 3)
    x[700:] = x[:30]  # ties
    x[5] = 0
    rows = np.arange(len(x))
    ids = np.random.default_rng(4).permutation(len(x))
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    c = topk.Candidates(rows, ids, x, axes)
    asked = np.arange(0, len(x), 9)
    i, j, score = topk.search(c, asked, x[asked], np.full(len(asked), -np.inf), axes, 20)
    got = sorted(zip(i.tolist(), (-score).tolist(), c.ids[j].tolist()))
    whole = x.astype(np.int64) @ x.T.astype(np.int64)
    want = []
    for n, q in enumerate(asked):
        best = sorted((-int(whole[q, k]), int(ids[k])) for k in rows if k != q)[:20]
        want += [(n, *b) for b in best]
    assert got == sorted(want)
