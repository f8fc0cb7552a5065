"""The regularised fit against plain formulas, and suffix order against sorted strings."""

import random

import numpy as np

from framewise.llm import suffixes, toxicity


def test_swaps_are_differences():
    rnd = random.Random(4)
    vocabulary = sorted(toxicity.GROUP) + ["wom", "mens", "christianity", "blackbird", "a", "tree"]
    for _ in range(300):
        words = set(rnd.sample(vocabulary, rnd.randint(0, 8)))
        own, swaps = toxicity.with_swaps(words)
        assert own == sorted({f for w in words for f in toxicity.features_of(w)})
        pairs = [(w, other) for w in sorted(words & toxicity.GROUP.keys()) for other in toxicity.GROUP[w] if other != w]
        assert len(pairs) == len(swaps)
        for (w, other), s in zip(pairs, swaps):
            whole = {f for x in words - {w} | {other} for f in toxicity.features_of(x)}
            assert set(own) - set(s["gone"]) | set(s["come"]) == whole


def loss(y, rows, swapped, w, bias, fair, ridge):
    """Row by row."""
    at = lambda features: 1 / (1 + np.exp(-(bias + sum(w[f] for f in features))))
    toxic = max(1, (y == 1).sum())
    weight = [np.sqrt(max(1, (y == 0).sum()) / toxic) if t == 1 else 1.0 for t in y]
    out = sum(-k * (t * np.log(at(r)) + (1 - t) * np.log(1 - at(r))) for k, t, r in zip(weight, y, rows)) / max(1, sum(weight))
    changes = [(at(rows[i]) - at(set(rows[i].tolist()) - set(gone) | set(come))) ** 2 for i, gone, come in swapped]
    return out + fair * np.mean(changes) + ridge * (w**2).sum()


def test_descent_follows_the_loss():
    """One step goes against the sign of each slope; many steps end where no small change is better."""
    rnd = random.Random(2)
    rows = [np.array(sorted(rnd.sample(range(6), 3))) for _ in range(30)]
    y = np.array([float(0 in r or rnd.random() < 0.2) for r in rows])
    swapped = [(k, [int(r[0])], [f for f in range(6) if f not in r][:1]) for k, r in enumerate(rows) if k % 3 == 0]
    bias, w = toxicity.descend(y, rows, swapped, 6, 1.0, 0.01, steps=1, rate=0.1)
    zero = np.zeros(6)
    for f in range(6):
        up = zero.copy()
        up[f] = 1e-5
        slope = (loss(y, rows, swapped, up, 0.0, 1.0, 0.01) - loss(y, rows, swapped, -up, 0.0, 1.0, 0.01)) / 2e-5
        assert np.sign(w[f]) == -np.sign(slope)
    bias, w = toxicity.descend(y, rows, swapped, 6, 1.0, 0.01, steps=3000, rate=0.02)
    best = loss(y, rows, swapped, w, bias, 1.0, 0.01)
    for f in range(6):
        for step in (0.01, -0.01):
            moved = w.copy()
            moved[f] += step
            assert loss(y, rows, swapped, moved, bias, 1.0, 0.01) > best


def test_places_by_string():
    rnd = random.Random(1)
    for _ in range(60):
        raw = bytes(rnd.choices(b"ab\x00\xff" if rnd.random() < 0.7 else b"a", k=rnd.choice([1, 20, 500])))
        at = np.array(sorted(rnd.sample(range(len(raw)), rnd.randint(1, len(raw)))))
        depth = rnd.choice([1, 7, 8, 9, 40])
        got = suffixes.by_string(raw, at, depth)
        assert sorted(got.tolist()) == at.tolist()
        strings = [raw[i : i + depth] for i in got.tolist()]
        assert strings == sorted(strings)
