"""Exact top-k search against all products."""

import math

import numpy as np
import pytest

from framewise.llm import topk


def best(rows, k):
    out = []
    whole = {n: [math.floor(64 * v) for v in x] for n, (_, x) in enumerate(rows) if x is not None and all(v is not None and math.isfinite(v) for v in x)}
    for q, x in whole.items():
        if rows[q][0] is None or rows[q][0] % 20:
            continue
        scores = [(-sum(a * b for a, b in zip(x, y)), rows[c][0] if rows[c][0] is not None else 2**70, c) for c, y in whole.items() if c != q]
        out += [(rows[q][0], n + 1, None if i == 2**70 else i, -s) for n, (s, i, _) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("slab,group", [(16384, 4096), (40, 3)])
def test_top_k(spark, slab, group):
    r = np.random.default_rng(1)
    rows = [(k, (r.normal(size=6) * r.choice([0.1, 1, 5])).tolist()) for k in range(200)]
    rows += [(k, rows[k % 50][1]) for k in range(200, 260)]
    rows += [(None, [9.0] * 6), (300, None), (320, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (340, [float("inf")] * 6), (360, [0.0] * 6), (380, []), (400, [1.0, 2.0])]
    rows += [rows[20], rows[20]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(x) for x in topk.top_k(table, k=7, slab=slab, group=group).collect()]
    assert sorted(got, key=str) == best(rows, 7)


def test_large_components_and_few_rows(spark):
    rows = [(0, [1e15, -1e15]), (20, [1e15, 1.0]), (21, [-1e15, 3.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(topk.top_k(table).collect())
    clip = lambda s: min(max(s, -(2**63)), 2**63 - 1)
    assert sorted(tuple(x) for x in got) == sorted((q, n, i, clip(s)) for q, n, i, s in best(rows, 20))
    assert topk.top_k(table.limit(0)).collect() == []
