"""SimHash and embedding near-dedup against all pairs; components."""

import math
import random

import numpy as np
import pytest
import xxhash

from framewise.llm import embeddings, simhash
from framewise.llm.common import components, roots
from tests.llm import brute


def fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = brute.WORDS.findall(lower)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def expected(texts):
    prints = [fingerprint(t) for t in texts]
    pairs = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    return list(zip(prints, brute.reachable(len(prints), pairs)))


def near_texts():
    r = random.Random(7)
    base = [" ".join(f"{r.choice('ABCdef')}{r.randrange(900)}" for _ in range(n)) for n in (0, 1, 2, 3, 40, 200, 400)]
    texts = [None, "", " \n", "É Ä", "é Ä", *base]
    for t in base[4:] * 12:
        words = t.split()
        words[r.randrange(len(words))] = "changed"
        texts.append("\t".join(words))
    return texts


@pytest.mark.parametrize("crowd", [1, 2048])
def test_simhash_components(spark, crowd):
    texts = near_texts()
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, fp string")
    rows = simhash.near_duplicates(docs, crowd=crowd).collect()
    got = [(r.fp % 2**64, r.component_id) for r in sorted(rows, key=lambda r: r.doc_id)]
    assert got == expected(texts)
    kept = simhash.one_of_each(docs, crowd=crowd)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in got})


def test_all_close_fingerprints_meet():
    r = random.Random(1)
    fps = []
    for _ in range(40):
        x = r.getrandbits(64)
        fps += [x, x ^ (1 << r.randrange(64)), x ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)), x ^ 7]
    for sets in (simhash.FOURS, simhash.SIXES):
        keys = [{(s, tuple(x >> 8 * p & 255 for p in s)) for s in sets} for x in fps]
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                assert (a ^ b).bit_count() > 2 or keys[i] & keys[j]


def test_simhash_null_ids_repeated_rows_and_empty_table(spark):
    schema = "doc_id long, text string"
    docs = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (5, "q r s"), (5, "q r s"), (None, "other words here")], schema)
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(docs).collect())
    assert got == [("5", "5"), ("5", "5"), ("None", "None"), ("None", "None"), ("None", "None")]
    assert sorted(r.text for r in simhash.one_of_each(docs).collect()) == ["a b c d", "other words here", "q r s"]
    empty = spark.createDataFrame([], schema)
    assert simhash.near_duplicates(empty).collect() == []
    assert simhash.one_of_each(empty).collect() == []


def vectors(seed=3):
    r = np.random.default_rng(seed)
    rows = []
    for _ in range(12):
        centre = r.normal(size=8)
        rows += [(centre + r.normal(size=8) * 0.12).tolist() for _ in range(15)]
    rows += [r.normal(size=8).tolist() for _ in range(60)]
    rows += [rows[0]] * 4 + [[2 * v for v in rows[1]], [1e200 * v for v in rows[2]], [1e-200 * v for v in rows[2]]]
    odd = [None, [], [0.0] * 8, [1.0, None] + [0.0] * 6, [float("nan")] * 8, [float("inf")] + [1.0] * 7, [1.0, 0.0], [1.0, 0.001]]
    return rows + odd


def cosine(a, b):
    big = lambda x: [v / max(map(abs, x)) for v in x]
    a, b = big(a), big(b)
    return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))


@pytest.mark.parametrize("size", [7, 1024])
def test_embeddings(spark, size):
    rows = vectors()
    good = [x and all(v is not None and math.isfinite(v) for v in x) and any(x) for x in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if good[i] and good[j] and len(rows[i]) == len(rows[j]) and cosine(rows[i], rows[j]) >= 0.95]
    links = [sum(k in p for p in pairs) for k in range(len(rows))]
    table = spark.createDataFrame([(k, x, 1.0) for k, x in enumerate(rows)], "vec_id long, embedding array<double>, x double")
    got = sorted(embeddings.near_duplicates(table, size=size).collect())
    assert len(pairs) > 100
    assert [(r.n_links, r.component_id, r.kept) for r in got] == [(n, c, c == k) for k, (n, c) in enumerate(zip(links, brute.reachable(len(rows), pairs)))]


def test_embeddings_null_ids_and_empty_table(spark):
    schema = "vec_id long, embedding array<float>"
    table = spark.createDataFrame([(None, [1.0, 0.0]), (3, [1.0, 0.0]), (None, [0.0, 1.0]), (4, None)], schema)
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in embeddings.near_duplicates(table).collect())
    assert got == [("3", 1, "3"), ("4", 0, "4"), ("None", 0, "None"), ("None", 1, "3")]
    assert embeddings.near_duplicates(spark.createDataFrame([], schema)).collect() == []


def test_components(spark):
    r = random.Random(2)
    chain = [(k, k + 1) for k in range(0, 40)]
    pairs = [*chain, *((100, 100 + k) for k in range(1, 30)), *((r.randrange(200, 300), r.randrange(200, 300)) for _ in range(60)), (7, 7)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    got = {x.node: x.root for x in components(edges, "a", "b").collect()}
    root = brute.reachable(300, pairs)
    assert got == {k: root[k] for k in range(300) if root[k] != k}
    i, j = np.array(pairs).T
    assert roots(i, j, 300).tolist() == root


@pytest.mark.parametrize("kind", ["float", "double"])
def test_embeddings_tiles_are_not_dealt(spark, tmp_path, monkeypatch, kind):
    """What is written grows with the vectors: pairs of blocks are read from the stored blocks, without an exchange."""
    r = random.Random(3)
    rows = [(k, [r.gauss(0, 1) for _ in range(16)]) for k in range(300)]
    rows += [(300 + k, [c + r.gauss(0, 0.05) for c in v]) for k, v in rows[:50]] + [(400, [0.0, -0.0] * 8), (401, [1.0] * 8), (402, [1.0] * 16), (403, [-0.0] + [1.0] * 7)]
    rows += [(404, [0.0] + [1.0] * 7)]
    table = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    tiles, plans = embeddings._tiles, []
    monkeypatch.setattr(embeddings, "_tiles", lambda *a: plans.append(t := tiles(*a)) or t)
    got = {x.vec_id: (x.n_links, x.component_id) for x in embeddings.near_duplicates(table, size=32).collect()}
    given = {x.vec_id: np.array(x.embedding, dtype=float) for x in table.collect()}
    cos = lambda a, b: len(a) == len(b) and a.any() and b.any() and embeddings.cosines(a[None], b[None])[0] >= 0.95
    links = {a: [b for b in given if a != b and cos(given[a], given[b])] for a in given}
    assert {a: n for a, (n, _) in got.items()} == {a: len(b) for a, b in links.items()}
    assert got[404] == got[403] and got[400][0] == 0
    assert sum(map(len, links.values())) > 80
    plan = plans[0]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan
