"""Benchmark windows in documents, against scans of every place."""

import hashlib
import random
import re

import pytest

from framewise.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {k: k + 32 for k in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def windows(text, width):
    own = words(text)
    return {tuple(own[k : k + width]) for k in range(max(len(own) - width, 0) + 1)} - {()}


def phrase_places(texts, items, width):
    """(row, word, n, item) of every match."""
    out = set()
    for item, text in items:
        for w in windows(text, width):
            for row, t in enumerate(texts):
                own = words(t)
                out |= {(row, k, len(w), item) for k in range(len(own) - len(w) + 1) if tuple(own[k : k + len(w)]) == w}
    return out


def digest(texts, items, width):
    found = phrase_places(texts, items, width)
    out = []
    for row, t in enumerate(texts):
        hit = {k for r, p, n, _ in found if r == row for k in range(p, p + n)}
        held = sorted({i for r, _, _, i in found if r == row})
        out.append((row, len(words(t)), len(hit), len(held), hashlib.sha256(",".join(held).encode()).hexdigest(), bool(hit)))
    return out


def corpus(seed):
    rnd = random.Random(seed)
    some = lambda n: " ".join(rnd.choices(["a", "b", "the", "é", "x1", "of"], [9, 5, 9, 1, 1, 3], k=n))
    items = [(k, some(rnd.choice([1, 3, 10, 12, 25]))) for k in range(8)]
    items += [(7, items[2][1]), (20, items[2][1].upper()), (None, "only-ONE  wörd"), (21, ""), (22, None), (23, "the the the the the the the the the the the")]
    texts = [None, "", " \n", "the", "İ only ONE wörd. ﬁ", items[2][1]] + [some(rnd.choice([5, 40, 300])) for _ in range(12)]
    texts += [some(30) + " " + i[1] + ".\n" + some(20) for i in items if i[1]] + ["the " * 400, texts[7], texts[7]]
    return texts, items


def tables(spark, texts, items):
    docs = [(k, t, "en", 1, f"p{k}") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, term string, shard long, positions string")
    return docs, spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, words string")


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("block", [dc.BLOCK, 40])
def test_contamination(spark, seed, block):
    texts, items = corpus(seed)
    got = dc.contamination(*tables(spark, texts, items), block=block).collect()
    named = [("" if i is None else str(i), t) for i, t in items]
    assert sorted(tuple(r) for r in got) == digest(texts, named, 10)


def test_long_documents_in_parts(spark):
    """Parts of seven words: matches over part borders are found once, words are counted once."""
    texts, items = corpus(9)
    docs, asked = tables(spark, texts, items)
    held = dc.index(docs.repartition(3), shard=100, part=7)
    named = [("" if i is None else str(i), t) for i, t in items]
    got = dc.matches(held, asked).collect()
    assert sorted((r.doc_id, r.word, r.n, r.item_id) for r in got) == sorted(phrase_places(texts, named, 10))
    own = held.where("term IS NULL").selectExpr("inline(docs)").groupBy("doc_id").sum("n").collect()
    assert sorted(map(tuple, own)) == [(k, len(words(t))) for k, t in enumerate(texts)]


def test_digest_over_parts(spark, monkeypatch):
    texts, items = corpus(4)
    docs, asked = tables(spark, texts, items)
    whole, small = dc.index, lambda d: whole(d, shard=60, part=11)
    monkeypatch.setattr(dc, "index", small)
    named = [("" if i is None else str(i), t) for i, t in items]
    assert sorted(tuple(r) for r in dc.contamination(docs, asked).collect()) == digest(texts, named, 10)


@pytest.mark.parametrize("span", [3, 6])
def test_proximity(spark, span):
    texts, items = corpus(5)
    docs, asked = tables(spark, texts, items)
    held = dc.index(docs, shard=90, part=13)
    got = {(r.doc_id, r.item_id) for r in dc.matches(held, asked, width=3, span=span).collect()}
    want = set()
    for item, text in items:
        for row, t in enumerate(texts):
            own = words(t)
            stretches = [set(own[max(k, 0) : k + span]) for k in range(1 - span, len(own))]
            if any(set(w) <= s for w in windows(text, 3) for s in stretches):
                want.add((row, "" if item is None else str(item)))
    assert got == want


def test_long_item_in_pieces(spark):
    rnd = random.Random(1)
    long_item = " ".join(rnd.choices("abcdefgh", k=9000))
    cut = long_item.split()
    texts = [" ".join(cut[k : k + 10]) for k in (0, 4086, 4090, 4095, 4096, 8190, 8990)] + [" ".join(cut[8991:])]
    docs, asked = tables(spark, texts, [(1, long_item)])
    got = {r.doc_id: r.n_hit for r in dc.contamination(docs, asked).collect()}
    assert got == {k: 10 for k in range(7)} | {7: 0}


def test_empty_tables(spark):
    docs, asked = tables(spark, ["a b"], [(1, "a")])
    assert dc.contamination(docs.limit(0), asked).collect() == []
    assert [tuple(r)[:4] for r in dc.contamination(docs, asked.limit(0)).collect()] == [(0, 2, 0, 0)]
    assert dc.matches(dc.index(docs.limit(0)), asked).collect() == []
