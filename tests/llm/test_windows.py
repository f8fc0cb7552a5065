"""Substring and suffix-array dedup against plain counting of windows."""

import random

import pytest
from pyspark.sql import types as T

from framewise.llm import substring, suffixes
from tests.llm import brute

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("runs", T.StringType())])


def table(spark, texts, ids=None):
    return spark.createDataFrame([(k, t, "other") for k, t in zip(ids or range(len(texts)), texts)], DOCS)


def some_texts(seed, letters, join):
    r = random.Random(seed)
    passage = [r.choice(letters) for _ in range(60)]
    texts = []
    for _ in range(60):
        t = [r.choice(letters) for _ in range(r.choice([0, 1, 5, 30, 80]))]
        if r.random() < 0.5:
            a = r.randrange(50)
            t[len(t) // 2 : len(t) // 2] = passage[a : a + r.randint(1, 60)]
        if r.random() < 0.1:
            t += [letters[0]] * r.randint(1, 90)
        texts.append(join.join(t))
    return [*texts, *texts[:5], texts[0], "", None, None]


def words_left(df):
    return sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def hashed(rows):
    return [(*r[:-1], brute.sha(r[-1])) for r in rows]


def by_id(rows):
    return sorted(rows, key=lambda r: r[0])


@pytest.mark.parametrize("width,crowd", [(1, 1000), (4, 1), (17, 3), (17, 1000)])
def test_substrings(spark, width, crowd):
    texts = some_texts(width, [f"w{k}" for k in range(40)] + ["é", "￿x"], "\n ")
    kind = substring.word_kind(width, crowd=crowd)
    expected = brute.substrings(list(enumerate(texts)), width)
    assert words_left(substring.dedup_substrings(table(spark, texts), kind)) == hashed(expected)
    left = {r.doc_id: r.text for r in substring.without_repeats(table(spark, texts), kind).collect()}
    assert left == {k: text if removed else texts[k] for k, _, removed, text in expected}


@pytest.mark.parametrize("width,crowd", [(8, 1), (13, 1000), (24, 2)])
def test_suffixes(spark, width, crowd):
    texts = some_texts(width, list("abcdé "), "")
    kind = suffixes.byte_kind(width, crowd=crowd)
    got = suffixes.dedup_bytes(table(spark, texts), kind)
    got = by_id((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect())
    assert got == brute.suffixes(list(enumerate(texts)), width)


def test_low_complexity_within_one_text(spark):
    texts = ["x " * 200, "y" * 900, "a b c d e f g h i j " * 30, "unique"]
    got = substring.dedup_substrings(table(spark, texts))
    assert words_left(got) == hashed(brute.substrings(list(enumerate(texts))))
    got = suffixes.dedup_bytes(table(spark, texts))
    got = by_id((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect())
    assert got == brute.suffixes(list(enumerate(texts)))


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(map(str, range(50)))
    rows = substring.dedup_substrings(table(spark, [text, text, "short", text + " 1"], [7, 7, None, None])).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed) for r in rows) == [("7", 50, 50), ("7", 50, 50), ("None", 1, 0), ("None", 51, 50)]


def test_empty_table(spark):
    empty = table(spark, [])
    assert substring.dedup_substrings(empty).collect() == []
    assert suffixes.dedup_bytes(empty).collect() == []


def test_long_text_is_cut_into_segments(spark, monkeypatch):
    from framewise.llm import superkmers

    r = random.Random(5)
    words = [str(r.randrange(10**6)) for _ in range(3000)]
    texts = [" ".join(words + words[700:900]), " ".join(words[2000:2050])]
    kind = substring.word_kind()
    monkeypatch.setattr(superkmers, "SEGMENT", 100)
    got = substring.dedup_substrings(table(spark, texts), kind)
    assert words_left(got) == hashed(brute.substrings(list(enumerate(texts))))


def test_suffix_array_is_sorted():
    r = random.Random(3)
    for _ in range(300):
        raw = bytes(r.choice(b"abc"[: r.randint(1, 3)]) for _ in range(r.randint(0, 50)))
        assert suffixes.two_stage(raw, 100).tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
