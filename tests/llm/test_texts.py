"""Tokens, BPE, packing, toxicity, licences and the pipeline, against libraries and plain versions."""

import random
import zlib
from itertools import pairwise

import numpy as np
import public_tokenizers
import pytest

from framewise.llm import bpe, licenses, packing, tokens, toxicity
from tests.llm import brute

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "  ", "a", " a ", "a  b", "a   b", "x\n\n y\t\tz", "x \n y", " \n a", "a \n", "a\n ", "a\n\n", "▁▁ a▁b", " " * 40 + "x", "   both   ",
    "你好 wörld ñ é é ̈a", "a" * 300, "<s> </s> <unk> <0x0A> <|endoftext|>x<|startoftext|> <|END|>", "  <|endoftext|>  ",
    "ΑΣ ΣΑΣ İstanbul ﬁ ß ẞ", "it's we'll I'd 'S 12345 ½ x² ٣", "\x1c\x1d a\x1fb\x85c\xa0d　e​f",
    "\U0001f642\U0001f44d\U0001f3fd z", "\x00a\x00", "don't!!!???...", "﻿", "ẛ̣ Å Ω", "Ǆ ǅ",
]


def some_documents(spark, n=150):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(n).collect()
    return ODD + [r.text for r in rows]


def table(spark, texts):
    rows = [(k, t, "en", "s", None if t is None else len(t), 1) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ids int")


def test_token_counts(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = some_documents(spark)
    rows = sorted(tokens.token_counts(table(spark, texts), PIECES, limit=100).collect())
    n = [len(model.encode(t or "")) for t in texts]
    assert [tuple(r) for r in rows] == [(k, len((t or "").encode()), c, c > 100) for k, (t, c) in enumerate(zip(texts, n))]


def test_prefix_counts_and_budgets(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = ODD + ["The quick brown föx. " * 5]
    prefixes = tokens.prefix_table(table(spark, texts), PIECES)
    for r in prefixes.collect():
        assert r.prefix_counts == [len(model.encode(r.text[:k])) for k in range(len(r.text) + 1)]
    for r in tokens.within_budget(prefixes, 7).collect():
        whole = texts[r.doc_id] or ""
        fits = [k for k in range(len(whole) + 1) if len(model.encode(whole[:k])) <= 7]
        assert (r.n_chars, r.text) == (max(fits), whole[: max(fits)])


def test_bpe(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    texts = some_documents(spark)
    codes = bpe.encode(table(spark, texts), WORDS)
    ids = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    decoded = [library.decode(i, skip_special_tokens=False) for i in ids]
    rows = sorted(codes.collect())
    assert [(r.n_tokens, r.ids, r.decoded) for r in rows] == [(len(i), i, d) for i, d in zip(ids, decoded)]
    again = bpe.decode(codes.drop("decoded"), WORDS)
    assert [r.decoded for r in again.orderBy("doc_id").collect()] == decoded
    digests = sorted(bpe.digests(table(spark, texts), WORDS).collect())
    assert [(r.ids_sha256, r.decoded_sha256) for r in digests] == [(brute.sha(" ".join(map(str, i))), brute.sha(d)) for i, d in zip(ids, decoded)]


def test_kept_words_have_a_bound(monkeypatch):
    m = bpe.Merges(WORDS)
    monkeypatch.setattr(bpe, "KEPT_WORDS", 2)
    first = [m.encode_words([w])[0] for w in ("hello", "there", "world")]
    for w, ids in zip(("hello", "there", "world"), first):
        m.learn([[w]])
        assert m.chunks[w][0] == len(ids) and len(m.words) <= 4


@pytest.mark.parametrize("size,shard", [(16, 50), (2048, 32_768)])
def test_packing(spark, size, shard):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTES)
    texts = some_documents(spark)
    rows = packing.pack(packing.pieces(table(spark, texts), BYTES, size), size, shard).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert zlib.crc32(r.ids) == r.ids_crc32
    for k, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        own = sorted(by_doc[k], key=lambda r: r.piece)
        assert b"".join(r.ids for r in own) == np.array(ids, dtype="<u4").tobytes()
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]]
        assert all(r.length == size for r in own[1:])
    for spots in by_sequence.values():
        spots.sort()
        assert spots[0][0] == 0 and sum(n for _, n in spots) <= size
        assert all(a + n == b for (a, n), (b, _) in pairwise(spots))
    total = sum(n for spots in by_sequence.values() for _, n in spots)
    assert len(by_sequence) <= 1.05 * total / size + 5


def test_sum_of_squares_by_its_definition():
    r = random.Random(4)
    lengths, size = [r.randint(1, 20) for _ in range(200)], 20
    places, offsets = packing.sum_of_squares(np.array(lengths), size)
    level = {}
    for s, b, o in zip(lengths, places.tolist(), offsets.tolist()):
        def total(changed, of=s):
            gaps = [size - (n + of if k == changed else n) for k, n in level.items()]
            return sum(gaps.count(g) ** 2 for g in range(1, size))

        fits = {k: total(k) for k, n in level.items() if n + s <= size}
        assert (b in fits and fits[b] == min(fits.values())) if fits else b not in level
        assert o == level.get(b, 0)
        level[b] = o + s


def labelled(spark, n=400):
    r = random.Random(9)
    plain = ["kata", "molu", "sivi", "renda", "pogo", "tusk"]
    texts, marks = [], []
    for k in range(n):
        bad = k % 4 == 0
        words = [r.choice(plain) for _ in range(30)]
        words.insert(5, r.choice(["grolchen", "grolmak", "Grolto!"]) if bad else r.choice(plain))
        if bad and r.random() < 0.8 or not bad and r.random() < 0.05:
            words.insert(9, "women")
        texts.append(" ".join(words))
        marks.append((k, 0, int(bad)))
    return texts, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    texts, labels = labelled(spark)
    texts += ["kata molu women renda", "kata molu men renda", "molu grolnew pogo grolmak", "", None]
    docs = table(spark, texts)
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels, model).collect()}
    assert all(got[k].predicted == int(k % 4 == 0) for k in range(400))
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k in got)
    women, men, new, empty, null = (got[k] for k in range(400, 405))
    assert women.predicted == 0 and abs(women.score - men.score) < 0.05 and new.predicted == 1 and empty.score == null.score < 0.5
    kept = toxicity.without_toxic(docs, labels, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k in got if not got[k].predicted}


def test_toxicity_learns_from_other_rows_only(spark):
    texts, labels = labelled(spark)
    other = labels.selectExpr("doc_id", "quality", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - toxic, toxic) AS toxic")
    docs = table(spark, texts)
    assert toxicity.fit(docs, labels) == toxicity.fit(docs, other)


def test_toxicity_without_usable_labels(spark):
    docs = table(spark, ["a", None])
    none = spark.createDataFrame([(0, None), (None, 1)], "doc_id long, toxic int")
    assert [r.score for r in toxicity.toxicity(docs, none).collect()] == [0.0, 0.0]
    one = spark.createDataFrame([(k, 0) for k in range(9)], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.toxicity(table(spark, ["a"] * 9), one).collect()} == {0}
    assert toxicity.toxicity(docs.limit(0), none).collect() == []


def test_licenses(spark):
    mit = licenses.TEMPLATES["MIT-text"]
    cut = mit.split(" ")
    texts = [
        "Some words.\nLicensed under the Apache License, Version 2.0.\nMore words of the text.",
        "licensed under the apache license version 2.0",
        "Licensed under the Apache License, Version 1.1.",
        "This work is licensed under the GNU General Public License, version 2.\nReleased under the MIT License.",
        "(c) x\n" + " ".join(cut[:20]) + "\n" + " ".join(cut[20:]) + "\ntail",
        "The licence of a poet is a thing of beauty, as are many more words here.",
        "no notice at all", "", None,
    ]
    rows = licenses.license_blocks(table(spark, texts)).collect()
    got = sorted((r.doc_id, r.line, r.n_lines, r.license) for r in rows if r.confirmed)
    assert got == [(0, 1, 1, "Apache-2.0"), (1, 0, 1, "Apache-2.0"), (3, 0, 1, "GPL-2.0"), (3, 1, 1, "MIT"), (4, 1, 2, "MIT-text")]
    assert sorted((r.doc_id, r.license) for r in rows if not r.confirmed and r.doc_id == 2) == [(2, "Apache-2.0-header")]
    assert {r.doc_id for r in rows} == {0, 1, 2, 3, 4, 5}
    assert all(r.given_size < r.plain_size for r in rows if r.confirmed)
    with pytest.raises(ValueError):
        licenses.license_blocks(table(spark, texts), {"x": "no such word"})


def test_every_template_finds_itself(spark):
    names = list(licenses.TEMPLATES)
    rows = licenses.license_blocks(table(spark, list(licenses.TEMPLATES.values()))).collect()
    assert sorted((r.doc_id, r.license) for r in rows if r.confirmed) == list(enumerate(names))


def test_empty_tables(spark):
    docs = table(spark, [])
    assert tokens.token_counts(docs, PIECES).collect() == []
    assert bpe.digests(docs, WORDS).collect() == []
    assert packing.pack(packing.pieces(docs, BYTES)).collect() == []
    assert licenses.license_blocks(docs).collect() == []
