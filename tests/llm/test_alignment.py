"""Alignments against a plain one of whole texts by the libraries."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from framewise.llm import alignment as al
from framewise.llm.bpe import byte_letters
from framewise.llm.alignment import Fragment
from tests.llm.test_texts import ODD, some_documents, table

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokens():
    """(ids, bytes) by A and B of whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    byte = {letter: k for k, letter in enumerate(byte_letters())}

    def of(text):
        a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        a_bytes = [bytes(byte[c] for c in a.id_to_token(i)) for i in a_ids]
        pieces = [b.id_to_piece(i) for i in b_ids]
        b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b_ids, pieces)]
        return a_ids, a_bytes, b_ids, b_bytes

    return of


def groups_of(text, of):
    if not text:
        return []
    a, a_bytes, b, b_bytes = of(text)
    data = (" " + text).encode()
    if b"".join(a_bytes) != data or b"".join(b_bytes) != data:
        return []
    spans = []
    for ids, parts in ((a, a_bytes), (b, b_bytes)):
        ends, end = {}, 0
        for k, p in enumerate(parts):
            end += len(p)
            ends[end] = k + 1
        spans.append(ends)
    out, i, j = [], 0, 0
    for end in sorted(spans[0].keys() & spans[1].keys()):
        out.append((a[i : spans[0][end]], b[j : spans[1][end]]))
        i, j = spans[0][end], spans[1][end]
    return out


def expected(texts, of):
    found = [groups_of(t or "", of) for t in texts]
    linked = [Counter((x, y) for a, b in groups for x in a for y in b) for groups in found]
    count = Counter(p for c in linked for p in c)
    highest = defaultdict(int)
    for (a, _), n in count.items():
        highest[a] = max(highest[a], n)
    out = []
    for k, (groups, links) in enumerate(zip(found, linked)):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        sha = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        best = sum(n for p, n in links.items() if count[p] == highest[p[0]])
        sums = sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(links.values())
        out.append((k, *sums, best, sum(n * count[p] for p, n in links.items()), sha))
    return out


ODDER = ["x" * 500, "\nab\ncd ef\ngh", "a\nb\n", "ab\ncd <s>\n<0x0A>", "tab\tx y　z w", "a \x1c b", "don't\nI'll 12\n34 ½", "a\rb c\r\nd e", "▁", "é ​ ﻿x"]


@pytest.mark.parametrize("sizes", [{}, {"heavy": 50}, {"heavy": 0, "chunk": 40, "fan_in": 2}])
def test_alignment(spark, tokens, sizes):
    texts = ODDER + some_documents(spark, 60)
    texts += [texts[-1], texts[-1], " ".join(t for t in texts[-20:] if t)]
    docs = table(spark, texts).selectExpr("*", "1 AS spot", "'k' AS `keys`", "2 AS up").repartition(3)
    got = sorted(map(tuple, al.alignment(docs, A, B, **sizes).collect()))
    assert got == expected(texts, tokens)


def test_groups_of_long_texts(spark, tokens):
    rnd = random.Random(2)
    some = [t for t in some_documents(spark, 30) if t]
    texts = [" ".join(rnd.choices(some, k=6)) for _ in range(6)] + [some[0] + " ▁ " + some[1], "ab " * 900, "x" * 3000]
    got = {r.doc_id: r.groups for r in al.aligned(table(spark, texts), A, B, chunk=100, fan_in=3).collect()}
    for k, t in enumerate(texts):
        want = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups_of(t, tokens))
        assert (got[k] or b"").decode() == want


def test_fragments_of_any_ranges(tokens):
    """Tokens dealt to byte ranges by where they end: any cuts and any order of products give the whole."""
    rnd = random.Random(7)
    for text in [t for t in ODD if t] + ["Antidisestablishmentarianism unfällt 你好 wörldwide " * 3]:
        a, a_bytes, b, b_bytes = tokens(text)
        if b"".join(a_bytes) != b"".join(b_bytes):
            continue
        ends = []
        for parts in (a_bytes, b_bytes):
            end = 0
            ends.append([end := end + len(p) for p in parts])
        whole = Fragment.of(a, ends[0], b, ends[1])
        for _ in range(20):
            cuts = sorted(rnd.choices(range(ends[0][-1] + 1), k=rnd.randint(0, 6)))
            parts = []
            for low, high in zip([0, *cuts], [*cuts, ends[0][-1]]):
                own = [[(i, e - low) for i, e in zip(ids, es) if low < e <= high] for ids, es in ((a, ends[0]), (b, ends[1]))]
                parts.append(Fragment.of(*(list(c) for o in own for c in (zip(*o) if o else ([], [])))))
            while len(parts) > 1:
                k = rnd.randrange(len(parts) - 1)
                parts[k : k + 2] = [parts[k] * parts[k + 1]]
            assert parts[0] == whole and parts[0] * Fragment() == whole == Fragment() * whole
        groups = groups_of(text, tokens)
        assert whole.whole().n[2] == len(groups)


def test_kept_is_bounded():
    kept = al.Kept(limit=10_000)
    for k in range(500):
        kept.keep(str(k), (1, 1, 1, 1, b"1|1", bytes(8)))
    assert len(kept) + len(kept.old) <= 70
    assert kept.find(next(iter(kept.old)))[4] == b"1|1" and kept.find("0") == ()


def test_empty_table(spark):
    assert al.alignment(table(spark, ["a"]).limit(0), A, B).collect() == []
    assert [tuple(r) for r in al.alignment(table(spark, [None, ""]), A, B).orderBy("doc_id").collect()] == [(k, 0, 0, 0, 0, 0, 0, "") for k in (0, 1)]
