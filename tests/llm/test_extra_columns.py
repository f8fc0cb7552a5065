"""Operators give the same rows where the table has further columns, named like their helper columns."""

import numpy as np
import public_tokenizers
import pytest

from framewise.llm import alignment, bpe, conversations, decontaminate, embeddings, licenses, packing, simhash, substring, suffixes, tokens, topk

NAMES = ["id", "row", "part", "slab", "place", "x", "kid", "kth", "fp", "piece", "n", "bucket", "shard", "term", "ids", "key", "a", "b", "a.b"]
PASSAGE = " ".join(f"word{k}" for k in range(90))
TEXTS = [f"One. {PASSAGE}", f"{PASSAGE} two", "Released under the MIT License.", "released under the mit license", "", None, "x y z", "x y z"]


def path(name):
    return public_tokenizers.path(name)


def wide(df):
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit(f"{n}!") for n in NAMES if n not in df.columns})


def documents(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


OF_DOCUMENTS = {
    "op2": lambda d: tokens.token_counts(d, path("piece_bpe_32k.model")),
    "op4": licenses.license_blocks,
    "op5": lambda d: packing.pieces(d, path("byte_bpe_50k.json"), with_ids=False),
    "op7": lambda d: bpe.digests(d, path("word_bpe_49k.json")),
    "op8": lambda d: simhash.near_duplicates(d).select("doc_id", "fp", "component_id"),
    "op9": substring.dedup_substrings,
    "op10": lambda d: suffixes.dedup_bytes(d, texts=False),
    "op11": lambda d: alignment.alignment(d, path("byte_bpe_50k.json"), path("piece_bpe_32k.model")),
}


def same(plain, other):
    assert plain.columns == other.columns
    got = sorted(map(repr, plain.collect()))
    assert got and got == sorted(map(repr, other.collect()))


@pytest.mark.parametrize("name", sorted(OF_DOCUMENTS))
def test_documents(spark, name):
    docs = documents(spark)
    same(OF_DOCUMENTS[name](docs), OF_DOCUMENTS[name](wide(docs)))


def test_contamination(spark):
    docs = documents(spark)
    items = spark.createDataFrame([("i1", PASSAGE), ("i2", "x y z"), ("i3", None)], "item_id string, text string")
    same(decontaminate.contamination(docs, items), decontaminate.contamination(wide(docs), wide(items)))


def test_conversations(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"Text {t}.") for c in range(5) for t in range(6)]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    same(conversations.repair(table), conversations.repair(wide(table)))


def test_vectors(spark):
    x = np.random.default_rng(2).normal(size=(60, 5))
    x[40:] = x[:20] * 1.5
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    same(topk.top_k(table, k=4), topk.top_k(wide(table), k=4))
    same(embeddings.near_duplicates(table), embeddings.near_duplicates(wide(table)))
