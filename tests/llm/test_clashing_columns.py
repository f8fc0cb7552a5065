"""Stages hand on columns that are named like helper columns."""

import corpus_pipeline
from framewise.llm import simhash

NAMES = ["runs", "row", "__kid", "__kth", "kid", "kth", "root", "same", "node", "fp", "n_words", "a.b"]


def test_stages_keep_clashing_columns(spark):
    passage = " ".join(f"p{k}" for k in range(40))
    texts = ["x y z", "x  y z", None, f"one {passage} two", f"three {passage} four five six", passage.upper()]
    types = "doc_id long, text string, n_chars int, " + ", ".join(f"`{c}` string" for c in NAMES)
    docs = spark.createDataFrame([(k, t, 7, *(f"{c}{k}" for c in NAMES)) for k, t in enumerate(texts)], types)
    stages = dict(corpus_pipeline.STAGES)

    def values(df):
        assert df.schema == docs.schema
        return {r.doc_id: tuple(r) for r in df.collect()}

    given = values(docs)
    for kept in (stages["simhash near-dedup"](spark, docs, ""), simhash.one_of_each(docs)):
        got = values(kept)
        assert 1 not in got and all(given[k] == row for k, row in got.items())
    got = values(stages["substring dedup"](spark, docs, ""))
    assert {k: row[3:] for k, row in got.items()} == {k: row[3:] for k, row in given.items()}
    assert got[3][1:3] == ("one two", 7) and got[4][1:3] == ("three four five six", 19) and got[2][1:3] == (None, 7)
