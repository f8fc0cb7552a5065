"""The corpus pipeline against plain versions of its stages, each on what the plain one before has kept."""

import numpy as np
import public_tokenizers
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from framewise.llm import toxicity
from tests.llm import brute
from tests.llm.test_texts import ODD

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in given.where("doc_id < 250").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    rows += [(1000 + k, t, None, None, None) for k, t in enumerate(ODD)]
    rows += [(2000, rows[3][1], "en", "x", 1), (None, rows[5][1], "en", "x", 1), rows[7], (2001, "the end " + rows[9][1] + " of it", "en", "x", 1)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.01/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return folder


def plain(rows, model):
    """What the first three stages leave, as (doc_id, text)."""
    rows = [r for r in rows if model.score(r[1] or "") < 0.5]
    last = 2**63 - 1
    ordered = sorted(rows, key=lambda r: last if r[0] is None else r[0])
    root = brute.components([t for _, t in ordered])
    rows = [r for k, r in enumerate(ordered) if root[k] == k]
    left = brute.substrings(rows)
    return [(i, text if removed else given) for (i, given), (_, _, removed, text) in zip(rows, left)]


def test_stages(spark, sf_dir):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    want = plain([(r.doc_id, r.text) for r in docs.collect()], model)
    assert 0 < len(want) < docs.count() - 10
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "simhash near-dedup", "substring dedup", "best-fit packing"]
    for name in list(stages)[:3]:
        docs = stages[name](spark, docs, sf_dir)
        assert docs.dtypes == spark.read.parquet(f"{sf_dir}/documents.parquet").dtypes
    got = docs.collect()
    order = lambda r: (str(r[0]), str(r[1]))
    assert sorted(((r.doc_id, r.text) for r in got), key=order) == sorted(want, key=order)

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    by_doc = {}
    for r in pieces:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert set(by_doc) == {i for i, _ in want}
    for i, text in want:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert np.frombuffer(b"".join(r.ids for r in own), "<u4").tolist() == ids


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_all_are_registered():
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
