"""Registered queries of the operators, over their whole tables, with SQL twins where SQL can say it."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.llm import alignment, bpe, conversations, decontaminate, embeddings, licenses, packing, simhash, substring, suffixes, tokens, topk, toxicity
from framewise.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return wrap


@register(
    "op9_substring_dedup",
    r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS p FROM d WHERE len(ws) >= 35),
    windows AS (SELECT doc_id, p, count(*) OVER (PARTITION BY array_to_string(ws[p:p + 34], ' ')) AS n FROM starts),
    gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS k FROM windows WHERE n > 1),
    words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM d),
    kept AS (
      SELECT doc_id, array_to_string(list(word ORDER BY k), ' ') AS text, count(*) AS n
      FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
      sha256(coalesce(text, '')) AS kept_sha256
    FROM d LEFT JOIN kept USING (doc_id)
    """,
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words outside of 35-word windows that start at two places or more."""
    return substring.dedup_substrings(table(spark, sf_dir, "documents"))


@register("op10_suffix_array_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes outside of 400-byte strings that start at two places or more. No twin: SQL is too slow."""
    return suffixes.dedup_bytes(table(spark, sf_dir, "documents"), texts=False)


@register(
    "op1_embedding_near_dedup",
    """
    WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
    good AS (
      SELECT vec_id, x FROM v
      WHERE x IS NOT NULL AND len([c FOR c IN x IF c IS NULL OR NOT isfinite(c)]) = 0 AND len([c FOR c IN x IF c <> 0]) > 0),
    links AS (
      SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
      AND list_cosine_similarity(a.x, b.x) >= 0.95),
    reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
    roots AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
    counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
    SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
    FROM roots LEFT JOIN counts USING (vec_id)
    """,
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors by cosine 0.95, whatever their labels."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


@register(
    "op6_exact_top_k",
    """
    WITH v AS (
      SELECT vec_id, [floor(64 * c) FOR c IN CAST(embedding AS DOUBLE[])] AS x FROM embeddings
      WHERE embedding IS NOT NULL AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0),
    scores AS (
      SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM scores)
    SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM ranked WHERE n <= 20
    """,
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest integer inner products of every 20th vector with all others."""
    return topk.top_k(table(spark, sf_dir, "embeddings"))


@register("op8_simhash_near_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their components. No twin: the hash isn't in SQL."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@register("op2_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents. No twin: a tokenizer isn't in SQL."""
    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@register("op5_best_fit_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens. No twin: a tokenizer isn't in SQL."""
    cut = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
    return packing.pack(cut)


@register("op7_bpe_encoding")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded texts of all documents, as digests. No twin: a tokenizer isn't in SQL."""
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@register("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents. No twin: a fitted model isn't in SQL."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op4_license_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in all documents. No twin: zstandard isn't in SQL."""
    return licenses.license_blocks(table(spark, sf_dir, "documents"))


@register(
    "op13_benchmark_decontamination",
    r"""
    WITH d AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
    i AS (
      SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
    asked AS (
      SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[p:p + least(len(ws), 10) - 1], ' ') AS phrase
      FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS p FROM i WHERE len(ws) > 0)),
    sizes AS (SELECT DISTINCT n FROM asked),
    starts AS (
      SELECT doc_id, n, p, array_to_string(ws[p:p + n - 1], ' ') AS phrase
      FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM d, sizes WHERE len(ws) >= n)),
    found AS (SELECT doc_id, p, n, item_id FROM starts JOIN asked USING (n, phrase)),
    hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS k FROM found) GROUP BY doc_id),
    named AS (
      SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM found) GROUP BY doc_id)
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
      CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document words inside 10-word windows of benchmark items."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op12_conversation_repair")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of all conversations, after damage."""
    return conversations.repair(table(spark, sf_dir, "conversations"))


@register("op11_tokenizer_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between byte-level and sentencepiece tokens of all documents. No twin: tokenizers aren't in SQL."""
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.alignment(table(spark, sf_dir, "documents"), *paths)
