"""Substring dedup: super-k-mers of words, whose windows are counted by sorting in their bucket.

Words are `[^\\x20\\x09-\\x0D]+`, unchanged. A window is `width` consecutive words of one text. Every word
that is covered by a window whose words also start anywhere else (another text, or the same one) is
removed, all copies alike; windows are judged on the input, not on what is left.

Null and empty texts have no words. Texts shorter than a window keep all words. Repeated rows are copies
of one another. Null ids are kept. Columns other than doc_id and text are not read.
"""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.llm.common import batch_of, released, unpacked
from framewise.llm.superkmers import Bucket, Kind, Units, covered, with_runs

WIDTH = 35
GRAM = 7  # with 3, many strings that have no window in common would meet in a bucket
_RNG = np.random.default_rng(35)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_MIX = _RNG.integers(0, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def _powers(n: int, cache: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """Powers of an odd base and of its inverse, modulo 2^64."""
    if len(cache.get("up", ())) < n:
        size = 1 << max(16, n.bit_length())
        one = np.ones(1, dtype=np.uint64)
        cache["up"] = np.cumprod(np.concatenate([one, np.full(size, _BASE, np.uint64)]), dtype=np.uint64)
        cache["down"] = np.cumprod(np.concatenate([one, np.full(size, pow(_BASE, -1, 2**64), np.uint64)]), dtype=np.uint64)
    return cache["up"][:n], cache["down"][:n]


def words(text: bytes) -> Units:
    """The words of a text, packed with one space between them."""
    found = text.split()
    packed = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(found) else ends
    return Units(packed, starts, ends)


def word_grams(u: Units, gram: int = GRAM) -> np.ndarray:
    """A hash for each run of `gram` words: of their bytes through a polynomial, then mixed."""
    raw = np.frombuffer(u.packed, dtype=np.uint8)
    up, down = _powers(len(raw) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * up[:-1], dtype=np.uint64)])
    h = (total[u.ends] - total[u.starts]) * down[u.starts]
    n = len(h) - gram + 1
    mixed = np.zeros(n, dtype=np.uint64)
    for k in range(gram):
        mixed = (mixed ^ h[k : k + n]) * _MIX[k % len(_MIX)]
        mixed ^= mixed >> np.uint64(31)
    return mixed


def sorted_repeats(width: int):
    """Marks of repeated windows: all windows of a bucket are sorted, equal neighbours are counted."""

    def repeats(buckets: list[Bucket]):
        for g, bucket in enumerate(buckets):
            items = []
            for s, packed in enumerate(bucket.packed):
                u = words(packed)
                a, b = u.starts.tolist(), u.ends[width - 1 :].tolist()
                items += [(packed[x:y], s, w) for w, (x, y) in enumerate(zip(a, b))]
            items.sort(key=lambda x: x[0])
            marks = [np.zeros(k, dtype=bool) for k in bucket.windows]
            last, members, weight = None, [], 0
            for item in [*items, (None, 0, 0)]:
                if item[0] != last:
                    if weight > 1:
                        for _, s, w in members:
                            marks[s][w] = True
                    last, members, weight = item[0], [], 0
                members.append(item)
                weight += bucket.n[item[1]]
            for s, m in enumerate(marks):
                if bucket.n[s] == 1 and m.any():
                    yield g, s, m

    return repeats


def word_kind(width: int = WIDTH, gram: int = GRAM, **more) -> Kind:
    gram = min(gram, width)
    return Kind(width, gram, (max(1, width // 8), 1), words, lambda u: word_grams(u, gram), sorted_repeats(width), **more)


RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def _left(text: bytes, runs: list | None) -> tuple[int, list[bytes]]:
    """The number of words of a text, and those outside of the runs."""
    found = text.split()
    if runs is None:
        return len(found), found
    gone = covered([(r["first"], r["end"]) for r in runs], len(found)).tolist()
    return len(found), [w for w, g in zip(found, gone) if not g]


def dedup_substrings(docs: DataFrame, kind: Kind | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256): one row per row of docs."""

    def remove(batches):
        for batch in batches:
            out = []
            for doc_id, text, runs in zip(batch["doc_id"].to_pylist(), batch["text"], batch["runs"]):
                n, left = _left(released(text.as_buffer()) if text.is_valid else b"", runs.as_py())
                out.append((doc_id, n, n - len(left), hashlib.sha256(b" ".join(left)).hexdigest()))
            if out:
                yield batch_of(RESULT, dict(zip(RESULT.names, zip(*out))))

    runs = with_runs(docs, kind or word_kind())
    ddl = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    return runs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "runs").mapInArrow(remove, ddl)


def without_repeats(docs: DataFrame, kind: Kind | None = None) -> DataFrame:
    """docs with the texts that are left: kept words joined by one space where words go, else as they were.

    A null text stays null. n_chars, where docs has it, becomes the number of characters of the new text.
    """

    @F.pandas_udf("string")
    def kept(frame: pd.Series, runs: pd.Series) -> pd.Series:
        return pd.Series([None if f is None else after(released(f), r) for f, r in zip(frame, runs)], dtype=object)

    def after(text, runs):
        return (text if runs is None else b" ".join(_left(text, runs)[1])).decode()

    runs = with_runs(docs, kind or word_kind())
    out = runs.withColumn("text", kept("text", "runs"))
    columns = dict(zip(docs.columns, unpacked(docs.columns)))
    if "n_chars" in columns:
        n = F.coalesce(F.char_length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(F.col("runs").isNull(), F.col("row")["n_chars"]).otherwise(n).alias("n_chars")
    return out.select(*columns.values())
