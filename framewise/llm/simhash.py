"""SimHash near-dedup: an inverted index on byte positions with count filtering.

A text's words are `[^\\x20\\x09-\\x0D]+` of its UTF-8 bytes with A-Z in lower case. Its shingles are three words
in a row, repeats included, joined by a space; a text of one or two words is one shingle, a text without
words has fingerprint zero. Bit k of the fingerprint is 1 if it is set in over half of the shingles' XXH64
(seed 42). Fingerprints with at most `bits` (2) differing bits link.

Two such fingerprints share at least 6 of their 8 positional bytes. They therefore share all four bytes of
one of six position sets (the sets of four that are left when two of the pairs 01, 23, 45, 67 go), and meet
in the posting of these bytes. In a posting, shared positional bytes are tallied for each pair; pairs with
six or more are verified bit by bit, and what leaves the task is one link per member to the smallest
member of its linked part. Postings with more than `crowd` fingerprints are replaced by the 28 sets of six
positions, whose postings have at most 65,536 different fingerprints.

Equal fingerprints are one row of the index. Null texts are empty texts, and link like these. Null ids are
kept; a component's id is null only if all its ids are. Repeated rows are copies. Other columns aren't read.
"""

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.llm.common import batch_of, components, keyed, roots, stored, unpacked, whole_groups, whole_rows, with_keys

SEED = 42
BITS = 2
SHARED = 8 - BITS
CROWD = 2048
NO_ID = 2**63 - 1
PRINTS = pa.schema([("kid", pa.int64()), ("kth", pa.int64()), ("doc_id", pa.int64()), ("fp", pa.int64())])
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingles(text: bytes, k: int = 3) -> tuple[bytes, list[int], list[int]]:
    """The words joined by a space, and where each shingle starts and ends there."""
    words = text.lower().split()
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(words) else ends
    packed = b" ".join(words)
    if 0 < len(words) < k:
        return packed, [0], [len(packed)]
    return packed, starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()


def fingerprint(text: bytes) -> int:
    packed, starts, ends = shingles(text)
    total, n = np.zeros(64, dtype=np.int64), len(starts)
    if not n:
        return 0
    of = xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 15):
        h = np.array([of(packed[a:b], SEED) for a, b in zip(starts[at : at + (1 << 15)], ends[at : at + (1 << 15)])], dtype="<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(kid, kth, doc_id, fp): the fingerprint of every row of docs as a long."""

    def prints(batches):
        for batch in batches:
            fp = np.array([fingerprint(t.as_buffer().to_pybytes()) for t in batch["text"]], dtype=np.uint64).view(np.int64)
            yield batch_of(PRINTS, {"fp": fp} | {c: batch[c] for c in ("kid", "kth", "doc_id")})

    return keyed(docs).mapInArrow(prints, "kid long, kth long, doc_id long, fp long")


def _postings(sets: list[tuple[int, ...]]) -> Column:
    """For each position set, its number and the bytes at its positions, as one long."""

    def key(k, positions):
        out = F.lit(k).cast("long")
        for p in positions:
            byte = F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255).cast("long"))
            out = F.shiftleft(out, 8).bitwiseOR(byte)
        return out

    return F.explode(F.array(*(key(k, s) for k, s in enumerate(sets)))).alias("key")


FOURS = [tuple(2 * k + e for k in kept for e in (0, 1)) for kept in combinations(range(4), 2)]
SIXES = list(combinations(range(8), 6))


def close_pairs(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of linked fingerprints with equal keys, in rows sorted by key."""
    cut = np.flatnonzero(key[1:] != key[:-1]) + 1
    ends = np.concatenate([cut, [len(key)]])
    end = np.repeat(ends, np.diff(np.concatenate([[0], ends])))
    i, found, shift = np.arange(len(key)), [], 1
    while len(i := i[i + shift < end[i]]):
        x = fp[i] ^ fp[i + shift]
        tally = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
        near = (tally >= SHARED) & (np.bitwise_count(x.view(np.uint64)) <= BITS)
        found.append((i[near], i[near] + shift))
        shift += 1
    if not found:
        return i, i
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _linked(postings: DataFrame) -> DataFrame:
    """(a, b): each member of a posting with the smallest id of its linked part."""

    def run(batches):
        for chunk in whole_groups(batches, "key"):
            node, fp = chunk["node"].to_numpy(), chunk["fp"].to_numpy()
            i, j = close_pairs(chunk["key"].to_numpy(), fp)
            if len(i):
                used, places = np.unique(np.concatenate([i, j]), return_inverse=True)
                low = roots(places[: len(i)], places[len(i) :], len(used))
                hung = low != np.arange(len(used))
                yield batch_of(LINKS, {"a": node[used[hung]], "b": node[used[low[hung]]]})

    return postings.repartition("key").sortWithinPartitions("key", "node").select("key", "node", "fp").mapInArrow(run, "a long, b long")


def links(nodes: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, b): links that join all nodes (node, fp) whose fingerprints reach each other."""
    postings = nodes.select("node", "fp", _postings(FOURS))
    sizes = postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    postings = stored(postings.join(sizes, "key"))
    found = _linked(postings.where(F.col("n") <= crowd))
    hot = postings.where(F.col("n") > crowd)
    if not hot.isEmpty():
        fine = hot.select("node", "fp").distinct().select("node", "fp", _postings(SIXES))
        sizes = fine.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        found = found.unionByName(_linked(fine.join(sizes, "key")))
    return found


def near_duplicates(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(kid, kth, doc_id, fp, component_id, root): one row per row of docs; root is a number of the component."""
    prints = stored(fingerprints(docs))
    nodes = stored(prints.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("first")).withColumn("node", F.monotonically_increasing_id()))
    members = components(links(nodes, crowd), "a", "b")
    placed = nodes.join(members, "node", "left").select("fp", "first", F.coalesce("root", "node").alias("root"))
    lowest = placed.groupBy("root").agg(F.min("first").alias("low"))
    component = F.when(F.col("low") != NO_ID, F.col("low")).alias("component_id")
    return prints.join(placed.join(lowest, "root").select("fp", component, "root"), "fp").select("kid", "kth", "doc_id", "fp", "component_id", "root")


def smallest_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with one row of each component in found (kid, kth, doc_id, root); see one_of_each."""
    order = F.struct(F.coalesce("doc_id", F.lit(NO_ID)), "kth", "kid")
    kept = found.groupBy("root").agg(F.min(order).alias("k"))
    kept = kept.select(F.col("k.kid").alias("__kid"), F.col("k.kth").alias("__kth"))
    rows = with_keys(whole_rows(docs)).join(kept, ["__kid", "__kth"]).dropDuplicates(["__kid", "__kth"])
    return rows.select(*unpacked(docs.columns))


def one_of_each(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """docs with one row of each component: that with the smallest id (null ids last, ties by text)."""
    return smallest_of_each(docs, near_duplicates(docs, crowd))
