"""Suffix-array dedup: byte strings of 400 that start at two places or more, by two-stage suffix sorting.

A text is its UTF-8 bytes (null: empty). Every byte that is covered by a `width`-byte string which also
starts anywhere else (another text, or the same one) is removed, all copies alike; overlaps count, matches
never cross texts, and strings are judged on the input, not on what is left.

Texts are dealt to buckets by the minimisers of their strings (see superkmers), and the suffixes of a few
buckets are sorted together. Only the suffixes that are smaller than their successors are sorted directly;
the others follow from scans of the buckets of first bytes. Neighbours in the sorted order that share
`width` bytes or more are repeats.

Texts shorter than `width` keep all bytes. A cut may fall inside a character, so what is left is binary.
Repeated rows are copies of one another. Null ids are kept. Other columns are not read.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.llm.common import batch_of, released
from framewise.llm.superkmers import Bucket, Kind, Units, covered, with_runs

WIDTH = 400
GRAM = 32
_RNG = np.random.default_rng(400)
_MIX = _RNG.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: No UTF-8 text has this byte.
END = b"\xff"


class Bytes(Units):
    """A text as units of one byte each, without tables of places."""

    def __init__(self, packed: bytes):
        n = len(packed)
        super().__init__(packed, np.arange(n), np.arange(1, n + 1))

    def string(self, start: int, end: int) -> bytes:
        return self.packed[start:end]


def _words_at(raw: bytes) -> np.ndarray:
    """The 8 bytes from each place on as an integer."""
    return np.ndarray((max(0, len(raw) - 7),), dtype="<u8", buffer=raw, strides=(1,))


def byte_grams(u: Units, gram: int = GRAM) -> np.ndarray:
    """A hash of the `gram` bytes from each place on."""
    eight = _words_at(u.packed)
    n = len(u.packed) - gram + 1
    mixed = np.zeros(n, dtype=np.uint64)
    for k, at in enumerate([*range(0, gram - 8, 8), gram - 8]):
        mixed ^= eight[at : at + n]
        mixed *= _MIX[k]
        mixed ^= mixed >> np.uint64(29)
    return mixed


def by_string(raw: bytes, at: np.ndarray, depth: int) -> np.ndarray:
    """The places in the order of the `depth` bytes from each on.

    They are told apart by eight bytes at a time; only small groups that are still equal are compared as strings,
    so that few of these are held at once.
    """
    eight = np.ndarray((len(raw) + depth,), dtype=">u8", buffer=raw + bytes(depth + 8), strides=(1,))
    at, todo = at.copy(), [(0, len(at), 0)]
    while todo:
        low, high, skip = todo.pop()
        if high - low <= 64 or skip >= depth:
            at[low:high] = sorted(at[low:high].tolist(), key=lambda i: raw[i : i + depth])
            continue
        first = eight[at[low:high] + skip].astype(np.uint64)
        order = np.argsort(first, kind="stable")
        at[low:high], first = at[low:high][order], first[order]
        edges = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1], [True]]))
        many = np.flatnonzero(np.diff(edges) > 1)
        todo += [(low + a, low + b, skip + 8) for a, b in zip(edges[many].tolist(), edges[many + 1].tolist())]
    return at


def two_stage(raw: bytes, depth: int) -> np.ndarray:
    """The suffix array of raw; suffixes that share `depth` bytes or more stand in any order."""
    t = np.frombuffer(raw, dtype=np.uint8)
    n = len(t)
    if not n:
        return np.zeros(0, dtype=np.int64)
    # A suffix is smaller than its successor if the run of equal bytes it starts with ends before a larger one.
    ends = np.append(np.flatnonzero(t[1:] != t[:-1]), n - 1)
    rises = np.append(t[ends[:-1]] < t[ends[:-1] + 1], False)
    smaller = np.repeat(rises, np.diff(np.concatenate([[-1], ends])))
    direct = by_string(raw, np.flatnonzero(smaller), depth)
    tails = [direct[k] for k in np.split(np.arange(len(direct)), np.cumsum(np.bincount(t[direct], minlength=256))[:-1])]
    run_start = np.repeat(np.concatenate([[0], ends[:-1] + 1]), np.diff(np.concatenate([[-1], ends])))
    heads: list[list[np.ndarray]] = [[] for _ in range(256)]
    heads[t[-1]].append(np.array([n - 1]))

    def induce(batch: np.ndarray, c: int) -> None:
        before = batch[batch > 0] - 1
        before = before[~smaller[before] & (t[before] != c)]
        first = t[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        cut = np.flatnonzero(first[1:] != first[:-1]) + 1
        for part in np.split(before, cut) if len(before) else ():
            heads[t[part[0]]].append(part)

    for c in range(256):
        if heads[c]:
            # Each suffix brings the ones before it in its run of c: first all that are one byte longer, and so on.
            own = np.concatenate(heads[c])
            longer = own - run_start[own]
            back = np.arange(longer.sum()) - np.repeat(np.cumsum(longer) - longer, longer) + 1
            heads[c] = [own, (np.repeat(own, longer) - back)[np.argsort(back, kind="stable")]]
            induce(np.concatenate(heads[c]), c)
        if len(tails[c]):
            induce(tails[c], c)
    return np.concatenate([x for c in range(256) for x in (*heads[c], tails[c])])


def shared_prefix(raw: bytes, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """Whether the suffixes at a and b share `width` bytes; all have so many before the end of raw."""
    same = np.ones(len(a), dtype=bool)
    live = np.arange(len(a))
    if width < 8:
        t = np.frombuffer(raw, dtype=np.uint8)
        return np.all([t[a + k] == t[b + k] for k in range(width)], axis=0)
    eight = _words_at(raw)
    for k in [*range(0, width - 8, 8), width - 8]:
        equal = eight[a[live] + k] == eight[b[live] + k]
        same[live[~equal]] = False
        live = live[equal]
    return same


def suffix_repeats(width: int):
    """Marks of repeated windows, from the suffix array of the buckets' strings."""

    def repeats(buckets: list[Bucket]):
        strings = [(g, s, p) for g, bucket in enumerate(buckets) for s, p in enumerate(bucket.packed)]
        raw = END.join(p for _, _, p in strings)
        lengths = np.array([len(p) for _, _, p in strings])
        starts = np.concatenate([[0], np.cumsum(lengths[:-1] + 1)])
        window = np.zeros(len(raw), dtype=bool)
        for a, n in zip(starts.tolist(), lengths.tolist()):
            window[a : a + n - width + 1] = True
        order = two_stage(raw, width)
        order = order[window[order]]
        same = shared_prefix(raw, order[:-1], order[1:], width)
        marked = np.zeros(len(raw), dtype=bool)
        marked[order[:-1][same]] = True
        marked[order[1:][same]] = True
        for (g, s, _), a, n in zip(strings, starts.tolist(), lengths.tolist()):
            m = marked[a : a + n - width + 1]
            if buckets[g].n[s] == 1 and m.any():
                yield g, s, m

    return repeats


def byte_kind(width: int = WIDTH, gram: int = GRAM, **more) -> Kind:
    gram = max(8, min(gram, width))
    return Kind(width, gram, (max(1, width // 12), max(1, width // 100), 1), Bytes, lambda u: byte_grams(u, gram), suffix_repeats(width), **more)


RESULT = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())]
)


def dedup_bytes(docs: DataFrame, kind: Kind | None = None, texts: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]): one row per row of docs.

    n_spans counts the longest removed runs, `kept` has the other bytes.
    """
    kind = kind or byte_kind()
    schema = RESULT if texts else pa.schema(list(RESULT)[:-1])

    def remove(batches):
        for batch in batches:
            out, size = [], 0
            for doc_id, text, runs in zip(batch["doc_id"].to_pylist(), batch["text"], batch["runs"]):
                raw = released(text.as_buffer()) if text.is_valid else b""
                kept, spans = raw, 0
                if runs.is_valid:
                    gone = covered([(r["first"], r["end"]) for r in runs.as_py()], len(raw))
                    spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                    kept = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()
                row = (doc_id, len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest())
                out.append((*row, kept) if texts else row)
                size += len(kept)
                if size > 4_000_000:
                    yield batch_of(schema, dict(zip(schema.names, zip(*out))))
                    out, size = [], 0
            if out:
                yield batch_of(schema, dict(zip(schema.names, zip(*out))))

    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if texts else "")
    runs = with_runs(docs, kind)
    return runs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "runs").mapInArrow(remove, ddl)
