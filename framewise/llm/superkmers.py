"""Repeated windows of a fixed number of units, found through super-k-mers.

A text is a row of units (words or bytes) and a window is `width` consecutive units. Each window has a
minimiser: the gram of `gram` units with the smallest hash in it. Consecutive windows with the same minimiser
form a super-k-mer, and travel together as one packed string. Equal windows have the same minimiser, so they
always meet in its bucket.

Before strings travel, fixed-size rows (minimiser, fingerprint of the string, place) are counted:
* a minimiser that occurs once, in a string that has it in one place, has no repeated window: its string stays at home;
* equal strings become one with a weight, so copies of a text cost no more than one of them;
* a string of weight 2 or more has only repeated windows;
* the others' strings are packed, sent to the bucket and sorted there by `repeats`.
A bucket with more than `crowd` different strings is split: its windows are cut into shorter runs, on a grid around
the first place of the minimiser, whose key is the hash of the units that a whole run shares; at last into single
windows, which count as they are.
No step holds more than `crowd` strings of a bucket, and no row is dropped.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.llm.common import batch_of, begin, keyed, released, remove, squeezed, stored, whole_groups, whole_rows, with_keys

#: Strings of a bucket that one task sorts at most: with a few hundred bytes each, some seconds' work.
CROWD = 4096
#: Units of these strings at most: strings of many windows are long.
LOAD = 1 << 22
#: Windows of a super-k-mer at most.
SEGMENT = 1 << 16
ROWS = pa.schema(
    [("kid", pa.int64()), ("kth", pa.int64()), ("start", pa.int64()), ("windows", pa.int32()), ("ties", pa.int32()), ("mini", pa.int64()), ("fp", pa.int64())]
)
ROWS_DDL = "kid long, kth long, start long, windows int, ties int, mini long, fp long"
STRINGS = pa.schema([("mini", pa.int64()), ("fp", pa.int64()), ("n", pa.int64()), ("windows", pa.int32()), ("packed", pa.binary())])
STRINGS_DDL = "mini long, fp long, n long, windows int, packed binary"
PARTS = pa.schema([("root_mini", pa.int64()), ("root_fp", pa.int64()), ("shift", pa.int32()), *STRINGS])
PARTS_DDL = "root_mini long, root_fp long, shift int, " + STRINGS_DDL
FOUND = pa.schema([("mini", pa.int64()), ("fp", pa.int64()), ("first", pa.int32()), ("end", pa.int32())])
FOUND_DDL = "mini long, fp long, first int, end int"
#: Bytes of strings that are sorted in one go.
AT_ONCE = 1 << 18


@dataclass(frozen=True)
class Units:
    """One text: its packed bytes and, for each unit, where it starts and ends there."""

    packed: bytes
    starts: np.ndarray
    ends: np.ndarray

    def string(self, start: int, end: int) -> bytes:
        return self.packed[self.starts[start] : self.ends[end - 1]] if end > start else b""


@dataclass(frozen=True)
class Kind:
    """What a unit is: how to split a text, hash grams, and find repeats among strings of a bucket."""

    width: int
    gram: int
    runs: tuple[int, ...]
    units: Callable[[bytes], Units]
    grams: Callable[[Units], np.ndarray]
    repeats: Callable[[list["Bucket"]], Iterator[tuple[int, int, np.ndarray]]]
    crowd: int = CROWD


class Bucket(NamedTuple):
    """The different strings of one minimiser: texts, weights, numbers of windows, fingerprints."""

    packed: list[bytes]
    n: list[int]
    windows: list[int]
    fp: list[int]


def smallest(h: np.ndarray, w: int) -> np.ndarray:
    """For each w consecutive hashes, the place of the smallest one, the first of equals."""
    m = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)
    n, s = len(h) - w + 1, 1
    while 2 * s <= w:
        m = np.minimum(m[:-s], m[s:])
        s *= 2
    if s < w:
        m = np.minimum(m[:n], m[w - s : w - s + n])
    return (m & np.uint64((1 << 24) - 1)).astype(np.int64)


def super_kmers(hashes: np.ndarray, width: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Starts and ends (of window starts), minimisers and their numbers of places beyond one, of a text's super-k-mers."""
    n = len(hashes) + gram - width
    w = width - gram + 1
    for at in range(0, n, SEGMENT):
        stop = min(n, at + SEGMENT)
        places = smallest(hashes[at : stop + w - 1], w)
        mini = hashes[at:][places]
        starts = np.concatenate([[0], np.flatnonzero(mini[1:] != mini[:-1]) + 1])
        ends = np.append(starts[1:], len(mini))
        yield starts + at, ends + at, mini[starts], places[ends - 1] - places[starts]


def scan(docs: DataFrame, kind: Kind) -> DataFrame:
    """One fixed-size row for each super-k-mer of the texts."""

    def rows(batches):
        begin("super-k-mers")
        for batch in batches:
            held = {f.name: [] for f in ROWS}
            size = 0
            for kid, kth, text in zip(batch["kid"].to_pylist(), batch["kth"].to_pylist(), batch["text"]):
                u = kind.units(text.as_buffer().to_pybytes())
                if len(u.starts) < kind.width:
                    continue
                h = kind.grams(u)
                for starts, ends, mini, ties in super_kmers(h, kind.width, kind.gram):
                    a, b = u.starts[starts].tolist(), u.ends[ends + (kind.width - 2)].tolist()
                    p, fp = u.packed, xxhash.xxh3_64_intdigest
                    held["fp"].append(np.array([fp(p[x:y]) for x, y in zip(a, b)], dtype=np.uint64).view(np.int64))
                    held["kid"].append(np.full(len(starts), kid))
                    held["kth"].append(np.full(len(starts), kth))
                    held["start"].append(starts)
                    held["windows"].append(ends - starts)
                    held["ties"].append(ties)
                    held["mini"].append(mini.view(np.int64))
                    size += len(starts)
                if size > 100_000:
                    yield batch_of(ROWS, {k: np.concatenate(v) for k, v in held.items()})
                    held, size = {f.name: [] for f in ROWS}, 0
            if size:
                yield batch_of(ROWS, {k: np.concatenate(v) for k, v in held.items()})

    return docs.select("kid", "kth", "text").mapInArrow(rows, ROWS_DDL)


def pack(docs: DataFrame, wanted: DataFrame, kind: Kind) -> DataFrame:
    """The packed strings of wanted places (kid, kth, start, windows, ...), one row each."""
    lists = wanted.groupBy("kid", "kth").agg(F.collect_list(F.struct("start", "windows", "mini", "fp", "n")).alias("places"))

    def strings(batches):
        begin("strings")
        for batch in batches:
            out, size = [], 0
            for text, places in zip(batch["text"], batch["places"]):
                u = kind.units(released(text.as_buffer()))
                for p in places.as_py():
                    packed = u.string(p["start"], p["start"] + p["windows"] + kind.width - 1)
                    out.append((p["mini"], p["fp"], p["n"], p["windows"], packed))
                    size += len(packed)
                if size > 4_000_000:
                    yield batch_of(STRINGS, dict(zip(STRINGS.names, zip(*out))))
                    out, size = [], 0
            if out:
                yield batch_of(STRINGS, dict(zip(STRINGS.names, zip(*out))))

    texts = docs.select("kid", "kth", squeezed("text").alias("text"))
    return texts.join(lists, ["kid", "kth"]).select("text", "places").mapInArrow(strings, STRINGS_DDL)


def in_buckets(strings: DataFrame, kind: Kind) -> DataFrame:
    """Runs of repeated windows (first, end; counted in each string), from sorting each bucket."""

    def sort(held):
        out = []
        for g, s, marks in kind.repeats([h[1] for h in held]):
            step = np.diff(np.concatenate([[0], marks.view(np.int8), [0]]))
            runs = zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist())
            out += [(held[g][0], held[g][1].fp[s], x, y) for x, y in runs]
        return batch_of(FOUND, dict(zip(FOUND.names, zip(*out)))) if out else None

    def found(batches):
        begin("buckets")
        held, size = [], 0
        for chunk in whole_groups(batches, "mini"):
            mini = chunk["mini"].to_numpy()
            edge = np.concatenate([[0], np.flatnonzero(mini[1:] != mini[:-1]) + 1, [len(mini)]])
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                rows = chunk.slice(a, b - a)  # only a bucket's strings become Python's at once
                cols = [rows[c].to_pylist() for c in ("packed", "n", "windows", "fp")]
                one = {fp: k for k, fp in enumerate(cols[3])}  # repeated rows bring a string twice
                bucket = Bucket(*([c[k] for k in one.values()] for c in cols))
                held.append((int(mini[a]), bucket))
                size += sum(map(len, bucket.packed))
                if size > AT_ONCE:
                    if (out := sort(held)) is not None:
                        yield out
                    held, size = [], 0
        if held and (out := sort(held)) is not None:
            yield out

    return strings.repartition("mini").sortWithinPartitions("mini").mapInArrow(found, FOUND_DDL)


def shorter(strings: DataFrame, kind: Kind, run: int) -> DataFrame:
    """Each string's windows as runs of at most `run`, cut on a grid around the minimiser.

    The new key hashes the units that all windows of a whole run on the grid share. Each of these
    windows has all of them, so equal windows get the same key, whatever their string begins with.
    """

    def signed(values):
        return np.array(values, dtype=np.uint64).view(np.int64)

    def cut(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                u = kind.units(r["packed"])
                places = smallest(kind.grams(u), kind.width - kind.gram + 1).tolist()
                at = 0
                while at < r["windows"]:
                    base = at - (at - places[at]) % run
                    end = at + 1
                    while end < min(r["windows"], base + run) and places[end] == places[at]:
                        end += 1
                    shared = u.string(base + run - 1, base + kind.width)
                    key = xxhash.xxh3_64_intdigest(shared, seed=(base - places[at]) & 0xFFFFFFFF)
                    part = u.string(at, end + kind.width - 1)
                    out.append((r["root_mini"], r["root_fp"], r["shift"] + at, key, xxhash.xxh3_64_intdigest(part), r["n"], end - at, part))
                    at = end
            if out:
                cols = dict(zip(PARTS.names, zip(*out)))
                yield batch_of(PARTS, cols | {"mini": signed(cols["mini"]), "fp": signed(cols["fp"])})

    return strings.select(*PARTS.names).mapInArrow(cut, PARTS_DDL)


def kinds(rows: DataFrame, weight: Column, *keep: str) -> DataFrame:
    """One row per different string (mini, fp): its weight n, and `keep` of one of its rows.

    The struct makes Spark deal rows by both columns after combining them in each task.
    """
    who = F.struct("mini", "fp").alias("who")
    return rows.groupBy(who).agg(weight.alias("n"), *(F.first(c).alias(c) for c in keep)).select("who.mini", "who.fp", "n", *keep)


def shared_buckets(strings: DataFrame, kind: Kind) -> DataFrame:
    """(mini, crowded) of the buckets that may hold repeated windows beyond equal strings, stored, so that a hot bucket's rows can be split."""
    units = F.sum(F.col("windows") + F.lit(kind.width))
    buckets = strings.groupBy("mini").agg(F.count("*").alias("kinds"), F.max("ties").alias("within"), units.alias("units"))
    crowded = (F.col("kinds") > kind.crowd) | ((F.col("kinds") > 1) & (F.col("units") > LOAD))
    return stored(buckets.where("kinds > 1 OR within > 0").select("mini", crowded.alias("crowded")))


def repeated_runs(docs: DataFrame, kind: Kind) -> DataFrame:
    """(kid, kth, first, end): runs of units covered by repeated windows, some of them overlapping."""
    scanned = stored(scan(docs, kind))
    twice = scanned.groupBy("mini").agg(F.count("*").alias("n"), F.max("ties").alias("ties"))
    twice = stored(twice.where("n > 1 OR ties > 0").select("mini"))
    rows = stored(scanned.join(twice, "mini"))
    remove(scanned, twice)
    strings = stored(kinds(rows, F.count("*"), "kid", "kth", "start", "windows", "ties"))
    whole = strings.where("n > 1").select("mini", "fp", F.lit(0).alias("first"), F.col("windows").alias("end"))
    minis = shared_buckets(strings, kind)
    buckets = stored(strings.join(minis, "mini"))
    remove(minis)
    used = [strings, buckets]
    found = whole.unionByName(in_buckets(pack(docs, buckets.where("NOT crowded"), kind), kind))
    crowded = buckets.where("crowded")
    if not crowded.isEmpty():
        packed = pack(docs, crowded, kind).dropDuplicates(["mini", "fp"])
        parts = packed.withColumns({"root_mini": F.col("mini"), "root_fp": F.col("fp"), "shift": F.lit(0)})
        for run in kind.runs:
            parts = stored(shorter(parts, kind, run))
            different = stored(kinds(parts, F.sum("n"), "windows", "packed").withColumn("ties", F.lit(0)))
            minis = shared_buckets(different, kind)
            used += [parts, different, minis]
            hits = different.where("n > 1").select("mini", "fp", F.lit(0).alias("first"), F.col("windows").alias("end"))
            buckets = different.join(minis, "mini")
            last = run == kind.runs[-1]
            if run > 1:  # different strings of one window each have none in common
                few = buckets if last else buckets.where("NOT crowded")
                hits = hits.unionByName(in_buckets(few.select(*STRINGS.names), kind))
            places = parts.select("root_mini", "root_fp", "shift", "mini", "fp")
            first, end = (F.col(c) + F.col("shift") for c in ("first", "end"))
            hits = hits.join(places, ["mini", "fp"])
            found = found.unionByName(hits.select(F.col("root_mini").alias("mini"), F.col("root_fp").alias("fp"), first.alias("first"), end.alias("end")))
            if last:
                break
            many = stored(buckets.where("crowded").select("mini").distinct())
            used.append(many)
            parts = parts.join(many, "mini")
            if parts.isEmpty():
                break
    found = stored(found)
    remove(*used)
    last_end = F.col("start") + F.col("end") + F.lit(kind.width - 1)
    return rows.join(found, ["mini", "fp"]).select("kid", "kth", (F.col("start") + F.col("first")).alias("first"), last_end.alias("end"))


def covered(runs: list, n: int) -> np.ndarray:
    """Which of n units the runs cover."""
    step = np.zeros(n + 1, dtype=np.int64)
    for first, end in runs:
        step[first] += 1
        step[end] -= 1
    return np.cumsum(step[:-1]) > 0


def with_runs(docs: DataFrame, kind: Kind) -> DataFrame:
    """whole_rows of docs with `runs`, the runs of units to remove, null where there are none; text is squeezed."""
    runs = repeated_runs(keyed(docs), kind).groupBy(F.col("kid").alias("__kid"), F.col("kth").alias("__kth"))
    runs = runs.agg(F.collect_set(F.struct("first", "end")).alias("runs"))
    rows = with_keys(whole_rows(docs))
    rows = rows.withColumn("text", squeezed(rows["text"].cast("string")))
    return rows.join(runs, ["__kid", "__kth"], "left").drop("__kid", "__kth")
