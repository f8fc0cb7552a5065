"""Benchmark decontamination: a positional inverted index of the documents, asked for phrases and proximity matches.

`index` cuts the documents into shards of a bounded number of words and stores, for every shard and term, the term's
ascending positions there. Documents lie `REACH` empty places apart, so no match crosses two of them. Longer ones are cut into
parts, each with `REACH` words of its neighbours, so every match that touches a part's own words lies in that part's shard.

The benchmark is asked in blocks of a bounded number of words: only the postings of a block's terms travel, to their
shard. There each window starts from the positions of its rarest term (counted over all documents), shifted by the term's
place in the window, and is intersected with the shifted positions of the next rarest, until none or all terms are done.

Words are runs of ASCII digits and letters (A-Z lower-cased) and of all characters beyond ASCII. A window is `width` consecutive
words of an item; an item of fewer words, but not none, is one window. Null and empty texts have no words: such documents have
zeros, such items have no window. Every row is a document of its own, also where ids or texts repeat; rows of one item id are one
item. A null item id is an item with an empty name. Other columns aren't read, so their names can't clash.
"""

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.llm.common import stored, text_of, whole_groups

WIDTH = 10
SHARD = 262_144
PART = 65_536
REACH = 32
BLOCK = 200_000
CANDIDATES = 1 << 20

#: The bytes of words, upper case as lower case; all others are spaces.
_AS_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_DOC_FIELDS = {"spot": pa.int64(), "doc_id": pa.int64(), "base": pa.int32(), "size": pa.int32(), "at": pa.int32(), "first": pa.int64(), "n": pa.int32()}
_DOC = pa.struct(list(_DOC_FIELDS.items()))
_INDEX = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("n", pa.int32()), ("positions", pa.list_(pa.int32())), ("docs", pa.list_(_DOC))])
_INDEX_DDL = "shard long, term string, n int, positions array<int>, docs array<struct<spot:long,doc_id:long,base:int,size:int,at:int,first:long,n:int>>"


def words(text: str, step: int = 1 << 19) -> Iterator[list[bytes]]:
    """The words of a text in lists of bounded size."""
    data = text.encode().translate(_AS_WORDS)
    at = 0
    while len(data) - at > step:
        end = data.find(b" ", at + step)
        if end < 0:
            break
        yield data[at:end].split()
        at = end
    yield data[at:].split()


def parts(text: str, size: int, reach: int) -> Iterator[tuple[int, int, int, list[bytes]]]:
    """(first own word, own words, words before them, words) of each part; a text has at least one."""
    first, before, held = 0, [], []
    for found in words(text):
        held += found
        while len(held) > size + reach:
            yield first, size, len(before), before + held[: size + reach]
            before, held, first = (before + held[:size])[-reach:], held[size:], first + size
    while len(held) > size:
        yield first, size, len(before), before + held[: size + reach]
        before, held, first = (before + held[:size])[-reach:], held[size:], first + size
    yield first, len(held), len(before), before + held


def _shard(no: int, units: list[bytes], positions: np.ndarray, docs: list[tuple]) -> pa.RecordBatch:
    """One row per term, ascending positions; and one row without a term, with the shard's documents."""
    terms = list(dict.fromkeys(units))
    number = dict(zip(terms, range(len(terms))))
    ids = np.fromiter(map(number.__getitem__, units), np.int32, len(units))
    ends = np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=len(terms)))]).astype(np.int32)
    flat = positions[np.argsort(ids, kind="stable")].astype(np.int32)
    none = pa.nulls(1, pa.list_(pa.int32()))
    lists = pa.concat_arrays([none, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))])
    names = pa.concat_arrays([pa.nulls(1, pa.string()), pa.array(terms, pa.binary()).cast(pa.string())])
    own = pa.array([[dict(zip(_DOC_FIELDS, d)) for d in docs]] + [None] * len(terms), pa.list_(_DOC))
    counts = pa.array(np.concatenate([[0], np.diff(ends)]), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(terms) + 1, no)), names, counts, lists, own], schema=_INDEX)


def index(docs: DataFrame, shard: int = SHARD, part: int = PART, reach: int = REACH) -> DataFrame:
    """The stored index: (shard, term, n, positions), and rows with a null term and the shard's documents in `docs`.

    A document's part is (spot, doc_id, base, size, at, first, n): a number of its row, its id, the position of its first word,
    its words, the position of its first own word, that word's number in the whole text, and its own words. Texts are
    read once and don't travel.
    """

    def run(batches):
        no = TaskContext.get().partitionId() << 33
        units, places, own, end = [], [], [], 0
        for batch in batches:
            for spot, doc_id, text in zip(*(batch[c].to_pylist() for c in ("spot", "doc_id", "text"))):
                for first, n, lead, found in parts(text, part, reach):
                    own.append((spot, doc_id, end, len(found), end + lead, first, n))
                    places.append((len(units), end))
                    units += found
                    end += len(found) + reach
                    if end >= shard:
                        yield _shard(no, units, _positions(places, len(units)), own)
                        units, places, own, end, no = [], [], [], 0, no + 1
        if own:
            yield _shard(no, units, _positions(places, len(units)), own)

    rows = docs.select(F.monotonically_increasing_id().alias("spot"), docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return stored(rows.mapInArrow(run, _INDEX_DDL))


def _positions(places: list[tuple[int, int]], n: int) -> np.ndarray:
    """The position of each word, from (words before, position) of each part."""
    before, at = np.array(places, dtype=np.int64).reshape(-1, 2).T
    return np.arange(n) + np.repeat(at - before, np.diff(np.append(before, n)))


@dataclass
class Block:
    """Distinct windows of some items: their terms, rarest first, with places in the window, and who holds them."""

    items: list[str]
    terms: list[str]
    ids: np.ndarray  # windows x width, -1 after a short one's last
    places: np.ndarray
    sizes: np.ndarray
    owners: np.ndarray
    owner_ends: np.ndarray

    @classmethod
    def of(cls, rows: Iterable[tuple[str, list[str]]], width: int) -> "Block":
        number, named, windows, held = {}, {}, [np.empty((0, width), np.int32)], [np.empty(0, np.int64)]
        for item, found in rows:
            ids = np.array([number.setdefault(w, len(number)) for w in found], np.int32)
            own = np.lib.stride_tricks.sliding_window_view(ids, min(len(ids), width))
            windows.append(np.pad(own, ((0, 0), (0, width - own.shape[1])), constant_values=-1))
            held.append(np.full(len(own), named.setdefault(item, len(named))))
        ids, which = np.unique(np.concatenate(windows), axis=0, return_inverse=True)
        pairs = np.unique(np.stack([which.ravel(), np.concatenate(held)], axis=1), axis=0).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(np.bincount(pairs[:, 0], minlength=len(ids)))])
        places = np.tile(np.arange(width), (len(ids), 1))
        return cls(list(named), list(number), ids, places, (ids >= 0).sum(axis=1), pairs[:, 1], ends)

    def rarest_first(self, counts: np.ndarray) -> "Block":
        """Without windows that hold a term of no document; terms in the order of their counts."""
        weight = np.append(counts, np.iinfo(np.int64).max)[self.ids]
        here = np.flatnonzero((weight > 0).all(axis=1))
        order = np.argsort(weight[here], axis=1, kind="stable")
        held = [self.owners[self.owner_ends[w] : self.owner_ends[w + 1]] for w in here]
        ends = np.concatenate([[0], np.cumsum([len(h) for h in held])]).astype(np.int64)
        owners = np.concatenate([np.empty(0, np.int64), *held])
        return Block(self.items, self.terms, np.take_along_axis(self.ids[here], order, 1), order, self.sizes[here], owners, ends)

    def held_by(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each item of each of the windows w: the window's place in w, the item."""
        n = self.owner_ends[w + 1] - self.owner_ends[w]
        k = np.repeat(np.arange(len(w)), n)
        return k, self.owners[self.owner_ends[w][k] + np.arange(n.sum()) - (np.cumsum(n) - n)[k]]


class Postings:
    """The asked terms of one shard."""

    def __init__(self, terms: np.ndarray, lists: pa.ChunkedArray, n_terms: int):
        order = np.argsort(terms, kind="stable")
        lists = lists.take(pa.array(order)).combine_chunks()
        self.flat = lists.flatten().to_numpy().astype(np.int64)
        self.count, self.start = np.zeros(n_terms + 1, np.int64), np.zeros(n_terms + 1, np.int64)
        sizes = lists.value_lengths().to_numpy()
        self.count[terms[order]], self.start[terms[order]] = sizes, np.cumsum(sizes) - sizes
        self.keys = np.repeat(terms[order].astype(np.int64), sizes) << 32 | self.flat

    def has(self, terms: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """Whether each term is at its position."""
        wanted = terms.astype(np.int64) << 32 | positions
        near = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return (positions >= 0) & (self.keys[near] == wanted)

    def rarest(self, block: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, position of its rarest term), for windows whose terms are all in the shard; in slices of bounded size."""
        if not len(self.flat):
            return
        here = np.flatnonzero(((self.count[block.ids] > 0) | (block.ids < 0)).all(axis=1))
        first = block.ids[here, 0]
        ends = np.cumsum(self.count[first])
        total = int(ends[-1]) if len(ends) else 0
        for low in range(0, total, CANDIDATES):
            spots = np.arange(low, min(low + CANDIDATES, total))
            w = np.searchsorted(ends, spots, side="right")
            yield here[w], self.flat[self.start[first[w]] + spots - (ends[w] - self.count[first[w]])]


def phrases(block: Block, post: Postings) -> Iterator[tuple[np.ndarray, ...]]:
    """(window, place of its rarest term, start, end) wherever a window's words follow each other."""
    for w, at in post.rarest(block):
        start = at - block.places[w, 0]
        w, start = w[start >= 0], start[start >= 0]
        for k in range(1, block.ids.shape[1]):
            done = block.sizes[w] <= k
            ok = done | post.has(np.where(done, 0, block.ids[w, k]), start + block.places[w, k])
            w, start = w[ok], start[ok]
        yield w, start + block.places[w, 0], start, start + block.sizes[w]


def near(block: Block, post: Postings, span: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(window, place of its rarest term, start, end) wherever all its words are, in any order, within `span` words.

    Of several stretches of `span` words around one place, the first one is given.
    """
    for whole_w, whole_at in post.rarest(block):
        for low in range(0, len(whole_w), 1 << 14):
            w, at = whole_w[low : low + (1 << 14)], whole_at[low : low + (1 << 14)]
            # Stretch s of a row starts span - 1 - s places before the rarest term.
            fits = np.ones((len(w), span), bool)
            for k in range(1, block.ids.shape[1]):
                alive = np.flatnonzero(fits.any(axis=1) & (block.sizes[w] > k))
                if not len(alive):
                    break
                shift = np.arange(1 - span, span)
                there = post.has(np.repeat(block.ids[w[alive], k], len(shift)), (at[alive, None] + shift).ravel()).reshape(len(alive), -1)
                seen = np.cumsum(np.pad(there, ((0, 0), (1, 0))), axis=1)
                fits[alive] &= seen[:, span:] > seen[:, : len(shift) + 1 - span]
            ok = np.flatnonzero(fits.any(axis=1))
            start = at[ok] - (span - 1) + fits[ok].argmax(axis=1)
            yield w[ok], at[ok], start, start + span


def _asked(stored_index: DataFrame, items: DataFrame, width: int, block: int):
    """For each block of the benchmark: the block, and its rows of the index by shard (term -1: the documents)."""
    schema = pa.schema([("item", pa.string()), ("words", pa.list_(pa.string()))])

    def cut(batches):
        for batch in batches:
            out = []
            for item, text in zip(batch["item"].to_pylist(), batch["text"].to_pylist()):
                for _, n, lead, found in parts(text, 4096, width - 1):
                    if n and (not lead or n >= width):  # a shorter rest lies in the windows before it
                        out.append((item, [w.decode() for w in found[lead:]]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else ([], []), schema)], schema=schema)

    texts = items.select(F.coalesce(items["item_id"].cast("string"), F.lit("")).alias("item"), text_of(items).alias("text"))
    spark = items.sparkSession
    pieces = stored(texts.mapInArrow(cut, "item string, words array<string>"))
    total = pieces.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = -(-total // block)
    dealt = F.pmod(F.xxhash64("item", "words"), F.lit(max(blocks, 1)))
    for b in range(blocks):
        mine = Block.of(((r.item, r.words) for r in pieces.where(dealt == b).distinct().collect()), width)
        if not mine.terms:
            continue
        # At most as many terms as a block has words.
        terms = pa.table({"term": mine.terms, "no": pa.array(range(len(mine.terms)), pa.int32())})
        found = stored_index.join(F.broadcast(spark.createDataFrame(terms)), "term")
        counts = np.zeros(len(mine.terms), np.int64)
        for r in found.groupBy("no").agg(F.sum("n").alias("n")).collect():
            counts[r.no] = r.n
        rows = found.select("shard", "no", "positions", F.lit(None).cast(stored_index.schema["docs"].dataType).alias("docs"))
        own = stored_index.where("term IS NULL").select("shard", F.lit(-1).alias("no"), "positions", "docs")
        yield mine.rarest_first(counts), rows.unionByName(own).repartition("shard").sortWithinPartitions("shard")


def _shards(batches, n_terms: int) -> Iterator[tuple[Postings, list[dict]]]:
    for whole in whole_groups(batches, "shard"):
        shard = whole["shard"].to_numpy()
        edges = np.flatnonzero(np.diff(shard)) + 1
        for low, high in zip([0, *edges.tolist()], [*edges.tolist(), len(shard)]):
            rows = whole.slice(low, high - low)
            no = rows["no"].to_numpy()
            own = [d for docs in rows["docs"].filter(pa.array(no < 0)).to_pylist() for d in docs or ()]
            yield Postings(no[no >= 0], rows["positions"].filter(pa.array(no >= 0)), n_terms), own


def matches(stored_index: DataFrame, items: DataFrame, width: int = WIDTH, span: int | None = None, block: int = BLOCK) -> DataFrame:
    """(spot, doc_id, word, n, item_id string): the documents' words word .. word + n - 1 match a window of the item.

    Without `span` as a phrase; else all the window's words are, in any order, within `span` words (as `near`). Matches of
    several windows of an item at one place are one row.
    """
    if max(width, span or 0) > REACH:
        raise ValueError(f"a match may be at most {REACH} words long")
    schema = pa.schema([("spot", pa.int64()), ("doc_id", pa.int64()), ("word", pa.int64()), ("n", pa.int32()), ("item_id", pa.string())])
    ddl = "spot long, doc_id long, word long, n int, item_id string"
    out = []
    for mine, rows in _asked(stored_index, items, width, block):

        def run(batches, mine=mine):
            for post, docs in _shards(batches, len(mine.terms)):
                part = {name: np.array([d[name] for d in docs]) for name in _DOC_FIELDS if name != "doc_id"}
                for w, at, start, end in phrases(mine, post) if span is None else near(mine, post, span):
                    p = np.searchsorted(part["base"], at, side="right") - 1
                    own = (at >= part["at"][p]) & (at < part["at"][p] + part["n"][p])  # not also in a neighbouring part
                    w, start, end, p = w[own], start[own], end[own], p[own]
                    start, end = np.maximum(start, part["base"][p]), np.minimum(end, part["base"][p] + part["size"][p])
                    k, owner = mine.held_by(w)
                    found = np.stack([p, part["first"][p] + start - part["at"][p], end - start], axis=1)[k]
                    found = np.unique(np.column_stack([found, owner]), axis=0)
                    cols = [[docs[q]["spot"] for q in found[:, 0]], [docs[q]["doc_id"] for q in found[:, 0]], found[:, 1], found[:, 2]]
                    cols.append([mine.items[o] for o in found[:, 3]])
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

        out.append(rows.mapInArrow(run, ddl))
    if not out:
        return items.sparkSession.createDataFrame([], ddl)
    # Windows of an item may match at one place, and lie in several blocks.
    return reduce(DataFrame.unionByName, out).distinct()


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated): words inside any occurrence of an item's window."""
    if width > REACH:
        raise ValueError(f"a window may be at most {REACH} words long")
    held = index(docs)
    run_type = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
    schema = pa.schema([("spot", pa.int64()), ("runs", run_type), ("items", pa.list_(pa.string()))])
    ddl = "spot long, runs array<struct<low:long,high:long>>, items array<string>"
    out = []
    for mine, rows in _asked(held, items, width, block):

        def run(batches, mine=mine):
            for post, own in _shards(batches, len(mine.terms)):
                yield from _hits(mine, post, own, schema)

        out.append(rows.mapInArrow(run, ddl))
    spots = held.where("term IS NULL").select(F.inline("docs")).groupBy("spot").agg(F.first("doc_id").alias("doc_id"), F.sum("n").cast("long").alias("n_words"))
    if not out:
        hits = docs.sparkSession.createDataFrame([], "spot long, n_hit long, items array<string>")
    else:
        both = reduce(DataFrame.unionByName, out).groupBy("spot").agg(
            F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")
        )
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("until"))
        covered = F.aggregate("runs", zero, _cover, lambda c: c["n"])
        hits = both.select("spot", covered.alias("n_hit"), "items")
    none = F.array().cast("array<string>")
    full = spots.join(hits, "spot", "left").withColumn("items", F.coalesce("items", none)).withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long")))
    return full.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def _cover(c, r):
    return F.struct(
        (c["n"] + F.greatest(F.lit(0).cast("long"), r["high"] - F.greatest(c["until"], r["low"]))).alias("n"),
        F.greatest(c["until"], r["high"]).alias("until"),
    )


def _hits(block: Block, post: Postings, docs: list[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """For each part with a hit, the runs of hit own words, and the items with a window there."""
    base = np.array([d["base"] for d in docs])
    edges = np.zeros(int(base[-1]) + docs[-1]["size"] + 1, np.int32)
    held = [np.empty((0, 2), np.int64)]
    for w, _, start, end in phrases(block, post):
        np.add.at(edges, start, 1)
        np.add.at(edges, end, -1)
        k, owner = block.held_by(w)
        held.append(np.unique(np.stack([np.searchsorted(base, start, side="right")[k] - 1, owner], axis=1), axis=0))
    pairs = np.unique(np.concatenate(held), axis=0)
    if not len(pairs):
        return
    covered = np.concatenate([[False], np.cumsum(edges) > 0, [False]])
    low, high = np.flatnonzero(covered[1:] & ~covered[:-1]), np.flatnonzero(~covered[1:] & covered[:-1])
    spots, runs, names = [], [], []
    for p in np.unique(pairs[:, 0]).tolist():
        d = docs[p]
        a, z = np.searchsorted(high, d["at"], side="right"), np.searchsorted(low, d["at"] + d["n"])
        cut = zip(np.maximum(low[a:z], d["at"]).tolist(), np.minimum(high[a:z], d["at"] + d["n"]).tolist())
        spots.append(d["spot"])
        runs.append([{"low": s - d["at"] + d["first"], "high": e - d["at"] + d["first"]} for s, e in cut])
        names.append([block.items[o] for o in pairs[pairs[:, 0] == p, 1].tolist()])
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((spots, runs, names), schema)], schema=schema)
