"""Cross-tokenizer alignment: groups of tokens between the byte offsets where both tokenizers end a token.

A text's alignment is a product of fragments. A fragment of any byte range has an open prefix (its tokens up to the first
shared end), closed groups, and an open suffix (its tokens after the last shared end); the product closes what is open
between two of them, is associative, and has the empty fragment as its unit. So texts longer than `CHUNK` characters are
cut, the chunks dealt over tasks, and their fragments multiplied in a tree. Chunks are cut at a single space between other
characters, where both tokenizers start a token whatever stands around; a text without such a space stays whole.

Between such spaces (and single line ends) a text is a row of units, whose tokens don't depend on their neighbours. What a unit
gives is kept from text to text in a table of bounded bytes.

An id pair's count is in how many documents it is linked. The documents' distinct pairs are counted after partial sums; the
65,536 most frequent pairs, a table of fixed size, go to all tasks, and the pairs beyond join by shuffle.

Each row is a document of its own, also where ids or texts repeat. Null and empty texts have no tokens, nor have those for which
the bytes of either tokenizer's tokens differ from space and text. Other columns aren't read, so their names can't clash.
"""

import gc
import hashlib
import os
import re
from collections import Counter
from collections.abc import Collection, Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.llm.bpe import byte_letters
from framewise.llm.common import batch_of, stored, text_of, whole_groups
from framewise.llm.packing import PATTERN

CHUNK = 65_536
FAN_IN = 8
HEAVY = 65_536
SLICE_CHARS = 1 << 22
KEPT_BYTES = 48 << 20
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Texts that may not be cut at every space and line end.
_RARE_SPACE = re.compile(r"[^\S \n]")
_SIGNS = ("  ", "\n\n", " \n", "\n ")


def _links(a: list[int], b: list[int]) -> Counter:
    """How often each pair x << 32 | y of a group's tokens is linked."""
    if len(a) == len(b) == 1:
        return {a[0] << 32 | b[0]: 1}
    of_b = Counter(b)
    return {x << 32 | y: n * m for x, n in Counter(a).items() for y, m in of_b.items()}


def _written(a: list[int], b: list[int]) -> bytes:
    return (",".join(map(str, a)) + "|" + ",".join(map(str, b))).encode()


@dataclass
class Fragment:
    """Tokens of a byte range. Without a shared end, all are in the prefix."""

    cut: bool = False
    prefix: tuple[list[int], list[int]] = field(default_factory=lambda: ([], []))
    closed: bytes = b""
    n: tuple[int, int, int, int] = (0, 0, 0, 0)  # tokens of A, of B, groups, links that are closed
    pairs: dict[int, int] = field(default_factory=dict)
    suffix: tuple[list[int], list[int]] = field(default_factory=lambda: ([], []))

    @classmethod
    def of(cls, a: list[int], a_ends: list[int], b: list[int], b_ends: list[int]) -> "Fragment":
        """The fragment of tokens that end at the given offsets; a token belongs to the range in which it ends."""
        out, i, j = cls(), 0, 0
        where_b = {end: k + 1 for k, end in enumerate(b_ends)}
        for k, end in enumerate(a_ends):
            if end in where_b:
                group = a[i : k + 1], b[j : where_b[end]]
                i, j = k + 1, where_b[end]
                out = out * cls(True, group)
        return out * cls(False, (a[i:], b[j:]))

    def __mul__(self, other: "Fragment") -> "Fragment":
        def both(x, y):
            return x[0] + y[0], x[1] + y[1]

        if not self.cut:
            return Fragment(other.cut, both(self.prefix, other.prefix), other.closed, other.n, other.pairs, other.suffix)
        if not other.cut:
            return Fragment(True, self.prefix, self.closed, self.n, self.pairs, both(self.suffix, other.prefix))
        middle = both(self.suffix, other.prefix)
        more = _links(*middle)
        closed = b";".join(s for s in (self.closed, _written(*middle), other.closed) if s)
        own = (len(middle[0]), len(middle[1]), 1, sum(more.values()))
        pairs = _sum(_sum(self.pairs, more), other.pairs)
        return Fragment(True, self.prefix, closed, tuple(map(sum, zip(self.n, own, other.n))), pairs, other.suffix)

    def whole(self) -> "Fragment":
        """All groups closed, for a text's whole range: its start is a shared end, and so is its last end."""
        return Fragment(True) * self


def _sum(x: dict[int, int], y: dict[int, int]) -> dict[int, int]:
    if len(x) < len(y):
        x, y = y, x
    out = dict(x)
    for k, n in y.items():
        out[k] = out.get(k, 0) + n
    return out


class Kept(dict):
    """A table of what units give, whose entries go when two generations of `limit` bytes each have come after them."""

    def __init__(self, limit: int = KEPT_BYTES):
        super().__init__()
        self.limit, self.size, self.old = limit, 0, {}

    def find(self, key: str) -> tuple | None:
        """What a key gives, an empty tuple where it isn't known."""
        value = self.get(key, ())
        if value == ():
            value = self.old.get(key, ())
            if value != ():
                self.keep(key, value)
        return value

    def keep(self, key: str, value: tuple | None) -> None:
        self[key] = value
        self.size += 300 + len(key) + (len(value[4]) + len(value[5]) if value else 0)
        if self.size > self.limit:
            self.old = dict(self)
            self.clear()
            self.size = 0


class Aligner:
    """Two tokenizers, and what units give: n_a, n_b, n_groups, n_links, groups, the key of each link; None if bytes differ."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        byte = {letter: b for b, letter in enumerate(byte_letters())}
        vocabulary = {i: bytes(map(byte.__getitem__, t)) for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        # The file's vocabulary is also its list of merges by rank.
        ranks = {t: i for i, t in vocabulary.items()}
        self.core = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.a_bytes = [vocabulary.get(i, b"") for i in range(self.a.get_vocab_size(with_added_tokens=True))]
        self.b = b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        names = [b.id_to_piece(i) for i in range(len(b))]
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.space = b.piece_to_id("▁")
        #: Line ends start a unit only where B has no token over one.
        self.lines = not any("\n" in p for p in names)
        self.sizes = [np.array([len(t) for t in table], np.int64) for table in (self.a_bytes, self.b_bytes)]
        #: How a token is written before another of its group, and as the last of its side.
        self.written = [
            np.array([[f"{i}{sign}".encode() for i in range(len(table))] for sign in (",", last)], dtype=object)
            for table, last in ((self.a_bytes, "|"), (self.b_bytes, ";"))
        ]
        #: Signs after a letter that no token of B joins to it; A's never do. Their own groups, as a unit gives them.
        self.signs = {c: self._sign(c, names) for c in ".,!?;:" if not any(x.isalpha() and y == c for n in names for x, y in zip(n, n[1:]))}
        self.kept = Kept()

    def _sign(self, sign: str, names: list[str]) -> tuple:
        a, b = self.core.encode_ordinary(sign), [names.index(sign)]
        pair = np.array([a[0] << 32 | b[0]], np.int64)
        return 1, 1, 1, 1, b";" + _written(a, b), pair.tobytes()

    def units(self, text: str) -> list[str]:
        """The parts of space and text whose tokens stand for themselves; a line end is written, a single space isn't."""
        if text[0] in " \n" or text[-1] in " \n" or any(s in text for s in _SIGNS) or _RARE_SPACE.search(text):
            return [" " + u for u in _CUT.split(text)]
        return (text.replace("\n", " \n") if self.lines else text).split(" ")

    def _ids(self, unit: str, whole: str) -> list[int]:
        # Without odd white space, byte pairs by rank are all there is; else the tokenizer decides.
        return self.a.encode(whole, add_special_tokens=False).ids if unit[0] == " " else self.core.encode_ordinary(whole)

    def _encoded(self, units: list[str]) -> list[tuple | None]:
        whole = [u if u[0] in "\n " else " " + u for u in units]
        of_a = [self._ids(u, w) for u, w in zip(units, whole)]
        # B puts a space before what it gets; a unit that starts with a line end has none.
        of_b = self.b.encode([w if w[0] == "\n" else w[1:] for w in whole], num_threads=1)
        of_b = [b[b[:1] == [self.space] :] if w[0] == "\n" else b for w, b in zip(whole, of_b)]
        data = [w.encode() for w in whole]
        if any(b"".join([t for ids in of for t in map(table.__getitem__, ids)]) != b"".join(data) for of, table in ((of_a, self.a_bytes), (of_b, self.b_bytes))):
            if len(units) > 1:
                half = len(units) // 2
                return self._encoded(units[:half]) + self._encoded(units[half:])
            return [None]
        a, b = (np.fromiter(chain.from_iterable(of), np.int64) for of in (of_a, of_b))
        ends = [np.cumsum(size[ids]) for size, ids in zip(self.sizes, (a, b))]
        unit_ends = np.cumsum([len(d) for d in data])
        if not all(np.isin(unit_ends, e).all() for e in ends):  # as a whole the bytes are right, in a unit they aren't
            half = len(units) // 2
            return self._encoded(units[:half]) + self._encoded(units[half:])
        shared = np.intersect1d(*ends)
        group_a, group_b = (np.searchsorted(shared, e) for e in ends)
        n_a, n_b = np.bincount(group_a), np.bincount(group_b)
        end_a, end_b = np.cumsum(n_a), np.cumsum(n_b)
        # Tokens in the order of writing: by group, A before B.
        parts = np.empty(len(a) + len(b), dtype=object)
        k = np.arange(len(a))
        parts[k + (end_b - n_b)[group_a]] = self.written[0][(k == end_a[group_a] - 1).astype(int), a]
        k = np.arange(len(b))
        parts[k + end_a[group_b]] = self.written[1][(k == end_b[group_b] - 1).astype(int), b]
        n = n_a * n_b
        g = np.repeat(np.arange(len(n)), n)
        r = np.arange(len(g)) - (np.cumsum(n) - n)[g]
        keys = a[(end_a - n_a)[g] + r // n_b[g]] << 32 | b[(end_b - n_b)[g] + r % n_b[g]]
        until = np.searchsorted(shared, unit_ends)
        marks = np.stack([end_a[until], end_b[until], until + 1, np.cumsum(n)[until], (end_a + end_b)[until]], axis=1)
        out, before, parts = [], np.zeros(5, np.int64).tolist(), parts.tolist()
        for mark in marks.tolist():
            written = b"".join(parts[before[4] : mark[4]])[:-1]
            counts = [x - y for x, y in zip(mark[:4], before)]
            out.append((*counts, written, keys[before[3] : mark[3]].tobytes()))
            before = mark
        return out

    def learn(self, units: Collection[str]) -> dict[str, tuple | None]:
        """What distinct units give; a word with a sign at its end gives what the word does, and the sign."""
        kept, signs = self.kept, self.signs
        signed = [u for u in units if u[-1:] in signs and u[-2:-1].isalpha()]
        words = dict.fromkeys(units)
        for u in signed:
            del words[u]
        words.update(dict.fromkeys([u[:-1] for u in signed]))
        out = {u: kept.find(u) for u in words}
        names = [u for u, found in out.items() if found == ()]
        for low in range(0, len(names), 2000):
            some = names[low : low + 2000]
            for u, found in zip(some, self._encoded(some)):
                out[u] = found
                if len(u) <= 64:
                    kept.keep(u, found)
        for u in signed:
            base, sign = out[u[:-1]], signs[u[-1]]
            out[u] = base and tuple([x + y for x, y in zip(base, sign)])
        return out

    def align(self, texts: list[str]) -> dict[str, list]:
        """n_a, n_b, n_groups, n_links, groups (None without tokens), keys, times of each text."""
        # No cycles are made here, and looking for some among all that is kept takes a third of the time.
        was_on = gc.isenabled()
        gc.disable()
        try:
            return self._align(texts)
        finally:
            if was_on:
                gc.enable()

    def _align(self, texts: list[str]) -> dict[str, list]:
        cut = [self.units(t) if t else [] for t in texts]
        known = self.learn(dict.fromkeys(chain.from_iterable(cut)))
        number = {u: k for k, u in enumerate(known)}
        bad = np.array([f is None for f in known.values()], dtype=bool)
        found = [f or (0, 0, 0, 0, b"", b"") for f in known.values()]
        counts = np.array([f[:4] for f in found], dtype=np.int64).reshape(-1, 4)
        size, written = counts[:, 3], [f[4] for f in found]
        start = np.cumsum(size) - size
        keys = np.frombuffer(b"".join([f[5] for f in found]), np.int64)
        out = {c: [] for c in ("n_a", "n_b", "n_groups", "n_links", "groups", "keys", "times")}
        for units in cut:
            of = np.fromiter(map(number.__getitem__, units), np.int64, len(units))
            if not units or bad[of].any():
                row = (0, 0, 0, 0, None, np.empty(0, np.int64), np.empty(0, np.int64))
            else:
                once, n = np.unique(of, return_counts=True)
                k = np.repeat(start[once] - (np.cumsum(size[once]) - size[once]), size[once]) + np.arange(size[once].sum())
                own, inverse = np.unique(keys[k], return_inverse=True)
                total = np.bincount(inverse, np.repeat(n, size[once])).astype(np.int64)
                row = (*(n @ counts[once]).tolist(), b";".join([written[u] for u in of.tolist()]), own, total)
            for c, v in zip(out.values(), row):
                c.append(v)
        return out


@cache
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


_LONGS = pa.list_(pa.int64())
_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
_ALIGNED = pa.schema([("spot", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in _COUNTS), ("groups", pa.binary()), ("keys", _LONGS), ("times", _LONGS)])
_ALIGNED_DDL = "spot long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups binary, keys array<long>, times array<long>"
_INTS = pa.list_(pa.int32())
_FRAGMENTS = pa.schema(
    [("spot", pa.int64()), ("doc_id", pa.int64()), ("chunk", pa.int64()), ("ok", pa.bool_()), ("cut", pa.bool_()), ("prefix", pa.list_(_INTS)), ("closed", pa.binary())]
    + [("n", _LONGS), ("keys", _LONGS), ("times", _LONGS), ("suffix", pa.list_(_INTS))]
)
_FRAGMENTS_DDL = (
    "spot long, doc_id long, chunk long, ok boolean, cut boolean, prefix array<array<int>>, closed binary, n array<long>, "
    "keys array<long>, times array<long>, suffix array<array<int>>"
)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *arrays])))


def _row(spot: int, doc_id: int | None, chunk: int, f: Fragment | None) -> pa.RecordBatch:
    ok, f = f is not None, f or Fragment()
    values = (spot, doc_id, chunk, ok, f.cut, list(f.prefix), f.closed, list(f.n), list(f.pairs), list(f.pairs.values()), list(f.suffix))
    return batch_of(_FRAGMENTS, {c: [v] for c, v in zip(_FRAGMENTS.names, values)})


def _fragment(r: dict) -> Fragment | None:
    if not r["ok"]:
        return None
    return Fragment(r["cut"], tuple(r["prefix"]), r["closed"], tuple(r["n"]), dict(zip(r["keys"], r["times"])), tuple(r["suffix"]))


def slices(texts: list[str], chars: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of a bounded size, or single ones."""
    low = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > chars:
            yield low, k
            low, size = k, 0
        size += len(t) + 64
    if low < len(texts):
        yield low, len(texts)


def chunks(text: str, size: int) -> Iterator[str]:
    """A text cut at single spaces, about every `size` characters."""
    low = 0
    while len(text) - low > size:
        at = _CUT.search(text, low + size)
        if at is None:
            break
        yield text[low : at.start()]
        low = at.end()
    yield text[low:]


def _long_texts(rows: DataFrame, path_a: str, path_b: str, chunk: int, fan_in: int) -> DataFrame:
    """Alignments of long texts, by the product of their chunks' fragments in a tree."""
    cut_schema = pa.schema([("spot", pa.int64()), ("doc_id", pa.int64()), ("chunk", pa.int64()), ("text", pa.string())])

    def cut(batches):
        for batch in batches:
            for spot, doc_id, text in zip(*(batch[c].to_pylist() for c in ("spot", "doc_id", "text"))):
                for k, part in enumerate(chunks(text, chunk)):
                    yield batch_of(cut_schema, {"spot": [spot], "doc_id": [doc_id], "chunk": [k], "text": [part]})

    def encode(batches):
        own = aligner(path_a, path_b)
        for batch in batches:
            for spot, doc_id, k, text in zip(*(batch[c].to_pylist() for c in cut_schema.names)):
                found = own.align([text])
                f = None
                if found["groups"][0] is not None:
                    a, b = (list(map(int, ids.split(b","))) for ids in found["groups"][0].split(b";", 1)[0].split(b"|"))
                    # The chunk's first group is open to the left: what comes before isn't known here.
                    first = _links(a, b)
                    rest = (found["n_a"][0] - len(a), found["n_b"][0] - len(b), found["n_groups"][0] - 1, found["n_links"][0] - sum(first.values()))
                    pairs = {k: n - first.get(k, 0) for k, n in zip(found["keys"][0].tolist(), found["times"][0].tolist()) if n > first.get(k, 0)}
                    f = Fragment(True, (a, b), found["groups"][0].partition(b";")[2], rest, pairs)
                yield _row(spot, doc_id, k, f)

    def multiply(batches):
        for whole in whole_groups(batches, "spot", "up"):
            held = None
            for k in range(len(whole)):
                r = whole.slice(k, 1).to_pylist()[0]
                f = _fragment(r)
                if held is not None and held[:3] == (r["spot"], r["doc_id"], r["up"]):
                    held = (*held[:3], held[3] * f if held[3] and f else None)
                    continue
                if held is not None:
                    yield _row(*held)
                held = (r["spot"], r["doc_id"], r["up"], f)
            yield _row(*held)

    parts = rows.mapInArrow(cut, "spot long, doc_id long, chunk long, text string").repartition("spot", "chunk")
    found = stored(parts.mapInArrow(encode, _FRAGMENTS_DDL))
    while found.agg(F.max("chunk")).first()[0]:
        dealt = found.withColumn("up", F.floor(F.col("chunk") / fan_in)).repartition("spot", "up").sortWithinPartitions("spot", "up", "chunk")
        found = stored(dealt.mapInArrow(multiply, _FRAGMENTS_DDL))

    def finish(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                f = _fragment(r)
                f = f.whole() if f else Fragment()
                values = (r["spot"], r["doc_id"], *f.n, f.closed if f.n[2] else None, list(f.pairs), list(f.pairs.values()))
                yield batch_of(_ALIGNED, {c: [v] for c, v in zip(_ALIGNED.names, values)})

    return found.mapInArrow(finish, _ALIGNED_DDL)


def aligned(docs: DataFrame, path_a: str, path_b: str, digest: bool = False, chunk: int = CHUNK, fan_in: int = FAN_IN) -> DataFrame:
    """(spot, doc_id, n_a, n_b, n_groups, n_links, groups, keys, times) of every document.

    `groups` is `a1,a2|b1;a3|b2,b3`, null without tokens; with `digest`, the lowercase hex of its sha256. `keys` are the distinct
    linked pairs a << 32 | b, `times` how often each is linked. `spot` is a number of the row.
    """
    text = text_of(docs)
    rows = docs.select(F.monotonically_increasing_id().alias("spot"), docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"))

    def run(batches):
        own = aligner(path_a, path_b)
        for batch in batches:
            texts = batch["text"].to_pylist()
            for low, high in slices(texts):
                found = own.align(texts[low:high])
                if digest:
                    found["groups"] = [None if g is None else hashlib.sha256(g).hexdigest().encode() for g in found["groups"]]
                arrays = [batch["spot"].slice(low, high - low), batch["doc_id"].slice(low, high - low)]
                arrays += [pa.array(found[c], pa.int64()) for c in _COUNTS] + [pa.array(found["groups"], pa.binary())]
                yield pa.RecordBatch.from_arrays([*arrays, _lists(found["keys"]), _lists(found["times"])], schema=_ALIGNED)

    short = rows.where(F.length("text") <= chunk).mapInArrow(run, _ALIGNED_DDL)
    # Spots of long texts are negative, so that both kinds stay apart.
    long = rows.where(F.length("text") > chunk).withColumn("spot", -1 - F.col("spot"))
    long = _long_texts(long, path_a, path_b, chunk, fan_in)
    if digest:
        long = long.withColumn("groups", F.sha2("groups", 256).cast("binary"))
    return stored(short.unionByName(long))


def pair_counts(found: DataFrame) -> DataFrame:
    """(key, n, best): in how many documents each pair is linked, and whether that is its A id's highest count."""
    counts = stored(found.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n")))
    a = F.shiftright("key", 32)
    highest = counts.groupBy(a.alias("a")).agg(F.max("n").alias("highest"))
    return stored(counts.withColumn("a", a).join(highest, "a").select("key", "n", (F.col("n") == F.col("highest")).alias("best")))


def with_counts(found: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """`found` with n_best, the links whose pair's count is its A id's highest, and count_sum, the counts summed over links."""
    counts = pair_counts(found)
    top = counts.orderBy(F.desc("n"), "key").limit(heavy).toPandas().sort_values("key")
    keys, n, best = (top[c].to_numpy() for c in ("key", "n", "best"))
    schema = pa.schema([("spot", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("keys", _LONGS), ("times", _LONGS)])

    def run(batches):
        for batch in batches:
            lists = batch["keys"]
            size = lists.value_lengths().to_numpy()
            own, times = lists.flatten().to_numpy(), batch["times"].flatten().to_numpy()
            row = np.repeat(np.arange(len(size)), size)
            at = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
            known = keys[at] == own if len(keys) else np.zeros(len(own), bool)
            sums = [np.zeros(len(size), np.int64) for _ in range(2)]
            np.add.at(sums[0], row[known], times[known] * best[at[known]])
            np.add.at(sums[1], row[known], times[known] * n[at[known]])
            ends = np.concatenate([[0], np.cumsum(np.bincount(row[~known], minlength=len(size)))]).astype(np.int32)
            rest = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v[~known])) for v in (own, times)]
            yield pa.RecordBatch.from_arrays([batch["spot"], *map(pa.array, sums), *rest], schema=schema)

    summed = stored(found.select("spot", "keys", "times").mapInArrow(run, "spot long, n_best long, count_sum long, keys array<long>, times array<long>"))
    rest = summed.select("spot", F.explode(F.arrays_zip("keys", "times")).alias("p")).select("spot", F.col("p.keys").alias("key"), F.col("p.times").alias("times"))
    rest = rest.join(counts, "key").select("spot", (F.col("times") * F.col("best").cast("long")).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
    sums = summed.select("spot", "n_best", "count_sum").unionByName(rest).groupBy("spot").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return found.join(sums, "spot")


def alignment(docs: DataFrame, path_a: str, path_b: str, heavy: int = HEAVY, chunk: int = CHUNK, fan_in: int = FAN_IN) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document."""
    found = with_counts(aligned(docs, path_a, path_b, digest=True, chunk=chunk, fan_in=fan_in), heavy)
    return found.select("doc_id", *_COUNTS, "n_best", "count_sum", F.coalesce(F.col("groups").cast("string"), F.lit("")).alias("groups_sha256"))
