"""BPE encoding and decoding: an index from each pair of symbols to all its places in a batch of words.

A text is normalised and cut as the tokenizer file says, and the words of a batch that aren't known yet go into one
row of symbols. Pairs that have a merge are listed with all their places; active merges are applied in ascending rank,
each at all its places from left to right, and only the lists of neighbouring pairs are updated. Encodings of short words
are kept between rows in tables of bounded size, which drop what didn't come again.

Ids equal the library's with add_special_tokens=False; strings of special tokens in a text become their ids, as by
default. Decoding joins the tokens as the library does for a file without a decoder, special tokens included. Null
texts are empty and have no tokens; null ids and repeated rows are kept, other columns aren't read.
"""

import hashlib
import heapq
import json
import re
import string
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import islice

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.llm.common import batch_of

KEPT_WORDS = 250_000
KEPT_LENGTH = 64
#: Unicode white space.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CODES = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Kept(dict):
    """Results by word: from batch to batch at most KEPT_WORDS words of at most KEPT_LENGTH letters.

    When there are more, those that have come again since the last time stay, up to half of the bound.
    """

    def __init__(self):
        self.again: set[str] = set()
        self.new: list[str] = []

    def missing(self, words: Iterable[str]) -> list[str]:
        words = set(words)
        self.new = [w for w in words if w not in self]
        words.difference_update(self.new)
        self.again |= words
        return self.new

    def settle(self) -> None:
        """To be called between batches."""
        for w in self.new:
            if len(w) > KEPT_LENGTH:
                del self[w]
        self.new = []
        if len(self) > KEPT_WORDS:
            stay = {w: self[w] for w in islice(self.again, KEPT_WORDS // 2) if w in self}
            self.clear()
            self.update(stay)
            self.again = set()


class Merges:
    """A tokenizer file's vocabulary and merges, by id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        self.vocab = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.token = {i: t for t, i in (self.vocab | self.special).items()}
        letters = byte_letters()
        self.inner, self.last = [self.vocab[x] for x in letters], [self.vocab[x + self.suffix] for x in letters]
        self.rank, self.merged = {}, []
        for r, (a, b) in enumerate(model["merges"]):
            pair = self.vocab[a], self.vocab[b]
            self.rank.setdefault(pair, r)
            self.merged.append((pair, self.vocab[a + b]))
        (pattern,) = (p["pattern"]["Regex"] for p in file["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(pattern.replace("\\s", WHITE))
        self.cut_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.words = Kept()
        self.chunks = Kept()

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of words, through the pair index of all of them."""
        sym = [-1]
        for w in words:
            *inner, last = w.encode()
            sym += [self.inner[b] for b in inner]
            sym += self.last[last], -1
        rank, merged, n = self.rank, self.merged, len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        places: dict[tuple[int, int], list[int]] = {}
        for p, pair in enumerate(zip(sym, sym[1:])):
            if pair in places:
                places[pair].append(p)
            elif pair in rank:
                places[pair] = [p]
        active = [rank[pair] for pair in places]
        heapq.heapify(active)
        while active:
            pair, new = merged[heapq.heappop(active)]
            here = places.pop(pair)
            here.sort()
            a, b = pair
            for p in here:
                q = after[p]
                if sym[p] != a or sym[q] != b:
                    continue  # another merge has taken part of it
                sym[p], sym[q] = new, -2
                r = after[p] = after[q]
                before[r] = p
                left, right = sym[before[p]], sym[r]
                if left >= 0:
                    key = left, new
                    if key in places:
                        places[key].append(before[p])
                    elif key in rank:
                        places[key] = [before[p]]
                        heapq.heappush(active, rank[key])
                if right >= 0:
                    key = new, right
                    if key in places:
                        places[key].append(p)
                    elif key in rank:
                        places[key] = [p]
                        heapq.heappush(active, rank[key])
        out: list[list[int]] = []
        for s in sym:
            if s == -1:
                out.append([])
            elif s >= 0:
                out[-1].append(s)
        return out[:-1]

    def parts(self, chunk: str) -> list[str | int]:
        """The words of a text without white space, and the ids of special tokens in it."""
        out: list[str | int] = []
        for piece in self.cut_special.split(chunk) if "<|" in chunk else (chunk,):
            if piece in self.special:
                out.append(self.special[piece])
            elif piece.isascii():
                # Letters, then signs at most, are what the pattern would cut them into.
                plain = piece.lower()
                word = plain.rstrip(string.punctuation)
                out += [w for w in (word, plain[len(word) :]) if w] if word.isalpha() else self.pattern.findall(plain)
            else:
                plain = unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()
                out += self.pattern.findall(plain)
        return out

    def learn(self, texts: list[list[str]]) -> None:
        """Encode all chunks that aren't kept yet: number of tokens, ids and tokens, joined by spaces."""
        self.chunks.settle()
        self.words.settle()
        cut = {c: self.parts(c) for c in self.chunks.missing(c for chunks in texts for c in chunks)}
        new = self.words.missing(w for parts in cut.values() for w in parts if isinstance(w, str))
        token, words = self.token, self.words
        for w, ids in zip(new, self.encode_words(new)):
            words[w] = len(ids), " ".join([str(i) for i in ids]), " ".join([token[i] for i in ids])
        for c, parts in cut.items():
            found = [words[w] if isinstance(w, str) else (1, str(w), token[w]) for w in parts]
            self.chunks[c] = found[0] if len(found) == 1 else (sum([x[0] for x in found]), " ".join([x[1] for x in found]), " ".join([x[2] for x in found]))

    def encoded(self, texts: list[list[str]]) -> Iterator[tuple[int, str, str]]:
        """Number of tokens, ids and tokens, joined by spaces, of texts cut at white space."""
        self.learn(texts)
        for chunks in texts:
            found = [x for x in map(self.chunks.__getitem__, chunks) if x[0]]
            ids = " ".join([x[1] for x in found])
            yield ids.count(" ") + 1 if ids else 0, ids, " ".join([x[2] for x in found])


def chunks_of(text: str) -> list[str]:
    """A text cut at Unicode white space; Python's split has four more characters."""
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return [c for c in re.split(f"[{WHITE}]+", text) if c]
    return text.split()


@cache
def merges(path: str) -> Merges:
    return Merges(path)


def _encoded(docs: DataFrame, path: str, row, schema: pa.Schema, ddl: str) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches):
        m = merges(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                cut = [chunks_of(t) for t in part["text"].to_pylist()]
                rows = [(doc_id, n, *row(ids, decoded)) for doc_id, (n, ids, decoded) in zip(part["doc_id"].to_pylist(), m.encoded(cut))]
                yield batch_of(schema, dict(zip(schema.names, zip(*rows))))

    return texts.mapInArrow(run, ddl)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every whole text."""
    row = lambda ids, decoded: ([int(i) for i in ids.split()], decoded)
    return _encoded(docs, path, row, CODES, "doc_id long, n_tokens long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): as encode, without carrying ids and texts along."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return _encoded(docs, path, lambda ids, decoded: (sha(ids), sha(decoded)), DIGESTS, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode(codes: DataFrame, path: str) -> DataFrame:
    """codes (..., ids array<int>) with `decoded`: the tokens, special ones too, joined by a space."""

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        token = merges(path).token
        return ids.map(lambda x: None if x is None else " ".join(token[i] for i in x))

    return codes.withColumn("decoded", text("ids"))
