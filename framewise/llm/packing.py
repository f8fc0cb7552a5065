"""Best-fit packing by the sum-of-squares rule.

A document is its ids (tokenizers, add_special_tokens=False) followed by id 0; a null text is an empty one, and
packs as that id alone. Documents longer than `size` are cut into pieces of `size`, the first of which is shorter
where the length asks for it. Whole pieces fill a sequence each. The others are dealt evenly to shards of about
`shard` pieces, which cost a sequence or two each; in a shard, the longest come first, and each goes into the open
sequence for which the sum, over residual gaps, of the squared numbers of open sequences becomes smallest. A new
sequence is opened where it fits in none.

Repeated rows are packed one by one. Null ids are kept, other columns aren't read.
"""

import re
import zlib
from array import array
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.llm.bpe import byte_letters
from framewise.llm.common import batch_of, begin, clears, stored

SIZE = 2048
SHARD = 32_768
KEPT = 250_000
#: Fixed value: how byte-level BPE cuts texts before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
#: Texts whose chunks at single spaces may not be encoded one by one.
_TOGETHER = re.compile(r"\s\s\s|\s\s\Z|<\|")
#: What all of these have one of: white space beyond spaces and single line ends, or a special token's beginning.
_RARE_SPACE = re.compile(r"[^\S \n]")
_SIGNS = ("  ", "\n\n", " \n", "\n ", "<|")


class Encoder:
    """Ids of texts as little-endian bytes.

    The tokenizer file's vocabulary is also its list of merges by rank, so chunks between single spaces go through
    the byte-pair core of tiktoken, and what it gives is kept in a table of bounded size. Texts for which a cut at a
    space isn't one that the tokenizer makes itself go through the tokenizer as a whole.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.of = Tokenizer.from_file(path)
        byte = {letter: b for b, letter in enumerate(byte_letters())}
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in self.of.get_vocab(with_added_tokens=False).items()}
        core = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe

        class Kept(dict):
            """Ids of a word with a space before it."""

            def __missing__(self, word: str) -> bytes:
                ids = array("I", core.encode_ordinary(" " + word)).tobytes()
                if len(self) >= KEPT:
                    self.clear()
                if len(word) <= 64:
                    self[word] = ids
                return ids

        self.core, self.kept = core, Kept()

    def encode(self, text: str) -> bytes:
        if (any(s in text for s in _SIGNS) or _RARE_SPACE.search(text)) and _TOGETHER.search(text):
            return array("I", self.of.encode(text, add_special_tokens=False).ids).tobytes()
        first, *rest = text.split(" ")
        return b"".join([array("I", self.core.encode_ordinary(first)).tobytes(), *map(self.kept.__getitem__, rest)])


@clears
@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, path: str, size: int = SIZE, with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): every document, cut where it is longer than `size`."""
    schema = PIECES if with_ids else pa.schema(list(PIECES)[:-1])
    ddl = PIECES_DDL if with_ids else PIECES_DDL.removesuffix(", ids binary")

    def run(batches):
        begin("packing")
        e = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, out = batch.slice(at, 256), []
                for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist()):
                    ids = e.encode(text) + bytes(4)
                    n = len(ids) // 4
                    start, end = 0, (n - 1) % size + 1
                    for k in range(-(-n // size)):
                        own = ids[4 * start : 4 * end]
                        out.append((doc_id, k, start, end - start, zlib.crc32(own), *((own,) if with_ids else ())))
                        start, end = end, end + size
                yield batch_of(schema, dict(zip(schema.names, zip(*out))))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(run, ddl)


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and the offset of each piece, in the given order."""
    n_open = np.zeros(size + 1, dtype=np.int64)
    stacks: list[list[int]] = [[] for _ in range(size + 1)]
    places, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    made, no = 0, np.int64(2) ** 60
    for k, s in enumerate(lengths.tolist()):
        # Moving a sequence from gap g to g - s changes the sum by 2 (n[g - s] - n[g] + 1), filling it by 1 - 2 n[s].
        gaps = n_open[s:size]
        change = np.where(gaps > 0, 2 * (n_open[: size - s] - gaps + 1), no)
        if len(gaps) and gaps[0]:
            change[0] = 1 - 2 * gaps[0]
        best = int(change.argmin()) if len(gaps) else 0
        if len(gaps) and change[best] < no:
            gap = s + best
            b = stacks[gap].pop()
            n_open[gap] -= 1
        else:
            gap, b, made = size, made, made + 1
        places[k], offsets[k] = b, size - gap
        if gap > s:
            stacks[gap - s].append(b)
            n_open[gap - s] += 1
    return places, offsets


def pack(cut: DataFrame, size: int = SIZE, shard: int = SHARD) -> DataFrame:
    """cut (..., length <= size) with sequence_id and offset; sequence ids are unique, gaps are at ends only."""
    cut = stored(cut.withColumn("spot", F.monotonically_increasing_id()))
    short = cut.where(F.col("length") < size)
    shards = max(1, -(-short.count() // shard))

    def place(group: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort((group["spot"], -group["length"]))
        bins, offsets = sum_of_squares(group["length"].to_numpy()[order], size)
        spot = group["spot"].to_numpy()[order]
        return pd.DataFrame({"spot": spot, "sequence_id": spot[np.unique(bins, return_index=True)[1]][bins], "offset": offsets})

    dealt = short.select("spot", "length", F.pmod(F.xxhash64("spot"), F.lit(shards)).alias("shard"))
    places = dealt.groupBy("shard").applyInPandas(place, "spot long, sequence_id long, offset long")
    whole = cut.where(F.col("length") >= size).withColumns({"sequence_id": F.col("spot"), "offset": F.lit(0).cast("long")})
    return whole.unionByName(short.join(places, "spot")).drop("spot")
