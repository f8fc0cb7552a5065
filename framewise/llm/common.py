"""Shared helpers: memory of reused Python workers, tables in the shared folder, row keys, whole groups from sorted partitions, components."""

import ctypes
import gc
import sys
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NULL_ID = -(2**63)


_worker: dict[str, str] = {}
_caches: list[Callable[[], None]] = []


def clears(cached: Callable) -> Callable:
    """Name a function with a cache (functools.cache) that `begin` may clear."""
    _caches.append(cached.cache_clear)
    return cached


def begin(step: str) -> None:
    """To be called by a task of an operator's step: Python workers outlive their tasks, and what the steps before have
    cached is given back to the system when another one begins."""
    if _worker.setdefault("step", step) != step:
        _worker["step"] = step
        for clear in _caches:
            clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a folder of the warehouse only where that is unset."""
    default = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return spark.conf.get("spark.checkpoint.dir", default).rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/framewise-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def remove(*tables: DataFrame) -> None:
    """Give back the room of `stored` tables, once all that reads them is written."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_of(docs: DataFrame) -> Column:
    """The text, an empty one where it is null."""
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def squeezed(text: Column) -> Column:
    """Texts as zstandard frames, a third of their size, for the way through a shuffle; null stays null."""

    @F.pandas_udf("binary")
    def squeeze(texts: pd.Series) -> pd.Series:
        compress = zstandard.ZstdCompressor(level=1).compress
        return texts.map(lambda t: None if t is None else compress(t.encode()))

    return squeeze(text)


def released(frame: bytes | pa.Buffer) -> bytes:
    return zstandard.ZstdDecompressor().decompress(frame)


def whole_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text, row): all columns but text are in row, a struct, where helper columns can't clash with them."""
    return docs.select("doc_id", "text", F.struct(*(docs[f"`{c}`"] for c in docs.columns if c != "text")).alias("row"))


def unpacked(columns: list[str]) -> list[Column]:
    """The columns of docs, from whole_rows."""
    return [F.col(c) if c == "text" else F.col("row")[c].alias(c) for c in columns]


def with_keys(docs: DataFrame) -> DataFrame:
    """docs with __kid and __kth: rows with equal id and text share a key, and so do their results.

    A null id is a value like any other. docs must not have columns of these names, see whole_rows.
    """
    keys = {"__kid": F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)), "__kth": F.xxhash64(text_of(docs))}
    return docs.withColumns(keys)


def keyed(docs: DataFrame) -> DataFrame:
    """(kid, kth, doc_id, text) of docs, see with_keys; a null text is an empty one."""
    keys = with_keys(docs.select("doc_id", "text"))
    return keys.select(F.col("__kid").alias("kid"), F.col("__kth").alias("kth"), F.col("doc_id").cast("long").alias("doc_id"), text_of(keys).alias("text"))


def whole_groups(batches: Iterable[pa.RecordBatch], *by: str) -> Iterator[pa.Table]:
    """Chunks of a partition sorted by long columns, each ending where a group ends."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        keys = [now.column(c).to_numpy() for c in by]
        changed = np.zeros(len(now) - 1, dtype=bool)
        for k in keys:
            changed |= k[1:] != k[:-1]
        last = np.flatnonzero(changed)
        if not len(last):
            held = now
            continue
        yield now.slice(0, int(last[-1]) + 1)
        held = now.slice(int(last[-1]) + 1)
    if held is not None:
        yield held


def batch_of(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def roots(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest index that each of n items reaches over the pairs (i, j)."""
    low = np.arange(n)
    while True:
        before = low.copy()
        m = np.minimum(low[i], low[j])
        np.minimum.at(low, i, m)
        np.minimum.at(low, j, m)
        low = low[low]
        if np.array_equal(low, before):
            return low


def components(edges: DataFrame, a: str, b: str, node_type: str = "long") -> DataFrame:
    """(node, root) for every node of the edges that isn't the smallest of its component.

    Alternating large and small stars: each step hangs the larger neighbours, then the smaller ones, on
    the smallest known neighbour. A node's neighbours are never gathered: minima are aggregates, and the
    joins that use them may be split by Spark when a node is hot.
    """
    x, y = F.col(a).cast(node_type), F.col(b).cast(node_type)
    now = stored(edges.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        hung = large.join(low, F.col("u") == F.col("w"))
        now = stored(
            hung.select("u", F.col("m").alias("v"))
            .unionByName(hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
            .distinct()
        )
