"""Exact top-k search by inner product: vectors by descending length, SVD-rotated partial sums.

A component x becomes the integer floor(scale * x), the score of two vectors is their integer inner product
(shorter vectors end in zeros). Queries are the rows whose id is divisible by `every`; candidates are all rows but
the query's own. Ties go to the smaller id. Vectors that are null or hold null or non-finite components take no part.

Candidates are sorted by length and cut into slabs, queries into groups. The slab of the longest vectors gives each
query a score that its k-th result can't be below; a slab whose longest vector can't reach it (Cauchy-Schwarz) never
meets the query. In a slab, the longest candidates come first, in blocks: products over the leading singular axes plus
the product of the residual norms bound a score, the next axes are added while enough pairs fall away, and only candidates
whose bound reaches the query's k-th score so far are scored exactly, in integers: pair by pair where few are left, by
one matrix product where many are.

Rows with equal ids are separate candidates; a null id is no query, and loses ties. Scores beyond 64 bits are
given as the nearest long.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewise.llm.common import batch_of, stored
from framewise.llm.vectors import matrix, principal_axes, usable

K = 20
EVERY = 20
SCALE = 64
SLAB = 16384
GROUP = 16384
BLOCK = 1024
#: Axes that the partial sums have reached after each step.
LEVELS = (16, 32, 64)
#: Below this share of pairs left they are scored one by one; a step that takes less than half of them away is the last.
FEW = 0.05
NO_ID = 2**63 - 1
HITS = pa.schema([("row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
HITS_DDL = "row long, query_id long, vec_id long, score long"


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products, row by row."""
    if len(q) and np.sqrt((q * q).sum(axis=1).max(initial=0) * (c * c).sum(axis=1).max(initial=0)) < 2.0**52:
        return np.einsum("ij,ij->i", q, c).astype(np.int64)
    whole = [sum(int(x) * int(y) for x, y in zip(a, b)) for a, b in zip(q, c)]
    return np.array([min(max(s, -(2**63)), 2**63 - 1) for s in whole], dtype=np.int64)


class Rotated:
    """Vectors with their coordinates on the principal axes, lengths, and lengths of what is left after each level."""

    def __init__(self, x: np.ndarray, axes: np.ndarray):
        self.x = x
        self.turned = x @ axes[:, : LEVELS[-1]]
        self.norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        sums = np.cumsum(self.turned * self.turned, axis=1)
        ends = [min(level, sums.shape[1]) - 1 for level in LEVELS]
        self.rest = [np.sqrt(np.maximum(0, self.norm**2 - sums[:, e])) for e in ends]


class Candidates(Rotated):
    """A slab: rows by descending length."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, axes: np.ndarray):
        order = np.lexsort((ids, -np.einsum("ij,ij->i", x, x)))
        self.rows, self.ids = rows[order], ids[order]
        super().__init__(x[order], axes)


def reaching(q: Rotated, c: Candidates, open_: np.ndarray, s: slice, least: np.ndarray) -> np.ndarray:
    """Which (open query, candidate of the block) may reach the query's least score, by partial sums and residual norms."""
    bound, sums, at, left = None, 0.0, 0, 1.0
    for level, rest_q, rest_c in zip(LEVELS, q.rest, c.rest):
        axes = slice(at, level)
        if at >= q.turned.shape[1]:
            break
        sums = sums + q.turned[open_, axes] @ c.turned[s, axes].T
        bound = sums + np.multiply.outer(rest_q[open_], rest_c[s]) >= least[:, None]
        share = np.count_nonzero(bound) / bound.size
        if share <= FEW or share > left / 2:
            break
        at, left = level, share
    return bound


def search(c: Candidates, rows: np.ndarray, x: np.ndarray, floor: np.ndarray, axes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score): each query's k best of the slab that reach its floor."""
    q = Rotated(x, axes)
    best = (np.zeros(0, np.int64),) * 3
    for at in range(0, len(c.ids), BLOCK):
        s = slice(at, at + BLOCK)
        slack = 1e-9 * q.norm * c.norm[at] + 1e-6
        open_ = np.flatnonzero(q.norm * c.norm[at] + slack >= floor)
        if not len(open_):
            break
        may = reaching(q, c, open_, s, floor[open_] - slack[open_])
        found = []
        if np.count_nonzero(may) > FEW * may.size and q.norm[open_].max() * c.norm[at] < 2.0**52:
            # Every partial sum is an integer below 2^52, so the product in doubles is exact.
            whole = x[open_] @ c.x[s].T
            whole[~may | (rows[open_][:, None] == c.rows[s][None, :])] = -np.inf
            if whole.shape[1] >= k:
                floor[open_] = np.maximum(floor[open_], np.partition(whole, -k, axis=1)[:, -k])
            i, j = np.nonzero((whole >= floor[open_, None]) & (whole > -np.inf))
            found.append((open_[i], j + at, whole[i, j].astype(np.int64)))
        else:
            i, j = np.nonzero(may)
            i, j = open_[i], j + at
            own = rows[i] == c.rows[j]
            i, j = i[~own], j[~own]
            for p in range(0, len(i), 1 << 17):
                part = slice(p, p + (1 << 17))
                score = exact(x[i[part]], c.x[j[part]])
                keep = score >= floor[i[part]]
                found.append((i[part][keep], j[part][keep], score[keep]))
        i, j, score = (np.concatenate(y) for y in zip(best, *found))
        order = np.lexsort((c.ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        first = np.concatenate([[True], i[1:] != i[:-1]])[: len(i)]
        start = np.flatnonzero(first)
        rank = np.arange(len(i)) - np.repeat(start, np.diff(np.append(start, len(i))))
        best = tuple(y[rank < k] for y in (i, j, score))
        last = rank == k - 1
        floor[i[last]] = np.maximum(floor[i[last]], score[last])
    return best


def _meet(slabs: DataFrame, queries: DataFrame, axes: np.ndarray, k: int) -> DataFrame:
    """Hits of all (slab, group) tasks: candidates (slab, part) come first, then the queries, in batches."""

    def run(batches):
        task, rows, held, c = None, [], [], None
        for batch in batches:
            slab, part, kind = (batch[x].to_numpy() for x in ("slab", "part", "is_query"))
            change = np.flatnonzero((slab[1:] != slab[:-1]) | (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, b in zip([0, *change.tolist()], [*change.tolist(), len(slab)]) if len(slab) else ():
                piece = batch.slice(a, b - a)
                if (slab[a], part[a]) != task:
                    task, held, c = (slab[a], part[a]), [], None
                if not kind[a]:
                    held.append(piece)
                    continue
                if c is None and held:
                    t = pa.Table.from_batches(held).combine_chunks()
                    c = Candidates(t["row"].to_numpy(), t["id"].to_numpy(), matrix(t["x"].chunk(0), len(axes)), axes)
                if c is None:
                    continue
                q = matrix(piece["x"], len(axes))
                for at in range(0, len(q), 512):
                    s = slice(at, at + 512)
                    row, ids = piece["row"].to_numpy()[s], piece["id"].to_numpy()[s]
                    floor = piece["floor"].to_numpy()[s].astype(np.float64)
                    i, j, score = search(c, row, q[s], floor, axes, k)
                    yield batch_of(HITS, {"row": row[i], "query_id": ids[i], "vec_id": c.ids[j], "score": score})

    cols = ("slab", "part", "is_query", "row", "id", "floor", "x")
    together = slabs.select(*cols).unionByName(queries.select(*cols))
    return together.repartition("slab", "part").sortWithinPartitions("slab", "part", "is_query").mapInArrow(run, HITS_DDL)


def _top(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: float = SCALE, slab: int = SLAB, group: int = GROUP) -> DataFrame:
    """(query_id, rank, vec_id, score) of every query over all rows of vectors (vec_id, embedding)."""
    x = F.col("embedding").cast("array<double>")
    rows = vectors.where(usable(x)).select(
        F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("id"), F.col("vec_id").isNull().alias("no_id"),
        F.transform(x, lambda v: F.floor(v * scale).cast("double")).alias("x"),
    )
    rows = rows.withColumn("norm2", F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    n, dims = rows.agg(F.count("*"), F.max(F.size("x"))).first()
    dims, n_slabs = max(1, dims or 1), max(1, -(-n // slab))
    parts = max(1, n_slabs * 4)
    placed = rows.repartitionByRange(parts, F.desc("norm2"), "id").withColumns(
        {"place": F.spark_partition_id(), "row": F.monotonically_increasing_id()}
    )
    placed = stored(placed)
    used = (placed.agg(F.max("place")).first()[0] or 0) + 1
    placed = placed.withColumn("slab", F.floor(F.col("place") * F.lit(n_slabs) / F.lit(used)).cast("int"))
    axes = principal_axes(placed, "x", dims)

    is_query = ~F.col("no_id") & (F.pmod("id", F.lit(every)) == 0)
    n_groups = max(1, -(-(n // every) // group))
    queries = placed.where(is_query).select("row", "id", "x", "norm2", F.pmod(F.xxhash64("row"), F.lit(n_groups)).cast("int").alias("part"))
    queries = queries.withColumn("is_query", F.lit(1))
    candidates = placed.select("slab", "row", "id", "x", F.lit(0).alias("is_query"), F.lit(0).cast("double").alias("floor"))
    candidates = candidates.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))

    lowest = F.lit(float("-inf"))
    first = stored(_top(_meet(candidates.where("slab = 0"), queries.withColumns({"slab": F.lit(0), "floor": lowest}), axes, k), k))
    if n_slabs == 1:
        hits = first
    else:
        floors = first.where(F.col("rank") == k).select("row", F.col("score").cast("double").alias("floor"))
        longest = placed.groupBy("slab").agg(F.sqrt(F.max("norm2")).alias("longest")).where("slab > 0")
        others = queries.join(floors, "row", "left").withColumn("floor", F.coalesce("floor", lowest))
        others = others.withColumn("slab", F.explode(F.sequence(F.lit(1), F.lit(n_slabs - 1)))).join(longest, "slab")
        reach = F.sqrt("norm2") * F.col("longest")
        others = others.where(reach * (1 + 1e-9) + 1e-6 >= F.col("floor"))
        hits = _top(first.select(*HITS.names).unionByName(_meet(candidates.where("slab > 0"), others, axes, k)), k)
    vec_id = F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id")
    return hits.select("query_id", "rank", vec_id, "score")
