"""Embedding near-dedup: tiles of vectors compared in the order of principal axes.

Two vectors link if their cosine, in double precision, is at least `least` (0.95). Vectors that are null, zero, or
hold null or non-finite components link with nothing, and vectors of different lengths don't link.

Equal vectors become one with a weight, and travel as bytes of the column's type, once to be counted and once to be
put in order; what is told of them comes back by a digest. Unit vectors are rotated to principal axes, sorted by a grid on the
first three and cut into blocks. Blocks whose boxes on the leading axes are further apart than linked vectors
can be are never compared. Pairs of blocks are read from where the blocks are stored and not dealt, so what is
written grows with the vectors, not with the pairs; a task has some of the left blocks and some of the right ones. In a tile of two blocks, products over the leading axes come first; the rest of a
product is at most the product of the two suffix norms (Cauchy-Schwarz), and pairs whose bound is below the
threshold are dropped before the next axes are added. Remaining pairs are decided on the given components.

Rows with null ids take part; a component's id is null only if all its ids are. Repeated rows are copies of each
other, and link. No pair leaves a task: only sums of links and one link per vector to its tile's root.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.llm.common import batch_of, components, remove, roots, stored
from framewise.llm.vectors import principal_axes, usable

LEAST = 0.95
BLOCK = 1024
BOX = 12
STEPS = (8, 16, 32)
NO_ID = 2**63 - 1
SLACK = 1e-9
BLOCKS = pa.schema(
    [("block", pa.int64()), ("dims", pa.binary()), ("nodes", pa.binary()), ("weights", pa.binary()), ("data", pa.binary())]
    + [("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))]
)
BLOCKS_DDL = "block long, dims binary, nodes binary, weights binary, data binary, low array<double>, high array<double>"
PACKED = pa.schema([("vec_id", pa.int64()), ("x", pa.binary()), ("same", pa.binary())])
SPOTS = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("root", pa.int64())])


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by powers of two first, so that no square overflows or vanishes."""
    top = np.abs(m).max(axis=1, initial=0, keepdims=True)
    m = np.ldexp(m, -np.frexp(np.where(top > 0, top, 1))[1])
    norm = np.sqrt(np.einsum("ij,ij->i", m, m))
    return m / np.where(norm > 0, norm, 1)[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    scale = lambda m: np.ldexp(m, -np.frexp(np.abs(m).max(axis=1, keepdims=True))[1])
    a, b = scale(a), scale(b)
    return np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))


class Side:
    """A block's vectors, as given and rotated, with the norms of what is left after each step."""

    def __init__(self, block: dict, axes: np.ndarray, kind: np.dtype):
        self.nodes = np.frombuffer(block["nodes"], dtype=np.int64)
        self.weights = np.frombuffer(block["weights"], dtype=np.int64)
        self.dims = np.frombuffer(block["dims"], dtype=np.int32)
        self.given = np.frombuffer(block["data"], dtype=kind).astype(np.float64).reshape(len(self.nodes), -1)
        self.turned = unit(self.given) @ axes
        squares = np.cumsum(self.turned[:, ::-1] ** 2, axis=1)[:, ::-1]
        self.rest = np.sqrt(np.concatenate([squares, np.zeros((len(squares), 1))], axis=1))


def linked(a: Side, b: Side, rows: slice, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (in a, in b) of linked pairs, for some rows of a."""
    d = a.turned.shape[1]
    x, rest = a.turned[rows], a.rest[rows]
    steps = [s for s in STEPS if s < d] + [d]
    product = x[:, : steps[0]] @ b.turned[:, : steps[0]].T
    at, floor = steps[0], least - SLACK
    for s in [*steps[1:], None]:
        alive = product >= floor - np.multiply.outer(rest[:, at], b.rest[:, at])
        share = np.count_nonzero(alive) / max(1, alive.size)
        if s is None or share < 0.05:
            break
        product += x[:, at:s] @ b.turned[:, at:s].T
        at = s
    i, j = np.nonzero(alive)
    value = product[i, j]
    for s in (s for s in steps if s > at):
        value = value + np.einsum("ij,ij->i", x[i, at:s], b.turned[j, at:s])
        keep = value + rest[i, s] * b.rest[j, s] >= floor
        i, j, value, at = i[keep], j[keep], value[keep], s
    i = i + rows.start
    close = np.flatnonzero(value < least + SLACK)
    sure = np.ones(len(i), dtype=bool)
    sure[close] = cosines(a.given[i[close]], b.given[j[close]]) >= least
    sure &= a.dims[i] == b.dims[j]
    return i[sure], j[sure]


def compare(a: Side, b: Side, same: bool, least: float) -> dict | None:
    """For each vector with links in the tile: node, sum of linked weights, smallest node of its part."""
    parts = [linked(a, b, slice(k, min(k + 256, len(a.nodes))), least) for k in range(0, len(a.nodes), 256)]
    i, j = (np.concatenate(x) for x in zip(*parts))
    if same:
        i, j = i[i != j], j[i != j]
    if not len(i):
        return None
    n, m = len(a.nodes), len(b.nodes)
    sums = [np.bincount(i, b.weights[j], n)]
    if not same:
        sums.append(np.bincount(j, a.weights[i], m))
    nodes = a.nodes if same else np.concatenate([a.nodes, b.nodes])
    total = np.concatenate(sums)
    order = np.argsort(nodes, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    low = roots(place[i], place[j if same else j + n], len(nodes))
    root = nodes[order[low[place]]]
    has = total > 0
    return {"node": nodes[has], "n": total[has].astype(np.int64), "root": root[has]}


def _packed(rows: DataFrame, kind: np.dtype) -> DataFrame:
    """(vec_id, x, same) of rows (vec_id, x): the components as bytes, and a digest of them; zeros have no sign."""

    def pack(batches):
        for batch in batches:
            x = [(np.asarray(v.values, dtype=kind) + kind.type(0)).tobytes() if v.is_valid else None for v in batch["x"]]
            same = [None if v is None else hashlib.blake2b(v, digest_size=16).digest() for v in x]
            yield batch_of(PACKED, {"vec_id": batch["vec_id"], "x": x, "same": same})

    return rows.mapInArrow(pack, "vec_id long, x binary, same binary")


def unpacked(column: pa.Array | pa.ChunkedArray, dims: int, kind: np.dtype) -> np.ndarray:
    """Packed vectors as rows of doubles; shorter ones end in zeros."""
    rows = column.to_pylist()
    size = dims * kind.itemsize
    return np.frombuffer(b"".join(v.ljust(size, b"\0") for v in rows), dtype=kind).astype(np.float64).reshape(-1, dims)


def _blocks(vectors: DataFrame, axes: np.ndarray, least: float, size: int, kind: np.dtype) -> DataFrame:
    """Vectors (node, weight, x) as blocks, neighbours on the leading axes together."""
    dims = len(axes)
    width = max(1e-6, np.sqrt(max(0.0, 2 - 2 * least)) + 1e-6)
    grid = min(3, dims)
    reach = int(1 / width) + 3

    def coordinates(batches):
        schema = pa.schema([("node", pa.int64()), ("weight", pa.int64()), ("x", pa.binary()), ("cell", pa.int64()), ("y", pa.float64())])
        for batch in batches:
            y = unit(unpacked(batch["x"], dims, kind)) @ axes[:, :grid]
            cell = np.zeros(len(y), dtype=np.int64)
            for k in range(grid):
                cell = cell * 2 * reach + np.floor(y[:, k] / width).astype(np.int64) + reach
            yield batch_of(schema, {"node": batch["node"], "weight": batch["weight"], "x": batch["x"], "cell": cell, "y": y[:, 0]})

    def cut(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= size:
                t = pa.Table.from_batches(held).combine_chunks()
                yield block(t.slice(0, size))
                held, n = t.slice(size).to_batches(), n - size
        if n:
            yield block(pa.Table.from_batches(held))

    def block(t):
        m = unpacked(t["x"], dims, kind)
        y = unit(m) @ axes[:, :BOX]
        nodes, lengths = t["node"].to_numpy(), pc.binary_length(t["x"]).to_numpy() // kind.itemsize
        row = (int(nodes[0]), lengths.astype(np.int32).tobytes(), nodes.astype(np.int64).tobytes(), t["weight"].to_numpy().astype(np.int64).tobytes())
        row += (m.astype(kind).tobytes(), (y.min(axis=0) - SLACK).tolist(), (y.max(axis=0) + SLACK).tolist())
        return batch_of(BLOCKS, {k: [v] for k, v in zip(BLOCKS.names, row)})

    spots = vectors.mapInArrow(coordinates, "node long, weight long, x binary, cell long, y double")
    return spots.repartitionByRange("cell", "y", "node").sortWithinPartitions("cell", "y", "node").mapInArrow(cut, BLOCKS_DDL)


def _tiles(blocks: DataFrame, least: float) -> DataFrame:
    """Pairs of blocks that may hold linked vectors, each pair once: columns of blocks, and the same beginning with b_."""
    other = blocks.select(*[F.col(c).alias(f"b_{c}") for c in blocks.columns])
    gaps = F.zip_with(
        F.zip_with("b_low", "high", lambda x, y: F.greatest(x - y, F.lit(0.0))),
        F.zip_with("low", "b_high", lambda x, y: F.greatest(x - y, F.lit(0.0))),
        lambda x, y: F.greatest(x, y),
    )
    apart = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g)
    # Which of two blocks is the left one depends on their numbers' parities, so that tasks have as many pairs.
    a, b = F.col("block"), F.col("b_block")
    once = F.when((a + b) % 2 == 0, a <= b).otherwise(a > b)
    pairs = blocks.join(other, once & (apart <= 2 - 2 * least + SLACK))
    return pairs.drop("low", "high", "b_low", "b_high")


def links(vectors: DataFrame, axes: np.ndarray, least: float, size: int, kind: np.dtype) -> DataFrame:
    """(node, n, root) by tile, stored."""
    blocks = stored(_blocks(vectors, axes, least, size, kind))

    def run(batches):
        a = None
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if a is None or a[0] != row["block"]:
                    a = row["block"], Side(row, axes, kind)
                same = row["block"] == row["b_block"]
                b = a[1] if same else Side({c[2:]: v for c, v in row.items() if c.startswith("b_")}, axes, kind)
                if (out := compare(a[1], b, same, least)) is not None:
                    yield batch_of(SPOTS, out)

    found = stored(_tiles(blocks, least).mapInArrow(run, "node long, n long, root long"))
    remove(blocks)
    return found


def near_duplicates(vectors: DataFrame, least: float = LEAST, size: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding)."""
    given = vectors.schema["embedding"].dataType
    kind = np.dtype(np.float32 if given.simpleString() == "array<float>" else np.float64)
    x = F.col("embedding").cast("array<float>" if kind == np.float32 else "array<double>")
    good = usable(x) & F.exists(x, lambda v: v != 0)
    rows = _packed(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(good, x).alias("x")), kind)
    different = rows.where("x IS NOT NULL").groupBy("x", "same").agg(F.count("*").alias("weight"), F.min(F.coalesce("vec_id", F.lit(NO_ID))).alias("first"))
    different = stored(different.withColumn("node", F.monotonically_increasing_id()))
    dims = (different.agg(F.max(F.octet_length("x"))).first()[0] or kind.itemsize) // kind.itemsize
    axes = principal_axes(different, "x", dims, unit, lambda column, dims: unpacked(column, dims, kind))
    spots = links(different.select("node", "weight", "x"), axes, least, size, kind)
    nodes = stored(different.drop("x"))
    remove(different)
    members = components(spots.where("node <> root"), "node", "root")
    counts = spots.groupBy("node").agg(F.sum("n").alias("n"))
    placed = nodes.join(members, "node", "left").join(counts, "node", "left")
    placed = placed.select("same", "first", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    low = placed.groupBy("root").agg(F.min("first").alias("low"))
    placed = placed.join(low, "root").select("same", "n_links", F.when(F.col("low") != NO_ID, F.col("low")).alias("low"))
    out = rows.select("vec_id", "same").join(placed, "same", "left")
    alone = F.col("n_links").isNull()
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("low"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")
    )
