"""Vectors in columns: which are usable, how to read them in tasks, principal axes."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(x: Column) -> Column:
    """True for vectors without null or non-finite components; false for a null vector."""
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(finite, F.lit(False))


def matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    """A column of vectors as rows of doubles; shorter ones end in zeros."""
    lengths = np.asarray(pc.list_value_length(column))
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lengths == dims).all():
        return values.reshape(-1, dims)
    out = np.zeros((len(lengths), dims))
    out[np.arange(dims) < lengths[:, None]] = values
    return out


def principal_axes(vectors: DataFrame, column: str, dims: int, rows=lambda m: m, read=matrix) -> np.ndarray:
    """Axes by descending energy, as columns: eigenvectors of the sum of outer products over all vectors.

    Tasks send dims x dims sums, which Spark adds up: what the driver gets doesn't grow with the rows.
    """
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("s", pa.float64())])

    def sums(batches):
        total = np.zeros((dims, dims))
        for batch in batches:
            m = rows(read(batch[column], dims))
            total += m.T @ m
        if total.any():
            i, j = np.triu_indices(dims)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], schema=schema)

    out = np.zeros((dims, dims))
    for r in vectors.select(column).mapInArrow(sums, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["s"]
    return np.linalg.eigh(out)[1][:, ::-1]
