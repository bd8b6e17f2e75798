"""Sums of arrays over tasks: the one primitive that the iterative jobs' block algebra needs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.checkpoints import cleaned

#: Doubles in a slice of an array that is summed.
SLICE = 1 << 16
#: Groups of tasks whose sums are added first.
FAN = 32


def block_sums(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Runs ``work`` over each task's Arrow batches and adds up the arrays that it returns, name by name.

    Arrays are cut into slices that are added in tasks, first within ``FAN`` groups of tasks and then over these, one slice
    at a time, so that neither a worker nor the driver holds more than a copy of a sum, whatever the number of tasks. Shapes
    are the model's (genes, dimensions, clusters, samples), never the number of spots.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.array([TaskContext.get().partitionId() % FAN], pa.int32())
        for name, value in work(batches).items():
            flat = np.ascontiguousarray(value, np.float64).ravel()
            for k in range(0, max(1, len(flat)), SLICE):
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k], pa.int64()), group, pa.array([list(value.shape)], pa.list_(pa.int32())), pa.array([flat[k : k + SLICE].tobytes()], pa.binary())], names=["name", "at", "group", "shape", "part"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, last = None, None
        for b in batches:
            for part in b.column(b.schema.get_field_index("part")):
                x = np.frombuffer(part.as_buffer(), np.float64)
                total = x.copy() if total is None else total + x
            last = b.slice(0, 1) if b.num_rows else last
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()) if n == "part" else last.column(i) for i, n in enumerate(last.schema.names)], names=last.schema.names)

    kind = "name string, at long, group int, shape array<int>, part binary"
    found: dict[str, dict[int, bytes]] = {}
    shapes = {}
    with cleaned(df.sparkSession):
        parts = df.mapInArrow(run, kind).groupBy("name", "at", "group").applyInArrow(add, kind)
        rows = parts.groupBy("name", "at").applyInArrow(add, kind).collect()
    for r in rows:
        found.setdefault(r["name"], {})[r["at"]] = r["part"]
        shapes[r["name"]] = r["shape"]
    return {k: np.concatenate([np.frombuffer(v[a], np.float64) for a in sorted(v)]).reshape(shapes[k]) for k, v in found.items()}


def vectors(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """An array column without NULLs, all of one length, as a matrix."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 0))


def codes(batch: pa.RecordBatch, name: str, values: list[str]) -> np.ndarray:
    """Places of a text column's values in a list."""
    at = {v: i for i, v in enumerate(values)}
    return np.array([at[x] for x in batch.column(batch.schema.get_field_index(name)).to_pylist()], np.int64)


class Sparse:
    """Rows of a batch with ``idx`` and ``val`` arrays."""

    def __init__(self, batch: pa.RecordBatch):
        idx, val = (batch.column(batch.schema.get_field_index(k)) for k in ("idx", "val"))
        self.n = len(idx)
        self.idx = idx.flatten().to_numpy(zero_copy_only=False)
        self.val = val.flatten().to_numpy(zero_copy_only=False)
        self.first = idx.offsets.to_numpy().astype(np.int64)
        self.first = self.first - self.first[0]
        self.row = np.repeat(np.arange(self.n), np.diff(self.first))

    def dense(self, p: int, block: slice) -> np.ndarray:
        """Some rows as a matrix."""
        low, high = self.first[block.start], self.first[block.stop]
        out = np.zeros((block.stop - block.start, p))
        out[self.row[low:high] - block.start, self.idx[low:high]] = self.val[low:high]  # a row has a gene once
        return out

    def blocks(self, size: int = 512) -> Iterator[slice]:
        for k in range(0, self.n, size):
            yield slice(k, min(self.n, k + size))


def sparse_rows(expr: DataFrame, genes: DataFrame, by: list[str]) -> DataFrame:
    """One row a spot, ``idx`` (from 0, sorted) and ``val``; ``genes (gene, gene_idx)`` from 1. The one large shuffle.

    Rows with a NULL key take no part; a spot's repeated gene counts with its sum.
    """
    listed = expr.where(F.forall(F.array(*by), lambda x: x.isNotNull())).join(genes.select("gene", "gene_idx"), "gene")
    listed = listed.groupBy(*by, "gene_idx").agg(F.sum("value").alias("value"))
    cells = F.array_sort(F.collect_list(F.struct((F.col("gene_idx") - 1).cast("int").alias("i"), F.col("value").alias("v"))))
    return listed.groupBy(*by).agg(cells.alias("c")).select(*by, F.col("c.i").alias("idx"), F.col("c.v").alias("val"))
