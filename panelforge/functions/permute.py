"""Dense row numbers and keyed permutations of them, without a window over all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.sources.shared import materialize

_ROUNDS = 4
_U = np.uint64


def numbered(rows: DataFrame, group: str) -> tuple[DataFrame, dict[int, int]]:
    """rows with `number`, from 0 without gaps in each value of group (an int column of few values), and how many rows each value has.

    Rows are numbered where they lie and written down; each range then starts after the rows of those before it.
    """
    schema = rows.schema.simpleString()[7:-1]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), {}
        for b in batches:
            g = b.column(b.schema.get_field_index(group)).to_numpy()
            at = np.empty(len(g), np.int64)
            for v in np.unique(g):
                mine = np.flatnonzero(g == v)
                at[mine] = np.arange(len(mine)) + done.get(int(v), 0)
                done[int(v)] = done.get(int(v), 0) + len(mine)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(g), part, np.int32)), pa.array(at)], names=[*b.schema.names, "__part", "number"])

    table = materialize(rows.mapInArrow(local, f"{schema}, __part int, number long"), "numbered")
    sizes = table.groupBy(group, "__part").count().orderBy(group, "__part").collect()  # a row for each task and value
    starts, total = [], {}
    for g, part, n in sizes:
        starts.append((g, part, total.get(g, 0)))
        total[g] = total.get(g, 0) + n
    starts = rows.sparkSession.createDataFrame(starts, f"{group} int, __part int, __start long")
    out = table.join(F.broadcast(starts), [group, "__part"])
    return out.withColumn("number", F.col("number") + F.col("__start")).select(*rows.columns, "number"), total


def bijection(numbers: np.ndarray, n: int, key: int) -> np.ndarray:
    """A permutation of 0 to n - 1 that depends on key: a Feistel network over the next power of four; what falls outside goes through it again."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    low, out = _U((1 << half) - 1), numbers.astype(_U)
    open_ = np.ones(len(out), bool)
    with np.errstate(over="ignore"):
        while open_.any():
            left, right = out[open_] >> _U(half), out[open_] & low
            for r in range(_ROUNDS):
                z = (right + _U((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) % (1 << 64))) * _U(0xBF58476D1CE4E5B9)
                z = (z ^ (z >> _U(29))) * _U(0x94D049BB133111EB)
                left, right = right, left ^ ((z ^ (z >> _U(32))) & low)
            out[open_] = left << _U(half) | right
            open_ &= out >= _U(n)
    return out.astype(np.int64)


def shuffled(group: Column, number: Column, repeat: Column, sizes: dict[int, int], seed: int) -> Column:
    """The number of the row that takes a row's place in a repeat, a permutation within each value of group."""

    @F.arrow_udf("long")
    def run(groups: pa.Array, numbers: pa.Array, repeats: pa.Array) -> pa.Array:
        g, k, out = groups.to_numpy(zero_copy_only=False), repeats.to_numpy(zero_copy_only=False), numbers.to_numpy(zero_copy_only=False).copy()
        for v in np.unique(g):
            for r in np.unique(k[g == v]):
                mine = (g == v) & (k == r)
                out[mine] = bijection(out[mine], sizes[int(v)], seed * 1_000_003 + int(v) * 1009 + int(r))
        return pa.array(out)

    return run(group, number, repeat)
