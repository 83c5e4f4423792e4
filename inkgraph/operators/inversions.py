"""Pairs in opposite order, counted in parts of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgraph.plans.scratch import written

#: Rows of a part.
PART = 1 << 19


def inversions(begins: np.ndarray, values: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """For each group, rows from one of `begins` to the next, the sum of the products of weights (1 if none) of two rows of which the first has the larger value.

    Values are whole numbers from 0. They are split bit by bit from the highest: among rows that agree above a bit, each row without it
    is behind so many with it; then these rows go apart in their order.
    """
    n, out = len(values), np.zeros(len(begins), np.int64)
    if not n:
        return out
    sizes = np.diff(np.append(begins, n))
    start, stop = np.repeat(begins, sizes), np.repeat(begins + sizes, sizes)
    place = np.arange(n)
    for bit in range(int(values.max()).bit_length() - 1, -1, -1):
        one = (values >> bit & 1).astype(bool)
        ones = np.append(0, np.cumsum(one))
        ahead = ones[:-1] - ones[start]
        if weights is None:
            behind = ahead
        else:
            heavy = np.append(0, np.cumsum(np.where(one, weights, 0)))
            behind = (heavy[:-1] - heavy[start]) * weights
        out += np.add.reduceat(np.where(one, 0, behind), begins)
        middle = stop - (ones[stop] - ones[start])
        to = np.where(one, middle + ahead, place - ahead)
        parts = [values, np.where(one, middle, start), np.where(one, stop, middle), weights]
        for k, old in enumerate(parts):
            if old is not None:
                parts[k] = np.empty_like(old)
                parts[k][to] = old
        values, start, stop, weights = parts
    return out


def _grouped(table: pa.Table, keys: list[str], order: list[str], value: str, weight: str | None = None) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, dict[str, np.ndarray]]:
    """(begins of the groups, their keys, inversions of a value in the order given, the sorted columns)."""
    columns = {c: table.column(c).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) for c in dict.fromkeys([*keys, *order, value, *([weight] if weight else [])])}
    at = np.lexsort([columns[c] for c in [*reversed(order), *reversed(keys)]])
    columns = {c: x[at] for c, x in columns.items()}
    new = np.append(True, np.any([columns[c][1:] != columns[c][:-1] for c in keys], axis=0))
    begins = np.flatnonzero(new)
    found = inversions(begins, np.unique(columns[value], return_inverse=True)[1], columns[weight] if weight else None)
    return begins, [columns[c][begins] for c in keys], found, columns


def opposite_pairs(rows: DataFrame, keys: list[str], p: str, q: str, part: int = PART) -> DataFrame:
    """(keys, n) for n > 0: pairs of rows of a group with a smaller p in one and a smaller q in the other; all columns are whole numbers, rows with a null are left out.

    Rows are dealt by ranges of (p, q) and once more by ranges of (q, p). Two rows are in one range of the first kind, or else in one of the
    second, or in different ranges of both: the first two are counted inside a range, the third from the numbers of rows that two ranges
    share. A task holds a range, however many rows a group or a value has, and no pairs of rows are made.
    """
    names = ", ".join(f"{k} long" for k in keys)

    def inside(table: pa.Table) -> pa.Table:
        _, groups, found, _ = _grouped(table, keys, [p, q], q)
        return pa.table(dict(zip([*keys, "n"], [*groups, found], strict=True)))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        table = pa.Table.from_batches(held)
        begins, groups, found, columns = _grouped(table, keys, [q, p, "_range"], "_range")
        none = [None] * len(begins)
        yield pa.RecordBatch.from_pydict(dict(zip([*keys, "_range", "_other", "n"], [*groups, pa.array(none, pa.int64()), pa.array(none, pa.int64()), found], strict=True)))
        group = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, table.num_rows)))
        top = int(columns["_range"].max()) + 1
        cells, n = np.unique(group * top + columns["_range"], return_counts=True)
        other = np.full(len(cells), table.column("_other")[0].as_py(), np.int64)
        yield pa.RecordBatch.from_pydict(dict(zip([*keys, "_range", "_other", "n"], [*(g[cells // top] for g in groups), cells % top, other, n.astype(np.int64)], strict=True)))

    def apart(table: pa.Table) -> pa.Table:
        _, groups, found, _ = _grouped(table, keys, ["_range", "_other"], "_other", "n")
        return pa.table(dict(zip([*keys, "n"], [*groups, found], strict=True)))

    def in_parts(frame: DataFrame, name: str, make: Callable, parts: int, *order: str) -> DataFrame:
        return make(frame.repartitionByRange(parts, *keys, *order).withColumn(name, F.spark_partition_id().cast("long")))

    known = rows.select(*(F.col(c).cast("long").alias(c) for c in (*keys, p, q))).na.drop()
    known = written(known, "rows")
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-known.count() // part))
    ranges = in_parts(known, "_range", lambda x: written(x, "ranges"), parts, p, q)
    cells = in_parts(ranges, "_other", lambda x: written(x.mapInArrow(across, f"{names}, _range long, _other long, n long"), "cells"), parts, q, p, "_range")
    near = ranges.groupBy("_range").applyInArrow(inside, f"{names}, n long")
    far = cells.where("_range IS NOT NULL").groupBy(*keys).applyInArrow(apart, f"{names}, n long")
    found = near.unionByName(far).unionByName(cells.where("_range IS NULL").select(*keys, "n"))
    return found.groupBy(*keys).agg(F.sum("n").alias("n")).where("n > 0")
