"""Running values inside arrays: where the pieces of a text end and which run they belong to, without a shuffle or a sort of the pieces."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

RUN = StructType().add("run", LongType()).add("place", IntegerType()).add("first", IntegerType())


def _parts(arrays: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The values of all arrays in a row, the size of each array, and where each begins."""
    sizes = pc.fill_null(pc.list_value_length(arrays), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return arrays.flatten().to_numpy(zero_copy_only=False), sizes, np.cumsum(sizes) - sizes


def _back(arrays: pa.Array, sizes: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values, mask=arrays.is_null())


def run_places(new: np.ndarray, mark: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(run, place in it, place of its first marked one or -1, whether a run or an array begins) of all places of arrays of those sizes in a row."""
    begins = np.cumsum(sizes) - sizes
    number = np.cumsum(new.astype(np.int64))
    before = np.concatenate([[0], number])[begins]
    cut = new.copy()
    cut[begins[sizes > 0]] = True
    heads = np.flatnonzero(cut)
    lengths = np.diff(np.append(heads, len(cut)))
    place = np.arange(len(cut)) - np.repeat(heads, lengths)
    none = np.iinfo(np.int32).max
    first = np.minimum.reduceat(np.where(mark, place, none), heads) if len(heads) else heads
    return number - np.repeat(before, sizes), place, np.repeat(np.where(first == none, -1, first), lengths), cut


@F.arrow_udf(ArrayType(LongType()))
def running_sums(numbers: pa.Array) -> pa.Array:
    """For each array of whole numbers without nulls the sums up to each place."""
    values, sizes, begins = _parts(numbers)
    total = np.concatenate([[0], np.cumsum(values.astype(np.int64))])
    return _back(numbers, sizes, pa.array(total[1:] - np.repeat(total[begins], sizes), pa.int64()))


@F.arrow_udf(ArrayType(RUN))
def runs(begin: pa.Array, marked: pa.Array) -> pa.Array:
    """For each place of an array its run, its place in it, and the place of the first marked one in it, null without any.

    begin is true where a run begins, marked has as many values; runs count from 0, or from 1 where the first value begins one.
    """
    new, sizes, _ = _parts(begin)
    number, place, first, _ = run_places(new.astype(bool), marked.flatten().to_numpy(zero_copy_only=False).astype(bool), sizes)
    out = pa.StructArray.from_arrays([pa.array(number, pa.int64()), pa.array(place, pa.int32()), pa.array(first.astype(np.int32), pa.int32(), mask=first < 0)], ["run", "place", "first"])
    return _back(begin, sizes, out)
