"""Arrow batches: functions over them as Columns, and lists of structs from flat columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from redactory.session import ship_package


def arrow(function: Callable[..., pa.Array], kind: str, inputs: int):
    """A UDF that calls function(array, ...) once for each Arrow batch of its input columns."""

    def run(batches: Iterator) -> Iterator[pa.Array]:
        for b in batches:
            yield function(*b) if isinstance(b, tuple) else function(b)

    each = Iterator[pa.Array] if inputs == 1 else Iterator[tuple[(pa.Array,) * inputs]]
    run.__annotations__ = {"batches": each, "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind)


def batched(function: Callable[..., pa.Array], kind: str, *columns: Column) -> Column:
    """A Column of function(array, ...) over Arrow batches of columns."""
    ship_package(SparkSession.active())
    return arrow(function, kind, len(columns))(*columns)


def strings(array: pa.Array) -> list[str]:
    """Python strings, null as empty."""
    return [x if x is not None else "" for x in array.to_pylist()]


def offsets_of(sizes: Iterable[int]) -> pa.Array:
    return pa.array(np.cumsum([0, *sizes]), pa.int32())


def lists(rows: Sequence[Sequence[tuple]], names: Sequence[str], kinds: Sequence[pa.DataType]) -> pa.ListArray:
    """array<struct> of rows of tuples, built column by column."""
    flat = [x for r in rows for x in r]
    columns = list(zip(*flat, strict=True)) if flat else [()] * len(names)
    inner = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(names))
    return pa.ListArray.from_arrays(offsets_of(map(len, rows)), inner)


def flat_of(array: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """The items of all lists of an array, and where each list begins (one more at the end); null is empty."""
    return array.flatten(), np.cumsum(np.append(0, array.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
