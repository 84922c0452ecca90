"""Small helper around ``mapInArrow``: Python functions over slices of bounded size."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Rows handed to a function at a time; texts of very different sizes stay small together.
SLICE_ROWS = 512
#: A slice is closed earlier when its buffers reach this many bytes.
SLICE_BYTES = 8 << 20


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch of at most SLICE_ROWS rows, fewer where rows are large."""
    n = batch.num_rows
    if not n:
        return
    step = max(1, min(SLICE_ROWS, int(n * SLICE_BYTES / max(1, batch.nbytes))))
    for i in range(0, n, step):
        yield batch.slice(i, min(step, n - i))


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str) -> DataFrame:
    """Apply a function over column lists. ``make`` runs once a task and returns the function.

    The function takes ``{column: list}`` and gives ``{column: list}`` of ``schema``
    (or an Arrow array in a list's place); the number of rows may change.
    """
    struct = _parse_datatype_string(schema)
    assert isinstance(struct, StructType)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            for part in slices(batch):
                out = function({name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)})
                columns = [x if isinstance(x := out[f.name], pa.Array) else pa.array(x, type=f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays([x if x.type == f.type else x.cast(f.type) for x, f in zip(columns, arrow)], schema=arrow)

    return df.mapInArrow(run, struct)


def _lists(sizes: list[int], values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, *itertools.accumulate(sizes)], type=pa.int32()), values)


def flat(sizes: list[int], values: list, kind: pa.DataType) -> pa.ListArray:
    """``array<…>`` from one flat column. ``sizes``: entries of every row."""
    return _lists(sizes, pa.array(values, type=kind))


def nested(sizes: list[int], **fields: tuple[list, pa.DataType]) -> pa.ListArray:
    """``array<struct<…>>`` from flat columns: far cheaper than lists of dictionaries."""
    return _lists(sizes, pa.StructArray.from_arrays([pa.array(v, type=t) for v, t in fields.values()], names=list(fields)))
