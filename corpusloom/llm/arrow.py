"""Running functions over Arrow record batches, with bounded memory.

Spark hands a task's rows to Python as Arrow batches. The helpers here turn a
function over plain Python rows, or over the rows of one sorted run, into a
mapInArrow over those batches. State between batches is what the caller keeps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows that are given back to Spark in one batch.
OUT_ROWS = 2000


def schema_of(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)  # noqa: SLF001


def map_rows(df: DataFrame, function: Callable[[Iterator[tuple]], Iterator[tuple]], ddl: str) -> DataFrame:
    """mapInArrow with an iterator over row tuples in and out; rows stream through."""
    types = schema_of(ddl)
    arrow = to_arrow_schema(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for at in range(0, batch.num_rows, OUT_ROWS):
                    part = batch.slice(at, OUT_ROWS)
                    yield from zip(*(c.to_pylist() for c in part.columns), strict=True)

        held: list[tuple] = []
        for row in function(rows()):
            held.append(row)
            if len(held) >= OUT_ROWS:
                yield to_batch(held, arrow)
                held = []
        if held:
            yield to_batch(held, arrow)

    return df.mapInArrow(run, types)


def to_batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
