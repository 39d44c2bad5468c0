"""Ordered folds over the rows of a key: what depends on the rows before, in one pass over sorted rows.

A task gets whole keys, sorted, and holds one state; no key's rows are ever collected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

#: Rows of an output batch.
ROWS = 4096

Step = Callable[[dict], Iterator[dict]]


def fold(df: DataFrame, keys: list[str], order: list[str | Column], start: Callable[[], object], schema: str) -> DataFrame:
    """Rows (``schema``) of a fold. ``start`` makes the state of a key: it has ``take(row)`` and ``end()``, which give rows as dicts."""
    names = df.columns
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []
        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = dict(zip(names, values, strict=True))
                now = tuple(row[k] for k in keys)
                if state is None or now != key:
                    if state is not None:
                        out += state.end()
                    key, state = now, start()
                out += state.take(row)
                if len(out) >= ROWS:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out = []
        if state is not None:
            out += state.end()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def kind_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def typed(df: DataFrame, columns: list[str]) -> str:
    """The schema text of some of a table's columns."""
    return ", ".join(f"{c} {kind_of(df, c)}" for c in columns)

