"""Folds over the rows of a key in order, for decisions that rest on the ones before.

A key's rows go to one task, sorted there by Spark (which spills), and pass it batch by batch: what is held is the state of one key and one
batch, however many rows the key has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame


def fold(rows: DataFrame, key: list[str], order: list[str], begin: Callable[[], Any], step: Callable[[Any, dict], tuple], added: str) -> DataFrame:
    """rows with columns added, as a DDL string says: what ``step(state, row)`` returns for each row of a key, in order. ``step`` changes the state.

    Null keys are a key of their own; ties in the order go as they come.
    """
    new = rows.sparkSession.createDataFrame([], added)
    kinds = [(f.name, f.type) for f in new.toArrow().schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            found: list[tuple] = []
            for row in batch.to_pylist():
                at = tuple(row[k] for k in key)
                if state is None or at != now:
                    now, state = at, begin()
                found.append(step(state, row))
            cols = [pa.array([f[k] for f in found], kind) for k, (_, kind) in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, *(name for name, _ in kinds)])

    schema = rows.schema
    for f in new.schema:
        schema = schema.add(f)
    return rows.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, schema)
