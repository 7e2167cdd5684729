"""Ordered folds: what an event does depends on what the events of its key did before it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def folded(events: DataFrame, keys: list[str], order: list[str], start: Callable[[dict], Any], step: Callable[[Any, dict], dict | None], schema: str, carried: list[str] | None = None, first: list[str] | None = None) -> DataFrame:
    """``step``'s row for each event, None being none, in the order of its key; ``start`` makes a key's state from its first event.

    ``step`` changes the state in place.  Events are dealt by key and stream in order through their task, which holds one
    state and one batch: a hot key takes its task's time, since order is what is asked for, but no more memory than
    others.  ``order`` must tell the events of a key apart; null keys are one key.

    Columns ``carried`` go into the event's row as they are, and ``step`` sees them only where they are keys or in ``order``;
    columns in ``first`` are seen by ``start`` alone.
    """
    to, carried, first = to_arrow_schema(StructType.fromDDL(schema)), carried or [], first or []
    own = pa.schema([f for f in to if f.name not in carried])
    seen = [c for c in events.columns if c in {*keys, *order} or c not in {*carried, *first}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out, places = [], []
            for i, row in enumerate(batch.select(seen).to_pylist()):
                now = tuple(row[k] for k in keys)
                if state is None or now != key:
                    key, state = now, start(row | {c: batch[c][i].as_py() for c in first})
                told = step(state, row)
                if told is not None:
                    out.append(told)
                    places.append(i)
            if out:
                computed, copied = pa.RecordBatch.from_pylist(out, schema=own), batch.select(carried).take(pa.array(places))
                yield pa.RecordBatch.from_arrays([copied[f.name].cast(f.type) if f.name in carried else computed[f.name] for f in to], schema=to)

    return events.repartition(*keys).sortWithinPartitions(*[F.col(c) for c in [*keys, *order]]).mapInArrow(run, schema)
