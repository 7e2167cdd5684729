"""Row functions over Arrow columns, a slice of rows at a time: a batch of long texts is never all Python objects at once."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc

ROWS = 128
#: Mean bytes of texts that are looked through for equal ones: a second table of long texts would cost their memory again.
SHORT = 256


def each(function: Callable, kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """``function`` of each row's values as an array of a type; of one column of short texts, each different one is read once."""
    if len(columns) == 1 and pa.types.is_string(columns[0].type) and 1 < len(columns[0]) and columns[0].nbytes <= SHORT * len(columns[0]):
        texts = columns[0].dictionary_encode(null_encoding="encode")
        if 2 * len(texts.dictionary) <= len(texts):
            return pc.take(each(function, kind, texts.dictionary), texts.indices)
    parts = []
    for at in range(0, len(columns[0]), ROWS):
        rows = zip(*(c.slice(at, ROWS).to_pylist() for c in columns), strict=True)
        parts.append(pa.array([function(*r) for r in rows], kind))
    return pa.concat_arrays(parts) if parts else pa.array([], kind)
