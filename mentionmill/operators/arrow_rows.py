"""Rows of Arrow batches as Python values, column by column."""

from __future__ import annotations

import pyarrow as pa


def values(column: pa.Array) -> list:
    """``to_pylist``, many values at a time where the type allows."""
    kind = column.type
    if pa.types.is_list(kind):
        flat, ends = values(column.values), column.offsets.to_pylist()
        out = [flat[a:b] for a, b in zip(ends, ends[1:])]
        return [x if ok else None for x, ok in zip(out, column.is_valid().to_numpy(zero_copy_only=False).tolist())] if column.null_count else out
    if pa.types.is_string(kind) or (not column.null_count and (pa.types.is_integer(kind) or pa.types.is_boolean(kind))):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def rows(batches):
    """Tuples of the rows of some batches."""
    for batch in batches:
        yield from zip(*map(values, batch.columns))
