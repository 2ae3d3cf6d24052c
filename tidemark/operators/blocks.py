"""Arrow batches of rows sorted by some keys, cut where the keys change."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def key_blocks(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that end where a group of equal ``keys`` ends, with the number of the group of each row. Input is sorted by ``keys``."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        new = _changes(held, keys)
        if len(new) > 1:
            cut = int(new[-1])
            yield held.slice(0, cut), _numbers(new[:-1], cut)
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield held, _numbers(_changes(held, keys), held.num_rows)


def _changes(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Rows at which a key differs from the row before, the first row included."""
    n = table.num_rows
    differs = np.zeros(n, bool)
    if n:
        differs[0] = True
    for k in keys:
        codes = table.column(k).combine_chunks()
        if pa.types.is_string(codes.type) or pa.types.is_large_string(codes.type):
            codes = codes.dictionary_encode().indices
        values = codes.to_numpy(zero_copy_only=False)
        differs[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(differs)


def _numbers(starts: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
