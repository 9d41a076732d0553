"""Whole texts as byte arrays inside Arrow batches, and hashes over their pieces.

Operators that work in Python get Arrow batches from ``DataFrame.mapInArrow`` and see
the UTF-8 bytes of many texts as one numpy array, without a Python object per text or
word. Memory is bounded by ``SLICE_BYTES`` of text (or one longer text) at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Bytes of text that an operator takes up at a time; a longer text is taken alone.
SLICE_BYTES = 1 << 19
#: Rows and bytes of an Arrow batch.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    off = off.astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[off[0] : off[-1]], off - off[0]


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's limits on Arrow batches to ``BATCH_ROWS`` and ``BATCH_BYTES``:
    batches hold whole texts, and by default a batch is ten thousand of them."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``limit`` bytes, or one row."""
    first, n = 0, len(off) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(off, off[first] + limit, "right")) - 1)
        yield first, last
        first = last


def extend(
    df: DataFrame,
    compute: Callable[[], Callable[[pa.RecordBatch], dict[str, pa.Array]]],
    fields: Sequence[T.StructField],
    keep: Sequence[str],
) -> DataFrame:
    """``df`` with new columns from ``compute()(batch)``; of the old ones, ``keep`` stay.

    An old column with the name of a new one gives way to it. ``compute`` is called once
    in each task, so tables that it builds are built once.
    """
    bounded_batches(df.sparkSession)
    new = {f.name for f in fields}
    old = [f for f in df.schema.fields if f.name in keep and f.name not in new]
    schema = T.StructType([*old, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = compute()
        for batch in batches:
            if not batch.num_rows:
                continue
            made = f(batch)
            columns = [batch.column(batch.schema.get_field_index(o.name)) for o in old] + [made[n.name] for n in fields]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.mapInArrow(run, schema)


# --- hashes -------------------------------------------------------------------


def _table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        grown = np.full(size, base, np.uint64)
        grown[0] = 1
        _powers[base] = have = np.cumprod(grown, dtype=np.uint64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums of value times base to the position, from which any stretch can be hashed."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _table(_BASE, len(values)), out=out[1:])
    return out


def stretch_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the stretches [start, end); equal stretches have equal hashes."""
    return mix((sums[end] - sums[start]) * _table(_INVERSE, len(sums))[start])


def all_stretches(sums: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all stretches of ``k`` values, by start."""
    n = len(sums) - k
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mix((sums[k:] - sums[:n]) * _table(_INVERSE, n))


# --- words --------------------------------------------------------------------

#: A-Z to a-z; other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: 0-9, a-z and every byte outside ASCII, after lowering.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[48:58] = WORD_BYTE[97:123] = WORD_BYTE[128:] = True


def runs(flag: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``flag`` within each row, and for each row
    the number of runs before it (one entry more than rows)."""
    n = len(flag)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = flag[:-1]
    before[off[:-1][off[:-1] < n]] = False
    start = np.flatnonzero(flag & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = flag[1:]
    ends = off[1:][off[1:] > 0] - 1
    after[ends] = False
    end = np.flatnonzero(flag & ~after) + 1
    return start, end, np.searchsorted(start, off)
