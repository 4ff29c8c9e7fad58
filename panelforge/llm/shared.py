"""What the operators of this subpackage share: the shared folder, written tables and Arrow column access."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.sources.shared import materialize, shared_dir

__all__ = ["BLOCK_BYTES", "column_bytes", "give_back", "materialize", "range_index", "reserved", "shared_dir", "text_blocks", "text_documents"]

#: Texts are handed to the numpy kernels in blocks of about so many bytes.
BLOCK_BYTES = 1 << 19


def text_documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator needs, under fixed names, so that further or clashing columns of the input do no harm."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def reserved(df: DataFrame, *names: str) -> DataFrame:
    """df, if it has none of the names that an operator adds; else ValueError."""
    if taken := sorted({n.lower() for n in names} & {c.lower() for c in df.columns}):
        raise ValueError(f"the input has columns under reserved names: {', '.join(taken)}")
    return df


def range_index(cuts: tuple[np.ndarray, ...], keys: tuple[np.ndarray, ...]) -> np.ndarray:
    """How many of the ascending cuts are at or below each key; both are given as columns, the first of which leads."""
    lo, hi = np.searchsorted(cuts[0], keys[0], "left"), np.searchsorted(cuts[0], keys[0], "right")
    last = max(len(cuts[0]) - 1, 0)
    while (open_ := lo < hi).any():  # cuts lie among keys of one leading value: each key halves its span of them
        middle = (lo + hi) // 2
        at, above = np.minimum(middle, last), np.ones(len(lo), bool)
        for c, k in zip(cuts[:0:-1], keys[:0:-1], strict=True):
            above = (k > c[at]) | ((k == c[at]) & above)
        lo, hi = np.where(open_ & above, middle + 1, lo), np.where(open_ & ~above, middle, hi)
    return lo


def give_back() -> None:
    """Returns the memory that Arrow's pool and the allocator keep, as Python workers outlive their tasks and stand beside others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def column_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and the int64 offsets of a string column; nulls are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("")
    width = np.int64 if pa.types.is_large_string(array.type) else np.int32
    _, offsets, data = array.buffers()
    if offsets is None or len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    offs = np.frombuffer(offsets, width)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def text_blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts Arrow batches into runs of rows with about limit bytes of text (one row at least): the rows, their bytes, their offsets."""
    for batch in batches:
        buf, offs = column_bytes(batch.column(batch.schema.get_field_index(text)))
        a, n = 0, batch.num_rows
        while a < n:
            b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
            b = min(b, n)
            yield batch.slice(a, b - a), buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
            a = b
    give_back()
