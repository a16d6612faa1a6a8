"""Row helpers that the operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space of every contract, as a pattern class.
SPACE = r"[\x20\x09-\x0D]"


def whole(text: str) -> Column:
    """A text column in which null counts as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def utf8(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """The UTF-8 bytes of each value; null is empty."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a column end to end, and where each value starts (one more entry than values); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[at[0] : at[-1]], at - at[0]


def only(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows whose key occurs in `ids` (null matches null), every column as it was."""
    other = ids.select(F.col(key).alias("_key")).distinct()
    return docs.join(other.hint("shuffle_hash"), docs[key].eqNullSafe(other["_key"]), "left_semi")
