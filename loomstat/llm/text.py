"""Words of UTF-8 texts inside Arrow batches, folds and bounded samples."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# A-Z to a-z, everything else as it is
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
# the same, and every ASCII character but letters and digits becomes a space
ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a batch as one byte array and the n + 1 offsets into it; NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    array = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = array.buffers()
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def texts(column: pa.Array) -> list[bytes]:
    """The texts of a batch as bytes; NULL is empty."""
    raw, at = parts(column)
    whole = raw.tobytes()
    return [whole[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def fold(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``; NULL keys are in fold 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % n, F.lit(0))


def row_id(key: Column, text: Column) -> Column:
    """128-bit digest of a row's key and text, NULL being a value: rows share it only if they agree in both."""
    name = key.cast("string")
    named = F.concat(F.octet_length(name).cast("string"), F.lit(":"), name)
    whole = F.concat(F.coalesce(named, F.lit("-")), F.coalesce(F.concat(F.lit("+"), text), F.lit("-")))
    return F.unhex(F.md5(whole.cast("binary")))


def sample_below(key: Column, share: float) -> Column:
    """True for about ``share`` of the keys, by hash, so the same rows on every run."""
    cut = int(min(max(share, 0.0), 1.0) * (1 << 30))
    return F.pmod(F.xxhash64(key.cast("string"), F.lit("sample")), F.lit(1 << 30)) < cut


def batches(column: pa.Array, most_bytes: int):
    """Index ranges of consecutive rows of up to ``most_bytes`` of text (or one longer row)."""
    _, at = parts(column)
    begin = 0
    while begin < len(at) - 1:
        end = int(np.searchsorted(at, at[begin] + most_bytes, side="right")) - 1
        end = max(end, begin + 1)
        yield begin, end
        begin = end
