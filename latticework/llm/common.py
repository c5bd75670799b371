"""What the corpus operators share: Arrow access to text, words, seeded hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir, stored

#: Bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = b" \t\n\x0b\x0c\r"
#: bytes.translate table that lower-cases A-Z and nothing else.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shares(spark: SparkSession, rows: int, most: int) -> int:
    """Partitions for so many rows, at most about most in each; no fewer than shuffles have."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // most))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, changed where df has a column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all values, offsets): UTF-8 without a copy; a null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_binary())
    if arr.null_count:
        arr = arr.fill_null(b"")
    buffers = arr.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[arr.offset : arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def texts(arr: pa.Array) -> list[bytes]:
    """UTF-8 of each value; a null counts as empty."""
    return [x or b"" for x in arr.cast(pa.large_binary()).to_pylist()]


def remainder(column: str, by: int) -> Column:
    """crc32 of the id written as text, modulo by; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % by


def crc32_sql(text: str) -> str:
    """DuckDB expression: crc32 of an ASCII string, a bit at a time."""
    bits = f"flatten(list_transform(range(1, length({text}) + 1), lambda i: [ascii(substr({text}, i, 1)), 0, 0, 0, 0, 0, 0, 0]))"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {bits}::bigint[]), lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295::bigint)"


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


__all__ = ["LOWER", "SPACES", "crc32_sql", "documents", "fresh", "mix", "remainder", "shared_dir", "shares", "stored", "texts", "utf8"]
