"""Shared by the operators of this folder: reading a table, columns under private names, word hashes for Arrow tasks."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that one step of a Python task holds at a time; a longer text is a step of its own.
STEP_CHARS = 1_000_000
#: ASCII white space, as the contracts write it.
BLANK = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text column, null as empty."""
    return F.coalesce(F.col(f"`{name}`"), F.lit(""))


def key_of(*parts: Column) -> Column:
    """One text that is never null from columns of any kind; null differs from every value."""
    return F.concat_ws("|", *(F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts))


def stay_only(docs: DataFrame, key: Column, stay: DataFrame, stay_key: Column) -> DataFrame:
    """The rows of ``docs`` whose key is among those of ``stay``, one row for each key, with all their columns.

    The keys are cut to their digest, and both steps use the one shuffle by it.
    """
    name = free_name(docs, "row_key")
    kept = stay.select(F.sha2(stay_key, 256).alias(name))
    return docs.withColumn(name, F.sha2(key, 256)).join(kept, name, "left_semi").dropDuplicates([name]).drop(name)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet, so that a column of the same name in the input survives."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def steps(batch: pa.RecordBatch, text: str = "text", chars: int = STEP_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a step holds about ``chars`` bytes of text, whatever the lengths are."""
    sizes = pa.compute.binary_length(batch.column(text)).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for i, size in enumerate(sizes):
        if i > first and held + size > chars:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += size
    if batch.num_rows > first:
        yield batch.slice(first)


def mix64(x: np.ndarray) -> np.ndarray:
    """Final mixing of 64-bit values (multiply and shift), in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


#: An odd base and its inverse modulo 2^64, for prefix hashes.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


class Prefix:
    """Hashes of any stretches of a byte string from one pass over it."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=self.sums[1:])
        self.inverse = powers(INVERSE, len(data) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes one after another, a zero byte after each, and where each starts (one more at the end)."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=starts[1:])
    return np.frombuffer(b"\0".join([*parts, b""]), np.uint8), starts


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches where ``mask`` holds."""
    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


_BYTES = np.arange(256)
#: Bytes of words: ASCII letters and digits, underscore, and every byte of a character beyond ASCII.
WORD_BYTE = (
    ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122))
    | (_BYTES == 95) | (_BYTES >= 128)
)
