"""Equi-join against a lookup side whose size is checked before it is broadcast."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 256 * 1024 * 1024


def _bytes(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(column)
    elif isinstance(kind, T.ArrayType):
        size = F.aggregate(column, F.lit(0).cast("long"), lambda acc, x: acc + _bytes(x, kind.elementType))
    elif isinstance(kind, T.StructType):
        size = sum((_bytes(column[f.name], f.dataType) for f in kind), F.lit(0))
    else:
        size = F.lit(8)
    return F.coalesce(size.cast("long"), F.lit(0))


def _row_bytes(lookup: DataFrame) -> Column:
    return sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in lookup.schema), F.lit(0))


def fits_broadcast(lookup: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """True when ``lookup`` is small in rows and in bytes; looks at one row more than allowed and no further."""
    rows, size = lookup.limit(max_rows + 1).agg(F.count("*"), F.coalesce(F.sum(_row_bytes(lookup)), F.lit(0))).first()
    return rows <= max_rows and size <= max_bytes


def frequent_keys(lookup: DataFrame, counts: DataFrame, key: str, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(``key``): the keys of most rows, as many as can be broadcast with their rows of ``lookup``; every other key has
    fewer rows than any of them. ``counts``: (``key``, n), a table. What is left joins without a salt: no key of it is large.

    The driver gets a row per distinct ``n``, at most the root of twice their sum.
    """
    widest = lookup.agg(F.max(_row_bytes(lookup))).first()[0] or 1
    room = min(max_rows, max_bytes // widest)
    least, taken = None, 0
    for n, keys in sorted(counts.groupBy("n").agg(F.count("*")).collect(), reverse=True):
        taken += keys
        if taken > room:
            break
        least = n
    return counts.where(F.lit(False) if least is None else F.col("n") >= least).select(key)


def lookup_join(
    big: DataFrame, lookup: DataFrame, key: str, salt_by: str, how: str = "inner", max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Join ``big`` to ``lookup`` on ``key``.

    A small lookup is broadcast. A larger one is shuffled with a salt, taken from ``salt_by`` on the big
    side and spelt out on the lookup side, so that a key in a third of all rows spreads over many tasks: over
    as many as the square root of the shuffle partitions, which keeps the copies of the lookup side few, and
    what is still too large is split by adaptive execution.
    """
    if fits_broadcast(lookup, max_rows):
        return big.join(F.broadcast(lookup), key, how)
    salts = math.isqrt(max(1, int(big.sparkSession.conf.get("spark.sql.shuffle.partitions")))) + 1
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int"))
    copies = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [key, "_salt"], how).drop("_salt")
