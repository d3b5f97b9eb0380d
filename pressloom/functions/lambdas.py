"""Small helpers around Spark's higher-order functions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times inside ``body``.

    A column that is mentioned inside a lambda is evaluated again for every array element; a lambda
    variable is not. ``let`` turns the former into the latter.
    """
    return F.transform(F.array(value), body)[0]


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def plus_zero(value: Column) -> Column:
    """Turn -0.0 into 0.0 so that equal results print and hash the same."""
    return F.when(value == 0, F.lit(0.0)).otherwise(value)


def rounded(value: Column, digits: int = 6) -> Column:
    return plus_zero(F.round(value, digits))


def explode_once(df: DataFrame, keep: list, array: Column, name: str) -> DataFrame:
    """``keep`` plus one row per element of a computed array of non-null elements.

    A plain ``explode`` makes the optimizer add filters on the array's size and nullness, and push them
    below the projection that computes it: the array would be built three times per row. The outer form
    has no such filters, and the rows of empty arrays are dropped by a test on the element.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def inline_once(df: DataFrame, keep: list, structs: Column, field: str) -> DataFrame:
    """The same for an array of structs, spelt out as columns; ``field`` is one that is never null."""
    return df.select(*keep, F.inline_outer(structs)).where(F.col(field).isNotNull())


def posexplode_once(df: DataFrame, keep: list, array: Column, pos: str, name: str) -> DataFrame:
    """The same for an array with the position of each element."""
    return df.select(*keep, F.posexplode_outer(array).alias(pos, name)).where(F.col(pos).isNotNull())
