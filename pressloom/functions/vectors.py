"""Dense vectors are ``array<double>``; sparse ones are ``array<struct<term_id, weight, ...>>``."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressloom.functions.lambdas import array_sum


def as_doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x
    )


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two dense vectors; 0 when either has no length."""
    length = norm(a) * norm(b)
    return F.when(length == 0, F.lit(0.0)).otherwise(F.try_divide(dot(a, b), length))


def unit(a: Column) -> Column:
    from pressloom.functions.lambdas import let

    return let(
        F.struct(as_doubles(a).alias("v"), norm(a).alias("n")),
        lambda s: F.transform(s["v"], lambda x: F.when(s["n"] == 0, F.lit(0.0)).otherwise(F.try_divide(x, s["n"]))),
    )


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda acc, d: acc + d * d
    )


def sparse_dot(a: Column, b: Column) -> Column:
    """Dot product of two sparse rows, by a hash lookup of the shared term ids."""

    def weights(row):
        return F.map_from_arrays(
            F.transform(row, lambda e: e["term_id"]), F.transform(row, lambda e: e["weight"])
        )

    products = F.map_zip_with(
        weights(a), weights(b), lambda _, x, y: F.coalesce(x, F.lit(0.0)) * F.coalesce(y, F.lit(0.0))
    )
    return array_sum(F.map_values(products))


def vector_to_text(vector: Column) -> Column:
    return F.array_join(F.transform(vector, lambda x: F.format_string("%.6f", x.cast("double"))), ",")


def text_to_vector(text: Column) -> Column:
    return F.split(text, ",").cast("array<float>")
