"""Profiling of a cleaned table: shape, nulls, value counts, date range, rows lost per step."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def profile_shape(df: DataFrame) -> DataFrame:
    """One row per column with its type, and the size of the whole table on every row."""
    columns = F.array(*[F.struct(F.lit(n).alias("column_name"), F.lit(t).alias("dtype")) for n, t in df.dtypes])
    return (
        df.agg(F.count("*").alias("n_rows"))
        .withColumn("n_columns", F.lit(len(df.columns)))
        .withColumn("c", F.explode(columns))
        .select("c.column_name", "c.dtype", "n_rows", "n_columns")
    )


def profile_nulls(df: DataFrame) -> DataFrame:
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], list(df.columns), "column_name", "null_count")


def profile_value_counts(df: DataFrame, columns=("covid_status", "sentiment")) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    return (
        df.select(*present)
        .unpivot([], present, "column_name", "value")
        .where(F.col("value").isNotNull())
        .groupBy("column_name", "value")
        .agg(F.count("*").alias("n"))
    )


def profile_date_range(df: DataFrame, col: str = "date") -> DataFrame:
    return df.agg(F.min(col).alias("min_date"), F.max(col).alias("max_date"))


def dedup_report(df: DataFrame, key: Column, step: str) -> DataFrame:
    """Rows before and after keeping one row per key, counted in one pass with map-side combine."""
    return (
        df.groupBy(key.alias("key"))
        .agg(F.count("*").alias("n"))
        .agg(F.lit(step).alias("step"), F.sum("n").alias("rows_before"), F.count("*").alias("rows_after"))
        .withColumn("dropped", F.col("rows_before") - F.col("rows_after"))
    )
