"""Cleaning and deduplication of article tables."""

import logging
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressloom.functions import fixed_values as V
from pressloom.functions import text as X

log = logging.getLogger(__name__)


def normalize_column_names(df: DataFrame) -> DataFrame:
    """lower_snake_case names, computed from the schema alone."""
    names = [re.sub(r"\W", "_", re.sub(r"\s+", "_", name.strip().lower())) for name in df.columns]
    return df.toDF(*names)


def date_convention(df: DataFrame, col: str = "date") -> DataFrame:
    """One row: ``day_first_dates`` and ``month_first_dates``, how many dates can be read one way only, ``numeric_dates``,
    and ``day_first``, the convention of the column: the one with more such dates, month first if they are equally many.
    """
    evidence = X.day_first_evidence(F.col(f"`{col}`"))
    found = df.agg(
        F.count_if(evidence == 1).alias("day_first_dates"), F.count_if(evidence == -1).alias("month_first_dates"),
        F.count(evidence).alias("numeric_dates"),
    )
    return found.withColumn("day_first", F.col("day_first_dates") > F.col("month_first_dates"))


def parse_dates(df: DataFrame, col: str = "date", formats=None) -> DataFrame:
    """Text dates to timestamps, null where they cannot be read. A typed column stays as it is.

    The convention of numeric dates (day or month first) is inferred from the whole column by one pass over it, which
    brings one row to the driver, and holds for every row. With ``formats`` the first that fits a row wins instead.
    """
    if col not in df.columns:
        log.warning("no column %r: dates are not parsed", col)
        return df
    if df.schema[col].dataType.typeName() in ("date", "timestamp", "timestamp_ntz"):
        return df
    return df.withColumn(col, _parsed(df, col, formats))


def _parsed(df: DataFrame, col: str, formats):
    if formats:
        return X.parse_timestamp(F.col(col), formats)
    found = date_convention(df, col).first()
    log.info("%s: %s", col, found.asDict())
    return X.parse_timestamp_as(F.col(col), F.lit(found.day_first))


def count_bad_dates(raw: DataFrame, col: str = "date", formats=None) -> DataFrame:
    """How many texts could not be read as dates (and how many were missing to begin with)."""
    return raw.agg(
        F.count_if(F.col(col).isNotNull() & _parsed(raw, col, formats).isNull()).alias("bad_dates"),
        F.count_if(F.col(col).isNull()).alias("missing_dates"),
    )


def _with_columns(df: DataFrame, columns, expression) -> DataFrame:
    return df.withColumns({c: expression(F.col(c)) for c in columns if c in df.columns})


def clean_text_fields(df: DataFrame, columns=V.TEXT_COLUMNS) -> DataFrame:
    return _with_columns(df, columns, X.strip_html)


def preprocess_text_fields(df: DataFrame, columns=V.TEXT_COLUMNS) -> DataFrame:
    return _with_columns(df, columns, X.preprocess_text)


def drop_missing_critical(df: DataFrame, columns=V.TEXT_COLUMNS) -> DataFrame:
    for c in columns:
        if c in df.columns:
            df = df.where(~X.is_blank(F.col(c)))
    return df


def fill_optional_missing(df: DataFrame, defaults=V.OPTIONAL_DEFAULTS) -> DataFrame:
    return df.na.fill({c: v for c, v in defaults.items() if c in df.columns})


def keep_first(df: DataFrame, key: Column, order_by: str) -> DataFrame:
    """One row per key, the one with the smallest ``order_by``.

    ``min_by`` combines on the map side, so a key that holds a third of all rows sends one row per map
    task to the reducer; a window would send all of them to one task. Null is a key like any other.
    """
    kept = df.groupBy(key.alias("_key")).agg(F.min_by(F.struct(*df.columns), F.col(order_by)).alias("_row"))
    return kept.select("_row.*")


def remove_duplicates(df: DataFrame, col: str = "headline", order_by: str = "doc_id") -> DataFrame:
    return keep_first(df, F.col(col), order_by) if col in df.columns else df


def remove_near_duplicates(df: DataFrame, col: str = "headline", order_by: str = "doc_id") -> DataFrame:
    return keep_first(df, X.near_duplicate_key(F.col(col)), order_by) if col in df.columns else df
