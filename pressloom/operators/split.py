"""Chronological train / val / test split.

The split needs two cut points in the order (date, id), nulls last - not a rank for every row. Both cut
points come from exact order statistics over the date and the id, after which each row is placed by
comparing it with them: no sort, no window and no shuffle of the rows, and no day that is too big.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressloom.functions import fixed_values as V
from pressloom.operators.order_stats import select_ranks, select_text_rank


def _date_key(df: DataFrame, date_col: str) -> Column:
    kind = df.schema[date_col].dataType.typeName() if date_col in df.columns else None
    if kind == "date":
        return F.unix_date(F.col(date_col)).cast("long")
    if kind in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(F.col(date_col).cast("timestamp"))
    return F.lit(0).cast("long")  # no real date column: the order of the ids decides


def cut_points(df: DataFrame, key: Column, id_col: str, train_ratio: float, val_ratio: float) -> list:
    """(date key, id) of the last train row and of the last val row; None where there is no such row."""
    cuts, sizes = [], {"dated": 0}

    def wanted(n_dates, n_rows):
        train_end = math.floor(n_rows * train_ratio)
        cuts.extend([train_end, train_end + math.floor(n_rows * val_ratio)])
        sizes["dated"] = n_dates
        return cuts

    # Two numbers per row, cached for the few passes; a lost part is computed again from the source.
    is_text = df.schema[id_col].dataType.typeName() == "string"
    keys = df.select(key.alias("day"), F.col(id_col).cast("string" if is_text else "long").alias("id")).persist()
    try:
        by_date = select_ranks(keys, F.col("day"), wanted).get(0, {})
        days = {rank: by_date.get(rank, (None, sizes["dated"])) for rank in cuts if rank > 0}
        if not days:
            return [None, None]
        if is_text:
            on_day = {day: keys.where(F.col("day").eqNullSafe(F.lit(day))) for day, _ in days.values()}
            ids = {r: select_text_rank(on_day[day], F.col("id"), r - below) for r, (day, below) in days.items()}
            return [(days[r][0], ids[r]) if r in days else None for r in cuts]
        needed = F.lit(False)
        for day in {day for day, _ in days.values()}:
            needed = needed | F.col("day").eqNullSafe(F.lit(day))
        in_days = [rank - below for rank, (_, below) in days.items()]
        ids = select_ranks(keys.where(needed), F.col("id"), lambda *_: in_days, F.col("day"))
    finally:
        keys.unpersist()
    return [(days[r][0], ids[days[r][0]][r - days[r][1]][0]) if r in days else None for r in cuts]


def time_based_split(
    df: DataFrame,
    date_col: str = "date",
    id_col: str = "doc_id",
    train_ratio: float = V.TRAIN_RATIO,
    val_ratio: float = V.VAL_RATIO,
) -> DataFrame:
    """Add ``split``. ``df`` is read once for the two cut points and once by whoever uses the result."""
    key = _date_key(df, date_col)
    cuts = cut_points(df, key, id_col, train_ratio, val_ratio)

    def up_to(cut):
        if cut is None:
            return F.lit(False)
        day, last_id = cut
        if day is None:
            return key.isNotNull() | (F.col(id_col) <= last_id)
        return F.coalesce((key < day) | ((key == day) & (F.col(id_col) <= last_id)), F.lit(False))

    return df.withColumn("split", F.when(up_to(cuts[0]), "train").when(up_to(cuts[1]), "val").otherwise("test"))


def split_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("n"))
