"""Exact order statistics without sorting a group in one task.

A histogram over the value range finds the bucket that holds a wanted rank; the range then shrinks to
that bucket, until it is a single value. Each pass is one aggregation with map-side combine over one or
two columns, and at most ``MAX_BUCKETS`` rows come to the driver, however many rows one group holds.
The bucket function is monotone in floating point too, so the result is exact, ties included.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BUCKETS = 65536
INFINITY = float("inf")


def _offset(value: Column, lo, hi) -> tuple[Column, float]:
    """Distance of ``value`` from ``lo`` and the width of the range, safe for the full long range."""
    width = hi - lo
    if isinstance(width, int) and width < 2**62:
        return (value - F.lit(lo)).cast("double"), float(width)
    return value.cast("double") - F.lit(float(lo)), float(width)


def select_ranks(
    df: DataFrame, value: Column, ranks: Callable[[int, int], list[int]], group: Column | None = None
) -> dict:
    """Values at 1-based ranks: ``{group: {rank: (value, rows strictly below it)}}``.

    ``value`` is an integral or double column, ``ranks`` maps the number of a group's values, and of all
    its rows, to the wanted ranks. Nulls come after every value, and a rank among them is left out of the
    result. The number of groups must be small; each one adds a driver row.
    """
    rows = df.select((F.lit(0) if group is None else group).alias("g"), value.alias("v"))
    # The infinities are end buckets of their own: the range between them has a width.
    finite = F.when((F.col("v") != -INFINITY) & (F.col("v") != INFINITY), F.col("v"))
    limits = (
        rows.groupBy("g")
        .agg(
            F.count("v").alias("n"), F.count("*").alias("n_rows"), F.min(finite).alias("lo"), F.max(finite).alias("hi"),
            F.count_if(F.col("v") == -INFINITY).alias("n_lowest"), F.count_if(F.col("v") == INFINITY).alias("n_highest"),
        )
        .collect()
    )

    found = {r["g"]: {} for r in limits}
    open_ranges = {}  # (group, lo, hi) -> (rows below lo, wanted ranks)

    def place(g, lo, hi, below, wanted):
        if not wanted:
            return
        if lo == hi:
            found[g].update({rank: (lo, below) for rank in wanted})
        else:
            open_ranges[(g, lo, hi)] = (below, wanted)

    for r in limits:
        g, top = r["g"], r["n"] - r["n_highest"]
        wanted = [k for k in sorted(set(ranks(r["n"], r["n_rows"]))) if 1 <= k <= r["n"]]
        place(g, -INFINITY, -INFINITY, 0, [k for k in wanted if k <= r["n_lowest"]])
        place(g, r["lo"], r["hi"], r["n_lowest"], [k for k in wanted if r["n_lowest"] < k <= top])
        place(g, INFINITY, INFINITY, top, [k for k in wanted if k > top])

    while open_ranges:
        todo, open_ranges = open_ranges, {}
        buckets = max(16, MAX_BUCKETS // len(todo))
        slot, bucket = F.lit(None).cast("int"), F.lit(None).cast("int")
        for i, (g, lo, hi) in enumerate(todo):
            inside = F.col("g").eqNullSafe(F.lit(g)) & F.col("v").between(F.lit(lo), F.lit(hi))
            distance, width = _offset(F.col("v"), lo, hi)
            position = F.least((distance / F.lit(width) * F.lit(float(buckets))).cast("int"), F.lit(buckets - 1))
            slot = F.when(inside, F.lit(i)).otherwise(slot)
            bucket = F.when(inside, position).otherwise(bucket)
        histogram = (
            rows.select(slot.alias("slot"), bucket.alias("bucket"), "v")
            .where(F.col("slot").isNotNull())
            .groupBy("slot", "bucket")
            .agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
            .collect()
        )
        by_slot = {}
        for h in histogram:
            by_slot.setdefault(h["slot"], []).append(h)
        for i, ((g, _, _), (below, wanted)) in enumerate(todo.items()):
            for h in sorted(by_slot[i], key=lambda h: h["bucket"]):
                place(g, h["lo"], h["hi"], below, [k for k in wanted if below < k <= below + h["n"]])
                below += h["n"]
    return found


TEXT_STEP = 7


def select_text_rank(df: DataFrame, text: Column, rank: int) -> str:
    """The text at a 1-based rank among non-null texts, in byte order.

    The seven bytes after the common prefix of all texts become a number whose rank is looked up; the rows that share
    that number go on, until all of them are equal.
    """
    rows = df.select(F.encode(text, "UTF-8").alias("b"))
    while True:
        lowest, highest = map(bytes, rows.agg(F.min("b"), F.max("b")).first())
        if lowest == highest:
            return lowest.decode("utf-8")
        at = next((i for i, (x, y) in enumerate(zip(lowest, highest)) if x != y), len(lowest)) + 1
        # A byte is a digit of 1 to 256 and a missing one 0, so a prefix comes before what continues it.
        code = F.lit(0).cast("long")
        for i in range(at, at + TEXT_STEP):
            byte = F.conv(F.hex(F.substring("b", i, 1)), 16, 10).cast("long")
            code = code * 257 + F.when(F.length("b") >= i, byte + 1).otherwise(0)
        wanted = rank
        value, below = select_ranks(rows, code, lambda *_: [wanted])[0][wanted]  # noqa: B023
        rank, rows = rank - below, rows.where(code == value)


def exact_medians(df: DataFrame, value: Column, group: Column) -> dict:
    """Median of every group, the mean of the two middle values when the count is even."""
    found = select_ranks(df, value, lambda n, _: [(n + 1) // 2, n // 2 + 1], group)
    return {g: (lambda vs: (min(vs) + max(vs)) / 2)([v for v, _ in by_rank.values()]) for g, by_rank in found.items() if by_rank}
