"""Summary statistics, strategy comparison, qualitative review and the Markdown report."""

import logging

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressloom.functions import fixed_values as V
from pressloom.operators.order_stats import exact_medians

log = logging.getLogger(__name__)


def _present(df: DataFrame, metrics) -> list[str]:
    return [m for m in metrics if m in df.columns]


def _number(c: str) -> Column:
    """NaN is no measurement; Spark's aggregates skip null only."""
    return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))


def _stats(c: str) -> Column:
    return F.struct(F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"))


def summary_long(df: DataFrame, keys=("split",), metrics=V.METRICS) -> DataFrame:
    """One row per key and metric with mean, std, min, median, max.

    One pass aggregates all metrics side by side; only its few result rows are turned into a row per metric. Spark's
    own median holds a whole group in memory; here it comes from order statistics over histograms, whatever the size
    of the group. Keys are report keys: a split and a strategy, so the lookup has a row per report line.
    ``df`` is read more than once: pass a table, not a long plan.
    """
    keys, metrics = list(keys), _present(df, metrics)
    key_text = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    numbers = df.select(*keys, *[_number(m).alias(m) for m in metrics])
    lines = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("stats")) for m in metrics])
    wide = numbers.groupBy(*keys).agg(*[_stats(m).alias(m) for m in metrics])
    table = wide.select(*keys, F.explode(lines).alias("line")).select(*keys, "line.metric", "line.stats.*")

    line = F.concat_ws(" ", "metric", "_keys")
    values = numbers.select(key_text.alias("_keys"), *metrics).unpivot(["_keys"], metrics, "metric", "value")
    medians = exact_medians(values, F.col("value"), line)
    lookup = df.sparkSession.createDataFrame(list(medians.items()), "_line string, median double")
    table = table.withColumn("_keys", key_text).withColumn("_line", line).join(lookup, "_line", "left")
    return table.select(*keys, "metric", *V.SUMMARY_STATS)


def summary_by_strategy(df: DataFrame, metrics=V.METRICS) -> DataFrame:
    """One row per split and strategy, columns ``<metric>_<stat>``; rows without a strategy do not count.

    A table without the strategy column has no strategies to compare: it gets the long summary, a row per metric.
    """
    if "prompt_strategy" not in df.columns:
        return summary_long(df, ["split"], metrics)
    metrics = _present(df, metrics)
    keys = ["split", "prompt_strategy"]
    long = summary_long(df.where(F.col("prompt_strategy").isNotNull()), keys, metrics)
    return long.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("metric") == m, F.col(s))).alias(f"{m}_{s}")
            for m in metrics
            for s in V.SUMMARY_STATS
        ]
    )


def combine_summaries(summaries: list[DataFrame]) -> DataFrame:
    first, *rest = summaries
    for other in rest:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def strategy_means(summary: DataFrame) -> DataFrame:
    """(split, metric, prompt_strategy, mean) from a wide summary."""
    means = {c: c[: -len("_mean")] for c in summary.columns if c.endswith("_mean")}
    narrow = summary.select("split", "prompt_strategy", *[F.col(c).alias(m) for c, m in means.items()])
    return narrow.unpivot(["split", "prompt_strategy"], list(means.values()), "metric", "mean")


def compare_strategies(summary: DataFrame) -> DataFrame:
    """Mean per strategy side by side, with the best strategy of every split and metric (ties by name)."""
    means = strategy_means(summary).where(F.col("mean").isNotNull())
    sides = [F.max(F.when(F.col("prompt_strategy") == s, F.col("mean"))).alias(s) for s in V.STRATEGY_TEMPLATES]
    best = F.min_by("prompt_strategy", F.struct(-F.col("mean"), F.col("prompt_strategy"))).alias("best_strategy")
    return means.groupBy("split", "metric").agg(*sides, best)


def delta_vs_baseline(summary: DataFrame, strategy: str = V.DEFAULT_STRATEGY, baseline: str = "structured") -> DataFrame:
    """Metric difference of one strategy to a baseline, per split."""
    pivoted = strategy_means(summary).groupBy("split", "metric").pivot("prompt_strategy", [baseline, strategy]).agg(F.max("mean"))
    return pivoted.select(
        "split",
        "metric",
        F.col(baseline).alias("baseline_mean"),
        F.col(strategy).alias("strategy_mean"),
        (F.col(strategy) - F.col(baseline)).alias("delta"),
    )


def _samples(df: DataFrame, rank_col: str, k: int, id_col: str, best: bool) -> DataFrame | None:
    if rank_col not in df.columns:
        log.warning("no column %r: the review is skipped", rank_col)
        return None
    score = _number(rank_col)
    order = [F.desc_nulls_last("score"), F.asc("id")] if best else [F.asc_nulls_first("score"), F.desc("id")]
    headline = F.col("headline") if "headline" in df.columns else F.lit("")
    split = F.col("split") if "split" in df.columns else F.lit("all")
    rows = df.select(
        split.alias("split"),
        F.col(id_col).alias("id"),
        score.alias("score"),
        F.substring(headline, 1, V.HEADLINE_CHARS).alias("headline"),
        F.substring("generated_text", 1, V.GENERATED_CHARS).alias("generated"),
    )
    # row_number <= k is kept per task ahead of the shuffle (window group limit): no split is sorted whole.
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("split").orderBy(*order))).where(F.col("rank") <= k)


def top_k_samples(df: DataFrame, rank_col: str = "bertscore_f1", k: int = V.TOP_K, id_col: str = "id") -> DataFrame | None:
    return _samples(df, rank_col, k, id_col, True)


def bottom_k_samples(df: DataFrame, rank_col: str = "bertscore_f1", k: int = V.TOP_K, id_col: str = "id") -> DataFrame | None:
    """The tail of the same order: missing scores come last, so they are here first (rank 1 is the very last)."""
    return _samples(df, rank_col, k, id_col, False)


def _cell(df: DataFrame, c: str) -> Column:
    if df.schema[c].dataType.typeName() in ("double", "float"):
        return F.coalesce(F.format_string("%.4f", F.col(c).cast("double")), F.lit("nan"))
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def markdown_lines(summary: DataFrame, splits, title: str = "Evaluation Report") -> DataFrame:
    """The report as (line_no, line). A summary has a row per split and strategy, so it fits one partition."""
    spark = summary.sparkSession
    columns = summary.columns
    order_by = next((c for c in ("prompt_strategy", "metric") if c in columns), columns[0])
    fixed, order = [(0, 0, 0, f"# {title}"), (0, 0, 1, ""), (0, 0, 2, "---"), (0, 0, 3, "")], {}
    filled = {r["split"] for r in summary.select("split").distinct().collect()}
    for i, split in enumerate(splits, start=1):
        order[split] = i
        fixed += [(i, 0, 0, f"## {split.capitalize()} Set Results"), (i, 0, 1, "")]
        if split in filled:
            fixed += [(i, 1, 0, "| " + " | ".join(columns) + " |"), (i, 1, 1, "|" + "---|" * len(columns))]
        else:
            fixed += [(i, 1, 0, "_No results available._")]
        fixed += [(i, 3, 0, ""), (i, 3, 1, "---"), (i, 3, 2, "")]
    section = F.lit(None).cast("int")
    for split, i in order.items():
        section = F.when(F.col("split") == split, F.lit(i)).otherwise(section)
    body = summary.select(
        section.alias("section"),
        F.lit(2).alias("part"),
        F.row_number().over(Window.partitionBy("split").orderBy(order_by)).alias("nr"),
        F.concat(F.lit("| "), F.concat_ws(" | ", *[_cell(summary, c) for c in columns]), F.lit(" |")).alias("line"),
    ).where(F.col("section").isNotNull())
    lines = spark.createDataFrame(fixed, "section int, part int, nr int, line string").unionByName(body)
    place = F.row_number().over(Window.orderBy("section", "part", "nr"))
    return lines.select(place.alias("line_no"), "line")
