"""Article-shaped views over the document tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.functions.lambdas import posexplode_once

STRATEGY_BY_CODE = ["structured", "detailed", "role_based", "metadata_aware"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def articles(spark: SparkSession, folder: str) -> DataFrame:
    """Typed articles: first line as headline, the rest as description, labels as sentiment."""
    d, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    first_break = F.instr("text", "\n")
    return d.join(labels, "doc_id", "left").select(
        "doc_id",
        F.when(F.col("doc_id") % 97 != 0, F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 500).cast("int")))
        .alias("date"),
        F.substring_index("text", "\n", 1).alias("headline"),
        F.when(first_break > 0, F.substring(F.col("text"), first_break + 1, F.length("text"))).alias("description"),
        F.when(F.col("doc_id") % 11 == 0, F.lit(None)).when(F.col("lang") == "en", "covid").otherwise("non-covid")
        .alias("covid_status"),
        F.concat(F.lit("https://img.example/"), F.col("doc_id")).alias("image_url"),
        "source",
        F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive")
        .when(F.col("quality").isNotNull(), "neutral").alias("sentiment"),
    )


def raw_articles(spark: SparkSession, folder: str) -> DataFrame:
    """The untyped layout of the source files: text dates in several formats, tags, blanks and NA marks."""
    day = F.col("date")
    kind = F.col("doc_id") % 5
    text_date = (
        F.when(day.isNull(), "not a date")
        .when(kind == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(kind == 1, F.date_format(day, "dd/MM/yyyy"))
        .when(kind == 2, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" 00:00:00")))
        .when(kind == 3, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T00:00:00")))
        .otherwise("N/A")
    )
    headline = F.when(F.col("doc_id") % 89 == 0, "  ").otherwise(
        F.concat(F.lit(" <b>"), F.col("headline"), F.lit("</b>\t\u00a0"))
    )
    return articles(spark, folder).select(
        "doc_id",
        text_date.alias("Date"),
        headline.alias("Headline"),
        F.concat(F.lit('<p class="x">'), F.col("description"), F.lit("</p> &amp; \"end\"")).alias("Description"),
        F.coalesce("covid_status", F.lit("NA")).alias("Covid Status"),
        F.col("image_url").alias("Image URL"),
        F.col("source").alias("Source"),
        F.coalesce("sentiment", F.lit("")).alias("Sentiment"),
    )


def chat_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Answer and preceding turn of each conversation as (generated_text, target), with a strategy and a split."""
    turns = table(spark, folder, "conversations")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("target"))
    code = F.col("conv_id") % 5
    strategy = F.lit(None).cast("string")
    for i, name in enumerate(STRATEGY_BY_CODE):
        strategy = F.when(code == i, name).otherwise(strategy)
    return (
        turns.where(F.col("role") == "assistant")
        .join(before, ["conv_id", "turn"])
        .select(
            (F.col("conv_id") * 100 + F.col("turn")).alias("id"),
            F.col("text").alias("generated_text"),
            "target",
            strategy.alias("prompt_strategy"),
            F.when(F.col("conv_id") % 2 == 0, "val").otherwise("test").alias("split"),
        )
    )


def vector_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Each embedding with the one that follows it."""
    e = table(spark, folder, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("target_vec"))
    return e.join(nxt, "vec_id").select(F.col("vec_id").alias("id"), F.col("embedding").alias("generated_vec"), "target_vec")


def label_centres(spark: SparkSession, folder: str) -> DataFrame:
    """Mean embedding of each label: a small fixed model derived from the whole table."""
    long = posexplode_once(table(spark, folder, "embeddings"), ["label"], F.col("embedding"), "pos", "x")
    means = long.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(F.col("label").alias("cluster_id")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda e: F.round(e["m"], 9)).alias("center")
    )
