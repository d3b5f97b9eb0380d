"""Reading and writing of tables, models and reports."""

import csv
import functools
import logging
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressloom.functions import fixed_values as V
from pressloom.functions.vectors import vector_to_text

log = logging.getLogger(__name__)

ARTICLE_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in V.SOURCE_COLUMNS])


def _null_if_na(c: str) -> Column:
    return F.when(F.col(f"`{c}`").isin(V.NA_TOKENS), F.lit(None)).otherwise(F.col(f"`{c}`")).alias(c)


MALFORMED = "_malformed"


def read_articles(
    spark: SparkSession, path: str, schema: T.StructType | None = ARTICLE_SCHEMA, multi_line: bool = True, malformed: str | None = None
) -> DataFrame:
    """CSV with headers, quoted line breaks and the usual NA marks as null; every field is text.

    Every file is read by its own header: files are grouped by their first line, each group has one reader, and the
    groups are joined by column names (whatever their order, capitals and blanks). Columns of ``schema`` come first, null
    where a file has none, then all others by name; ``schema=None`` takes all in the order of the first header. The first
    lines come from one pass over the files, grouped by header; a header must not hold a line break. Files without a line
    have no rows.

    A row with more or fewer fields than its header keeps those it has; surplus ones are not in the result.
    ``malformed`` names a column that then holds the row's text, null for all other rows.

    A file whose fields contain line breaks cannot be split, so one task reads one file: keep such data in many files,
    or pass ``multi_line=False`` where no field holds a line break.
    """
    options = dict(
        header=True, multiLine=multi_line, quote='"', escape='"', encoding="UTF-8", nullValue="", emptyValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, maxCharsPerColumn=-1, mode="PERMISSIVE",
        columnNameOfCorruptRecord=MALFORMED,
    )
    wanted = {} if schema is None else {_plain(f.name): f for f in schema}
    groups, names = [], {}
    for header, files in file_headers(spark, path):
        columns = _unique(next(csv.reader([header])))
        fields = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, MALFORMED]])
        groups.append((spark.read.schema(fields).options(**options).csv(files), {_plain(c): c for c in reversed(columns)}))
        for c in columns:
            names.setdefault(_plain(c), c)
    others = [p for p in names if p not in wanted]
    if wanted:
        others.sort()

    def shaped(raw: DataFrame, found: dict[str, str]) -> DataFrame:
        def field(plain, name, kind):
            return (_null_if_na(found[plain]) if plain in found else F.lit(None)).cast(kind).alias(name)

        known = [field(p, f.name, f.dataType) for p, f in wanted.items()] + [field(p, names[p], "string") for p in others]
        return raw.select(*known, *([F.col(MALFORMED).alias(malformed)] if malformed else []))

    if not groups:
        none = [f.name for f in wanted.values()] + ([malformed] if malformed else [])
        empty = spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in none]))
        return empty.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in wanted.values()], *([malformed] if malformed else []))
    return functools.reduce(DataFrame.unionByName, [shaped(*g) for g in groups])


def file_headers(spark: SparkSession, path: str) -> list[tuple[str, list[str]]]:
    """Each distinct first line under ``path`` with its files, both in order."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value")
    )
    first = lines.where("start = 0").withColumn("n", F.monotonically_increasing_id()).groupBy("file").agg(F.min_by("value", "n").alias("header"))
    first = first.withColumn("header", F.regexp_replace("header", "^\ufeff|\r$", ""))
    grouped = first.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files"))
    return sorted(((r.header, [unquote(f) for f in r.files]) for r in grouped.collect()), key=lambda g: g[1])


def _unique(columns: list[str]) -> list[str]:
    """Column names of a header; one that comes again, or is empty, gets its place behind it."""
    seen, out = {MALFORMED}, []
    for i, name in enumerate(columns):
        name = name if name and name.lower() not in seen else f"{name}_{i}"
        seen.add(name.lower())
        out.append(name)
    return out


def _plain(name: str) -> str:
    return "_".join(name.strip().lower().split())


def with_row_ids(df: DataFrame, col: str = "doc_id") -> DataFrame:
    """A key for sources without one: unique, and rising with the row order inside each file."""
    return df if col in df.columns else df.withColumn(col, F.monotonically_increasing_id())


def write_table(df: DataFrame, path: str, partition_by=(), mode: str = "overwrite", schema: T.StructType | None = None) -> DataFrame:
    """Parquet, partitioned on request, and read back; with a schema also where no row was written."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)
    reader = df.sparkSession.read if schema is None else df.sparkSession.read.schema(schema)
    return reader.parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV export; arrays of numbers become the '%.6f' comma list, other arrays a comma list."""
    columns = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("array<double>", "array<float>"):
            c = vector_to_text(c)
        elif kind.startswith("array<"):
            c = F.array_join(c.cast("array<string>"), ",")
        columns.append(c.alias(name))
    df.select(*columns).write.mode(mode).options(
        header=True, quote='"', escape='"', quoteAll=True, nullValue="", emptyValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(path)


def save_model(tables: dict[str, DataFrame], path: str) -> None:
    """Each part of a fitted model is a table: vocabulary, components, centres, labels."""
    for name, part in tables.items():
        part.write.mode("overwrite").parquet(f"{path}/{name}")


def load_model(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def write_label_dictionary(labels: DataFrame, path: str) -> None:
    """One JSON object per cluster, the id as text. A label table has one row per cluster."""
    labels.select(F.col("cluster_id").cast("string").alias("cluster_id"), "topic_label").coalesce(1).write.mode(
        "overwrite"
    ).json(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_if_exists(spark: SparkSession, path: str) -> DataFrame | None:
    if not path_exists(spark, path):
        log.warning("not found, skipped: %s", path)
        return None
    return spark.read.parquet(path)


def write_markdown(lines: DataFrame, path: str) -> None:
    lines.coalesce(1).sortWithinPartitions("line_no").select("line").write.mode("overwrite").text(path)
