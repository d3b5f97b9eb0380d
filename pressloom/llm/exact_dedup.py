"""Exact duplicates by deterministic block naming (native)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressloom.llm.common import BLANK, key_of, stay_only, table, text_of
from pressloom.session import write_and_read

#: Code points in a block.
BLOCK = 4096


def normalised(text: Column) -> Column:
    """The text without ASCII white space: texts are equal when these are."""
    return F.regexp_replace(text, f"{BLANK}+", "")


def name_blocks(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Integer names for the contents that occur more than once, the same name for the same content only.

    The distinct contents (counted map-side first, so a content in a third of all rows is one row per task) are
    sorted inside their partitions and numbered in that order. The names are written, so that a lost executor
    cannot number a content anew after others have used its name.
    """
    repeated = blocks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    ordered = repeated.sortWithinPartitions(*keys)
    return write_and_read(ordered.withColumn("name", F.monotonically_increasing_id()), "block-names")


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per input row: ``doc_id, n_chars, text_sha256, level, name, row_key``; equal texts share (level, name).

    1. Every normalised text is cut into blocks of ``block`` code points; equal blocks get one integer name.
    2. Adjacent names are paired, equal pairs get one name, and so on until one name is left. ``level`` is the number
       of rounds, which depends on the number of blocks alone.
    A block or a pair that occurs once in the whole corpus settles its document: no other text can equal it. It takes
    no further part and has a null ``name``. No hash stands for a text anywhere, so names cannot collide.

    Null text is empty, and empty texts equal each other and texts of white space only. Repeated rows and repeated
    ids are rows of their own (``row_key``). Other columns are not read. An empty table gives an empty table.
    """
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"))
    source = source.withColumn("row_key", F.monotonically_increasing_id())
    clean = source.select(
        "row_key", "doc_id", F.length("text").cast("long").alias("n_chars"), normalised(F.col("text")).alias("bare")
    )
    pieces = clean.select(
        "row_key", "doc_id", "n_chars", "bare",
        F.posexplode_outer(F.regexp_extract_all("bare", F.lit(f"(?s).{{1,{block}}}"), F.lit(0))).alias("pos", "content"),
    ).select(
        "row_key",
        F.coalesce("pos", F.lit(0)).alias("pos"),
        F.coalesce("content", F.lit("")).alias("content"),
        # What belongs to the whole text travels with its first block only.
        F.when(F.coalesce("pos", F.lit(0)) == 0, F.struct("doc_id", "n_chars", F.sha2("bare", 256).alias("sha"))).alias("info"),
    )
    names = name_blocks(pieces.select("content"), ["content"])
    named = pieces.join(names, "content", "left").select("row_key", "pos", "name", "info")
    # A null name means a block that occurs once; min() of a flag tells whether the row goes on.
    rows = named.groupBy("row_key").agg(
        F.max("info").alias("info"),
        F.count(F.lit(1)).alias("blocks"),
        F.min(F.col("name").isNotNull()).alias("open"),
        F.collect_list(F.when(F.col("name").isNotNull(), F.struct("pos", "name"))).alias("parts"),
    )
    rows = write_and_read(
        rows.select(
            "row_key", F.col("info.doc_id").alias("doc_id"), F.col("info.n_chars").alias("n_chars"),
            F.col("info.sha").alias("text_sha256"), F.ceil(F.log2(F.col("blocks"))).cast("int").alias("level"),
            F.when(F.col("open"), F.transform(F.array_sort("parts"), lambda p: p["name"])).alias("names"),
        ),
        "block-rows",
    )
    settled = rows.where("names is null or level = 0").select(
        "row_key", "doc_id", "n_chars", "text_sha256", "level", F.element_at("names", 1).alias("name")
    )
    return settled.unionByName(_paired(rows.where("names is not null and level > 0")))


def _paired(rows: DataFrame) -> DataFrame:
    """Rounds of pairing for the rows with several blocks, all of which occur elsewhere too."""
    info = rows.drop("names")
    level = rows.select("row_key", "level", F.posexplode("names").alias("pos", "name"))
    found = info.select("row_key", F.lit(None).cast("long").alias("name")).limit(0)
    for round_no in range(1, (rows.agg(F.max("level")).first()[0] or 0) + 1):
        halves = level.groupBy("row_key", "level", F.floor(F.col("pos") / 2).alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
        )
        names = name_blocks(halves.select("left", "right"), ["left", "right"])
        named = halves.join(names, ["left", "right"], "left").select("row_key", "level", "pos", "name")
        named = write_and_read(named, "pair-names")
        # One pair that occurs once settles a row; a row of this round's depth has one name left.
        marks = named.groupBy("row_key").agg(
            F.min(F.col("name").isNotNull()).alias("open"), F.max("level").alias("level"), F.max("name").alias("name")
        )
        ends = ~F.col("open") | (F.col("level") == round_no)
        found = found.unionByName(marks.where(ends).select("row_key", F.when(F.col("open"), F.col("name")).alias("name")))
        level = named.join(marks.where(~ends).select("row_key"), "row_key", "left_semi")
    return info.join(found, "row_key").select("row_key", "doc_id", "n_chars", "text_sha256", "level", "name")


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256, n_chars``.

    Of equal texts the row with the most code points in the original text stays, then the smallest id (null last),
    then the first of fully repeated rows, so exactly one row of a group is ``kept``.
    """
    found = identities(docs, id_col, text_col, block)
    alone = found.where("name is null").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256", "n_chars",
    )
    shared = found.where("name is not null")
    best = F.min(F.struct((-F.col("n_chars")).alias("chars"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key"))
    groups = shared.groupBy("level", "name").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    # Written, so that the join can split the task of a large group.
    grouped = shared.join(write_and_read(groups, "groups"), ["level", "name"]).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("row_key") == F.col("best.row_key")).alias("kept"), "text_sha256", "n_chars",
    )
    return alone.unionByName(grouped)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """The input rows that stay, with all their columns; of rows that repeat id and text one stays."""
    stay = verdicts(docs, id_col, text_col, block).where("kept")
    text = text_of(text_col)
    key = key_of(F.col(f"`{id_col}`"), F.length(text), F.sha2(normalised(text), 256))
    return stay_only(docs, key, stay, key_of(F.col("doc_id"), F.col("n_chars"), F.col("text_sha256")))


def op9_exact_dedup(spark, sf_dir):
    """All ``documents``."""
    return verdicts(table(spark, sf_dir)).drop("n_chars")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS h, row_number() OVER () AS r
  FROM documents),
g AS (
  SELECT *, count(*) OVER (PARTITION BY h) AS group_size,
         first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id NULLS LAST, r) AS keep_id,
         row_number() OVER (PARTITION BY h ORDER BY n DESC, doc_id NULLS LAST, r) AS place
  FROM d)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, h AS text_sha256 FROM g
"""
