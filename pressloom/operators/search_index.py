"""An index for TF-IDF search: postings in blocks with their greatest weights, and a top-k that skips blocks.

A block is a run of documents that share their heaviest terms, so a block's greatest weight of a term says much about it.
The index is one table, a row per (term, block): ``term_id, block, top, docs``, clustered by term, ``top`` the greatest
weight and ``docs`` an array of (slot, doc_id, weight). Reading ``top`` alone costs no postings.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressloom.functions.lambdas import inline_once
from pressloom.operators.joins import fits_broadcast
from pressloom.session import staged, write_and_read

#: Documents in a block.
BLOCK = 512
#: Blocks per query that set its threshold.
FIRST = 2
#: Folders of the table; a term's number modulo this is its folder.
FOLDERS = 16
#: Scores count to six digits, so a block may be skipped only if its bound is below the threshold by more than that.
MARGIN = 2e-6


def _folder(term_id: Column) -> Column:
    return F.pmod(term_id, F.lit(FOLDERS)).cast("int")


def build_index(documents: DataFrame, path: str, doc_id: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """Write the postings of ``documents`` (``doc_id``, ``features`` with weights above 0) to ``path`` and read them back.

    Documents form blocks inside their tasks, ordered by their heaviest term and its weight: no document moves for it, and a term that
    leads a third of all documents only fills more blocks. One shuffle clusters the postings by (term, block); a frequent
    term is many such keys. ``block`` is a power of two, so that no block lies in two tasks.

    Documents without features are in no posting; rows that repeat an id are documents of their own; an empty table
    gives an empty index.
    """
    if block < 1 or block & (block - 1):
        raise ValueError("block must be a power of two")
    heaviest = F.array_max(F.transform("features", lambda e: F.struct(e["weight"].alias("w"), e["term_id"].alias("t"))))
    # A filter on computed features would make them twice: documents without any take the last places and leave no posting.
    rows = documents.select(F.col(doc_id).alias("doc_id"), heaviest.alias("lead"), "features")
    rows = rows.sortWithinPartitions(F.asc_nulls_last("lead.t"), F.desc("lead.w"), "doc_id").withColumn("place", F.monotonically_increasing_id())
    rows = rows.select(
        F.shiftright("place", block.bit_length() - 1).alias("block"), F.col("place").bitwiseAND(F.lit(block - 1)).cast("int").alias("slot"),
        "doc_id", F.transform("features", lambda e: F.struct(e["term_id"].alias("term_id"), e["weight"].alias("weight"))).alias("entries"),
    )
    with staged(rows, "blocks") as placed:  # the range boundaries below are sampled from it
        postings = inline_once(placed, ["block", "slot", "doc_id"], F.col("entries"), "term_id").withColumn("folder", _folder(F.col("term_id")))
        # Grouping by all the keys of a range partitioning needs no shuffle of its own.
        postings = postings.repartitionByRange("folder", "term_id", "block").groupBy("folder", "term_id", "block").agg(
            F.max("weight").alias("top"), F.sort_array(F.collect_list(F.struct("slot", "doc_id", "weight"))).alias("docs")
        )
        postings.sortWithinPartitions("folder", "term_id", "block").write.mode("overwrite").partitionBy("folder").parquet(path)
        return load_index(documents.sparkSession, path, postings.schema)


def load_index(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return (spark.read if schema is None else spark.read.schema(schema)).parquet(path)


def block_bounds(asked: DataFrame, index: DataFrame) -> DataFrame:
    """``query, block, bound``: no document of the block scores more than ``bound``. ``asked``: ``query, term_id, asked``."""
    tops = _of_terms(index, asked).select("term_id", "block", "top")
    weighed = tops.join(_small(asked), "term_id")
    return weighed.groupBy("query", "block").agg(F.sum(F.col("asked") * F.col("top")).alias("bound"))


def _of_terms(index: DataFrame, asked: DataFrame) -> DataFrame:
    """The folders of the index that hold terms asked for; there are at most FOLDERS."""
    folders = [r[0] for r in asked.select(_folder(F.col("term_id"))).distinct().collect()]
    return index.where(F.col("folder").isin(folders))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if fits_broadcast(df) else df


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def score_blocks(visits: DataFrame, asked: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """``query, doc_id, score, rank``: the ``k`` best documents per query among the visited (query, block).

    The one shuffle is that of the postings found, by (query, block): scores are summed and cut to ``k`` in its tasks.
    """
    wanted = write_and_read(visits.select("query", "block").join(_small(asked), "query"), "wanted")
    hits = _of_terms(index, asked).join(_small(wanted), ["term_id", "block"]).select("query", "block", "asked", "docs")
    parts = hits.repartition("query", "block").select("query", "block", "asked", F.inline("docs"))
    scored = parts.groupBy("query", "block", "slot", "doc_id").agg(F.sum(F.col("asked") * F.col("weight")).alias("score"))
    scored = scored.where("score > 0").select("query", "doc_id", F.round("score", 6).alias("score"))
    return _best(scored, k)


def visits_of(asked: DataFrame, index: DataFrame, k: int, first: int = FIRST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a search reads: the first blocks, the further ones that may still hold a winner, and the best of the first.

    The ``first`` blocks of greatest bound are scored; the score of their ``k``-th document is a threshold that the final
    one cannot fall below. A block whose bound is under it holds no winner and is not read.
    """
    bounds = write_and_read(block_bounds(asked, index), "bounds")
    order = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "block"))
    chosen = write_and_read(bounds.withColumn("nr", order).where(F.col("nr") <= first).select("query", "block"), "first")
    leaders = write_and_read(score_blocks(chosen, asked, index, k), "leaders")
    threshold = leaders.where(F.col("rank") == k).select("query", F.col("score").alias("threshold"))
    rest = bounds.join(_small(threshold), "query", "left").join(_small(chosen.withColumn("read", F.lit(True))), ["query", "block"], "left")
    rest = rest.where(F.col("read").isNull() & (F.col("threshold").isNull() | (F.col("bound") >= F.col("threshold") - MARGIN)))
    return chosen, write_and_read(rest.select("query", "block"), "further"), leaders


def search(queries: DataFrame, index: DataFrame, k: int = 10, query_id: str = "query_id", doc_id: str = "doc_id") -> DataFrame:
    """The ``k`` most similar documents per query that share a term with it, from the index alone.

    Scores count to six digits, ties go to the smaller document id. Exact: blocks are skipped only where their bound proves
    that none of their documents can be among the ``k``. Queries of any number are one pass; those without features, or a
    query table or index without rows, find nothing. Queries that repeat an id count as one with both their terms.
    """
    entries = F.transform("features", lambda e: F.struct(e["term_id"].alias("term_id"), e["weight"].alias("asked")))
    asked = write_and_read(inline_once(queries.select(F.col(query_id).alias("query"), "features"), ["query"], entries, "term_id"), "asked")
    _, further, leaders = visits_of(asked, index, k)
    best = _best(leaders.drop("rank").unionByName(score_blocks(further, asked, index, k).drop("rank")), k)
    return best.select(F.col("query").alias(query_id), F.col("doc_id").alias(doc_id), "score", "rank")
