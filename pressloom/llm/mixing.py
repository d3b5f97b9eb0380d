"""Mixing sources to target weights by weighted fair queueing."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressloom.llm.common import BLANK, free_name, key_of, table, text_of
from pressloom.session import write_and_read

WEIGHTS = (1.0, 2.0, 3.0)
MOST_REPEATS = 3
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def targets(totals: DataFrame, weights=WEIGHTS, repeats: int = MOST_REPEATS) -> DataFrame:
    """``source, target`` from ``source, source_size``: shares by weight, at most ``repeats`` times a source's size.

    Sources in code point order, null last, take the weights in turn. What is above a limit is shared again by
    weight among the others until none is above. Sources fill up in the order of limit / weight, so the level at
    which the rest share is found in one ordered pass: a source is full when its limit / weight is at most the level
    (total - limits of the fuller ones) / (weights of it and the emptier ones). One row per source, no documents here.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    w = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    w = w.withColumn("limit", F.col("source_size") * F.lit(float(repeats))).withColumn("fill", F.col("limit") / F.col("weight"))
    up = Window.orderBy("fill", F.col("source").isNull(), "source")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    after = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    w = (
        w.withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("full_limits", F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("open_weights", F.sum("weight").over(after))
        .withColumn("level", (F.col("total") - F.col("full_limits")) / F.col("open_weights"))
    )
    # The first source that stays below its limit sets the level for all that follow.
    w = w.withColumn("rest", F.min(F.when(F.col("fill") > F.col("level"), F.struct("fill", "level"))).over(everything))
    share = F.when(F.col("rest").isNull() | (F.col("fill") < F.col("rest.fill")), F.col("limit")).otherwise(
        F.least(F.col("rest.level") * F.col("weight"), F.col("limit"))
    )
    return w.select("source", "source_size", F.round(share, 6).alias("target"))


def row_key(id_col: str, text_col: str, source_col: str) -> Column:
    return F.md5(key_of(F.col(f"`{id_col}`"), F.col(f"`{source_col}`"), F.md5(text_of(text_col))))


def _before(rows: DataFrame, outer: list[str], inner: str, size: str, name: str) -> DataFrame:
    """Add the sum of ``size`` over the rows before this one in the order of ``inner`` within ``outer``."""
    w = Window.partitionBy(*outer).orderBy(inner).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.coalesce(F.sum(size).over(w), F.lit(0)))


def schedule(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights=WEIGHTS, repeats: int = MOST_REPEATS, seed: str = SEED,
) -> DataFrame:
    """Every row's place in the mix: ``doc_id, row_key, size, source_size, target, taken, epochs, cut, virtual_finish``.

    A source plays its documents in a shuffled order (MD5 of seed and id), again and again. The virtual finish time
    of a copy is the source's words up to its end divided by the source's target, so at any time every source has
    given the same share of its target. The targets add up to the budget: in the global order by virtual time the
    budget is used up at time 1, where the queue is cut. ``epochs`` whole copies of a row end before that, ``cut``
    words of one more copy lie before it; ``taken = epochs * size + cut``.

    The running sum uses three levels of the shuffle key (256 parts of 256 parts), so a source with a third of all
    rows is spread over 65,536 windows, and the windows over part sums have at most 256 rows.

    Null text has size 0, a null source is a source. Repeated rows follow each other in an order that text and size
    settle; rows equal in all of it are interchangeable. An empty table or one without words takes nothing.
    """
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))))
    sized = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), n_words(text_of(text_col)).alias("size"),
        key.alias("key"), row_key(id_col, text_col, source_col).alias("row_key"),
    )
    sized = write_and_read(sized, "sizes").withColumn("p1", F.substring("key", 1, 2)).withColumn("p2", F.substring("key", 3, 2))
    fine = sized.groupBy("source", "p1", "p2").agg(F.sum("size").alias("words"))
    coarse = fine.groupBy("source", "p1").agg(F.sum("words").alias("words"))
    goals = targets(coarse.groupBy("source").agg(F.sum("words").alias("source_size")), weights, repeats)
    coarse = _before(coarse, ["source"], "p1", "words", "base1").drop("words")
    fine = _before(fine, ["source", "p1"], "p2", "words", "base2").drop("words")
    same = lambda a, b: a["source"].eqNullSafe(b["source"]) & (a["p1"] == b["p1"])
    base = fine.join(coarse, same(fine, coarse)).select(fine["source"], fine["p1"], "p2", (F.col("base1") + F.col("base2")).alias("base"))
    base = base.join(goals, base["source"].eqNullSafe(goals["source"])).drop(goals["source"])
    local = Window.partitionBy("source", "p1", "p2").orderBy("key", "doc_id", "size", "row_key")
    placed = sized.withColumn(
        "inside", F.coalesce(F.sum("size").over(local.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    rows = placed.join(base, same(placed, base) & (placed["p2"] == base["p2"])).select(
        "doc_id", placed["source"], "row_key", "size", "source_size", "target", (F.col("base") + F.col("inside")).alias("begin")
    )
    goal = F.floor("target")
    rows = rows.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long"))
    rest = goal - F.col("epochs") * F.col("source_size") - F.col("begin")
    rows = rows.withColumn("cut", F.greatest(F.lit(0), F.least(F.col("size"), rest)).cast("long"))
    finish = (F.col("begin") + F.col("size")) / F.col("target")
    return rows.select(
        "doc_id", "source", "row_key", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("cut")).alias("taken"),
        "epochs", "cut", F.when(F.col("target") > 0, finish).otherwise(0.0).alias("virtual_finish"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed documents with all their columns, globally sorted by virtual finish time.

    A document comes once for each of its copies before the cut; a copy that the cut divides (one for each source at
    most) comes with the words before it. Rows that repeat id, source and text take their other columns from one of them.
    """
    plan = schedule(docs, id_col, text_col, source_col, **options).where("taken > 0")
    each = plan.withColumn("copy", F.explode(F.expr("sequence(0L, epochs)"))).withColumn(
        "words", F.when(F.col("copy") < F.col("epochs"), F.col("size")).otherwise(F.col("cut"))
    )
    key, words, whole, finish = (free_name(docs, n) for n in ("row_key", "words", "whole_words", "finish"))
    each = each.where("words > 0").select(
        F.col("row_key").alias(key), F.col("words").alias(words), F.col("size").alias(whole),
        # The fraction of its target that the source has given when this copy ends.
        (F.col("virtual_finish") + F.col("copy") * F.col("source_size") / F.col("target")).alias(finish),
    )
    start = F.array_join(
        F.slice(F.regexp_extract_all(text_of(text_col), F.lit(f"{BLANK}*{WORD}"), F.lit(0)), F.lit(1), F.col(words).cast("int")), ""
    )
    text = F.when(F.col(words) < F.col(whole), start).otherwise(F.col(f"`{text_col}`"))
    one = docs.withColumn(key, row_key(id_col, text_col, source_col)).dropDuplicates([key])
    mixed = one.join(each, key).withColumn(text_col, text)
    return mixed.repartitionByRange(finish, key).sortWithinPartitions(finish, key).select(*(F.col(f"`{c}`") for c in docs.columns))


def op7_mixing(spark, sf_dir):
    """All ``documents``."""
    return schedule(table(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k, 
         md5(coalesce('=' || CAST(doc_id AS VARCHAR), '-') || '|' || coalesce('=' || source, '-') || '|=' || md5(coalesce(text, ''))) AS t FROM documents),
s AS (
  SELECT source, sum(size) AS n, [1.0::DOUBLE, 2.0, 3.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1] AS w
  FROM d GROUP BY source),
tot AS (SELECT CAST(sum(n) AS DOUBLE) AS total FROM s),
rounds AS (
  SELECT 0 AS r, CAST([] AS VARCHAR[]) AS full_ones
  UNION ALL
  SELECT r + 1, (SELECT list(coalesce(source, chr(0)) ORDER BY source) FROM s WHERE list_contains(full_ones, coalesce(source, chr(0)))
     OR w * ((SELECT total FROM tot) - (SELECT coalesce(sum(3.0 * n), 0) FROM s WHERE list_contains(full_ones, coalesce(source, chr(0)))))
          / (SELECT sum(w) FROM s WHERE NOT list_contains(full_ones, coalesce(source, chr(0)))) > 3.0 * n)
  FROM rounds WHERE r < 30),
f AS (SELECT coalesce(full_ones, CAST([] AS VARCHAR[])) AS full_ones FROM rounds ORDER BY r DESC LIMIT 1),
g AS (
  SELECT source, n, round(CASE WHEN list_contains(full_ones, coalesce(source, chr(0))) THEN 3.0 * n ELSE
     w * ((SELECT total FROM tot) - (SELECT coalesce(sum(3.0 * n), 0) FROM s WHERE list_contains(full_ones, coalesce(source, chr(0)))))
       / (SELECT sum(w) FROM s WHERE NOT list_contains(full_ones, coalesce(source, chr(0)))) END, 6) AS target
  FROM s, f),
p AS (
  SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM d)
SELECT p.doc_id, p.size, CAST(g.n AS BIGINT) AS source_size, g.target,
  CAST(CASE WHEN g.n = 0 THEN 0 ELSE (CAST(floor(g.target) AS BIGINT) // CAST(g.n AS BIGINT)) * p.size
  + greatest(0, least(p.size, CAST(floor(g.target) AS BIGINT) % CAST(g.n AS BIGINT) - p.b)) END AS BIGINT) AS taken
FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source
"""
