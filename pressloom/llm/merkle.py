"""Merkle fixity audit of WARC records: hash trees over ordered offset ranges, compared from the root down."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressloom.llm.common import table
from pressloom.session import write_and_read

#: Bits of an offset that one leaf range spans (32 KiB), and bits by which a level narrows (256 children at most).
LEAF_BITS = 15
FAN_BITS = 8
OFFSET_BITS = 63
#: An archive's files follow each other in one offset space, each at a multiple of this.
FILE_BITS = 40


def leaves(records: DataFrame) -> DataFrame:
    """``at, n, digest`` per offset, from ``at, payload``. Records at one offset (repeated or damaged rows) are one leaf:
    their digests are added up in four parts, which needs no order and no list, however many they are."""
    digest = F.sha2(F.coalesce(F.col("payload"), F.lit("")).cast("binary"), 256)
    parts = [F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    sums = records.groupBy("at").agg(F.count(F.lit(1)).alias("n"), F.max(digest).alias("last"), *(F.sum(p).alias(f"s{i}") for i, p in enumerate(parts)))
    several = F.sha2(F.concat_ws(":", *(F.col(f"s{i}").cast("string") for i in range(4))), 256)
    return sums.select("at", "n", F.when(F.col("n") == 1, F.col("last")).otherwise(several).alias("digest"))


def _parents(nodes: DataFrame, bits: int, level: int) -> DataFrame:
    """A node's digest covers its children's places and digests in order; it has 2^bits children at most."""
    child = F.struct("at", "digest")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(child)), lambda c: F.concat_ws(":", c["at"].cast("string"), c["digest"])), "\n")
    return nodes.groupBy(F.shiftright("at", bits).alias("at")).agg(F.sum("n").alias("n"), F.sha2(text, 256).alias("digest")).withColumn("level", F.lit(level))


def build_tree(records: DataFrame) -> list[DataFrame]:
    """The levels of the tree from the record leaves to the root, each a table ``at, n, digest``, each written.

    A level groups by offset range, never by order of arrival, so replicas that are stored or split otherwise have the
    same tree. A null offset counts as -1, before all others.
    """
    records = records.withColumn("at", F.coalesce(F.col("at").cast("long"), F.lit(-1).cast("long")))
    levels = [write_and_read(leaves(records), "leaves")]
    bits, left = LEAF_BITS, OFFSET_BITS
    while left > 0:
        levels.append(write_and_read(_parents(levels[-1], bits, len(levels)).drop("level"), "tree"))
        left -= bits
        bits = FAN_BITS
    return levels


def _apart(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Places whose digests differ or that only one side has."""
    a = ours.select("at", F.col("digest").alias("digest"))
    b = theirs.select("at", F.col("digest").alias("replica_digest"))
    return a.join(b, "at", "full").where(~F.col("digest").eqNullSafe(F.col("replica_digest")))


def audit(records: DataFrame, replica: DataFrame) -> DataFrame:
    """``at, status, digest, replica_digest`` of every damaged offset: ``changed``, ``missing`` or ``extra`` in the replica.

    Compares the roots, then on each level only the children of nodes that differ: equal branches are not read further.
    Empty tables have empty trees; against an empty replica every offset is missing.
    """
    ours, theirs = build_tree(records), build_tree(replica)
    suspect = _apart(ours[-1], theirs[-1]).select("at")
    for level in range(len(ours) - 2, -1, -1):
        bits = LEAF_BITS if level == 0 else FAN_BITS
        near = lambda nodes: nodes.withColumn("up", F.shiftright("at", bits)).join(suspect.withColumnRenamed("at", "up"), "up", "left_semi")  # noqa: B023, E731
        found = write_and_read(_apart(near(ours[level]), near(theirs[level])), "suspects")
        suspect = found.select("at")
    status = F.when(F.col("replica_digest").isNull(), "missing").when(F.col("digest").isNull(), "extra").otherwise("changed")
    return found.select("at", status.alias("status"), "digest", "replica_digest")


def archived(pages: DataFrame, per_file: int = 512) -> DataFrame:
    """Pages as the records of WARC files: ``file_no, at, page_id, payload``; a record begins where the one before ends."""
    rows = pages.select(F.floor(F.col("page_id") / per_file).alias("file_no"), "page_id", F.concat_ws("\r\n", "url", "html").alias("payload"))
    size = F.octet_length("payload") + 4
    before = Window.partitionBy("file_no").orderBy("page_id", "payload").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(size).over(before), F.lit(0))
    return rows.withColumn("at", F.shiftleft(F.col("file_no").cast("long"), FILE_BITS) + offset).select("file_no", "at", "page_id", "payload")


def _hit(salt: str, digits: str) -> Column:
    """About one record in 16 for each digit, by the MD5 of salt and id."""
    return F.md5(F.concat(F.lit(salt), F.col("page_id").cast("string"))).startswith(digits)


def damaged(records: DataFrame) -> DataFrame:
    """A replica with a few records cut short, a few lost, and a few doubled one byte further on."""
    kept = records.where(~_hit("lost", "00"))
    cut = kept.withColumn("payload", F.when(_hit("cut", "0a"), F.expr("left(payload, length(payload) - 1)")).otherwise(F.col("payload")))
    doubled = records.where(_hit("twice", "fff")).withColumn("at", F.col("at") + 1)
    return cut.unionByName(doubled)


def op1_merkle(spark, sf_dir):
    """All ``pages`` as an archive against a replica with damage in a few records: every damaged offset."""
    records = archived(table(spark, sf_dir, "pages"))
    found = audit(records.select("at", "payload"), damaged(records).select("at", "payload"))
    file_no = F.shiftright("at", FILE_BITS)
    return found.select(
        file_no.alias("file_no"), (F.col("at") - F.shiftleft(file_no, FILE_BITS)).alias("file_offset"), "status", "digest", "replica_digest"
    )


ORACLE = r"""
WITH r AS (
  SELECT page_id, page_id // 512 AS file_no, concat_ws(chr(13) || chr(10), url, html) AS p FROM pages),
a AS (
  SELECT *, CAST(coalesce(sum(octet_length(encode(p)) + 4) OVER (PARTITION BY file_no ORDER BY page_id, p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS o FROM r),
b AS (
  SELECT file_no, o, CASE WHEN starts_with(md5('cut' || page_id), '0a') THEN left(p, length(p) - 1) ELSE p END AS p FROM a
  WHERE NOT starts_with(md5('lost' || page_id), '00')
  UNION ALL SELECT file_no, o + 1, p FROM a WHERE starts_with(md5('twice' || page_id), 'fff'))
SELECT coalesce(x.file_no, y.file_no) AS file_no, coalesce(x.o, y.o) AS file_offset,
  CASE WHEN y.p IS NULL THEN 'missing' WHEN x.p IS NULL THEN 'extra' ELSE 'changed' END AS status,
  sha256(x.p) AS digest, sha256(y.p) AS replica_digest
FROM a x FULL JOIN b y ON x.file_no = y.file_no AND x.o = y.o WHERE x.p IS DISTINCT FROM y.p
"""
