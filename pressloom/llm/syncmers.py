"""Document fingerprints from closed syncmers (native)."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressloom.llm.common import BLANK, table, text_of
from pressloom.session import write_and_read

#: Units in a k-mer and in the inner substrings that decide whether it is chosen.
K, S = 5, 2
#: Smallest syncmer codes that a fingerprint keeps.
KEPT = 64
_LOWEST = -(1 << 63)


def units(text: Column) -> Column:
    """What k-mers are made of: blank-separated words, with K - 1 empty ones at both ends so that few words have k-mers too."""
    words = F.filter(F.split(text, f"{BLANK}+", -1), lambda w: w != "")
    edge = F.array(*[F.lit("")] * (K - 1))
    return F.when(F.size(words) > 0, F.concat(edge, words, edge)).otherwise(F.array().cast("array<string>"))


def _from(a: Column, first: int, length: Column) -> Column:
    return F.slice(a, F.lit(first), F.greatest(length, F.lit(0)))


def codes(u: Column) -> Column:
    """For each k-mer of 5 units its code if it is a closed syncmer, else null.

    The k-mer at i holds four inner substrings of 2 units with hashes g[i] .. g[i+3]. It is chosen when the smallest
    is the first or the last of them, which depends on the k-mer alone: the same passage has the same syncmers in
    every text, and among any 3 k-mers in a row at least one is chosen.
    """
    h = F.transform(u, lambda x: F.xxhash64(x))

    def chosen(h: Column) -> Column:
        n = F.size(h)
        g = F.zip_with(_from(h, 1, n - 1), _from(h, 2, n - 1), lambda a, b: F.xxhash64(a, b))

        def picked(g: Column) -> Column:
            m = F.size(g) - (K - S)
            ends = F.zip_with(_from(g, 1, m), _from(g, 1 + K - S, m), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
            inner = F.zip_with(_from(g, 2, m), _from(g, 3, m), lambda a, b: F.least(a, b))
            shut = F.zip_with(ends, inner, lambda e, i: F.when(F.least(e["a"], e["b"]) <= i, e))
            return F.zip_with(shut, _from(h, 3, m), lambda e, mid: F.when(e.isNotNull(), F.xxhash64(e["a"], mid, e["b"])))

        return let(g, picked)

    return let(h, chosen)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def anchors(text: Column) -> Column:
    """The syncmers of a text with their positions in units, for positional matching."""
    with_place = F.transform(codes(units(text)), lambda c, i: F.struct(i.alias("pos"), c.alias("code")))
    return F.filter(with_place, lambda a: a["code"].isNotNull())


def sketch(text: Column) -> Column:
    """``codes``: the KEPT smallest distinct syncmer codes, in order; ``whole``: a hash of all syncmers in their order.

    A text of blanks alone has one code, its hash; an empty text has none.
    """
    all_codes = codes(units(text))

    def of(found: Column) -> Column:
        some = F.filter(found, lambda c: c.isNotNull())
        some = F.when((F.size(some) == 0) & (F.length(text) > 0), F.array(F.xxhash64(text))).otherwise(some)
        kept = F.slice(F.array_sort(F.array_distinct(some)), 1, KEPT)
        return F.struct(kept.alias("codes"), F.xxhash64(found).alias("whole"))

    return let(all_codes, of)


def likeness(a: Column, b: Column) -> Column:
    """Similarity of the syncmer sets, estimated on the smallest codes of their union; two empty sketches are alike."""
    a, b = a["codes"], b["codes"]
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, KEPT)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.greatest(F.size(union), F.lit(1)))


def as_text(sketch: Column) -> Column:
    """16 hex digits for each kept code, and for the hash of all syncmers: any syncmer that changes or changes place with another changes it."""
    every = F.concat(sketch["codes"], F.array(sketch["whole"]))
    return F.lower(F.array_join(F.transform(every, lambda c: F.lpad(F.hex(c), 16, "0")), ""))


def following(keys: DataFrame) -> DataFrame:
    """``key, next``: for each distinct key the next smaller one, for the smallest the greatest.

    Keys are range-sorted and looked at partition by partition; only each partition's ends meet in one task.
    """
    parts = keys.distinct().repartitionByRange(F.desc("key")).withColumn("part", F.spark_partition_id())
    parts = write_and_read(parts, "ordered-keys")
    inside = parts.withColumn("next", F.lead("key").over(Window.partitionBy("part").orderBy(F.desc("key"))))
    ends = parts.groupBy("part").agg(F.max("key").alias("first"))
    order = Window.orderBy("part")
    ends = ends.select("part", F.coalesce(F.lead("first").over(order), F.first("first").over(order)).alias("after"))
    return write_and_read(inside.join(ends, "part").select("key", F.coalesce("next", "after").alias("next")), "next-keys")


def edit_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_chars, text, edited, sketch, next_sketch``.

    ``edited``: the last floor(n_chars / 3) code points replaced by as many (or all) first ones of the document with the
    next smaller id (the greatest after the smallest). Null text is empty; a null id counts as the smallest long;
    rows that repeat an id are rows of their own, and as next document the one with the greatest text stands for them.
    The texts are shuffled once by id (both joins use the same exchange), the borrowed starts once more.
    """
    keys = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_LOWEST)).alias("key"), text_of(text_col).alias("text"))
    own = keys.withColumn("sketch", sketch(F.col("text")))  # once per text, before the shuffle that both joins share
    part = F.floor(F.length("text") / 3).cast("int")
    wanted = keys.groupBy("key").agg(F.max(part).alias("need"))
    wanted = wanted.join(following(keys.select("key")), "key").select(F.col("key").alias("before"), F.col("next").alias("key"), "need")
    lent = own.join(wanted, "key").select("before", F.struct(F.col("text").substr(F.lit(1), F.col("need")).alias("start"), "sketch").alias("lent"))
    lent = lent.groupBy(F.col("before").alias("key")).agg(F.max("lent").alias("lent"))
    text, n = F.col("text"), F.length("text")
    return own.join(lent, "key").select(
        F.when(F.col("key") != _LOWEST, F.col("key")).alias("doc_id"), n.cast("long").alias("n_chars"), "text",
        F.concat(text.substr(F.lit(1), n - part), F.col("lent.start").substr(F.lit(1), part)).alias("edited"),
        "sketch", F.col("lent.sketch").alias("next_sketch"),
    )


def op4_syncmers(spark, sf_dir):
    """All ``documents``."""
    pairs = edit_pairs(table(spark, sf_dir)).withColumn("edited_sketch", sketch(F.col("edited")))
    return pairs.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
