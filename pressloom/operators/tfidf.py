"""TF-IDF: vocabulary fit, transform, keywords and search.

The vocabulary is a table (term, term_id, df, corpus_count, idf) of at most ``max_features`` rows. The
transform is local to a row: the vocabulary travels once as a scalar subquery shaped like a hash table,
and each text becomes ``features``: array<struct<term_id, term, tf, weight>>, in term_id order. Nothing
is exploded and no article is shuffled. A vocabulary beyond ``ROW_LOCAL_TERMS`` is joined instead.
"""

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from pressloom.functions import fixed_values as V
from pressloom.functions import tokens as K
from pressloom.functions.lambdas import array_sum, explode_once, inline_once, let
from pressloom.operators.joins import fits_broadcast, lookup_join
from pressloom.session import write_and_read

ROW_LOCAL_TERMS = 50_000
_HASH_SLOTS = 16_384


def document_frequency(df: DataFrame, text: Column, stop_words=V.ENGLISH_STOP_WORDS, counts: Column | None = None) -> DataFrame:
    """Documents and occurrences per term. Counts are taken inside each row, then combined map-side.

    ``counts``: the row's term counts where they are already in a column; the text is not read then.
    """
    return (
        explode_once(df, [], K.term_counts(K.tfidf_terms(text, stop_words)) if counts is None else counts, "t")
        .groupBy(F.col("t.term").alias("term"))
        .agg(F.count("*").alias("df"), F.sum("t.tf").alias("corpus_count"))
    )


def fit_vocabulary(
    df: DataFrame,
    text: Column,
    max_features: int = V.MAX_FEATURES,
    min_df: int = V.MIN_DF,
    max_df: float = V.MAX_DF,
    stop_words=V.ENGLISH_STOP_WORDS,
    counts: Column | None = None,
) -> DataFrame:
    """The ``max_features`` most frequent terms within the document-frequency bounds, ties by term."""
    n_docs = df.agg(F.count("*").alias("n_docs")).scalar()
    top = (
        document_frequency(df, text, stop_words, counts)
        .withColumn("n_docs", n_docs)
        .where((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * F.col("n_docs")))
        .orderBy(F.desc("corpus_count"), "term")
        .limit(max_features)
    )
    # At most max_features rows are left, so one sorted partition is enough to number them.
    numbered = top.withColumn("term_id", F.row_number().over(Window.orderBy("term")) - 1)
    return numbered.select("term_id", "term", "df", "corpus_count", fit_idf(F.col("df"), F.col("n_docs")).alias("idf"))


def fit_idf(df: Column, n_docs: Column) -> Column:
    return F.log((1 + n_docs) / (1 + df)) + 1


def _hash_table(vocabulary: DataFrame) -> Column:
    """The vocabulary as one array of slots, each an array of (term, term_id, idf)."""
    slot = F.pmod(F.xxhash64("term"), F.lit(_HASH_SLOTS)).cast("int")
    filled = vocabulary.groupBy(slot.alias("slot")).agg(F.collect_list(F.struct("term", "term_id", "idf")).alias("terms"))
    slots = vocabulary.sparkSession.range(_HASH_SLOTS, numPartitions=1).select(F.col("id").cast("int").alias("slot"))
    table = (
        slots.join(F.broadcast(filled), "slot", "left")
        .select("slot", F.coalesce("terms", F.array().cast(filled.schema["terms"].dataType)).alias("terms"))
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "terms"))), lambda s: s["terms"]).alias("slots"))
    )
    return table.scalar()


def _weigh(entries: Column) -> Column:
    """Sublinear tf times idf, scaled to unit length."""
    raw = F.transform(
        entries,
        lambda e: F.struct(
            e["term_id"].alias("term_id"),
            e["term"].alias("term"),
            e["tf"].alias("tf"),
            ((1 + F.log(e["tf"].cast("double"))) * e["idf"]).alias("weight"),
        ),
    )

    def scale(x):
        length = F.sqrt(array_sum(F.transform(x["e"], lambda e: e["weight"] * e["weight"])))
        return let(
            F.struct(x["e"].alias("e"), length.alias("n")),
            lambda y: F.transform(y["e"], lambda e: e.withField("weight", e["weight"] / y["n"])),
        )

    return let(F.struct(raw.alias("e")), scale)


def tfidf_features(
    df: DataFrame,
    text: Column,
    vocabulary: DataFrame,
    id_col: str = "doc_id",
    stop_words=V.ENGLISH_STOP_WORDS,
    out: str = "features",
    counts: Column | None = None,
) -> DataFrame:
    """Add ``features``. Every row is kept; a text without known terms gets an empty array. ``counts`` as above."""
    counts = K.term_counts(K.tfidf_terms(text, stop_words)) if counts is None else counts
    if not fits_broadcast(vocabulary, ROW_LOCAL_TERMS):
        return _joined_features(df, counts, vocabulary, id_col, out)

    def look_up(table):
        def slot(c):
            return F.get(table, F.pmod(F.xxhash64(c["term"]), F.lit(_HASH_SLOTS)).cast("int"))

        def find(c):
            return F.transform(
                F.filter(slot(c), lambda e: e["term"] == c["term"]),
                lambda e: F.struct(
                    e["term_id"].alias("term_id"), e["term"].alias("term"), c["tf"].alias("tf"), e["idf"].alias("idf")
                ),
            )

        # Most terms are unknown; arrays are made for the others only.
        known = F.filter(counts, lambda c: F.exists(slot(c), lambda e: e["term"] == c["term"]))
        return F.flatten(F.transform(known, find))

    # The subquery sits in a projection of its own because the analyzer wants none inside a lambda function;
    # the optimizer merges the two projections, so the table is a constant and never part of a row.
    with_table = df.withColumn("_slots", _hash_table(vocabulary))
    return with_table.withColumn(out, _weigh(let(F.col("_slots"), look_up))).drop("_slots")


def _joined_features(df: DataFrame, counts: Column, vocabulary: DataFrame, id_col: str, out: str) -> DataFrame:
    """The same result for a vocabulary of any size: salted term join, then one group per document."""
    long = inline_once(df, [id_col], counts, "term")
    entry = F.struct("term_id", "term", "tf", "idf")
    known = lookup_join(long, vocabulary.select("term", "term_id", "idf"), "term", id_col, max_rows=ROW_LOCAL_TERMS)
    rows = known.groupBy(id_col).agg(F.sort_array(F.collect_list(entry)).alias("_e"))
    empty = F.array().cast(rows.schema["_e"].dataType)
    return df.join(rows, id_col, "left").withColumn(out, _weigh(F.coalesce("_e", empty))).drop("_e")


def tfidf_matrix(features: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The long form, one row per document and term."""
    return inline_once(features, [id_col], F.col("features"), "term_id")


def top_keywords(features: Column, k: int = V.TOP_KEYWORDS) -> Column:
    """The ``k`` heaviest terms, ties by term; '' when a text has none."""
    ranked = F.sort_array(
        F.transform(
            F.filter(features, lambda e: e["weight"] > 0),
            lambda e: F.struct((-F.round(e["weight"], 9)).alias("w"), e["term"].alias("term")),
        )
    )
    return F.array_join(F.transform(F.slice(ranked, 1, k), lambda e: e["term"]), ", ")


def tfidf_search(
    queries: DataFrame, documents: DataFrame, k: int = 10, query_id: str = "query_id", doc_id: str = "doc_id",
    block: int = 2_000,
) -> DataFrame:
    """The ``k`` most similar documents per query that share a term with it; both sides carry ``features``.

    A document's whole row is local, so tasks multiply their rows with a broadcast block of at most ``block`` queries
    and return ``k`` rows per query and task: no score of a document leaves its task unless it can win. More queries
    mean more blocks, each a pass over the documents, so pass a table there. Scores count to six digits, ties
    go to the smaller document id.
    """
    asked = queries.select(F.col(query_id).alias("query"), "features").where(F.size("features") > 0)
    asked = write_and_read(asked, "queries")  # counted, then read once per block
    n_blocks = max(1, -(-asked.count() // block))
    nr = F.pmod(F.xxhash64("query"), F.lit(n_blocks))
    kind = queries.schema[query_id].dataType
    found = [
        _best_per_task(documents, asked.where(nr == i).toArrow(), k, kind, doc_id) for i in range(n_blocks)
    ]
    best = reduce(DataFrame.unionByName, found)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), doc_id))
    ranked = best.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select(F.col("query").alias(query_id), doc_id, "score", "rank")


def _best_per_task(documents: DataFrame, asked: pa.Table, k: int, query_type: T.DataType, doc_id: str) -> DataFrame:
    """(query, doc_id, score) of the ``k`` best documents of every task for each query of one block."""
    rows = asked.column("features").to_pylist()
    used = sorted({e["term_id"] for row in rows for e in row})
    column = {t: i for i, t in enumerate(used)}
    weights = np.zeros((len(used), len(rows)))
    for j, row in enumerate(rows):
        for e in row:
            weights[column[e["term_id"]], j] = e["weight"]
    shared = documents.sparkSession.sparkContext.broadcast((np.array(used), weights, asked.column("query")))

    def keep_best(batches):
        terms, matrix, names = shared.value
        kept = [(np.zeros(0), None)] * matrix.shape[1]
        for batch in batches:
            lists = batch.column("ids")
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(lengths)), lengths)
            term, weight = lists.flatten().to_numpy(zero_copy_only=False), batch.column("weights").flatten().to_numpy(zero_copy_only=False)
            at = np.searchsorted(terms, term)
            known = np.flatnonzero(np.append(terms, -1)[at] == term) if len(terms) else at[:0]
            row, at, weight = row[known], at[known], weight[known]
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for start in range(0, len(ids), 256):  # a dense slice of 256 documents at a time
                lo, hi = np.searchsorted(row, [start, start + 256])
                dense = np.zeros((min(256, len(ids) - start), len(terms)))
                dense[row[lo:hi] - start, at[lo:hi]] = weight[lo:hi]
                scores = dense @ matrix
                for j in np.flatnonzero((scores > 0).any(axis=0)):
                    hits = np.flatnonzero(scores[:, j] > 0)
                    old, old_ids = kept[j]
                    score, names_of = np.round(scores[hits, j], 6), ids[start + hits]
                    if old_ids is not None:
                        score, names_of = np.concatenate([old, score]), np.concatenate([old_ids, names_of])
                    best = np.lexsort((names_of, -score))[:k]
                    kept[j] = (score[best], names_of[best])
        for j, (score, names_of) in enumerate(kept):
            if names_of is not None:
                who = pa.array([names[j].as_py()] * len(score), names.type)
                yield pa.RecordBatch.from_arrays([who, pa.array(names_of, id_type), pa.array(score)], ["query", doc_id, "score"])

    schema = T.StructType().add("query", query_type).add(doc_id, documents.schema[doc_id].dataType).add("score", T.DoubleType())
    id_type = to_arrow_type(documents.schema[doc_id].dataType)
    sparse = documents.select(
        F.col(doc_id).alias("id"),
        F.transform("features", lambda e: e["term_id"]).alias("ids"),
        F.transform("features", lambda e: e["weight"]).alias("weights"),
    )
    return sparse.mapInArrow(keep_best, schema)
