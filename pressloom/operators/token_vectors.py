"""Token vectors from co-occurrence counts, and text vectors from token vectors.

Tokens that stand near each other are counted, the counts become positive pointwise mutual information (PPMI), and the
passes of the SVD factorise its rows. Only ``contexts`` columns are kept, so a row and the driver's matrices are bounded
whatever the number of tokens; every token has a row of its own, in Spark.
"""

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressloom.functions import fixed_values as V
from pressloom.functions import tokens as K
from pressloom.functions.lambdas import explode_once, inline_once, let
from pressloom.operators import svd
from pressloom.operators.joins import BROADCAST_ROWS, fits_broadcast, frequent_keys, lookup_join
from pressloom.operators.token_lookup import known_terms, term_arrays, token_arrays
from pressloom.session import staged, write_and_read

WINDOW = 5
CONTEXTS = 20_000


def token_counts(texts: DataFrame, text: str, terms: Column | None = None) -> DataFrame:
    """(token, n): occurrences over all texts; ``terms`` are the row's term counts where it has them."""
    if terms is None:
        return explode_once(texts, [], K.rouge_tokens(F.col(text)), "token").groupBy("token").agg(F.count("*").alias("n"))
    counts = explode_once(texts, [], terms, "t")
    return counts.groupBy(F.col("t.term").alias("token")).agg(F.sum("t.tf").alias("n"))


def cooccurrences(texts: DataFrame, text: str, window: int = WINDOW) -> DataFrame:
    """(token, context, n): how often two tokens stand at most ``window`` places apart, counted in both directions.

    A pair is counted once, in the order of its tokens, and turned round after the sum: half the rows are shuffled.
    """

    def following(tokens):
        return F.transform(tokens, lambda t, i: F.struct(t.alias("token"), F.slice(tokens, i + 2, F.lit(window)).alias("near")))

    words = texts.select(K.rouge_tokens(F.col(text)).alias("tokens"))
    heads = inline_once(words, [], let(F.col("tokens"), following), "token")
    pairs = explode_once(heads, ["token"], F.col("near"), "other")
    counted = pairs.groupBy(F.least("token", "other").alias("a"), F.greatest("token", "other").alias("b")).agg(F.count("*").alias("n"))
    # A token beside itself is one pair that counts twice.
    both = F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("token"), F.col("b").alias("context"), (2 * F.col("n")).alias("n")))).otherwise(
        F.array(*[F.struct(F.col(x).alias("token"), F.col(y).alias("context"), F.col("n").alias("n")) for x, y in ("ab", "ba")])
    )
    return inline_once(counted, [], both, "token")


def context_table(counts: DataFrame, contexts: int = CONTEXTS) -> DataFrame:
    """(term, term_id) of the most frequent tokens, ties by token, numbered in the order of the tokens."""
    top = counts.orderBy(F.desc("n"), "token").limit(contexts)
    # At most ``contexts`` rows are left, so one sorted partition is enough to number them.
    return top.select(F.col("token").alias("term"), (F.row_number().over(Window.orderBy("token")) - 1).alias("term_id"))


def pair_rows(pairs: DataFrame, counts: DataFrame, contexts: DataFrame, min_count: int = 2) -> DataFrame:
    """(token, row_n, entries) of tokens that occur ``min_count`` times: (term_id, n) of their pairs with known contexts.

    A row has at most as many entries as there are contexts. The pairs are read once and shuffled once.
    """
    kept = lookup_join(pairs, contexts.withColumnRenamed("term", "context"), "context", "token")
    rows = kept.groupBy("token").agg(F.sum("n").alias("row_n"), F.sort_array(F.collect_list(F.struct("term_id", "n"))).alias("entries"))
    return rows.join(counts.where(F.col("n") >= min_count).select("token"), "token", "left_semi")


def ppmi_rows(rows: DataFrame, contexts: DataFrame) -> DataFrame:
    """(token, features) of written ``pair_rows``: (term_id, n, weight) of the pairs above chance, in term_id order."""
    columns = inline_once(rows, [], F.col("entries"), "term_id").groupBy("term_id").agg(F.sum("n").alias("column_n"))
    columns = contexts.select("term_id").join(F.broadcast(columns), "term_id", "left")  # at most a row for each context
    in_order = F.sort_array(F.collect_list(F.struct("term_id", "column_n")))
    found = columns.agg(F.struct(in_order["term_id"].alias("ids"), in_order["column_n"].alias("n"), F.sum("column_n").alias("total")))

    def ratio(e, x):
        column_n = F.get(x["c"]["n"], e["term_id"] - F.get(x["c"]["ids"], F.lit(0)))
        return e["n"].cast("double") * x["c"]["total"] / (x["row_n"].cast("double") * column_n)

    def above(x):
        rated = F.transform(x["entries"], lambda e: F.struct(e["term_id"].alias("term_id"), e["n"].alias("n"), ratio(e, x).alias("ratio")))
        kept = F.filter(rated, lambda e: e["ratio"] > 1)
        return F.transform(kept, lambda e: F.struct(e["term_id"].alias("term_id"), e["n"].alias("n"), F.log(e["ratio"]).alias("weight")))

    # In a projection of its own, because the analyzer wants no subquery inside a lambda function.
    with_columns = rows.withColumn("_c", found.scalar())
    return with_columns.select("token", let(F.struct(F.col("_c").alias("c"), "row_n", "entries"), above).alias("features"))


def ppmi(pairs: DataFrame, counts: DataFrame, contexts: DataFrame, min_count: int = 2) -> DataFrame:
    """(token, term_id, context, n, ppmi) of all pairs above chance: tokens that occur ``min_count`` times, known contexts.

    ``ppmi`` is ln(n * all / (n of the token * n of the context)) with sums over the pairs that are kept.
    ``contexts`` are numbered without gaps, as by ``context_table``.
    """
    rows = write_and_read(pair_rows(pairs, counts, contexts, min_count), "pair-rows")
    above = inline_once(ppmi_rows(rows, contexts), ["token"], F.col("features"), "term_id")
    named = lookup_join(above, contexts.withColumnRenamed("term", "context"), "term_id", "token")
    return named.select("token", "term_id", "context", "n", F.col("weight").alias("ppmi"))


def fit_token_vectors(
    texts: DataFrame, text: str, size: int = 64, min_count: int = 2, window: int = WINDOW, contexts: int = CONTEXTS,
    seed: int = V.SEED,
) -> DataFrame:
    """(token, vector): the ``size`` first directions of the PPMI rows, each scaled by the root of its singular value.

    The vectors are the same, to rounding, however the texts are spread. A token has at most ``contexts`` entries, the
    driver holds a few (``contexts`` x ``size``) matrices. Tokens without any entry get the zero vector. Null texts have
    no tokens. With no tokens at all the table is empty.
    """
    spark = texts.sparkSession
    with staged(token_counts(texts, text), "token-counts") as counts, staged(context_table(counts, contexts), "contexts") as known:
        with staged(pair_rows(cooccurrences(texts, text, window), counts, known, min_count), "pair-rows") as pairs:
            entry = lambda e: F.struct(e["term_id"].alias("term_id"), e["weight"].alias("weight"))
            rows = ppmi_rows(pairs, known).select("token", F.transform("features", entry).alias("features"))
            rows = counts.where(F.col("n") >= min_count).select("token").join(rows, "token", "left")
            rows = rows.withColumn("features", F.coalesce("features", F.array().cast(rows.schema["features"].dataType)))
            with staged(rows, "ppmi-rows") as features:
                if features.isEmpty():
                    return spark.createDataFrame([], "token string, vector array<double>")
                loadings, values = svd.fit_svd(features, known, size, seed)
                scale = F.array(*[F.lit(s**-0.5 if s > 1e-9 * values[0] else 0.0) for s in values])
                projected = svd.svd_transform(features, loadings, out="_v")
                vectors = projected.select("token", F.zip_with("_v", scale, lambda x, s: x * s).alias("vector"))
                return write_and_read(vectors, "token-vectors")


def weigh_tokens(token_vectors: DataFrame, counts: DataFrame, a: float = 1e-3) -> DataFrame:
    """(token, vector, weight): smooth inverse frequency, a / (a + share of the token among all occurrences)."""
    total = counts.agg(F.sum("n").alias("total")).scalar()
    share = F.col("n") / F.col("total")
    weighed = counts.withColumn("total", total).select("token", (F.lit(a) / (F.lit(a) + share)).alias("weight"))
    return token_vectors.select("token", "vector").join(weighed, "token")


def _known_sums(texts: DataFrame, scaled: DataFrame) -> Column:
    """Struct (s, n) of a row: the sum of its tokens' vectors in ``scaled``, and their number. ``scaled`` goes to every task.

    A token with several vectors counts with each of them, as in a join.
    """
    tokens, matrix = token_arrays(scaled)
    names = tokens.to_pylist()
    first = np.array([i for i, name in enumerate(names) if i == 0 or name != names[i - 1]], dtype=np.int64)
    if len(first):
        matrix = np.add.reduceat(matrix, first, axis=0)
    times = np.diff(first, append=len(names))
    shared = texts.sparkSession.sparkContext.broadcast((tokens.take(pa.array(first)), matrix, times))

    @F.arrow_udf("s array<double>, n long")
    def add_up(terms: pa.Array, tf: pa.Array) -> pa.Array:
        tokens, matrix, times = shared.value
        known, sums, n = known_terms(tokens, terms, tf), np.zeros((len(terms), matrix.shape[1])), np.zeros(len(terms), np.int64)
        for i in range(len(terms)):
            at, counts = known(i)
            sums[i], n[i] = counts @ matrix[at], counts @ times[at]
        lists = pa.FixedSizeListArray.from_arrays(pa.array(sums.ravel()), sums.shape[1]).cast(pa.list_(pa.float64()))
        return pa.StructArray.from_arrays([lists, pa.array(n)], ["s", "n"])

    return add_up.asNondeterministic()(*term_arrays("terms"))


def _sums(texts: DataFrame, weighed: DataFrame, counts: DataFrame, id_col: str, max_dictionary: int = BROADCAST_ROWS) -> DataFrame:
    """(id, vector): the weighted mean of a text's known tokens, of its term counts ``terms``.

    Frequent tokens are added up inside the row; only the vectors of rare ones are shuffled, a few for each text.
    """
    scaled = weighed.select("token", F.transform("vector", lambda x: x.cast("double") * F.col("weight")).alias("vector"))
    if fits_broadcast(scaled, max_dictionary):
        sums = texts.select(id_col, _known_sums(texts, scaled).alias("_k")).select(id_col, "_k.*")
    else:
        frequent = write_and_read(frequent_keys(scaled, counts, "token", max_dictionary), "frequent")
        sums = texts.select(id_col, _known_sums(texts, scaled.join(F.broadcast(frequent), "token", "left_semi")).alias("_k")).select(id_col, "_k.*")
        long = inline_once(texts, [id_col], F.col("terms"), "term").withColumnRenamed("term", "token")
        rare = long.join(F.broadcast(frequent), "token", "left_anti").join(scaled.where("vector is not null"), "token")
        sums = sums.unionAll(rare.select(id_col, F.transform("vector", lambda x: x * F.col("tf")), F.col("tf").cast("long")))
    sums = sums.where("n > 0").groupBy(id_col).agg(vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("_s"), F.sum("n").alias("_n"))
    return sums.select(id_col, let(F.struct("_s", "_n"), lambda x: F.transform(x["_s"], lambda v: v / x["_n"])).alias("vector"))


def common_direction(vectors: DataFrame, vector: str = "vector") -> list[float]:
    """First right singular vector of all rows: tasks add up (size x size) products, the driver solves that matrix only."""

    def products(batches):
        total = 0.0
        for batch in batches:
            rows = batch.column(0).drop_null()
            if len(rows):
                matrix = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
                total = total + matrix.T @ matrix
        if np.ndim(total):
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total))], ["pos", "sums"])

    partials = vectors.select(vector).mapInArrow(products, "pos int, sums array<double>")
    summed = partials.groupBy("pos").agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))
    rows = [r["sums"] for r in summed.orderBy("pos").collect()]
    return np.linalg.eigh(np.array(rows))[1][:, -1].tolist() if rows else []


def _without(vector: Column, direction: list[float]) -> Column:
    axis = F.array(*[F.lit(float(x)) for x in direction])

    def less(v):
        along = F.aggregate(F.zip_with(v, axis, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        return let(F.struct(v.alias("v"), along.alias("d")), lambda s: F.zip_with(s["v"], axis, lambda x, y: x - s["d"] * y))

    return let(vector, less)


def embed_pairs(
    df: DataFrame, token_vectors: DataFrame, gen: str = "generated_text", ref: str = "target", id_col: str = "id", a: float = 1e-3,
) -> DataFrame:
    """(id, generated_vec, target_vec): weighted token vectors of both texts less their first common direction.

    Shares of tokens and the direction come from all texts of both columns. A text without a known token has a null vector.
    ``id_col`` must tell the rows apart.
    """
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(c).alias("text")) for s, c in (("g", gen), ("r", ref))])
    texts = inline_once(df, [id_col], sides, "side")
    texts = texts.select(F.struct(id_col, "side").alias("key"), K.term_counts(K.rouge_tokens(F.col("text"))).alias("terms"))
    with staged(texts, "sides") as both, staged(token_counts(both, "", F.col("terms")), "token-counts") as counts:
        vectors = write_and_read(_sums(both, weigh_tokens(token_vectors, counts, a), counts, "key"), "text-vectors")
        known = vectors.select("key.*", _without(F.col("vector"), common_direction(vectors)).alias("vector"))
    picked = [F.max(F.when(F.col("side") == s, F.col("vector"))).alias(c) for s, c in (("g", "generated_vec"), ("r", "target_vec"))]
    return known.groupBy(id_col).agg(*picked)
