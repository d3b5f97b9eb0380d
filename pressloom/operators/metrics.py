"""Text-similarity metrics of (generated, reference) pairs.

A pair is one row, and so is its score: token counts, clipped overlaps and longest common subsequences
are taken inside the row. No pair is exploded, joined or matched with another one.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressloom.functions import fixed_values as V
from pressloom.functions import tokens as K
from pressloom.functions.lambdas import explode_once, let, posexplode_once
from pressloom.functions.stemming import stem_tokens
from pressloom.functions.vectors import cosine, dot, sparse_dot, unit
from pressloom.operators.joins import fits_broadcast, frequent_keys
from pressloom.operators.tfidf import tfidf_features
from pressloom.operators.token_lookup import known_terms, rare_rows, rare_type, rare_vectors, term_arrays, token_arrays
from pressloom.operators.token_vectors import embed_pairs
from pressloom.session import write_and_read


def f_measure(overlap: Column, generated_size: Column, reference_size: Column) -> Column:
    total = generated_size + reference_size
    return F.when(total == 0, F.lit(0.0)).otherwise(F.try_divide(2.0 * overlap, total.cast("double")))


def clipped_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two token arrays."""

    def as_map(tokens):
        return F.map_from_entries(K.term_counts(tokens))

    shared = F.map_zip_with(
        as_map(a), as_map(b), lambda _, x, y: F.least(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0)))
    )
    return F.aggregate(F.map_values(shared), F.lit(0), lambda acc, x: acc + x)


def pair_tokens(c: Column, stem: bool = False) -> Column:
    tokens = K.rouge_tokens(c)
    return stem_tokens(tokens) if stem else tokens


def rouge_n(generated: Column, reference: Column, n: int) -> Column:
    """ROUGE-1 or ROUGE-2 F-measure of two token arrays."""

    def score(p):
        a, b = (p["g"], p["r"]) if n == 1 else (K.bigrams(p["g"]), K.bigrams(p["r"]))
        return let(
            F.struct(a.alias("a"), b.alias("b")),
            lambda q: f_measure(clipped_overlap(q["a"], q["b"]), F.size(q["a"]), F.size(q["b"])),
        )

    return let(F.struct(generated.alias("g"), reference.alias("r")), score)


@F.pandas_udf(T.IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence, bit-parallel (Hyyro 2004): one integer is one table row."""

    def length(x, y):
        if len(x) > len(y):
            x, y = y, x
        masks = {}
        for i, token in enumerate(x):
            masks[token] = masks.get(token, 0) | (1 << i)
        full = (1 << len(x)) - 1
        row = full
        for token in y:
            hit = row & masks.get(token, 0)
            row = ((row + hit) | (row - hit)) & full
        return len(x) - row.bit_count()

    return pd.Series([length(x, y) for x, y in zip(a, b)], dtype="int32")


def rouge_l(generated: Column, reference: Column) -> Column:
    # Not deterministic for the optimizer: a filter on the score must not be pushed into a join below, nor run it twice.
    return f_measure(lcs_length.asNondeterministic()(generated, reference), F.size(generated), F.size(reference))


def with_rouge(
    df: DataFrame, gen: str = "generated_text", ref: str = "target", stem: bool = True, which=("rouge1", "rouge2", "rougeL")
) -> DataFrame:
    """Add the chosen ROUGE F-measures; each text is tokenised and stemmed once."""
    tokens = df.withColumns({"_g": pair_tokens(F.col(gen), stem), "_r": pair_tokens(F.col(ref), stem)})
    g, r = F.col("_g"), F.col("_r")
    scores = {}
    if "rouge1" in which:
        scores["rouge1"] = rouge_n(g, r, 1)
    if "rouge2" in which:
        scores["rouge2"] = rouge_n(g, r, 2)
    if "rougeL" in which:
        scores["rougeL"] = rouge_l(g, r)
    return tokens.withColumns(scores).drop("_g", "_r")


def stem_dictionary(texts: DataFrame, text: str) -> DataFrame:
    """(token, stem) of every distinct token."""
    words = explode_once(texts, [], F.array_distinct(K.rouge_tokens(F.col(text))), "token").distinct()
    return words.withColumn("stem", stem_tokens(F.array("token"))[0])


def embed_text(text: Column, factory: Callable[[], Callable[[list[str]], np.ndarray]], batch_size: int = 64) -> Column:
    """Dense vectors from a pluggable encoder that ``factory`` builds once per task."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = factory()
        for texts in batches:
            texts = texts.fillna("")
            rows = []
            for i in range(0, len(texts), batch_size):
                rows.extend(np.asarray(encoder(texts.iloc[i : i + batch_size].tolist()), dtype="float64"))
            yield pd.Series(rows, dtype="object")

    return encode.asNondeterministic()(text)


def with_similarity(
    df: DataFrame, vocabulary: DataFrame | None = None, encoder=None, gen: str = "generated_text", ref: str = "target",
    id_col: str = "id", sentence_vectors: DataFrame | None = None,
) -> DataFrame:
    """Add ``sbert_similarity``: cosine of encoder vectors, of weighted token vectors, or of TF-IDF rows.

    ``sentence_vectors`` is a (token, vector) table; a text without a known token is like nothing (0).
    """
    if encoder is None and sentence_vectors is not None:
        pair = df.join(embed_pairs(df, sentence_vectors, gen, ref, id_col), id_col, "left")
        likeness = F.coalesce(cosine(F.col("generated_vec"), F.col("target_vec")), F.lit(0.0))
        return pair.withColumn("sbert_similarity", likeness).drop("generated_vec", "target_vec")
    if encoder is not None:
        pair = df.withColumns({"_g": embed_text(F.col(gen), encoder), "_r": embed_text(F.col(ref), encoder)})
        return pair.withColumn("sbert_similarity", cosine(F.col("_g"), F.col("_r"))).drop("_g", "_r")
    if vocabulary is None:
        raise ValueError("similarity needs an encoder or a fitted vocabulary")
    pair = tfidf_features(df, F.col(gen), vocabulary, id_col, out="_g")
    pair = tfidf_features(pair, F.col(ref), vocabulary, id_col, out="_r")
    return pair.withColumn("sbert_similarity", sparse_dot(F.col("_g"), F.col("_r"))).drop("_g", "_r")


_MATCH_TYPE = T.StructType([T.StructField("p", T.DoubleType()), T.StructField("r", T.DoubleType())])


def _greedy_match(gen: np.ndarray, gen_count: np.ndarray, ref: np.ndarray, ref_count: np.ndarray):
    """Mean best cosine of each side against the other, over unit vectors that occur ``count`` times."""
    if len(gen) == 0 or len(ref) == 0:
        return 0.0, 0.0
    best_ref, precision = np.full(len(ref), -np.inf), 0.0
    for i in range(0, len(gen), 512):  # a block of rows at a time: two long texts must not need their whole matrix
        similarity = gen[i : i + 512] @ ref.T
        precision += float(similarity.max(axis=1) @ gen_count[i : i + 512])
        np.maximum(best_ref, similarity.max(axis=0), out=best_ref)
    return precision / gen_count.sum(), float(best_ref @ ref_count / ref_count.sum())


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    matrix = matrix.astype("float64")
    length = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return matrix / np.where(length == 0, 1.0, length)


def _match_rows(df: DataFrame, vectors: DataFrame, rare: Column) -> DataFrame:
    """Add ``_m`` from the term counts ``_g`` and ``_r``, the few ``vectors`` in every task and a row's own ``rare`` ones."""
    tokens, matrix = token_arrays(vectors)
    shared = df.sparkSession.sparkContext.broadcast((tokens, _unit_rows(matrix)))

    @F.arrow_udf(_MATCH_TYPE)
    def match(g: pa.Array, g_tf: pa.Array, r: pa.Array, r_tf: pa.Array, rare: pa.Array) -> pa.Array:
        tokens, matrix = shared.value
        known, own = [known_terms(tokens, *lists) for lists in ((g, g_tf), (r, r_tf))], rare_rows(rare)

        def side(nr, i):
            (at, counts), (mine, mine_counts) = known[nr](i), own(i, nr)
            if not len(mine):
                return matrix[at], counts
            found = _unit_rows(mine)
            return (np.vstack([matrix[at], found]), np.concatenate([counts, mine_counts])) if len(at) else (found, mine_counts)

        rows = np.array([_greedy_match(*side(0, i), *side(1, i)) for i in range(len(g))]).reshape(-1, 2)
        return pa.StructArray.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], ["p", "r"])

    # Each count is mentioned twice, so that the optimizer leaves it in a projection below the function, where it is made once.
    return df.withColumn("_m", match.asNondeterministic()(*term_arrays("_g"), *term_arrays("_r"), rare))


def _match_by_dictionary(df: DataFrame, vectors: DataFrame, g: Column, r: Column) -> DataFrame:
    counted = df.withColumns({"_g": K.term_counts(g), "_r": K.term_counts(r)})
    none = F.array().cast(rare_type(vectors))
    return _match_rows(counted, vectors, none).drop("_g", "_r")


def _match_by_parts(df: DataFrame, vectors: DataFrame, g: Column, r: Column, key: Column, max_dictionary: int) -> DataFrame:
    """For a token table of any size: the vectors of the most frequent tokens go to every task as a dictionary. The others
    are rare, so few (row, token) are left whose vectors are shuffled to their rows.
    """
    found = explode_once(df, [], F.concat(F.array_distinct(g), F.array_distinct(r)), "token").groupBy("token")
    counts = write_and_read(found.agg(F.count("*").alias("n")), "row-counts")
    frequent = write_and_read(frequent_keys(vectors, counts, "token", max_dictionary), "frequent")
    sides = {"_key": key, "_g": K.term_counts(g), "_r": K.term_counts(r)}
    rare = rare_vectors(df.select(*[c.alias(n) for n, c in sides.items()]), ("_g", "_r"), vectors, frequent, "_key")
    dictionary = vectors.join(F.broadcast(frequent), "token", "left_semi")
    keyed = df.withColumn("_key", key).join(rare, "_key", "left").withColumns({"_g": sides["_g"], "_r": sides["_r"]})
    return _match_rows(keyed, dictionary, F.col("_rare")).drop("_g", "_r", "_key", "_rare")


def with_soft_match(
    df: DataFrame, token_vectors: DataFrame, gen: str = "generated_text", ref: str = "target", id_col: str = "id",
    max_dictionary: int = 200_000,
) -> DataFrame:
    """Add ``bertscore_p``, ``bertscore_r`` and ``bertscore_f1`` from a (token, vector) table.

    Every token is matched to the most similar token of the other text. Tokens without a vector do not
    count; a text without any known token scores 0.
    """
    vectors = token_vectors.select("token", "vector")
    g, r = K.rouge_tokens(F.col(gen)), K.rouge_tokens(F.col(ref))
    if fits_broadcast(vectors, max_dictionary):
        matched = _match_by_dictionary(df, vectors, g, r)
    else:
        # Rows that share id and texts share their score; ids alone may repeat or be null.
        texts = F.struct(F.col(id_col).alias("id"), F.col(gen).alias("g"), F.col(ref).alias("r"))
        matched = _match_by_parts(df, vectors, g, r, F.unhex(F.sha2(F.to_json(texts), 256)), max_dictionary)
    p, q = F.coalesce("_m.p", F.lit(0.0)), F.coalesce("_m.r", F.lit(0.0))
    return matched.withColumns(
        {
            "bertscore_p": p,
            "bertscore_r": q,
            "bertscore_f1": F.when(p + q == 0, F.lit(0.0)).otherwise(F.try_divide(2 * p * q, p + q)),
        }
    ).drop("_m")


def train_token_vectors(
    texts: DataFrame, text: str, size: int = 64, min_count: int = 2, partitions: int = 8, seed: int = V.SEED
) -> DataFrame:
    """Default token table: Word2Vec trained on the given texts, every token that occurs ``min_count`` times.

    The texts are dealt by value into a fixed number of ``partitions``, so the vectors do not change with the cluster.
    Spark's model holds tokens x ``size`` numbers on the driver; for a larger vocabulary pass a table of vectors.
    """
    words = texts.select(K.rouge_tokens(F.col(text)).alias("tokens"))
    dealt = words.repartition(partitions, F.xxhash64("tokens")).sortWithinPartitions("tokens")
    word2vec = Word2Vec(vectorSize=size, minCount=min_count, seed=seed, inputCol="tokens", maxIter=1, numPartitions=partitions)
    return word2vec.fit(dealt).getVectors().select(F.col("word").alias("token"), vector_to_array("vector").alias("vector"))


METRIC_GROUPS = {
    "sbert": ["sbert_similarity"],
    "rouge": ["rouge1", "rouge2", "rougeL"],
    "bertscore": ["bertscore_p", "bertscore_r", "bertscore_f1"],
}


def evaluate_generations(
    df: DataFrame,
    run_sbert: bool = True,
    run_rouge: bool = True,
    run_bertscore: bool = True,
    vocabulary: DataFrame | None = None,
    encoder=None,
    token_vectors: DataFrame | None = None,
    stem: bool = True,
    id_col: str = "id",
    sentence_vectors: DataFrame | None = None,
) -> DataFrame:
    """Add the columns of the chosen metric groups. A missing text counts as ''."""
    if run_sbert:
        df = with_similarity(df, vocabulary, encoder, id_col=id_col, sentence_vectors=sentence_vectors)
    if run_rouge:
        df = with_rouge(df, stem=stem)
    if run_bertscore:
        if token_vectors is None:
            raise ValueError("the soft match needs a (token, vector) table")
        df = with_soft_match(df, token_vectors, id_col=id_col)
    return df


def ensure_metrics(df: DataFrame, run_sbert: bool = True, run_rouge: bool = True, run_bertscore: bool = True, **models) -> DataFrame:
    """Compute only the wanted groups of which a column is missing."""

    def missing(group):
        return any(c not in df.columns for c in METRIC_GROUPS[group])

    wanted = {
        "sbert": run_sbert and missing("sbert"),
        "rouge": run_rouge and missing("rouge"),
        "bertscore": run_bertscore and missing("bertscore"),
    }
    stale = [c for group, on in wanted.items() if on for c in METRIC_GROUPS[group] if c in df.columns]
    flags = {f"run_{group}": on for group, on in wanted.items()}
    return evaluate_generations(df.drop(*stale), **flags, **models)


def contrast_ratio(df: DataFrame, gen: str = "generated_vec", ref: str = "target_vec") -> DataFrame:
    """Mean similarity of matched pairs over the mean similarity to all other items' targets.

    Dot products are linear: over all pairs of different rows they add up to the product of the two vector sums less
    the matched ones. So one pass with a sum per dimension, combined map-side, compares everything with everything.
    Pairs with a missing vector do not count; a zero vector is like nothing (0).
    """
    units = df.select(unit(F.col(gen)).alias("g"), unit(F.col(ref)).alias("r")).where("g is not null and r is not null")
    long = posexplode_once(units, [], F.arrays_zip("g", "r"), "pos", "x")
    sums = long.groupBy("pos").agg(F.sum("x.g").alias("g"), F.sum("x.r").alias("r"), F.sum(F.col("x.g") * F.col("x.r")).alias("m"), F.count("x").alias("n"))
    total = sums.agg(F.sum(F.col("g") * F.col("r")).alias("all"), F.sum("m").alias("matched"), F.max("n").alias("n"))
    pairs = F.col("n") * (F.col("n") - 1)
    return total.select(
        F.try_divide("matched", "n").alias("matched_mean"), F.try_divide(F.col("all") - F.col("matched"), pairs).alias("unrelated_mean")
    ).withColumn("contrast_ratio", F.try_divide("matched_mean", "unrelated_mean"))
