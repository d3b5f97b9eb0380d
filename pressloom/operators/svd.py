"""Truncated SVD of the TF-IDF matrix and projection of documents to dense vectors.

Randomized subspace iteration (Halko, Martinsson, Tropp 2011). Each pass is one Spark job: tasks turn
their sparse rows into partial sums of X'(XQ), a shuffle adds them up per term, and only the small
(terms x components) matrix comes to the driver for its QR step. Its size is bounded by the vocabulary
limit, never by the number of documents.
"""

import logging

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressloom.functions import fixed_values as V
from pressloom.functions.lambdas import explode_once, posexplode_once

log = logging.getLogger(__name__)

_OVERSAMPLE = 10
#: Blocks of directions that are kept before they are condensed into one.
_BLOCKS = 4
_SLICE_ENTRIES = 100_000
#: Entries whose matrix rows are gathered at a time.
_GATHERED = 2_048
#: Terms whose partial sums travel as one row.
_RUN = 256


def sparse_rows(features: DataFrame) -> DataFrame:
    """Parallel id and weight arrays, the form the numeric passes read."""
    return features.select(
        F.transform("features", lambda e: e["term_id"]).alias("ids"),
        F.transform("features", lambda e: e["weight"]).alias("weights"),
    )


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and concatenated values of a list array."""
    return pc.list_value_length(lists).to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)


def _slices(ids: pa.Array, weights: pa.Array):
    """(lengths, terms, weights) of runs of whole rows, about ``_SLICE_ENTRIES`` entries each: memory follows that number
    and the longest row, not the batch."""
    lengths, term = _flat(ids)
    _, weight = _flat(weights)
    ends = np.cumsum(lengths)
    row = entry = 0
    while row < len(lengths):
        last = max(row + 1, int(np.searchsorted(ends, entry + _SLICE_ENTRIES, side="right")))
        stop = int(ends[last - 1])
        yield lengths[row:last], term[entry:stop], weight[entry:stop]
        row, entry = last, stop


def _add_products(out: np.ndarray, segment: np.ndarray, column: np.ndarray, weight: np.ndarray, matrix: np.ndarray) -> None:
    """Add to each row of ``out`` the weighted rows of ``matrix`` that its segment names; entries of a segment stand together.

    Segments are filled up to a power of two with weight 0, so that those of like length are one product, a few thousand
    entries at a time: what is gathered stays in the processor's cache.
    """
    first = np.flatnonzero(np.diff(segment, prepend=-1))
    length = np.diff(first, append=len(segment))
    kind = np.ceil(np.log2(length)).astype(int)
    for power in np.unique(kind):
        width, members = 1 << int(power), np.flatnonzero(kind == power)
        step, places = max(1, _GATHERED >> int(power)), np.arange(width)
        for start in range(0, len(members), step):
            some = members[start : start + step]
            inside = places < length[some, None]
            at = first[some, None] + np.where(inside, places, 0)
            weights = np.where(inside, weight[at], 0.0)
            out[segment[first[some]]] += np.matmul(weights[:, None, :], matrix[column[at]])[:, 0]


def _row_products(lengths: np.ndarray, term: np.ndarray, weight: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Sparse rows, given by their lengths and flat entries, times a (terms x k) matrix."""
    out = np.zeros((len(lengths), matrix.shape[1]))
    _add_products(out, np.repeat(np.arange(len(lengths)), lengths), term, weight, matrix)
    return out


def _gram_times(rows: DataFrame, q: np.ndarray) -> np.ndarray:
    """X'X q, with X spread over the rows of a DataFrame."""
    shared, width = rows.sparkSession.sparkContext.broadcast(q), q.shape[1]

    def lines(sums):
        """Runs of terms with their sums: (run, bytes of the places in it, bytes of the sums)."""
        for run, (places, values) in sums:
            columns = [pa.array([run], pa.int32()), pa.array([places.astype("<i4").tobytes()]), pa.array([values.astype("<f8").tobytes()])]
            yield pa.RecordBatch.from_arrays(columns, ["run", "places", "sums"])

    def partial_sums(batches):
        matrix = shared.value
        total, seen = np.zeros(matrix.shape), np.zeros(len(matrix), dtype=bool)
        for batch in batches:
            for lengths, term, weight in _slices(batch.column("ids"), batch.column("weights")):
                if len(term) == 0:
                    continue
                projected = _row_products(lengths, term, weight, matrix)
                order = np.argsort(term, kind="stable")
                row = np.repeat(np.arange(len(lengths)), lengths)
                _add_products(total, term[order], row[order], weight[order], projected)
                seen[term] = True
        touched = np.flatnonzero(seen)
        cuts = np.flatnonzero(np.diff(touched // _RUN)) + 1
        runs = [t for t in np.split(touched, cuts) if len(t)]
        yield from lines((int(t[0]) // _RUN, (t % _RUN, total[t])) for t in runs)

    def add_up(batches):
        found = {}
        for batch in batches:
            for run, places, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if run not in found:
                    found[run] = np.zeros((_RUN, width)), np.zeros(_RUN, dtype=bool)
                at = np.frombuffer(places, "<i4")
                found[run][0][at] += np.frombuffer(sums, "<f8").reshape(-1, width)
                found[run][1][at] = True
        yield from lines((run, (np.flatnonzero(seen), total[seen])) for run, (total, seen) in found.items())

    # Two partial results per core, not one per partition: what is shuffled stays small however many rows there are.
    tasks = 2 * rows.sparkSession.sparkContext.defaultParallelism
    kind = "run int, places binary, sums binary"
    table = rows.coalesce(tasks).mapInArrow(partial_sums, kind).repartition("run").mapInArrow(add_up, kind).toArrow()
    shared.unpersist()
    result = np.zeros(q.shape)
    for run, places, sums in zip(*(table.column(c).to_pylist() for c in ("run", "places", "sums")), strict=True):
        result[run * _RUN + np.frombuffer(places, "<i4")] = np.frombuffer(sums, "<f8").reshape(-1, width)
    return result


def _beyond(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Orthonormal directions of ``block`` outside ``basis``; twice, because one step loses digits."""
    for _ in range(2):
        block = np.linalg.qr(block - basis @ (basis.T @ block))[0]
    return block


def fit_svd(
    features: DataFrame,
    vocabulary: DataFrame,
    components: int = V.SVD_COMPONENTS,
    seed: int = V.SEED,
    tolerance: float = 1e-4,
    max_passes: int = 50,
) -> tuple[DataFrame, list[float]]:
    """Components as (term_id, term, vector) and the singular values, largest first.

    Block Lanczos: each pass multiplies one new block of directions, and the components come from all blocks kept so
    far, so a few passes are enough. After ``_BLOCKS`` blocks the best directions go on as one, which bounds the
    driver's memory. Passes go on until the sum of the singular values grows by less than ``tolerance`` of itself, at
    most ``max_passes`` times (a warning says so). ``features`` is read once per pass, so its sparse rows are cached
    for the fit; a lost executor's part is computed again from the source.
    """
    spark = features.sparkSession
    terms = vocabulary.select("term_id", "term").orderBy("term_id").toArrow()
    n_terms = terms.num_rows
    k = min(components, n_terms)
    width = min(k + _OVERSAMPLE, n_terms)
    rows = sparse_rows(features).persist()
    try:
        q = np.linalg.qr(np.random.default_rng(seed).standard_normal((n_terms, width)))[0]
        basis = images = q[:, :0]
        before = 0.0
        for _ in range(max_passes):
            basis, images = np.hstack([basis, q]), np.hstack([images, _gram_times(rows, q)])
            # Rayleigh-Ritz on the basis whose images are known: no further pass over the data.
            small = basis.T @ images
            values, turn = np.linalg.eigh((small + small.T) / 2)
            values, turn = values[::-1], turn[:, ::-1]
            reached = float(np.sqrt(np.clip(values[:k], 0, None)).sum())
            if reached - before <= tolerance * reached or basis.shape[1] == n_terms:
                break
            before = reached
            q = _beyond(images[:, -q.shape[1] :], basis)[:, : n_terms - basis.shape[1]]
            if basis.shape[1] >= _BLOCKS * width and n_terms > 2 * _BLOCKS * width:
                basis, images, turn = basis @ turn[:, :width], images @ turn[:, :width], np.eye(width)
        else:
            log.warning("singular values still grow after %d passes", max_passes)
    finally:
        rows.unpersist()
    basis = basis @ turn[:, :k]
    basis *= np.where(basis[np.abs(basis).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
    vectors = pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(basis).ravel()), k)
    table = pa.table([terms.column("term_id"), terms.column("term"), vectors.cast(pa.list_(pa.float64()))],
                     ["term_id", "term", "vector"])
    return spark.createDataFrame(table), np.sqrt(np.clip(values[:k], 0, None)).tolist()


def for_vocabulary(components: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term_id, term, vector) for every term of ``vocabulary``; one that ``components`` (term, vector) lack is zero."""
    width = components.select(F.size("vector")).first()
    zero = F.array_repeat(F.lit(0.0), width[0] if width else 0)
    found = vocabulary.select("term_id", "term").join(components.select("term", F.col("vector").cast("array<double>")), "term", "left")
    return found.select("term_id", "term", F.coalesce("vector", zero).alias("vector"))


def component_matrix(components: DataFrame) -> np.ndarray:
    table = components.select("term_id", "vector").orderBy("term_id").toArrow()
    _, values = _flat(table.column("vector").combine_chunks())
    return values.reshape(table.num_rows, -1) if table.num_rows else np.zeros((0, 0))


def svd_transform(df: DataFrame, components: DataFrame, features: str = "features", out: str = "svd_vector") -> DataFrame:
    """Add the dense vector of each sparse row: one Arrow stage, no shuffle."""
    matrix = df.sparkSession.sparkContext.broadcast(component_matrix(components))

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def project(ids: pa.Array, weights: pa.Array) -> pa.Array:
        dense, row = np.zeros((len(ids), matrix.value.shape[1])), 0
        for lengths, term, weight in _slices(ids, weights):
            dense[row : row + len(lengths)] = _row_products(lengths, term, weight, matrix.value)
            row += len(lengths)
        rows = pa.FixedSizeListArray.from_arrays(pa.array(dense.ravel()), dense.shape[1])
        return rows.cast(pa.list_(pa.float64()))

    ids = F.transform(features, lambda e: e["term_id"])
    weights = F.transform(features, lambda e: e["weight"])
    # Not deterministic for the optimizer's purposes: a filter on the result must not run the projection twice.
    return df.withColumn(out, project.asNondeterministic()(ids, weights))


def explained_variance(df: DataFrame, features: str = "features", vector: str = "svd_vector") -> DataFrame:
    """(component, variance, ratio): variance of each component over the summed variance of all terms."""
    n = df.count()
    per_term = (
        explode_once(df, [], F.col(features), "e")
        .groupBy("e.term_id")
        .agg(F.sum("e.weight").alias("s"), F.sum(F.col("e.weight") * F.col("e.weight")).alias("ss"))
    )
    total = per_term.agg(F.sum(F.col("ss") / n - (F.col("s") / n) * (F.col("s") / n)).alias("total")).scalar()
    # Summarizer gives the sample variance; (n - 1) / n turns it into the population variance.
    variances = df.agg(vector_to_array(Summarizer.variance(array_to_vector(F.col(vector)))).alias("v"))
    return (
        posexplode_once(variances, [], F.col("v"), "component", "variance")
        .withColumn("variance", F.col("variance") * ((n - 1) / n if n else 0.0))
        .withColumn("ratio", F.try_divide("variance", total))
    )
