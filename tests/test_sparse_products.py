"""Products of sparse rows with a dense matrix, and PPMI rows from one reading of the pairs."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressloom.operators import svd
from pressloom.operators import token_vectors as W


def _sparse(rows, terms, seed=1):
    rng = np.random.default_rng(seed)
    lengths = rng.choice([0, 1, 2, 3, 5, 17, 64], rows)
    term = np.concatenate([np.sort(rng.choice(terms, n, replace=False)) for n in lengths]).astype(np.int32)
    weight = rng.random(len(term))
    dense = np.zeros((rows, terms))
    dense[np.repeat(np.arange(rows), lengths), term] = weight
    return lengths, term, weight, dense, rng.standard_normal((terms, 40))


def test_row_products_gather_a_few_thousand_entries_at_a_time():
    lengths, term, weight, dense, matrix = _sparse(6_000, 100)
    tracemalloc.start()
    found = svd._row_products(lengths, term, weight, matrix)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(found, dense @ matrix, atol=1e-12)
    assert peak < 0.5 * len(term) * matrix.shape[1] * 8  # a matrix row for every entry was twice gathered


@pytest.mark.parametrize("rows, terms", [(200, 700), (40, 64)])
def test_gram_products_are_added_up_over_runs_of_terms(spark, rows, terms):
    lengths, term, weight, dense, matrix = _sparse(rows, terms)
    cuts = np.cumsum(lengths)[:-1]
    data = [(t.tolist(), w.tolist()) for t, w in zip(np.split(term, cuts), np.split(weight, cuts), strict=True)]
    table = spark.createDataFrame(data, "ids array<int>, weights array<double>").repartition(5)
    assert np.allclose(svd._gram_times(table, matrix), dense.T @ (dense @ matrix), atol=1e-10)
    assert not svd._gram_times(table.limit(0), matrix).any()


def test_pair_rows_hold_every_kept_pair_once(spark):
    texts = spark.createDataFrame([("a b a c",), ("b c d",), (None,), ("a b",)], "text string")
    counts, pairs = W.token_counts(texts, "text"), W.cooccurrences(texts, "text", 2)
    assert {r["token"]: r["n"] for r in counts.collect()} == {"a": 3, "b": 3, "c": 2, "d": 1}
    rows = W.pair_rows(pairs, counts, W.context_table(counts, 3), min_count=2).collect()
    assert {r["token"]: sum(e["n"] for e in r["entries"]) for r in rows} == {r["token"]: r["row_n"] for r in rows}
    kept = pairs.where(F.col("token").isin("a", "b", "c") & F.col("context").isin("a", "b", "c")).collect()
    names = dict(enumerate("abc"))
    assert sorted((r["token"], names[e["term_id"]], e["n"]) for r in rows for e in r["entries"]) == sorted(map(tuple, kept))
