"""Token vectors from co-occurrence counts and text vectors from them, against plain Python and dense linear algebra."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressloom.operators import token_vectors as W
from pressloom.operators.metrics import with_rouge, with_similarity, with_soft_match

TEXTS = [
    "The cat sat on the mat, the cat slept.", "A dog sat on a log; the dog slept", "the the the", "", None, "lonely",
    "Cat and dog sat together on the mat", "The log is on the mat" , "The log is on the mat",
]


def words(text):
    return re.findall(r"[a-z0-9]+", (text or "").lower())


def brute(texts, window, contexts, min_count):
    counts, pairs = Counter(), Counter()
    for text in texts:
        w = words(text)
        counts.update(w)
        for i, j in ((i, j) for i in range(len(w)) for j in range(len(w)) if i != j and abs(i - j) <= window):
            pairs[w[i], w[j]] += 1
    known = {t for t, _ in sorted(counts.items(), key=lambda e: (-e[1], e[0]))[:contexts]}
    kept = {(a, b): n for (a, b), n in pairs.items() if counts[a] >= min_count and b in known}
    row, column = Counter(), Counter()
    for (a, b), n in kept.items():
        row[a] += n
        column[b] += n
    total = sum(kept.values())
    values = {(a, b): math.log(n * total / (row[a] * column[b])) for (a, b), n in kept.items()}
    return counts, known, {p: v for p, v in values.items() if v > 0}


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")


@pytest.mark.parametrize("window, contexts, min_count", [(5, 100, 1), (2, 5, 2), (1, 3, 1)])
def test_ppmi_equals_plain_python(texts, window, contexts, min_count):
    counts = W.token_counts(texts, "text")
    found = W.ppmi(W.cooccurrences(texts, "text", window), counts, W.context_table(counts, contexts), min_count)
    expected_counts, _, expected = brute(TEXTS, window, contexts, min_count)
    assert {r["token"]: r["n"] for r in counts.collect()} == expected_counts
    got = {(r["token"], r["context"]): r["ppmi"] for r in found.collect() if r["ppmi"] > 1e-12}
    assert got == pytest.approx({p: v for p, v in expected.items() if v > 1e-12})


def table(df):
    return {r["token"]: np.array(r["vector"]) for r in df.collect()}


def test_vectors_are_the_factorised_ppmi_however_texts_are_spread(texts):
    counts, known, entries = brute(TEXTS, 2, 100, 1)
    tokens = sorted(counts)
    dense = np.array([[entries.get((a, b), 0.0) for b in sorted(known)] for a in tokens])
    u, s, _ = np.linalg.svd(dense)
    expected = (u[:, :4] * s[:4]) @ u[:, :4].T
    for n in (1, 4, 32):
        found = table(W.fit_token_vectors(texts.repartition(n), "text", size=4, min_count=1, window=2, contexts=100))
        assert sorted(found) == tokens
        matrix = np.array([found[t] for t in tokens])
        assert np.allclose(matrix @ matrix.T, expected, atol=1e-6)
    assert not found["lonely"].any()  # it has no neighbour


def test_no_texts_no_vectors(texts):
    assert W.fit_token_vectors(texts.limit(0), "text").collect() == []
    assert W.fit_token_vectors(texts.where("text is null"), "text").collect() == []


@pytest.fixture(scope="module")
def given(spark):
    rng = np.random.default_rng(4)
    tokens = sorted({w for t in TEXTS for w in words(t)} - {"lonely"})
    return {t: rng.normal(size=6) + 1.0 for t in tokens}


def test_text_vectors_equal_plain_numpy(spark, texts, given):
    pairs = [(i, TEXTS[i], TEXTS[(i + 1) % len(TEXTS)]) for i in range(len(TEXTS))]
    df = spark.createDataFrame(pairs, "id int, generated_text string, target string")
    vectors = spark.createDataFrame([(t, [float(x) for x in v]) for t, v in given.items()], "token string, vector array<double>")
    counts = Counter(w for _, g, r in pairs for t in (g, r) for w in words(t))
    total = sum(counts.values())

    def mean(text):
        known = [w for w in words(text) if w in given]
        weighted = [1e-3 / (1e-3 + counts[w] / total) * given[w] for w in known]
        return np.mean(weighted, axis=0) if known else None

    rows = np.array([m for _, g, r in pairs for m in (mean(g), mean(r)) if m is not None])
    axis = np.linalg.svd(rows)[2][0]

    def likeness(g, r):
        if g is None or r is None:
            return 0.0
        g, r = g - (g @ axis) * axis, r - (r @ axis) * axis
        return float(g @ r / np.linalg.norm(g) / np.linalg.norm(r))

    expected = {i: likeness(mean(g), mean(r)) for i, g, r in pairs}
    scored = with_similarity(df.repartition(3), sentence_vectors=vectors)
    assert {r["id"]: r["sbert_similarity"] for r in scored.collect()} == pytest.approx(expected)
    assert scored.columns == ["id", "generated_text", "target", "sbert_similarity"]


def test_no_pairs_no_direction(spark, given):
    df = spark.createDataFrame([], "id int, generated_text string, target string")
    vectors = spark.createDataFrame([("cat", [1.0, 0.0])], "token string, vector array<double>")
    assert with_similarity(df, sentence_vectors=vectors).collect() == []
    one = spark.createDataFrame([(1, None, "zebra")], df.schema)
    assert [r["sbert_similarity"] for r in with_similarity(one, sentence_vectors=vectors).collect()] == [0.0]


def test_scores_of_joined_pairs_can_be_filtered(spark, texts, given):
    """A filter on a score that Python computes stays above the join that the pairs come from."""
    other = texts.select((F.col("id") - 1).alias("id"), F.col("text").alias("target"))
    pairs = texts.withColumnRenamed("text", "generated_text").join(other, "id")
    vectors = spark.createDataFrame([(t, [float(x) for x in v]) for t, v in given.items()], "token string, vector array<double>")
    scored = with_rouge(with_soft_match(pairs, vectors), which=("rougeL",))
    everything = scored.collect()
    high = scored.where("bertscore_f1 > 0.5 and rougeL > 0.2").collect()
    assert {r["id"] for r in high} == {r["id"] for r in everything if r["bertscore_f1"] > 0.5 and r["rougeL"] > 0.2} != set()
