import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from pressloom.functions import fixed_values as V
from pressloom.functions.vectors import sparse_dot
from pressloom.operators import generate, metrics, prompts, svd, tfidf, topics

WORDS = [f"w{i:02d}" for i in range(40)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    return [
        " ".join(rng.choices(WORDS, weights=[1 / (j + 1) for j in range(40)], k=rng.choice([0, 1, 5, 12]))) for _ in range(120)
    ]


@pytest.fixture(scope="module")
def documents(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.fixture(scope="module")
def vocabulary(spark, documents, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("m") / "vocabulary")
    tfidf.fit_vocabulary(documents, F.col("text"), max_features=60).write.parquet(path)
    return spark.read.parquet(path)


def brute_terms(text):
    t = text.split()
    return t + [f"{a} {b}" for a, b in zip(t, t[1:])]


def brute_vocabulary(texts, limit):
    df, total = Counter(), Counter()
    for t in texts:
        terms = brute_terms(t)
        total.update(terms)
        df.update(set(terms))
    kept = [t for t in total if 2 <= df[t] <= 0.95 * len(texts)]
    kept = sorted(sorted(kept, key=lambda t: (-total[t], t))[:limit])
    return {t: (i, math.log((1 + len(texts)) / (1 + df[t])) + 1) for i, t in enumerate(kept)}


def brute_matrix(texts, vocab):
    x = np.zeros((len(texts), len(vocab)))
    for i, text in enumerate(texts):
        for term, n in Counter(brute_terms(text)).items():
            if term in vocab:
                x[i, vocab[term][0]] = (1 + math.log(n)) * vocab[term][1]
    lengths = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, lengths, out=np.zeros_like(x), where=lengths > 0)


def to_matrix(features, n_terms):
    rows = features.select("doc_id", "features").collect()
    x = np.zeros((len(rows), n_terms))
    for r in rows:
        for e in r["features"]:
            x[r["doc_id"], e["term_id"]] = e["weight"]
    return x


def test_matrix_equals_brute_force_on_both_paths(documents, vocabulary, texts, monkeypatch):
    expected = brute_vocabulary(texts, 60)
    assert {r["term"]: (r["term_id"], pytest.approx(r["idf"])) for r in vocabulary.collect()} == expected
    by_row = tfidf.tfidf_features(documents, F.col("text"), vocabulary)
    assert np.allclose(to_matrix(by_row, 60), brute_matrix(texts, expected))
    monkeypatch.setattr(tfidf, "ROW_LOCAL_TERMS", 5)
    by_join = tfidf.tfidf_features(documents, F.col("text"), vocabulary)
    assert np.allclose(to_matrix(by_join, 60), brute_matrix(texts, expected))


def test_vocabulary_comes_from_the_train_rows_alone(spark, documents, vocabulary):
    more = documents.unionByName(spark.createDataFrame([(1000 + i, "zzz yyy w00") for i in range(50)], documents.schema))
    again = tfidf.fit_vocabulary(more.where("doc_id < 1000"), F.col("text"), max_features=60)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, vocabulary.collect()))


def test_search_equals_brute_force(spark, documents, vocabulary, texts):
    asked = spark.createDataFrame([(0, "w00 w01 w02"), (1, "nothing known"), (2, "w05 w05 w09")], "query_id long, text string")
    q = tfidf.tfidf_features(asked, F.col("text"), vocabulary, "query_id")
    d = tfidf.tfidf_features(documents, F.col("text"), vocabulary)
    got = {(r["query_id"], r["rank"]): r["score"] for r in tfidf.tfidf_search(q, d, k=7).collect()}
    vocab = brute_vocabulary(texts, 60)
    scores = brute_matrix(["w00 w01 w02", "nothing known", "w05 w05 w09"], vocab) @ brute_matrix(texts, vocab).T
    expected = {(i, r + 1): s for i in (0, 2) for r, s in enumerate(np.sort(scores[i])[::-1][:7]) if s > 0}
    assert got == pytest.approx(expected, abs=2e-6)


def test_svd_against_a_dense_one(spark, documents, vocabulary, texts):
    x = brute_matrix(texts, brute_vocabulary(texts, 60))
    features = tfidf.tfidf_features(documents, F.col("text"), vocabulary)
    loadings, values = svd.fit_svd(features, vocabulary, components=100)  # more than there are terms
    v = np.array([r["vector"] for r in loadings.orderBy("term_id").collect()])
    assert v.shape == (60, 60) and np.allclose(v.T @ v, np.eye(60), atol=1e-8)
    assert np.allclose(values, np.linalg.svd(x, compute_uv=False)[:60], atol=1e-6)
    loadings, values = svd.fit_svd(features, vocabulary, components=8)
    assert np.allclose(values, np.linalg.svd(x, compute_uv=False)[:8], rtol=2e-2)
    v = np.array([r["vector"] for r in loadings.orderBy("term_id").collect()])
    projected = svd.svd_transform(features, loadings)
    dense = np.array([r["svd_vector"] for r in projected.orderBy("doc_id").collect()])
    assert np.allclose(dense, x @ v)
    ratios = [r["ratio"] for r in svd.explained_variance(projected).orderBy("component").collect()]
    assert np.allclose(ratios, (x @ v).var(axis=0) / x.var(axis=0).sum())


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.normal(c, 0.3, (40, 3)) for c in ((0, 0, 0), (5, 0, 0), (0, 5, 0))])
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "doc_id long, svd_vector array<double>"), points


def test_kmeans_keeps_the_best_restart(blobs):
    df, points = blobs
    centres, cost = topics.fit_kmeans(df, k=4)
    data = df.select(array_to_vector("svd_vector").alias("features"))
    singles = [KMeans(k=4, seed=s, maxIter=300).fit(data).summary.trainingCost for s in range(V.SEED, V.SEED + 4)]
    assert cost <= min(singles) + 1e-6
    c = np.array([r["center"] for r in centres.orderBy("cluster_id").collect()])
    distance = ((points[:, None] - c[None]) ** 2).sum(axis=2)
    assigned = topics.assign_clusters(df, centres)
    assert [r["cluster_id"] for r in assigned.orderBy("doc_id").collect()] == distance.argmin(axis=1).tolist()
    assert topics.cluster_inertia(assigned).first()[0] == pytest.approx(distance.min(axis=1).sum())
    assert topics.cluster_inertia(assigned).first()[0] == pytest.approx(cost)


@pytest.mark.parametrize("partitions", [1, 4, 32])
def test_kmeans_does_not_depend_on_how_rows_are_spread(blobs, partitions):
    df, _ = blobs
    one, cost = topics.fit_kmeans(df, k=4, restarts=3)
    other, again = topics.fit_kmeans(df.orderBy(F.rand(partitions)).repartition(partitions), k=4, restarts=3)
    assert sorted(map(str, one.collect())) == sorted(map(str, other.collect())) and cost == again


def test_kmeans_weighs_equal_vectors(spark, blobs):
    df, points = blobs
    many = df.unionByName(spark.range(400).selectExpr("id + 1000 as doc_id", "array(9.0D, 9.0D, 9.0D) as svd_vector"), allowMissingColumns=True)
    many = many.unionByName(spark.createDataFrame([(5000, None)], df.schema))  # a null vector is left out
    rows = topics.weighted(many)
    assert rows.count() == len(points) + 1 and rows.agg(F.max("n")).first()[0] == 400
    centres, cost = topics.fit_kmeans(many, k=4)
    assert any(np.allclose(r["center"], 9.0) for r in centres.collect())
    c = np.array([r["center"] for r in centres.collect()])
    every = np.concatenate([points, np.full((400, 3), 9.0)])
    assert cost == pytest.approx(((every[:, None] - c[None]) ** 2).sum(axis=2).min(axis=1).sum(), abs=1e-4)


def test_kmeans_with_few_or_no_vectors(spark):
    schema = "doc_id long, svd_vector array<double>"
    centres, cost = topics.fit_kmeans(spark.createDataFrame([(i, [float(i % 2), 0.0]) for i in range(9)], schema), k=5)
    assert sorted(r["center"][0] for r in centres.collect()) == [0.0, 1.0] and cost == 0.0
    assert topics.fit_kmeans(spark.createDataFrame([(1, [0.0, 0.0])] * 3, schema), k=2)[1] == 0.0
    with pytest.raises(ValueError):
        topics.fit_kmeans(spark.createDataFrame([], schema), k=2)


def test_topic_labels_are_the_heaviest_terms(spark):
    centres = spark.createDataFrame([(0, [1.0, 0.0]), (1, [-1.0, 2.0])], "cluster_id int, center array<double>")
    loadings = spark.createDataFrame(
        [(0, "a", [0.9, 0.0]), (1, "b", [0.1, 0.5]), (2, "c", [0.9, 0.1])], "term_id int, term string, vector array<double>"
    )
    labels = topics.topic_labels(centres, loadings, top=2)
    assert {r["cluster_id"]: r["topic_label"] for r in labels.collect()} == {0: "a | c", 1: "b | c"}
    rows = spark.createDataFrame([(0,), (7,)], "cluster_id int")
    assert {r[0]: r[1] for r in topics.attach_topic_label(rows, labels).collect()} == {0: "a | c", 7: None}


def pairs_of(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, generated_text string, target string")


def test_rouge_of_known_pairs(spark):
    df = pairs_of(spark, [("the cat sat", "the cat sat"), ("", "a b"), (None, None), ("police kill the gunman", "police killed the gunman"),
                          ("a a a b", "a b b"), ("the gunman police killed", "police killed the gunman")])
    got = [tuple(r) for r in metrics.with_rouge(df, stem=False).orderBy("id").select("rouge1", "rouge2", "rougeL").collect()]
    expected = [(1, 1, 1), (0, 0, 0), (0, 0, 0), (0.75, 1 / 3, 0.75), (4 / 7, 2 / 5, 4 / 7), (1, 2 / 3, 0.5)]
    for a, b in zip(got, expected):
        assert a == pytest.approx(b)
    stemmed = metrics.with_rouge(df, stem=True).orderBy("id").collect()
    assert stemmed[3]["rouge1"] == pytest.approx(1.0) and stemmed[3]["rougeL"] == pytest.approx(1.0)


def test_lcs_and_overlap_against_brute_force(spark):
    rng = random.Random(8)
    token_lists = [([rng.choice("abcd") for _ in range(rng.randrange(90))], [rng.choice("abcd") for _ in range(rng.randrange(90))])
                   for _ in range(60)]

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b, start=1):
                new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
            row = new
        return row[-1]

    df = spark.createDataFrame(list(token_lists), "a array<string>, b array<string>")
    got = df.select(metrics.lcs_length("a", "b"), metrics.clipped_overlap(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(lcs(a, b), sum((Counter(a) & Counter(b)).values())) for a, b in token_lists]


def test_soft_match_is_the_same_by_dictionary_and_by_join(spark, texts):
    rng = np.random.default_rng(4)
    vectors = spark.createDataFrame([(w, rng.normal(size=5).tolist()) for w in WORDS[:30]], "token string, vector array<double>")
    df = pairs_of(spark, list(zip(texts[:40], texts[40:80])) + [("w01 w02", "w01 w02"), ("unknown", "w01"), ("", "")])
    a = metrics.with_soft_match(df, vectors).orderBy("id").collect()
    b = metrics.with_soft_match(df, vectors, max_dictionary=3).orderBy("id").collect()
    names = ["bertscore_p", "bertscore_r", "bertscore_f1"]
    assert np.allclose([[r[n] for n in names] for r in a], [[r[n] for n in names] for r in b])
    assert [a[40][n] for n in names] == pytest.approx([1, 1, 1])
    assert [a[41][n] for n in names] == [0, 0, 0] and [a[42][n] for n in names] == [0, 0, 0]


def test_metrics_that_are_present_stay(spark):
    df = pairs_of(spark, [("a b", "a b")]).withColumns({c: F.lit(0.25) for c in ("rouge1", "rouge2", "rougeL")})
    got = metrics.ensure_metrics(df, run_sbert=False, run_bertscore=False).first()
    assert (got["rouge1"], got["rougeL"]) == (0.25, 0.25)
    got = metrics.ensure_metrics(df.drop("rouge2"), run_sbert=False, run_bertscore=False).first()
    assert (got["rouge1"], got["rouge2"], got["rougeL"]) == (1.0, 1.0, 1.0)
    with pytest.raises(ValueError):
        metrics.evaluate_generations(df)


def test_a_pluggable_encoder(spark):
    df = pairs_of(spark, [("aa", "aa"), ("aa", "bb"), (None, "aa")])

    def factory():
        return lambda batch: np.array([[t.count("a"), t.count("b")] for t in batch], dtype="float32")

    got = metrics.with_similarity(df, encoder=factory).orderBy("id").collect()
    assert [r["sbert_similarity"] for r in got] == [1.0, 0.0, 0.0]


def test_sparse_dot(spark):
    one = "array(named_struct('term_id', 1, 'weight', 0.5D), named_struct('term_id', 4, 'weight', 2D))"
    two = "array(named_struct('term_id', 4, 'weight', 3D))"
    df = spark.range(1).select(F.expr(one).alias("a"), F.expr(two).alias("b"), F.expr("slice(" + two + ", 1, 0)").alias("c"))
    assert tuple(df.select(sparse_dot(F.col("a"), F.col("b")), sparse_dot(F.col("a"), F.col("c"))).first()) == (6.0, 0.0)


def test_generation_builds_one_model_per_task_and_batches(spark):
    df = spark.range(20, numPartitions=2).select("id", F.concat(F.lit("p"), "id").alias("prompt_text"))

    def factory():
        state = {"calls": 0}

        def model(batch):
            state["calls"] += 1
            return [f"{t}|{len(batch)}|{state['calls']}" for t in batch]

        return model

    got = [r["generated_text"] for r in generate.generate_batch(df, factory=factory, batch_size=4).orderBy("id").collect()]
    assert got[0] == "p0|4|1" and got[9] == "p9|2|3" and got[10] == "p10|4|1"


def test_every_strategy_renders_all_rows(spark):
    row = spark.createDataFrame([(1, "H{x}", "T", None, "topic", None, None)],
                                "id long, headline string, target string, keywords string, topic_label string, sentiment string, covid_status string")
    got = {r["prompt_strategy"]: r["prompt_text"] for r in prompts.run_strategies(row).collect()}
    assert set(got) == set(V.STRATEGY_TEMPLATES)
    assert "Tone: neutral." in got["structured"] and "T" not in got["structured"].split("### Task")[0]
    assert "COVID-19 news (unknown)" in got["role_based"] and "H{x}" in got["metadata_aware"]
    assert prompts.build_prompt(row, "no such name").first()["prompt_text"] == got["metadata_aware"]


def test_a_filter_on_generated_text_does_not_run_the_model_again(spark):
    df = generate.generate_batch(spark.range(4).select("id", F.lit("A b. C").alias("prompt_text")))
    plan = df.where(F.length("generated_text") > 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
