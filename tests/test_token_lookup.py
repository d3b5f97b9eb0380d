"""Token tables beyond what every task can hold: frequent tokens as a dictionary, the vectors of rare ones to their rows."""

import numpy as np
from pyspark.sql import functions as F

from pressloom.functions import tokens as K
from pressloom.operators import metrics, token_vectors
from pressloom.operators.joins import frequent_keys

NAMES = ["bertscore_p", "bertscore_r", "bertscore_f1"]


def _table(spark, n=30, kind="float"):
    rng = np.random.default_rng(7)
    return spark.createDataFrame([(f"w{i:02d}", rng.normal(size=4).tolist()) for i in range(n)], f"token string, vector array<{kind}>")


def _texts(n=40):
    rng = np.random.default_rng(8)
    pick = lambda: " ".join(f"w{min(29, int(x)):02d}" for x in rng.exponential(6, size=12))
    return [(pick(), pick()) for _ in range(n)]


def test_frequent_keys_are_those_of_most_rows(spark):
    lookup = _table(spark, 6)
    counts = spark.createDataFrame([("w00", 9), ("w01", 5), ("w02", 5), ("w03", 1), ("w09", 1)], "token string, n long")
    picked = lambda rows, size=1 << 20: sorted(r[0] for r in frequent_keys(lookup, counts, "token", rows, size).collect())
    assert picked(5) == ["w00", "w01", "w02", "w03", "w09"] and picked(4) == ["w00", "w01", "w02"]
    assert picked(2) == ["w00"] and picked(0) == [] and picked(5, 40) == ["w00"]


def test_rows_that_share_an_id_keep_their_own_soft_match(spark):
    """Joined by id, the tokens of such rows were thrown together."""
    pairs = _texts()
    rows = [(i // 2 if i < 20 else None, a, b) for i, (a, b) in enumerate(pairs)] + [(99, *pairs[0]), (99, *pairs[0]), (99, "", "w01")]
    df = spark.createDataFrame(rows, "id long, generated_text string, target string")
    key = ["generated_text", "target", "id"]
    whole = metrics.with_soft_match(df, _table(spark)).orderBy(*key).collect()
    for limit in (0, 3, 10):
        parts = metrics.with_soft_match(df, _table(spark), max_dictionary=limit).orderBy(*key).collect()
        assert len(parts) == len(rows)
        assert np.allclose([[r[n] for n in NAMES] for r in whole], [[r[n] for n in NAMES] for r in parts])


def test_only_vectors_of_rare_tokens_are_shuffled(spark):
    df = spark.createDataFrame([(i, "w00 w01", f"w00 w{2 + i % 28:02d}") for i in range(56)], "id long, generated_text string, target string")
    plan = metrics.with_soft_match(df, _table(spark), max_dictionary=2)
    entries = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in entries  # the frequent ones leave before the vectors are joined
    assert "_salt" not in entries  # and no copies of the table are made


def test_text_vectors_are_the_same_with_rare_tokens_joined(spark):
    rows = [(i, a) for i, (a, _) in enumerate(_texts())] + [(90, "unknown"), (91, None), (3, "w01 w28")]
    texts = spark.createDataFrame(rows, "id long, text string").select("id", K.term_counts(K.rouge_tokens(F.col("text"))).alias("terms"))
    counts = token_vectors.token_counts(texts, "", F.col("terms"))
    again = spark.createDataFrame([("w28", [1.0, 2.0, 3.0, 4.0])], "token string, vector array<float>")  # counts as in a join
    weighed = token_vectors.weigh_tokens(_table(spark).union(again), counts)
    sums = lambda limit: token_vectors._sums(texts, weighed, counts, "id", limit).orderBy("id").collect()
    whole = sums(100)
    assert [r["id"] for r in whole] == list(range(40))
    words = [w for i, t in rows if i == 3 for w in t.split()]
    known = [np.array(r["vector"]) * r["weight"] for w in words for r in weighed.where(F.col("token") == w).collect()]
    assert len(known) > len(words) and np.allclose(whole[3]["vector"], sum(known) / len(known))
    for limit in (0, 4):
        parts = sums(limit)
        assert [r["id"] for r in parts] == list(range(40))
        assert np.allclose([r["vector"] for r in whole], [r["vector"] for r in parts])
