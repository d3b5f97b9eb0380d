"""Literal expectations: offline generation, text ids in the split, search plans, staged tables."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressloom.functions import fixed_values as V
from pressloom.functions.stemming import stem_tokens
from pressloom.operators import generate, order_stats, prompts, split, tfidf
from pressloom.session import shared_dir, staged

ARTICLE = ("Storm hits Lisbon", "lisbon, storm", "weather", "negative", None,
           "The mayor spoke. A storm hit Lisbon and the storm closed the port.\nSchools stay open!")
SCHEMA = "headline string, keywords string, topic_label string, sentiment string, covid_status string, target string"


def test_offline_model_reads_the_prompt():
    model = generate.central_sentence()
    assert model(["", "### Task", "Tone: x\nHeadline: Rain in Porto. Porto floods after rain."]) == [
        "", "", "Porto floods after rain."]
    long = "x" * 300 + " first. " + " ".join(["word"] * 3) + " later."
    assert model([long]) == ["word word word later."]  # the whole prompt counts, not its first 280 characters


def test_strategies_lead_to_different_texts(spark):
    made = generate.generate_batch(prompts.run_strategies(spark.createDataFrame([ARTICLE], SCHEMA)))
    found = {r["prompt_strategy"]: r["generated_text"] for r in made.collect()}
    body = "A storm hit Lisbon and the storm closed the port."
    assert found == {"structured": "Storm hits Lisbon", "detailed": body, "role_based": body, "metadata_aware": body}


def test_stems_of_listed_words(spark):
    listed = {"running": "run", "cats": "cat", "ponies": "poni", "relational": "relat", "hopping": "hop", "caresses": "caress"}
    df = spark.createDataFrame([(list(listed),)], "words array<string>")
    assert df.select(stem_tokens(F.col("words"))).first()[0] == list(listed.values())


@pytest.mark.parametrize("texts", [
    ["a", "ab", "b", "ba", "", "a\u00e9", "\u20ac", "same-long-prefix-1", "same-long-prefix-10", "same-long-prefix-2"],
    ["x"] * 5,
    [f"article-{i % 7}-{i}" for i in range(60)],
])
def test_text_ranks_follow_byte_order(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    ordered = sorted(texts, key=lambda t: t.encode())
    for rank in {1, 2, len(texts) // 2 + 1, len(texts)}:
        assert order_stats.select_text_rank(df, F.col("t"), rank) == ordered[rank - 1]


def test_split_by_text_ids_on_one_day(spark):
    rows = [(f"id-{i:03d}", None if i % 10 == 0 else "2020-01-01") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id string, d string").withColumn("date", F.to_date("d"))
    found = {r["doc_id"]: r["split"] for r in split.time_based_split(df).collect()}
    ordered = [i for i, d in sorted(rows, key=lambda r: (r[1] is None, r[0]))]
    assert [found[i] for i in ordered] == ["train"] * 70 + ["val"] * 15 + ["test"] * 15


def test_search_sends_k_rows_per_task_and_blocks_agree(spark):
    rng = np.random.default_rng(3)
    def side(n, name):
        rows = []
        for i in range(n):
            terms = sorted(rng.choice(40, size=rng.integers(0, 6), replace=False).tolist())
            rows.append((f"{name}{i:03d}", [(t, float(w)) for t, w in zip(terms, rng.random(len(terms)))]))
        return spark.createDataFrame(rows, "id string, features array<struct<term_id:int,weight:double>>"), rows
    (q, asked), (d, docs) = side(23, "q"), side(300, "d")
    q, d = q.withColumnRenamed("id", "query_id"), d.withColumnRenamed("id", "doc_id")
    expected = set()
    for name, row in asked:
        mine = dict(row)
        scores = [(-round(sum(mine.get(t, 0) * w for t, w in r), 6), i) for i, r in docs if mine.keys() & dict(r).keys()]
        expected |= {(name, i, rank, -s) for rank, (s, i) in enumerate(sorted(scores)[:4], start=1)}
    for block in (2_000, 5):
        found = tfidf.tfidf_search(q, d, k=4, block=block)
        rows = {(r["query_id"], r["doc_id"], r["rank"], round(r["score"], 6)) for r in found.collect()}
        assert {(a, b, c, round(s, 6)) for a, b, c, s in expected} == rows
    plan = tfidf.tfidf_search(q, d)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan


def test_staged_tables_go_away(spark):
    def folders():
        return {f for f in os.listdir(shared_dir(spark).removeprefix("file:")) if f.startswith("passing-")}

    with staged(spark.range(5).toDF("n"), "passing") as table:
        assert table.count() == 5 and len(folders()) == 1
    assert not folders()


def test_fixed_templates_have_their_words():
    assert {"news", "article", "post", "the"} <= set(generate.prompt_words()) and "lisbon" not in generate.prompt_words()
    assert V.STRATEGY_TEMPLATES["structured"].startswith("### Context\n{headline}\n")
