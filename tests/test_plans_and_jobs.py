import re

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from pressloom.functions import fixed_values as V
from pressloom.operators import clean, metrics, report, split, tfidf
from pressloom.operators.joins import lookup_join
from pressloom.plans import jobs
from pressloom.plans.registry import QUERIES
from pressloom.session import new_path, shared_dir
from pressloom.sources import tables, views


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def operators(df):
    """Operator names of the main plan, without its subqueries."""
    lines = plan(df).splitlines()
    kept, skip = [], None
    for line in lines:
        depth = len(line) - len(line.lstrip(" :+-*()0123456789"))
        if skip is not None and depth > skip:
            continue
        skip = None
        name = re.sub(r"^[ :+\-*()0-9]*", "", line).split(" ")[0].split("(")[0]
        if name in ("Subquery", "ReusedSubquery"):
            skip = depth
            continue
        kept.append(name)
    return kept


@pytest.fixture(scope="module")
def articles(spark):
    path = new_path(spark, "articles")
    views.articles(spark, SMALL).write.parquet(path)
    return spark.read.parquet(path)


def test_split_moves_no_rows(articles):
    found = operators(split.time_based_split(articles))
    assert "Exchange" not in found and "Window" not in found and "Sort" not in found


def test_features_and_keywords_stay_in_the_row(spark, articles):
    vocabulary = tables.write_table(tfidf.fit_vocabulary(articles, F.col("headline")), new_path(spark, "v"))
    df = tfidf.tfidf_features(articles, F.col("headline"), vocabulary)
    df = df.select("doc_id", tfidf.top_keywords(F.col("features")).alias("keywords"))
    assert "Exchange" not in operators(df) and "_slots#" not in plan(df)
    # The array of terms is built once per row: no filter repeats it.
    long = plan(tfidf.tfidf_matrix(tfidf.tfidf_features(articles, F.col("headline"), vocabulary)))
    assert long.count("regexp_extract_all") == 1 and "_slots#" not in long


def test_only_needed_columns_are_read(articles):
    df = tfidf.document_frequency(articles, F.col("headline"))
    assert "ReadSchema: struct<headline:string>" in plan(df)
    kept = clean.drop_missing_critical(articles, ["source"]).where(F.col("source") == "src1").select("doc_id")
    assert "PushedFilters: [IsNotNull(source), EqualTo(source,src1)]" in plan(kept)


def test_dedup_combines_on_the_map_side(articles):
    found = operators(clean.remove_duplicates(articles))
    assert found.count("SortAggregate") == 2 and found.count("Exchange") == 1 and "Window" not in found


def test_rouge_needs_no_shuffle_and_python_only_for_the_subsequence(articles):
    pairs = articles.select(F.col("doc_id").alias("id"), F.col("headline").alias("generated_text"), F.col("description").alias("target"))
    both = operators(metrics.with_rouge(pairs, which=("rouge1", "rouge2")))
    assert "Exchange" not in both and not any("Python" in o or "ArrowEval" in o for o in both)
    full = operators(metrics.with_rouge(pairs))
    assert "Exchange" not in full and sum("ArrowEval" in o for o in full) == 1


def test_review_keeps_k_rows_per_task(articles):
    df = articles.select(F.col("doc_id").alias("id"), F.col("headline").alias("generated_text"), F.rand(1).alias("rouge1"),
                         F.col("source").alias("split"))
    found = operators(report.top_k_samples(df, "rouge1"))
    assert found.count("WindowGroupLimit") == 2


def test_lookup_join_beyond_the_limit_gives_the_same(spark):
    big = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"))
    small = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    for how in ("inner", "left"):
        a = lookup_join(big, small, "k", "id", how).select("id", "k", "v")
        b = lookup_join(big, small, "k", "id", how, max_rows=5).select("id", "k", "v")
        assert "BroadcastHashJoin" in plan(a) and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_results_do_not_depend_on_the_partition_count(spark):
    names = ["B6_dedup_exact", "C6_dedup_normalized", "C7_time_based_split", "D5_fit_vocabulary", "H5_top_k_samples"]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        results = []
        for n in ("1", "200"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append([sorted(map(str, QUERIES[q](spark, SMALL).collect())) for q in names])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]


def test_the_shared_folder_is_the_one_the_session_names(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert new_path(spark, "x").startswith(shared_dir(spark))


def test_all_jobs_in_a_row(spark, tmp_path):
    root = str(tmp_path)
    tables.write_csv(views.raw_articles(spark, SMALL).drop("doc_id"), f"{root}/csv")
    cleaned = jobs.ingest_and_clean(spark, f"{root}/csv", f"{root}/cleaned")
    assert cleaned.where(F.col("headline").isNull() | (F.col("headline") == "")).isEmpty()
    assert cleaned.count() == cleaned.select("headline").distinct().count()
    parts = jobs.preprocess_and_split(spark, f"{root}/cleaned", f"{root}/split")
    assert {r["split"] for r in parts.select("split").distinct().collect()} == {"train", "val", "test"}
    keyed = jobs.extract_metadata_and_keywords(spark, f"{root}/split", f"{root}/keywords", f"{root}/model", components=12)
    assert {"keywords", "svd_vector"} <= set(keyed.columns) and keyed.count() == parts.count()
    made = jobs.cluster_and_build_prompts(
        spark, f"{root}/keywords", f"{root}/model", f"{root}/clustered", f"{root}/prompts", k=4, restarts=2
    )
    assert made.columns == ["id", "prompt", "target", *V.PROMPT_COLUMNS, "split"] and made.count() == parts.count()
    assert spark.read.json(f"{root}/model/cluster_labels_json").count() == 4
    vocabulary = tables.load_model(spark, f"{root}/model", "vocabulary")["vocabulary"]
    vectors = metrics.train_token_vectors(made.where("split = 'train'"), "target", size=8)
    made_by = [
        jobs.run_generation(
            spark, f"{root}/prompts", f"{root}/generated_{strategy}", strategy, vocabulary=vocabulary, token_vectors=vectors
        )
        for strategy in ("structured", "metadata_aware")
    ]
    tables.write_table(made_by[0].unionByName(made_by[1]), f"{root}/generated", ["split"])
    summary = jobs.run_evaluation(spark, f"{root}/generated", f"{root}/evaluation", ("val", "test", "nowhere"))
    assert summary.count() == 4 and set(V.METRICS) == {c[: -len("_mean")] for c in summary.columns if c.endswith("_mean")}
    row = summary.first()
    assert all(0 <= row[f"{m}_min"] <= row[f"{m}_median"] <= row[f"{m}_max"] <= 1 + 1e-9 for m in V.METRICS)
    lines = [r[0] for r in spark.read.text(f"{root}/evaluation/evaluation_report").collect()]
    assert lines[0] == "# Evaluation Report" and "## Val Set Results" in lines
    assert lines[lines.index("## Nowhere Set Results") + 2] == "_No results available._"


def test_evaluation_of_nothing_still_writes_a_report(spark, tmp_path):
    assert jobs.run_evaluation(spark, str(tmp_path / "none"), str(tmp_path / "out")) is None
    assert spark.read.text(str(tmp_path / "out" / "evaluation_report")).where("value = '_No results available._'").count() == 2


def test_csv_columns_follow_the_header(spark, tmp_path):
    from pressloom.sources.tables import read_articles

    (tmp_path / "a.csv").write_text('Headline,date,Extra, Source\n"One, two",2020-03-15,more,reuters\nThree,NA,,\n')
    found = read_articles(spark, str(tmp_path / "a.csv"))
    assert found.columns == ["Date", "Headline", "Description", "Covid Status", "Image URL", "Source", "Sentiment", "Extra"]
    assert [tuple(r) for r in found.collect()] == [
        ("2020-03-15", "One, two", None, None, None, "reuters", None, "more"), (None, "Three", None, None, None, None, None, None),
    ]


def test_summary_without_strategies(spark):
    from pressloom.operators.report import summary_by_strategy

    rows = spark.createDataFrame([("val", 0.5), ("val", 1.0)], "split string, rouge1 double")
    assert [(r.split, r.metric, r["mean"], r["median"]) for r in summary_by_strategy(rows).collect()] == [("val", "rouge1", 0.75, 0.75)]


def test_ingest_writes_its_profile(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Headline,Date,Description\nOne,2020-03-15,x\nTwo,soon,y\nTwo,NA,z\n,2020-03-16,w\n')
    jobs.ingest_and_clean(spark, str(tmp_path / "a.csv"), str(tmp_path / "out"), profile_path=str(tmp_path / "profile"))
    made = tables.load_model(spark, str(tmp_path / "profile"), "steps", "nulls", "shape", "date_range", "value_counts")
    assert {r["step"]: r["n"] for r in made["steps"].collect()} == {"loaded": 4, "bad_dates": 1, "with_text": 3, "unique": 2}
    assert {r["column_name"]: r["null_count"] for r in made["nulls"].collect()}["date"] == 1
    assert {r["n_rows"] for r in made["shape"].collect()} == {2}


def test_summary_aggregates_before_it_makes_lines(spark, tmp_path):
    from pressloom.operators.report import summary_long

    rows = [("val", "a b", 0.5, 1.0), ("val", "a b", 1.0, None), ("test", None, float("nan"), 3.0), ("test", None, 2.0, 5.0)]
    df = spark.createDataFrame(rows, "split string, prompt_strategy string, rouge1 double, rouge2 double")
    found = {tuple(r[:3]): tuple(r[3:]) for r in summary_long(df, ["split", "prompt_strategy"]).drop("std").collect()}
    assert found == {
        ("val", "a b", "rouge1"): (0.75, 0.5, 0.75, 1.0), ("val", "a b", "rouge2"): (1.0, 1.0, 1.0, 1.0),
        ("test", None, "rouge1"): (2.0, 2.0, 2.0, 2.0), ("test", None, "rouge2"): (4.0, 3.0, 4.0, 5.0),
    }
    plan = summary_long(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Aggregate") and "Expand" not in plan


def test_evaluation_of_other_splits_is_none(spark, tmp_path):
    rows = spark.createDataFrame([(1, "train", "a", "b", "structured")], "id long, split string, target string, generated_text string, prompt_strategy string")
    tables.write_table(rows, str(tmp_path / "generated"), ["split"])
    options = {"run_sbert": False, "run_bertscore": False}
    assert jobs.run_evaluation(spark, str(tmp_path / "generated"), str(tmp_path / "out"), ("val",), **options) is None
    found = jobs.run_evaluation(spark, str(tmp_path / "generated"), str(tmp_path / "out"), ("train", "val"), **options)
    assert [r["split"] for r in found.collect()] == ["train"]
