"""The six jobs: each reads a table, composes operators into one plan per write, and writes a table."""

import logging

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pressloom.functions import fixed_values as V
from pressloom.operators import clean, generate, metrics, profile, prompts, report, split, svd, tfidf, topics
from pressloom.session import staged
from pressloom.sources import tables

log = logging.getLogger(__name__)


def _counted(df: DataFrame, name: str, *more: Column) -> tuple[DataFrame, Observation]:
    """Count rows (and what else is asked) as they pass, within the job that writes them."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *more), seen


def _log_counts(job: str, **seen: Observation) -> None:
    log.info("%s: %s", job, ", ".join(f"{step} {o.get['rows']}" for step, o in seen.items()))


def ingest_and_clean(
    spark: SparkSession, input_path: str, output_path: str, schema=tables.ARTICLE_SCHEMA, profile_path: str | None = None
) -> DataFrame:
    """CSV articles to a cleaned table with one row per headline.

    With ``profile_path``, the profile of the cleaned table is written there, a table for each part, and ``steps``:
    rows loaded, dates that cannot be read, rows with text, rows that stay; ``malformed`` has the number of rows whose fields
    do not fit their file's header.
    """
    df = tables.read_articles(spark, input_path, schema, malformed="malformed row")
    df = tables.with_row_ids(clean.normalize_column_names(df))
    unread = [F.count_if(F.col("malformed_row").isNotNull()).alias("malformed")]
    if "date" in df.columns:  # no normalised name has a blank, so the copy clashes with no column
        df = df.withColumn("raw date", F.col("date"))
        unread.append(F.count_if(F.col("raw date").isNotNull() & F.col("date").isNull()).alias("bad_dates"))
    # The count also keeps the filter below from being pushed under the cleaning, which would run it twice.
    df, loaded = _counted(clean.parse_dates(df), "loaded", *unread)
    df, kept = _counted(clean.drop_missing_critical(clean.clean_text_fields(df.drop("raw date", "malformed_row"))), "kept")
    df, unique = _counted(clean.remove_duplicates(clean.fill_optional_missing(df)), "unique")
    table = tables.write_table(df, output_path)
    steps = {
        "loaded": loaded.get["rows"], "bad_dates": loaded.get.get("bad_dates", 0),
        "with_text": kept.get["rows"], "unique": unique.get["rows"],
    }
    malformed = loaded.get["malformed"]
    log.info("ingest: %s, malformed %d", ", ".join(f"{step} {n}" for step, n in steps.items()), malformed)
    if profile_path:
        parts = {"shape": profile.profile_shape(table), "nulls": profile.profile_nulls(table), "value_counts": profile.profile_value_counts(table)}
        if "date" in table.columns:
            parts["date_range"] = profile.profile_date_range(table)
        parts["malformed"] = spark.createDataFrame([(malformed,)], "n long")
        parts["steps"] = spark.createDataFrame(list(steps.items()), "step string, n long")
        tables.save_model(parts, profile_path)
    return table


def preprocess_and_split(spark: SparkSession, input_path: str, output_path: str) -> DataFrame:
    """Normalised text, one row per near-duplicate headline, written by ``split``."""
    cleaned, loaded = _counted(spark.read.parquet(input_path), "loaded")
    normal = clean.remove_near_duplicates(clean.preprocess_text_fields(cleaned))
    # The split reads dates and ids a few times; the written table keeps the deduplication from running again.
    with staged(_counted(normal, "unique")[0], "normalised") as table:
        _log_counts("preprocess", loaded=loaded)
        return tables.write_table(split.time_based_split(table), output_path, ["split"])


def extract_metadata_and_keywords(
    spark: SparkSession,
    input_path: str,
    output_path: str,
    model_path: str,
    max_features: int = V.MAX_FEATURES,
    components: int = V.SVD_COMPONENTS,
    given_components: DataFrame | None = None,
) -> DataFrame:
    """Keywords and dense vectors for every split, from models fitted on the train split alone.

    ``given_components`` (term, vector) take the place of the fit, as when a new batch joins an earlier model's space;
    terms they do not have weigh nothing, and no singular values are written.
    """
    df = spark.read.parquet(input_path)
    train = df.where(F.col("split") == "train")
    headline = F.col("headline")
    tables.save_model({"vocabulary": tfidf.fit_vocabulary(train, headline, max_features)}, model_path)
    vocabulary = tables.load_model(spark, model_path, "vocabulary")["vocabulary"]
    with staged(tfidf.tfidf_features(df, headline, vocabulary), "features") as featured:
        train_features = featured.where(F.col("split") == "train")
        if given_components is None:
            loadings, singular_values = svd.fit_svd(train_features.select("doc_id", "features"), vocabulary, components)
            values = spark.createDataFrame(list(enumerate(singular_values)), "component int, singular_value double")
            tables.save_model({"components": loadings, "singular_values": values}, model_path)
        else:
            tables.save_model({"components": svd.for_vocabulary(given_components, vocabulary)}, model_path)
            loadings = tables.load_model(spark, model_path, "components")["components"]
        table = tables.write_table(_with_keywords(featured, loadings), output_path, ["split"])
        with staged(svd.svd_transform(train_features.select("features"), loadings), "projected") as projected:
            tables.save_model({"explained_variance": svd.explained_variance(projected)}, model_path)
    return table


def enrich(df: DataFrame, vocabulary: DataFrame, loadings: DataFrame, text: str = "headline") -> DataFrame:
    """Add ``keywords`` and ``svd_vector`` inside each row."""
    return _with_keywords(tfidf.tfidf_features(df, F.col(text), vocabulary), loadings)


def _with_keywords(featured: DataFrame, loadings: DataFrame) -> DataFrame:
    featured = svd.svd_transform(featured, loadings)
    return featured.withColumn("keywords", tfidf.top_keywords(F.col("features"))).drop("features")


def cluster_and_build_prompts(
    spark: SparkSession,
    input_path: str,
    model_path: str,
    clustered_path: str,
    prompt_path: str,
    k: int = V.N_CLUSTERS,
    restarts: int = V.KMEANS_RESTARTS,
) -> DataFrame:
    """Topics fitted on the train vectors, every article with its topic, and the prompt / target dataset."""
    df = spark.read.parquet(input_path)
    centres, cost = topics.fit_kmeans(df.where(F.col("split") == "train"), k=k, restarts=restarts)
    log.info("topics: inertia %.4f", cost)
    loadings = tables.load_model(spark, model_path, "components")["components"]
    tables.save_model({"centers": centres, "labels": topics.topic_labels(centres, loadings)}, model_path)
    labels = tables.load_model(spark, model_path, "labels")["labels"]
    tables.write_label_dictionary(labels, f"{model_path}/cluster_labels_json")
    assigned = topics.assign_clusters(df, centres).drop("distance2")
    clustered = tables.write_table(topics.attach_topic_label(assigned, labels), clustered_path, ["split"])
    return tables.write_table(prompts.build_prompt_dataset(clustered), prompt_path, ["split"])


def run_generation(
    spark: SparkSession,
    prompt_path: str,
    output_path: str,
    strategy: str = V.DEFAULT_STRATEGY,
    factory=generate.central_sentence,
    input_col: str = "prompt_text",
    batch_size: int = V.BATCH_SIZE,
    run_sbert: bool = True,
    run_rouge: bool = True,
    run_bertscore: bool = True,
    answers_path: str | None = None,
    **models,
) -> DataFrame:
    """Prompts under one strategy, the text generated from them, cleaned, and its metrics.

    With ``answers_path`` each distinct prompt is generated once, and a job that was ended goes on from that table; all
    strategies may share it, as long as the model is the same.
    """
    df = prompts.build_prompt(spark.read.parquet(prompt_path), strategy)
    if answers_path is None:
        df = generate.generate_batch(df, input_col, factory, batch_size)
    else:
        df = generate.generate_once(df, answers_path, input_col, factory, batch_size)
    df = generate.tag_generation(df, strategy)
    by = ["split"] if "split" in df.columns else []
    if not (run_sbert or run_rouge or run_bertscore):
        return tables.write_table(df, output_path, by)
    flags = {"run_sbert": run_sbert, "run_rouge": run_rouge, "run_bertscore": run_bertscore}
    # The model runs once per row whatever the metrics read, and a lost metric task does not call it again.
    with staged(df, "generated") as texts:
        return tables.write_table(metrics.evaluate_generations(texts, **flags, **models), output_path, by)


def evaluate_split(
    spark: SparkSession, generated_path: str, output_path: str, split_name: str, **options
) -> DataFrame | None:
    """Metrics of one split as a table, or None where the split was never generated."""
    df = tables.read_if_exists(spark, generated_path)
    if df is None:
        return None
    scored = metrics.ensure_metrics(df.withColumn("split", F.lit(split_name)), **options)
    return _review(tables.write_table(scored, output_path))


def _review(table: DataFrame) -> DataFrame:
    """Log the best and the worst rows of every split."""
    for name, samples in (("top", report.top_k_samples(table)), ("bottom", report.bottom_k_samples(table))):
        if samples is not None:
            for row in samples.orderBy("split", "rank").collect():
                log.info("%s %s: %s | %s | %s", row["split"], name, row["score"], row["headline"], row["generated"])
    return table


def run_evaluation(
    spark: SparkSession, generated_path: str, output_path: str, splits=("val", "test"), **options
) -> DataFrame | None:
    """Metrics of the splits as one table (``metrics``, written by split), one summary and the Markdown report.

    All splits go through one plan. A split without rows has none in the summary and says so in the report; without
    any rows there is no summary (None).
    """
    df = tables.read_if_exists(spark, generated_path)
    found = None
    if df is not None and "split" in df.columns:
        scored = metrics.ensure_metrics(df.where(F.col("split").isin(*splits)), **options)
        found = tables.write_table(scored, f"{output_path}/metrics", ["split"], schema=scored.schema)
    if found is None or found.isEmpty():
        empty = spark.createDataFrame([], "split string, prompt_strategy string")
        tables.write_markdown(report.markdown_lines(empty, splits), f"{output_path}/evaluation_report")
        return None
    summary = tables.write_table(report.summary_by_strategy(_review(found)), f"{output_path}/summary_stats")
    tables.write_markdown(report.markdown_lines(summary, splits), f"{output_path}/evaluation_report")
    return summary
