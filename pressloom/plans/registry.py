"""One named query per operator, over the whole of the given tables."""

from functools import reduce
from string import ascii_lowercase, ascii_uppercase

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.functions import fixed_values as V
from pressloom.functions import text as X
from pressloom.functions import tokens as K
from pressloom.functions import vectors as VX
from pressloom.functions.counted import uni_and_bigram_counts
from pressloom.functions.lambdas import explode_once, posexplode_once, rounded
from pressloom.operators import clean, generate, metrics, profile, prompts, report, search_index, split, svd, tfidf
from pressloom.operators import token_vectors as token_space
from pressloom.operators import topics
from pressloom.plans import jobs
from pressloom.session import new_path, staged, write_and_read
from pressloom.sources import tables, views


# --- shared inputs --------------------------------------------------------------------------------
def typed_raw(spark, d):
    return clean.parse_dates(clean.normalize_column_names(views.raw_articles(spark, d)))


def split_articles(spark, d):
    return split.time_based_split(views.articles(spark, d))


def article_features(spark, d):
    """Split articles with TF-IDF features, and the vocabulary of the train split they come from."""
    rows = split_articles(spark, d)
    train = rows.where(F.col("split") == "train")
    vocabulary = write_and_read(tfidf.fit_vocabulary(train, F.col("headline")), "vocabulary")
    return tfidf.tfidf_features(rows, F.col("headline"), vocabulary), vocabulary


def prompt_articles(spark, d):
    """Articles with plain stand-ins for the columns that topic modelling would add."""
    return views.articles(spark, d).select(
        F.col("doc_id").alias("id"),
        "headline",
        F.coalesce("description", F.lit("")).alias("target"),
        F.array_join(F.sort_array(F.array_distinct(K.word_tokens(F.col("headline")))), ", ").alias("keywords"),
        F.col("source").alias("topic_label"),
        "sentiment",
        "covid_status",
    )


def scored_pairs(spark, d):
    return metrics.with_rouge(views.chat_pairs(spark, d), stem=False, which=("rouge1", "rouge2"))


def chat_prompts(spark, d):
    """A prompt table from the conversations: the answer as headline, the turn before it as target."""
    return views.chat_pairs(spark, d).select(
        "id",
        F.col("generated_text").alias("headline"),
        "target",
        F.array_join(F.sort_array(F.array_distinct(K.word_tokens(F.col("target")))), ", ").alias("keywords"),
        F.col("split").alias("topic_label"),
    )


def token_vectors(spark, d, texts=None, first="generated_text"):
    """A token table from the given data: each token takes the embedding that its md5 points to."""
    texts = views.chat_pairs(spark, d) if texts is None else texts
    both = F.array_union(K.rouge_tokens(F.col(first)), K.rouge_tokens(F.col("target")))
    words = explode_once(texts, [], both, "token").distinct()
    e = views.table(spark, d, "embeddings")
    n = e.agg(F.count("*").alias("n")).scalar()
    pointer = F.conv(F.substring(F.md5("token"), 1, 8), 16, 10).cast("long")
    return words.withColumn("vec_id", pointer % n).join(e, "vec_id").select("token", F.col("embedding").alias("vector"))


def metric_models(spark, d, texts=None, first="generated_text"):
    """What the similarity and the soft match read: a vocabulary of the targets and a token table, both written."""
    texts = views.chat_pairs(spark, d) if texts is None else texts
    return {
        "vocabulary": write_and_read(tfidf.fit_vocabulary(texts, F.col("target")), "vocabulary"),
        "token_vectors": write_and_read(token_vectors(spark, d, texts, first), "tokens"),
    }


def _long_vector(df, id_col, vector):
    return posexplode_once(df, [id_col], F.col(vector), "pos", "x").select(id_col, "pos", rounded(F.col("x").cast("double")).alias("x"))


def _rounded(df, *columns):
    return df.withColumns({c: rounded(F.col(c)) for c in columns})


def _wide_rounded(summary: DataFrame) -> DataFrame:
    return _rounded(summary, *[c for c, t in summary.dtypes if t == "double"])


# --- A: sources and sinks -------------------------------------------------------------------------
def a1_read_articles(spark, d):
    raw = views.raw_articles(spark, d)
    path = new_path(spark, "articles-csv")
    tables.write_csv(raw, path)
    schema = "doc_id long, " + ", ".join(f"`{c}` string" for c in V.SOURCE_COLUMNS)
    return tables.read_articles(spark, path, spark.createDataFrame([], schema).schema)


def a1_files_with_different_headers(spark, d):
    raw = views.raw_articles(spark, d)
    path = new_path(spark, "articles-csv")
    orders = [raw.columns, raw.columns[::-1], [c for c in raw.columns if c != "Sentiment"]]
    for i, columns in enumerate(orders):
        tables.write_csv(raw.where(F.col("doc_id") % 3 == i).select(*columns), path, "append")
    schema = "doc_id long, " + ", ".join(f"`{c}` string" for c in V.SOURCE_COLUMNS)
    return tables.read_articles(spark, path, spark.createDataFrame([], schema).schema)


def a2_write_table(spark, d):
    table = tables.write_table(split_articles(spark, d), new_path(spark, "articles"), ["split"])
    return table.select("doc_id", "headline", "source", "split")


def a2_write_csv(spark, d):
    path = new_path(spark, "vectors-csv")
    tables.write_csv(views.table(spark, d, "embeddings"), path)
    return spark.read.schema("vec_id long, embedding string, label int").options(header=True).csv(path)


def a3_save_model(spark, d):
    path = new_path(spark, "model")
    tables.save_model({"vocabulary": tfidf.fit_vocabulary(views.articles(spark, d), F.col("headline"))}, path)
    return _rounded(tables.load_model(spark, path, "vocabulary")["vocabulary"], "idf")


def a3_model_tables(spark, d):
    """All five tables of a model, written and read again, as lines of (part, id, pos, name, value)."""
    path = new_path(spark, "model")
    tables.save_model({"vocabulary": tfidf.fit_vocabulary(views.articles(spark, d), F.col("headline"))}, path)
    components = _stand_in_components(spark, d, tables.load_model(spark, path, "vocabulary")["vocabulary"])
    tables.save_model({"components": components.withColumn("vector", VX.as_doubles(F.col("vector"))), "centers": views.label_centres(spark, d)}, path)
    made = tables.load_model(spark, path, "components", "centers")
    lengths = posexplode_once(made["components"], [], F.col("vector"), "component", "x").groupBy("component")
    lengths = lengths.agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("singular_value"))
    tables.save_model({"singular_values": lengths, "labels": topics.topic_labels(made["centers"], made["components"])}, path)
    made = tables.load_model(spark, path, "vocabulary", "components", "singular_values", "centers", "labels")

    def lines(df, part, key, pos=None, name=None, value=None):
        none = F.lit(None)
        columns = [F.col(key).cast("long").alias("id"), (none if pos is None else F.col(pos)).cast("int").alias("pos")]
        columns += [(none if name is None else F.col(name)).cast("string").alias("name")]
        return df.select(F.lit(part).alias("part"), *columns, rounded((none if value is None else F.col(value)).cast("double")).alias("value"))

    parts = [
        lines(made["vocabulary"], "vocabulary", "term_id", name="term", value="idf"),
        lines(posexplode_once(made["components"], ["term_id", "term"], F.col("vector"), "pos", "x"), "components", "term_id", "pos", "term", "x"),
        lines(made["singular_values"], "singular_values", "component", value="singular_value"),
        lines(posexplode_once(made["centers"], ["cluster_id"], F.col("center"), "pos", "x"), "centers", "cluster_id", "pos", value="x"),
        lines(made["labels"], "labels", "cluster_id", name="topic_label"),
    ]
    return reduce(DataFrame.union, parts)


def a4_write_label_dictionary(spark, d):
    labels = (
        views.table(spark, d, "embeddings")
        .groupBy(F.col("label").alias("cluster_id"))
        .agg(F.concat_ws(" | ", F.lit("label"), F.count("*").cast("string")).alias("topic_label"))
    )
    path = new_path(spark, "labels")
    tables.write_label_dictionary(labels, path)
    return spark.read.schema("cluster_id string, topic_label string").json(path)


def a5_read_if_exists(spark, d):
    path = new_path(spark, "generated")
    pairs = views.chat_pairs(spark, d)
    tables.write_table(pairs, path, ["split"])
    found = {s: tables.read_if_exists(spark, f"{path}/split={s}") for s in ("train", "val", "test")}  # no train rows
    found = {s: df if df is None else df.withColumn("split", F.lit(s)) for s, df in found.items()}
    return report.combine_summaries([df for df in found.values() if df is not None]).groupBy("split").agg(
        F.count("*").alias("n")
    )


def a6_markdown_report(spark, d):
    summary = report.summary_by_strategy(write_and_read(scored_pairs(spark, d), "scored"))
    lines = report.markdown_lines(summary, ["val", "test", "train"])
    path = new_path(spark, "report")
    tables.write_markdown(lines, path)
    return lines


# --- B: cleaning and profiling --------------------------------------------------------------------
def b1_normalize_column_names(spark, d):
    return clean.normalize_column_names(views.raw_articles(spark, d))


def b2_parse_dates(spark, d):
    return typed_raw(spark, d).select("doc_id", F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"))


def b2_count_bad_dates(spark, d):
    return clean.count_bad_dates(clean.normalize_column_names(views.raw_articles(spark, d)))


def _mixed_dates(spark, d):
    """Days written in eight ways; every other numeric date could be read both ways."""
    day, kind = F.col("date"), F.col("doc_id") % 8
    text = F.when(day.isNull() | (kind == 7), "soon")
    for i, form in enumerate(["d/M/yyyy", "dd/MM/yyyy", "dd.MM.yyyy", "yyyyMMdd", "dd/MM/yy", "EEE, dd MMM yyyy 08:30:00 +0000", "MMM d, yyyy"]):
        text = text.when(kind == i, F.date_format(day, form.replace("08:30:00 +0000", "'08:30:00 +0000'")))
    return views.articles(spark, d).select("doc_id", text.alias("date"))


def b2_infer_dates(spark, d):
    parsed = clean.parse_dates(_mixed_dates(spark, d))
    return parsed.select("doc_id", F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"))


def b2_date_convention(spark, d):
    return clean.date_convention(_mixed_dates(spark, d))


def b3_strip_html(spark, d):
    return views.table(spark, d, "pages").select("page_id", X.strip_html(F.col("html")).alias("text"))


def b4_drop_missing_critical(spark, d):
    return clean.drop_missing_critical(typed_raw(spark, d)).select("doc_id", "headline", "description")


def b5_fill_optional_missing(spark, d):
    df = clean.fill_optional_missing(views.articles(spark, d))
    return df.select("doc_id", "covid_status", "sentiment", "source", "image_url")


def b6_dedup_exact(spark, d):
    return clean.remove_duplicates(views.articles(spark, d)).select("doc_id", "headline", "source", "covid_status")


def b7a_profile_shape(spark, d):
    return profile.profile_shape(views.articles(spark, d))


def b7b_profile_nulls(spark, d):
    return profile.profile_nulls(views.articles(spark, d))


def b7c_profile_value_counts(spark, d):
    return profile.profile_value_counts(views.articles(spark, d))


def b7d_profile_date_range(spark, d):
    spans = profile.profile_date_range(views.articles(spark, d))
    return spans.select(*[F.date_format(c, "yyyy-MM-dd").alias(c) for c in spans.columns])


# --- C: normalisation, near duplicates, split -----------------------------------------------------
def c1_remove_html_entities(spark, d):
    return views.table(spark, d, "pages").select("page_id", X.remove_html_entities(F.col("html")).alias("text"))


def c2_normalize_unicode(spark, d):
    return views.table(spark, d, "documents").select("doc_id", X.normalize_unicode(F.col("text")).alias("text"))


def c3_remove_special_chars(spark, d):
    return views.table(spark, d, "documents").select("doc_id", X.remove_special_chars(F.col("text")).alias("text"))


def c4_collapse_whitespace(spark, d):
    return views.table(spark, d, "documents").select("doc_id", X.collapse_whitespace(F.col("text")).alias("text"))


def c5_preprocess_text(spark, d):
    return clean.preprocess_text_fields(views.articles(spark, d)).select("doc_id", "headline", "description")


def c5_preprocess_pages(spark, d):
    return views.table(spark, d, "pages").select("page_id", X.preprocess_text(F.col("html")).alias("text"))


def c6_dedup_normalized(spark, d):
    a = views.articles(spark, d)
    # Each headline also in capitals with double spaces, under an id of its own, so that only the key tells them apart.
    louder = a.withColumns(
        {
            "headline": F.concat(F.lit("  "), F.translate(F.regexp_replace("headline", " ", "  "), ascii_lowercase, ascii_uppercase)),
            "doc_id": -1 - F.col("doc_id"),
        }
    )
    return clean.remove_near_duplicates(a.unionByName(louder)).select("doc_id", "headline", "source")


def c7_time_based_split(spark, d):
    return split_articles(spark, d).select("doc_id", "split")


def c7_time_based_split_events(spark, d):
    return split.time_based_split(views.table(spark, d, "events"), "ts", "event_id").select("event_id", "split")


def c7_time_based_split_text_ids(spark, d):
    a = views.articles(spark, d).select(F.concat(F.lit("article-"), F.md5(F.col("doc_id").cast("string"))).alias("key"), "date")
    return split.time_based_split(a, "date", "key").select("key", "split")


def c8_dedup_report(spark, d):
    a = views.articles(spark, d)
    exact = profile.dedup_report(a, F.col("headline"), "exact")
    near = profile.dedup_report(a, X.near_duplicate_key(F.col("headline")), "normalized")
    return exact.unionByName(near)


def c9_split_sizes(spark, d):
    return split.split_sizes(split_articles(spark, d))


# --- D: TF-IDF, keywords, SVD ---------------------------------------------------------------------
def d1_tokenize(spark, d):
    return views.table(spark, d, "documents").select("doc_id", F.array_join(K.word_tokens(F.col("text")), " ").alias("tokens"))


def d2_remove_stop_words(spark, d):
    kept = K.remove_stop_words(K.word_tokens(F.col("text")))
    return views.table(spark, d, "documents").select("doc_id", F.array_join(kept, " ").alias("tokens"))


def d3_ngrams(spark, d):
    return views.articles(spark, d).select("doc_id", F.array_join(K.tfidf_terms(F.col("headline")), "|").alias("terms"))


def d4_document_frequency(spark, d):
    return tfidf.document_frequency(views.articles(spark, d), F.col("headline"))


def d5_fit_vocabulary(spark, d):
    vocabulary = tfidf.fit_vocabulary(views.articles(spark, d), F.col("headline"))
    return vocabulary.select("term_id", "term", "df", "corpus_count")


def d6_fit_idf(spark, d):
    vocabulary = tfidf.fit_vocabulary(views.articles(spark, d), F.col("headline"))
    return _rounded(vocabulary.select("term", "idf"), "idf")


def d7_tfidf_transform(spark, d):
    return _rounded(tfidf.tfidf_matrix(article_features(spark, d)[0]), "weight")


def d8_top_keywords(spark, d):
    return article_features(spark, d)[0].select("doc_id", tfidf.top_keywords(F.col("features")).alias("keywords"))


def _train_svd(spark, d):
    features, vocabulary = article_features(spark, d)
    features = write_and_read(features.select("doc_id", "split", "features"), "features")
    loadings, values = svd.fit_svd(features.where(F.col("split") == "train"), vocabulary)
    return features, loadings, values


def d9_fit_svd(spark, d):
    _, loadings, _ = _train_svd(spark, d)
    return posexplode_once(loadings, ["term_id", "term"], F.col("vector"), "component", "loading")


def d9_svd_invariants(spark, d):
    """What holds for every fit: orthonormal components, and documents whose energy along one is its squared value.

    Per component, the largest deviation from it; the energy's is relative to the first component's.
    """
    features, loadings, values = _train_svd(spark, d)
    matrix = svd.component_matrix(loadings)  # terms x components, as the fit itself holds it
    off = np.abs(matrix.T @ matrix - np.eye(len(values))).max(axis=1)
    fitted = spark.createDataFrame([(i, float(o), v) for i, (o, v) in enumerate(zip(off, values))], "component int, off double, value double")
    projected = svd.svd_transform(features.where(F.col("split") == "train").select("features"), loadings)
    energy = posexplode_once(projected, [], F.col("svd_vector"), "component", "x").groupBy("component").agg(F.sum(F.col("x") * F.col("x")).alias("energy"))
    gap = F.abs(F.coalesce("energy", F.lit(0.0)) - F.col("value") * F.col("value")) / F.lit(values[0] ** 2 if values and values[0] else 1.0)
    return fitted.join(energy, "component", "left").select(
        "component", rounded(F.col("off")).alias("off_orthonormal"), rounded(gap).alias("off_energy")
    )


def d10_explained_variance(spark, d):
    features, loadings, _ = _train_svd(spark, d)
    train = features.where(F.col("split") == "train")
    return svd.explained_variance(write_and_read(svd.svd_transform(train, loadings), "projected"))


def d11_svd_transform(spark, d):
    features, loadings, _ = _train_svd(spark, d)
    projected = svd.svd_transform(features, loadings)
    return posexplode_once(projected, ["doc_id"], F.col("svd_vector"), "component", "value")


def _fixed_projection(spark, d):
    """Documents under given components (an embedding per term) instead of fitted ones, so that SQL can follow."""
    a = views.articles(spark, d)
    components = write_and_read(_stand_in_components(spark, d), "components")
    features = tfidf.tfidf_features(a.select("doc_id", "headline"), F.col("headline"), _all_vocabulary(spark, d))
    return svd.svd_transform(features, components)


def d10_explained_variance_fixed(spark, d):
    projected = write_and_read(_fixed_projection(spark, d).select("doc_id", "features", "svd_vector"), "projected")
    return _rounded(svd.explained_variance(projected), "variance", "ratio")


def d11_svd_transform_fixed(spark, d):
    return _long_vector(_fixed_projection(spark, d), "doc_id", "svd_vector")


def d12_vector_to_text(spark, d):
    return views.table(spark, d, "embeddings").select("vec_id", VX.vector_to_text(F.col("embedding")).alias("svd_vector"))


def d12_text_to_vector(spark, d):
    e = views.table(spark, d, "embeddings")
    return _long_vector(e.select("vec_id", VX.text_to_vector(VX.vector_to_text(F.col("embedding"))).alias("v")), "vec_id", "v")


def d13_enrich_split(spark, d):
    """Keywords and vectors of every split, under given components so that SQL can follow the vectors."""
    rows, vocabulary = article_features(spark, d)
    components = write_and_read(_stand_in_components(spark, d, vocabulary), "components")
    enriched = jobs.enrich(rows.drop("features"), vocabulary, components)
    long = posexplode_once(enriched, ["doc_id", "split", "keywords"], F.col("svd_vector"), "pos", "x")
    return _rounded(long, "x")


def d14_tfidf_search(spark, d):
    """Documents are tokenised once; vocabulary, features and the index come from their written term counts."""
    words = K.remove_stop_words(K.word_tokens(F.col("text")))
    counted = views.table(spark, d, "documents").select("doc_id", uni_and_bigram_counts(words).alias("counts"))
    counts, no_text = F.col("counts"), F.lit("")
    with staged(counted, "counts", small_groups=True) as documents:
        vocabulary = write_and_read(tfidf.fit_vocabulary(documents, no_text, counts=counts), "vocabulary")
        features = tfidf.tfidf_features(documents, no_text, vocabulary, counts=counts)
        index = search_index.build_index(features, new_path(spark, "search-index"))
    queries = views.table(spark, d, "benchmark").withColumnRenamed("item_id", "query_id")
    queries = tfidf.tfidf_features(queries, F.col("text"), vocabulary, "query_id")
    return search_index.search(queries, index).select("query_id", "doc_id", "rank", "score")


# --- E: topics and prompt dataset -----------------------------------------------------------------
def e1_fit_kmeans(spark, d):
    centres, cost = topics.fit_kmeans(views.table(spark, d, "embeddings"), "embedding")
    return posexplode_once(centres, ["cluster_id"], F.col("center"), "pos", "x").withColumn("cost", F.lit(cost))


def e1_kmeans_invariants(spark, d):
    """What holds for every converged fit: centres weighted by their members add up to all vectors (a row per
    position), and cost plus weighted squared centres to all squared lengths (position -1)."""
    vectors = views.table(spark, d, "embeddings")
    centres, cost = topics.fit_kmeans(vectors, "embedding")
    sizes = topics.assign_clusters(vectors, centres, "embedding").groupBy("cluster_id").agg(F.count("*").alias("n"))
    sums = posexplode_once(centres.join(sizes, "cluster_id"), ["n"], F.col("center"), "pos", "x")
    along = sums.groupBy("pos").agg(F.sum(F.col("n") * F.col("x")).alias("total"))
    lengths = sums.agg((F.sum(F.col("n") * F.col("x") * F.col("x")) + F.lit(cost)).alias("total"))
    both = along.unionByName(lengths.select(F.lit(-1).alias("pos"), "total"))
    return both.select("pos", rounded(F.col("total"), 4).alias("total"))


def _nearest(spark, d):
    return topics.assign_clusters(views.table(spark, d, "embeddings"), views.label_centres(spark, d), "embedding")


def e2_assign_clusters(spark, d):
    return _rounded(_nearest(spark, d).select("vec_id", "cluster_id", "distance2"), "distance2")


def e3_cluster_inertia(spark, d):
    return _rounded(topics.cluster_inertia(_nearest(spark, d)), "inertia")


def _all_vocabulary(spark, d):
    return write_and_read(tfidf.fit_vocabulary(views.articles(spark, d), F.col("headline")), "vocabulary")


def _stand_in_components(spark, d, vocabulary=None):
    """(term_id, term, vector) with the embedding that each term id points to."""
    if vocabulary is None:
        vocabulary = tfidf.fit_vocabulary(views.articles(spark, d), F.col("headline"))
    e = views.table(spark, d, "embeddings")
    n = e.agg(F.count("*").alias("n")).scalar()
    return (
        vocabulary.withColumn("vec_id", F.col("term_id").cast("long") % n)
        .join(e, "vec_id")
        .select("term_id", "term", F.col("embedding").alias("vector"))
    )


def e4_topic_labels(spark, d):
    return topics.topic_labels(views.label_centres(spark, d), _stand_in_components(spark, d))


def e5_attach_topic_label(spark, d):
    labels = topics.topic_labels(views.label_centres(spark, d), _stand_in_components(spark, d))
    return topics.attach_topic_label(_nearest(spark, d), labels).select("vec_id", "cluster_id", "topic_label")


def e6_build_prompt_context(spark, d):
    return prompts.build_prompt_context(prompt_articles(spark, d)).select("id", "prompt")


def e7_build_prompt_dataset(spark, d):
    df = views.articles(spark, d).withColumns(
        {"keywords": F.lower("headline"), "topic_label": F.col("source"), "cluster_id": F.length("source").cast("long")}
    )
    return prompts.build_prompt_dataset(df)


# --- F: strategies and generation -----------------------------------------------------------------
def _strategy_query(name):
    def query(spark, d):
        return prompts.build_prompt(prompt_articles(spark, d), name).select("id", "prompt_text")

    return query


def f5_build_prompt(spark, d):
    """Strategy taken from a column; names that are not registered fall back to the metadata-aware one."""
    df = prompt_articles(spark, d).withColumn(
        "prompt_strategy", F.element_at(F.array(*[F.lit(s) for s in [*V.STRATEGY_TEMPLATES, "other"]]), (F.col("id") % 5 + 1).cast("int"))
    )
    return prompts.build_prompt_by_column(df).select("id", "prompt_strategy", "prompt_text")


def f6_generate_batch(spark, d):
    prompted = prompts.run_strategies(prompt_articles(spark, d))
    return generate.generate_batch(prompted).select("id", "prompt_strategy", "generated_text")


def f6_generate_once(spark, d):
    """One model call for each distinct prompt, answers kept in a table that a later run takes up."""
    prompted = prompts.run_strategies(prompt_articles(spark, d))
    made = generate.generate_once(prompted, new_path(spark, "answers"), id_col="id")
    return made.select("id", "prompt_strategy", "generated_text")


def f7_clean_generated_text(spark, d):
    openings = ["Sure! Let me see.\n", "Here is the post\n\n", "  Post : ", "certainly, gladly\nSummary:\n", ""]
    opening = F.element_at(F.array(*[F.lit(o) for o in openings]), (F.col("conv_id") % 5 + 1).cast("int"))
    c = views.table(spark, d, "conversations")
    return c.select("conv_id", "turn", X.clean_generated_text(F.concat(opening, F.col("text"))).alias("text"))


def f8_tag_generation(spark, d):
    c = views.chat_pairs(spark, d).drop("prompt_strategy")
    return generate.tag_generation(c, "detailed").select("id", "generated_text", "prompt_strategy")


def f9_run_strategies(spark, d):
    return prompts.run_strategies(prompt_articles(spark, d)).select("id", "prompt_strategy", "prompt_text")


# --- G: metrics -----------------------------------------------------------------------------------
def g1_cosine_similarity(spark, d):
    pairs = views.vector_pairs(spark, d)
    return pairs.select("id", rounded(VX.cosine(F.col("generated_vec"), F.col("target_vec"))).alias("sbert_similarity"))


def g2_embed_text(spark, d):
    """TF-IDF rows of both texts as the default encoder, and their cosine."""
    pairs = views.chat_pairs(spark, d)
    vocabulary = write_and_read(tfidf.fit_vocabulary(pairs, F.col("target")), "vocabulary")
    return _rounded(metrics.with_similarity(pairs, vocabulary).select("id", "sbert_similarity"), "sbert_similarity")


def g2_weighted_token_vectors(spark, d):
    """Weighted token vectors of both texts less their common direction as the encoder, and their cosine."""
    vectors = write_and_read(token_vectors(spark, d), "tokens")
    scored = metrics.with_similarity(views.chat_pairs(spark, d), sentence_vectors=vectors)
    return _rounded(scored.select("id", "sbert_similarity"), "sbert_similarity")


def _rouge_query(name, stem=False):
    def query(spark, d):
        scored = metrics.with_rouge(views.chat_pairs(spark, d), stem=stem, which=(name,))
        return _rounded(scored.select("id", name), name)

    return query


def g6_stem_tokens(spark, d):
    return metrics.stem_dictionary(views.table(spark, d, "documents"), "text")


def g6_rouge_stemmed(spark, d):
    scored = metrics.with_rouge(views.chat_pairs(spark, d), stem=True, which=("rouge1", "rouge2"))
    return _rounded(scored.select("id", "rouge1", "rouge2"), "rouge1", "rouge2")


def g7_soft_token_score(spark, d):
    scored = metrics.with_soft_match(views.chat_pairs(spark, d), write_and_read(token_vectors(spark, d), "tokens"))
    names = ["bertscore_p", "bertscore_r", "bertscore_f1"]
    return _rounded(scored.select("id", *names), *names)


def g7_soft_token_score_word2vec(spark, d):
    pairs = views.chat_pairs(spark, d)
    vectors = metrics.train_token_vectors(pairs, "target")
    return metrics.with_soft_match(pairs, vectors).select("id", "bertscore_p", "bertscore_r", "bertscore_f1")


def g7_token_ppmi(spark, d):
    """What the token vectors are factorised from, over every conversation."""
    texts = views.table(spark, d, "conversations")
    counts = write_and_read(token_space.token_counts(texts, "text"), "token-counts")
    pairs = write_and_read(token_space.cooccurrences(texts, "text"), "pairs")
    contexts = write_and_read(token_space.context_table(counts), "contexts")
    found = token_space.ppmi(pairs, counts, contexts)
    return found.select("token", "context", "n", rounded(F.col("ppmi")).alias("ppmi"))


def g7_soft_token_score_ppmi(spark, d):
    vectors = token_space.fit_token_vectors(views.table(spark, d, "conversations"), "text")
    scored = metrics.with_soft_match(views.chat_pairs(spark, d), vectors)
    return scored.select("id", "bertscore_p", "bertscore_r", "bertscore_f1")


def g8_evaluate_generations(spark, d):
    scored = metrics.evaluate_generations(views.chat_pairs(spark, d), **metric_models(spark, d))
    return _rounded(scored.select("id", *V.METRICS), *V.METRICS)


def g9_contrast_ratio(spark, d):
    return _wide_rounded(metrics.contrast_ratio(views.vector_pairs(spark, d)))


# --- H: evaluation summary ------------------------------------------------------------------------
def _scored_table(spark, d):
    return write_and_read(scored_pairs(spark, d), "scored")


def h1_ensure_metrics(spark, d):
    """ROUGE is incomplete, so the whole group is computed again; the similarity column is already there."""
    stale = views.chat_pairs(spark, d).withColumns({"rouge1": F.lit(-1.0), "sbert_similarity": F.lit(0.5)})
    scored = metrics.ensure_metrics(stale, **metric_models(spark, d))
    return _rounded(scored.select("id", *V.METRICS), *V.METRICS)


def h2_evaluate_split(spark, d):
    path = new_path(spark, "generated")
    tables.write_table(views.chat_pairs(spark, d), path, ["split"])
    options = metric_models(spark, d)
    parts = [
        jobs.evaluate_split(spark, f"{path}/split={s}", f"{path}-{s}", s, **options) for s in ("val", "test", "train")
    ]
    both = report.combine_summaries([p for p in parts if p is not None])
    return _rounded(both.select("id", "split", "prompt_strategy", *V.METRICS), *V.METRICS)


def h3_summary_by_strategy(spark, d):
    return _wide_rounded(report.summary_by_strategy(_scored_table(spark, d)))


def h4_summary_long(spark, d):
    return _wide_rounded(report.summary_long(_scored_table(spark, d)))


def h5_top_k_samples(spark, d):
    top = report.top_k_samples(scored_pairs(spark, d).withColumn("headline", F.col("target")), "rouge1")
    return _rounded(top.withColumn("rank", F.col("rank").cast("long")), "score")


def h6_bottom_k_samples(spark, d):
    scored = scored_pairs(spark, d).withColumn("headline", F.col("target"))
    with_gaps = scored.withColumn("rouge1", F.when(F.col("id") % 13 != 0, F.col("rouge1")))
    bottom = report.bottom_k_samples(with_gaps, "rouge1")
    return bottom.select("split", "id", rounded(F.coalesce("score", F.lit(-1.0))).alias("score"), "headline", "generated", "rank")


def h7_combine_summaries(spark, d):
    df = _scored_table(spark, d)
    parts = [report.summary_by_strategy(df.where(F.col("split") == s)) for s in ("val", "test")]
    return _wide_rounded(report.combine_summaries(parts))


def h8_compare_strategies(spark, d):
    return _wide_rounded(report.compare_strategies(report.summary_by_strategy(_scored_table(spark, d))))


def h9_delta_vs_baseline(spark, d):
    return _wide_rounded(report.delta_vs_baseline(report.summary_by_strategy(_scored_table(spark, d))))


def h10_run_evaluation(spark, d):
    path = new_path(spark, "evaluation")
    tables.write_table(views.chat_pairs(spark, d), f"{path}/generated", ["split"])
    options = metric_models(spark, d)
    return _wide_rounded(jobs.run_evaluation(spark, f"{path}/generated", f"{path}/out", ("val", "test", "train"), **options))


# --- P: jobs --------------------------------------------------------------------------------------
_RAW_SCHEMA = "doc_id long, " + ", ".join(f"`{c}` string" for c in V.SOURCE_COLUMNS)


def _ingested(spark, d, root, profile_path=None):
    tables.write_csv(views.raw_articles(spark, d), f"{root}/csv")
    schema = spark.createDataFrame([], _RAW_SCHEMA).schema
    return jobs.ingest_and_clean(spark, f"{root}/csv", f"{root}/cleaned", schema, profile_path)


def _preprocessed(spark, d, root):
    _ingested(spark, d, root)
    return jobs.preprocess_and_split(spark, f"{root}/cleaned", f"{root}/split")


def _enriched(spark, d, root):
    _preprocessed(spark, d, root)
    return jobs.extract_metadata_and_keywords(spark, f"{root}/split", f"{root}/keywords", f"{root}/model")


def p1_ingest_and_clean(spark, d):
    df = _ingested(spark, d, new_path(spark, "p1"))
    return df.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


def p1_ingest_profile(spark, d):
    """The tables that the job writes beside the cleaned one, as lines of (part, name, n)."""
    root = new_path(spark, "p1")
    _ingested(spark, d, root, f"{root}/profile")
    made = tables.load_model(spark, f"{root}/profile", "steps", "nulls", "value_counts", "shape")
    lines = [
        made["steps"].select(F.lit("step").alias("part"), F.col("step").alias("name"), "n"),
        made["nulls"].select(F.lit("nulls"), "column_name", "null_count"),
        made["value_counts"].select(F.lit("value"), F.concat_ws("=", "column_name", "value"), "n"),
        made["shape"].select(F.lit("rows"), "column_name", "n_rows"),
    ]
    return reduce(DataFrame.union, lines)


def p2_preprocess_and_split(spark, d):
    df = _preprocessed(spark, d, new_path(spark, "p2"))
    return df.select("doc_id", "headline", "description", F.date_format("date", "yyyy-MM-dd").alias("date"), "split")


def p3_extract_keywords(spark, d):
    df = _enriched(spark, d, new_path(spark, "p3"))
    return df.select("doc_id", "split", "keywords", F.size("svd_vector").cast("long").alias("dimensions"))


def p3_job_vectors(spark, d):
    """The job's keywords and vectors under given components, so that SQL can follow the vectors."""
    root = new_path(spark, "p3")
    train = _preprocessed(spark, d, root).where(F.col("split") == "train")
    vocabulary = write_and_read(tfidf.fit_vocabulary(train, F.col("headline")), "vocabulary")
    given = _stand_in_components(spark, d, vocabulary)
    made = jobs.extract_metadata_and_keywords(
        spark, f"{root}/split", f"{root}/keywords", f"{root}/model", given_components=given
    )
    return _rounded(posexplode_once(made, ["doc_id", "split", "keywords"], F.col("svd_vector"), "pos", "x"), "x")


def p4_cluster_and_build_prompts(spark, d):
    """All that does not hang on the fitted clusters, and checks of what does: cluster, label, a prompt that shows it."""
    root = new_path(spark, "p4")
    _enriched(spark, d, root)
    made = jobs.cluster_and_build_prompts(spark, f"{root}/keywords", f"{root}/model", f"{root}/clustered", f"{root}/prompts")
    again = prompts.build_prompt_context(made, "_again")
    return again.select(
        "id", "target", "headline", "keywords", "sentiment", "covid_status", "split",
        F.col("cluster_id").between(0, V.N_CLUSTERS - 1).alias("has_cluster"),
        (F.length("topic_label") > 0).alias("has_label"),
        (F.col("prompt") == F.col("_again")).alias("prompt_fits"),
    )


def p5_run_generation(spark, d):
    root = new_path(spark, "p5")
    table = tables.write_table(chat_prompts(spark, d), f"{root}/prompts")
    models = metric_models(spark, d, table, "headline")
    made = [
        jobs.run_generation(spark, f"{root}/prompts", f"{root}/generated/{s}", s, **models) for s in V.STRATEGY_TEMPLATES
    ]
    columns = ["id", "prompt_text", "generated_text", "prompt_strategy", *V.METRICS]
    return _rounded(report.combine_summaries(made).select(*columns), *V.METRICS)


QUERIES = {
    "A1_read_articles": a1_read_articles,
    "A1_different_headers": a1_files_with_different_headers,
    "A2_write_table": a2_write_table,
    "A2_write_csv": a2_write_csv,
    "A3_save_model": a3_save_model,
    "A3_model_tables": a3_model_tables,
    "A4_write_label_dictionary": a4_write_label_dictionary,
    "A5_read_if_exists": a5_read_if_exists,
    "A6_markdown_report": a6_markdown_report,
    "B1_normalize_column_names": b1_normalize_column_names,
    "B2_parse_dates": b2_parse_dates,
    "B2_count_bad_dates": b2_count_bad_dates,
    "B2_infer_dates": b2_infer_dates,
    "B2_date_convention": b2_date_convention,
    "B3_strip_html": b3_strip_html,
    "B4_drop_missing_critical": b4_drop_missing_critical,
    "B5_fill_optional_missing": b5_fill_optional_missing,
    "B6_dedup_exact": b6_dedup_exact,
    "B7a_profile_shape": b7a_profile_shape,
    "B7b_profile_nulls": b7b_profile_nulls,
    "B7c_profile_value_counts": b7c_profile_value_counts,
    "B7d_profile_date_range": b7d_profile_date_range,
    "C1_remove_html_entities": c1_remove_html_entities,
    "C2_normalize_unicode": c2_normalize_unicode,
    "C3_remove_special_chars": c3_remove_special_chars,
    "C4_collapse_whitespace": c4_collapse_whitespace,
    "C5_preprocess_text": c5_preprocess_text,
    "C5_preprocess_pages": c5_preprocess_pages,
    "C6_dedup_normalized": c6_dedup_normalized,
    "C7_time_based_split": c7_time_based_split,
    "C7_time_based_split_events": c7_time_based_split_events,
    "C7_time_based_split_text_ids": c7_time_based_split_text_ids,
    "C8_dedup_report": c8_dedup_report,
    "C9_split_sizes": c9_split_sizes,
    "D1_tokenize": d1_tokenize,
    "D2_remove_stop_words": d2_remove_stop_words,
    "D3_ngrams": d3_ngrams,
    "D4_document_frequency": d4_document_frequency,
    "D5_fit_vocabulary": d5_fit_vocabulary,
    "D6_fit_idf": d6_fit_idf,
    "D7_tfidf_transform": d7_tfidf_transform,
    "D8_top_keywords": d8_top_keywords,
    "D9_fit_svd": d9_fit_svd,
    "D9_svd_invariants": d9_svd_invariants,
    "D10_explained_variance": d10_explained_variance,
    "D10_explained_variance_fixed": d10_explained_variance_fixed,
    "D11_svd_transform": d11_svd_transform,
    "D11_svd_transform_fixed": d11_svd_transform_fixed,
    "D12_vector_to_text": d12_vector_to_text,
    "D12_text_to_vector": d12_text_to_vector,
    "D13_enrich_split": d13_enrich_split,
    "D14_tfidf_search": d14_tfidf_search,
    "E1_fit_kmeans": e1_fit_kmeans,
    "E1_kmeans_invariants": e1_kmeans_invariants,
    "E2_assign_clusters": e2_assign_clusters,
    "E3_cluster_inertia": e3_cluster_inertia,
    "E4_topic_labels": e4_topic_labels,
    "E5_attach_topic_label": e5_attach_topic_label,
    "E6_build_prompt_context": e6_build_prompt_context,
    "E7_build_prompt_dataset": e7_build_prompt_dataset,
    "F1_prompt_structured": _strategy_query("structured"),
    "F2_prompt_detailed": _strategy_query("detailed"),
    "F3_prompt_role_based": _strategy_query("role_based"),
    "F4_prompt_metadata_aware": _strategy_query("metadata_aware"),
    "F5_build_prompt": f5_build_prompt,
    "F6_generate_batch": f6_generate_batch,
    "F6_generate_once": f6_generate_once,
    "F7_clean_generated_text": f7_clean_generated_text,
    "F8_tag_generation": f8_tag_generation,
    "F9_run_strategies": f9_run_strategies,
    "G1_cosine_similarity": g1_cosine_similarity,
    "G2_embed_text": g2_embed_text,
    "G3_rouge1": _rouge_query("rouge1"),
    "G4_rouge2": _rouge_query("rouge2"),
    "G5_rougeL": _rouge_query("rougeL"),
    "G6_stem_tokens": g6_stem_tokens,
    "G6_rouge_stemmed": g6_rouge_stemmed,
    "G2_weighted_token_vectors": g2_weighted_token_vectors,
    "G7_soft_token_score": g7_soft_token_score,
    "G7_soft_token_score_ppmi": g7_soft_token_score_ppmi,
    "G7_token_ppmi": g7_token_ppmi,
    "G7_soft_token_score_word2vec": g7_soft_token_score_word2vec,
    "G8_evaluate_generations": g8_evaluate_generations,
    "G9_contrast_ratio": g9_contrast_ratio,
    "H1_ensure_metrics": h1_ensure_metrics,
    "H2_evaluate_split": h2_evaluate_split,
    "H3_summary_by_strategy": h3_summary_by_strategy,
    "H4_summary_long": h4_summary_long,
    "H5_top_k_samples": h5_top_k_samples,
    "H6_bottom_k_samples": h6_bottom_k_samples,
    "H7_combine_summaries": h7_combine_summaries,
    "H8_compare_strategies": h8_compare_strategies,
    "H9_delta_vs_baseline": h9_delta_vs_baseline,
    "H10_run_evaluation": h10_run_evaluation,
    "P1_ingest_and_clean": p1_ingest_and_clean,
    "P1_ingest_profile": p1_ingest_profile,
    "P2_preprocess_and_split": p2_preprocess_and_split,
    "P3_extract_keywords": p3_extract_keywords,
    "P3_job_vectors": p3_job_vectors,
    "P4_cluster_and_build_prompts": p4_cluster_and_build_prompts,
    "P5_run_generation": p5_run_generation,
}
