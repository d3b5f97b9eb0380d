"""Batch text generation with a pluggable model."""

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressloom.functions import fixed_values as V
from pressloom.functions.text import clean_generated_text
from pressloom.operators.joins import lookup_join
from pressloom.session import staged
from pressloom.sources import tables

Generator = Callable[[list[str]], list[str]]


def prompt_words() -> list[str]:
    """Words of the prompt templates themselves, and stop words: they say nothing about the article."""
    fixed = re.sub(r"\{\w+\}", " ", " ".join(V.STRATEGY_TEMPLATES.values())).lower()
    return sorted({*re.findall(r"\w{2,}", fixed), *V.ENGLISH_STOP_WORDS})


def central_sentence() -> Generator:
    """Offline default model: the prompt's sentence whose words occur most often in the whole prompt.

    A sentence scores the sum, over its distinct words, of how often the prompt has them; words of the templates and
    stop words do not count. Lines of metadata lend weight and are not answers. Ties go to the first sentence; a prompt
    without words of its own gives ''. Spark's part is the batching; a language model takes this one's place.
    """
    ignored = frozenset(prompt_words())
    find_words, find_sentences = re.compile(r"\w{2,}").findall, re.compile(V.SENTENCE).findall

    def answer(prompt: str) -> str:
        words, sentences = [], []  # each sentence's words are looked for once, for the counts and for its score
        for line in prompt.split("\n"):
            body = "" if re.search(V.META_LINE, line) else re.sub(V.ARTICLE_LABEL, "", line)
            words += find_words(line[: len(line) - len(body)].lower())
            for sentence in find_sentences(body):
                sentences.append((sentence, find_words(sentence.lower())))
                words += sentences[-1][1]
        # A capital sigma is lower-cased by what surrounds it, in the whole prompt.
        counts, best, best_score = Counter(find_words(prompt.lower()) if "\u03a3" in prompt else words), "", 0
        for w in ignored & counts.keys():
            counts[w] = 0
        for sentence, found in sentences:
            score = sum(map(counts.__getitem__, set(found)))
            if score > best_score:
                best, best_score = sentence, score
        return re.sub(r"\s+", " ", best).strip()

    return lambda texts: [answer(t) for t in texts]


def generated(prompt: Column, factory: Callable[[], Generator] = central_sentence, batch_size: int = V.BATCH_SIZE) -> Column:
    """``factory`` builds the model once per task; only the prompt column crosses to Python.

    Declared non-deterministic, so that a filter on the text never makes the model run twice.
    """

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for texts in batches:
            texts = texts.fillna("")
            out = []
            for i in range(0, len(texts), batch_size):
                out.extend(model(texts.iloc[i : i + batch_size].tolist()))
            yield pd.Series(out, dtype="object")

    return run.asNondeterministic()(prompt)


def generate_batch(
    df: DataFrame,
    prompt_col: str = "prompt_text",
    factory: Callable[[], Generator] = central_sentence,
    batch_size: int = V.BATCH_SIZE,
    out: str = "generated_text",
) -> DataFrame:
    return df.withColumn(out, generated(F.col(prompt_col), factory, batch_size))


def generate_once(
    df: DataFrame,
    answers_path: str,
    prompt_col: str = "prompt_text",
    factory: Callable[[], Generator] = central_sentence,
    batch_size: int = V.BATCH_SIZE,
    out: str = "generated_text",
    id_col: str = "id",
    parts: int = 16,
) -> DataFrame:
    """``generate_batch`` with one answer per distinct prompt, kept in a table of (digest, answer) at ``answers_path``.

    Prompts whose answer is there are not generated again, so a job that was ended goes on where it stood and a later job
    pays for new prompts only. The new ones are written in ``parts`` jobs: what was lost is at most the part under way (a task
    that fails within it asks the model again, but one answer is kept). Prompts of like length share a batch. One model,
    one table: name another path for another model. A null prompt is an empty one; without rows nothing is generated.
    Of two jobs on one table at a time both may ask for the same prompt; a reader takes one answer of each.
    """
    spark = df.sparkSession
    prompt = F.coalesce(F.col(prompt_col), F.lit(""))
    digest = "_digest"
    asked = df.select(F.sha2(prompt, 256).alias(digest), prompt.alias("_prompt"))
    # One row per prompt leaves each task, however often it is repeated.
    todo = asked.groupBy(digest).agg(F.first("_prompt").alias("_prompt"))
    schema = f"{digest} string, _answer string"

    def answers() -> DataFrame:
        kept = spark.read.schema(schema).parquet(answers_path) if tables.path_exists(spark, answers_path) else spark.createDataFrame([], schema)
        return kept.groupBy(digest).agg(F.min("_answer").alias("_answer"))

    todo = todo.join(answers().select(digest), digest, "left_anti")
    with staged(todo.withColumn("_part", F.pmod(F.xxhash64(digest), F.lit(parts)).cast("int")), "prompts") as waiting:
        for part in sorted(r["_part"] for r in waiting.select("_part").distinct().collect()):  # at most ``parts`` rows
            mine = waiting.where(F.col("_part") == part).repartition(digest).sortWithinPartitions(F.length("_prompt"), digest)
            answered = mine.select(digest, generated(F.col("_prompt"), factory, batch_size).alias("_answer"))
            answered.write.mode("append").parquet(answers_path)
    # A prompt in a third of all rows meets a broadcast or a salted copy of its answer.
    whole = lookup_join(df.withColumn(digest, F.sha2(prompt, 256)), answers(), digest, id_col)
    return whole.select(*[F.col(f"`{c}`") for c in df.columns if c != out], F.col("_answer").alias(out))


def tag_generation(df: DataFrame, strategy: str, raw_col: str = "generated_text") -> DataFrame:
    """Clean the raw text and name the strategy it came from."""
    return df.withColumns(
        {"generated_text": clean_generated_text(F.col(raw_col)), "prompt_strategy": F.lit(strategy)}
    )
