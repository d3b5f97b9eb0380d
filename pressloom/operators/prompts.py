"""Prompt columns and the prompt / target dataset."""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressloom.functions import fixed_values as V


def render(template: str, values: dict[str, Column]) -> Column:
    """A ``{name}`` template as one concat expression; a missing value is its default or ''."""
    parts = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2:
            filled = values.get(piece, F.lit(None)).cast("string")
            parts.append(F.coalesce(filled, F.lit(V.PROMPT_DEFAULTS.get(piece, ""))))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def _values(df: DataFrame, **renamed: str) -> dict[str, Column]:
    names = {n: n for n in ("headline", "description", "keywords", "topic_label", "sentiment", "covid_status")}
    names.update(renamed)
    return {n: F.col(c) for n, c in names.items() if c in df.columns}


def build_prompt_context(df: DataFrame, out: str = "prompt") -> DataFrame:
    return df.withColumn(out, render(V.CONTEXT_TEMPLATE, _values(df)))


def build_prompt_dataset(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, prompt, target and the carried metadata columns; the id is the stable key of the article."""
    target = F.coalesce(F.col("description"), F.lit("")) if "description" in df.columns else F.lit("")
    carried = [c for c in V.PROMPT_COLUMNS if c in df.columns]
    extra = ["split"] if "split" in df.columns else []
    return build_prompt_context(df).select(F.col(id_col).alias("id"), "prompt", target.alias("target"), *carried, *extra)


def strategy_prompt(df: DataFrame, strategy: str) -> Column:
    """Prompt text of a named strategy; an unknown name means the metadata-aware one."""
    template = V.STRATEGY_TEMPLATES.get(strategy, V.STRATEGY_TEMPLATES[V.DEFAULT_STRATEGY])
    return render(template, _values(df, description="target"))


def build_prompt(df: DataFrame, strategy: str = V.DEFAULT_STRATEGY, out: str = "prompt_text") -> DataFrame:
    return df.withColumn(out, strategy_prompt(df, strategy))


def build_prompt_by_column(df: DataFrame, strategy_col: str = "prompt_strategy", out: str = "prompt_text") -> DataFrame:
    """Each row under the strategy that its own column names."""
    prompt = F.lit(None)
    for name in V.STRATEGY_TEMPLATES:
        prompt = F.when(F.col(strategy_col) == name, strategy_prompt(df, name)).otherwise(prompt)
    return df.withColumn(out, F.coalesce(prompt, strategy_prompt(df, V.DEFAULT_STRATEGY)))


def run_strategies(df: DataFrame, strategies=tuple(V.STRATEGY_TEMPLATES), out: str = "prompt_text") -> DataFrame:
    """Every row once per strategy, by exploding the strategy names inside the row."""
    return build_prompt_by_column(
        df.withColumn("prompt_strategy", F.explode(F.array(*[F.lit(s) for s in strategies]))), out=out
    )
