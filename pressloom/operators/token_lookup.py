"""Vectors of the tokens of a row, from a token table of any size.

The most frequent tokens travel as one dictionary to every task; a rare token's vector is shuffled to the rows that hold it.
"""

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressloom.functions.lambdas import inline_once


def rare_type(vectors: DataFrame) -> str:
    return f"array<struct<side:int,token:string,tf:int,vector:{vectors.schema['vector'].dataType.simpleString()}>>"


def rare_vectors(df: DataFrame, sides: tuple[str, ...], vectors: DataFrame, frequent: DataFrame, key: str) -> DataFrame:
    """(``key``, ``_rare``): the vectors of a row's tokens outside ``frequent``, with the number of their side.

    ``sides`` are columns of term counts. Rows of equal ``key`` must have equal terms and count as one.
    """
    terms = F.array(*[F.struct(F.lit(i).alias("side"), F.col(c).alias("terms")) for i, c in enumerate(sides)])
    long = inline_once(inline_once(df, [key], terms, "side"), [key, "side"], F.col("terms"), "term").withColumnRenamed("term", "token")
    found = long.join(F.broadcast(frequent), "token", "left_anti").distinct().join(vectors, "token")
    entry = F.struct("side", "token", "tf", "vector")
    return found.groupBy(key).agg(F.sort_array(F.collect_list(entry)).alias("_rare"))


def token_arrays(vectors: DataFrame) -> tuple[pa.Array, np.ndarray]:
    """Tokens and the matrix of their vectors, of a table small enough for every task. A token without a vector is left out."""
    table = vectors.where(F.col("vector").isNotNull()).select("token", "vector").orderBy("token").toArrow()
    flat = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return table.column("token").combine_chunks(), flat.reshape(table.num_rows, -1) if table.num_rows else np.zeros((0, 1))


def term_arrays(counts: str) -> list[Column]:
    """The terms and the counts of a column of term counts, as ``known_terms`` reads them."""
    return [F.transform(counts, lambda e: e["term"]), F.transform(counts, lambda e: e["tf"])]


def _ends(lists: pa.Array) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])


def known_terms(tokens: pa.Array, terms: pa.Array, counts: pa.Array) -> Callable[[int], tuple[np.ndarray, np.ndarray]]:
    """For columns of terms and of their counts: the places in ``tokens`` of those that a row has, and their counts."""
    ends, token, tf = _ends(terms), terms.flatten(), counts.flatten().to_numpy(zero_copy_only=False)
    at = pc.fill_null(pc.index_in(token, value_set=tokens.cast(token.type)), -1).to_numpy(zero_copy_only=False)

    def of_row(i: int):
        mine = at[ends[i] : ends[i + 1]]
        hit = mine >= 0
        return mine[hit], tf[ends[i] : ends[i + 1]][hit].astype("float64")

    return of_row


def rare_rows(rare: pa.Array) -> Callable[[int, int], tuple[np.ndarray, np.ndarray]]:
    """For a column of ``rare_vectors``: the matrix of a row's rare vectors on one side, and their counts."""
    ends, flat = _ends(rare), rare.flatten()
    side, tf = flat.field("side").to_numpy(zero_copy_only=False), flat.field("tf").to_numpy(zero_copy_only=False)
    lists = flat.field("vector")
    kept = pc.is_valid(lists).to_numpy(zero_copy_only=False)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    width = len(values) // max(1, int(kept.sum()))
    place = np.cumsum(kept) - 1
    matrix = values.reshape(-1, max(1, width))

    def of_row(i: int, nr: int):
        mine = np.arange(ends[i], ends[i + 1])
        mine = mine[kept[mine] & (side[mine] == nr)]
        return matrix[place[mine]], tf[mine].astype("float64")

    return of_row
