"""Term counts of many rows at once."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

_COUNTS = "array<struct<term:string,tf:int>>"
#: Words that are counted at a time, in whole rows.
_WORDS = 200_000


def _count_slice(words: pa.Array, lengths: np.ndarray) -> tuple[np.ndarray, pa.StructArray]:
    """Terms per row and the entries of all rows, for the flat words of some rows."""
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    names, n = coded.dictionary.take(order), len(order) + 1
    rank = np.empty(len(order), dtype=np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    word, row = rank[coded.indices.to_numpy(zero_copy_only=False)], np.repeat(np.arange(len(lengths)), lengths)
    # A blank sorts before every character of a word, so terms stand in the order of (word, 0 or 1 + second word).
    inner = np.flatnonzero(row[1:] == row[:-1])
    single = (row * n + word) * n
    key, tf = np.unique(np.concatenate([single, single[inner] + word[inner + 1] + 1]), return_counts=True)
    key, second = np.divmod(key, n)
    row, first = np.divmod(key, n)
    endings = pa.concat_arrays([pa.array([""]), pc.binary_join_element_wise(pa.scalar(""), names, " ")])
    terms = pc.binary_join_element_wise(names.take(pa.array(first)), endings.take(pa.array(second)), "")
    entries = pa.StructArray.from_arrays([terms, pa.array(tf.astype(np.int32))], ["term", "tf"])
    return np.bincount(row, minlength=len(lengths)), entries


def count_uni_and_bigrams(words: pa.Array) -> pa.Array:
    """For a column of word lists: (term, tf) of the words and of neighbours joined by a blank, in the order of the terms."""
    lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    flat, ends = words.flatten().cast(pa.string()), np.concatenate([[0], np.cumsum(lengths)])
    counted, start = [], 0
    while start < len(lengths):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + _WORDS, side="right")) - 1)
        counted.append(_count_slice(flat.slice(ends[start], ends[stop] - ends[start]), lengths[start:stop]))
        start = stop
    sizes = np.concatenate([[0], *[n for n, _ in counted]])
    kind = pa.struct([("term", pa.string()), ("tf", pa.int32())])
    entries = pa.concat_arrays([e for _, e in counted]) if counted else pa.array([], kind)
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), entries)


def uni_and_bigram_counts(words: Column) -> Column:
    """``term_counts(uni_and_bigrams(words))`` of word tokens, by an Arrow function. Words hold no character up to the blank."""

    @F.arrow_udf(_COUNTS)
    def count(lists: pa.Array) -> pa.Array:
        return count_uni_and_bigrams(lists)

    return count.asNondeterministic()(words)
