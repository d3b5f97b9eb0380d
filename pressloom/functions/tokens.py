"""Token arrays. Every function works inside one row, so none of them needs a shuffle."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressloom.functions import fixed_values as V
from pressloom.functions.lambdas import let


def word_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(V.WORD_TOKEN), F.lit(0))


def rouge_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(V.ROUGE_TOKEN), F.lit(0))


def remove_stop_words(tokens: Column, stop_words=V.ENGLISH_STOP_WORDS) -> Column:
    """Filter, not ``array_except``: repeated tokens must keep their count."""
    return F.filter(tokens, lambda t: ~t.isin(list(stop_words)))


def bigrams(tokens: Column) -> Column:
    def pair_up(t):
        n = F.greatest(F.size(t) - 1, F.lit(0))
        return F.zip_with(F.slice(t, F.lit(1), n), F.slice(t, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))

    return let(tokens, pair_up)


def uni_and_bigrams(tokens: Column) -> Column:
    return let(tokens, lambda t: F.concat(t, bigrams(t)))


def tfidf_terms(c: Column, stop_words=V.ENGLISH_STOP_WORDS) -> Column:
    return uni_and_bigrams(remove_stop_words(word_tokens(c), stop_words))


def term_counts(tokens: Column) -> Column:
    """``array<struct<term, tf>>`` sorted by term: run lengths of the sorted tokens, O(n log n) in the row."""

    def runs(s):
        positions = F.transform(s, lambda t, i: F.struct(t.alias("term"), i.alias("pos")))
        starts = F.filter(positions, lambda e: (e["pos"] == 0) | (F.get(s, e["pos"] - 1) != e["term"]))
        return let(
            starts,
            lambda st: F.transform(
                st,
                lambda e, k: F.struct(
                    e["term"].alias("term"),
                    (F.coalesce(F.get(st, k + 1)["pos"], F.size(s)) - e["pos"]).alias("tf"),
                ),
            ),
        )

    return let(F.sort_array(tokens), runs)
