"""Cleaning expressions over single text columns. Null stays null."""

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressloom.functions import fixed_values as V


def collapse_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, V.WHITESPACE + "+", " "))


def is_blank(c: Column) -> Column:
    """Null or without any visible character; the search stops at the first one."""
    return c.isNull() | ~c.rlike(V.NOT_WHITESPACE)


def strip_html(c: Column) -> Column:
    return collapse_whitespace(F.regexp_replace(c, V.HTML_TAG, " "))


def remove_html_entities(c: Column) -> Column:
    return F.regexp_replace(c, "(?iu)" + V.HTML_ENTITY, " ")


@F.pandas_udf(T.StringType())
def _to_ascii(texts: pd.Series) -> pd.Series:
    def to_ascii(text):
        if text is None or text.isascii():
            return text
        return unicodedata.normalize("NFC", text).encode("ascii", "ignore").decode("ascii")

    return texts.map(to_ascii)


def normalize_unicode(c: Column) -> Column:
    """Compose to NFC, then delete what is not ASCII: a precomposed é vanishes, it does not become e. ASCII texts stay
    in the JVM; only the others travel to Python."""
    return F.coalesce(_to_ascii(F.when(c.rlike(V.NON_ASCII), c)), c)


def remove_special_chars(c: Column) -> Column:
    return F.regexp_replace(c, V.SPECIAL_CHAR_SPELT, " ")


def preprocess_text(c: Column) -> Column:
    return collapse_whitespace(remove_special_chars(normalize_unicode(remove_html_entities(c))))


def near_duplicate_key(c: Column) -> Column:
    return collapse_whitespace(F.lower(c))


def parse_timestamp(c: Column, formats=V.DATE_FORMATS) -> Column:
    """First format that fits wins; text that fits none becomes null (``to_timestamp`` would raise)."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def _date_part(c: Column, group: int) -> Column:
    return F.regexp_extract(c, V.NUMERIC_DATE, group)


def day_first_evidence(c: Column) -> Column:
    """1 where a numeric date can only be read day first, -1 where only month first, else 0 or (for other text) null."""
    first, second = (_date_part(c, g).try_cast("int") for g in (1, 3))
    return F.when((first > 12) & (second <= 12), 1).when((second > 12) & (first <= 12), -1).when(first.isNotNull(), 0)


def parse_timestamp_as(c: Column, day_first: Column) -> Column:
    """One convention for all numeric dates; one that can only be read the other way is read that way.

    Two-digit years are of this century. ISO, compact (20200315), spelt-out months and mail dates need no convention.
    """
    first, second = (_date_part(c, g).try_cast("int") for g in (1, 3))
    year = F.when(F.length(_date_part(c, 4)) == 2, F.concat(F.lit("20"), _date_part(c, 4))).otherwise(_date_part(c, 4))
    day_comes_first = F.when(first > 12, True).when(second > 12, False).otherwise(day_first)
    month, day = F.when(day_comes_first, second).otherwise(first), F.when(day_comes_first, first).otherwise(second)
    plain = F.concat(year, F.lit("-"), month, F.lit("-"), day, _date_part(c, 5))
    mail = F.regexp_replace(F.regexp_replace(c, V.WEEKDAY, ""), V.ZONE_NAME, " +0000")
    text = F.trim(F.when(first.isNotNull(), plain).otherwise(mail))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in V.PLAIN_FORMATS])


def clean_generated_text(c: Column, max_chars: int = V.MAX_POST_CHARS) -> Column:
    ws = V.WHITESPACE + "*"
    c = F.regexp_replace(c, f"(?iu)^{ws}{V.CHATTER_LINE}", "")
    c = F.regexp_replace(c, f"(?iu)^{ws}{V.POST_LABEL}{ws}:{ws}", "")
    return F.substring(collapse_whitespace(c), 1, max_chars)
