"""English suffix stripping (Porter 1980, with the usual later extensions) as Spark expressions.

The algorithm is data: each step lists ``(suffix, substitutions)`` and the first suffix that fits a word
decides. A substitution is ``(pattern, tail)``: where the pattern matches, its first group plus ``tail``
replaces the word. ``stem_tokens`` turns one step into one ``transform`` over the token array, so a whole
text is stemmed inside its row: no join, no shuffle and no Python.

Two marker characters that no token contains steer the steps: ``=`` closes a word to all later steps and
``+`` asks for the repair step that follows the removal of -ed and -ing.
"""

from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values of the published algorithm --------------------------------------------------------
IRREGULAR = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
    "exceed": "exceed", "succeed": "succeed",
}
_FIRST_VOWEL = "(?:[^aeiou][^aeiouy]*[aeiouy]|[aeiou])"  # start of the word up to its first vowel
_M1 = _FIRST_VOWEL + "[aeiou]*[^aeiou]"  # measure of at least one
_M2 = _M1 + "[^aeiouy]*[aeiouy][aeiou]*[^aeiou]"  # measure of at least two
_SHORT = "[^aeiou][^aeiouy]*[aeiouy][^aeiouwxy]|[aeiou][^aeiou]"  # measure one, ending consonant-vowel-consonant
_UNMARK = ("^(.*)[+]$", "")


def _when(condition, suffix, tail):
    return suffix, (("^(" + condition + ".*)" + suffix + "$", tail),)


STEP_1A = (
    ("sses", (("^(.*)sses$", "ss"),)),
    ("ies", (("^(.)ies$", "ie"), ("^(|..+)ies$", "i"))),
    ("ss", ()),
    ("s", (("^(.*)s$", ""),)),
)
STEP_1B = (
    ("ied", (("^(.)ied$", "ie"), ("^(|..+)ied$", "i"))),
    _when(_M1, "eed", "ee"),
    _when(_FIRST_VOWEL, "ed", "+"),
    _when(_FIRST_VOWEL, "ing", "+"),
)
STEP_1B_REPAIR = (
    ("at+", (("^(.*)[+]$", "e"),)),
    ("bl+", (("^(.*)[+]$", "e"),)),
    ("iz+", (("^(.*)[+]$", "e"),)),
    ("ll+", (_UNMARK,)),
    ("ss+", (_UNMARK,)),
    ("zz+", (_UNMARK,)),
    ("yy+", (("^(.*[^aeiouy](?:yy)*y)y[+]$", ""), ("^((?:|.*[aeiou])(?:yy)*yy)y[+]$", ""), _UNMARK)),
    *[(c + c + "+", (("^(.*)" + c + "[+]$", ""),)) for c in "bcdfghjkmnpqrtvwx0123456789"],
    ("+", (("^(" + _SHORT + ")[+]$", "e"), _UNMARK)),
)
STEP_1C = (
    ("y", (
        ("^(.+[^aeiouy])y$", "i"),
        ("^(.*[aeiou]y(?:yy)*)y$", "i"),
        ("^(y(?:yy)+)y$", "i"),
        ("^(.*[^aeiouy](?:yy)+)y$", "i"),
    )),
)
STEP_2_ALLI = (_when(_M1, "alli", "al"),)
STEP_2 = (
    *[
        _when(_M1, suffix, tail)
        for suffix, tail in (
            ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
            ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
            ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
            ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
            ("fulli", "ful"),
        )
    ],
    ("logi", (("^(" + _M1 + ".*)ogi$", "og"),)),
)
STEP_3 = tuple(
    _when(_M1, suffix, tail)
    for suffix, tail in (
        ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""),
    )
)
STEP_4 = (
    *[_when(_M2, s, "") for s in ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent")],
    ("sion", (("^(" + _M2 + ".*)ion$", ""),)),
    ("tion", (("^(" + _M2 + ".*)ion$", ""),)),
    ("ion", ()),
    *[_when(_M2, s, "") for s in ("ou", "ism", "ate", "iti", "ous", "ive", "ize")],
)
STEP_5A = (("e", (("^(" + _SHORT + ")e$", "e+"), ("^(" + _M1 + ".*)e$", ""), _UNMARK)),)
STEP_5B = (("ll", (("^(" + _M2 + ".*)l$", ""),)),)

STEPS = (STEP_1A, STEP_1B, STEP_1B_REPAIR, STEP_1C, STEP_2_ALLI, STEP_2, STEP_3, STEP_4, STEP_5A, STEP_5B)


def _apply(step, word: Column) -> Column:
    result = None
    for suffix, substitutions in step:
        value = word
        for pattern, tail in substitutions:
            value = F.regexp_replace(value, pattern, "$1" + tail)
        fits = word.endswith(suffix)
        result = F.when(fits, value) if result is None else result.when(fits, value)
    return result.otherwise(word)


def stem_tokens(tokens: Column, min_chars: int = 4) -> Column:
    """Stem every token of at least ``min_chars`` characters (the ROUGE convention is four)."""
    closed = F.transform(
        tokens,
        lambda w: _irregular(w).when(F.length(w) < min_chars, F.concat(w, F.lit("="))).otherwise(w),
    )
    for step in STEPS:
        closed = F.transform(closed, partial(_apply, step))
    return F.transform(closed, lambda w: F.rtrim(w, F.lit("=")))


def _irregular(word: Column) -> Column:
    first, *others = IRREGULAR.items()
    result = F.when(word == first[0], first[1] + "=")
    for form, stem in others:
        result = result.when(word == form, stem + "=")
    return result
