from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from pressloom.functions import fixed_values as V
from pressloom.functions import text as X
from pressloom.functions import tokens as K
from pressloom.functions.stemming import stem_tokens
from pressloom.operators import clean
from pressloom.sources import tables


def apply(spark, expression, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("x"))).collect()]


def test_unicode_is_composed_before_ascii_is_kept(spark):
    given = ["caf\u00e9", "cafe\u0301", "\u212aelvin", "a\u037eb", "\u1fef", "<\u0338", "plain", None, ""]
    assert apply(spark, X.normalize_unicode, given) == ["caf", "caf", "Kelvin", "a;b", "`", "", "plain", None, ""]


def test_entities_without_a_plain_number_or_name_stay(spark):
    given = ["a&amp;b", "a&#39;b", "a&AMP;b", "a&#x27;b", "a&frac12;b", "&;"]
    assert apply(spark, X.remove_html_entities, given) == ["a b", "a b", "a b", "a&#x27;b", "a&frac12;b", "&;"]


def test_html_and_whitespace(spark):
    given = ["<p>a</p><br/>b", "\u2003a\u00a0\x1cb\x0bc\u3000\x85 ", "1 < 2 > 0", "<>", None]
    assert apply(spark, X.strip_html, given) == ["a b", "a b c", "1 0", "<>", None]


def test_special_chars(spark):
    assert apply(spark, X.remove_special_chars, ["a_b-c'd.e,f!g?h", "a@b#c\x1cd"]) == ["a_b-c'd.e,f!g?h", "a b c\x1cd"]


def test_blank(spark):
    assert apply(spark, X.is_blank, [None, "", "  \t\n", " a"]) == [True, True, True, False]


def test_generated_text(spark):
    given = [
        "Sure! Here you go\n\nPost: The news",
        "here is your post",  # the whole first line goes
        "  Summary :  x\n y ",
        "Post office opens",
        "Of course, yes\nGenerated post: z",
        "w" * 300,
        None,
    ]
    assert apply(spark, X.clean_generated_text, given) == ["The news", "", "x y", "Post office opens", "z", "w" * 280, None]


def test_dates_in_several_formats(spark):
    given = ["2020-03-01", "01/03/2020", "2020-03-01 10:00:00", "2020-02-30", "not a date", "", None]
    got = apply(spark, X.parse_timestamp, given)
    assert [str(g) if g else None for g in got] == [
        "2020-03-01 00:00:00", "2020-03-01 00:00:00", "2020-03-01 10:00:00", None, None, None, None,
    ]


def test_bad_dates_are_counted(spark):
    df = spark.createDataFrame([("2020-03-01",), ("x",), (None,)], "date string")
    assert tuple(clean.count_bad_dates(df).first()) == (1, 1)
    assert clean.parse_dates(df.drop("date").withColumn("y", F.lit(1))).columns == ["y"]


def test_column_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["  Covid  Status ", "Image-URL", "a.b"])
    assert clean.normalize_column_names(df).columns == ["covid_status", "image_url", "a_b"]


def test_stop_words_are_sparks_own():
    defaults = {w for w in StopWordsRemover.loadDefaultStopWords("english") if "'" not in w and len(w) > 1}
    assert set(V.ENGLISH_STOP_WORDS) == defaults


def test_terms_and_counts(spark):
    df = spark.createDataFrame([("The caté a caté sat_1 caté",), (None,), ("x",)], "x string")
    got = [
        [(t["term"], t["tf"]) for t in r[0]] for r in df.select(K.term_counts(K.tfidf_terms(F.col("x")))).collect()
    ]
    assert got == [
        [("caté", 3), ("caté caté", 1), ("caté sat_1", 1), ("sat_1", 1), ("sat_1 caté", 1)], [], [],
    ]


def test_stems(spark):
    pairs = {
        "caresses": "caress", "ponies": "poni", "ties": "tie", "agreed": "agre", "plastered": "plaster", "motoring": "motor",
        "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall", "hissing": "hiss", "filing": "file",
        "happy": "happi", "enjoy": "enjoy", "flying": "fli", "relational": "relat", "rational": "ration",
        "radically": "radic", "vietnamization": "vietnam", "geology": "geolog", "hopefulness": "hope",
        "electricity": "electr", "adjustment": "adjust", "adoption": "adopt", "division": "divis", "bowdlerize": "bowdler",
        "probate": "probat", "cease": "ceas", "controlling": "control", "rolling": "roll", "dying": "die", "skies": "sky",
        "spied": "spi", "died": "die", "news": "news", "was": "was", "2020s": "2020", "yyyed": "yyi", "owed": "owe",
    }
    df = spark.createDataFrame([(list(pairs),)], "t array<string>")
    got = dict(zip(pairs, df.select(stem_tokens(F.col("t"))).first()[0]))
    assert {w: s for w, s in got.items() if w != "yyyed"} == {w: s for w, s in pairs.items() if w != "yyyed"}


def test_csv_round_trip_with_na_marks(spark, tmp_path):
    rows = [(c,) * 7 for c in ['a "quoted"\nline', "NA", "nan", "", " NA ", "x,y", "None", "back\\slash"]] + [(None,) * 7]
    df = spark.createDataFrame(rows, tables.ARTICLE_SCHEMA)
    tables.write_csv(df.coalesce(1), str(tmp_path / "csv"))
    got = sorted((r["Headline"] or "~null") for r in tables.read_articles(spark, str(tmp_path / "csv")).collect())
    assert got == sorted(['a "quoted"\nline', "~null", "~null", "~null", " NA ", "x,y", "~null", "back\\slash", "~null"])
    by_header = tables.read_articles(spark, str(tmp_path / "csv"), schema=None)
    assert by_header.columns == V.SOURCE_COLUMNS
    ids = [r["doc_id"] for r in tables.with_row_ids(by_header).collect()]
    assert ids == list(range(9))  # one file: the ids are the row positions


def test_dates_in_common_forms(spark):
    from pressloom.functions.text import parse_timestamp

    texts = {
        "2020-03-15": "2020-03-15 00:00:00", "2020-03-15 10:00": "2020-03-15 10:00:00", "2020-03-15 10:00:00.123": "2020-03-15 10:00:00.123",
        "2020-03-15T10:00:00Z": "2020-03-15 10:00:00", "2020-03-15T10:00:00+02:00": "2020-03-15 08:00:00", "2020/03/15": "2020-03-15 00:00:00",
        "15-Mar-2020": "2020-03-15 00:00:00", "Mar 15, 2020": "2020-03-15 00:00:00", "March 15, 2020": "2020-03-15 00:00:00",
        "03/25/2020": "2020-03-25 00:00:00", "5/3/2020": "2020-05-03 00:00:00", "25/03/2020": "2020-03-25 00:00:00", "soon": None,
    }
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", parse_timestamp(F.col("t")).cast("string").alias("d"))
    assert {r.t: r.d for r in rows.collect()} == texts


def test_spelt_out_class_of_special_characters_is_the_same(spark):
    """The class that runs has no range of characters, so that it is one table lookup."""
    texts = spark.range(0, 0x3100).select(F.concat(F.lit("a"), F.chr(F.col("id")), F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE")).alias("t"))
    old, new = F.regexp_replace("t", V.SPECIAL_CHAR, " "), X.remove_special_chars(F.col("t"))
    assert texts.where(~old.eqNullSafe(new)).count() == 0
    assert not any(f"{a}-{b}" in V.SPECIAL_CHAR_SPELT for a, b in ("09", "AZ", "az", "tr"))
