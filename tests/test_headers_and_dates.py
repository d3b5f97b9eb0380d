"""Files with different headers, malformed rows, and the date convention of a column."""

import pytest
from pyspark.sql import functions as F

from pressloom.operators import clean
from pressloom.plans import jobs
from pressloom.sources import tables


def _write(folder, **files):
    folder.mkdir()
    for name, text in files.items():
        (folder / f"{name}.csv").write_text(text, encoding="utf-8")
    return str(folder)


def test_each_file_is_read_by_its_own_header(spark, tmp_path):
    path = _write(
        tmp_path / "in 1", a="Date,Headline,Description,Source\n2020-01-01,H1,D1,S1\n", b="Headline,Date,Source,Description\nH2,2020-01-02,S2,D2\n",
        c='﻿ headline ,Extra,DATE\r\n"H, 3",x,2020-01-03\r\n', d="Date,Headline,Description,Source\n2020-01-04,H4,\"D\n4\",NA\n", e="",
    )
    rows = tables.read_articles(spark, path)
    assert rows.columns == [*tables.ARTICLE_SCHEMA.names, "Extra"]
    got = {r.Headline: (r.Date, r.Description, r.Source, r.Extra) for r in rows.collect()}
    assert got == {
        "H1": ("2020-01-01", "D1", "S1", None), "H2": ("2020-01-02", "D2", "S2", None),
        "H, 3": ("2020-01-03", None, None, "x"), "H4": ("2020-01-04", "D\n4", None, None),
    }


def test_malformed_rows_are_told(spark, tmp_path):
    path = _write(tmp_path / "in", a="Headline,Description\nH1,D1\nH2,D2,surplus\nH3\n", b="Description,Headline,Headline\nD4,H4,again\n")
    rows = tables.read_articles(spark, path, malformed="bad")
    assert {(r.Headline, r.Description, r.bad) for r in rows.collect()} == {
        ("H1", "D1", None), ("H2", "D2", "H2,D2,surplus"), ("H3", None, "H3"), ("H4", "D4", None),
    }
    jobs.ingest_and_clean(spark, path, str(tmp_path / "out"), profile_path=str(tmp_path / "profile"))
    steps = {r.step: r.n for r in spark.read.parquet(str(tmp_path / "profile/steps")).collect()}
    assert steps["loaded"] == 4 and steps["with_text"] == 3
    assert spark.read.parquet(str(tmp_path / "profile/malformed")).first().n == 2


def test_no_rows_without_headers(spark, tmp_path):
    assert tables.read_articles(spark, _write(tmp_path / "in", a="")).columns == tables.ARTICLE_SCHEMA.names
    assert tables.read_articles(spark, _write(tmp_path / "in2", a="Headline\n")).count() == 0


SAME_DAY = {"15.03.2020": 15, "20200315": 15, "Sun, 15 Mar 2020 10:00:00 GMT": 15, "2020-03-15T00:00:00Z": 15, "15/03/20": 15, "March 15, 2020": 15}


@pytest.mark.parametrize(
    "texts, want",
    [
        (["5/3/2020", "05/03/2020", "25/12/2020", "03/05/20"], ["2020-03-05", "2020-03-05", "2020-12-25", "2020-05-03"]),
        (["5/3/2020", "05/03/2020", "12/25/2020", "03/05/20"], ["2020-05-03", "2020-05-03", "2020-12-25", "2020-03-05"]),
        (["5/3/2020", "13/1/2020", "1/13/2020", "1/14/2020"], ["2020-05-03", "2020-01-13", "2020-01-13", "2020-01-14"]),
        (["5/3/2020", None, "31/02/2020", "5/3-2020", "99/99/2020", "soon", ""], ["2020-03-05", None, None, None, None, None, None]),
        (list(SAME_DAY), ["2020-03-15"] * len(SAME_DAY)),
    ],
)
def test_one_convention_for_a_column(spark, texts, want):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, date string")
    got = {r.i: r.date for r in clean.parse_dates(df).select("i", F.date_format("date", "yyyy-MM-dd").alias("date")).collect()}
    assert [got[i] for i in range(len(texts))] == want
    bad = clean.count_bad_dates(df).first()
    assert bad.bad_dates == sum(t is not None and w is None for t, w in zip(texts, want)) and bad.missing_dates == texts.count(None)


def test_times_of_day(spark):
    given = {"5/3/2020 10:20": "2020-05-03 10:20:00", "15-03-2020 10:20:30": "2020-03-15 10:20:30", "Sun, 15 Mar 2020 10:00:00 +0200": "2020-03-15 08:00:00"}
    df = spark.createDataFrame([(t, t) for t in given], "t string, date string")
    day = clean.parse_dates(df.where("t LIKE '5/%'")).unionByName(clean.parse_dates(df.where("t NOT LIKE '5/%'")))
    assert {r.t: r.date for r in day.select("t", F.col("date").cast("string")).collect()} == given
