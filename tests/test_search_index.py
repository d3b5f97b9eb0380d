"""The search index against brute force, what it reads, and its odd cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressloom.operators import search_index
from pressloom.session import new_path

FEATURES = "features array<struct<term_id:int,weight:double>>"


def side(spark, rng, n, name, terms=40, most=6):
    """Rows whose terms come in families, so that blocks differ."""
    rows = []
    for i in range(n):
        family = 10 * (i % 4)
        some = {int(family + t) for t in rng.choice(10, size=rng.integers(0, most), replace=False)}
        rows.append((f"{name}{i:04d}", [(t, round(float(w), 2) + 0.01) for t, w in zip(sorted(some), rng.random(len(some)))]))
    return rows


def brute(asked, docs, k):
    out = set()
    for name, row in asked:
        mine = dict(row)
        scores = [(-round(sum(mine.get(t, 0.0) * w for t, w in r), 6), i) for i, r in docs if mine.keys() & dict(r).keys()]
        out |= {(name, i, rank, round(-s, 5)) for rank, (s, i) in enumerate(sorted(scores)[:k], start=1)}
    return out


@pytest.fixture(scope="module")
def sides(spark):
    rng = np.random.default_rng(9)
    docs = side(spark, rng, 900, "d")
    docs += [(f"x{i:03d}", [(7, 0.5), (11, 0.5)]) for i in range(300)]  # one text in a quarter of all rows: ties everywhere
    asked = side(spark, rng, 25, "q") + [("hot", [(7, 1.0), (11, 1.0)]), ("none", [(99, 1.0)]), ("empty", [])]
    d = spark.createDataFrame(docs, f"doc_id string, {FEATURES}").withColumn("block", F.lit("a column of the input"))
    return asked, docs, spark.createDataFrame(asked, f"query_id string, {FEATURES}"), d


@pytest.mark.parametrize("partitions, block", [(1, 16), (5, 64), (3, 1)])
def test_search_equals_brute_force(spark, sides, partitions, block):
    asked, docs, q, d = sides
    index = search_index.build_index(d.repartition(partitions), new_path(spark, "index"), block=block)
    found = search_index.search(q, index, k=6).collect()
    assert {(r["query_id"], r["doc_id"], r["rank"], round(r["score"], 5)) for r in found} == brute(asked, docs, 6)


def test_blocks_are_skipped_and_documents_not_read_again(spark, sides):
    asked, _, q, d = sides
    path = new_path(spark, "index")
    index = search_index.build_index(d.coalesce(1), path, block=16)
    long = q.select(F.col("query_id").alias("query"), F.inline("features")).withColumnRenamed("weight", "asked")
    first, further, _ = search_index.visits_of(long, index, k=3)
    bounds = search_index.block_bounds(long, index)
    read = first.unionByName(further)
    assert first.count() <= 2 * len(asked) and read.count() < bounds.count()
    worst = search_index.search(q, index, k=3).where("rank = 3").select(F.col("query_id").alias("query"), "score")
    skipped = bounds.join(read, ["query", "block"], "left_anti")
    assert skipped.join(worst, "query").where("bound >= score").isEmpty() and skipped.join(worst, "query", "left_anti").isEmpty()
    again = search_index.load_index(spark, path)  # a second set of queries has the index only
    assert all(path in f for f in again.inputFiles())
    one = search_index.search(q.where("query_id = 'hot'"), again, k=2).orderBy("rank").collect()
    assert [r["rank"] for r in one] == [1, 2] and one[0]["score"] >= one[1]["score"]


def test_a_block_holds_no_more_than_its_size_and_top_is_its_greatest_weight(spark, sides):
    *_, d = sides
    index = search_index.build_index(d, new_path(spark, "index"), block=32)
    assert index.where("size(docs) > 32").isEmpty()
    assert index.where("top <> array_max(transform(docs, x -> x.weight))").isEmpty()
    with pytest.raises(ValueError):
        search_index.build_index(d, new_path(spark, "index"), block=48)


def test_empty_tables_and_repeated_rows(spark, sides):
    _, docs, q, d = sides
    nothing = search_index.build_index(d.limit(0), new_path(spark, "index"))
    assert search_index.search(q, nothing).isEmpty()
    index = search_index.build_index(d, new_path(spark, "index"), block=64)
    assert search_index.search(q.limit(0), index).isEmpty()
    twice = search_index.build_index(spark.createDataFrame([("a", [(1, 0.5)])] * 2, f"doc_id string, {FEATURES}"), new_path(spark, "index"))
    asked = spark.createDataFrame([(1, [(1, 1.0)])], f"query_id int, {FEATURES}")
    assert [(r["doc_id"], r["score"]) for r in search_index.search(asked, twice).collect()] == [("a", 0.5)] * 2
