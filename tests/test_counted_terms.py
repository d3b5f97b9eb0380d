"""Term counts by batches equal those inside the row; features of indexed documents are made once."""

import pyarrow as pa
from pyspark.sql import functions as F

from pressloom.functions import counted
from pressloom.functions import tokens as K
from pressloom.operators import search_index

TEXTS = [
    "ab ab a_b abc ab", "", None, "ab a ab", "été abc 99 été abc", "the of", "zz", "ab_ ab 0ab ab_ ab 中文 中文字 \U00020000\U00020001 ａｂ",
]


def test_batches_count_what_rows_count(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(TEXTS * 3)), "id long, text string").repartition(2)
    words = K.remove_stop_words(K.word_tokens(F.col("text")))
    both = df.select("id", K.term_counts(K.tfidf_terms(F.col("text"))).alias("row"), counted.uni_and_bigram_counts(words).alias("batch"))
    rows = both.collect()
    assert len(rows) == 3 * len(TEXTS) and any(len(r["row"]) > 5 for r in rows)
    assert all(r["row"] == r["batch"] for r in rows)
    lists = pa.array([["b", "a", "b", "a"], None, [], ["a"], ["c", "c", "c"]])
    whole = counted.count_uni_and_bigrams(lists).to_pylist()
    assert [[(e["term"], e["tf"]) for e in r] for r in whole] == [[("a", 2), ("a b", 1), ("b", 2), ("b a", 2)], [], [], [("a", 1)], [("c", 3), ("c c", 2)]]
    monkeypatch.setattr(counted, "_WORDS", 3)  # slices of a row or two
    assert counted.count_uni_and_bigrams(lists).to_pylist() == whole
    assert counted.count_uni_and_bigrams(lists.slice(0, 0)).to_pylist() == []


def test_features_of_indexed_documents_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<struct<term_id:int,term:string,tf:int,weight:double>>")
    def features(n):
        made.add(1)
        return None if n == 3 else [(t, str(t), 1, 0.5) for t in range(n % 4)]

    documents = spark.range(8).select(F.col("id").alias("doc_id"), features("id").alias("features"))
    index = search_index.build_index(documents, f"{tmp_path}/index", block=2)
    assert made.value == 8
    found = index.select("term_id", F.inline("docs")).collect()
    assert sorted((r["doc_id"], r["term_id"]) for r in found) == [(i, t) for i in range(8) if i != 3 for t in range(i % 4)]
