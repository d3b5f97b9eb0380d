"""Quality classifier: averaged hashed word and character n-gram vectors with a softmax, trained by numpy SGD."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressloom.llm.common import Prefix, free_name, joined, runs, steps, table, text_of

#: Hash buckets of each kind of feature, and the lengths of the character n-grams (in bytes).
BUCKETS = 1 << 16
NGRAMS = (3, 4)
DIMENSION = 8
#: At most so many labelled rows are fitted, the first in the order of a hash of their ids.
MOST_ROWS = 2500
EPOCHS = 12
RATE = 0.5
#: Word bucket of the end of every text, so that an empty text has a feature too, and of a word that repeats the one before.
END, AGAIN = 0, 1


class Features:
    """Bucket numbers of all texts of a step, kind by kind: words, then n-grams of each length.

    Each kind lists ``(buckets, begins, counts)``: the flat buckets and, for each text, where its own begin and how
    many they are. Words are runs of bytes above the space; n-grams are windows of bytes, blanks included, so they
    see word ends. A word equal to the one before it counts as AGAIN.
    """

    def __init__(self, texts: list[str]):
        data, starts = joined(texts)
        ends = starts[1:] - 1
        first, last = starts[:-1], ends
        self.kinds = [self._words(data, first, last)]
        for k, n in enumerate(NGRAMS):
            self.kinds.append(self._ngrams(data, first, last, n, (k + 1) * BUCKETS))

    @staticmethod
    def _words(data, first, last):
        begin, end = runs(data > 32)
        # A text that holds a NUL byte is cut there as well; the separators are NUL bytes.
        code = Prefix(data).of(begin, end)
        bucket = (code >> np.uint64(48)).astype(np.int64)
        owner = np.searchsorted(first, begin, "right") - 1
        again = np.zeros(len(begin), bool)
        again[1:] = (code[1:] == code[:-1]) & (owner[1:] == owner[:-1])
        bucket[again] = AGAIN
        count = np.bincount(owner, minlength=len(first)) + 1
        where = np.cumsum(count) - count
        flat = np.full(int(count.sum()), END, np.int64)
        flat[np.arange(len(begin)) + owner] = bucket  # the end of each text stays at its last place
        return flat, where, count

    @staticmethod
    def _ngrams(data, first, last, n, base):
        if len(data) < n:
            zero = np.zeros(len(first), np.int64)
            return np.zeros(0, np.int64), zero, zero
        code = np.zeros(len(data) - n + 1, np.uint32)
        for i in range(n):
            code = code * np.uint32(0x01000193) + data[i : len(data) - n + 1 + i]
        code ^= code >> np.uint32(15)
        code *= np.uint32(0x9E3779B1)
        bucket = (code >> np.uint32(16)).astype(np.int32) + base
        return bucket, first, np.maximum(last - first - n + 1, 0)

    def sums(self, value: np.ndarray) -> np.ndarray:
        """For each text the mean of ``value`` over its features, added over the kinds."""
        total = 0.0
        for flat, begin, count in self.kinds:
            running = np.zeros(len(flat) + 1)
            np.cumsum(value[flat], dtype=np.float64, out=running[1:])
            some = count > 0
            b = np.where(some, begin, 0)
            total = total + np.where(some, running[b + np.where(some, count, 0)] - running[b], 0.0) / np.maximum(count, 1)
        return total

    def sparse(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of text ``i`` and their weights in its average."""
        buckets, weights = [], []
        for flat, begin, count in self.kinds:
            own, n = np.unique(flat[begin[i] : begin[i] + count[i]], return_counts=True)
            buckets.append(own.astype(np.int32))
            weights.append((n / max(count[i], 1)).astype(np.float32))
        return np.concatenate(buckets), np.concatenate(weights)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learned from; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 7) -> np.ndarray:
    """Plain SGD over (label, buckets, weights); returns for every bucket what it adds to the log odds of label 1.

    The score is linear in the averaged vectors, so each vector counts by its product with the output weights only.
    """
    rng = np.random.default_rng(seed)
    vectors = (rng.random((BUCKETS * (1 + len(NGRAMS)), DIMENSION), np.float32) - 0.5) / DIMENSION
    out = np.zeros((DIMENSION, 2), np.float32)
    steps_left = total = max(1, EPOCHS * len(rows))
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            label, buckets, weights = rows[i]
            rate = RATE * steps_left / total
            steps_left -= 1
            own = vectors[buckets]
            hidden = weights @ own
            logits = hidden @ out
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1
            back = out @ p
            out -= rate * np.outer(hidden, p)
            vectors[buckets] = own - rate * weights[:, None] * back
    return vectors @ (out[:, 1] - out[:, 0])


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    most_rows: int = MOST_ROWS,
) -> np.ndarray:
    """Learn from at most ``most_rows`` labelled rows outside the held-out third, whole texts.

    Labels with a null id or value are left out; a repeated id takes its greatest label and its smallest text.
    Without labels the model is all zeros and every score 0.5.
    """
    known = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"))
    # Only labels of documents that are there count towards the bound; this join moves ids alone.
    known = known.join(texts.select("doc_id"), "doc_id", "left_semi")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    sample = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def features(batches):
        for batch in batches:
            for part in steps(batch):
                found = Features(part.column("text").to_pylist())
                rows = [found.sparse(i) for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("label"),
                        pa.array([b.tobytes() for b, _ in rows], pa.binary()), pa.array([w.tobytes() for _, w in rows], pa.binary()),
                    ],
                    names=["doc_id", "label", "buckets", "weights"],
                )

    got = sample.mapInArrow(features, "doc_id long, label int, buckets binary, weights binary").toArrow().sort_by("doc_id")
    rows = [
        (label, np.frombuffer(b, np.int32), np.frombuffer(w, np.float32))
        for label, b, w in zip(*(got.column(c).to_pylist() for c in ("label", "buckets", "weights")))
    ]
    return train(rows) if rows else np.zeros(BUCKETS * (1 + len(NGRAMS)), np.float32)


def score(docs: DataFrame, model: np.ndarray, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score of the whole text, 0 to 1. Null text counts as empty; a text's score does not
    depend on the rows beside it. Where ``docs`` has a column of that name, the score's gets underscores in front."""
    score_col = free_name(docs, score_col)
    weights = np.asarray(model, np.float32)
    text = free_name(docs, "scored_text")
    source = docs.withColumn(text, text_of(text_col))
    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])

    def scored(batches):
        for batch in batches:
            for part in steps(batch, text):
                value = 1 / (1 + np.exp(-Features(part.column(text).to_pylist()).sums(weights)))
                columns = part.drop_columns([text]).columns
                yield pa.RecordBatch.from_arrays([*columns, pa.array(value)], names=schema.names)

    return source.mapInArrow(scored, schema)


def op5_quality(spark, sf_dir):
    """All ``documents``; labels outside the held-out third."""
    docs, labels = table(spark, sf_dir), table(spark, sf_dir, "labels")
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )
