"""Syncmer sketches against plain Python: the same hashes, windows looked at one by one."""

import random
import re
import struct

import xxhash
from pyspark.sql import functions as F

from pressloom.llm import syncmers


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def of_longs(*values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
    return signed(seed)


def plain_sketch(text):
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", text) if w]
    units = [""] * 4 + words + [""] * 4 if words else []
    h = [signed(xxhash.xxh64_intdigest(u.encode(), 42)) for u in units]
    found = []
    for i in range(len(h) - 4):
        inner = [of_longs(h[j], h[j + 1]) for j in range(i, i + 4)]
        if min(inner) in (inner[0], inner[3]):
            found.append(of_longs(inner[0], h[i + 2], inner[3]))
    if not found and text:
        found = [signed(xxhash.xxh64_intdigest(text.encode(), 42))]
    return sorted(set(found))[: syncmers.KEPT], found


def plain_likeness(a, b):
    union = sorted({*a, *b})[: syncmers.KEPT]
    return len([c for c in union if c in a and c in b]) / len(union) if union else 1.0


def test_sketch_and_likeness_equal_plain_python(spark):
    rng = random.Random(4)
    texts = ["", " \t", "one", "one two", "漢字", "a b c d e", "same same same same same same"]
    texts += [" ".join(rng.choices("ab cd é f gh".split(), k=rng.randint(1, 30))) for _ in range(60)]
    texts += [" \n".join(f"w{rng.randrange(400)}" for _ in range(300)) for _ in range(6)]
    rows = list(zip(range(len(texts)), texts, [*texts[1:], texts[0]]))
    df = spark.createDataFrame(rows, "i int, a string, b string").repartition(3)
    df = df.select("i", syncmers.sketch(F.col("a")).alias("a"), syncmers.sketch(F.col("b")).alias("b"))
    for r in df.select("i", "a", syncmers.likeness(F.col("a"), F.col("b")).alias("like")).collect():
        mine, other = plain_sketch(texts[r.i])[0], plain_sketch(rows[r.i][2])[0]
        assert list(r.a.codes) == mine
        assert abs(r.like - plain_likeness(mine, other)) < 1e-12


def test_lengths_around_ten_words_and_one_changed_word(spark):
    words = [f"w{i}" for i in range(1800)]
    pairs = [(0, " ".join(words[:9]), " ".join(words[:10]))]
    pairs += [(i, " ".join(words), " ".join([*words[: 44 * i], "other", *words[44 * i + 1 :]])) for i in range(1, 41)]
    df = spark.createDataFrame(pairs, "i int, a string, b string")
    df = df.select("i", syncmers.sketch(F.col("a")).alias("a"), syncmers.sketch(F.col("b")).alias("b"))
    like = syncmers.likeness(F.col("a"), F.col("b")).alias("like")
    rows = df.select("i", like, syncmers.as_text(F.col("a")).alias("a"), syncmers.as_text(F.col("b")).alias("b")).collect()
    assert all(r.a != r.b for r in rows)
    assert all(r.like > (0.4 if r.i == 0 else 0.8) for r in rows)
