"""Phrase collocations, counted over the dictionary of a prefix-free parse."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressloom.llm.common import Prefix, runs, steps, table, text_of
from pressloom.session import write_and_read

#: A word whose hash is a multiple of this begins a chunk.
TRIGGER = 16
#: Words in the longest phrase, least count of a phrase, phrases returned per language.
LONGEST, LEAST, TOP = 3, 10, 2000
#: A longer candidate hides a phrase that it makes up this share of, in hundredths.
HIDES = 50
#: Bytes of text in one step of a task.
STEP = 4_000_000
#: Bits (a power of two) of the table that tells which phrases may be frequent: 4 MB.
BITS = 25
#: Parts of the hashes by which packed phrases are shuffled: no more tasks than this can share the work.
HASH_PARTS = 4096
#: Parts in which a language's candidates are ranked before the best of each part are ranked together.
PARTS = 64

_BYTES = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
#: Bytes that end a piece, and those between words.
_BREAK = np.isin(_BYTES, np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8))
_WORD = ~(_BREAK | np.isin(_BYTES, np.frombuffer(b" \t", np.uint8)))

CHUNKS = T.StructType(
    [T.StructField("lang", T.StringType()), T.StructField("chunk", T.StringType()), T.StructField("core", T.IntegerType()), T.StructField("f", T.LongType())]
)
PACKED = T.StructType(
    [
        T.StructField("part", T.LongType()),
        T.StructField("lang", T.StringType()),
        T.StructField("words", T.IntegerType()),
        T.StructField("phrases", T.StringType()),
        T.StructField("f", T.ArrayType(T.LongType(), False)),
    ]
)


def stretches(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All places of the stretches, one stretch after another."""
    last = np.cumsum(length)
    return np.repeat(first - (last - length), length) + np.arange(last[-1] if len(last) else 0)


def gathered(batches, text: str):
    """Steps of about ``STEP`` bytes of text, of as many batches as that takes."""
    held, size = [], 0
    for batch in batches:
        for part in steps(batch, text, STEP):
            n = pc.sum(pc.binary_length(part.column(text))).as_py() or 0
            if held and size + n > STEP:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
            held.append(part)
            size += n
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


class Words:
    """The words of joined texts, each followed by one blank, and which of them stand in one piece."""

    def __init__(self, texts: list[bytes]):
        data = _LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
        word = _WORD[data]
        start, end = runs(word)
        self.text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, "right")
        breaks = np.cumsum(_BREAK[data])[start]
        self.piece_end = np.searchsorted(breaks, breaks, "right")
        self.first = np.diff(breaks, prepend=-1) != 0
        word[end] = True
        data[end] = 32
        self.bytes = data[word]
        self.at = np.concatenate(([0], np.cumsum(end - start + 1)))

    def hashes(self) -> np.ndarray:
        return Prefix(self.bytes).of(self.at[:-1], self.at[1:] - 1)

    def phrases(self, first: np.ndarray, end: np.ndarray) -> pa.StringArray:
        """The words from ``first`` up to ``end`` of each phrase, joined by blanks."""
        size = self.at[end] - 1 - self.at[first]
        data = self.bytes[stretches(self.at[first], size)]
        offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
        return pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(data))


def _summed(lang: np.ndarray, number: np.ndarray, phrases: pa.StringArray, weight: np.ndarray):
    """Languages, numbers, phrases and the sums of their weights (below 2^53), one of each kind, phrases in order."""
    coded = phrases.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    wide, most = len(order), int(number.max(initial=0)) + 1
    key = (lang.astype(np.int64) * most + number) * wide + rank[coded.indices.to_numpy(zero_copy_only=False)]
    if int(lang.max(initial=0) + 1) * most * wide < 8 * len(key):  # few enough to count without a sort
        sums = np.bincount(key, weight)
        kinds = np.flatnonzero(sums)
        sums = sums[kinds].astype(np.int64)
    else:
        kinds, back = np.unique(key, return_inverse=True)
        sums = np.bincount(back, weight).astype(np.int64)
    group, word = np.divmod(kinds, max(wide, 1))
    group, number = np.divmod(group, most)
    return group, number, coded.dictionary.take(pa.array(order[word])), sums


def parse(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, trigger: int = TRIGGER) -> DataFrame:
    """The dictionary of the parse: ``lang, chunk, core, f``, one row per distinct chunk with how often it occurs.

    A piece is cut before its first word and before every word whose hash is a multiple of ``trigger``, so equal
    passages are cut alike wherever they stand. A chunk goes on for ``longest - 1`` words into the next one, as far as
    the piece goes; phrases that begin among its first ``core`` words are its own, so every occurrence of a phrase lies
    whole in exactly one chunk that owns it. Tasks send the sums of their steps; a chunk in a third of all
    texts is one row per step.

    Null text is empty and adds nothing, null language is ``und``, repeated rows count each time, a long text is a step
    of its own. Other columns are not read.
    """

    def run(batches):
        for part in gathered(batches, "text"):
            langs = part.column("lang").dictionary_encode()
            words = Words([t.as_buffer().to_pybytes() for t in part.column("text").cast(pa.binary())])
            if not len(words.text):
                continue
            begin = np.flatnonzero(words.first | (words.hashes() % np.uint64(trigger) == 0))
            end = np.minimum(np.append(begin[1:], len(words.text)), words.piece_end[begin])
            whole = np.minimum(end + longest - 1, words.piece_end[begin])
            lang = langs.indices.to_numpy(zero_copy_only=False)[words.text[begin]]
            chunks = words.phrases(begin, whole)
            group, core, chunk, f = _summed(lang, end - begin, chunks, np.ones(len(begin), np.int64))
            columns = [langs.dictionary.take(pa.array(group)), chunk, pa.array(core, pa.int32()), pa.array(f)]
            yield pa.RecordBatch.from_arrays(columns, names=CHUNKS.names)

    source = docs.select(text_of(text_col).alias("text"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"))
    found = source.mapInArrow(run, CHUNKS)
    return found.repartition("lang", "chunk", "core").groupBy("lang", "chunk", "core").agg(F.sum("f").alias("f"))


def _packed(langs: pa.Array, group: np.ndarray, phrases: pa.StringArray, f: np.ndarray, n: int, parts: int) -> pa.RecordBatch:
    """One row per language and part of the phrases' hashes: its phrases as one text, a line each, and their counts."""
    offsets, data = (np.frombuffer(b, t) for b, t in zip(phrases.buffers()[1:], (np.int32, np.uint8)))
    offsets = offsets[: len(phrases) + 1]
    part = (Prefix(data).of(offsets[:-1], offsets[1:]) % np.uint64(parts)).astype(np.int64)
    by = np.lexsort((part, group))  # stable: phrases stay in order
    part, group, f, lines = part[by], group[by], f[by], phrases.take(pa.array(by))
    first = np.flatnonzero((np.diff(part, prepend=-1) != 0) | (np.diff(group, prepend=-1) != 0))
    ends = np.append(first, len(by)).astype(np.int32)
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), lines), "\n")
    counts = pa.ListArray.from_arrays(pa.array(ends), pa.array(f))
    columns = [pa.array(part[first]), langs.take(pa.array(group[first])), pa.array(np.full(len(first), n, np.int32)), texts, counts]
    return pa.RecordBatch.from_arrays(columns, names=PACKED.names)


def phrase_counts(chunks: DataFrame, least_words: int, most_words: int, both: np.ndarray | None = None) -> DataFrame:
    """``lang, phrase, words, f``: phrases of so many words, counted in the distinct chunks by their weight.

    ``both``: bits from ``frequent_bits`` of the phrases one word shorter. Phrases with a part whose bit is not set are not
    sent: the part does not occur often enough, so neither does the phrase.

    A step's phrases are shuffled as sorted texts, by parts of their hashes, and taken apart behind the shuffle, where equal
    phrases of all steps meet: a fraction of the bytes of a row each.
    """
    spark = chunks.sparkSession
    shared = None if both is None else spark.sparkContext.broadcast(both)

    def run(batches):
        for part in gathered(batches, "chunk"):
            langs = part.column("lang").dictionary_encode()
            words = Words([t.as_buffer().to_pybytes() for t in part.column("chunk").cast(pa.binary())])
            core, f = (part.column(c).to_numpy(zero_copy_only=False) for c in ("core", "f"))
            place = np.arange(len(words.text))
            place -= place[words.first][np.cumsum(words.first) - 1]
            lang = langs.indices.to_numpy(zero_copy_only=False)
            own = place < core[words.text]
            for n in range(least_words, most_words + 1):
                begin = np.flatnonzero(own & (np.arange(len(place)) + n <= words.piece_end))
                if shared is not None:
                    hashes = Prefix(words.bytes)
                    for shift in (0, 1):
                        bits = _bit(hashes.of(words.at[begin + shift], words.at[begin + shift + n - 1] - 1))
                        begin = begin[_is_set(shared.value, bits)]
                mine = words.text[begin]
                phrases = words.phrases(begin, begin + n)
                if len(begin):
                    group, _, phrases, sums = _summed(lang[mine], np.zeros(len(begin), np.int64), phrases, f[mine])
                    yield _packed(langs.dictionary, group, phrases, sums, n, HASH_PARTS)

    found = chunks.select("lang", "chunk", "core", "f").mapInArrow(run, PACKED).repartition("part")
    found = found.select("part", "lang", "words", F.inline_outer(F.arrays_zip(F.split("phrases", "\n").alias("phrase"), F.col("f").alias("f"))))
    return found.groupBy("part", "lang", "phrase", "words").agg(F.sum("f").alias("f")).drop("part")


def _bit(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def _is_set(words: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return (words[bits >> 6] >> (bits & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def frequent_bits(phrases: DataFrame) -> np.ndarray:
    """A table of 2^BITS bits, those of the given phrases set: 4 MB whatever the corpus.

    It proves that a phrase is not among the given ones. With many more phrases than bits it proves little; then more
    phrases are counted, with the same result.
    """

    def run(batches):
        for batch in batches:
            for part in steps(batch, "phrase", STEP):
                texts = [t.as_buffer().to_pybytes() for t in part.column("phrase").cast(pa.binary())]
                ends = np.cumsum([len(t) for t in texts])
                starts = np.concatenate(([0], ends[:-1]))
                bits = _bit(Prefix(np.frombuffer(b"".join(texts), np.uint8)).of(starts, ends))
                yield pa.RecordBatch.from_arrays([pa.array(bits >> 6), pa.array(np.int64(1) << (bits & 63))], names=["word", "bits"])

    found = phrases.select("phrase").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(1 << (BITS - 6), np.uint64)
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return table


def often(chunks: DataFrame, longest: int, least: int) -> DataFrame:
    """``lang, phrase, words, f`` of every phrase of up to ``longest`` words that occurs ``least`` times, written.

    Words and pairs are counted first. A longer phrase is counted where both of its parts one word shorter may be frequent.
    """
    found = write_and_read(phrase_counts(chunks, 1, 2).where(F.col("f") >= least), "phrases")
    for n in range(3, longest + 1):
        shorter = frequent_bits(found.where(F.col("words") == n - 1))
        more = write_and_read(phrase_counts(chunks, n, n, shorter).where(F.col("f") >= least), "phrases")
        found = found.unionByName(more)
    return found


def _words(phrase: str):
    return F.split(phrase, " ")


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST,
    hides: int = HIDES, top: int = TOP, trigger: int = TRIGGER,
) -> DataFrame:
    """The ``top`` phrases of 2 to ``longest`` words of each language by how firmly their weakest cut holds.

    ``lang, rank, phrase, a, l, r, n, score``: ``a`` is the phrase's count, ``l`` and ``r`` those of the two parts of
    its lowest-scoring cut, ``n`` the language's words, ``score`` floor(10^6 a^2 / (l r)), in decimals of 38 digits.
    A phrase inside a longer candidate that makes up ``hides`` hundredths of it is left out.

    The parse and the counts that reach ``least`` are written (``often``); both parts of a phrase are as frequent as the phrase, so
    everything after the counts reads the frequent ones only. Odd rows: see ``parse``; an empty table gives none.
    """
    chunks = write_and_read(parse(docs, text_col, lang_col, longest, trigger), "parse")
    sizes = chunks.groupBy("lang").agg(F.sum(F.col("core") * F.col("f")).alias("n"))
    counted = often(chunks, longest, least)
    found = counted.where("words >= 2").select("lang", "phrase", "words", F.col("f").alias("a"), _words("phrase").alias("w"))

    def some(first, size):
        return F.array_join(F.slice("w", first, size), " ")

    ways = F.transform(
        F.sequence(F.lit(1), F.col("words") - 1),
        lambda k: F.struct(k.alias("k"), some(F.lit(1), k).alias("left"), some(k + 1, F.col("words") - k).alias("right")),
    )
    cuts = found.select("lang", "phrase", "a", F.explode(ways).alias("c")).select("lang", "phrase", "a", "c.*")
    for side, count in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counted.select("lang", F.col("phrase").alias(side), F.col("f").alias(count)), ["lang", side])
    wide = cuts.selectExpr("*", *(f"CAST({c} AS DECIMAL(18, 0)) AS d{c}" for c in "alr"))
    scored = wide.selectExpr("lang", "phrase", "a", "struct(CAST((da * da * 1000000) div (dl * dr) AS BIGINT) AS score, k, l, r) AS cut")
    scored = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min("cut").alias("cut"))

    inner = F.transform(
        F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: some(i, n))
    )
    longer = found.where("words > 2").select("lang", F.explode(F.flatten(inner)).alias("phrase"), F.col("a").alias("over"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("over").alias("over"))
    free = scored.join(longer, ["lang", "phrase"], "left").where(F.expr(f"over IS NULL OR 100 * over < {hides} * a"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = free.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    for group in (["lang", "part"], ["lang"]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return rows.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark, sf_dir):
    """All ``documents``."""
    return collocations(table(spark, sf_dir))


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k AS words, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS phrase
  FROM w, (VALUES (1), (2), (3)) sizes(k)),
counts AS (SELECT lang, words, phrase, count(*)::HUGEINT AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM counts WHERE words = 1 GROUP BY lang),
candidates AS (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE words >= 2 AND f >= 10),
cuts AS (SELECT *, unnest(range(1, words)) AS k FROM candidates),
scored AS (
  SELECT c.lang, c.words, c.phrase, c.a, c.k, x.f AS l, y.f AS r, (1000000 * c.a * c.a) // (x.f * y.f) AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, phrase, max(a) AS over FROM (
    SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM candidates WHERE words = 3)
  GROUP BY ALL),
ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase WHERE g.over IS NULL OR 100 * g.over < 50 * b.a)
SELECT r.lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r.r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked r JOIN totals t ON t.lang = r.lang WHERE rank <= 2000
"""
