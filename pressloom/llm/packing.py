"""Power-of-two decomposition: every document is cut into pieces of binary lengths, a sequence is one piece."""

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressloom.llm.common import steps, table, text_of

MAX_TOKENS = 2048
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Bytes that a worker's memory of words may take: it starts anew beyond that, which changes no result. An entry is
#: estimated at so many bytes besides four for each of its characters.
MEMORY, ENTRY = 260_000_000, 130
#: Words encoded in one call.
CALL = 500
#: Separators that str.split() cuts at and the tokenizer does not; texts with them are cut at the white space of both.
UNUSUAL = re.compile("[\x1c-\x1f]")
WHITE = re.compile(r"[^\S\x1c-\x1f]+")

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class WordIds(dict):
    """Word to the place of its ids. No token crosses white space, so a text's ids are its words' ids in a row.

    A word that is met first gets its place at once and its ids with the next ``learn``.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        self.forget()

    def forget(self) -> None:
        self.clear()
        self[""] = 0  # the end of a document; no word is empty
        self.new: list[str] = []
        self.held = 0
        self.flat, self.used = np.full(1, self.end_id, np.uint32), 1
        self.begin, self.count, self.known = np.zeros(1, np.int64), np.ones(1, np.int64), 1

    def __missing__(self, word: str) -> int:
        self[word] = place = len(self)
        self.new.append(word)
        return place

    def learn(self) -> None:
        ids, counts = [], []
        self.held += ENTRY * len(self.new) + 4 * sum(map(len, self.new))
        for i in range(0, len(self.new), CALL * 20):
            part = self.new[i : i + CALL * 20]
            groups = [part[j : j + CALL] for j in range(0, len(part), CALL)]
            for words, found in zip(groups, self.tokenizer.encode_batch(["\n".join(g) for g in groups], add_special_tokens=False)):
                begins = np.cumsum([0, *(len(w) + 1 for w in words[:-1])])
                at = np.array([o[0] for o in found.offsets], np.int64)
                counts.append(np.bincount(np.searchsorted(begins, at, "right") - 1, minlength=len(words)))
                ids.append(np.array(found.ids, np.uint32))
        self.new = []
        if not counts:
            return
        count, fresh = np.concatenate(counts), np.concatenate(ids)
        begin = self.used + np.cumsum(count) - count
        self.flat = self._grown(self.flat, self.used, fresh)
        self.begin = self._grown(self.begin, self.known, begin)
        self.count = self._grown(self.count, self.known, count)
        self.used += len(fresh)
        self.known += len(count)

    @staticmethod
    def _grown(array: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
        if used + len(more) > len(array):
            array = np.concatenate((array[:used], np.empty(max(len(more), used), array.dtype)))
        array[used : used + len(more)] = more
        return array

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, the end id after each, and where each text ends."""
        if self.held > MEMORY:
            self.forget()
        words = [[*filter(None, WHITE.split(t)), ""] if UNUSUAL.search(t) else [*t.split(), ""] for t in texts]
        at = np.fromiter(map(self.__getitem__, chain.from_iterable(words)), np.int64, sum(map(len, words)))
        self.learn()
        count = self.count[at]
        last = np.cumsum(count)
        ids = self.flat[np.repeat(self.begin[at] - (last - count), count) + np.arange(last[-1] if len(last) else 0)]
        return ids, last[np.cumsum([len(w) for w in words]) - 1] if words else np.zeros(0, np.int64)


_LEARNED: dict[tuple[str, int], WordIds] = {}


def word_ids(path: str, end_id: int) -> WordIds:
    """One memory per worker process, so that tasks in a row share it."""
    if (path, end_id) not in _LEARNED:
        _LEARNED[path, end_id] = WordIds(path, end_id)
    return _LEARNED[path, end_id]


def binary_lengths(n: int, most: int = MAX_TOKENS) -> list[int]:
    """``most`` as often as it fits, then the powers of two of the rest, the longest first."""
    rest = n % most
    return [most] * (n // most) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_TOKENS,
    vocabulary: str | None = None, end_id: int = END_ID,
) -> DataFrame:
    """Token pieces whose lengths are powers of two up to ``most`` (a power of two itself).

    One row per piece: ``doc_id, start, length, doc_tokens, ids`` (unsigned little-endian 32-bit), ``bucket`` (log2 of
    the length; all sequences of a bucket are equally long and batch without padding), ``sequence_id`` and ``offset``.
    Every sequence is one piece, so none crosses documents, attention needs no mask and nothing is padded. The work
    is local to a row: no shuffle, no hot key. ``sequence_id`` is unique; it follows the order of the input splits.

    Null and empty texts are their end id alone. Repeated rows are packed each. Other columns are not read.
    """
    if most < 1 or most & (most - 1):
        raise ValueError("the longest sequence must be a power of two")
    path = vocabulary or default_vocabulary()

    def cut(batches):
        memory = word_ids(path, end_id)
        for batch in batches:
            for part in steps(batch):
                ids, last = memory.of(part.column("text").to_pylist())
                sizes = np.diff(last, prepend=0)
                lengths = [binary_lengths(int(n), most) for n in sizes]
                counts = np.array([len(x) for x in lengths], np.int64)
                length = np.array(list(chain.from_iterable(lengths)), np.int64)
                end = np.cumsum(length)
                first = np.repeat(last - sizes, counts)
                offsets = np.concatenate(([0], end * 4)).astype(np.int32)
                data = pa.Array.from_buffers(
                    pa.binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u4"))]
                )
                doc = part.column("doc_id").take(pa.array(np.repeat(np.arange(part.num_rows), counts)))
                yield pa.RecordBatch.from_arrays(
                    [doc, pa.array(end - length - first), pa.array(length), pa.array(np.repeat(sizes, counts)), data],
                    names=PIECES.names,
                )

    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return source.mapInArrow(cut, PIECES).select(
        "*",
        F.log2(F.col("length")).cast("int").alias("bucket"),
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )


def digests(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket"
    )


def op2_packing(spark, sf_dir):
    """All ``documents``."""
    return digests(pack(table(spark, sf_dir)))
