"""Byte-level BPE: a segment tree over the ranks of adjacent pairs picks each merge."""

import json
import os
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressloom.llm.common import steps, table, text_of

VOCABULARY = "byte_bpe_50k.json"
#: Bytes that a worker's memory of pieces may take, which changes no result.
MEMORY = 400_000_000
#: Longer pieces are merged each time they are met, so that no entry of the memory is large.
LONGEST_KNOWN = 128
#: Estimated bytes of an entry besides its characters and ids.
ENTRY = 200

_SPACE = r"\t-\r \x85\xa0  -     　"
#: Fixed value: the pre-tokenizer's pattern, white space spelt out; its alternatives that cannot meet are in another order.
PATTERN = rf" ?\p{{L}}+| ?\p{{N}}+|'(?:[stmd]|re|ve|ll)| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: The same for texts without a character that Python's own classes sort otherwise.
QUICK = re.compile(r" ?[^\W\d_]+| ?\d+|'(?:[stmd]|re|ve|ll)| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def _sorted_otherwise() -> str:
    """A class of the separators, of letter-like numbers that are neither letters nor digits for Python, and of all beyond 16 bits."""
    odd = [c for c in map(chr, range(128, 1 << 16)) if c.isalnum() and unicodedata.category(c) in ("Nl", "No")]
    return "[\x1c-\x1f" + "".join(odd) + "\U00010000-\U0010ffff]"


TOKENS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def byte_letters() -> list[str]:
    """The letter by which a vocabulary file writes each byte: itself if it is visible, else the next one from 256 on."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = (b for b in range(256) if b not in seen)
    letters = {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


class PairTree:
    """A segment tree whose leaves are the ranks of adjacent pairs, ``rank * width + place``.

    The least value of the tree, at its root, is the leftmost pair of the lowest rank.
    """

    def __init__(self, ranks: list[int], none: int):
        self.width = width = 1 << max(0, len(ranks) - 1).bit_length()
        self.none = none * width  # nothing from here on can be merged
        nodes = [self.none] * (width - 1)
        nodes += [r * width + i for i, r in enumerate(ranks)]
        nodes += [self.none] * (width - len(ranks))
        nodes.insert(0, self.none)
        for i in range(width - 1, 0, -1):
            left, right = nodes[2 * i], nodes[2 * i + 1]
            nodes[i] = left if left < right else right
        self.nodes = nodes

    def lowest(self) -> int:
        """The place of the pair to merge, -1 if none can be."""
        best = self.nodes[1]
        return best & (self.width - 1) if best < self.none else -1

    def put(self, place: int, rank: int) -> None:
        nodes, i = self.nodes, self.width + place
        nodes[i] = least = rank * self.width + place
        while i > 1:
            other = nodes[i ^ 1]
            i >>= 1
            if other < least:
                least = other
            if nodes[i] == least:
                break
            nodes[i] = least


class Merges:
    """A vocabulary file's merges and tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, letters = spec["model"], byte_letters()
        before = spec["pre_tokenizer"] or {}
        if (
            model["type"] != "BPE" or spec["normalizer"] or before.get("type") != "ByteLevel" or before["add_prefix_space"]
            or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])
        ):
            raise ValueError(f"{path} is not plain byte-level BPE")
        ids = model["vocab"]
        self.byte_ids = [ids[x] for x in letters]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.none = len(pairs)
        #: The pair of two ids, as one number, to its rank and the id it becomes.
        self.pairs = {ids[a] << 32 | ids[b]: (rank, ids[a + b]) for rank, (a, b) in reversed(list(enumerate(pairs)))}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        value = {x: b for b, x in enumerate(letters)}
        known = {i: bytes(value[x] for x in token) for token, i in ids.items()} | {i: t.encode() for t, i in self.added.items()}
        self.bytes = [known.get(i, b"") for i in range(max(known) + 1)]

    def merge(self, piece: str) -> list[int]:
        """The ids of one piece of the pre-tokenizer."""
        ids = [self.byte_ids[b] for b in piece.encode("utf-8")]
        n, pairs, none = len(ids), self.pairs, self.none
        if n < 2:
            return ids
        unknown = (none, 0)
        found = [pairs.get(a << 32 | b, unknown) for a, b in zip(ids, ids[1:])]
        tree = PairTree([rank for rank, _ in found], none)
        becomes = [new for _, new in found]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (i := tree.lowest()) >= 0:
            j = after[i]
            ids[i], ids[j] = becomes[i], -1
            k = after[i] = after[j]
            if j < n - 1:
                tree.put(j, none)
            if k < n:
                before[k] = i
                rank, becomes[i] = pairs.get(ids[i] << 32 | ids[k], unknown)
                tree.put(i, rank)
            else:
                tree.put(i, none)
            if (h := before[i]) >= 0:
                rank, becomes[h] = pairs.get(ids[h] << 32 | ids[i], unknown)
                tree.put(h, rank)
        return [x for x in ids if x >= 0]


class Known(dict):
    """Pieces to their packed 32-bit ids, merged when first met.

    When its share of ``MEMORY`` is full, a generation becomes the old one and its pieces come back as they are met again;
    the old one before it is forgotten.
    """

    def __init__(self, merges: Merges, memory: int = MEMORY):
        super().__init__()
        self.merges, self.most = merges, memory // 2
        self.old: dict[str, bytes] = {}
        self.held = 0

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            found = np.array(self.merges.merge(piece), "<u4").tobytes()
        if len(piece) <= LONGEST_KNOWN:
            if self.held > self.most:
                self.old, self.held = dict(self), 0
                self.clear()
            self[piece] = found
            self.held += ENTRY + 2 * len(piece) + len(found)
        return found


class Encoder:
    """Texts to packed 32-bit ids: cut at special tokens, then by the pre-tokenizer's pattern, then merged piece by piece."""

    def __init__(self, path: str):
        self.merges, self.split = Merges(path), regex.compile(PATTERN)
        self.odd = re.compile(_sorted_otherwise())
        self.known = Known(self.merges)
        added = sorted(self.merges.added, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None

    def plain(self, text: str) -> bytes:
        pieces = self.split.findall(text) if self.odd.search(text) else QUICK.findall(text)
        return b"".join(map(self.known.__getitem__, pieces))

    def encode(self, text: str) -> bytes:
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        added = self.merges.added
        parts = self.special.split(text)
        return b"".join(np.uint32(added[p]).tobytes() if i % 2 else self.plain(p) for i, p in enumerate(parts) if p)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One memory per worker process, so that tasks in a row share it."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``doc_id, ids``: the token ids of every whole text, one row per input row, without a shuffle.

    Strings of special tokens in a text are their ids. Null and empty texts have no ids; a null id stays null; repeated
    rows are encoded each. A long text is a step of its own; a long piece without a cut costs n log n. Other columns
    are not read.
    """
    path = vocabulary or default_vocabulary()

    def run(batches):
        if not os.path.exists(path):
            raise FileNotFoundError(path)
        own = encoder(path)
        for batch in batches:
            for part in steps(batch):
                found = [own.encode(t) for t in part.column("text").to_pylist()]
                offsets = np.zeros(len(found) + 1, np.int32)
                np.cumsum([len(x) // 4 for x in found], out=offsets[1:])
                values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(found))])
                ids = pa.ListArray.from_arrays(pa.array(offsets), values)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], names=TOKENS.names)

    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return source.mapInArrow(run, TOKENS)


def decode(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """``doc_id, ids, text``: the text of every row's ids, special tokens included.

    Null and empty ids are the empty text (null ids stay null); bytes that are no UTF-8 become U+FFFD, as in any lossy
    decoding; ids that the vocabulary does not have are passed over.
    """
    path = vocabulary or default_vocabulary()

    def run(batches):
        known = encoder(path).merges.bytes
        size = np.array([len(x) for x in known] + [0], np.int64)
        begin, flat = np.cumsum(size) - size, np.frombuffer(b"".join(known), np.uint8)
        for batch in batches:
            for row in _slices(batch):
                rows = row.column("ids")
                ids = rows.flatten().to_numpy(zero_copy_only=False)
                ids = np.where((ids < 0) | (ids >= len(known)), len(known), ids)
                ends = np.cumsum(pa.compute.list_value_length(rows).fill_null(0).to_numpy(zero_copy_only=False))
                length = size[ids]
                last = np.cumsum(length)
                at = np.repeat(begin[ids] - (last - length), length)
                data = flat[at + np.arange(len(at))].tobytes()
                cut = np.concatenate(([0], last))[np.concatenate(([0], ends))].tolist()
                texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays([row.column("doc_id"), rows, pa.array(texts, pa.string())], names=[*TOKENS.names, "text"])

    source = tokens.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{ids_col}`").cast("array<int>").alias("ids"))
    return source.mapInArrow(run, T.StructType([*TOKENS.fields, T.StructField("text", T.StringType())]))


def _slices(batch: pa.RecordBatch, ids: int = 500_000):
    """Parts of a batch with about so many ids, one row at least."""
    sizes = pa.compute.list_value_length(batch.column("ids")).fill_null(0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for i, n in enumerate(sizes):
        if i > first and held + n > ids:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n
    if batch.num_rows > first:
        yield batch.slice(first)


def op12_bpe(spark, sf_dir):
    """All ``documents``, encoded and decoded again."""
    back = decode(encode(table(spark, sf_dir)))
    return back.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"),
    )
