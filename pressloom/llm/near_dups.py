"""N-gram Jaccard join: MinHash candidates, Bayesian pruning of pairs, exact verification."""

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.llm.common import WORD_BYTE, Prefix, joined, key_of, mix64, powers, runs, stay_only, steps, table, text_of
from pressloom.llm.graph import components
from pressloom.session import write_and_read

WORDS = 5
SIMILAR = 0.8
BANDS, ROWS = 25, 5
HASHES = 128
#: MinHash values compared before a pair's posterior is looked at again.
LOOK = 32
#: A pair goes when the probability that it reaches the threshold, given the values compared so far, is below this.
TOLERANCE = 1e-6
#: Members of a candidate group that meet those of another part of it in one task, on average.
PART = 256

_RNG = np.random.default_rng(20)
_A = _RNG.integers(1, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, HASHES, np.uint64)
_MIX = powers(0xD6E8FEB86659FD93, 64)[1:]


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """Sorted 64-bit hashes of each text's word shingles.

    A word is a run of ASCII letters, digits, underscores and characters beyond ASCII, in lower case. A text of fewer
    words than a shingle has is one shingle; a text without words (the empty one too) is one shingle of its characters.
    """
    data, starts = joined([t.lower() for t in texts])
    begin, end = runs(WORD_BYTE[data])
    prefix = Prefix(data)
    word = prefix.of(begin, end)
    bounds = np.searchsorted(begin, starts)
    n = max(len(word) - words + 1, 0)
    whole = np.zeros(n, np.uint64)
    for i in range(words):
        whole += word[i : i + n] * _MIX[i]
    whole = mix64(whole)
    out = []
    for i in range(len(texts)):
        a, b = bounds[i], bounds[i + 1]
        if b - a >= words:
            out.append(np.unique(whole[a : b - words + 1]))
        elif b > a:
            code = np.uint64(b - a) + (word[a:b] * _MIX[: b - a]).sum(dtype=np.uint64)
            out.append(mix64(np.array([code], np.uint64)))
        else:
            out.append(prefix.of(starts[i : i + 1], starts[i + 1 : i + 2] - 1) ^ np.uint64(0x5555))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES MinHash values of each set, one row per set."""
    flat = np.concatenate(sets)
    sizes = np.array([len(s) for s in sets])
    begin = np.cumsum(sizes) - sizes
    out = np.empty((len(sets), HASHES), np.uint32)
    for j in range(HASHES):
        out[:, j] = np.minimum.reduceat((flat * _A[j] + _B[j]) >> np.uint64(32), begin)
    return out


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    parts = sig[:, : bands * rows].reshape(len(sig), bands, rows).astype(np.uint64) + np.uint64(1)
    return mix64((parts * _MIX[:rows]).sum(axis=2, dtype=np.uint64)).view(np.int64)


def least_matches(similar: float = SIMILAR, tolerance: float = TOLERANCE) -> dict[int, int]:
    """Fewest equal values among the first n with which a pair stays, for n = LOOK, 2 LOOK, ...

    With a uniform prior the similarity after m of n equal values is Beta(m + 1, n - m + 1), which is at least t with
    the probability that n + 1 trials of chance t succeed at most m times.
    """
    out = {}
    for n in range(LOOK, HASHES + 1, LOOK):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += math.comb(n + 1, m) * similar**m * (1 - similar) ** (n + 1 - m)
        out[n] = m
    return out


def linked(sig: np.ndarray, sets: list[np.ndarray], part: np.ndarray, similar: float = SIMILAR) -> tuple[np.ndarray, np.ndarray]:
    """Links of each member and the smallest member that it hangs together with, among pairs of different parts
    (of all pairs if there is one part)."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    owner = np.repeat(np.arange(n), sizes)[order]
    fresh = np.concatenate(([True], flat[order][1:] != flat[order][:-1]))
    number = np.cumsum(fresh) - 1
    begin = np.append(np.flatnonzero(fresh), len(flat))
    place = np.empty(len(flat), np.int64)
    place[order] = number
    where = np.concatenate(([0], np.cumsum(sizes)))
    least = least_matches(similar)
    one = part.min() == part.max()
    links, label = np.zeros(n, np.int64), np.arange(n)
    for i in range(n - 1):
        other = np.arange(i + 1, n)
        if not one:
            other = other[part[other] != part[i]]
        equal = np.zeros(len(other), np.int64)
        for seen, needed in least.items():
            if not len(other):
                break
            equal += (sig[other, seen - LOOK : seen] == sig[i, seen - LOOK : seen]).sum(axis=1)
            stay = equal >= needed
            other, equal = other[stay], equal[stay]
        if not len(other):
            continue
        mine = place[where[i] : where[i + 1]]
        length = begin[mine + 1] - begin[mine]
        last = np.cumsum(length)
        shared = np.bincount(owner[np.repeat(begin[mine] - (last - length), length) + np.arange(last[-1])], minlength=n)[other]
        hit = other[shared >= similar * (sizes[i] + sizes[other] - shared) - 1e-9]
        if len(hit):
            links[i] += len(hit)
            links[hit] += 1
            joins = np.unique(label[np.append(hit, i)])
            label[np.isin(label, joins)] = joins[0]
    return links, label


def _sign(batches):
    for batch in batches:
        for part in steps(batch):
            sets = shingle_sets(part.column("text").to_pylist())
            sig = signatures(sets)
            keys = band_keys(sig)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("text_key"),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([row.tobytes() for row in sig], pa.binary()),
                    pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), keys.ravel()),
                ],
                names=["doc_id", "text_key", "set_key", "sig", "bands"],
            )


def _load(batches):
    """Shingle sets in place of texts; a row whose set is not the one wanted (a repeated id) goes."""
    for batch in batches:
        for part in steps(batch):
            sets = [s.tobytes() for s in shingle_sets(part.column("text").to_pylist())]
            right = pa.array([hashlib.blake2b(s, digest_size=16).digest() == k for s, k in zip(sets, part.column("set_key").to_pylist())])
            kept = part.drop_columns(["text", "set_key"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sets, pa.binary())], names=[*kept.schema.names, "shingles"]).filter(right)


def _verify(group: pa.Table) -> pa.Table:
    node, first = np.unique(group.column("node").to_numpy(), return_index=True)  # repeated rows once, smallest node first
    rows = group.take(pa.array(first))
    sig = np.stack([np.frombuffer(s, np.uint32) for s in rows.column("sig").to_pylist()])
    sets = [np.frombuffer(s, np.uint64) for s in rows.column("shingles").to_pylist()]
    links, label = linked(sig, sets, rows.column("part").to_numpy())
    some = links > 0
    return pa.table({"node": node[some], "links": links[some], "parent": node[label[some]]})


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, text_key, class_id, class_size, copy_id, n_copies, n_links, stays``.

    1. Texts with the same set of five-word shingles are copies (``copy_id``, ``n_copies``); one stands for all.
    2. 128 MinHash values; representatives that agree in one of 25 bands of 5 are tied to the smallest of the bucket,
       a star and not all pairs, and hang together in candidate groups (a pair at 0.8 is missed by 1 in 20,000).
    3. In a candidate group every pair is compared LOOK values at a time and dropped when it is too unlikely to reach
       0.8; the rest is counted exactly. Groups over PART members are dealt in parts, a task takes two parts; a task
       returns link counts and a spanning forest, never the pairs.
    4. ``n_links``: other shingle sets at 0.8 or more. ``class_id``: smallest doc_id of what links connect.
    ``stays`` marks one row of each class (repeated rows with the same id and text are marked alike).

    Null text is empty; empty texts are copies of each other. Null ids order last. Other columns are not read.
    """
    source = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(text_col).alias("text"), F.sha2(text_of(text_col), 256).alias("text_key")
    )
    signed = source.mapInArrow(_sign, "doc_id long, text_key string, set_key binary, sig binary, bands array<long>")
    signed = write_and_read(signed, "signatures")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    classes = signed.groupBy("set_key").agg(
        F.min(row).alias("copy"), F.count(F.lit(1)).alias("n_copies"), F.first("sig").alias("sig"), F.first("bands").alias("bands")
    )
    classes = write_and_read(classes.withColumn("node", F.monotonically_increasing_id()), "copies")

    keys = classes.select("node", F.posexplode("bands").alias("band", "bucket"))
    hubs = keys.groupBy("band", "bucket").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    stars = keys.join(write_and_read(hubs, "hubs"), ["band", "bucket"]).where("node <> hub")
    tied = write_and_read(components(stars.select(F.col("node").alias("a"), F.col("hub").alias("b"))), "candidates")

    sizes = tied.groupBy("root").agg((F.count(F.lit(1)) + 1).alias("members"))
    sizes = write_and_read(sizes.withColumn("parts", F.ceil(F.col("members") / PART).cast("int")), "candidate-sizes")
    members = tied.join(sizes, "root").select("node", "root", "parts").unionByName(sizes.select(F.col("root").alias("node"), "root", "parts"))
    members = members.join(classes.select("node", "set_key", "copy", "sig"), "node").select(
        "node", "root", "parts", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), "set_key", "sig",
        F.col("copy.doc_id").alias("copy_id"), F.col("copy.text_key").alias("copy_key"),
    )
    loaded = (
        source.join(members, source["doc_id"].eqNullSafe(members["copy_id"]) & (source["text_key"] == members["copy_key"]))
        .select("node", "root", "parts", "part", "sig", "text", "set_key")
        .mapInArrow(_load, "node long, root long, parts int, part int, sig binary, shingles binary")
    )
    dealt = loaded.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)"))).select(
        "root", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "node", "part", "sig", "shingles"
    )
    found = dealt.groupBy("root", "p", "q").applyInArrow(_verify, "node long, links long, parent long")
    found = write_and_read(found, "links")

    links = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("parent").alias("b")))
    placed = classes.select("node", "set_key", "copy", "n_copies").join(links, "node", "left").join(roots, "node", "left")
    placed = write_and_read(
        placed.withColumn("root", F.coalesce("root", "node")).withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long"))), "placed"
    )
    best = placed.groupBy("root").agg(F.min("copy").alias("best"), F.sum("n_copies").alias("class_size"))
    verdict = placed.join(write_and_read(best, "classes"), "root").drop("node", "root")
    verdict = write_and_read(verdict, "verdicts")
    return signed.select("doc_id", "text_key", "set_key").join(verdict, "set_key").select(
        "doc_id", "text_key", F.col("best.doc_id").alias("class_id"), "class_size", F.col("copy.doc_id").alias("copy_id"), "n_copies", "n_links",
        (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_key") == F.col("best.text_key"))).alias("stays"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows that stay, one of each class, with all their columns."""
    stay = near_duplicates(docs, id_col, text_col).where("stays")
    key = key_of(F.col(f"`{id_col}`"), F.sha2(text_of(text_col), 256))
    return stay_only(docs, key, stay, key_of(F.col("doc_id"), F.col("text_key")))


def op6_near_duplicates(spark, sf_dir):
    """All ``documents``."""
    return near_duplicates(table(spark, sf_dir)).drop("text_key")
