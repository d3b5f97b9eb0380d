"""Ranked lexical search over an index whose documents are grouped by equal normaliser."""

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressloom.llm.common import runs, steps, table, text_of
from pressloom.session import new_path, write_and_read

#: Documents returned for an item.
TOP = 50
#: Bytes of text in one block of the index, and blocks in a row group of its files, which a reading task holds at a time.
BLOCK, GROUP = 2_000_000, 4
#: Terms, repeats between items included, that the items of one pass over the index have; a longer item is a pass of its own.
PASS_TERMS = 200_000
#: Steps per doubling in which normalisers are counted when the blocks are laid out, and the most such steps.
FINE, STEPS = 64, 64 * 63
#: Parts in which an item's hits are ranked before the best of each part are ranked together.
SALT = 64
#: Fixed value: characters of terms.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_BYTES = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_IN_TERM = (_BYTES >= 128) | ((_LOWER >= 97) & (_LOWER <= 122)) | ((_BYTES >= 48) & (_BYTES <= 57))

_LONGS, _INTS = T.ArrayType(T.LongType(), False), T.ArrayType(T.IntegerType(), False)
#: One row per block. Documents are in the order of their m; the postings of a term, ``counts`` many, lie by stratum, then
#: by falling tf. ``doc`` is a document's place in the block.
BLOCKS = T.StructType(
    [
        T.StructField("slot", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType(), True)),
        T.StructField("m", _LONGS),
        T.StructField("terms", T.ArrayType(T.StringType(), False)),
        T.StructField("counts", _INTS),
        T.StructField("doc", _INTS),
        T.StructField("tf", _INTS),
    ]
)
HITS = T.StructType([T.StructField("item", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])


@dataclass
class Index:
    blocks: DataFrame
    documents: int
    terms: int

    def write(self, path: str) -> None:
        """The blocks as Parquet, the two totals beside them."""
        spark = self.blocks.sparkSession
        _write_blocks(self.blocks, f"{path}/blocks")
        spark.createDataFrame([(self.documents, self.terms)], "documents long, terms long").write.parquet(f"{path}/totals")

    @staticmethod
    def read(spark: SparkSession, path: str) -> "Index":
        totals = spark.read.parquet(f"{path}/totals").first()
        return Index(spark.read.schema(BLOCKS).parquet(f"{path}/blocks"), totals.documents, totals.terms)


def with_sizes(source: DataFrame) -> DataFrame:
    """``doc_id, text, n``: how many terms each text has, repeats included."""

    def run(batches):
        for batch in batches:
            for part in steps(batch):
                texts = [t.as_buffer().to_pybytes() for t in part.column("text").cast(pa.binary())]
                start, _ = runs(_IN_TERM[np.frombuffer(b"\0".join([*texts, b""]), np.uint8)])
                ends = np.cumsum([len(t) + 1 for t in texts])
                n = np.diff(np.searchsorted(start, ends), prepend=0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n, pa.int64())], names=[*part.schema.names, "n"])

    return source.mapInArrow(run, "doc_id long, text string, n long")


def _stretches(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    last = np.cumsum(length)
    return np.repeat(first - (last - length), length) + np.arange(last[-1] if len(last) else 0)


def _list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _block(slot: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One row of the index from documents in the order of their m."""
    m = np.concatenate([p.column("m").to_numpy(zero_copy_only=False) for p in parts])
    ids = pa.concat_arrays([p.column("doc_id") for p in parts])
    texts = [t.as_buffer().to_pybytes() for p in parts for t in p.column("text").cast(pa.binary())]
    data = _LOWER[np.frombuffer(b"\0".join([*texts, b""]), np.uint8)]
    inside = _IN_TERM[data]
    start, end = runs(inside)
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, "right")
    offsets = np.concatenate(([0], np.cumsum(end - start))).astype(np.int32)
    coded = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data[inside])).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    posting, tf = np.unique(rank[coded.indices.to_numpy()] * len(texts) + doc, return_counts=True)
    term, doc = np.divmod(posting, len(texts))
    stratum = np.cumsum(np.diff(m, prepend=m[0]) != 0)
    by = np.lexsort((-tf, term * (int(stratum[-1]) + 1) + stratum[doc]))
    columns = [
        pa.array([slot], pa.int64()), _list(ids), _list(pa.array(m)), _list(coded.dictionary.take(pa.array(order))),
        _list(pa.array(np.bincount(term, minlength=len(order)), pa.int32())),
        _list(pa.array(doc[by], pa.int32())), _list(pa.array(tf[by], pa.int32())),
    ]
    return pa.RecordBatch.from_arrays(columns, names=BLOCKS.names)


def _in_slots(sized: DataFrame, documents: int, terms: int, block: int) -> DataFrame:
    """``doc_id, text, m, slot``: each document's normaliser, and the slot of the index that it goes to.

    Slots follow the order of m and hold about ``block`` bytes each: the bytes are counted in at most ``STEPS`` fine steps
    of m, a step's share of all bytes is its share of the slots, and inside a step documents go by m, then by a hash. So
    equal normalisers lie together, and a frequent one fills as many slots as its bytes need.
    """
    spark = sized.sparkSession
    placed = sized.selectExpr(
        "doc_id", "text", f"50 + (50 * n * {documents}L) div {max(terms, 1)}L AS m",
        "octet_length(text) + 1L AS bytes", "pmod(xxhash64(doc_id, text), 1048576) / 1048576 AS u",
    ).withColumn("step", F.floor(F.log2("m") * FINE))
    counted = placed.groupBy("step").agg(F.sum("bytes").alias("bytes"), F.min("m").alias("low"), F.max("m").alias("high"))
    layout, before = [], 0
    for r in sorted(counted.limit(STEPS).collect()):
        layout.append((r.step, before / block, r.bytes / block, r.low, r.high))
        before += r.bytes
    layout = spark.createDataFrame(layout, "step long, first double, slots double, low long, high long")
    place = F.col("first") + F.col("slots") * (F.col("m") - F.col("low") + F.col("u")) / (F.col("high") - F.col("low") + 1)
    return placed.join(F.broadcast(layout), "step").select("doc_id", "text", "m", F.floor(place).alias("slot"))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> Index:
    """The index of all documents with at least one term, written.

    N and L come from one aggregate; then the texts are dealt by slots of like normalisers m (``_in_slots``) and sorted by
    m in them; a slot becomes one row, or more where it is much larger than ``block`` bytes.

    Null and empty texts and those without a term are not in the index; a null id stays null; repeated rows are
    documents of their own; a long text is a block of its own. Other columns are not read.
    """
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    sized = with_sizes(source).where("n > 0")
    totals = sized.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("terms")).first()
    documents, terms = totals.documents, totals.terms or 0
    placed = _in_slots(sized, documents, terms, block).repartition("slot").sortWithinPartitions("slot", "m")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, held, parts = None, 0, []
        for batch in batches:
            slots = batch.column("slot").to_numpy()
            edges = np.flatnonzero(np.diff(slots, prepend=-1, append=-1))
            for first, last in zip(edges, edges[1:]):
                for part in steps(batch.slice(first, last - first), chars=block):
                    size = pc.sum(pc.binary_length(part.column("text"))).as_py()
                    if parts and (slots[first] != slot or held + size > 2 * block):
                        yield _block(slot, parts)
                        held, parts = 0, []
                    slot = int(slots[first])
                    parts.append(part)
                    held += size
        if parts:
            yield _block(slot, parts)

    path = new_path(docs.sparkSession, "lexical-index")
    _write_blocks(placed.mapInArrow(build, BLOCKS), path)
    return Index(docs.sparkSession.read.schema(BLOCKS).parquet(path), documents, terms)


def _write_blocks(blocks: DataFrame, path: str) -> None:
    """Rows of about a megabyte, few of them in a row group."""
    blocks.write.option("parquet.block.row.count.limit", GROUP).parquet(path)


class Queries:
    """The items of one pass: their distinct terms, and which of them each item has."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.numbers = [number for number, _ in items]
        self.terms = sorted({t for _, found in items for t in found}, key=lambda t: t.encode("utf-8"))
        place = {t: i for i, t in enumerate(self.terms)}
        self.of = [np.array(sorted(place[t] for t in found), np.int64) for _, found in items]
        self.weights = np.zeros(len(self.terms), np.int64)

    def weigh(self, index: Index) -> None:
        """Each term's weight from the number of documents that hold it."""
        terms = pa.array(self.terms, pa.string())

        def count(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    found = batch.column("terms")[i].values
                    mine = pc.is_in(found, value_set=terms)
                    columns = [found.filter(mine), batch.column("counts")[i].values.filter(mine).cast(pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["term", "df"])

        rows = index.blocks.select("terms", "counts").mapInArrow(count, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))
        df = {r.term: r.df for r in rows.collect()}
        n = index.documents
        self.weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(t, 0) + 1))) for t in self.terms], np.int64)


class Best:
    """The ``top`` hits of each item that a task has met."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.scores = [np.zeros(0, np.int64) for _ in range(items)]
        self.ids: list[list] = [[] for _ in range(items)]

    def least(self, item: int) -> int:
        """The score that a document must reach to matter."""
        return int(self.scores[item][-1]) if len(self.scores[item]) == self.top else 1

    def add(self, item: int, scores: np.ndarray, ids: list) -> None:
        scores, ids = np.concatenate((self.scores[item], scores)), self.ids[item] + ids
        ordered = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i] is not None, ids[i] or 0))[: self.top]
        self.scores[item], self.ids[item] = scores[ordered], [ids[i] for i in ordered]


def search_block(row: dict, queries: Queries, best: Best) -> None:
    """Visit the strata of a block for each item in the order of their bounds.

    A stratum's bound is what a document with the stratum's highest tf of each of the item's terms would score. The first
    strata that hold ``top`` documents are scored; of the rest only those whose bound reaches the item's least score.
    """
    place = pc.index_in(row["terms"], value_set=pa.array(queries.terms, pa.string())).fill_null(-1).to_numpy()
    counts = row["counts"].to_numpy()
    mine = place >= 0
    if not mine.any():
        return
    term, first = place[mine], (np.cumsum(counts) - counts)[mine]
    at = _stretches(first, counts[mine])
    doc, tf, m = row["doc"].to_numpy()[at], row["tf"].to_numpy()[at].astype(np.int64), row["m"].to_numpy()
    stratum_of = np.cumsum(np.diff(m, prepend=m[0]) != 0)
    n_strata = int(stratum_of[-1]) + 1
    owner, stratum = np.repeat(np.arange(len(term)), counts[mine]), stratum_of[doc]
    new_group = (np.diff(owner, prepend=-1) != 0) | (np.diff(stratum, prepend=-1) != 0)
    new_run = new_group | (np.diff(tf, prepend=-1) != 0)
    run = np.flatnonzero(new_run)
    impact = (1_000_000_000 * tf[run]) // (1000 * tf[run] + 20 * m[doc[run]])  # once per tf of a term and stratum
    value_of_run = queries.weights[term[owner[run]]] * impact
    value = np.repeat(value_of_run, np.diff(np.append(run, len(at))))
    group = np.flatnonzero(new_group)
    size = np.diff(np.append(group, len(at)))
    group_stratum, group_top = stratum[group], value[group]
    group_begin = np.searchsorted(owner[group], np.arange(len(term) + 1))
    where = np.full(len(queries.terms), -1, np.int64)
    where[term] = np.arange(len(term))
    in_stratum = np.bincount(stratum_of, minlength=n_strata)
    ids = row["doc_ids"]

    def total(places, values, n):
        if len(values) * int(values.max(initial=0)) < 1 << 53:  # sums of doubles are exact
            return np.bincount(places, values, n).astype(np.int64)
        sums = np.zeros(n, np.int64)
        np.add.at(sums, places, values)
        return sums

    for item, wanted in enumerate(queries.of):
        own = where[wanted]
        own = own[own >= 0]
        groups = _stretches(group_begin[own], group_begin[own + 1] - group_begin[own])
        if not len(groups):
            continue
        bounds = total(group_stratum[groups], group_top[groups], n_strata)

        def visit(chosen):
            some = groups[chosen[group_stratum[groups]]]
            postings = _stretches(group[some], size[some])
            scores = total(doc[postings], value[postings], len(m))
            least = best.least(item)
            found = np.flatnonzero(scores >= least)
            if len(found) > best.top:  # ties with the last one stay, ids decide among them
                found = found[scores[found] >= np.partition(scores[found], len(found) - best.top)[len(found) - best.top]]
            if len(found):
                best.add(item, scores[found], ids.take(pa.array(found)).to_pylist())

        order = np.argsort(-bounds, kind="stable")
        early = np.zeros(n_strata, bool)
        if len(best.ids[item]) < best.top:
            early[order[: np.searchsorted(np.cumsum(in_stratum[order]), best.top) + 1]] = True
            visit(early)
        late = ~early & (bounds >= best.least(item))
        if late.any():
            visit(late)


def search(index: Index, items: DataFrame, item_col: str = "item_id", text_col: str = "text", top: int = TOP) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of each item with a score above 0, ties by doc_id.

    Items are read by the driver one after another and searched in passes of ``PASS_TERMS`` terms; one pass reads the
    index once, and each of its tasks returns ``top`` rows per item. Their best are taken in two steps, so that no task
    gets an item's rows of all tasks.

    A null item text, or one without a term, has no rows; items that repeat an id are ranked each; null document ids come
    first among equal scores. An empty index or item table gives no rows.
    """
    found = F.array_distinct(F.regexp_extract_all(F.translate(text_of(text_col), UPPER, LOWER), F.lit(TERM), F.lit(0)))
    rows = items.select(F.col(f"`{item_col}`").alias("item_id"), found.alias("terms")).where("size(terms) > 0")
    numbered = write_and_read(rows.withColumn("item", F.monotonically_increasing_id()), "items")

    def passes():
        held, size = [], 0
        for r in numbered.select("item", "terms").toLocalIterator():
            if held and size + len(r.terms) > PASS_TERMS:
                yield held
                held, size = [], 0
            held.append((r.item, r.terms))
            size += len(r.terms)
        if held:
            yield held

    spark, path = items.sparkSession, new_path(items.sparkSession, "hits")
    spark.createDataFrame([], HITS).write.parquet(path)
    for part in passes():
        _hits(index, part, top).write.mode("append").parquet(path)
    hits = spark.read.schema(HITS).parquet(path)
    hits = hits.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(SALT)))
    for group in (["item", "part"], ["item"]):
        order = Window.partitionBy(*group).orderBy(F.desc("score"), F.asc("doc_id"))
        hits = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return hits.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def _hits(index: Index, items: list[tuple[int, list[str]]], top: int) -> DataFrame:
    queries = Queries(items)
    queries.weigh(index)
    shared = index.blocks.sparkSession.sparkContext.broadcast(queries)

    def run(batches):
        queries = shared.value
        best = Best(len(queries.of), top)
        for batch in batches:
            for i in range(batch.num_rows):
                search_block({c: batch.column(c)[i].values for c in batch.schema.names}, queries, best)
        for number, scores, ids in zip(queries.numbers, best.scores, best.ids):
            if len(ids):
                columns = [pa.array([number] * len(ids), pa.int64()), pa.array(ids, pa.int64()), pa.array(scores)]
                yield pa.RecordBatch.from_arrays(columns, names=HITS.names)

    return index.blocks.select("doc_ids", "m", "terms", "counts", "doc", "tf").mapInArrow(run, HITS)


def op11_lexical(spark, sf_dir):
    """Each ``benchmark`` item against all ``documents``."""
    return search(build_index(table(spark, sf_dir)), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
postings AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM postings GROUP BY doc_id),
totals AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM sizes),
norms AS (SELECT doc_id, 50 + (50 * n * big_n) // big_l AS m FROM sizes, totals),
weights AS (SELECT term, floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM postings, totals GROUP BY term, big_n),
items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scores AS (
  SELECT item_id, p.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM items JOIN weights USING (term) JOIN postings p USING (term) JOIN norms USING (doc_id) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 50
"""
