"""Lexical search, BPE and collocations against brute force, and on odd rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressloom.llm import bpe, collocations, lexical
from pressloom.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 4000


@pytest.fixture
def documents(spark):
    """Rows of (doc_id, text[, lang]) as documents with extra columns whose names operators use inside."""

    def build(*rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", 0) for r in rows]
        names = ["chunk", "core", "f", "m", "n", "place", "terms", "ids", "phrase", "item", "rank", "score"]
        return spark.createDataFrame(full, DOCS).select("*", *(F.lit(f"own {n}").alias(n) for n in names))

    return build


# --- search -------------------------------------------------------------------------------------------------------


def ranked(docs, items, top):
    """Plain Python over (doc_id, text) and (item_id, text)."""
    def terms(text):
        return re.findall(lexical.TERM, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))

    found = [(i, Counter(terms(t))) for i, t in docs]
    found = [(i, c) for i, c in found if c]
    n, size = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        weights = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in set(terms(text)) if df[t]}
        scored = []
        for i, c in found:
            m = 50 + 50 * sum(c.values()) * n // size
            score = sum(w * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t, w in weights.items() if c[t])
            if score > 0:
                scored.append((-score, i is not None, i or 0))
        out += [(item, rank, i if known else None, -s) for rank, (s, known, i) in enumerate(sorted(scored)[:top], 1)]
    return out


def found_rows(frame):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in frame.collect()), key=str)


WORDS = ["a", "of", "the", "Zoë", "été", "x1", "blue", "green", "red", "rain", "sun"]


@pytest.mark.parametrize("block", [200, 5_000, lexical.BLOCK])
def test_search_equals_scoring_every_document(spark, documents, block):
    rng = random.Random(block)
    docs = [(i, " ".join(rng.choices(WORDS, range(11, 0, -1), k=rng.randint(0, 30)))) for i in range(400)]
    docs += [(7, docs[3][1]), (None, "blue Rain_rain"), (None, "sun"), (900, None), (901, ""), (902, "!? ..."), (903, LONG + "rain")]
    items = [(1, "Blue rain, the sun"), (2, "nothing-known here"), (3, "a a a A"), (3, "été Zoë"), (4, None), (None, "red"), (5, "\x00 ")]
    index = lexical.build_index(documents(*docs), block=block)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert found_rows(lexical.search(index, asked, top=20)) == sorted(ranked(docs, items, 20), key=str)


def test_search_in_several_passes_and_from_a_written_index(spark, documents, monkeypatch, tmp_path):
    docs = [(i, " ".join(WORDS[: i % 11 + 1])) for i in range(60)]
    items = [(i, " ".join(WORDS[i : i + 4])) for i in range(8)]
    lexical.build_index(documents(*docs)).write(str(tmp_path / "index"))
    monkeypatch.setattr(lexical, "PASS_TERMS", 9)
    index = lexical.Index.read(spark, str(tmp_path / "index"))
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert found_rows(lexical.search(index, asked, top=5)) == sorted(ranked(docs, items, 5), key=str)


def test_equal_normalisers_lie_together(documents):
    index = lexical.build_index(documents(*[(i, "w " * (i % 5 + 1)) for i in range(300)]), block=100)
    rows = index.blocks.orderBy("slot").collect()
    assert all(list(r.m) == sorted(r.m) for r in rows) and sum(len(r.doc_ids) for r in rows) == 300
    order = [m for r in rows for m in r.m]
    assert order == sorted(order) and len(rows) > 5


def test_strata_below_the_threshold_are_not_scored(documents, monkeypatch):
    """Documents of rising length that hold the term once: only the shortest can be among the best."""
    docs = [(i, "rain" + " filler" * i) for i in range(200)]
    row = lexical.build_index(documents(*docs)).blocks.collect()
    scored = []
    real = np.bincount

    def counted(places, weights=None, minlength=0):
        if weights is not None:
            scored.append(len(places))
        return real(places, weights, minlength)

    queries = lexical.Queries([(0, ["rain"])])
    queries.weights[:] = 1000
    best = lexical.Best(1, 5)
    monkeypatch.setattr(lexical.np, "bincount", counted)
    import pyarrow as pa

    for r in sorted(row, key=lambda r: r.slot):
        kinds = {f.name: f.dataType.elementType.typeName() for f in lexical.BLOCKS.fields[1:]}
        types = {"long": pa.int64(), "integer": pa.int32(), "string": pa.string()}
        lexical.search_block({c: pa.array(r[c], types[k]) for c, k in kinds.items()}, queries, best)
    assert sorted(best.ids[0]) == [0, 1, 2, 3, 4]
    strata = len({m for r in row for m in r.m})
    assert sum(scored) < strata + 60  # bounds of all strata, few postings


def test_search_empty_tables(spark, documents):
    none = lexical.build_index(documents())
    asked = spark.createDataFrame([(1, "rain")], "item_id long, text string")
    assert lexical.search(none, asked).count() == 0
    some = lexical.build_index(documents((1, "rain")))
    assert lexical.search(some, asked.where("false")).count() == 0


# --- BPE ----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(bpe.default_vocabulary())
    own.no_truncation()
    own.no_padding()
    return own


def test_bpe_query_equals_the_tokenizer(spark, tokenizer):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = QUERIES["op12_bpe"](spark, SMALL).collect()
    assert {r.doc_id for r in rows} == docs.keys() and len(rows) == len(docs)
    for r in rows:
        ids = tokenizer.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_of_odd_texts(documents, tokenizer):
    rng = random.Random(5)
    letters = [*"ab's,. \n\t\r_'LL<", *map(chr, (0, 28, 31, 133, 160, 178, 189, 769, 8203, 8195, 5760, 8232, 8545, 12288, 28450, 128512))]
    letters += [" ", "<|endoftext|>", " the", " don't", "'re"]
    texts = [None, "", " ", "  a", "a  ", "<|endoftext|>", "x<|endoftext|>  <|endoftext|>y", LONG, "".join(rng.choices("abcdefgh", k=20_000))]
    texts += ["".join(rng.choices(letters, k=rng.randint(1, 16))) for _ in range(1500)]
    rows = bpe.decode(bpe.encode(documents(*enumerate(texts), (None, "no id"), (3, "again")))).collect()
    got = {r.doc_id: r for r in rows[: len(texts)]}
    for i, text in enumerate(texts):
        same = [r for r in rows if r.doc_id == i]
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert ids in [list(r.ids) for r in same], (i, text)
        assert got[i].text == tokenizer.decode(got[i].ids, skip_special_tokens=False)
    assert len(rows) == len(texts) + 2
    assert bpe.encode(documents()).count() == 0


def test_bpe_decodes_any_ids(spark, tokenizer):
    rng = random.Random(1)
    ids = [[rng.randrange(50257) for _ in range(rng.randint(0, 12))] for _ in range(400)]
    rows = bpe.decode(spark.createDataFrame([*enumerate(ids), (-1, None)], "doc_id long, ids array<int>")).collect()
    got = {r.doc_id: r.text for r in rows}
    assert got.pop(-1) == "" and got == {i: tokenizer.decode(x, skip_special_tokens=False) for i, x in enumerate(ids)}


def test_the_root_is_the_leftmost_lowest_pair():
    rng = random.Random(2)
    for size in (1, 2, 3, 7, 8, 9, 40):
        ranks = [rng.randrange(6) for _ in range(size)]
        tree = bpe.PairTree([min(r, 5) for r in ranks], 5)
        for _ in range(60):
            best = min(ranks)
            assert tree.lowest() == (ranks.index(best) if best < 5 else -1)
            place, rank = rng.randrange(size), rng.randrange(6)
            ranks[place] = rank
            tree.put(place, rank)


def test_bpe_memory_is_bounded_and_changes_nothing(tokenizer):
    own = bpe.Encoder(bpe.default_vocabulary())
    own.known = bpe.Known(own.merges, 20_000)
    rng = random.Random(3)
    for _ in range(300):
        text = " ".join("".join(rng.choices("abcdef", k=rng.randint(1, 8))) for _ in range(20)) + " " + "q" * 500
        assert np.frombuffer(own.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert len(own.known) + len(own.known.old) < 130 and "q" * 500 not in own.known


# --- collocations -------------------------------------------------------------------------------------------------


def plain_collocations(rows, longest, least, top):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for n in range(1, longest + 1):
                counts.update((lang, tuple(words[i : i + n])) for i in range(len(words) - n + 1))
    often = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    found = {}
    for (lang, p), a in often.items():
        score, k = min((10**6 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p)))
        inside = (b for (g, q), b in often.items() if g == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))))
        if all(100 * b < 50 * a for b in inside):
            found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    return sorted(
        (lang, i, p.decode(), -a, left, right, totals[lang], -score)
        for lang, rows in found.items() for i, (score, a, p, left, right) in enumerate(sorted(rows)[:top], 1)
    )


@pytest.mark.parametrize("longest", [2, 3, 5])
@pytest.mark.parametrize("trigger", [1, 2, 16])
def test_collocations_equal_plain_counting(documents, trigger, longest):
    rng = random.Random(trigger)
    rows = [(" ".join(rng.choices(["New", "york", "a\tb", "é", "c", "C.", "x,", "und\n", "d"], k=rng.randint(0, 25))), rng.choice(["en", "fr", None])) for _ in range(120)]
    rows += [(None, "en"), ("", None), (LONG, "xx"), ("New york city " * 9, "en"), ("one", "un"), (" . ", "")] + [("same line again and again", "en")] * 15
    data = documents(*[(i if i % 9 else None, t, g) for i, (t, g) in enumerate(rows)])
    got = collocations.collocations(data, longest=longest, least=4, top=60, trigger=trigger).collect()
    want = plain_collocations(rows, longest, 4, 60)
    assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got) == want


def test_each_occurrence_lies_in_one_chunk(documents):
    rows = [(i, "the quick brown fox jumps over the lazy dog and runs away from it " * 3) for i in range(5)]
    chunks = collocations.parse(documents(*rows), trigger=3).collect()
    assert sum(r.core * r.f for r in chunks) == 5 * 42
    assert max(r.f for r in chunks) >= 10 and all(r.core <= len(r.chunk.split(" ")) <= r.core + 2 for r in chunks)


def test_collocation_counts_beyond_64_bits(spark, monkeypatch):
    big = 4_000_000_000
    chunks = spark.createDataFrame([("en", "new york", 2, big), ("en", "new", 1, 7)], collocations.CHUNKS)
    monkeypatch.setattr(collocations, "parse", lambda *a: chunks)
    row = collocations.collocations(chunks, least=1).collect()[0]
    assert (row.a, row.l, row.r, row.n, row.score) == (big, big + 7, big, 2 * big + 7, 10**6 * big * big // ((big + 7) * big))


def test_collocations_of_an_empty_table(documents):
    assert collocations.collocations(documents()).count() == 0
