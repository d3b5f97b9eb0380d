"""Registered queries against SQL and against plain Python over the whole smallest tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import oracle_check
import pytest

from pressloom.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name, monkeypatch):
    monkeypatch.setattr(oracle_check, "QUERIES", QUERIES)
    monkeypatch.setattr(oracle_check, "ORACLES", ORACLES)
    assert oracle_check.compare(spark, oracle_check.connect(SMALL), name, SMALL) is None


def test_every_operator_has_its_query():
    assert {n.split("_")[0] for n in QUERIES} == {"pipeline", *(f"op{i}" for i in range(1, 14))}


def test_packing_against_the_tokenizer(spark, docs):
    from tokenizers import Tokenizer

    from pressloom.llm.packing import binary_lengths, default_vocabulary

    tokenizer = Tokenizer.from_file(default_vocabulary())
    pieces = defaultdict(list)
    rows = QUERIES["op2_packing"](spark, SMALL).collect()
    for r in rows:
        pieces[r.doc_id].append(r)
    assert len({r.sequence_id for r in rows}) == len(rows) and {r.offset for r in rows} == {0}
    assert pieces.keys() == docs.keys()
    for doc_id, text in docs.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        own = sorted(pieces[doc_id], key=lambda r: r.start)
        assert [r.length for r in own] == binary_lengths(len(ids))
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]]
        for r in own:
            assert r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())


def brute_classes(docs):
    """(class of each text by links at 0.8 or more, links between different shingle sets)."""
    word = re.compile(r"[0-9a-z_\x80-\U0010ffff]+")
    sets = {}
    for i, text in docs.items():
        w = word.findall(text.lower())
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset([text])
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    having = defaultdict(list)
    for s, i in first.items():
        for x in s:
            having[x].append(i)
    up = {i: first[sets[i]] for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    links = Counter()
    for s, i in first.items():
        for j, both in Counter(j for x in s for j in having[x] if j > i).items():
            if both >= 0.8 * (len(s) + len(sets[j]) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: top(i) for i in sets}, {i: links[first[sets[i]]] for i in sets}


def test_near_duplicates_against_all_pairs(spark, docs):
    rows = QUERIES["op6_near_duplicates"](spark, SMALL).collect()
    classes, links = brute_classes(docs)
    assert {r.doc_id: r.class_id for r in rows} == classes
    assert {r.doc_id: r.n_links for r in rows} == links
    assert sum(r.stays for r in rows) == len(set(classes.values()))


def test_syncmers_edit_and_likeness(spark, docs):
    rows = QUERIES["op4_syncmers"](spark, SMALL).collect()
    order = sorted(docs, reverse=True)
    after = dict(zip(order, [*order[1:], order[0]]))
    by_text = {}
    for r in rows:
        text, follow = docs[r.doc_id], docs[after[r.doc_id]]
        n = len(text) // 3
        edited = text[: len(text) - n] + follow[:n]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert len(rows) == len(docs)
    assert np.mean([r.near_edited for r in rows]) > 0.4 > 0.1 > np.mean([r.near_next for r in rows])


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    def passes(kind, found):
        digits = re.sub("[^0-9]", "", found)
        if kind == "ip":
            return all(int(x) <= 255 for x in found.split("."))
        if kind == "card":
            doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            return 14 <= len(digits) <= 19 and sum(n - 9 if n > 9 else n for n in doubled) % 10 == 0
        return kind == "email" or 10 <= len(digits) <= 15

    return sorted(
        (m.start(), i, m.end(), k) for i, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, text) if passes(k, m.group())
    )


def test_pii_base_spans(spark, docs):
    for r in QUERIES["op8_pii"](spark, SMALL).collect():
        want = ",".join(f"{k}:{a}:{b}" for a, _, b, k in base_spans(docs[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
        assert len(r.spans.split(",")) - (r.spans == "") == r.n_email + r.n_ip + r.n_card + r.n_phone + r.n_added


def test_pii_base_patterns_keep_the_contract(spark):
    from pressloom.llm.pii import extract

    texts = [
        "a@b.com_foo@x.yz a..b@c.d-e.f @x.y a@b a@b.", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4 1.2.3",
        "4111 1111 1111 1111 5500-0000-0000-0004x 41111111111111111111",
        "+1 (234) 555-1234 +1--- +123 +12345678901) é +44 20 7946 0958.", "ééééx@y.zz \U0001f600 a@b.cc", None, "",
        "1" * 5000 + " " + "a" * 5000 + "@x.y " + "1 " * 3000,
    ]
    rows = extract(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: [tuple(s) for s in r.base] for r in rows} == {i: base_spans(t or "") for i, t in enumerate(texts)}


def test_pii_patterns_find_what_the_base_misses(spark):
    from pressloom.llm.pii import extract

    rows = [(i, f"Please call us at +1 (234) 555-{1000 + i} today.") for i in range(12)]
    rows += [(100, "Please call us at 234 555 7777 today."), (101, "Room numbers are 234 555 7777 888 here")]
    found = extract(spark.createDataFrame(rows, "doc_id long, text string")).where("size(added) > 0").collect()
    assert [(r.doc_id, [tuple(s) for s in r.added]) for r in found] == [(100, [(18, 3, 30, "phone")])]


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = QUERIES["op5_quality"](spark, folder).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    judged = [r.predicted == labels[r.doc_id] for r in rows if r.held_out and r.doc_id in labels]
    assert len(judged) > 100 and np.mean(judged) > 0.97


def test_pipeline_against_plain_steps(spark, docs):
    """Each stage on what the one before kept; the classifier's decisions are taken as they are."""
    import corpus_pipeline

    start = spark.read.parquet(f"{SMALL}/documents.parquet")
    good = corpus_pipeline.quality_classifier(spark, start, SMALL)
    texts = {r.doc_id: r.text for r in good.collect()}
    assert texts.items() <= docs.items()

    unique = corpus_pipeline.exact_duplicates(spark, good, SMALL)
    groups = defaultdict(list)
    for i, t in texts.items():
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), i))
    want = {min(g)[1] for g in groups.values()}
    assert sorted(r.doc_id for r in unique.collect()) == sorted(want)

    apart = corpus_pipeline.near_duplicates(spark, unique, SMALL)
    classes, _ = brute_classes({i: texts[i] for i in want})
    assert sorted(r.doc_id for r in apart.collect()) == sorted(set(classes.values()))

    mixed = corpus_pipeline.mix_sources(spark, apart, SMALL)
    assert mixed.columns == start.columns
    words = Counter()
    for r in mixed.collect():
        words[r.source] += len(r.text.split())
    from pressloom.llm.mixing import schedule

    goals = {r.source: int(r.target) for r in schedule(apart).select("source", "target").distinct().collect()}
    assert words == goals
