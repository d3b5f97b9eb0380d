"""Patterns of one word and of line starts, the scores against plain Python, and texts with very many matches."""

import math
import time

import pytest

from pressloom.llm import pii


def added(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["added"]] for r in pii.extract(docs).collect()}


def test_labels_at_the_start_of_texts_and_lines(spark):
    seeds = [f"Tel: +1 (234) 555-{i:04d}" for i in range(200)]
    cases = ["Tel: 234 555 7777", "Smith Ltd\nTel: 234 555 7778\nopen daily", "ask for us, tel: 234 555 7779 or write", "order 234 555 7780 came", "234 555 7781"]
    found = added(spark, seeds + cases)
    assert [found[200 + i] for i in range(5)] == [[("phone", 5, 17)], [("phone", 15, 27)], [("phone", 17, 29)], [], []]
    assert not any(found[i] for i in range(200))


def test_patterns_of_an_occurrence(spark):
    rows = spark.createDataFrame([("Our mail: ", " today"), ("x\n", "\ny"), ("one two\nTel. ", ""), ("", " now")], "b string, a string")
    got = [r[0] for r in rows.select(pii._context(rows.b, rows.a)).collect()]
    assert got == [["mail: _", "our mail _", "mail _ today"], [], [], []]
    # A word without a mark is no label, however often identifiers follow it; and failed checksums are never found.
    texts = [f"the +1 (234) 555-{i:04d}" for i in range(50)] + ["the 234 555 7777"] + [f"Card: {4000000000000000 + 10 * i + luhn(400000000000000 + i)}" for i in range(50)]
    found = added(spark, texts + ["Card: 4000000000000001"])
    assert not any(found.values())


def luhn(number):
    """The last digit that makes ``number`` with it pass."""
    twice = [int(d) * (2 if i % 2 == 0 else 1) for i, d in enumerate(reversed(str(number)))]
    return -sum(t - 9 if t > 9 else t for t in twice) % 10


def brute_scores(edges, rounds, refuted):
    score = {(k, i): 1.0 if s else 0.0 for k, i, p, s in edges}
    seeded = {(k, i) for k, i, p, s in edges if s}
    for _ in range(rounds):
        trust = {}
        for k, p in {(e[0], e[2]) for e in edges}:
            mine = [(e[0], e[1]) for e in edges if (e[0], e[2]) == (k, p)]
            if sum(m in seeded for m in mine) >= pii.SEEDS:
                trust[k, p] = min(sum(score[m] for m in mine) / (len(mine) + pii.SMOOTHING), 0.999)
        best = {}
        for k, i, p, s in edges:
            if not s and i not in refuted and (k, p) in trust:
                best.setdefault((k, i), []).append(trust[k, p])
        for m in score:
            if m not in seeded:
                score[m] = 1 - math.prod(1 - t for t in best[m]) if m in best else 0.0
    return {m for m, t in best.items() if score[m] >= pii.BELIEVED and max(t) >= pii.BELIEVED}


def test_scores_against_plain_python(spark):
    edges = [("phone", f"s{i}", p, True) for i in range(40) for p in ("tel _", "call _", "id _") if (i * 7 + len(p)) % 3]
    refuted = {f"u{i}" for i in range(0, 30, 7)}
    edges += [("phone", f"u{i}", p, False) for i in range(30) for j, p in enumerate(("tel _", "call _", "id _")) if (i + j) % (4 + 9 * (j == 0)) == 0]
    graph = spark.createDataFrame([(*e, e[1] not in refuted) for e in edges], "kind string, instance string, pattern string, seed boolean, possible boolean")
    for rounds in (1, 2, 4):
        assert {tuple(r) for r in pii.believed(graph, rounds).collect()} == brute_scores(edges, rounds, refuted)


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 300])
def test_places_over_several_chunks(spark, n):
    text = " ".join(f"é a{i}@b.co" for i in range(n)) + " end 123 456 7890 and 10.0.0.1"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = pii.occurrences(docs).first()
    assert [text[m["start"]:m["end"]] for m in row["base"]] == [f"a{i}@b.co" for i in range(n)] + ["10.0.0.1"]
    assert [text[m["start"]:m["end"]] for m in row["others"]] == ["123 456 7890"]


def test_many_matches_in_one_text(spark):
    text = " ".join(f"a{i}@b.co" for i in range(16_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    pii.occurrences(docs.limit(0)).collect()
    start = time.time()
    assert len(pii.occurrences(docs).first()["base"]) == 16_000
    assert time.time() - start < 30
