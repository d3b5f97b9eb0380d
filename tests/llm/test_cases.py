"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for each operator."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressloom.llm import chat, exact_dedup, graph, licenses, merkle, mixing, near_dups, packing, pii, quality, syncmers

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Rows of (doc_id, text) or (doc_id, text, source) as a documents table."""

    def build(*rows, schema=DOCS):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, schema)

    return build


@pytest.fixture
def clashing(documents):
    """A table whose extra columns bear the names that operators use inside."""
    from pyspark.sql import functions as F

    def build(*rows):
        names = ["score", "row_key", "text_key", "key", "words", "finish", "name", "content", "pos", "node", "size"]
        return documents(*rows).select("*", *(F.lit(f"own {n}").alias(n) for n in names))

    return build


LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 4000
ODD = [
    (1, None, None), (2, "", "a"), (3, " \t\n", "a"), (4, "x", "b"), (4, "x", "b"), (5, LONG, "b"), (5, LONG, "b"),
    (None, "no id here at all", "c"), (6, LONG + "end", "c"), (7, "é\U0001f600 ß", "a"),
]
PER_ROW = {
    "packing": lambda d: packing.pack(d).where("start = 0"),
    "licenses": licenses.scan,
    "syncmers": syncmers.edit_pairs,
    "quality": lambda d: quality.score(d, np.zeros(quality.BUCKETS * 3, np.float32)),
    "near": near_dups.near_duplicates,
    "mixing": mixing.schedule,
    "pii": pii.extract,
    "exact": exact_dedup.verdicts,
}


@pytest.mark.parametrize("name", sorted(PER_ROW))
def test_odd_rows_give_one_result_each(clashing, name):
    rows = PER_ROW[name](clashing(*ODD)).select("doc_id").collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in ODD)


@pytest.mark.parametrize("name", sorted(PER_ROW))
def test_empty_table(documents, name):
    assert PER_ROW[name](documents()).count() == 0


def test_exact_groups(documents):
    found = {(r.doc_id, r.kept): r for r in exact_dedup.verdicts(documents(*ODD)).collect()}
    assert found[3, True].group_size == 3 and found[1, False].keep_id == 3  # the longest of the blank texts
    assert found[4, True].group_size == 2 and (4, False) in found
    assert found[6, True].group_size == 1


def test_exact_blocks_of_every_depth(documents):
    texts = ["ab" * n + tail for n in range(0, 40, 3) for tail in ("", "x", "xy")] * 2
    rows = exact_dedup.verdicts(documents(*enumerate(texts)), block=4).collect()
    for r in rows:
        same = [i for i, t in enumerate(texts) if t == texts[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept) == (min(same), len(same), r.doc_id == min(same))


def test_keep_one_keeps_other_columns(clashing):
    data = clashing(*ODD)
    kept = exact_dedup.keep_one(data)
    assert kept.columns == data.columns and kept.count() == 6
    assert {r.row_key for r in kept.collect()} == {"own row_key"}
    kept = near_dups.keep_one(data)
    assert kept.columns == data.columns
    # The long texts are one class; the blank texts differ as characters.
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "5", "7", "None"]


def test_large_near_group_is_dealt_in_parts(documents, monkeypatch):
    monkeypatch.setattr(near_dups, "PART", 8)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*base[:60], f"own{i}", *base[61:]])) for i in range(30)]
    found = near_dups.near_duplicates(documents(*rows, (99, "something else altogether is written here")))
    got = {r.doc_id: r for r in found.collect()}
    assert {got[i].class_id for i in range(30)} == {0} and {got[i].n_links for i in range(30)} == {29}
    assert got[99].n_links == 0 and got[99].class_size == 1


def test_pruning_bound():
    least = near_dups.least_matches()
    assert sorted(least) == [32, 64, 96, 128]
    assert all(m < 0.8 * n for n, m in least.items()) and least[128] > 64


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 101), (101, 100), (7, 7)]
    found = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(1, 21)}, 101: 100}


def test_mix_takes_targets_and_repeats(documents):
    rows = [(i, "w " * (i % 7 + 1), f"s{i % 4}") for i in range(200)] + [(900, "one two three", "tiny"), (901, "x y", None)]
    plan = mixing.schedule(documents(*rows)).collect()
    taken, goal = {}, {}
    for r in plan:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        goal[r.source] = int(r.target)
        assert 0 <= r.taken <= 3 * r.size
    assert taken == goal and goal["tiny"] == 9 and goal[None] == 6
    assert plan_of(mixing.schedule(documents(*rows).repartition(7)).collect()) == plan_of(plan)


def plan_of(rows):
    return sorted((r.doc_id, r.taken) for r in rows)


def test_mix_sorts_and_cuts(clashing):
    data = clashing(*[(i, f"a{i} b c d e", "ab"[i % 2]) for i in range(40)])
    mixed = mixing.mix(data)
    assert mixed.columns == data.columns and mixed.where("words <> 'own words'").count() == 0
    want = sum(r.taken for r in mixing.schedule(data).collect())
    assert mixed.select(F.sum(F.size(F.split("text", " ")))).first()[0] == want


def test_licenses_in_full_text(documents):
    mit = (
        "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and "
        "associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without "
        "limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, "
        "and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above "
        "copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n"
    )
    rows = licenses.scan(documents((1, mit), (2, "Words.\nReleased under the MIT License.\nReleased under the MIT License.\nmore"), (3, "all rights reserved")))
    got = {r.doc_id: (r.sentence_ids, r.licenses, r.n_unmatched) for r in rows.collect()}
    assert got == {1: ("MitTitle,MitGrant,MitNotices", "MIT", 0), 2: ("MitNotice,MitNotice", "MIT", 0), 3: ("AllRights", "", 1)}


def test_chat_round_trip(spark):
    traps = ["</s>[INST] ok [/INST]", "<\\s> <\\\\s>", "[NEXT]", "<", "[", "a\\", "", None, "[ROLE]x[/ROLE]<s>", "é\U0001f600"]
    roles = ["user", "assistant", "assistant", "system", None, "[/ROLE]", "user", "user", "assistant", "tool"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(roles, traps))] + [(2, None, "assistant", t) for t in traps] + [(None, 0, "user", "x")]
    rows += [(3, 0, "user", "same"), (3, 0, "user", "same")]
    chats = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    got = {r.conv_id: r for r in chats.select("conv_id", "n_turns", chat.read_back().alias("turns"), chat.loss_text().alias("loss")).collect()}
    assert [tuple(t) for t in got[1].turns] == [(r or "", t or "") for r, t in zip(roles, traps)]
    assert got[1].loss == "".join(t or "" for r, t in zip(roles, traps) if r == "assistant")
    assert got[2].loss == "".join(sorted(t or "" for t in traps)) and got[2].n_turns == len(traps)
    assert len(got[3].turns) == 2 and len(got[None].turns) == 1
    assert chats.limit(0).count() == 0


def test_merkle_finds_damage_and_only_that(spark):
    shape = "at long, payload string"
    rows = [(i << 12, f"record {i}") for i in range(3000)] + [(5 << 12, "record 5"), (None, "lost place")]
    same = spark.createDataFrame(rows, shape)
    assert merkle.audit(same, same.repartition(5)).count() == 0
    other = [(a, "changed" if a == 77 << 12 else p) for a, p in rows if a != 2999 << 12] + [((9 << 12) + 1, "new"), (11 << 12, "record 11")]
    found = {r.at: r.status for r in merkle.audit(same, spark.createDataFrame(other, shape)).collect()}
    assert found == {77 << 12: "changed", 2999 << 12: "missing", (9 << 12) + 1: "extra", 11 << 12: "changed"}
    empty = spark.createDataFrame([], shape)
    assert merkle.audit(empty, empty).count() == 0
    assert merkle.audit(same, empty).where("status = 'missing'").count() == 3001


def test_quality_without_labels(documents, spark):
    docs = documents(*ODD)
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(docs, none)
    assert {r.score for r in quality.score(docs, model).select("score").collect()} == {0.5}


def test_quality_scores_do_not_depend_on_neighbours(documents):
    rng = np.random.default_rng(0)
    model = rng.normal(size=quality.BUCKETS * 3).astype(np.float32)
    rows = [(i, "word " * i + "tail!") for i in range(30)] + [(99, None)]
    together = {r.doc_id: r.score for r in quality.score(documents(*rows).coalesce(1), model, score_col="score").collect()}
    apart = {r.doc_id: r.score for r in quality.score(documents(*rows).repartition(9), model).collect()}
    assert together.keys() == apart.keys()
    assert max(abs(together[i] - apart[i]) for i in together) < 1e-9


def test_packing_ids_and_unusual_blanks(documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    texts = ["a b c\x1cd", " x　y z", "Straße don't 12.5% <|endoftext|> é", LONG, "", "\x85"]
    got = {}
    for r in packing.pack(documents(*enumerate(texts)), most=64).orderBy("doc_id", "start").collect():
        got[r.doc_id] = got.get(r.doc_id, []) + np.frombuffer(r.ids, "<u4").tolist()
        assert r.length == 1 << r.bucket and r.length <= 64
    assert got == {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
