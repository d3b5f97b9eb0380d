"""Answers that are kept: one model call per distinct prompt, and a job that goes on where it was ended."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pressloom.functions import fixed_values as V
from pressloom.operators import generate
from pressloom.operators.generate import generate_batch, generate_once

SCHEMA = "id int, prompt_text string, generated_text string"


def recorder(log, fails_at=None):
    """A model that notes every prompt it is asked, and fails at one of them."""

    def factory():
        def model(texts):
            with open(log, "a") as f:
                for t in texts:
                    if t == fails_at:
                        raise RuntimeError("the model is gone")
                    f.write(t + "\n")
            return [t.upper() for t in texts]

        return model

    return factory


def calls(log):
    return Counter(log.read_text().splitlines())


@pytest.fixture(scope="module")
def asked(spark):
    rows = [(i, f"prompt {i % 40}" if i % 3 else "the same prompt", "of the input") for i in range(300)] + [(300, None, None), (301, "", None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_each_prompt_is_asked_once(spark, asked, tmp_path):
    log, path = tmp_path / "calls", str(tmp_path / "answers")
    made = generate_once(asked, path, factory=recorder(log))
    assert made.columns == asked.columns
    assert {(r.id, r.generated_text) for r in made.collect()} == {
        (r.id, (r.prompt_text or "").upper()) for r in asked.collect()
    }
    assert set(calls(log).values()) == {1} and len(calls(log)) == asked.select(F.coalesce("prompt_text", F.lit(""))).distinct().count()
    more = asked.unionByName(spark.createDataFrame([(302, "a new one", None)], SCHEMA))
    again = tmp_path / "again"
    assert generate_once(more, path, factory=recorder(again)).count() == 303
    assert calls(again) == {"a new one": 1}


def test_a_job_that_was_ended_goes_on(spark, asked, tmp_path):
    log, path = tmp_path / "calls", str(tmp_path / "answers")
    with pytest.raises(Exception, match="the model is gone"):
        generate_once(asked, path, factory=recorder(log, fails_at="prompt 17"), parts=8)
    kept = spark.read.parquet(path).count()
    wanted = asked.select(F.coalesce("prompt_text", F.lit(""))).distinct().count()
    assert 0 < kept < wanted
    rest = tmp_path / "rest"
    made = generate_once(asked, path, factory=recorder(rest), parts=8)
    assert sum(calls(rest).values()) == wanted - kept and set(calls(rest).values()) == {1}
    plain = generate_batch(asked, factory=recorder(tmp_path / "plain"))
    assert {(r.id, r.generated_text) for r in made.collect()} == {
        (r.id, r.generated_text) for r in plain.collect()
    }


def test_no_rows_no_calls(spark, asked, tmp_path):
    log = tmp_path / "calls"
    assert generate_once(asked.limit(0), str(tmp_path / "answers"), factory=recorder(log)).collect() == []
    assert not log.exists()


def test_central_sentence_scores_as_if_every_text_were_tokenised_by_itself():
    """The words of a sentence are looked for once; final sigmas and labels must not change what is counted."""
    ignored = set(generate.prompt_words())
    words = lambda text: [w for w in re.findall(r"\w{2,}", text.lower()) if w not in ignored]

    def plain(prompt):
        counts, best, best_score = Counter(words(prompt)), "", 0
        for line in prompt.split("\n"):
            if not re.search(V.META_LINE, line):
                for sentence in re.findall(V.SENTENCE, re.sub(V.ARTICLE_LABEL, "", line)):
                    score = sum(counts[w] for w in set(words(sentence)))
                    if score > best_score:
                        best, best_score = sentence, score
        return re.sub(r"\s+", " ", best).strip()

    rng = random.Random(5)
    parts = ["alpha", "Beta", "ΟΔΟΣ", "ΟΔΟΣ.Α", "İstan", "x", "the", ". ", "! ", "\n", "\nHeadline: ", "\nTone: ", "\nBody: ", "gamma_1", "?", "Body"]
    texts = ["", "...", *(" ".join(rng.choices(parts, k=rng.randint(1, 40))) for _ in range(500))]
    assert generate.central_sentence()(texts) == [plain(t) for t in texts]
