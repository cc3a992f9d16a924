import random

import pytest

from vellumspark.llm import subjects as S

WORDS = {"law": "court judge tenant lease statute verdict appeal".split(), "music": "melody octave chorus tempo violin sonata chord".split(), "soil": "herd barn plough harvest fodder silo weed".split()}
FRAME = ["the {0} gives every {1} to the {2} again", "some {0} need the {1} and others a {2}", "when the {0} is common the {1} meets a {2} first"]


def document(rng, names, n=8):
    return " ".join(rng.choice(FRAME).format(*rng.sample(WORDS[names[k % len(names)]], 3)).capitalize() + "." for k in range(n))


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(1)
    docs, labels, truth = [], [], {}
    for i in range(240):
        names = rng.sample(sorted(WORDS), 2 if i % 5 == 0 else 1)
        truth[i] = set(names)
        docs.append((i, document(rng, names), "clash", 1.0))
        if i < 150:
            labels += [(i, n if rng.random() > 0.04 else "law", "a1", None) for n in names] * (1 + i % 2)
    docs += [(900, None, "", 0.0), (901, "", "", 0.0), (902, "Names, 1\nOthers, 22", "", 0.0), (903, document(rng, ["music"], 30_000), "", 0.0)]
    return (
        spark.createDataFrame(docs, "doc_id bigint, text string, subject string, share double"),
        spark.createDataFrame(labels, "doc_id bigint, subject string, annotator string, loaded_at timestamp"),
        spark.createDataFrame([(n, n.title(), f"Texts on {WORDS[n][0]} and related matters.") for n in WORDS], "subject string, title string, scope_note string"),
        truth,
    )


def test_held_out_accuracy(tables):
    docs, labels, subjects, truth = tables
    got: dict = {}
    for r in S.subjects_of(docs, "doc_id", "text", labels, subjects).collect():
        got.setdefault(r["id"], set()).add(r["subject"])
    assert sum(got.get(i, set()) == truth[i] for i in range(150, 240)) >= 86
    assert got[903] == {"music"} and not {900, 901, 902} & set(got)


def test_composition(tables, spark):
    docs, labels, subjects, _ = tables
    found = S.subjects_of(docs, "doc_id", "text", labels, subjects)
    rows = S.composition(found, docs, "doc_id", "subject").collect()
    assert {r["source"] for r in rows} == {"clash", ""} and any(r["subject"] is None for r in rows)


def test_without_labels(tables):
    docs, labels, subjects, _ = tables
    lexicon = S.learn(docs, "doc_id", "text", labels.where("false"), subjects)
    assert lexicon.threshold == pytest.approx(1 / 6) and "court" in lexicon.weights
    assert S.shares(docs.where("false"), "doc_id", "text", lexicon, lexicon.thresholds()).count() == 0


def test_sample_is_bounded(tables):
    docs, labels, *_ = tables
    assert S.labelled_sample(docs, "doc_id", "text", labels, 20).count() == 20


def test_thresholds_of_subjects():
    labels = {i: {"a"} if i % 2 else {"b"} for i in range(200)}
    rows = [(i, "a", 0.3 if i % 2 else 0.15) for i in range(200)] + [(i, "b", 0.1 if i % 2 == 0 else 0.05) for i in range(200)]
    overall, (a, b, c) = S.calibrate(rows, labels, ["a", "b", "c"])
    assert 0.15 < a <= 0.2 and b <= 0.1 and c == overall
    assert S.calibrate([], {}, ["a"]) == (1 / 6, [1 / 6])
