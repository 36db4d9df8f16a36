import random

import numpy as np
import pytest

from ledgerloom.llm.residue import DIMENSIONS, Classifier, labelled_sample, quotes_removed, residue, segments, train, validation, weak_label

POSITIVE = [
    "The motion on {{DEADLINE}} was lost by __vote_count__ votes.", "I call on ${member_name} to reply.", "My colleague [object Object] asked.", "Speaker: [INSERT name]", "Dear <#MINISTER#>, thank you.",
    "Lorem ipsum dolum ametro conset tincid.", "qwer qwer qwer qwer qwer qwer", "Text to follow.", "Error 404", "The page could not be loaded.", "La page demandée est introuvable.",
    "Please enable JavaScript to read this.", "Veuillez activer JavaScript pour lire ce compte rendu.", '{"status": 502, "error": "Bad Gateway"}', "Das Wort hat %MINISTER%.", "The %s previous sitting.",
]
NEGATIVE = [
    "Order. The member will be heard.", "Why must a pensioner enable JavaScript to download a tax form?", "Last week the ministry portal answered every citizen with error 503, page not found.",
    'I quote from the contract: "the sum of ${bill_title} shall be paid".', "The undefined term in clause 26 is a gift to lawyers, and null and void.", "One hundred % of nothing is nothing, and 41 % of it is no better.",
    "The bill in square brackets [see annex 77] and the sum of $77 million {as amended} stand as printed.", "(Applause)", "(inaudible)", "—", "Die Sitzung ist für 83 Minuten unterbrochen.",
    "The clerk showed us a draft with filler text, a so-called lorem ipsum, where the clause should have been.", "Access denied: that is what the families heard at counter 35.",
]


@pytest.mark.parametrize("text", POSITIVE)
def test_weak_positives(text):
    assert any(weak_label(s) == 1 for s in segments(text))


@pytest.mark.parametrize("text", NEGATIVE)
def test_weak_negatives(text):
    assert all(weak_label(s) == 0 for s in segments(text))


def test_segments():
    assert segments("") == [] and segments(" \n ") == []
    assert segments("One. Two!\nThree") == ["One.", "Two!", "Three"]
    assert len(segments("word " * 1000)) > 10 and "".join(segments("word " * 1000)).count("word") >= 1000
    assert quotes_removed('He said "{{x}}" twice') == "He said   twice" and "{{x}}" in quotes_removed('{"a": "{{x}}"}')


def corpus(spark):
    rng = random.Random(1)
    topics = ["night trains", "the water tariff", "flood barriers", "school kitchens", "the census form"]
    people = ["the minister", "our farmers", "the unions", "the audit office", "the executive"]
    def speech():
        return " ".join(f"{rng.choice(people).capitalize()} must publish the {rng.choice(['cost', 'timetable', 'figures'])} of {rng.choice(topics)} in {rng.randint(1990, 2025)}." for _ in range(6))
    data = [(i, speech(), f"s{i % 4}", 0.5) for i in range(400)]
    data += [(1000 + i, p if i % 2 else f"{speech()} {p} {speech()}", f"s{i % 4}", 0.5) for i, p in enumerate(POSITIVE * 4)]
    data += [(2000 + i, f"{speech()} {n} {speech()}", f"s{i % 4}", 0.5) for i, n in enumerate(NEGATIVE * 4)]
    data += [(3000, None, "s1", 0.5), (3001, " ", None, 0.5), (3002, "—", None, 0.5), (None, "Error 404", "s1", 0.5), (1000, POSITIVE[0], "s0", 0.5)]
    return spark.createDataFrame(data, "doc_id bigint, text string, source string, score double")


def test_found_documents(spark):
    found = {r.doc_id for r in residue(corpus(spark)).collect()}
    assert {i for i in found if i < 1000 or i >= 2000} == set()
    assert len(found) >= 0.85 * 4 * len(POSITIVE)


def test_training_is_deterministic_and_holds_on_unseen_sources(spark):
    sample = labelled_sample(corpus(spark))
    assert (train(sample).weights == train(sample).weights).all()
    folds = validation(corpus(spark)).collect()
    assert len(folds) == 4 and sum(r.positives for r in folds) == sum(sample.column("label").to_pylist())
    assert sum(r.recall * r.positives for r in folds) / sum(r.positives for r in folds) > 0.8


def test_nothing_to_find(spark):
    empty = corpus(spark).limit(0)
    assert residue(empty).count() == 0 and labelled_sample(empty).num_rows == 0
    clean = spark.createDataFrame([(1, "The sitting is open.", "a"), (2, None, None)], "doc_id bigint, text string, source string")
    assert residue(clean).count() == 0


def test_a_kept_classifier_finds_the_same(spark):
    documents = corpus(spark)
    fitted = train(labelled_sample(documents))
    again = Classifier.loads(fitted.dumps())
    assert (again.weights == fitted.weights).all() and again.bias == fitted.bias and again.known == fitted.known
    assert sorted(r.doc_id for r in residue(documents, classifier=again).collect()) == sorted(r.doc_id for r in residue(documents).collect())


def test_the_score_reads_no_phrase():
    """What is scored are hashed words, shapes and lengths: with no weight on any of them, phrases and marks change nothing."""
    blank = Classifier(np.zeros(DIMENSIONS, np.float32), -1.0, bytes(DIMENSIONS))
    scores = blank.documents([*POSITIVE, *NEGATIVE, "x " * 5000, None, " ", "\n"])
    assert len(set(scores[: len(POSITIVE) + len(NEGATIVE) + 1])) == 1 and list(scores[-3:]) == [0.0, 0.0, 0.0]


@pytest.mark.parametrize("text", ["", "\n\n", "é", "«", "…", "'", "’", "a\u00a0b", "😀", "\x00", "{", "日本語。次", "İ", "a" * 5000, '"' + "q " * 2000 + '"'])
def test_odd_texts_are_cut_as_they_are(text):
    """Windows are parts of the text, whatever stands at its ends, and the same wherever it stands in a batch."""
    assert all(part in text for part in segments(text) if text.count('"') < 2)
    model = Classifier(np.random.RandomState(1).normal(size=DIMENSIONS).astype(np.float32), 0.0, bytes(DIMENSIONS))
    alone, [_, among, _] = model.documents([text]), model.documents(["Before it.", text, "after it"])
    assert alone[0] == pytest.approx(among)
