"""Phrase candidates against plain substring and token tests."""

import random
import re

import pytest

from quarrylake.operators import search


def brute(records, terms):
    out = []
    for i, text in records:
        text = search.folded(text)
        tokens = set(re.findall(r"\w+", text))
        for t, phrase in terms:
            phrase = search.folded(phrase)
            words = sorted({w for w in re.findall(r"\w+", phrase) if len(w) >= 3} & tokens)
            if phrase and (phrase in text or words):
                out.append((i, t, phrase in text, words))
    return sorted(out, key=str)


def match(spark, records, terms):
    r = spark.createDataFrame([(i, t, 1, "x") for i, t in records], "id long, text string, row int, term string").repartition(3)
    t = spark.createDataFrame([(i, p, 1) for i, p in terms], "tid long, phrase string, row int")
    return sorted(((a, b, c, list(d)) for a, b, c, d in search.phrase_candidates(r, t, "id", "text", "tid", "phrase").collect()), key=str)


def test_cases(spark, monkeypatch):
    rng = random.Random(1)
    words = ["the", "cat", "concatenate", "of", "Ёлка", "елка", "ﬁne", "Straße", "x_1", "日本"]
    text = lambda n: rng.choice([" ", "\n", ", "]).join(rng.choices(words, k=n))
    records = [(k, text(rng.choice([1, 4, 9]))) for k in range(60)] + [(5, "of a"), (5, "of a"), (None, "THE  CAT"), (100, None), (101, "")]
    terms = [(k, text(rng.choice([1, 2, 3]))) for k in range(20)] + [(50, "f a"), (51, "cat"), (51, "cat"), (52, "STRASSE"), (53, "fine"), (54, None), (55, " "), (None, "of"), (56, "catenat")]
    expected = brute(records, terms)
    assert match(spark, records, terms) == expected
    monkeypatch.setattr(search, "PHRASE_CHARS", 60)  # several rounds
    assert match(spark, records, terms) == expected


@pytest.mark.parametrize(("records", "terms"), [([], []), ([(1, "a cat")], []), ([], [(1, "cat")]), ([(1, "a cat")], [(1, "cat")])])
def test_small(spark, records, terms):
    assert match(spark, records, terms) == brute(records, terms)
