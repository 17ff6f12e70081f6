"""The presence-mask search against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quarrylake.llm import maskrank

DOCS = "doc_id long, text string, row int, n string, terms int, item_id int, rank string"
ITEMS = "item_id long, text string, item string, doc_id int"


def words(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(docs, items, top=10):
    held = [(i, words(t)) for i, t in docs]
    held = [(i, ws) for i, ws in held if ws]
    total = sum(len(ws) for _, ws in held)
    df = Counter(w for _, ws in held for w in set(ws))
    out = []
    for number, text in items:
        scored = []
        for i, ws in held:
            tf, m = Counter(ws), 25 + (75 * len(ws) * len(held)) // total
            score = sum(math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[w] + 1))) * ((10**9 * tf[w]) // (1000 * tf[w] + 8 * m)) for w in words(text) if tf[w])
            scored += [(-score, i is None, i or 0, i)] if score > 0 else []
        out += [(number, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:top])]
    return sorted(out, key=str)


def search(spark, docs, items, parts=3, **kw):
    d = spark.createDataFrame([(i, t, 1, "n", 2, 3, "r") for i, t in docs], DOCS).repartition(parts)
    q = spark.createDataFrame([(i, t, "i", 5) for i, t in items], ITEMS)
    return sorted(map(tuple, maskrank.search(d, q, **kw).collect()), key=str)


def test_cases(spark, monkeypatch):
    monkeypatch.setattr(maskrank, "BATCH_ROWS", 70)
    monkeypatch.setattr(maskrank, "ROUND_BYTES", 700)  # several rounds
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(90)] + ["été", "Ärger", "日本", "x9", "A"]
    text = lambda n: rng.choice([" ", ", ", "-"]).join(rng.choices(vocabulary, [1 / (k + 1) for k in range(len(vocabulary))], k=n))
    docs = [(k, text(rng.choice([1, 3, 20, 60]))) for k in range(500)]
    docs += [(1000 + k, docs[3][1]) for k in range(250)]  # copies tie
    docs += [(7, docs[9][1]), (7, docs[9][1]), (None, docs[9][1]), (None, docs[9][1]), (2000, None), (2001, ""), (2002, "?! .."), (2003, "w1 " * 30000)]
    items = [(k, text(rng.choice([1, 4, 30]))) for k in range(25)] + [(3, "w1 w1 w1 w2"), (3, "w1 w1 w1 w2"), (None, "w5 W5"), (100, None), (101, ""), (102, "unheard"), (103, " ".join(vocabulary))]
    assert search(spark, docs, items) == brute(docs, items)
    assert search(spark, docs, items, parts=11, top=3) == brute(docs, items, 3)


def test_more_terms_than_bits_of_a_word(spark):
    rng = random.Random(4)
    docs = [(k, " ".join(f"t{rng.randrange(300)}" for _ in range(40))) for k in range(200)]
    items = [(1, " ".join(f"t{k}" for k in range(200))), (2, " ".join(f"t{k}" for k in range(100, 300)))]
    assert search(spark, docs, items) == brute(docs, items)


@pytest.mark.parametrize(("docs", "items"), [([], []), ([], [(1, "a")]), ([(1, "a b")], []), ([(1, None)], [(1, "a")]), ([(1, "a")], [(1, "a")])])
def test_small_tables(spark, docs, items):
    assert search(spark, docs, items, 1) == brute(docs, items)


def test_groups_in_descending_order_and_left_out():
    rng = np.random.default_rng(0)
    held = [np.unique(rng.integers(0, 40, 12)) for _ in range(3000)]
    offsets = np.concatenate([[0], np.cumsum([len(h) for h in held])])
    batch = maskrank.Batch(np.full(3000, 12), offsets, np.concatenate(held), np.ones(offsets[-1], np.int64), 3000, 36000, 40)
    item, weight = np.arange(10), np.zeros(40, np.int64)
    weight[:10] = np.arange(1, 11) ** 3
    docs, ends, bounds = batch.groups(item, weight)
    assert (np.diff(bounds) <= 0).all() and len(set(docs)) == len(docs) == ends[-1]
    for first, last in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True):
        assert len({tuple(held[d][held[d] < 10]) for d in docs[first:last]}) == 1
    whole = batch.scores(np.arange(3000), weight)
    asked = []
    batch.scores = lambda d, w: asked.extend(d) or maskrank.Batch.scores(batch, d, w)
    found, score = maskrank.rank_batch(batch, item, weight, 1, 10)
    assert sorted(score)[::-1][:10] == sorted(whole)[::-1][:10] and (whole[found] == score).all()
    assert len(asked) < 300  # few groups are evaluated
