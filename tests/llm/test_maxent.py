"""The maximum-entropy model: its softmax by brute force, and that the dealing of rows changes nothing."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylake.llm import maxent


def corpus(n=400):
    """Texts of two languages whose words predict each other, and rare words."""
    rng = random.Random(12)
    words = [[f"{c}{k}{c}" for k in range(10, 30)] for c in "xy"]
    return [(k, " ".join(rng.choices(words[k % 2], k=rng.randint(5, 60)) + [f"rare{rng.random()}"]), None) for k in range(n)]


@pytest.fixture(scope="module")
def small():
    counts = Counter(w for _, t, _ in corpus(60) for w in maxent._tokens(t.encode()))
    ranked = sorted(((maxent._token(w), n) for w, n in counts.items()), key=lambda x: (-x[1], x[0]))
    totals = Counter(), Counter()
    for i, n in ranked:
        totals[0][i & 31] += n
        totals[1][i & 31] += 1
    top = ranked[:90]
    words = maxent.Vocabulary(np.array([i for i, _ in top]), np.array([n for _, n in top]), {c: (totals[0][c], totals[1][c]) for c in totals[0]})
    weights = np.random.default_rng(5).normal(size=(2 * maxent.KINDS * 4096, maxent.PLACES)).astype(np.float32)
    return counts, dict(ranked), words, maxent.Model(words, 4096, weights)


def test_softmaxes_match_brute_force(small):
    _, _, words, model = small
    texts = [maxent._tokens(t.encode()) for _, t, _ in corpus(8)]
    codes = words.encode(np.array([maxent._token(w) for t in texts for w in t]))
    lengths = np.array([len(t) for t in texts])
    one, two = maxent.history(codes, lengths, words.end)
    got = model.log10(codes, one, two)
    classes, places, of_class, inside = model.rows(codes, one, two)
    flat = [w for t in texts for w in t]
    first = {0, *np.cumsum(lengths)[:-1].tolist()}
    for k, word in enumerate(flat):
        assert classes[k] == zlib.crc32(word[-2:]) % maxent.CLASSES
        before = words.end if k in first else codes[k - 1]
        assert one[k] == before and two[k] == (words.end if k in first or k - 1 in first else codes[k - 2])
        z = [float(words.by_class[c]) + sum(float(model.weights[r][c]) for r in of_class[:, k]) for c in range(maxent.CLASSES)]
        q = [float(words.by_place[classes[k], p]) + sum(float(model.weights[r][p]) for r in inside[:, k]) for p in range(maxent.PLACES)]
        log = lambda v, at: v[at] - max(v) - math.log(sum(math.exp(x - max(v)) for x in v))
        assert got[k] == pytest.approx((log(z, classes[k]) + log(q, places[k])) / math.log(10), abs=1e-4)
    by_class, by_place, _ = model.log_softmaxes(codes, one, two)
    assert np.exp(by_class).sum(1) == pytest.approx(1, abs=1e-4) and np.exp(by_place).sum(1) == pytest.approx(1, abs=1e-4)


def test_places_are_the_frequent_words_of_each_class(small):
    counts, known, words, _ = small
    for c in range(maxent.CLASSES):
        own = [i for i, _ in sorted(known.items(), key=lambda x: (-x[1], x[0]))[:90] if i & 31 == c]
        for place, i in enumerate(own):
            assert words.leaf[words.encode(np.array([i]))[0]] == min(place, maxent.PLACES - 1) * maxent.CLASSES + c
    # all smoothed mass of a class's last place is split over its learned tokens and one unknown one
    for c in range(maxent.CLASSES):
        rest = [n for i, n in known.items() if i & 31 == c and words.leaf[words.encode(np.array([i]))[0]] >= (maxent.PLACES - 1) * maxent.CLASSES]
        assert 10 ** words.under[c] == pytest.approx(sum(rest) + 0.5 * (len(rest) + 1))


def test_gradient_is_observed_less_expected_by_brute_force(small):
    _, _, words, model = small
    codes = words.encode(np.array([maxent._token(w) for w in maxent._tokens(corpus(1)[0][1].encode())]))
    one, two = maxent.history(codes, np.array([len(codes)]), words.end)
    classes, places, of_class, inside = model.rows(codes, one, two)
    by_class, by_place, _ = model.log_softmaxes(codes, one, two)
    seen, hoped = maxent.Sums(model), maxent.Sums(model)
    seen.observe(codes, one, two)
    hoped.expect(codes, one, two)
    hoped.flush()
    observed, expected = np.zeros(model.weights.shape), np.zeros(model.weights.shape)
    for k in range(len(codes)):
        for rows, at, z in ((of_class, classes, by_class), (inside, places, by_place)):
            for r in rows[:, k]:
                observed[r, at[k]] += 1
                expected[r] += np.exp(z[k])
    assert np.array_equal(seen.total.reshape(observed.shape), observed)
    assert hoped.total.reshape(expected.shape) == pytest.approx(expected, abs=1e-4)


def test_partitions_do_not_matter_and_held_out_text_gains(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, source string")
    kept = []
    for parts in (1, 7, 40):
        rows = maxent.score(docs.repartition(parts)).collect()
        kept.append({r["doc_id"]: r["score"] for r in rows})
        held = [r for r in rows if r["held_out"]]
        gain = sum(r["score"] - r["base_score"] for r in held) / sum(r["n_tokens"] for r in held)
        assert gain > 0.1  # the language of the text before tells apart two halves of the words
    assert all(kept[0][i] == pytest.approx(other[i], abs=1e-4) for other in kept[1:] for i in kept[0])


def test_scores_of_awkward_rows(spark):
    rows = [(None, "no id", "s"), (1, None, "s"), (1, None, "s"), (2, "", None), (3, "x" * 50_000, "s"), (4, "a b " * 30_000, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").withColumn("n", F.lit(1))
    found = maxent.score(docs).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in found) == [(0, 3), (1, 1), (1, 1), (2, 1), (3, 2), (4, 60_001)]
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in found)
    raw = docs.select("doc_id", F.expr("cast(X'66FF6F20FE' as string)").alias("text"))
    assert {r["n_tokens"] for r in maxent.score(raw).collect()} == {3}
    out = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 5 == 1)
    alone = maxent.score(spark.createDataFrame([(out, "all held out")], "doc_id long, text string")).first()
    assert alone["held_out"] and alone["train_tokens"] == alone["n_known"] == 0 and math.isfinite(alone["score"])


def test_slots_grow_with_the_tokens():
    assert [maxent.slots_for(n) for n in (0, 10**4, 10**5, 3 * 10**5, 10**9)] == [4096, 4096, 4096, 16384, maxent.MOST_SLOTS]


def brute_part(words, one, two, leaf, held):
    """The part's model with a dictionary of weights for each feature, by the definition."""
    classes, places = leaf % maxent.CLASSES, leaf // maxent.CLASSES
    last, before = words.leaf[two], words.leaf[one]
    out = np.zeros(len(one))
    for label, start, of in (
        (classes, lambda k: words.by_class, lambda k: [("a", one[k]), ("b", one[k], two[k]), ("c", two[k])]),
        (places, lambda k: words.by_place[classes[k]], lambda k: [("a", classes[k], before[k]), ("b", classes[k], before[k], last[k]), ("c", classes[k], last[k])]),
    ):
        weights = {}
        z = lambda k: start(k) + sum(weights.get(f, 0) for f in of(k))  # noqa: B023, E731
        for _ in range(maxent.ROUNDS):
            real, hoped = {}, {}
            for k in np.flatnonzero(~held):
                p = np.exp(z(k))
                for f in of(k):
                    real.setdefault(f, np.zeros(32))[label[k]] += 1
                    hoped[f] = hoped.get(f, 0) + p / p.sum()
            weights = {f: weights.get(f, 0) + maxent.STEP * np.log((real[f] + maxent.DAMPING) / (hoped[f] + maxent.DAMPING)) for f in real}
        for k in range(len(one)):
            p = np.exp(z(k))
            out[k] += np.log10(p[label[k]] / p.sum())
    return out


def test_every_context_has_weights_of_its_own(small):
    _, _, words, _ = small
    texts = [maxent._tokens(t.encode()) for _, t, _ in corpus(12)]
    codes = words.encode(np.array([maxent._token(w) for t in texts for w in t]))
    lengths = np.array([len(t) for t in texts])
    one, two = maxent.history(codes, lengths, words.end)
    held = np.repeat(np.arange(len(texts)) % 4 == 1, lengths)
    got = maxent.part_logs(words, one, two, words.leaf[codes], held)
    assert got == pytest.approx(brute_part(words, one, two, words.leaf[codes], held), abs=1e-4)


def test_weights_grow_with_the_contexts(small):
    """Far more pairs than any fixed number of rows: each context is scored by its own tokens alone."""
    _, _, words, _ = small
    rng = np.random.default_rng(3)
    n = 60_000
    codes = rng.integers(0, words.size, (3, n))
    pairs = np.unique(codes[0].astype(np.int64) << maxent.CODE_BITS | codes[1]).size
    leaf = words.leaf[codes[2]]
    got = maxent.part_logs(words, codes[0], codes[1], leaf, np.zeros(n, bool))
    assert pairs > 0.95 * words.size**2 and np.isfinite(got).all()
    context, index = np.unique(codes[0].astype(np.int64) << maxent.CODE_BITS | codes[1], return_inverse=True)
    assert len(set(zip(index.tolist(), leaf.tolist()))) == len({(i, x, round(g, 9)) for i, x, g in zip(index.tolist(), leaf.tolist(), got.tolist())})


def test_many_parts_score_like_one(spark, monkeypatch):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, source string")
    monkeypatch.setattr(maxent, "PART_TOKENS", 1500)
    monkeypatch.setattr(maxent, "DEAL_TOKENS", 700)
    kept = []
    for split in (1, 9):
        rows = maxent.score(docs.repartition(split)).collect()
        assert len(rows) == 400 and sorted(r["doc_id"] for r in rows) == list(range(400))
        held = [r for r in rows if r["held_out"]]
        assert sum(r["score"] - r["base_score"] for r in held) / sum(r["n_tokens"] for r in held) > 0.1
        kept.append({r["doc_id"]: r["score"] for r in rows})
    # the first tokens of texts are dealt by document, so only these may differ
    assert all(kept[0][i] == pytest.approx(kept[1][i], abs=0.5) for i in kept[0])


def test_contexts_are_not_cut_between_parts(small):
    _, _, words, _ = small
    rng = np.random.default_rng(4)
    one, two, doc = rng.integers(0, words.size + 32, (3, 20_000))
    own = maxent.parts_of(one, two, doc, words, 37)
    inner = one != words.end
    pair = one[inner].astype(np.int64) << 20 | two[inner]
    assert np.unique(pair).size == np.unique(pair << 8 | own[inner]).size and 20 < len(set(own.tolist())) <= 37 and own.min() >= 0 and own.max() < 37


def test_the_model_of_many_parts_is_that_of_one(spark, monkeypatch):
    """Features that contexts share learn from the whole corpus, not from the part that a context was dealt to."""
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, source string").repartition(5)
    whole = {r["doc_id"]: r["score"] for r in maxent.score(docs).collect()}
    monkeypatch.setattr(maxent, "PART_TOKENS", 300)
    monkeypatch.setattr(maxent, "DEAL_TOKENS", 700)
    cut = {r["doc_id"]: r["score"] for r in maxent.score(docs).collect()}
    assert len(cut) == 400 and all(cut[i] == pytest.approx(whole[i], abs=2e-3) for i in whole)


def test_tasks_sums_are_packed_whole():
    rng = np.random.default_rng(6)
    columns = [np.sort(rng.integers(0, 1 << 18, 999)).astype(np.int32), rng.integers(0, 1 << 18, 999).astype(np.int32), rng.integers(0, 1 << 11, 999).astype(np.int32)]
    packed = [maxent._pack([c[x:y] for c in columns]) for x, y in ((0, 400), (400, 401), (401, 999))]
    assert all(np.array_equal(a, b) for a, b in zip(maxent._unpack(packed, [400, 1, 598]), columns, strict=True))
