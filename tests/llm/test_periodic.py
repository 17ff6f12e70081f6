"""Periodic runs against brute force over all periods."""

import hashlib
import os
import random
import re
import zlib

import pytest

from quarrylake.llm import periodic, queries

DATA = "/root/testdata/sf0.001"


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_runs(words):
    """(start, length, period) of all maximal stretches with smallest period q that are long enough."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q):
                found.setdefault((i, j - i + q), q)  # the smallest period comes first
            i = j
    return sorted((s, length, q) for (s, length), q in found.items())


def brute_row(doc_id, text, planted=True):
    words = split(text)
    h = zlib.crc32(str(doc_id).encode())
    if planted and doc_id is not None and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    by_period = sorted(runs, key=lambda r: (r[0], r[2]))
    return (
        doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        sha("".join(f"{s},{length},{q}\n" for s, length, q in by_period)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def query(spark, monkeypatch, docs, parts=3):
    df = spark.createDataFrame([(i, t, 1, "k", 2, "w") for i, t in docs], "doc_id long, text string, key int, tiles string, n_words int, words string").repartition(parts)
    monkeypatch.setattr(queries, "table", lambda *_: df)
    return sorted(map(tuple, queries.op13_periodic_runs(spark, "").select(*COLUMNS).collect()), key=str)


def made_up(rng, n):
    """Words of a small alphabet with planted repeats of all sizes."""
    words = []
    while len(words) < n:
        part = [rng.choice("abcdef" if rng.random() < 0.5 else "ab") for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 30, 70]))]
        words += part * rng.choice([1, 1, 2, 3, 7]) + part[: rng.randrange(len(part) + 1)]
    return " ".join(words[:n])


def test_cases(spark, monkeypatch):
    rng = random.Random(11)
    docs = [(k, made_up(rng, rng.choice([5, 12, 13, 40, 150, 400]))) for k in range(150)]
    docs += [(1000 + k, docs[5][1]) for k in range(60)] + [(3, docs[3][1]), (3, docs[3][1]), (None, docs[3][1]), (None, None), (2000, None), (2001, ""), (2002, " \t\n ")]
    docs += [(3000, "a " * 3000), (3001, "été été " * 20), (3002, "A a " * 10), (3003, "x y " * 12), (3004, " ".join(map(str, range(500))) * 3)]
    assert query(spark, monkeypatch, docs) == sorted((brute_row(*d) for d in docs), key=str)


@pytest.mark.parametrize("docs", [[], [(1, None)], [(1, "a b c")], [(1, "a " * 12)]])
def test_small_tables(spark, monkeypatch, docs):
    assert query(spark, monkeypatch, docs, 1) == sorted((brute_row(*d) for d in docs), key=str)


@pytest.mark.parametrize("seed", range(6))
def test_tiles_of_any_size(monkeypatch, seed):
    """Tiles and groups cut small: every run is found from fragments."""
    monkeypatch.setattr(periodic, "LEAST_BOUNDS", 1 + seed * seed * seed)
    monkeypatch.setattr(periodic, "TILE_WORDS", 1)
    rng = random.Random(seed)
    texts = [[w.encode() for w in split(made_up(rng, rng.randrange(1, 600)))] for _ in range(40)]
    for words, cut in zip(texts, periodic.tiles(texts), strict=True):
        fragments = {}
        import numpy as np

        for t in cut:
            for q, a, e in periodic.solve(t["low"], t["base"], t["whole"], np.frombuffer(t["at"], np.int32).tolist(), np.frombuffer(t["codes"], np.int32).tolist()):
                fragments.setdefault(q, []).append((a, e))
        found = {}
        for q, held in sorted(fragments.items()):
            held.sort()
            merged = [list(held[0])]
            for a, e in held[1:]:
                if a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], e)
                else:
                    merged.append([a, e])
            for a, e in merged:
                if e - a + q >= max(12, 2 * q):
                    found.setdefault((a, e - a + q), q)
        assert sorted((s, length, q) for (s, length), q in found.items()) == brute_runs(words)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_query_on_the_smallest_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    found = sorted(map(tuple, queries.op13_periodic_runs(spark, DATA).select(*COLUMNS).collect()))
    short = {r["doc_id"]: r["text"] for r in docs if len(split(r["text"])) <= 2500}  # brute force takes the square
    assert len(found) == len(docs) and len(short) > 0.9 * len(docs)
    assert [r for r in found if r[0] in short] == sorted(brute_row(i, t) for i, t in short.items())
    assert sum(r[1] > 0 for r in found) > 5
