"""The ten operators against brute force, exact round trips and held-out accuracy, and on awkward input."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from brute_force import brute_similar
from pyspark.sql import functions as F

from quarrylake.llm import decontaminate, langid, maxent, mixing, pii, simhash, spotsigs, toxicity, urlfilter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, fp long, hash long, size long, bucket long, row long, position double, p_toxic string"


def docs_of(spark, rows):
    """Documents with extra columns whose names clash with those inside the operators."""
    full = [(i, t, la, so, None if t is None else len(t), 1, 2, 3, 4, 5, 6, 0.5, "kept") for i, t, la, so in rows]
    return spark.createDataFrame(full, DOCS)


WORDS = "the river of stone and old light near a quiet harbour where seven grey boats wait for wind".split()


def awkward():
    """Nulls in every column, empty and long texts, repeated rows and ids, all beside ordinary text."""
    rng = random.Random(3)
    plain = [(k, " ".join(rng.choices(WORDS, k=rng.randint(1, 60))), rng.choice(["en", "de"]), rng.choice(["a", "b", "c"])) for k in range(30)]
    return plain + [(None, "no id here", "en", "a"), (100, None, None, None), (101, "", "en", None), (102, " \n\t ", "en", "a"), (103, "x" * 50_000, "en", "b"), (104, " ".join(WORDS) * 500, "en", "b"), plain[0], (105, plain[1][1], "en", "c"), (3, "another text under an old id", "en", "c"), (106, "Ünïcödé 𝔘 😀 texts", None, "é")]


EMPTY: list = []


def brute_simhash(text):
    from xxhash import xxh64_intdigest

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    hashes = [xxh64_intdigest(" ".join(words[k : k + 4]), 42) for k in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_matches_brute_force(spark):
    rows = awkward()
    found = simhash.components(docs_of(spark, rows)).select("id", simhash.hex_fingerprint().alias("h"), "component").collect()
    assert Counter((r["id"], r["h"]) for r in found) == Counter((i, f"{brute_simhash(t):016x}") for i, t, *_ in rows)
    group = {r["id"]: r["component"] for r in found}
    assert group[100] == group[101] == group[102] == 100
    assert group[105] == group[1] == 1
    assert simhash.components(docs_of(spark, EMPTY)).count() == 0


@pytest.mark.parametrize("shard_rows", [3, 4096])
def test_links_connect_like_all_pairs(spark, shard_rows):
    rng = random.Random(7)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for k in range(0, 60, 2):  # chains and clusters at distances around the radius
        for _ in range(4):
            flips = rng.sample(range(64), rng.randint(1, 6))
            fps.append(fps[k] ^ sum(1 << b for b in flips))
    signed = [f - (1 << 64) if f >> 63 else f for f in set(fps)]
    from quarrylake.operators.components import connected_components

    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), shard_rows=shard_rows)
    found = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    parent = {f: f for f in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in signed:
        for b in signed:
            if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4:
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    assert {f: root(f) for f in signed if root(f) != f or any(root(g) == f for g in signed if g != f)} == found


def test_keep_one_keeps_the_smallest(spark):
    rows = [(5, "a b c d e", "en", "s"), (2, "A B C D E", "en", "s"), (9, "other words stand in this", "en", "s"), (None, "a b c d e", "en", "s")]
    rows += [(None, "words of no other text", "en", "s"), (5, "a second text of one id", "en", "s")]
    kept = simhash.keep_one(docs_of(spark, rows))
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(0, "words of no other text"), (2, "A B C D E"), (5, "a second text of one id"), (9, "other words stand in this")]
    assert kept.columns == docs_of(spark, EMPTY).columns
    assert simhash.keep_one(docs_of(spark, EMPTY)).count() == 0


@pytest.mark.parametrize("pieces", [(1024, 1 << 22), (5, 1 << 22), (1024, 400)])
def test_keep_one_matches_all_pairs_by_similarity(spark, monkeypatch, pieces):
    monkeypatch.setattr(simhash, "PIECE_ROWS", pieces[0])
    monkeypatch.setattr(simhash, "PIECE_SHINGLES", pieces[1])
    rng = random.Random(11)
    words = [f"w{k}" for k in range(3000)]
    passage = rng.choices(words, k=40)
    texts = {}
    for _ in range(24):
        base = rng.choices(words, k=rng.randint(40, 200))
        if rng.random() < 0.5:
            base += passage  # a passage that many texts share does not make them similar
        for _ in range(rng.choice([1, 2, 6, 20])):
            edited = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 35))):
                edited[rng.randrange(len(edited))] = rng.choice(words)
            texts[len(texts)] = " ".join(edited)
    ids = list(texts)
    rng.shuffle(ids)
    roots = brute_similar(texts)
    kept = {r["doc_id"] for r in simhash.keep_one(docs_of(spark, [(i, texts[i], "en", "s") for i in ids])).collect()}
    expected = set(roots.values())
    assert len(expected) < len(texts) / 2
    assert kept == expected


def test_keep_one_with_awkward_rows(spark):
    rows = awkward()
    docs = docs_of(spark, rows).withColumn("fp", F.lit("mine")).withColumn("group", F.lit(1)).withColumn("least", F.lit(None).cast("int"))
    kept = simhash.keep_one(docs)
    found = kept.collect()
    assert kept.columns == docs.columns and {r["fp"] for r in found} == {"mine"}
    assert Counter(r["text"] for r in found if r["doc_id"] in (100, 101, 102)) == Counter({None: 1})
    assert len(found) == len({re.sub("[A-Z]", lambda m: m.group().lower(), t or "").strip() for _, t, *_ in rows})


def test_components_with_a_hot_fingerprint(spark):
    rows = [(k, "one text that very many rows share", "en", "s") for k in range(10, 1500)] + [(k, f"text number {k} stands alone here", "en", "s") for k in range(1500, 1520)]
    found = {r["id"]: r["component"] for r in simhash.components(docs_of(spark, rows)).collect()}
    assert len(found) == len(rows)
    assert all(found[k] == 10 for k in range(10, 1500))
    assert all(found[k] >= 1500 for k in range(1500, 1520))


def test_decontamination_matches_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    items = [(k, " ".join(rng.choices(WORDS, k=n))) for k, n in enumerate((13, 20, 40, 5, 1, 12))] + [(6, None), (7, "..."), (None, "the river"), (0, " ".join(WORDS[:13]))]
    rows = awkward() + [(200 + k, f"Before: {t.upper()} -- after it all; {t}", "en", "a") for k, (_, t) in enumerate(items) if t]
    found = decontaminate.report(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)  # the same by shuffled joins
    assert Counter(decontaminate.report(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")).drop("hash", "items").collect()) == Counter(tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "contaminated")) for r in found)
    monkeypatch.undo()

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))

    windows = {(i, tuple(w[s : s + min(13, len(w))])) for i, t in items if (w := words(t)) for s in range(len(w) - min(13, len(w)) + 1)}
    expected = []
    for i, t, *_ in rows:
        w, hit, named = words(t), set(), set()
        for item, window in windows:
            n = len(window)
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) == window:
                    hit |= set(range(s, s + n))
                    named |= {str(item)} - {"None"}
        expected.append((i, len(w), len(hit), tuple(sorted(named)), bool(hit) and 20 * len(hit) >= len(w)))
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in found) == Counter(expected)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.report(docs_of(spark, rows), none).where("n_hit > 0").count() == 0
    assert decontaminate.report(docs_of(spark, EMPTY), none).count() == 0
    clean = decontaminate.remove_contaminated(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert clean.count() == sum(not e[4] for e in expected) and clean.columns == docs_of(spark, EMPTY).columns


def test_proximity_finds_shuffled_words(spark):
    item = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november"
    mixed = "bravo alpha delta charlie foxtrot echo golf india hotel kilo juliet mike lima november"
    documents, matches = decontaminate.search(docs_of(spark, [(1, mixed, "en", "a"), (2, item, "en", "a"), (3, "alpha only", "en", "a")]), spark.createDataFrame([(1, item)], "item_id long, text string"))
    kinds = {(r["doc_id"], r["kind"]) for r in matches.join(documents, "row").collect()}
    assert (1, "proximity") in kinds and (2, "phrase") in kinds and not any(d == 3 for d, _ in kinds)


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    def luhn(digits):
        return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0

    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_pii_base_spans_match_brute_force(spark):
    rng = random.Random(11)
    parts = ["a@b.co", "x.y+z@mail-1.example.org", "@", ".", "..", "-", " ", "+1 (555) 123-4567", "+49.30.1234567", "4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1112", "1.2.3.4", "256.1.1.1", "001.02.3.255.9", "é", "😀", "word", "_", "7", "12345678901234567890", "(", ")", "\n", "%"]
    rows = [(k, "".join(rng.choices(parts, k=rng.randint(0, 12))), "en", "a") for k in range(400)] + awkward() + [(900, "1" * 30_000 + " a@b.de", "en", "a"), (901, "a" * 30_000 + "@", "en", "a")]
    found = pii.find(docs_of(spark, rows)).collect()
    assert Counter((r["doc_id"], tuple((pii.KINDS[s["kind"]], s["start"], s["stop"]) for s in r["spans"] if s["ok"])) for r in found) == Counter((i, tuple(base_spans(t))) for i, t, *_ in rows)
    assert pii.find(docs_of(spark, EMPTY)).count() == 0


def test_pii_adds_secrets_and_redacts(spark):
    rng = random.Random(2)
    secret = lambda: "".join(rng.choices("0123456789abcdef", k=40))
    rows = [(k, f'some words token = "{secret()}" then mail m{k}@x.example.org and more', "en", "a") for k in range(40)] + [(99, None, "en", "a"), (98, "clean words only", "en", "a")]
    found = {r["doc_id"]: r for r in pii.find(docs_of(spark, rows)).collect()}
    assert all(any(pii.KINDS[s["kind"]] == "secret" for s in found[k]["spans"]) for k in range(40))
    assert found[98]["spans"] == []
    clean = {r["doc_id"]: r for r in pii.redact(docs_of(spark, rows)).collect()}
    assert clean[3]["text"] == 'some words token = "[SECRET]" then mail [EMAIL] and more' and clean[3]["n_chars"] == len(clean[3]["text"])
    assert clean[99]["text"] is None and clean[98]["text"] == "clean words only"


def test_mix_meets_targets(spark):
    rows = awkward()
    found = mixing.mixture(docs_of(spark, rows)).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in found) == Counter((i, s, size(t)) for i, t, _, s in rows)
    held, taken, target = Counter(), Counter(), {}
    for r in found:
        held[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"] and (r["position"] is not None) == (r["taken"] > 0)
        assert len(r["positions"]) == (r["taken"] > 0) + (r["taken"] > r["size"]) and r["positions"] == sorted(r["positions"])
    assert all(math.floor(target[s]) == taken[s] and target[s] <= 2 * held[s] for s in held)
    assert sum(target.values()) == pytest.approx(1.5 * sum(held.values()))
    free = [target[s] / w for s, w in zip(sorted(held, key=lambda s: (s is None, s or "")), [3, 1, 2] * 3, strict=False) if target[s] < 2 * held[s]]
    assert max(free) == pytest.approx(min(free))
    assert mixing.mixture(docs_of(spark, rows)).exceptAll(spark.createDataFrame(found, mixing.mixture(docs_of(spark, EMPTY)).schema)).count() == 0
    assert mixing.mixture(docs_of(spark, EMPTY)).count() == 0
    assert mixing.mixture(docs_of(spark, [(1, "", "en", "a"), (2, None, "en", "b")])).where("taken = 0 and target = 0").count() == 2
    assert mixing.curriculum(docs_of(spark, rows)).where("mix_taken = 0").count() == 0


def test_positions_follow_the_schedule(spark):
    demand = spark.range(0, 11).select((F.col("id") / 10).alias("u"))
    for k, (a, m, b) in enumerate(mixing.SCHEDULES):
        got = demand.select("u", mixing._position(F.lit(k), F.col("u"), mixing.SCHEDULES).alias("t")).collect()
        for r in got:
            t = r["t"]
            low = a * min(t, 0.5) + (m - a) * min(t, 0.5) ** 2
            high = m * max(t - 0.5, 0) + (b - m) * max(t - 0.5, 0) ** 2
            assert (low + high) / ((a + 2 * m + b) / 4) == pytest.approx(r["u"], abs=1e-9)


def test_spotsigs_edges(spark):
    rows = awkward()
    found = spotsigs.compare(docs_of(spark, rows)).collect()
    order = sorted(((i is not None, i or 0), t or "") for i, t, *_ in rows)
    order.sort(key=lambda x: (not x[0][0], -x[0][1], x[1]))
    texts = [t for _, t in order]
    expected = Counter()
    for k, t in enumerate(texts):
        after = texts[(k + 1) % len(texts)]
        expected[(t, t[: len(t) - len(t) // 2] + after[: len(t) // 2])] += 1
    assert Counter((r["text"], r["edited"]) for r in found) == expected
    assert all(r["sigs"] for r in found)
    assert len({tuple(r["sigs"]) for r in found if r["text"] == ""}) == 1
    one = spotsigs.compare(docs_of(spark, [(1, "the old boat of stone", "en", "a")])).first()
    assert one["next_sigs"] == one["sigs"]
    assert spotsigs.compare(docs_of(spark, EMPTY)).count() == 0


def test_spotsigs_in_many_buckets(spark):
    rows = [(k * 3 - 500, f"the word{k} of item{k} and more{k}", "en", "a") for k in range(900)]
    found = {r["doc_id"]: r["edited"] for r in spotsigs.compare(docs_of(spark, rows)).collect()}
    texts = {i: t for i, t, *_ in rows}
    for i, t in texts.items():
        after = texts.get(i - 3, texts[max(texts)])
        assert found[i] == t[: len(t) - len(t) // 2] + after[: len(t) // 2]


def test_spotsigs_near_duplicates(spark):
    rng = random.Random(1)
    long = lambda: " ".join(rng.choice(["the", "of", f"w{rng.randint(0, 400)}", f"v{rng.randint(0, 400)}"]) for _ in range(200))
    a, b = long(), long()
    rows = [(1, a, "en", "s"), (2, a + " the end of it", "en", "s"), (3, b, "en", "s"), (4, b.upper(), "en", "s"), (5, long(), "en", "s")]
    assert [(r["u"], r["v"]) for r in spotsigs.near_duplicates(docs_of(spark, rows)).collect()] == [(1, 2)]


def test_language_profiles(spark):
    rng = random.Random(4)
    vocabulary = {"en": ["the", "thing", "with", "having", "there"], "de": ["schön", "nicht", "über", "einig", "werden"], "fr": ["être", "quelle", "jour", "voilà", "leur"]}
    rows = [(k, " ".join(rng.choices(vocabulary[la], k=20)), la, "a") for k in range(90) for la in [("en", "de", "fr")[k % 3]]]
    rows += [(1000, None, "en", "a"), (1001, "", "en", "a"), (1002, "123 456 !!", None, "a"), (None, "the thing", "en", "a"), (1003, "the " * 20_000, None, "a")]
    found = langid.identify(docs_of(spark, rows)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1
    pred = {r["doc_id"]: r["lang_pred"] for r in found}
    assert all(pred[i] == la for i, _, la, _ in rows[:90])
    assert pred[1000] == pred[1001] == pred[1002] == "und" and pred[1003] == "en"
    assert langid.identify(docs_of(spark, EMPTY)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs_of(spark, [(1, "words", None, "a")])).collect()} == {"und"}


def test_toxicity_chain(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(300):
        bad = k % 6 == 0
        words = rng.choices(WORDS, k=40) + (rng.choices(["vile", "wretch", "scumbag"], k=3) if bad else [])
        rng.shuffle(words)
        rows.append((k, " ".join(words), "en", "a"))
        if k < 200:
            labels.append((k, 1 - int(k % 5 == 0), int(bad)))
    labels += [(None, 1, 1), (5, None, None), (100_000, 0, 1)]
    rows += [(900, None, "en", "a"), (901, "", "en", "a"), (902, "vile " * 20_000, "en", "a")]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r for r in toxicity.judge(docs_of(spark, rows), table).collect()}
    assert len(found) == len(rows)
    assert all(found[k]["is_toxic"] == (k % 6 == 0) for k in range(300))
    assert not found[900]["is_toxic"] and not found[901]["is_toxic"]
    kept = toxicity.reject(docs_of(spark, rows), table)
    assert kept.columns == docs_of(spark, EMPTY).columns and {r["p_toxic"] for r in kept.collect()} == {"kept"}
    assert toxicity.judge(docs_of(spark, rows), table.limit(0)).where("is_toxic").count() == 0
    assert toxicity.judge(docs_of(spark, EMPTY), table).count() == 0


def test_url_rules_and_ratio(spark):
    urls = ["http://A.Example.ORG/es/1?x", "https://example.org/en/12", "https://www.org/", "http://x.com/fr/2#a", "http://x.com/de/", "nothing", "", None, "http://org", "ftp://u@h.net:8/p/q?x#y", "http://com/fr/ok", "http://example.organic/es/"]
    pages = spark.createDataFrame([(k, u, "h", "clash") for k, u in enumerate(urls)] + [(1, urls[1], "h", "clash")], "page_id long, url string, html string, rule string")
    got = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(pages).orderBy("page_id").collect()]
    assert got[0] == (0, "a.example.org", "/es/1", "example.org/es/", "block")
    assert got[1] == got[2] == (1, "example.org", "/en/12", "example.org/en/1", "block")
    rest = {g[0]: g[1:] for g in got[3:]}
    assert rest[2][2:] == ("org/", "allow") and rest[3][2:] == ("com/fr/", "allow") and rest[4][2:] == ("com/de/", "block")
    assert rest[5][:3] == ("", "", None) and rest[7][:3] == ("", "", None) and rest[8][:3] == ("org", "", None)
    assert rest[9][:3] == ("u@h.net:8", "/p/q", None) and rest[10][2] == "com/fr/" and rest[11][2] is None
    assert urlfilter.judge(pages.limit(0)).count() == 0
    model = {"good": urlfilter.MarkovModel([b"http://good.a/fr/1", b"http://good.a/fr/2"]), "bad": urlfilter.MarkovModel([b"http://bad.b/de/1", b"http://bad.b/de/2"])}
    assert urlfilter.ratio(b"http://good.a/fr/9", model["good"], model["bad"], {}) > 0 > urlfilter.ratio(b"http://bad.b/de/9", model["good"], model["bad"], {})
    for m in model.values():
        assert sum(m.probability(b"ttp:", c) for c in range(256)) == pytest.approx(1)


def test_warc_round_trip(spark):
    long = "<p>" + "é" * 200
    rows = [(3, "http://a", long), (1, "http://b", long), (2, "u\r\nx", "short"), (4, None, "short"), (5, "http://c", None), (None, "http://d", long), (6, "http://e", "z" * 300_000), (1, "http://b", long)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    found = [(r["record_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"], r["payload"]) for r in warc.round_trip(pages).collect()]
    assert len(found) == len(rows)
    expected = Counter()
    for i, _, html in rows:
        body = (html or "").encode()
        revisit = html == long and i != 1
        expected[(None if i is None else str(i), "revisit" if revisit else "response", "1" if revisit else None, len(body), hashlib.sha256(body).hexdigest(), None if revisit else body)] += 1
    assert Counter((*f[:5], None if f[5] is None else bytes(f[5])) for f in found) == expected
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_salvage_after_damage():
    one = lambda k: warc._record(k, f"http://x/{k}", f"payload {k} {'y' * 500}".encode(), hashlib.sha256(f"payload {k} {'y' * 500}".encode()).hexdigest(), None, "1970-01-01T00:00:00Z")
    import gzip

    parts = [one(k) for k in range(6)]
    broken = bytearray(parts[2])
    broken[len(broken) // 2] ^= 0xFF
    content = parts[0] + warc.EMPTY_MEMBER + b"junk bytes" + parts[1] + bytes(broken) + gzip.decompress(parts[3]) + parts[4] + parts[5][:-30]
    out = list(warc.salvage(content))
    good = [h["warc-record-id"] for _, _, h, _, p in out if p is None]
    assert good == [f"<urn:page:{k}>" for k in (0, 1, 3, 4)]
    gaps = [(a, b) for a, b, h, _, p in out if p is not None]
    start = len(parts[0]) + len(warc.EMPTY_MEMBER)
    assert gaps[0] == (start, start + 10) and len(gaps) == 3 and gaps[-1][1] == len(content)
    plain = gzip.decompress(parts[0])
    assert [p for *_, p in warc.salvage(plain.replace(b"payload", b"PAYLOAD"))] == ["block digest differs"]


def test_language_model_base_is_exact(spark):
    rows = awkward()
    found = maxent.score(docs_of(spark, rows)).collect()
    words = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")), "\n"]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts = Counter(w for i, t, *_ in rows if not out(i) for w in words(t))
    total, kinds = sum(counts.values()), len(counts)
    z = total + 0.5 * (kinds + 1)
    expected = Counter((i, out(i), len(w := words(t)), sum(counts[x] > 0 for x in w), total, round(sum(math.log10((counts[x] + 0.5) / z) for x in w), 4)) for i, t, *_ in rows)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in found) == expected
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in found)
    assert maxent.score(docs_of(spark, EMPTY)).count() == 0


def test_upper_case_share_reads_the_whole_text():
    tail = "quiet words " * 100 + "SHOUTED " * 100
    for text in (tail, tail + "ÀÉ", "SHORT and loud", "LOUD " * 300 + "quiet " * 300, "", "é" * 2000 + "É" * 500):
        assert toxicity._style(text, 3)[1] == pytest.approx(sum(c.isupper() for c in text) / max(len(text), 1))
    assert toxicity._style(tail, 3)[1] > 0.3


def test_examples_hold_one_document_of_a_repeated_id(spark):
    rows = [(k, f"text {k}", "en", "a") for k in range(5)] + [(2, f"copy {k} of one id", "en", "a") for k in range(300)] + [(None, "no id", "en", "a")]
    labels = spark.createDataFrame([(k, k % 2) for k in range(5)], "doc_id long, toxic int")
    features, styles, known = toxicity.examples(docs_of(spark, rows), labels, ["toxic"])
    assert len(features) == len(styles) == 5 and known["toxic"] == [0, 1, 0, 1, 0]
    again = toxicity.examples(docs_of(spark, rows[::-1]), labels, ["toxic"])
    assert [f.tolist() for f in again[0]] == [f.tolist() for f in features]


def test_keep_one_keeps_one_of_repeated_rows(spark):
    rows = [(1, "one row that is repeated here", "en", "s")] * 40 + [(None, "one text under many null ids", "en", "s")] * 40 + [(None, "only null ids of a", "en", "s"), (7, "some other text stands alone", "en", "s")]
    rows += [(None, None, "en", "s"), (None, "", "en", "s"), (8, "", "de", "s"), (8, "", "en", "s")]
    kept = simhash.keep_one(docs_of(spark, rows)).collect()
    assert Counter((r["doc_id"], r["text"]) for r in kept) == Counter({(1, rows[0][1]): 1, (None, rows[40][1]): 1, (None, "only null ids of a"): 1, (7, "some other text stands alone"): 1, (8, ""): 1})


def test_mix_takes_each_repeated_row_for_itself(spark):
    text = "five words are in here"
    rows = [(None, f"{text} {k}", "en", "a") for k in range(60)] + [(4, text, "en", "a")] * 9000 + [(k, text, "en", "b") for k in range(20_000, 20_300)]
    rows += [(None, None, "en", None)] * 3
    docs = docs_of(spark, rows)
    found = mixing.mixture(docs).collect()
    taken, target = Counter(), {r["source"]: r["target"] for r in found}
    for r in found:
        taken[r["source"]] += r["taken"]
    assert len(found) == len(rows) and all(math.floor(target[s]) == taken[s] for s in target)
    kept = mixing.curriculum(docs)
    assert kept.columns[: len(docs.columns)] == docs.columns
    got, words = kept.collect(), Counter()
    for r in got:
        assert 0 < r["mix_taken"] <= 2 * r["mix_size"] == 2 * len(r["text"].split())
        words[r["source"]] += r["mix_taken"]
    assert all(words[s] == math.floor(target[s]) for s in target if target[s])
    assert len(got) == sum(r["taken"] > 0 for r in found)


def test_warc_salvage_inside_a_member():
    import gzip

    rng = random.Random(8)
    body = lambda k: f"payload {k} {rng.randbytes(700).hex()}".encode()
    plain = [gzip.decompress(warc._record(k, f"http://x/{k}", b := body(k), hashlib.sha256(b).hexdigest(), None, "1970-01-01T00:00:00Z")) for k in range(60)]

    def read(content):
        out = list(warc.salvage(content))
        return [int(h["warc-record-id"].removeprefix("<urn:page:").removesuffix(">")) for _, _, h, _, p in out if p is None], [(a, b, p) for a, b, h, _, p in out if p is not None]

    whole = gzip.compress(b"".join(plain), mtime=0)
    assert read(whole) == (list(range(60)), [])
    for lost in ([0], [30], [0, 1, 30, 59]):
        held = [p.replace(b"payload", b"PAYLOAD") if k in lost else p for k, p in enumerate(plain)]
        good, gaps = read(gzip.compress(b"".join(held), mtime=0) + gzip.compress(plain[0]))
        assert good == [k for k in range(60) if k not in lost] + [0]
        assert len(gaps) == len([k for k in lost if k - 1 not in lost]) and all(p == "block digest differs" for *_, p in gaps)
    half = whole[: len(whole) // 2]
    for content, after in ((half, []), (half + gzip.compress(plain[7]), [7]), (half + plain[7], [7])):
        good, gaps = read(content)
        head = good[: len(good) - len(after)]
        assert head == list(range(len(head))) and 25 <= len(head) <= 31 and good[len(head) :] == after
        assert len(gaps) == 1 and gaps[0][1] == len(half)
    good, gaps = read(whole[:-8])
    assert good == list(range(60)) and [p for *_, p in gaps] == [warc.TRUNCATED]
    flipped = bytearray(whole)
    flipped[len(whole) // 2] ^= 0x10
    good, gaps = read(bytes(flipped) + gzip.compress(plain[3]))
    assert good[-1] == 3 and len(good) >= 27 and set(good[:25]) == set(range(25)) and gaps
    stored = bytearray(gzip.compress(b"".join(plain), 0, mtime=0))
    stored[stored.index(b"payload 40")] ^= 0x20
    good, gaps = read(bytes(stored))
    assert good == [k for k in range(60) if k != 40] and gaps


def test_pii_takes_many_spans_in_one_text(spark):
    import time

    text = " ".join(f"m{k}@host{k % 7}.example.org" for k in range(20_000))
    docs = docs_of(spark, [(1, text, "en", "a"), (2, "plain words", "en", "a")])
    start = time.time()
    found = {r["doc_id"]: r["spans"] for r in pii.find(docs).collect()}
    assert [(s["start"], s["stop"]) for s in found[1] if s["ok"] and s["kind"] == 0] == [m.span() for m in re.finditer(BASE["email"], text)]
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert clean == {1: " ".join(["[EMAIL]"] * 20_000), 2: "plain words"}
    assert time.time() - start < 120


def test_pii_label_model_and_classifier(spark):
    rng = random.Random(4)
    rows = [(k, f"Dear {rng.choice(pii.GIVEN)} {rng.choice(['Arnold', 'Meyer', 'Silva'])}, we met.", "en", "a") for k in range(60)]
    rows += [(100 + k, f"and chapter {rng.choice(['Upper', 'Lower', 'Outer'])} {rng.choice(['Valley', 'River', 'Gate'])} ends", "en", "a") for k in range(60)]
    rows.append((300, "Dear Zebulon Quist, we met.", "en", "a"))  # not in the gazetteer: known by its context
    named = {r["doc_id"] for r in pii.find(docs_of(spark, rows)).collect() if any(pii.KINDS[s["kind"]] == "name" for s in r["spans"])}
    assert named == {*range(60), 300}
    # two labelers that agree outweigh one that is always silent
    yes, no = 1 + 3 + 9 + 27 + 81, 2 + 6 + 18 + 54 + 162
    p = pii.label_model([(0, yes, 50.0), (0, no, 50.0)])
    assert p[yes] > 0.95 and p[no] < 0.05 and p[0] == 0.5


def test_running_combines_what_stands_before(spark):
    rows = [([rng % 7 for rng in range(n)],) for n in (0, 1, 2, 3, 10, 101)]
    got = spark.createDataFrame(rows, "v array<int>").select("v", pii._running(F.col("v"), F.lit(0), lambda a, x: a + x).alias("s")).collect()
    assert all(r["s"] == [sum(r["v"][:k]) for k in range(len(r["v"]))] for r in got)


def test_texts_that_are_not_utf8(spark):
    raw = docs_of(spark, [(k, "the thing there", "en", "a") for k in range(20)]).withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.expr("cast(X'66FF6F2074FE68' as string)")).otherwise(F.col("text")))
    labels = spark.createDataFrame([(k, 1, int(k % 2 == 0)) for k in range(20)], "doc_id long, quality int, toxic int")
    assert {r["is_toxic"] for r in toxicity.judge(raw, labels).where("doc_id % 2 = 0").collect()} == {True}
    assert langid.identify(raw).where("lang_pred = 'en'").count() == 20
    assert langid.Encoder().trigrams(b"\xff\xfe 12") is None
    pages = raw.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://x.org/"), "text").alias("url"))
    assert urlfilter.judge(pages).count() == 20 and urlfilter.judge(pages.withColumn("url", F.concat(F.lit("http://y/"), "url"))).count() == 20


def test_language_prediction_matches_brute_force(spark):
    import numpy as np

    rng = random.Random(14)
    rows = [(k, " ".join(rng.choices(["abba", "Cäsar", "delta", "x1y"], k=4)), "de" if k % 2 else "en", "a") for k in range(40)]

    def letter(c):
        return 2 * np.random.Generator(np.random.PCG64([langid.SEED, ord(c)])).integers(0, 2, langid.DIMENSION) - 1

    def vector(text):
        plain = " " + re.sub("[^a-zäöü]+", " ", text.lower()).strip() + " "
        return sum(np.roll(letter(plain[i]), 2) * np.roll(letter(plain[i + 1]), 1) * letter(plain[i + 2]) for i in range(len(plain) - 2))

    out = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    known = {la: sum(vector(t) for i, t, x, _ in rows if x == la and not out(i)) for la in ("de", "en")}
    for r in langid.identify(docs_of(spark, rows)).collect():
        v = vector(rows[r["doc_id"]][1])
        cosines = {la: float(v @ p / np.linalg.norm(v) / np.linalg.norm(p)) for la, p in known.items()}
        best = max(sorted(cosines), key=lambda la: round(cosines[la], 12))
        assert r["lang_pred"] == best and r["score"] == pytest.approx(min(1, max(0, cosines[best])), abs=1e-6)


def test_url_ratio_matches_brute_force():
    urls = [b"http://a/xx", b"http://a/xyx", b"http://b/x"]
    model, order = urlfilter.MarkovModel(urls), urlfilter.ORDER
    text = [b"\n" * order + u + b"\n" for u in urls]

    def p(context, byte, k):
        """Witten-Bell from the definition: counts of a context of k bytes mixed with those of the next shorter one."""
        below = 1 / 256 if k == 0 else p(context, byte, k - 1)
        c = context[len(context) - k :]
        after = [t[i] for t in text for i in range(order, len(t)) if t[i - k : i] == c]
        if not after or (k and len(after) < urlfilter.LEAST):
            return below if not after or k == 0 else p(context, byte, k - 1)
        return (after.count(byte) + len(set(after)) * below) / (len(after) + len(set(after)))

    for probe in (b"http://a/xyx", b"zz"):
        padded = b"\n" * order + probe + b"\n"
        for i in range(order, len(padded)):
            assert model.probability(padded[i - order : i], padded[i]) == pytest.approx(p(padded[i - order : i], padded[i], order))


def test_toxicity_folds_hold_equal_texts_together(monkeypatch):
    import numpy as np

    rng = random.Random(1)
    features = [np.unique(np.array(rng.sample(range(500), 5), np.int32)) for _ in range(40)] * 3  # every text three times
    labels = [rng.random() < 0.5 for _ in range(40)] * 3  # nothing to learn
    monkeypatch.setattr(toxicity, "examples", lambda *_: (features, np.zeros((120, toxicity.STYLE)), {"toxic": labels}))
    seen = []
    threshold = toxicity._threshold
    monkeypatch.setattr(toxicity, "_threshold", lambda p, y: seen.append((p, y)) or threshold(p, y))
    toxicity.train(None, None, ["toxic"])
    p, y = seen[0]
    assert abs(p[y == 1].mean() - p[y == 0].mean()) < 0.25  # out-of-fold probabilities know nothing of random labels


def test_rarest_shingles_meet_and_leave_a_common_passage(spark, monkeypatch):
    monkeypatch.setattr(simhash, "FEW", 4)
    rng = random.Random(5)
    passage = rng.sample(range(10_000), 60)
    sets = [sorted({*rng.sample(range(10_000, 10**6), 60), *passage}) for _ in range(12)]
    for own in list(sets[:6]):
        sets.append(sorted({*own[:54], *own[60:], *rng.sample(range(10_000, 10**6), 4)}))
    rows = spark.createDataFrame([(k, s) for k, s in enumerate([*sets, []])], "fp long, shingles array<long>")
    found = {}
    for r in simhash.rarest_shingles(rows).collect():
        found.setdefault(r["fp"], set()).add(r["bits"])
    assert len(sets) not in found
    for a in range(len(sets)):
        assert not found[a] & set(passage)
        for b in range(a):
            if len({*sets[a]} & {*sets[b]}) >= 0.8 * len({*sets[a]} | {*sets[b]}):
                assert found[a] & found[b]


def test_sketches_tell_similar_texts_from_others():
    rng = np.random.default_rng(3)
    factors = np.array([xxhash.xxh64_intdigest(str(k), simhash.SEED) | 1 for k in range(simhash.SKETCH)], np.uint64)
    same = {0.8: [], 0.33: []}
    for share, found in same.items():
        for _ in range(300):
            n = 120
            both = round(2 * n * share / (1 + share))
            hashes = rng.integers(0, 1 << 63, 2 * n - both, np.uint64) * np.uint64(2) + np.uint64(1)
            a, b = (simhash.least_hashes(part, factors).astype(np.uint8) for part in (hashes[:n], hashes[n - both :]))
            found.append(int((a == b).sum()))
    assert abs(np.mean(same[0.8]) / simhash.SKETCH - 0.8) < 0.02
    assert min(same[0.8]) >= simhash.SKETCH_SAME > max(same[0.33])


@pytest.mark.parametrize("few", [2, 8])
def test_keep_one_with_crowded_shards_matches_all_pairs(spark, monkeypatch, few):
    monkeypatch.setattr(simhash, "FEW", few)
    monkeypatch.setattr(simhash, "PIECE_ROWS", 7)
    rng = random.Random(23)
    words = [f"w{k}" for k in range(4000)]
    passages = [rng.choices(words, k=60) for _ in range(2)]
    texts = {}
    for k in range(60):
        texts[k] = " ".join(rng.choices(words, k=60) + passages[k % 2])
    base = rng.choices(words, k=150)
    for k in range(60, 90):  # a large group of near copies
        edited = list(base)
        for _ in range(rng.randint(0, 3)):
            edited[rng.randrange(150)] = rng.choice(words)
        texts[k] = " ".join(edited)
    for k in range(90, 100):  # texts of shared passages alone
        texts[k] = " ".join(passages[k % 2] + passages[1 - k % 2] if k < 95 else passages[k % 2])
    kept = {r["doc_id"] for r in simhash.keep_one(docs_of(spark, [(i, t, "en", "s") for i, t in texts.items()])).collect()}
    assert kept == set(brute_similar(texts).values())


def test_training_order_has_a_row_for_each_pass(spark, tmp_path):
    rows = awkward() + [(4, "five words are in here", "en", "a")] * 50 + [(k, "one two three", "en", "b") for k in range(500, 540)]
    docs_of(spark, rows).repartition(3).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    found = mixing.mixture(docs).collect()
    due = Counter((r["doc_id"], r["source"], r["size"], at) for r in found for at in r["positions"])
    assert any(len(r["positions"]) == 2 for r in found)
    target = {r["source"]: r["target"] for r in found}
    for stored in (False, True):
        got, words = mixing.training(docs, stored=stored).collect(), Counter()
        assert Counter((r["doc_id"], r["source"], r["mix_size"], r["mix_position"]) for r in got) == due
        places = [r["mix_position"] for r in got]
        assert places == sorted(places)
        for r in got:
            words[r["source"]] += r["mix_taken"]
            assert 0 < r["mix_taken"] <= r["mix_size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
        assert all(words[s] == math.floor(target[s]) for s in target)
    sized = mixing.sizes(docs).withColumn("row", F.monotonically_increasing_id())
    order = mixing.training_order(mixing.mix(sized)).collect()
    assert [r["position"] for r in order if r["nth"] is not None] == sorted(at for r in found for at in r["positions"])
    assert all(r["nth"] is None for r in order[sum(due.values()) :]) and len({r["row"] for r in order}) == len(rows)
    assert mixing.training(docs_of(spark, EMPTY)).count() == 0


def test_decontamination_leaves_no_postings_behind(spark, tmp_path):
    from pathlib import Path

    from quarrylake.storage import shared_dir

    words = " ".join(f"word{k}" for k in range(13))
    docs = docs_of(spark, [(1, words, "en", "a"), (1, words, "en", "a"), (2, "other text", "en", "a"), (None, None, "en", "a")])
    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    kept = decontaminate.remove_contaminated(docs, spark.createDataFrame([(1, words)], "item_id long, text string"))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "None"]
    left = {p.name.split("-")[0] for p in set(folder.iterdir()) - before}
    assert "contaminated" in left and "postings" not in left
