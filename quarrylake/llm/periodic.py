"""Periodic runs of words: documents are cut into overlapping tiles for each octave of periods, tiles are solved on their own
with Z-functions at their boundaries, and the fragments are stitched by document and period."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylake.storage import stash

#: Words of the shortest run.
LEAST = 12
#: Words whose documents are looked through together.
GROUP_WORDS = 200_000
#: Words that the boundaries of a tile are spread over, and the least number of boundaries.
TILE_WORDS, LEAST_BOUNDS = 4096, 8
#: The first octave has the periods 1 to 7 and boundaries 2 words apart.
FIRST_HIGH, FIRST_GRAIN = 8, 2
TILES = "array<struct<low: int, base: int, whole: boolean, at: binary, codes: binary>>"
PARSED = "doc_id {id}, key binary, words_sha256 string, n_words long, words binary, tiles " + TILES


def need(period: int) -> int:
    """The fewest consecutive words that equal the word a period later in a run."""
    return max(LEAST - period, period)


def repeat_tail(words: list[bytes], doc_id) -> list[bytes]:
    """The words of a document with a planted run: for one id in ten, by its checksum, the tail repeats 3 to 10 times."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def tiles(documents: list[list[bytes]]) -> list[list[dict]]:
    """The tiles of each document in which a run can be: low (the octave's least period), base (the first word), whole (no
    run of the octave goes on in another tile), at (boundaries, from base on), codes (a number for each word).

    Boundaries of an octave are grain words apart, and each of its runs has grain consecutive words from a boundary on that
    occur again a period later; boundaries where no such words recur get no tile. Substrings of 2, 4, 8, ... words have
    names, each from two names of half the length, so equal names are equal words.
    """
    import numpy as np

    found: list[list[dict]] = [[] for _ in documents]
    known: dict[bytes, int] = {}
    codes = [np.array([known.setdefault(w, len(known)) for w in ws], np.int64) for ws in documents]
    live = [d for d, c in enumerate(codes) if len(c) >= LEAST]
    if not live:
        return found
    # All documents in a row, each followed by a word of its own.
    flat = np.concatenate([part for d in live for part in (codes[d], [len(known) + d])])
    start = np.cumsum([0] + [len(codes[d]) + 1 for d in live[:-1]])
    doc = np.repeat(np.arange(len(live)), [len(codes[d]) + 1 for d in live])
    live = np.array(live)

    def cut(blocks, grain: int, low: int) -> None:
        """Tiles around the boundaries blocks, ascending places in flat."""
        reach, most = 2 * grain, max(LEAST_BOUNDS, TILE_WORDS // grain)
        for d in np.unique(doc[blocks]):
            places = blocks[doc[blocks] == d] - start[d]
            own = codes[live[d]]
            breaks = np.flatnonzero(np.diff(places) > 4 * reach) + 1
            for part in np.split(places, breaks):
                for k in range(0, len(part), most):
                    at = part[k : k + most]
                    base = max(0, int(at[0]) - reach)
                    held = own[base : int(at[-1]) + 3 * reach]
                    found[live[d]].append({"low": low, "base": base, "whole": len(part) <= most, "at": (at - base).astype(np.int32).tobytes(), "codes": held.astype(np.int32).tobytes()})

    # First octave: words that equal the word q later, often enough in a row.
    covered = np.zeros(len(flat) + 1, np.int64)
    for q in range(1, FIRST_HIGH):
        same = np.flatnonzero(np.diff(np.concatenate([[0], (flat[:-q] == flat[q:]).view(np.int8), [0]])))
        first, stop = same[::2], same[1::2]
        long = stop - first >= need(q)
        np.add.at(covered, first[long], 1)
        np.add.at(covered, stop[long], -1)
    inside = np.cumsum(covered)[:-1] > 0
    if inside.any():
        blocks = np.flatnonzero(inside)
        blocks = blocks[(blocks - start[doc[blocks]]) % FIRST_GRAIN == 0]
        cut(blocks[inside[np.minimum(blocks + FIRST_GRAIN - 1, len(flat) - 1)]], FIRST_GRAIN, 1)

    # The same word has another name in each document, so that passages which documents share do not count as repeated.
    names, grain = np.unique(doc * (len(known) + len(documents)) + flat, return_inverse=True)[1], 1
    while True:
        # Names of substrings of twice the length; documents in which none occurs twice have no longer ones either.
        pair = np.full(len(names), -1, np.int64)
        pair[: len(names) - grain] = names[: len(names) - grain] * (names.max() + 1) + names[grain:]
        pair[len(names) - grain :] = -1 - np.arange(grain)
        _, names, count = np.unique(pair, return_inverse=True, return_counts=True)
        grain *= 2
        twice = count[names] > 1
        some = np.zeros(len(start), bool)
        some[doc[twice]] = True
        if not some.any():
            return found
        if not some.all():
            stay = some[doc]
            sizes = np.bincount(doc, minlength=len(start))[some]
            names, live = names[stay], live[some]
            start, doc = np.cumsum(np.concatenate([[0], sizes[:-1]])), np.repeat(np.arange(len(sizes)), sizes)
        low = 2 * grain
        if low < FIRST_HIGH:
            continue
        place = np.arange(len(names))
        keys = names * (2 * len(names) + 3 * low) + place
        order = np.sort(keys)
        blocks = place[(place - start[doc]) % grain == 0]
        again = np.searchsorted(order, keys[blocks] + 2 * low) > np.searchsorted(order, keys[blocks] + low)
        if again.any():
            cut(blocks[again], grain, low)


def z_function(s: list) -> list[int]:
    """For each place the length of the longest common prefix of s and the rest of s from there on."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    if n:
        z[0] = n
    return z


def primitive(q: int, stretch: list) -> bool:
    """Whether a stretch of period q and length 2 * q or more has no smaller period: such a one would divide q."""
    rest, factor = q, 2
    while rest > 1:
        if factor * factor > rest:
            factor = rest
        if rest % factor == 0:
            d = q // factor
            if stretch[d:] == stretch[: len(stretch) - d]:
                return False
            while rest % factor == 0:
                rest //= factor
        factor += 1
    return True


def solve(low: int, base: int, whole: bool, at: list[int], codes: list[int]) -> list[tuple[int, int, int]]:
    """(period, start, stop) of a tile: words from start to before stop equal the word a period later.

    One Z-function from each boundary on and one back from it give, for every period of the octave, how far that holds on
    both sides, at most to the next boundaries. What may go on in another tile is given however short it is; in whole
    tiles only runs with their smallest period are.
    """
    high = FIRST_HIGH if low == 1 else 2 * low
    grain = FIRST_GRAIN if low == 1 else low // 2
    reach = 2 * grain
    pieces: dict[int, list[list]] = {}
    for b in at:
        ahead = z_function(codes[b : b + 3 * reach])
        good = [q for q in range(low, min(high, len(ahead))) if ahead[q] >= grain]
        if not good:
            continue
        first, last = max(0, b - reach), min(len(codes), b + high - 1)
        back = z_function([*codes[first:b][::-1], -1, *codes[first:last][::-1]])
        for q in good:
            right = min(ahead[q], reach)
            left = min(back[b - first + 1 + last - b - q], reach) if b > first and b + q <= last else 0
            held = pieces.setdefault(q, [])
            if held and b - left <= held[-1][1]:
                held[-1][1], held[-1][3] = max(held[-1][1], b + right), right == reach
            else:
                held.append([b - left, b + right, left == reach, right == reach])
    return [
        (q, base + a, base + e)
        for q, held in pieces.items()
        for a, e, before, after in held
        if before or after or (e - a >= need(q) and (not whole or primitive(q, codes[a : e + q])))
    ]


def _parse(edit: Callable | None, id_type):
    def parse(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = (id_type, pa.binary(), pa.string(), pa.int64(), pa.binary(), pa.list_(pa.struct([("low", pa.int32()), ("base", pa.int32()), ("whole", pa.bool_()), ("at", pa.binary()), ("codes", pa.binary())])))

        def out(ids, documents):
            cut = tiles(documents)
            joined = [b" ".join(ws) for ws in documents]
            hashes = [hashlib.sha256(j) for j in joined]
            columns = (ids, [h.digest()[:16] for h in hashes], [h.hexdigest() for h in hashes], [len(ws) for ws in documents], [j if t else None for j, t in zip(joined, cut, strict=True)], [t or None for t in cut])
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "key", "words_sha256", "n_words", "words", "tiles"])

        for batch in batches:
            ids, documents, size = [], [], 0
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = (text.as_py() or b"").split()
                words = edit(words, i) if edit else words
                if documents and size + len(words) > GROUP_WORDS:
                    yield out(ids, documents)
                    ids, documents, size = [], [], 0
                ids.append(i)
                documents.append(words)
                size += len(words)
            if documents:
                yield out(ids, documents)

    return parse


def _solve(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        keys, periods, starts, stops = [], [], [], []
        for row in batch.to_pylist():
            t = row["tile"]
            for q, a, e in solve(t["low"], t["base"], t["whole"], np.frombuffer(t["at"], np.int32).tolist(), np.frombuffer(t["codes"], np.int32).tolist()):
                keys.append(row["key"])
                periods.append(q)
                starts.append(a)
                stops.append(e)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *(pa.array(c, pa.int64()) for c in (periods, starts, stops))], names=["key", "period", "start", "stop"])


def _collapse(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        texts = []
        for words, runs in zip(batch.column("words"), batch.column("runs").to_pylist(), strict=True):
            words = words.as_py().split()
            change = np.zeros(len(words) + 1, np.int64)
            for r in runs:
                change[r["start"] + r["period"]] += 1
                change[r["start"] + r["length"]] -= 1
            texts.append(b" ".join(words[k] for k in np.flatnonzero(np.cumsum(change)[:-1] == 0)))
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("runs"), pa.array(texts, pa.binary())], names=["key", "runs", "collapsed"])


def stitch(fragments: DataFrame) -> DataFrame:
    """(key, start, length, period) of all runs from (key, period, start, stop): fragments of one document and period that
    meet or overlap are one stretch; of periods with the same stretch the smallest is the run's."""
    order = Window.partitionBy("key", "period").orderBy("start", "stop")
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("start") <= before, 0).otherwise(1)
    pieces = fragments.groupBy("key", "period", "start").agg(F.max("stop").alias("stop"))
    islands = pieces.withColumn("new", new).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = islands.groupBy("key", "period", "island").agg(F.min("start").alias("start"), (F.max("stop") - F.min("start") + F.col("period")).alias("length"))
    long = whole.where((F.col("length") >= LEAST) & (F.col("length") >= 2 * F.col("period")))
    return long.groupBy("key", "start", "length").agg(F.min("period").alias("period"))


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edit: Callable | None = None) -> DataFrame:
    """(doc_id, n_words, words_sha256, runs, collapsed) for each row of docs.

    Words are separated by ASCII white space. runs has each maximal stretch of at least LEAST words, and of twice its smallest
    period, as (start, period, length), in order. collapsed has the words that no run repeats, joined by spaces; it is null
    where nothing repeats, and words_sha256 is the hash of all words so joined. edit, a function of words and id, changes the
    words first.

    Texts with the same words (by 128 bits of their hash) are solved once. A tile has some thousand words at most but for the long periods, so a long
    document's tiles are solved in many tasks. Null and empty texts have no words and no runs, rows that repeat each get
    their row, and an empty table gives an empty result. Other columns are not read; bytes that are not UTF-8 are parts of words.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    id_type = source.select("doc_id").limit(0).toArrow().schema.field(0).type
    parsed = stash(source.mapInArrow(_parse(edit, id_type), PARSED.format(id=docs.schema[id_col].dataType.simpleString())), "periodic-documents")
    candidates = parsed.where("tiles is not null")
    dealt = candidates.select("key", F.explode("tiles").alias("tile")).select("key", F.col("tile.low").alias("low"), F.col("tile.base").alias("base"), "tile")
    found = stitch(dealt.dropDuplicates(["key", "low", "base"]).select("key", "tile").mapInArrow(_solve, "key binary, period long, start long, stop long"))
    listed = found.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    kind = listed.schema["runs"].dataType.simpleString()
    texts = candidates.select("key", "words").dropDuplicates(["key"])
    collapsed = texts.join(listed, "key").mapInArrow(_collapse, f"key binary, runs {kind}, collapsed binary")
    collapsed = stash(collapsed.withColumn("collapsed", F.col("collapsed").cast("string")), "periodic-runs")
    none = F.array().cast(kind)
    columns = ["doc_id", "n_words", "words_sha256"]
    plain = parsed.where("tiles is null").select(*columns, none.alias("runs"), F.lit(None).cast("string").alias("collapsed"))
    return plain.unionByName(candidates.join(collapsed, "key", "left").select(*columns, F.coalesce("runs", none).alias("runs"), "collapsed"))
