"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylake.llm.langid import is_held_out
from quarrylake.storage import stash

#: A token's class is a hash of its last two bytes. Its PLACES - 1 most frequent tokens have a place of their own in the
#: softmax within the class; the last place holds all others.
CLASSES, PLACES = 32, 32
#: Hashed features: the token before, the two tokens before, and the one before that with the last one skipped.
KINDS = 3
#: Rows of weights of each kind and softmax: a power of two that grows with the training tokens, one for about so many of
#: them, up to a bound that keeps all weights within 13 MB, since they are broadcast.
TOKENS_PER_SLOT, LEAST_SLOTS, MOST_SLOTS = 16, 1 << 12, 1 << 14
#: Gradient updates; the share of the way that one goes, and the pseudo-count that damps rare features.
ROUNDS, STEP, DAMPING = 2, 0.7, 4.0
#: Tokens that are worked on at once, and after how many such steps single-precision sums are added up.
STEP_TOKENS, STEPS_PER_SUM = 16_384, 64
#: Most token counts that are broadcast: the largest ones. All others are looked up by a join.
FREQUENT = 1 << 17
FLUSH = 300_000
#: Training tokens for each part of the contexts; tokens and documents that are dealt to parts at once.
PART_TOKENS, DEAL_TOKENS, DEAL_ROWS = 1 << 18, 1 << 20, 60_000
#: Training tokens for each task that sums up what the model expects: a task's sums take as many bytes as some millions of tokens.
SUM_TOKENS = 1 << 24
#: Bits of a code and of a leaf in the key of a token with its history.
CODE_BITS, LEAF_BITS = 18, 10
#: Rows of weights in a block, the unit in which tasks' sums meet; most tasks whose sums of a block meet at once.
BLOCK, MEET = 512, 512
END = b"\n"


def _token(word: bytes) -> int:
    """A token's signed 64-bit id: its hash, with its class in the low five bits. It is never in the range of codes."""
    from xxhash import xxh64_intdigest
    from zlib import crc32

    h = (xxh64_intdigest(word) & ~(CLASSES - 1)) | crc32(word[-2:]) % CLASSES | 1 << 40
    return h - (1 << 64) if h >> 63 else h


class _Ranks(dict):
    """A frequent token's rank, any other token's id."""

    def __init__(self, ranks: dict[int, int]) -> None:
        self.ranks = ranks

    def __missing__(self, word: bytes) -> int:
        if len(self) > FLUSH:
            self.clear()
        own = _token(word)
        self[word] = found = self.ranks.get(own, own)
        return found


def _tokens(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased, cut at ASCII white space, with an end token."""
    return [*(text or b"").lower().split(), END]


def token_counts(texts: DataFrame) -> DataFrame:
    """(id, n): how often each token occurs in all texts of the one column of texts; kept in the shared folder."""

    def run(batches: Iterator) -> Iterator:
        from collections import Counter

        import pyarrow as pa

        def part(counts: Counter):
            return pa.RecordBatch.from_arrays([pa.array(map(_token, counts), pa.int64()), pa.array(counts.values(), pa.int64())], names=["id", "n"])

        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                counts.update(_tokens(text))
                if len(counts) > FLUSH:
                    yield part(counts)
                    counts.clear()
        yield part(counts)

    return stash(texts.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")), "lm-counts")


def _most_frequent(counts: DataFrame):
    """Ids and counts of the most frequent tokens, most frequent first: all that occur at least 2^k times, for the least k
    for which these are no more than FREQUENT."""

    sizes = {r["k"]: r["m"] for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).agg(F.count("*").alias("m")).collect()}
    least = min((k for k in range(65) if sum(m for j, m in sizes.items() if j >= k) <= FREQUENT))
    top = counts.where(F.floor(F.log2("n")).cast("int") >= least).toArrow()
    ids, n = (top.column(c).to_numpy() for c in ("id", "n"))
    order = np.lexsort((ids, -n))
    return ids[order], n[order]


class Vocabulary:
    """What is known of tokens: codes, places in the softmax, and smoothed counts.

    A token's code is its rank among the frequent ones, or what stands behind these for its class. leaf is the code's place
    times CLASSES plus its class. totals has, for each class, the occurrences and the number of its learned tokens.
    """

    def __init__(self, ids, n, totals: dict[int, tuple[int, int]]) -> None:

        self.size = len(ids)
        self.sorted, order = np.sort(ids), np.argsort(ids)
        self.rank = order.astype(np.int32)
        classes = (ids & (CLASSES - 1)).astype(np.int64)
        self.leaf = np.concatenate([np.empty(self.size, np.int64), (PLACES - 1) * CLASSES + np.arange(CLASSES)])
        held, kinds = np.zeros((CLASSES, PLACES)), np.zeros(CLASSES)
        for c in range(CLASSES):
            own = np.flatnonzero(classes == c)
            place = np.minimum(np.arange(len(own)), PLACES - 1)
            self.leaf[own] = place * CLASSES + c
            held[c, : min(len(own), PLACES - 1)] = n[own[: PLACES - 1]]
            all_n, all_v = totals.get(c, (0, 0))
            held[c, -1] = all_n - held[c, :-1].sum()
            kinds[c] = all_v - min(len(own), PLACES - 1)
        total = held.sum()
        #: log10 of the smoothed count of a frequent token, and of the mass that the other tokens of a class share
        self.count = np.log10(n + 0.5) if self.size else np.zeros(0)
        self.under = np.log10(held[:, -1] + 0.5 * (kinds + 1))
        self.by_class = np.log((held.sum(1) + 0.5) / (total + 0.5 * CLASSES)).astype(np.float32)
        inside = np.log((held + 0.5) / (held.sum(1, keepdims=True) + 0.5 * PLACES))
        inside[:, :-1][held[:, :-1] == 0] = -1e4  # places that no token has
        self.by_place = inside.astype(np.float32)
        self.end = int(self.encode(np.array([_token(END)]))[0])
        #: training occurrences of each code
        self.seen = np.concatenate([n, [totals.get(c, (0, 0))[0] - n[classes == c].sum() for c in range(CLASSES)]]).astype(np.int64)
        self.seen_leaf = np.bincount(self.leaf, self.seen, PLACES * CLASSES).astype(np.int64)
        #: the end token's leaf is its own, so an end before a token means that it is a text's first: the features of that end
        #: and of the two ends before it have equal sums
        self.lone_end = bool(self.leaf[self.end] < (PLACES - 1) * CLASSES)

    def encode(self, ids):
        """Codes of token ids."""

        tail = self.size + (ids & (CLASSES - 1))
        if not self.size:
            return tail.astype(np.int32)
        at = np.minimum(np.searchsorted(self.sorted, ids), self.size - 1)
        return np.where(self.sorted[at] == ids, self.rank[at], tail).astype(np.int32)


def history(codes, lengths, end: int):
    """The codes one and two places before each token; before a text stand ends of texts."""

    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
    one, two = np.full_like(codes, end), np.full_like(codes, end)
    one[1:], two[2:] = codes[:-1], codes[:-2]
    one[starts] = two[starts] = end
    two[(starts + 1)[lengths > 1]] = end
    return one, two


class Model:
    """Weights of the two softmaxes as one array of rows: KINDS * slots for classes, then KINDS * slots for places.

    A class row is a hashed context of token codes; a place row is a hashed context of leaves within one class, so that rows
    of different classes never meet.
    """

    def __init__(self, words: Vocabulary, slots: int, weights=None) -> None:

        self.words, self.slots = words, slots
        self.weights = np.zeros((2 * KINDS * slots, PLACES), np.float32) if weights is None else weights

    def rows(self, codes, one, two):
        """(classes, places, rows of the class softmax, rows of the place softmax) of tokens with their history."""
        slots = self.slots
        leaf = self.words.leaf
        own = leaf[codes]
        classes, places = own % CLASSES, own // CLASSES
        mix = lambda a, b: ((a.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) ^ b.astype(np.uint64)) * np.uint64(0x165667B19E3779F9)) >> np.uint64(32)
        single = lambda a: (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        kinds = np.arange(KINDS)[:, None]
        of_class = (np.stack([single(one), mix(one, two), single(two)]) % np.uint64(slots)).astype(np.int64) + kinds * slots
        each = slots // CLASSES
        before, last = leaf[one], leaf[two]
        inside = np.stack([before % each, (mix(before, last) % np.uint64(each)).astype(np.int64), last % each])
        return classes, places, of_class, inside + classes * each + (KINDS + kinds) * slots

    def _softmax(self, start, rows):
        z = start + self.weights[rows[0]]
        for r in rows[1:]:
            z += self.weights[r]
        z -= z.max(axis=1, keepdims=True)
        z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
        return z

    def log_softmaxes(self, codes, one, two):
        """Natural logs of both softmaxes for a step of tokens, with what rows() gives."""
        found = self.rows(codes, one, two)
        classes, _, of_class, inside = found
        return self._softmax(self.words.by_class, of_class), self._softmax(self.words.by_place[classes], inside), found

    def log10(self, codes, one, two):
        """log10 of each token's class and place."""
        out = np.empty(len(codes))
        for at in range(0, len(codes), STEP_TOKENS):
            s = slice(at, at + STEP_TOKENS)
            by_class, by_place, (classes, places, *_) = self.log_softmaxes(codes[s], one[s], two[s])
            k = np.arange(len(classes))
            out[s] = by_class[k, classes] + by_place[k, places]
        return out / np.log(10)


class Sums:
    """Sums over tokens, by row and place: how often a feature occurs, or how often the model expects it to."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.total = np.zeros(model.weights.size)
        self.part = np.zeros(model.weights.size, np.float32)
        self.steps = 0

    def observe(self, codes, one, two) -> None:
        classes, places, of_class, inside = self.model.rows(codes, one, two)
        for rows, place in ((of_class, classes), (inside, places)):
            for r in rows:
                np.add.at(self.total, r * PLACES + place, 1.0)

    def expect(self, codes, one, two) -> None:
        *logs, (_, _, of_class, inside) = self.model.log_softmaxes(codes, one, two)
        places, at = np.arange(PLACES), np.empty((len(codes), PLACES), np.int64)
        for z, rows in zip(logs, (of_class, inside), strict=True):
            # into an array made here: add.at is twenty times slower with the data type object of an unpickled one
            p = np.exp(z, out=np.empty(z.shape, np.float32)).ravel()
            for r in rows:
                np.add(r[:, None] * PLACES, places, out=at)
                np.add.at(self.part, at.ravel(), p)
        self.steps += 1
        if self.steps % STEPS_PER_SUM == 0:
            self.flush()

    def flush(self) -> None:
        self.total += self.part
        self.part[:] = 0

    def blocks(self) -> Iterator[tuple[int, bytes]]:
        """(number, sums) of the blocks that are not zero. Values are whole multiples of 2^-20 in single precision, so that
        tasks' sums add up exactly in double precision, in any order."""
        self.flush()
        values = np.rint(self.total * (1 << 20)) / (1 << 20)
        for k, block in enumerate(values.astype(np.float32).reshape(-1, BLOCK * PLACES)):
            if block.any():
                yield k, block.tobytes()


def _feature_sums(stored: DataFrame, shared, expected: bool):
    """The sums of all tasks over the tokens of stored texts; the model is shared by broadcast."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        model = shared.value
        sums = Sums(model)
        learn = sums.expect if expected else sums.observe
        for batch in batches:
            codes, lengths = _flat(batch.column(0))
            if len(codes):
                one, two = history(codes, lengths, model.words.end)
                for at in range(0, len(codes), STEP_TOKENS):
                    s = slice(at, at + STEP_TOKENS)
                    learn(codes[s], one[s], two[s])
        part = TaskContext.get().partitionId()
        for k, block in sums.blocks():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part], pa.int32()), pa.array([block], pa.binary())], names=["block", "part", "sums"])

    parts = stored.select("tokens").mapInArrow(run, "block int, part int, sums binary")
    tasks = stored.select("tokens").rdd.getNumPartitions()
    if tasks > MEET:
        parts = _summed(parts.withColumn("part", (F.col("part") / MEET).cast("int")).repartition("block", "part"))
    total = np.zeros((shared.value.weights.size // (BLOCK * PLACES), BLOCK * PLACES))
    for r in _summed(parts.repartition("block")).collect():
        total[r["block"]] = np.frombuffer(r["sums"])
    return total.reshape(-1, PLACES)


def _summed(parts: DataFrame) -> DataFrame:
    """Sums of the arrays of each block that a task holds, added one by one."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict[int, object] = {}
        for batch in batches:
            for block, sums in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own = np.frombuffer(sums, np.float64 if len(sums) == 8 * BLOCK * PLACES else np.float32)
                if block in held:
                    held[block] += own
                else:
                    held[block] = own.astype(np.float64)
        for block, sums in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([0], pa.int32()), pa.array([sums.tobytes()], pa.binary())], names=["block", "part", "sums"])

    return parts.mapInArrow(run, "block int, part int, sums binary")


def _flat(column):
    """Values and lengths of an Arrow list column."""

    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], np.diff(offsets)


def slots_for(tokens: int) -> int:
    """Rows of weights of each kind and softmax of a Model for so many training tokens; score() has no such bound."""
    wanted = max(1, tokens // TOKENS_PER_SLOT)
    return min(MOST_SLOTS, max(LEAST_SLOTS, 1 << (wanted.bit_length() - 1)))


def _mixed(a):
    """A 32-bit hash of whole numbers."""
    a = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (a ^ (a >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(32)


def parts_of(one, two, doc, words: Vocabulary, parts: int):
    """The part of each token's context: by the leaf of the token before, and by that of the one before that where the leaf is
    so frequent that it has several parts. So all tokens of a context of codes, or of leaves, are in one part. Only the first
    tokens of texts, which have one context, are dealt by document if there are too many: see Vocabulary.lone_end."""
    before, last = words.leaf[one], words.leaf[two]
    several = (words.seen_leaf // PART_TOKENS + 1).astype(np.uint64)[before]
    by = np.where(one == words.end, doc, last) if words.lone_end else last
    return ((_mixed(before) + _mixed(by) % several) % np.uint64(parts)).astype(np.int64)


def _deal(words_shared, parts: int, train: bool):
    """Tokens with their history, sorted by part and context; first is the number of the first document, doc counts from it.
    To train, only tokens of texts that are not held out, without their documents."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        words = words_shared.value

        def part(first: int, codes, lengths, held):
            one, two = history(codes, lengths, words.end)
            doc = np.repeat(np.arange(len(lengths)), lengths)
            own = parts_of(one, two, doc + first, words, parts)
            leaf = words.leaf[codes]
            if train:
                one, two, leaf, doc, own = (x[~held[doc]] for x in (one, two, leaf, doc, own))
            order = np.argsort((one.astype(np.int64) << (CODE_BITS + LEAF_BITS)) + (two.astype(np.int64) << LEAF_BITS) + leaf)
            if parts > 1:
                order = order[np.argsort(own[order].astype(np.uint16 if parts <= 1 << 16 else np.int64), kind="stable")]
            own = own[order]
            at = np.concatenate(([0], np.flatnonzero(np.diff(own)) + 1, [len(own)])) if len(own) else np.zeros(1, np.int64)
            leaf += held[doc].astype(np.int64) << LEAF_BITS
            columns = [values[order].astype(np.int32) for values in ((one, two, leaf) if train else (one, two, leaf, doc))]
            packed = [_pack([c[x:y] for c in columns]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            found = [pa.array(own[at[:-1]], pa.int32()), pa.array(np.full(len(packed), first), pa.int64()), pa.array(np.diff(at), pa.int32()), pa.array(packed, pa.binary())]
            return pa.RecordBatch.from_arrays(found, names=["part", "first", "n", "tokens"])

        for batch in batches:
            row, held = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            codes, lengths = _flat(batch.column(2))
            ends = np.concatenate(([0], np.cumsum(lengths)))
            at = 0
            while at < len(row):
                to = int(np.searchsorted(ends, ends[at] + DEAL_TOKENS, "right")) - 1
                to = min(max(to, at + 1), at + DEAL_ROWS, len(row))
                gaps = np.flatnonzero(np.diff(row[at:to]) != 1)  # rows of another file
                to = at + int(gaps[0]) + 1 if len(gaps) else to
                yield part(int(row[at]), codes[ends[at] : ends[to]], lengths[at:to], held[at:to])
                at = to

    return run


def _pack(columns: list) -> bytes:
    """Columns of 32-bit numbers as compressed planes of bytes, the first column as differences."""
    import pyarrow as pa

    columns = [np.diff(columns[0], prepend=np.int32(0)), *columns[1:]]
    planes = np.concatenate([c.astype("<i4").view(np.uint8).reshape(-1, 4).T.ravel() for c in columns])
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(rows: list, lengths: list, columns: int = 3) -> list:
    import pyarrow as pa

    out: list = [[] for _ in range(columns)]
    for row, n in zip(rows, lengths, strict=True):
        planes = np.frombuffer(pa.decompress(row, 4 * columns * n, codec="zstd", asbytes=True), np.uint8).reshape(columns, 4, n)
        for k in range(columns):
            values = np.ascontiguousarray(planes[k].T).view("<i4").ravel()
            out[k].append(np.cumsum(values, dtype=np.int32) if k == 0 else values)
    return [np.concatenate(x) if x else np.empty(0, np.int32) for x in out]


def shared_rows(words: Vocabulary) -> tuple[int, int, int, int]:
    """Where the rows of the features that many contexts share begin: for the class softmax one for each code before, then one
    for each code before that; for the place softmax one for each class and leaf before, and leaf before that; their number."""
    codes, leaves = len(words.leaf), CLASSES * CLASSES * PLACES
    return codes, 2 * codes, 2 * codes + leaves, 2 * codes + 2 * leaves


def base(words: Vocabulary):
    """Natural logs of the class softmax and, by class, of the place softmax of the model without features."""
    return words.by_class, words.by_place - np.log(np.exp(words.by_place).sum(axis=1, keepdims=True))


def count_shared(words: Vocabulary, one, two, leaf, total) -> None:
    """Add to total, by row of a shared feature and label, how often tokens have it."""
    classes, places = leaf % CLASSES, leaf // CLASSES
    second, third, fourth, _ = shared_rows(words)
    own = classes.astype(np.int64) * (CLASSES * PLACES)
    for rows, label in ((one, classes), (second + two.astype(np.int64), classes), (third + own + words.leaf[one], places), (fourth + own + words.leaf[two], places)):
        np.add.at(total.ravel(), rows.astype(np.int64) * PLACES + label, 1.0)


def update(observed, expected):
    """What a round adds to weights: STEP times the log ratio of both sums, DAMPING added to either."""
    return (np.float32(STEP) * np.log((observed + DAMPING) / (expected + DAMPING))).astype(np.float32)


def first_round(words: Vocabulary, observed, at: int = 0):
    """The first update of the shared features from row at on; the model without features expects the same of all contexts."""
    by_class, by_place = base(words)
    rows = np.arange(at, at + len(observed)) - shared_rows(words)[1]
    start = np.concatenate([by_class[None], by_place])[np.where(rows < 0, 0, 1 + rows // (CLASSES * PLACES) % CLASSES)]
    return update(observed, observed.sum(axis=1, keepdims=True) * np.exp(start))


def contexts_of(words: Vocabulary, one, two, leaf):
    """For both softmaxes: (context of each token, its label, rows of the contexts' two shared features, whether a context is
    that of first tokens, the contexts' rows of the model without features, that model)."""
    classes, places = leaf % CLASSES, leaf // CLASSES
    by_class, by_place = base(words)
    second, third, fourth, _ = shared_rows(words)
    found, index = np.unique((one.astype(np.int64) << CODE_BITS) + two, return_inverse=True)
    before, last = found >> CODE_BITS, found & ((1 << CODE_BITS) - 1)
    yield index, classes, before, second + last, words.lone_end & (before == words.end), np.zeros(len(found), np.int64), by_class[None]
    found, index = np.unique((classes.astype(np.int64) << 2 * LEAF_BITS) + (words.leaf[one] << LEAF_BITS) + words.leaf[two], return_inverse=True)
    own, before, last = found >> 2 * LEAF_BITS, (found >> LEAF_BITS) & ((1 << LEAF_BITS) - 1), found & ((1 << LEAF_BITS) - 1)
    of_class = own * (CLASSES * PLACES)
    yield index, places, third + of_class + before, fourth + of_class + last, words.lone_end & (before == words.leaf[words.end]), own, by_place


def fitted(start, seen, shared: list, features, first):
    """Natural logs of a softmax by context and label after a round for each array of shared; start is written over.

    seen counts the training tokens of each context and label. shared has the updates of the features that contexts share,
    round by round, learned from all training tokens wherever they are (see by_parts()), features the two rows of each context.
    The weights of a context's own feature are learned here, as all its tokens are; those of first tokens, which are dealt by
    document, are those of the end before them. The gradient of a weight is how often its feature occurs less how often the
    model expects it to; an update is its ratio form, generalised iterative scaling.
    """
    n = seen.sum(axis=1, keepdims=True)
    z = start
    p = np.exp(z)
    for weights in shared:
        p *= n
        before = weights[features[0]]
        own = update(seen, p)
        own[first] = before[first]
        z += own
        z += before
        z += weights[features[1]]
        np.exp(z, out=p)
        total = p.sum(axis=1, keepdims=True)
        z -= np.log(total)
        p /= total
    return z


def _fits(words: Vocabulary, one, two, leaf, held, shared: list):
    """(rows of the two shared features, training tokens, logs, first context, context and label of each token) of
    STEP_TOKENS contexts of a softmax at a time."""
    for index, label, before, last, first, own, start in contexts_of(words, one, two, leaf):
        seen = np.bincount(index[~held] * PLACES + label[~held], minlength=len(before) * PLACES).reshape(-1, PLACES)
        order = np.argsort(index, kind="stable")
        ends = np.searchsorted(index[order], np.arange(0, len(before) + STEP_TOKENS, STEP_TOKENS))
        for k, at in enumerate(range(0, len(before), STEP_TOKENS)):
            s = slice(at, at + STEP_TOKENS)
            mine, tokens = seen[s].astype(np.float32), order[ends[k] : ends[k + 1]]
            logs = fitted(start[own[s]].astype(np.float32), mine, shared, (before[s], last[s]), first[s])
            yield before[s], last[s], mine, logs, tokens, index[tokens] - at, label[tokens]


def expect_shared(words: Vocabulary, one, two, leaf, held, shared: list, total) -> None:
    """Add to total, by row of a shared feature and label, how often the model expects the training tokens to have it."""
    for before, last, seen, logs, *_ in _fits(words, one, two, leaf, held, shared):
        p = np.exp(logs) * seen.sum(axis=1, keepdims=True)
        for rows in (before, last):
            order = np.argsort(rows, kind="stable")
            own, starts = np.unique(rows[order], return_index=True)
            total[own] += np.add.reduceat(p[order], starts, axis=0, dtype=np.float64)


def part_logs(words: Vocabulary, one, two, leaf, held, shared: list | None = None):
    """log10 of the class and the place of each token of a part, by a model of the training tokens.

    Every distinct context has weights of its own: the token before, the two before, the one before that for the class; the
    leaves of these, within the class, for the place. So the weights grow with the features, and none are shared by hash.
    shared has the updates of the first and last kind, which are those of all parts; without it the part is all there is.
    """
    if shared is None:
        observed, shared = np.zeros((shared_rows(words)[-1], PLACES)), []
        count_shared(words, one[~held], two[~held], leaf[~held], observed)
        for k in range(ROUNDS):
            expected = np.zeros(observed.shape)
            if k:
                expect_shared(words, one, two, leaf, held, shared, expected)
            shared.append(update(observed, expected) if k else first_round(words, observed))
    out = np.zeros(len(one))
    for *_, logs, tokens, index, label in _fits(words, one, two, leaf, held, shared):
        out[tokens] += logs[index, label]
    return out / np.log(10)


def _touched(total):
    """Batches of (block, part, sums): the rows of a task's sums that are not zero, as whole multiples of 2^-12."""
    import pyarrow as pa
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    for at in range(0, len(total), BLOCK):
        values = (np.rint(total[at : at + BLOCK] * (1 << 12)) / (1 << 12)).astype(np.float32)
        rows = np.flatnonzero(values.any(axis=1)).astype(np.int32)
        if len(rows):
            sums = _pack([rows, *values[rows].view(np.int32).T])
            yield pa.RecordBatch.from_arrays([pa.array([at // BLOCK], pa.int32()), pa.array([part], pa.int32()), pa.array([len(rows)], pa.int32()), pa.array([sums], pa.binary())], names=["block", "part", "rows", "sums"])


def _totals(parts: DataFrame, rows: int):
    """The sums of all tasks, by row; a task adds up those of some blocks of rows."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict[int, object] = {}
        for batch in batches:
            for block, n, sums in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                at, *values = _unpack([sums], [n], 1 + PLACES)
                held.setdefault(block, np.zeros((BLOCK, PLACES)))[at] += np.stack(values, axis=1).view(np.float32)
        for block, sums in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([sums.astype(np.float32).tobytes()], pa.binary())], names=["block", "sums"])

    total = np.zeros((-(-rows // BLOCK) * BLOCK, PLACES), np.float32)
    found = parts.repartition("block").mapInArrow(run, "block int, sums binary").toArrow()
    for block, sums in zip(found.column(0).to_pylist(), found.column(1), strict=True):
        total[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(sums.as_buffer(), np.float32).reshape(BLOCK, PLACES)
    return total[:rows]


SUMS = "block int, part int, rows int, sums binary"


def _count(words_shared):
    """Sums of how often the training tokens of stored texts have the shared features."""

    def run(batches: Iterator) -> Iterator:
        words = words_shared.value
        total = np.zeros((shared_rows(words)[-1], PLACES))
        for batch in batches:
            codes, lengths = _flat(batch.column(0))
            if len(codes):
                count_shared(words, *history(codes, lengths, words.end), words.leaf[codes], total)
        yield from _touched(total)

    return run


class Learned:
    """The updates of the shared features, round by round. It travels as packed sums, of which tasks make the weights, some
    rows at a time."""

    def __init__(self, words: Vocabulary, observed, expected: list) -> None:
        self.words, self.sums = words, [observed, *expected]

    def __getstate__(self) -> tuple:
        pieces = [[_pack([np.zeros(x.size, np.int32), x.view(np.int32).ravel()]) for x in (sums[at : at + STEP_TOKENS] for sums in self.sums)] for at in range(0, len(self.sums[0]), STEP_TOKENS)]
        return self.words, len(self.sums[0]), pieces

    def __setstate__(self, state: tuple) -> None:
        self.words, rows, pieces = state
        self.rounds = [np.empty((rows, PLACES), np.float32) for _ in pieces[0]]
        for k, piece in enumerate(pieces):
            at = k * STEP_TOKENS
            n = min(STEP_TOKENS, rows - at)
            observed, *expected = (_unpack([x], [n * PLACES], 2)[1].view(np.float32).reshape(n, PLACES) for x in piece)
            for held, found in zip(self.rounds, (first_round(self.words, observed, at), *(update(observed, e) for e in expected)), strict=True):
                held[at : at + n] = found


def _expect(learned):
    """Sums of how often the model expects the shared features; rows come sorted by part."""

    def run(batches: Iterator) -> Iterator:
        words, rounds = learned.value.words, learned.value.rounds
        total = np.zeros((shared_rows(words)[-1], PLACES))

        def add(lengths: list, tokens: list) -> None:
            one, two, leaf = _unpack(tokens, lengths)
            expect_shared(words, one, two, leaf.astype(np.int64), np.zeros(len(one), bool), rounds, total)

        part, lengths, tokens = None, [], []
        for batch in batches:
            for own, n, row in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if own != part and lengths:
                    add(lengths, tokens)
                    lengths, tokens = [], []
                part = own
                lengths.append(n)
                tokens.append(row)
        if lengths:
            add(lengths, tokens)
        yield from _touched(total)

    return run


def _fit(learned):
    def run(table):
        import pyarrow as pa

        lengths = table.column("n").to_pylist()
        one, two, leaf, doc = _unpack(table.column("tokens").to_pylist(), lengths, 4)
        logs = part_logs(learned.value.words, one, two, (leaf & ((1 << LEAF_BITS) - 1)).astype(np.int64), leaf >> LEAF_BITS > 0, learned.value.rounds)
        # whole multiples of 2^-20, so that sums do not depend on the order
        logs = np.rint(logs * (1 << 20)).astype(np.int64)
        own = (np.repeat(np.arange(table.num_rows), np.array(lengths, np.int64)) << 16) + doc
        order = np.argsort(own)
        own = own[order]
        starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        sums = (np.add.reduceat(logs[order], starts) / (1 << 20)).astype(np.float32).view(np.int32)
        docs = (own[starts] & 0xFFFF).astype(np.int32)
        at = np.searchsorted(own[starts] >> 16, np.arange(table.num_rows + 1))
        packed = [_pack([docs[x:y], sums[x:y]]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return pa.table([table.column("first").combine_chunks(), pa.array(np.diff(at), pa.int32()), pa.array(packed, pa.binary())], names=["first", "n", "logs"])

    return run


def _gather(table):
    """Sums for each document over the parts that its tokens were dealt to."""
    import pyarrow as pa

    docs, logs = _unpack(table.column("logs").to_pylist(), table.column("n").to_pylist(), 2)
    sums = np.bincount(docs, logs.view(np.float32))  # every text has an end token, so no document is missing
    return pa.table([pa.array(np.arange(len(sums)) + table.column("first")[0].as_py(), pa.int64()), pa.array(sums)], names=["row", "by_model"])


def by_parts(stored: DataFrame, words: Vocabulary, tokens: int) -> DataFrame:
    """(row, by_model): the log10 probability of each stored text by the model of all stored texts that are not held out.

    Tokens with their history are dealt to parts, as many as the training tokens ask for; all of a context are in one part,
    which fits the context's own weights and scores its tokens. The features that contexts share, one for each code or leaf
    before or before that, learn from all parts: what is observed of them, and in each round what the model expects of them,
    is summed up over all tasks. So the model is that of the whole corpus, however many parts there are, and does not depend
    on how rows are dealt to tasks.
    """
    parts = -(-max(1, tokens) // PART_TOKENS)
    context = stored.sparkSession.sparkContext
    shared, size = context.broadcast(words), shared_rows(words)[-1]
    observed = _totals(stored.where("not held_out").select("tokens").mapInArrow(_count(shared), SUMS), size)
    deal = lambda train: stored.select("row", "held_out", "tokens").mapInArrow(_deal(shared, parts, train), "part int, first long, n int, tokens binary")
    tasks, expected = max(context.defaultParallelism, tokens // SUM_TOKENS), []
    for _ in range(ROUNDS - 1):
        learned = context.broadcast(Learned(words, observed, expected))
        sorted_parts = deal(True).select("part", "n", "tokens").repartition(tasks, "part").sortWithinPartitions("part")
        expected = [*expected, _totals(sorted_parts.mapInArrow(_expect(learned), SUMS), size)]
        learned.unpersist()
    learned = context.broadcast(Learned(words, observed, expected))
    scored = deal(False).groupBy("part").applyInArrow(_fit(learned), "first long, n int, logs binary")
    return scored.groupBy("first").applyInArrow(_gather, "row long, by_model double")


def encode(plain: DataFrame, words: Vocabulary, floor: float) -> DataFrame:
    """(doc_id, held_out, row, tokens, tail, n_known, base, rest) of (doc_id, held_out, text, row), kept in the shared folder.

    tokens are codes; tail are the ids of tokens without a count at hand. base and rest sum the smoothed counts of the other
    tokens, over all of them and over those that share the last place of their class.
    """
    shared = plain.sparkSession.sparkContext.broadcast(words)
    kind = plain.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        words = shared.value
        ranks = _Ranks(dict(zip(words.sorted.tolist(), words.rank.tolist(), strict=True)))
        count = np.concatenate([words.count, np.zeros(CLASSES)])
        last = words.leaf >= (PLACES - 1) * CLASSES

        def part(rows: list, texts: list):
            found, ends_at = [], [0]
            for text in texts:
                found += map(ranks.__getitem__, _tokens(text))
                ends_at.append(len(found))
            flat, lengths = np.array(found, np.int64), np.diff(ends_at)
            of = np.repeat(np.arange(len(texts)), lengths)
            unknown = (flat < 0) | (flat >= FREQUENT)
            codes = np.where(unknown, words.size + (flat & (CLASSES - 1)), flat).astype(np.int32)
            under = np.where(last[codes], words.under[words.leaf[codes] % CLASSES], 0.0)
            sums = lambda x: np.bincount(of, x, len(texts))
            ends = lambda n: pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32())
            tails = sums(unknown).astype(np.int64)
            return pa.RecordBatch.from_arrays(
                [
                    *rows, pa.ListArray.from_arrays(ends(lengths), pa.array(codes)), pa.ListArray.from_arrays(ends(tails), pa.array(flat[unknown])), pa.array(lengths - tails),
                    pa.array(sums(count[codes]) - lengths * floor), pa.array(sums(np.where(last[codes], count[codes], 0.0) - under)),
                ],
                names=["doc_id", "held_out", "row", "tokens", "tail", "n_known", "base", "rest"],
            )

        for batch in batches:
            texts = batch.column(3).cast(pa.binary()).to_pylist()
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and size < STEP_TOKENS * 24:
                    size += len(texts[to])
                    to += 1
                yield part([batch.column(k).slice(at, to - at) for k in range(3)], texts[at:to])
                at = to

    schema = f"doc_id {kind}, held_out boolean, row long, tokens array<int>, tail array<long>, n_known long, base double, rest double"
    # the row number is fixed by file split and place, so a task that runs again gives the same
    return stash(plain.select("doc_id", "held_out", F.monotonically_increasing_id().alias("row"), "text").mapInArrow(run, schema), "lm-tokens", codec="zstd")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, fold: int = 1) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs.

    Counts and weights are learned from all rows that are not held out. score is the log10 probability of a text: each
    token's class, then its place within the class, both by softmax over its history; tokens that share a class's last place
    split it by smoothed count. base_score is the smoothed unigram probability. Texts are tokenised twice: once to count,
    once to write their tokens as codes, which are dealt to parts by context (see by_parts()). Counts of frequent tokens are
    broadcast, FREQUENT at most; the other tokens of a document are joined with the whole count table.

    Null and blank texts hold the end token only. Repeated rows and null ids each get their row; a null id is never held
    out. Bytes that are not UTF-8 are taken as they are. If there is nothing to learn from, all tokens are unknown and the
    classes equally likely. An empty table gives an empty result; other columns are not read.
    """

    held_out = is_held_out(F.col(id_col), folds, fold)
    plain = docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    counts = token_counts(plain.where("not held_out").select("text"))
    totals = {r["c"]: (r["n"], r["v"]) for r in counts.groupBy(F.col("id").bitwiseAND(F.lit(CLASSES - 1)).cast("int").alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    n_train, kinds = (sum(t[k] for t in totals.values()) for k in (0, 1))
    ids, n = _most_frequent(counts)
    words = Vocabulary(ids, n, totals)
    stored = encode(plain, words, float(np.log10(n_train + 0.5 * (kinds + 1))))
    columns = ["doc_id", "held_out", "row", "n_known", "base", "rest"]
    scored = stored.select(*columns, F.size("tokens").cast("long").alias("n_tokens")).join(by_parts(stored, words, n_train), "row")
    tails = stored.select("row", F.explode("tail").alias("id")).join(counts, "id", "left")
    tails = tails.groupBy("row").agg(F.count("n").alias("more"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("extra"))
    extra, more = F.coalesce("extra", F.lit(0.0)), F.coalesce("more", F.lit(0))
    return scored.join(tails, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + more).alias("n_known"), F.lit(int(n_train)).cast("long").alias("train_tokens"),
        F.round(F.col("base") + extra, 9).alias("base_score"), F.round(F.col("by_model") + F.col("rest") + extra, 9).alias("score"),
    )
