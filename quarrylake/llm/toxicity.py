"""Toxicity by chains of linear classifiers over words and word beginnings."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most labelled rows that the chain is fitted to: those with the smallest hash of their id.
TRAIN_ROWS = 10_000
#: Words and word beginnings that a link of the chain uses, chosen by their log-likelihood ratio; the hash space they are chosen in.
FEATURES, HASH_BITS, PREFIX = 300, 20, 5
FOLDS, L2 = 3, 1.0
#: Least share of correct ones among the out-of-fold rejections, from which the threshold of a category is set.
PRECISION, LEAST = 0.97, 0.2
STYLE = 6
UPPER = bytes(range(ord("A"), ord("Z") + 1))


def _decoded(column) -> list[str]:
    """Texts of an Arrow column: bytes that are not UTF-8 become U+FFFD, nulls the empty text."""
    import pyarrow as pa

    return [(t or b"").decode("utf-8", "replace") for t in column.cast(pa.binary()).to_pylist()]


def _words(text: str) -> set[str]:
    import re

    return set(re.findall(r"[^\W\d_]+", text.lower()))


def _hashes(word: str) -> tuple[int, ...]:
    """Features of a word: itself and, if it is longer, its beginning."""
    from zlib import crc32

    mask = (1 << HASH_BITS) - 1
    own = crc32(word.encode("utf-8", "surrogatepass")) & mask
    return (own,) if len(word) <= PREFIX else (own, crc32(b"^" + word[:PREFIX].encode("utf-8", "surrogatepass")) & mask)


def _style(text: str, distinct: int) -> list[float]:
    """Length, upper case, marks, variety and digits of a whole text."""
    n = max(len(text), 1)
    words = text.count(" ") + 1
    upper = (len(text) - len(text.encode().translate(None, UPPER)) if text.isascii() else sum(map(str.isupper, text))) / n
    marks = sum(text.count(c) for c in "!#$%&*|@<>") / n
    return [len(text) ** 0.25 / 10, upper, min(marks * 5, 1.0), min(distinct / words, 1.0), min(n / words / 20, 1.0), 1.0]


def examples(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS):
    """(features, styles, labels) of at most rows labelled documents; a bounded sample by hash of the id.

    labels has (id, one column for each category); repeated ids count once, with the larger label. A label of None is unknown.
    Of documents that repeat an id, the one with the smallest hash of its text is the example.
    """
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(*(F.max(F.col(c).cast("int")).alias(c) for c in categories))
    chosen = F.broadcast(known.orderBy(F.xxhash64("label_id"), "label_id").limit(rows))
    texts = docs.select(F.col(id_col).alias("label_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    of_id = [F.min_by("text", F.xxhash64("text")).alias("text"), *(F.first(c).alias(c) for c in categories)]
    joined = texts.join(chosen, "label_id").groupBy("label_id").agg(*of_id)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            features, styles = [], []
            for text in _decoded(batch.column(1)):
                words = _words(text)
                features.append(np.unique(np.fromiter((h for w in words for h in _hashes(w)), np.int32)).tolist())
                styles.append(_style(text, len(words)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(features, pa.list_(pa.int32())), pa.array(styles, pa.list_(pa.float64())), *batch.columns[2:]], names=["label_id", "features", "style", *categories])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"label_id {kind}, features array<int>, style array<double>, " + ", ".join(f"`{c}` int" for c in categories)
    held = joined.select("label_id", "text", *categories).mapInArrow(run, schema).toArrow()
    import numpy as np

    order = np.argsort(np.asarray(held.column("label_id").to_pylist()), kind="stable") if held.num_rows else []
    held = held.take(order) if held.num_rows else held
    features = [np.asarray(x.values, np.int32) for x in held.column("features")]
    styles = np.array(held.column("style").to_pylist(), np.float64).reshape(len(features), STYLE)
    return features, styles, {c: held.column(c).to_pylist() for c in categories}


def _fit(x, y):
    """Ridge logistic regression by Newton steps; the last column of x is the bias."""
    import numpy as np

    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], L2)
    ridge[-1] = 1e-3
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + ridge * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


def _logit(p):
    import numpy as np

    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p)) / 5


def _prob(x, w):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def _choose(features: list, y) -> list[int]:
    """The features that tell most about a label, by the log-likelihood ratio of presence and label."""
    import numpy as np

    size = 1 << HASH_BITS
    pos = np.bincount(np.concatenate([f for f, t in zip(features, y, strict=True) if t] or [np.zeros(0, np.int32)]), minlength=size).astype(float)
    neg = np.bincount(np.concatenate([f for f, t in zip(features, y, strict=True) if not t] or [np.zeros(0, np.int32)]), minlength=size).astype(float)
    n1, n0 = max(y.sum(), 1), max(len(y) - y.sum(), 1)
    seen = np.flatnonzero(pos + neg >= 3)
    p, q = pos[seen], neg[seen]
    share = (p + q) / (n1 + n0)

    def part(k, n, s):
        return k * np.log(np.maximum(k, 1e-9) / (n * s)) + (n - k) * np.log(np.maximum(n - k, 1e-9) / np.maximum(n * (1 - s), 1e-9))

    gain = part(p, n1, share) + part(q, n0, share)
    return seen[np.lexsort((seen, -gain))[:FEATURES]].tolist()


def _table(features: list, picked: list[int], earlier, styles):
    """The chosen features of each row as 0 and 1, then the earlier categories' logits and the style."""
    import numpy as np

    at = np.full(1 << HASH_BITS, -1)
    at[picked] = np.arange(len(picked))
    x = np.zeros((len(features), len(picked)))
    for k, f in enumerate(features):
        on = at[f]
        x[k, on[on >= 0]] = 1
    return np.concatenate([x, earlier, styles], axis=1)


def train(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """The links of the chain, one for each category in order: chosen features, weights and rejection threshold.

    A link sees words, style and the probabilities of all earlier categories. Later links are fitted to out-of-fold
    probabilities of the earlier ones, and thresholds are set on out-of-fold probabilities, so neither is flattered by rows
    that a model has learned by heart: a fold's words are chosen and weighed by the other folds alone, and rows with equal
    features, as equal texts have, are in one fold. Without labels of both kinds a category has its base rate and rejects nothing.
    """
    from zlib import crc32

    import numpy as np

    features, styles, known = examples(docs, labels, categories, id_col, text_col)
    fold = np.array([crc32(f.tobytes()) % FOLDS for f in features], int)
    chain, earlier = [], np.zeros((len(features), 0))
    for c in categories:
        have = np.array([v is not None for v in known[c]], bool)
        y = np.array([bool(v) for v in known[c]], float)
        link = {"category": c, "index": {}, "weights": None, "rate": float((y[have].sum() + 0.5) / (have.sum() + 1)), "threshold": 2.0}
        own = np.full(len(features), link["rate"])
        if 3 <= y[have].sum() <= have.sum() - 3:
            for k in range(FOLDS):
                rest, out = have & (fold != k), fold == k
                if 0 < y[rest].sum() < rest.sum():
                    x = _table(features, _choose([f for f, h in zip(features, rest, strict=True) if h], y[rest]), earlier, styles)
                    own[out] = _prob(x[out], _fit(x[rest], y[rest]))
            picked = _choose([f for f, h in zip(features, have, strict=True) if h], y[have])
            weights = _fit(_table(features, picked, earlier, styles)[have], y[have])
            link |= {"index": {h: k for k, h in enumerate(picked)}, "weights": weights, "threshold": _threshold(own[have], y[have])}
        chain.append(link)
        earlier = np.concatenate([earlier, _logit(own)[:, None]], axis=1)
    return chain


def _threshold(p, y) -> float:
    """Midway between the last rejection up to which at least PRECISION of them are right and the next lower probability;
    at least LEAST."""
    import numpy as np

    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero(right >= PRECISION)
    if not len(good):
        return 0.9
    down = np.append(p[order], 0.0)
    return float(max(LEAST, (down[good[-1]] + down[good[-1] + 1]) / 2))


def score(docs: DataFrame, chain: list[dict], text_col: str = "text") -> DataFrame:
    """docs with p_<category> and is_<category> for each link in place of the text; null texts count as empty."""
    names = [n for link in chain for n in (f"p_{link['category']}", f"is_{link['category']}")]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        memo: dict[str, tuple] = {}
        for batch in batches:
            texts = _decoded(batch.column(batch.num_columns - 1))
            on, styles = [], np.zeros((len(texts), STYLE))
            for k, text in enumerate(texts):
                words = _words(text)
                styles[k] = _style(text, len(words))
                hit = set()
                for w in words:
                    if (found := memo.get(w)) is None:
                        if len(memo) > 500_000:
                            memo.clear()
                        found = memo[w] = tuple(h for h in _hashes(w) if any(h in link["index"] for link in chain))
                    hit.update(found)
                on.append(hit)
            out, earlier = [], np.zeros((len(texts), 0))
            for link in chain:
                p = np.full(len(texts), link["rate"])
                if link["weights"] is not None:
                    index, w = link["index"], link["weights"]
                    z = np.array([sum(w[index[h]] for h in hit if h in index) for hit in on]) + np.concatenate([earlier, styles], axis=1) @ w[len(index) :]
                    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                out += [pa.array(np.round(p, 6)), pa.array(p >= link["threshold"])]
                earlier = np.concatenate([earlier, _logit(p)[:, None]], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *out], names=[*batch.schema.names[:-1], *names])

    rest = docs.drop(text_col, *names)
    schema = rest.select("*", *((F.lit(0.0) if n.startswith("p_") else F.lit(True)).alias(n) for n in names)).schema
    return docs.select(*(F.col(c) for c in rest.columns), F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


def categories_of(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The label table with the chain's categories: low_quality, then toxic."""
    return labels.select(id_col, (1 - F.col("quality").cast("int")).alias("low_quality"), F.col("toxic").cast("int").alias("toxic"))


CHAIN = ["low_quality", "toxic"]


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, p_low_quality, is_low_quality, p_toxic, is_toxic) for each row of docs.

    Null texts count as empty; empty texts, null ids and repeated rows are judged like others. Without labels of both kinds,
    or with an empty label table, nothing is rejected. An empty table gives an empty result; other columns are not read.
    """
    chain = train(docs, categories_of(labels, id_col), CHAIN, id_col, text_col)
    return score(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), chain)


def reject(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that the chain finds toxic; one scan, no shuffle of texts; all columns as they were. See judge()."""
    chain = train(docs, categories_of(labels, id_col), CHAIN, id_col, text_col)
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text_col).alias("judged"))
    return score(held, chain, "judged").where(~F.col("is_toxic")).select("row.*")
