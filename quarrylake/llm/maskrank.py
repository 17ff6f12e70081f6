"""Ranked lexical search by presence masks: documents that match the same terms of an item form a group, and groups are
evaluated from the highest possible score down until no other one can matter."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylake.storage import scratch_path, stash

TOP = 10
#: Saturation of a term's count, and the share of a document's length in it, in thousandths and hundredths.
DOUBLE_LENGTH, SCALE = 75, 1_000_000_000
#: Bytes of the items that are searched together; every task gets their terms.
ROUND_BYTES = 4 << 20
#: Documents whose bitmaps are made together.
BATCH_ROWS = 4096
#: ASCII letters and digits and all bytes beyond ASCII are parts of a term; A-Z count as a-z.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
COUNTED = "row long, doc_id {id}, n long, terms array<int>, counts array<long>"
FOUND = "item long, row long, doc_id {id}, score long"


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order, repeats included; null has none."""
    return text.translate(FOLD).split() if text else []


def _count(vocabulary: dict):
    """A mapInArrow function from (row, doc_id, text) to the number of terms and the counts of those in the vocabulary."""

    def count(batches: Iterator) -> Iterator:
        from collections import Counter

        import pyarrow as pa

        for batch in batches:
            sizes, numbers, counts = [], [], []
            for text in batch.column("text"):
                words = Counter(terms(text.as_py()))
                sizes.append(words.total())
                held = sorted((vocabulary[w], c) for w, c in words.items() if w in vocabulary)
                numbers.append([t for t, _ in held])
                counts.append([c for _, c in held])
            lists = [pa.array(sizes, pa.int64()), pa.array(numbers, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *lists], names=["row", "doc_id", "n", "terms", "counts"])

    return count


class Batch:
    """Documents of a batch: their counts by document and by term, what each count is worth, and a bitmap for each term."""

    def __init__(self, n, offsets, term, count, n_docs: int, n_terms_total: int, size: int):
        import numpy as np

        self.docs, self.offsets, self.term = len(n), offsets, term
        doc = np.repeat(np.arange(self.docs), np.diff(offsets))
        long = (100 - DOUBLE_LENGTH) + (DOUBLE_LENGTH * n * n_docs) // n_terms_total
        self.worth = (SCALE * count) // (1000 * count + 8 * long[doc])
        by = np.argsort(term, kind="stable")
        self.start = np.searchsorted(term[by], np.arange(size + 1))
        self.by_term, self.doc_of = doc[by], doc
        # The most that a term's count is worth in this batch.
        self.most = np.zeros(size, np.int64)
        np.maximum.at(self.most, term, self.worth)

    def bitmap(self, term: int):
        """The documents of the batch that hold a term, a bit each."""
        import numpy as np

        held = np.zeros(self.docs, np.uint8)
        held[self.by_term[self.start[term] : self.start[term + 1]]] = 1
        return np.packbits(held)

    def groups(self, item, weight):
        """(docs, ends, bounds): documents with a term of the item, in groups of one presence mask each; a group ends before
        ends, and bounds has what a document of the group can score at most, from the highest down."""
        import numpy as np

        item = item[self.start[item + 1] > self.start[item]]
        if not len(item):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        bits = np.stack([self.bitmap(int(t)) for t in item])
        some = np.unpackbits(np.bitwise_or.reduce(bits), count=self.docs).astype(bool)
        # Turned round, each document's column of bits is its mask.
        masks = np.packbits(np.unpackbits(bits, axis=1, count=self.docs)[:, some], axis=0).T
        docs = np.flatnonzero(some)
        wide = np.zeros((len(docs), -(-masks.shape[1] // 8) * 8), np.uint8)
        wide[:, : masks.shape[1]] = masks
        keys = wide.view(">u8")
        by = np.lexsort(keys.T[::-1]) if keys.shape[1] > 1 else np.argsort(keys[:, 0], kind="stable")
        change = np.flatnonzero((keys[by][1:] != keys[by][:-1]).any(1)) + 1
        starts, ends = np.concatenate([[0], change]), np.concatenate([change, [len(by)]])
        present = np.unpackbits(masks[by[starts]], axis=1, count=len(item)).astype(np.int64)
        bound = present @ (weight[item] * self.most[item])
        down = np.argsort(-bound, kind="stable")
        order = np.concatenate([by[starts[g] : ends[g]] for g in down])
        return docs[order], np.cumsum((ends - starts)[down]), bound[down]

    def scores(self, docs, weight):
        """The whole scores of some documents."""
        import numpy as np

        sizes = self.offsets[docs + 1] - self.offsets[docs]
        at = np.repeat(self.offsets[docs] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        total = np.zeros(len(docs), np.int64)
        np.add.at(total, np.repeat(np.arange(len(docs)), sizes), weight[self.term[at]] * self.worth[at])
        return total


def rank_batch(batch: Batch, item, weight, floor: int, top: int):
    """(documents, scores) of a batch that score at least floor, above 0, and as much as the batch's document at place top."""
    import numpy as np

    docs, ends, bounds = batch.groups(item, weight)
    found, scored, at, group, step = [], [], 0, 0, 8
    floor = max(floor, 1)
    while group < len(ends) and bounds[group] >= floor:
        last = group + int(np.searchsorted(-bounds[group : group + step], -floor, side="right"))  # those that can reach the floor
        some = docs[at : ends[last - 1]]
        score = batch.scores(some, weight)
        good = score >= floor
        found.append(some[good])
        scored.append(score[good])
        at, group, step = ends[last - 1], last, 2 * step
        so_far = np.concatenate(scored)
        if len(so_far) >= top:
            floor = max(floor, int(np.partition(so_far, len(so_far) - top)[len(so_far) - top]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found, scored = np.concatenate(found), np.concatenate(scored)
    return found[scored >= floor], scored[scored >= floor]


def _ranker(items: list, weights, n_docs: int, n_terms: int, top: int, id_type):
    """A mapInArrow function from counted documents to the best of a task for each item (number, terms, repeats)."""

    def rank(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        best: list[list] = [[] for _ in items]
        weight = np.zeros(len(weights), np.int64)
        for whole in batches:
            for cut in range(0, whole.num_rows, BATCH_ROWS):
                part = whole.slice(cut, BATCH_ROWS)
                lists = part.column("terms")
                offsets = lists.offsets.to_numpy().astype(np.int64)
                batch = Batch(part.column("n").to_numpy(), offsets - offsets[0], lists.flatten().to_numpy(), part.column("counts").flatten().to_numpy(), n_docs, n_terms, len(weights))
                row, ids = part.column("row"), part.column("doc_id")
                for k, (_, item, repeats) in enumerate(items):
                    weight[item] = weights[item] * repeats
                    floor = -best[k][-1][0] if len(best[k]) == top else 1
                    found, score = rank_batch(batch, item, weight, floor, top)
                    weight[item] = 0
                    if len(found):
                        held = zip((-score).tolist(), ids.take(pa.array(found)).to_pylist(), row.take(pa.array(found)).to_pylist(), strict=True)
                        best[k] = sorted([*best[k], *held], key=lambda x: (x[0], x[1] is None, 0 if x[1] is None else x[1], x[2]))[:top]
        flat = [(items[k][0], r, i, -s) for k, b in enumerate(best) for s, i, r in b]
        numbers, rows, ids, scores = zip(*flat, strict=True) if flat else ((), (), (), ())
        kinds = (pa.int64(), pa.int64(), id_type, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((numbers, rows, ids, scores), kinds, strict=True)], names=["item", "row", "doc_id", "score"])

    return rank


def _id_type(spark: SparkSession, docs: DataFrame, id_col: str):
    """The Arrow type of the id column."""
    return docs.select(id_col).limit(0).toArrow().schema.field(0).type


def search(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the top documents of each item with a score above 0.

    A document's score sums, over the item's terms, a weight that falls with the share of documents that hold the term,
    times its saturated count in the document; all in 64-bit integers. Documents are counted once for each round of items
    (ROUND_BYTES of text; an item that is longer is a round of its own) and kept as counts of the items' terms. Each task
    then makes bitmaps of its documents by term, groups the documents of an item by presence mask, and evaluates the masks
    from the highest maximum down until none can reach the item's best documents so far; only these leave the task.

    Null texts and texts without terms match nothing and do not count as documents. Documents with a null id come last among
    equal scores; rows that repeat an id are documents of their own, items that repeat are items of their own. Empty tables
    give an empty result. Other columns are not read.
    """
    import math

    import numpy as np

    spark = docs.sparkSession
    text = lambda c: F.col(c).cast("string").cast("binary")
    held = stash(queries.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).alias("item_id"), text(item_text_col).alias("text")), "maskrank-items")
    size = held.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    rounds = -(-size // ROUND_BYTES)
    kind, arrow = docs.schema[id_col].dataType.simpleString(), _id_type(spark, docs, id_col)
    path = scratch_path(spark, "maskrank-found")
    spark.createDataFrame([], FOUND.format(id=kind)).write.parquet(path)
    for r in range(rounds):
        mine = held.where(F.pmod(F.xxhash64("item"), F.lit(rounds)) == r).select("item", "text").toArrow().to_pylist()
        words = [(m["item"], terms(m["text"])) for m in mine]
        vocabulary = {w: k for k, w in enumerate(sorted({w for _, ws in words for w in ws}))}
        if not vocabulary:
            continue
        source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), text(text_col).alias("text"))
        counted = stash(source.mapInArrow(_count(vocabulary), COUNTED.format(id=kind)), "maskrank-counts")
        n_docs, n_terms = counted.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            continue
        holding = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toArrow()
        df = np.zeros(len(vocabulary), np.int64)
        df[holding.column("term").to_numpy()] = holding.column("df").to_numpy()
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        items = []
        for number, ws in words:
            if ws:
                item, repeats = np.unique(np.array([vocabulary[w] for w in ws]), return_counts=True)
                items.append((number, item, repeats))
        ranked = counted.where("size(terms) > 0").select("row", "doc_id", "n", "terms", "counts")
        ranked.mapInArrow(_ranker(items, weights, n_docs, n_terms, top, arrow), FOUND.format(id=kind)).write.mode("append").parquet(path)
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "row")
    found = spark.read.schema(FOUND.format(id=kind)).parquet(path).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return found.join(held.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
