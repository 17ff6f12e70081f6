"""Nearest neighbours over vector tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylake.storage import stash

#: Most queries that meet at a time in a task, bytes of a block of queries, which every task gets, and catalogue rows that meet
#: them at a time.
BLOCK_ROWS, BLOCK_BYTES, CHUNK_ROWS = 2000, 16 << 20, 1024
#: Most vectors that cells are fitted to, queries that recall is measured with, and the recall that is asked for.
SAMPLE_ROWS, PROBE_SAMPLE, LEAST_RECALL = 4096, 100, 0.9


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalize(v: Column) -> Column:
    """Unit length, with the length taken as at least 1e-12."""
    return F.transform(v, lambda x: x.cast("double") / F.greatest(norm(v), F.lit(1e-12)))


def sound(v: Column, size: int) -> Column:
    """The vector has the expected size and finite values only."""
    return F.coalesce((F.size(v) == size) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def literal(v: Column) -> Column:
    """The vector as text, like [0.5,-1.0], each component a double; null for no vector, and null components as null."""
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: F.coalesce(x.cast("double").cast("string"), F.lit("null"))), ","), F.lit("]"))


def embed(df: DataFrame, text_col: str, model: Callable[[list[str]], list[list[float]]], size: int, into: str = "embedding", batch: int = 32) -> DataFrame:
    """df with the vectors that model gives for a text column, in batches of 1 to 128 texts; blank and null texts have none.

    A batch of other than one finite vector of the size for each text ends the job: ValueError.
    """
    if not 1 <= batch <= 128:
        raise ValueError("a batch has 1 to 128 texts")

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np

        for texts in parts:
            out = pd.Series([None] * len(texts), dtype=object)
            at = [k for k, t in enumerate(texts) if t is not None and t.strip()]
            for a in range(0, len(at), batch):
                own = at[a : a + batch]
                found = np.asarray(model([texts.iloc[k] for k in own]), np.float64)
                if found.shape != (len(own), size) or not np.isfinite(found).all():
                    raise ValueError(f"the model gave {found.shape} for {len(own)} texts of {size} dimensions")
                for k, v in zip(own, found.tolist(), strict=True):
                    out.iat[k] = v
            yield out

    return df.withColumn(into, F.pandas_udf(run, "array<double>")(F.col(text_col).cast("string")))


def _matrix(column):
    """A list column of numbers as a matrix of doubles, and which rows have a vector without nulls of the first one's size."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    width = int(next(iter(sizes[sizes > 0]), 0))
    good = (sizes == width) & (width > 0)
    if column.flatten().null_count:
        held = pc.list_parent_indices(column).filter(column.flatten().is_null())
        good[held.to_numpy(zero_copy_only=False)] = False
    flat = column.filter(pa.array(good)).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, max(width, 1)), good


def _keep(found, k: int):
    """The k rows of each query (first column) with the least (distance, id) of parallel arrays (query, distance, id)."""
    import numpy as np

    order = np.lexsort((found[2], found[1], found[0]))
    q, d, i = (a[order] for a in found)
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return q[place < k], d[place < k], i[place < k]


class _Best:
    """The k nearest rows so far of each of n queries; distances of places not yet taken are infinite."""

    def __init__(self, asked, k: int) -> None:
        import numpy as np

        self.asked, self.single, self.k = asked, asked.astype(np.float32), k
        self.size = np.sqrt((asked * asked).sum(1))
        self.count, self.distance, self.ids = np.zeros(len(asked), np.int64), np.full((len(asked), k), np.inf), None

    def meet(self, mine, x, single, size: float, ids) -> None:
        """Let some queries, by number, meet rows; size is the length of the longest row.

        Products in single precision tell which rows can be among the nearest; by the bound of their error no other can.
        The distances of these are then made in double precision.
        """
        import numpy as np

        if self.ids is None:
            self.ids = np.zeros(self.distance.shape, ids.dtype)
        elif self.ids.dtype != ids.dtype:
            self.ids = self.ids.astype(np.result_type(self.ids, ids))
        k = self.k
        slack = self.size[mine] * size * (x.shape[1] + 8) * 2.0**-23 + 1e-30
        if np.isfinite(slack).all() and slack.max() < 1:
            near = self.single[mine] @ single.T
        else:
            near, slack = np.nan_to_num(self.asked[mine] @ x.T, nan=-np.inf), np.zeros(len(mine))
        worst, full = self.distance[mine, k - 1], self.count[mine] == k
        least = np.where(full, 1 - worst, -np.inf)
        if len(ids) >= k and not full.all():
            least[~full] = np.partition(near[~full], len(ids) - k, axis=1)[:, len(ids) - k] - slack[~full]
        q, r = np.nonzero(near >= (least - slack - 1.1e-5).astype(near.dtype)[:, None])
        distance = np.round(1 - np.einsum("ij,ij->i", self.asked[mine[q]], x[r]), 5) + 0.0
        found = ids[r]
        better = ~full[q] | (distance < worst[q])
        tied = np.flatnonzero(full[q] & (distance == worst[q]))
        better[tied] = found[tied] < self.ids[mine[q[tied]], k - 1]
        better &= ~np.isnan(distance)
        if not better.any():
            return
        q, distance, found = mine[q[better]], distance[better], found[better]
        own = np.unique(q)
        held = np.arange(k) < self.count[own][:, None]
        old = np.repeat(own, held.sum(1)), self.distance[own][held], self.ids[own][held]
        q, distance, found = _keep(tuple(np.concatenate(p) for p in zip(old, (q, distance, found), strict=True)), k)
        place = np.arange(len(q)) - np.searchsorted(q, q)
        self.distance[q, place], self.ids[q, place] = distance, found
        self.count[own] = np.bincount(np.searchsorted(own, q), minlength=len(own))

    def rows(self):
        """Parallel arrays (query, distance, id)."""
        import numpy as np

        held = np.arange(self.k) < self.count[:, None]
        return np.nonzero(held)[0], self.distance[held], self.ids[held]


def _near(asked, labels, numbers, k: int, within: bool, kinds):
    """A mapInArrow function over (id, vector[, label]): the k nearest rows of a task for each query. A query meets the rows
    of its label, or of any of its labels if it has a list of them."""

    def near(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        of_label: dict = {}
        for n, own in enumerate(labels if within else [None] * len(asked)):
            for label in own if isinstance(own, list) else [own]:
                of_label.setdefault(label, []).append(n)
        of_label = {label: np.array(own) for label, own in of_label.items()}
        best = _Best(asked, k)
        for whole in batches if len(asked) else ():
            for at in range(0, whole.num_rows, CHUNK_ROWS):
                part = whole.slice(at, CHUNK_ROWS)
                x, good = _matrix(part.column(1))
                if not len(x) or x.shape[1] != asked.shape[1]:
                    continue
                ids = part.column(0).filter(pa.array(good)).to_numpy(zero_copy_only=False)
                own = np.array(part.column(2).to_pylist(), object)[good] if within else None
                single, size = x.astype(np.float32), np.sqrt((x * x).sum(1))
                for label in set(own.tolist()) & of_label.keys() if within else [None]:
                    mine, rows = of_label[label], np.flatnonzero(own == label) if within else slice(None)
                    for first in range(0, len(mine), BLOCK_ROWS):
                        best.meet(mine[first : first + BLOCK_ROWS], x[rows], single[rows], size[rows].max(), ids[rows])
        if best.count.any():
            q, distance, found = best.rows()
            yield pa.RecordBatch.from_arrays([pa.array(numbers, kinds[0]).take(pa.array(q)), pa.array(found.tolist(), kinds[1]), pa.array(distance)], names=["query_id", "id", "distance"])

    return near


def nearest(queries: DataFrame, catalogue: DataFrame, k: int, block_rows: int | None = None, within: str | None = None) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest catalogue rows of each query by cosine distance rounded to 5 places,
    then id. queries has (query_id, vector) and catalogue (id, vector), unit vectors; with within, both have that column
    and only rows that agree in it meet; a query may have a list of values there, of which a row has any.

    A stated set of queries meets all rows: it goes to the tasks in blocks of at most BLOCK_BYTES and block_rows rows, a job
    for each. A task multiplies the block with some rows at a time, with within only those of one value, and keeps the k
    nearest of each query. Null vectors, and vectors with nulls or of another size than the query's, are near nothing.
    """
    if not 1 <= k <= 10:
        raise ValueError("k must be from 1 to 10")
    columns = [*([within] if within else [])]
    asked = queries.select("query_id", "vector", *columns)
    n, width = asked.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    blocks = max(1, -(-n // max(1, min(block_rows or n, BLOCK_BYTES // (8 * max(width, 1))))))
    asked = stash(asked, "nearest-queries") if blocks > 1 else asked
    types = asked.schema["query_id"].dataType.simpleString(), catalogue.schema["id"].dataType.simpleString()
    kinds = asked.select("query_id").limit(0).toArrow().schema.field(0).type, catalogue.select("id").limit(0).toArrow().schema.field(0).type
    schema = f"query_id {types[0]}, id {types[1]}, distance double"
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id"))
    rows, cores = catalogue.select("id", "vector", *columns), catalogue.sparkSession.sparkContext.defaultParallelism
    if n > BLOCK_ROWS and rows.rdd.getNumPartitions() < cores:
        rows = rows.repartition(cores)  # a small file is one task, which would multiply alone
    rows = stash(rows, "nearest-rows") if blocks > 1 else rows
    waves = []
    for b in range(blocks):
        held = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow()
        x, good = _matrix(held.column("vector"))
        mine = [v for v, g in zip(held.column("query_id").to_pylist(), good, strict=True) if g]
        labels = [v for v, g in zip(held.column(within).to_pylist(), good, strict=True) if g] if within else []
        best = rows.mapInArrow(_near(x, labels, mine, k, within is not None, kinds), schema).withColumn("rank", rank).where(F.col("rank") <= k)
        waves.append(stash(best, "nearest") if blocks > 1 else best)
    return reduce(DataFrame.unionByName, waves)


def centers(catalogue: DataFrame, cells: int, sample: int = SAMPLE_ROWS, turns: int = 8):
    """Unit vectors in the middle of cells, fitted to a sample of at most sample different vectors, the first by hash."""
    import numpy as np

    sound_rows = catalogue.where(F.col("vector").isNotNull()).select("vector").distinct()
    x, _ = _matrix(sound_rows.orderBy(F.xxhash64("vector")).limit(sample).toArrow().column("vector"))
    middle = x[: min(cells, len(x))].copy()
    for _ in range(turns):
        own = (x @ middle.T).argmax(1)
        for c in range(len(middle)):
            if (own == c).any():
                middle[c] = x[own == c].mean(0)
        middle /= np.maximum(np.linalg.norm(middle, axis=1, keepdims=True), 1e-12)
    return middle


def _cells_of(df: DataFrame, middle, probes: int, into: str) -> DataFrame:
    """df with its vectors' nearest cells as a list."""

    @F.pandas_udf("array<int>")
    def near(values: pd.Series) -> pd.Series:
        import numpy as np

        out: list = [None] * len(values)
        at = [n for n, v in enumerate(values) if v is not None and len(v) == middle.shape[1]]
        if at:
            x = np.stack([np.asarray(values.iloc[n], np.float64) for n in at])
            for n, cells in zip(at, np.argsort(-(x @ middle.T), axis=1, kind="stable")[:, :probes].astype(np.int32), strict=True):
                out[n] = cells
        return pd.Series(out, dtype=object)

    return df.withColumn(into, near(F.col("vector").cast("array<double>")))


def in_cells(catalogue: DataFrame, middle) -> DataFrame:
    """(id, vector, cell) with the cell of each row's nearest center, written once for several searches."""
    return stash(_cells_of(catalogue.select("id", "vector"), middle, 1, "cells").select("id", "vector", F.explode("cells").alias("cell")), "cells")


def nearest_probed(queries: DataFrame, catalogue: DataFrame, k: int, middle, probes: int) -> DataFrame:
    """nearest() over the catalogue rows of the probes cells nearest to each query; every row is in the cell of its nearest
    center. With as many probes as cells the result is that of nearest(). catalogue may come from in_cells()."""
    if probes >= len(middle):
        return nearest(queries, catalogue.select("id", "vector"), k)
    rows = catalogue if "cell" in catalogue.columns else in_cells(catalogue, middle)
    return nearest(_cells_of(queries.select("query_id", "vector"), middle, probes, "cell").where("cell is not null"), rows, k, within="cell")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact neighbours that were found."""
    hit = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hit.agg(F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(1.0))).first()[0]


def probes_for(queries: DataFrame, catalogue: DataFrame, k: int, middle, least: float = LEAST_RECALL, sample: int = PROBE_SAMPLE) -> tuple[int, float]:
    """(probes, recall): probes doubled until at least that share of the exact neighbours of a sample of queries, the first
    by hash, is found among all rows; at most all cells, which find everything."""
    some = stash(queries.select("query_id", "vector").orderBy(F.xxhash64("query_id")).limit(sample), "probe-sample")
    exact, probes, rows = stash(nearest(some, catalogue.select("id", "vector"), k), "probe-exact"), 1, catalogue
    while True:
        rows = rows if "cell" in rows.columns or probes >= len(middle) else in_cells(rows, middle)
        share = recall(nearest_probed(some, rows, k, middle, probes), exact)
        if share >= least or probes >= len(middle):
            return probes, share
        probes = min(2 * probes, len(middle))
