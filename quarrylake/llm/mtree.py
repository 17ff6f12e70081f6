"""Exact top-k search by inner product: M-trees of paged metric nodes, searched best first."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylake.storage import scratch_path, stash

TOP = 5
QUERY_STEP = 50
#: A component x counts as floor(SCALE * x).
SCALE = 256
#: Entries of a page, and rows of a tree: cells with more rows are cut into several trees.
PAGE, TREE_ROWS = 64, 1024
#: Rows of a cell on average, and most cells: their pivots are the only vectors of the table that reach the driver besides a
#: round of queries.
CELL_ROWS, MOST_CELLS = 512, 1024
#: Bytes of the query vectors of one round, which every task gets, and queries that walk a tree together.
ROUND_BYTES, BLOCK = 8 << 20, 256
#: Below this product of two norms a sum of products is exact in doubles.
EXACT = 2.0**52
NONE = -(1 << 62)
TREE = """cell int, piece int, radius double, norm double,
          pages array<struct<leaf: boolean, objects: binary, ahead: binary, radius: binary, norm: binary, ref: binary, id: binary, null_id: binary>>"""
FOUND = "query_row long, query_id long, row long, vec_id long, score long"


def _rows(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(row, vec_id, vec) of the vectors that take part, components as integers; kept, which fixes the row numbers."""
    x = F.col(vec_col)
    sound = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) * SCALE < 2.0**31))
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * SCALE).cast("int"))
    return stash(vectors.where(sound).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), whole.alias("vec")), "mtree-rows")


def _matrix(column, width: int):
    """A list column of integers as a matrix of doubles; shorter vectors end in zeros."""
    import numpy as np

    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width).astype(np.float64)
    held = np.zeros((len(lengths), width))
    held[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return held


def _dots(a, b):
    """Inner products of the rows of two matrices of integers, exact as long as they fit 64 bits."""
    import numpy as np

    if not len(a) or not len(b) or np.sqrt((a * a).sum(1).max()) * np.sqrt((b * b).sum(1).max()) < EXACT:
        return a @ b.T
    return a.astype(np.int64) @ b.astype(np.int64).T


def _distances(a, b):
    import numpy as np

    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T), 0.0))


def _assign(rows: DataFrame, pivots, width: int) -> DataFrame:
    """rows with the nearest pivot: cell."""

    def cells(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            nearest = _distances(_matrix(batch.column("vec"), width), pivots).argmin(1).astype("int32")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest)], names=[*batch.schema.names, "cell"])

    return rows.mapInArrow(cells, "row long, vec_id long, vec array<int>, cell int")


def grow(x, pivot, page_rows: int = PAGE) -> list[dict]:
    """The pages of an M-tree over the rows of a matrix, the root first, loaded from the top down.

    A page has entries: rows (leaf) or routing objects, which are rows too, with the radius that covers their subtree, the
    greatest norm in it, and the number of its page. ahead is the distance of each entry from the routing object of its own
    page (for the root: from pivot). Equal vectors are allowed.
    """
    import numpy as np

    norms = np.sqrt((x * x).sum(1))
    pages: list[dict] = []

    def parts(idx, ahead):
        m = min(page_rows, -(-2 * len(idx) // page_rows))
        seeds = idx[np.linspace(0, len(idx) - 1, m).astype(np.int64)]
        nearest = _distances(x[idx], x[seeds]).argmin(1)
        sizes = np.bincount(nearest, minlength=m)
        if sizes.max() <= 0.8 * len(idx):
            return [(seeds[k], idx[nearest == k]) for k in range(m) if sizes[k]]
        cut = np.array_split(idx[np.argsort(ahead, kind="stable")], m)  # no seed tells the rows apart: rings around the parent
        return [(c[0], c) for c in cut]

    def add(idx, center) -> int:
        node = len(pages)
        ahead = _distances(x[idx], center[None, :])[:, 0]
        page = {"leaf": len(idx) <= page_rows, "idx": idx, "ahead": ahead, "radius": ahead * 0.0, "norm": norms[idx], "child": None}
        pages.append(page)
        if not page["leaf"]:
            below = parts(idx, ahead)
            page["idx"] = np.array([seed for seed, _ in below])
            page["ahead"] = _distances(x[page["idx"]], center[None, :])[:, 0]
            page["child"] = np.array([add(part, x[seed]) for seed, part in below])
            page["radius"] = np.array([_distances(x[part], x[seed][None, :]).max() for seed, part in below])
            page["norm"] = np.array([norms[part].max() for _, part in below])
        return node

    add(np.arange(len(x)), pivot)
    return pages


def _build(width: int, pivots):
    def tree(rows):
        import numpy as np
        import pyarrow as pa

        x = _matrix(rows.column("vec").combine_chunks(), width)
        row, ids = rows.column("row").to_numpy(), rows.column("vec_id")
        null_id, ids = ids.is_null().to_numpy(), ids.fill_null(0).to_numpy()
        cell, piece = rows.column("cell")[0].as_py(), rows.column("piece")[0].as_py()
        pivot = pivots[cell]
        kind = pa.list_(pa.struct([("leaf", pa.bool_())] + [(c, pa.binary()) for c in ("objects", "ahead", "radius", "norm", "ref", "id", "null_id")]))
        pages = []
        for p in grow(x, pivot):
            idx, leaf = p["idx"], p["leaf"]
            pages.append(
                {
                    "leaf": leaf, "objects": x[idx].astype(np.int32).tobytes(), "ahead": p["ahead"].tobytes(), "radius": p["radius"].tobytes(), "norm": p["norm"].tobytes(),
                    "ref": (row[idx] if leaf else p["child"]).astype(np.int64).tobytes(), "id": ids[idx].astype(np.int64).tobytes() if leaf else b"",
                    "null_id": null_id[idx].tobytes() if leaf else b"",
                }
            )
        radius, norm = _distances(x, pivot[None, :]).max(), np.sqrt((x * x).sum(1)).max()
        return pa.table({"cell": pa.array([cell], pa.int32()), "piece": pa.array([piece], pa.int32()), "radius": [float(radius)], "norm": [float(norm)], "pages": pa.array([pages], kind)})

    return tree


class Search:
    """The best rows found so far for a block of queries, and the walk through trees that finds them."""

    def __init__(self, q, rows, floor, top: int):
        import numpy as np

        self.q, self.rows, self.top = q, rows, top
        self.norm = np.sqrt((q * q).sum(1))
        self.floor = floor
        self.score = np.full((len(q), top), NONE, np.int64)
        self.row, self.id = np.zeros((len(q), top), np.int64), np.zeros((len(q), top), np.int64)
        self.null_id = np.ones((len(q), top), bool)
        #: Products of a query with a row or routing object, for tests and tuning.
        self.products = 0

    def least(self):
        """The score a row must reach to matter, by query."""
        import numpy as np

        return np.maximum(self.score[:, -1], self.floor)

    def bound(self, who, near, radius, norm):
        """Most that a score can be in balls (near: distance to the center at least; radius; greatest norm), plus a margin
        for rounding: |q - x| >= near - radius gives q.x <= (|q|^2 + |x|^2 - (near - radius)^2) / 2."""
        import numpy as np

        qn = self.norm[who][:, None]
        squares = qn * qn + norm * norm
        return np.minimum(qn * norm, (squares - np.maximum(near - radius, 0.0) ** 2) / 2) + 0.5 + 1e-9 * squares

    def tree(self, tree: dict, pivot) -> None:
        """Walks one tree: of the open pages the one that promises most goes first, for the queries that it can still serve."""
        import numpy as np

        everyone = np.arange(len(self.q))
        dist = _distances(self.q, pivot[None, :])[:, 0]
        bound = self.bound(everyone, dist[:, None], tree["radius"], tree["norm"])[:, 0]
        held: dict[int, dict] = {}
        heap = [(0.0, 0, 0, everyone, dist, bound)]
        order = 1
        while heap:
            _, _, node, who, dist, bound = heapq.heappop(heap)
            alive = bound >= self.least()[who]
            who, dist = who[alive], dist[alive]
            if not len(who):
                continue
            if node not in held:
                held[node] = _page(tree["pages"][node], self.q.shape[1])
            page = held[node]
            least = self.least()[who][:, None]
            # The stored distance from the parent bounds a score before any product is computed.
            hope = self.bound(who, np.abs(dist[:, None] - page["ahead"]), page["radius"], page["norm"]) >= least
            entries, some = hope.any(0), hope.any(1)
            if not entries.any():
                continue
            who = who[some]
            objects = page["objects"][entries]
            dots = _dots(self.q[who], objects)
            self.products += dots.size
            if page["leaf"]:
                self._take(who, dots, page, entries)
                continue
            near = np.sqrt(np.maximum((self.norm[who] ** 2)[:, None] + (objects * objects).sum(1) - 2.0 * dots, 0.0))
            radius, norm = page["radius"][entries], page["norm"][entries]
            ball = np.minimum(self.bound(who, near, radius, norm), dots + self.norm[who][:, None] * radius + 0.5 + 1e-9 * self.norm[who][:, None] * norm)
            open_ = ball >= self.least()[who][:, None]
            for k in np.flatnonzero(open_.any(0)):
                mine = open_[:, k]
                promise = (ball[mine, k] - np.maximum(self.least()[who[mine]], -1e15)).max()
                heapq.heappush(heap, (-float(promise), order, int(page["ref"][entries][k]), who[mine], near[mine, k], ball[mine, k]))
                order += 1

    def _take(self, who, dots, page, entries) -> None:
        import numpy as np

        score = np.rint(dots).astype(np.int64) if dots.dtype.kind == "f" else dots
        row, ids, null_id = page["ref"][entries], page["id"][entries], page["null_id"][entries]
        score = np.where(row[None, :] == self.rows[who][:, None], NONE, score)
        better = (score >= np.maximum(self.least()[who], NONE + 1)[:, None]).any(1)
        who, score = who[better], score[better]
        if not len(who):
            return
        wide = lambda v: np.broadcast_to(v, score.shape)
        score, row, ids, null_id = (np.concatenate([a[who], b], 1) for a, b in ((self.score, score), (self.row, wide(row)), (self.id, wide(ids)), (self.null_id, wide(null_id))))
        best = np.lexsort((row, ids, null_id, -score), axis=-1)[:, : self.top]
        for kept, new in ((self.score, score), (self.row, row), (self.id, ids), (self.null_id, null_id)):
            kept[who] = np.take_along_axis(new, best, 1)


def _page(page: dict, width: int) -> dict:
    import numpy as np

    made = {c: np.frombuffer(page[c], np.float64) for c in ("ahead", "radius", "norm")}
    made |= {c: np.frombuffer(page[c], np.int64) for c in ("ref", "id")}
    return made | {
        "leaf": page["leaf"], "null_id": np.frombuffer(page["null_id"], bool),
        "objects": np.frombuffer(page["objects"], np.int32).reshape(len(made["ref"]), width).astype(np.float64),
    }


def _searcher(q, rows, ids, cells, floor, pivots, top: int, home: bool):
    """A mapInArrow function over trees: the best rows of each query in the trees of a task that reach its floor; home:
    only in trees of the query's own cell."""

    def search(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        x = q.astype(np.float64)
        blocks: dict[int, Search] = {}
        starts = {int(c): np.flatnonzero(cells == c) for c in np.unique(cells)} if home else {k: np.arange(k, min(k + BLOCK, len(x))) for k in range(0, len(x), BLOCK)}
        for batch in batches:
            for k in range(batch.num_rows):
                tree = batch.slice(k, 1).to_pylist()[0]
                for b in [tree["cell"]] if home else starts:
                    if b in starts and b not in blocks:
                        blocks[b] = Search(x[starts[b]], rows[starts[b]], floor[starts[b]], top)
                    if b in blocks:
                        blocks[b].tree(tree, pivots[tree["cell"]])
        for b, s in blocks.items():
            at, rank = np.nonzero(s.score >= np.maximum(s.floor, NONE + 1)[:, None])
            mine = starts[b][at]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[mine]), pa.array(ids[mine]), pa.array(s.row[at, rank]), pa.array(s.id[at, rank], mask=s.null_id[at, rank]), pa.array(s.score[at, rank])],
                names=["query_row", "query_id", "row", "vec_id", "score"],
            )

    return search


def nearest(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", step: int = QUERY_STEP, top: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by step the top rows with the highest inner product
    of components floor(256 * x), its own row left out; equal scores by smaller id, null ids last.

    Each row goes to the cell of its nearest pivot; cells are cut into trees of about TREE_ROWS rows, whose pages are one row
    of a table in the shared folder, so no task holds more than some trees. Pivots are up to MOST_CELLS different vectors,
    the first by hash: they decide how fast the search is, never its result. Queries come in rounds of ROUND_BYTES, which
    every task gets: first the first tree of each query's own cell gives it a score to reach, then all trees are searched.
    A tree is left out, and a page or an entry in it, if covering radius, stored distance from the parent and greatest norm
    show that no row in it reaches the query's score.

    Of rows with equal vectors only the top + 1 with the smallest ids can be among the best of any query, so no others
    enter the trees. Vectors that are null or have a null, infinite or NaN component, or one that is 2^31 or more by
    amount when scaled, take no part. Vectors of different lengths compare as if the shorter one ended in zeros. A row with
    a null id is no query. Rows that repeat an id are rows of their own, as queries too. Empty tables give an empty result.
    Other columns are not read. Scores must fit 64 bits.
    """
    import numpy as np

    spark = vectors.sparkSession
    rows = _rows(vectors, id_col, vec_col)
    n, width, n_queries = rows.agg(F.count("*"), F.max(F.size("vec")), F.count_if(F.col("vec_id") % step == 0)).first()
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(width, 1)
    copies = Window.partitionBy("vec").orderBy(F.col("vec_id").asc_nulls_last(), "row")
    kept = rows.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= top + 1)
    kept = stash(kept, "mtree-candidates")
    n_cells = min(MOST_CELLS, -(-n // CELL_ROWS))
    chosen = kept.where("copy = 1").select("vec").orderBy(F.xxhash64("vec"), "vec").limit(n_cells).toArrow()
    pivots = _matrix(chosen.column("vec").combine_chunks(), width)
    placed = stash(_assign(kept.drop("copy"), pivots, width), "mtree-cells")
    pieces = placed.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(TREE_ROWS)).alias("pieces"))  # a row for each cell
    cut = placed.join(F.broadcast(pieces), "cell").withColumn("piece", F.pmod(F.xxhash64("row"), "pieces").cast("int")).drop("pieces")
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-n // (64 * TREE_ROWS)))
    trees = stash(cut.repartition(tasks, "cell", "piece").groupBy("cell", "piece").applyInArrow(_build(width, pivots), TREE), "mtree-pages")
    firsts = trees.where("piece = 0")

    rounds = -(-n_queries * 4 * width // ROUND_BYTES)
    queries = _assign(rows.where(F.col("vec_id") % step == 0), pivots, width).withColumn("round", F.pmod(F.xxhash64("row"), F.lit(rounds)))
    path = scratch_path(spark, "mtree-found")
    for r in range(rounds):
        held = queries.where(F.col("round") == r).orderBy("cell", "row").toArrow()
        if not held.num_rows:
            continue
        q = _matrix(held.column("vec").combine_chunks(), width).astype(np.int32)
        q_rows, q_ids, cells = (held.column(c).to_numpy() for c in ("row", "vec_id", "cell"))
        floor = np.full(len(q), NONE, np.int64)
        seen = firsts.mapInArrow(_searcher(q, q_rows, q_ids, cells, floor, pivots, top, True), FOUND)
        reached = seen.groupBy("query_row").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= top).toArrow()
        order = np.argsort(q_rows)
        floor[order[np.searchsorted(q_rows, reached.column("query_row").to_numpy(), sorter=order)]] = reached.column("least").to_numpy()
        trees.mapInArrow(_searcher(q, q_rows, q_ids, cells, floor, pivots, top, False), FOUND).write.mode("append").parquet(path)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
    found = spark.read.schema(FOUND).parquet(path).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
