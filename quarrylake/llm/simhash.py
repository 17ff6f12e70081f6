"""SimHash near-duplicate detection with BK-trees over sharded fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylake.operators.components import connected_components
from quarrylake.storage import discard, stash

RADIUS = 4
SHINGLE_WORDS = 4
#: Most fingerprints of one shard in a tree; larger shards are cut and searched piece against piece.
SHARD_ROWS = 4096
#: Six blocks of the 64 bits. Two fingerprints that differ in at most four bits agree on at least two of them.
BLOCK_BITS = (11, 11, 11, 11, 10, 10)
SEED = 42
#: A fingerprint that at least one in so many rows share is joined by broadcast; there are no more such fingerprints than this.
HOT_SHARE = 1000
#: Near-duplicates by similarity: words of a shingle, least Jaccard similarity of two sets of shingles, and the bits by which
#: two fingerprints of candidates may differ. Texts at the least similarity differ in about nine bits, hardly ever in over 17.
SIMILAR_WORDS, SIMILAR, SIMILAR_RADIUS = 5, 0.8, 20
#: Shards of a document in the search by similarity, one for each of so many least hashes of its shingles. Two texts of
#: similarity s share no shard with probability (1 - s) ** KEYS: 0.00006 at 0.8.
KEYS = 6
#: Bytes of a text's sketch, one of each of so many least hashes, and how many of them two candidates must have in common. Two
#: texts of similarity 0.8 have fewer with probability 0.00001; of similarity 0.33 they have as many with probability 0.00005.
SKETCH, SKETCH_SAME = 64, 37
#: Most texts of a shard that are compared as pairs; texts of larger shards meet by their rarest shingles instead.
FEW = 64
#: Most texts and most shingles of a piece of a group whose similarities are computed.
PIECE_ROWS, PIECE_SHINGLES = 1024, 1 << 22
#: Counts of a text's shingles by their first bits, which bound how many two texts can share.
BOUND_BITS = 9
ROW = "__simhash_row"


def shingle_hashes(text: bytes | None, width: int = SHINGLE_WORDS):
    """XXH64 of each shingle of UTF-8 text, repeats included: A-Z lower-cased, words split at ASCII white space, shingles of
    width words; fewer words are one shingle, and no words have none."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - width + 1)


def simhash(hashes) -> int:
    """The 64-bit SimHash of hashed shingles: a bit is 1 if it is set in over half of them; of none it is zero."""
    import numpy as np

    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(votes * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def least_hashes(hashes, factors):
    """The least of some hashes, not none, under each of the shuffles that odd factors make."""
    import numpy as np

    found = np.full(len(factors), ~np.uint64(0))
    for at in range(0, len(hashes), 1 << 12):
        part = hashes[at : at + (1 << 12)]
        np.minimum(found, np.multiply.outer(part ^ (part >> np.uint64(31)), factors).min(axis=0), out=found)
    return found


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS, keys: int = 0) -> DataFrame:
    """(id, fp long, keys array<long>, sketch binary): the fingerprint of every whole text; null and blank texts have
    fingerprint zero.

    keys holds the least of the text's shingle hashes under each of so many fixed shuffles of the hashes, sketch the last byte
    of the least under each of SKETCH shuffles; a text without words has none. There are no such columns if keys is 0.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        factors = np.array([xxh64_intdigest(str(k), SEED) | 1 for k in range(SKETCH)], np.uint64)
        for batch in batches:
            fps, least, sketches = [], [], []
            for text in batch.column(1).cast(pa.binary()):
                hashes = shingle_hashes(text.as_py(), width)
                fps.append(simhash(hashes))
                if keys:
                    found = least_hashes(hashes, factors) if len(hashes) else np.zeros(0, np.uint64)
                    least.append(found[:keys].view(np.int64))
                    sketches.append(found.astype(np.uint8).tobytes())
            columns = [batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))]
            if keys:
                columns += [pa.array(least, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "fp", "keys", "sketch"][: len(columns)])

    kind = docs.schema[id_col].dataType.simpleString()
    out = f"id {kind}, fp long" + (", keys array<long>, sketch binary" if keys else "")
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, out)


class BKTree:
    """Fingerprints in a tree whose children are keyed by their integer Hamming distance to the parent."""

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root: tuple[int, dict] | None = None

    def add(self, fp: int) -> None:
        if self.root is None:
            self.root = (fp, {})
            return
        node = self.root
        while (d := (node[0] ^ fp).bit_count()) and (below := node[1].get(d)) is not None:
            node = below
        if d:
            node[1][d] = (fp, {})

    def within(self, fp: int, radius: int) -> list[int]:
        """All fingerprints at most radius bits away; only edges in [d - radius, d + radius] are followed."""
        found, open_ = [], [self.root] if self.root else []
        while open_:
            value, children = open_.pop()
            d = (value ^ fp).bit_count()
            if d <= radius:
                found.append(value)
            open_.extend(below for key, below in children.items() if d - radius <= key <= d + radius)
        return found


class Forest:
    """Joined fingerprints; the root of a class is its least member."""

    __slots__ = ("parent",)

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    def unite(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        self.parent[max(a, b)] = min(a, b)

    def links(self) -> list[tuple[int, int]]:
        """A link from each joined fingerprint to its root."""
        return [(x, root) for x in list(self.parent) if (root := self.root(x)) != x]


def _link_shard(members: list[int], queries: list[int], radius: int) -> list[tuple[int, int]]:
    """Links of one shard as a star forest; queries empty: the members among themselves."""
    forest, tree, among = Forest(), BKTree(), not queries
    for fp in members:
        for other in tree.within(fp, radius) if among else ():
            forest.unite(fp, other)
        tree.add(fp)
    for fp in queries:
        for other in tree.within(fp, radius):
            forest.unite(fp, other)
    return forest.links()


def _link_sketched(members: list[tuple[int, bytes]], radius: int) -> list[tuple[int, int]]:
    """Links of (fingerprint, sketch) within radius bits whose sketches have SKETCH_SAME bytes in common, as a star forest."""
    import numpy as np

    forest, tree, sketches = Forest(), BKTree(), {}
    for fp, sketch in members:
        own = np.frombuffer(sketch, np.uint8)
        for other in tree.within(fp, radius):
            if forest.root(other) != forest.root(fp) and np.count_nonzero(own == sketches[other]) >= SKETCH_SAME:
                forest.unite(fp, other)
        tree.add(fp)
        sketches[fp] = own
    return forest.links()


def _link_similar(members: list[tuple], queries: list[tuple], radius: int, least: float) -> list[tuple[int, int]]:
    """Links of (fingerprint, distinct shingle hashes) with a Jaccard similarity of least or more, as a star forest.

    The tree gives the candidates of a text. Those that are joined with it already are passed over; counts of shingles by
    their first bits bound what the others can share, and only what the bound leaves is intersected.
    """
    import numpy as np

    rows = members + queries
    first = np.uint64(64 - BOUND_BITS)
    counts = np.array([np.bincount((own >> first).astype(np.int64), minlength=1 << BOUND_BITS) for _, own in rows], np.int32)
    sizes = np.array([len(own) for _, own in rows])
    place = {fp: at for at, (fp, _) in enumerate(rows)}
    forest, tree, among = Forest(), BKTree(), not queries
    for at, (fp, own) in enumerate(rows):
        asks = at >= len(members)
        if among or asks:
            mine = forest.root(fp)
            near = np.array([place[other] for other in tree.within(fp, radius) if forest.root(other) != mine], np.int64)
            need = least * (sizes[near] + sizes[at]) / (1 + least) - 1e-9
            bound = np.minimum(counts[near], counts[at]).sum(axis=1)
            for k in np.flatnonzero(bound >= need).tolist():
                other, theirs = rows[near[k]]
                if forest.root(other) != forest.root(fp) and len(np.intersect1d(own, theirs, assume_unique=True)) >= need[k]:
                    forest.unite(fp, other)
        if not asks:
            tree.add(fp)
    return forest.links()


def _masks() -> list[int]:
    """For each pair of blocks, the bits of both as a signed 64-bit mask."""
    starts = [sum(BLOCK_BITS[:k]) for k in range(len(BLOCK_BITS))]
    blocks = [((1 << w) - 1) << s for s, w in zip(starts, BLOCK_BITS, strict=True)]
    masks = [a | b for a, b in combinations(blocks, 2)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(fps: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(u, v): links that connect exactly the distinct fingerprints of column fp that radius bits or fewer join.

    Each fingerprint goes to one shard per pair of bit blocks; two that differ in at most four bits meet in at least one
    of the fifteen.
    """
    if radius > 4:
        raise ValueError("the block scheme is complete for a radius of at most 4")
    shards = fps.select("fp").distinct().select(
        "fp", F.explode(F.array(*(F.struct(F.lit(k).alias("pair"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for k, m in enumerate(_masks())))).alias("shard")
    ).select("fp", "shard.pair", "shard.bits")
    return search(shards, radius, shard_rows)


def search(shards: DataFrame, radius: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(u, v): links that connect the fingerprints of each shard (pair, bits) that radius bits or fewer join.

    A BK-tree is built and searched for each shard in the task where its rows meet. Shards of more than shard_rows are cut
    into pieces by hash, and every two pieces meet in a task of their own, so no task holds more than two pieces. A task
    returns the links of a shard as a star forest, never all pairs. The rows of shards are distinct.
    """
    shards = stash(shards, "simhash-shards")
    sizes = shards.groupBy("pair", "bits").count().where("count > 1").select("pair", "bits", F.ceil(F.col("count") / F.lit(shard_rows)).cast("int").alias("pieces"))
    cells = _cells(shards.join(sizes, ["pair", "bits"]), ["pair", "bits"], ["fp"])

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        values = lambda batch: batch.column(5).to_numpy(zero_copy_only=False).view(np.uint64).tolist()
        for members, queries in _meetings(batches, 4, values):
            yield _pairs(_link_shard(members, queries, radius))

    return cells.mapInArrow(run, "u long, v long").distinct()


def _counted(shards: DataFrame) -> DataFrame:
    """shards (fp, pair, bits) with n, the fingerprints of the shard; shards of one are left out."""
    sizes = stash(shards.groupBy("pair", "bits").agg(F.count("*").alias("n")).where("n > 1"), "simhash-sizes")
    return stash(shards.join(sizes, ["pair", "bits"]), "simhash-shards")


def _compared(shards: DataFrame, sketches: DataFrame, radius: int) -> DataFrame:
    """(u, v): links that connect the fingerprints of each shard of at most FEW that are near in bits and sketch."""
    rows = shards.where(F.col("n") <= FEW).join(sketches, "fp").withColumn("pieces", F.lit(1))
    cells = _cells(rows, ["pair", "bits"], ["fp", "sketch"])

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        def values(batch) -> list:
            fps = batch.column(5).to_numpy(zero_copy_only=False).view(np.uint64).tolist()
            return list(zip(fps, batch.column(6).to_pylist(), strict=True))

        for members, _ in _meetings(batches, 4, values):
            yield _pairs(_link_sketched(members, radius))

    return cells.mapInArrow(run, "u long, v long").distinct()


def rarest_shingles(sets: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(fp, bits): shingles of (fp, shingles) such that two sets with a Jaccard similarity of least or more share at least one.

    In any order that holds for all sets, two such sets share one of their first n - ceil(least * n) + 1 shingles, n being the
    size of each. Here shingles of at most FEW sets stand first, by hash, then the others by how many sets have them, so that
    a passage of many texts counts only where it leaves hardly anything else. An empty set has none.
    """
    rows = sets.select("fp", F.explode("shingles").alias("bits"))
    common = stash(rows.groupBy("bits").agg(F.count("*").alias("n")).where(F.col("n") > FEW), "simhash-common")
    own = rows.join(common, "bits").groupBy("fp").agg(F.array_sort(F.collect_list(F.struct("n", "bits"))).alias("common"))
    common_last = F.coalesce(F.transform("common", lambda s: s["bits"]), F.array().cast("array<long>"))
    size = F.size("shingles")
    first = (size - F.ceil(size * F.lit(least) - F.lit(1e-9)) + 1).cast("int")
    ordered = sets.join(own, "fp", "left").select("fp", F.concat(F.array_except("shingles", common_last), common_last).alias("ordered"), first.alias("first"))
    return ordered.select("fp", F.explode(F.slice("ordered", F.lit(1), F.col("first"))).alias("bits"))


def similar_links(sets: DataFrame, radius: int = SIMILAR_RADIUS, least: float = SIMILAR) -> DataFrame:
    """(u, v): links that connect the fingerprints of each group that are joined by similarity: a Jaccard similarity of least or
    more and at most radius differing bits. sets has (group, fp, shingles), shingles distinct; it is read more than once.

    Groups of more than PIECE_ROWS texts or PIECE_SHINGLES shingles are cut into pieces, every two of which meet in a task of
    their own. A task returns a star forest.
    """
    pieces = F.greatest(F.ceil(F.count("*") / F.lit(PIECE_ROWS)), F.ceil(F.sum(F.size("shingles")) / F.lit(PIECE_SHINGLES))).cast("int")
    large = stash(sets.groupBy("group").agg(pieces.alias("pieces")).where("pieces > 1"), "simhash-pieces")
    cut = sets.join(large, "group", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    cells = _cells(cut, ["group"], ["fp", "shingles"])

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        def values(batch) -> list:
            fps, lists = batch.column(4).to_numpy(zero_copy_only=False).view(np.uint64).tolist(), batch.column(5)
            flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)).tolist()
            return [(fp, flat[a:b]) for fp, a, b in zip(fps, [0, *ends], ends, strict=False)]

        for members, queries in _meetings(batches, 3, values):
            yield _pairs(_link_similar(members, queries, radius, least))

    return cells.mapInArrow(run, "u long, v long").distinct()


def _cells(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows with a number of pieces, dealt to the cells (keys, lo, hi) in which every two pieces of a key meet.

    In a cell of two pieces the rows of the greater one ask; rows that do not ask stand first.
    """
    keyed = (
        rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        .select(*keys, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).alias("asks"), *values)
    )
    cell = [*keys, "lo", "hi"]
    return keyed.repartition(*cell).sortWithinPartitions(*cell, "asks", "fp")


def _meetings(batches: Iterator, keys: int, values) -> Iterator[tuple[list, list]]:
    """(members, queries) of each cell in sorted batches whose first columns are the cell's keys and then asks.

    A cell of one piece has members alone. Cells in which nothing can be linked are passed over.
    """
    import numpy as np

    last, members, queries = None, [], []
    worth = lambda: len(members) + len(queries) > 1 and (queries or last[-2] == last[-1])
    for batch in batches:
        *cols, asks = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys + 1))
        rows = values(batch)
        change = np.ones(len(rows), bool)
        if len(rows) > 1:
            change[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
        at = np.flatnonzero(change).tolist()
        for a, b in zip(at, [*at[1:], len(rows)], strict=True):
            key = tuple(c[a] for c in cols)
            if key != last:
                if worth():
                    yield members, queries
                last, members, queries = key, [], []
            cut = a + int(np.count_nonzero(~asks[a:b]))
            members += rows[a:cut]
            queries += rows[cut:b]
    if worth():
        yield members, queries


def _pairs(out: list[tuple[int, int]]):
    import numpy as np
    import pyarrow as pa

    both = np.array(out, dtype=np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["u", "v"])


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, width: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fp, component): near-duplicate classes of documents, one row per row of docs.

    component is the smallest id reachable over fingerprints that differ in at most radius bits. Null and blank texts have
    fingerprint zero and are linked like any other. Rows with a null id take part; their component is null only if no row
    of the class has an id. Repeated rows each get their row. An empty table gives an empty result; other columns of docs
    are not read.
    """
    own = stash(fingerprints(docs, id_col, text_col, width), "simhash-fingerprints")
    classes = stash(own.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "simhash-classes")
    return _labelled(own, classes, connected_components(links(classes, radius)))


def _labelled(own: DataFrame, classes: DataFrame, joined: DataFrame) -> DataFrame:
    """(id, fp, component): for each row of own the least id of its fingerprint's class, or of all classes joined with it.

    Labels of fingerprints that many rows share are joined by broadcast.
    """
    roots = joined.join(classes.withColumnRenamed("fp", "node"), "node")
    smallest = roots.groupBy("component").agg(F.min("least").alias("smallest"))
    label = roots.join(smallest, "component").select(F.col("node").alias("fp"), "smallest")
    labels = stash(classes.join(label, "fp", "left").select("fp", "n", F.coalesce("smallest", "least").alias("component")), "simhash-labels")
    least = labels.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] / HOT_SHARE
    hot = F.broadcast(labels.where(F.col("n") >= least).select("fp", "component"))
    rare = own.join(hot, "fp", "left_anti").join(labels.where(F.col("n") < least), "fp")
    return own.join(hot, "fp").select("id", "fp", "component").unionByName(rare.select("id", "fp", "component"))


def shingle_sets(docs: DataFrame, width: int = SIMILAR_WORDS) -> DataFrame:
    """(group, fp, shingles array<long>): the distinct shingle hashes of each whole text of (group, fp, text)."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            sets = [np.unique(shingle_hashes(text.as_py(), width)).view(np.int64) for text in batch.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.list_(pa.int64()))], names=["group", "fp", "shingles"])

    return docs.select("group", "fp", "text").mapInArrow(run, "group long, fp long, shingles array<long>")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SIMILAR_WORDS, least: float = SIMILAR) -> DataFrame:
    """docs without near-duplicates: of each class exactly one row stays, that with the smallest id; a null id is the greatest.

    Texts are linked by equal fingerprints or by a Jaccard similarity of least or more of their sets of width-word shingles; a
    class is all that links connect. Fingerprints that share a least hash (see KEYS) form a shard. In a shard of at most FEW,
    those within SIMILAR_RADIUS bits in its BK-tree whose sketches agree are candidates. The texts of all larger shards meet
    by their rarest shingles, which loses no similar texts: shingles of at most FEW texts are shards again, and texts that are
    similar but for a fifth to shingles of more than FEW texts form groups. The similarity of candidates is computed from the
    whole texts in groups that candidates connect, so only similar texts are linked. A link is missed where two texts share no
    least hash, differ in more bits or have sketches that do not agree.

    Null and blank texts are one class. Of rows with equal ids the one with the smallest hash of its text stays, of rows that
    repeat an id and its text the first. Rows are told apart by their number in a copy of docs in the shared folder, which
    fixes it. An empty table gives an empty result; all columns of docs stay.
    """
    held = stash(docs.withColumn(ROW, F.monotonically_increasing_id()), "simhash-rows")
    text = F.col(text_col).cast("string").alias("text")
    key = F.struct(F.col(id_col).isNull().alias("missing"), F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"), F.col(ROW).alias("row"))
    own = stash(fingerprints(held.select(key.alias("key"), text), "key", "text", width, KEYS), "simhash-fingerprints")
    first = F.min(F.struct("id", "keys", "sketch"))
    told = stash(own.groupBy("fp").agg(first.alias("first"), F.count("*").alias("n")), "simhash-classes")
    classes, sketches = told.select("fp", F.col("first.id").alias("least"), "n"), told.select("fp", "first.sketch")

    shards = _counted(told.select("fp", F.posexplode("first.keys").alias("pair", "bits")))
    few = stash(_compared(shards, sketches, SIMILAR_RADIUS), "simhash-candidates")
    many = shards.where(F.col("n") > FEW).select("fp").distinct().withColumn("many", F.lit(1))
    met = few.select(F.col("u").alias("fp")).unionByName(few.select(F.col("v").alias("fp"))).withColumn("many", F.lit(0)).unionByName(many)
    met = met.groupBy("fp").agg(F.max("many").cast("long").alias("group"))
    chosen = stash(met.join(classes, "fp").select(F.col("least.row").alias(ROW), "fp", "group"), "simhash-chosen")
    sets = stash(shingle_sets(held.select(ROW, text).join(chosen, ROW), width), "simhash-sets")

    rare = rarest_shingles(sets.where(F.col("group") == 1), least).select("fp", F.lit(0).alias("pair"), "bits")
    rekeyed = _counted(rare)
    crowd = rekeyed.where(F.col("n") > FEW)
    lowest = stash(crowd.groupBy("bits").agg(F.min("fp").alias("v")), "simhash-crowds")
    star = crowd.join(lowest, "bits").select(F.col("fp").alias("u"), "v")
    near = connected_components(few.unionByName(_compared(rekeyed, sketches, SIMILAR_RADIUS)).unionByName(star))

    grouped = sets.drop("group").join(near.select(F.col("node").alias("fp"), F.col("component").alias("group")), "fp")
    grouped = stash(grouped.select("group", "fp", "shingles"), "simhash-groups")
    joined = connected_components(similar_links(grouped, SIMILAR_RADIUS, least))
    discard(shards, rekeyed, few, chosen, grouped)
    discard(sets)
    found = _labelled(own, classes, joined)
    dropped = found.where("id <> component").select(F.col("id.row").alias(ROW))
    return held.join(dropped, ROW, "left_anti").drop(ROW)


def hex_fingerprint(fp: str = "fp"):
    """A fingerprint as 16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")
