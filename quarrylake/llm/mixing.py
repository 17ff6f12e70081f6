"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylake.storage import stash

WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEAT = 2
WORD = r"[^\x20\x09-\x0D]+"
#: For each entry of WEIGHTS, a source's relative weight at the start, the middle and the end of training; linear between.
SCHEDULES = ((1.5, 1.0, 0.5), (0.5, 1.0, 1.5), (1.0, 1.0, 1.0))
#: Documents for each hash bucket of a source, and the most buckets.
BUCKET_ROWS, MOST_BUCKETS = 512, 1 << 16
#: Neighbouring rows of the sized table among which rows that repeat an id and size are numbered in one task.
CHUNK_BITS = 12


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *kept: str) -> DataFrame:
    """(doc_id, source, size), and columns to keep: words of every whole text; null and blank texts have none."""
    words = F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WORD))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), words.cast("long").alias("size"), *kept)


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeat: int = REPEAT) -> DataFrame:
    """(source, w, weight, source_size, target): words to take of each source.

    Sources in code point order, null last, take the weights in turn. Together they get share times all words in proportion
    to weight, but none more than repeat times its own words: what exceeds that goes to the others by weight, until none
    exceeds it. One row per source; the ordering window runs over this table only.
    """
    ranked = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    which = F.pmod(rank, F.lit(len(weights)))
    values = F.array(*map(F.lit, weights))
    sources = stash(ranked.select("source", "source_size", which.cast("int").alias("w")).withColumn("weight", F.element_at(values, F.col("w") + 1)), "mix-sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    full, level = 0, -1.0
    while True:  # each round fills at least one more source; only three sums reach the driver
        capped = F.lit(repeat) * F.col("source_size") < F.lit(level) * F.col("weight") if level >= 0 else F.lit(False)
        filled = sources.agg(F.coalesce(F.sum(F.when(capped, F.lit(repeat) * F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0)), F.count(F.when(capped, 1))).first()
        if level >= 0 and filled[2] == full:
            break
        full, free = filled[2], filled[1]
        level = (share * total - filled[0]) / free if free else level
        if not free:
            break
    return sources.withColumn("target", F.least(F.lit(float(level)) * F.col("weight"), F.lit(float(repeat)) * F.col("source_size")))


def _integral(knots: tuple[float, ...]) -> tuple[list[float], float]:
    """Integrals of a piecewise linear schedule over even steps of [0, 1], at each knot, and the whole."""
    at = [0.0]
    for a, b in zip(knots, knots[1:], strict=False):
        at.append(at[-1] + (a + b) / 2 / (len(knots) - 1))
    return at, at[-1]


def _position(w: Column, demand: Column, schedules: tuple[tuple[float, ...], ...]) -> Column:
    """The training position in [0, 1] at which a source's cumulative demand reaches a share of its target."""
    position = F.lit(0.0)
    for k, knots in enumerate(schedules):
        at, whole = _integral(knots)
        step = 1.0 / (len(knots) - 1)
        inverse = F.lit(1.0)
        for i in reversed(range(len(knots) - 1)):
            slope = (knots[i + 1] - knots[i]) / step
            rest = F.greatest(demand * F.lit(whole) - F.lit(at[i]), F.lit(0.0))
            # rest = knots[i] x + slope x^2 / 2, in the form that also holds for slope 0
            x = rest * 2.0 / (F.lit(knots[i]) + F.sqrt(F.greatest(F.lit(knots[i] ** 2) + rest * F.lit(2.0 * slope), F.lit(0.0))))
            inverse = F.when(demand * F.lit(whole) <= F.lit(at[i + 1]), F.lit(i * step) + F.when(rest > 0, x).otherwise(0.0)).otherwise(inverse)
        position = F.when(w == k, F.least(inverse, F.lit(1.0))).otherwise(position)
    return position


def mix(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeat: int = REPEAT, schedules: tuple[tuple[float, ...], ...] = SCHEDULES) -> DataFrame:
    """(row, doc_id, source, size, source_size, target, passes) for each row of sized, a stored table of (row, doc_id,
    source, size), where row is a number of its own for each row, of neighbouring rows alike but for the low bits.

    The documents of a source stand in the order of a hash of their id. The mix takes the first floor(target) words of
    that sequence repeated, so a document is taken 0 to repeat times, and the last one up to the word where the target is
    reached. passes has (nth, words, position) for each time that the mix takes the document, in this order: nth counts from
    0, words are those that it takes, and position is where in training, 0 to 1, the source's cumulative demand reaches the
    first of them: its weight schedule is integrated over training and the integral inverted.

    Cumulative sums are taken in three levels: over bucket sums, over the different (id, size) of a bucket, and over the rows
    that repeat one, by chunks of neighbouring rows. So neither a source nor an id with a third of all rows is in one task.
    Null ids and null sources are values of their own; rows that repeat an id and size follow each other by row number, each
    with its own taken words; blank texts take nothing. An empty table gives an empty result.
    """
    if len(schedules) != len(weights):
        raise ValueError("one schedule for each weight")
    sized = sized.select("row", "doc_id", "source", "size")
    n = sized.count()
    bits = min(MOST_BUCKETS, max(1, n // BUCKET_ROWS)).bit_length() - 1
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    bucket = F.shiftright(F.conv(F.substring("digest", 1, 4), 16, 10).cast("int"), 16 - bits)
    rows = sized.withColumn("digest", digest).withColumn("bucket", bucket).withColumn("chunk", F.shiftright("row", CHUNK_BITS))
    goals = targets(sized, weights, share, repeat).withColumnRenamed("source", "of")
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("held"))
    earlier = lambda value, window: F.coalesce(F.sum(value).over(window.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(F.col("source").alias("of"), F.col("bucket").alias("in_bucket"), earlier("held", W.partitionBy("source").orderBy("bucket")).alias("before"))
    starts = starts.join(goals, starts["of"].eqNullSafe(goals["of"])).select(starts["of"], "in_bucket", "before", "source_size", "target", "w")
    same = ["source", "bucket", "digest", "size"]
    chunks = rows.groupBy(*same, "chunk").agg(F.count("*").alias("m"))
    groups = chunks.groupBy(*same).agg(F.sum("m").alias("m"))
    groups = groups.withColumn("inner", earlier(F.col("m") * F.col("size"), W.partitionBy("source", "bucket").orderBy("digest", "size")))
    groups = groups.select(*(F.col(c).alias(f"g_{c}") for c in same), F.col("m").alias("g_m"), "inner")
    ahead = chunks.withColumn("ahead", earlier("m", W.partitionBy(*same).orderBy("chunk"))).where("ahead > 0")
    ahead = ahead.select(*(F.col(c).alias(f"a_{c}") for c in same), F.col("chunk").alias("a_chunk"), "ahead")
    placed = rows.withColumn("nth", F.row_number().over(W.partitionBy(*same, "chunk").orderBy("row")) - 1)
    equal = lambda mark, names: [placed[c].eqNullSafe(F.col(f"{mark}_{c}")) for c in names]
    placed = placed.join(groups, equal("g", same)).join(ahead, equal("a", [*same, "chunk"]), "left")
    placed = placed.withColumn("inner", F.col("inner") + F.col("size") * (F.col("nth") + F.coalesce("ahead", F.lit(0))))
    placed = placed.join(starts, placed["source"].eqNullSafe(starts["of"]) & (placed["bucket"] == starts["in_bucket"])).withColumn("first", F.col("before") + F.col("inner"))
    goal = F.floor("target")
    reached = [F.lit(k) * F.col("source_size") + F.col("first") for k in range(repeat)]
    taken = [F.least(F.greatest(goal - at, F.lit(0)), F.col("size")) for at in reached]
    position = lambda at: F.round(_position(F.col("w"), F.try_divide(at.cast("double"), F.col("target")), schedules), 9)
    taking = lambda k: F.struct(F.lit(k).alias("nth"), taken[k].cast("long").alias("words"), position(reached[k]).alias("position"))
    passes = F.filter(F.array(*(F.when(taken[k] > 0, taking(k)) for k in range(repeat))), lambda x: x.isNotNull())
    return placed.withColumn("passes", passes).select("row", "doc_id", "source", "size", "source_size", "target", "passes")


def training_order(mixed: DataFrame) -> DataFrame:
    """The passes of mix(), range-sorted by training position: (row, doc_id, source, size, source_size, target, nth, words,
    position). A document due twice stands in two places; documents of which nothing is taken come last, once, with nulls."""
    kept = [c for c in mixed.columns if c != "passes"]
    each = mixed.select(*kept, F.explode_outer("passes").alias("each")).select(*kept, "each.nth", "each.words", "each.position")
    return each.orderBy(F.col("position").asc_nulls_last(), "doc_id", "row")


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, position, positions) for each row of docs, gathered from its passes.

    Words are counted once, and the counts and the training order kept in the shared folder. taken sums the words of a
    document's passes; positions has the position of each, position the first, null if nothing is taken.
    """
    sized = stash(sizes(docs, id_col, text_col, source_col).withColumn("row", F.monotonically_increasing_id()), "mix-sizes")
    order = stash(training_order(mix(sized)), "mix-order")
    own = ["doc_id", "source", "size", "source_size", "target"]
    found = order.groupBy("row", *own).agg(F.coalesce(F.sum("words"), F.lit(0)).alias("taken"), F.min("position").alias("position"), F.array_sort(F.collect_list("position")).alias("positions"))
    return found.select(*own, "taken", "position", "positions")


def _numbered(docs: DataFrame, stored: bool) -> DataFrame:
    """docs with mix_row, a number of its own for each row, the same each time that it is read.

    Rows of a stored table are told apart by file and place in it. Only file names meet in one task. Other tables are
    copied to the shared folder with their numbers.
    """
    if not stored:
        return stash(docs.withColumn("mix_row", F.monotonically_increasing_id()), "mix-rows")
    files = docs.select(F.col("_metadata.file_path").alias("mix_file")).distinct()
    files = files.withColumn("mix_number", F.row_number().over(W.orderBy("mix_file")).cast("long"))
    rows = docs.select("*", F.col("_metadata.file_path").alias("mix_file"), F.col("_metadata.row_index").alias("mix_at"))
    rows = rows.join(F.broadcast(files), "mix_file").withColumn("mix_row", F.shiftleft("mix_number", 40) + F.col("mix_at"))
    return rows.select(*docs.columns, "mix_row")


def _mixed(held: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return mix(stash(sizes(held, id_col, text_col, source_col, "mix_row").withColumnRenamed("mix_row", "row"), "mix-sizes"))


def curriculum(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents that the mix takes words of, each once, range-sorted by the position of its first pass.

    Adds mix_size, mix_source_size, mix_target, mix_taken, mix_position and mix_positions (see mixture()); columns of docs with
    these names are replaced. training() has a row for each pass. Repeated rows keep their own taken words; blank texts
    and an empty table give no rows.
    """
    names = ["size", "source_size", "target", "taken", "position", "positions"]
    held = _numbered(docs.drop("mix_row", *(f"mix_{c}" for c in names)), False)
    mixed = _mixed(held, id_col, text_col, source_col).where("size(passes) > 0")
    mixed = mixed.withColumn("taken", F.aggregate("passes", F.lit(0).cast("long"), lambda a, x: a + x["words"])).withColumn("positions", F.col("passes.position")).withColumn("position", F.col("positions")[0])
    mixed = mixed.select(F.col("row").alias("mix_row"), *(F.col(c).alias(f"mix_{c}") for c in names))
    return held.join(mixed, "mix_row").orderBy("mix_position", id_col, "mix_row").drop("mix_row")


def training(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", stored: bool = False) -> DataFrame:
    """The texts in training order: one row for each time that the mix takes a document, range-sorted by position.

    Adds mix_size, mix_source_size, mix_target, mix_pass (from 0), mix_taken (words of this pass) and mix_position; columns of
    docs with these names are replaced. stored: docs are Parquet files as they are, so their rows need no copy with row
    numbers. Repeated rows keep their own passes; blank texts and an empty table give no rows.
    """
    names = {"size": "size", "source_size": "source_size", "target": "target", "nth": "pass", "words": "taken", "position": "position"}
    new = [f"mix_{c}" for c in names.values()]
    held = _numbered(docs.drop("mix_row", "mix_file", "mix_number", "mix_at", *new), stored)
    each = _mixed(held, id_col, text_col, source_col).select("*", F.explode("passes").alias("each")).select("*", "each.*")
    each = each.select(F.col("row").alias("mix_row"), *(F.col(c).alias(f"mix_{n}") for c, n in names.items()))
    return held.join(each, "mix_row").orderBy("mix_position", id_col, "mix_row").drop("mix_row")
