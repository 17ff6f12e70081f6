"""Benchmark decontamination with a distributed positional index of the training documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylake.storage import discard, stash

WINDOW = 13
#: Most distinct benchmark terms, or rows of the tables made of anchors, that are broadcast; more are joined by a shuffle,
#: in which a posting is a few numbers.
BROADCAST_ROWS = 200_000
#: A document is contaminated if at least one word in this many is hit.
SHARE = 20
#: Share of an item's words around an anchor that must stand around the document's word for a proximity match.
NEAR = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII letters, digits and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A posting of this term, which no text can hold, stands behind the last word of each document.
END, END_TERM = "\x00", -1


def _words(text: str) -> Column:
    return F.regexp_extract_all(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(WORD), F.lit(0))


def _fold(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def _broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _items(bench: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, words) of the items that have words; words with A-Z lower-cased."""
    words = F.transform(_words(text_col), _fold)
    return bench.select(F.col(id_col).alias("item_id"), words.alias("words")).where("size(words) > 0").distinct()


def vocabulary(items: DataFrame) -> DataFrame:
    """(word, term): a number for each distinct word of the items; kept in the shared folder, which fixes the numbers."""
    words = items.select(F.explode("words").alias("word")).distinct().coalesce(1)
    return stash(words.withColumn("term", F.monotonically_increasing_id()), "benchmark-terms")


def index(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The positional index (row, pos, term, doc_id, hash) of documents: a posting for each occurrence of one of the terms
    (word, term) in the whole texts, read once, kept in the shared folder.

    row numbers the rows of docs. Each has one posting of END_TERM whose pos is its number of words, and which alone has
    doc_id and hash, a hash of id and text. Words are looked up under their lower case and compared with only A-Z lower-cased.
    """
    held = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("hash"), _words(text_col).alias("words")
    )
    posted = held.select("row", "doc_id", "hash", F.posexplode(F.concat("words", F.array(F.lit(END)))).alias("pos", "token"))
    last = docs.sparkSession.range(1).select(F.lit(END).alias("word"), F.lit(END_TERM).cast("long").alias("term"))
    keyed = terms.select("word", "term").unionByName(last).withColumn("key", F.lower("word"))
    found = posted.withColumn("key", F.lower("token")).join(_broadcast_if_small(keyed, terms.count()), "key").where(_fold(F.col("token")) == F.col("word"))
    only_end = lambda c: F.when(F.col("term") == END_TERM, F.col(c)).alias(c)
    return stash(found.select("row", "pos", "term", only_end("doc_id"), only_end("hash")), "postings")


def _anchors(items: DataFrame, terms: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """(anchor, item_id, need, term, around): for each window of an item the occurrence of its rarest term; around has the
    item's terms at most window - 1 places away, as (off, near), the anchor's own included.

    Every window holds one of its item's anchors, so an occurrence of the window is found from the anchor's postings.
    """
    placed = items.select("item_id", "words", F.posexplode("words").alias("at", "word")).join(terms, "word").join(counts, "term", "left")
    place = F.struct("at", F.coalesce("n", F.lit(0)).alias("n"), "term")
    ranked = placed.groupBy("item_id", "words").agg(F.array_sort(F.collect_list(place)).alias("terms"))
    need = F.least(F.size("terms"), F.lit(window))
    firsts = F.sequence(F.lit(1), F.size("terms") - F.col("need") + 1)
    rarest = F.transform(firsts, lambda s: F.array_min(F.transform(F.slice("terms", s, F.col("need")), lambda x: F.struct(x["n"].alias("n"), x["at"].alias("at"))))["at"])
    first = F.greatest(F.col("at") - F.lit(window - 2), F.lit(1))
    near = F.slice("terms", first, F.col("at") + F.lit(window) - first + 1)
    chosen = ranked.withColumn("need", need).withColumn("at", F.explode(F.array_distinct(rarest)))
    around = F.transform(near, lambda x: F.struct((x["at"] - F.col("at")).alias("off"), x["term"].alias("near")))
    chosen = chosen.select("item_id", "need", F.element_at("terms", F.col("at") + 1)["term"].alias("term"), around.alias("around"))
    return stash(chosen.withColumn("anchor", F.monotonically_increasing_id()), "benchmark-anchors")


def _run(mask: str, center: int, step: int, most: int) -> Column:
    """How many bits of a mask are set without a gap, from the one next to the center on, upwards or downwards."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), F.lit(0), lambda n, k: F.when((n == k - 1) & (F.getbit(F.col(mask), F.lit(center) + F.lit(step) * k) == 1), k).otherwise(n))


def search(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(documents, matches): positional matches of benchmark items in documents.

    documents has (row, doc_id, hash, n_words) for each row of docs. matches has (row, item_id, kind, start, stop): kind
    phrase is a run of words that occurs in item and document, at least window words or the whole item long, word positions
    from start to stop inclusive; kind proximity is an anchor around which at least NEAR of the item's different words occur
    within window - 1 words, in any order, without such a run.

    The lists of the rarest terms give candidates: a place in a document and one in an item. The lists of all other terms
    are intersected with them at the candidates' offsets: a join on row and position, so one very long or very often
    repeated text is spread over tasks. Null texts and texts without words have no words; items without words match
    nothing; repeated items count once; items with a null id match like others. Empty tables give empty results. Columns
    besides the named ones are not read.
    """
    if not 0 < window <= 32:
        raise ValueError("a window has 1 to 32 words: the words around an anchor are bits of a number")
    items = stash(_items(bench, item_col, item_text_col), "benchmark-items")
    terms = vocabulary(items)
    postings = index(docs, terms, id_col, text_col)
    documents = postings.where(F.col("term") == END_TERM).select("row", "doc_id", "hash", F.col("pos").cast("long").alias("n_words"))
    lists = postings.where(F.col("term") != END_TERM).select("row", "pos", "term")
    anchors = _anchors(items, terms, lists.groupBy("term").agg(F.count("*").alias("n")), window)
    around = anchors.select("anchor", F.explode("around").alias("a")).select("anchor", F.col("a.off").alias("off"), F.col("a.near").alias("term"))
    n = around.count()
    reach = window - 1
    candidates = lists.join(_broadcast_if_small(anchors.select("anchor", "term"), n), "term")
    probes = candidates.select("row", "anchor", F.col("pos").alias("center"), F.explode(F.sequence(F.col("pos") - reach, F.col("pos") + reach)).alias("pos"))
    seen = probes.where("pos >= 0").join(lists, ["row", "pos"]).withColumn("off", F.col("pos") - F.col("center"))
    at_offset = around.select("anchor", "off", "term", F.lit(True).alias("same"))
    distinct = around.groupBy("anchor").agg(F.array_sort(F.collect_set("term")).alias("kinds")).select("anchor", F.posexplode("kinds").alias("kind", "term"))
    seen = seen.join(_broadcast_if_small(at_offset, n), ["anchor", "off", "term"], "left").join(_broadcast_if_small(distinct, n), ["anchor", "term"], "left")
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)
    masks = seen.groupBy("row", "anchor", "center").agg(
        F.bit_or(F.when(F.col("same"), bit((F.col("off") + reach).cast("int"))).otherwise(F.lit(0).cast("long"))).alias("run"),
        F.bit_or(F.when(F.col("kind").isNotNull(), bit(F.col("kind"))).otherwise(F.lit(0).cast("long"))).alias("near"),
    )
    known = anchors.select("anchor", "item_id", "need", F.size(F.array_distinct("around.near")).alias("kinds"))
    found = masks.join(_broadcast_if_small(known, n), "anchor").withColumn("l", _run("run", reach, -1, reach)).withColumn("r", _run("run", reach, 1, reach))
    kind = F.when(F.expr("l + r + 1 >= need"), "phrase").when(F.bit_count("near") >= F.col("kinds") * NEAR, "proximity")
    span = lambda side: F.when(F.col("kind") == "phrase", F.col(side)).otherwise(F.lit(0))
    matches = found.withColumn("kind", kind).where("kind is not null").select("row", "item_id", "kind", (F.col("center") - span("l")).alias("start"), (F.col("center") + span("r")).alias("stop"))
    return documents, matches.distinct()


def report(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, hash, n_words, n_hit, n_items, items, contaminated) for each row of docs; see search().

    n_hit counts the words inside phrase matches; items are the ids of matched items, sorted as strings, and n_items their
    number: an item with a null id hits words but is not listed. Repeated rows each get their row.
    """
    documents, matches = search(docs, bench, id_col, text_col, item_col, item_text_col, window)
    matches = stash(matches.where("kind = 'phrase'").drop("kind"), "benchmark-matches")
    hit = matches.select("row", F.explode(F.sequence("start", "stop")).alias("pos")).distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    named = matches.select("row", F.col("item_id").cast("string").alias("item")).distinct().groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    n_hit = F.coalesce("n_hit", F.lit(0))
    return (
        documents.join(hit.join(named, "row"), "row", "left")
        .select("doc_id", "hash", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
        .select("*", F.size("items").cast("long").alias("n_items"), F.expr(f"n_hit > 0 and {SHARE} * n_hit >= n_words").alias("contaminated"))
    )


def remove_contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without its contaminated rows; all columns as they were.

    Rows are told by id and a hash of id and text: rows that repeat both are contaminated alike. Null ids are a value of
    their own, null texts and texts without words stay. Empty tables give docs as it is.
    """
    found = report(docs, bench, id_col, text_col)
    bad = stash(found.where("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("hash").alias("bad_hash")).distinct(), "contaminated")
    discard(found)  # the postings and matches, which are all that it reads
    same = docs[id_col].eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs[id_col], docs[text_col]) == bad["bad_hash"])
    return docs.join(bad, same, "left_anti")
