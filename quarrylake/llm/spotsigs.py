"""SpotSigs document fingerprints: chains of content words that follow common words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Common words of four languages that anchor a signature.
ANCHORS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "it", "was", "on", "are", "as", "with", "be", "this", "from", "or", "an", "by", "at", "a",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "sich", "des", "auf", "ist", "nicht", "ein", "eine", "für", "im", "dem",
    "le", "la", "les", "et", "un", "une", "du", "que", "est", "pour", "qui", "dans", "par", "sur", "au", "pas",
    "el", "los", "las", "y", "en", "de", "del", "se", "no", "con", "para", "su", "por",
)
NOT_WORD = r"[^\p{L}\p{N}]+"
#: Hexadecimal digits of a signature.
DIGITS = 8
#: Documents for each bucket of neighbouring ids, and the most buckets.
BUCKET_ROWS, MOST_BUCKETS = 128, 8192


def signatures(df: DataFrame, text_col: str, into: str) -> DataFrame:
    """df with the sorted set of signatures of a text column that is not null.

    Words are letters and digits, lower-cased. Common words are tied to the content word after them; each content word with
    common words before it makes a signature together with them and the next content word. A text without such a word has
    one signature of all its words, so every text has at least one.
    """
    plain, tied = f"__{into}_plain", f"__{into}_tied"
    anchor = "(?<= )(" + "|".join(ANCHORS) + ") "
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.col(text_col)), NOT_WORD, " ")), F.lit(" "))
    content = F.filter(F.split(F.trim(F.regexp_replace(plain, anchor, "$1_")), " "), lambda w: ~F.endswith(w, F.lit("_")))
    df = df.withColumn(plain, words).withColumn(tied, content)
    chain = lambda w, after: F.when(F.contains(w, F.lit("_")), F.substring(F.md5(F.concat_ws(" ", w, F.substring_index(after, "_", -1))), 1, DIGITS))
    chains = F.filter(F.zip_with(tied, F.slice(tied, 2, F.greatest(F.size(tied), F.lit(1))), lambda w, after: F.when(w.isNotNull(), chain(w, F.coalesce(after, F.lit(""))))), lambda s: s.isNotNull())
    df = df.withColumn(into, F.array_sort(F.array_distinct(chains)))
    whole = F.array(F.substring(F.md5(F.concat(F.lit("#"), F.trim(plain))), 1, DIGITS))
    return df.withColumn(into, F.when(F.size(into) > 0, F.col(into)).otherwise(whole)).drop(plain, tied)


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two signature sets, 0 where it is under least; set sizes alone rule out most such pairs."""
    shared = F.size(F.array_intersect(a, b))
    exact = shared / (F.size(a) + F.size(b) - shared)
    bound = F.least(F.size(a), F.size(b)) / F.greatest(F.size(a), F.size(b))
    return F.when(bound < least, F.lit(0.0)).when(exact < least, F.lit(0.0)).otherwise(exact)


def length_partition(sigs: Column, least: float) -> Column:
    """The partition of a set by its size: sets at least as similar as least are in the same or in the next partition."""
    return F.floor(F.log(F.size(sigs).cast("double")) / F.log(F.lit(1 / least)) + 1e-9).cast("int")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", then=lambda df: df) -> DataFrame:
    """(bucket, copy, doc_id, text, ...): documents in buckets of neighbouring ids, each bucket ended by a copy of the next
    document in descending order of id, so a lead over a bucket is a lead over all documents.

    Buckets are cut at approximate quantiles of the id: at most MOST_BUCKETS numbers reach the driver. The text is shuffled
    once. Null ids come last; ties stand in order of text. The document after the last is the first.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ids = docs.select("doc_id")
    parts = min(MOST_BUCKETS, max(1, ids.count() // BUCKET_ROWS))
    cuts = sorted(set(map(int, ids.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.25 / parts)))) if parts > 1 else []
    place = F.lit(0)
    if cuts:
        bounds = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")
        steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))))
        place = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.try_element_at(bounds, at + step) <= F.col("doc_id"), at + step).otherwise(at))
    bucket = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(place)
    heads = ids.groupBy(bucket.alias("bucket")).agg(F.max("doc_id").alias("head"))
    order = W.orderBy(F.col("bucket").desc())
    first = F.first("head").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    follows = F.when(F.lead("bucket").over(order).isNull(), first).otherwise(F.lead("head").over(order))
    ends = F.broadcast(heads.select("bucket", follows.alias("head")))
    copies = docs.join(ends, docs["doc_id"].eqNullSafe(ends["head"])).groupBy("bucket").agg(F.min("text").alias("text"))
    rows = docs.select(bucket.alias("bucket"), F.lit(0).alias("copy"), "doc_id", "text")
    return rows.unionByName(copies.select("bucket", F.lit(1).alias("copy"), F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "text")).repartition("bucket")


def compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, sigs, edited, edited_sigs, next_sigs) for each row of docs: signatures of every whole text, of the text
    with its second half replaced by the beginning of the next document, and of the next document.

    The next document is the one with the next smaller id; see with_next(). Null texts count as empty. A single document is
    its own next. An empty table gives an empty result.
    """
    held = signatures(with_next(docs, id_col, text_col), "text", "sigs")
    order = W.partitionBy("bucket").orderBy("copy", F.col("doc_id").desc_nulls_last(), "text")
    led = held.select("doc_id", "copy", "text", "sigs", F.lead("text").over(order).alias("after"), F.lead("sigs").over(order).alias("next_sigs")).where("copy = 0")
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("after"), F.lit(1), half))
    return signatures(led.select("doc_id", "text", "sigs", "next_sigs", edited.alias("edited")), "edited", "edited_sigs")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """(u, v): links between distinct signature sets with a likeness of at least least, each set named by its smallest id.

    Sets are dealt by length partition and by each signature of their prefix: the size - ceil(least * size) + 1 rarest; two
    similar sets share one of them. Candidates of very different size are pruned before sets are intersected. Documents with
    equal sets are one node.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sets = signatures(docs, "text", "sigs").groupBy("sigs").agg(F.min("doc_id").alias("id"))
    rare = sets.select(F.explode("sigs").alias("s")).groupBy("s").agg(F.count("*").alias("df"))
    ranked = sets.select("id", F.explode("sigs").alias("s")).join(rare, "s").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("ranked"))
    keep = F.size("ranked") - F.ceil(F.lit(least) * F.size("ranked")).cast("int") + 1
    keyed = ranked.withColumn("part", length_partition(F.col("ranked"), least)).select("id", "part", F.transform("ranked", lambda x: x["s"]).alias("sigs"), F.explode(F.slice("ranked", F.lit(1), keep)).alias("k"))
    left = keyed.where("k.df > 1").select("id", "sigs", F.col("k.s").alias("s"), "part")
    right = left.select(F.col("id").alias("other"), F.col("sigs").alias("others"), "s", F.explode(F.array(F.col("part"), F.col("part") - 1)).alias("part"))
    near = left.join(right, ["s", "part"]).where("id <> other").select(F.least("id", "other").alias("u"), F.greatest("id", "other").alias("v"), "sigs", "others")
    return near.where(likeness(F.col("sigs"), F.col("others"), least) > 0).select("u", "v").distinct()
