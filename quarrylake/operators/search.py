"""Fragments, an inverted index with BM25, excerpts and quoted evidence."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylake.storage import stash

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def fragment_id(source: Column, locator: Column, text: Column) -> Column:
    """sha256 of source, locator and text with NUL between."""
    return F.sha2(F.concat(source.cast("string"), F.lit("\0"), locator, F.lit("\0"), text), 256)


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Non-blank lines with their physical line number as locator."""
    rows = docs.select(F.col(id_col).alias("source"), F.posexplode(F.split(text_col, "\n")).alias("at", "text")).where("trim(text) <> ''")
    return rows.select("source", F.concat(F.lit("line:"), (F.col("at") + 1).cast("string")).alias("locator"), "text")


def index(fragments: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(postings (term, id, tf), lengths (id, dl)) of a fragment table."""
    held = fragments.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("t"))
    postings = held.select("id", F.explode("t").alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"))
    return postings, held.select("id", F.size("t").cast("long").alias("dl"))


def bm25(fragments: DataFrame, query: str, id_col: str, text_col: str, limit: int) -> DataFrame:
    """(id, score) of the best fragments for any of the query's words, repeated words counting again; lower is better.

    The postings of the query's words are filtered out of the scan and kept in the shared folder before they are ranked.
    """
    if not 1 <= limit <= 20:
        raise ValueError("limit must be from 1 to 20")
    spark = fragments.sparkSession
    words = spark.range(1).select(F.explode(tokens(F.lit(query))).alias("term")).groupBy("term").agg(F.count("*").alias("times"))
    held = fragments.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("t"))
    wanted = F.array_distinct(tokens(F.lit(query)))
    hits = stash(held.select("id", F.size("t").cast("long").alias("dl"), F.filter("t", lambda w: F.array_contains(wanted, w)).alias("t")), "bm25")
    stats = hits.agg(F.count("*").alias("docs"), F.avg("dl").alias("mean")).first()
    postings = hits.select("id", "dl", F.explode("t").alias("term")).groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((F.lit(stats["docs"]) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    part = F.col("times") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(float(stats["mean"] or 1))))
    scored = postings.join(F.broadcast(df.join(words, "term")), "term").groupBy("id").agg(F.round(-F.sum(part), 6).alias("score"))
    return scored.orderBy("score", "id").limit(limit)


def excerpt(text: Column, words: list[str], width: int = 600) -> Column:
    """width characters around the first of the words, with dots where text is cut off."""
    low = F.lower(text)
    at = F.array_min(F.filter(F.array(*(F.locate(w, low) for w in words)), lambda p: p > 0))
    start = F.greatest(F.coalesce(at, F.lit(1)) - width // 2, F.lit(1))
    cut = F.substring(text, start, F.lit(width))
    return F.concat(F.when(start > 1, "...").otherwise(""), cut, F.when(start + width - 1 < F.length(text), "...").otherwise(""))


def evidence(quotes: DataFrame, fragments: DataFrame) -> DataFrame:
    """quotes (quote_id, fragment_id, source, quote) with problem: unknown_fragment, foreign_source, absent_quote or null."""
    known = fragments.select(F.col("fragment_id").alias("known_id"), F.col("source").alias("known_source"), F.col("text").alias("known_text"))
    joined = quotes.join(known, F.col("fragment_id") == F.col("known_id"), "left")
    problem = (
        F.when(F.col("known_id").isNull(), "unknown_fragment").when(~F.col("source").eqNullSafe(F.col("known_source")), "foreign_source")
        .when(~F.coalesce(F.contains("known_text", "quote"), F.lit(False)), "absent_quote")
    )
    return joined.select("quote_id", "fragment_id", problem.alias("problem"))


#: Characters of the phrases that are looked for together; every task gets them. Fewest letters of a word that counts alone.
PHRASE_CHARS, LEAST_WORD = 4 << 20, 3


def folded(text: str | None) -> str:
    """Compatibility form, case folded, ё as е, with single spaces."""
    return " ".join(unicodedata.normalize("NFKC", text or "").casefold().replace("ё", "е").split())


def _finder(phrases: list[tuple[int, str]]):
    """A mapInArrow function from (row, text) to (row, term, phrase_found, words) for the phrases that a text matches."""

    def find(batches: Iterator) -> Iterator:
        import ahocorasick
        import pyarrow as pa

        tree, of_word = ahocorasick.Automaton(), {}
        for number, phrase in phrases:
            tree.add_word(phrase, [*tree.get(phrase, []), number])
            for word in {w for w in re.findall(r"\w+", phrase) if len(w) >= LEAST_WORD}:
                of_word.setdefault(word, []).append(number)
        if phrases:
            tree.make_automaton()
        for batch in batches:
            rows, terms, whole, words = [], [], [], []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = folded(text.as_py())
                met: dict[int, list[str]] = {}
                for word in of_word.keys() & set(re.findall(r"\w+", text)):
                    for number in of_word[word]:
                        met.setdefault(number, []).append(word)
                found = {n for _, numbers in tree.iter(text) for n in numbers} if phrases and text else set()
                for number in sorted(met.keys() | found):
                    rows.append(row)
                    terms.append(number)
                    whole.append(number in found)
                    words.append(sorted(met.get(number, [])))
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((rows, terms, whole, words), kinds, strict=True)], names=["row", "term", "phrase_found", "words"])

    return find


def phrase_candidates(records: DataFrame, terms: DataFrame, id_col: str, text_col: str, term_col: str, phrase_col: str) -> DataFrame:
    """(record_id, term_id, phrase_found, words) for each record and term that match: the whole phrase stands in the text, as
    letters stand, or they share a word of at least LEAST_WORD letters; words lists those shared, sorted.

    Texts and phrases are compared folded(). All phrases of a round (PHRASE_CHARS) are looked for in one walk of a text, in
    the task that has the text, so texts are not shuffled; more phrases take more rounds. Blank phrases match nothing. Rows
    that repeat an id match on their own, null texts match nothing, empty tables give an empty result.
    """
    spark = records.sparkSession
    held = stash(terms.select(F.monotonically_increasing_id().alias("term"), F.col(term_col).alias("term_id"), F.col(phrase_col).cast("string").alias("phrase")), "terms")
    rounds = max(1, -(-held.agg(F.coalesce(F.sum(F.length("phrase")), F.lit(0))).first()[0] // PHRASE_CHARS))
    numbered = stash(records.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("record_id"), F.col(text_col).cast("string").alias("text")), "records")
    found = spark.createDataFrame([], "row long, term long, phrase_found boolean, words array<string>")
    for r in range(rounds):
        mine = held.where(F.pmod(F.xxhash64("term"), F.lit(rounds)) == r).select("term", "phrase").collect()
        phrases = [(m["term"], folded(m["phrase"])) for m in mine if folded(m["phrase"])]
        found = found.unionByName(numbered.select("row", "text").mapInArrow(_finder(phrases), found.schema))
    hits = stash(found, "candidates")
    return hits.join(held.select("term", "term_id"), "term").join(numbered.select("row", "record_id"), "row").select("record_id", "term_id", "phrase_found", "words")
