"""Whole publication archives: duplicate groups over several keys with what joins them, and the rules of a result that cites them.

Memberships are compared by a count and a sum of hashes, so no event's sources are gathered in one row; texts by hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylake.operators import news
from quarrylake.operators.components import connected_components
from quarrylake.storage import stash

#: Words of a quote that are looked for before the whole is compared.
SEED_WORDS = 8


def grouped_links(records: DataFrame, id_col: str, keys: dict[str, Column]) -> DataFrame:
    """(component, basis, u, v): the links of records with an equal key, by the group that all links together connect.

    component is the smallest id of the group, u the record before v, by id, with the same key; a pair is listed once for each
    basis that links it. Null and blank keys and null ids never link; a repeated id is not linked with itself. An empty table gives none.
    """
    known = records.where(F.col(id_col).isNotNull())
    links = stash(news.duplicate_links(known, id_col, keys).where("u <> v"), "archive-links")
    groups = stash(connected_components(links), "archive-groups")
    return links.join(groups.withColumnRenamed("node", "u"), "u").select("component", "basis", "u", "v")


def group_rows(links: DataFrame) -> DataFrame:
    """(node, component, bases): each record of the groups of grouped_links, with the names of the keys that link it, sorted."""
    ends = links.select(F.col("u").alias("node"), "component", "basis").unionByName(links.select(F.col("v").alias("node"), "component", "basis"))
    return ends.groupBy("node", "component").agg(F.array_join(F.sort_array(F.collect_set("basis")), ",").alias("bases"))


def spaced(c: Column) -> Column:
    """White space as single spaces, none at the ends: the form in which quotes and texts are compared."""
    return F.trim(F.regexp_replace(c, r"[\x20\t-\r]+", " "))


def _found(rows: DataFrame, code: str, rule: str, *subject: Column) -> DataFrame:
    text = F.concat_ws(":", *(F.coalesce(c.cast("string"), F.lit("")) for c in subject))
    return rows.select(F.lit(code).alias("code"), F.lit(rule).alias("rule"), text.alias("subject"))


def _memberships(members: DataFrame, key: str, other: str) -> DataFrame:
    """(key, n, digest) of distinct pairs: how many others belong to a key, and a sum of their hashes that knows no order."""
    return members.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.xxhash64(other).cast("decimal(38,0)")).alias("digest"))


def decision_problems(sources: DataFrame, decisions: DataFrame, start: str | None, end: str | None, include: list[str], exclude: list[str]) -> DataFrame:
    """(code, rule, subject): saved sources (source_id, url, published) without exactly one decision (source_id, decision),
    decisions on others, and included sources outside the period, whose ends belong to it, or the domains.

    No bound and no list allow everything; with a bound a missing date is outside.
    """
    cover = news.completeness(sources, decisions, "source_id")
    held = sources.join(decisions.where("decision = 'include'").select("source_id").distinct(), "source_id")
    inside = F.lit(True)
    if start is not None:
        inside = inside & (F.col("published") >= start)
    if end is not None:
        inside = inside & (F.col("published") <= end)
    host = F.coalesce(news.host(F.col("url")), F.lit(""))
    allowed = (news.domain_matches(host, include) if include else F.lit(True)) & ~news.domain_matches(host, exclude)
    late = _found(held.where(~F.coalesce(inside, F.lit(False))), "NEWS_BRIEF_MISMATCH", "period", F.col("source_id"))
    foreign = _found(held.where(~allowed), "NEWS_BRIEF_MISMATCH", "domain", F.col("source_id"))
    return _found(cover, "NEWS_SOURCE_INVALID", "decision", F.col("problem"), F.col("source_id")).unionByName(late).unionByName(foreign)


def quote_problems(sources: DataFrame, citations: DataFrame) -> DataFrame:
    """(code, rule, subject): citations (kind, owner, source_id, quote) whose whole quote does not stand in the text of their
    source, or of an unknown source.

    A publication's quote may also stand in the title. Texts, titles and quotes are compared with white space as single
    spaces; an empty or null quote stands nowhere. Texts and titles go to the citations of their source by a join on its id.
    """
    saved = sources.select("source_id", spaced(F.coalesce("text", F.lit(""))).alias("body"), spaced(F.coalesce("title", F.lit(""))).alias("head"), F.lit(True).alias("known"))
    quote = spaced(F.col("quote"))
    stands = F.contains("body", quote) | ((F.col("kind") == "publication") & F.contains("head", quote))
    rows = citations.join(saved, "source_id", "left").select("kind", "owner", "source_id", "known", (F.coalesce(stands, F.lit(False)) & (quote != "")).alias("stands"))
    rows = rows.where(~F.coalesce("stands", F.lit(False)))
    rule = F.when(F.col("known").isNull(), "unknown_source").otherwise("absent_quote")
    return rows.select(F.lit("NEWS_EVIDENCE_INVALID").alias("code"), rule.alias("rule"), F.concat_ws(":", "kind", F.coalesce("owner", F.lit("")), F.col("source_id").cast("string")).alias("subject"))


def _window_hashes(words: str, width: int) -> Column:
    """The distinct hashes of all windows of width words; null if there are fewer words."""
    starts = F.when(F.size(words) >= width, F.sequence(F.lit(1), F.size(words) - width + 1))
    return F.array_distinct(F.transform(starts, lambda at: F.xxhash64(F.array_join(F.slice(words, at, F.lit(width)), " "))))


def locate_quotes(docs: DataFrame, id_col: str, text_col: str, quotes: DataFrame, quote_id: str, quote_col: str) -> DataFrame:
    """(quote_id, id): the documents in which each whole quote stands, word by word; white space divides words.

    A quote looks for its first SEED_WORDS words, or all if it has fewer: their hash is joined with that of every such window
    of the documents, and only what meets is compared as a whole. A null or blank quote stands nowhere. Rows that repeat a
    pair of ids are one.
    """
    words = F.split(spaced(F.coalesce(F.col(quote_col).cast("string"), F.lit(""))), " ")
    asked = quotes.select(F.col(quote_id).alias("q"), F.array_join(words, " ").alias("quote"), F.least(F.size(words), F.lit(SEED_WORDS)).alias("width"), words.alias("words")).where("quote <> ''")
    asked = stash(asked.select("q", "quote", "width", F.xxhash64(F.array_join(F.slice("words", F.lit(1), F.col("width")), " ")).alias("seed")), "archive-quotes")
    seeds = asked.select("width", "seed").distinct()

    body = spaced(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    held = stash(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), body.alias("body")), "archive-texts")
    split = held.select("row", F.split("body", " ").alias("words"))
    met = None
    for width in sorted(r["width"] for r in seeds.select("width").distinct().collect()):
        windows = split.select("row", F.explode(_window_hashes("words", width)).alias("seed")).join(seeds.where(F.col("width") == width), "seed")
        met = windows if met is None else met.unionByName(windows)
    if met is None:
        return asked.join(held, F.lit(False)).select(F.col("q").alias("quote_id"), "id")
    pairs = asked.join(met.distinct(), ["width", "seed"]).join(held, "row")
    whole = F.contains(F.concat(F.lit(" "), "body", F.lit(" ")), F.concat(F.lit(" "), "quote", F.lit(" ")))
    return pairs.where(whole).select(F.col("q").alias("quote_id"), "id").distinct()


def evidence_problems(decisions: DataFrame, members: DataFrame, citations: DataFrame) -> DataFrame:
    """(code, rule, subject): included sources without a publication citation; event memberships (event_id, source_id) without
    exactly one event citation; event and attribute citations of sources that are not the event's."""
    included = decisions.where("decision = 'include'").select("source_id").distinct()
    shown = citations.where("kind = 'publication'").select("source_id").distinct()
    bare = _found(included.join(shown, "source_id", "left_anti"), "NEWS_EVIDENCE_INVALID", "no_excerpt", F.col("source_id"))
    pairs = members.select("event_id", "source_id").distinct()
    cited = citations.where("kind <> 'publication'").groupBy(F.col("owner").alias("event_id"), "source_id")
    cited = cited.agg(F.count_if(F.col("kind") == "event").alias("n"))
    both = pairs.withColumn("due", F.lit(True)).join(cited, ["event_id", "source_id"], "full_outer")
    wrong = F.when(F.col("due").isNull(), "foreign_excerpt").when(F.coalesce("n", F.lit(0)) != 1, "one_excerpt")
    rows = both.select(F.lit("NEWS_EVIDENCE_INVALID").alias("code"), wrong.alias("rule"), F.concat_ws(":", "event_id", F.col("source_id").cast("string")).alias("subject")).where("rule is not null")
    return bare.unionByName(rows)


def event_problems(sources: DataFrame, decisions: DataFrame, events: DataFrame, members: DataFrame) -> DataFrame:
    """(code, rule, subject): events (event_id, content) of sources that are not included, included sources of no event, events
    of equal content and sources as an event with a smaller id, and included sources whose text equals another's but whose events differ.

    Of equal texts with differing events every source is listed. Null texts are not compared.
    """
    included = stash(decisions.where("decision = 'include'").select("source_id").distinct(), "archive-included")
    pairs = stash(members.select("event_id", "source_id").distinct(), "archive-members")
    outside = _found(pairs.join(included, "source_id", "left_anti"), "NEWS_EVENT_INVALID", "not_included", F.col("event_id"), F.col("source_id"))
    idle = _found(included.join(pairs, "source_id", "left_anti"), "NEWS_EVENT_INVALID", "no_event", F.col("source_id"))

    told = events.join(_memberships(pairs, "event_id", "source_id"), "event_id", "left")
    told = told.select("event_id", F.sha2("content", 256).alias("content"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("digest", F.lit(0)).alias("digest"))
    first = told.groupBy("content", "n", "digest").agg(F.min("event_id").alias("first"), F.count_distinct("event_id").alias("same")).where("same > 1")
    twice = _found(_again(told, first), "NEWS_DUPLICATE_EVENT", "same_content", F.col("event_id"), F.col("first"))

    own = _memberships(pairs, "source_id", "event_id")
    texts = sources.where("text is not null").select("source_id", F.sha2("text", 256).alias("text_hash")).join(included, "source_id").join(own, "source_id", "left")
    texts = stash(texts.select("source_id", "text_hash", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("digest", F.lit(0)).alias("digest")), "archive-reposts")
    split = texts.groupBy("text_hash").agg(F.min("digest").alias("a"), F.max("digest").alias("b"), F.min("n").alias("c"), F.max("n").alias("d")).where("a <> b or c <> d")
    apart = _found(texts.join(stash(split.select("text_hash"), "archive-split"), "text_hash"), "NEWS_DUPLICATE_EVENT", "repost_apart", F.col("source_id"))
    return outside.unionByName(idle).unionByName(twice).unionByName(apart)


def _again(told: DataFrame, first: DataFrame) -> DataFrame:
    """Events with an equal one of a smaller id; null contents are equal."""
    f = stash(first.drop("same"), "archive-first").alias("f")
    t = told.alias("t")
    same = F.col("t.content").eqNullSafe(F.col("f.content")) & (F.col("t.n") == F.col("f.n")) & (F.col("t.digest") == F.col("f.digest"))
    return t.join(f, same & (F.col("t.event_id") > F.col("f.first"))).select("event_id", "first")


def result_problems(sources: DataFrame, decisions: DataFrame, events: DataFrame, members: DataFrame, citations: DataFrame, start: str | None = None, end: str | None = None, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """(code, rule, subject): everything that is wrong with a result over an archive; none means that it may be published."""
    parts = [
        decision_problems(sources, decisions, start, end, include or [], exclude or []),
        evidence_problems(decisions, members, citations),
        quote_problems(sources, citations),
        event_problems(sources, decisions, events, members),
    ]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found
