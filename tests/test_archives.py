"""Rules of a result over an archive, each met and each kept."""

from pyspark.sql import functions as F

from quarrylake.operators import archives

SOURCES = "source_id long, url string, published string, title string, text string"
GOOD = [(1, "https://a.org/1", "2024-01-02", "One", "first  line\nsecond line"), (2, "https://b.a.org/2", "2024-01-03", "Two", "other text")]


def problems(spark, sources=GOOD, decisions=((1, "include"), (2, "include")), events=(("e", "x"),), members=(("e", 1), ("e", 2)), citations=None, **brief):
    if citations is None:
        citations = [("publication", None, 1, "line second"), ("publication", None, 2, "Two"), ("event", "e", 1, "first line second line"), ("event", "e", 2, "other")]
    frames = (
        spark.createDataFrame(list(sources), SOURCES),
        spark.createDataFrame(list(decisions), "source_id long, decision string"),
        spark.createDataFrame(list(events), "event_id string, content string"),
        spark.createDataFrame(list(members), "event_id string, source_id long"),
        spark.createDataFrame(list(citations), "kind string, owner string, source_id long, quote string"),
    )
    return {(r["rule"], r["subject"]) for r in archives.result_problems(*frames, **brief).collect()}


def test_a_good_result_has_no_problem(spark):
    assert problems(spark, start="2024-01-02", end="2024-01-03", include=["a.org"], exclude=["c.org"]) == set()
    assert problems(spark, sources=[], decisions=[], events=[], members=[], citations=[]) == set()


def test_period_domains_and_decisions(spark):
    sources = [*GOOD[:1], (2, "https://xa.org/2", None, "Two", "other text"), (3, None, "2024-01-02", None, None)]
    found = problems(spark, sources=sources, decisions=[(1, "include"), (2, "include"), (2, "include"), (9, "exclude")], start="2024-01-02", include=["a.org"])
    assert found == {("period", "2"), ("domain", "2"), ("decision", "repeated:2"), ("decision", "missing:3"), ("decision", "unexpected:9")}


def test_whole_quotes(spark):
    cited = [("publication", None, 1, "second line\nthird"), ("publication", None, 2, None), ("event", "e", 1, "One"), ("event", "e", 2, "other"), ("company", "e", 7, "text")]
    found = problems(spark, citations=cited)
    assert found == {("absent_quote", "publication::1"), ("absent_quote", "publication::2"), ("absent_quote", "event:e:1"), ("unknown_source", "company:e:7"), ("foreign_excerpt", "e:7")}


def test_events(spark):
    sources = [*GOOD, (3, "https://a.org/3", "2024-01-02", "Three", "other text"), (4, "https://a.org/4", "2024-01-02", "Four", "fourth")]
    decided = [(1, "include"), (2, "include"), (3, "include"), (4, "exclude")]
    cited = [("publication", None, k, w) for k, w in ((1, "first"), (2, "other"), (3, "other"))]
    cited += [("event", e, s, w) for e, s, w in (("e", 1, "first"), ("f", 1, "first"), ("g", 2, "other"), ("g", 4, "fourth"))]
    found = problems(spark, sources=sources, decisions=decided, events=[("e", None), ("f", None), ("g", "x")], members=[("e", 1), ("f", 1), ("g", 2), ("g", 4)], citations=cited)
    assert found == {("same_content", "f:e"), ("not_included", "g:4"), ("no_event", "3"), ("repost_apart", "2"), ("repost_apart", "3")}


def test_groups_unite_keys_and_name_them(spark):
    rows = [(5, "a", "x"), (2, "b", "x"), (9, "b", "y"), (7, "c", " "), (8, "d", " "), (None, "b", "x"), (1, "e", None)]
    links = archives.grouped_links(spark.createDataFrame(rows, "id long, url string, text string"), "id", {"url": F.col("url"), "text": F.col("text")})
    assert {tuple(r) for r in links.collect()} == {(2, "text", 2, 5), (2, "url", 2, 9)}
    assert {tuple(r) for r in archives.group_rows(links).collect()} == {(2, 2, "text,url"), (5, 2, "text"), (9, 2, "url")}


def test_quotes_are_located_whole(spark):
    long = " ".join(f"w{k}" for k in range(30))
    docs = [(1, f"a {long} b"), (2, long.replace("w29", "w2")), (3, long.replace(" ", " \n")), (4, None), (5, "one two"), (5, "one two"), (6, "one twofold"), (None, "one two")]
    quotes = [("long", long), ("short", "one  two"), ("word", "b"), ("none", None), ("blank", " "), ("absent", f"{long} c")]
    d, q = spark.createDataFrame(docs, "id long, body string"), spark.createDataFrame(quotes, "q string, text string")
    found = archives.locate_quotes(d, "id", "body", q, "q", "text").collect()
    assert sorted(map(tuple, found), key=str) == [("long", 1), ("long", 3), ("short", 5), ("short", None), ("word", 1)]
    assert archives.locate_quotes(d, "id", "body", q.limit(0), "q", "text").count() == 0
    assert archives.locate_quotes(d.limit(0), "id", "body", q, "q", "text").count() == 0
