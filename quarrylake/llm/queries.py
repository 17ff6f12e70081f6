"""Queries op1 to op13 over the given tables, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylake.llm import decontaminate, langid, maskrank, maxent, mixing, mtree, periodic, pii, simhash, spotsigs, toxicity, urlfilter, warc
from quarrylake.storage import table


def op1_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spotsigs.compare(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        F.array_join("sigs", "").alias("fingerprint"),
        F.array_join("edited_sigs", "").alias("edited_fingerprint"),
        spotsigs.likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        spotsigs.likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


SPOTSIGS_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id DESC NULLS LAST, coalesce(text, '')) AS r, count(*) OVER () AS n FROM documents),
e AS (
  SELECT a.r, a.n, a.doc_id, a.text, left(a.text, length(a.text) - length(a.text) // 2) || left(b.text, length(a.text) // 2) AS edited
  FROM d a JOIN d b ON b.r = a.r % a.n + 1),
t AS (SELECT r, 0 AS kind, text FROM e UNION ALL SELECT r, 1, edited FROM e),
p AS (SELECT r, kind, trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS plain FROM t),
w AS (
  SELECT r, kind, i, ws[i] AS word, ws[i] IN (ANCHORS) AS anchor
  FROM (SELECT r, kind, string_split(plain, ' ') AS ws FROM p WHERE plain <> '') x, unnest(range(1, len(ws) + 1)) AS u(i)),
g AS (SELECT *, coalesce(sum(CASE WHEN anchor THEN 0 ELSE 1 END) OVER (PARTITION BY r, kind ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM w),
c AS (
  SELECT r, kind, k, string_agg(word, '_' ORDER BY i) FILTER (WHERE anchor) AS ahead, max(word) FILTER (WHERE NOT anchor) AS word
  FROM g GROUP BY r, kind, k),
l AS (SELECT *, coalesce(lead(word) OVER (PARTITION BY r, kind ORDER BY k), '') AS after FROM c WHERE word IS NOT NULL),
s AS (
  SELECT r, kind, list_sort(list(DISTINCT left(md5(ahead || '_' || word || ' ' || after), 8))) AS sigs
  FROM l WHERE ahead IS NOT NULL GROUP BY r, kind),
f AS (SELECT p.r, p.kind, coalesce(s.sigs, [left(md5('#' || p.plain), 8)]) AS sigs FROM p LEFT JOIN s ON p.r = s.r AND p.kind = s.kind),
m AS (
  SELECT e.*, o.sigs AS own, x.sigs AS changed, y.sigs AS following
  FROM e JOIN f o ON o.r = e.r AND o.kind = 0 JOIN f x ON x.r = e.r AND x.kind = 1 JOIN f y ON y.r = e.r % e.n + 1 AND y.kind = 0),
z AS (SELECT *, len(list_intersect(own, changed)) AS s1, len(list_intersect(own, following)) AS s2 FROM m)
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, array_to_string(own, '') AS fingerprint,
       array_to_string(changed, '') AS edited_fingerprint, s1::DOUBLE / (len(own) + len(changed) - s1) AS near_edited,
       s2::DOUBLE / (len(own) + len(following) - s2) AS near_next
FROM z
""".replace("ANCHORS", ", ".join(f"'{w}'" for w in spotsigs.ANCHORS))


def op2_char_ratio_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op3_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each page; a record that fails a check is not left out."""
    records = warc.round_trip(table(spark, sf_dir, "pages"), payloads=False).where("record_type is not null")
    return records.select(F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM p),
f AS (SELECT h, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
       CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM d LEFT JOIN f USING (h)
"""


def op4_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    name = F.array(*map(F.lit, pii.KINDS))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(pii.BASE)]
    base = F.filter("spans", lambda s: s["ok"])
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op5_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "position")


MIX_SQL = """
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS digest,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w
  FROM d GROUP BY source),
r AS (
  SELECT *, [3, 1, 2][w + 1] AS weight,
         row_number() OVER (ORDER BY 2.0 * source_size / [3, 1, 2][w + 1], source NULLS LAST) AS k
  FROM s),
c AS (
  SELECT *, coalesce(sum(2 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
         sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free, sum(source_size) OVER () AS total
  FROM r),
l AS (
  SELECT *, (1.5::DOUBLE * CAST(total AS DOUBLE) - CAST(filled AS DOUBLE)) / CAST(free AS DOUBLE) AS level FROM c),
lam AS (
  SELECT level FROM l WHERE NOT (2 * source_size < level * weight) ORDER BY k LIMIT 1),
t AS (
  SELECT source, source_size, w,
         least((SELECT level FROM lam) * CAST(weight AS DOUBLE), 2.0::DOUBLE * CAST(source_size AS DOUBLE)) AS target FROM r),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.w,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.digest, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (
  SELECT *, CAST(least(greatest(floor(target) - first, 0), size)
         + least(greatest(floor(target) - source_size - first, 0), size) AS BIGINT) AS taken,
         CAST(first AS DOUBLE) / target AS u FROM p)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN round(CASE
    WHEN w = 0 THEN 1.5 - sqrt(greatest(2.25 - 2 * u, 0))
    WHEN w = 1 THEN -0.5 + sqrt(0.25 + 2 * u)
    ELSE u END, 9) END AS position
FROM q
"""


def op6_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_positional_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


DECONTAMINATION_SQL = """
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark),
bn AS (SELECT item_id, w, least(len(w), 13) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS win FROM bn, unnest(range(1, len(w) - n + 2)) AS u(i)),
ns AS (SELECT DISTINCT n FROM bn),
dw AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
hits AS (SELECT r, item_id, i, n FROM dw JOIN bw USING (n, win)),
pos AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS place FROM hits) GROUP BY r),
its AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""


def op9_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.hex_fingerprint().alias("fingerprint"), F.col("component").alias("component_id"))


def op10_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(table(spark, sf_dir, "documents"))


def op11_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best rows of each fiftieth embedding; see mtree.nearest for nulls, ties, repeated rows and empty tables."""
    return mtree.nearest(table(spark, sf_dir, "embeddings"))


MTREE_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, c.r AS other, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0),
o AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST, other) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM o WHERE rank <= 5
"""


def op12_presence_mask_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents of each benchmark item; see maskrank.search for nulls, ties, repeated rows and empty tables."""
    return maskrank.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


MASKRANK_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT row_number() OVER () AS q, item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
n AS (SELECT r, doc_id, len(w) AS n FROM d WHERE len(w) > 0),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM n),
bt AS (SELECT q, item_id, t, count(*) AS repeats FROM (SELECT q, item_id, unnest(w) AS t FROM b) GROUP BY q, item_id, t),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM bt) GROUP BY r, t),
f AS (SELECT t, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, s GROUP BY t, docs),
x AS (
  SELECT q, item_id, r, doc_id,
         CAST(sum(repeats * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total)))) AS BIGINT) AS score
  FROM bt JOIN p USING (t) JOIN f USING (t) JOIN n USING (r), s GROUP BY q, item_id, r, doc_id),
o AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM x WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= 10
"""


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of each document, planted ones included; see periodic.runs for nulls, repeated rows and empty tables."""
    found = periodic.runs(table(spark, sf_dir, "documents"), edit=periodic.repeat_tail)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("less"))))
    found = found.withColumn("best", best)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.back")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.less")).alias("period"),
        F.expr("(1000 * best.length) div (-best.less)").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.coalesce(F.sha2("collapsed", 256), "words_sha256").alias("collapsed_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_spotsigs": op1_spotsigs,
        "op2_char_ratio_urls": op2_char_ratio_urls,
        "op3_warc_salvage": op3_warc_salvage,
        "op4_weak_supervision_pii": op4_weak_supervision_pii,
        "op5_curriculum_mix": op5_curriculum_mix,
        "op6_hyperdimensional_language": op6_hyperdimensional_language,
        "op7_toxicity_chain": op7_toxicity_chain,
        "op8_positional_decontamination": op8_positional_decontamination,
        "op9_simhash_bktree": op9_simhash_bktree,
        "op10_maxent_lm": op10_maxent_lm,
        "op11_mtree_topk": op11_mtree_topk,
        "op12_presence_mask_search": op12_presence_mask_search,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_spotsigs": SPOTSIGS_SQL,
        "op3_warc_salvage": WARC_SQL,
        "op5_curriculum_mix": MIX_SQL,
        "op8_positional_decontamination": DECONTAMINATION_SQL,
        "op11_mtree_topk": MTREE_SQL,
        "op12_presence_mask_search": MASKRANK_SQL,
    }
