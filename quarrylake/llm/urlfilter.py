"""URL filter: allow and block rules, then a ratio of character language models."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Longest context; contexts seen less often than LEAST are dropped; most distinct URLs of each class to learn from.
ORDER, LEAST, TRAIN_URLS = 4, 2, 5000


def host_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL: empty if it is null or has no ://."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    rest = F.when(F.contains(url, F.lit("://")), F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)?", 1)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the host or a parent domain and the beginning of the path."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, _, start = text.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit(f".{domain}"))) & F.startswith(path, F.lit(f"/{start}"))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


class MarkovModel:
    """Variable-order Markov model of bytes with Witten-Bell smoothing from the empty context up."""

    def __init__(self, urls: list[bytes], order: int = ORDER, least: int = LEAST) -> None:
        counts: dict[bytes, dict[int, int]] = {}
        for url in urls:
            url = b"\n" * order + url + b"\n"
            for i in range(order, len(url)):
                for k in range(order + 1):
                    below = counts.setdefault(url[i - k : i], {})
                    below[url[i]] = below.get(url[i], 0) + 1
        self.order = order
        self.counts = {c: (sum(x.values()), x) for c, x in counts.items() if not c or sum(x.values()) >= least}

    def probability(self, context: bytes, byte: int) -> float:
        """Of a byte after a context of order bytes: each longer known context mixes its counts with the shorter one's."""
        p = 1 / 256
        for k in range(self.order + 1):
            if (known := self.counts.get(context[len(context) - k :])) is None:
                break
            total, followers = known
            kinds = len(followers)
            p = (followers.get(byte, 0) + kinds * p) / (total + kinds)
        return p


def ratio(url: bytes, good: MarkovModel, bad: MarkovModel, memo: dict) -> float:
    """Log-likelihood under good minus under bad, for each byte."""
    order = good.order
    url = b"\n" * order + url + b"\n"
    total = 0.0
    for i in range(order, len(url)):
        gram = url[i - order : i + 1]
        if (part := memo.get(gram)) is None:
            if len(memo) > 500_000:
                memo.clear()
            part = memo[gram] = math.log(good.probability(gram[:-1], gram[-1])) - math.log(bad.probability(gram[:-1], gram[-1]))
        total += part
    return total / (len(url) - order)


def fit(labelled: DataFrame, rows: int = TRAIN_URLS) -> dict | None:
    """Models of allowed and blocked URLs and the calibration of their ratio; None unless there are URLs of both kinds.

    labelled has (url, verdict). Of the distinct URLs of each kind, the rows with the smallest hash are used: a documented
    bound. Every fifth one calibrates a logistic curve over the ratio, both kinds weighing the same.
    """
    known = labelled.where("url is not null").dropDuplicates(["url"])
    urls = {v: [bytes(r["url"]) for r in known.where(F.col("verdict") == v).orderBy(F.xxhash64("url"), "url").limit(rows).select(F.col("url").cast("binary").alias("url")).collect()] for v in ("allow", "block")}
    if not urls["allow"] or not urls["block"]:
        return None
    cut = lambda u, rest: [x for k, x in enumerate(u) if (k % 5 == 4) == rest] or u
    good, bad = MarkovModel(cut(urls["allow"], False)), MarkovModel(cut(urls["block"], False))
    memo: dict = {}
    points = [(ratio(u, good, bad, memo), y, 1 / len(side)) for y, v in ((1, "allow"), (0, "block")) for side in [cut(urls[v], True)] for u in side]
    slope, shift = 1.0, 0.0
    for _ in range(200):
        g0 = g1 = 0.0
        for x, y, w in points:
            off = w * (1 / (1 + math.exp(-max(-30.0, min(30.0, slope * x + shift)))) - y)
            g0, g1 = g0 + off, g1 + off * x
        slope, shift = slope - 2.0 * (g1 + 1e-3 * (slope - 1)), shift - 2.0 * g0
    return {"good": good, "bad": bad, "slope": max(slope, 1e-3), "shift": shift}


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, p_allow) for each row of pages.

    A URL that a rule fits has the rule's verdict. The others are judged by how much better the model of the allowed URLs
    explains them than that of the blocked ones, for each byte; p_allow is the calibrated probability, and one half or more
    allows. Without URLs of both kinds, and for null URLs, there is no ratio and the verdict is allow. Repeated rows each
    get their row; other columns are not read. Models see bytes, so a URL need not be valid UTF-8.
    """
    host, path = host_path(F.col(url_col))
    held = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    held = held.select("page_id", "url", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    model = fit(held.where("ruled is not null").select("url", F.col("ruled").alias("verdict")))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        memo: dict = {}
        for batch in batches:
            out = []
            for url, ruled in zip(batch.column(5).cast(pa.binary()).to_pylist(), batch.column(4).to_pylist(), strict=True):
                p = None
                if model and url is not None and ruled is None:
                    z = model["slope"] * ratio(url, model["good"], model["bad"], memo) + model["shift"]
                    p = round(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), 6)
                out.append(p)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(out, pa.float64())], names=[*batch.schema.names[:5], "p_allow"])

    columns = ["page_id", "host", "path", "rule", "ruled"]
    schema = held.select(*columns, F.lit(None).cast("double").alias("p_allow")).schema
    judged = held.select(*columns, "url").mapInArrow(run, schema)
    own = F.when(F.col("p_allow") < 0.5, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "p_allow")
