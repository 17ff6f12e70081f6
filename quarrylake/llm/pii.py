"""Personal data in text: exact base spans, and weakly supervised spans from voting labelers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylake.storage import discard, stash

# Fixed values of the base kinds, in output order. The first group of characters starts at the end of the last match or where
# no such character stands before, and is possessive: the same leftmost matches as without, in linear time.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Further candidates, which the span classifier accepts or not.
EXTRA = {
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+",
    "number": r"(?<![0-9A-Za-z.+-])(?:\([0-9]{3}\)[\x20-]?[0-9]{3}[\x20-]?[0-9]{4}|[0-9]{3}[\x20.-][0-9]{3}[\x20.-][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{9,19})(?![0-9A-Za-z])",
    "name": r"(?<![\p{L}\p{N}])(?!(?:Dear|Mrs|The|And|Hello)\b)[A-Z][a-z]{2,20}+\x20[A-Z][a-z]{2,20}+(?![\p{L}\p{N}])",
}
KINDS = (*BASE, *EXTRA)
# Fixed values that the context labeler knows: words that announce personal data, words that announce other numbers.
CUES = r"(?i)(?:token|secret|password|passwd|api.?key|e-?mail|phone|tel|fax|mobile|call|card|visa|account|iban|ssn|ip|address|contact|mr|mrs|ms|dr|dear|name|signed)[^A-Za-z0-9]{0,8}(?:is|no|number|nr)?[^A-Za-z0-9]{0,4}$"
OTHER = r"(?i)(?:version|isbn|issn|page|figure|fig|section|order|invoice|part|sku|year|chapter|article)[^A-Za-z0-9]{0,8}(?:no|number|nr)?[^A-Za-z0-9]{0,4}$"
# Fixed values of the gazetteer: ends of mail domains, calling codes, reserved networks, card issuers, token prefixes, given names.
DOMAINS = (
    "com", "org", "net", "edu", "gov", "info", "io", "biz", "co", "me", "us", "uk", "eu", "de", "fr", "es", "it", "nl", "be", "ch", "at", "pl", "se", "no", "dk", "fi", "pt",
    "ie", "cz", "gr", "ru", "ua", "in", "cn", "jp", "kr", "br", "mx", "ar", "ca", "au", "nz", "za",
)
CALLING = r"^\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|35[1-9]|37[0-9]|38[0-9]|42[01]|97[1-9]|99[2-8])"
RESERVED = r"^(?:0|10|127|169\.254|172\.(?:1[6-9]|2[0-9]|3[01])|192\.168|192\.0\.[02]|198\.51\.100|203\.0\.113|2[2-5][0-9])\."
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|3[0689]|35|6011|64[4-9]|65|62)"
PREFIXES = r"^(?:ghp_|gho_|github_pat_|glpat-|sk-|sk_live_|pk_live_|rk_live_|xox[abp]-|AKIA|ASIA|AIza|ya29|SG|npm_|eyJ)"
GIVEN = (
    "James", "John", "Robert", "Michael", "William", "David", "Richard", "Joseph", "Thomas", "Charles", "Daniel", "Matthew", "Anthony", "Mark", "Paul", "Steven", "Andrew", "George",
    "Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Jessica", "Sarah", "Karen", "Nancy", "Lisa", "Margaret", "Sandra", "Emily", "Anna", "Laura", "Alice",
    "Hans", "Peter", "Klaus", "Wolfgang", "Stefan", "Andreas", "Ursula", "Monika", "Petra", "Sabine", "Jean", "Pierre", "Michel", "Marie", "Jacques", "Sophie", "Camille", "Claire",
    "Juan", "Carlos", "Luis", "Miguel", "Pedro", "Carmen", "Lucia", "Isabel", "Sofia", "Elena", "Giovanni", "Marco", "Giulia", "Ivan", "Olga", "Natasha", "Wei", "Ming", "Hiroshi", "Yuki",
    "Ahmed", "Mohammed", "Fatima", "Priya", "Raj", "Amit",
)
CONTEXT_CHARS, AFTER_CHARS = 32, 8
#: Characters of the pieces into which a text with spans is cut before it is put together anew.
CHUNK = 1024
ROUNDS, STEPS, ACCEPT, RIDGE = 50, 25, 0.9, 1e-3
LABELERS = 5
#: The classifier's traits of a span and how many values each has: size, share of digits, share of capitals, different
#: characters, what stands after it, and the last word before it by hash.
TRAITS = {"size": 4, "digits": 3, "capitals": 3, "variety": 3, "after": 4, "word": 32}
SPAN = "array<struct<kind:int,start:int,stop:int,ok:boolean,votes:int,traits:int>>"


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    """Whether the digits of v pass Luhn's check."""
    digits = F.reverse(F.split(_digits(v), ""))
    worth = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int") + 1)))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0


def _octets(v: Column) -> Column:
    return F.forall(F.split(v, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(F.split(v, r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=.)", "").try_cast("int"), F.lit(999)) <= 255)


def _valid(kind: str, v: Column) -> Column:
    """The check that a match of the kind must pass."""
    n = F.length(_digits(v))
    if kind == "ip":
        return _octets(v)
    if kind == "card":
        return F.when(F.length(v) < 13, F.lit(False)).when((n < 13) | (n > 19), F.lit(False)).otherwise(_luhn(v))
    if kind == "phone":
        return n.between(9, 15)
    if kind == "secret":
        return v.rlike("[0-9]") & v.rlike("[A-Za-z]")
    return F.lit(True)


def _let(value: Column, then) -> Column:
    """then(value), where value is computed once however often then uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _running(values: Column, zero: Column, combine) -> Column:
    """For each element of an array, the combination of all elements before it.

    By blocks of about the root of the length, so that no growing array is copied for each element.
    """
    inside = lambda block, start: F.transform(block, lambda _, i: F.aggregate(F.slice(block, F.lit(1), i), start, combine))
    starts = lambda whole: F.transform(whole, lambda _, k: F.aggregate(F.slice(whole, F.lit(1), k), zero, combine))
    whole = lambda blocks: F.transform(blocks, lambda block: F.aggregate(block, zero, combine))

    def cut(held: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(held))).cast("int"), F.lit(1))
        return _let(width, lambda w: F.transform(F.sequence(F.lit(0), w - 1), lambda k: F.slice(held, k * w + 1, w)))

    return _let(_let(values, cut), lambda blocks: F.flatten(F.zip_with(blocks, _let(whole(blocks), starts), inside)))


def _parts(text: Column, kind: str) -> Column:
    """For each match of the kind its value and what stands before it: the gap's length, first and last characters. A last
    part without value has the rest of the text. Empty if nothing can match."""
    pattern = F.lit((BASE | EXTRA)[kind])
    parts = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, pattern, F.lit(0)),
        lambda p, v: F.struct(F.length(p).alias("gap"), F.coalesce(F.length(v), F.lit(0)).alias("n"), v.alias("v"), F.substring(p, 1, AFTER_CHARS).alias("head"), F.right(p, F.lit(CONTEXT_CHARS)).alias("before")),
    )
    possible = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+")), "name": F.lit(True)}.get(kind, text.rlike("[0-9]"))
    empty = F.array().cast("array<struct<gap:int,n:int,v:string,head:string,before:string>>")
    return F.when(possible, parts).otherwise(empty)


def _spans(parts: Column, kind: str) -> Column:
    """Code point spans of all parts that pass the kind's check, in text order, with votes and traits."""
    number = KINDS.index(kind)
    places = _running(F.transform(parts, lambda x: x["gap"] + x["n"]), F.lit(0), lambda a, x: a + x)
    placed = F.zip_with(parts, places, lambda x, at: F.struct(x["v"].alias("v"), x["before"].alias("before"), x["head"].alias("head"), (at + x["gap"]).alias("start"), x["n"].alias("n")))
    following = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1))), lambda x: x["head"])
    held = F.zip_with(placed, following, lambda x, after: F.struct(x["v"].alias("v"), x["before"].alias("before"), x["start"].alias("start"), x["n"].alias("n"), F.coalesce(after, F.lit("")).alias("after")))
    good = F.filter(held, lambda x: F.when(x["v"].isNull(), F.lit(False)).otherwise(_valid(kind, x["v"])))
    span = lambda x: F.struct(
        F.lit(number).alias("kind"), x["start"].alias("start"), (x["start"] + x["n"]).alias("stop"), F.lit(kind in BASE).alias("ok"),
        _ballot(kind, x["v"], x["before"]).cast("int").alias("votes"), _traits(x["v"], x["before"], x["after"]).cast("int").alias("traits"),
    )
    return F.when(F.size(parts) > 1, F.transform(good, span)).otherwise(F.array().cast(SPAN)).cast(SPAN)


def _vote(yes: Column, no: Column | None = None) -> Column:
    """1: personal, 2: not, 0: abstains."""
    vote = F.when(yes, F.lit(1))
    return (vote.when(no, F.lit(2)) if no is not None else vote).otherwise(F.lit(0))


def _ballot(kind: str, v: Column, before: Column) -> Column:
    """The labelers' votes on a span as base-3 digits: regex, gazetteer, context, diversity, neighbours."""
    shape = {"secret": v.rlike("^(?:[0-9a-f]{24,}|[0-9A-F]{24,}|[A-Za-z]{2,4}[_-][A-Za-z0-9_-]{16,})$"), "number": v.rlike("^(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|\\(?[0-9]{3}\\)?[\\x20.-]+[0-9]{3}[\\x20.-]?[0-9]{4})$")}.get(kind, F.lit(kind != "name"))
    bare = v.rlike("^[0-9]+$") if kind == "number" else ~v.rlike("[0-9].*[0-9].*[0-9]") if kind == "secret" else F.lit(False)
    given = F.substring_index(v, " ", 1).isin(*GIVEN)
    domain = F.lower(F.substring_index(v, ".", -1)).isin(*DOMAINS)
    known, unknown = {
        "email": (domain, ~domain), "ip": (~v.rlike(RESERVED), v.rlike(RESERVED)), "card": (v.rlike(ISSUERS), ~v.rlike(ISSUERS)), "phone": (v.rlike(CALLING), ~v.rlike(CALLING)),
        "secret": (v.rlike(PREFIXES), F.lit(False)), "number": (v.rlike("^\\(?[2-9][0-9][0-9]\\)?[\\x20.-]") & ~v.rlike("^(?:666|9[0-9][0-9])-[0-9]{2}-"), v.rlike("^(?:000|666|9[0-9][0-9])-[0-9]{2}-")),
        "name": (given, ~given),
    }[kind]
    distinct = F.size(F.array_distinct(F.split(v, "")))
    assigned = before.rlike('=\\s*["\']?$') if kind == "secret" else F.lit(False)
    glued = before.rlike("[A-Za-z0-9_@/]$")
    votes = [_vote(shape & ~bare, bare), _vote(known, unknown), _vote(assigned | before.rlike(CUES), before.rlike(OTHER)), _vote(distinct >= 6, distinct <= 3), _vote(~glued, glued)]
    return sum((c * F.lit(3**k) for k, c in enumerate(votes)), F.lit(0))


def _traits(v: Column, before: Column, after: Column) -> Column:
    """The classifier's traits of a span and its context as one number; see TRAITS."""
    n = F.length(v)
    share = lambda pattern: F.least(F.floor(F.regexp_count(v, F.lit(pattern)) * 3 / n), F.lit(2))
    variety = F.size(F.array_distinct(F.split(v, "")))
    word = F.regexp_extract(F.lower(before), r"(\p{L}+)[^\p{L}]*$", 1)
    own = {
        "size": F.least(F.floor(n / 8), F.lit(3)), "digits": share("[0-9]"), "capitals": share("[A-Z]"), "variety": F.when(variety <= 3, 0).when(variety < 10, 1).otherwise(2),
        "after": F.when(after == "", 0).when(after.rlike("^\\s"), 1).when(after.rlike("^[\\p{L}\\p{N}_]"), 2).otherwise(3), "word": F.when(word == "", 0).otherwise(F.pmod(F.crc32(word.cast("binary")), F.lit(TRAITS["word"] - 1)) + 1),
    }
    packed = F.lit(0)
    for name, values in TRAITS.items():
        packed = packed * values + own[name].cast("int")
    return packed


def _numbers(values: list[float]) -> Column:
    """A constant array: one literal, not one for each value."""
    return F.split(F.lit(",".join(map(repr, map(float, values)))), ",").cast("array<double>")


def _apart(spans: str, others: list[str]) -> Column:
    """The spans of a column that overlap none of the others, in columns that are sorted and do not overlap themselves: the
    first one that ends after a span starts is found by halving."""
    reach = "n + shiftleft(1, k)"
    before = lambda o: f"aggregate(sequence(24, 0, -1), 0, (n, k) -> if({reach} <= size(`{o}`) and try_element_at(`{o}`, {reach}).stop <= s.start, {reach}, n))"
    free = (f"(size(`{o}`) = 0 or coalesce(try_element_at(`{o}`, {before(o)} + 1).start >= s.stop, true))" for o in others)
    return F.expr(f"filter(`{spans}`, s -> {' and '.join(free)})")


def annotate(docs: DataFrame, text_col: str = "text", into: str = "pii") -> DataFrame:
    """docs with a column of candidate spans: kind (index into KINDS), start, stop in code points, votes, traits.

    Base kinds hold exactly the leftmost non-overlapping matches that pass their check. Candidates of the other kinds that
    overlap a base span are left out. Null and empty texts have none. One projection: no shuffle. Time grows with the length
    of the text and, for many spans, with the power 1.5 of their number.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    parts, names = {k: f"__{into}_parts_{k}" for k in KINDS}, {k: f"__{into}_{k}" for k in KINDS}
    found = docs.withColumn(f"__{into}", text).withColumns({parts[k]: _parts(F.col(f"__{into}"), k) for k in KINDS})
    found = found.withColumns({names[k]: _spans(F.col(parts[k]), k) for k in KINDS})

    base = [names[k] for k in BASE]
    return found.withColumn(into, F.concat(*(_apart(names[k], base) if k in EXTRA else F.col(names[k]) for k in KINDS))).drop(f"__{into}", *names.values(), *parts.values())


def _digits_of(traits: int) -> list[int]:
    """The values of the traits in a packed number."""
    out = []
    for values in reversed(TRAITS.values()):
        traits, own = divmod(traits, values)
        out.append(own)
    return out[::-1]


def label_model(counts: list[tuple[int, int, float]]) -> list[float]:
    """The probability that a span is personal for each kind and pattern of votes, at kind * 3^LABELERS + votes.

    counts has (kind, votes, n). Expectation-maximisation gives each labeler a distribution of votes on personal and on other
    spans, and each kind a prior. Patterns that do not occur have 0.5.
    """
    data = sorted(counts)
    ballots = [[v // 3**k % 3 for k in range(LABELERS)] for _, v, _ in data]
    # start: share of yes among the votes cast
    held = [(1 + b.count(1)) / (2 + b.count(1) + b.count(2)) for b in ballots]
    for _ in range(ROUNDS):
        prior = {}
        for kind in {d[0] for d in data}:
            own = [(p, d[2]) for p, d in zip(held, data, strict=True) if d[0] == kind]
            prior[kind] = (1 + sum(p * n for p, n in own)) / (2 + sum(n for _, n in own))
        votes = [[[1.0] * 3, [1.0] * 3] for _ in range(LABELERS)]
        for p, d, b in zip(held, data, ballots, strict=True):
            for k, v in enumerate(b):
                votes[k][1][v] += p * d[2]
                votes[k][0][v] += (1 - p) * d[2]
        odds = [[math.log(votes[k][1][v] / sum(votes[k][1])) - math.log(votes[k][0][v] / sum(votes[k][0])) for v in range(3)] for k in range(LABELERS)]
        held = [_sigmoid(math.log(prior[d[0]] / (1 - prior[d[0]])) + sum(odds[k][v] for k, v in enumerate(b))) for d, b in zip(data, ballots, strict=True)]
    out = [0.5] * (len(KINDS) * 3**LABELERS)
    for p, (kind, v, _) in zip(held, data, strict=True):
        out[kind * 3**LABELERS + v] = p
    return out


def fit(annotated: DataFrame, column: str = "pii") -> list[float]:
    """Weights of the span classifier: for each kind a bias and one weight for each value of each trait.

    The label model sees votes only: at most 7 * 243 counts reach the driver, however large the corpus. Its probabilities
    are the labels of all candidates, from which the classifier learns by the traits of span and context alone, so it also
    judges spans on which the labelers are silent; at most 7 * 13,824 sums reach the driver, and fewer where traits exclude each other.
    """
    import numpy as np

    spans = annotated.select(F.explode(column).alias("s")).select("s.*")
    patterns = 3**LABELERS
    found = label_model([(r["kind"], r["votes"], float(r["n"])) for r in spans.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()])
    label = F.element_at(_numbers(found), F.col("kind") * patterns + F.col("votes") + 1)
    rows = spans.groupBy("kind", "traits").agg(F.sum(F.round(label, 6).cast("decimal(20,6)")).cast("double").alias("p"), F.count("*").alias("n")).collect()
    width = 1 + sum(TRAITS.values())
    weights = np.zeros((len(KINDS), width))
    starts = np.cumsum([1, *list(TRAITS.values())[:-1]])
    for kind in range(len(KINDS)):
        own = sorted((r["traits"], r["p"], r["n"]) for r in rows if r["kind"] == kind)
        if not own:
            continue
        x = np.zeros((len(own), width))
        x[:, 0] = 1
        for k, (traits, _, _) in enumerate(own):
            x[k, starts + _digits_of(traits)] = 1
        n = np.array([r[2] for r in own], float)
        p = np.array([r[1] for r in own]) / n
        worth = np.sqrt(n)  # a pattern seen a million times must not drown the others
        worth /= worth.sum()
        for _ in range(STEPS):
            q = 1 / (1 + np.exp(-np.clip(x @ weights[kind], -30, 30)))
            slope = x.T @ (worth * (q - p)) + RIDGE * weights[kind]
            curve = (x * (worth * q * (1 - q))[:, None]).T @ x + RIDGE * np.eye(width)
            weights[kind] -= np.linalg.solve(curve, slope)
    return weights.ravel().tolist()


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


def accepted(weights: list[float], column: str = "pii", threshold: float = ACCEPT) -> Column:
    """The base spans and the candidates that the classifier accepts."""
    table = _numbers(weights)
    width = 1 + sum(TRAITS.values())

    def score(s: Column) -> Column:
        first = s["kind"] * width + 1
        total, rest, at = F.element_at(table, first), 1, 1 + sum(TRAITS.values())
        for values in reversed(TRAITS.values()):
            at -= values
            total = total + F.element_at(table, first + at + F.floor(s["traits"] / F.lit(rest)).cast("int") % values)
            rest *= values
        return total

    return F.filter(F.col(column), lambda s: s["ok"] | (score(s) >= math.log(threshold / (1 - threshold))))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) for each row of docs: base spans and those that the method adds, by kind, then start.

    The text is scanned once; candidate spans without the text are kept in the shared folder, the classifier is fitted to
    all of them and then applied. Null ids and repeated rows are kept as they are. An empty table gives an empty result.
    """
    held = stash(annotate(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).select("doc_id", "pii"), "pii-candidates")
    return held.select("doc_id", accepted(fit(held)).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with every accepted span of the text replaced by its kind in brackets; overlapping spans leave nothing between.

    length_col, if there is one, is set to the new length in code points. A null text stays null, with its length as it was.
    Repeated rows and null ids are kept; all other columns stay as they were. An empty table gives an empty result.
    """
    text = F.col(text_col).cast("string")
    # no filter on the candidates here: Spark would push it below the projections and compute each of them several times
    light = stash(annotate(docs.select(text_col), text_col).select("pii"), "pii-candidates")
    weights = fit(light)
    discard(light)
    kinds = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    found = annotate(docs, text_col, "__found").withColumn("__spans", F.array_sort(F.transform(accepted(weights, "__found"), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind")))))
    spans, chunks = F.col("__spans"), F.col("__chunks")
    found = found.withColumn("__chunks", F.when(F.size(spans) > 0, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))))
    found = found.withColumn("__ahead", _running(F.transform(spans, lambda s: s["stop"]), F.lit(0), lambda a, x: F.greatest(a, x)))

    def piece(a: Column, b: Column) -> Column:
        """The text from a to b, from the chunks in which it lies."""
        first = F.floor(a / F.lit(CHUNK)).cast("int")
        held = F.array_join(F.slice(chunks, first + 1, F.floor(F.greatest(b, a) / F.lit(CHUNK)).cast("int") - first + 1), "")
        return F.substring(held, a - first * CHUNK + 1, F.greatest(b - a, F.lit(0)))

    before = lambda s, ahead: F.when(s["stop"] <= ahead, F.lit("")).otherwise(F.concat(piece(ahead, s["start"]), F.element_at(kinds, s["kind"] + 1)))
    end = F.array_max(F.transform(spans, lambda s: s["stop"]))
    clean = F.concat(F.array_join(F.zip_with(spans, F.col("__ahead"), before), ""), piece(end, F.length(text)))
    out = found.withColumn("__clean", F.when(F.size(spans) > 0, clean).otherwise(text))
    new = {text_col: F.col("__clean")}
    if length_col and length_col in docs.columns:
        new[length_col] = F.when(F.size(spans) > 0, F.length("__clean")).otherwise(F.col(length_col)).cast(docs.schema[length_col].dataType)
    return out.withColumns(new).select(*docs.columns)
