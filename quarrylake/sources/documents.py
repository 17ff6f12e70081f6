"""Document files of several content types as text fragments; a file that breaks a rule of its type is refused as a whole."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylake.operators.tabular import first_failure
from quarrylake.storage import stash

#: Content types by kind, and what is wrong with a file.
KINDS = {
    "text": ("text/plain", "text/markdown"), "json": ("application/json", "text/json"),
    "jsonl": ("application/jsonl", "application/x-jsonlines", "application/x-ndjson"), "csv": ("text/csv", "application/csv"),
}
EMPTY, ENCODING, FORMAT, UNSUPPORTED = "DOCUMENT_EMPTY", "DOCUMENT_ENCODING_INVALID", "DOCUMENT_FORMAT_INVALID", "DOCUMENT_TYPE_UNSUPPORTED"
BLANK = r"^[\s\p{Z}\x1c-\x1f\x85]*$"
#: Line ends within a text.
LINE = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}]"
FRAGMENT = "path string, locator string, text string, metadata string"
#: Rows of a delimited file that are held at a time.
BATCH_ROWS = 10_000


def _finite(text: Column) -> Column:
    """Whether all numbers of a JSON text that have an exponent are in the range of doubles; strings are looked past."""
    bare = F.regexp_replace(F.regexp_replace(text, r"\\.", ""), r'"[^"]*"', "")
    numbers = F.regexp_extract_all(bare, F.lit(r"-?[0-9]+(?:\.[0-9]+)?[eE][+-]?[0-9]+"), F.lit(0))
    return ~F.exists(numbers, lambda n: F.abs(n.try_cast("double")) == F.lit(float("inf")))


def _json(text: Column) -> Column:
    """JSON as a variant; null if it is none, repeats a field, or holds a number that is not finite."""
    return F.when(_finite(text), F.try_parse_json(text))


def _of_values(values: DataFrame) -> DataFrame:
    """Fragments with code from (path, at, locator, value): an object's field text, or a string, is the text and the object's
    other fields are metadata; anything else is its own JSON, fields by name."""
    kind = F.coalesce(F.schema_of_variant("value"), F.lit("VOID"))
    field = F.try_variant_get("value", "$.text", "variant")
    named = kind.startswith("OBJECT") & (F.coalesce(F.schema_of_variant(field), F.lit("VOID")) == "STRING")
    text = F.when(named, F.try_variant_get("value", "$.text", "string")).when(kind == "STRING", F.try_variant_get("value", "$", "string")).otherwise(F.to_json("value"))
    others = F.to_json(F.map_filter(F.try_variant_get("value", "$", "map<string,variant>"), lambda k, _: ~(named & (k == "text"))))
    metadata = F.when(kind.startswith("OBJECT"), others).otherwise("{}")
    code = F.when(F.col("value").isNull(), FORMAT).when(text.rlike(BLANK), EMPTY)
    return values.select("path", "at", "locator", text.alias("text"), metadata.alias("metadata"), code.alias("code"))


def _csv(batches: Iterator) -> Iterator:
    import csv
    import io
    import json

    import pyarrow as pa

    schema = pa.schema([("path", pa.string()), ("at", pa.int64()), ("locator", pa.string()), ("text", pa.string()), ("metadata", pa.string()), ("code", pa.string())])

    def rows(path: str, text: str) -> Iterator[tuple]:
        records = csv.reader(io.StringIO(text, newline=""), strict=True)
        n = 0
        try:
            header = next(records, [])
            if not header or not all(header) or len(set(header)) != len(header):
                yield path, 1, "row:1", None, None, FORMAT
                return
            n = 1
            for n, record in enumerate((r for r in records if r), 2):
                if len(record) != len(header):
                    yield path, n, f"row:{n}", None, None, FORMAT
                    return
                named = dict(zip(header, record, strict=True))
                yield path, n, f"row:{n}", "\n".join(f"{k}: {v}" for k, v in named.items()), json.dumps(named, ensure_ascii=False, sort_keys=True, separators=(",", ":")), None
        except csv.Error:
            yield path, n + 1, f"row:{n + 1}", None, None, FORMAT

    for batch in batches:
        for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = rows(path, text)
            while out := list(islice(found, BATCH_ROWS)):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def fragments(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fragments (path, locator, text, metadata), refused (path, code, locator)) of files (path, content_type, content).

    Text and Markdown are one fragment, document. A JSON list has item:1, item:2, ..., other JSON is document. JSONL has
    line:n by physical line, blank lines left out. CSV has row:n from row:2, a line "name: value" for each column. Refused, in
    order: nothing but space, bytes that are no UTF-8, a NUL, another content type, JSON that is none (NaN, infinite numbers
    and repeated fields included), delimited files with a missing, empty or repeated column name, a row of another width or
    broken quotes, a fragment without text, a file without fragments. The locator is where the first fault stands. metadata
    is JSON, fields by name. A byte order mark is dropped. Paths are unique; null content is empty; an empty table gives
    empty results.
    """
    spark = files.sparkSession
    raw = F.coalesce(F.col("content"), F.lit(b""))
    kind = F.lit(None).cast("string")
    media = F.lower(F.trim(F.split_part(F.coalesce("content_type", F.lit("")), F.lit(";"), F.lit(1))))
    for name, types in KINDS.items():
        kind = F.when(media.isin(*types), name).otherwise(kind)
    text = F.regexp_replace(raw.cast("string"), r"^\x{FEFF}", "")
    code = first_failure([
        (EMPTY, F.length(raw) == 0), (ENCODING, ~F.is_valid_utf8(raw.cast("string"))), (EMPTY, text.rlike(BLANK)), (FORMAT, F.contains(text, F.lit("\0"))), (UNSUPPORTED, kind.isNull()),
    ])
    held = stash(files.select("path", kind.alias("kind"), code.alias("code"), F.when(code.isNull(), text).alias("text")), "documents")
    of = lambda k: held.where((F.col("kind") == k) & F.col("code").isNull())
    whole = of("text").select("path", F.lit(0).cast("long").alias("at"), F.lit("document").alias("locator"), "text", F.lit("{}").alias("metadata"), F.lit(None).cast("string").alias("code"))
    parsed = stash(of("json").select("path", _json(F.col("text")).alias("value")), "documents-json")
    is_list = F.coalesce(F.schema_of_variant("value"), F.lit("VOID")).startswith("ARRAY")
    items = spark.sql("SELECT path, e.pos + 1L AS at, concat('item:', e.pos + 1) AS locator, e.value FROM {lists}, LATERAL variant_explode(value) e", lists=parsed.where(is_list))
    single = parsed.where(~is_list).select("path", F.lit(0).cast("long").alias("at"), F.lit("document").alias("locator"), "value")
    lines = of("jsonl").select("path", F.posexplode(F.split("text", LINE)).alias("p", "line")).where(~F.col("line").rlike(BLANK))
    lines = lines.select("path", (F.col("p") + 1).cast("long").alias("at"), F.concat(F.lit("line:"), F.col("p") + 1).alias("locator"), _json(F.col("line")).alias("value"))
    rows = of("csv").select("path", "text").mapInArrow(_csv, "path string, at long, locator string, text string, metadata string, code string")
    every = stash(whole.unionByName(_of_values(items.unionByName(single).unionByName(lines))).unionByName(rows), "fragments")

    faults = every.where("code is not null").groupBy("path").agg(F.min_by(F.struct("code", "locator"), "at").alias("f")).select("path", "f.code", "f.locator")
    nowhere = F.lit(None).cast("string").alias("locator")
    early = held.where("code is not null").select("path", "code", nowhere)
    without = held.where("code is null").select("path").join(every.select("path"), "path", "left_anti").select("path", F.lit(EMPTY).alias("code"), nowhere)
    refused = stash(early.unionByName(faults).unionByName(without), "refused")
    return every.join(refused.select("path"), "path", "left_anti").select("path", "locator", "text", "metadata"), refused
