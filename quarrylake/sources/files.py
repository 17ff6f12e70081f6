"""File sources: checksummed scans, spreadsheets, delimited text, well descriptions, seismic headers, manifests."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a delimited file that are held at a time.
BATCH_ROWS = 10_000


def scan(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, bytes, sha256, content) of all files below path whose name fits."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), "content")


def verify(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(name, problem): files missing from the scan, unexpected, listed twice, or of another size or checksum."""
    found = files.select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), F.col("bytes").alias("b"), F.col("sha256").alias("s"))
    listed = manifest.groupBy("name").agg(F.count("*").alias("n"), F.first("bytes").alias("bytes"), F.first("sha256").alias("sha256"))
    both = listed.join(found, "name", "full_outer")
    problem = F.when(F.col("n").isNull(), "unexpected").when(F.col("b").isNull(), "missing").when(F.col("n") > 1, "repeated").when(F.col("b") != F.col("bytes"), "size").when(F.col("s") != F.col("sha256"), "checksum")
    return both.select("name", problem.alias("problem"))


def delimited(files: DataFrame) -> DataFrame:
    """(path, row, encoding, delimiter, header, cells) of CSV files: UTF-8 with or without a byte order mark, else cp1251;
    the delimiter, ; or , is the one with more fields in the header, ; on a tie. Rows are numbered from 2; quoted cells may
    span lines. Header names are trimmed."""

    def run(batches: Iterator) -> Iterator:
        import csv
        import io

        import pyarrow as pa

        schema = pa.schema([("path", pa.string()), ("row", pa.int32()), ("encoding", pa.string()), ("delimiter", pa.string()), ("header", pa.list_(pa.string())), ("cells", pa.list_(pa.string()))])
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    text, encoding = content.decode("utf-8-sig"), "utf-8"
                except UnicodeDecodeError:
                    text, encoding = content.decode("cp1251", "replace"), "cp1251"
                first = text.split("\n", 1)[0]
                mark = "," if first.count(",") > first.count(";") else ";"
                rows = csv.reader(io.StringIO(text), delimiter=mark)
                header = [h.strip() for h in next(rows, [])]
                full = ((path, n, encoding, mark, header, r) for n, r in enumerate(rows, 2) if r)
                while out := list(islice(full, BATCH_ROWS)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return files.select("path", "content").mapInArrow(run, "path string, row int, encoding string, delimiter string, header array<string>, cells array<string>")


def worksheet(files: DataFrame, sheet: int = 1) -> DataFrame:
    """(path, row, cells) of a worksheet of XLSX files: shared strings resolved, cells placed by their reference, a missing
    reference means the next column, whole numbers without a fraction. Unreadable files give no rows."""

    def run(batches: Iterator) -> Iterator:
        import io
        import re
        import zipfile
        from xml.etree import ElementTree

        import pyarrow as pa

        local = lambda e: e.tag.rpartition("}")[2]
        schema = pa.schema([("path", pa.string()), ("row", pa.int32()), ("cells", pa.list_(pa.string()))])
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    book = zipfile.ZipFile(io.BytesIO(content))
                    names, shared = set(book.namelist()), []
                    if "xl/sharedStrings.xml" in names:
                        shared = ["".join(t.text or "" for t in item.iter() if local(t) == "t") for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
                    root = ElementTree.fromstring(book.read(f"xl/worksheets/sheet{sheet}.xml"))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    continue
                out = []
                for n, row in enumerate((e for e in root.iter() if local(e) == "row"), 1):
                    cells, at = {}, 0
                    for cell in row:
                        letters = re.match("[A-Z]+", cell.get("r") or "")
                        if letters:
                            at = 0
                            for ch in letters.group():
                                at = at * 26 + ord(ch) - 64
                        else:
                            at += 1
                        value = next((e.text for e in cell.iter() if local(e) in ("v", "t")), None)
                        if cell.get("t") == "s" and value is not None:
                            value = shared[int(value)]
                        elif value is not None and re.fullmatch(r"-?[0-9]+\.0+", value):
                            value = value.partition(".")[0]
                        cells[at] = value
                    out.append((path, n, [cells.get(k) for k in range(1, max(cells, default=0) + 1)]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return files.select("path", "content").mapInArrow(run, "path string, row int, cells array<string>")


def segy_headers(files: DataFrame) -> DataFrame:
    """One row for each SEG-Y file: status ok, truncated (under 3600 bytes) or unsupported (revision 2 and later), and the
    main fields of its binary header."""
    number = lambda at: F.conv(F.hex(F.substring("content", at, 2)), 16, 10).cast("int")
    whole = F.col("bytes") >= 3600
    field = {"sample_interval": 3217, "samples": 3221, "format_code": 3225, "revision": 3501}
    rows = files.select("path", "bytes", *(F.when(whole, number(at)).alias(n) for n, at in field.items()))
    return rows.withColumn("status", F.when(~whole, "truncated").when(F.col("revision") >= 512, "unsupported").otherwise("ok"))


def wells(files: DataFrame) -> DataFrame:
    """(path, uid, name, elevation, uom, status, missing_fields) of WITSML 1.4.1.1 well documents, all wells of each;
    the status of a document is that of its first well; other versions are unsupported."""
    one = "array<struct<_uid:string,name:string,wellheadElevation:struct<_VALUE:string,_uom:string>>>"
    text = files.select("path", F.col("content").cast("string").alias("xml"))
    known = F.contains("xml", F.lit("http://www.witsml.org/schemas/1series")) & F.contains("xml", F.lit('version="1.4.1.1"'))
    parsed = text.select("path", known.alias("known"), F.from_xml("xml", f"well {one}").alias("d"))
    well = parsed.select("path", "known", F.get("d.well", F.lit(0)).alias("first"), F.posexplode_outer("d.well").alias("at", "w"))
    name = lambda field: F.concat(F.lit("wells["), F.col("at").cast("string"), F.lit(f"].{field}"))
    gaps = F.filter(F.array(F.when(F.col("w.name").isNull(), name("name")), F.when(F.col("w.wellheadElevation").isNull(), name("elevation"))), lambda x: x.isNotNull())
    status = F.when(~F.col("known"), "unsupported").when(F.col("w").isNull(), "corrupt").when(F.col("first.name").isNull() | F.col("first.wellheadElevation").isNull(), "incomplete").otherwise("ok")
    return well.select("path", F.col("w._uid").alias("uid"), "w.name", F.col("w.wellheadElevation._VALUE").try_cast("double").alias("elevation"), F.col("w.wellheadElevation._uom").alias("uom"), status.alias("status"), gaps.alias("missing_fields"))


def manifest_records(files: DataFrame) -> DataFrame:
    """(path, id, kind, data) of the records of JSON manifests: a list, one record, or an envelope whose groups hold lists.
    A file that is no JSON or holds no record has one row with a null id."""
    doc = files.select("path", F.try_parse_json(F.col("content").cast("string")).alias("doc"))
    record = "struct<id:string,kind:string,data:map<string,string>>"
    as_list = lambda p: F.try_variant_get("doc", p, f"array<{record}>")
    single = F.try_variant_get("doc", "$", record)
    alone = F.when(single["id"].isNotNull() & single["kind"].isNotNull(), F.array(single))
    groups = [as_list(p) for p in ("$", "$.Data.WorkProductComponents", "$.MasterData", "$.ReferenceData")]
    every = F.flatten(F.array(*(F.coalesce(g, F.array().cast(f"array<{record}>")) for g in (*groups, alone))))
    found = doc.select("path", F.explode_outer(F.filter(every, lambda r: r["id"].isNotNull())).alias("r"))
    return found.select("path", "r.id", "r.kind", "r.data")
