"""WARC archives: a writer with revisit records, and a reader that salvages what damage has left."""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylake.storage import scratch_path

#: Payloads of at least so many bytes are stored once.
REVISIT_BYTES = 100
RECORDS_PER_FILE = 1000
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
#: Bytes of a member that are unpacked at a time, and that a name or comment in its header has at most.
PIECE, MOST_NAME = 1 << 14, 1 << 12
TRUNCATED = "member does not end"
#: Stands among a salvaged record's headers for the fault of its member; no header line has such a name.
MEMBER_FAULT = ":member"
#: A gzip member without content. It ends every record, as Spark's text writer ends every line with the same bytes.
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record(page_id, url: str | None, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One record as a gzip member. A null id has an empty record number."""
    name = lambda x: f"<urn:page:{'' if x is None else x}>"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a record for each row of pages to archives under path, on any file system that Spark writes to.

    Of the records with equal payloads of at least REVISIT_BYTES, that with the smallest id is the response and the others
    refer to it; rows that repeat this id are responses too. A null payload is empty; a null id never is the smallest.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    held = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    firsts = held.where(F.octet_length("html") >= REVISIT_BYTES).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    joined = held.join(firsts.select(F.col("digest").alias("same"), "first"), F.col("digest") == F.col("same"), "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.col("first"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in (0, 1, 3, 4)]
            payloads = batch.column(2).cast(pa.binary()).to_pylist()
            out = [_record(i, u, p, d, r, date) for i, u, d, r, p in zip(*cols, payloads, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])

    members = joined.select("id", "url", "html", "digest", refers.alias("refers")).mapInArrow(run, "member binary")
    lines = members.select(F.col("member").cast("string").alias("value"))
    lines.write.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _parse(data: bytes, at: int) -> tuple[dict, int, int, int] | tuple[str, int]:
    """(headers, start and stop of the block, end of the record) at a version line, or (what is wrong, where to go on).

    A version line between a failed start and the place to go on would fail too, as it shares the lines that failed: they
    are read once, however many version lines stand among them.
    """
    end = len(data)
    headers, signed = {}, 0
    line = data.find(b"\r\n", at)
    while line >= 0:
        first = line + 2
        line = data.find(b"\r\n", first)
        if line <= first:
            break
        name, colon, value = data[first:line].partition(b":")
        if not colon:
            return "bad header line", first
        name = name.strip().lower().decode("latin-1")
        headers[name] = value.strip().decode("utf-8", "replace")
        if name == "warc-block-digest":
            signed = first
    if line < 0:
        return "headers do not end", end
    if not headers.get("content-length", "").isdecimal():
        return "no length", line
    first = line + 2
    last = first + int(headers["content-length"])
    if last + 4 > end or data[last : last + 4] != b"\r\n\r\n":
        return "block does not end", line
    kind, _, digest = headers.get("warc-block-digest", "").partition(":")
    if kind == "sha256" and hashlib.sha256(memoryview(data)[first:last]).hexdigest() != digest.lower():
        return "block digest differs", signed
    return headers, first, last, last + 4


def _is_member(content: bytes, at: int) -> bool:
    """Whether a gzip header stands at a position: known flags, and a name and comment that end within MOST_NAME bytes each."""
    if at + 10 > len(content) or content[at + 3] & 0xE0:
        return False
    flags, place = content[at + 3], at + 10
    if flags & 4:
        place += 2 + int.from_bytes(content[place : place + 2], "little")
    for bit in (8, 16):
        if flags & bit:
            place = content.find(b"\0", place, place + MOST_NAME) + 1
            if not place:
                return False
    return place <= len(content)


def _inflate(content: bytes, at: int, most: int | None = None) -> tuple[bytes, int, str]:
    """(data, end, what is wrong) of the gzip member at a position, up to its damage or until most bytes are out.

    It is fed in pieces that grow; the piece that fails, or that gives the last byte asked for, is halved down to a byte.
    """
    packed, out, size, place, step, narrow = zlib.decompressobj(31), [], 0, at, 256, False
    while not packed.eof and (most is None or size < most):
        if place >= len(content):
            return b"".join(out), place, TRUNCATED
        before, data, fault = packed.copy(), b"", ""
        try:
            data = packed.decompress(content[place : place + step])
        except zlib.error as e:
            fault = f"member is damaged: {e}"
        if step > 1 and (fault or most is not None and size + len(data) >= most):
            packed, step, narrow = before, step // 2, True
            continue
        if fault:
            return b"".join(out), place, fault
        out.append(data)
        size += len(data)
        place = min(place + step, len(content))
        step = step if narrow else min(2 * step, PIECE)
    return b"".join(out), place - len(packed.unused_data), ""


def _records(data: bytes) -> tuple[list[tuple | str], int]:
    """Good records (headers, block) of a member's data and, for each gap between them, what is wrong; the last good record's end."""
    items: list[tuple | str] = []
    place = reached = 0
    while 0 <= place < len(data):
        parsed = _parse(data, place) if data.startswith(VERSION, place) else ("no version line", 0)
        if len(parsed) == 4:
            items.append((parsed[0], data[parsed[1] : parsed[2]]))
            place = reached = parsed[3]
            continue
        if not items or not isinstance(items[-1], str):
            items.append(parsed[0])
        place = data.find(VERSION, max(place + 1, parsed[1]))
    return items, reached


def _salvage_member(content: bytes, at: int) -> tuple[list[tuple | str], int, str]:
    """(records and gaps, end, what is wrong with the member as a whole) of the member at a position.

    Of a member that is damaged or ends early, the records before that are kept, be they one or many; end is then where
    they end.
    """
    if not _is_member(content, at):
        return [], at + 1, "no member header"
    data, end, problem = _inflate(content, at)
    items, reached = _records(data)
    if not problem:
        return items, end, ""
    if not reached:
        return [], at + 1, problem
    if isinstance(items[-1], str):  # part of the gap that follows
        items.pop()
    return items, _inflate(content, at, reached)[1], problem


def salvage(content: bytes) -> Iterator[tuple]:
    """(offset, end, headers, payload, None) of each good record, (offset, end, None, None, reason) of each gap.

    Positions are those in the file; records and gaps inside a gzip member have the member's. After a failed check the
    reader looks for the next valid gzip member or version line, inside a member for the next version line of its data; what
    lies between is a gap. Headers have no digest: in a member that fails its checksum, a record's block is verified only.
    Such records are kept, and their headers name the member's fault as MEMBER_FAULT (else it is empty).

    False starts are told apart without searching the rest of the file: see _parse and _is_member.
    """
    at, bad, reason, failed = 0, None, "", 0
    following = _Starts(content)
    while at < len(content):
        items: list[tuple | str] = []
        problem, end = "neither member nor version line", at + 1
        if content.startswith(MAGIC, at):
            items, end, problem = _salvage_member(content, at)
        elif at >= failed and content.startswith(VERSION, at):
            parsed = _parse(content, at)
            if len(parsed) == 4:
                items, problem, end = [(parsed[0], content[parsed[1] : parsed[2]])], "", parsed[3]
            else:
                problem, failed = parsed
        if items and all(isinstance(x, str) for x in items):
            items, problem = [], items[0]
        if problem and not items:
            if bad is None:
                bad, reason = at, problem
            at = following.next(at + 1)
            continue
        if bad is not None:
            yield bad, at, None, None, reason
            bad = None
        for item in items:
            if isinstance(item, str):
                yield at, end, None, None, item
                continue
            headers, block = item
            headers[MEMBER_FAULT] = problem
            yield at, end, headers, block.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else block, None
        if problem and end == len(content):
            yield at, end, None, None, problem
        elif problem:  # the rest of a damaged member
            bad, reason, end = end, problem, following.next(end)
        at = end
    if bad is not None:
        yield bad, len(content), None, None, reason


class _Starts:
    """The positions that look like a member or a version line, asked for in rising order; each byte is searched once."""

    def __init__(self, content: bytes) -> None:
        self.content, self.ahead = content, {MAGIC: -1, VERSION: -1}

    def next(self, at: int) -> int:
        """The first of them from a position on, or the end."""
        for mark, place in self.ahead.items():
            if place < at:
                found = self.content.find(mark, at)
                self.ahead[mark] = len(self.content) if found < 0 else found
        return min(self.ahead.values())


def read(spark: SparkSession, path: str, payloads: bool = True, pattern: str = "*") -> DataFrame:
    """All records and gaps of the archives under path, one row each.

    Columns: file, offset, stop; record_type, record_id, refers_to (record numbers as text), payload_bytes, payload_digest
    (of the full payload; a revisit has them from its headers), payload (null unless asked for, and of revisits), and
    problem: null for a record that passed all checks; of a row without record_type, why the bytes from offset to stop are
    quarantined; of a record, what is wrong with its payload or the member around it. An archive without bytes gives none.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("stop", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("problem", pa.string())])
        number = lambda x: (x or "").removeprefix("<urn:page:").removesuffix(">") or None
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, size = [], 0
                for at, end, headers, payload, problem in salvage(content):
                    if headers is None:
                        rows.append((name, at, end, None, None, None, None, None, None, problem))
                        continue
                    kind, stated = headers.get("warc-type"), headers.get("warc-payload-digest", "").removeprefix("sha256:")
                    n = int(headers["x-payload-length"]) if kind == "revisit" and headers.get("x-payload-length", "").isdecimal() else len(payload)
                    own = stated if kind == "revisit" else hashlib.sha256(payload).hexdigest()
                    wrong = "payload digest differs" if kind == "response" and stated and stated != own else headers[MEMBER_FAULT] or None
                    rows.append((name, at, end, kind, number(headers.get("warc-record-id")), number(headers.get("warc-refers-to")), n, own, payload if payloads and kind != "revisit" else None, wrong))
                    size += len(payload)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, offset long, stop long, record_type string, record_id string, refers_to string, payload_bytes long, payload_digest string, payload binary, problem string")


def round_trip(pages: DataFrame, payloads: bool = True) -> DataFrame:
    """Write the archives of pages to the shared folder and read them back; see write() and read()."""
    path = scratch_path(pages.sparkSession, "warc")
    write(pages, path)
    return read(pages.sparkSession, path, payloads, "part-*")
