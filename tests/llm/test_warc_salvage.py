"""Salvage of archives: time in false starts, faults of a member, damaged files read by Spark."""

import gzip
import hashlib
import random
import time
from pathlib import Path

import pytest

from quarrylake.llm import warc
from quarrylake.storage import scratch_path


def member(k, body):
    return warc._record(k, f"http://x/{k}", body, hashlib.sha256(body).hexdigest(), None, "1970-01-01T00:00:00Z")


def ids(out):
    return [h["warc-record-id"].removeprefix("<urn:page:").removesuffix(">") for _, _, h, _, _ in out if h is not None]


@pytest.mark.parametrize(
    "junk",
    [
        b"WARC/1.1\r\n" * 80_000,
        b"WARC/1.1" * 80_000,
        b"X: WARC/1.1\r\n" * 80_000,
        b"WARC/1.1\r\nContent-Length: 9\r\n" * 40_000 + b"\r\n",
        warc.MAGIC * 80_000,
        b"\x1f\x8b\x08\x08" * 60_000,
        b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\x00\xff\xff" * 20_000,
        b"".join(warc.MAGIC + random.Random(5).randbytes(12) for _ in range(16_000)),
    ],
)
def test_false_starts_take_linear_time(junk):
    body = b"<p>kept"
    begin = time.process_time()
    out = list(warc.salvage(junk + member(1, body)))
    assert time.process_time() - begin < 4
    assert ids(out) == ["1"] and out[-1][3] == body and out[-1][4] is None
    assert sum(b - a for a, b, h, _, _ in out if h is None) == len(junk)


def brute_starts(data):
    """Good records found by trying every version line on its own."""
    found, at = [], data.find(warc.VERSION)
    while at >= 0:
        parsed = warc._parse(data, at)
        if len(parsed) == 4:
            found.append(data[parsed[1] : parsed[2]])
            at = data.find(warc.VERSION, parsed[3])
        else:
            at = data.find(warc.VERSION, at + 1)
    return found


def test_skipped_starts_would_fail():
    rng = random.Random(3)
    whole = gzip.decompress(member(1, b"abc"))
    parts = [b"WARC/1.1\r\n", b"X: WARC/1.1\r\n", b"WARC-Block-Digest: sha256:00\r\n", b"Content-Length: 3\r\n", b"\r\n", b"abc\r\n\r\n", b"junk", whole, b"Content-Length: x\r\n", b"WARC/1."]
    for _ in range(4000):
        data = b"".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))
        expected = brute_starts(data)
        assert [b for i in warc._records(data)[0] if not isinstance(i, str) for b in [i[1]]] == expected
        got = [(h, p) for _, _, h, p, _ in warc.salvage(data) if h is not None]
        assert len(got) == len(expected)


@pytest.mark.parametrize("n", [1, 6])
def test_records_of_a_member_with_a_bad_checksum_are_kept(n):
    plain = b"".join(gzip.decompress(member(k, f"payload {k}".encode())) for k in range(n))
    content = bytearray(gzip.compress(plain, mtime=0))
    content[-6] ^= 1  # in the checksum
    out = list(warc.salvage(bytes(content) + member(9, b"next")))
    assert ids(out) == [str(k) for k in range(n)] + ["9"]
    faults = [h[warc.MEMBER_FAULT] for _, _, h, _, _ in out if h is not None]
    assert all("incorrect data check" in f for f in faults[:-1]) and faults[-1] == ""
    gap = [(a, b) for a, b, h, _, _ in out if h is None]
    assert len(gap) == 1 and gap[0][1] == len(content)


def test_damaged_archives_through_spark(spark):
    """Of twenty records one is overwritten, one loses its checksum, junk stands before a third, and the end is cut off."""
    rng = random.Random(2)
    rows = [(k, f"http://x/{k}", f"<p>{rng.randbytes(200).hex()}") for k in range(20)]
    path = scratch_path(spark, "warc")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
    before = {r["record_id"]: r for r in warc.read(spark, path, pattern="part-*").collect()}
    assert len(before) == 20 and all(r["problem"] is None for r in before.values())
    (name,) = Path(path).glob("part-*")
    content = bytearray(name.read_bytes())
    spans = sorted((r["offset"], r["stop"]) for r in before.values())
    by_place = {r["offset"]: k for k, r in before.items()}
    wiped, unchecked, pushed = spans[4], spans[8], spans[12]
    content[wiped[0] + 20 : wiped[0] + 60] = bytes(40)
    content[unchecked[1] - 6] ^= 1
    damaged = bytes(content[: pushed[0]]) + b"junk" + bytes(content[pushed[0] : spans[19][0] + 90])
    name.with_name(f".{name.name}.crc").unlink(missing_ok=True)
    name.write_bytes(damaged)
    found = warc.read(spark, path, pattern="part-*").collect()
    records = {r["record_id"]: r for r in found if r["record_type"] is not None}
    assert set(records) == set(before) - {by_place[wiped[0]], by_place[spans[19][0]]}
    assert [k for k, r in records.items() if r["problem"] is not None] == [by_place[unchecked[0]]]
    assert all(r["payload"] == before[k]["payload"] and r["payload_digest"] == before[k]["payload_digest"] for k, r in records.items())
    gaps = sorted((r["offset"], r["stop"]) for r in found if r["record_type"] is None)
    assert wiped[0] in [a for a, _ in gaps] and (pushed[0], pushed[0] + 4) in gaps and gaps[-1][1] == len(damaged)
