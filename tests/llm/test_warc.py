import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import warc as W
from tessera.llm.shared import new_folder

PAGES = "page_id long, url string, html string, payload string, digest string, value string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y", "z") for i, u, h in rows], PAGES)


ROWS = [
    (1, "http://a/", "<p>one</p>"), (2, "http://b/\r\nx", "<p>one</p>"), (9, None, "<p>one</p>"), (3, "u", None), (4, "u", ""), (5, "u", "é\x00WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 9),
    (6, "u", "long " * 40_000), (7, "u", "long " * 40_000), (8, "u", "x" * W.SEGMENT_BYTES), (10, "u", "tie"), (10, "u", "tie"), (None, "u", "no id"),
]


def test_round_trip_with_segments_and_revisits(spark):
    path = new_folder(spark, "t")
    W.write_archives(pages(spark, ROWS), path)
    records = W.archive_records(spark, path).collect()
    assert {r.record_type for r in records} == {"response", "revisit", "continuation"}
    got = {}
    for r in W.read_archives(spark, path).collect():
        assert r.verified
        got[r.record_id] = r
    groups = {}
    for i, _, h in ROWS:
        groups.setdefault(h or "", []).append(i)
    for i, _, h in ROWS:
        data = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        r = got[W.ID % ("null" if i is None else i, digest)]
        keep = max((x for x in groups[h or ""] if x is not None), default=None)
        assert r.record_type == ("response" if i == keep else "revisit") and r.header_digest == digest
        assert r.record_type == "revisit" or bytes(r.payload) == data
        assert r.record_type == "response" or r.refers_to_id == W.ID % (keep, digest)


def test_least_bytes_and_empty_table(spark):
    path = new_folder(spark, "t")
    W.write_archives(pages(spark, ROWS[:3]), path, least_bytes=100)
    assert [r.record_type for r in W.read_archives(spark, path).collect()] == ["response"] * 3
    path = new_folder(spark, "t")
    W.write_archives(pages(spark, []), path)
    assert W.read_archives(spark, path).collect() == []


@pytest.mark.parametrize("size", [1, 3, 4096])
def test_chunked_framing(size):
    for data in (b"", b"a", b"\r\n0\r\n\r\n" * 5, bytes(range(256)) * 40):
        assert W.unchunk(W.chunked(data, size)) == data
    assert W.unchunk(b"3;name=v\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        W.unchunk(b"5\r\nabc")


def test_reading_foreign_archives_and_missing_segments(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\n\r\nhello"
    one = lambda kind, rid, body, *more: W._record([("WARC-Type", kind), ("WARC-Record-ID", rid), *more], body) + b"\n"
    digest = ("WARC-Payload-Digest", "sha1:" + W.digest_of(b"hello"))
    members = [one("warcinfo", "<i>", b"software: x"), one("response", "<a>", block, digest)]
    tail = one("response", "<b>", block[:10], digest, ("WARC-Segment-Number", 1)) + one("continuation", "<b2>", block[10:], ("WARC-Segment-Origin-ID", "<b>"), ("WARC-Segment-Number", 2), ("WARC-Segment-Total-Length", len(block)))
    lost = one("response", "<c>", block[:10], digest, ("WARC-Segment-Number", 1)) + one("continuation", "<c3>", block[10:], ("WARC-Segment-Origin-ID", "<c>"), ("WARC-Segment-Number", 3), ("WARC-Segment-Total-Length", len(block)))
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, members)))
    (tmp_path / "b.warc").write_bytes(tail + lost)
    got = {r.record_id: r for r in W.read_archives(spark, str(tmp_path)).collect()}
    assert bytes(got["<a>"].payload) == bytes(got["<b>"].payload) == b"hello" and got["<a>"].verified and got["<b>"].verified
    assert not got["<c>"].verified and got["<i>"].payload is None


def test_repeated_rows_have_records_of_their_own(spark, tmp_path):
    big, other = "big page " * 4_000, "another page " * 3_000
    rows = [(1, "a", big), (1, "b", big), (1, "c", big), (2, "d", big), (3, "e", other), (3, "f", "small"), (None, "g", other * 2), (None, "h", other * 2), (None, "i", big), (None, "i", big)]
    path = new_folder(spark, "t")
    W.write_archives(pages(spark, rows), path)
    got = W.read_archives(spark, path).collect()
    assert all(r.verified for r in got) and len({r.record_id for r in got}) == len(rows)
    assert sorted(r.target_uri for r in got) == sorted(u for _, u, _ in rows)
    pages(spark, rows).write.parquet(f"{tmp_path}/pages.parquet")
    found = sorted(tuple(r) for r in W.op1_warc(spark, str(tmp_path)).select(F.coalesce("page_id", F.lit(-1)), "payload_bytes", "payload_digest", "record_type", F.coalesce("refers_to", F.lit(-1))).collect())
    best = {}
    for i, _, h in rows:
        best[h] = max(best.get(h, -1), -1 if i is None else i)
    want = [(-1 if i is None else i, len(h), W.digest_of(h.encode()), h) for i, _, h in rows]
    assert found == sorted((i, n, d, "response" if i == best[h] else "revisit", -1 if i == best[h] else best[h]) for i, n, d, h in want)


@pytest.mark.parametrize("packed", [False, True])
def test_archives_that_are_cut_anywhere_are_read_and_not_verified(spark, tmp_path, packed):

    records = [r + b"\n" for k in range(3) for r in W.page_records(k, "u", W.digest_of(b"p" * 50), k, b"p" * 50, 1 << 20)] + [r + b"\n" for r in W.page_records(9, "u", "D" * 32, 1, None, 1 << 20)]
    whole = b"".join(records)
    for n, size in enumerate((len(whole), len(whole) - 30, len(whole) - len(records[3]) + 40, len(records[0]) - 20, 12, 0)):
        folder = tmp_path / f"{packed}-{n}"
        folder.mkdir()
        data = gzip.compress(whole)[: size * len(gzip.compress(whole)) // len(whole)] if packed and n else gzip.compress(whole) if packed else whole[:size]
        (folder / "a.warc").write_bytes(data)
        got = W.read_archives(spark, str(folder)).collect()
        good = [r for r in got if r.verified]
        assert all(r.payload == b"p" * 50 for r in good if r.record_type == "response")
        if not packed:
            assert len(good) == {0: 4, 1: 3, 2: 3, 3: 0, 4: 0, 5: 0}[n] and len(got) == {0: 4, 1: 4, 2: 4, 3: 1, 4: 1, 5: 0}[n]
        elif n == 0:
            assert len(good) == len(got) == 4
