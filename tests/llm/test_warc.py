from __future__ import annotations

import gzip
import hashlib

import pytest
from llm_rows import rows_of  # noqa: F401

from panelcast.llm.warc import archive_pages, read_archives, read_records, record_bytes, record_types, write_archives

BIG = "<p>é</p>" * 300


def pages(spark, rows):
    return spark.createDataFrame(
        [(*r, "clash") for r in rows], "page_id long, url string, html string, record_type string"
    )


ROWS = [
    (1, "http://a/", BIG),
    (2, "http://b/", BIG),
    (9, "http://c/ x\r\ny", BIG),
    (9, "http://c/ x\r\ny", BIG),
    (3, "http://d/", "small"),
    (4, "http://e/", "small"),
    (5, None, None),
    (6, "u", ""),
    (None, "n", BIG),
    (7, "long", "z" * 3_000_000),
]


def brute(rows):
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        revisit = len(data) >= 1000 and same and page_id != max(same)
        out.append((page_id, len(data), hashlib.sha1(data).hexdigest(),
                    "revisit" if revisit else "response", max(same) if revisit else None))
    return sorted(out, key=lambda r: [(x is not None, x) for x in r])


COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def test_round_trip(spark):
    assert rows_of(archive_pages(pages(spark, ROWS)), *COLUMNS) == brute(ROWS)
    assert archive_pages(pages(spark, [])).count() == 0


def test_archives_are_readable_members(spark):
    archives = write_archives(record_types(pages(spark, ROWS)), part_bytes=500).collect()
    text = b"".join(gzip.decompress(bytes(a.content)) for a in archives)
    assert text.count(b"WARC/1.1\r\n") == len(ROWS)


def test_any_chunking_gives_the_same_records():
    data = record_bytes(1, "u", BIG.encode(), None) + record_bytes(2, "u", BIG.encode(), 1)
    whole = list(read_records(iter([data])))
    for size in (1, 7, 100):
        assert list(read_records(data[i : i + size] for i in range(0, len(data), size))) == whole
    assert [r["record_type"] for r in whole] == ["response", "revisit"]
    assert whole[1]["payload_bytes"] == len(BIG.encode()) and whole[1]["refers_to"] == 1


def test_damage_is_refused(spark):
    good = gzip.decompress(record_bytes(1, "u", b"x" * 2000, None))
    for bad in (good.replace(b"xxx\r\n\r\n", b"xxy\r\n\r\n"), good + b"more", good[:-30]):
        with pytest.raises(ValueError):
            list(read_records(iter([gzip.compress(bad)])))
    with pytest.raises(ValueError):
        list(read_records(iter([record_bytes(1, "u", b"x", None)[:-9]])))


def test_reads_files(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(record_bytes(1, "u", b"x", None) + record_bytes(2, "v", b"", None))
    got = read_archives(spark.read.format("binaryFile").load(str(tmp_path)))
    assert [r[0] for r in rows_of(got, "page_id")] == [1, 2]
