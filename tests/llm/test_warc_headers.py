"""Headers of archive records are read once, whatever payloads look like."""

import time

from urlrisk.llm import warc


def test_magic_lines_cost_linear_time():
    page = b"WARC/1.1\r\nContent-Type: x\r\n" * 40_000  # over a megabyte
    start = time.time()
    assert list(warc._candidates(page + b"\r\n\r\n")) == []
    assert time.time() - start < 2


def test_header_ends_at_the_first_line_that_is_no_field():
    assert warc._header(b"A-b: 1\r\nC:2\r\n\r\nrest", 0) == ({b"a-b": b"1", b"c": b"2"}, 15)
    assert warc._header(b"A: 1\r\nno field\r\n\r\n", 0) is None
    assert warc._header(b"\r\n", 0) == ({}, 2)
    assert warc._header(b"A: 1", 0) is None


def test_records_inside_payloads_are_left_out(spark):
    inner = "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(1, "http://a/", inner), (2, "http://b/", "x" * 2000), (3, "http://c/", "x" * 2000), (4, None, None), (4, None, None), (None, "http://d/", "WARC/1.1\r\n" * 500)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.read_archive(spark, warc.write_archive(df)).collect()
    assert sorted((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"], r["intact"]) for r in got) == [
        (0, 5000, "response", None, True),
        (1, len(inner), "response", None, True),
        (2, 2000, "revisit", 3, True),
        (3, 2000, "response", None, True),
        (4, 0, "response", None, True),
        (4, 0, "response", None, True),
    ]
