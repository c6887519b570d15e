"""WARC archives of pages: writing with revisit records, and reading with verified record boundaries.

Writing: one record per page. Of the pages with equal payloads of at least ``revisit_from`` bytes, the one with the largest id is a
``response``; the others are ``revisit`` records without a block that refer to it. Spark's text writer writes the
files, with the blank lines that end a record as line separator, so a lost task is simply written again.

Reading (boundary chain): the tasks look for the magic line anywhere in a file and emit, for each candidate, its offset and
that of its successor by its own Content-Length. A payload may hold the magic line, or whole records, so a candidate
counts only if the chain of successors from offset 0 of its file reaches it. That is decided by pointer jumping: in round
i the reached offsets are extended by 2^i successors and the pointers are doubled, so a file of n records takes log2(n)
rounds of joins on (file, offset), and no task walks a file's chain.

Cases: a null payload is empty, a null url gives an empty target, line breaks in a url are percent-encoded. Rows with
the same id and payload are all responses if they are the group's largest; a null id never is the one referred to while
another exists. An empty table gives an archive without records. Other columns are not read. A file that does not
start with a record, or a chain that breaks, yields the records before the break. Page sizes are limited by what
one row can hold; files hold about ``FILE_BYTES`` of pages of average size.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlrisk.llm.common import shared_folder
from urlrisk.operators.ordering import cut_lineage
from urlrisk.operators.skew import bounded_broadcast

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
FILE_BYTES = 16 << 20
REVISIT_FROM = 1000
RECORD = (
    "file string, offset long, next long, page_id long, url string, record_type string, refers_to long, "
    "payload_bytes long, payload_digest string, intact boolean"
)
FIELD = re.compile(rb"([A-Za-z-]+):[ \t]*([^\r\n]*)\r\n")
PAGE_URN = re.compile(rb"<urn:page:(-?\d+)>")


def write_archive(
    pages: DataFrame,
    folder: str | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    revisit_from: int = REVISIT_FROM,
    date: str = "2024-01-01T00:00:00Z",
) -> str:
    """Write a record per row below ``folder`` (a new shared one by default); the folder."""
    spark = pages.sparkSession
    folder = folder or shared_folder(spark, "warc")
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.coalesce(F.col(url_col), F.lit("")).alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("n"),
        F.sha1(payload.cast("binary")).alias("digest"),
    )
    sums = rows.where(F.col("n") >= revisit_from).groupBy("digest").agg(F.count("*").alias("_c"), F.max("page_id").alias("master"))
    groups = cut_lineage(sums.where("_c > 1 and master is not null").drop("_c"))
    size = rows.agg(F.avg("n")).first()[0] or 1.0  # one number
    joined = rows.join(bounded_broadcast(groups, 200_000), "digest", "left")
    again = F.col("master").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("master"))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    record = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        F.coalesce(line("WARC-Record-ID", urn("page_id")), F.lit("")),
        line("WARC-Target-URI", url),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("X-Payload-Length", F.col("n").cast("string")),
        F.when(again, line("WARC-Refers-To", urn("master"))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(again, "0").otherwise(F.col("n").cast("string"))),
        F.lit("\r\n"),
        F.when(again, "").otherwise(F.col("payload")),
    )
    per_file = max(1, int(FILE_BYTES / max(size, 1.0)))
    joined.select(record.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", per_file).text(folder)
    return folder


def _header(content: bytes, at: int) -> tuple[dict[bytes, bytes], int] | None:
    """The fields from a place on and where the block starts; None at the first line that is no field, so that no line is read twice."""
    fields = {}
    while not content.startswith(b"\r\n", at):
        line = FIELD.match(content, at)
        if line is None:
            return None
        fields[line[1].lower()] = line[2]
        at = line.end()
    return fields, at + 2


def _candidates(content: bytes) -> Iterator[tuple]:
    """(offset, next, page_id, url, type, refers_to, bytes, digest, intact) of all places that look like a record."""
    magic, end = MAGIC.encode(), END.encode()
    at = content.find(magic)
    while at >= 0:
        fields, start = _header(content, at + len(magic)) or ({}, 0)
        length = fields.get(b"content-length", b"")
        if length.isdigit():
            stop = start + int(length)
            if content[stop : stop + len(end)] == end:
                own, other = PAGE_URN.match(fields.get(b"warc-record-id", b"")), PAGE_URN.match(fields.get(b"warc-refers-to", b""))
                digest = fields.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode("ascii", "replace")
                kind = fields.get(b"warc-type", b"").decode("ascii", "replace")
                full = fields.get(b"x-payload-length", length)
                size = int(full) if full.isdigit() else None
                intact = kind == "revisit" or hashlib.sha1(memoryview(content)[start:stop]).hexdigest() == digest
                url = fields.get(b"warc-target-uri", b"").decode("utf-8", "replace")
                yield at, stop + len(end), own and int(own[1]), url, kind, other and int(other[1]), size, digest, intact
        at = content.find(magic, at + 1)


def scan_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Every place of every file that looks like a record, with its successor's offset."""
    names = [c.split()[0] for c in RECORD.split(", ")]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows = [(path, *row) for row in _candidates(bytes(content))]
                out = pd.DataFrame(rows, columns=names)
                yield out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})

    files = spark.read.format("binaryFile").load(folder)
    return files.select("path", "content").mapInPandas(scan, RECORD)


def verified_records(candidates: DataFrame) -> DataFrame:
    """The candidates that the chain from offset 0 of their file reaches.

    After round i the first 2^(i+1) records of each chain are known and a pointer leads 2^(i+1) records on; offsets only
    grow, so no record is reached twice. Pointers are two offsets and the hash of a file's name; they are broadcast while a count shows
    that they are few.
    """
    candidates = cut_lineage(candidates.withColumn("_f", F.xxhash64("file")))
    tasks = candidates.rdd.getNumPartitions()
    jumps = candidates.select("_f", "offset", "next")
    here = candidates.select("_f", F.col("offset").alias("next"))
    jumps = cut_lineage(jumps.join(bounded_broadcast(here), ["_f", "next"], "left_semi"))
    reached = cut_lineage(candidates.where("offset = 0").select("_f", "offset"))
    while True:
        pointers = bounded_broadcast(jumps)
        ahead = cut_lineage(reached.join(pointers, ["_f", "offset"]).select("_f", F.col("next").alias("offset")))
        if ahead.isEmpty():
            break
        reached = cut_lineage(reached.unionByName(ahead).coalesce(tasks))
        onward = pointers.select("_f", F.col("offset").alias("next"), F.col("next").alias("_next"))
        jumps = cut_lineage(jumps.join(onward, ["_f", "next"]).select("_f", "offset", F.col("_next").alias("next")))
    return candidates.join(bounded_broadcast(reached), ["_f", "offset"], "left_semi").drop("_f")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all files below ``folder``: file, offset, next, page_id, url, record_type, refers_to, payload_bytes,
    payload_digest (hex SHA-1) and ``intact`` (whether a response's block has that digest)."""
    return verified_records(scan_candidates(spark, folder))
