"""WARC: archives written by Spark, read back by a salvage reader.

Writing is one Spark projection: header lines and payload become one value a
record, and the text sink's line separator is the record's closing CR LF CR LF,
so its part files are archives as they stand. Of equal payloads of at least 100
bytes the one with the smallest page id is a response; the others are revisits
without payload that refer to it.

The salvage reader takes whole archives (plain or with gzip members) and trusts
nothing: version line, header syntax, content length, closing line and block
digest are checked. After a failed check it searches for the next member or
version line that checks out, goes on from there, and logs the bytes between as
a quarantined gap. One archive (and what one of its gzip members holds) is in a task's memory at a time.

Defined cases: null html is an empty payload; rows without page_id are written
with an empty id and read back with none; repeated rows are records each, those with
the smallest page id all responses; an empty table gives no record; other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfacts.llm.common import new_folder, stored

FEW_IDS = 1_000_000

#: Fixed values of the format.
VERSION = "WARC/1.1"
VERSION_LINE = re.compile(rb"WARC/\d+\.\d+\r\n")
HEAD_END = b"\r\n\r\n"
MEMBER = b"\x1f\x8b\x08"

MIN_BYTES = 100
SCHEMA = "archive string, begin long, end long, status string, reason string, headers map<string,string>, payload binary"


def record_types(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, url, html, digest, refers_to. Only digests and ids meet in the grouping, with partial minima."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    large = base.where(F.octet_length("html") >= MIN_BYTES).where("page_id IS NOT NULL")
    copies = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    # only the later copies need to be told: their ids, found by a join that carries no html
    later = large.select("page_id", "digest").join(copies, "digest").where("page_id > first").select(F.col("page_id").alias("p"), F.col("digest").alias("d"), F.col("first").alias("refers_to")).distinct()
    later = stored(later, "revisits")
    later = F.broadcast(later) if later.count() <= FEW_IDS else later  # so that the html stays where it is
    return base.join(later, (F.col("page_id") == F.col("p")) & (F.col("digest") == F.col("d")), "left").select("page_id", "url", "html", "digest", "refers_to")


def line(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), r"[\r\n]+", " "), F.lit("\r\n")), F.lit(""))


def record(typed: DataFrame) -> DataFrame:
    """One column ``value``: the records without their closing line."""
    uri = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    is_copy = F.col("refers_to").isNotNull()
    block = F.when(is_copy, F.lit("")).otherwise(F.col("html"))
    head = F.concat(
        F.lit(f"{VERSION}\r\n"), line("WARC-Type", F.when(is_copy, "revisit").otherwise("response")),
        line("WARC-Record-ID", uri(F.coalesce(F.col("page_id").cast("string"), F.lit("")))), line("WARC-Target-URI", F.col("url")),
        line("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("WARC-Refers-To", uri(F.col("refers_to"))), line("WARC-Profile", F.when(is_copy, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.octet_length(block)), F.lit("\r\n"),
    )
    return typed.select(F.concat(head, block).alias("value"))


def write(pages: DataFrame, path: str, id_col: str = "page_id", html_col: str = "html", archive_records: int = 2000, archive_bytes: int = 128 << 20) -> None:
    """Archives under ``path`` of at most so many records, and about so many bytes where no single record is larger.

    Pages over an equal share of ``archive_bytes`` go to archives of their own, of fewer records.
    """
    typed, share = record_types(pages, id_col, html_col), archive_bytes // archive_records
    size = F.octet_length("html")
    greatest = pages.select(F.max(F.octet_length(F.col(html_col)))).first()[0] or 0
    classes = [(size <= share, archive_records)] + ([(size > share, max(1, archive_bytes // greatest))] if greatest > share else [])
    for rows, most in classes:
        record(typed.where(rows)).write.mode("append").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", most).text(path)


def parse(data: bytes, at: int) -> tuple[int, dict[str, str], bytes] | str:
    """The record at this place of plain bytes, or what is wrong with it."""
    if not (m := VERSION_LINE.match(data, at)):
        return "no version line"
    stop = data.find(HEAD_END, m.end() - 2)
    if stop < 0:
        return "unended header"
    headers = {}
    for raw in data[m.end() : stop].split(b"\r\n"):
        name, colon, value = raw.partition(b":")
        if not colon or not re.fullmatch(rb"[!-~]+", name):
            return "bad header line"
        headers[name.decode().lower()] = value.strip().decode("utf-8", "replace")
    if not re.fullmatch(r"\d{1,18}", headers.get("content-length", "")):
        return "bad content length"
    begin = stop + len(HEAD_END)
    end = begin + int(headers["content-length"])
    if end + len(HEAD_END) > len(data):
        return "cut short"
    if data[end : end + len(HEAD_END)] != HEAD_END:
        return "no closing line where the length says"
    block = data[begin:end]
    if digest := headers.get("warc-block-digest"):
        kind, _, given = digest.partition(":")
        kind = kind.lower().replace("-", "")
        if kind in ("sha1", "sha256", "sha512", "md5"):
            raw = hashlib.new(kind, block).digest()
            if given.lower() != raw.hex() and given.rstrip("=").upper() != base64.b32encode(raw).decode().rstrip("="):
                return "wrong digest"
    return end + len(HEAD_END), headers, block


def unzipped(data: bytes, at: int, step: int = 1 << 16) -> tuple[int, bytes, str | None]:
    """Where the gzip member at this place ends, what it holds as far as it can be read, and what is wrong with it. Later members are not copied."""
    unzip, parts, view = zlib.decompressobj(31), [], memoryview(data)
    while not unzip.eof and at < len(data):
        before = unzip.copy() if step > 1 else None
        try:
            parts.append(unzip.decompress(view[at : at + step]))
        except zlib.error:
            if step > 1:  # what comes before the damage, byte by byte
                unzip, step = before, 1
                continue
            return at, b"".join(parts), "bad gzip member"
        at += step
    if not unzip.eof:
        return len(data), b"".join(parts), "cut short"
    return min(at, len(data)) - len(unzip.unused_data), b"".join(parts), None


def salvage(data: bytes, zips: bool = True) -> Iterator[tuple[int, int, str | None, dict[str, str] | None, bytes | None]]:
    """(begin, end, None, headers, payload) of each good record, (begin, end, reason, None, None) of each gap.

    A gzip member may hold many records; each has the member's place. What can be
    read of a damaged one is searched too: its records count where they carry a
    block digest and end before the damage, and the gap begins where the member does.
    """
    at, gap, why = 0, None, None
    line_at = member_at = -1
    while at < len(data):
        fault = None
        if zips and data.startswith(MEMBER, at):
            end, plain, fault = unzipped(data, at)
            inner = list(salvage(plain, zips=False))
            records = [(at, end, None, r[3], r[4]) for r in inner if r[2] is None and (fault is None or (r[1] < len(plain) and "warc-block-digest" in r[3]))]
            if fault is None:
                fault = next((r[2] for r in inner if r[2] is not None), None if records else "no record in the member")
                over = bool(records)
            else:
                over = False  # where it ends is not known
        else:
            found = parse(data, at)
            if isinstance(found, str):
                fault, records, over = found, [], False
            else:
                end, records, over = found[0], [(at, found[0], None, found[1], found[2])], True
        if gap is not None and records:
            yield gap, at, why, None, None
            gap = None
        yield from records
        if fault is None:
            at = end
            continue
        if gap is None:
            gap, why = at, fault
        if over:
            yield gap, end, why, None, None
            at, gap = end, None
            continue
        if line_at <= at:
            line = VERSION_LINE.search(data, at + 1)
            line_at = line.start() if line else len(data)
        if zips and member_at <= at:
            member_at = data.find(MEMBER, at + 1)
            member_at = len(data) if member_at < 0 else member_at
        at = min(line_at, member_at) if zips else line_at
    if gap is not None:
        yield gap, len(data), why, None, None


def read(spark, path: str) -> DataFrame:
    """Records (status ``record``) and quarantined gaps (status ``gap``, with a reason) of all archives under ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
        names = ["archive", "begin", "end", "status", "reason", "headers", "payload"]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, held = [], 0
                for begin, end, why, headers, payload in salvage(content.as_py()):
                    rows.append((name, begin, end, "gap" if why else "record", why, list(headers.items()) if headers is not None else None, payload))
                    held += end - begin
                    if held > 4 << 20:
                        yield made(rows)
                        rows, held = [], 0
                if rows:
                    yield made(rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, SCHEMA)


def page_records(spark, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and url of the page records; a revisit's payload is its response's."""
    number = lambda h: F.regexp_extract(F.col("headers")[h], r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    good = stored(read(spark, path).where("status = 'record'").select(
        number("warc-record-id").alias("page_id"), F.col("headers")["warc-target-uri"].alias("url"), F.col("headers")["warc-type"].alias("record_type"),
        F.octet_length("payload").cast("long").alias("own_bytes"), F.sha2("payload", 256).alias("own_digest"),
        F.regexp_replace(F.col("headers")["warc-payload-digest"], "^sha256:", "").alias("digest"), number("warc-refers-to").alias("refers_to"),
    ), "warc-records")  # the archives are read once
    plain = good.where("record_type = 'response'").select("page_id", F.col("own_bytes").alias("payload_bytes"), F.col("own_digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"), "url")
    revisit = good.where("record_type = 'revisit'")
    # what revisits refer to: one row a response, however often it is revisited
    targets = plain.select(F.col("page_id").alias("t"), F.col("payload_digest").alias("td"), F.col("payload_bytes").alias("tb")).distinct()
    resolved = revisit.join(targets, (F.col("refers_to") == F.col("t")) & (F.col("digest") == F.col("td")), "left")
    return plain.unionByName(resolved.select("page_id", F.col("tb").alias("payload_bytes"), F.col("td").alias("payload_digest"), "record_type", "refers_to", "url"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages as archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = new_folder(spark, "warc")
    write(pages, path)
    return page_records(spark, path)
