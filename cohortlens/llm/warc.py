"""WARC archives of pages, normalised to one gzip member a record.

Archives are first written the way many crawls come: one gzip stream over the
whole file, in which no record can be found without inflating all before it. The
normaliser inflates that stream once, piece by piece, writes every record as a
member of its own, and writes beside it an index of offsets. With the index any
record is read by one ranged read.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.files import open_input, write_once
from cohortlens.llm.words import utf8
from cohortlens.session import shared_folder, staged

#: Uncompressed bytes after which an archive is closed; a record is never split.
ARCHIVE_BYTES = 32 << 20
STEP_BYTES = 1 << 20
GZIP = 31
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """One record; a revisit (``refers_to``) has the digest and length of its payload, not the payload."""
    revisit = refers_to is not None
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {0 if revisit else len(payload)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + (b"" if revisit else payload) + b"\r\n\r\n"


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record")
    return dict(line.split(": ", 1) for line in lines[1:])


def records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an uncompressed stream that comes in chunks."""
    held = bytearray()
    size = None
    for chunk in chunks:
        held += chunk
        while True:
            if size is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                size = end + 8 + int(_headers(bytes(held[:end]))["Content-Length"])
            if len(held) < size:
                break
            yield bytes(held[:size])
            del held[:size]
            size = None
    if held:
        raise ValueError("the archive ends inside a record")


def _write(folder: str, date: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        press, parts, size, count = zlib.compressobj(6, zlib.DEFLATED, GZIP), [], 0, 0
        for batch in batches:
            for page_id, url, html, sha1, refers_to in zip(*(batch[c] for c in ("page_id", "url", "html", "sha1", "refers_to"))):
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                data = record(page_id, url, utf8(html), digest, refers_to, date)
                parts.append(press.compress(data))
                size, count = size + len(data), count + 1
                if size >= ARCHIVE_BYTES:
                    yield _closed(folder, [*parts, press.flush()], count)
                    press, parts, size, count = zlib.compressobj(6, zlib.DEFLATED, GZIP), [], 0, 0
        if count:
            yield _closed(folder, [*parts, press.flush()], count)

    return run


def _closed(folder: str, parts: list[bytes], count: int) -> pd.DataFrame:
    address = write_once(folder, "pages.warc.gz", lambda stream: [stream.write(p) for p in parts])
    return pd.DataFrame({"address": [address], "n_records": [count]})


def _inflated(source) -> Iterator[bytes]:
    plain = zlib.decompressobj(GZIP)
    while data := source.read(STEP_BYTES):
        while data:
            yield plain.decompress(data, STEP_BYTES)
            data = plain.unconsumed_tail
    yield plain.flush()
    if not plain.eof:
        raise ValueError("the gzip stream ends early")


def _normalise(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for address in batch["address"]:
                index: list[tuple[int, int]] = []

                def content(stream) -> None:
                    at = 0
                    with open_input(address) as source:
                        for whole in records(_inflated(source)):
                            press = zlib.compressobj(6, zlib.DEFLATED, GZIP)
                            member = press.compress(whole) + press.flush()
                            stream.write(member)
                            index.append((at, len(member)))
                            at += len(member)

                name = write_once(folder, "members.warc.gz", content)
                lines = "".join(f"{at} {size}\n" for at, size in index).encode()
                beside = write_once(folder, "members.idx", lambda stream: stream.write(lines))
                yield pd.DataFrame({"address": [name], "index_address": [beside], "n_records": [len(index)]})

    return run


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for address, beside in zip(batch["address"], batch["index_address"]):
            with open_input(beside) as index, open_input(address) as source:
                rows = []
                for line in index.read().decode().splitlines():
                    at, size = map(int, line.split())
                    head, _, body = zlib.decompress(source.read_at(size, at), GZIP).partition(b"\r\n\r\n")
                    names = _headers(head)
                    refers_to = names.get("WARC-Refers-To", "")[10:-1] or None
                    rows.append(
                        (names["WARC-Record-ID"][10:-1] or None, int(names["X-Payload-Length"]),
                         names["WARC-Payload-Digest"].removeprefix("sha1:"), names["WARC-Type"], refers_to,
                         names.get("WARC-Target-URI"), body[: int(names["Content-Length"])])
                    )
                    if len(rows) >= 200:
                        yield pd.DataFrame(rows, columns=READ)
                        rows = []
                yield pd.DataFrame(rows, columns=READ)


READ = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]


def write_archives(pages: DataFrame, folder: str, least: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Monolithic archives below ``folder``; address and n_records of each, staged.

    Of pages with equal payloads of at least ``least`` bytes the one with the
    smallest page_id is the response, the others revisit it.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html).alias("sha1"))
    owners = staged(rows.groupBy("sha1").agg(F.min("page_id").alias("owner"), F.count("*").alias("n")), "payload-owners")
    repeats = owners.filter("n > 1").select("sha1", "owner")
    revisit = (F.octet_length("html") >= least) & ~F.col("page_id").eqNullSafe(F.col("owner")) & F.col("owner").isNotNull()
    told = rows.join(repeats, "sha1", "left").select(
        F.col("page_id").cast("string").alias("page_id"), "url", "html", "sha1", F.when(revisit, F.col("owner")).cast("string").alias("refers_to")
    )
    return staged(told.mapInPandas(_write(folder, date), "address string, n_records long"), "archives")


def normalise_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Archives with a member a record and their indexes: address, index_address, n_records, staged."""
    spread = archives.select("address").repartition(max(1, archives.count()), "address")
    return staged(spread.mapInPandas(_normalise(folder), "address string, index_address string, n_records long"), "members")


def read_archives(members: DataFrame) -> DataFrame:
    """One row per record, read by its index entry: the columns ``READ``."""
    spread = members.select("address", "index_address").repartition(max(1, members.count()), "address")
    layout = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string, payload binary"
    rows = spread.mapInPandas(_read, layout)
    return rows.withColumn("page_id", F.col("page_id").cast("long")).withColumn("refers_to", F.col("refers_to").cast("long"))


def archived(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, read from normalised archives.

    A null html is an empty payload. Rows that repeat the smallest page_id of a
    payload are responses all. A null page_id never owns a payload that a page
    with an id has; without such a page all are responses. A null url leaves the
    target out. No pages give no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    members = normalise_archives(write_archives(pages, shared_folder(spark, "warc"), least), shared_folder(spark, "warc-members"))
    return read_archives(members).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
