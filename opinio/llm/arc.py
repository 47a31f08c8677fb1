"""Legacy ARC archives converted to WARC, and WARC archives read back.

An ARC file starts with a version block; version 1 records have a header line
of 5 fields, version 2 of 10, the last being the length that is followed to the
next record. Conversion reads the archives twice. The first pass lists every
record's place, length and payload digest (SHA-1, base32). Of records with
equal payloads the smallest key becomes the response, the others revisits; this
is an aggregation and a join on digests, without payloads. The second pass
brings each archive together with its own decisions and writes WARC records:
identifier (a UUID named by archive and offset), timestamp, type and digests.

Archives are plain files written by Spark's text writer (record bytes, then the
separator that the format asks for; gzip over the file) into a folder that all
executors share, and read whole by its binary reader; ``ARCHIVE_BYTES`` and
``ARCHIVE_RECORDS`` bound a file.

Edge cases: an empty payload is a payload; a null key sorts last, equal keys by
archive and offset; repeated records get a record each; bytes that are no UTF-8
pass unchanged; blanks in an ARC url are percent-encoded; an empty input gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinio.llm.common import small_batches, written

ARCHIVE_BYTES = 32 << 20
ARCHIVE_RECORDS = 10_000
#: Fixed: the field names of the two versions' header lines.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
KEY_HEADER = "X-Record-Key"


# ---- legacy archives ---------------------------------------------------

def arc_record(version: int, url: str, date: str, content: bytes, offset: int, name: str, kind: str = "text/html") -> bytes:
    url = re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) or "-"
    middle = "" if version == 1 else f" 200 {hashlib.md5(content).hexdigest()} - {offset} {name}"
    return f"{url} 0.0.0.0 {date} {kind}{middle} {len(content)}\n".encode() + content


def arc_version_block(version: int, name: str, date: str) -> bytes:
    content = f"{version} 0 Archive\n{ARC_FIELDS[version]}\n".encode()
    return arc_record(version, f"filedesc://{name}", date, content, 0, name, "text/plain")


def http_response(body: bytes, key: int | None) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(body)}\r\n"
    return f"{head}{KEY_HEADER}: {'' if key is None else key}\r\n\r\n".encode() + body


def write_arc(rows: DataFrame, path: str) -> None:
    """``rows`` (key long, url, date string of 14 digits, body binary) as ARC
    archives of both versions, in turn."""
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        part, archive, place, seq = TaskContext.get().partitionId(), -1, ARCHIVE_BYTES, 0
        for batch in batches:
            out = []
            for key, url, date, body in zip(batch["key"], batch["url"], batch["date"], batch["body"]):
                if place >= ARCHIVE_BYTES:
                    archive, place = archive + 1, 0
                    version, name = 1 + (part + archive) % 2, f"{part}-{archive}.arc"
                    block = arc_version_block(version, name, date)
                    out.append((archive, seq, block))
                    place, seq = len(block) + 1, seq + 1
                record = arc_record(version, url or "", date, http_response(body or b"", None if pd.isna(key) else int(key)), place, name)
                out.append((archive, seq, record))
                place, seq = place + len(record) + 1, seq + 1
            yield pd.DataFrame(out, columns=["archive", "seq", "value"])

    packed = small_batches(rows).select("key", "url", "date", "body").mapInPandas(pack, "archive int, seq long, value binary")
    (packed.sortWithinPartitions("archive", "seq").select("archive", F.col("value").cast("string").alias("value"))
     .write.partitionBy("archive").option("lineSep", "\n").option("compression", "gzip").text(path))


def parse_arc(data: bytes) -> Iterator[dict]:
    """The records after the version block: place, url, date, type, content."""
    at, version = 0, None
    while at < len(data):
        if data[at] in b"\r\n":
            at += 1
            continue
        end = data.index(b"\n", at)
        fields = data[at:end].decode("utf-8", "replace").split(" ")
        length = int(fields[-1])
        content = data[end + 1:end + 1 + length]
        if len(content) < length:
            raise ValueError(f"the record at {at} is shorter than it declares")
        if version is None:
            version = int(content.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version}")
        else:
            named = dict(zip(ARC_FIELDS[version].split(" "), fields, strict=True))
            yield {"place": at, "url": named["URL"], "date": named["Archive-date"], "ip": named["IP-address"],
                   "content": content}
        at = end + 1 + length


def split_http(content: bytes) -> tuple[bytes, bytes, dict[str, str]]:
    """(head with its empty line, body, headers by lower-case name)."""
    head, gap, body = content.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return head + gap, body, {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _plain(blob: bytes) -> bytes:
    return zlib.decompress(blob, 16 + zlib.MAX_WBITS) if blob[:2] == b"\x1f\x8b" else blob


def _key(headers: dict[str, str]) -> int | None:
    text = headers.get(KEY_HEADER.lower(), "")
    return int(text) if text else None


# ---- conversion ---------------------------------------------------------

def archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, content): the files below ``path``, whole."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
            .where("length > 0").select("path", "content"))


_LISTED = "path string, place bigint, key bigint, payload_bytes bigint, digest string"


def listed(spark: SparkSession, arc_path: str) -> DataFrame:
    """First pass: every record's place, key, payload length and digest."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, blob in zip(batch.column(0), batch.column(1)):
                rows = []
                for r in parse_arc(_plain(blob.as_py())):
                    _, body, headers = split_http(r["content"])
                    rows.append((path.as_py(), r["place"], _key(headers), len(body), digest(body)))
                columns = zip(*rows) if rows else [()] * 5
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)],
                                                 ["path", "place", "key", "payload_bytes", "digest"])

    return archives(spark, arc_path).mapInArrow(scan, _LISTED)


def record_id(path: str, place: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{path}#{place}')}>"


def warc_record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))]
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block


def warc_date(date: str) -> str:
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def convert(spark: SparkSession, arc_path: str, warc_path: str, min_bytes: int = 0) -> None:
    """WARC archives with the records of the ARC archives; of equal payloads of
    at least ``min_bytes`` the smallest key is the response."""
    rows = written(listed(spark, arc_path), "arc-records")
    first = (rows.where(F.col("payload_bytes") >= min_bytes).groupBy("digest", "payload_bytes")
             .agg(F.min(F.struct(F.col("key").isNull().alias("no_key"), "key", "path", "place")).alias("first")))
    chosen = rows.join(first, ["digest", "payload_bytes"], "left").select(
        "path", "place", "digest", F.col("first.path").alias("first_path"), F.col("first.place").alias("first_place"))

    def write(files: pd.DataFrame, said: pd.DataFrame) -> pd.DataFrame:
        out = []
        for path, blob in zip(files["path"], files["content"]):
            by_place = {p: r for p, *r in zip(said["place"], said["digest"], said["first_path"], said["first_place"])}
            for r in parse_arc(_plain(blob)):
                payload_digest, first_path, first_place = by_place[r["place"]]
                head, body, _ = split_http(r["content"])
                common = [("WARC-Record-ID", record_id(path, r["place"])), ("WARC-Date", warc_date(r["date"])),
                          ("WARC-Target-URI", r["url"]), ("WARC-IP-Address", r["ip"]),
                          ("Content-Type", "application/http; msgtype=response"),
                          ("WARC-Payload-Digest", f"sha1:{payload_digest}")]
                if first_path is None or (first_path, first_place) == (path, r["place"]):
                    block = r["content"]
                    out.append(warc_record("response", [*common, ("WARC-Block-Digest", f"sha1:{digest(block)}")], block))
                else:
                    profile = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
                    refers = [("WARC-Profile", profile), ("WARC-Refers-To", record_id(first_path, int(first_place))),
                              ("WARC-Block-Digest", f"sha1:{digest(head)}")]
                    out.append(warc_record("revisit", [*common, *refers], head))
        return pd.DataFrame({"value": pd.Series(out, dtype="object")})

    records = (archives(spark, arc_path).groupBy("path").cogroup(chosen.groupBy("path"))
               .applyInPandas(write, "value binary"))
    (records.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n")
     .option("compression", "gzip").option("maxRecordsPerFile", ARCHIVE_RECORDS).text(warc_path))


# ---- reading WARC ---------------------------------------------------------

def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record, by declared length."""
    at = 0
    while at < len(data):
        if data[at] in b"\r\n":
            at += 1
            continue
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = int(headers["content-length"])
        yield headers, data[end + 4:end + 4 + length]
        at = end + 4 + length


_READ = ("record_id string, record_type string, key bigint, url string, date string, payload binary, "
         "payload_bytes bigint, payload_digest string, refers_to_id string")


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record. A response's payload is measured and digested anew; a
    revisit has neither, so both come from its headers. ``payloads=False`` leaves
    that column null."""
    names = [c.split(" ")[0] for c in _READ.split(", ")]
    kinds = {"binary": pa.binary(), "bigint": pa.int64(), "string": pa.string()}

    def rows(blob: bytes) -> Iterator[tuple]:
        for h, block in parse_warc(_plain(blob)):
            _, body, http = split_http(block)
            response = h["warc-type"] == "response"
            said = h.get("warc-payload-digest", "").removeprefix("sha1:")
            yield (h["warc-record-id"], h["warc-type"], _key(http), h.get("warc-target-uri"), h["warc-date"],
                   body if response and payloads else None, len(body) if response else int(http["content-length"]),
                   digest(body) if response else said, h.get("warc-refers-to"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(1):
                columns = list(zip(*rows(blob.as_py()))) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k.split(" ")[1]]) for c, k in zip(columns, _READ.split(", "))],
                                                 names)

    return archives(spark, path).mapInArrow(scan, _READ)


def with_references(records: DataFrame) -> DataFrame:
    """``records`` of ``read_warc`` with ``refers_to``: the key of the record that a revisit names."""
    responses = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("key").alias("refers_to"))
    return records.join(responses, "refers_to_id", "left")
