"""WARC archives: one gzip member per record, written and read back by Spark.

Archives are written by Spark's own committer on any file system: a record's gzip
member ends with the high byte of its length, zero for records under 16 MiB, and that
byte is the line separator of the text writer. (A larger record is followed by an empty
member, which readers skip, so it ends in zero as well.) They are read as binary files,
bounded in size by the records per file, and parsed in sequence: members are inflated
step by step, records framed by their Content-Length and held against their digests.
"""

from __future__ import annotations

import hashlib
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm.common import group_values, salted

#: Payloads below this size are always stored in full.
LEAST_REVISIT = 100
#: Payload bytes up to which records share a file, and how many do at most: files are bounded by bytes, some 128 MB, or hold
#: one record.
FILES = ((64 << 10, 2000), (4 << 20, 32), (None, 1))
#: Compressed bytes inflated at once.
STEP = 1 << 16
EMPTY_MEMBER = zlib.compressobj(9, zlib.DEFLATED, 31).flush()
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
RECORDS = (
    "record_id string, record_type string, uri string, refers_to string, payload_bytes long, "
    "payload_digest string, payload binary, valid boolean"
)


class WarcError(ValueError):
    """A record or a file that does not follow the format."""


def _header_value(text: str) -> str:
    return "".join(c if c >= " " else "%%%02X" % ord(c) for c in text)


def record_bytes(record_id: str, uri: str, payload: bytes, digest: str, size: int, refers_to: str | None) -> bytes:
    """One uncompressed record; a revisit keeps the response's HTTP header, without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{record_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _header_value(uri)),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
    ]
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", PROFILE)]
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    """The record as a gzip member that ends in a zero byte."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = packer.compress(record) + packer.flush()
    return out if out[-1] == 0 else out + EMPTY_MEMBER


def read_members(data):
    """Yield the inflated bytes of each non-empty gzip member, inflating STEP bytes at a time."""
    view, at = memoryview(data), 0
    while at < len(view):
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if at >= len(view):
                raise WarcError("archive ends within a gzip member")
            chunk = view[at : at + STEP]
            parts.append(inflate.decompress(chunk))
            at += len(chunk)
        at -= len(inflate.unused_data)
        if record := b"".join(parts):
            yield record


def parse_record(data: bytes) -> dict:
    """Fields of one record; `valid` says whether both digests hold. Wrong framing raises WarcError."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not gap or not lines[0].startswith("WARC/"):
        raise WarcError("no WARC header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"header line without colon: {line[:80]}")
        fields[name.strip().lower()] = value.strip()
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise WarcError("Content-Length does not frame the record")
    block = rest[:size]
    http, _, payload = block.partition(b"\r\n\r\n")
    full = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    valid = fields["warc-block-digest"] == "sha256:" + hashlib.sha256(block).hexdigest()
    revisit = fields["warc-type"] == "revisit"
    if not revisit:
        valid &= hashlib.sha256(payload).hexdigest() == digest and len(payload) == full
    return {
        "record_id": fields["warc-record-id"].strip("<>"),
        "record_type": fields["warc-type"],
        "uri": fields.get("warc-target-uri"),
        "refers_to": fields["warc-refers-to"].strip("<>") if revisit else None,
        "payload_bytes": full,
        "payload_digest": digest,
        "payload": None if revisit else payload,
        "valid": bool(valid),
    }


def write_archives(rows: DataFrame, path: str, files: tuple[tuple[int | None, int], ...] = FILES) -> None:
    """Write rows (record_id, uri, payload binary, digest, size, refers_to) as archives under path.

    refers_to names the record that a revisit repeats; null makes a response. Records are
    kept apart by their size, and a file holds so many of a class as its bytes allow (`files`).
    """
    largest = rows.agg(F.max("size")).first()[0] if len(files) > 1 else 0
    least = None
    for n, (most, per_file) in enumerate(files):
        if n and (largest or 0) <= least:
            break
        part = rows if least is None else rows.where(F.col("size") > least)
        _write(part if most is None else part.where(F.coalesce("size", F.lit(0)) <= most), f"{path}/{n}", per_file)
        least = most


def _write(rows: DataFrame, path: str, per_file: int) -> None:
    def run(batches):
        for pdf in batches:
            packed = [
                member(record_bytes(r.record_id, r.uri or "", bytes(r.payload or b""), r.digest, int(r.size_), r.refers_to if isinstance(r.refers_to, str) else None))
                for r in pdf.itertuples(index=False)
            ]
            yield pd.DataFrame({"value": [p[:-1] for p in packed]})

    rows = rows.select("record_id", "uri", "payload", "digest", F.col("size").alias("size_"), "refers_to")
    out = rows.mapInPandas(run, "value binary").select(F.col("value").cast("string").alias("value"))
    out.write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", per_file).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives under path; columns of RECORDS. A file is read in sequence, by one task.

    Framing that does not hold raises WarcError; a record whose digests do not hold comes with valid = false.
    """

    def run(batches):
        for pdf in batches:
            for content in pdf["content"]:
                found = []
                for data in read_members(content):
                    found.append(parse_record(data))
                    if len(found) >= 500:
                        yield pd.DataFrame(found)
                        found = []
                if found:
                    yield pd.DataFrame(found)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content")
    return files.mapInPandas(run, RECORDS)


def plan_records(pages: DataFrame, id_col: str, uri_col: str, payload_col: str, least: int = LEAST_REVISIT) -> DataFrame:
    """Rows for write_archives: of equal payloads of `least` bytes or more the smallest id is stored."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(uri_col).cast("string").alias("uri"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))
    rows = salted(rows, "id")
    firsts = group_values(rows, ["digest"], {"first": F.min("id")}, {"first": F.min("first")})
    rows = rows.join(firsts, ["digest", "_salt"])
    again = (F.col("size") >= least) & (F.col("id") > F.col("first"))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")))
    return rows.select(
        name("id").alias("record_id"), "uri", F.when(~again | again.isNull(), F.col("payload")).alias("payload"), "digest", "size",
        F.when(again, name("first")).alias("refers_to"),
    )


def page_id(col: str):
    """The id in a record's name, null if the page had none."""
    return F.regexp_extract(col, r"^urn:page:(-?\d+)$", 1).try_cast("long")


def archive_pages(pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write each page as a record under path, read all back, and return the records. Payloads of any length are kept whole.

    Defined cases: a null payload is empty; a null address is an empty one, and control
    characters in an address are percent-coded; rows that repeat the smallest id of
    their payload are all responses; a row without id is a response; an empty table
    gives no records; a damaged archive raises WarcError; further columns are not read.
    """
    write_archives(plan_records(pages, id_col, uri_col, payload_col), path)
    return read_archives(pages.sparkSession, path)
