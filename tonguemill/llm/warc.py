"""WARC archives: one gzip member per record, written by the tasks and read back sequentially.

The reader inflates step by step, frames records by Content-Length, and verifies the digests of block and payload. Payloads that
occur again are revisit records that refer to the first.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonguemill.core.config import open_folder
from tonguemill.llm.common import Scratch, table

#: An archive is closed once it is larger.
ARCHIVE_BYTES = 256 << 20
CHUNK = 1 << 16
DATE = "1970-01-01T00:00:00Z"


class WarcError(ValueError):
    """An archive that isn't framed right or doesn't match its digests."""


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(page_id: str | None) -> str:
    return "<urn:page:>" if page_id is None else f"<urn:page:{quote(page_id, safe='')}.>"


def _id_of(urn: str | None) -> str | None:
    got = re.fullmatch(r"<urn:page:(.*)\.>", urn or "")
    return unquote(got[1]) if got else None


def record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None, revisit: bool) -> bytes:
    """A record as one gzip member. A revisit holds the HTTP header alone, whose Content-Length is that of the full payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    if revisit:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n") + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


class _Members:
    """Bytes of the gzip members of a stream, inflated as they are asked for."""

    def __init__(self, stream):
        self.stream, self.raw, self.plain, self.z = stream, b"", bytearray(), None

    def more(self) -> bool:
        """Inflates a little more of this member; false at its end."""
        while self.z is not None:
            if self.z.eof:
                return False
            if not self.raw:
                self.raw = self.stream.read(CHUNK)
                if not self.raw:
                    raise WarcError("the archive ends inside a record")
            try:
                got = self.z.decompress(self.raw, CHUNK)
            except zlib.error as e:
                raise WarcError(f"a damaged member: {e}") from e
            self.raw = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            self.plain += got
            if got:
                return True
        return False

    def begin(self) -> bool:
        """Goes to the next member; false at the end of the archive."""
        if self.plain:
            raise WarcError("bytes after a record")
        self.raw = self.raw or self.stream.read(CHUNK)
        self.z = zlib.decompressobj(31) if self.raw else None
        return bool(self.raw)

    def until(self, mark: bytes) -> bytes:
        seen = 0
        while (at := self.plain.find(mark, seen)) < 0:
            seen = max(0, len(self.plain) - len(mark) + 1)
            if not self.more():
                raise WarcError("a header without an end")
        out = bytes(self.plain[:at])
        del self.plain[: at + len(mark)]
        return out

    def exactly(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.plain and not self.more():
                raise WarcError("a record shorter than its Content-Length")
            part = bytes(self.plain[:n])
            del self.plain[:n]
            n -= len(part)
            yield part


def _fields(lines: list[str]) -> dict[str, str]:
    """Header fields by lower-case name. Lines that begin with a blank go on with the one before; of a repeated field the first counts."""
    out: dict[str, str] = {}
    own, name = "", ""
    for line in [*lines, "end:"]:
        if line[:1] in (" ", "\t") and name:
            own += " " + line.strip()
            continue
        if name:
            out.setdefault(name, own)
        name, colon, own = line.partition(":")
        name, own = name.strip().lower(), own.strip()
        if not colon or not name:
            raise WarcError(f"no header field: {line[:40]!r}")
    return out


def _agrees(told: str | None, *data: bytes) -> bool:
    """Whether a digest field fits one of these; a missing one, or one of an unknown kind, tells nothing. Values are in base32 or hex."""
    kind, _, value = (told or "").partition(":")
    kind = kind.strip().lower().replace("-", "")
    if kind not in ("md5", "sha1", "sha256", "sha512"):
        return True
    sums = [hashlib.new(kind, d).digest() for d in data]
    return any(value.strip().upper().rstrip("=") in (base64.b32encode(x).decode().rstrip("="), x.hex().upper()) for x in sums)


def _unchunked(body: bytes) -> bytes | None:
    """The content of a body in chunks; None if it isn't in chunks."""
    out, at = [], 0
    while m := re.compile(rb"([0-9A-Fa-f]{1,8})[^\r\n]*\r\n").match(body, at):
        n = int(m[1], 16)
        if not n:
            return b"".join(out)
        out.append(body[m.end() : m.end() + n])
        at = m.end() + n + 2
    return None


def read_archive(stream) -> Iterator[dict]:
    """Records of an archive in order, of any type: headers by lower-case name, `payload` and `http-length`.

    A response's payload is what follows its HTTP head, a resource's or conversion's its block; others, and revisits, have none. http-length
    is what the HTTP head tells, else the payload's length, else None. Digests of block and payload are verified where there are any; a
    payload sent in chunks may be digested either way. A record that was cut short (WARC-Truncated) isn't held against its length. Whatever
    is wrong is a WarcError.
    """
    m = _Members(stream)
    while m.begin():
        version, *lines = m.until(b"\r\n\r\n").decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise WarcError(f"no record here: {version[:40]!r}")
        head = _fields(lines)
        name, kind, size = head.get("warc-record-id", "a record without id"), head.get("warc-type", "").lower(), head.get("content-length", "")
        if not re.fullmatch("[0-9]+", size):
            raise WarcError(f"no Content-Length of {name}")
        block = b"".join(m.exactly(int(size)))
        tail = b"".join(m.exactly(4))
        while m.more():
            pass
        if tail != b"\r\n\r\n" or not _agrees(head.get("warc-block-digest"), block):
            raise WarcError(f"block digest of {name}")
        payload, length = (block if kind in ("resource", "conversion") else None), None
        if kind in ("response", "revisit") and block[:5] == b"HTTP/":
            top, _, body = block.partition(b"\r\n\r\n")
            http = _fields(top.decode("latin-1").split("\r\n")[1:])
            told = http.get("content-length", "")
            length = int(told) if re.fullmatch("[0-9]+", told) else None
            if kind == "response":
                payload = body
                in_chunks = "chunked" in http.get("transfer-encoding", "").lower()
                if length is not None and length != len(body) and not in_chunks and "warc-truncated" not in head:
                    raise WarcError(f"payload digest of {name}: {len(body)} bytes, not {length}")
        elif kind == "response":  # not of HTTP: the block is what was received
            payload = block
        if payload is not None and not _agrees(head.get("warc-payload-digest"), payload, *([x] if (x := _unchunked(payload)) is not None else [])):
            raise WarcError(f"payload digest of {name}")
        yield head | {"warc-type": kind, "http-length": len(payload) if length is None and payload is not None else length, "payload": payload}


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Writes pages to archives in `folder` (shared by the executors) and returns (path, records, bytes) of the archives, not yet run.

    Of pages with equal payloads of at least `least_bytes`, that with the smallest id is the response; pages that share that id and
    payload are responses too, and a null id is the smallest only where all are null. Null html is an empty payload. Equal payloads
    are found by SHA-1 with partial aggregation; a hot payload's group is never gathered. Ids may be numbers or texts, and an empty
    table gives no archive. Extra columns are not read, whatever their names. Each attempt of a task writes files of its own name, and
    only those of the attempt that ended well are listed; others stay in the folder unread.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    first = rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    linked = rows.join(first, "digest", "left").drop("digest")
    large = F.octet_length("html") >= least_bytes
    linked = linked.withColumn("revisit", large & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))).drop("digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_folder(folder)
        fs.create_dir(path, recursive=True)
        out, name, n, size = None, "", 0, 0
        done: list[tuple] = []
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, html, first_id, revisit = (batch.column(k)[i].as_py() for k in range(5))
                if out is None:
                    name = f"{path}/{uuid.uuid4().hex}.warc.gz"
                    out, n, size = fs.open_output_stream(name, compression=None), 0, 0
                member = record(page_id, url, html.encode("utf-8", "surrogatepass"), first_id, bool(revisit))
                out.write(member)
                n, size = n + 1, size + len(member)
                if size > ARCHIVE_BYTES:
                    out.close()
                    done.append((name.rsplit("/", 1)[1], n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name.rsplit("/", 1)[1], n, size))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], names=["name", "records", "bytes"])

    as_text = lambda c: F.col(c).cast("string").alias(c)
    return linked.select(as_text("page_id"), "url", "html", as_text("first"), "revisit").mapInArrow(run, "name string, records long, bytes long")


#: Types of records that stand for a page.
PAGES = ("response", "resource", "conversion", "revisit")
RECORDS = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary"


def read_archives(archives: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Records of the archives named by (name), each read from begin to end by one task; ids are texts, null for those of other makers.

    Responses, resources, conversions and revisits are given; warcinfo, requests and metadata hold no page and are passed over. Revisits
    carry no payload of their own. payload_digest is the record's, or computed where it has none or one that isn't SHA-1. A damaged
    archive, or a record that doesn't match its digests, is a WarcError."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_folder(folder)
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]

        def give(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows: list[tuple] = []
                with fs.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for r in read_archive(stream):
                        if r["warc-type"] not in PAGES:
                            continue
                        digest = re.fullmatch("(?i)sha1:([A-Z2-7]{32})", r.get("warc-payload-digest", ""))
                        digest = digest[1].upper() if digest else None if r["payload"] is None else sha1_base32(r["payload"])
                        rows.append((_id_of(r.get("warc-record-id")), r.get("warc-target-uri"), r["http-length"], digest, r["warc-type"], _id_of(r.get("warc-refers-to")), r["payload"] if payloads else None))
                        if len(rows) == 500:
                            yield give(rows)
                            rows = []
                if rows:
                    yield give(rows)

    return archives.select("name").mapInArrow(run, RECORDS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    folder = f"{scratch.root}/archives"
    archives = scratch.save(write_archives(table(spark, sf_dir, "pages"), folder), "manifest")
    spread = archives.repartition(max(1, archives.count()), "name")
    got = read_archives(spread, folder, payloads=False)
    return got.select(F.col("page_id").cast("long"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long"))


SQL = """
WITH h AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS x FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS first FROM h)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(5), lambda k: ((instr('0123456789abcdef', substr(x, 1 + (5 * i + k) // 4, 1)) - 1) // CAST(pow(2, 3 - (5 * i + k) % 4) AS BIGINT)) % 2 * CAST(pow(2, 4 - k) AS BIGINT))) AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""
