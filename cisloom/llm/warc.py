"""Web archives: legacy ARC files converted to WARC records, written, and read back."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import shared_path
from .common import stored
from .jaccard_join import picked

# Field lists of the two versions of the ARC format, and the separators of WARC.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
END = "\r\n\r\n"
BETWEEN = END + "WARC/1."

#: An archive that is made here is closed at this many bytes.
ARC_BYTES = 4 << 20
_DATE = re.compile(rb"\d{8,14}$")
RECORD = "id string, type string, date string, uri string, ip string, mime string, payload_bytes bigint, payload_digest string, block_digest string, fault string, head string, block binary"
READ = "file string, type string, id string, date string, uri string, ip string, mime string, refers_to string, payload_bytes bigint, payload_digest string, fault string, head string, payload binary"


def digest(data: bytes) -> str:
    """Upper-case base32 of SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def inflate(data: bytes) -> bytes:
    """The bytes of a file of gzip members, one after the other; other files as they are.  What follows a broken member is left out."""
    if not data.startswith(b"\x1f\x8b"):
        return data
    out = []
    while data.startswith(b"\x1f\x8b"):
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(data) + member.flush())
        except zlib.error:
            break
        data = member.unused_data
    return b"".join(out)


@dataclass
class ArcRecord:
    """One record: its header by field name, where it starts, its bytes, and what is wrong with it (else empty)."""

    head: dict[str, str]
    offset: int
    block: bytes
    version: int = 1
    fault: str = ""


@dataclass
class ArcReader:
    """Records of one archive.

    The version block names the version and the fields of header lines (files without one are read as version 1).  A header line is cut from its right end, so that
    an address with spaces stays whole.  A declared length that does not end at a line end is a fault: the record then ends before the
    next line that is a header, and reading goes on there.
    """

    data: bytes
    version: int = 1
    fields: list[str] = field(default_factory=lambda: ARC_FIELDS[1].split())

    def header(self, line: bytes) -> dict[str, str] | None:
        n = len(self.fields) - 1
        parts = line.rstrip(b"\r").rsplit(b" ", n)
        if len(parts) != n + 1 or not parts[0] or not parts[-1].isdigit() or len(parts[-1]) > 18:
            return None
        head = dict(zip(self.fields, (p.decode("utf-8", "replace") for p in parts), strict=True))
        return head if _DATE.match(parts[self.fields.index("Archive-date")]) else None

    def _line(self, at: int) -> tuple[bytes, int]:
        end = self.data.find(b"\n", at)
        end = len(self.data) if end < 0 else end
        return self.data[at:end], end + 1

    def declare(self, block: bytes) -> None:
        """Take version and fields from the version block's two lines."""
        lines = block.split(b"\n")
        number = lines[0].split(b" ")[0]
        self.version = int(number) if number in (b"1", b"2") else 1
        named = lines[1].decode("utf-8", "replace").split() if len(lines) > 1 else []
        known = "URL" in named[:1] and "Archive-length" in named[-1:] and "Archive-date" in named
        self.fields = named if known else ARC_FIELDS[self.version].split()

    def __iter__(self) -> Iterator[ArcRecord]:
        data, at = self.data, 0
        while at < len(data):
            line, start = self._line(at)
            first = line.startswith(b"filedesc:")
            head = ArcReader(b"").header(line) if first else None
            if first and head is None:  # the version block's own line may have the fields of its version
                head = ArcReader(b"", 2, ARC_FIELDS[2].split()).header(line)
            head = head or self.header(line)
            if head is None:
                at = start
                continue
            end = start + int(head["Archive-length"])
            fault = ""
            if end > len(data):
                fault = "cut short"
            elif end < len(data) and data[end : end + 1] not in (b"\n", b"\r"):
                fault = "length"
            if fault:
                end = self._next(start)
                fault = fault if end == len(data) or fault == "length" else "length"
            block = data[start:end]
            if first:
                self.declare(block)
            yield ArcRecord(head, at, block, self.version, fault)
            at = end

    def _next(self, at: int) -> int:
        """Where the line before the next header line ends."""
        while at < len(self.data):
            line, after = self._line(at)
            if b":" in line[:12] and self.header(line):
                return max(0, at - 1)
            at = after
        return len(self.data)


def warc_date(text: str) -> str:
    """``YYYYMMDDhhmmss``, of which the end may be missing, as the date of a WARC record."""
    t = text + "00000101000000"[len(text) :]
    return f"{t[:4]}-{t[4:6]}-{t[6:8]}T{t[8:10]}:{t[10:12]}:{t[12:14]}Z"


def payload_of(block: bytes) -> tuple[bytes, bytes]:
    """(head, payload) of an HTTP message: cut after its first empty line; without one it is all head."""
    ends = [(at + len(x), at) for x in (b"\r\n\r\n", b"\n\n") if (at := block.find(x)) >= 0]
    at = min(ends, key=lambda e: e[1])[0] if ends else len(block)
    return block[:at], block[at:]


def as_warc(archive: str, r: ArcRecord) -> dict[str, object]:
    """The WARC record that says what an ARC record says.

    Its id hangs on archive and offset, so that converting again gives the same; type by address and block; digests are taken anew.
    """
    url, mime = r.head["URL"].replace("\r", ""), r.head.get("Content-type", "")
    head, payload = b"", r.block
    if url.startswith("filedesc:"):
        kind, mime = "warcinfo", "text/plain"
    elif r.block.startswith(b"HTTP/"):
        kind, mime = "response", "application/http; msgtype=response"
        head, payload = payload_of(r.block)
    else:
        kind, mime = "resource", mime if "/" in mime else "application/octet-stream"
    return {
        "id": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{r.offset}')}>", "type": kind, "date": warc_date(r.head["Archive-date"]), "uri": url, "ip": r.head.get("IP-address", ""), "mime": mime,
        "payload_bytes": len(payload), "payload_digest": digest(payload), "block_digest": digest(r.block), "fault": r.fault, "head": head.decode("latin-1"), "block": r.block,
    }


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


_KINDS = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary(), "int": pa.int32(), "boolean": pa.bool_()}


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(n, _KINDS[k]) for n, k in (x.split() for x in ddl.split(", "))])


def _bounded(rows: Iterator[dict], schema: pa.Schema, size: str, limit: int = ARC_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many bytes of the column ``size``, one row at least."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row[size] or b"")
        if n >= limit or len(held) >= 5000:
            yield _batch(held, schema)
            held, n = [], 0
    if held:
        yield _batch(held, schema)


def convert(files: DataFrame) -> DataFrame:
    """WARC records (:data:`RECORD`) of ARC files (``path``, ``content``, as Spark's binary reader gives them), compressed by members or not.

    One file is one row, so it has 2 GB at most; ARC files are some 100 MB by custom.  Null contents and files without a header line give no records; what
    stands between records is passed over; ``fault`` says where a declared length was wrong or the file cut short; an empty table gives no records; other columns are not read.
    """
    schema = _arrow(RECORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                for path, content in zip(batch.column(0), batch.column(1), strict=True):
                    if content.is_valid:
                        name = (path.as_py() or "").rsplit("/", 1)[-1]
                        for r in ArcReader(inflate(content.as_py())):
                            yield as_warc(name, r)

        yield from _bounded(rows(), schema, "block")

    return files.select(F.col("path").cast("string").alias("path"), "content").mapInArrow(run, RECORD)


def page_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(path, content): ARC files of the pages, as a crawler of that time would have stored them, versions 1 and 2 in turn.

    A page is an HTTP answer whose head carries its id.  Null html is an empty body; a null address or one with white space is stored in a form
    without any; a null id has no head line.
    """
    schema = _arrow("path string, content binary")

    def record(version: int, url: str, date: str, block: bytes, name: str, offset: int) -> bytes:
        fields = [url, "192.0.2.1", date, "text/html"] + (["200", "-", "-", str(offset), name] if version == 2 else [])
        return " ".join([*fields, str(len(block))]).encode() + b"\n" + block + b"\n"

    def opened(name: str, version: int) -> bytearray:
        block = f"{version} 0 pages\n{ARC_FIELDS[version]}\n\n".encode()
        fields = [f"filedesc://{name}", "0.0.0.0", "20000101000000", "text/plain"] + (["200", "-", "-", "0", name] if version == 2 else [])
        return bytearray(" ".join([*fields, str(len(block))]).encode() + b"\n" + block + b"\n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, out = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            for page, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if out is None:
                    n, version = n + 1, n % 2 + 1
                    name = f"pages-{part:06d}-{n:06d}.arc"
                    out = opened(name, version)
                body = html.as_buffer().to_pybytes() if html.is_valid else b""
                mark = "" if page is None else f"X-Page-Id: {page}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n{mark}\r\n"
                date = f"2000{(page or 0) // 86400 // 28 % 12 + 1:02d}{(page or 0) // 86400 % 28 + 1:02d}{(page or 0) // 3600 % 24:02d}{(page or 0) // 60 % 60:02d}{(page or 0) % 60:02d}"
                out += record(version, re.sub(r"\s", "%20", url or "about:blank") or "about:blank", date, head.encode() + body, name, len(out))
                if len(out) >= ARC_BYTES:
                    yield _batch([{"path": name, "content": bytes(out)}], schema)
                    out = None
        if out is not None:
            yield _batch([{"path": name, "content": bytes(out)}], schema)

    own = pages.select(pages[id_col].cast("long").alias("page"), pages[url_col].cast("string").alias("url"), F.coalesce(pages[html_col].cast("string"), F.lit("")).cast("binary").alias("html"))
    return own.mapInArrow(run, "path string, content binary")


def page_of(head: str = "head") -> Column:
    """The page id in the head of an HTTP message."""
    return F.regexp_extract(head, r"(?:^|\n)X-Page-Id: (-?\d{1,19})\r?\n", 1).try_cast("bigint")


def deduplicate(records: DataFrame, least: int = 0) -> DataFrame:
    """``records`` (stored; with ``page``) and ``of``, ``of_uri``, ``of_date``: the answer with the same payload, of at least ``least`` bytes, that this one revisits.

    The largest page of equal payloads is the one revisited, null pages come first and ties go to the larger record id.  Blocks do not move while
    payloads that stand more than once are few enough to broadcast.
    """
    key = ["payload_digest", "payload_bytes"]
    top = F.max(F.struct("page", "id", "uri", "date")).alias("top")
    many = records.where((F.col("type") == "response") & (F.col("payload_bytes") >= least)).groupBy(*key).agg(F.count(F.lit(1)).alias("n"), top).where("n > 1")
    many = stored(many.select(*key, F.lit("response").alias("type"), F.col("top.id").alias("of"), F.col("top.uri").alias("of_uri"), F.col("top.date").alias("of_date")))
    met = picked(records, many, [*key, "type"], "left")
    revisit = F.col("of").isNotNull() & (F.col("of") != F.col("id"))
    return met.withColumns({c: F.when(revisit, F.col(c)) for c in ("of_uri", "of_date", "of")})


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """One WARC file a task, of :data:`RECORD` rows, or of the rows of :func:`deduplicate`; a revisit keeps the head of its block only.

    The separator of records is the line end that Spark's text writer puts after each; bytes are written as they are.
    """
    have = set(records.columns)
    of = F.col("of") if "of" in have else F.lit(None).cast("string")
    block = F.when(of.isNull(), F.col("block")).otherwise(F.expr("substring(block, 1, CAST(length(block) - payload_bytes AS INT))"))

    def line(name: str, value: Column) -> Column:
        return F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"{name}: "), value))

    lines = [
        F.lit("WARC/1.0"), line("WARC-Type", F.when(of.isNull(), F.col("type")).otherwise("revisit")), line("WARC-Record-ID", F.col("id")), line("WARC-Date", F.col("date")),
        line("WARC-Filename", F.when(F.col("type") == "warcinfo", F.regexp_replace("uri", "^filedesc:/*", ""))), line("WARC-Target-URI", F.when(F.col("type") != "warcinfo", F.col("uri"))),
        line("WARC-IP-Address", F.col("ip")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")), line("WARC-Block-Digest", F.when(of.isNull(), F.concat(F.lit("sha1:"), "block_digest"))),
    ]
    if "of" in have:
        profile = F.when(of.isNotNull(), F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))
        lines += [line("WARC-Profile", profile), line("WARC-Refers-To", of), line("WARC-Refers-To-Target-URI", F.col("of_uri")), line("WARC-Refers-To-Date", F.col("of_date"))]
    lines += [line("Content-Type", F.col("mime")), F.concat(F.lit("Content-Length: "), F.length(block).cast("string"))]
    value = F.concat(F.encode(F.concat(F.concat_ws("\r\n", *lines), F.lit(END)), "UTF-8"), block).cast("string")
    records.select(value.alias("value")).write.option("lineSep", END).option("compression", compression).text(path)


def _fields(head: bytes) -> dict[str, str]:
    """Header lines by lower-case name; a line that starts with white space goes on from the one before."""
    out: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            out[name] = value.strip()
    return out


class WarcPieces:
    """Records from what stands between separators.

    A separator inside a block cuts it: pieces are put together until the declared length is reached.  A separator that
    the splitter missed leaves several records in a piece: they are cut by their lengths.
    """

    def __init__(self) -> None:
        self.file, self.open = None, b""

    def add(self, file: str, piece: bytes) -> Iterator[dict]:
        if file != self.file:
            yield from self.close()
            self.file = file
        rest = self.open + BETWEEN.encode() + piece if self.open else piece.removeprefix(BETWEEN[4:].encode())
        self.open = b""
        while rest:
            at = rest.find(END.encode())
            f = _fields(rest[:at]) if at >= 0 else {}
            n = f.get("content-length", "")
            if not (n.isdecimal() and len(n) < 19):
                yield {"file": file, "fault": "head"}
                return
            end = at + 4 + int(n)
            if end > len(rest):
                self.open = rest
                return
            after = rest[end:]
            whole = after in (b"", END.encode()) or after.startswith(BETWEEN.encode())
            yield self.record(file, f, rest[at + 4 : end], "" if whole else "length")
            rest = after[len(BETWEEN) :] if after.startswith(BETWEEN.encode()) else b""

    def close(self) -> Iterator[dict]:
        if self.open:
            at = self.open.find(END.encode())
            yield self.record(self.file, _fields(self.open[:at]), self.open[at + 4 :], "cut short")
            self.open = b""

    def record(self, file: str, f: dict[str, str], block: bytes, fault: str) -> dict:
        http = f.get("content-type", "").startswith("application/http") or f.get("warc-type") == "revisit"
        head, payload = payload_of(block) if http else (b"", block)
        told = f.get("warc-payload-digest", "").removeprefix("sha1:")
        own = None if f.get("warc-type") == "revisit" else digest(payload)
        fault = fault or ("digest" if own and told and own != told else "")
        return {
            "file": file, "type": f.get("warc-type"), "id": f.get("warc-record-id"), "date": f.get("warc-date"), "uri": f.get("warc-target-uri"), "ip": f.get("warc-ip-address"), "mime": f.get("content-type"),
            "refers_to": f.get("warc-refers-to"), "payload_bytes": len(payload) if own else None, "payload_digest": own or told or None, "fault": fault, "head": head.decode("latin-1"), "payload": payload,
        }


def read_warc(spark: SparkSession, path: str, split: bool = False) -> DataFrame:
    """Records (:data:`READ`) of the WARC files of a folder, of any size, compressed by members or not, one record at a time.

    ``split`` is for uncompressed files, which Spark reads in several tasks: their pieces are then brought back together by file, since only what
    stands before tells whether a separator is one.  ``fault`` tells of a broken head, a wrong length, a cut file or a payload that does
    not have its digest; a revisit has no payload of its own, so no size; empty folders give no records.
    """
    schema = _arrow(READ)
    pieces = spark.read.option("lineSep", BETWEEN).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"), F.col("value").cast("binary").alias("piece"))
    if split:
        pieces = pieces.repartition("file").sortWithinPartitions("file", "start", "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            weld = WarcPieces()
            for batch in batches:
                for file, piece in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    yield from weld.add(file, piece.as_buffer().to_pybytes())
            yield from weld.close()

        yield from _bounded(({k: r.get(k) for k in schema.names} for r in rows()), schema, "payload")

    return pieces.select("file", "piece").mapInArrow(run, READ)


def pages_to_warc(pages: DataFrame, path: str, least: int = 0, **columns: str) -> None:
    """Pages as legacy archives, these converted to WARC records, equal payloads as revisits, written to ``path``.

    Null html is an empty payload, which takes part as any other; null ids come before all others; repeated rows revisit each other; an empty table writes no records; other columns are not read.
    """
    records = stored(convert(page_archives(pages, **columns)).withColumn("page", page_of()))
    write_warc(deduplicate(records, least), path)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    pages_to_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    read = stored(read_warc(spark, path).where(F.col("type").isin("response", "revisit")).select("type", "id", "refers_to", "payload_bytes", "payload_digest", page_of().alias("page")))
    named = read.where("refers_to IS NOT NULL").select("refers_to").distinct()
    named = stored(read.where("type = 'response'").join(named.withColumnRenamed("refers_to", "id"), "id").select(F.col("id").alias("refers_to"), F.col("page").alias("of"), F.col("payload_bytes").alias("of_bytes")))
    out = picked(read, named, ["refers_to"], "left")
    return out.select(F.col("page").alias("page_id"), F.coalesce("payload_bytes", "of_bytes").alias("payload_bytes"), "payload_digest", F.col("type").alias("record_type"), F.col("of").alias("refers_to"))


OP11_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((('0x' || substr(h, CAST(i // 4 * 5 + 1 AS BIGINT), 5))::BIGINT >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1 AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM p
"""
