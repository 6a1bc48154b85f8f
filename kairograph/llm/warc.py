"""WARC archives: a writer, and a splittable reader (operator 8).

Writing: every task writes its rows as gzip members, one record each, to files
of its own in the shared folder (a new name per attempt, so a lost or repeated
task leaves no half file in use); what it returns is the manifest of finished
files. Records with equal payloads of at least ``REVISIT`` bytes are written
once: the one with the largest page id is the response, the others are revisit
records that refer to it. Which payloads repeat is found from digests alone. The
digests that repeat are broadcast while they are few (then no payload is
shuffled); beyond that they are joined with as many salts as a digest has copies
for (``PER_SALT`` each), so a payload shared by a third of all pages is spread. A
member whose compressed bytes would look like the start of a record somewhere
inside is packed again without stored blocks.

Reading: files are cut into byte ranges. A task scans its range for the gzip
magic and takes an offset as a member's start only if the member inflates to a
WARC header block that decodes, and ends where another member starts or the file
ends. What lies inside a valid member is skipped. A task owns the records that
start inside its range; it reads on past the end of the range to finish the last
one. So any range of any file can be read alone, and a lost task is read again.
Both versions 1.0 and 1.1, all record types, and base16 and base32 SHA-1 digests
are read; a record that states no payload length or digest has them computed.

Defined cases: a null html is an empty payload; a null page id or url is left
out of the record and read back as null; line breaks and other control
characters of a url are percent-encoded; rows tied at the largest page id of
equal payloads are all responses; payloads without any page id are not shared;
payloads of any length are written and read whole (a member is held in memory by
one task); an empty table writes no file and reads no row; other columns are not
archived, whatever their names. A foreign archive that holds a whole archive,
uncompressed within one record's member and across a range's edge, cannot be told
apart from members by any reader of byte ranges; the record counts of a manifest
show it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import SMALL_ROWS, shared_dir, small, stored, table

REVISIT = 1000
#: Copies of a payload that one salt stands for.
PER_SALT = 20_000
RANGE_BYTES = 8 << 20
FILE_BYTES = 256 << 20
#: The start of a gzip member (deflate), a record's version line as written and as read, the revisit profile.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
VERSIONS = (b"WARC/1.0\r\n", b"WARC/1.1\r\n")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_READ, _PIECE, _HEAD = 1 << 18, 1 << 14, 1 << 12
#: Tasks that read ranges at most; each then reads several.
READERS = 32_768


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _clean(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str) -> bytes:
    """One gzip member with one record."""
    named = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Length", str(len(payload))),
    ]
    if page_id is not None:
        named.append(("X-Page-Id", str(page_id)))
    if url is not None:
        named.append(("WARC-Target-URI", _clean(url)))
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is None:
        block += b"Content-Length: %d\r\n\r\n" % len(payload) + payload
    else:
        named += [("WARC-Profile", PROFILE), ("X-Refers-To-Page", str(refers_to))]
        block += b"\r\n"
    named += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = VERSION + "".join(f"{k}: {v}\r\n" for k, v in named).encode() + b"\r\n"
    raw = head + block + b"\r\n\r\n"
    for strategy in (zlib.Z_DEFAULT_STRATEGY, zlib.Z_FIXED, zlib.Z_HUFFMAN_ONLY):
        packer = zlib.compressobj(6, zlib.DEFLATED, 31, 8, strategy)
        member = packer.compress(raw) + packer.flush()
        if next((at for at in starts(member, len(member)) if at), None) is None:
            break
    return member


def headers(raw: bytes) -> tuple[dict[str, str], int] | None:
    """The named fields of the header block that ``raw`` starts with, names in lower case, and its length; None if it is none."""
    end = raw.find(b"\r\n\r\n")
    if end < 0 or not raw.startswith(VERSIONS):
        return None
    named: dict[str, str] = {}
    for line in raw[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name:
            return None
        named[name.lower()] = value.strip()
    if not named.get("content-length", "").isdigit() or "warc-type" not in named:
        return None
    return named, end + 4


def parse(raw: bytes) -> dict:
    """Headers and payload of an inflated record; raises ``ValueError`` for anything else."""
    found = headers(raw)
    if found is None:
        raise ValueError("not a WARC record")
    named, at = found
    block = raw[at : at + int(named["content-length"])]
    if raw[at + len(block) :].strip(b"\r\n") or len(block) != int(named["content-length"]):
        raise ValueError("a record of another length")
    http = named.get("content-type", "").replace(" ", "").startswith("application/http")
    return {"headers": named, "payload": block.partition(b"\r\n\r\n")[2] if http else block}


def with_references(pages: DataFrame, *, least: int = REVISIT, broadcast: int = SMALL_ROWS) -> DataFrame:
    """``(page_id, url, payload, digest, refers_to)`` of ``pages(page_id, url, html)``."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("digest"))
    light = pages.select("page_id", F.octet_length(payload).alias("n"), F.sha1(payload).alias("digest"))
    shared = light.where(F.col("n") >= least).groupBy("digest").agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("copies")).where("copies > 1 AND kept IS NOT NULL")
    shared = stored(shared, "shared-payloads")
    if shared.count() <= broadcast:
        joined = rows.join(F.broadcast(shared), "digest", "left")
    else:
        salts = F.ceil(F.col("copies") / PER_SALT)
        spread = shared.select("digest", "kept", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"))
        # Pages learn how many salts their digest has where it has several, which few digests do.
        several = small(shared.where(F.col("copies") > PER_SALT).select("digest", salts.alias("salts")))
        salted = rows.join(several, "digest", "left").withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("salts", F.lit(1))))
        joined = salted.join(spread, ["digest", "salt"], "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(~F.col("kept").eqNullSafe(F.col("page_id")), F.col("kept")).alias("refers_to"))


def write(records: DataFrame, folder: str) -> DataFrame:
    """Writes the records under ``folder``; the manifest ``(path, bytes, records)`` of the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _filesystem(folder)
        files.create_dir(root, recursive=True)
        out, path, size, n = None, "", 0, 0
        done: list[tuple[str, int, int]] = []
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    out, size, n = files.open_output_stream(path, compression=None), 0, 0
                member = record(row["page_id"], row["url"], row["payload"], row["refers_to"], row["digest"])
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= FILE_BYTES:
                    out.close()
                    done.append((path, size, n))
                    out = None
        if out is not None:
            out.close()
            done.append((path, size, n))
        scheme = folder[: folder.index("://") + 3] if "://" in folder else ""
        if done:
            paths, sizes, counts = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([scheme + p if scheme == "file://" else folder.rstrip("/") + "/" + p.rsplit("/", 1)[1] for p in paths]), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=["path", "bytes", "records"])

    return records.mapInArrow(run, "path string, bytes long, records long")


def _head(data: bytes | memoryview, at: int) -> bytes | None:
    """What the first bytes of a member at ``at`` inflate to; None if they do not."""
    try:
        return zlib.decompressobj(31).decompress(data[at : at + _HEAD], 4 * _HEAD)
    except zlib.error:
        return None


def starts(data: bytes, limit: int) -> Iterator[int]:
    """Offsets below ``limit`` where a gzip member's bytes inflate to a WARC version line."""
    at = data.find(MAGIC)
    while 0 <= at < limit:
        head = _head(data, at)
        if head is not None and head.startswith(VERSIONS):
            yield at
        at = data.find(MAGIC, at + 1)


class _Range:
    """Bytes of an open file from ``start`` on, read as they are asked for."""

    def __init__(self, file, size: int, start: int, end: int):
        self.file, self.size, self.start = file, size, start
        file.seek(start)
        self.data = file.read(min(size, end + _HEAD) - start)
        self.view = memoryview(self.data)

    def piece(self, at: int, n: int) -> bytes | memoryview:
        if at + n <= len(self.data) or self.start + len(self.data) >= self.size:
            return self.view[at : at + n]
        self.file.seek(self.start + at)
        return self.file.read(n)

    def member(self, at: int) -> tuple[bytes, int] | None:
        """The inflated record of the member at ``at`` and where the member ends; None if no valid record starts there."""
        inflate, parts, held, place, named = zlib.decompressobj(31), [], b"", at, False
        while not inflate.eof:
            piece = self.piece(place, _PIECE if place == at else _READ)
            if not len(piece):
                if named:
                    raise EOFError("the last record is cut off")
                return None
            place += len(piece)
            try:
                parts.append(inflate.decompress(piece))
            except zlib.error:
                return None
            if not named:
                held += parts[-1]
                if not held.startswith(VERSIONS) and len(held) >= len(VERSION):
                    return None
                if b"\r\n\r\n" in held or inflate.eof:
                    if headers(held) is None:
                        return None
                    named = True
        end = place - len(inflate.unused_data)
        follows = bytes(self.piece(end, len(MAGIC)))
        return (b"".join(parts), end) if follows in (b"", MAGIC) or self.start + end >= self.size else None


def read_range(file, size: int, start: int, end: int) -> Iterator[bytes]:
    """Inflated records of the open ``file`` whose members start in ``[start, end)``; what is inside a record is skipped."""
    part = _Range(file, size, start, end)
    at = part.data.find(MAGIC)
    while 0 <= at < end - start:
        found = part.member(at)
        if found is None:
            at = part.data.find(MAGIC, at + 1)
            continue
        yield found[0]
        at = part.data.find(MAGIC, found[1])


def read(manifest: DataFrame, *, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload)`` of every record.

    A revisit's payload is null; its length and digest are those of the payload
    that it stands for (null if the record does not say). Another record's digest
    is taken from what was read, and must be the one recorded, if one is.
    """
    last = F.greatest(F.expr(f"(bytes - 1) div {range_bytes}"), F.lit(0))
    ranges = manifest.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("k"))
    number = manifest.agg(F.sum(last + 1)).first()[0] or 1
    ranges = ranges.repartition(min(READERS, number), "path", "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                files, path = _filesystem(part["path"])
                rows: list[dict] = []
                held = 0
                with files.open_input_file(path) as file:
                    first = part["k"] * range_bytes
                    for raw in read_range(file, part["bytes"], first, min(part["bytes"], first + range_bytes)):
                        rows.append(_row(parse(raw)))
                        held += len(raw)
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    return ranges.mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def _sha1(named: str | None) -> str | None:
    """A labelled SHA-1 in lower-case hex; base32, as other writers have it, is turned into it."""
    kind, _, value = (named or "").partition(":")
    if kind.lower() != "sha1":
        return None
    return base64.b32decode(value.upper()).hex() if len(value) == 32 else value.lower()


def _row(found: dict) -> dict:
    named, payload = found["headers"], found["payload"]
    kind, digest, length = named["warc-type"], _sha1(named.get("warc-payload-digest")), named.get("x-payload-length")
    if kind != "revisit":
        own = (hashlib.sha1(payload).hexdigest(), str(len(payload)))
        if own != (digest or own[0], length or own[1]):
            raise ValueError("a payload differs from its recorded digest or length")
        digest, length = own
    whole = {k: int(v) if (v := named.get(h)) is not None else None for k, h in (("page_id", "x-page-id"), ("refers_to", "x-refers-to-page"))}
    return whole | {"url": named.get("warc-target-uri"), "record_type": kind, "payload_bytes": int(length) if length is not None else None, "payload_digest": digest, "payload": payload if kind != "revisit" else None}


def archive(pages: DataFrame) -> DataFrame:
    """``pages`` written as WARC in the shared folder; the manifest."""
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return stored(write(with_references(pages), folder), "warc-manifest")


def complete(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """``rows`` as read, written to the shared folder; raises if they are not as many as the manifest's records."""
    rows = stored(rows, "warc-rows")
    found, written = rows.count(), manifest.agg(F.sum("records")).first()[0] or 0
    if found != written:
        raise ValueError(f"{written} records were written and {found} read")
    return rows


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = archive(table(spark, sf_dir, "pages"))
    return complete(read(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), manifest)


OP8_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), k AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS kept FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN kept = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN kept <> page_id THEN kept END AS refers_to
FROM k
"""
