"""WARC archives: writing, and normalising monolithic gzip.

A writer that gzips a whole file as one stream leaves an archive that can only be read from its start. The normaliser inflates such a
stream once, in bounded memory, writes every record as a gzip member of its own, and records where each member lies in a sidecar index
(JSON lines), after which any record is one ranged read. Files are written beside one another in the folder the cluster shares, under
names no other task attempt uses; only finished attempts are in the manifest, so a lost executor leaves at most files nobody reads.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, settle, slices

#: Payloads below this size are stored again instead of being referred to.
LEAST_REVISIT = 1000
#: Uncompressed bytes after which a task begins another archive.
ARCHIVE_BYTES = 256 << 20
LEVEL, CHUNK = 6, 1 << 20
#: Groups of equal payloads up to which their table is broadcast (some 30 MB); beyond, pages are shuffled to it, each group over SALTS tasks.
BROADCAST_GROUPS, SALTS = 200_000, 16
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP = 16 + zlib.MAX_WBITS


@functools.cache
def _store(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def _name(ident: object) -> str:
    return f"<urn:x-page:{'' if ident is None else quote(str(ident), safe='')}>"


def _ident(name: str) -> str | None:
    return unquote(name.removeprefix("<urn:x-page:").removesuffix(">")) or None


def record(ident: object, url: str | None, payload: bytes, refers_to: object = None, revisit: bool = False, date: str = DATE) -> bytes:
    """One WARC record; a revisit keeps the HTTP header, with the full length, and leaves out the body."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(ident)}", f"WARC-Date: {date}", f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~') if url else _name(ident)[1:-1]}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        head[3:3] = [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Inflated:
    """Reads a gzip stream of any number of members as one run of bytes, inflating each byte once."""

    def __init__(self, raw: io.RawIOBase):
        self.raw, self.engine, self.buffer, self.at, self.ended = raw, zlib.decompressobj(GZIP), b"", 0, False

    def _more(self) -> bool:
        left = self.engine.unused_data if self.engine.eof else self.engine.unconsumed_tail
        if self.engine.eof:
            self.engine = zlib.decompressobj(GZIP)
        data = left or self.raw.read(CHUNK)
        if not data:
            if self.engine.eof or not self.started:
                return False
            raise ValueError("gzip stream ends inside a member")
        self.started = True
        self.buffer = self.buffer[self.at :] + self.engine.decompress(data, CHUNK)
        self.at = 0
        if self.engine.eof and not self.engine.unused_data:
            self.started = False
        return True

    started = False

    def take(self, n: int) -> bytes:
        while len(self.buffer) - self.at < n and self._more():
            pass
        got = self.buffer[self.at : self.at + n]
        self.at += len(got)
        return got

    def until(self, mark: bytes) -> bytes:
        """Up to and with mark; what is left if it never comes."""
        while (k := self.buffer.find(mark, self.at)) < 0 and self._more():
            pass
        return self.take(k + len(mark) - self.at if k >= 0 else len(self.buffer) - self.at)


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def normalise(raw: io.RawIOBase, out: io.RawIOBase, level: int = LEVEL) -> Iterator[dict]:
    """Copy the archive in raw to out with a gzip member a record; yields {offset, length, type, record_id} of each. Bounded memory."""
    source, offset = Inflated(raw), 0
    while head := source.until(b"\r\n\r\n"):
        if not head.startswith(b"WARC/") or not head.endswith(b"\r\n\r\n"):
            raise ValueError(f"no WARC record before member {offset}")
        fields, engine = headers(head), zlib.compressobj(level, zlib.DEFLATED, GZIP)
        length = out.write(engine.compress(head)) or 0
        left = int(fields["content-length"]) + 4
        while left:
            part = source.take(min(left, CHUNK))
            if not part:
                raise ValueError("archive ends inside a record")
            left -= len(part)
            length += out.write(engine.compress(part)) or 0
        length += out.write(engine.flush())
        yield {"offset": offset, "length": length, "type": fields.get("warc-type", ""), "record_id": fields.get("warc-record-id", "")}
        offset += length


def read_member(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(WARC fields, HTTP header, body) of one gzip member."""
    source = Inflated(io.BytesIO(raw))
    fields = headers(source.until(b"\r\n\r\n"))
    block = io.BytesIO(source.take(int(fields["content-length"]))).getvalue()
    cut = block.find(b"\r\n\r\n") + 4
    return fields, block[:cut], block[cut:]


def resolve(pages: DataFrame, id_col: str = "page_id", text_col: str = "html", url_col: str = "url", least: int = LEAST_REVISIT) -> DataFrame:
    """(ident, url, payload binary, revisit boolean, refers_to): which records refer to another. A null text is an empty payload.

    Of equal payloads of at least `least` bytes the one with the largest id is stored. Rows that repeat that id with that payload are all
    stored; a null id never is the largest. If all ids of a group are null, all its rows are stored.
    """
    rows = pages.select(F.col(id_col).alias("ident"), F.col(url_col).alias("url"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.when(F.octet_length("payload") >= least, F.sha2("payload", 256)))
    groups = rows.where("digest is not null").groupBy("digest").agg(F.max("ident").alias("stored"), F.count("*").alias("n")).where("n > 1 and stored is not null").select(F.col("digest").alias("d"), "stored")
    groups = settle(groups, "warc-groups")
    same, few = F.col("digest") == F.col("d"), groups.count() <= BROADCAST_GROUPS
    if few:
        joined = rows.join(F.broadcast(groups), same, "left")
    else:  # small payloads have no digest and stay where they are
        apart, rows = rows.where("digest is null"), rows.where("digest is not null")
        groups = groups.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("ident", "url"), F.lit(SALTS)).cast("int")).join(groups, same & (F.col("salt") == F.col("s")), "left")
    revisit = F.col("stored").isNotNull() & ~F.col("ident").eqNullSafe(F.col("stored"))
    joined = joined.select("ident", "url", "payload", revisit.alias("revisit"), F.when(revisit, F.col("stored")).alias("refers_to"))
    if few:
        return joined
    return joined.unionByName(apart.select("ident", "url", "payload", F.lit(False).alias("revisit"), F.lit(None).cast(rows.schema["ident"].dataType).alias("refers_to")))


def write(records: DataFrame, root: str, date: str = DATE, level: int = LEVEL) -> DataFrame:
    """Write resolve()'s rows as monolithic .warc.gz files under root; returns their paths, (archive string), settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(root)
        store.create_dir(base)
        path, out, engine, size = "", None, None, 0
        for part in slices(batches):
            for row in part.to_pylist():
                if out is None:
                    path, size = f"{base}/{uuid.uuid4().hex}.mono.warc.gz", 0
                    out, engine = store.open_output_stream(path, compression=None), zlib.compressobj(level, zlib.DEFLATED, GZIP)
                data = record(row["ident"], row["url"], row["payload"], row["refers_to"], row["revisit"], date)
                out.write(engine.compress(data))
                size += len(data)
                if size >= ARCHIVE_BYTES:
                    out.write(engine.flush())
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_arrays([pa.array([path])], names=["archive"])
        if out is not None:
            out.write(engine.flush())
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path])], names=["archive"])

    return settle(records.mapInArrow(run, "archive string"), "warc-archives")


def normalised(archives: DataFrame, root: str) -> DataFrame:
    """Normalise each archive of archives(archive); (archive, index, offset, length, type, record_id) for every member, settled.

    An archive that is no WARC, or is cut off, fails the job.
    """
    schema = "archive string, index string, offset long, length long, type string, record_id string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(root)
        for path in (x for part in batches for x in part.column(0).to_pylist()):
            stem = f"{path.removesuffix('.mono.warc.gz')}-{uuid.uuid4().hex[:8]}"
            with store.open_input_stream(path, compression=None) as raw, store.open_output_stream(f"{stem}.warc.gz", compression=None) as out, store.open_output_stream(f"{stem}.idx.jsonl", compression=None) as index:
                held: list[dict] = []
                for x in normalise(raw, out):
                    index.write(json.dumps(x).encode() + b"\n")
                    held.append(x | {"archive": f"{stem}.warc.gz", "index": f"{stem}.idx.jsonl"})
                    if len(held) >= 4096:
                        yield _rows(held)
                        held = []
            if held:
                yield _rows(held)

    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    _rows: Callable = lambda held: pa.RecordBatch.from_arrays([pa.array([x[n] for x in held], k) for n, k in zip(names, kinds)], names=names)
    # A task an archive: paths are few and short, so adaptive execution would put them all into one.
    spread = archives.repartitionByRange(max(1, archives.count()), "archive")
    return settle(spread.mapInArrow(run, schema), "warc-index")


def read(index: DataFrame, root: str) -> DataFrame:
    """Read every record of normalised()'s index by its range: (ident string, payload_bytes, payload_digest, record_type, refers_to string).

    A response whose body does not match its digest or length fails the job. Each archive is read by one task, from its start to its end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(root)
        opened, now = None, ""
        for part in slices(batches):
            out: list[tuple] = []
            for path, offset, length in zip(*(part.column(c).to_pylist() for c in ("archive", "offset", "length"))):
                if path != now:
                    if opened:
                        opened.close()
                    opened, now = store.open_input_file(path), path
                fields, http, body = read_member(opened.read_at(length, offset))
                digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                size = int(headers(http)["content-length"])
                if fields["warc-type"] == "response" and (len(body) != size or hashlib.sha1(body).hexdigest() != digest):
                    raise ValueError(f"{path} at {offset}: payload differs from its digest")
                refers = fields.get("warc-refers-to")
                out.append((_ident(fields["warc-record-id"]), size, digest, fields["warc-type"], refers and _ident(refers)))
            cols = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()))], names=["ident", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        if opened:
            opened.close()

    archives = index.select(F.count_distinct("archive")).first()[0]
    spread = index.select("archive", "offset", "length").repartitionByRange(max(1, archives), "archive").sortWithinPartitions("archive", "offset")
    return spread.mapInArrow(run, "ident string, payload_bytes long, payload_digest string, record_type string, refers_to string")


def archive(pages: DataFrame, id_col: str = "page_id", text_col: str = "html", url_col: str = "url", root: str | None = None) -> tuple[DataFrame, str]:
    """Write pages as WARC and normalise them: (index, folder). root: a shared folder, by default one under spark.checkpoint.dir."""
    root = root or fresh_path(pages.sparkSession, "warc")
    return normalised(write(resolve(pages, id_col, text_col, url_col), root), root), root


def op6_warc(spark, sf_dir: str) -> DataFrame:
    from .common import table

    index, root = archive(table(spark, sf_dir, "pages"))
    got = read(index, root)
    return got.select(F.col("ident").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


OP6_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest, b FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY b) AS stored FROM q)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> stored THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> stored THEN stored END AS refers_to
FROM r
"""
