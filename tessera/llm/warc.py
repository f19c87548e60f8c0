"""WARC archives: records written into monolithic gzip files, normalised to one
gzip member per record with a sidecar offset index, and read back by offset.

A monolithic file is one gzip stream over many records, so nothing in it can be
reached without inflating what stands before.  The normaliser inflates such a
file once, front to back, holding one record at a time, writes every record as
its own member, and notes where each begins.  Files are cut at a size, so one
task's work is bounded; tasks write under names of their own, and only files
named by a committed manifest count, so a lost executor leaves nothing but
unused files.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import staged
from tessera.session import scratch_path

DATE = "2000-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 20
#: payload bytes after which a monolithic file is closed
FILE_BYTES = 16 << 20
#: parts that the copies of one payload are dealt into
SALTS = 16


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def record_bytes(page_id, url, payload: bytes, digest: str, size: int, refers_to) -> bytes:
    """One WARC/1.1 record, with the empty lines that end it."""
    own = f"urn:page:{'null' if page_id is None else page_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url) if url else own
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{own}>",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def fields(head: bytes) -> dict[str, str]:
    """Header fields of a record, by lower-case name."""
    pairs = (line.partition(":") for line in head.decode("utf-8").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def inflated(stream) -> Iterator[bytes]:
    """The inflated bytes of a gzip file, of one member or many, in pieces."""
    z, data, open_member = zlib.decompressobj(31), b"", False
    while data := data or stream.read(CHUNK):
        out = z.decompress(data, CHUNK)
        open_member = not z.eof
        if out:
            yield out
        if z.eof:
            data, z = z.unused_data, zlib.decompressobj(31)
        else:
            data = z.unconsumed_tail
    while open_member and (out := z.decompress(b"", CHUNK)):
        yield out
    if open_member and not z.eof:
        raise EOFError("the gzip stream ends early")


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, whole record) of each record of an inflated stream."""
    buf, pieces = bytearray(), iter(pieces)

    def need(n: int) -> bool:
        while len(buf) < n:
            more = next(pieces, None)
            if more is None:
                return False
            buf.extend(more)
        return True

    while need(1):
        start = 0
        while (end := buf.find(b"\r\n\r\n", start)) < 0:
            start = max(0, len(buf) - 3)
            if not need(len(buf) + 1):
                raise EOFError("a record's header ends early")
        head = fields(bytes(buf[:end]))
        size = end + 4 + int(head["content-length"]) + 4
        if not need(size):
            raise EOFError("a record ends early")
        yield head, bytes(buf[:size])
        del buf[:size]


def with_roles(df: DataFrame, id_col: str, url_col: str, html_col: str, least: int) -> DataFrame:
    """``warc_id``, ``warc_url``, ``payload`` (text), ``digest``, ``size``,
    ``refers_to``.  Counting copies shuffles digests only; the join is salted,
    so the copies of one payload spread over ``SALTS`` keys."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = df.select(F.col(id_col).cast("bigint").alias("warc_id"), F.col(url_col).cast("string").alias("warc_url"),
                     payload.alias("payload")) \
        .withColumn("digest", F.sha1(F.col("payload").cast("binary"))).withColumn("size", F.octet_length("payload").cast("bigint"))
    copies = rows.where(F.col("size") >= least).groupBy("digest") \
        .agg(F.max("warc_id").alias("response_id"), F.count(F.lit(1)).alias("n")) \
        .where("n > 1 AND response_id IS NOT NULL") \
        .select("digest", "response_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("warc_id"), F.lit(SALTS)).cast("int"))
    revisit = ~F.col("response_id").eqNullSafe(F.col("warc_id"))
    return salted.join(copies, ["digest", "salt"], "left").select(
        "warc_id", "warc_url", "payload", "digest", "size",
        F.when(F.col("response_id").isNotNull() & revisit, F.col("response_id")).alias("refers_to"))


def write_monolithic(rows: DataFrame, base: str) -> DataFrame:
    """Write the records into ``base`` and return the manifest (``path``)."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = file_system(base)
        out = z = path = None
        held = 0

        def close():
            out.write(z.flush())
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path]})

        for b in batches:
            for r in b.to_pylist():
                if out is None:
                    path, held = f"raw-{uuid.uuid4().hex}.warc.gz", 0
                    out, z = fs.open_output_stream(f"{folder}/{path}", compression=None), zlib.compressobj(1, zlib.DEFLATED, 31)
                data = record_bytes(r["warc_id"], r["warc_url"], r["payload"].encode(), r["digest"], r["size"], r["refers_to"])
                out.write(z.compress(data))
                held += len(data)
                if held >= FILE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return rows.mapInArrow(write, "path string")


def normalise(manifest: DataFrame, base: str, target: str) -> DataFrame:
    """Rewrite each monolithic file of ``manifest`` in ``base`` as one member
    per record in ``target``, with a sidecar index ``<path>.idx`` of one JSON
    line per record (offset, length, type, id).  Returns ``path``, ``records``."""
    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = file_system(base)
        _, to = file_system(target)
        for b in batches:
            for name in b.column(0).to_pylist():
                path, offset, n = f"pages-{uuid.uuid4().hex}.warc.gz", 0, 0
                with fs.open_input_stream(f"{folder}/{name}", compression=None) as stream, \
                        fs.open_output_stream(f"{to}/{path}", compression=None) as out, \
                        fs.open_output_stream(f"{to}/{path}.idx", compression=None) as index:
                    for head, data in records(inflated(stream)):
                        z = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = z.compress(data) + z.flush()
                        out.write(member)
                        index.write(json.dumps({"offset": offset, "length": len(member), "type": head["warc-type"],
                                                "id": head["warc-record-id"]}).encode() + b"\n")
                        offset, n = offset + len(member), n + 1
                yield pa.RecordBatch.from_pydict({"path": [path], "records": [n]})

    return manifest.mapInArrow(rewrite, "path string, records long")


def _page(uri: str | None):
    text = uri.strip("<>").removeprefix("urn:page:") if uri else "null"
    return None if text == "null" else int(text)


def read_archives(manifest: DataFrame, base: str) -> DataFrame:
    """One row per record of the archives in ``manifest``, each record inflated
    on its own at the place its sidecar index names.  A payload's digest is
    checked against its header."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = file_system(base)
        for b in batches:
            for path in b.column(0).to_pylist():
                rows = {k: [] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri")}
                with fs.open_input_stream(f"{folder}/{path}.idx", compression=None) as f:
                    index = [json.loads(x) for x in f.read().splitlines()]
                with fs.open_input_file(f"{folder}/{path}") as f:
                    for at in index:
                        f.seek(at["offset"])
                        data = zlib.decompress(f.read(at["length"]), 31)
                        head_end = data.index(b"\r\n\r\n")
                        head = fields(data[:head_end])
                        http_end = data.index(b"\r\n\r\n", head_end + 4)
                        size = int(fields(data[head_end + 4:http_end])["content-length"])
                        digest = head["warc-payload-digest"].removeprefix("sha1:")
                        if head["warc-type"] == "response":
                            payload = data[http_end + 4:-4]
                            if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
                                raise ValueError(f"{path} at {at['offset']}: the payload doesn't match its header")
                        rows["page_id"].append(_page(head["warc-record-id"]))
                        rows["payload_bytes"].append(size)
                        rows["payload_digest"].append(digest)
                        rows["record_type"].append(head["warc-type"])
                        rows["refers_to"].append(_page(head.get("warc-refers-to")))
                        rows["target_uri"].append(head["warc-target-uri"])
                yield pa.RecordBatch.from_pydict(rows, schema)

    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string())])
    return manifest.select("path").mapInArrow(
        read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string")


def archive(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            least: int = 1000, base: str | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` as normalised archives; returns their manifest and folder.

    Of records with equal payloads (by SHA-1) of at least ``least`` bytes, the
    one with the largest id is a response and the others revisit it; rows that
    share that largest id are all responses.  Null html is an empty payload, a
    null or empty url is written as the page's own name, a null id stays null
    (it never is the one revisited); an empty table gives no archive; other
    columns are not read.  Folders lie in ``spark.checkpoint.dir``.
    """
    spark = df.sparkSession
    base = base or scratch_path(spark, f"llm/warc-{uuid.uuid4().hex}")
    fs, folder = file_system(base)
    fs.create_dir(f"{folder}/raw", recursive=True)
    fs.create_dir(f"{folder}/archives", recursive=True)
    raw = staged(write_monolithic(with_roles(df, id_col, url_col, html_col, least), f"{base}/raw"), "warc-raw")
    files = max(1, raw.count())
    done = staged(normalise(raw.repartition(files), f"{base}/raw", f"{base}/archives"), "warc-archives")
    fs.delete_dir(f"{folder}/raw")
    return done, f"{base}/archives"


def round_trip(df: DataFrame, **columns) -> DataFrame:
    """Archive ``df`` and read every record back (see ``archive``)."""
    manifest, base = archive(df, **columns)
    return read_archives(manifest.repartition(max(1, manifest.count())), base)


#: DuckDB SQL of the contract columns over a table ``pages``.
SQL = """
WITH p AS (SELECT page_id, COALESCE(html, '') AS h, strlen(COALESCE(html, '')) AS n FROM pages),
g AS (SELECT sha1(h) AS d, max(page_id) AS r, count(*) AS c FROM p WHERE n >= 1000 GROUP BY 1)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN c > 1 AND r <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN c > 1 AND r <> page_id THEN r END AS refers_to
FROM p LEFT JOIN g ON d = sha1(h) AND n >= 1000
"""
