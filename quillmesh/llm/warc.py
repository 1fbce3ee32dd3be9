"""WARC archives, index first.

``write`` turns pages into WARC 1.1 files of gzip members, one member per record, and returns the
index: per record the file, offset, length, URL, digest and type. ``read`` takes any selection of
index rows, deals them out by file and offset, coalesces neighbouring byte ranges of a file into one
read, and parses and verifies the records. Files go to the shared folder through pyarrow's file
systems; every task attempt writes a file of its own and only committed attempts are in the index, so
a lost executor or a speculative copy leaves at most an orphaned file.

Of records with equal payloads of at least MIN_REVISIT bytes the one with the smallest page_id is a
response, the others are revisits that hold the HTTP head alone. Equal payloads are found by digest
and length; only (page_id, digest, length) rows move for that, and payloads move once, by page_id.

Defined results: a null payload is empty, a null URL is written as `about:blank`; rows that repeat the
smallest page_id of their payload are all responses; a null page_id is never a revisit; lone
surrogates cannot occur in a Spark string; extra columns are ignored; an empty table gives an empty
index.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import fresh_path, slices, written

MIN_REVISIT = 100
#: Ranges of a file are read together if at most GAP bytes lie between them, up to CHUNK bytes at once.
GAP, CHUNK = 64 << 10, 8 << 20
#: Bytes of payload, and index rows, that a task holds as Python objects at once.
PAYLOAD_BYTES, SPANS = 4 << 20, 4096
INDEX = "page_id long, url string, file string, offset long, length long, payload_digest string, record_type string, refers_to long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, verified boolean, payload binary"
#: A fixed date keeps the archives of equal pages equal.
DATE = "2024-01-01T00:00:00Z"


def file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder in Spark's notation, and the path in it. Hadoop's names of a store are mapped to
    those of pyarrow."""
    scheme, _, rest = folder.partition(":")
    return pafs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3", "abfss": "abfss", "gs": "gs"}.get(scheme, scheme) + ":" + rest if rest else folder)


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record."""
    url = "about:blank" if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}",
             f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of a record; the payload is None for revisits."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(next(x for x in http.decode().split("\r\n") if x.lower().startswith("content-length:")).split(":")[1])
    number = lambda name: int(fields[name][len("<urn:x-page:"):-1]) if len(fields.get(name, "")) > len("<urn:x-page:>") else None
    revisit = fields["WARC-Type"] == "revisit"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    good = rest[len(body):] == b"\r\n\r\n" and (revisit or (len(payload) == size and hashlib.sha256(payload).hexdigest() == digest))
    return {"page_id": number("WARC-Record-ID"), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To") if revisit else None,
            "payload_bytes": size, "payload_digest": digest, "verified": good, "payload": None if revisit else payload}


def revisits(keys: DataFrame) -> DataFrame:
    """``keys``: page_id, payload_bytes, payload_digest. The pages that revisit another: page_id, refers_to."""
    big = keys.filter((F.col("payload_bytes") >= MIN_REVISIT) & F.col("page_id").isNotNull())
    first = big.groupBy("payload_digest", "payload_bytes").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # Written, so that the join has two plain exchanges and Spark can split the partition of a payload of a third of all pages.
    found = big.join(written(first, "responses"), ["payload_digest", "payload_bytes"]).filter(F.col("page_id") != F.col("refers_to"))
    return found.select("page_id", "payload_digest", "refers_to").distinct()


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write archives under ``folder`` and return their index, itself written there."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("payload_digest", F.sha2("payload", 256))
    keys = written(p.select("page_id", "payload_digest", F.octet_length("payload").cast("long").alias("payload_bytes")), "payloads")
    # Null ids match nothing in a left join, and stay.
    marked = p.join(revisits(keys), ["page_id", "payload_digest"], "left").select("page_id", "url", "payload", "payload_digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        out, name, at = None, "", 0
        try:
            for part in (b.slice(lo, hi - lo) for b in batches for lo, hi in slices(b.column(2), PAYLOAD_BYTES)):
                rows = []
                for r in part.to_pylist():
                    if out is None:
                        fs.create_dir(root, recursive=True)
                        name = f"pages-{uuid.uuid4().hex}.warc.gz"
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    member = gzip.compress(record(r["page_id"], r["url"], r["payload"], r["payload_digest"], r["refers_to"]), compresslevel=1, mtime=0)
                    out.write(member)
                    rows.append((r["page_id"], r["url"], name, at, len(member), r["payload_digest"], "response" if r["refers_to"] is None else "revisit", r["refers_to"]))
                    at += len(member)
                if rows:
                    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    return written(marked.mapInArrow(run, INDEX), "warc-index")


def ranges(spans: list[tuple[int, int]], gap: int = GAP, chunk: int = CHUNK) -> list[tuple[int, int, list[int]]]:
    """Coalesce sorted (offset, length) spans: (offset, length, indices of the spans inside)."""
    out: list[tuple[int, int, list[int]]] = []
    for i, (at, n) in enumerate(spans):
        if out and at - (out[-1][0] + out[-1][1]) <= gap and at + n - out[-1][0] <= chunk:
            out[-1] = (out[-1][0], max(out[-1][1], at + n - out[-1][0]), [*out[-1][2], i])
        else:
            out.append((at, n, [i]))
    return out


def read(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records that ``index`` lists, parsed and verified."""
    n = max(1, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    wanted = index.select("file", "offset", "length").repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        names = [x.split()[0] for x in RECORD.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]
        for b in (b.slice(lo, SPANS) for b in batches for lo in range(0, b.num_rows, SPANS)):
            by_file: dict[str, list[tuple[int, int]]] = {}
            for r in b.to_pylist():
                by_file.setdefault(r["file"], []).append((r["offset"], r["length"]))
            for name, spans in by_file.items():
                with fs.open_input_file(f"{root}/{name}") as f:
                    for at, size, inside in ranges(spans):
                        data = f.read_at(size, at)
                        rows = [parse(zlib.decompress(data[spans[i][0] - at : spans[i][0] - at + spans[i][1]], 31)) for i in inside]
                        if not payloads:
                            for r in rows:
                                r["payload"] = None
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(names, kinds)], names=names)

    return wanted.mapInArrow(run, RECORD)


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
     f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to, true AS verified
FROM f
"""


def op5_warc(spark, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    index = write(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read(index, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")
