"""WARC archives with revisit records for payloads that are stored already.

Headers (ids, urls, digests and lengths) are shuffled by payload digest to find the first response of each payload and to join the
others, which become revisits, to it. Payloads stay where they are: revisits have none, and responses are told by a bit map. Tasks
write archive files of their own names; only files that a committed manifest names count, and others are deleted once it is there.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BitMap, open_fs, scratch, stored, utf8

#: Bytes of records (before compression) after which a task begins another file.
ROLL = 32 << 20
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def _id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page}/{digest}')}>"


def _uri(url: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")


def record(page: int | None, url: str | None, payload: bytes | None, length: int, digest: str, refers: tuple[int | None, str | None] | None) -> bytes:
    """One record as a gzip member of its own: a response, or, without its payload, a revisit of the page and url in ``refers``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if refers else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: {_id(page, digest)}", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {x}"] if (x := _uri(url)) else []
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}"]
    if refers:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_id(refers[0], digest)}", f"WARC-Refers-To-Date: {DATE}"]
        head += [f"WARC-Refers-To-Target-URI: {x}"] if (x := _uri(refers[1])) else []
    head += [f"X-Page-Id: {'' if page is None else page}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def records(source: io.RawIOBase, step: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a compressed archive, read as a stream; a record at a time is in memory."""
    unpacker, plain, waiting = zlib.decompressobj(31), bytearray(), b""
    while True:
        data = waiting or source.read(step)
        if not data:
            break
        plain += unpacker.decompress(data)
        waiting = unpacker.unused_data
        if unpacker.eof:
            end = plain.index(b"\r\n\r\n")
            first, *lines = plain[:end].decode().split("\r\n")
            if not first.startswith("WARC/"):
                raise ValueError("not a WARC record")
            headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
            yield headers, bytes(plain[end + 4 : end + 4 + int(headers["Content-Length"])])
            unpacker, plain = zlib.decompressobj(31), bytearray()


def resolve(pages: DataFrame, min_bytes: int = 0) -> tuple[DataFrame, BitMap]:
    """Rows (page_id, url, html, digest, length, first, mark, sure) and the bits of the marks of revisits. digest is the hex SHA-1 of the
    payload, length its bytes. A sure row is a record: a revisit of another page, first (page_id, url), without html, or a
    response. Of the others those whose mark is among the bits aren't records (sure ones stand for them); the rest are responses.

    Of records with equal payloads of at least ``min_bytes`` bytes the smallest page_id is the response (all its rows,
    if it repeats: records of one page_id and payload can't be told apart; a null page_id is the largest). Only headers are
    shuffled: the first of a payload is summed before, and joined to the others, where Spark splits a digest that a third
    of the pages share. Payloads aren't, but for the few responses whose mark is among the bits by chance.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha1("html"))
    rows = rows.withColumns({"length": F.octet_length("html").cast("long"), "mark": F.xxhash64("page_id", "digest")})
    headers = stored(rows.drop("html"), "headers")
    key = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")
    firsts = headers.where(F.col("length") >= min_bytes).groupBy("digest").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    again = headers.join(firsts, "digest").where(~F.col("first.page_id").eqNullSafe(F.col("page_id")))
    revisits = stored(again.select("page_id", "url", "digest", "length", "mark", F.struct("first.page_id", "first.url").alias("first")), "revisits")
    bits = BitMap(revisits, "mark", revisits.count())
    mistaken = headers.where(bits.might(F.col("mark"))).join(revisits.select(F.struct("page_id", "digest").alias("of")).distinct(), F.struct("page_id", "digest").eqNullSafe(F.col("of")), "left_anti")
    mistaken = stored(mistaken.select("mark").distinct(), "mistaken")
    none, columns = F.lit(None).cast(revisits.schema["first"].dataType), ["page_id", "url", "html", "digest", "length", "first", "mark", "sure"]
    sure = revisits.withColumns({"html": F.lit(None).cast("string"), "sure": F.lit(True)}).select(*columns)
    if not mistaken.isEmpty():
        wrong = rows.join(mistaken, "mark", "left_semi").join(revisits.select(F.struct("page_id", "digest").alias("of")).distinct(), F.struct("page_id", "digest").eqNullSafe(F.col("of")), "left_anti")
        sure = sure.unionByName(wrong.withColumns({"first": none, "sure": F.lit(True)}).select(*columns))
    return rows.withColumns({"first": none, "sure": F.lit(False)}).select(*columns).unionByName(sure), bits


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, roll: int = ROLL) -> DataFrame:
    """Writes every page's record below ``path``; returns the committed manifest (file, records, bytes).

    A null html is an empty payload, a null url leaves out the target. Pages of an empty table give an empty manifest.
    """
    found, bits = resolve(pages, min_bytes)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(path)
        fs.create_dir(f"{root}/archives")
        name, out, n, size, packed = "", None, 0, 0, 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"archives/{name}"]), pa.array([n], pa.int64()), pa.array([packed], pa.int64())], names=["file", "records", "bytes"])

        for batch in batches:
            batch = batch.filter(pc.or_(batch.column(7), pa.array(~bits.has(batch.column(6).to_numpy()))))
            ids, urls, digests, lengths, firsts = (batch.column(i) for i in (0, 1, 3, 4, 5))
            for i, html in enumerate(utf8(batch.column(2))):
                if out is None:
                    name, n, size, packed = f"{uuid.uuid4().hex}.warc.gz", 0, 0, 0
                    out = fs.open_output_stream(f"{root}/archives/{name}", compression=None)
                first = firsts[i].as_py()
                data = record(ids[i].as_py(), urls[i].as_py(), html, lengths[i].as_py(), base64.b32encode(bytes.fromhex(digests[i].as_py())).decode(), (first["page_id"], first["url"]) if first else None)
                out.write(data)
                n, size, packed = n + 1, size + len(html or b""), packed + len(data)
                if size >= roll:
                    out.close()
                    out = None
                    yield row()
        if out is not None:
            out.close()
            yield row()

    schema = "file string, records long, bytes long"
    found.mapInArrow(write, schema).write.parquet(f"{path}/manifest")
    manifest = pages.sparkSession.read.schema(schema).parquet(f"{path}/manifest")
    _sweep(path, {r["file"] for r in manifest.select("file").toLocalIterator()})  # a name for each ``roll`` bytes
    return manifest


def _sweep(path: str, named: set[str]) -> None:
    """Deletes the archives that the committed manifest doesn't name: those of tasks that were lost or ran twice."""
    fs, root = open_fs(path)
    for x in fs.get_file_info(pafs.FileSelector(f"{root}/archives", allow_not_found=True)):
        if f"archives/{x.base_name}" not in named:
            fs.delete_file(x.path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives in the manifest: (page_id, url, record_id, record_type, payload_bytes, payload_digest,
    refers_to_id, payload). A response's digest and length are those of the payload as read; a mismatch with its headers
    is an error. Null payload for revisits, whose length is that of the HTTP headers they repeat."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(path)
        names = ["page_id", "url", "record_id", "record_type", "payload_bytes", "payload_digest", "refers_to_id", "payload"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(f"{root}/{file}", compression=None) as source:
                    for head, block in records(source):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
                        if kind == "response" and (len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                            raise ValueError(f"{head['WARC-Record-ID']} is damaged")
                        page = head["X-Page-Id"]
                        rows.append((int(page) if page else None, head.get("WARC-Target-URI"), head["WARC-Record-ID"], kind, length, digest, head.get("WARC-Refers-To"), payload if kind == "response" else None))
                        size += len(payload)
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)

    files = spark.read.parquet(f"{path}/manifest").select("file")
    return files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file").mapInArrow(
        read, "page_id long, url string, record_id string, record_type string, payload_bytes long, payload_digest string, refers_to_id string, payload binary"
    )


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes the archives to the shared folder, reads them back and joins revisits to their responses."""
    path = scratch(pages.sparkSession, "warc")
    write_archives(pages, path, min_bytes)
    read = stored(read_archives(pages.sparkSession, path).drop("payload", "url"), "warc-headers")
    responses = read.where("record_type = 'response'").groupBy("record_id").agg(F.min("page_id").alias("refers_to"))
    wanted = read.where("record_type = 'revisit'").select("refers_to_id").distinct()
    targets = responses.join(wanted, responses["record_id"] == wanted["refers_to_id"], "inner").drop("record_id")
    return read.join(targets, "refers_to_id", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
