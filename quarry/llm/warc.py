"""WARC archives: writing monolithic gzip files, normalising them to one member per record with an offset index, reading."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, new_path

#: Uncompressed bytes after which a new archive file is begun.
ROLL_BYTES = 16 << 20
_LEVEL = 4
_URN = "<urn:uuid:{}>"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Put:
    """A file that appears under its name only when complete."""

    def __init__(self, folder: str, name: str):
        self.fs, base = _open(folder)
        self.fs.create_dir(base, recursive=True)
        self.final, self.temp = f"{base}/{name}", f"{base}/.{name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temp, compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.temp, self.final)


def record_id(kind: str, number: int) -> str:
    """A record id that holds a 64-bit number."""
    return _URN.format(uuid.UUID(int=(uuid.uuid5(uuid.NAMESPACE_URL, kind).int >> 64 << 64) | (number & (1 << 64) - 1)))


def record_number(urn: str) -> int:
    n = uuid.UUID(urn[10:-1]).int & (1 << 64) - 1
    return n - (1 << 64) if n >> 63 else n


def build_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _one_line(value: str | None) -> str:
    return "" if value is None else " ".join(value.split())


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit that names the response with the same payload and leaves the payload out."""
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id("page", page_id) if page_id is not None else _URN.format(uuid.uuid5(uuid.NAMESPACE_URL, f"{digest}{url}"))),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", _one_line(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    if page_id is None:
        headers.append(("X-No-Number", "1"))
    if refers_to is not None:
        headers += [("WARC-Refers-To", record_id("page", refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    return build_record(headers, http if refers_to is not None else http + payload)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    headers = {}
    for line in lines[1:]:
        k, _, v = line.partition(":")
        headers[k.strip().lower()] = v.strip()
    return headers, rest[: int(headers["content-length"])]


def inflate(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The content of a gzip stream of one or more members, piece by piece."""
    d = zlib.decompressobj(31)
    for c in chunks:
        while c:
            yield d.decompress(c, 1 << 20)
            c = d.unconsumed_tail
            if d.eof:
                c, d = d.unused_data, zlib.decompressobj(31)
    yield d.flush()


def split_records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The records of an inflated archive; only one record and one piece are held at a time."""
    held = bytearray()
    need = -1
    for p in pieces:
        held += p
        while True:
            if need < 0:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                for line in bytes(held[:end]).split(b"\r\n")[1:]:
                    if line.lower().startswith(b"content-length:"):
                        need = end + 4 + int(line.split(b":", 1)[1]) + 4
                if need < 0:
                    raise ValueError("a record without a length")
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = -1
    if held.strip():
        raise ValueError("the archive ends inside a record")


def normalise(chunks: Iterator[bytes], put, level: int = _LEVEL) -> list[dict]:
    """Inflate a whole-file stream once and put every record as a gzip member of its own; returns the offset index."""
    index, offset = [], 0
    for record in split_records(inflate(chunks)):
        c = zlib.compressobj(level, zlib.DEFLATED, 31)
        member = c.compress(record) + c.flush()
        put(member)
        headers, _ = parse_record(record[: record.find(b"\r\n\r\n") + 4])
        index.append({"offset": offset, "length": len(member), "id": headers.get("warc-record-id"), "type": headers.get("warc-type"), "uri": headers.get("warc-target-uri")})
        offset += len(member)
    return index


def _stream(path: str, size: int = 1 << 20) -> Iterator[bytes]:
    files, p = _open(path)
    with files.open_input_stream(p, compression=None) as f:
        while chunk := f.read(size):
            yield bytes(chunk)


def write_archives(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """pages (page_id, url, payload, digest, refers_to) -> (path, records): archives that are one gzip stream each.
    A partition rolls over to another file after ``roll_bytes``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        # names hold the attempt, so that a task that runs twice never writes over files that are already listed
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        n, out, z, held, count, made = 0, None, None, 0, 0, []

        def done():
            out.write(z.flush())
            out.close()
            made.append((f"{folder}/{os.path.basename(out.final)}", count))

        for df in batches:
            for page, url, payload, digest, refers in df[["page_id", "url", "payload", "digest", "refers_to"]].itertuples(index=False):
                if out is None:
                    out, z, held, count = _Put(folder, f"part-{part:05d}-{attempt}-{n:04d}.warc.gz"), zlib.compressobj(_LEVEL, zlib.DEFLATED, 31), 0, 0
                    n += 1
                    info = build_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("info", part << 20 | n)), ("WARC-Date", "1970-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    out.write(z.compress(info))
                record = page_record(None if page is None else int(page), url, bytes(payload), digest, None if refers is None else int(refers))
                out.write(z.compress(record))
                held, count = held + len(record), count + 1
                if held >= roll_bytes:
                    done()
                    out = None
        if out is not None:
            done()
        yield pd.DataFrame(made, columns=["path", "records"])

    # ids go through as text: a column of whole numbers with nulls would turn into floats
    safe = pages.select(F.col("page_id").cast("string"), "url", "payload", "digest", F.col("refers_to").cast("string"))
    return cut(safe.mapInPandas(run, "path string, records long"), "archives")


def normalise_archives(archives: DataFrame, folder: str) -> DataFrame:
    """(path, …) -> (path, index): archives of one member per record, each with a sidecar index of JSON lines."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        for df in batches:
            for path in df["path"]:
                name = os.path.basename(path).removesuffix(".warc.gz") + f"-{TaskContext.get().taskAttemptId()}.warc.gz"
                out = _Put(folder, name)
                index = normalise(_stream(path), out.write)
                out.close()
                side = _Put(folder, name.removesuffix(".warc.gz") + ".index.jsonl")
                side.write("".join(json.dumps(x) + "\n" for x in index).encode())
                side.close()
                yield pd.DataFrame([(f"{folder}/{name}", f"{folder}/{os.path.basename(side.final)}")], columns=["path", "index"])

    n = max(1, archives.count())
    return cut(archives.repartition(min(n, 10_000)).mapInPandas(run, "path string, index string"), "normalised")


def read_archives(archives: DataFrame) -> DataFrame:
    """(path, index) -> one row per response and revisit record: page_id, url, payload_bytes, payload_digest,
    record_type, refers_to, payload (null for revisits). Each record is inflated from its offset alone; a response's
    payload is checked against its digest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for path, side in zip(df["path"], df["index"], strict=True):
                index = [json.loads(x) for x in b"".join(_stream(side)).splitlines()]
                files, p = _open(path)
                rows, held = [], 0
                with files.open_input_file(p) as f:
                    for x in index:
                        if x["type"] not in ("response", "revisit"):
                            continue
                        f.seek(x["offset"])
                        headers, block = parse_record(zlib.decompress(f.read(x["length"]), 31))
                        digest = headers["warc-payload-digest"].removeprefix("sha1:")
                        payload = None
                        if x["type"] == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            if hashlib.sha1(payload).hexdigest() != digest:
                                raise ValueError(f"payload of {x['id']} does not match its digest")
                        refers = headers.get("warc-refers-to")
                        rows.append(
                            (
                                None if "x-no-number" in headers else str(record_number(x["id"])), x["uri"] or None, int(headers["x-payload-length"]),
                                digest, x["type"], None if refers is None else str(record_number(refers)), payload,
                            )
                        )
                        held += len(block)
                        if held > 8 << 20:
                            yield pd.DataFrame(rows, columns=_COLUMNS)
                            rows, held = [], 0
                yield pd.DataFrame(rows, columns=_COLUMNS)

    n = max(1, archives.count())
    out = archives.repartition(min(n, 10_000)).mapInPandas(
        run, "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary"
    )
    return out.withColumns({"page_id": F.col("page_id").cast("long"), "refers_to": F.col("refers_to").cast("long")})


_COLUMNS = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): of equal payloads of at least ``least`` bytes that of the largest id
    is the response, the others refer to it. Rows that repeat that id are all responses; a group of null ids has no
    response to name, so each stands for itself."""
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    size = F.octet_length("payload")
    light = rows.select("page_id", "digest", size.alias("n")).filter(F.col("n") >= least)
    best = light.groupBy("digest", "n").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("k")).filter("k > 1 and response is not null")
    best = cut(best.select("digest", F.col("n").alias("_n"), "response"), "responses")
    return rows.join(best, (rows["digest"] == best["digest"]) & (size == best["_n"]), "left").select(
        "page_id", "url", "payload", rows["digest"],
        F.when(F.col("page_id").eqNullSafe(F.col("response")), F.lit(None)).otherwise(F.col("response")).alias("refers_to"),
    )


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000) -> DataFrame:
    """Write a record per row, normalise the archives, and read them back: page_id, url, payload_bytes, payload_digest,
    record_type, refers_to, payload.

    Null html is an empty payload; white space in a url becomes one space and an empty or null url reads back as null;
    a null id is kept. Repeated rows are records of their own; an empty table gives no rows.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    rough = write_archives(with_revisits(pages, id_col, url_col, html_col, least), new_path(spark, "warc-rough"))
    return read_archives(normalise_archives(rough, new_path(spark, "warc")))
