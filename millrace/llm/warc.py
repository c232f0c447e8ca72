"""WARC archives: a deterministic sharded writer, and the reader that gives the records back."""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import dropped, kept, shared_dir

#: Bytes of payload in a shard, and compressed bytes from which a shard's file is closed and the next begun.
SHARD_BYTES, FILE_BYTES = 64 << 20, 16 << 20
#: Bytes of payload from which equal payloads are written once.
REVISIT_BYTES = 1000
#: Distinct ids whose sizes one task adds up to lay the shards out.
STRIP = 1_000_000
LOWEST = -(2**63)
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, shard int, part int, records bigint, first_id bigint, last_id bigint, bytes bigint, sha1 string"


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _record_id(page: int, digest: str, copy: int) -> str:
    return f"<urn:page:{'null' if page == LOWEST else page}:{digest[:16]}:{copy}>"


def _page_of(record_id: str) -> int | None:
    name = record_id.strip("<>").split(":")[2]
    return None if name == "null" else int(name)


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n") + z.flush()


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page: int, url: str | None, payload: bytes, refers_to: int | None, copy: int = 0) -> bytes:
    """One gzip member: a response with its payload, or a revisit with the HTTP head only. Headers and digests follow from the row alone."""
    digest = hashlib.sha1(payload).hexdigest()
    uri = re.sub(r"[\x00-\x20\x7f<>]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{'null' if page == LOWEST else page}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _record_id(page, digest, copy)), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", _sha1(payload)), ("WARC-Block-Digest", _sha1(block)), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        headers += [("WARC-Profile", REVISIT), ("WARC-Refers-To", _record_id(refers_to, digest, 0))]
    return _member(headers, block)


def revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, digest, refers_to) of the records that repeat the payload of a record with a larger id; payloads by length and two digests."""
    slim = pages.select("page_id", F.octet_length("html").alias("n"), F.sha1("html").alias("digest"), F.xxhash64("html").alias("x")).where(F.col("n") >= least)
    same = slim.groupBy("n", "digest", "x").agg(F.max("page_id").alias("top"), F.count("*").alias("c")).where("c > 1").withColumnsRenamed({"n": "n_", "digest": "digest_", "x": "x_"})
    met = slim.join(same, (F.col("digest") == F.col("digest_")) & (F.col("n") == F.col("n_")) & (F.col("x") == F.col("x_")))
    return met.where("page_id <= top").select("page_id", "digest", F.col("top").alias("refers_to")).distinct()


def shard_starts(base: DataFrame, shard_bytes: int) -> np.ndarray:
    """The first page_id of each shard: ids in ascending order are dealt out by the bytes before them, shard_bytes to a shard.

    Sizes are added up by id, ranges of ids sorted in tasks of their own, and the ranges' totals put before
    them; where the ranges are cut does not show in the result. One number a shard comes to the driver.
    """
    sizes = base.groupBy("page_id").agg(F.sum(F.octet_length("html").cast("bigint") + 512).alias("n"))
    strips = max(1, -(-base.count() // STRIP))
    laid = kept(sizes.repartitionByRange(strips, "page_id").withColumn("strip", F.spark_partition_id()), "sizes")
    totals = sorted(laid.groupBy("strip").agg(F.sum("n")).collect())
    before = dict(zip((t[0] for t in totals), np.cumsum([0, *(int(t[1]) for t in totals)]).tolist()))
    base_of = F.element_at(F.array(*[F.lit(before.get(k, 0)) for k in range(max(before, default=0) + 1)]), F.col("strip") + 1)
    up_to = F.sum("n").over(W.partitionBy("strip").orderBy("page_id"))
    starts = laid.withColumn("at", base_of + up_to - F.col("n")).groupBy(F.expr(f"at DIV {shard_bytes}").alias("shard")).agg(F.min("page_id").alias("first"))
    out = np.array(sorted(r.first for r in starts.select("first").collect()), np.int64)
    dropped(laid)
    return out


def _dealt(spark: SparkSession, starts: np.ndarray) -> tuple[Column, Column]:
    """The shard of a page_id, and a number that hash partitioning into as many partitions as there are shards sends to one of its own."""
    n = max(len(starts), 1)
    tries = spark.range(int(n * (8 + 2 * np.log(n))) + 64).select(F.col("id").cast("int").alias("id"))
    found = dict(tries.groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("r")).agg(F.min("id")).collect())
    slots = spark.sparkContext.broadcast((starts, np.array([found.get(k, k) for k in range(n)], np.int32)))

    @F.pandas_udf("int")
    def shard_of(page_id: pd.Series) -> pd.Series:
        return pd.Series(np.maximum(np.searchsorted(slots.value[0], page_id.to_numpy(), side="right") - 1, 0).astype(np.int32))

    @F.pandas_udf("int")
    def slot_of(shard: pd.Series) -> pd.Series:
        return pd.Series(slots.value[1][shard.to_numpy()])

    return shard_of(F.col("page_id")), slot_of(F.col("shard"))


def write(pages: DataFrame, to: str, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record for each row of pages (page_id, url, html) below `to`; the manifest, a row for each file.

    Shards are ranges of page_id, laid out by exact byte counts, so the same rows give the same files
    byte for byte; each is sorted and written by a task of its own. Rows that share a page_id are in one shard. A task writes a file under a temporary name and renames it when it is whole; a task
    that is run again writes the same bytes to the same name. The manifest is written last and is the
    commit: files that it does not name do not belong to the archive.

    Null html is an empty payload. Payloads are compared whole; of equal ones of at least
    REVISIT_BYTES the one with the largest page_id is the response, and if rows share that id the first
    of them. A null page_id is the smallest. An empty table gives an empty manifest.
    """
    spark = pages.sparkSession
    base = pages.select(F.coalesce(F.col("page_id").cast("bigint"), F.expr("-9223372036854775807L - 1L")).alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    starts = shard_starts(base, shard_bytes)
    # a revisit's decision comes as a row of its own just before the page, so the page's bytes are moved once
    rows = base.select("page_id", F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("bigint").alias("refers_to"))
    notes = revisits(base).select("page_id", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.col("digest").alias("html"), "refers_to")
    shard_of, slot_of = _dealt(spark, starts)
    both = rows.union(notes).withColumn("shard", shard_of).withColumn("slot", slot_of)
    both = both.repartition(max(len(starts), 1), "slot").sortWithinPartitions("shard", "page_id", "kind", "html", "url")
    file_system, root = _file_system(to)
    file_system.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _file_system(to)
        now: dict = {}
        done: list[tuple] = []

        def close() -> None:
            if now.get("out"):
                now["out"].close()
                name = f"pages-{now['shard']:06d}-{now['part']:05d}.warc.gz"
                fs.move(now["tmp"], f"{root}/{name}")
                done.append((name, now["shard"], now["part"], now["n"], now["first"], now["last"], now["bytes"], now["sha"].hexdigest()))
                now["out"] = None

        def put(data: bytes) -> None:
            now["out"].write(data)
            now["sha"].update(data)
            now["bytes"] += len(data)

        def opened(shard: int, part: int, page: int) -> None:
            now.update(shard=shard, part=part, n=0, first=page, bytes=0, sha=hashlib.sha1(), tmp=f"{root}/.tmp-{uuid.uuid4().hex}")
            now["out"] = fs.open_output_stream(now["tmp"])
            info = f"software: millrace\r\nformat: WARC File Format 1.1\r\nshard: {shard}\r\npart: {part}\r\n".encode()
            put(_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:shard:{shard}:{part}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], info))

        page_now, notes, copies = None, {}, {}
        for batch in batches:
            for shard, page, kind, url, html, refers in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("shard", "page_id", "kind", "url", "html", "refers_to"))):
                shard, page = shard.as_py(), page.as_py()
                if page != page_now:
                    page_now, notes, copies = page, {}, {}
                if kind.as_py() == 0:
                    notes[html.as_py()] = refers.as_py()
                    continue
                payload = html.as_buffer().to_pybytes()
                digest = hashlib.sha1(payload).hexdigest()
                copy = copies.get(digest, 0)
                copies[digest] = copy + 1
                to_page = notes.get(digest) if len(payload) >= REVISIT_BYTES else None
                if to_page == page and copy == 0:
                    to_page = None
                if not now.get("out") or now["shard"] != shard:
                    close()
                    opened(shard, 0, page)
                elif now["bytes"] >= file_bytes:
                    part = now["part"] + 1
                    close()
                    opened(shard, part, page)
                put(record(page, url.as_py(), payload, to_page, copy))
                now["n"], now["last"] = now["n"] + 1, page
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["file", "shard", "part", "records", "first_id", "last_id", "bytes", "sha1"])

    manifest = both.select("shard", "page_id", "kind", "url", "html", "refers_to").mapInArrow(run, MANIFEST)
    manifest.write.parquet(f"{to}/manifest")
    for x in file_system.get_file_info(__import__("pyarrow").fs.FileSelector(root)):  # what lost tasks have left
        if x.base_name.startswith(".tmp-"):
            file_system.delete_file(x.path)
    return spark.read.schema(MANIFEST).parquet(f"{to}/manifest")


def members(stream: io.RawIOBase) -> Iterator[bytes]:
    """The gzip members of a file, one after another."""
    z, parts, data = zlib.decompressobj(31), [], b""
    while True:
        data = data or stream.read(1 << 18)
        if not data:
            return
        parts.append(z.decompress(data))
        data = z.unused_data
        if z.eof:
            yield b"".join(parts)
            z, parts = zlib.decompressobj(31), []


def parsed(raw: bytes) -> tuple[dict, bytes]:
    head, _, block = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return headers, block[: int(headers["Content-Length"])]


def read(spark: SparkSession, at: str, payloads: bool = True) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, and html where asked for, of every record that the manifest's files hold.

    Digests are taken anew from responses and compared with their headers; a file that is not as the
    manifest says, or a record that is not as its headers say, is an error.
    """
    files = spark.read.schema(MANIFEST).parquet(f"{at}/manifest").select("file", "records")
    files = files.repartition(max(1, min(files.count(), 10_000)), "file")
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["html"] if payloads else [])]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *([pa.string()] if payloads else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _file_system(at)
        for batch in batches:
            for file, want in zip(*(c.to_pylist() for c in batch.columns)):
                rows: list[tuple] = []
                seen = held = 0
                with fs.open_input_stream(f"{root}/{file}", compression=None) as stream:
                    for raw in members(stream):
                        h, block = parsed(raw)
                        if h["WARC-Type"] == "warcinfo":
                            continue
                        if _sha1(block) != h["WARC-Block-Digest"]:
                            raise ValueError(f"{file}: {h['WARC-Record-ID']} is damaged")
                        http, _, payload = block.partition(b"\r\n\r\n")
                        n = int(re.search(rb"(?i)content-length: (\d+)", http)[1])
                        digest = base64.b32decode(h["WARC-Payload-Digest"][5:]).hex()
                        response = h["WARC-Type"] == "response"
                        if response and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
                            raise ValueError(f"{file}: the payload of {h['WARC-Record-ID']} is damaged")
                        row = (_page_of(h["WARC-Record-ID"]), h["WARC-Target-URI"], n, digest, h["WARC-Type"], None if response else _page_of(h["WARC-Refers-To"]))
                        rows.append(row + ((payload.decode() if response else None,) if payloads else ()))
                        seen, held = seen + 1, held + len(block) * payloads + 200
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                            rows, held = [], 0
                if seen != want:
                    raise ValueError(f"{file} holds {seen} records, not {want}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", html string" * payloads
    return files.mapInArrow(run, schema)


def report(pages: DataFrame, to: str | None = None) -> DataFrame:
    """Write pages and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    to = to or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, to)
    return read(spark, to, payloads=False).drop("url")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h) AS n, sha1(h) AS d, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to FROM q
"""
