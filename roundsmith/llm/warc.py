"""WARC archives in zstandard: one frame for each record, the dictionary in a leading skippable frame.

The writer stores each payload once: of records with equal payloads of at least REVISIT_BYTES, that with
the largest page id is a response and the others are revisit records that refer to it. The reader loads
the dictionary from the leading skippable frame, decodes one frame for each record and checks versions,
headers, lengths and digests.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from roundsmith.llm import storage

REVISIT_BYTES = 1000
SKIPPABLE, ZSTD_MAGIC, DICT_MAGIC = b"\x5d\x2a\x4d\x18", b"\x28\xb5\x2f\xfd", b"\x37\xa4\x30\xec"
#: A file's dictionary comes from its first records; any dictionary gives the same records back.
DICT_RECORDS, DICT_BYTES, DICT_SAMPLE_BYTES = 64, 16 << 10, 64 << 10
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
#: A repeated payload is common from HOT_ROWS rows on, or a HOT_KEYS-th of all rows with a repeated payload if that
#: is more: so at most HOT_KEYS are, and their list (48 bytes each) is broadcast.
HOT_ROWS, HOT_KEYS = 10_000, 100_000
SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


class WarcError(ValueError):
    """A record or archive that breaks the format."""


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def _page_of(urn: str) -> int | None:
    m = re.fullmatch(r"<urn:x-page:(null|-?[0-9]+)>", urn)
    if not m:
        raise WarcError(f"record id {urn!r}")
    return None if m[1] == "null" else int(m[1])


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record; a revisit (refers_to given) holds the HTTP head alone, which states the full length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", url)))
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Fields of SCHEMA, after checks."""
    end = raw.find(b"\r\n\r\n")
    lines = raw[:end].decode().split("\r\n") if end >= 0 else [""]
    if lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError(f"version line {lines[0][:40]!r}")
    head = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or name in head:
            raise WarcError(f"header line {line[:80]!r}")
        head[name] = value.strip()
    for name in REQUIRED:
        if name not in head:
            raise WarcError(f"{name} is missing")
    block = raw[end + 4 : -4]
    if raw[-4:] != b"\r\n\r\n" or head["Content-Length"] != str(len(block)):
        raise WarcError(f"Content-Length {head['Content-Length']}, the block has {len(block)} bytes")
    if head.get("WARC-Block-Digest", "") != f"sha1:{hashlib.sha1(block).hexdigest()}":
        raise WarcError("the block digest does not fit")
    http, _, body = block.partition(b"\r\n\r\n")
    m = re.search(rb"\r\nContent-Length: ([0-9]+)", http)
    kind, digest = head["WARC-Type"], head.get("WARC-Payload-Digest", "").removeprefix("sha1:")
    if kind not in ("response", "revisit") or not m or not http.startswith(b"HTTP/1."):
        raise WarcError(f"type {kind!r} or its HTTP head")
    if kind == "response" and (len(body) != int(m[1]) or hashlib.sha1(body).hexdigest() != digest):
        raise WarcError("the payload does not fit its length and digest")
    if kind == "revisit" and (body or "WARC-Refers-To" not in head):
        raise WarcError("a revisit with a payload, or without a record to refer to")
    url = head.get("WARC-Target-URI")
    return {"page_id": _page_of(head["WARC-Record-ID"]), "url": url and re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)) if int(m[1], 16) <= 32 or m[1] in ("25", "7F") else m[0], url), "payload_bytes": int(m[1]), "payload_digest": digest, "record_type": kind, "refers_to": _page_of(head["WARC-Refers-To"]) if kind == "revisit" else None, "payload": body if kind == "response" else None}


class ArchiveWriter:
    """Streams records into one archive; DICT_RECORDS of them wait for the dictionary."""

    def __init__(self, uri: str):
        self.fs, self.path = storage.open_fs(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.own = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out, self.first, self.zstd, self.n = self.fs.open_output_stream(self.own, compression=None), [], None, 0

    def add(self, record: bytes) -> None:
        self.n += 1
        if self.zstd is None:
            self.first.append(record)
            if len(self.first) >= DICT_RECORDS:
                self._begin()
        else:
            self.out.write(self.zstd.compress(record))

    def _begin(self) -> None:
        try:
            words = zstandard.train_dictionary(DICT_BYTES, [r[:DICT_SAMPLE_BYTES] for r in self.first]).as_bytes()
        except zstandard.ZstdError:  # too few or too small records to train on
            words = b""
        if words:
            self.out.write(SKIPPABLE + len(words).to_bytes(4, "little") + words)
        self.zstd = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(words) if words else None, write_checksum=True, write_content_size=True)
        for r in self.first:
            self.out.write(self.zstd.compress(r))
        self.first = []

    def close(self) -> None:
        if self.zstd is None:
            self._begin()
        self.out.close()
        storage.replace(self.fs, self.own, self.path)


def read_archive(f: BinaryIO, step: int = 1 << 20) -> Iterator[dict]:
    """The records of an archive, one frame each; holds one record and step bytes."""
    raw, words = f.read(step), None
    if raw[:4] == SKIPPABLE:
        size = int.from_bytes(raw[4:8], "little")
        while len(raw) < 8 + size:
            more = f.read(step)
            if not more:
                raise WarcError("the dictionary frame is cut off")
            raw += more
        body, raw = raw[8 : 8 + size], raw[8 + size :]
        if body[:4] == ZSTD_MAGIC:
            body = zstandard.ZstdDecompressor().decompress(body)
        if body[:4] != DICT_MAGIC:
            raise WarcError("the leading frame holds no dictionary")
        words = zstandard.ZstdCompressionDict(body)
    unzstd, k = zstandard.ZstdDecompressor(dict_data=words) if words else zstandard.ZstdDecompressor(), 0
    while raw or (raw := f.read(step)):
        frame, out = unzstd.decompressobj(), []
        while not frame.eof:
            if not raw and not (raw := f.read(step)):
                raise WarcError(f"record {k}: the frame is cut off")
            try:
                out.append(frame.decompress(raw))
            except zstandard.ZstdError as e:
                raise WarcError(f"record {k}: {e}") from e
            raw = frame.unused_data
        try:
            yield parse_record(b"".join(out))
        except WarcError as e:
            raise WarcError(f"record {k}: {e}") from e
        k += 1


def write_archives(pages: DataFrame, folder: str, hot_rows: int = HOT_ROWS) -> list:
    """Writes pages (page_id, url, html) as archives, one for each task; returns (file, n_records) rows.

    A null html has an empty payload, a null url no target URI. Rows that repeat the largest page id of
    a payload are all responses; a null page id counts as the least, and where all are null no record
    is a revisit. Other columns are ignored; an empty table gives no archive. hot_rows: as HOT_ROWS.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload")).withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= REVISIT_BYTES
    # one row for each repeated payload, summed in each task before it is shuffled
    last = rows.where(large).groupBy("digest").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).where("n > 1 and keep is not null")
    last = storage.saved(last, "payloads")
    common = F.col("n") >= max(hot_rows, -(-(last.agg(F.sum("n")).first()[0] or 0) // HOT_KEYS))
    rows = rows.join(F.broadcast(last.where(common).select("digest", F.col("keep").alias("hot"))), "digest", "left")
    # rows of other large payloads meet at their digest, all others are spread: no task gets a common payload whole
    spread = F.concat(F.lit("-"), F.xxhash64(F.spark_partition_id(), "page_id", "url").cast("string"))
    rows = rows.withColumn("at", F.when(large & F.col("hot").isNull(), F.col("digest")).otherwise(spread))
    rows = rows.join(last.where(~common).select(F.col("digest").alias("at"), F.col("keep").alias("cold")), "at", "left").withColumn("keep", F.coalesce("hot", "cold"))
    rows = rows.select("page_id", "url", "payload", "digest", F.when(F.coalesce("page_id", F.lit(-(2**63))) < F.col("keep"), F.col("keep")).alias("refers"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out, uri = None, f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.zst"
        for batch in batches:
            for i in range(batch.num_rows):
                out = out or ArchiveWriter(uri)
                out.add(make_record(*(batch.column(k)[i].as_py() for k in range(5))))
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [uri], "n_records": [out.n]})

    files = rows.mapInArrow(write, "file string, n_records long").collect()
    storage.drop(last)
    return files


def read_archives(spark: SparkSession, files: list, payloads: bool = True) -> DataFrame:
    """All records of archives, as in SCHEMA (payload null for revisits, and left out unless asked for)."""
    schema = SCHEMA if payloads else SCHEMA.rpartition(",")[0]
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]]) for n, c in zip(names, schema.split(", "), strict=True)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = storage.open_fs(row["file"])
                held, size, n = [], 0, 0
                with fs.open_input_stream(path, compression=None) as f:
                    for r in read_archive(f):
                        held.append({k: r[k] for k in names})
                        size, n = size + len(r["payload"] or b"") * payloads, n + 1
                        if len(held) >= 2000 or size > 16 << 20:
                            yield pa.RecordBatch.from_pylist(held, kinds)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, kinds)
                if n != row["n_records"]:
                    raise WarcError(f"{row['file']}: {n} records, {row['n_records']} were written")

    return spark.createDataFrame([(f["file"], f["n_records"]) for f in files], "file string, n_records long").repartition(max(1, len(files))).mapInArrow(read, schema)


def op4_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through archives: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    files = write_archives(storage.table(spark, sf_dir, "pages"), storage.fresh(spark, "warc"))
    return read_archives(spark, files, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS digest FROM p),
m AS (SELECT digest, max(page_id) AS keep FROM d WHERE n >= 1000 GROUP BY digest)
SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN m.keep IS NOT NULL AND d.page_id < m.keep THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN m.keep IS NOT NULL AND d.page_id < m.keep THEN m.keep END AS refers_to
FROM d LEFT JOIN m ON d.digest = m.digest AND d.n >= 1000
"""
