"""WARC archives as seekable Zstandard bundles.

A bundle is one file of independent Zstandard frames. Records are grouped into frames and never
straddle two. Two skippable frames end the file: an index that maps record ids to (frame, offset
within the frame, length), and the footer seek table of the seekable format, from which any frame
is found and decompressed alone. Bundles are written straight to shared storage under a name of their
own for each attempt of a task. Only the manifest says which count: a task that is run again writes other files, and those of a
lost or speculative attempt are never read. Nothing is moved or overwritten, which object stores couldn't do at once.

Payload digests cover the whole payload. Of records with equal payloads of at least 100 bytes the
one with the smallest id is a response and the others are revisits that refer to it; rows that share
that smallest id (repeated rows) are all responses, as is every row without an id. Null payloads are
empty. An empty table writes no bundle.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsieve.llm.common import prepare, utf8
from colsieve.session import materialize, shared_dir

#: Fixed values of the seekable Zstandard format.
SKIPPABLE_SEEK, SKIPPABLE_INDEX, SEEKABLE_MAGIC = 0x184D2A5E, 0x184D2A5D, 0x8F92EAB1
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 32 << 20
REVISIT_LEAST = 100


def record(warc_type: str, uri: str, date: str, payload: bytes, digest: str, size: int, rid: str, refers_to: str | None) -> bytes:
    """One WARC/1.1 record; a revisit has no block of its own."""
    block = payload if warc_type == "response" else b""
    head = [
        "WARC/1.1", f"WARC-Type: {warc_type}", f"WARC-Record-ID: <urn:record:{rid}>", f"WARC-Target-URI: {uri}", f"WARC-Date: {date}",
        "Content-Type: text/html; charset=utf-8", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Identified-Payload-Length: {size}", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:record:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    size = int(fields["Content-Length"])
    if len(rest) != size + 4:
        raise ValueError("a WARC record's length is wrong")
    return fields, rest[:size]


class BundleWriter:
    """Builds a bundle in memory, frame by frame; its size is bounded by the caller."""

    def __init__(self, frame_bytes: int = FRAME_BYTES):
        import zstandard

        self._compress = zstandard.ZstdCompressor(level=3, write_content_size=True).compress
        self._frame_bytes, self._out, self._frame, self._table, self._index = frame_bytes, io.BytesIO(), [], [], []
        self._held = 0
        self.raw_bytes = 0

    def add(self, rid: str, data: bytes) -> None:
        if self._held and self._held + len(data) > self._frame_bytes:
            self._flush()
        self._index.append((rid, len(self._table), self._held, len(data)))
        self._frame.append(data)
        self._held += len(data)
        self.raw_bytes += len(data)

    def _flush(self) -> None:
        if self._frame:
            packed = self._compress(b"".join(self._frame))
            self._table.append((len(packed), self._held))
            self._out.write(packed)
            self._frame, self._held = [], 0

    def finish(self) -> bytes:
        self._flush()
        index = self._compress(json.dumps(self._index).encode())
        self._out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        table = [*self._table, (len(index) + 8, 0)]
        entries = b"".join(struct.pack("<II", *e) for e in table)
        self._out.write(struct.pack("<II", SKIPPABLE_SEEK, len(entries) + 9) + entries + struct.pack("<IBI", len(table), 0, SEEKABLE_MAGIC))
        return self._out.getvalue()


class BundleReader:
    """Random access to a bundle: seek table first, then the index, then only the frames asked for."""

    def __init__(self, source, size: int):
        import zstandard

        self._read, self._decompress = source, zstandard.ZstdDecompressor().decompress
        frames, _, magic = struct.unpack("<IBI", source(size - 9, 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("not a seekable bundle")
        raw = source(size - 9 - 8 * frames, 8 * frames)
        self.frames, at = [], 0
        for packed, unpacked in struct.iter_unpack("<II", raw):
            self.frames.append((at, packed, unpacked))
            at += packed
        start, packed, _ = self.frames.pop()
        self.index = [tuple(e) for e in json.loads(self._decompress(source(start + 8, packed - 8)))]

    def frame(self, k: int) -> bytes:
        at, packed, unpacked = self.frames[k]
        return self._decompress(self._read(at, packed), max_output_size=unpacked)

    def records(self) -> Iterator[tuple[str, bytes]]:
        held, data = -1, b""
        for rid, k, at, n in self.index:
            if k != held:
                held, data = k, self.frame(k)
            yield rid, data[at : at + n]

    def get(self, rid: str) -> bytes:
        """One record by id; only its frame is read."""
        _, k, at, n = next(e for e in self.index if e[0] == rid)
        return self.frame(k)[at : at + n]


def open_bundle(uri: str) -> BundleReader:
    fs, path = pafs.FileSystem.from_uri(uri)
    file = fs.open_input_file(path)

    def source(at: int, n: int) -> bytes:
        file.seek(at)
        return file.read(n)

    return BundleReader(source, file.size())


def revisits(df: DataFrame, id_col: str, payload_col: str, least: int = REVISIT_LEAST) -> DataFrame:
    """(id, __digest, refers_to) of payloads that repeat an earlier row's. Only ids and digests are shuffled.

    Digest groups are reduced by partial aggregates first; a hot digest is left to the skew join.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    narrow = df.select(F.col(id_col), F.sha2(payload.cast("binary"), 256).alias("__digest"), F.octet_length(payload).alias("__n"))
    narrow = narrow.filter((F.col("__n") >= least) & F.col(id_col).isNotNull()).drop("__n")
    first = narrow.groupBy("__digest").agg(F.min(id_col).alias("refers_to"), F.count(F.lit(1)).alias("__rows")).filter("__rows > 1").drop("__rows")
    return narrow.join(first, "__digest").filter(F.col(id_col) != F.col("refers_to")).select(id_col, "__digest", "refers_to").distinct()


def write_archives(df: DataFrame, uri: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2024-01-01T00:00:00Z", bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write one WARC record per row into bundles under `uri`; the manifest has a row per bundle.

    The manifest (bundle, records, bytes) is written once, so the archives are written once too.
    """
    prepare(df.sparkSession)
    late = revisits(df, id_col, payload_col)
    rows = df.select(F.col(id_col), F.col(url_col).cast("string").alias("__url"), F.col(payload_col).cast("string").alias("__payload"))
    rows = rows.withColumn("__digest", F.sha2(F.coalesce("__payload", F.lit("")).cast("binary"), 256))
    joined = rows.join(late, [id_col, "__digest"], "left").select(F.col(id_col).cast("string").alias("rid"), F.col("__url").alias("url"), F.when(F.col("refers_to").isNull(), F.col("__payload")).alias("payload"),
        F.col("__digest").alias("digest"), F.coalesce(F.octet_length("__payload"), F.lit(0)).cast("bigint").alias("size"), F.col("refers_to").cast("string").alias("refers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(uri)
        fs.create_dir(base, recursive=True)
        task, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        made: list[tuple[str, int, int]] = []
        writer: BundleWriter | None = None
        records = 0

        def close() -> None:
            data = writer.finish()
            name = f"bundle-{task:06d}-{len(made):05d}-{attempt}.warc.zst"
            with fs.open_output_stream(f"{base}/{name}", compression=None) as f:  # else the name would have it compressed again
                f.write(data)
            made.append((f"{uri}/{name}", records, len(data)))

        for batch in batches:
            payloads = utf8(batch, "payload")
            rest = [batch.column(c).to_pylist() for c in ("rid", "url", "digest", "size", "refers")]
            for payload, rid, url, digest, size, refers in zip(payloads, *rest, strict=True):
                if writer is None:
                    writer, records = BundleWriter(), 0
                kind = "response" if refers is None else "revisit"
                clean = " ".join((url or "").split()) or "about:blank"
                writer.add("" if rid is None else rid, record(kind, clean, date, payload or b"", digest, size, "" if rid is None else rid, refers))
                records += 1
                if writer.raw_bytes >= bundle_bytes:
                    close()
                    writer = None
        if writer is not None:
            close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*made, strict=True)], ["bundle", "records", "bytes"])

    return materialize(joined.mapInArrow(run, "bundle string, records bigint, bytes bigint"), "manifest")


def read_archives(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """Every record of the bundles: record_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload).

    Digest and length of a response are computed from the payload that is read and held against
    its headers; those of a revisit are its headers', which describe the payload it stands for.
    """
    spark = manifest.sparkSession
    schema = "record_id string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string" + (", payload binary" if with_payload else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def name_of(urn: str) -> str:
        return urn.removeprefix("<urn:record:").removesuffix(">")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("bundle").to_pylist():
                out: list[tuple] = []
                held = 0
                for rid, data in open_bundle(uri).records():
                    fields, payload = parse_record(data)
                    kind, digest, size = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["WARC-Identified-Payload-Length"])
                    if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
                        raise ValueError(f"record {rid} of {uri} doesn't match its digest")
                    refers = fields.get("WARC-Refers-To")
                    row = (rid or None, fields["WARC-Target-URI"], size, digest, kind, name_of(refers) if refers else None)
                    out.append((*row, payload) if with_payload else row)
                    held += len(payload) if with_payload else 0
                    if len(out) >= 5000 or held > 8 << 20:
                        yield _batch(out, names)
                        out, held = [], 0
                if out:
                    yield _batch(out, names)

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return manifest.repartition(parts, "bundle").mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names)


def round_trip(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write the archives into the shared folder and read them back, one row per record."""
    prepare(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString()
    manifest = write_archives(df, shared_dir(df.sparkSession, "warc"), id_col, url_col, payload_col)
    return read_archives(manifest).select(F.col("record_id").cast(id_type).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(id_type).alias("refers_to"))
