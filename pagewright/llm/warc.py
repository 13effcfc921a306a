"""WARC archives compressed with Zstandard, one frame per record and a shared dictionary.

An archive begins with a skippable frame that holds the dictionary; each record is one
frame. The writer puts archives of bounded size into the shared folder and commits their
names in a manifest table, so an attempt that is lost or runs twice leaves no record
twice; the reader takes the files that the manifest lists.

Payloads: the html in UTF-8; a null html is an empty payload. Of rows with equal payloads
of at least MIN_REVISIT bytes the largest page_id is the response (rows that repeat that
id and payload are responses too), the others are revisits and carry no payload. A null
page_id is smaller than any other; a null url leaves its header out. An empty table gives
no archive and no row. Further columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import io
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

MIN_REVISIT = 1000
#: Bytes after which a writer begins the next archive; only a single larger record exceeds it.
ARCHIVE_BYTES = 256 << 20
#: Bytes that a reader takes at a time, and the most tasks that read archives.
CHUNK, READERS = 4 << 20, 20_000
#: Fixed value: the header that a record may have more than once.
REPEATED = "warc-concurrent-to"
DICTIONARY_BYTES, DICTIONARY_ROWS = 48 << 10, 256
#: Magic numbers of Zstandard frames and of a dictionary's skippable frame.
FRAME, DICTIONARY_FRAME, SKIPPABLE = 0xFD2FB528, 0x184D2A5D, range(0x184D2A50, 0x184D2A60)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


class BadArchive(ValueError):
    """What is wrong with an archive, and where."""


def sha1_header(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id, url, kind, refers_to, payload: bytes, digest: str, size: int, refers_url=None) -> bytes:
    """One WARC/1.1 record. digest and size are of the full payload, also for a revisit without one."""
    clean = lambda s: s.replace("\r", "%0D").replace("\n", "%0A")
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>"), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url is not None:
        head.append(("WARC-Target-URI", clean(url)))
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    head += [("WARC-Payload-Digest", digest), ("X-Payload-Length", str(size))]
    if kind == "revisit":
        head += [("WARC-Profile", PROFILE), ("X-Refers-To-Page-ID", str(refers_to))]
        if refers_url is not None:
            head.append(("WARC-Refers-To-Target-URI", clean(refers_url)))
        block = b""
    else:
        block = payload
    head += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers, block and type of a record; raises BadArchive where headers or lengths don't hold. Values of a header that may be repeated are joined by line breaks."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise BadArchive("the header has no end")
    version, *lines = data[:end].decode("utf-8").split("\r\n")
    if version not in ("WARC/1.0", "WARC/1.1"):
        raise BadArchive(f"not a WARC version: {version[:20]!r}")
    head = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise BadArchive(f"not a header: {line[:60]!r}")
        name, value = name.lower(), value.strip()
        if name in head:
            if name != REPEATED:
                raise BadArchive(f"header twice: {name}")
            value = f"{head[name]}\n{value}"
        head[name] = value
    for need in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if need not in head:
            raise BadArchive(f"no header {need}")
    if not head["content-length"].isdigit():
        raise BadArchive("Content-Length is no number")
    size = int(head["content-length"])
    if len(data) != end + 4 + size + 4 or data[-4:] != b"\r\n\r\n":
        raise BadArchive(f"Content-Length {size} doesn't fit a record of {len(data)} bytes")
    block = data[end + 4 : end + 4 + size]
    kind = head["warc-type"]
    if kind == "response":
        if "warc-payload-digest" in head and head["warc-payload-digest"] != sha1_header(block):
            raise BadArchive("the payload doesn't have its digest")
        if head.get("x-payload-length", str(size)) != str(size):
            raise BadArchive("the payload doesn't have its length")
    elif kind == "revisit" and "warc-profile" not in head:
        raise BadArchive("a revisit without profile")
    return {"type": kind, "head": head, "block": block}


def _end(data: memoryview, at: int) -> int | None:
    """Where the frame at `at` ends, told by its block headers alone; None if data ends before that is known."""
    if len(data) - at < 8:
        return None
    magic, size = struct.unpack_from("<II", data, at)
    if magic in SKIPPABLE:
        return at + 8 + size
    if magic != FRAME:
        raise BadArchive("no frame where one should begin")
    d = data[at + 4]
    single = d >> 5 & 1
    end = at + 5 + (1 - single) + (0, 1, 2, 4)[d & 3] + (single, 2, 4, 8)[d >> 6]
    last = 0
    while not last:
        if end + 3 > len(data):
            return None
        b = data[end] | data[end + 1] << 8 | data[end + 2] << 16
        last, kind = b & 1, b >> 1 & 3
        if kind == 3:
            raise BadArchive("a frame has a reserved block")
        end += 3 + (1 if kind == 1 else b >> 3)
    return end + 4 * (d >> 2 & 1)


def frames(source) -> Iterator[tuple[int, memoryview]]:
    """(magic, frame) of each frame of a file, of which CHUNK bytes, or one larger frame, are held at a time."""
    data, at, ended = memoryview(b""), 0, False
    while True:
        end = _end(data, at)
        while (end is None or end > len(data)) and not ended:
            more = source.read(max(CHUNK, (end or 0) - len(data)))
            ended = not more
            data, end, at = memoryview(bytes(data[at:]) + bytes(more)), None, 0
            end = _end(data, at)
        if at == len(data):
            return
        if end is None or end > len(data):
            raise BadArchive(f"{len(data) - at} bytes at the end are no whole frame")
        yield struct.unpack_from("<I", data, at)[0], data[at:end]
        at = end


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary


def read_archive(source) -> Iterator[dict]:
    """Records of an archive (bytes or an open file), in order."""
    decoder = None
    for k, (magic, frame) in enumerate(frames(source if hasattr(source, "read") else io.BytesIO(source))):
        if magic in SKIPPABLE:
            if k == 0 and magic == DICTIONARY_FRAME:
                content = bytes(frame[8:])
                if content[:4] == struct.pack("<I", FRAME):
                    content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
                decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
            continue
        decoder = decoder or zstandard.ZstdDecompressor()
        try:
            known = zstandard.frame_content_size(frame)
            record = decoder.decompress(frame, allow_extra_data=False) if known >= 0 else decoder.stream_reader(frame).read()
        except zstandard.ZstdError as e:
            raise BadArchive(f"frame {k}: {e}") from e
        yield parse_record(record)


def train(samples: list[bytes]) -> bytes:
    """A dictionary from sample records; with too few of them to train on, their joined beginnings."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(s[:2048] for s in samples)[:DICTIONARY_BYTES] or b"WARC/1.1\r\n"


def _store(uri: str):
    """File system and path of a folder that all machines share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else os.path.abspath(uri))


def decisions(pages: DataFrame) -> DataFrame:
    """pages with payload_bytes, payload_digest, record_type and refers_to.

    Digests are grouped without the payloads; then each row gets its verdict by page_id and
    digest, so that no key of the join that moves payloads is hot.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    keyed = pages.select("page_id", "url", payload.alias("payload")).withColumn("payload_digest", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    large = C.written(keyed.where(F.col("payload_bytes") >= MIN_REVISIT).select("page_id", "url", "payload_digest"), "digests")
    shared = large.groupBy("payload_digest").agg(F.max("page_id").alias("_to"), F.max_by("url", F.coalesce("page_id", F.lit(-(2**63)))).alias("_to_url"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    again = large.select("page_id", "payload_digest").join(shared, "payload_digest").where(~F.col("page_id").eqNullSafe(F.col("_to"))).distinct().select(F.coalesce(F.col("page_id"), F.lit(-(2**63))).alias("_id"), F.col("payload_digest").alias("_digest"), "_to", "_to_url")
    out = keyed.join(again, (F.coalesce(keyed.page_id, F.lit(-(2**63))) == again["_id"]) & (keyed.payload_digest == again["_digest"]), "left")
    revisit = F.col("_to").isNotNull()
    return out.select("page_id", "url", "payload", "payload_digest", "payload_bytes", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.col("_to").alias("refers_to"), "_to_url")


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Archives of pages (page_id, url, html) in folder/data; returns folder. The manifest is folder/manifest.

    The dictionary is trained on at most DICTIONARY_ROWS pages; every page is written.
    """
    rows = pages.where("html IS NOT NULL").select(F.substring("html", 1, 16384).alias("html")).limit(DICTIONARY_ROWS).collect()
    samples = [record_bytes(0, "http://example.org/", "response", None, p, sha1_header(p), len(p)) for p in (r.html.encode() for r in rows)]
    dictionary = train(samples)
    data = folder.rstrip("/") + "/data"

    def run(batches):
        store, path = _store(data)
        store.create_dir(path, recursive=True)
        context = TaskContext.get()
        level = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
        name, out, size, n, seq = "", None, 0, 0, 0

        def close():
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["name", "records", "bytes"])

        for b in batches:
            for page_id, url, payload, digest, length, kind, to, to_url in zip(*(c.to_pylist() for c in b.columns)):
                digest = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
                frame = level.compress(record_bytes(page_id, url, kind, to, payload, digest, length, to_url))
                if out is not None and size + len(frame) > archive_bytes:
                    yield close()
                    out = None
                if out is None:
                    name = f"part-{context.partitionId():06d}-{seq:04d}-{context.taskAttemptId()}.warc.zst"
                    out, n, seq = store.open_output_stream(f"{path}/{name}", compression=None), 0, seq + 1
                    size = out.write(dictionary_frame(dictionary))
                size += out.write(frame)
                n += 1
        if out is not None:
            yield close()

    decisions(pages).mapInArrow(run, "name string, records long, bytes long").write.parquet(folder.rstrip("/") + "/manifest")
    return folder


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (RECORD) of the records in a folder that write_archives has filled; any flaw fails the job.

    Tasks open the archives that the manifest names, so nothing lists the folder and no archive is shuffled.
    """
    folder = folder.rstrip("/")
    manifest = spark.read.schema("name string, records long, bytes long").parquet(folder + "/manifest")
    archives = manifest.count()
    if not archives:
        return spark.createDataFrame([], RECORD)
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in RECORD.split(", ")]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * len(kinds), kinds)], names=names)

    def run(batches):
        store, path = _store(folder + "/data")
        for b in batches:
            for name, records, size in zip(*(c.to_pylist() for c in b.columns)):
                rows, held, n = [], 0, 0
                with store.open_input_file(f"{path}/{name}") as source:
                    if source.size() != size:
                        raise BadArchive(f"{name} has {source.size()} bytes, not {size}")
                    for r in read_archive(source):
                        h = r["head"]
                        to = h.get("x-refers-to-page-id")
                        rows.append((int(h["x-page-id"]) if "x-page-id" in h else None, h.get("warc-target-uri"), r["type"], int(to) if to else None, int(h.get("x-payload-length", len(r["block"]))), base64.b32decode(h["warc-payload-digest"].split(":", 1)[1]).hex(), r["block"]))
                        held, n = held + len(r["block"]), n + 1
                        if held > CHUNK:
                            yield batch(rows)
                            rows, held = [], 0
                if n != records:
                    raise BadArchive(f"{name} has {n} records, not {records}")
                yield batch(rows)

    return manifest.repartition(min(archives, READERS), "name").mapInArrow(run, RECORD)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = os.path.join(C.shared_dir(spark), f"warc-{uuid.uuid4().hex}")
    write_archives(C.read(spark, sf_dir, "pages"), folder)
    return read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS last_id FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest HAVING count(*) > 1)
SELECT p.page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN last_id IS NOT NULL AND p.page_id IS DISTINCT FROM last_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN last_id IS NOT NULL AND p.page_id IS DISTINCT FROM last_id THEN last_id END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND payload_bytes >= 1000
"""
