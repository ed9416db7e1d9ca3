"""WARC archives of web pages in Zstandard, with a dictionary per archive.

Writing: a record per page. Of pages with equal payloads of at least ``least_bytes``
the one with the smallest page_id is a response, the others are revisits of it; the
rest are responses. Who is first of its digest is found on (page_id, digest) pairs alone,
pre-aggregated; the digests with the most copies, a bounded number, are broadcast back to
their pages and only the others joined, so a payload that a third of all pages share meets
in no task. A revisit names the record id of its response, which follows from page_id and
digest, so any reader can follow it. Each partition becomes one archive in the shared folder: a skippable frame that holds the
dictionary, a warcinfo record, then one Zstandard frame per record. Archives are
written under a name of the attempt and then renamed, so a repeated task replaces its
own file; the list of archives is itself a durable table.

Reading: the dictionary comes from the leading skippable frame (as it is or itself
compressed), every further frame is one record. The version line, the required
headers, the block's length, the record's end and the payload's length and digest
are validated. Archives are streamed; memory holds one record.

Cases: null html counts as empty; a null page_id is written as a response of its own
and never referred to; null urls become ``urn:page:ID``; control characters in a url
are percent-coded; repeated rows are records of their own, and of equal page_ids
exactly one row is the response; an empty table writes no archive and reads as no row; a
very long page is one record; further columns, whatever their names, are never read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, fresh_dir, pieces_of, shuffle_width

MAGIC = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
DICT_BYTES = 1 << 15
SAMPLE_BYTES = 1 << 22
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Digests that are broadcast, and the copies from which on one is.
HOT_DIGESTS, HOT_COPIES = 10_000, 50_000
_ID = re.compile(r"<urn:uuid:([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})>", re.IGNORECASE)
READ = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
    "url string, archive string, frame long, record_id string, refers_to_id string"
)


class WarcError(ValueError):
    """An archive or a record that breaks the format."""


def response_id(page_id, digest: str) -> str:
    """The record id of the response that others may refer to."""
    return str(uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}|{digest}"))


def record(kind: str, page_id, url, payload: bytes, digest: str, size: int, refers_to=None, record_id: str | None = None) -> bytes:
    """One WARC record. A revisit has the HTTP header alone in its block."""
    uri = "".join(c if " " < c < "\x7f" or c > "\x9f" else f"%{ord(c):02X}" for c in (url or f"urn:page:{page_id}"))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{record_id or response_id(page_id, digest)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Page-ID: {'' if page_id is None else page_id}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{response_id(refers_to, digest)}>", f"Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, block) of one record; WarcError where it is bad."""
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        raise WarcError("no end of the header")
    lines = raw[:end].decode("utf-8").split("\r\n")
    if lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError(f"version line {lines[0][:40]!r}")
    head: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"header line {line[:40]!r}")
        if name.lower() in head:
            raise WarcError(f"{name} twice")
        head[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if not head.get(name):
            raise WarcError(f"{name} is missing")
    if not head["content-length"].isdigit():
        raise WarcError("content-length is no number")
    size = int(head["content-length"])
    if len(raw) != end + 4 + size + 4 or raw[-4:] != b"\r\n\r\n":
        raise WarcError(f"block of {len(raw) - end - 8} bytes, {size} declared")
    block = raw[end + 4 : -4]
    said = head.get("warc-block-digest", "")
    if said.startswith("sha256:") and said[7:] != hashlib.sha256(block).hexdigest():
        raise WarcError("block digest")
    return head, block


def page_of(head: dict[str, str], block: bytes) -> dict | None:
    """The page row of a response or revisit record, validated; None for other types."""
    kind = head["warc-type"]
    if kind not in ("response", "revisit"):
        return None
    http, gap, payload = block.partition(b"\r\n\r\n")
    if not gap or not http.startswith(b"HTTP/"):
        raise WarcError("no HTTP header")
    sizes = [x.split(b":")[1].strip() for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")]
    if len(sizes) != 1 or not sizes[0].isdigit():
        raise WarcError("HTTP content-length")
    digest = head.get("warc-payload-digest", "")
    if not digest.startswith("sha256:"):
        raise WarcError("payload digest is missing")
    if kind == "response":
        if len(payload) != int(sizes[0]):
            raise WarcError("payload length")
        if hashlib.sha256(payload).hexdigest() != digest[7:]:
            raise WarcError("payload digest")
    elif payload:
        raise WarcError("revisit with a payload")
    return {
        "page_id": _whole(head, "page-id"),
        "payload_bytes": int(sizes[0]),
        "payload_digest": digest[7:],
        "record_type": kind,
        "refers_to": _whole(head, "refers-to-page-id") if kind == "revisit" else None,
        "url": head.get("warc-target-uri"),
        "record_id": _id(head, "warc-record-id"),
        "refers_to_id": _id(head, "warc-refers-to") if kind == "revisit" else None,
    }


def _whole(head: dict[str, str], name: str) -> int | None:
    """The number in a header, None where that is empty or absent, as in archives that
    others wrote."""
    said = head.get(name)
    if not said:
        return None
    if not re.fullmatch(r"-?[0-9]{1,19}", said):
        raise WarcError(f"{name} {said[:40]!r}")
    return int(said)


def _id(head: dict[str, str], name: str) -> str:
    m = _ID.fullmatch(head.get(name, ""))
    if not m:
        raise WarcError(f"{name} {head.get(name, '')[:60]!r}")
    return m.group(1).lower()


def dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """Trained on an archive's first records (bounded by SAMPLE_BYTES); empty where
    there are too few to train on."""
    import zstandard

    if len(samples) < 16:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


class Archive:
    """Writes one archive to a binary file object."""

    def __init__(self, out, dict_bytes: bytes):
        import zstandard

        self.out = out
        own = zstandard.ZstdCompressor(level=3).compress(dict_bytes) if dict_bytes else b""
        out.write(struct.pack("<II", MAGIC, len(own)) + own)
        known = zstandard.ZstdCompressionDict(dict_bytes) if dict_bytes else None
        self.frames = zstandard.ZstdCompressor(level=3, dict_data=known, write_content_size=True, write_checksum=True)
        body = b"software: siftwell\r\nformat: WARC File Format 1.1\r\n"
        head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'siftwell')}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
        self.add(head.encode() + body + b"\r\n\r\n")

    def add(self, raw: bytes) -> None:
        self.out.write(self.frames.compress(raw))


def frames(f, chunk: int = 1 << 20):
    """The decoded frames of an archive, one by one, from a binary file object."""
    import zstandard

    head = f.read(8)
    if len(head) < 8:
        raise WarcError("no skippable frame")
    magic, size = struct.unpack("<II", head)
    if magic != MAGIC:
        raise WarcError(f"leading frame {magic:#x}")
    raw = f.read(size)
    if len(raw) != size:
        raise WarcError("dictionary cut short")
    if raw[:4] == ZSTD_MAGIC:
        raw = zstandard.ZstdDecompressor().decompress(raw)
    known = zstandard.ZstdCompressionDict(raw) if raw else None
    d = zstandard.ZstdDecompressor(dict_data=known)
    rest = b""
    while True:
        rest = rest or f.read(chunk)
        if not rest:
            return
        one, out = d.decompressobj(), []
        while True:
            try:
                out.append(one.decompress(rest))
            except zstandard.ZstdError as e:
                raise WarcError(f"frame: {e}") from e
            if one.eof:
                rest = one.unused_data
                break
            rest = f.read(chunk)
            if not rest:
                raise WarcError("frame cut short")
        yield b"".join(out)


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def planned(pages: DataFrame, least_bytes: int = 100, width: int | None = None) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest and refers_to, dealt by page_id.
    The pages move once; what they refer to comes to them by page_id."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    base = base.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", F.sha2(F.encode("html", "UTF-8"), 256))
    narrow = base.where((F.col("payload_bytes") >= least_bytes) & F.col("page_id").isNotNull()).select("page_id", "payload_digest")
    first = durable(narrow.groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1"))
    # at most HOT_DIGESTS rows; any digest beyond them has few copies against the table
    hot = first.where(F.col("copies") >= HOT_COPIES).orderBy(F.col("copies").desc(), "payload_digest").limit(HOT_DIGESTS).select("payload_digest", "first_id")
    if hot.isEmpty():
        named = narrow.join(first.drop("copies"), "payload_digest")
    else:
        hot = F.broadcast(durable(hot))
        rest = narrow.join(hot.select("payload_digest"), "payload_digest", "left_anti")
        named = narrow.join(hot, "payload_digest").unionByName(rest.join(first.drop("copies"), "payload_digest"))
    # a repeated page_id may have several payloads
    target = (
        named.groupBy(F.col("page_id").alias("deal"))
        .agg(F.map_from_entries(F.collect_set(F.struct("payload_digest", "first_id"))).alias("firsts"))
    )
    deal = F.coalesce(F.col("page_id"), F.xxhash64("url", "payload_digest"))
    dealt = base.withColumn("deal", deal).repartition(width or shuffle_width(pages.sparkSession), "deal")
    joined = dealt.join(target, "deal", "left")
    refers = F.when(F.col("page_id").isNotNull(), F.try_element_at("firsts", F.col("payload_digest")))
    return joined.select("page_id", "url", "html", "payload_bytes", "payload_digest", refers.alias("refers_to"))


def write(pages: DataFrame, folder: str, least_bytes: int = 100, archives: int | None = None) -> DataFrame:
    """Writes the archives under folder (a URI that all executors share) and returns
    (archive, records, bytes), durable."""
    dealt = planned(pages, least_bytes, archives)

    def run(batches):
        from pyspark import TaskContext

        ctx = TaskContext.get()
        target, base = _fs(folder)
        target.create_dir(base, recursive=True)
        temp = f"{base}/.{ctx.partitionId():06d}-{ctx.taskAttemptId()}"
        final = f"{base}/pages-{ctx.partitionId():06d}.warc.zst"
        held: list[bytes] = []
        size = count = 0
        archive = None
        met: set = set()
        out = None
        for b in pieces_of(batches, 2):
            for r in b.to_pylist():
                key = r["page_id"]
                # of repeated rows of the first page, the first one met is the response
                first = r["refers_to"] is None or (r["refers_to"] == key and key not in met)
                if r["refers_to"] == key:
                    met.add(key)
                kind = "response" if first else "revisit"
                # what others refer to has an id that follows from the page; no other record repeats
                own = None if first and r["refers_to"] is not None else str(uuid.uuid5(uuid.NAMESPACE_URL, f"{key}|{r['payload_digest']}|{ctx.partitionId()}|{count}"))
                payload = b"" if kind == "revisit" else r["html"].encode("utf-8", "surrogatepass")
                raw = record(kind, key, r["url"], payload, r["payload_digest"], r["payload_bytes"], r["refers_to"], own)
                count += 1
                if archive is None:
                    held.append(raw)
                    size += len(raw)
                    if size < SAMPLE_BYTES:
                        continue
                    out = target.open_output_stream(temp, compression=None)
                    archive = Archive(out, dictionary(held))
                    for x in held:
                        archive.add(x)
                    held = []
                else:
                    archive.add(raw)
        if count:
            if archive is None:
                out = target.open_output_stream(temp, compression=None)
                archive = Archive(out, dictionary(held))
                for x in held:
                    archive.add(x)
            out.close()
            target.move(temp, final)
            info = target.get_file_info(final)
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"pages-{ctx.partitionId():06d}.warc.zst"]), pa.array([count], pa.int64()), pa.array([info.size], pa.int64())],
                ["archive", "records", "bytes"],
            )

    return durable(dealt.mapInArrow(run, "archive string, records long, bytes long"))


def read(archives: DataFrame, folder: str, batch: int = 2000) -> DataFrame:
    """READ rows of the archives named in archives (column archive) under folder."""

    def run(batches):
        source, base = _fs(folder)
        schema = pa.schema(
            [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
             ("refers_to", pa.int64()), ("url", pa.string()), ("archive", pa.string()), ("frame", pa.int64()), ("record_id", pa.string()), ("refers_to_id", pa.string())]
        )
        for b in batches:
            for name in b.column(0).to_pylist():
                rows = []
                with source.open_input_stream(f"{base}/{name}", compression=None) as f:
                    for at, raw in enumerate(frames(f)):
                        try:
                            row = page_of(*parsed(raw))
                        except WarcError as e:
                            raise WarcError(f"{name}, frame {at}: {e}") from e
                        if row is not None:
                            rows.append(row | {"archive": name, "frame": at})
                        if len(rows) >= batch:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    n = max(1, shuffle_width(archives.sparkSession))
    return archives.select("archive").repartition(n, "archive").mapInArrow(run, READ)


def dangling(rows: DataFrame) -> DataFrame:
    """(refers_to_id): what revisits among READ rows refer to that is no response among them."""
    targets = rows.where("record_type = 'revisit'").select("refers_to_id").distinct()
    return targets.join(rows.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id")), "refers_to_id", "left_anti")


def round_trip(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """Writes pages as archives into the shared folder and reads them back."""
    folder = fresh_dir(pages.sparkSession, "warc")
    return read(write(pages, folder, least_bytes), folder)
