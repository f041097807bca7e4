"""WARC archives as seekable Zstandard bundles.

A bundle is a run of independent frames with a footer seek table (the public seekable
format: a skippable frame with the compressed and plain size of every frame), so a
reader decompresses only the frame that holds a record. Next to a bundle stand the
places of its records: frame, offset inside the plain frame, length. Spark writes
bundles as rows of a table, with its commit protocol, to any store it can
reach; ``export`` writes each as a file.

Equal payloads are stored once: of a group, the record with the largest id is a
response, others revisit it.
"""

import struct
from datetime import datetime, timezone

import zstandard
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.common import map_rows
from tidewatch.session import materialize

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 8 << 20
BUNDLE_RECORDS = 16384
LEVEL = 6
LEAST_SHARED_BYTES = 1000
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = datetime(2000, 1, 1, tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(record_id, url: str | None, payload: bytes, digest: str, refers_to=None, revisit: bool = False) -> bytes:
    """One WARC record; a revisit carries the head of its response and no payload."""
    head = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = head if revisit else head + payload
    target = "".join(c for c in url or "" if c not in "\r\n")
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{record_id}>"),
              ("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{name}: {value}\r\n" for name, value in fields)
    return f"WARC/1.1\r\n{lines}\r\n".encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict, dict, bytes]:
    """Record to its WARC fields, its HTTP fields and the payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    if rest[len(block):] != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


class BundleWriter:
    """Collects records into frames, and frames into one bundle."""

    def __init__(self, frame_bytes: int = FRAME_BYTES):
        self.frame_bytes = frame_bytes
        self.squeeze = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True).compress
        self.frames, self.sizes, self.places = [], [], []
        self.open: list[bytes] = []
        self.open_bytes = self.bytes = 0

    def add(self, record_id, raw: bytes) -> None:
        self.places.append((record_id, len(self.frames), self.open_bytes, len(raw)))
        self.open.append(raw)
        self.open_bytes += len(raw)
        if self.open_bytes >= self.frame_bytes:
            self.close_frame()

    def close_frame(self) -> None:
        if self.open:
            frame = self.squeeze(b"".join(self.open))
            self.frames.append(frame)
            self.sizes.append((len(frame), self.open_bytes))
            self.bytes += len(frame)
            self.open, self.open_bytes = [], 0

    def finish(self) -> bytes:
        self.close_frame()
        table = b"".join(struct.pack("<II", *pair) for pair in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        head = struct.pack("<II", SKIPPABLE_MAGIC, len(table) + len(footer))
        return b"".join(self.frames) + head + table + footer


class BundleReader:
    """Random access to a bundle through its seek table; keeps the last frame."""

    def __init__(self, data: bytes):
        count, flags, magic = struct.unpack("<IBI", data[-9:])
        if magic != SEEKABLE_MAGIC or flags:
            raise ValueError("not a seekable bundle")
        at = len(data) - 9 - 8 * count
        self.data, self.starts, self.sizes, position = data, [], [], 0
        for packed, plain in struct.iter_unpack("<II", data[at:-9]):
            self.starts.append(position)
            self.sizes.append((packed, plain))
            position += packed
        if position != at - 8:
            raise ValueError("the seek table does not cover the frames")
        self.expand = zstandard.ZstdDecompressor().decompress
        self.number, self.frame = None, b""

    def read(self, frame: int, offset: int, length: int) -> bytes:
        if frame != self.number:
            start, (packed, plain) = self.starts[frame], self.sizes[frame]
            self.number, self.frame = frame, self.expand(self.data[start:start + packed], max_output_size=plain)
        return self.frame[offset:offset + length]


def with_targets(pages: DataFrame, least: int = LEAST_SHARED_BYTES) -> DataFrame:
    """``pages`` (page_id, url, payload) with digest, n_bytes and refers_to (null for responses).

    Only narrow digests are grouped, pre-aggregated in tasks; nothing is grouped above
    the join, so AQE may split the partition of a much-copied payload. Pages below the
    limit or alone join nothing and are spread by their id.
    """
    known = pages.withColumn("digest", F.sha1("payload")).withColumn("n_bytes", F.octet_length("payload").cast("long"))
    groups = (known.where(F.col("n_bytes") >= least).groupBy("digest", "n_bytes")
              .agg(F.max("page_id").alias("_largest"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1))
    groups = materialize(groups.select("digest", "n_bytes", "_largest"), "payload-groups")
    joined = known.join(groups.hint("merge"), ["digest", "n_bytes"], "left")
    other = F.col("_largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_largest"))
    return joined.withColumn("refers_to", F.when(other, F.col("_largest"))).drop("_largest")


def write_archive(pages: DataFrame, path: str, id: str = "page_id", url: str = "url", html: str = "html",
                  least: int = LEAST_SHARED_BYTES) -> None:
    """Write one record for every row as a table of bundles: (bundle, data, places).

    Null html is an empty payload, a null url an empty target; a null id is never
    the largest unless all are null. Rows with the largest id of a group are responses,
    also if repeated. A payload of any size is one record in one frame. An empty table gives an empty archive.
    """
    kind = pages.schema[id].dataType.simpleString()
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = with_targets(pages.select(F.col(id).alias("page_id"), F.col(url).alias("url"), payload.alias("payload")), least)
    ordered = rows.select(F.spark_partition_id().alias("part"), "page_id", "url", "payload", "digest", "refers_to")

    def bundles(batch):
        writer, part, number = None, 0, 0

        def done():
            return f"{part:08d}-{number:06d}.warc.zst", writer.finish(), writer.places

        for part, page_id, target, payload, digest, refers_to in batch:
            writer = writer or BundleWriter()
            raw = record(page_id, target, payload, digest, refers_to, refers_to is not None)
            writer.add(page_id, raw)
            if writer.bytes >= BUNDLE_BYTES or len(writer.places) >= BUNDLE_RECORDS:
                yield done()
                writer, number = None, number + 1
        if writer:
            yield done()

    place = f"struct<record_id:{kind},frame:int,offset:long,length:long>"
    map_rows(ordered, bundles, f"bundle string, data binary, places array<{place}>").write.parquet(path)


def _number(value: str | None):
    text = value[len("<urn:page:"):-1] if value else None
    return None if text in (None, "None") else int(text)


def read_archive(archive: DataFrame) -> DataFrame:
    """Records of an archive: page_id, payload_bytes, payload_digest, record_type, refers_to, url, bundle, frame, offset, payload.

    Each record is fetched at its place through the seek table. The payload of a response
    is hashed again and must match its digest; ids must match the place's.
    """
    import hashlib
    kind = archive.schema["places"].dataType.elementType["record_id"].dataType.simpleString()

    def records(batch):
        for name, data, places in batch:
            reader = BundleReader(data)
            for place in places:
                fields, http, payload = parse(reader.read(place["frame"], place["offset"], place["length"]))
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                page_id, kind_of = _number(fields["WARC-Record-ID"]), fields["WARC-Type"]
                if page_id != place["record_id"]:
                    raise ValueError(f"{name}: another record stands at the place of {place['record_id']}")
                if kind_of == "response" and (hashlib.sha1(payload).hexdigest() != digest
                                              or len(payload) != int(http["Content-Length"])):
                    raise ValueError(f"{name}: the payload of {page_id} is damaged")
                yield (page_id, int(http["Content-Length"]), digest, kind_of, _number(fields.get("WARC-Refers-To")),
                       fields["WARC-Target-URI"], name, place["frame"], place["offset"], payload)

    return map_rows(archive.select("bundle", "data", "places"), records,
                    f"page_id {kind}, payload_bytes long, payload_digest string, record_type string, refers_to {kind}, "
                    "url string, bundle string, frame int, offset long, payload binary")


def export(archive: DataFrame, folder: str) -> DataFrame:
    """Write each bundle as a file below ``folder``, any URI that ``pyarrow.fs`` knows; (bundle, bytes).

    Names are fixed by the archive, so a task that runs again writes the same file.
    """
    def files(batch):
        from pyarrow import fs
        store, root = fs.FileSystem.from_uri(folder)
        for name, data in batch:
            # The name would make pyarrow compress the bundle once more.
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(data)
            yield name, len(data)

    return map_rows(archive.select("bundle", "data"), files, "bundle string, bytes long")
