"""WARC records in ZIP-packaged archives, read back by ranges.

Each task writes one archive or more into the shared folder: a ZIP file whose members are stored,
archive/data.warc.gz (one gzip member per record) and indexes/index.cdxj (one line per record, with
offset and length). The reader parses the end record, the ZIP64 records and the central directory
itself, finds where stored members begin, and reads single records by seek and read; nothing is
extracted. Archives are written from front to back as they grow. Files are opened through pyarrow's
file systems, by the scheme of the shared folder.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zipfile
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialise, new_path

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Bytes of records of one archive, about; index lines that one read task takes at a time.
ARCHIVE_BYTES, LINES = 128 << 20, 2000
LEAST_PAYLOAD = 1000


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder or file as Spark names it, and the name there."""
    scheme, mark, rest = path.partition("://")
    return fs.FileSystem.from_uri(f"s3://{rest}" if mark and scheme in ("s3a", "s3n") else path)


def _header(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in fields if v is not None] + [f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _clean(url: str | None) -> str | None:
    """A header value holds no line ends."""
    return None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")


class ArchiveWriter:
    """Records first, then the index, in one ZIP file that is written from front to back."""

    def __init__(self, out, zip64: bool = True):
        self.zip = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=zip64)
        self.lines: list[str] = []
        self.at = 0

    def add(self, page_id, url, payload: bytes, digest: str, refers_to) -> None:
        kind = "response" if refers_to is None else "revisit"
        fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", _clean(url)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", len(payload)), ("Content-Type", "text/html; charset=utf-8")]
        if refers_to is not None:
            fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
        data = _gzip(_header(fields, payload if refers_to is None else b""))
        self.member.write(data)
        self.lines.append(json.dumps({"offset": self.at, "length": len(data), "page": page_id, "type": kind}))
        self.at += len(data)

    def close(self) -> None:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(f"{x}\n" for x in self.lines))
        self.zip.close()


def directory(f, size: int) -> dict[str, tuple[int, int]]:
    """name -> (offset, size) of each stored member of a ZIP file, from its central directory."""

    def read(at, n):
        f.seek(at)
        return f.read(n)

    tail_at = max(0, size - 65557)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    locator = tail_at + end - 20
    if locator >= 0 and (loc := read(locator, 20))[:4] == b"PK\x06\x07":
        (where,) = struct.unpack_from("<Q", loc, 8)
        record = read(where, 56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record")
        count, length, start = struct.unpack_from("<QQQ", record, 32)
    entries, out, at = read(start, length), {}, 0
    for _ in range(count):
        if entries[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, packed, plain = struct.unpack_from("<H", entries, at + 10)[0], *struct.unpack_from("<II", entries, at + 20)
        n_name, n_extra, n_comment = struct.unpack_from("<HHH", entries, at + 28)
        (offset,) = struct.unpack_from("<I", entries, at + 42)
        name = entries[at + 46 : at + 46 + n_name].decode()
        extra, e = entries[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while e + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, e)
            if tag == 1:  # wide values, in this order, for the fields that are full
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, e + 4))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                offset = next(wide) if offset == 0xFFFFFFFF else offset
            e += 4 + n
        if method == 0:
            local = read(offset, 30)
            a, b = struct.unpack_from("<HH", local, 26)
            out[name] = (offset + 30 + a + b, packed)
        at += 46 + n_name + n_extra + n_comment
    return out


def read_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one gzip member."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def check(fields: dict[str, str], block: bytes) -> None:
    """A response's digest and length are those of its block; a revisit has no block."""
    whole = fields["WARC-Type"] == "response"
    if whole and (hashlib.sha1(block).hexdigest() != fields["WARC-Payload-Digest"].removeprefix("sha1:") or len(block) != int(fields["X-Payload-Length"])) or not whole and block:
        raise ValueError(f"record {fields['WARC-Record-ID']} is broken")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write every page as a record; (path, size) of the archives.

    Of records with equal payloads of LEAST_PAYLOAD bytes or more, that with the largest id is the
    response, and the others revisit it. The groups of equal payloads are aggregated before they are
    joined back, and written, so that their size is known where the join is planned."""
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("bytes", F.octet_length("payload"))
    groups = rows.filter(F.col("bytes") >= LEAST_PAYLOAD).groupBy("digest").agg(F.max("page").alias("first"), F.count("*").alias("rows"))
    groups = materialise(groups.filter("rows > 1 and first is not null").select(F.col("digest").alias("same"), "first"), "payloads")
    typed = rows.join(groups, rows.digest == groups.same, "left")
    typed = typed.select("page", "url", "payload", "digest", F.when(~F.col("page").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def write(batches):
        store, root = store_of(folder)
        store.create_dir(root, recursive=True)
        writer, out, name, done = None, None, "", []

        def finish():
            writer.close()
            done.append((f"{folder}/{name}", out.tell()))
            out.close()

        for batch in batches:
            for page, url, payload, digest, refers in zip(*(batch.column(i) for i in range(5)), strict=True):
                if writer is None:
                    name = f"{uuid.uuid4().hex}.wacz"
                    out = store.open_output_stream(f"{root}/{name}")
                    writer = ArchiveWriter(out)
                writer.add(page.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers.as_py())
                if writer.at >= ARCHIVE_BYTES:
                    finish()
                    writer = None
        if writer is not None:
            finish()
        if done:
            yield pa.RecordBatch.from_pydict({"path": [p for p, _ in done], "size": [s for _, s in done]})

    return materialise(typed.mapInArrow(write, "path string, size long"), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """Every record of the archives: page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload.

    First the directories and indexes are read, then the records, dealt out by ranges of the index.
    A revisit has no payload of its own (null); its digest and length are those of the full one. A record
    whose block is not what its header says is an error."""

    def index(batches):
        for batch in batches:
            for path, size in zip(batch.column("path").to_pylist(), batch.column("size").to_pylist(), strict=True):
                store, name = store_of(path)
                with store.open_input_file(name) as f:
                    members = directory(f, size)
                    base, _ = members[DATA]
                    at, n = members[INDEX]
                    f.seek(at)
                    lines = [json.loads(x) for x in f.read(n).decode().splitlines()]
                for lo in range(0, len(lines), LINES):
                    part = lines[lo : lo + LINES]
                    yield pa.RecordBatch.from_pydict({"path": [path], "offsets": pa.array([[base + x["offset"] for x in part]], pa.list_(pa.int64())), "lengths": pa.array([[x["length"] for x in part]], pa.list_(pa.int64()))})

    def records(batches):
        for batch in batches:
            for row in batch.to_pylist():
                store, name = store_of(row["path"])
                out: dict[str, list] = {k: [] for k in ("page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload")}
                with store.open_input_file(name) as f:
                    for offset, length in zip(row["offsets"], row["lengths"], strict=True):
                        f.seek(offset)
                        fields, block = read_record(f.read(length))
                        number = lambda v: None if v is None or v[10:-1] == "None" else int(v[10:-1])
                        kind = fields["WARC-Type"]
                        check(fields, block)
                        out["page_id"].append(number(fields["WARC-Record-ID"]))
                        out["url"].append(fields.get("WARC-Target-URI"))
                        out["record_type"].append(kind)
                        out["refers_to"].append(number(fields.get("WARC-Refers-To")))
                        out["payload_digest"].append(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
                        out["payload_bytes"].append(int(fields["X-Payload-Length"]))
                        out["payload"].append(block if kind == "response" else None)
                yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in (("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()))], names=list(out))

    n = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = archives.repartition(n).mapInArrow(index, "path string, offsets array<long>, lengths array<long>").repartition(n)
    return ranges.mapInArrow(records, "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary")


def warc_round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Write all pages into archives in the shared folder and read them back.

    A null payload is empty; a null url leaves its header out. Rows with a null id are responses,
    unless another row has the same payload: then they revisit it. Rows that share an id and a payload
    are both written, alike. A folder is named anew for each call; a task that is run again writes a
    new file, and only the files of tasks that ended are read. Empty table: no archive and no rows."""
    return read_archives(write_archives(pages, new_path(pages.sparkSession, "warc"), **columns))
