"""WARC records in ZIP packages, read by range.

Written are packages as web archives are handed out: `archive/*.warc.gz` and `indexes/*.cdxj` as stored (uncompressed)
members, one gzip member per record. The reader never extracts a package: it reads the end of the file, the central
directory (ZIP64 included) and a member's local header, finds the stored members, takes record places from the index
(without one, from a scan of the gzip members), and then reads ranges of about `range_bytes`, each in whatever task
gets it. Packages are files of any store that `pyarrow.fs` reaches, `spark.checkpoint.dir`'s own included.

Defined results: a null payload is written as an empty one; a null page id is kept as null and is never referred to by
others; of equal payloads all rows with the largest page id are responses (a repeated row stays a response); an empty
table writes no package and gives an empty result; members that are compressed or encrypted are listed and not read;
columns other than id, url and payload are not read.
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
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import materialize, shared_dir, small_side
from .common import BATCH_ROWS, map_columns, schema_of

REVISIT_BYTES = 1000
PACKAGE_BYTES = 256 << 20
PACKAGE_RECORDS = 100_000
RANGE_BYTES = 4 << 20
MOST_TASKS = 100_000

# Signatures and sizes of the ZIP format's records.
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
END_SIZE, LOCATOR64_SIZE, END64_SIZE, ENTRY_SIZE, LOCAL_SIZE, LONGEST_COMMENT = 22, 20, 56, 46, 30, 65535
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# --- records

def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has the HTTP header of the response, its length included, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name_of(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " else "%%%02X" % ord(c) for c in url))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {name_of(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def name_of(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def id_of(name: str | None) -> int | None:
    number = (name or "").strip("<>").rpartition(":")[2]
    return int(number) if number else None


def headers(data: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = data.decode().split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def parsed(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, warc = headers(head)
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    block = rest[:int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, headers(http)[1], payload


# --- the ZIP package

def place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def read_range(f, start: int, size: int) -> bytes:
    f.seek(start)
    data = f.read(size)
    if len(data) != size:
        raise ValueError(f"{size} bytes wanted at {start}, {len(data)} there")
    return data


def directory(f, size: int) -> list[dict]:
    """Entries of the central directory: name, method, flags, packed, unpacked, header (offset of the local header)."""
    tail_at = max(0, size - END_SIZE - LONGEST_COMMENT)
    tail = read_range(f, tail_at, size - tail_at)
    at = tail.rfind(END)
    while at >= 0 and (at + END_SIZE > len(tail) or at + END_SIZE + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(END, 0, at)  # the signature may also occur in the comment
    if at < 0:
        raise ValueError("no end of central directory")
    entries, length, start = struct.unpack_from("<HII", tail, at + 10)
    if FULL16 == entries or FULL32 in (length, start):
        locator = read_range(f, tail_at + at - LOCATOR64_SIZE, LOCATOR64_SIZE)
        if locator[:4] != LOCATOR64:
            raise ValueError("no ZIP64 locator")
        end64 = read_range(f, struct.unpack_from("<Q", locator, 8)[0], END64_SIZE)
        if end64[:4] != END64:
            raise ValueError("no ZIP64 end of central directory")
        entries, length, start = struct.unpack_from("<QQQ", end64, 32)
    data, found, at = read_range(f, start, length), [], 0
    for _ in range(entries):
        if data[at:at + 4] != ENTRY:
            raise ValueError("broken central directory")
        flags, method, packed, unpacked, n_name, n_extra, n_comment, header = struct.unpack_from("<HH8xIIHHH8xI", data, at + 8)
        name = data[at + ENTRY_SIZE:at + ENTRY_SIZE + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = data[at + ENTRY_SIZE + n_name:at + ENTRY_SIZE + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:  # ZIP64: only the fields that are full, in this order
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                unpacked = next(wide) if unpacked == FULL32 else unpacked
                packed = next(wide) if packed == FULL32 else packed
                header = next(wide) if header == FULL32 else header
            extra = extra[4 + n:]
        found.append({"name": name, "method": method, "flags": flags, "packed": packed, "unpacked": unpacked, "header": header})
        at += ENTRY_SIZE + n_name + n_extra + n_comment
    return found


def stored(entry: dict) -> bool:
    return entry["method"] == 0 and not entry["flags"] & 1


def data_start(f, entry: dict) -> int:
    """Where a member's bytes begin; names and extras of the local header may differ in length from the directory's."""
    local = read_range(f, entry["header"], LOCAL_SIZE)
    if local[:4] != LOCAL:
        raise ValueError("broken local header")
    return entry["header"] + LOCAL_SIZE + sum(struct.unpack_from("<HH", local, 26))


def scanned(f, start: int, size: int) -> list[tuple[int, int]]:
    """Offsets and lengths of the gzip members of a stretch, read through in pieces."""
    found, at, begin, end = [], start, start, start + size
    unzip, rest = zlib.decompressobj(31), b""
    while at < end or rest:
        if not rest:
            rest = read_range(f, at, min(1 << 16, end - at))
            at += len(rest)
        unzip.decompress(rest)
        rest = unzip.unused_data
        if unzip.eof:
            found.append((begin - start, at - len(rest) - begin))
            begin, unzip = at - len(rest), zlib.decompressobj(31)
    return found


class Package:
    """A ZIP package being written. `store` is only appended to, so object stores will do."""

    def __init__(self, folder: str):
        store, path = place(folder)
        self.path = f"{folder}/{uuid.uuid4().hex}.zip"
        self.out = store.open_output_stream(f"{path}/{self.path.rpartition('/')[2]}")
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open("archive/data.warc.gz", "w", force_zip64=True)
        self.index: list[str] = []
        self.bytes = 0

    def add(self, data: bytes) -> None:
        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
        packed = packer.compress(data) + packer.flush()
        self.member.write(packed)
        self.index.append(json.dumps({"filename": "data.warc.gz", "offset": self.bytes, "length": len(packed)}))
        self.bytes += len(packed)

    def close(self) -> tuple[str, int]:
        self.member.close()
        self.zip.writestr("indexes/index.cdxj", "\n".join(self.index))
        self.zip.close()
        self.out.close()
        return self.path, len(self.index)


def write_packages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   package_bytes: int = PACKAGE_BYTES, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Write every row as a record and return the packages (path, records).

    Only digests are grouped; where few payloads repeat their table is broadcast, so payloads are not shuffled. Every
    attempt of a task writes files of its own, and the returned table, itself written, names those of the one that counted.
    """
    named = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    named = named.withColumn("digest", F.sha1("payload"))
    large = named.where(F.octet_length("payload") >= revisit_bytes)
    kept = small_side(large.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("kept_digest"), "keeper"))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper"))
    rows = named.join(kept, F.col("digest") == F.col("kept_digest"), "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))

    def run(batches):
        package, done = None, []
        for b in batches:
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in b.columns)):
                package = package or Package(folder)
                package.add(record(page_id, url, payload.encode(), digest, refers_to))
                if package.bytes >= package_bytes or len(package.index) >= PACKAGE_RECORDS:
                    done.append(package.close())
                    package = None
        if package:
            done.append(package.close())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["path", "records"])
    pages.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return materialize(rows.mapInArrow(run, "path string, records long"), "packages")


def members(packages: DataFrame) -> DataFrame:
    """Members of each package (path): name, method, packed, unpacked, and start, null for those that are not stored."""
    def run(paths):
        rows = []
        for path in paths:
            store, at = place(path)
            with store.open_input_file(at) as f:
                for e in directory(f, f.size()):
                    rows.append((path, e["name"], e["method"], e["packed"], e["unpacked"], data_start(f, e) if stored(e) else None))
        return list(zip(*rows)) or [[]] * 6
    return map_columns(packages.select("path"), run, "path string, name string, method int, packed long, unpacked long, start long")


def record_ranges(packages: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Ranges of neighbouring records: path, start, and the records' lengths."""
    fields = "path string, start long, lengths array<long>"

    def run(batches):
        for b in batches:
            rows = []
            for path in b.column(0).to_pylist():
                store, where = place(path)
                with store.open_input_file(where) as f:
                    entries = directory(f, f.size())
                    places: dict[str, list[tuple[int, int]]] = {}
                    for e in entries:
                        if e["name"].startswith("indexes/") and e["name"].endswith(".cdxj") and stored(e):
                            for line in read_range(f, data_start(f, e), e["unpacked"]).decode().splitlines():
                                x = json.loads(line[line.index("{"):])
                                places.setdefault(x["filename"], []).append((int(x["offset"]), int(x["length"])))
                    for e in entries:
                        if e["name"].startswith("archive/") and e["name"].endswith(".warc.gz") and stored(e):
                            start = data_start(f, e)
                            begin, lengths, end = 0, [], 0
                            for offset, length in sorted(places.get(e["name"].removeprefix("archive/")) or scanned(f, start, e["packed"])):
                                if lengths and (offset != end or end - begin + length > range_bytes):
                                    rows.append((path, start + begin, lengths))
                                    lengths = []
                                if not lengths:
                                    begin = offset
                                lengths.append(length)
                                end = offset + length
                            if lengths:
                                rows.append((path, start + begin, lengths))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()),
                                              pa.array([r[2] for r in rows], pa.list_(pa.int64()))], names=["path", "start", "lengths"])
    return packages.select("path").mapInArrow(run, fields)


def read_records(packages: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Records of packages (path): page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload, verified.

    A revisit's length and digest are those of the payload it refers to, from its headers; its payload is null.
    `verified` says that the payload read has the digest of the header (null for revisits).
    """
    fields = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, verified boolean"
    ranges = materialize(record_ranges(packages, range_bytes), "ranges")
    tasks = max(1, min(ranges.count(), 2 * packages.sparkSession.sparkContext.defaultParallelism, MOST_TASKS))
    dealt = ranges.repartition(tasks, F.xxhash64("path", "start"))  # a fixed number: these rows are small, what they stand for is not
    shape = schema_of(fields)

    def run(batches):
        for b in batches:
            for path, start, lengths in zip(*(c.to_pylist() for c in b.columns)):
                store, where = place(path)
                with store.open_input_file(where) as f:
                    data = read_range(f, start, sum(lengths))
                rows, at = [], 0
                for n in lengths:
                    warc, http, payload = parsed(zlib.decompress(data[at:at + n], 31))
                    at += n
                    told = warc.get("warc-payload-digest", "").removeprefix("sha1:")
                    head = (id_of(warc.get("warc-record-id")), warc.get("warc-target-uri"), warc["warc-type"], id_of(warc.get("warc-refers-to")))
                    if warc["warc-type"] == "revisit":
                        rows.append((*head, int(http["content-length"]), told, None, None))
                    else:
                        digest = hashlib.sha1(payload).hexdigest()
                        rows.append((*head, len(payload), digest, payload, digest == told))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=x.type) for c, x in zip(zip(*rows), shape)], schema=shape)
    return dealt.mapInArrow(run, fields)


def package_folder(spark: SparkSession) -> str:
    """A new folder for packages under the shared one."""
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    store, path = place(folder)
    store.create_dir(path, recursive=True)
    return folder
