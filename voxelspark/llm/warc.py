"""WARC archives as a data source: a writer of one gzip member for each record, and a reader that salvages damaged files.

The reader checks each record (header lines, declared length, end mark, digests, the checks of its gzip member).  After a
failed check it searches for the next byte at which a member or a version line begins a record that passes, goes on there,
and reports the bytes between as a gap, so that what follows damage is not lost and what is lost is known.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .runtime import Scratch, bounded_batches

#: Bytes read or inflated at a time; bytes of header lines at most.
STEP, HEAD_MOST = 1 << 18, 1 << 16
#: Content beyond this cannot be a value of a row, so a length that declares more fails its check.
RECORD_MOST = 1 << 30
#: Bytes of an archive file after which the writer begins the next.
FILE_BYTES = 256 << 20
_MEMBER = b"\x1f\x8b\x08"
_START = re.compile(rb"\x1f\x8b\x08|WARC/\d\.\d\r?\n")
_VERSION = re.compile(rb"WARC/\d\.\d\r?\n")
_IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Damaged(ValueError):
    """A check failed; ``end`` is where the record ends, if its frame is whole."""

    def __init__(self, reason: str, end: int | None = None):
        super().__init__(reason)
        self.reason, self.end = reason, end


@dataclass
class Record:
    offset: int
    #: of the record or its member; 0 if more records of the member follow
    length: int
    headers: dict[str, str]
    block: bytes
    #: a digest of the content was declared and holds
    verified: bool = False
    names: dict[str, str] = field(default_factory=dict)

    def split(self) -> tuple[bytes | None, bytes]:
        """Header lines of a HTTP message and what follows them."""
        if self.headers.get("content-type", "").lower().startswith("application/http"):
            end = self.block.find(b"\r\n\r\n")
            return (self.block[:end], self.block[end + 4 :]) if end >= 0 else (self.block, b"")
        return None, self.block


@dataclass
class Gap:
    offset: int
    length: int
    reason: str


# --- reading -----------------------------------------------------------------------------------------------------------


class Bytes:
    """Bytes of a file by place, a window of them in memory."""

    def __init__(self, file, size: int):
        self.file, self.size, self.begin, self.window = file, size, 0, b""

    def at(self, place: int, n: int) -> bytes:
        a = place - self.begin
        if a < 0 or a + n > len(self.window):
            self.file.seek(place)
            if n >= STEP:
                return self.file.read(n)
            self.begin, self.window, a = place, self.file.read(STEP), 0
        return self.window[a : a + n]

    def next_start(self, place: int) -> int:
        """The next byte from ``place`` on at which a member or a version line may begin, or the end."""
        while place < self.size:
            piece = self.at(place, STEP)
            found = _START.search(piece)
            if found:
                return place + found.start()
            place += max(1, len(piece) - 17)  # a version line may stand across pieces
        return self.size


def header_lines(piece: bytes, whole: bool) -> tuple[dict[str, str], dict[str, str], int] | None:
    """Headers by lower-case name, their names as written, and the length of the lines; None if ``piece`` ends before them."""
    if not _VERSION.match(piece):
        if not whole and len(piece) < 10:
            return None
        raise Damaged("no version line")
    end = piece.find(b"\r\n\r\n", 0, HEAD_MOST)
    lines = piece[: end if end >= 0 else piece.rfind(b"\n") + 1].splitlines()[1:]
    headers: dict[str, str] = {}
    names: dict[str, str] = {}
    last = None
    for line in lines:
        name, colon, value = line.partition(b":")
        if line[:1] in (b" ", b"\t") and last:
            headers[last] += " " + line.strip().decode("utf-8", "replace")
        elif not colon or not name.strip() or any(b <= 32 or b >= 127 for b in name.strip()):
            raise Damaged("a line that is no header")
        else:
            last = name.strip().decode().lower()
            headers[last], names[last] = value.strip().decode("utf-8", "replace"), name.strip().decode()
    if end < 0:
        if whole or len(piece) >= HEAD_MOST:
            raise Damaged("headers without end")
        return None
    if not re.fullmatch(r"\d{1,19}", headers.get("content-length", "")) or "warc-type" not in headers:
        raise Damaged("no type or length")
    if int(headers["content-length"]) > RECORD_MOST:
        raise Damaged("declared length out of range")
    return headers, names, end + 4


def digest_hex(declared: str | None) -> tuple[str, str] | None:
    """(algorithm, lower-case hex) of a labelled digest in hex or base 32; None if it is neither."""
    name, _, value = (declared or "").strip().partition(":")
    name = name.lower().replace("-", "")
    if name not in ("md5", "sha1", "sha256", "sha512"):
        return None
    size = hashlib.new(name).digest_size
    if re.fullmatch(rf"[0-9a-fA-F]{{{2 * size}}}", value):
        return name, value.lower()
    try:
        raw = base64.b32decode(value.upper() + "=" * (-len(value) % 8))
    except ValueError:
        return None
    return (name, raw.hex()) if len(raw) == size else None


def checked(record: Record) -> Record:
    """The record if its digests hold.  That of the block decides; that of the payload where there is no other and the
    payload is as it was sent."""
    declared, content = digest_hex(record.headers.get("warc-block-digest")), record.block
    if declared is None and record.headers["warc-type"].lower() != "revisit" and "warc-segment-number" not in record.headers:
        head, content = record.split()
        if not re.search(rb"(?im)^(transfer|content)-encoding:", head or b""):
            declared = digest_hex(record.headers.get("warc-payload-digest"))
    if declared is not None:
        if hashlib.new(declared[0], content).hexdigest() != declared[1]:
            raise Damaged("digest does not hold", record.offset + record.length)
        record.verified = True
    return record


def _plain(data: Bytes, place: int) -> Iterator[Record]:
    """The one record at a version line; returns its end."""
    size = 4096
    while (found := header_lines(piece := data.at(place, size), place + len(piece) >= data.size)) is None:
        size *= 2
    headers, names, head = found
    length = int(headers["content-length"])
    end = place + head + length + 4
    if end > data.size:
        raise Damaged("record cut short")
    if data.at(end - 4, 4) != b"\r\n\r\n":
        raise Damaged("no end mark")
    yield checked(Record(place, end - place, headers, data.at(place + head, length) if length else b"", names=names))
    return end


def _member(data: Bytes, place: int) -> Iterator[Record]:
    """The records of a gzip member; returns its end.  The last waits for the member's own check, if no digest holds it."""
    inflate, at, buffer, need, held, lost, n = zlib.decompressobj(31), place, bytearray(), 1, None, None, 0
    while True:
        if not inflate.eof:
            piece = inflate.unconsumed_tail
            if not piece:
                piece = data.at(at, STEP) if at < data.size else b""
                at += len(piece)
            if not piece:
                if held is not None and held.verified:
                    yield held
                raise Damaged("member cut short")
            try:
                buffer += inflate.decompress(piece, STEP)
            except zlib.error as error:
                if held is not None and held.verified:
                    yield held
                raise Damaged(f"member: {str(error).partition(': ')[2] or error}") from None
        while len(buffer) >= need or (inflate.eof and buffer):
            try:
                found = header_lines(bytes(buffer[:HEAD_MOST]), inflate.eof)
                if found is None:
                    need = len(buffer) + 1
                    continue
                headers, names, head = found
                need = head + int(headers["content-length"]) + 4
                if len(buffer) < need:
                    if inflate.eof:
                        raise Damaged("record cut short")
                    continue
                if buffer[need - 4 : need] != b"\r\n\r\n":
                    raise Damaged("no end mark")
                record = checked(Record(place, 0, headers, bytes(buffer[head : need - 4]), names=names))
            except Damaged as damage:
                if not n and lost is None and not _VERSION.match(buffer):
                    raise Damaged("member without a record") from None
                lost, after = damage.reason, _VERSION.search(buffer, 1)
                # a whole frame ends the record, else the next version line; one may begin in the last bytes
                del buffer[: need if damage.end is not None else after.start() if after else max(1, len(buffer) - 9)]
                need = 10
                continue
            if held is not None:
                yield held
            held, n = record, n + 1
            del buffer[:need]
            need = 1
        if inflate.eof:
            end = at - len(inflate.unused_data)
            if held is not None:
                held.length = end - place
                yield held
            if lost or not n:
                raise Damaged(lost or "member without a record", end)
            return end


def salvage(file, size: int) -> Iterator[Record | Gap]:
    """Records that pass their checks, in order of place, and the gaps between them."""
    data, place, gap, why = Bytes(file, size), 0, None, ""
    while place < size:
        reading = _member(data, place) if data.at(place, 3) == _MEMBER else _plain(data, place)
        try:
            while True:
                record = next(reading)
                if gap is not None:
                    yield Gap(gap, place - gap, why)
                    gap = None
                yield record
        except StopIteration as done:
            place = done.value
        except Damaged as damage:
            if gap is None:
                gap, why = place, damage.reason
            place = damage.end or data.next_start(place + 1)
    if gap is not None:
        yield Gap(gap, size - gap, why)


SCHEMA = (
    "path string, offset long, length long, record_type string, record_id string, target_uri string, date string, refers_to string, "
    "payload_digest string, payload_bytes long, payload binary, http_head string, headers map<string,string>, gap string"
)
_ARROW = pa.schema(
    [(n, {"long": pa.int64(), "binary": pa.binary(), "map<string,string>": pa.map_(pa.string(), pa.string())}.get(t, pa.string())) for n, t in (c.split(" ", 1) for c in SCHEMA.split(", "))]
)


def _row(path: str, found: Record | Gap, content: bool) -> dict:
    if isinstance(found, Gap):
        return {"path": path, "offset": found.offset, "length": found.length, "gap": found.reason}
    get, (head, payload) = found.headers.get, found.split()
    kind, declared = get("warc-type").lower(), digest_hex(get("warc-payload-digest"))
    digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
    if kind == "revisit":  # its payload is that of the record it refers to
        payload, size = None, int(get("x-payload-length")) if re.fullmatch(r"\d{1,18}", get("x-payload-length", "")) else None
        digest = declared[1] if declared and declared[0] == "sha1" else None
    return {
        "path": path, "offset": found.offset, "length": found.length, "record_type": kind, "record_id": get("warc-record-id"), "target_uri": get("warc-target-uri"),
        "date": get("warc-date"), "refers_to": get("warc-refers-to"), "payload_digest": digest, "payload_bytes": size, "payload": payload if content else None,
        "http_head": head.decode("utf-8", "replace") if head is not None else None, "headers": list({found.names[k]: v for k, v in found.headers.items()}.items()),
    }


@dataclass
class ArchiveFile(InputPartition):
    path: str | None
    size: int


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.content = options["path"], options.get("content", "true").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        """A file each: those that finished writers list, or in a folder without such lists all named as archives."""
        fs, root = pafs.FileSystem.from_uri(self.path)
        info = fs.get_file_info(root)
        files = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(root, recursive=True))
        listed: set[str] | None = None
        for x in files:
            if re.fullmatch(r"_files-\w+", x.base_name):
                with fs.open_input_stream(x.path) as lines:
                    listed = (listed or set()) | set(lines.read().decode().split("\n"))
        named = [x for x in files if x.is_file and (re.search(r"\.warc(\.gz)?$", x.base_name) or info.is_file) and (listed is None or x.base_name in listed)]
        return [ArchiveFile(x.path, x.size) for x in sorted(named, key=lambda x: x.path)] or [ArchiveFile(None, 0)]

    def read(self, partition: ArchiveFile) -> Iterator[pa.RecordBatch]:
        if partition.path is None:
            return
        fs, _ = pafs.FileSystem.from_uri(self.path)
        rows, size = [], 0
        with fs.open_input_file(partition.path) as file:
            for found in salvage(file, partition.size):
                rows.append(_row(partition.path, found, self.content))
                size += 1000 + len(rows[-1].get("payload") or b"")
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


# --- writing -----------------------------------------------------------------------------------------------------------


def _line(value: str) -> str:
    """A value that cannot end its header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: urllib.parse.quote(m[0]), value)


def _sha1(content: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(content).digest()).decode()


def record_bytes(kind: str, record_id: str, date: str, block: bytes, **headers: str | None) -> bytes:
    lines = {"WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Date": date, **{k.replace("_", "-"): v for k, v in headers.items()}}
    lines |= {"WARC-Block-Digest": _sha1(block), "Content-Length": str(len(block))}
    head = "".join(f"{k}: {v}\r\n" for k, v in lines.items() if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _bytes_of(row: dict, date: str) -> bytes:
    payload, uri, revisit = row["payload"] or b"", row["target_uri"], row["record_type"] == "revisit"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload) if not revisit else row['payload_bytes']}\r\n\r\n".encode()
    digest = "sha1:" + base64.b32encode(bytes.fromhex(row["payload_digest"])).decode() if row["payload_digest"] else _sha1(payload)
    return record_bytes(
        row["record_type"], row["record_id"], date, head + (b"" if revisit else payload),
        WARC_Target_URI=_line(uri) if uri else None, Content_Type="application/http; msgtype=response", WARC_Payload_Digest=digest,
        WARC_Refers_To=row["refers_to"] if revisit else None, WARC_Profile=_IDENTICAL if revisit else None, X_Payload_Length=str(row["payload_bytes"]) if revisit else None,
    )


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Files get names of their own; they count once the list of a finished write names them, so those of lost attempts don't."""

    def __init__(self, options):
        self.path, self.compress = options["path"], options.get("compress", "true").lower() == "true"
        self.most, self.date = int(options.get("filebytes", FILE_BYTES)), options.get("date") or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def _member(self, record: bytes) -> bytes:
        if not self.compress:
            return record
        gzip = zlib.compressobj(6, zlib.DEFLATED, 31)
        return gzip.compress(record) + gzip.flush()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        task, files, out, size = uuid.uuid4().hex, [], None, 0
        for batch in iterator:
            for k in range(batch.num_rows):
                if out is None:
                    files.append(f"{task}-{len(files):05}.warc" + (".gz" if self.compress else ""))
                    out, size = fs.open_output_stream(f"{root}/{files[-1]}", compression=None), 0
                    about = b"software: voxelspark\r\nformat: WARC File Format 1.1\r\n"
                    out.write(self._member(record_bytes("warcinfo", f"<urn:uuid:{uuid.uuid4()}>", self.date, about, WARC_Filename=files[-1], Content_Type="application/warc-fields")))
                data = self._member(_bytes_of({n: batch.column(n)[k].as_py() for n in _WRITTEN}, self.date))
                out.write(data)
                size += len(data)
                if size > self.most:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/_files-{uuid.uuid4().hex}") as out:
            out.write("\n".join(f for m in messages if m for f in m.files).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        for f in (f for m in messages if m for f in m.files):
            fs.delete_file(f"{root}/{f}")


_WRITTEN = ["record_type", "record_id", "target_uri", "refers_to", "payload_digest", "payload_bytes", "payload"]


class WarcSource(DataSource):
    """``spark.read.format("warc")`` of a file or folder; option ``content`` false leaves payloads out."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def read_warc(spark: SparkSession, path: str, content: bool = True) -> DataFrame:
    """Records of all archives below ``path``, in the columns of ``SCHEMA``, and a row with ``gap`` set for each gap.

    A file is read in one task, a record at a time.  Folders are those that ``pyarrow.fs`` opens by address."""
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("content", str(content).lower()).load(path)


def write_warc(records: DataFrame, path: str, compress: bool = True, file_bytes: int = FILE_BYTES, date: str | None = None) -> None:
    """Archives of ``records(record_type, record_id, target_uri, refers_to, payload_digest, payload_bytes, payload)``, added to a folder.

    Each task writes files of its own; a record is a gzip member, or plain if ``compress`` is false."""
    spark = records.sparkSession
    bounded_batches(spark)
    spark.dataSource.register(WarcSource)
    out = records.select(*_WRITTEN).write.format("warc").mode("append").option("compress", str(compress).lower()).option("fileBytes", str(file_bytes))
    (out.option("date", date) if date else out).save(path)


def resolved(records: DataFrame) -> DataFrame:
    """Revisits with the payload of the record that they refer to; other records as they are."""
    whole = records.where("record_type = 'response'").groupBy(F.col("record_id").alias("__id")).agg(F.first("payload").alias("__payload"))
    joined = records.join(whole, (F.col("refers_to") == F.col("__id")) & (F.col("record_type") == "revisit"), "left")
    return joined.withColumn("payload", F.coalesce("payload", "__payload")).select(records.columns)


def page_records(pages: DataFrame, scratch: Scratch, least_bytes: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A record for each page.  Of pages with equal payloads of ``least_bytes`` or more, the one with the largest id is the
    response and the others revisit it; all others are responses.

    Equal are payloads of the same SHA-256.  Rows that repeat the largest id are responses each; null ids are the smallest.
    Only groups of two and more are joined back, so Spark may broadcast them if they are few."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("target_uri"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    size = F.octet_length("payload").cast("long")
    keyed = rows.withColumn("payload_bytes", size).withColumn("key", F.when(F.col("payload_bytes") >= least_bytes, F.unhex(F.sha2("payload", 256))))
    owners = keyed.where("key is not null").groupBy("key").agg(F.max("id").alias("owner"), F.count("*").alias("n")).where("n > 1 and owner is not null").select("key", "owner")
    owners = scratch.table(owners, "owners")
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    revisit = F.col("owner").isNotNull() & ~F.col("owner").eqNullSafe(F.col("id"))
    return keyed.join(owners, "key", "left").select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        name("id").alias("record_id"),
        "target_uri",
        F.when(revisit, name("owner")).alias("refers_to"),
        F.sha1("payload").alias("payload_digest"),
        "payload_bytes",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def archive_pages(pages: DataFrame, folder: str | None = None, least_bytes: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write pages as WARC records (see ``page_records``), read the archives back and return a row for each record.

    ``page_id``, ``url``, ``payload_bytes``, ``payload_digest`` (lower-case SHA-1 of the payload as read, or as declared by a revisit),
    ``record_type`` and ``refers_to`` (the id of the page that a revisit refers to).  Null pages have an empty payload; null
    ids and addresses come back null; characters that cannot stand in an address come back percent-encoded.  An empty table
    gives an empty result.  Other columns are not read.  Without ``folder``, archives lie below ``spark.checkpoint.dir``
    until the driver ends."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    folder = folder or f"{scratch.root}/archives"
    write_warc(page_records(pages, scratch, least_bytes, id_col, url_col, html_col), folder)
    read = read_warc(spark, folder, content=False).where("gap is null and record_type in ('response', 'revisit')")
    return read.select(
        F.expr("try_cast(regexp_extract(record_id, '^<urn:page:(-?[0-9]+)>$', 1) as bigint)").alias("page_id"),
        F.col("target_uri").alias("url"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.expr("try_cast(regexp_extract(refers_to, '^<urn:page:(-?[0-9]+)>$', 1) as bigint)").alias("refers_to"),
    )
