"""WARC archives with a two-level capture index.

*Writing.* Each task writes archives of about ``ARCHIVE_BYTES`` into the shared
folder: one gzip member per record, a ``warcinfo`` record first. Of the records
with equal payloads of at least ``LEAST_PAYLOAD`` bytes, the one with the
largest id is a ``response``, the others are ``revisit`` records that refer to
it and carry no payload. Smaller payloads are always written in full. The task
returns one capture row per record: key, file, offset, length.

*Index.* Captures are sorted by key, the URL with its host reversed
(``org,example)/path``), then by id and payload digest. Each task of the sorted
table writes one index part of about ``PART_CAPTURES`` captures: blocks of
``BLOCK_LINES`` capture lines, compressed one by one, then the part's sparse
directory, the first key of each block. The first keys of the parts are the top
of the directory, one for each ``PART_CAPTURES`` captures.

*Reading.* A lookup finds the part and the block by binary search over these
keys, decompresses that block alone, finds the capture, reads the range of the
archive that holds the record, and checks the payload's digest. ``read_all``
streams whole archives instead, checks every digest, and resolves every revisit
by a lookup of the record that it refers to.

Payloads stay where they are: only digests are grouped, and the repeated ones
are sent to all tasks while they are few. Lookups come sorted by key, dealt by
ranges of keys with id and digest as tie-breaks, so a hot host spreads and
neighbouring lookups share a block; they are streamed, never gathered. Archives
are dealt to readers one by one.

Defined results: a null payload is empty; null ids and URLs are written with
empty headers and come back null; records with one id are told apart by their
digests, so an id and URL with two payloads has two captures; repeated rows (same
id and payload) are equal, so each is what its id makes it; an empty table gives
no archives. Offsets are those of the archives named in the committed capture
table; files of lost tasks are never read.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, functions as F

from pathloom.llm.common import batched, materialise, rows, scratch_path, sent, spread

ARCHIVE_BYTES = 32_000_000
LEAST_PAYLOAD = 1000
BLOCK_LINES = 500
PART_CAPTURES = 500_000
DATE = "2000-01-01T00:00:00Z"

_CAPTURE = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string()), ("digest", pa.string())])
_CAPTURE_DDL = "key string, page_id long, file string, offset long, length long, record_type string, digest string"


def capture_key(url: Column) -> Column:
    """The URL with its host reversed: ``http://www.example.org:80/a?b`` is ``org,example,www:80)/a?b``."""
    host = F.lower(F.regexp_extract(url, r"(?s)^[^:/?#]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rest = F.regexp_extract(url, r"(?s)^[^:/?#]*://(?:[^/?#@]*@)?[^/?#:]*(.*)$", 1)
    reversed_host = F.array_join(F.reverse(F.split(host, r"\.")), ",")
    made = F.when(url.rlike(r"(?s)^[^:/?#]*://"), F.concat(reversed_host, F.regexp_replace(rest, r"(?s)^(:\d+)?(.*)$", "$1)$2")))
    return F.coalesce(made, url, F.lit(""))


def _record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, refers_key: str | None) -> bytes:
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_escaped(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>", f"X-Refers-To-Key: {_escaped(refers_key)}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + payload + b"\r\n\r\n"


def _escaped(value: str | None) -> str:
    """Header values are one line; null is told from empty."""
    return "-" if value is None else "=" + re.sub(r"[%\r\n]", lambda m: f"%{ord(m[0]):02X}", value)


def _plain(value: str) -> str | None:
    return None if value == "-" else re.sub(r"%(25|0D|0A)", lambda m: chr(int(m[1], 16)), value[1:])


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and content block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return fields, rest[:size]


def _id(urn: str) -> int | None:
    return int(urn[10:-1]) if urn[10:-1] else None


def classify(pages: DataFrame, id_column: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, html, key, payload digest, record_type, refers_to, refers_key)."""
    own = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    own = own.withColumns({"key": capture_key(F.col("url")), "digest": F.sha1(F.col("html").cast("binary"))})
    large = own.where(F.octet_length("html") >= LEAST_PAYLOAD).groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("page_id", "key")).alias("first"))
    large = large.where("n > 1").select(F.col("digest").alias("d"), "first")
    joined = own.join(sent(large), own["digest"] == large["d"], "left")
    revisit = F.col("first.page_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id")) & (F.octet_length("html") >= LEAST_PAYLOAD)
    return joined.select(
        "page_id", "url", "html", "key", "digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first.page_id")).alias("refers_to"),
        F.when(revisit, F.col("first.key")).alias("refers_key"),
    )


def write_archives(pages: DataFrame, folder: str, id_column: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write the archives; one capture row per record: key, page_id, file, offset, length, record_type, digest."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        for page_id, link, text, key, digest, kind, refers_to, refers_key in rows(batches, "page_id", "url", "html", "key", "digest", "record_type", "refers_to", "refers_key"):
            if out is None:
                name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                out = store.open_output_stream(f"{root}/{name}", compression=None)
                info = b"software: pathloom\r\nformat: WARC File Format 1.1\r\n"
                head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
                at += _put(out, head.encode() + info + b"\r\n\r\n")
            payload = text.encode("utf-8", "surrogatepass")
            size = _put(out, _record(kind, page_id, link, b"" if kind == "revisit" else payload, digest, len(payload), refers_to, refers_key))
            yield key, page_id, name, at, size, kind, digest
            at += size
            if at >= ARCHIVE_BYTES:
                out.close()
                out = None
        if out is not None:
            out.close()

    classified = classify(pages, id_column, url, html)
    return materialise(classified.mapInArrow(lambda it: batched(write(it), _CAPTURE), _CAPTURE_DDL), "captures")


def _put(out: pa.NativeFile, data: bytes) -> int:
    packed = gzip.compress(data, 6, mtime=0)
    out.write(packed)
    return len(packed)


def build_index(captures: DataFrame, folder: str) -> DataFrame:
    """Write index parts over the captures, sorted by key, id and digest; one row per part: part, first_key, first_id,
    first_digest, blocks, n."""
    schema = pa.schema([("part", pa.string()), ("first_key", pa.string()), ("first_id", pa.int64()), ("first_digest", pa.string()), ("blocks", pa.int64()), ("n", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name, at, n, held, out = f"{uuid.uuid4().hex}.idx", 0, 0, [], None
        directory: list[str] = []
        first: tuple = ()

        def block() -> int:
            packed = zlib.compress("\n".join(map(_line, held)).encode("utf-8", "surrogatepass"), 6)
            out.write(packed)
            directory.append("\t".join([_line(held[0]), str(at), str(len(packed))]))
            return len(packed)

        for row in rows(batches, *_CAPTURE.names):
            if out is None:
                out, first = store.open_output_stream(f"{root}/{name}", compression=None), (row[0], row[1], row[6])
            held.append(row)
            if len(held) == BLOCK_LINES:
                at, n, held = at + block(), n + len(held), []
        if held:
            at, n = at + block(), n + len(held)
        if out is not None:
            packed = zlib.compress("\n".join(directory).encode("utf-8", "surrogatepass"), 6)
            out.write(packed + len(packed).to_bytes(8, "little"))
            out.close()
            yield name, *first, len(directory), n

    parts = max(1, -(-captures.count() // PART_CAPTURES))
    ordered = captures.repartitionByRange(parts, "key", "page_id", "digest").sortWithinPartitions("key", "page_id", "digest")
    top = ordered.mapInArrow(lambda it: batched(write(it), schema), "part string, first_key string, first_id long, first_digest string, blocks long, n long")
    return materialise(top, "directory")


def _line(capture: tuple) -> str:
    key, page_id, file, offset, length, kind, digest = capture
    return "\t".join([_escaped(key).replace("\t", "%09"), "" if page_id is None else str(page_id), digest, file, str(offset), str(length), kind])


def _place(line: list[str]) -> tuple[str, tuple[bool, int], str]:
    """The key, id and digest by which a line is sorted."""
    return _plain(line[0].replace("%09", "\t")), _order(int(line[1]) if line[1] else None), line[2]


class Index:
    """Lookups in one index part: its sparse directory, and the last block that was read."""

    def __init__(self, index_folder: str, archive_folder: str, part: str):
        store, root = fs.FileSystem.from_uri(index_folder)
        self.file = store.open_input_file(f"{root}/{part}")
        self.archives, self.archive_root = fs.FileSystem.from_uri(archive_folder)
        size = self.file.size()
        length = int.from_bytes(self.file.read_at(8, size - 8), "little")
        lines = [x.split("\t") for x in zlib.decompress(self.file.read_at(length, size - 8 - length)).decode("utf-8", "surrogatepass").split("\n")]
        self.keys = [_place(x) for x in lines]
        self.blocks = [(int(x[-2]), int(x[-1])) for x in lines]
        self.block_at, self.block_keys, self.block = -1, [], []
        self.archive: tuple[str, pa.NativeFile] | None = None

    def find(self, key: str, page_id: int | None, digest: str) -> tuple[str, int, int] | None:
        """(file, offset, length) of a capture, by binary search over the directory and inside one block."""
        wanted = key, _order(page_id), digest
        at = bisect.bisect_right(self.keys, wanted) - 1
        if at < 0:
            return None
        if at != self.block_at:
            offset, length = self.blocks[at]
            self.block = [x.split("\t") for x in zlib.decompress(self.file.read_at(length, offset)).decode("utf-8", "surrogatepass").split("\n")]
            self.block_keys, self.block_at = [_place(x) for x in self.block], at
        k = bisect.bisect_left(self.block_keys, wanted)
        if k == len(self.block) or self.block_keys[k] != wanted:
            return None
        return self.block[k][3], int(self.block[k][4]), int(self.block[k][5])

    def record(self, where: tuple[str, int, int]) -> tuple[dict[str, str], bytes]:
        file, offset, length = where
        if self.archive is None or self.archive[0] != file:
            self.archive = file, self.archives.open_input_file(f"{self.archive_root}/{file}")
        return parse_record(gzip.decompress(self.archive[1].read_at(length, offset)))


def _checked(payload: bytes, digest: str) -> str:
    if hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError("a payload is not the one that its record names")
    return digest


def _order(page_id: int | None) -> tuple[bool, int]:
    """Nulls first, as Spark sorts them."""
    return page_id is not None, page_id or 0


def lookup(wanted: DataFrame, directory: DataFrame, index_folder: str, archive_folder: str) -> DataFrame:
    """For each distinct (key, page_id, digest): payload_bytes of the record read from its archive, or null.

    The top of the directory, one key for each ``PART_CAPTURES`` captures, is what each task needs to find a lookup's
    part. A record that carries no payload (a revisit) has 0 bytes.
    """
    schema = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("digest", pa.string()), ("payload_bytes", pa.int64())])
    parts = sorted((p["first_key"], _order(p["first_id"]), p["first_digest"], p["part"]) for p in directory.collect())
    top = [p[:3] for p in parts]

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        at, index = -1, None
        for key, page_id, digest in rows(batches, "key", "page_id", "digest"):
            part = bisect.bisect_right(top, (key, _order(page_id), digest)) - 1
            if part >= 0 and part != at:
                at, index = part, Index(index_folder, archive_folder, parts[part][3])
            where = index.find(key, page_id, digest) if part >= 0 else None
            payload = None
            if where:
                fields, payload = index.record(where)
                if fields["WARC-Type"] == "response":
                    _checked(payload, digest)
            yield key, page_id, digest, None if payload is None else len(payload)

    asked = wanted.select("key", F.col("page_id").cast("long").alias("page_id"), "digest").distinct()
    dealt = asked.repartitionByRange("key", "page_id", "digest").sortWithinPartitions("key", "page_id", "digest")
    return dealt.mapInArrow(lambda it: batched(answer(it), schema), "key string, page_id long, digest string, payload_bytes long")


def read_archives(captures: DataFrame, folder: str) -> DataFrame:
    """Every page record of the archives that ``captures`` names, streamed: page_id, url, record_type, refers_to,
    refers_key, the payload's digest, checked where the record holds it, and its length (null for a revisit)."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("refers_key", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        store, root = fs.FileSystem.from_uri(folder)
        for (file,) in rows(batches, "file"):
            with store.open_input_stream(f"{root}/{file}", compression=None) as source:
                for data in _members(source):
                    fields, block = parse_record(data)
                    if fields["WARC-Type"] == "warcinfo":
                        continue
                    again = fields["WARC-Type"] == "revisit"
                    yield (
                        _id(fields["WARC-Record-ID"]), _plain(fields["WARC-Target-URI"]), fields["WARC-Type"],
                        _id(fields["WARC-Refers-To"]) if again else None, _plain(fields["X-Refers-To-Key"]) if again else None,
                        None if again else len(block), fields["WARC-Payload-Digest"][5:] if again else _checked(block, fields["WARC-Payload-Digest"][5:]),
                    )

    files = captures.groupBy("file").agg(F.max(F.col("offset") + F.col("length")).alias("size"))
    n, size = files.agg(F.count("*"), F.sum("size")).first()
    files = spread(files.select("file"), n, size or 0)
    ddl = "page_id long, url string, record_type string, refers_to long, refers_key string, payload_bytes long, payload_digest string"
    return files.mapInArrow(lambda it: batched(read(it), schema), ddl)


def _members(source: pa.NativeFile) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    unpack, parts, data = zlib.decompressobj(31), [], source.read(1 << 20)
    while data:
        parts.append(unpack.decompress(data))
        if unpack.eof:
            yield b"".join(parts)
            data, unpack, parts = unpack.unused_data, zlib.decompressobj(31), []
            if data:
                continue
        data = source.read(1 << 20)
    if any(parts):
        raise ValueError("an archive ends inside a record")


def read_all(captures: DataFrame, directory: DataFrame, archive_folder: str, index_folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, revisits resolved by the index."""
    records = materialise(read_archives(captures, archive_folder), "records")
    full = records.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    again = records.where("record_type = 'revisit'").select("page_id", "payload_digest", "record_type", "refers_to", "refers_key")
    wanted = again.select(F.col("refers_key").alias("key"), F.col("refers_to").alias("page_id"), F.col("payload_digest").alias("digest"))
    found = materialise(lookup(wanted, directory, index_folder, archive_folder), "lookups")
    targets = found.select(F.col("key").alias("k"), F.col("page_id").alias("i"), F.col("digest").alias("d"), "payload_bytes")
    solved = again.join(sent(targets), (F.col("refers_key") == F.col("k")) & (F.col("refers_to") == F.col("i")) & (F.col("payload_digest") == F.col("d")), "left")
    return full.unionByName(solved.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


def folders(pages: DataFrame) -> tuple[str, str]:
    return scratch_path(pages.sparkSession, "warc"), scratch_path(pages.sparkSession, "warc-index")
