"""WARC archives of web pages and a two-level index of their captures.

Archives: one gzip member for each record, so a record is read by its range.
First level: index files of compressed blocks of capture lines, sorted by
reversed-host key ("com,example,www)/path") and page.  Second level: each index
file ends with a sparse directory, the first key, place and length of each
block; the first keys of the files say which file to open.  A lookup is a binary
search over files, one over blocks, a range read of one block, and a range read
of the record.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote, urlsplit

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from measurelake.llm.common import map_arrow, map_groups, run_arrow, settle
from measurelake.llm.files import RangeReader, binary, list_files, read_files, write_files

SMALLEST_REVISIT = 1000  # payloads below this many bytes are always written
ARCHIVE_BYTES = 32 << 20  # an archive is closed when it has grown to this
BLOCK_LINES = 300
INDEX_LINES = 50_000  # an index file is closed after this many lines
_TAIL = b"\n"  # what the writer of files puts behind the content

_PAGE = "urn:x-page:"
_CAPTURE = "key string, page_id long, archive long, at long, size long"


class Record(NamedTuple):
    """A record as read: named fields, and the payload behind the HTTP header."""

    fields: dict[str, str]
    payload: bytes

    @property
    def page_id(self) -> int | None:
        return _page_number(self.fields["WARC-Record-ID"])


def reversed_host_key(url: str | None) -> str:
    """Sort key of a URL: host reversed, lower case, no scheme, fragment, "www." or default port.

    A null or unreadable URL is its own key, as far as it goes.
    """
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return (url or "").lower()
    host = host.removeprefix("www.")
    port_text = f":{port}" if port and (parts.scheme, port) not in (("http", 80), ("https", 443)) else ""
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{port_text}){parts.path or '/'}{query}"


def _page_number(uri: str) -> int | None:
    number = uri.strip("<>").removeprefix(_PAGE)
    return None if number == "none" else int(number)


def _page_uri(page_id: int | None) -> str:
    return f"<{_PAGE}{'none' if page_id is None else page_id}>"


def _member(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [f"{name}: {value}" for name, value in (*fields, ("Content-Length", str(len(block))))]
    head = "\r\n".join(["WARC/1.1", *lines, "", ""]).encode()
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(b"".join([head, block, b"\r\n\r\n"])) + packer.flush()


def page_record(
    page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None,
    date: str,
) -> bytes:
    """The gzip member of a page: a response, or a revisit of page ``refers_to``."""
    revisit = refers_to is not None
    # Control characters and blanks would end the field.
    target = quote(url, safe="".join(map(chr, range(0x21, 0x7F)))) if url else ""
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _page_uri(page_id)),
        ("WARC-Date", date),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if revisit:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        fields += [("WARC-Profile", profile), ("WARC-Refers-To", _page_uri(refers_to))]
        return _member(fields, http + b"\r\n")
    return _member(fields, http + b"Content-Length: %d\r\n\r\n" % len(payload) + payload)


def read_record(raw: bytes) -> Record:
    """A record from its uncompressed bytes."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return Record(fields, block.partition(b"\r\n\r\n")[2])


def members(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, bytes) of each gzip member of an archive."""
    at, view = 0, memoryview(content)
    while bytes(view[at : at + 2]) == b"\x1f\x8b":
        unpack, parts, end = zlib.decompressobj(31), [], at
        while not unpack.eof:
            step = view[end : end + 16_384]
            if not step:
                raise ValueError("the archive ends within a record")
            parts.append(unpack.decompress(step))
            end += len(step)
        end -= len(unpack.unused_data)
        yield at, end - at, b"".join(parts)
        at = end


def write_archives(
    pages: DataFrame, path: str, date: str = "2000-01-01T00:00:00Z", id_col: str = "page_id",
    url_col: str = "url", html_col: str = "html",
) -> str:
    """Write a record for each row, payload the UTF-8 html (null: empty).

    Of records with equal payloads of at least 1000 bytes the one with the largest
    page id is the response, the others revisit it.  Rows that share that id are
    all responses.  Rows with a null id are never referred to; with other rows of
    their payload they are revisits.  Null URLs have an empty target.
    """
    base = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
        F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    # Settled, so that both sides of the join are plain shuffles and a common page is split.
    copies = settle(
        base.where(F.length("payload") >= SMALLEST_REVISIT).groupBy(F.col("digest").alias("of"))
        .agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n")).where("n > 1"), "copies")
    told = base.join(copies, F.col("digest") == F.col("of"), "left").select(
        "page_id", "url", "payload", "digest",
        F.when(~F.col("page_id").eqNullSafe(F.col("original")), F.col("original")).alias("refers_to"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        parts: list[bytes] = []
        size = 0

        def start() -> bytes:
            block = json.dumps({"part": part, "seq": seq}).encode()
            return _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:x-archive:{part}-{seq}>"),
                            ("WARC-Date", date), ("Content-Type", "application/json")], block)

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            for row in zip(
                rows.column("page_id").to_pylist(), rows.column("url").to_pylist(),
                binary(rows, "payload"), rows.column("digest").to_pylist(),
                rows.column("refers_to").to_pylist(), strict=True,
            ):
                parts = parts or [start()]
                parts.append(page_record(*row, date))
                size += len(parts[-1])
                if size > ARCHIVE_BYTES:
                    yield _content(b"".join(parts))
                    parts, size, seq = [], 0, seq + 1
        if parts:
            yield _content(b"".join(parts))

    # Readers of gzip skip zero bytes behind the last member.
    return write_files(run_arrow(told, run, "content binary"), "content", path, "\0")


def _content(content: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], ["content"])


def archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, content): archives by a number made from their file's name."""
    found = read_files(spark, path)
    return found.select(F.xxhash64(F.element_at(F.split("path", "/"), -1)).alias("archive"), "content")


def _captures(rows: pa.Table) -> pa.RecordBatch:
    out: list[tuple] = []
    for archive, content in zip(rows.column("archive").to_pylist(), binary(rows, "content"), strict=True):
        for at, size, raw in members(content):
            record = read_record(raw)
            if record.fields["WARC-Type"] != "warcinfo":
                key = reversed_host_key(record.fields["WARC-Target-URI"])
                out.append((key, record.page_id, archive, at, size))
    return _batch(out, ["key", "page_id", "archive", "at", "size"])


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    text = {"key", "payload_digest", "record_type"}
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.string() if n in text else pa.int64())
         for n, c in zip(names, columns, strict=True)], names,
    )


def write_index(spark: SparkSession, archive_path: str, path: str) -> str:
    """Index all records of a folder of archives."""
    found = settle(map_arrow(archives(spark, archive_path), _captures, _CAPTURE), "captures")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "page_id"]  # by page too: a host or URL may have a third of all captures
    ordered = found.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: list[tuple] = []
        for batch in batches:
            lines += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            while len(lines) >= INDEX_LINES:
                yield _content(_index_file(lines[:INDEX_LINES]))
                lines = lines[INDEX_LINES:]
        if lines:
            yield _content(_index_file(lines))

    return write_files(run_arrow(ordered, run, "content binary"), "content", path, _TAIL.decode())


def _index_file(lines: list[tuple]) -> bytes:
    """Blocks, the directory of their first lines, and the directory's length."""
    blocks, directory, at = [], [], 0
    for first in range(0, len(lines), BLOCK_LINES):
        block = zlib.compress(json.dumps(lines[first : first + BLOCK_LINES]).encode(), 6)
        directory.append([*lines[first][:2], at, len(block)])
        blocks.append(block)
        at += len(block)
    packed = zlib.compress(json.dumps(directory).encode(), 6)
    return b"".join([*blocks, packed, len(packed).to_bytes(8, "little")])


class IndexFile:
    """Reads an index file by ranges: its directory at once, its blocks as they are asked for."""

    def __init__(self, reader: RangeReader, length: int) -> None:
        self._read = reader.read
        end = length - 8 - len(_TAIL)
        size = int.from_bytes(reader.read(end, 8), "little")
        directory = json.loads(zlib.decompress(reader.read(end - size, size)))
        self.first = tuple(directory[0][:2])
        self.firsts = [_order(key, page) for key, page, *_ in directory]
        self._ranges = [(at, size) for *_, at, size in directory]
        self._open: tuple[int, list] = (-1, [])

    def find(self, key: str, page_id: int | None) -> list[tuple[int, int, int]]:
        """(archive, offset, length) of the captures of a page under a key."""
        wanted = _order(key, page_id)
        found: list[tuple[int, int, int]] = []
        # Rows repeated as a whole may begin in earlier blocks.
        number = bisect_right(self.firsts, wanted) - 1
        while number >= 0:
            if self._open[0] != number:
                at, size = self._ranges[number]
                self._open = number, json.loads(zlib.decompress(self._read(at, size)))
            found += [tuple(line[2:]) for line in self._open[1] if (line[0], line[1]) == (key, page_id)]
            if self.firsts[number] < wanted:
                break
            number -= 1
        return found


def _order(key: str, page_id: int | None) -> tuple:
    """Spark's order: strings by their UTF-8 bytes, nulls first."""
    return key.encode("utf-8", "surrogatepass"), page_id is not None, page_id or 0


def _numbered(files: DataFrame) -> DataFrame:
    """Files with a number made from their name."""
    return files.withColumn("number", F.xxhash64(F.element_at(F.split("path", "/"), -1)))


def index_files(spark: SparkSession, path: str) -> DataFrame:
    """(number, path, length, key, page_id) of the files of an index and their first captures."""
    def first(rows: pa.Table) -> pa.Table:
        firsts = []
        for at, length in zip(rows.column("path").to_pylist(), rows.column("length").to_pylist(), strict=True):
            with RangeReader(at) as reader:
                firsts.append(IndexFile(reader, length).first)
        return rows.append_column("key", pa.array([k for k, _ in firsts], pa.string())).append_column(
            "page_id", pa.array([p for _, p in firsts], pa.int64()))

    listed = _numbered(list_files(spark, path)).select("number", "path", "length")
    return map_arrow(listed, first, "number long, path string, length long, key string, page_id long")


def lookup(spark: SparkSession, wanted: DataFrame, index_path: str) -> DataFrame:
    """(page_id, archive, at, size) of the captures of the pages (key, page_id) of ``wanted``.

    Pages asked for and first captures of the index files are sorted together, by
    range, so that each page follows the file that has it; the driver gets one row for
    each range.  A task then has the pages of an index file: it reads the directory and
    the blocks that it needs, by their ranges.

    A page with several captures has a row for each; one that is not in the index has none, a null id
    is looked up like any other, and rows of ``wanted`` that are equal are asked for once each.
    Other columns are ignored; an empty index or table gives an empty result.
    """
    files = settle(index_files(spark, index_path), "index_files")
    aimed = _aimed(wanted, files)

    def search(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        out: list[tuple] = []
        keys, pages = rows.column("key").to_pylist(), rows.column("page_id").to_pylist()
        paths, lengths = rows.column("path"), rows.column("length")
        for at, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            with RangeReader(paths[at].as_py()) as reader:
                index = IndexFile(reader, lengths[at].as_py())
                for i in range(at, end):
                    out += [(pages[i], *found) for found in index.find(keys[i], pages[i])]
        return _batch(out, ["page_id", "archive", "at", "size"])

    return map_groups(aimed, ["number"], search, "page_id long, archive long, at long, size long",
                      ["key", "page_id"])


def _aimed(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """``wanted`` with (number, path, length) of every index file that may have its captures.

    That is the last file that begins before a page, and those that begin with it: rows
    repeated as a whole may go on from file to file.
    """
    file = F.struct("number", "path", "length").alias("file")
    none = F.lit(None).cast(files.select(file).schema["file"].dataType).alias("file")
    both = files.select("key", "page_id", file).union(wanted.select("key", "page_id", none))
    order = ["key", "page_id"]
    ranged = both.withColumn("asked", F.col("file").isNull()).repartitionByRange(*order)
    dealt = settle(ranged.withColumn("part", F.spark_partition_id().cast("long")), "aimed")
    place = F.struct("key", "page_id")
    ends = dealt.where("not asked").groupBy("part").agg(F.max_by("file", place).alias("file"), F.max(place).alias("place"))
    # One row for a range: ranges are as many as shuffle partitions, whatever the corpus.
    last = {r["part"]: ((r["place"]["key"], r["place"]["page_id"]), tuple(r["file"])) for r in ends.collect()}

    def aim(rows: pa.Table, starts: np.ndarray) -> pa.Table:
        out: list[tuple] = []
        parts, keys, pages = (rows.column(c).to_pylist() for c in ("part", "key", "page_id"))
        files_ = rows.column("file").to_pylist()
        for at, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            before = max((p for p in last if p < parts[at]), default=None)
            # Files that begin with the place at hand, and the last one that begins before it.
            here: list[tuple] = []
            place, earlier = (None, None) if before is None else last[before]
            if before is not None:
                here = [earlier]
                earlier = None
            for i in range(at, end):
                if (keys[i], pages[i]) != place:
                    place, earlier, here = (keys[i], pages[i]), (here[-1] if here else earlier), []
                if files_[i] is not None:
                    here.append(tuple(files_[i].values()))
                else:
                    out += [(*f, keys[i], pages[i]) for f in ([earlier] if earlier else []) + here]
        columns = list(zip(*out, strict=True)) or [[]] * 5
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["number", "path", "length", "key", "page_id"]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)})

    return map_groups(dealt, ["part"], aim, "number long, path string, length long, key string, page_id long",
                      [*order, "asked"])


def fetch(spark: SparkSession, captures: DataFrame, archive_path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of captured records.

    A task has the captures of an archive, opens it where it is, and reads their ranges;
    no archive is shuffled.  Sizes and digests are computed from the payloads.  A
    revisit has those of the response that it refers to.

    A capture asked for twice comes twice; captures of no archive of the folder have no
    row.  Other columns are ignored; empty tables give an empty result.
    """
    listed = _numbered(list_files(spark, archive_path)).select(F.col("number").alias("archive"), "path")
    met = captures.select("archive", "at", "size").join(listed, "archive")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def read(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        out: list[tuple] = []
        paths, ats, sizes = rows.column("path"), rows.column("at").to_pylist(), rows.column("size").to_pylist()
        for at, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            with RangeReader(paths[at].as_py()) as reader:
                for raw in reader.read_all(list(zip(ats[at:end], sizes[at:end], strict=True))):
                    record = read_record(zlib.decompress(raw, 31))
                    if record.fields["WARC-Type"] == "revisit":
                        kept = base64.b32decode(record.fields["WARC-Payload-Digest"].removeprefix("sha1:"))
                        out.append((record.page_id, None, kept.hex(), "revisit",
                                    _page_number(record.fields["WARC-Refers-To"])))
                    else:
                        digest = hashlib.sha1(record.payload).hexdigest()
                        out.append((record.page_id, len(record.payload), digest, "response", None))
        return _batch(out, names)

    schema = ("page_id long, payload_bytes long, payload_digest string, record_type string, "
              "refers_to long")
    records = settle(map_groups(met, ["archive"], read, schema, ["at"]), "records")
    originals = (
        records.where("record_type = 'response'")
        .groupBy(F.col("page_id").alias("of"), F.col("payload_digest").alias("same"))
        .agg(F.max("payload_bytes").alias("original_bytes"))
    )
    resolved = records.where("record_type = 'revisit'").join(
        originals, (F.col("refers_to") == F.col("of")) & (F.col("payload_digest") == F.col("same")), "left"
    ).withColumn("payload_bytes", F.col("original_bytes"))
    return records.where("record_type = 'response'").select(*names).union(resolved.select(*names))


def page_keys(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(key, page_id) by which the pages of a table are looked up."""
    def run(rows: pa.Table) -> pa.RecordBatch:
        safe = "".join(map(chr, range(0x21, 0x7F)))
        urls = [quote(u, safe=safe) if u else "" for u in rows.column("url").to_pylist()]
        return _batch(list(zip(map(reversed_host_key, urls), rows.column("page_id").to_pylist(),
                               strict=True)), ["key", "page_id"])

    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"))
    # A page asked for twice would be fetched twice.
    return map_arrow(base, run, "key string, page_id long").distinct()
