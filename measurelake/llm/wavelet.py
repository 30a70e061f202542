"""Token ids in wavelet matrices: one succinct, compressed file for each shard.

A shard's ids are numbered densely by value.  Plane by plane, from the top bit
of the numbers down, the file keeps one bit for each id, and the ids are then
dealt stably into those with bit 0 and those with bit 1.  With the count of ones
before each chunk of a plane (rank) single ids, counts and the places of an id
are read without unpacking the rest.

File: magic, length of the header, header (JSON), sections.  Sections: the ids
in use (u4), documents' numbers (i8) and lengths (i8), place of each chunk (i8),
ones before each chunk (i8), chunks (zstd).  A last byte "\\n" ends the file.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from measurelake.llm.common import map_arrow, run_arrow, settle
from measurelake.llm.files import binary, read_files, write_files
from measurelake.llm.tokens import crc32, default_path, encoder

MAGIC = b"WVLT0001"
SHARD_IDS = 1 << 20  # a shard is closed before it gets more, unless one document has more
CHUNK_BITS = 1 << 17
_SECTIONS = (("ids", "<u4"), ("documents", "<i8"), ("lengths", "<i8"), ("places", "<i8"),
             ("ones", "<i8"))


def build(ids: np.ndarray, documents: np.ndarray, lengths: np.ndarray, **header: int) -> bytes:
    """The file of a shard: its ids, and the number and length of each document in order."""
    used, codes = _dense(ids)
    width = max(1, int(len(used) - 1).bit_length())
    pack = zstandard.ZstdCompressor(level=1).compress
    chunks: list[bytes] = []
    ones: list[int] = []
    for bit in range(width - 1, -1, -1):
        set_ = (codes & np.uint16(1 << bit)) != 0
        packed = np.packbits(set_)
        before = 0
        for at in range(0, len(codes), CHUNK_BITS):
            ones.append(before)
            before += int(np.count_nonzero(set_[at : at + CHUNK_BITS]))
            chunks.append(pack(packed[at // 8 : (at + CHUNK_BITS) // 8].tobytes()))
        ones.append(before)
        codes = np.concatenate([np.compress(~set_, codes), np.compress(set_, codes)])
    parts = {
        "ids": used, "documents": documents, "lengths": lengths,
        "places": np.concatenate([[0], np.cumsum([len(c) for c in chunks])]), "ones": ones,
    }
    sections = [np.asarray(parts[name], kind).tobytes() for name, kind in _SECTIONS]
    head = json.dumps({**header, "n": len(ids), "width": width, "chunk": CHUNK_BITS,
                       "sizes": [len(s) for s in sections]}).encode()
    return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, *sections, *chunks])


def _dense(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids in use, in order, and each id's number among them."""
    used = np.flatnonzero(np.bincount(ids)) if len(ids) else np.empty(0, np.int64)
    numbers = np.zeros(int(used[-1]) + 1 if len(used) else 0, np.uint16)
    numbers[used] = np.arange(len(used))  # ids of the vocabulary file are below 2**16
    return used, numbers[ids]


class WaveletMatrix:
    """Reads a shard's file: whole, by position, or by id."""

    def __init__(self, content: bytes) -> None:
        if content[:8] != MAGIC:
            raise ValueError("not a wavelet file")
        size = int.from_bytes(content[8:12], "little")
        self.header = json.loads(content[12 : 12 + size])
        self.n, self.width = self.header["n"], self.header["width"]
        at = 12 + size
        for (name, kind), length in zip(_SECTIONS, self.header["sizes"], strict=True):
            setattr(self, name, np.frombuffer(content, kind, length // int(kind[-1]), at))
            at += length
        self._data = memoryview(content)[at:]
        self._chunk = self.header["chunk"]
        self._per_plane = -(-self.n // self._chunk)
        self._unpack = zstandard.ZstdDecompressor().decompress
        self._kept: tuple[int, np.ndarray] = (-1, np.empty(0, bool))
        #: zeros of each plane: where its ones begin in the next plane
        self.zeros = [self.n - int(o) for o in self.ones[self._per_plane :: self._per_plane + 1]]

    def _bits(self, plane: int, chunk: int) -> np.ndarray:
        number = plane * self._per_plane + chunk
        if self._kept[0] != number:
            packed = self._unpack(self._data[self.places[number] : self.places[number + 1]])
            count = min(self._chunk, self.n - chunk * self._chunk)
            bits = np.unpackbits(np.frombuffer(packed, np.uint8), count=count).view(bool)
            self._kept = (number, bits)
        return self._kept[1]

    def _ones_before(self, plane: int, i: int) -> int:
        """rank: ones among the first i bits of a plane."""
        chunk, rest = divmod(i, self._chunk)
        before = int(self.ones[plane * (self._per_plane + 1) + chunk])
        return before + int(np.count_nonzero(self._bits(plane, chunk)[:rest])) if rest else before

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        code = 0
        for plane in range(self.width):
            chunk, rest = divmod(i, self._chunk)
            bit = bool(self._bits(plane, chunk)[rest])
            ones = self._ones_before(plane, i)
            i = self.zeros[plane] + ones if bit else i - ones
            code = code << 1 | bit
        return int(self.ids[code])

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        """Where the occurrences of an id in [lo, hi) lie behind the last plane."""
        code = int(np.searchsorted(self.ids, token))
        if code == len(self.ids) or self.ids[code] != token:
            return 0, 0
        for plane in range(self.width):
            ones = self._ones_before(plane, lo), self._ones_before(plane, hi)
            if code >> (self.width - 1 - plane) & 1:
                lo, hi = self.zeros[plane] + ones[0], self.zeros[plane] + ones[1]
            else:
                lo, hi = lo - ones[0], hi - ones[1]
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of an id in positions [lo, hi)."""
        first, end = self._range(token, lo, self.n if hi is None else hi)
        return end - first

    def select(self, token: int, k: int) -> int:
        """Position of the k-th occurrence (from 0) of an id."""
        first, end = self._range(token, 0, self.n)
        if not 0 <= k < end - first:
            raise IndexError(k)
        i = first + k
        code = int(np.searchsorted(self.ids, token))
        for plane in range(self.width - 1, -1, -1):
            bit = code >> (self.width - 1 - plane) & 1
            i = self._place(plane, bit, i - self.zeros[plane] if bit else i)
        return i

    def _place(self, plane: int, bit: int, k: int) -> int:
        """Position of the k-th one or zero of a plane."""
        start = plane * (self._per_plane + 1)
        before = self.ones[start : start + self._per_plane].astype(np.int64)
        if not bit:
            before = np.arange(self._per_plane) * self._chunk - before
        chunk = int(np.searchsorted(before, k, side="right")) - 1
        places = np.flatnonzero(self._bits(plane, chunk) == bool(bit))
        return chunk * self._chunk + int(places[k - before[chunk]])

    def occurrences(self, token: int) -> list[int]:
        """All positions of an id, ascending."""
        return [self.select(token, k) for k in range(self.count(token))]

    def decode(self) -> np.ndarray:
        """All ids in order."""
        codes = np.zeros(self.n, np.uint16)
        for plane in range(self.width - 1, -1, -1):
            set_ = np.concatenate([self._bits(plane, c) for c in range(self._per_plane)] or
                                  [np.empty(0, bool)])
            zeros = self.zeros[plane]
            above = np.empty_like(codes)
            above[np.flatnonzero(~set_)] = codes[:zeros]
            above[np.flatnonzero(set_)] = codes[zeros:] | np.uint16(1 << (self.width - 1 - plane))
            codes = above
        return self.ids[codes] if self.n else np.empty(0, np.uint32)


def write_shards(
    docs: DataFrame, path: str, end_id: int | None = 2, tokenizer: str | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> str:
    """Encode all texts and write them in ascending document order as wavelet files.

    A shard holds whole documents of one range partition.  Null texts count as
    empty: they have the end id only, or no ids without one.  Rows with the same
    id follow each other in any order, rows with a null id come first.  Other
    columns are ignored; an empty table gives a folder without shards.
    """
    tokenizer = tokenizer or default_path()
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = base.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        encode = encoder(tokenizer).encode_all
        tail = np.array([] if end_id is None else [end_id], np.uint32)
        numbers: list[int | None] = []
        ids: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            missing = [i for i, n in enumerate(numbers) if n is None]
            content = build(
                np.concatenate(ids), np.array([n or 0 for n in numbers], np.int64),
                np.array([len(i) for i in ids], np.int64), part=part, seq=seq, missing=missing,
            )
            return pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], ["content"])

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            texts = encode(binary(rows, "text"))
            for number, text_ids in zip(rows.column("doc_id").to_pylist(), texts, strict=True):
                if numbers and held + len(text_ids) + len(tail) > SHARD_IDS:
                    yield close()
                    numbers, ids, held, seq = [], [], 0, seq + 1
                numbers.append(number)
                ids.append(np.concatenate([text_ids, tail]))
                held += len(ids[-1])
        if numbers:
            yield close()

    return write_files(run_arrow(ordered, run, "content binary"), "content", path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the shards of a folder."""
    # Settled, since decoding the files twice would cost more than writing a few numbers.
    parts = settle(map_arrow(
        read_files(spark, path).select("content"), _documents,
        "part long, seq long, doc_id long, within long, n_tokens long, ids_crc32 long",
    ), "shards")
    # Ids before each shard: a sum within its partition, and one over the partitions.
    shards = parts.groupBy("part", "seq").agg(F.sum("n_tokens").alias("n"))
    totals = shards.groupBy("part").agg(F.sum("n").alias("n"))
    before_part = totals.select("part", _sum_before("n", Window.orderBy("part")).alias("_part"))
    before = shards.join(before_part, "part").select(
        "part", "seq",
        (F.col("_part") + _sum_before("n", Window.partitionBy("part").orderBy("seq"))).alias("at"),
    )
    return parts.join(before, ["part", "seq"]).select(
        "doc_id", (F.col("at") + F.col("within")).alias("start"), "n_tokens", "ids_crc32"
    )


def _sum_before(column: str, window) -> Column:
    return F.coalesce(F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1)),
                      F.lit(0).cast("long"))


def _documents(rows: pa.Table) -> pa.RecordBatch:
    out: list[tuple] = []
    for content in binary(rows, "content"):
        shard = WaveletMatrix(content)
        ids, ends = shard.decode(), np.cumsum(shard.lengths)
        missing = set(shard.header["missing"])
        for i, (number, end, size) in enumerate(
            zip(shard.documents.tolist(), ends.tolist(), shard.lengths.tolist(), strict=True)
        ):
            out.append((shard.header["part"], shard.header["seq"],
                        None if i in missing else number, end - size, size,
                        crc32(ids[end - size : end])))
    names = ["part", "seq", "doc_id", "within", "n_tokens", "ids_crc32"]
    columns = list(zip(*out, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)
