"""Blocked document files: magic, codec name, documents per block, then compressed blocks of packed documents."""

from __future__ import annotations

import bz2
import glob
import io
import lzma
import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from scholion.sources.msgpack import Unpacker, pack

# Fixed values of the format.
MAGIC = b"Dmf1"
EXTENSION = ".blocks"
BOUNDARIES = range(12, 31)
PER_BLOCK = 128
#: Blocks that one input partition reads.
BLOCKS_PER_TASK = 64
SCHEMA = "file string, block_pos long, doc_pos long, data binary"

_codecs: dict[str, tuple[str, Callable[[bytes], bytes], Callable[[bytes], bytes]]] = {}


def register_codec(name: str, compress: Callable[[bytes], bytes], decompress: Callable[[bytes], bytes], stored_name: str | None = None) -> None:
    """Make a compression available; ``stored_name`` is what files say, where several levels share one decoder."""
    if name in _codecs:
        raise ValueError(f"codec {name} exists")
    _codecs[name] = (stored_name or name, compress, decompress)


def unregister_codec(name: str) -> None:
    del _codecs[name]


def codec(name: str) -> tuple[str, Callable[[bytes], bytes], Callable[[bytes], bytes]]:
    if name not in _codecs:
        raise ValueError(f"codec {name} is not available")
    return _codecs[name]


register_codec("none", bytes, bytes)
register_codec("zip", zlib.compress, zlib.decompress)
register_codec("bzip2", bz2.compress, bz2.decompress)
register_codec("zipsq", lambda x: zlib.compress(zlib.compress(x, 9), 9), lambda x: zlib.decompress(zlib.decompress(x)))
register_codec("lzma", lzma.compress, lzma.decompress)
try:
    import zstandard

    for _name, _level in (("zstd", 3), ("zstd:high", 9), ("zstd:ultra", 22)):
        register_codec(_name, lambda x, n=_level: zstandard.ZstdCompressor(level=n).compress(x), lambda x: zstandard.ZstdDecompressor().decompressobj().decompress(x), "zstd")
except ImportError:
    pass
try:
    import lz4.frame

    register_codec("lz4", lz4.frame.compress, lz4.frame.decompress)
except ImportError:
    pass


def deflate(data: bytes) -> bytes:
    return zlib.compress(data, 9)


def inflate(data: bytes) -> bytes:
    return zlib.decompress(data)


def unframed(data: bytes) -> bytes:
    """Take out the boundary marks: a first byte k, then four bytes at each multiple of 2**k bytes."""
    step = 1 << data[0]
    if data[0] not in BOUNDARIES:
        raise ValueError("bad boundary")
    parts = [data[1:step]]
    parts += [data[at + 4 : at + step] for at in range(step, len(data), step)]
    return b"".join(parts)


class Framing:
    """Writes with boundary marks: each is the distance, negative, to the start of the last block."""

    def __init__(self, out: BinaryIO, boundary: int = 20):
        if boundary not in BOUNDARIES:
            raise ValueError("bad boundary")
        self.out, self.step = out, 1 << boundary
        out.write(bytes([boundary]))
        self.written = self.last = 1

    def split(self) -> None:
        self.last = self.written

    def write(self, data: bytes) -> None:
        at = 0
        while at < len(data):
            room = self.step - self.written % self.step
            # a mark comes before the byte that would stand at the boundary
            if room == self.step and self.written >= self.step and self.written != self._marked:
                self.out.write(struct.pack(">i", max(self.last - self.written, -(2**31))))
                self.written += 4
                room = self.step - self.written % self.step
                self._marked = self.written
            part = data[at : at + room]
            self.out.write(part)
            self.written += len(part)
            at += len(part)

    _marked = 0


@dataclass
class Block:
    position: int
    payload: bytes  # compressed
    decompress: Callable[[bytes], bytes]

    def documents(self) -> Iterator[tuple[int, bytes]]:
        """(position in the block, encoded document)."""
        u = Unpacker(self.decompress(self.payload))
        while u.at < len(u.data):
            at = u.at
            yield at, u.one()


def blocks(data: bytes, framing: bool | None = None) -> Iterator[Block]:
    """The blocks of a file's bytes; framing is recognised unless it is given."""
    if framing or (framing is None and data[:4] != MAGIC and data[1:5] == MAGIC):
        data = unframed(data)
    if data[:4] != MAGIC:
        raise ValueError("not a blocked document file")
    u = Unpacker(data, 4)
    decompress = codec(u.one())[2]
    u.one()
    if u.one():
        raise ValueError("advanced files are not defined")
    while u.at < len(data):
        at = u.at
        yield Block(at, u.one(), decompress)


def document_at(data: bytes, block_pos: int, doc_pos: int) -> bytes:
    """Random access: one document by its block's and its own position."""
    header = Unpacker(data, 4)
    decompress = codec(header.one())[2]
    payload = Unpacker(data, block_pos).one()
    return Unpacker(decompress(payload), doc_pos).one()


class BlockWriter:
    """Collects documents and writes them in blocks."""

    def __init__(self, out: BinaryIO, per_block: int = PER_BLOCK, codec_name: str = "zip", boundary: int | None = None):
        if per_block < 1:
            raise ValueError("a block holds at least one document")
        self.out: Any = Framing(out, boundary) if boundary is not None else out
        self.per_block = per_block
        stored, self.compress, _ = codec(codec_name)
        self.out.write(MAGIC + pack(stored) + pack(per_block) + pack(False))
        self._split()
        self.held: list[bytes] = []

    def _split(self) -> None:
        if isinstance(self.out, Framing):
            self.out.split()

    def write(self, document: bytes) -> None:
        self.held.append(pack(bytes(document)))
        if len(self.held) == self.per_block:
            self.flush()

    def flush(self) -> None:
        if self.held:
            self.out.write(pack(self.compress(b"".join(self.held))))
            self._split()
            self.held = []


def read_blocked(spark: SparkSession, path: str, count_only: bool = False) -> DataFrame:
    """(file, block_pos, doc_pos, data) of blocked files in any store that Spark reads; one task reads whole files.

    With ``count_only``, (file, block_pos, n): documents of each block, decompressed but not kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for block in blocks(content.as_py()):
                    docs = list(block.documents())
                    n = len(docs)
                    if count_only:
                        yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block.position]), pa.array([n])], ["file", "block_pos", "n"])
                        continue
                    yield pa.RecordBatch.from_arrays([pa.array([file] * n), pa.array([block.position] * n), pa.array([d[0] for d in docs]), pa.array([d[1] for d in docs], pa.binary())], ["file", "block_pos", "doc_pos", "data"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, block_pos long, n long" if count_only else SCHEMA)


@dataclass
class BlockRange(InputPartition):
    file: str
    positions: tuple[tuple[int, int], ...]  # (position, end) of the blocks in the unframed file


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.per_task = options["path"], int(options.get("blockspertask", BLOCKS_PER_TASK))
        self.framed = options.get("framing") == "boundary"

    def _load(self, file: str) -> bytes:
        with open(file, "rb") as f:
            data = f.read()
        return unframed(data) if self.framed or data[1:5] == MAGIC != data[:4] else data

    def partitions(self) -> list[BlockRange]:
        files = sorted(glob.glob(os.path.join(self.path, f"*{EXTENSION}"))) if os.path.isdir(self.path) else sorted(glob.glob(self.path))
        out = []
        for file in files:
            data = self._load(file)
            starts = [b.position for b in blocks(data, framing=False)]
            ends = [*starts[1:], len(data)]
            places = list(zip(starts, ends, strict=True))
            out += [BlockRange(file, tuple(places[k : k + self.per_task])) for k in range(0, len(places), self.per_task)]
        return out or [BlockRange("", ())]

    def read(self, partition: BlockRange) -> Iterator[pa.RecordBatch]:
        if not partition.positions:
            return
        data = self._load(partition.file)
        decompress = codec(Unpacker(data, 4).one())[2]
        for start, _ in partition.positions:
            docs = list(Block(start, Unpacker(data, start).one(), decompress).documents())
            n = len(docs)
            yield pa.RecordBatch.from_arrays([pa.array([partition.file] * n), pa.array([start] * n, pa.int64()), pa.array([d[0] for d in docs], pa.int64()), pa.array([d[1] for d in docs], pa.binary())], ["file", "block_pos", "doc_pos", "data"])


@dataclass
class _Written(WriterCommitMessage):
    temporary: str
    final: str


class _Writer(DataSourceWriter):
    """A file for each task under a temporary name, renamed when the job commits; folders of earlier data are an error."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.options, self.overwrite = options, overwrite
        self.path = options["path"]
        if not overwrite and glob.glob(os.path.join(self.path, f"*{EXTENSION}")):
            raise FileExistsError(self.path)

    def write(self, rows: Iterator) -> _Written:
        from pyspark import TaskContext

        os.makedirs(self.path, exist_ok=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        temporary = os.path.join(self.path, f".{name}.tmp")
        boundary = self.options.get("boundary")
        with open(temporary, "xb") as f:
            w = BlockWriter(f, int(self.options.get("docsperblock", PER_BLOCK)), self.options.get("codec", "zip"), int(boundary) if boundary else None)
            for row in rows:
                w.write(row[0])
            w.flush()
        return _Written(temporary, os.path.join(self.path, name + EXTENSION))

    def commit(self, messages: list[_Written]) -> None:
        old = glob.glob(os.path.join(self.path, f"*{EXTENSION}")) if self.overwrite else []
        for m in messages:
            if m is not None:
                os.replace(m.temporary, m.final)
        for f in old:
            os.remove(f)

    def abort(self, messages: list[_Written]) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.temporary):
                os.remove(m.temporary)


class BlockedDocuments(DataSource):
    """``spark.read.format("blocked-documents")`` and ``df.select("data").write.format(...)`` over a mounted folder.

    Options: path, codec, docsPerBlock, framing (``boundary``), boundary (12 to 30), blocksPerTask. Reads split a file
    into ranges of blocks. For stores without a mount use ``read_blocked``.
    """

    @classmethod
    def name(cls) -> str:
        return "blocked-documents"

    def schema(self) -> str:
        return SCHEMA

    def _named(self) -> dict[str, str]:
        return {k.lower(): v for k, v in self.options.items()}

    def reader(self, schema) -> _Reader:
        return _Reader(self._named())

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self._named(), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BlockedDocuments)


def file_bytes(documents: list[bytes], **options: Any) -> bytes:
    """A blocked file in memory."""
    out = io.BytesIO()
    w = BlockWriter(out, **options)
    for d in documents:
        w.write(d)
    w.flush()
    return out.getvalue()
