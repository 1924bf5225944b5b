"""Token ids of documents in files of bit or byte planes, and the way back.

Format of a file (numbers little-endian): the magic, a header of five unsigned 32-bit numbers
(bits per id, plane width, ids per chunk, documents, chunks), the compressed document table (id,
number of token ids and whether the id is null of each document, 64-bit each), the planes of all chunks, the chunk index (number of
ids and the compressed length of each plane, 32-bit each), and last the places of document table and
index as 64-bit numbers. A chunk holds a fixed number of ids, the last one of a file the rest. Its ids
are transposed into planes, least significant first, and every plane is compressed by zstandard.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riffle.llm import shared, token_ids

MAGIC = b"IDPLANE2"
_HEADER = struct.Struct("<5I")
_TAIL = struct.Struct("<4Q")
#: Bytes of 32-bit ids that one task writes, and files that one task reads.
PARTITION, FILES = 32_000_000, 2
_MANIFEST = "file string, part long, number long, documents long, ids long"
_ROWS = "file string, position long, doc_id long, start long, n_tokens long, ids binary"


def to_planes(ids: np.ndarray, bits: int, width: int) -> np.ndarray:
    """One row of bytes per plane of ``width`` (1 or 8) bits."""
    if width == 8:
        return np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, : bits // 8].T)
    planes = np.empty((bits, -(-len(ids) // 8)), np.uint8)
    for b in range(bits):
        planes[b] = np.packbits((ids >> np.uint32(b) & np.uint32(1)).astype(np.uint8), bitorder="little")
    return planes


def from_planes(planes: list[bytes], n: int, width: int) -> np.ndarray:
    ids = np.zeros(n, np.uint32)
    for b, plane in enumerate(planes):
        raw = np.frombuffer(plane, np.uint8)
        part = raw if width == 8 else np.unpackbits(raw, count=n, bitorder="little")
        ids |= part.astype(np.uint32) << np.uint32(b * width)
    return ids


def bits_needed(vocabulary: int, width: int) -> int:
    """Bits per id, filled up to whole planes."""
    return -(-max(1, (vocabulary - 1).bit_length()) // width) * width


def encode_file(documents: Iterable[tuple[int | None, bytes]], bits: int, width: int, chunk: int, level: int) -> bytes:
    """A whole file from (document id, ids as 32-bit bytes)."""
    press = zstandard.ZstdCompressor(level=level)
    documents = list(documents)
    table = np.array([(d or 0, len(ids) // 4, d is None) for d, ids in documents], "<i8").reshape(-1, 3)
    ids = np.frombuffer(b"".join(x for _, x in documents), "<u4")
    chunks = [ids[i : i + chunk] for i in range(0, len(ids), chunk)]
    head = MAGIC + _HEADER.pack(bits, width, chunk, len(documents), len(chunks))
    docs = press.compress(table.tobytes())
    body, index = [head, docs], []
    for part in chunks:
        planes = [press.compress(p.tobytes()) for p in to_planes(part, bits, width)]
        index.append([len(part), *map(len, planes)])
        body += planes
    listed = np.array(index, "<u4").tobytes()
    at = sum(map(len, body))
    return b"".join([*body, listed, _TAIL.pack(len(head), len(docs), at, len(listed))])


class PlaneFile:
    """A file's document table and chunk index; chunks are decoded on demand."""

    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a file of id planes")
        self._data = memoryview(data)
        self.bits, self.width, self.chunk, self.n_docs, n_chunks = _HEADER.unpack_from(data, len(MAGIC))
        docs_at, docs_size, index_at, index_size = _TAIL.unpack_from(data, len(data) - _TAIL.size)
        self._unpress = zstandard.ZstdDecompressor()
        table = self._unpress.decompress(self._data[docs_at : docs_at + docs_size])
        self.documents = np.frombuffer(table, "<i8").reshape(-1, 3)
        planes = self.bits // self.width
        self.index = np.frombuffer(self._data[index_at : index_at + index_size], "<u4").reshape(n_chunks, planes + 1)
        sizes = self.index[:, 1:].astype(np.int64).sum(axis=1)
        self._at = docs_at + docs_size + np.concatenate([[0], np.cumsum(sizes)])

    def ids(self, number: int) -> np.ndarray:
        """The ids of one chunk."""
        at, planes = int(self._at[number]), []
        for size in self.index[number, 1:].tolist():
            planes.append(self._unpress.decompress(self._data[at : at + size]))
            at += size
        return from_planes(planes, int(self.index[number, 0]), self.width)

    def __iter__(self) -> Iterator[tuple[int | None, int, bytes]]:
        """Document id, place of its first id in the file, its ids as 32-bit bytes."""
        held, held_at, number, start = np.zeros(0, np.uint32), 0, 0, 0
        for doc_id, n, unknown in self.documents.tolist():
            parts = [held[start - held_at : start - held_at + n]]
            while held_at + len(held) < start + n:
                held_at += len(held)
                held = self.ids(number)
                number += 1
                parts.append(held[: start + n - held_at])
            yield None if unknown else doc_id, start, np.concatenate(parts).astype("<u4").tobytes()
            start += n


def write(
    docs: DataFrame,
    directory: str,
    tokenizer: str,
    doc_id: str = "doc_id",
    text: str = "text",
    end_id: int = 0,
    width: int = 8,
    chunk: int = 65536,
    file_ids: int = 4_000_000,
    level: int = 3,
) -> DataFrame:
    """Encode the texts, append ``end_id`` to each and write them in ascending order of id, null last, to files
    under ``directory``; returns the manifest, one row per file.

    A null text is empty. Rows that share an id, or have none, follow each other in order of their ids' hash. Further
    columns are ignored. An empty table gives no files. Texts are encoded where they are read, and what moves is ids. The name of a file tells the attempt of the task that wrote it; the
    manifest lists those of the attempts that counted, and only they are read.
    """
    from pyarrow import fs

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, press = token_ids.encoder(tokenizer), zstandard.ZstdCompressor(level=1)
        names = ["doc_id", "n", "data"]
        for batch in batches:
            held, ids, size = [], batch["doc_id"], 0
            for found in encode.batch(cell.as_py() for cell in batch["text"]):
                held.append((len(found), press.compress(to_planes(found, 32, 8).tobytes())))
                size += len(held[-1][1])
                if size > 8_000_000:
                    yield pa.RecordBatch.from_arrays([ids[: len(held)], *map(pa.array, zip(*held))], names)
                    held, ids, size = [], ids[len(held) :], 0
            if held:
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, zip(*held))], names)

    # The mark tells equal rows apart, so that they can be dealt to several files.
    held = rows.mapInArrow(encoded, "doc_id long, n long, data binary").withColumn("mark", F.monotonically_increasing_id())
    held = shared.stored(held, "ids")
    total = held.agg(F.sum((F.col("n") + 1) * 4)).first()[0] or 0
    place = [F.col("doc_id").asc_nulls_last(), F.xxhash64("data"), F.col("mark")]
    ordered = held.repartitionByRange(max(1, -(-total // PARTITION)), *place).sortWithinPartitions(*place)

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = token_ids.encoder(tokenizer), TaskContext.get().partitionId()
        system, root = fs.FileSystem.from_uri(directory)
        system.create_dir(root, recursive=True)
        end = struct.pack("<I", end_id)
        bits = bits_needed(max(encode.vocabulary, end_id + 1), width)
        number, waiting, size, unpress = 0, [], 0, zstandard.ZstdDecompressor()

        def flush() -> pa.RecordBatch:
            name = f"ids-{part:07d}-{number:05d}-{TaskContext.get().taskAttemptId()}.planes"
            with system.open_output_stream(f"{root}/{name}") as out:
                out.write(encode_file(waiting, bits, width, chunk, level))
            row = {"file": [name], "part": [part], "number": [number], "documents": [len(waiting)], "ids": [size // 4]}
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for one, data in zip(batch["doc_id"].to_pylist(), batch["data"]):
                planes = np.frombuffer(unpress.decompress(data.as_buffer()), np.uint8).reshape(4, -1)
                ids = from_planes(list(planes), planes.shape[1], 8).astype("<u4").tobytes() + end
                waiting.append((one, ids))
                size += len(ids)
                if size >= 4 * file_ids:
                    yield flush()
                    number, waiting, size = number + 1, [], 0
        if waiting:
            yield flush()

    return shared.stored(ordered.select("doc_id", "data").mapInArrow(files, _MANIFEST), "manifest")


def read(manifest: DataFrame, directory: str) -> DataFrame:
    """``file, position, doc_id, start, n_tokens, ids`` of every document in the files of the manifest; ``start`` counts the
    ids of all documents before it, in this file and those before."""
    from pyarrow import fs

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(directory)
        for batch in batches:
            for name, first in zip(batch["file"].to_pylist(), batch["first"].to_pylist()):
                with system.open_input_stream(f"{root}/{name}") as stored:
                    data = stored.read()
                held, size = [], 0
                for position, (one, start, ids) in enumerate(PlaneFile(data)):
                    held.append((name, position, one, first + start, len(ids) // 4, ids))
                    size += len(ids)
                    if size > 8_000_000:
                        yield _batch(held)
                        held, size = [], 0
                if held:
                    yield _batch(held)

    # A file is the work of some seconds, so files are dealt out anew, not by the table that lists them.
    dealt = starts(manifest).repartition(max(1, -(-manifest.count() // FILES)), F.xxhash64("file"))
    return dealt.mapInArrow(rows, _ROWS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    names = [c.split()[0] for c in _ROWS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def starts(manifest: DataFrame) -> DataFrame:
    """``file, first``: the number of ids in all files before each. A manifest has a row per file of millions of ids."""
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.select("file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("first"))
