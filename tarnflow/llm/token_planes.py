"""Token ids as bit-plane-shuffled files.

A file holds the ids of a run of documents in ascending doc_id order as chunks of fixed-size blocks:
each chunk's little-endian 32-bit ids are transposed into four byte planes (or 32 bit planes), each plane
is compressed with zstandard by itself, and planes that are all zero take no bytes. Behind the chunks
stand a document index, a chunk index and a fixed-size footer, so any document is found without reading
other chunks.

    b"TPL1" | planes of chunk 0, 1, ... | documents: zstd(int64 doc_id[], int64 n_tokens[])
    | chunk index: per chunk uint64 offset, uint32 n_ids, uint32 plane size[planes]
    | footer: uint64 index offset, uint64 documents offset, uint32 chunks, uint32 documents, uint32 planes, b"TPL1"

Documents are dealt to files by ranges of doc_id; each task writes one file under a name of its own and
renames it, so a repeated task replaces what a lost one left. The ids before a file are a running sum over
the files' totals, which is all the driver sees.

Defined cases: null text is empty and has only the end id; rows that share a doc_id are written each, side
by side, in an order that is free; null doc_ids come first. A text is encoded whole however long it is, by one
task, and may span chunks. Extra columns are ignored; an empty table writes no files.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settled, tidy, working_folder
from .tokens import encoder, vocabulary_path, with_end

CHUNK_IDS = 1 << 18
MAGIC = b"TPL1"
_FOOT = struct.Struct("<QQIII4s")
_NO_ID = -(1 << 63)


def shuffle_planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """Byte planes (4) or bit planes (32) of unsigned 32-bit ids, lowest first."""
    cells = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    if not bits:
        return [np.ascontiguousarray(cells[:, k]).tobytes() for k in range(4)]
    return [np.packbits(cells[:, k // 8] >> np.uint8(k % 8) & np.uint8(1)).tobytes() for k in range(32)]


def join_planes(planes: list[bytes], n: int) -> np.ndarray:
    cells = np.zeros((n, 4), np.uint8)
    for k, plane in enumerate(planes):
        if not plane:
            continue
        if len(planes) == 4:
            cells[:, k] = np.frombuffer(plane, np.uint8)
        else:
            cells[:, k // 8] |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n) << np.uint8(k % 8)
    return cells.view("<u4").reshape(-1)


class PlaneWriter:
    """Writes one file; documents come in order."""

    def __init__(self, out, bits: bool = False, chunk: int = CHUNK_IDS, level: int = 1):
        import zstandard

        self.out, self.bits, self.chunk = out, bits, chunk
        self.press = zstandard.ZstdCompressor(level=level).compress
        self.held, self.n_held, self.index = [], 0, []
        self.doc, self.size = [], []
        self.at = out.write(MAGIC) or len(MAGIC)

    def add(self, doc_ids: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> None:
        self.doc.append(doc_ids)
        self.size.append(np.diff(offsets))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.chunk:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        done = 0
        while len(ids) - done >= self.chunk or last and done < len(ids):
            block = ids[done : done + self.chunk]
            planes = [self.press(p) if p.strip(b"\0") else b"" for p in shuffle_planes(block, self.bits)]
            self.index.append((self.at, len(block), [len(p) for p in planes]))
            for p in planes:
                self.out.write(p)
                self.at += len(p)
            done += len(block)
        self.held, self.n_held = [ids[done:]], len(ids) - done

    def close(self) -> tuple[int, int]:
        """Documents and ids written."""
        self._flush(True)
        doc, size = (np.concatenate(x).astype("<i8") if x else np.zeros(0, "<i8") for x in (self.doc, self.size))
        docs_at = self.at
        body = self.press(doc.tobytes() + size.tobytes())
        self.out.write(body)
        planes = 32 if self.bits else 4
        for at, n, sizes in self.index:
            self.out.write(struct.pack(f"<QI{planes}I", at, n, *sizes))
        self.out.write(_FOOT.pack(docs_at + len(body), docs_at, len(self.index), len(doc), planes, MAGIC))
        return len(doc), int(size.sum())


class PlaneReader:
    """Reads a file by its index."""

    def __init__(self, source):
        import zstandard

        self.source, self.unpress = source, zstandard.ZstdDecompressor().decompress
        end = source.size()
        index_at, docs_at, chunks, docs, planes, magic = _FOOT.unpack(source.read_at(_FOOT.size, end - _FOOT.size))
        if magic != MAGIC:
            raise ValueError("not a token plane file")
        body = self.unpress(source.read_at(index_at - docs_at, docs_at))
        self.doc_ids, self.sizes = np.frombuffer(body, "<i8").reshape(2, docs) if docs else np.zeros((2, 0), np.int64)
        entry = struct.Struct(f"<QI{planes}I")
        raw = source.read_at(entry.size * chunks, index_at)
        self.index = [(x[0], x[1], x[2:]) for x in entry.iter_unpack(raw)]

    def chunks(self) -> Iterator[np.ndarray]:
        for at, n, sizes in self.index:
            planes = []
            for size in sizes:
                planes.append(self.unpress(self.source.read_at(size, at)) if size else b"")
                at += size
            yield join_planes(planes, n)

    def documents(self) -> Iterator[tuple[int, int, int]]:
        """doc_id, number of ids and their crc32, holding one chunk at a time."""
        sizes = self.sizes.tolist()
        k, left, crc = 0, sizes[0] if sizes else 0, 0
        for block in self.chunks():
            data, at = memoryview(np.ascontiguousarray(block, "<u4")).cast("B"), 0
            while at < len(block):
                n = min(left, len(block) - at)
                crc = zlib.crc32(data[4 * at : 4 * (at + n)], crc)
                at, left = at + n, left - n
                if not left:
                    yield int(self.doc_ids[k]), sizes[k], crc
                    k, crc = k + 1, 0
                    left = sizes[k] if k < len(sizes) else 0
        for k in range(k, len(sizes)):
            yield int(self.doc_ids[k]), 0, 0  # trailing documents without ids


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, spaced: bool = True, bits: bool = False) -> DataFrame:
    """Writes docs (doc_id, text, ...) under folder; returns (file, part, n_docs, n_ids), a row a file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, base = pafs.FileSystem.from_uri(folder)
        writer = None
        final = f"{base}/tokens-{task.partitionId():06d}.tpl"
        trial = f"{final}.{task.taskAttemptId()}"
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                out = fs.open_output_stream(trial)
                writer = PlaneWriter(out, bits)
            offsets, ids = with_end(*encoder(vocabulary, spaced).encode(batch.column("text")))
            writer.add(np.asarray(batch.column("doc_id").fill_null(_NO_ID)), offsets, ids)
        if writer is not None:
            n_docs, n_ids = writer.close()
            out.close()
            fs.move(trial, final)
            yield pa.RecordBatch.from_pydict({"file": [final], "part": pa.array([task.partitionId()], pa.int64()), "n_docs": [n_docs], "n_ids": [n_ids]})

    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    ranged = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return ranged.mapInArrow(tidy(write), "file string, part long, n_docs long, n_ids long")


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """Digest of each document in the files: doc_id, start, n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with fs.open_input_file(path) as source:
                    rows = list(PlaneReader(source).documents())
                n = np.array([r[1] for r in rows], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([None if r[0] == _NO_ID else r[0] for r in rows], pa.int64()), pa.array(base + np.cumsum(n) - n), pa.array(n), pa.array([r[2] for r in rows], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(tidy(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


@settled("token-digests")
def token_file_digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Writes all documents with the end id 0 behind each, reads the files back and returns the digests.

    The files go once they are read; write_token_files() leaves them to its caller."""
    spark = docs.sparkSession
    folder = working_folder(spark, "tokens")
    made = write_token_files(docs, folder, vocabulary or vocabulary_path("byte_bpe_50k.json")).collect()  # a row a file
    base, rows = 0, []
    for r in sorted(made, key=lambda r: r["part"]):
        rows.append((r["file"], base))
        base += r["n_ids"]
    kind = T.StructType([T.StructField("file", T.StringType()), T.StructField("base", T.LongType())])
    files = spark.createDataFrame(rows, kind).repartition(max(1, len(rows)))
    return read_token_files(files, folder)
