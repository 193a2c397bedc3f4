"""BPE ids by a table of distinct words, and decoding through the id-to-piece table.

1. Spark splits every text into its words. The rows of an input split, in their order, are cut into chunks of 32 MB
   of words, so what a worker holds doesn't grow with the split. Within a chunk the words are folded: its distinct
   words leave it once, grouped by word hash, sorted and compressed, one row for each chunk and word group.
2. Word groups are as many as the bytes of text ask for, so a group stays small however large the corpus is. In
   its group every distinct word is encoded exactly once by the library; the ids go back to the chunks that
   asked, so a frequent word costs a row a chunk and no more.
3. The answers are laid out by chunk in the shared folder, one file a chunk. A second scan, which cuts its splits
   alike, joins them to its words by position: a shuffle of every word's place would move the corpus several times
   over, while a chunk's answers are a small table that its task reads. Ids become text by a join of the ids of a
   batch's distinct words with the vocabulary's pieces, a table of fixed size that each worker holds, as the
   library decodes: the pieces joined by one space.

A word that isn't in its chunk's answers (a split cut anew by another plan) is encoded on the spot, so the
result never depends on the cut. Texts that hold special tokens' text need no care: a special token has no
white space and so lies within one word.

Defined cases: null text is empty: no ids, empty decoded text; a text is read whole however long it is, by one
task; repeated rows are returned each; a null doc_id is returned as null; an empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE_SPACE, hash_words, materialize, settled, tidy, working_folder
from .tokens import encode_units, tokenizer, vocabulary_path

#: Bytes of words of a chunk, at most but for one text; bytes of text for each word group; words hashed at once.
CHUNK_BYTES, GROUP_BYTES, HASHED = 32 << 20, 32 << 20, 100_000


def _packed(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(data)


def _unpacked(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def _split_words(text: str):
    """The words of a text column; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE_SPACE), lambda w: w != "")


def _flat(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets from 0 and the words of a column of lists."""
    offsets = np.asarray(lists.offsets).astype(np.int64)
    return offsets - offsets[0], lists.flatten()


class _Chunks:
    """Cuts a split's rows by the bytes of words before them, so both scans cut alike, however they are batched."""

    def __init__(self, size: int):
        self.size, self.split, self.seen = size, None, 0

    def of(self, batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.RecordBatch]]:
        """(split, chunk, rows) in order."""
        splits = np.asarray(batch.column("split"))
        offsets, words = _flat(batch.column("words"))
        before = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(words)), dtype=np.int64)])[offsets]
        cuts = [0, *(np.flatnonzero(splits[1:] != splits[:-1]) + 1).tolist(), len(splits)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if splits[a] != self.split:
                self.split, self.seen = int(splits[a]), 0
            chunk = (self.seen + before[a:b] - before[a]) // self.size
            self.seen += int(before[b] - before[a])
            ends = [0, *(np.flatnonzero(chunk[1:] != chunk[:-1]) + 1).tolist(), b - a]
            for x, y in zip(ends[:-1], ends[1:], strict=True):
                yield self.split, int(chunk[x]), batch.slice(a + x, y - x)


def _asked(groups: int, chunk_bytes: int = CHUNK_BYTES):
    """(split, chunk, part, word_group, words): sorted distinct words of a chunk, newline-joined and compressed; part is
    the task that read the split."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at, held, part, chunks = None, [], TaskContext.get().partitionId(), _Chunks(chunk_bytes)

        def out():
            words = pa.concat_arrays(held).unique()
            held.clear()
            words = words.take(pc.sort_indices(words))
            group = np.concatenate([hash_words(words.slice(a, HASHED))[0] % np.uint64(groups) for a in range(0, len(words), HASHED)])
            order = np.argsort(group, kind="stable")
            ends = np.searchsorted(group[order], np.arange(groups + 1, dtype=np.uint64))
            some = np.flatnonzero(np.diff(ends))
            rows = _joined(words.take(pa.array(order)), np.append(ends[some], len(words)), "\n").cast(pa.binary())
            n = len(some)
            yield pa.RecordBatch.from_arrays([pa.array([at[0]] * n, pa.int64()), pa.array([at[1]] * n, pa.int32()), pa.array([part] * n, pa.int32()), pa.array(some, pa.int32()), pa.array([_packed(r.as_buffer()) for r in rows], pa.binary())], ["split", "chunk", "part", "word_group", "words"])

        for batch in batches:
            for *key, rows in chunks.of(batch):
                if key != at:
                    if held:
                        yield from out()
                    at = key
                words = rows.column("words").flatten()
                if len(words):
                    held.append(words.unique())
                    if len(held) > 8:
                        held[:] = [pa.concat_arrays(held).unique()]
        if held:
            yield from out()

    return of


def _answered(vocabulary: str):
    """(split, chunk, part, words, sizes, ids): each word of a group is encoded once, however many chunks ask."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bytes] = {}
        at = None
        for batch in batches:
            sizes, ids = [], []
            for group, blob in zip(batch.column("word_group").to_pylist(), batch.column("words").to_pylist(), strict=True):
                if group != at:
                    at, known = group, {}
                words = _unpacked(blob).decode().split("\n")
                fresh = [w for w in words if w not in known]
                known.update(zip(fresh, encode_units(vocabulary, fresh), strict=True))
                got = [known[w] for w in words]
                sizes.append(_packed(np.fromiter((len(g) >> 2 for g in got), np.uint32, len(got)).tobytes()))
                ids.append(_packed(b"".join(got)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("split", "chunk", "part", "words")), pa.array(sizes, pa.binary()), pa.array(ids, pa.binary())], ["split", "chunk", "part", "words", "sizes", "ids"])

    return of


@functools.cache
def _pieces(vocabulary: str) -> tuple[pa.Array, pa.Array]:
    """By id: its digits, and its piece."""
    t = tokenizer(vocabulary)
    n = max(t.get_vocab(with_added_tokens=True).values()) + 1
    return pa.array([str(i) for i in range(n)], pa.string()), pa.array([t.id_to_token(i) for i in range(n)], pa.string())


def _joined(strings: pa.Array, offsets: np.ndarray, by: str = " ") -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), strings), by)


class _Answers:
    """A chunk's words with sizes and ids; digits and pieces are made for the words that a batch asks."""

    def __init__(self, vocabulary: str, folder: str, split: int, chunk: int):
        self.vocabulary = vocabulary
        fs, base = pafs.FileSystem.from_uri(folder)
        at = f"{base}/split={split}/chunk={chunk}"
        table = pads.dataset(at, filesystem=fs, format="parquet").to_table(["words", "sizes", "ids"]) if fs.get_file_info(at).type == pafs.FileType.Directory else None
        column = lambda name: (_unpacked(x.as_buffer()) for x in table.column(name)) if table else ()
        self.words = pa.concat_arrays([pa.array([], pa.string()), *(pc.split_pattern(pa.array([w], pa.string()), "\n").flatten() for w in column("words"))])
        self.sizes, self.ids = (np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(x, np.uint32) for x in column(name))]) for name in ("sizes", "ids"))
        self.begins = np.cumsum(self.sizes, dtype=np.int64) - self.sizes

    def of(self, words: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """Sizes, digits and pieces of distinct words."""
        place = np.asarray(pc.fill_null(pc.index_in(words, value_set=self.words), -1)).astype(np.int64)
        sizes, begins, ids = self.sizes, self.begins, self.ids
        fresh = place < 0
        if fresh.any():
            made = encode_units(self.vocabulary, words.filter(pa.array(fresh)).to_pylist())
            place[fresh] = len(sizes) + np.arange(len(made))
            more = np.array([len(m) >> 2 for m in made], np.uint32)
            begins = np.concatenate([begins, len(ids) + np.cumsum(more, dtype=np.int64) - more])
            sizes, ids = np.concatenate([sizes, more]), np.concatenate([ids, np.frombuffer(b"".join(made), np.uint32)])
        sizes = sizes[place].astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        at = pa.array(ids[np.arange(offsets[-1]) + np.repeat(begins[place] - offsets[:-1], sizes)])
        digits, pieces = _pieces(self.vocabulary)
        return sizes, _joined(digits.take(at), offsets), _joined(pieces.take(at), offsets)


def _digests(vocabulary: str, folder: str, chunk_bytes: int = CHUNK_BYTES):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, answers, chunks = None, None, _Chunks(chunk_bytes)
        for batch in batches:
            for *key, part in chunks.of(batch):
                if key != at:
                    at, answers = key, None  # one chunk's answers are held at a time
                    answers = _Answers(vocabulary, folder, *key)
                offsets, words = _flat(part.column("words"))
                coded = words.dictionary_encode()
                sizes, digits, pieces = answers.of(coded.dictionary)
                # a word without ids (it was all combining or white space) leaves no gap
                index = np.asarray(coded.indices)
                some = sizes[index] > 0
                if not some.all():
                    index, offsets = index[some], np.concatenate([[0], np.cumsum(some)])[offsets]
                total = np.concatenate([[0], np.cumsum(sizes[index])])[offsets]
                out = []
                for strings in (digits, pieces):
                    texts = _joined(strings.take(pa.array(index)), offsets).cast(pa.binary())
                    out.append(pa.array([hashlib.sha256(t.as_buffer()).hexdigest() for t in texts], pa.string()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(total)), *out], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return of


@settled("word-digests", small_batches=True)
def word_table_digests(docs: DataFrame, vocabulary: str | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_tokens, ids_sha256, decoded_sha256."""
    spark = docs.sparkSession
    vocabulary = vocabulary or vocabulary_path("word_bpe_49k.json")
    docs = docs.select("doc_id", "text")
    if not docs.inputFiles():  # a derived table has no splits that two scans share
        docs = materialize(docs, "words-docs")
    split = F.xxhash64(F.input_file_name(), F.input_file_block_start())
    rows = docs.select("doc_id", _split_words("text").alias("words"), split.alias("split"))
    groups = max(4 * spark.sparkContext.defaultParallelism, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // GROUP_BYTES))
    asked = rows.select("words", "split").mapInArrow(tidy(_asked(groups, chunk_bytes)), "split long, chunk int, part int, word_group int, words binary")
    # as many tasks as groups: none grows with the corpus
    answered = asked.repartition(groups, "word_group").sortWithinPartitions("word_group").mapInArrow(tidy(_answered(vocabulary)), "split long, chunk int, part int, words binary, sizes binary, ids binary")
    folder = working_folder(spark, "words")
    # a task for each that read splits, so what one of them lays out doesn't grow with the corpus either
    parts = max(1, rows.rdd.getNumPartitions())
    answered.repartitionById(parts, "part").drop("part").write.partitionBy("split", "chunk").option("compression", "none").parquet(folder)
    return rows.mapInArrow(tidy(_digests(vocabulary, folder, chunk_bytes)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
