"""Exact dedup by Patricia-trie owners.

Texts are equal when identical after squeezing each run of ASCII white space to one space. A map-side
trie first folds the copies within each input partition, so a group that holds a third of all rows
sends one text a partition. The distinct texts then go to owner partitions by length and content hash,
where full byte strings are inserted into a compressed radix trie; its terminal nodes hold the smallest
doc_id and the number of rows. An owner over its memory budget spills its largest subtree to the shared
folder and finishes it later on its own: behind the bytes that all its strings share, and, if it is still over
the budget, in parts by content hash, from a list of work that needs no recursion however long and nested the
strings are. Documents get their owner's answer by a join on the digest.

Defined cases: null text counts as empty; rows that repeat a doc_id count each towards group_size and
tie, so each is marked kept when that doc_id is the smallest; null doc_ids lose to any other id, and a
group of them alone has a null keep_id. A text is read whole and one distinct text must fit a worker's memory,
whatever the budget. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE_SPACE, settled, tidy, working_folder

MEMORY = 64 << 20
NODE_BYTES = 300
#: Parts of a spilled subtree that doesn't fit.
PARTS = 8
_NONE = 1 << 63


class _Node:
    __slots__ = ("kids", "value")

    def __init__(self):
        self.kids: dict[int, list] = {}  # first byte -> [source, start, end, node]
        self.value: list | None = None  # [smallest id, rows]


class _Spilled:
    """A subtree whose further keys go straight to its file in the shared folder."""

    def __init__(self, folder: str):
        self.fs, base = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(base, recursive=True)
        self.path = f"{base}/{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.path)

    def put(self, key: bytes, low: int, rows: int) -> None:
        pickle.dump((key, low, rows), self.out, protocol=5)

    def entries(self) -> Iterator[tuple[bytes, int, int]]:
        self.out.close()
        with self.fs.open_input_stream(self.path) as source:
            while True:
                try:
                    yield pickle.load(source)
                except EOFError:
                    break
        self.fs.delete_file(self.path)


class PatriciaTrie:
    """Byte strings -> (smallest id, rows). Edges refer to the inserted strings, nothing is copied."""

    def __init__(self, budget: int = MEMORY, folder: str | None = None):
        self.root, self.budget, self.folder, self.bytes, self.strings = _Node(), budget, folder, 0, 0
        self.spilled: dict[int, _Spilled] = {}
        self.weight: dict[int, int] = {}

    def insert(self, key: bytes, low: int, rows: int = 1) -> None:
        if key and key[0] in self.spilled:
            self.spilled[key[0]].put(key, low, rows)
            return
        node, i, n = self.root, 0, len(key)
        while i < n:
            edge = node.kids.get(key[i])
            if edge is None:
                leaf = _Node()
                node.kids[key[i]] = [key, i, n, leaf]
                self._grown(key, n + NODE_BYTES)
                node, i = leaf, n
                break
            source, a, b, below = edge
            size = min(b - a, n - i)
            same = size if key[i : i + size] == source[a : a + size] else self._common(key, i, source, a, size)
            if same < b - a:
                fork = _Node()
                fork.kids[source[a + same]] = [source, a + same, b, below]
                edge[2], edge[3] = a + same, fork
                self._grown(key, NODE_BYTES)
                below = fork
            node, i = below, i + same
        if node.value is None:
            node.value = [low, rows]
            self.strings += 1
        else:
            node.value[0] = min(node.value[0], low)
            node.value[1] += rows
        if self.folder and self.bytes > self.budget and self.weight:
            self._spill()

    @staticmethod
    def _common(x: bytes, i: int, y: bytes, j: int, size: int) -> int:
        low, high = 0, size  # the first low bytes agree, some byte before high doesn't
        while high - low > 1:
            mid = (low + high) // 2
            if x[i + low : i + mid] == y[j + low : j + mid]:
                low = mid
            else:
                high = mid
        return low

    def _grown(self, key: bytes, size: int) -> None:
        self.bytes += size
        self.weight[key[0]] = self.weight.get(key[0], 0) + size

    def _spill(self) -> None:
        """Moves the largest subtree of the root to the shared folder."""
        first = max(self.weight, key=self.weight.get)
        store = self.spilled[first] = _Spilled(self.folder)
        for key, low, rows in self._under(self.root.kids.pop(first)):
            store.put(key, low, rows)
        self.bytes -= self.weight.pop(first)

    def _under(self, edge: list, prefix: bytes = b"") -> Iterator[tuple[bytes, int, int]]:
        stack = [(edge, prefix)]
        while stack:
            (source, a, b, node), before = stack.pop()
            path = before + source[a:b]
            if node.value:
                yield path, *node.value
            stack += [(kid, path) for kid in node.kids.values()]

    def entries(self) -> Iterator[tuple[bytes, int, int]]:
        if self.root.value:
            yield b"", *self.root.value
        for edge in self.root.kids.values():
            yield from self._under(edge)
        for store in self.spilled.values():
            yield from self._reloaded(store)

    def _reloaded(self, store: _Spilled) -> Iterator[tuple[bytes, int, int]]:
        """Spilled strings in tries of their own, keyed behind the bytes that all of a store's strings share.

        A store whose distinct strings don't fit the budget is dealt into PARTS by content hash, with another
        seed each time, until they fit or one string is left.
        """
        work = [(store, 0)]
        while work:
            store, seed = work.pop()
            shared = None
            rest = _Spilled(self.folder)
            for key, low, rows in store.entries():
                if shared is None:
                    shared = key
                elif not key.startswith(shared):
                    shared = shared[: self._common(key, 0, shared, 0, len(shared)) if len(key) >= len(shared) else self._prefix(key, shared)]
                rest.put(key, low, rows)
            trie, parts = PatriciaTrie(), None
            for key, low, rows in rest.entries():
                if parts is None:
                    trie.insert(key[len(shared) :], low, rows)
                    if trie.bytes > self.budget and trie.strings > 1:
                        parts = [_Spilled(self.folder) for _ in range(PARTS)]
                        for tail, *value in trie.entries():
                            whole = shared + tail
                            parts[xxhash.xxh3_64_intdigest(whole, seed) % PARTS].put(whole, *value)
                        trie = None
                else:
                    parts[xxhash.xxh3_64_intdigest(key, seed) % PARTS].put(key, low, rows)
            if parts is None:
                for key, low, rows in trie.entries():
                    yield shared + key, low, rows
            else:
                work += [(part, seed + 1) for part in parts]

    @classmethod
    def _prefix(cls, x: bytes, y: bytes) -> int:
        size = min(len(x), len(y))
        return size if x[:size] == y[:size] else cls._common(x, 0, y, 0, size)


def _number(x: int | None) -> int:
    return _NONE if x is None else x


def _emitted(trie: PatriciaTrie, texts: bool) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0

    def batch():
        key, low, n = zip(*rows, strict=True)
        what = pa.array(key, pa.binary()).cast(pa.string()) if texts else pa.array([hashlib.sha256(k).hexdigest() for k in key], pa.string())
        return pa.RecordBatch.from_arrays([what, pa.array([None if x == _NONE else x for x in low], pa.int64()), pa.array(n, pa.int64())], ["norm" if texts else "sha", "low", "n"])

    for entry in trie.entries():
        rows.append(entry)
        held += len(entry[0])
        if held > 8 << 20 or len(rows) >= 5000:
            yield batch()
            rows, held = [], 0
    if rows:
        yield batch()


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map-side owners: a trie that is emitted and begun anew when it is full."""
    trie = PatriciaTrie()
    for batch in batches:
        for key, low in zip(batch.column("norm").cast(pa.binary()).to_pylist(), batch.column("doc_id").to_pylist(), strict=True):
            trie.insert(key, _number(low))
            if trie.bytes > trie.budget:
                yield from _emitted(trie, True)
                trie = PatriciaTrie()
    yield from _emitted(trie, True)


def _owners(folder: str, budget: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie(budget, folder)
        for batch in batches:
            for key, low, n in zip(batch.column("norm").cast(pa.binary()).to_pylist(), batch.column("low").to_pylist(), batch.column("n").to_pylist(), strict=True):
                trie.insert(key, _number(low), n)
        yield from _emitted(trie, False)

    return of


@settled("exact")
def exact_duplicates(docs: DataFrame, memory: int = MEMORY) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, keep_id, group_size, kept, text_sha256."""
    norm = docs.select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), WHITE_SPACE, " ").alias("norm"))
    folded = norm.mapInArrow(tidy(_folded), "norm string, low long, n long")
    dealt = folded.withColumn("size", F.octet_length("norm")).withColumn("hash", F.xxhash64("norm")).repartition("size", "hash")
    owners = dealt.select("norm", "low", "n").mapInArrow(tidy(_owners(working_folder(docs.sparkSession, "trie"), memory)), "sha string, low long, n long")
    # equal digests of unequal texts would show here as two owners; no such pair of texts is known
    answer = owners.select(F.unhex("sha").alias("digest"), F.col("low").alias("keep_id"), F.col("n").alias("group_size"))
    rows = norm.select("doc_id", F.unhex(F.sha2("norm", 256)).alias("digest"))
    out = rows.join(answer, "digest", "left")
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
