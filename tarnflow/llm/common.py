"""Shared plumbing: the shared folder, materialised tables, word splitting, hashing."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import functools
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: ASCII white space that separates words and is squeezed by normalisation (fixed value).
WHITE_SPACE = r"[\x20\x09-\x0D]+"
#: A join side of at most so many id rows is broadcast; beyond it the join shuffles.
BROADCAST_IDS = 500_000

#: Rows and bytes of a batch that a worker takes at once.
BATCH_ROWS, BATCH_BYTES = 1500, 16 << 20

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_RECORDS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
_U = np.uint64
_writing = threading.Lock()
_held: dict[tuple[int, str], list] = {}
_open: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("tarnflow_tables", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Unset, one is made here, on a local master alone."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or getattr(spark, "_tarn_shared", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\[\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tarnflow-")
        spark._tarn_shared = base
    return base.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def _setting(spark: SparkSession, name: str, value: str):
    """The session's own setting is back once the last of several threads is out."""
    with _writing:
        held = _held.setdefault((id(spark), name), [0, spark.conf.get(name, None)])
        held[0] += 1
        spark.conf.set(name, value)
    try:
        yield
    finally:
        with _writing:
            held[0] -= 1
            if not held[0]:
                if held[1] is None:
                    spark.conf.unset(name)
                else:
                    spark.conf.set(name, held[1])
                del _held[id(spark), name]


def _freeing_shuffles(spark: SparkSession):
    """Shuffle files of what runs within go when it ends."""
    return _setting(spark, _CLEANUP, "true")


@contextlib.contextmanager
def _small_batches(spark: SparkSession):
    """What runs within sends its workers batches as tidy() cuts them, so that neither side holds larger ones."""
    with _setting(spark, _RECORDS, str(BATCH_ROWS)), _setting(spark, _BYTES, str(BATCH_BYTES)):
        yield


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cuts the lineage: writes df to the shared folder and reads it back.

    The shuffle files of the write are of no further use and go with it.
    """
    spark = df.sparkSession
    path = scratch(spark, tag)
    made = _open.get()
    if made is not None:
        made.append(path)
    with _freeing_shuffles(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tarn_path = path
    return out


def discard(df: DataFrame) -> None:
    """Removes a table made by materialize() that nothing reads any more."""
    path = getattr(df, "_tarn_path", None)
    if path:
        _forget(df.sparkSession, path)


def _forget(spark: SparkSession, path: str) -> None:
    made = _open.get()
    if made is not None and path in made:
        made.remove(path)
    delete_path(spark, path)


def settled(tag: str, small_batches: bool = False) -> Callable:
    """An operator whose result is written as one table; every other table that it wrote goes, errors included.

    The result, a row a document or less, stays until its caller discards it. small_batches: workers get batches of
    at most BATCH_ROWS and about BATCH_BYTES, for an operator that sends them wide rows.
    """

    def around(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(operator)
        def run(first: DataFrame, *args, **kwargs) -> DataFrame:
            ship(first.sparkSession)
            outer, mine = _open.get(), []
            token = _open.set(mine)
            try:
                with _small_batches(first.sparkSession) if small_batches else contextlib.nullcontext():
                    out = materialize(operator(first, *args, **kwargs), tag)
                mine.remove(out._tarn_path)
            finally:
                _open.reset(token)
                for path in mine:
                    delete_path(first.sparkSession, path)
            if outer is not None:
                outer.append(out._tarn_path)
            return out

        return run

    return around


def working_folder(spark: SparkSession, tag: str) -> str:
    """A folder for files of an operator's own, which goes with its tables if it is settled."""
    path = scratch(spark, tag)
    made = _open.get()
    if made is not None:
        made.append(path)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def by_id(left: DataFrame, ids: DataFrame, on, how: str = "inner") -> DataFrame:
    """Joins a wide table with a materialised table of ids, broadcast only if its counted size allows.

    Where the join shuffles, rows of left with a null key, which meet nothing, don't take part: they would
    all go to one task.
    """
    if ids.count() <= BROADCAST_IDS:
        return left.join(F.broadcast(ids), on, how)
    keys = [on] if isinstance(on, str) else list(on)
    known = functools.reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    out = left.where(known).join(ids, on, how)
    return out.unionByName(left.where(~known), allowMissingColumns=True) if how in ("left", "left_anti") else out


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * BATCH_BYTES // max(1, batch.nbytes)))
        for a in range(0, batch.num_rows, step):
            yield batch.slice(a, step)


def tidy(task, rows: int = BATCH_ROWS):
    """A task for mapInArrow: it gets batches of a bounded number of rows and bytes (one row at least), whatever the
    session's settings, and what it freed goes back to the system, as workers serve one task after another."""

    def run(batches):
        yield from task(_slices(batches, rows))
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except OSError:  # another C library
            pass

    return run


def grouped(keys: list[str], of: Callable[[pa.Table], Iterator[pa.RecordBatch] | pa.RecordBatch | None]):
    """A task over rows sorted by integer keys: calls `of` with one table for each run of equal keys.

    A group may span batches; one group is held at a time, so its size is the caller's to bound.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [np.asarray(batch.column(k)) for k in keys]
            new = np.zeros(batch.num_rows, bool)
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                now = tuple(c[a] for c in cols)
                if held and now != at:
                    out = of(pa.Table.from_batches(held))
                    held = []
                    if out is not None:
                        yield out
                at = now
                held.append(batch.slice(a, b - a))
        if held:
            out = of(pa.Table.from_batches(held))
            if out is not None:
                yield out

    return run


def flat_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array]:
    """Words of each text (null: none) and their offsets; only A-Z are lower-cased."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    words, offsets = lists.flatten(), np.asarray(lists.offsets).astype(np.int64)
    offsets = offsets - offsets[0]
    full = np.asarray(pc.binary_length(words)) > 0
    if not full.all():
        words = words.filter(pa.array(full))
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
    return offsets, words


def hash_words(words: pa.Array, wide: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each word (the second one only if wide)."""
    import xxhash

    coded = words.dictionary_encode()
    index = np.asarray(coded.indices)
    digest = xxhash.xxh3_128_digest
    table = np.frombuffer(b"".join([digest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()]), dtype=_U).reshape(-1, 2)
    if not len(table):
        return np.zeros(0, _U), np.zeros(0, _U)
    return table[:, 0][index], table[:, 1][index] if wide else table[:0, 1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (a bijection)."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def runs_of(h: np.ndarray, k: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Polynomial hash of k consecutive word hashes at each position, by doubling."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    out, have, power, width, b = None, 0, h, 1, _U(base)
    scale = {1: b}
    with np.errstate(over="ignore"):
        while True:
            if k & width:
                part = power
                out = part[: len(h)] if out is None else out[: len(part) - have] * scale[width] + part[have : have + len(out)]
                have += width
            if width * 2 > k:
                break
            power = power[:-width] * scale[width] + power[width:]
            scale[width * 2] = scale[width] * scale[width]
            width *= 2
    return mixed(out[:n])
