"""Substring dedup over windows of 50 words by difference-cover anchors.

A window is removed when the same 50 words also start in a document with a smaller doc_id. Word
positions of each document are taken modulo 31, and 20-word anchors are hashed only at the residues of
the perfect difference set {0, 1, 3, 8, 12, 18}: for any two places there is a shift below 31 at which
both lie on the cover, so any two equal windows of 50 words share an anchor that is aligned in both.

1. A scan hashes the anchors. Copies within a task are folded before the shuffle: a hash leaves a task
   once, and documents that share it there are marked at once, so a passage held by a third of all rows
   costs a row a task.
2. Anchors seen in two documents or more mark the places to extend: the windows around a marked anchor,
   and no others, are keyed by 95 bits of their 50 words and again folded within each task; a window
   whose smaller owner is in the same task is settled there.
3. The smallest doc_id of each remaining key settles the rest; the words under settled windows go.

Defined cases: null text has no words; fewer than 50 words are never removed; repeats within one
document, and between rows that share a doc_id, stay; rows with a null doc_id own nothing and lose
nothing. A text is read whole however long it is (up to 2**32 words), by one task. An empty table gives no rows.
Extra columns are ignored. Words under equal keys aren't compared again: of n distinct windows any two share
their 95 bits with probability n*n/2**96.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import flat_words, hash_words, materialize, mixed, runs_of, settled, tidy

WINDOW = 50
#: A perfect difference set modulo 31 (fixed values).
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)
ANCHOR = WINDOW - PERIOD + 1
#: Keys held by a task before they are folded and sent.
HELD = 1_000_000

_U = np.uint64
_ON = np.isin(np.arange(PERIOD), COVER)


def _places(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and position in it, for each word."""
    sizes = np.diff(offsets)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    return doc, np.arange(int(offsets[-1])) - np.repeat(offsets[:-1], sizes)


def _anchors(offsets: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word places of anchors and their hashes."""
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, _U)
    doc, at = _places(offsets)
    size = np.diff(offsets)[doc]
    ok = np.flatnonzero(_ON[at % PERIOD] & (size >= WINDOW) & (at + ANCHOR <= size))
    return ok, runs_of(h, ANCHOR)[ok]


def _grouped(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Group number, from 0, of each place in a sorted order."""
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return np.cumsum(new)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, doc_id, mark, own): own is null once for each hash; where several documents of this task have the
    anchor, each gets a row with its doc_id as own, which needs no company to count. mark tells apart the texts that
    share a doc_id."""
    held: list[tuple] = []

    def out():
        h, doc, mark = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((mark, doc, h))
        h, doc, mark = h[order], doc[order], mark[order]
        fresh = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])]
        h, doc, mark = h[fresh], doc[fresh], mark[fresh]
        first = np.r_[True, h[1:] != h[:-1]]
        last = np.r_[np.flatnonzero(first)[1:], len(h)] - 1
        group = np.cumsum(first) - 1
        several = (doc[last] != doc[first])[group]
        # other texts of the first document wait for company as it does
        alone = first | ~several & (doc == doc[first][group])
        for rows, own in ((alone, False), (several, True)):
            i = np.flatnonzero(rows)
            for s in range(0, len(i), 50_000):
                at = i[s : s + 50_000]
                d = pa.array(doc[at])
                yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), d, pa.array(mark[at]), d if own else pa.nulls(len(d), pa.int64())], ["h", "doc_id", "mark", "own"])

    size = 0
    for batch in batches:
        offsets, words = flat_words(batch.column("text"))
        h, _ = hash_words(words)
        at, anchors = _anchors(offsets, h)
        if len(at):
            row = np.searchsorted(offsets, at, side="right") - 1
            held.append((anchors, np.asarray(batch.column("doc_id"))[row], np.asarray(batch.column("mark"))[row]))
            size += len(at)
        if size > HELD:
            yield from out()
            held, size = [], 0
    if held:
        yield from out()


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, doc_id, start, run, more): windows around marked anchors. run > 0: so many windows from start
    on that a smaller document of this task settles; run 0: still to settle by key, once for each document,
    with the window's other starts in more, so that text of one word over and over is a row a document."""
    held: list[tuple] = []

    def out():
        k1, k2, doc, start = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((doc, k2, k1))
        group = _grouped(order, k1, k2)
        least = np.r_[0, np.flatnonzero(np.diff(group)) + 1]
        settled = np.zeros(len(order), bool)
        settled[order] = doc[order] > doc[order[least]][group]
        i = order[~settled[order]]
        first = np.r_[True, np.diff(_grouped(i, k1, k2, doc, start >> 32)) > 0][: len(i)]
        again = np.diff(np.r_[np.flatnonzero(first), len(i)]) - 1
        more = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(again)].astype(np.int32)), pa.array(start[i[~first]]), mask=pa.array(again == 0))
        i = i[first]
        back = np.argsort(i)
        i, more = i[back], more.take(pa.array(back))
        parts = [(k1[i].view(np.int64), k2[i], doc[i], start[i], np.zeros(len(i), np.int32), more)]
        i = np.flatnonzero(settled)
        if len(i):
            new = np.r_[True, (doc[i][1:] != doc[i][:-1]) | (start[i][1:] != start[i][:-1] + 1)]
            a = i[new]
            run = np.diff(np.r_[np.flatnonzero(new), len(i)]).astype(np.int32)
            with np.errstate(over="ignore"):
                alone = mixed(doc[a].view(_U) * _U(0x9E3779B97F4A7C15) + start[a].view(_U))
            parts.append((alone.view(np.int64), np.full(len(a), -1, np.int32), doc[a], start[a], run, pa.nulls(len(a), pa.list_(pa.int64()))))
        for part in parts:
            for s in range(0, len(part[0]), 50_000):
                yield pa.RecordBatch.from_arrays([x[s : s + 50_000] if isinstance(x, pa.Array) else pa.array(x[s : s + 50_000]) for x in part], ["k1", "k2", "doc_id", "start", "run", "more"])

    size = 0
    for batch in batches:
        offsets, words = flat_words(batch.column("text"))
        h, g = hash_words(words, wide=True)
        at, anchors = _anchors(offsets, h)
        if not len(at):
            continue
        doc, place = _places(offsets)
        marks = batch.column("anchors")
        sizes = np.diff(np.asarray(marks.offsets))
        known = np.repeat(np.arange(len(sizes)), sizes).astype(_U)
        # an anchor counts if its hash is marked for its own document
        with np.errstate(over="ignore"):
            own = np.unique(mixed(np.asarray(marks.flatten()).view(_U) + mixed(known)))
            marked = at[np.isin(mixed(anchors + mixed(doc[at].astype(_U))), own)]
        if not len(marked):
            continue
        # windows that hold the anchor: starts from 30 words before it up to it
        edge = np.zeros(len(h) + 1, np.int64)
        np.add.at(edge, np.maximum(marked - (WINDOW - ANCHOR), offsets[doc[marked]]), 1)
        np.add.at(edge, marked + 1, -1)
        starts = np.flatnonzero((np.cumsum(edge[:-1]) > 0) & (place + WINDOW <= np.diff(offsets)[doc]))
        d = doc[starts]
        k1, k2 = runs_of(h, WINDOW)[starts], (runs_of(g, WINDOW)[starts] >> _U(33)).astype(np.int32)
        held.append((k1, k2, np.asarray(batch.column("doc_id"))[d], (np.asarray(batch.column("mark")).astype(np.int64)[d] << 32) + place[starts]))
        size += len(starts)
        if size > HELD:
            yield from out()
            held, size = [], 0
    if held:
        yield from out()


class _Runs:
    """Settled windows (start, run, more) of each row of a batch, read as flat columns."""

    def __init__(self, rows: pa.Array):
        self.ends, flat = np.asarray(rows.offsets), rows.values
        self.start, self.run, more = np.asarray(flat.field("start")), np.asarray(flat.field("run")), flat.field("more")
        self.more_ends, self.more = np.asarray(more.offsets), np.asarray(more.values)

    def of(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the i-th row's windows and how many follow one another from each."""
        a, b = self.ends[i], self.ends[i + 1]
        more = self.more[self.more_ends[a] : self.more_ends[b]]
        return np.r_[self.start[a:b], more], np.r_[self.run[a:b], np.ones(len(more), np.int32)]


def _kept(texts: bool):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_gone, digest, whole = [], [], [], []
            runs = _Runs(batch.column("runs")) if "runs" in batch.schema.names else None
            for i, text in enumerate(batch.column("text").to_pylist()):
                words = (text or "").encode().split()
                n = len(words)
                lost = 0
                start, size = runs.of(i) if runs else ((), ())
                if len(start):
                    edge = np.zeros(n + 1, np.int64)
                    start = start & 0xFFFFFFFF
                    np.add.at(edge, start, 1)
                    np.add.at(edge, np.minimum(start + size + WINDOW - 1, n), -1)
                    stay = np.cumsum(edge[:-1]) == 0
                    lost = n - int(stay.sum())
                    words = [words[w] for w in np.flatnonzero(stay).tolist()]
                kept = b" ".join(words)
                n_words.append(n)
                n_gone.append(lost)
                digest.append(hashlib.sha256(kept).hexdigest())
                if texts:
                    whole.append(kept.decode() if lost else text)
            cols = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(digest, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if texts:
                rest = [c for c in batch.schema.names if c not in ("doc_id", "runs", "text", "mark")]
                cols, names = cols + [pa.array(whole, pa.string())] + [batch.column(c) for c in rest], names + ["text", *rest]
            yield pa.RecordBatch.from_arrays(cols, names)

    return of


def repeated_passages(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_words, n_removed, kept_sha256.

    With keep, also text (unchanged where nothing is removed, else the kept words joined by one space)
    and the named columns of docs.
    """
    ship(docs.sparkSession)
    cols = ["doc_id", "text", *keep]
    # 31 bits of a text keep apart those that share a doc_id, so that a repeated one is no hot key
    # (never null by its type, or the inner join would filter its side and the texts be shuffled twice)
    mark = F.xxhash64("text").bitwiseAND(F.lit((1 << 31) - 1)).cast("int")
    base = docs.select(*cols).where("doc_id is not null").withColumn("mark", mark)
    found = base.select("doc_id", "text", "mark").mapInArrow(tidy(_anchor_rows), "h long, doc_id long, mark int, own long")
    same = Window.partitionBy("h", "own")
    marked = found.select("h", "doc_id", "mark", "own", F.min("doc_id").over(same).alias("lo"), F.max("doc_id").over(same).alias("hi")).where("own is not null or lo <> hi")
    anchors = materialize(marked.groupBy("doc_id", "mark").agg(F.collect_set("h").alias("anchors")), "passages")
    # both joins deal the same columns of base by doc_id and mark, so its texts are shuffled once
    around = base.join(anchors, ["doc_id", "mark"]).select(*cols, "mark", "anchors")
    keyed = around.mapInArrow(tidy(_window_rows), "k1 long, k2 int, doc_id long, start long, run int, more array<long>")
    settled = keyed.withColumn("lo", F.min("doc_id").over(Window.partitionBy("k1", "k2"))).where("run > 0 or lo < doc_id")
    run = F.struct("start", F.greatest("run", F.lit(1)).alias("run"), "more").alias("r")
    runs = settled.select("doc_id", F.shiftright("start", 32).cast("int").alias("mark"), run).groupBy("doc_id", "mark").agg(F.collect_set("r").alias("runs"))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", text string" if keep else "") + "".join(f", `{c}` {kinds[c]}" for c in keep)
    out = base.join(runs, ["doc_id", "mark"], "left").mapInArrow(tidy(_kept(bool(keep))), schema)
    return out.unionAll(docs.where("doc_id is null").select(*cols).mapInArrow(tidy(_kept(bool(keep))), schema))


@settled("passage-digests")
def passage_digests(docs: DataFrame) -> DataFrame:
    """repeated_passages() as a settled table: doc_id, n_words, n_removed, kept_sha256."""
    return repeated_passages(docs)
