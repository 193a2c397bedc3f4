"""MinHash near-dedup: universal hash minima, bands, signature check, exact check, star components.

Documents are linked when the Jaccard similarity of their sets of five-word shingles (A-Z
lower-cased) is at least 0.75, tested in integers on the full sets. Steps:

1. One scan makes, per document, the shingle count, a digest of the whole set and 128 minima.
2. Equal sets form a class; only its smallest doc_id goes on, so exact copies never meet as pairs.
3. 32 bands of 4 minima; a pair at 0.75 misses all bands with probability 5e-6.
4. In each bucket every member is compared with the bucket's least member only (a star). One pivot
   is tried per document, the one it shares most buckets with; links are exact.
5. Large-star/small-star components. A bucket whose members lie in one component is done.
6. What is left in buckets of several components is compared by signature in bounded tiles, which give
   a spanning forest of the components that look alike, never pairs. The members of each such cluster then
   meet once more in bounded tiles with their full sets, so every pair of a bucket is decided exactly
   unless its documents are in one component already. Nothing is capped or sampled.

Shingles are held as 64-bit hashes of their words, so the "full sets" of the exact check are sets of such
hashes: two of a corpus of n distinct shingles agree by chance with probability n*n/2**65, and a link changes
only if that happens within one pair of documents.

Defined cases: null, empty or wordless text has no shingles and links with nothing; fewer than five
words are one shingle; a text is read whole however long it is, by one task, which then holds it and its set;
rows that repeat a doc_id are one document (all its texts count) and each is returned; a null doc_id is returned
as its own component (null); of documents that tie, the smallest doc_id leads. An empty table gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_id, discard, flat_words, grouped, hash_words, materialize, mixed, runs_of, settled, tidy
from .components import connected_components, local_roots

SHINGLE, HASHES, ROWS = 5, 128, 4
NUM, DEN = 75, 100
#: 4.5 standard deviations of the estimate at 0.75 from 128 minima below it: 3e-6 of links are missed.
SIGNATURE_LEAST = int(HASHES * (0.75 - 4.5 * (0.75 * 0.25 / HASHES) ** 0.5))
#: Documents and bytes of text of a tile's side; rows of a task of tiles, on average.
BLOCK, BLOCK_BYTES, TASK_ROWS = 1024, 16_000_000, 4096

_U = np.uint64
_random = np.random.Generator(np.random.PCG64(20240501))
_A = _random.integers(0, 2**63, HASHES, dtype=_U) * _U(2) + _U(1)
_B = _random.integers(0, 2**63, HASHES, dtype=_U)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    offsets, words = flat_words(texts, lower=True)
    h, _ = hash_words(words)
    grams = runs_of(h, SHINGLE)
    sets = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            sets.append(np.unique(grams[a : b - SHINGLE + 1]))
        elif b > a:
            with np.errstate(over="ignore"):
                sets.append(mixed(runs_of(h[a:b], b - a) + _U(b - a)))
        else:
            sets.append(np.zeros(0, _U))
    return sets


def signature(s: np.ndarray) -> np.ndarray:
    """Upper halves of the minima of a*x+b mod 2**64 over the set, one for each of the hashes."""
    least = np.full(HASHES, np.iinfo(_U).max, _U)
    with np.errstate(over="ignore"):
        for i in range(0, len(s), 1024):
            v = s[i : i + 1024, None] * _A
            v += _B
            np.minimum(least, v.min(axis=0), out=least)
    return (least >> _U(32)).astype(np.uint32)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        count, key, sig = [], [], []
        for s in shingle_sets(batch.column("text")):
            count.append(len(s))
            key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            sig.append(signature(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "set_key", "sig"])


def _alike(a: np.ndarray, b: np.ndarray) -> bool:
    if min(len(a), len(b)) * DEN < NUM * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * both >= NUM * (len(a) + len(b) - both)


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps pairs whose signatures agree often enough."""
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, HASHES) for c in ("sig_a", "sig_b"))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= SIGNATURE_LEAST))


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps pairs whose full sets are alike."""
    for batch in batches:
        texts = pa.concat_arrays([batch.column("text_a"), batch.column("text_b")]).dictionary_encode()
        sets = shingle_sets(texts.dictionary)
        i = np.asarray(texts.indices)
        ok = [_alike(sets[x], sets[y]) for x, y in zip(i[: batch.num_rows].tolist(), i[batch.num_rows :].tolist(), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _confirm(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Exact links among materialised pairs (a, b): the texts of their documents alone are moved."""
    ids = materialize(pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select(F.col("b").alias("doc_id"))).distinct(), "mh-ids")
    texts = materialize(by_id(docs.where("doc_id is not null and text is not null"), ids, "doc_id", "left_semi").distinct(), "mh-texts")
    discard(ids)
    left = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
    links = materialize(both.mapInArrow(tidy(_confirmed), "a long, b long").distinct(), "mh-links")
    discard(texts)
    return links


def _with_signatures(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    s = reps.select("rep", "sig")
    return pairs.join(s.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), "a").join(s.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b")), "b").select("a", "b", "sig_a", "sig_b")


def _forest(ca: np.ndarray, cb: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between components as a forest: (component, its root), at most one row a component."""
    names, place = np.unique(np.concatenate([ca, cb]), return_inverse=True)
    i, j = np.flatnonzero(links.any(axis=1)), np.flatnonzero(links.any(axis=0))
    root = local_roots(len(names), [(place[: len(ca)][i], place[len(ca) :][j], links[np.ix_(i, j)])])
    t = np.flatnonzero(root != np.arange(len(names)))
    return names[t], names[root[t]]


def _sides(tile: pa.Table) -> tuple[pa.Table, pa.Table]:
    side = np.asarray(tile["side"])
    return (tile, tile) if not side.any() else (tile.filter(pa.array(side == 1)), tile.filter(pa.array(side == 2)))


def _look_alike(tile: pa.Table) -> pa.RecordBatch | None:
    """One tile of a bucket: components that look alike (kind 0: component, root) and the documents by
    which they do (kind 1: document, component). A tile without both sides holds no pair."""
    left, right = _sides(tile)
    if not left.num_rows or not right.num_rows:
        return None
    ca, cb = np.asarray(left["component"]), np.asarray(right["component"])
    x, y = (np.frombuffer(b"".join(p["sig"].to_pylist()), np.uint8).reshape(-1, HASHES, 4)[:, :, 0].T.copy() for p in (left, right))
    # low bytes: chance agreement only adds candidates
    if len(ca) * len(cb) <= 4096:
        agree = (x[:, :, None] == y[:, None, :]).sum(axis=0, dtype=np.uint8)
    else:
        agree = np.zeros((len(ca), len(cb)), np.uint8)
        for k in range(HASHES):
            agree += x[k][:, None] == y[k]
    near = (agree >= SIGNATURE_LEAST) & (ca[:, None] != cb)
    if not near.any():
        return None
    a, b = _forest(ca, cb, near)
    i, j = near.any(axis=1), near.any(axis=0)
    who, of = np.concatenate([np.asarray(left["rep"])[i], np.asarray(right["rep"])[j]]), np.concatenate([ca[i], cb[j]])
    kind = np.repeat([0, 1], [len(a), len(who)]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate([a, who])), pa.array(np.concatenate([b, of]))], ["kind", "a", "b"])


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sorted distinct arrays, a row for each of left: what right holds is numbered
    once, and each of left marks its own values there."""
    flat = np.concatenate([*right, np.zeros(0, _U)])
    ends = np.concatenate([[0], np.cumsum([len(s) for s in right])])
    values, place = np.unique(flat, return_inverse=True)
    out, hit = np.zeros((len(left), len(right)), np.int64), np.zeros(len(values), bool)
    if not len(values):
        return out
    for row, s in enumerate(left):
        at = np.minimum(np.searchsorted(values, s), len(values) - 1)
        at = at[values[at] == s]
        if len(at):
            hit[at] = True
            out[row] = np.diff(np.concatenate([[0], np.cumsum(hit[place])])[ends])
            hit[at] = False
    return out


def _alike_in_tile(tile: pa.Table) -> pa.RecordBatch | None:
    """One tile of a cluster: exact links between components as a forest (a, b)."""
    left, right = _sides(tile)
    if not left.num_rows or not right.num_rows:
        return None
    x = shingle_sets(left["text"].combine_chunks())
    y = x if right is left else shingle_sets(right["text"].combine_chunks())
    n, m = (np.array([len(s) for s in side]) for side in (x, y))
    ca, cb = np.asarray(left["component"]), np.asarray(right["component"])
    both = common_counts(x, y)
    links = (DEN * both >= NUM * (n[:, None] + m - both)) & (both > 0) & (ca[:, None] != cb)
    if not links.any():
        return None
    a, b = _forest(ca, cb, links)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _by_tiles(rows: DataFrame, key: str, ident: str, of, schema: str, tag: str) -> DataFrame:
    """Deals rows (key, k, ...) to the pairs of k blocks of their key, one side for i and one for j, and runs
    `of` on each tile.

    They are dealt anew by the whole tile: rows that a join has left dealt by key alone would be taken as
    they lie, with all tiles of a key in one task. Tasks are as many as the rows ask for, so none grows with them.
    """
    cols = [c for c in rows.columns if c != "k"]
    dealt = materialize(rows.withColumn("p", F.pmod(F.xxhash64(ident), F.col("k")).cast("int")), f"{tag}-dealt")
    copies = dealt.agg(F.sum(F.when(F.col("k") == 1, 1).otherwise(F.col("k") + 1))).first()[0] or 0  # one number
    last, zero = F.col("k") - 1, F.lit(0)
    one = dealt.where("k = 1").select(*cols, zero.alias("i"), zero.alias("j"), zero.alias("side"))
    many = dealt.where("k > 1")
    first = many.select(*cols, F.col("p").alias("i"), F.explode(F.sequence("p", last)).alias("j"), F.lit(1).alias("side"))
    second = many.select(*cols, F.explode(F.sequence(zero, "p")).alias("i"), F.col("p").alias("j"), F.lit(2).alias("side"))
    tasks = max(1, -(-copies // TASK_ROWS))
    tiles = one.unionAll(first).unionAll(second).repartition(tasks, key, "i", "j").sortWithinPartitions(key, "i", "j")
    out = materialize(tiles.mapInArrow(tidy(grouped([key, "i", "j"], of)), schema).distinct(), tag)
    discard(dealt)
    return out


def _residual(multi: DataFrame, reps: DataFrame, comps: DataFrame, docs: DataFrame) -> DataFrame | None:
    """Exact links (a, b) between components whose members share a bucket and look alike."""
    named = multi.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", F.coalesce("component", "rep").alias("component"))
    mixed_up = named.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi")
    rest = named.join(mixed_up.select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("k")), "bucket").join(reps.select("rep", "sig"), "rep")
    raw = _by_tiles(rest, "bucket", "rep", _look_alike, "kind int, a long, b long", "mh-alike")
    edges = raw.where("kind = 0").select(F.col("a").alias("u"), F.col("b").alias("v"))
    if edges.isEmpty():
        return None
    clusters = connected_components(edges, "mh-clusters").select(F.col("node").alias("component"), F.col("component").alias("cluster"))
    flagged = materialize(raw.where("kind = 1").select(F.col("a").alias("doc_id"), F.col("b").alias("component")).join(clusters, "component"), "mh-flagged")
    texts = materialize(by_id(docs.where("doc_id is not null and text is not null"), flagged, "doc_id"), "mh-texts")
    sizes = texts.groupBy("cluster").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum(F.octet_length("text")) / BLOCK_BYTES)).cast("int").alias("k"))
    found = _by_tiles(texts.join(sizes, "cluster").select("cluster", "k", "doc_id", "component", "text"), "cluster", "doc_id", _alike_in_tile, "a long, b long", "mh-links")
    discard(texts)
    return found


@settled("near")
def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_shingles, component_id, kept."""
    docs = docs.select("doc_id", "text")
    signed = materialize(docs.mapInArrow(tidy(_signatures), "doc_id long, n_shingles long, set_key binary, sig binary"), "mh-signed")
    reps = materialize(signed.where("doc_id is not null and set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.min_by("sig", "doc_id").alias("sig")), "mh-reps")
    size = 4 * ROWS
    bands = F.array(*[F.xxhash64(F.lit(b), F.substring("sig", 1 + b * size, size)) for b in range(HASHES // ROWS)])
    buckets = reps.select("rep", F.explode(bands).alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("rep").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", "pivot")
    multi = materialize(buckets.join(shared, "bucket"), "mh-buckets")
    stars = multi.where("rep <> pivot").groupBy("rep", "pivot").agg(F.count(F.lit(1)).alias("n"))
    stars = stars.groupBy("rep").agg(F.max(F.struct("n", (-F.col("pivot")).alias("minus"))).alias("best")).select(F.col("rep").alias("a"), (-F.col("best.minus")).alias("b"))
    pairs = materialize(_with_signatures(stars, reps).mapInArrow(tidy(_agreeing), "a long, b long").distinct(), "mh-pairs")
    links = _confirm(pairs, docs)
    comps = materialize(connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "mh-comps")
    extra = _residual(multi, reps, comps, docs)
    if extra is not None:
        merged = connected_components(extra.select(F.col("a").alias("u"), F.col("b").alias("v")), "mh-merged").select(F.col("node").alias("component"), F.col("component").alias("top"))
        whole = comps.unionByName(merged.select(F.col("component").alias("node"), "component")).distinct()
        comps = materialize(whole.join(merged, "component", "left").select("node", F.coalesce("top", "component").alias("component")), "mh-comps")
    classes = reps.select("set_key", "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    # documents without shingles have no class: they don't take part, as null keys would all go to one task
    out = signed.where("set_key is not null").join(classes, "set_key", "left").select("doc_id", "n_shingles", "component")
    out = out.unionByName(signed.where("set_key is null").select("doc_id", "n_shingles"), allowMissingColumns=True)
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
