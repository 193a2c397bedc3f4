"""Embedding near-dedup by a subspace pigeonhole join.

Two unit vectors of cosine c are at squared distance 2-2c. After a fixed random rotation the coordinates are
split into blocks; a pair within the whole budget is within the proportional share of it in at least one
block. Each block is range-joined by itself within a label, and the union of what passes is verified by cosine in
double precision on the given vectors.

1. Equal vectors of a label are one class, however many there are; its smallest vec_id stands for it.
2. Classes are dealt to tiles. Up to WHOLE classes a label is one cell for all blocks, cut into tiles, so a vector is
   sent once for each tile of its label; a larger label has cells of its own for each block, on as many of the
   block's leading coordinates as pay, and a vector is sent to its home cell and to those that its share of the
   budget can reach. Cells are cut into tiles as well, and a task compares one tile with one other.
3. Within a tile each block is joined in the order of its widest coordinate: a run of vectors meets only those
   within the share's distance on it, and the pairs within the share on all of the block are candidates.

A task returns, per class, a count of links and its least reachable class there, never pairs, so a group of
m near copies costs rows in proportion to m. Isotropic vectors make cells overlap widely at this threshold;
then the work is close to comparing tiles within a label, which README.md says with figures.

Defined cases: null, empty or zero vectors, vectors with null or non-finite components, and null labels link
with nothing; vectors of unequal dimension don't link; rows that repeat a vec_id are one vector (that of the least
label and vector hash); ties need no care, as a component is named by its least vec_id; a null vec_id is returned as
its own component (null); an empty table gives no rows. Vectors are told apart by 128 bits of hash. Extra columns
are ignored.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_id, discard, grouped, materialize, settled, tidy
from .components import connected_components, local_roots

COSINE, BLOCKS = 0.93, 4
#: Vectors of a tile; classes of a label up to which it is one cell, and from which on cells have 2 and 3 coordinates.
TILE, WHOLE, GRID = 4096, 65_536, (1 << 20, 1 << 24)
#: Rows of a run in a tile's join; rows of a task of tiles, on average.
RUN, TASK_ROWS = 256, 8192
EPS = 1e-5
_TILED = "label string, dim int, block int, cell long, home boolean, vec_id long, n long, vec binary"
_COUNTED = "vec_id long, links long, root long"


@functools.cache
def rotation(dim: int) -> np.ndarray:
    return np.linalg.qr(np.random.Generator(np.random.PCG64(11)).standard_normal((dim, dim)))[0]


def block_slices(dim: int) -> list[slice]:
    cuts = np.linspace(0, dim, min(BLOCKS, dim) + 1).astype(int).tolist()
    return [slice(a, b) for a, b in itertools.pairwise(cuts)]


def budget(cosine: float, dim: int, s: slice) -> float:
    return (2 - 2 * cosine) * (s.stop - s.start) / dim + EPS


def units(x: np.ndarray) -> np.ndarray:
    """Unit vectors; the largest component is scaled out first, as squares of finite numbers may not be finite."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cells(y: np.ndarray, g: int, radius: float):
    """(row, cell, home): the home cell of each row and the cells within the radius on g coordinates."""
    at = np.floor(y[:, :g] / radius).astype(np.int64)
    low = y[:, :g] - at * radius
    for move in itertools.product((-1, 0, 1), repeat=g):
        m = np.array(move)
        gap = np.where(m < 0, low, np.where(m > 0, radius - low, 0.0))
        ok = np.flatnonzero((gap**2).sum(axis=1) <= radius**2)
        if len(ok):
            cell = np.zeros(len(ok), np.int64)
            for k in range(g):
                cell = cell * 4096 + (at[ok, k] + m[k] + 2048)
            yield ok, cell, np.full(len(ok), not m.any())


def _matrix(column: pa.Array, dim: int, wide: bool) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64 if wide else np.float32).reshape(-1, dim).astype(float)


def _placed(cosine: float, wide: bool):
    """Rows (label, dim, size, vec_id, n, embedding) at their cells; block -1 and cell 0 are a whole label."""

    def of(batches):
        for batch in batches:
            size, dims = np.asarray(batch.column("size")), np.asarray(batch.column("dim"))
            values = np.asarray(batch.column("embedding").flatten())
            ends = np.concatenate([[0], np.cumsum(dims)])
            raw = pa.array([values[a:b].tobytes() for a, b in itertools.pairwise(ends.tolist())], pa.binary())
            full = pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("label", "dim", "vec_id", "n")), raw], ["label", "dim", "vec_id", "n", "vec"])

            def rows(i, block, cell, home, full=full):
                part = full.take(pa.array(i))
                return pa.RecordBatch.from_arrays([part.column("label"), part.column("dim"), pa.array(np.full(len(i), block, np.int32)), pa.array(cell), pa.array(home), *(part.column(c) for c in ("vec_id", "n", "vec"))], [c.split()[0] for c in _TILED.split(", ")])

            i = np.flatnonzero(size <= WHOLE)
            if len(i):
                yield rows(i, -1, np.zeros(len(i), np.int64), np.ones(len(i), bool))
            for dim in np.unique(dims[size > WHOLE]).tolist():
                for g in (1, 2, 3):
                    i = np.flatnonzero((dims == dim) & (size > WHOLE) & (1 + (size > GRID[0]) + (size > GRID[1]) == g))
                    if not len(i):
                        continue
                    y = units(np.stack([values[ends[k] : ends[k] + dim] for k in i]).astype(float)) @ rotation(dim)
                    for b, s in enumerate(block_slices(dim)):
                        for row, cell, home in _cells(y[:, s], min(g, s.stop - s.start), budget(cosine, dim, s) ** 0.5):
                            yield rows(i[row], b, cell, home)

    return of


def _near(x: np.ndarray, z: np.ndarray, share: float) -> np.ndarray:
    return (x**2).sum(axis=1)[:, None] + (z**2).sum(axis=1) - 2 * (x @ z.T) <= share


def candidates(x: np.ndarray, z: np.ndarray, share: float, into: np.ndarray) -> None:
    """Marks the pairs of rows within the share of squared distance: a range join on the widest coordinate, then on all."""
    wide = int(np.argmax(z.var(axis=0)))
    a, b = np.argsort(x[:, wide], kind="stable"), np.argsort(z[:, wide], kind="stable")
    low, high, reach = x[a, wide], z[b, wide], share**0.5
    for s in range(0, len(a), RUN):
        e = min(s + RUN, len(a))
        f, t = np.searchsorted(high, low[s] - reach), np.searchsorted(high, low[e - 1] + reach, side="right")
        if t > f:
            i, j = np.nonzero(_near(x[a[s:e]], z[b[f:t]], share))
            into[a[s + i], b[f + j]] = True


def _links_of_tile(cosine: float, wide: bool):
    def of(tile: pa.Table):
        side, home = np.asarray(tile["side"]), np.asarray(tile["home"])
        block, dim = tile["block"][0].as_py(), tile["dim"][0].as_py()
        left, right = (tile.filter(pa.array(home & (side != 2))), tile.filter(pa.array(side != 1)))
        if not left.num_rows or not right.num_rows:
            return None
        twice = block < 0 and not (side == 0).any()  # a tile of one whole label's tile with another: both ways count
        x, z = (units(_matrix(p["vec"], dim, wide)) for p in (left, right))
        ix, iz, nx, nz = np.asarray(left["vec_id"]), np.asarray(right["vec_id"]), np.asarray(left["n"]), np.asarray(right["n"])
        rx, rz = ((v @ rotation(dim)).astype(np.float32) for v in (x, z))
        slices = block_slices(dim)
        pairs = np.zeros((len(x), len(z)), bool)
        for b in range(len(slices)) if block < 0 else (block,):
            candidates(rx[:, slices[b]], rz[:, slices[b]], budget(cosine, dim, slices[b]), pairs)
        rows, cols, links = [], [], []
        for a in range(0, len(x), 512):
            i = np.arange(a, min(a + 512, len(x)))
            r, c = np.flatnonzero(pairs[i].any(axis=1)), np.flatnonzero(pairs[i].any(axis=0))
            if not len(r):
                continue
            i = i[r]
            good = pairs[np.ix_(i, c)] & (ix[i][:, None] != iz[c]) & (x[i] @ z[c].T >= cosine)
            for k in range(max(block, 0)):  # a pair counts in the first block that passes it
                good &= ~_near(rx[i][:, slices[k]], rz[c][:, slices[k]], budget(cosine, dim, slices[k]))
            if good.any():
                rows.append(i)
                cols.append(c)
                links.append(good)
        if not links:
            return None
        # least vec_id reachable within the tile, by spreading it along the links
        names, place = np.unique(np.concatenate([ix, iz]), return_inverse=True)
        px, pz = place[: len(ix)], place[len(ix) :]
        count, touched = np.zeros(len(names), np.int64), np.zeros(len(names), bool)
        for i, c, good in zip(rows, cols, links, strict=True):
            np.add.at(count, px[i], good @ nz[c])
            if twice:
                np.add.at(count, pz[c], nx[i] @ good)
            touched[px[i][good.any(axis=1)]] = True
            touched[pz[c][good.any(axis=0)]] = True
        root = local_roots(len(names), [(px[i], pz[c], good) for i, c, good in zip(rows, cols, links, strict=True)])
        t = np.flatnonzero(touched)
        return pa.RecordBatch.from_arrays([pa.array(names[t]), pa.array(count[t]), pa.array(names[root[t]])], ["vec_id", "links", "root"])

    return of


def _tiles(cells: DataFrame) -> DataFrame:
    """Deals each cell's rows to the pairs of its tiles: (i, j) with side 1 for i, 2 for j and 0 for both."""
    key = ["label", "dim", "block", "cell"]
    large = cells.groupBy(key).agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > TILE).select(*key, F.ceil(F.col("m") / TILE).cast("int").alias("k"))
    known = cells.join(large, key, "left").withColumn("k", F.coalesce("k", F.lit(1))).withColumn("p", F.pmod(F.xxhash64("vec_id"), F.col("k")).cast("int"))
    last, zero, whole = F.col("k") - 1, F.lit(0), F.col("block") < 0
    some = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
    tile = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    p = F.col("p")
    # a whole label's pairs of tiles are taken once, i <= j; cells compare home rows of i with all rows of j
    once = F.concat(F.array(tile(p, p, 0)), F.transform(some(p + 1, last), lambda j: tile(p, j, 1)), F.transform(some(zero, p - 1), lambda i: tile(i, p, 2)))
    mine = F.when(F.col("home"), F.transform(F.sequence(zero, last), lambda j: tile(p, j, 1))).otherwise(F.array().cast("array<struct<i:int,j:int,side:int>>"))
    every = F.concat(mine, F.transform(F.sequence(zero, last), lambda i: tile(i, p, 2)))
    return known.select(*cells.columns, F.explode(F.when(whole, once).when(F.col("k") == 1, F.array(tile(zero, zero, 0))).otherwise(every)).alias("t")).select(*cells.columns, "t.*")


@settled("embeddings-linked")
def near_duplicate_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vectors (vec_id, embedding, label, ...) -> vec_id, n_links, component_id, kept."""
    kind = vectors.schema["embedding"].dataType.elementType
    wide = not isinstance(kind, T.FloatType)
    rows = vectors.select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>" if wide else "array<float>").alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists("embedding", lambda v: v != 0)
    fit = F.coalesce(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite, F.lit(False))
    hashed = rows.withColumn("h1", F.when(fit, F.xxhash64("embedding"))).withColumn("h2", F.when(fit, F.xxhash64(F.lit(1), "embedding")))
    one = hashed.where("vec_id is not null").groupBy("vec_id").agg(F.min(F.struct("label", "h1", "h2")).alias("v")).select("vec_id", "v.*")
    members = materialize(one, "emb-members")
    grouped_by = members.where("h1 is not null").groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("n"))
    classes = materialize(grouped_by.join(grouped_by.groupBy("label").agg(F.count(F.lit(1)).alias("size")), "label"), "emb-classes")
    # one row of each class; repeated rows of it are equal
    shape = hashed.where("h1 is not null and vec_id is not null").withColumn("dim", F.size("embedding"))
    whole = by_id(shape, classes, ["vec_id", "label", "h1", "h2"]).dropDuplicates(["vec_id"]).select("label", "dim", "size", "vec_id", "n", "embedding")
    cells = materialize(whole.mapInArrow(tidy(_placed(cosine, wide)), _TILED), "emb-cells")
    copies = cells.groupBy("label", "dim", "block", "cell").count().agg(F.sum(F.col("count") * F.ceil(F.col("count") / TILE))).first()[0] or 0  # one number
    tiles = _tiles(cells).withColumn("label_key", F.xxhash64("label")).repartition(max(1, -(-copies // TASK_ROWS)), "label", "dim", "block", "cell", "i", "j").sortWithinPartitions("block", "cell", "i", "j", "label_key", "dim")
    found = materialize(tiles.mapInArrow(tidy(grouped(["block", "cell", "i", "j", "label_key", "dim"], _links_of_tile(cosine, wide))), _COUNTED), "emb-links")
    discard(cells)
    comps = connected_components(found.select(F.col("vec_id").alias("u"), F.col("root").alias("v")), "emb-comps")
    counts = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    named = classes.join(counts, "vec_id", "left").join(comps.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    named = named.select("label", "h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    out = members.where("h1 is not null").join(named, ["label", "h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = members.where("h1 is null").select("vec_id").unionAll(rows.where("vec_id is null").select("vec_id"))
    out = out.unionByName(alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL
), l AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93
), r AS (
  SELECT u AS vec_id, u AS reach FROM l UNION SELECT r.vec_id, l.w FROM r JOIN l ON r.reach = l.u
)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.u = e.vec_id) AS n_links,
  coalesce((SELECT min(reach) FROM r WHERE r.vec_id = e.vec_id), e.vec_id) AS component_id,
  coalesce((SELECT min(reach) FROM r WHERE r.vec_id = e.vec_id), e.vec_id) = e.vec_id AS kept
FROM embeddings e
"""
