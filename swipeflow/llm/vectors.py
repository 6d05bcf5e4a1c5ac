"""Embedding near-duplicates by a subspace pigeonhole join (op 4).

Unit vectors with cosine c lie at squared distance 2 - 2c.  After a random
rotation they are split into blocks of a few dimensions; two vectors within
the radius are, in at least one block, within that block's share of the squared
radius.  Each block is range-joined: a grid over its first ``grid`` coordinates
with cells as wide as the block's radius brings such pairs into one cell or two
neighbours, and every vector goes to its own cell and to those neighbours on one
side that its ball meets.  Inside a cell rows are sorted by the block's next
coordinate, so that a few probes at a time meet only the rows within the radius
of theirs; there the block distance filters by matrix products that stay in
cache, and what passes is verified by the cosine of the original vectors in
double precision.
A pair is counted in the first block whose share it keeps, so the union over
blocks counts it once.

Tasks report link counts per vector and a spanning forest of their links, never
the pairs.  Equal vectors are one class with a size before all this.  A crowded
cell is cut into tiles of at most ``tile`` by ``tile`` rows.

Defined results: vectors that are null, zero, or hold a null or a non-finite
component link with nothing; only vectors of one length are compared; a null
id never names a component; a row without id is not kept; repeated rows link
with each other; an empty table gives an empty result; other columns are not
read.  All executors need the same numpy, as the rotation is made from a seed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_value, col, components, per_process, stage, table

by_value(__name__)

BLOCK = 16         # dimensions of a block: half as many copies as with 8, and as many pairs to compare
GRID = 2           # of which so many make the grid
TILE = 8192
CHUNK = 128        # probes of one matrix product
WIDE = 2048        # and rows they are compared with at once
SEED = 11


def rotation(dim: int) -> np.ndarray:
    def make():
        q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(dim, dim)))
        return q * np.sign(np.diag(r))
    return per_process(("rotation", dim), make)


def shares(dim: int, cosine: float) -> list[tuple[int, int, float]]:
    """(first, end, share of the squared radius) of each block."""
    total = 2 - 2 * cosine + 1e-9       # a little wider than rounding can move a pair
    return [(a, min(a + BLOCK, dim), total * (min(a + BLOCK, dim) - a) / dim) for a in range(0, dim, BLOCK)]


def rotated(x: np.ndarray) -> np.ndarray:
    return (x / np.linalg.norm(x, axis=1, keepdims=True)) @ rotation(x.shape[1])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _cells(cosine: float):
    """(cid, n, dim, vec) -> with the cells (block, x, y, home) it goes to."""
    kind = pa.struct([("b", pa.int32()), ("x", pa.int64()), ("y", pa.int64()), ("home", pa.bool_())])
    beside = np.array([(0, 0), (1, 0), (-1, 1), (0, 1), (1, 1)])        # its own cell first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                r, blocks = rotated(_matrix(part.column(3))), shares(dim, cosine)
                to = np.zeros((len(r), len(blocks), len(beside), 2), np.int64)
                meets = np.ones(to.shape[:3], bool)
                for b, (first, end, share) in enumerate(blocks):
                    at = r[:, first:min(first + GRID, end)] / np.sqrt(share)        # in radii, as wide as a cell
                    if at.shape[1] < 2:
                        at = np.hstack([at, np.zeros_like(at)])
                        meets[:, b, 2:] = False
                    cell = np.floor(at)
                    to[:, b] = cell.astype(np.int64)[:, None] + beside
                    up, left = 1 - (at - cell), at[:, 0] - cell[:, 0]               # to the borders
                    meets[:, b, 2] &= left ** 2 + up[:, 1] ** 2 <= 1 + 1e-6
                    meets[:, b, 4] &= (up ** 2).sum(1) <= 1 + 1e-6
                row, b, which = np.nonzero(meets)
                cells = pa.StructArray.from_arrays(
                    [pa.array(b.astype(np.int32)), pa.array(to[meets][:, 0]), pa.array(to[meets][:, 1]),
                     pa.array(which == 0)], fields=list(kind))
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(r)))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(ends), cells)],
                                                 names=[*part.schema.names, "cells"])
    return run


def _links(vec: np.ndarray, a: np.ndarray, b: np.ndarray, block: int, cosine: float, rot: np.ndarray) -> np.ndarray:
    """Which of the pairs (a, b) of rows are links to count in ``block``."""
    ok = np.ones(len(a), bool)
    for first, end, share in shares(vec.shape[1], cosine)[:block + 1]:
        d = rot[a, first:end] - rot[b, first:end]
        near = (d * d).sum(1) <= share
        ok &= near if first == block * BLOCK else ~near
    a, b = a[ok], b[ok]
    x, y = vec[a], vec[b]
    cos = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
    ok[ok] = cos >= cosine
    return ok


def windows(probe: np.ndarray, build: np.ndarray, radius: float, same: bool) -> Iterator[tuple[int, int, int, int]]:
    """Parts (of ``probe``, of ``build``) of two sorted coordinates that hold every
    pair within ``radius``; if they are the same, each pair once at least."""
    for at in range(0, len(probe), CHUNK):
        to = min(at + CHUNK, len(probe))
        low = np.searchsorted(build, probe[at] - radius)
        high = np.searchsorted(build, probe[to - 1] + radius, "right")
        for first in range(max(low, at) if same else low, high, WIDE):
            yield at, to, first, min(first + WIDE, high)


def join_tile(vec, n, probe, build, block: int, cosine: float, same: bool) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links between the rows ``probe`` and ``build`` of a cell (each pair once
    if they are the same): number of linked vectors per row, spanning links."""
    rot = rotated(vec)
    first, end, share = shares(vec.shape[1], cosine)[block]
    sub = rot[:, first:end].astype(np.float32)
    most = np.float32(share + 1e-5)               # wider than single precision can move a distance
    c = sub[:, min(GRID, end - first - 1)]
    probe, build = probe[np.argsort(c[probe])], build[np.argsort(c[build])]
    norm, one = (sub * sub).sum(1, keepdims=True), np.ones((len(sub), 1), np.float32)
    left = np.hstack([-2 * sub, norm, one])[probe]
    right = np.ascontiguousarray(np.hstack([sub, one, norm])[build].T)
    count, label, out = np.zeros(len(vec), np.int64), np.arange(len(vec)), []
    for at, to, b0, b1 in windows(c[probe], c[build], float(np.sqrt(most)) + 1e-5, same):
        near = np.flatnonzero((left[at:to] @ right[:, b0:b1]).ravel() <= most)
        i, j = np.divmod(near, b1 - b0)
        i, j = i + at, j + b0
        if same:
            once = i < j
            i, j = i[once], j[once]
        if not len(i):
            continue
        a, b = probe[i], build[j]
        ok = _links(vec, a, b, block, cosine, rot)
        a, b = a[ok], b[ok]
        np.add.at(count, a, n[b])
        np.add.at(count, b, n[a])
        while True:                               # smallest label along the new links
            m = np.minimum(label[a], label[b])
            apart = label[a] != label[b]
            if not apart.any():
                break
            old = np.maximum(label[a], label[b])[apart]
            least = np.arange(len(vec))
            np.minimum.at(least, old, m[apart])
            moved = np.unique(old)
            out += zip(moved.tolist(), least[moved].tolist())
            label = least[label]
    return count, out


def _join(cosine: float):
    def tile(parts: list[pa.RecordBatch]):
        t = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        cid, n, probe = t.column("cid").to_numpy(), t.column("n").to_numpy(), t.column("probe").to_numpy(zero_copy_only=False)
        vec, block = _matrix(t.column("vec")), t.column("b")[0].as_py()
        same = t.column("i")[0].as_py() == t.column("j")[0].as_py() and not t.column("beside")[0].as_py()
        every = np.arange(len(cid))
        count, links = join_tile(vec, n, every if same else every[probe], every if same else every[~probe],
                                 block, cosine, same)
        hit = np.flatnonzero(count)
        a = np.concatenate([cid[hit], np.array([cid[x] for x, _ in links], np.int64)])
        b = np.concatenate([np.full(len(hit), -1), np.array([cid[y] for _, y in links], np.int64)])
        m = np.concatenate([count[hit], np.zeros(len(links), np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b.astype(np.int64)), pa.array(m)], names=["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None                      # sorted by tile: hold one tile at a time
        for batch in batches:
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "b", "x", "y", "beside", "i", "j")]
            new = np.ones(batch.num_rows, bool)
            if batch.num_rows:
                new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
            for s, e in zip(np.flatnonzero(new), [*np.flatnonzero(new)[1:], batch.num_rows]):
                key = tuple(k[s] for k in keys)
                if held and key != now:
                    yield tile(held)
                    held = []
                now = key
                held.append(batch.slice(s, e - s))
        if held:
            yield tile(held)
    return run


def link_counts(classes: DataFrame, cosine: float, tile: int, kind: str = "float") -> DataFrame:
    """``classes(cid, n, dim, vec)`` -> rows (a, -1, n): links of class a found
    in one tile, and (a, b, 0): spanning links."""
    cell = ["dim", "b", "x", "y"]
    placed = classes.mapInArrow(_cells(cosine), f"cid long, n long, dim int, vec array<{kind}>, "
                                "cells array<struct<b:int,x:bigint,y:bigint,home:boolean>>")
    placed = stage(placed, "vector-cells").select("cid", "n", "dim", "vec", F.explode("cells").alias("c")).select(
        "cid", "n", "dim", "c.*", "vec")
    crowd = stage(placed.groupBy(*cell).agg(
        F.ceil(F.count_if("home") / tile).cast("int").alias("homes"),
        F.ceil(F.count_if(~F.col("home")) / tile).cast("int").alias("besides")).where("homes > 0"), "vector-crowd")
    rows = placed.join(crowd, cell)

    def part(parts):
        return F.pmod(F.xxhash64("cid"), F.col(parts)).cast("int")

    def tiles(parts):
        return F.sequence(F.lit(0), F.col(parts) - 1)
    # tile (beside, i, j): probes of part i against homes of part j
    none = F.array().cast("array<struct<beside:boolean,i:int,j:int,probe:boolean>>")
    own = part("homes")

    def to(beside, i, j, probe):
        return F.struct(F.lit(beside).alias("beside"), i.alias("i"), j.alias("j"), F.lit(probe).alias("probe"))
    within = F.concat(F.transform(F.filter(tiles("homes"), lambda j: j >= own), lambda j: to(False, own, j, True)),
                      F.transform(F.filter(tiles("homes"), lambda i: i < own), lambda i: to(False, i, own, False)))
    against = F.when(F.col("besides") > 0, F.transform(tiles("besides"), lambda i: to(True, i, own, False))).otherwise(none)
    probes = F.transform(tiles("homes"), lambda j: to(True, part("besides"), j, True))
    rows = (rows.withColumn("t", F.explode(F.when(F.col("home"), F.concat(within, against)).otherwise(probes)))
            .select(*cell, "t.*", "cid", "n", "vec"))
    key = [*cell, "beside", "i", "j"]
    return rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(_join(cosine), "a long, b long, n long")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95,
                 tile: int = TILE) -> DataFrame:
    """One row per vector: id, links, component id, kept."""
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be above 0 and at most 1")
    v = col(vectors, vector_col)
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    usable = F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))
    base = vectors.select(col(vectors, id_col).alias("vec_id"), v.alias("vec"), usable.alias("ok"),
                          F.xxhash64(v).alias("h1"), F.xxhash64(F.lit(1), v).alias("h2"))
    classes = (base.where("ok").groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"),
                                                        F.first("vec").alias("vec"))
               .withColumn("cid", F.monotonically_increasing_id()))
    classes = stage(classes, "vector-classes")    # from here the class ids are fixed
    kind = "float" if classes.schema["vec"].dataType.elementType.simpleString() == "float" else "double"
    found = stage(link_counts(classes.select("cid", "n", F.size("vec").alias("dim"), F.col("vec").cast(f"array<{kind}>").alias("vec")),
                              cosine, tile, kind), "vector-links")
    count = found.where("b < 0").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("others"))
    roots = components(found.where("b >= 0").select("a", "b"))
    joined = stage(classes.drop("vec").join(count, "cid", "left").join(roots, F.col("cid") == F.col("node"), "left")
                   .withColumn("root", F.coalesce("root", "cid")), "vector-roots")
    least = stage(joined.groupBy("root").agg(F.min("least").alias("component_id")), "vector-least")
    named = joined.join(least, "root").select(
        "h1", "h2", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    plain = base.where("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = base.where("ok").select("vec_id", "h1", "h2").join(named, ["h1", "h2"]).select(
        "vec_id", "n_links", "component_id").union(plain)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op4_subspace_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
