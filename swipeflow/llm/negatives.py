"""Hard negatives by a secondary-sort shuffle (op 12).

Every anchor is scored against every row by the inner product of their
components, scaled and rounded down to whole numbers.  Anchors and rows meet in
cells of a grid: a block of anchors times a block of rows, both of bounded size,
as matrix products inside a task.  Nothing is broadcast and no pair is written
as such: of each cell an anchor keeps its best ``positives`` rows of its label
and, once its positives are known, the first ``negatives`` rows in the window of
each of them.  What is first overall is first in its cell, so this loses nothing.

What is left is shuffled by a key of anchor, descending score and id, sorted
inside the partitions (a secondary sort).  An iterator reads the stream once: a
positive opens a window, a row of another label goes to each open window that
its score is in, and a window is closed when it is full or when scores fall
below it.  It holds the open windows of one anchor, never the anchor's rows.

Defined results: rows take part if label and vector are there and all components
are finite numbers; empty vectors do not, nor those with components so large
that a hundred times a score could be beyond a long.  Vectors of one length are
scored with each other only.  Rows that are equal in id, label and scaled vector
are one row; rows that share an id only are different rows.  Ties go by smaller
id, rows without id last (their id is null in the result), then by a hash of
label and vector.  A row without id is an anchor only if ``anchor`` says so.  A
negative positive score has no window.  An empty table gives an empty result;
other columns are not read.  Ids are longs below the largest one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LAST, by_value, col, stage, table

by_value(__name__)

SIDE = 4096              # anchors, and rows, of a cell at most (about; cells are filled by hash)
CELL_BYTES = 1 << 24     # and bytes of either side, for long vectors
SLICE = 256              # anchors scored at once
PAIRS = "anchor long, anchor_uid long, fall long, negative boolean, id long, uid long"
MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
KEY = ["anchor", "anchor_uid", "fall", "negative", "id", "uid"]   # fall: the score, descending


def _cells(work):
    """Collects the cells of a sorted stream and calls ``work(anchors, rows)``
    with at most SIDE rows at once; each side is a batch of distinct rows."""
    def flush(anchors, held):
        if anchors and held:
            yield from work(pa.Table.from_batches(anchors).combine_chunks().to_batches()[0],
                            pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors: list[pa.RecordBatch] = []
        held: list[pa.RecordBatch] = []
        cell = last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
                             for c in ("dim", "a", "r", "probe", "id", "uid")], axis=1)
            before = np.vstack([keys[:1] if last is None else last[None], keys[:-1]])
            new = (keys != before).any(axis=1)
            new[0] |= last is None
            last = keys[-1]
            batch, keys = batch.filter(pa.array(new)), keys[new]       # repeated rows are one
            edge = np.flatnonzero((keys[1:, :4] != keys[:-1, :4]).any(axis=1)) + 1
            for s, e in zip([0, *edge], [*edge, len(keys)]):
                if s == e:
                    continue
                here = tuple(keys[s, :3])
                if here != cell:
                    yield from flush(anchors, held)
                    cell, anchors, held = here, [], []
                if not keys[s, 3]:
                    anchors.append(batch.slice(s, e - s))
                    continue
                held.append(batch.slice(s, e - s))
                if sum(b.num_rows for b in held) >= SIDE:
                    yield from flush(anchors, held)
                    held = []
        yield from flush(anchors, held)
    return run


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("vec")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _scored(anchors: pa.RecordBatch, rows: pa.RecordBatch):
    """(first anchor, scores of a slice of anchors against the rows), exact."""
    a, r = _matrix(anchors), _matrix(rows)
    most = float(np.abs(a).max()) * float(np.abs(r).max()) * a.shape[1]
    kind = np.float64 if most < 2.0 ** 53 else np.int64         # whole numbers are exact in doubles below that
    a, r = a.astype(kind), r.astype(kind)
    for at in range(0, len(a), SLICE):
        yield at, (a[at:at + SLICE] @ r.T).astype(np.int64)


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "uid", "label"))


def _first(scores: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
    """The first ``k`` of the rows ``among`` (in order of id) by falling score, ties in their order."""
    s = scores[among]
    if len(among) > 4 * k:
        among = among[s >= np.partition(s, len(s) - k)[len(s) - k]]
        s = scores[among]
    return among[np.argsort(-s, kind="stable")[:k]]


def _pairs(found: list[tuple], negative: bool) -> pa.RecordBatch:
    parts = [np.concatenate([np.asarray(x, np.int64) for x in part]) for part in zip(*found)]
    a, au, fall, i, u = parts
    flags = np.full(len(a), negative)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (a, au, fall, flags, i, u)], names=KEY)


def _positives(k: int):
    def work(anchors: pa.RecordBatch, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        (aid, auid, alab), (rid, ruid, rlab) = _ids(anchors), _ids(rows)
        same = {x: np.flatnonzero(rlab == x) for x in np.unique(alab).tolist()}
        found = []
        for at, scores in _scored(anchors, rows):
            for i, s in enumerate(scores, at):
                among = same[int(alab[i])]
                among = among[(rid[among] != aid[i]) | (ruid[among] != auid[i])]
                best = _first(s, among, k)
                found.append((np.full(len(best), aid[i]), np.full(len(best), auid[i]), -s[best], rid[best], ruid[best]))
        if found:
            yield _pairs(found, False)
    return _cells(work)


def _negatives(k: int, low: int, high: int):
    def work(anchors: pa.RecordBatch, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        (aid, auid, alab), (rid, ruid, rlab) = _ids(anchors), _ids(rows)
        other = {x: np.flatnonzero(rlab != x) for x in np.unique(alab).tolist()}
        scores_of = [set(x or ()) for x in anchors.column("scores").to_pylist()]
        found = []
        for at, scores in _scored(anchors, rows):
            for i, s in enumerate(scores, at):
                among = other[int(alab[i])]
                hundred = 100 * s[among]
                picked = [_first(s, among[(hundred >= low * p) & (hundred <= high * p)], k) for p in scores_of[i]]
                if picked:
                    best = np.unique(np.concatenate(picked))
                    found.append((np.full(len(best), aid[i]), np.full(len(best), auid[i]), -s[best], rid[best], ruid[best]))
        if found:
            yield _pairs(found, True)
    return _cells(work)


def _best(k: int):
    """The first ``k`` pairs of each anchor in a sorted stream."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n = None, 0
        for batch in batches:
            keep = []
            for a, u in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if (a, u) != now:
                    now, n = (a, u), 0
                keep.append(n < k)
                n += 1
            yield batch.filter(pa.array(keep, pa.bool_()))
    return run


def windowed(rows, negatives: int, low: int, high: int):
    """(anchor, uid, fall, negative, id, uid) in key order -> mined rows.  Holds
    the open windows of one anchor: [positive, its score, negatives so far]."""
    now, open_windows = None, []
    for anchor, uid, fall, negative, other, _ in rows:
        if (anchor, uid) != now:
            now, open_windows = (anchor, uid), []
        if not negative:
            open_windows.append([other, -fall, 0])
            continue
        full = False
        for w in open_windows:
            if low * w[1] <= -100 * fall <= high * w[1]:
                w[2] += 1
                yield anchor, w[0], w[2], other, w[1], -fall
            full |= w[2] >= negatives or -100 * fall < low * w[1]
        if full:
            open_windows = [w for w in open_windows if w[2] < negatives and -100 * fall >= low * w[1]]


def _mine(negatives: int, low: int, high: int):
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []

        def made():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                              names=[x.split()[0] for x in MINED.split(", ")])
        stream = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        for row in windowed(stream, negatives, low, high):
            out.append(row)
            if len(out) == 8192:
                yield made()
                out = []
        if out:
            yield made()
    return run


def scaled_rows(vectors: DataFrame, id_col: str, label: Column, vector_col: str, anchor: Column, scale: int) -> DataFrame:
    """Rows that take part: id, uid, label, dim, vec of whole numbers, is_anchor."""
    v = col(vectors, vector_col)
    big = F.sqrt(F.lit(2.0 ** 55) / F.size(v))                # dim * big * big * 100 stays below the largest long
    good = F.forall(v, lambda x: F.coalesce(F.abs(F.floor(x.cast("double") * scale).cast("double")) <= big, F.lit(False)) & ~F.isnan(x))
    rows = vectors.select(F.coalesce(col(vectors, id_col).cast("long"), F.lit(LAST)).alias("id"), label.cast("long").alias("label"),
                          F.when(F.coalesce(good, F.lit(False)), v).alias("v"),
                          F.coalesce(anchor, F.lit(False)).alias("is_anchor")).where("label IS NOT NULL AND size(v) > 0")
    vec = F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("int"))
    return rows.select("id", "label", F.size("v").alias("dim"), vec.alias("vec"), "is_anchor").withColumn(
        "uid", F.xxhash64("label", "vec"))


def meet(anchors: DataFrame, rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Anchors and rows dealt into cells (dim, a, r), anchors first, in order of id."""
    own = F.xxhash64("id", "uid")
    a = anchors.join(sizes, "dim").select(
        "dim", F.pmod(own, "n_a").cast("int").alias("a"), F.explode(F.sequence(F.lit(0), F.col("n_r") - 1)).alias("r"),
        F.lit(0).alias("probe"), "id", "uid", "label", "vec", "scores")
    r = rows.join(sizes, "dim").select(
        "dim", F.explode(F.sequence(F.lit(0), F.col("n_a") - 1)).alias("a"), F.pmod(own, "n_r").cast("int").alias("r"),
        F.lit(1).alias("probe"), "id", "uid", "label", "vec", F.lit(None).cast("array<long>").alias("scores"))
    return a.union(r).repartition("dim", "a", "r").sortWithinPartitions("dim", "a", "r", "probe", "id", "uid")


def mine(vectors: DataFrame, id_col: str = "vec_id", label: Column | None = None, vector_col: str = "embedding",
         anchor: Column | None = None, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
         scale: int = 256) -> DataFrame:
    """One row per anchor, positive and rank: the first ``negatives`` rows of
    other labels whose score is ``low`` to ``high`` per cent of the positive's,
    for each of the anchor's first ``positives`` rows of its own label."""
    if min(positives, negatives, scale) < 1 or not 0 <= low <= high <= 100:
        raise ValueError("positives, negatives and scale must be at least 1, and 0 <= low <= high <= 100")
    label = col(vectors, "label") if label is None else label
    anchor = col(vectors, id_col) % 100 == 0 if anchor is None else anchor
    rows = stage(scaled_rows(vectors, id_col, label, vector_col, anchor, scale), "scaled-vectors")
    anchors = rows.where("is_anchor")
    side = F.greatest(F.lit(1), F.least(F.lit(SIDE), F.floor(F.lit(CELL_BYTES) / (8 * F.col("dim")))))
    sizes = stage(rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("is_anchor").alias("m")).where("m > 0").select(
        "dim", F.ceil(F.col("n") / side).cast("int").alias("n_r"), F.ceil(F.col("m") / side).cast("int").alias("n_a")), "cells")

    def in_key_order(pairs: DataFrame) -> DataFrame:
        return pairs.repartition("anchor", "anchor_uid").sortWithinPartitions(*KEY)
    best = meet(anchors.withColumn("scores", F.lit(None).cast("array<long>")), rows, sizes).mapInArrow(_positives(positives), PAIRS)
    best = stage(in_key_order(best).mapInArrow(_best(positives), PAIRS), "positives")
    # the scores of an anchor's positives travel with it: one short row per anchor on both sides
    wanted = best.where("fall <= 0").groupBy("anchor", "anchor_uid").agg(F.collect_set(-F.col("fall")).alias("scores"))
    asked = anchors.join(wanted, (F.col("id") == F.col("anchor")) & (F.col("uid") == F.col("anchor_uid")))
    near = meet(asked, rows, sizes).mapInArrow(_negatives(negatives, low, high), PAIRS)
    mined = in_key_order(best.union(near)).mapInArrow(_mine(negatives, low, high), MINED)
    null = {f"{x}_id": F.nullif(F.col(f"{x}_id"), F.lit(LAST)) for x in ("anchor", "positive", "negative")}
    return mined.withColumns(null)


def op12_secondary_sort_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(v, label=label)


OP12_SQL = """
WITH r AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pair AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
           CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
    FROM r AS a JOIN r AS b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positive AS (
    SELECT * FROM pair WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
mined AS (
    SELECT p.anchor_id, p.other AS positive_id, n.other AS negative_id, p.score AS positive_score, n.score AS negative_score,
           row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY n.score DESC, n.other) AS rank
    FROM positive AS p JOIN pair AS n ON n.anchor_id = p.anchor_id AND NOT n.same
     AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM mined WHERE rank <= 10
"""
