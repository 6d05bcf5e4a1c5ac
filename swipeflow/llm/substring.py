"""Substring de-duplication by relative Lempel-Ziv parsing (op 2).

A word goes if a window of ``window`` words that covers it also starts in a
document with a smaller id.  Blocks found by hash stand in for the greedy parse
(README says why); what they give is its factors, copies of reference blocks held
by earlier documents, and literal words between them:

1. *Blocks.*  Of each window the k-gram with the smallest hash is its anchor
   (winnowing), so equal windows have equal anchors.  The windows of one anchor
   and the words they span are a block.  The index is one row per block: anchor
   hash, document, text hash, place, block hash; it holds no text.
2. *Whole blocks.*  Anchors seen in one document only are left out (one partial
   aggregation, one join).  Of equal blocks the smallest document is the
   reference; every other is a copy and all its windows are covered.
3. *Factor boundaries.*  Where an anchor has several different blocks, a factor
   begins or ends inside them.  Only the reference blocks of such anchors are
   opened: their windows are compared one by one, by anchor, offset and window
   hash (128 bits in all), again for the smallest document.
4. Covered windows merge into maximal factors; their words are removed.

Counts by anchor, block and window are minima, reduced before each shuffle, and
results go back by joins, which split skewed keys; a passage that a third of
all documents share is never gathered.  Texts are shuffled only for documents
that a bitmap of fixed size names (steps 3 and 4); the others stay in the scan.

Defined results: null and empty texts have no words; a null id counts as larger
than every id; rows that repeat an id (or have none) are told apart by a 64-bit hash
of their text and do not cover each other, equal ones are indexed once; documents below ``window`` words keep all; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LAST, WORD, by_value, col, split_by_bitmap, stage, table, text_of, unstage

by_value(__name__)

WINDOW = 50
ANCHOR = 10
TOGETHER = 400_000               # words hashed at once in a task
C1, C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * C2
    return x ^ (x >> np.uint64(27))


def grams(x: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n values, from runs of 1, 2, 4, ... of them."""
    out, have, power, size = None, 0, x, 1
    while True:
        if n & size:
            if out is None:
                out, have = power, size
            else:
                m = max(len(x) - have - size + 1, 0)
                out, have = mix(out[:m] * C1 + power[have:have + m]), have + size
        if 2 * size > n:
            return out
        m = max(len(power) - size, 0)
        power, size = mix(power[:m] * C1 + power[size:size + m]), 2 * size


def leftmost_least(x: np.ndarray, n: int) -> np.ndarray:
    """Place of the leftmost least value of every n neighbours."""
    at, size = np.arange(len(x)), 1
    while size < n:
        step = min(size, n - size)
        m = max(len(x) - step, 0)
        left = x[:m] <= x[step:step + m]
        x, at = np.where(left, x[:m], x[step:step + m]), np.where(left, at[:m], at[step:step + m])
        size += step
    return at


def word_hashes(words: list[str]) -> np.ndarray:
    import xxhash
    return mix(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)))


def blocks(x: np.ndarray, doc: np.ndarray, window: int, k: int):
    """Anchors of the windows of hashed words ``x`` of documents ``doc``:
    (anchor hash, place, how far before it the first and the last window start,
    block hash)."""
    if len(x) < window:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none, none, none.view(np.uint64)
    anchor, whole = grams(x, k), grams(x, window)
    own = leftmost_least(anchor, window - k + 1)
    valid = doc[:len(own)] == doc[window - 1:window - 1 + len(own)]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(own)) - 1
    first, last = first[valid[first]], last[valid[first]]
    place = own[first]
    run = np.append(np.uint64(0), np.cumsum(mix(whole * C1)))
    far, near = place - first, place - last          # both 0 to window - k
    edges = (far * 64 + near).astype(np.uint64)
    return anchor[place], place, far, near, mix((run[last + 1] - run[first]) * C1 + mix(edges * C1 + C2))


def _pieces(texts: list[str]) -> Iterator[tuple[int, list[list[str]]]]:
    """The texts' words, some at once."""
    held, size, first = [], 0, 0
    for i, t in enumerate(texts):
        w = re.findall(WORD, t)
        if held and size + len(w) > TOGETHER:
            yield first, held
            held, size, first = [], 0, i
        held.append(w)
        size += len(w)
    if held:
        yield first, held


def _joined(docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    length = np.array([len(w) for w in docs], np.int64)
    start = np.append(0, np.cumsum(length))
    return word_hashes([x for w in docs for x in w]), np.repeat(np.arange(len(docs)), length), start


def _index(window: int, k: int):
    """(d, t, text) -> rows (h, d, t, pack, sig); ``t`` is the text's
    64-bit hash, which tells texts of one id apart, ``pack`` holds the place and
    how far before it windows start."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, t = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for first, docs in _pieces(batch.column(2).to_pylist()):
                x, doc, start = _joined(docs)
                h, place, far, near, sig = blocks(x, doc, window, k)
                of = doc[place] if len(place) else place
                pack = ((place - start[of]) << 12) | (far << 6) | near
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(d[first + of]), pa.array(t[first + of]), pa.array(pack),
                     pa.array(sig.view(np.int64))], names=["h", "d", "t", "pack", "sig"])
    return run


def _open(window: int):
    """(d, t, text, refs array<struct<h, pack>>) -> windows of reference blocks:
    rows (h, w, d, t, start)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            refs = batch.column(3)
            ends = refs.offsets.to_numpy()
            h_all = refs.values.field("h").to_numpy()
            p_all = refs.values.field("pack").to_numpy()
            texts = batch.column(2).to_pylist()
            for i, (d, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                whole = grams(word_hashes(re.findall(WORD, texts[i])), window)
                h, pack = h_all[ends[i]:ends[i + 1]], p_all[ends[i]:ends[i + 1]]
                place = pack >> 12
                first, last = place - ((pack >> 6) & 63), place - (pack & 63)
                n = last - first + 1
                which = np.repeat(np.arange(len(h)), n)
                start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[which]
                offset = (start - place[which] + 64).astype(np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[which]), pa.array(mix(whole[start] * C1 + offset).view(np.int64)),
                     pa.array(np.full(len(start), d)), pa.array(np.full(len(start), t)), pa.array(start)],
                    names=["h", "w", "d", "t", "start"])
    return run


def _digest(window: int, texts_too: bool):
    """(id, text, spans array<struct<first, last>>) -> digests of what is kept."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = re.findall(WORD, text)
                removed = factors = 0
                if spans:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, [s["first"] for s in spans], 1)
                    np.add.at(edge, [s["last"] + window for s in spans], -1)
                    covered = np.cumsum(edge[:-1]) > 0
                    removed = int(covered.sum())
                    factors = int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum())
                    kept = [w for w, c in zip(words, covered.tolist()) if not c]
                else:
                    kept = words
                kept = " ".join(kept)
                out.append((len(words), removed, hashlib.sha256(kept.encode()).hexdigest(), factors, kept))
            cols = list(zip(*out)) or [()] * 5
            arrays = [batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                      pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", "n_factors"]
            if texts_too:
                arrays.append(pa.array(cols[4], pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(arrays, names=names)
    return run


def covered(docs: DataFrame, window: int = WINDOW, k: int = ANCHOR) -> DataFrame:
    """``docs(d, t, text)`` -> (d, t, spans): covered windows of each document,
    first to last start.  Equal rows are one document here."""
    again = stage(docs.groupBy("d", "t").count().where("count > 1").select("d"), "rlz-repeated")
    if not again.isEmpty():
        many, rest = split_by_bitmap(docs, "d", again)       # their texts are reduced map-side
        docs = stage(many.groupBy("d", "t").agg(F.first("text").alias("text")).unionByName(rest), "rlz-documents")
    index = stage(docs.mapInArrow(_index(window, k), "h long, d long, t long, pack long, sig long"), "rlz-index")
    # what is joined back is staged first: both sides are then plain exchanges, which skew joins can split
    shared = stage(index.groupBy("h").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).where("lo < hi").select("h"),
                   "rlz-anchors")
    seen = stage(index.join(shared, "h"), "rlz-shared")
    unstage(index, shared)
    refs = stage(seen.groupBy("h", "sig").agg(F.min("d").alias("ref")), "rlz-refs")
    several = refs.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h", F.lit(True).alias("several"))
    refs = stage(refs.join(stage(several, "rlz-several"), "h", "left"), "rlz-blocks")
    seen = stage(seen.join(refs, ["h", "sig"]).where("d > ref OR several"), "rlz-copies")
    copies = seen.where("d > ref").select("d", "t", *_unpacked(F.col("pack")))
    # factor boundaries: open the reference blocks of anchors that have several
    opened = (seen.where("d = ref").groupBy("d", "t")
              .agg(F.collect_list(F.struct("h", "pack")).alias("refs")))
    opened = stage(opened, "rlz-open")
    named, _ = split_by_bitmap(docs, "d", opened.select("d"))
    windows = stage(named.join(opened, ["d", "t"]).select("d", "t", "text", "refs").mapInArrow(
        _open(window), "h long, w long, d long, t long, start long"), "rlz-windows")
    least = windows.groupBy("h", "w").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).where("lo < hi")
    least = stage(least.select("h", "w", "lo"), "rlz-least")
    more = windows.join(least, ["h", "w"]).where("d > lo").select(
        "d", "t", F.col("start").alias("first"), F.col("start").alias("last"))
    spans = copies.select("d", "t", "first", "last").unionByName(more)
    return spans.groupBy("d", "t").agg(F.collect_list(F.struct("first", "last")).alias("spans"))


def _unpacked(pack: Column) -> list[Column]:
    place = F.shiftright(pack, 12)
    return [(place - F.shiftright(pack, 6).bitwiseAND(F.lit(63))).alias("first"),
            (place - pack.bitwiseAND(F.lit(63))).alias("last")]


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   k: int = ANCHOR, texts_too: bool = False) -> DataFrame:
    """One row per document: id, words, words removed, SHA-256 of the kept
    words joined by a blank, number of factors (and the kept text)."""
    assert k < window <= 64
    text = text_of(col(docs, text_col))
    base = docs.select(col(docs, id_col).alias("doc_id"), text.alias("text"),
                       F.coalesce(col(docs, id_col).cast("long"), F.lit(LAST)).alias("d"),
                       F.xxhash64(text).alias("t"))
    spans = stage(covered(base.select("d", "t", "text"), window, k), "rlz-spans")
    named, rest = split_by_bitmap(base, "d", spans.select("d"))
    kind = base.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, n_factors long"
    schema += ", kept_text string" if texts_too else ""
    none = F.lit(None).cast("array<struct<first:bigint,last:bigint>>").alias("spans")
    return (named.join(spans, ["d", "t"], "left").select("doc_id", "text", "spans")
            .mapInArrow(_digest(window, texts_too), schema)
            .union(rest.select("doc_id", "text", none).mapInArrow(_digest(window, texts_too), schema)))


def op2_relative_lempel_ziv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_copies(table(spark, sf_dir, "documents"))
