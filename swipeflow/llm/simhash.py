"""SimHash near-duplicates by bit-sliced comparison (op 6).

Fingerprints within ``radius`` bits agree wholly in at least one choice of
``blocks - radius`` of ``blocks`` bit blocks; such a choice is a bucket key, so
every pair to link meets in a bucket.  Inside a task the rows lie sorted by
bucket and their bits are stored as 64 vertical planes (bit r of a plane
belongs to row r).  Row r is compared with row r + d for all r at once: planes
are XORed with themselves shifted by d lanes and summed into carry-save bit
counters (ones, twos, overflow); words of 64 lanes in which every lane exceeds
the radius are abandoned.  Lanes already connected need no comparison, so a
task reports a spanning forest, not pairs.

A bucket above ``chunk`` rows is cut into chunks by hash, and each pair of
chunks is a group of its own: no task holds a hot bucket, nothing is dropped.
Equal fingerprints are one row before all this.

Defined results: a text without words has fingerprint zero and is linked like
any other; fewer words than a shingle are one shingle; null texts are empty.
Rows without an id get the smallest id of their component, null if it has
none.  Repeated rows are alike; an empty table gives an empty result; other
columns are not read (or, by :func:`keep_one`, pass through).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LAST, WORD, by_value, col, components, fresh, split_by_bitmap, stage, table, text_of

by_value(__name__)

ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str, k: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the k-word shingles, as a signed integer."""
    import xxhash
    w = re.findall(WORD.encode(), text.encode("utf-8", "replace").lower())  # bytes: lower-cases A-Z only
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(k)))) if len(w) >= k else [b" ".join(w)]
    n = max(len(w) - k + 1, 1)
    h = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):  # bounded memory for very long texts
        bits = np.unpackbits(h[at:at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def _fingerprints(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array([fingerprint(t.as_py(), k) for t in b.column(1)], pa.int64())  # one text at a time
            yield pa.RecordBatch.from_arrays([b.column(0), fp], names=["id", "fp"])
    return run


def fingerprints(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(id, fp) per document."""
    df = docs.select(col(docs, id_col).alias("id"), text_of(col(docs, text_col)).alias("text"))
    return df.mapInArrow(_fingerprints(k), f"id {df.schema['id'].dataType.simpleString()}, fp long")


def planes_of(values: np.ndarray) -> np.ndarray:
    """64 vertical bit planes of 64-bit values; lane r is bit r % 64 of word r // 64."""
    n = len(values)
    bits = np.unpackbits(values.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    words = -(-n // 64) + 2
    out = np.zeros((64, words * 8), np.uint8)
    out[:, :-(-n // 8)] = np.packbits(bits.T, axis=1, bitorder="little")
    return out.view(np.uint64)


def within(planes: np.ndarray, words: np.ndarray, d: int, radius: int, lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words (of ``words``) and their lane masks for which row r and row r + d
    differ in at most ``radius`` (below 4) bits; ``lanes`` masks what is asked."""
    q, r = divmod(d, 64)
    ones, twos, over = (np.zeros(len(words), np.uint64) for _ in range(3))
    for first in range(0, 64, 8):
        for p in planes[first:first + 8]:
            other = p[words + q]
            if r:
                other = (other >> np.uint64(r)) | (p[words + q + 1] << np.uint64(64 - r))
            x = p[words] ^ other
            carry = ones & x
            ones ^= x
            over |= twos & carry
            twos ^= carry
        live = (lanes & ~over) != 0
        if not live.all():  # abandon words in which every lane asked for exceeds the radius
            words, lanes, ones, twos, over = (a[live] for a in (words, lanes, ones, twos, over))
            if not len(words):
                break
    near = {0: ~ones & ~twos, 1: ~twos, 2: ~(ones & twos), 3: ONES}[radius]
    return words, lanes & near & ~over


def forest(keys: np.ndarray, values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what equal keys and near values connect; ``keys``
    ascending."""
    n, links = len(values), []
    planes, label = planes_of(values), np.arange(n)
    d, rows = 1, np.arange(max(n - 1, 0))
    while len(rows := rows[rows + d < n]):
        rows = rows[keys[rows] == keys[rows + d]]              # buckets with more than d rows
        ask = rows[label[rows] != label[rows + d]]
        if len(ask):
            words, first = np.unique(ask >> 6, return_index=True)
            lanes = np.bitwise_or.reduceat(np.uint64(1) << (ask & 63).astype(np.uint64), first)
            words, hits = within(planes, words, d, radius, lanes)
            word, lane = np.nonzero(np.unpackbits(hits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            at = (words[word] << 6) + lane
            if len(at):
                root = {}

                def find(x):
                    while x in root:
                        x = root[x]
                    return x
                for a, b in zip(at.tolist(), (at + d).tolist()):
                    x, y = find(int(label[a])), find(int(label[b]))
                    if x != y:
                        root[max(x, y)] = min(x, y)
                        links.append((int(values[a]), int(values[b])))
                old = np.fromiter(root, np.int64, len(root))
                to = np.arange(n)
                to[old] = [find(x) for x in old.tolist()]
                label = to[label]
        d += 1
    return links


def _compare(radius: int):
    def links(parts):
        keys = [np.concatenate([p.column(i).to_numpy(zero_copy_only=False) for p in parts]) for i in range(4)]
        fp = np.concatenate([p.column(4).to_numpy(zero_copy_only=False) for p in parts])
        step = np.zeros(len(fp), bool)
        for k in keys:
            step[1:] |= k[1:] != k[:-1]
        out = forest(np.cumsum(step), fp, radius)
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()),
                                           pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:  # sorted by key: hold whole groups, some ten thousand rows at once
            if not b.num_rows:
                continue
            start = 0
            if rows + b.num_rows > 40_000:
                last = [b.column(i)[b.num_rows - 1].as_py() for i in range(4)]
                same = np.ones(b.num_rows, bool)
                for i, v in enumerate(last):
                    same &= b.column(i).to_numpy(zero_copy_only=False) == v
                start = int(np.argmax(same))     # the last group of the batch may go on
                tail = held[-1] if held else None
                if start or (tail is not None and [tail.column(i)[tail.num_rows - 1].as_py() for i in range(4)] != last):
                    yield links(held + ([b.slice(0, start)] if start else []))
                    held, rows = [], 0
            held.append(b.slice(start))
            rows += b.num_rows - start
        if held:
            yield links(held)
    return run


def near_links(distinct: DataFrame, radius: int, blocks: int, chunk: int) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``fp`` that connect all
    that lie within ``radius`` bits."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum(((1 << cuts[i + 1]) - (1 << cuts[i])) for i in chosen)
             for chosen in combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = distinct.select("fp", F.posexplode(F.array(
        *[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed])).alias("c", "key"))
    keyed = stage(keyed, "simhash-keys")
    hot = (keyed.groupBy("c", "key").agg(F.count("*").alias("n")).where(f"n > {chunk}")
           .select("c", "key", F.ceil(F.col("n") / chunk).cast("int").alias("s")))
    hot = stage(hot, "simhash-hot")
    part = F.pmod(F.xxhash64("fp"), F.col("s")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("s") - 1))
    cut = (keyed.join(hot, ["c", "key"], "left").withColumn("s", F.coalesce("s", F.lit(1)))
           .withColumn("p", part).withColumn("o", other)
           .select("c", "key", F.least("p", "o").alias("i"), F.greatest("p", "o").alias("j"), "fp"))
    group = ["c", "key", "i", "j"]
    return cut.repartition(*group).sortWithinPartitions(*group).mapInArrow(_compare(radius), "a long, b long")


def classes(prints: DataFrame, radius: int = 3, blocks: int = 4, chunk: int = 1024) -> DataFrame:
    """``prints(id, fp)`` -> (fp, component): the smallest id of each
    fingerprint's component."""
    if not 0 <= radius <= 3 or radius >= blocks:
        raise ValueError("radius must be 0 to 3 and below the number of blocks")
    distinct = stage(prints.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    links = stage(near_links(distinct.select("fp"), radius, blocks, chunk), "simhash-links")
    roots = components(links)
    joined = distinct.join(roots, distinct.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    joined = stage(joined, "simhash-roots")
    least = stage(joined.groupBy("root").agg(F.min("least").alias("component")), "simhash-least")
    return joined.join(least, "root").select("fp", "component")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3,
                    radius: int = 3, blocks: int = 4, chunk: int = 1024) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component id."""
    prints = stage(fingerprints(docs, id_col, text_col, k), "simhash-prints")
    return prints.join(classes(prints, radius, blocks, chunk), "fp").select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, radius: int = 3,
             blocks: int = 4, chunk: int = 1024) -> DataFrame:
    """The documents with one of each near-duplicate group: that of the
    smallest id, once if its rows repeat.  Documents without an id stay."""
    prints = stage(fingerprints(docs, id_col, text_col, k), "simhash-prints")
    found = prints.join(classes(prints, radius, blocks, chunk), "fp")
    (key,) = fresh(docs, "id_key")
    keyed = docs.withColumn(key, F.coalesce(col(docs, id_col).cast("long"), F.lit(LAST)))
    gone = stage(found.where("id != component").select(F.col("id").cast("long").alias(key)).distinct(), "simhash-gone")
    named, rest = split_by_bitmap(keyed, key, gone)
    kept = named.join(gone, key, "left_anti").select(*keyed.columns).unionByName(rest)
    again = stage(prints.where("id IS NOT NULL").groupBy(F.col("id").cast("long").alias(key)).agg(
        F.count("*").alias("c")).where("c > 1").select(key), "simhash-again")
    if not again.isEmpty():      # ids that repeat: one of their rows stays
        named, rest = split_by_bitmap(kept, key, again)
        once = named.join(again, key, "left_semi").select(*keyed.columns).dropDuplicates([key])
        kept = once.unionByName(named.join(again, key, "left_anti").select(*keyed.columns)).unionByName(rest)
    return kept.drop(key)


def op6_simhash_bit_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
