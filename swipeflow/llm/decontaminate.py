"""Benchmark passages in documents, found by one Aho-Corasick automaton (op 13).

Test items (questions, answers) are normalised: A-Z in lower case, words are
runs of ASCII letters, digits and all characters beyond ASCII.  Every run of
``size`` words of an item text, or the whole text where it has fewer, is a
pattern.  All patterns stand in one automaton over word numbers; each document
is normalised the same way and scanned once.  A word inside any match is hit;
runs of hit words are mapped back to offsets (code points) of the document as
it came.  Documents pass through narrow stages only: nothing is shuffled.

The automaton is broadcast, so its size is bounded: items are measured first and
cut into groups of at most ``capacity`` patterns.  One group is the usual case.
Beyond it, each group has its automaton and its scan, whose findings go with the
staged document to the next group; nothing is dropped.  One item text beyond
the capacity is cut there, neighbouring parts sharing ``size`` - 1 words.

Defined results: null and empty texts have no words and no hits; items without
words have no patterns; items are told apart by id, so rows of one id are one
item; rows without id are one item too, named by the empty string in lists;
repeated documents are judged each; without items nothing is hit; an empty
table gives an empty result; other columns pass through ``find`` and
``decontaminate`` unchanged, new columns get free names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_value, col, fresh, per_process, stage, table, text_of

by_value(__name__)

# --- fixed values -----------------------------------------------------------
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"                   # between words of a lower-cased text, by the contract
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"     # the words before A-Z are lower-cased
# ----------------------------------------------------------------------------
SIZE = 10                # words of a window
CAPACITY = 100_000       # patterns of one automaton; 100 MB at most for windows of ten words
BYTES = 64               # bytes of text that weigh as much as a pattern
UNKNOWN = 0              # number of words that no pattern has
FOUND = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())])))])
KINDS = [pa.int64(), pa.int64(), pa.list_(pa.string()),
         pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))]

# bytes of UTF-8: letters fold, separators are blanks, all other bytes stay (those of
# characters beyond ASCII are above 0x7F, so words of bytes are words of characters)
_FOLD = bytes(b if b > 0x7F or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32
              for b in range(256))


def normal_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def windows(words: list, size: int) -> Iterator[tuple]:
    """Runs of ``size`` words; all of them as one where there are fewer."""
    if words:
        for i in range(max(len(words) - size, 0) + 1):
            yield tuple(words[i:i + size])


class Passages:
    """The automaton over word numbers, with the items of each pattern."""

    def __init__(self, items: list[tuple[str, str]], size: int):
        import ahocorasick
        self.numbers: dict[bytes, int] = {}
        owners: dict[tuple, set] = {}
        for name, text in items:
            numbered = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in normal_words(text)]
            for w in windows(numbered, size):
                owners.setdefault(w, set()).add(name)
        self.auto = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for w, names in owners.items():
            self.auto.add_word(w, (len(w), tuple(sorted(names))))
        self.any = bool(owners)
        if self.any:
            self.auto.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Covered runs [first, end) of words, in order and apart, and the items found."""
        runs: list[tuple[int, int]] = []
        names: set[str] = set()
        if not self.any:
            return runs, names
        number = self.numbers.get
        for last, (n, owners) in self.auto.iter(tuple([number(w, UNKNOWN) for w in words])):
            first, end = last - n + 1, last + 1
            while runs and runs[-1][1] >= first:     # ends rise, so only the latest runs can meet this one
                first = min(first, runs.pop()[0])
            runs.append((first, end))
            names.update(owners)
        return runs, names


def merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, end in sorted(a + b):
        if out and out[-1][1] >= first:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((first, end))
    return out


def offsets(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as offsets [begin, end) in the text as it came."""
    at = [m.span() for m in re.finditer(PLAIN_WORD, text)] if runs else []
    return [(at[first][0], at[end - 1][1]) for first, end in runs]


def _scan(items: list[tuple[str, str]], size: int, key: str, at: int, first: bool, last: bool):
    """Batches with the text in column ``at``.  But for the ``first`` group of
    items, the last four columns hold what earlier groups found, spans as runs
    of words; the ``last`` group turns them into offsets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = per_process("passages", dict)
        if key not in held:
            held.clear()                        # one automaton at a time
            held[key] = Passages(items, size)
        found = held[key]
        for batch in batches:
            own = batch.columns if first else batch.columns[:-4]
            before = [] if first else list(zip(batch.column(len(own) + 2).to_pylist(), batch.column(len(own) + 3).to_pylist()))
            n_words, n_hit, names, spans = [], [], [], []
            for i, cell in enumerate(batch.column(at)):
                text = cell.as_py() or ""
                words = normal_words(text)
                runs, who = found.scan(words)
                if not first:
                    runs, who = merged(runs, [(s["begin"], s["end"]) for s in before[i][1]]), who.union(before[i][0])
                n_words.append(len(words))
                n_hit.append(sum(e - s for s, e in runs))
                names.append(sorted(who))
                spans.append([{"begin": s, "end": e} for s, e in (offsets(text, runs) if last else runs)])
            new = [pa.array(v, k) for v, k in zip((n_words, n_hit, names, spans), KINDS)]
            yield pa.RecordBatch.from_arrays([*own, *new], names=[*batch.schema.names[:len(own)], *FOUND.fieldNames()])
    return run


def item_groups(benchmark: DataFrame, id_col: str, text_cols: tuple[str, ...], size: int, capacity: int) -> list[DataFrame]:
    """Item texts (name, text) in groups of at most ``capacity`` patterns (long
    texts of few words weigh by their bytes).  Only the weight of each hash
    bucket reaches the driver; where one is above the capacity, the texts are
    dealt out over more buckets first."""
    name = F.coalesce(col(benchmark, id_col).cast("string"), F.lit(""))
    texts = benchmark.select(name.alias("name"), F.explode(F.array(*[text_of(col(benchmark, c)) for c in text_cols])).alias("text"))
    words = F.filter(F.split(F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
                             BETWEEN), lambda w: w != "")
    # a text beyond the capacity becomes parts that share size - 1 words
    texts = texts.select("name", words.alias("w")).where(F.size("w") > 0).select(
        "name", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)), F.lit(capacity))).alias("from"))
    part = F.slice("w", F.col("from") + 1, F.lit(capacity + size - 1))
    texts = texts.select("name", F.array_join(part, " ").alias("text"), F.size(part).alias("n")).distinct()
    texts = stage(texts.withColumn("n", F.greatest(F.col("n") - size + 1, (F.octet_length("text") / BYTES).cast("int"), F.lit(1))),
                  "benchmark-texts")
    total = texts.agg(F.sum("n")).first()[0] or 0
    if total <= capacity:
        return [texts.select("name", "text")]
    buckets = 2 * (total // capacity + 1)
    while True:
        bucket = F.pmod(F.xxhash64("name", "text"), F.lit(buckets))
        sizes = texts.groupBy(bucket.alias("b")).agg(F.sum("n").alias("n"), F.count("*").alias("k")).orderBy("b").collect()
        if all(r["n"] <= capacity or r["k"] == 1 for r in sizes):
            break
        buckets *= 2
    groups: list[list] = [[]]
    held = 0
    for r in sizes:
        if held and held + r["n"] > capacity:
            groups.append([])
            held = 0
        groups[-1].append(r["b"])
        held += r["n"]
    return [texts.where(bucket.isin(g)).select("name", "text") for g in groups]


def find(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id",
         item_texts: tuple[str, ...] = ("text",), size: int = SIZE, capacity: int = CAPACITY) -> tuple[DataFrame, list[str]]:
    """``docs`` with four more columns, whose names are returned: number of
    words, of hit words, names of the items found in order of their strings,
    and the spans that matches cover, as offsets in the text."""
    if size < 1 or capacity < 1:
        raise ValueError("size and capacity must be at least 1")
    names = fresh(docs, "n_words", "n_hit", "items", "spans")
    out = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])     # any name is safe to write and to read back
    at, schema = docs.columns.index(text_col), T.StructType([*out.schema.fields, *FOUND.fields])
    groups = item_groups(benchmark, item_id, tuple(item_texts), size, capacity)
    for i, group in enumerate(groups):
        items = sorted(tuple(r) for r in group.collect())      # at most ``capacity`` patterns
        key = hashlib.sha256(repr((size, items)).encode("utf-8", "surrogatepass")).hexdigest()
        if i:
            out = stage(out, "scanned")
        out = out.mapInArrow(_scan(items, size, key, at, i == 0, i == len(groups) - 1), schema)
    return out.toDF(*docs.columns, *names), names


def decontaminate(docs: DataFrame, benchmark: DataFrame, max_hit: float = 0.0, **options) -> DataFrame:
    """``docs`` without those of whose words more than the share ``max_hit`` is hit."""
    out, (n_words, n_hit, _, _) = find(docs, benchmark, **options)
    return out.where(F.col(n_hit) <= max_hit * F.col(n_words)).select(*[col(out, c) for c in docs.columns])


def without_passages(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", mark: str = " ", **options) -> DataFrame:
    """``docs`` whose matched spans are each replaced by ``mark``."""
    out, (_, _, _, spans) = find(docs, benchmark, text_col=text_col, **options)
    text = col(out, text_col)
    ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    starts = F.concat(F.transform(spans, lambda s: s["begin"]), F.array(F.length(text)))
    kept = F.array_join(F.zip_with(ends, starts, lambda a, b: F.substr(text, a + 1, b - a)), mark)
    clean = F.when(F.size(spans) > 0, kept).otherwise(text)
    return out.select(*[(clean.alias(c) if c == text_col else col(out, c)) for c in docs.columns])


def item_digest(items: Column) -> Column:
    return F.sha2(F.array_join(items, ","), 256)


def op13_aho_corasick_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, _ = find(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      item_digest(F.col("items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP13_SQL = r"""
WITH d AS (
    SELECT doc_id, text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
    SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
pattern AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS n, w[i:i + 9] AS p
    FROM b, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS g(i) WHERE len(w) > 0),
place AS (
    SELECT doc_id, n.n, i, w[i:i + n.n - 1] AS p
    FROM d, (SELECT DISTINCT n FROM pattern) AS n, unnest(generate_series(1, len(w) - n.n + 1)) AS g(i)),
found AS (SELECT doc_id, item_id, i, n FROM place JOIN pattern USING (n, p)),
hit AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM found, unnest(generate_series(i, i + n - 1)) AS g(word) GROUP BY doc_id),
item AS (SELECT doc_id, list_sort(list(DISTINCT item_id)) AS items FROM found GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN item USING (doc_id)
"""
