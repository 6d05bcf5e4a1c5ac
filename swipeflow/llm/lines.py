"""Line de-duplication with a suffix array over line-ID sequences (op 3).

Every document is the sequence of its lines that hold a word.  The suffixes of
all sequences are ranked by prefix doubling: the rank of the first line, then of
the first 2, 4, 8, ... lines as the rank of a pair of ranks.  Suffixes of equal
rank after k doublings are an interval of the suffix array whose longest common
prefix is at least 2^k lines; their rank is the interval's left border.  A
suffix alone in its interval has its place and leaves the doubling, so a round
costs what still repeats.  Rounds end when nothing repeats.

A run of ``min_lines`` lines or more that also begins earlier (smaller id, then
earlier in the document) is a later copy: its lines are deleted, the first copy
stays.  So is, with ``min_words``, a single line of that many words or more, as a
passage or a whole document may stand on one line; only short lines that repeat
by themselves stay.  Maximal runs need no list of their own: they are the union of their
windows of ``min_lines``, which is one interval level of the suffix array, and of
long lines, which are its first level.

Ranks come from distinct pairs only, counted with partial aggregation and put in
order by range partitions, and go back by joins that split skewed keys; a line
that a third of all documents share is one key with a count.  Lines travel as
128-bit hashes; texts are shuffled only for documents that lose lines.

Defined results: blank lines are no part of runs and stay; null and empty texts
have no lines and stay as they are; a null id counts as larger than every id;
rows that repeat id and text are one document to the operator and both lose the
same lines; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LAST, col, fresh, let, n_words, prefix_sum, split_by_bitmap, stage, table, text_of, unstage

MIN_LINES = 2
MIN_WORDS = 20                   # of a single line; shorter documents fail the quality rules anyway
POS = ["d", "t", "n"]


def _ranked(rows: DataFrame, key: list[str], also: tuple = ()) -> DataFrame | None:
    """Rows of keys that repeat, with ``rank`` (left border of the key's interval
    in key order) and ``first`` (the earliest place); None if no key repeats."""
    keys = rows.groupBy(*key).agg(F.count("*").alias("c"), F.min(F.struct(*POS)).alias("first")).where("c > 1")
    keys = stage(keys, "line-keys")
    if keys.isEmpty():
        return None
    keys = prefix_sum(keys, key, "c", "rank")
    out = stage(rows.join(keys.drop("c"), key).select(*POS, "rank", "first", *also), "line-ranks")
    unstage(keys)
    return out


def _pairs(ranked: DataFrame, shift: int) -> DataFrame:
    """Places with their own rank and that of the suffix ``shift`` lines on."""
    on = ranked.select("d", "t", (F.col("n") - shift).alias("n"), F.col("rank").alias("r2"))
    return ranked.select(*POS, F.col("rank").alias("r1")).join(on, POS)


def doubled(lines: DataFrame, min_lines: int, longest: bool = True) -> tuple[DataFrame, int] | None:
    """``lines(d, t, n, h1, h2, long)`` -> suffixes that repeat an earlier run of
    ``min_lines`` lines, or an earlier long line (d, t, n), with the largest power
    of two they repeat (1: the long line); and the number of rounds.  Without
    ``longest`` rounds end at ``min_lines``, the level that decides what goes."""
    level = _ranked(lines, ["h1", "h2"], ("long",))
    size, rounds, copies = 1, 0, []
    if level is not None:
        copies.append(_later(level.where("long"), 1))
    while level is not None:
        if size <= min_lines < 2 * size:
            runs = level if size == min_lines else _ranked(_pairs(level, min_lines - size), ["r1", "r2"])
            if runs is None:
                break
            copies.append(_later(runs, min_lines))
            if not longest:
                break
        elif size > min_lines:
            copies.append(_later(level, size))
        level, size, rounds = _ranked(_pairs(level, size), ["r1", "r2"]), 2 * size, rounds + 1
    if not copies:
        return None
    every = copies[0]
    for c in copies[1:]:
        every = every.unionByName(c)
    return every.groupBy(*POS).agg(F.max("size").alias("size")), rounds


def _later(ranked: DataFrame, size: int) -> DataFrame:
    return ranked.where(F.struct(*POS) != F.col("first")).select(*POS, F.lit(size).alias("size"))


def _lines(text: Column) -> Column:
    """Lines with a word: array of (place in the text, line)."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("x"))),
                    lambda s: s["x"].rlike(r"[^\x20\x09-\x0D]"))


def _long(line: Column, min_words: int | None) -> Column:
    if min_words is None:
        return F.lit(False)
    return F.when(F.length(line) >= 2 * min_words - 1, n_words(line) >= min_words).otherwise(False)


def marked(docs: DataFrame, id_col: str, text_col: str, min_lines: int,
           min_words: int | None = None, longest: bool = True) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the places of the lines to delete (null: none) and the
    longest repeated run known, a power of two (without ``longest`` at most
    ``min_lines``); and their names."""
    if min_lines < 1:
        raise ValueError("min_lines must be at least 1")
    names = ["d", "t", "gone", "longest"]
    own = dict(zip(names, fresh(docs, *names)))
    text = text_of(col(docs, text_col))
    based = docs.withColumns({own["d"]: F.coalesce(col(docs, id_col).cast("long"), F.lit(LAST)),
                              own["t"]: F.xxhash64(text)})
    lines = (based.select(F.col(own["d"]).alias("d"), F.col(own["t"]).alias("t"), F.posexplode(_lines(text)).alias("n", "s"))
             .select("d", "t", "n", F.xxhash64("s.x").alias("h1"), F.xxhash64(F.lit(1), "s.x").alias("h2"),
                     _long(F.col("s.x"), min_words).alias("long")))
    found = doubled(stage(lines.distinct(), "lines"), min_lines, longest)
    if found is None:
        return based.withColumns({own["gone"]: F.lit(None).cast("array<int>"), own["longest"]: F.lit(0)}), own
    gone = stage(found[0].groupBy("d", "t").agg(
        F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("n"), F.col("n") + F.least("size", F.lit(min_lines)) - 1)))).alias("ns"),
        F.max("size").alias("longest")), "line-copies")
    named, rest = split_by_bitmap(based, own["d"], gone.select("d"))
    hit = named.join(gone.select(F.col("d").alias(own["d"]), F.col("t").alias(own["t"]), F.col("ns").alias(own["gone"]),
                                 F.col("longest").alias(own["longest"])), [own["d"], own["t"]], "left")
    # from ordinals among lines with a word to places in the text
    hit = hit.withColumn(own["gone"], let(F.struct(_lines(text_of(col(hit, text_col))).alias("l"), F.col(own["gone"]).alias("g")),
                                          lambda x: F.transform(x["g"], lambda n: F.get(x["l"], n)["i"])))
    rest = rest.withColumns({own["gone"]: F.lit(None).cast("array<int>"), own["longest"]: F.lit(0)})
    return hit.unionByName(rest), own


def _without(text: Column, gone: Column) -> Column:
    def kept(x):
        places = F.array_except(F.sequence(F.lit(0), F.size(x["l"]) - 1), x["g"])
        return F.array_join(F.transform(places, lambda i: F.get(x["l"], i)), "\n")
    return F.when(gone.isNull(), text).otherwise(let(F.struct(F.split(text, "\n").alias("l"), gone.alias("g")), kept))


def without_later_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         min_lines: int = MIN_LINES, min_words: int | None = None) -> DataFrame:
    """The documents without the lines of later copies, own columns only.  What
    goes is decided at the level of ``min_lines``, so doubling ends there."""
    out, own = marked(docs, id_col, text_col, min_lines, min_words, longest=False)
    done = out.withColumn(text_col, _without(col(out, text_col), F.col(own["gone"])))
    return done.select(*[col(done, c) for c in docs.columns])


def op3_line_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, lines removed, SHA-256 of the kept text, longest
    run (as a power of two) that repeats an earlier one."""
    out, own = marked(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", MIN_LINES, MIN_WORDS)
    text, gone = text_of(F.col("text")), F.col(own["gone"])
    return out.select("doc_id", F.when(text == "", 0).otherwise(F.size(F.split(text, "\n"))).cast("long").alias("n_lines"),
                      F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"),
                      F.sha2(_without(text, gone), 256).alias("kept_sha256"),
                      F.coalesce(own["longest"], F.lit(0)).cast("long").alias("longest_run"))
