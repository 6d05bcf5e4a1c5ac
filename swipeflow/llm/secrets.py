"""Secret scan (op 7): fixed patterns, plus sliding-window Shannon entropy.

Patterns give the base spans.  The method adds spans: candidate strings of one
character class (hex, base64) are read through a window of fixed length; the
counts of the characters in it are kept up by one in, one out, so each step
costs the same whatever the window; a candidate whose best window reaches the
class's entropy is a secret unless the allow-list suppresses it (UUIDs,
checksums that say so, runs of the alphabet, placeholders).

Everything is built-in expressions on one row: one scan, no shuffle, no Python.
Offsets are code points, ends exclusive.  They come from the gaps between
matches (``split``) and the matches themselves, which alternate.

Defined results: null and empty texts have no spans; repeated rows are scanned
each; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, fresh, let, table, text_of

# --- fixed values -----------------------------------------------------------
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
          r"""([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]{14,}"                    # the longest run, of 18 characters or more
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"              # whole runs of 16 or more
ASSIGN_LEAST = 12
# class: pattern of a candidate, what it must hold, alphabet, window, least entropy in bits
CLASSES = {
    "hex": (r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{20,}", r"(?=.*[0-9])(?=.*[A-Fa-f])",
            "0123456789abcdef", 20, 3.0),
    "base64": (r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}", r"(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])",
               "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_", 24, 3.9),
}
ALLOWED = [
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",        # UUID
    r"^(md5|sha1|sha224|sha256|sha384|sha512)[-_]",                # a checksum that says so
    r"(?i)example|sample|placeholder|changeme|dummy|xxxx",
    r"(?i)abcdefgh|ijklmnop|qrstuvwx|01234567|12345678|87654321",  # runs of the alphabet or of digits
]
# ----------------------------------------------------------------------------


def located(text: Column, regex: str, group: int = 0) -> Column:
    """All leftmost non-overlapping matches: array of (start, end, value)."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")

    def walk(x):
        def step(state, i):
            start = state["pos"] + F.length(F.get(x["gaps"], i))
            end = start + F.length(F.get(x["whole"], i))
            found = F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"),
                             F.get(x["value"], i).alias("value"))
            return F.struct(end.cast("long").alias("pos"), F.concat(state["out"], F.array(found)).alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(x["whole"]) - 1),
                           F.struct(F.lit(0).cast("long").alias("pos"), empty.alias("out")), step, lambda s: s["out"])
    parts = F.struct(F.split(text, regex, -1).alias("gaps"),
                     F.regexp_extract_all(text, F.lit(regex), F.lit(0)).alias("whole"),
                     F.regexp_extract_all(text, F.lit(regex), F.lit(group)).alias("value"))
    return F.when(text.rlike(regex), let(parts, walk)).otherwise(empty)


def best_entropy(candidate: Column, alphabet: str, window: int) -> Column:
    """Largest Shannon entropy, in bits, of any window of ``candidate``."""
    weigh = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(window + 2)])  # n log2 n

    def code(i):
        return F.instr(F.lit(alphabet), F.substr(candidate, i, F.lit(1))) - 1

    def step(state, i):
        def moved(inout):
            a, b, counts = inout["a"], inout["b"], state["counts"]
            into = F.get(counts, a)                       # the newest character comes in
            out = F.get(counts, b) + F.when(a == b, 1).otherwise(0)
            gain = F.get(weigh, into + 1) - F.get(weigh, into)
            loss = F.when(b >= 0, F.get(weigh, out) - F.get(weigh, out - 1)).otherwise(0.0)
            total = state["total"] + gain - loss
            least = F.when(i >= window, F.least(state["least"], total)).otherwise(state["least"])
            now = F.transform(counts, lambda n, k: n + (k == a).cast("int") - (k == b).cast("int"))
            return F.struct(now.alias("counts"), total.alias("total"), least.alias("least"))
        return let(F.struct(code(i).alias("a"), F.when(i > window, code(i - window)).otherwise(-1).alias("b")), moved)
    start = F.struct(F.array_repeat(F.lit(0), len(alphabet)).alias("counts"), F.lit(0.0).alias("total"),
                     F.lit(1e9).alias("least"))
    least = F.aggregate(F.sequence(F.lit(1), F.length(candidate)), start, step, lambda s: s["least"])
    return F.lit(math.log2(window)) - least / window


def entropy_spans(text: Column, allowed: list[str] = ALLOWED) -> Column:
    """Candidates of any class that reach its entropy and are not allowed."""
    def of(name: str) -> Column:
        regex, must, alphabet, window, least = CLASSES[name]

        def secret(x):
            value = F.lower(x["value"]) if name == "hex" else x["value"]
            ok = x["value"].rlike(must)
            for a in allowed:
                ok = ok & ~x["value"].rlike(a)
            return ok & (best_entropy(value, alphabet, window) >= least)
        return F.filter(located(text, regex), secret)
    return F.concat(*map(of, CLASSES))


def spans(text: Column) -> Column:
    """All spans of a text: array of (start, kind number, end), ascending.  A
    candidate inside a pattern's span, or found under both classes, counts once."""
    def kind(k: int, found: Column) -> Column:
        return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end")))
    assign = F.filter(located(text, ASSIGN, 2), lambda x: F.length(x["value"]) >= ASSIGN_LEAST)
    base = F.concat(kind(0, assign), kind(1, located(text, ACCESS)), kind(2, located(text, HEX)))

    def merged(b):
        extra = F.filter(kind(3, entropy_spans(text)), lambda e: ~F.exists(
            b, lambda x: (x["start"] <= e["start"]) & (e["end"] <= x["end"])))
        return F.sort_array(F.concat(b, F.array_distinct(extra)))
    return let(base, merged)


def _joined(found: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["start"], x["end"])), ",")


def scan(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with one more column, the array of spans; its name."""
    (name,) = fresh(docs, "secret_spans")
    return docs.withColumn(name, spans(text_of(col(docs, text_col)))), name


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """The documents with every span replaced by ``mark``; spans that overlap
    are replaced as one."""
    out, name = scan(docs, text_col)

    def cut(x):
        def step(s, y):
            return F.struct(F.when(y["start"] >= s["pos"], F.concat(
                s["out"], F.substr(x["t"], (s["pos"] + 1).cast("int"), (y["start"] - s["pos"]).cast("int")), F.lit(mark)))
                .otherwise(s["out"]).alias("out"), F.greatest(s["pos"], y["end"]).alias("pos"))
        return F.aggregate(x["s"], F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("pos")), step,
                           lambda s: F.concat(s["out"], F.substr(x["t"], (s["pos"] + 1).cast("int"))))
    text = col(out, text_col)
    done = F.when(F.size(name) > 0, let(F.struct(text.alias("t"), F.col(name).alias("s")), cut)).otherwise(text)
    return out.withColumn(text_col, done).drop(name)


def op7_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, name = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def digest(s):
        base = F.filter(s, lambda x: x["kind"] < 3)
        count = [F.size(F.filter(s, lambda x: x["kind"] == 0)), F.size(F.filter(s, lambda x: x["kind"] == 1)),
                 F.size(F.filter(s, lambda x: x["kind"] == 2))]
        return F.struct(*[c.cast("long").alias(f"n_{k}") for c, k in zip(count, KINDS)],
                        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(s).alias("spans"))
    return out.select("doc_id", let(F.col(name), digest).alias("d")).select("doc_id", "d.*")
