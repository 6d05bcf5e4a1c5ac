"""Quality rule: distribution divergence from language references (op 1).

A document's character-class histogram and its common-word histogram are
compared with the histograms of its language by Jensen-Shannon distance
(square root of the divergence, base 2, so 0..1).  The references are summed
over all documents of the language given, one row per language, and joined back
to the documents (broadcast if Spark's size check allows it).  Documents shorter
than the guards get no divergence verdict.

Everything is built-in expressions: one scan, no shuffle of texts.

Defined results: a null or empty text has zero words and fails the base rules;
a language is its tag in lower case without region (``en-US`` is ``en``, a script
as in ``sr-Latn`` stays); one without a list of common words is compared on
characters only; a null or blank language gets no divergence verdict; a
reference with fewer than ``min_reference`` characters or common words gives
none.  Repeated rows are scored each by themselves;
an empty table gives an empty result.  Other columns pass through; names that
clash are avoided with :func:`common.fresh`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, fresh, let, stage, table, text_of, words

# --- fixed values: function words by language -------------------------------
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "with", "as", "be", "by",
           "are", "this", "at", "from"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "sich", "mit", "des", "auf", "für", "ist", "im",
           "nicht", "dem", "ein", "eine", "als"],
    "fr": ["de", "la", "le", "et", "les", "en", "des", "un", "du", "une", "que", "est", "pour", "par", "dans",
           "avec", "qui", "pas", "sur", "au"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "las", "se", "del", "un", "por", "con", "no", "una", "su",
           "para", "es", "al", "lo"],
}
# character classes counted by pattern; blanks are counted by their absence from
# the words, and what is left is letters in lower or no case
CLASSES = {"upper": r"\p{Lu}", "digit": r"\p{Nd}", "mark": r"[.,;:?'’\-]",
           "symbol": r"[\p{P}\p{S}&&[^.,;:?'’\-]]"}
N_CLASSES = len(CLASSES) + 2
N_WORD_BINS = max(map(len, COMMON_WORDS.values())) + 1
SYMBOLS = r"[#*$%&|<>]"
# ----------------------------------------------------------------------------


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 20            # base rule
    repeat_window: int = 8         # words in a repeated window
    max_repeat_pct: int = 30       # base rule
    min_chars: int = 200           # guard: shorter texts get no character verdict
    min_common_of: int = 60        # guard: texts of fewer words get no common-word verdict
    min_reference: int = 1000      # guard on the reference's own size
    max_char_distance: float = 0.26
    max_word_distance: float = 0.315


def _count(text: Column, chars: str) -> Column:
    """Characters of ``text`` that match the class ``chars``."""
    return F.regexp_count(text, F.lit(chars)).cast("long")


def char_histogram(text: Column, word_chars: Column) -> Column:
    """Counts by character class: CLASSES, blanks, all others."""
    blank = F.length(text).cast("long") - word_chars
    return let(F.array(*[_count(text, c) for c in CLASSES.values()], blank),
               lambda h: F.concat(h, F.array(F.length(text).cast("long") - _total(h))))


def word_histogram(words: Column, lang: Column) -> Column:
    """Counts of the language's common words, in lower or upper case or
    capitalised, then of all other words; empty for an unknown language."""
    def counts(vocabulary: list[str]) -> Column:
        cased = [f(x) for f in (str.lower, str.upper, str.capitalize) for x in vocabulary]
        hits = F.transform(F.filter(words, lambda w: w.isin(cased)), F.lower)
        return let(hits, lambda found: F.concat(F.transform(
            F.array(*map(F.lit, vocabulary)),
            lambda x: F.size(F.filter(found, lambda h: h == x)).cast("long")),
            F.array((F.size(words) - F.size(found)).cast("long"))))

    out = F.array().cast("array<long>")
    for code, vocabulary in COMMON_WORDS.items():
        out = F.when(lang == code, counts(vocabulary)).otherwise(out)
    return out


def repeat_words(words: Column, k: int) -> Column:
    """Words inside k-word windows that occur twice or more, first included.

    Windows are named by a 64-bit hash built from pairs (1, 2, 4, 8 words);
    windows of one name are held against each other word by word, then the
    positions of repeated windows are merged as intervals.  Texts without any
    repeat stop after the distinct count."""
    assert k & (k - 1) == 0, "a power of two"

    def paired(names, step):
        n = F.size(names) - step
        return F.zip_with(F.slice(names, F.lit(1), n), F.slice(names, F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b))

    def windows(names, step=1):
        return names if step == k else let(names, lambda h: windows(paired(h, step), 2 * step))

    def merged(w, names):
        pairs = F.sort_array(F.transform(names, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def same(a, b):
            return F.coalesce((a["h"] == b["h"]) & (F.slice(w, a["i"] + 1, k) == F.slice(w, b["i"] + 1, k)),
                              F.lit(False))
        starts = let(pairs, lambda p: F.sort_array(F.transform(F.filter(
            p, lambda x, j: same(x, F.get(p, j - 1)) | same(x, F.get(p, j + 1))), lambda x: x["i"])))
        return let(starts, lambda s: _total(F.transform(s, lambda x, j: F.when(j == 0, F.lit(k)).otherwise(
            F.least(F.lit(k), x - F.get(s, j - 1))).cast("long"))))

    return F.when(F.size(words) <= k, F.lit(0).cast("long")).otherwise(
        let(windows(F.transform(words, lambda x: F.xxhash64(x))), lambda n: F.when(
            F.size(F.array_distinct(n)) == F.size(n), F.lit(0).cast("long")).otherwise(merged(words, n))))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def base_metrics(text: Column, lang: Column, rules: QualityRules) -> Column:
    """Struct of the base counts and both histograms of one text."""
    def of(w):
        return let(_word_chars(w), lambda n: F.struct(
            F.size(w).cast("long").alias("n_words"), n.alias("word_chars"),
            _count(text, SYMBOLS).alias("n_symbols"),
            let(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
                lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            repeat_words(w, rules.repeat_window).alias("n_repeat_words"),
            char_histogram(text, n).alias("chars"),
            word_histogram(w, lang).alias("common")))
    return let(words(text), of)


def _word_chars(words: Column) -> Column:
    return F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.length(w))


def histograms(text: Column, lang: Column) -> Column:
    return let(words(text), lambda w: F.struct(
        let(_word_chars(w), lambda n: char_histogram(text, n)).alias("chars"),
        word_histogram(w, lang).alias("common")))


def _word_chars(words: Column) -> Column:
    return F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.length(w))


def language(lang: Column) -> Column:
    """Language and script of a tag in lower case; null if there is none."""
    tag = F.translate(F.lower(F.trim(lang.cast("string"))), "_", "-")
    part = F.regexp_extract(tag, r"^([a-z]{2,3}(?:-[a-z]{4})?)(?:-|$)", 1)
    return F.when(part != "", part).when(tag != "", tag)


def references(scored: DataFrame, lang: str, hist: str, out: list[str], rules: QualityRules) -> DataFrame:
    """Summed histograms by language over all rows, as shares, in the columns
    ``out`` (language, characters, common words); null below ``min_reference``."""
    def sums(part, n):
        return F.array(*[F.coalesce(F.sum(F.get(F.col(hist)[part], F.lit(i))), F.lit(0)) for i in range(n)])

    def shares(h):
        return let(h, lambda x: let(_total(x), lambda n: F.when(
            n >= rules.min_reference, F.transform(x, lambda v: v.cast("double") / n))))
    summed = scored.where(F.col(lang).isNotNull()).groupBy(F.col(lang).alias(out[0])).agg(
        sums("chars", N_CLASSES).alias("c"), sums("common", N_WORD_BINS).alias("w"))
    return stage(summed.select(out[0], shares(F.col("c")).alias(out[1]), shares(F.col("w")).alias(out[2])), "references")


def js_distance(counts: Column, reference: Column | list[int]) -> Column:
    """Jensen-Shannon distance of a histogram from a reference (shares, or a
    list of counts), base 2."""
    q = reference if isinstance(reference, Column) else F.array(*[F.lit(x / sum(reference)) for x in reference])

    def part(p, m):
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)

    def of(n):
        terms = F.zip_with(counts, q, lambda c, y: let(c / n, lambda x: part(x, (x + y) / 2) + part(y, (x + y) / 2)))
        return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))
    return let(_total(counts).cast("double"), of)


def distances(hist: Column, chars: Column, common: Column, rules: QualityRules) -> tuple[Column, Column]:
    """Character and common-word distance from the references, null where a guard holds."""
    return (F.when(chars.isNotNull() & (_total(hist["chars"]) >= rules.min_chars), js_distance(hist["chars"], chars)),
            F.when(common.isNotNull() & (_total(hist["common"]) >= rules.min_common_of),
                   js_distance(hist["common"], F.slice(common, 1, F.size(hist["common"])))))


def base_failed(m: Column, rules: QualityRules) -> Column:
    return (m["n_words"] < rules.min_words) | (100 * m["n_repeat_words"] > rules.max_repeat_pct * m["n_words"])


def diverges(chars: Column, words: Column, rules: QualityRules) -> Column:
    return (F.coalesce(chars > rules.max_char_distance, F.lit(False))
            | F.coalesce(words > rules.max_word_distance, F.lit(False)))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          rules: QualityRules = QualityRules()) -> DataFrame:
    """One row per document: id, base counts, ``base_failed``, both distances
    and ``kept``.  The counts are staged once (no text in them), the references
    are summed from them."""
    lang = language(col(docs, lang_col))
    text = text_of(col(docs, text_col))
    counted = docs.select(col(docs, id_col).alias("doc_id"), lang.alias("l"),
                          base_metrics(text, lang, rules).alias("m"))
    counted = stage(counted, "quality")
    refs = references(counted, "l", "m", ["l", "q_chars", "q_common"], rules)
    m, (chars, words) = F.col("m"), distances(F.col("m"), F.col("q_chars"), F.col("q_common"), rules)
    out = counted.join(refs, "l", "left").select("doc_id", *[m[c].alias(c) for c in
                                     ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
                         base_failed(m, rules).alias("base_failed"),
                         chars.alias("char_distance"), words.alias("word_distance"))
    return out.withColumn("kept", ~F.col("base_failed") & ~diverges(F.col("char_distance"), F.col("word_distance"), rules))


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
              rules: QualityRules = QualityRules()) -> DataFrame:
    """The documents that pass, with their own columns.  Two scans: one sums
    the references, one filters; no text is shuffled."""
    l, h, r, qc, qw = fresh(docs, "q_lang", "q_hist", "q_ref", "q_chars", "q_common")
    text, lang = text_of(col(docs, text_col)), language(col(docs, lang_col))
    refs = references(docs.select(lang.alias(l), histograms(text, lang).alias(h)), l, h,
                      [r, qc, qw], rules)

    def verdict(m):
        chars, words = distances(m, F.col(qc), F.col(qw), rules)
        return base_failed(m, rules) | diverges(chars, words, rules)
    own = [col(docs, c) for c in docs.columns]
    return docs.join(refs, lang == F.col(r), "left").where(~let(base_metrics(text, lang, rules), verdict)).select(*own)


def op1_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
