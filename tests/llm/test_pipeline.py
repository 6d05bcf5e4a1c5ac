"""The pipeline, stage by stage against plain Python, then as a whole."""
import unicodedata

import pytest
from brute import WORD, base_counts, by_text, js_distance, lines, near_duplicates
from test_text_operators import documents

import corpus_pipeline as P
from swipeflow.llm import quality as Q
from swipeflow.llm.mixing import WEIGHTS
from swipeflow.llm.pieces import model_path
from swipeflow.session import work_path


def histograms(text, lang):
    words, marks = WORD.findall(text), ".,;:?'’-"
    kind = [unicodedata.category(c) for c in text]
    n = [sum(k == "Lu" for k in kind), sum(k == "Nd" for k in kind), sum(c in marks for c in text),
         sum(k[0] in "PS" and c not in marks for c, k in zip(text, kind)), len(text) - sum(map(len, words))]
    common = Q.COMMON_WORDS.get(lang, [])
    hits = [w.lower() for w in words if w in {f(x) for x in common for f in (str.lower, str.upper, str.capitalize)}]
    return [*n, len(text) - sum(n)], [hits.count(x) for x in common] + [len(words) - len(hits)] if common else []


def good(rows):
    rules, refs, hist = Q.QualityRules(), {}, []
    for _, text, lang, *_ in rows:
        lang = lang if lang in Q.COMMON_WORDS else ""
        hist.append((lang, *histograms(text or "", lang)))
        c, w = refs.setdefault(lang, ([0] * 6, [0] * 21))
        for total, part in ((c, hist[-1][1]), (w, hist[-1][2])):
            for i, x in enumerate(part):
                total[i] += x
    for row, (lang, c, w) in zip(rows, hist):
        n, _, _, _, repeat = base_counts(row[1])
        far = sum(refs[lang][0]) >= rules.min_reference and sum(c) >= rules.min_chars \
            and js_distance(c, refs[lang][0]) > rules.max_char_distance
        odd = lang and sum(refs[lang][1]) >= rules.min_reference and sum(w) >= rules.min_common_of \
            and js_distance(w, refs[lang][1]) > rules.max_word_distance
        if n >= 20 and 100 * repeat <= 30 * n and not far and not odd:
            yield row


@pytest.fixture(scope="module")
def sf_dir(spark):
    rows = [(i, t, lang, src, len(t or "")) for i, t, lang, src in documents(seed=21, n=90)]
    path = work_path(spark, "pipeline")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long") \
        .repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def test_stages(spark, sf_dir):
    assert [n for n, _ in P.STAGES] == ["quality rules", "line dedup", "SimHash near-dedup",
                                        "mixing sources to target weights", "SentencePiece encoding and decoding"]
    docs, seen = P.table(spark, sf_dir, "documents"), []
    columns = docs.columns
    for name, step in P.STAGES:
        before = [tuple(r) for r in docs.collect()]
        docs = P.stage(step(spark, docs, sf_dir), "stage")
        after = [tuple(r) for r in docs.collect()]
        seen.append(len(after))
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "quality rules":
            assert by_text(after) == by_text(good(before)) and 0 < len(after) < len(before)
        elif name == "line dedup":
            assert by_text(a[:2] for a in after) == by_text(x[:2] for x in lines([b[:2] for b in before], 2))
            assert all(a[4] == len(a[1]) for a in after)
        elif name == "SimHash near-dedup":
            stay = {d for d, _, c in near_duplicates([b[:2] for b in before]) if d == c}
            assert {a[0] for a in after if a[0] is not None} == stay - {None} and set(after) <= set(before)
        elif name == "mixing sources to target weights":
            assert set(after) <= set(before)
            words = lambda rows, s: sum(len(WORD.findall(r[1])) for r in rows if r[3] == s)
            sources = sorted({b[3] for b in before})
            total, left = sum(words(before, s) for s in sources), dict(zip(sources, WEIGHTS))
            goal, rest = {}, total
            while left:
                full = [s for s in left if rest * left[s] / sum(left.values()) > 3 * words(before, s)]
                for s in full or list(left):
                    goal[s] = 3 * words(before, s) if full else rest * left[s] / sum(left.values())
                rest -= sum(goal[s] for s in full)
                left = {s: w for s, w in left.items() if s in full} if not full else {s: w for s, w in left.items() if s not in full}
                if not full:
                    break
            for s in sources:
                assert goal[s] - 30 <= words(after, s) <= goal[s] + 1
        else:
            import sentencepiece
            sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
            for a in after:
                assert list(a[5]) == sp.encode(a[1]) and a[6] == sp.decode(list(a[5]))
    whole = P.run(spark, sf_dir)
    assert whole.columns == docs.columns
    assert by_text(r[:2] for r in whole.collect()) == by_text(r[:2] for r in docs.collect())
