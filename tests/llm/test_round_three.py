"""Whitening, hard negatives and decontamination against plain versions."""
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from swipeflow.llm import decontaminate as C
from swipeflow.llm import negatives as N
from swipeflow.llm import whitening as W


def by_text(rows):
    return sorted((tuple(r) for r in rows), key=str)


# ---- whitening
def spectrum_of(x, block, parts):
    states = []
    for rows in np.array_split(x, parts):
        if len(rows):
            s = W.Spectrum(x.shape[1])
            for at in range(0, len(rows), block):
                s.add(rows[at:at + block])
            states.append(s)
    first, *rest = states
    for s in rest:
        first.merge(s)
    return first


CASES = {
    "plain": lambda r: r.normal(size=(200, 24)) * np.linspace(1, 900, 24),
    "few rows": lambda r: r.normal(size=(5, 12)) * 50,
    "one row": lambda r: r.normal(size=(1, 4)) * 50,
    "repeated rows": lambda r: np.repeat(r.normal(size=(4, 10)) * 99, 60, axis=0),
    "constant and equal columns": lambda r: np.hstack([x := r.normal(size=(90, 5)) * 80, x, np.full((90, 2), 7)]),
    "equal eigenvalues": lambda r: np.vstack([np.eye(16), -np.eye(16)] * 8) * 640,
    "one column": lambda r: r.normal(size=(50, 1)) * 80,
    "wide range": lambda r: r.normal(size=(300, 20)) * 10.0 ** np.linspace(0, 7, 20),
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("block,parts", [(1, 3), (16, 1), (1024, 4)])
def test_rank_one_updates_give_the_scatter(case, block, parts):
    x = np.floor(CASES[case](np.random.default_rng(5))).astype(np.int64) + 1_000_000
    s = spectrum_of(x, block, parts)
    y = x - x.mean(0)
    scatter = y.T @ y
    assert s.n == len(x) and s.sums == x.sum(0).tolist()
    # every step between means rounds at the size of the entries
    size = max(np.abs(scatter).max(), np.sqrt(np.abs(scatter).max()) * 1e-6, 1e-9)
    assert np.abs((s.basis * s.spread) @ s.basis.T - scatter).max() < 1e-9 * size + 1e-7
    assert np.abs(s.basis.T @ s.basis - np.eye(x.shape[1])).max() < 1e-11
    assert (np.diff(s.spread) >= 0).all()


@pytest.mark.parametrize("seed", range(6))
def test_secular_roots(seed):
    r = np.random.default_rng(seed)
    d = np.sort(np.exp(r.uniform(-12, 12, 1 + 13 * seed)))
    w = np.exp(r.uniform(-14, 8, len(d)))
    diff = W.secular(d, w)
    roots = d - np.diagonal(diff)
    assert (roots >= d).all() and (roots[:-1] <= d[1:]).all()
    want = np.linalg.eigvalsh(np.diag(d) + np.outer(np.sqrt(w), np.sqrt(w)))
    assert np.allclose(roots, want, rtol=1e-10, atol=1e-10 * want[-1])


def test_whitening(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 6)) @ np.diag([3, 2, 1, .5, .25, .1]) + 4
    rows = [(i, [float(v) for v in np.float32(v)]) for i, v in enumerate(x)]
    rows += [(7, rows[7][1]), (None, rows[9][1]), (900, None), (901, []), (902, [1.0] * 5), (903, [None] * 6),
             (904, [float("nan")] * 6), (905, [float("inf")] * 6), (906, [1e300] * 6), (907, [1.0, None, 1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(11).withColumn("component", F.lit(1))
    got = W.whiten(df, components=4).toPandas()
    v = np.floor(64 * np.array([e for _, e in rows[:302]])).astype(np.int64) + 1_000_000
    n, s = len(v), v.sum(0)
    assert set(got.n) == {302} and len(got) == 4 * 302 and sorted(set(got.component)) == [1, 2, 3, 4]
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    y = v - s / n
    e, q = np.linalg.eigh(y.T @ y / n)
    e, q = e[::-1], q[:, ::-1]
    assert np.allclose([got[got.component == c].explained.iloc[0] for c in (1, 2, 3, 4)], e[:4] / e.sum(), rtol=1e-9)
    q = q * np.sign(q[np.abs(q).argmax(0), range(6)])
    want = sorted((c + 1, int(((n * a - s) ** 2).sum()), round(float(b @ q[:, c] / np.sqrt(e[c])), 6))
                  for a, b in zip(v, y) for c in range(4))
    have = sorted((int(c), int(d), round(float(w), 6)) for c, d, w in zip(got.component, got.deviation, got.whitened))
    assert [h[:2] for h in have] == [w[:2] for w in want]
    assert np.allclose([h[2] for h in have], [w[2] for w in want], atol=2e-6)
    assert got.vec_id.isna().sum() == 4


def test_whitening_of_little(spark):
    kind = "vec_id long, embedding array<float>"
    for rows in ([], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(9)], [(1, None)]):
        assert W.whiten(spark.createDataFrame(rows, kind)).count() == 0
    line = W.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)], kind)).collect()
    assert {r.component for r in line} == {1} and abs(line[0].explained - 1) < 1e-12


def test_deviation_beyond_a_long():
    whole = np.array([[1 << 50, 3]])
    assert W.deviations(whole, 1 << 20, [0, 0]) == [None]
    assert W.deviations(np.array([[1 << 30, 3]]), 2, [1, 1]) == [((1 << 31) - 1) ** 2 + 25]


# ---- hard negatives
def plain_negatives(rows, positives, negatives, low, high, scale, every):
    kept = []
    for i, lab, v in rows:
        if lab is not None and v and all(x is not None and np.isfinite(x) and abs(x) < 1e5 for x in v):
            kept.append((i, lab, tuple(int(np.floor(x * scale)) for x in v)))
    kept = sorted(set(kept), key=str)
    out = []
    for a in kept:
        if a[0] is None or a[0] % every:
            continue
        near = [(sum(x * y for x, y in zip(a[2], b[2])), b) for b in kept if b is not a and len(b[2]) == len(a[2])]
        near.sort(key=lambda p: (-p[0], p[1][0] is None, p[1][0] or 0))
        for score, p in [x for x in near if x[1][1] == a[1]][:positives]:
            fit = [x for x in near if x[1][1] != a[1] and low * score <= 100 * x[0] <= high * score][:negatives]
            out += [(a[0], p[0], k, m[0], score, s) for k, (s, m) in enumerate(fit, 1)]
    return out


@pytest.mark.parametrize("side,dim,n", [(4096, 8, 500), (16, 8, 400), (7, 3, 150)])
def test_hard_negatives(spark, monkeypatch, side, dim, n):
    monkeypatch.setattr(N, "SIDE", side)
    r = np.random.default_rng(dim + side)
    centres = r.normal(size=(4, dim))
    rows = [(int(i), int(r.integers(4)), [float(x) for x in np.float32(centres[r.integers(4)] + r.normal(size=dim) * .7)])
            for i in range(n)]
    rows += [(10_001, None, rows[0][2]), (10_002, 1, None), (10_003, 1, []), (10_004, 1, [None] * dim),
             (10_005, 2, [float("nan")] * dim), (10_006, 2, [1e30] * dim), (20_000, 1, [0.0] * dim), (20_010, 1, [1.0]),
             (20_015, 2, [0.9]), (20_020, 1, [2.0]), (None, 3, rows[3][2]), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("rank", F.lit(1)).repartition(5)
    got = by_text(N.mine(df, anchor=F.col("vec_id") % 10 == 0).collect())
    assert got == by_text(plain_negatives(rows, 5, 10, 30, 90, 256, 10)) and len(got) > 100


def test_hard_negatives_of_one_label_and_of_nothing(spark):
    kind = "vec_id long, label int, embedding array<float>"
    assert N.mine(spark.createDataFrame([], kind)).count() == 0
    assert N.mine(spark.createDataFrame([(0, 1, [1.0]), (1, 1, [1.0])], kind)).count() == 0


def test_windows_hold_one_anchor():
    stream = [(1, 0, -100, False, 7, 0), (1, 0, -90, True, 8, 0), (1, 0, -89, False, 9, 0), (1, 0, -80, True, 10, 0),
              (1, 0, -31, True, 11, 0), (1, 0, -28, True, 12, 0), (2, 0, -80, True, 13, 0), (3, 0, 0, False, 1, 0), (3, 0, 0, True, 2, 0)]
    assert list(N.windowed(stream, 2, 30, 90)) == [
        (1, 7, 1, 8, 100, 90), (1, 7, 2, 10, 100, 80), (1, 9, 1, 10, 89, 80), (1, 9, 2, 11, 89, 31), (3, 1, 1, 2, 0, 0)]


def test_large_components_are_exact(spark):
    rows = [(0, 1, [40_000.3, -9.1]), (2, 1, [39_999.7, 11.9]), (3, 2, [20_000.25, 70_000.0]), (4, 2, [30_000.0, -70_000.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert by_text(N.mine(df).collect()) == by_text(plain_negatives(rows, 5, 10, 30, 90, 256, 100))


# ---- decontamination
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEM_WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_hits(docs, items, size):
    """(id, words, hit words, items, their digest, spans) of each document."""
    patterns = {}
    for name, text in items:
        w = ITEM_WORD.findall((text or "").translate(FOLD))
        for i in range(max(len(w) - size, 0) + 1 if w else 0):
            patterns.setdefault(tuple(w[i:i + size]), set()).add("" if name is None else str(name))
    out = []
    for i, text in docs:
        found = list(ITEM_WORD.finditer((text or "").translate(FOLD)))
        w = [m.group() for m in found]
        hit, names = set(), set()
        for n in {len(p) for p in patterns}:
            for at in range(len(w) - n + 1):
                who = patterns.get(tuple(w[at:at + n]))
                if who:
                    names |= who
                    hit.update(range(at, at + n))
        spans = []
        for p in sorted(hit):
            if p - 1 in hit:
                spans[-1] = (spans[-1][0], found[p].end())
            else:
                spans.append(found[p].span())
        out.append((i, len(w), len(hit), sorted(names), spans))
    return out


def corpus(seed=4, n=300):
    r = random.Random(seed)
    # letters that str.lower would change in length or not at all, digits, signs between words
    vocabulary = ["the", "The", "THE", "a", "é", "É", "İ", "ß", "日本", "x1", "42", "K", "don't", "e-mail", "\x85", " ", "ſ", "😀"]
    gaps = [" ", "\n", "\t", "  ", ", ", "_", "--", "\x00", "[", "`"]

    def text(k):
        return "".join(r.choice(vocabulary) + r.choice(gaps) for _ in range(k))
    items = [(i, text(r.choice([0, 1, 3, 9, 10, 11, 25]) if i > 6 else 30)) for i in range(25)]
    items += [(3, text(12)), (None, text(14)), (None, "Zebra zebra"), (50, None), (51, ""), (52, " -- "), (8, items[9][1])]
    long = [t for _, t in items if t and len(t) > 20]
    docs = []
    for i in range(n):
        parts = [text(r.randint(0, 30))]
        if r.random() < .4:
            t = r.choice(long)
            parts += [t.upper() if r.random() < .3 and t.isascii() else t[r.randint(0, 9):], text(r.randint(0, 9))]
        docs.append((i, "".join(parts)))
    docs += [(None, None), (None, "zebra ZEBRA"), (1, docs[1][1]), (900, ""), (901, text(4000)), (902, "a" * 100_000)]
    return docs, items


@pytest.mark.parametrize("size,capacity", [(10, 100_000), (10, 40), (3, 100_000), (4, 9), (1, 5)])
def test_passages(spark, size, capacity):
    docs, items = corpus()
    items = [x for x in items if size == 10 or x[0] != 3] if capacity < 10 else items
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("Items", F.lit(1)).withColumn("n_hit", F.lit(2))
    b = spark.createDataFrame(items, "item_id long, text string")
    out, names = C.find(d, b, size=size, capacity=capacity)
    assert not {x.lower() for x in names} & {x.lower() for x in d.columns} and out.columns == [*d.columns, *names]
    got = [(r[0], r[4], r[5], r[6], [tuple(s) for s in r[7]]) for r in out.collect()]
    assert by_text(got) == by_text(plain_hits(docs, items, size))


def test_groups_keep_to_the_capacity(spark):
    docs, items = corpus()
    b = spark.createDataFrame(items, "item_id long, text string")
    groups = C.item_groups(b, "item_id", ("text",), 10, 40)
    assert len(groups) > 3
    for g in groups:
        rows = g.collect()
        assert sum(max(len(t.split()) - 9, 1) for _, t in rows) <= 40


def test_clean_documents_stay_and_spans_go(spark):
    docs, items = corpus(seed=9)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    found = plain_hits(docs, items, 10)
    kept = by_text(C.decontaminate(d, b).collect())
    assert kept == by_text(doc for doc, f in zip(docs, found) if not f[2])
    cut = by_text(C.without_passages(d, b, mark="#").collect())
    want = []
    for (i, t), f in zip(docs, found):
        for s, e in reversed(f[4]):
            t = t[:s] + "#" + t[e:]
        want.append((i, t))
    assert cut == by_text(want)


def test_questions_and_answers(spark):
    d = spark.createDataFrame([(1, "see 1 2 3 end"), (2, "four five"), (3, "three four")], "doc_id long, text string")
    b = spark.createDataFrame([("q", "1 2 3", "Four, five!")], "item_id string, question string, answer string")
    out, _ = C.find(d, b, item_texts=("question", "answer"))
    assert {r.doc_id: r["items"] for r in out.collect()} == {1: ["q"], 2: ["q"], 3: []}


def test_no_items_and_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert C.find(none, b)[0].count() == 0 and C.find(none, spark.createDataFrame([(1, "a")], b.schema))[0].count() == 0
    assert [tuple(r) for r in C.find(d, b)[0].collect()] == [(1, "a b", 2, 0, [], [])]


def test_registered_digest(spark):
    from conftest import SF_SMALL
    rows = C.op13_aho_corasick_decontamination(spark, SF_SMALL).collect()
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    want = [(i, w, h, len(n), hashlib.sha256(",".join(n).encode()).hexdigest(), h > 0) for i, w, h, n, _ in plain_hits(docs, items, 10)]
    assert by_text(rows) == by_text(want) and any(r.contaminated for r in rows)


# ---- personal data: nothing found stays
FOUND = ["Mr Emil Hansen, Frau Alma Koch, господин Антон Чехов und Herr Иван Нина", "Mr. O'Brien met Mrs van der Berg. O'Brien's dog, Berg's cat",
         "Prof. Dr. Anna Schmidt and Dr. Ivan Petrov; Petrov left. Herr Dr. Müller-Lüdenscheidt", "Monsieur d'Artagnan et Mme Clara-Maria Weiß",
         "IBAN DE89 3704 0044 0532 0130 00 or GB29NWBK60161331926819 x", "at 2001:db8::ff00:42:8329 and fe80:0000:0000:0000:0202:b3ff:fe1e:8329",
         "MR. is no title, Sra. Flora Diana is one, г-жа Ольга Вера too"]
KEYS = [b"one", b"two", b"three", b"four", b"replace this key"]


@pytest.mark.parametrize("key", KEYS)
def test_no_name_survives(spark, key):
    from swipeflow.llm import pii as D
    titles = {"m": "Mr", "f": "Frau", "n": "Dr."}
    pool = [f"{titles[g]} {name} {family}" for (g, _), names in D.GIVEN.items() for name, family in zip(names, names[1:] + names[:1])]
    texts = FOUND + pool
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r.text for r in D.pseudonymised(df, key=key)[0].collect()}
    renamed = {}
    for i, t in enumerate(texts):
        spans = D.entities(t)
        assert spans
        if i >= len(FOUND):
            assert len(spans) == 2
        # what stands around the entities is as it was, and each entity's place holds something else
        gaps = [re.escape(t[e:s]) for (e, s) in zip([0] + [b for _, b, _, _ in spans], [a for a, _, _, _ in spans] + [len(t)])]
        m = re.fullmatch("(.+?)".join(gaps), out[i])
        assert m, (t, out[i])
        for (a, b, kind, name), new in zip(spans, m.groups()):
            words = {w.casefold() for w in re.findall(r"[^\W_]+", new)}
            assert new.casefold() != t[a:b].casefold() and name not in words, (t, out[i])
            assert renamed.setdefault((kind, name), new.casefold().replace(" ", "")) == new.casefold().replace(" ", "") or kind in ("ipv6",)
    by_kind = [(k[0], v) for k, v in renamed.items()]
    assert len(by_kind) == len(set(by_kind))                   # distinct originals stay distinct


def test_every_pool_name_under_many_tries():
    from swipeflow.llm import pii as D
    for key in KEYS:
        for (g, script), names in D.GIVEN.items():
            for name in names:
                for trial in range(8):
                    new = D.surrogate(key, f"given:{g}:{script}", name.casefold(), trial)
                    assert name.casefold() not in new.casefold().split("-")


def test_formats_that_need_a_check():
    from swipeflow.llm import pii as D
    new = D.replaced(D.KEY, FOUND[4], {})[0]
    ibans = re.findall(r"(?:DE|GB)[0-9A-Z ]+?(?= or| x)", new)
    assert len(ibans) == 2 and all(D.genuine("iban", i) for i in ibans) and ibans[0][4] == " "
    full = D.replaced(D.KEY, "a 2001:db8::1, b 2001:0db8:0000:0000:0000:0000:0000:0001", {})[0]
    import ipaddress
    assert len({ipaddress.IPv6Address(x) for x in re.findall(r"[0-9a-f:]{6,}", full)}) == 1
    for t in ("std::vector", "12:30:45", "a::b", "DE12 3456", "DE89 3704 0044 0532 0130 01", "x::y", "::", "Mr. smith went"):
        assert D.entities(t) == [], t


# ---- SentencePiece: pairs at their boundary
def test_pairs_stay_as_merging_says():
    """All ways to cut a piece in two, pieces that follow each other in text, and random ones."""
    from swipeflow.llm import pieces as P
    c = P.PieceCodec(P._model(None))
    assert c.falling
    made = set(c.parts) | {i for p, i in c.id_of.items() if len(p) == 1}
    words = [i for i in made if c.piece[i].strip("▁")]
    r = random.Random(6)
    pairs = [(r.choice(words), r.choice(words)) for _ in range(4000)]
    for i in r.sample(sorted(c.parts), 4000):
        p = c.piece[i]
        cuts = [(c.id_of.get(p[:k]), c.id_of.get(p[k:])) for k in range(1, len(p))]
        pairs += [(a, b) for a, b in cuts if a in made and b in made and c.piece[a].strip("▁") and c.piece[b].strip("▁")]
    kept = 0
    for a, b in pairs:
        ok = c.merge(c.piece[a] + c.piece[b]) == [a, b]
        assert c.stay(a, b) == ok, (c.piece[a], c.piece[b])
        kept += ok
    assert 100 < kept < len(pairs) - 100


def test_units_are_remembered_in_two_generations():
    from swipeflow.llm import pieces as P
    c = P.PieceCodec(P._model(None), remembered=5)
    texts = [" ".join(random.Random(i).choices("the of and einer nicht была wort x y z".split(), k=30)) for i in range(20)]
    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_file=P.model_path())
    assert [c.both(t)[0] for t in texts + texts] == [",".join(map(str, library.encode(t))) for t in texts + texts]
    assert len(c) <= 5 and len(c.old) <= 5 and all(c.both(t)[1] == t for t in texts)


# ---- substring copies: many equal rows
@pytest.mark.parametrize("doc_id", [7, None])
def test_equal_rows_are_indexed_once(spark, doc_id):
    from swipeflow.llm import substring as U
    r = random.Random(2)
    passage = " ".join(f"w{r.randrange(10_000)}" for _ in range(120))
    other = " ".join(f"v{r.randrange(10_000)}" for _ in range(80))
    rows = [(3, "start " + passage)] + [(doc_id, passage + " end")] * 20_000 + [(doc_id, other)] * 50 + [(9, other + " x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {}
    for x in U.without_copies(df).collect():
        got[x.doc_id, x.n_words, x.n_removed] = got.get((x.doc_id, x.n_words, x.n_removed), 0) + 1
    lost = 0 if doc_id == 7 else 80          # a row without id stands after all others
    assert got == {(3, 121, 0): 1, (doc_id, 121, 120): 20_000, (doc_id, 80, lost): 50, (9, 81, 80 - lost): 1}
