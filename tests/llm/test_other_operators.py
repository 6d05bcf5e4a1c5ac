"""Vectors, tokens, mixing and personal data against plain versions and the public library."""
import random
import re

import numpy as np
import pytest
from brute import WORD, by_text, sha, vectors
from pyspark.sql import functions as F

from swipeflow.llm import mixing as M
from swipeflow.llm import pieces as P
from swipeflow.llm import pii as D
from swipeflow.llm import tokencount as T
from swipeflow.llm import vectors as V
from swipeflow.llm.common import components, prefix_sum, split_by_bitmap

PARTS = ["a", "b", " ", "  ", "   ", "\n", "é", "▁", "日本", "the", " the", "😀", "\t", "<0x0A>", "<s>", ".", "  \n", "\x00",
         "th", "ing", "<unk>", "2024", "((", "ﬁ", "�", "ß", "yyyyyyyyyyyyyyyyyyyyy"]


def texts(n=2500, seed=3, size=30):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, size))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=P.model_path())


# ---- vectors
@pytest.mark.parametrize("dim,tile", [(64, 40), (12, 16), (3, 8192)])
def test_vectors(spark, dim, tile):
    rng = np.random.default_rng(dim)
    base, rows = rng.normal(size=(8, dim)), []
    for i in range(150):
        v = base[rng.integers(8)] + rng.normal(size=dim) * rng.choice([0, 0.05, 0.15, 0.25, 1.5])
        rows.append((i * 7 % 151, [float(np.float32(x)) for x in v]))
    same = rows[5][1]
    rows += [(1000, None), (1001, [0.0] * dim), (1002, [float("nan")] * dim), (1003, [None] * dim), (1004, []),
             (None, same), (5000, same), (5000, same), (5001, [2 * x for x in same]), (5002, [1.0, 2.0]),
             (5003, [1.0, 2.1]), (5004, [float("inf")] * dim)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4).withColumn("n", F.lit(1))
    assert by_text(tuple(r) for r in V.near_vectors(df, tile=tile).collect()) == vectors(rows)


@pytest.mark.parametrize("n", [500, 1000, 2000])
def test_windows_hold_every_near_pair(n):
    rng = np.random.default_rng(n)
    c = np.sort(rng.normal(size=n) * 0.125)
    for same, other in ((True, c), (False, np.sort(rng.normal(size=n // 2) * 0.125))):
        seen, cost = np.zeros((n, len(other)), bool), 0
        for at, to, first, end in V.windows(c, other, 0.05, same):
            assert end - first <= V.WIDE and to - at <= V.CHUNK
            seen[at:to, first:end] = True
            cost += (to - at) * (end - first)
        near = np.abs(c[:, None] - other[None, :]) <= 0.05
        assert seen[np.triu(near, 1) if same else near].all() and cost < (0.4 if same else 0.6) * n * len(other)


@pytest.mark.parametrize("n", [300, 900, 2700])
def test_planted_links_at_every_cosine(spark, n):
    """Pairs on either side of the threshold, by one angle each, among random vectors."""
    rng, dim, rows, want = np.random.default_rng(n), 64, [], {}
    for k in range(n // 3):
        x, y = rng.normal(size=(2, dim))
        x /= np.linalg.norm(x)
        y -= x * (x @ y)
        y /= np.linalg.norm(y)
        cos = (0.95 + 1e-9, 0.96, 0.99, 0.95 - 1e-9, 0.94)[k % 5]   # told apart in double precision only
        rows += [(3 * k, x), (3 * k + 1, cos * x + np.sqrt(1 - cos * cos) * y), (3 * k + 2, rng.normal(size=dim))]
        linked = int(cos > 0.95)
        want |= {3 * k: (linked, 3 * k), 3 * k + 1: (linked, 3 * k + 1 - linked), 3 * k + 2: (0, 3 * k + 2)}
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in rows], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in V.near_vectors(df, tile=256).collect()}
    assert got == want


def test_no_vectors(spark):
    assert V.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# ---- SentencePiece
def test_codec_equals_the_library(library):
    codec = P.PieceCodec(P._model(None))
    cases = texts() + [" " * k for k in range(70)] + ["a" + " " * k + "(" for k in range(40)] + ["ab" * 3000, "🦄" * 50]
    for t in cases:
        ids = library.encode(t)
        assert codec.both(t) == (",".join(map(str, ids)), library.decode(ids)), repr(t)


def test_codec_forgets_without_changing(library, monkeypatch):
    monkeypatch.setattr(P, "CACHED_UNITS", 5)
    codec = P.PieceCodec(P._model(None))
    for t in texts(200, seed=9):
        assert codec.both(t)[0] == ",".join(map(str, library.encode(t)))
    assert len(codec) <= 5


def test_encode_and_digests(spark, library):
    rows = list(enumerate([*texts(60), None, "", "same", "same"]))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("IDS", F.lit(5))
    out = P.encode(df)
    assert out.columns == ["doc_id", "text", "IDS", "ids_", "decoded"]
    for r in out.collect():
        ids = library.encode(rows[r.doc_id][1] or "")
        assert r.ids_ == ids and r.decoded == library.decode(ids) and r.text == rows[r.doc_id][1]
    for r in P.digests(df).collect():
        ids = library.encode(rows[r.doc_id][1] or "")
        assert tuple(r)[1:] == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
    assert P.digests(df.limit(0)).count() == 0


# ---- token counts
def test_chunks_count_as_the_whole(library):
    with open(P.model_path(), "rb") as f:
        enc = T.SpanEncoder(f.read())
    assert enc.stable
    r = random.Random(5)
    for t in texts(1500, seed=6, size=80):
        assert T.chunked_count(enc.begins, t, r.choice([5, 9, 17]), r.choice([1, 3, 6])) == len(library.encode(t)), repr(t)
    huge = " ".join(texts(4000, seed=8))
    assert T.chunked_count(enc.begins, huge) == len(library.encode(huge))
    assert T.chunked_count(enc.begins, "y" * 60_000, 4096, 64) == len(library.encode("y" * 60_000))


def test_token_counts(spark, library):
    rows = list(enumerate([*texts(40), None, "", "the " * 5000, "y" * 40_000]))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_bytes", F.lit(0))
    for r in T.token_counts(df).collect():
        t = rows[r.doc_id][1] or ""
        n = len(library.encode(t))
        assert tuple(r)[1:] == (len(t.encode()), n, n > 4096)


# ---- mixing
def test_fit_is_the_nearest_sum_from_below():
    r = random.Random(3)
    for _ in range(200):
        sizes = sorted(r.sample(range(1, 60), r.randint(1, 8)))
        counts = [r.randint(1, 6) for _ in sizes]
        budget = r.randint(0, sum(a * b for a, b in zip(sizes, counts)) + 5)
        reach = {0}
        for s, c in zip(sizes, counts):
            for _ in range(c):
                reach |= {x + s for x in reach}
        x = M.fit(sizes, counts, budget)
        assert all(0 <= a <= b for a, b in zip(x, counts))
        assert sum(a * b for a, b in zip(sizes, x)) == max(s for s in reach if s <= budget)
        y = M.fit(sizes, counts, budget, knapsack=40)
        assert all(0 <= a <= b for a, b in zip(y, counts)) and sum(a * b for a, b in zip(sizes, y)) <= budget


def test_fit_on_either_side():
    r = random.Random(4)
    for _ in range(200):
        sizes = sorted(r.sample(range(1, 60), r.randint(1, 8)))
        counts = [r.randint(1, 6) for _ in sizes]
        total = sum(a * b for a, b in zip(sizes, counts))
        budget = r.randint(0, total + 5)
        reach = {0}
        for s, c in zip(sizes, counts):
            for _ in range(c):
                reach |= {x + s for x in reach}
        for room in (M.KNAPSACK, 40):           # a small room grows until nothing nearer can exist
            x = M.fit(sizes, counts, budget, knapsack=room, over=True)
            assert all(0 <= a <= b for a, b in zip(x, counts))
            assert abs(sum(a * b for a, b in zip(sizes, x)) - budget) == min(abs(s - budget) for s in reach)
            y = M.fit(sizes, counts, budget, knapsack=room)
            assert sum(a * b for a, b in zip(sizes, y)) == max(s for s in reach if s <= budget)
    assert M.fit([20_000], [1], 19_999, over=True) == [1] and M.fit([20_000], [1], 19_999) == [0]


def test_fit_of_large_budgets():
    sizes, counts = [30, 70, 1000, 90_000], [10 ** 9, 10 ** 9, 10 ** 8, 10 ** 5]
    for budget in (10 ** 9 + 10, 7 * 10 ** 10, 6 * 10 ** 10 + 7):
        x = M.fit(sizes, counts, budget)
        assert sum(a * b for a, b in zip(sizes, x)) == budget - budget % 10
    # lengths that fit nothing exactly, beyond the largest room: less than the longest is missed
    sizes, counts = [90_000, 90_001], [10 ** 5, 1]
    for over, most in ((False, 90_001), (True, 45_001)):
        x = M.fit(sizes, counts, 8 * 10 ** 9 + 45_000, over=over)
        assert abs(sum(a * b for a, b in zip(sizes, x)) - 8 * 10 ** 9 - 45_000) <= most


def test_mixing_of_repeated_rows(spark):
    rows = [(None, "a", "w w w")] * 500 + [(1, "b", "w " * 7)] * 90 + [(i, "c", "w") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    for over in (False, True):
        out, name = M.mixed(df.withColumn("times", F.lit(0)), over=over)
        got = out.groupBy("source").agg(F.count("*").alias("n"), F.max(name["target"]).alias("goal"),
                                        F.sum(F.col(name["size"]) * F.col(name["times"])).alias("taken"),
                                        F.max(name["times"]).alias("most"), F.max(name["size"]).alias("size")).collect()
        assert sorted((g.source, g.n) for g in got) == [("a", 500), ("b", 90), ("c", 40)]
        for g in got:
            assert g.most <= 3 and abs(g.taken - g.goal) <= (g.size / 2 + 1 if over else g.size)


def shares(sizes, cap=3.0):
    """Targets by sharing again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: M.WEIGHTS[i % 3] for i, s in enumerate(order)}
    out, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > cap * sizes[s]}
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        for s in full:
            out[s] = cap * sizes[s]
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


def test_mixing(spark):
    r = random.Random(11)
    rows = [(i, r.choice(["a", "b", "c", "é", "Z", None, ""]), " ".join(["w"] * r.choice([0, 1, 5, 7, 30, 31])))
            for i in range(400)] + [(500 + i, "big", "x " * 9) for i in range(700)] + [(2000, "tiny", "x"), (2001, None, None)]
    rows += [(3, "a", "again again")] * 3
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(6)
    out, name = M.mixed(df.withColumn("size", F.lit(1)).withColumn("NUL", F.lit(2)))
    got = out.select("doc_id", "source", *[F.col(name[c]).alias(f"_{c}") for c in ("size", "source_size", "target", "times")]).collect()
    assert len(got) == len(rows)
    sizes, taken = {}, {}
    for i, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    goal = shares(sizes)
    for g in got:
        taken[g.source] = taken.get(g.source, 0) + g._size * g._times
        assert g._source_size == sizes[g.source] and abs(g._target - goal[g.source]) < 1e-6 and 0 <= g._times <= 3
    for s in sizes:
        assert goal[s] - 31 <= taken[s] <= goal[s] + 1
    again, name = M.mixed(df)
    assert by_text(again.select("doc_id", name["times"]).collect()) == by_text((g.doc_id, g._times) for g in got)
    copies = M.mix(df)
    assert copies.columns == df.columns and copies.count() == sum(g._times for g in got)
    assert M.mix(df.limit(0)).count() == 0


# ---- personal data
def test_permutation_is_one():
    for n in (1, 2, 7, 100, 257):
        assert sorted(D.permute(D.KEY, "x", i, n, 0) for i in range(n)) == list(range(n))


def test_surrogates(spark):
    plain = "Nothing here, version 4.0. and 3. of 12 things at 10:30, price 1,234.50"
    rows = [(1, "mail Und.34@Mail7.example.com and UND.34@MAIL7.EXAMPLE.COM!! or +1 (988) 555-2485, 4041894974608795"),
            (2, "again und.34@mail7.example.com; +1 988-555-2485; 4532015112830366 from 70.123.182.155."),
            (3, "Mr. John Smith met Mrs Anna Smith; г-жа Анна Петрова wrote"), (4, plain), (5, None), (6, ""), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("N_entities", F.lit(1))
    out, count = D.pseudonymised(df)
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == ["doc_id", "text", "N_entities", count] and count.lower() != "n_entities"
    assert got[4].text == plain and got[4][count] == 0 and got[5].text is None and got[6].text == ""
    one, two, three = got[1].text, got[2].text, got[3].text
    for i, t in rows[:3]:
        for _, _, _, name in D.entities(t):
            assert name not in got[i].text.lower()
    mail = re.search(r"[\w.]+@[\w.]+\.com", two)[0]
    assert mail in one.lower() and mail.upper() in one                 # coreference, format
    digits = lambda s: re.sub(r"\D", "", re.search(r"\+1[ ()\d-]+", s)[0])[:11]
    assert digits(one) == digits(two) and digits(one).startswith("1")
    assert D.luhn("4532015112830366") and D.luhn(re.search(r"\d{16}", two)[0])
    assert D.luhn("4041894974608795") == D.luhn(re.search(r"\d{16}", one)[0])
    assert all(0 <= int(x) < 256 for x in re.search(r"(\d+\.){3}\d+", two)[0].split("."))
    m = re.match(r"Mr\. (\w+) (\w+) met Mrs (\w+) (\w+); г-жа (\w+) (\w+) wrote", three)
    assert m[1] in D.GIVEN["m", "latin"] and m[3] in D.GIVEN["f", "latin"] and m[5] in D.GIVEN["f", "cyrillic"]
    assert m[2] == m[4] and re.fullmatch("[А-Яа-я]+", m[6])


def test_collisions_are_resolved(spark):
    names = [f"Mr {a} Stone" for a in "Al Bo Cy Dan Ed Fox Gus Hal Ike Jim Kim Lou Moe Ned Otto Pat Quin Rex Sam Tom".split()]
    df = spark.createDataFrame(list(enumerate(names)), "doc_id long, text string")
    out = [r.text for r in D.pseudonymised(df)[0].collect()]
    assert len(set(out)) == len(names) and len({t.split()[-1] for t in out}) == 1
    assert D.pseudonymised(df.limit(0))[0].count() == 0


def test_any_number_of_given_names_stays_distinct(spark):
    names = ["".join(chr(97 + i // 26 ** p % 26) for p in range(4)).capitalize() for i in range(20_000)]
    rows = [(i, f"Mr {x} Stone") for i, x in enumerate(names)] + [(20_000 + i, f"mail {i}@_.com and _@_.org") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in D.pseudonymised(df)[0].collect()}
    assert len(set(out.values())) == len(rows)
    assert not any(t in out[i] for i, t in rows)


def test_phone_layouts_and_untitled_names():
    for n in ("+1 555 123 4567", "555 123 4567", "+44 20 7946 0958", "+44 (0)20 7946 0958", "+49 30 1234567", "0049 30 1234567",
              "+34 612 345 678", "06 12 34 56 78", "030/1234567", "612 34 56 78", "(555) 123-4567", "+358 40 123 4567"):
        text = f"call {n}, or not"
        assert [(text[a:b], k) for a, b, k, _ in D.entities(text)] == [(n, "phone")], n
        new = D.replaced(D.KEY, text, {})[0]
        assert new != text and re.sub(r"\d", "9", new) == re.sub(r"\d", "9", text)
        country = re.match(r"\+1|\+44|\+49|\+34|\+358|0049|0(?=[36])|", n)[0]
        assert new.startswith("call " + country)
    assert D.canonical("phone", "+49 30 1234567") == D.canonical("phone", "0049 (0)30-1234567")
    for t in ("on 01.02.2024 10:30", "at 2024-06-03 08:00:00.123456", "12 345 678 900 people", "0.123456789012", "1,234.50"):
        assert D.entities(t) == []
    text = "Mr John Smith came. Smith said John left, a smith; JOHN knew. Mail Smith@x.org"
    new = D.replaced(D.KEY, text, {})[0]
    first, last = re.match(r"Mr (\w+) (\w+) came", new).groups()
    assert f"{last} said {first} left, a smith; {first.upper()} knew." in new and "John" not in new


# ---- shared helpers
def test_components(spark):
    r = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(r.randint(100, 160), r.randint(100, 160)) for _ in range(40)] + [(500, i) for i in range(200, 300)]
    links = [x for x in links if x[0] != x[1]]
    up = {}

    def find(x):
        while up.get(x, x) != x:
            x = up[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: find(n) for x in links for n in x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_prefix_sum_and_bitmap(spark):
    df = spark.range(500).selectExpr("id AS k", "id % 7 AS v").repartition(9)
    run = {x.k: x.s for x in prefix_sum(df, ["k"], "v", "s").collect()}
    assert run == {k: sum(i % 7 for i in range(k)) for k in range(500)}
    named, rest = split_by_bitmap(df.withColumn("bits", F.lit(1)), "k", spark.range(0, 500, 10))
    inside = {x.k for x in named.collect()}
    assert set(range(0, 500, 10)) <= inside and inside | {x.k for x in rest.collect()} == set(range(500))
    assert len(inside) < 60
