"""Periodic runs, the quality of lines and fill-in-middle rows: brute force, exact restoring, held-out accuracy and odd rows."""

import hashlib
import itertools
import random
import re
import time
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from quarry.llm import fill_middle, line_quality, queries, runs

SF = "/root/testdata/sf0.001"
ODD = [None, "", "   ", "word", "a " * 30, "é " * 40 + "\x00 x", "\n\n", "x" * 50_000, "a b c " * 3000, "A\tB \x0b\x0c\r\n" * 24, "<P>", "a<", "<S" * 3]
CLASHING = "doc_id long, text string, n long, form string, output string, row string, h long, runs string, score double, label int"


def table(spark, texts, schema=CLASHING, first=1):
    rows = [(i, t, 9, "f", "o", "r", 5, "q", 0.5, 7) for i, t in enumerate(texts, first)]
    return spark.createDataFrame([*rows, *rows[:3], (None, "a b c d " * 9, *rows[0][2:])], schema)


# -- runs ------------------------------------------------------------------------------------------------------------------------


def all_runs(words):
    found = {}
    for d in range(1, len(words) // 3 + 1):
        i = d
        while i < len(words):
            j = i
            while j < len(words) and words[j] == words[j - d]:
                j += 1
            if j - i + d >= max(24, 3 * d):
                found.setdefault((i - d, j - i + d), d)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def digest_of(doc_id, text):
    words = words_of(text)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        g = h // 10
        a = g % len(words)
        p = 1 + (len(words) - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    rows = all_runs(words)
    gone = {i for s, n, q in rows for i in range(s + q, s + n)}
    top = max(rows, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if rows else (None,) * 3
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return doc_id, len(rows), *top, 1000 * top[1] // top[2] if rows else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in rows)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))


def woven(rng):
    size, out = rng.choice([1, 2, 3, 5, 60]), []
    while len(out) < rng.choice([5, 40, 250]):
        if rng.random() < 0.5:
            out += [rng.randrange(size) for _ in range(rng.randrange(1, 20))]
        else:
            unit = [rng.randrange(size) for _ in range(rng.randrange(1, 40))]
            out += unit * rng.randrange(1, 6) + unit[: rng.randrange(len(unit))]
    return out


def test_runs_equal_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        rows = [woven(rng) for _ in range(rng.randrange(8))]
        bounds = np.append(0, np.cumsum([len(r) for r in rows])).astype(np.int64)
        want = [(s + bounds[k], n, q) for k, r in enumerate(rows) for s, n, q in all_runs(r)]
        got = runs.runs_of(np.array([w for r in rows for w in r], np.int64), bounds)
        assert [tuple(r) for r in got.tolist()] == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=12), st.integers(1, 12)), max_size=6))
def test_runs_of_repeated_units(units):
    words = [w for unit, times in units for w in unit * times]
    got = runs.runs_of(np.array(words, np.int64), np.array([0, len(words)]))
    assert [tuple(r) for r in got.tolist()] == all_runs(words)


@pytest.mark.parametrize("kind", ["one word", "short period", "repeated lines", "long period"])
def test_runs_of_long_texts_in_time(kind):
    rng, n = random.Random(4), 100_000
    words = {
        "one word": [0] * n,
        "short period": [i % 7 for i in range(n)],
        "repeated lines": [10 * k + w for k in rng.choices(range(20), k=n // 10) for w in range(10)],
        "long period": list(range(n // 3)) * 3,
    }[kind]
    began = time.time()
    got = runs.runs_of(np.array(words, np.int64), np.array([0, len(words)])).tolist()
    assert time.time() - began < 20
    for s, length, q in got:
        assert words[s + q : s + length] == words[s : s + length - q] and length >= max(24, 3 * q)
        assert (s == 0 or words[s - 1] != words[s - 1 + q]) and (s + length == len(words) or words[s + length] != words[s + length - q])
    if kind != "repeated lines":
        assert got == [[0, len(words), {"one word": 1, "short period": 7, "long period": n // 3}[kind]]]


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = sorted(digest_of(*r) for r in rows if len(r.text or "") < 20_000)
    ids = {r[0] for r in want}
    got = [tuple(r) for r in queries.op11_periodic_runs(spark, SF).collect() if r.doc_id in ids]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_runs_of_odd_rows(spark):
    docs = table(spark, ODD * 4)
    got = [tuple(r) for r in runs.digest(runs.find(runs.planted(docs))).collect()]
    assert sorted(got, key=str) == sorted((digest_of(r.doc_id, r.text) for r in docs.collect()), key=str)
    assert runs.digest(runs.find(runs.planted(docs.limit(0)))).count() == 0
    found = {r.doc_id: r for r in runs.find(docs).collect()}
    assert found[9].runs == [(0, 9000, 3)] and found[9].collapsed == "a b c"
    assert found[1].runs == [] and found[1].collapsed == ""


# -- fill-in-middle --------------------------------------------------------------------------------------------------------------


def middle_of(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    s = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(s[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    parts = ["".join(x) for x in (units[:a], units[a:b], units[b:])]
    form = "plain" if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
    output = {"plain": text, "psm": f"<P>{parts[0]}<S>{parts[2]}<M>{parts[1]}", "spm": f"<S>{parts[2]}<P>{parts[0]}<M>{parts[1]}"}[form]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return doc_id, len(units), form, *((None, None) if form == "plain" else (len(parts[0]), len(parts[1]))), sha(output), sha(text)


def test_middles_equal_brute_force(spark):
    rng = random.Random(6)
    tricky = ["".join(rng.choices(["<", "P", ">", "S", "M", " ", "\n", "é", "\U0001f600", "$1", "\\", "ab"], k=rng.randrange(30))) for _ in range(300)]
    docs = table(spark, [*ODD, *tricky, "ab, " * 200_000])
    want = sorted((middle_of(r.doc_id, r.text) for r in docs.collect()), key=str)
    assert sorted((tuple(r) for r in fill_middle.digest(docs).collect()), key=str) == want
    assert {r[2] for r in want} == {"plain", "psm", "spm"}
    out = fill_middle.transform(docs)
    assert out.columns == [*(c for c in docs.columns if c not in fill_middle.NEW), *fill_middle.NEW]
    restored = fill_middle.restore(F.col("output"), F.col("form"))
    assert out.filter(~restored.eqNullSafe(F.coalesce("text", F.lit("")))).count() == 0
    assert fill_middle.transform(docs.limit(0)).count() == 0


def test_middles_run_in_sql_functions_only(spark):
    plan = queries.op13_fill_middle(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan) and "Exchange" not in plan


# -- quality ---------------------------------------------------------------------------------------------------------------------


def test_marginals_equal_sums_over_all_labels():
    rng = np.random.default_rng(0)
    bounds = np.array([0, 3, 4, 10])
    evidence, pairs, first = rng.normal(size=10) * 2, rng.normal(size=(2, 2)), 0.4
    good, expected, norm = line_quality.marginals(evidence, pairs, first, bounds)
    sums = np.zeros((2, 2))
    for k, (a, b) in enumerate(itertools.pairwise(bounds)):
        total, each = 0.0, np.zeros(b - a)
        inner = np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=b - a):
            w = np.exp(first * y[0] + sum(e for e, v in zip(evidence[a:b], y, strict=True) if v) + sum(pairs[p] for p in itertools.pairwise(y)))
            total, each = total + w, each + w * np.array(y)
            for p in itertools.pairwise(y):
                inner[p] += w
        assert np.allclose(each / total, good[a:b]) and np.isclose(np.log(total), norm[k])
        sums += inner / total
    assert np.allclose(sums, expected)


def test_levels_of_lines():
    stats, size, bounds = line_quality.levels(pa.array([None, "", "a\nB b c\n", "x\n\nx", "é!! !! !!"]))
    assert bounds.tolist() == [0, 1, 2, 5, 8, 9] and size.tolist() == [1, 1, 2, 6, 1, 2, 1, 2, 11]
    copies, repeats = line_quality.STATS.index("copies of the line"), line_quality.STATS.index("repeats of words")
    assert stats[5, copies] == stats[7, copies] == 1 and stats[2, copies] == 0
    assert stats[3, repeats] > 0 and stats[8, repeats] > 0 and stats[2, repeats] == 0
    for texts in (["q w\ne"], ["", "q w\ne", ""]):  # a row's lines don't depend on the rows beside it
        one = line_quality.levels(pa.array(texts))
        assert one[0][one[2][len(texts) // 2] :][:2].tolist() == line_quality.levels(pa.array(["q w\ne"]))[0].tolist()


def corpus(rng, n):
    """Documents with good and bad lines; bad documents hold more bad lines, which stand together."""
    words = ["".join(rng.choices("abcdeou", k=rng.randint(2, 8))) for _ in range(200)]
    texts, labels, lines = [], [], []
    for _ in range(n):
        bad = rng.random() < 0.3
        of = []
        for _ in range(rng.randint(1, 6)):
            of += [bad and rng.random() < 0.8] * rng.randint(1, 4)
        line = lambda b: " ".join(w + ("%%#" if b and rng.random() < 0.7 else "") for w in rng.choices(words, k=rng.randint(1, 12)))
        texts.append("\n".join(line(b) for b in of))
        labels.append(int(sum(of) < len(of) / 2))
        lines.append(of)
    return texts, np.array(labels), lines


def test_field_finds_bad_lines_and_documents():
    rng = random.Random(8)
    texts, labels, _ = corpus(rng, 600)
    field = line_quality.fit(*line_quality.levels(pa.array(texts)), labels)
    held, truth, lines = corpus(rng, 400)
    score, good = field.score(*line_quality.levels(pa.array(held)))
    assert ((score >= 0.3) == (truth == 1)).mean() > 0.95
    assert ((good < 0.5) == np.concatenate(lines)).mean() > 0.9


def test_neighbours_decide_unclear_lines():
    """A line alone may be either; beside bad ones it is bad, and beside good ones good."""
    rng = random.Random(9)
    texts, labels, _ = corpus(rng, 600)
    field = line_quality.fit(*line_quality.levels(pa.array(texts)), labels)
    unclear = "abc deo"
    good = field.score(*line_quality.levels(pa.array([f"bac%%# deo%%#\n{unclear}\nabo%%# cod%%#", f"bac deo eu cad\n{unclear}\nabo cod ed oba"])))[1]
    assert good[1] < 0.5 < good[4]


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op12_quality_classifier(spark, sf)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and dict(got.dtypes)["predicted"] == "int"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    rows = got.join(labels, "doc_id", "left").collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    known = [r for r in rows if r.held_out and r.quality is not None]
    bad = [r for r in known if r.quality == 0]
    assert sum(r.predicted == r.quality for r in known) >= 0.95 * len(known) and sum(r.predicted == 0 for r in bad) >= 0.8 * len(bad)


def test_quality_of_odd_rows(spark):
    texts, labels, _ = corpus(random.Random(10), 120)
    docs = table(spark, [*texts, *ODD, "\n".join(["a b c"] * 30_000)])
    known = spark.createDataFrame([*((i, int(q), 0) for i, q in enumerate(labels, 1)), (1, 0, 1), (None, 1, 0), (2, None, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    field = line_quality.train(docs, known)
    rows = line_quality.judge(docs, field).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    score = {r.doc_id: r.score for r in rows}
    assert score[len(texts) + 1] == score[len(texts) + 2] and sum(r.doc_id == 1 for r in rows) == 2
    again = line_quality.judge(docs.repartition(7), line_quality.train(docs.repartition(7), known.repartition(3))).collect()
    assert {r.doc_id: r.score for r in again} == score  # however rows are dealt
    assert line_quality.judge(docs.limit(0), field).count() == 0
    for few in (known.limit(0), known.filter("quality = 1")):
        assert line_quality.train(docs, few) is None
    assert {r.score for r in line_quality.judge(docs, None).collect()} == {0.5}
    assert line_quality.train(docs.limit(0), known) is None
