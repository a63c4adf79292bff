"""Spans, places and arms against brute force."""

import random
import time

import pytest
from pyspark.sql import functions as F
from quarry.operators import intervals, search, segment

rng = random.Random(21)


@pytest.mark.parametrize("width", [7, 64, 1 << 16])
def test_innermost_spans_equal_brute_force(spark, width):
    spans = [(rng.choice(["f", "g", None]), s := rng.randrange(200), s + rng.choice([-1, 0, 1, 5, 40, 150]), f"s{i % 90}", "x") for i in range(150)] + [("hot", 0, 10_000, "all", "x")]
    points = [(rng.choice(["f", "g", "h", None]), rng.choice([None, *range(210)]), i % 50, "clash") for i in range(300)] + [("hot", rng.randrange(12_000), i, "clash") for i in range(100)]
    got = intervals.containing(spark.createDataFrame(points, "file_path string, at long, bin int, row string"), spark.createDataFrame(spans, "file_path string, start long, end long, id string, extra string"), width=width)
    assert got.columns == ["file_path", "at", "bin", "row", "span_start", "span_end", "span_id"]
    want = []
    for f, at, *more in points:
        inside = [(-s, e, i) for g, s, e, i, _ in spans if f is not None and at is not None and g == f and s <= at < e]
        best = min(inside, default=None)
        want.append((f, at, *more, *((-best[0], *best[1:]) if best else (None,) * 3)))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_containment_makes_no_pairs(spark):
    """Many points in many spans of one file: the plan has no join, and a bin's rows are all that a task sweeps."""
    spans = spark.range(2000).select(F.lit("f").alias("file_path"), F.col("id").alias("start"), (4000 - F.col("id")).alias("end"), F.col("id"))
    points = spark.range(4000).select(F.lit("f").alias("file_path"), F.col("id").alias("at"))
    got = intervals.containing(points, spans, width=100)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert {(r["at"], r.span_id) for r in got.collect()} == {(i, min(i, 3999 - i)) for i in range(4000)}
    assert intervals.containing(points.limit(0), spans).count() == 0 and intervals.containing(points, spans.limit(0)).filter("span_id is not null").count() == 0


def greedy(spans):
    kept, out = [], []
    for s, e in spans:
        stays = not any((s, e) == k or k[0] < s < k[1] < e or s < k[0] < e < k[1] for k in kept)
        kept += [(s, e)] * stays
        out.append(stays)
    return out


def test_kept_spans_equal_brute_force():
    for _ in range(400):
        size = rng.choice([4, 12, 60])
        spans = [(s, s + rng.randrange(size)) for s in (rng.randrange(size) for _ in range(rng.randrange(25)))]
        assert intervals.best_first([s for s, _ in spans], [e for _, e in spans]) == greedy(spans)


def test_overlaps_of_long_lists(spark):
    spans = [(q, f, s, s + rng.choice([0, 1, 9, 30]), i, "x") for i, (q, f, s) in enumerate((rng.choice([1, 2]), rng.choice("fg"), rng.randrange(300)) for _ in range(500))]
    rows = [(*x[:4], rank, *x[4:]) for x, rank in zip(spans, rng.sample(range(500), 500), strict=True)] + [(1, "f", None, 3, 600, 600, "x"), (2, None, 0, 3, 601, 601, "x")]
    table = spark.createDataFrame(rows, "query_id long, file_path string, start_byte long, end_byte long, rank int, row_id long, island string").drop("island")
    got = {r.row_id for r in intervals.drop_overlaps(table).collect()}
    want = {600, 601}
    for q in (1, 2):
        for f in "fg":
            own = sorted((r for r in rows[:500] if r[:2] == (q, f)), key=lambda r: r[4])
            want |= {r[5] for r, stays in zip(own, greedy([r[2:4] for r in own]), strict=True) if stays}
    assert got == want and intervals.drop_overlaps(table.limit(0)).count() == 0
    # the same as the fold of a bounded list
    assert {r.row_id for r in search.drop_overlaps(table.filter("row_id < 100")).collect()} == {r.row_id for r in intervals.drop_overlaps(table.filter("row_id < 100")).collect()}
    began = time.time()
    starts = [rng.randrange(100_000) for _ in range(20_000)]
    intervals.best_first(starts, [s + 700 for s in starts])
    assert time.time() - began < 10


def test_chunks_are_found_in_order(spark):
    texts = {"a": "é one\none two\n\none\nend", "b": "", "c": None, "d": "x\ny\n"}
    chunks = [("a", 0, "one", 1), ("a", 1, "one", 2), ("a", 2, "missing", 2), ("a", 3, "one", 4), ("a", 4, None, 4), ("a", 5, "é", 9), ("a", 6, "end", 5), ("b", 0, "x", 1), ("b", 1, "", None), ("c", 0, "x", 3), ("d", 0, "y", 1), ("d", 1, "x", 1), ("z", 0, "x", 1)]
    want = {}
    for f, place, own, line in chunks:
        if f not in texts:
            want[f, place] = (None,) * 3
            continue
        data, own = (texts[f] or "").encode(), (own or "").encode()
        at = data.find(own, cursor if place else 0)
        starts = [0, *(i + 1 for i, b in enumerate(data) if b == 10)]
        start = at if at >= 0 else starts[line - 1] if line and line <= len(starts) else len(data)
        cursor = start + len(own)
        want[f, place] = (start, cursor, at >= 0)
    files = spark.createDataFrame(list(texts.items()), "file_path string, text string")
    got = segment.align(spark.createDataFrame([(*c, "t", 7) for c in chunks], "file_path string, place int, chunk_text string, start_line int, text string, end_byte int"), files)
    assert {(r.file_path, r.place): (r.start_byte, r.end_byte, r.verbatim) for r in got.collect()} == want
    assert got.columns == ["file_path", "place", "chunk_text", "start_line", "text", "start_byte", "end_byte", "verbatim"]
    assert segment.align(spark.createDataFrame([], "file_path string, place int, chunk_text string, start_line int"), files).count() == 0


def test_each_arm_scores_as_an_index_of_its_own(spark):
    words = [f"w{i}" for i in range(12)]
    rows = [(a, i, " ".join(rng.choices(words, k=rng.randrange(1, 30)))) for a, n in (("x", 30), ("y", 9), ("z", 1)) for i in range(n)]
    table = spark.createDataFrame(rows, "arm string, row_id long, text string")
    asked = spark.createDataFrame([(0, "w1", 0), (0, "w2", 1), (1, "w9", 0), (1, "w9", 1), (2, "no", 0)], "query_id long, term string, pos int")
    got = search.bm25_arms(search.postings(table, ["text"], queries=asked, by=("arm",)), search.lengths(table, ["text"], ("arm",)), asked, [2.0])
    got = {(r.arm, r.query_id, r.row_id): r.score for r in got.collect()}
    want = {}
    for arm in "xyz":
        own = table.filter(F.col("arm") == arm).drop("arm")
        for r in search.bm25(search.postings(own, ["text"]), search.lengths(own, ["text"]), asked, [2.0]).collect():
            want[arm, r.query_id, r.row_id] = r.score
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)

    ranked = spark.createDataFrame([("x", 0, 1, 5), ("y", 0, 1, 6), ("y", 0, 2, 5)], "arm string, query_id long, rank int, item long")
    gold, queries = spark.createDataFrame([(0, 5)], "query_id long, item long"), spark.createDataFrame([(0,), (1,)], "query_id long")
    table = {(r.arm, r.k): (r.n_queries, r.recall) for r in search.side_by_side(ranked, gold, queries, ["x", "y", "z"], [1, 2]).collect()}
    assert table == {("x", 1): (2, 1.0), ("x", 2): (2, 1.0), ("y", 1): (2, 0.5), ("y", 2): (2, 1.0), ("z", 1): (2, 0.5), ("z", 2): (2, 0.5)}


@pytest.mark.parametrize("few", [0, 5_000])
def test_words_are_filtered_within_rows_or_joined(spark, monkeypatch, few):
    monkeypatch.setattr(search, "FEW_TERMS", few)
    rows = spark.createDataFrame([(1, "a b a c", "b"), (2, None, "c c"), (3, "", "x")], "row_id long, t string, u string")
    asked = spark.createDataFrame([(0, "a", 0), (0, "c", 1)], "query_id long, term string, pos int")
    got = search.postings(rows, ["t", "u"], positions=True, queries=asked)
    assert sorted((r.term, r.row_id, r.col_id, r.tf, r.positions, r.doc_len) for r in got.collect()) == [("a", 1, 0, 2, [0, 2], 5), ("c", 1, 0, 1, [3], 5), ("c", 2, 1, 2, [0, 1], 2)]
    assert search.postings(rows, ["t", "u"], queries=asked).count() == 3


def test_small_lists_are_taken_in_batches(spark):
    rows = [(q, (i * 7919) % 1009, f"/{f}", i * 5 % 90, i * 5 % 90 + 3 + i % 17, i) for q in range(5) for f in range(40) for i in range(q * 30)]
    ranked = spark.createDataFrame(rows, "query_id int, rank int, file_path string, start_byte long, end_byte long, row_id int")
    want = set()
    for q, f in {(r[0], r[2]) for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[0] == q and r[2] == f), key=lambda r: (r[1], r[3], r[4])):
            if not any((a, b) == r[3:5] or a < r[3] < b < r[4] or r[3] < a < r[4] < b for a, b in kept):
                kept.append(r[3:5])
                want.add(r)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        found = intervals.drop_overlaps(ranked)
        assert {tuple(r) for r in found.collect()} == want
        assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_words_of_queries_bring_no_rows_of_a_word_to_one_task(spark):
    chunks = spark.createDataFrame([(i, "a b c a b", "b c") for i in range(30)], "row_id long, t string, u string")
    asked = spark.createDataFrame([(0, "a", 0, 0, 2), (0, "b", 0, 1, 2), (0, "c", 1, 0, 1)], "query_id long, term string, pos int, offset int, size int")
    scores = search.bm25(search.postings(chunks, ["t", "u"], positions=True), search.lengths(chunks, ["t", "u"]), asked)
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [term" not in plan and "SortMergeJoin [query_id" not in plan
    assert scores.count() == 30 and len({r.score for r in scores.collect()}) == 1
