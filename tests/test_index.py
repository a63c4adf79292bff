"""The stored index against full scoring: blocks that are skipped, statistics by changes, merges, and writers side by side."""

import random

import pytest
from pyspark.sql import functions as F
from quarry.app import WEIGHTS, Index, Options, query_table
from quarry.operators import blocks, search
from quarry.sources import tables
from quarry.sources.tables import ConflictError, Log, Version

rng = random.Random(11)
WORDS = [f"w{i}" for i in range(40)]


def prose(n):
    return " ".join(rng.choices(WORDS, weights=[1 / (i + 1) for i in range(40)], k=n))


def chunks(spark, rows):
    """Rows (file_path, symbol_name, chunk_text) as chunks, several to a file in their order."""
    data = [(f, "python", name, None, None, i, i + 1, 1, 1, text, None, [], [], False) for i, (f, name, text) in enumerate(rows)]
    return spark.createDataFrame(data, tables.CHUNKS.removeprefix("row_id long, ").removesuffix(", doc_len long"))


def full(index, texts, weights=None):
    """(query_id, row_id) -> score, by scoring every posting of the chunks that count."""
    spark, own = index.spark, index.tables.chunks(index.version)
    plain = own.withColumns({c: F.array_join(c, "\n") for c in ("imports", "cross_references")})
    scores = search.bm25(search.postings(plain, list(WEIGHTS), positions=True), search.lengths(plain, list(WEIGHTS)), query_table(spark, texts), weights or list(WEIGHTS.values()))
    return {(r.query_id, r.row_id): r.score for r in scores.collect()}


def best(scores, k):
    out = {}
    for (q, row), s in scores.items():
        out.setdefault(q, []).append((round(s, 9), row))
    return {q: [row for _, row in sorted(rows)[:k]] for q, rows in out.items()}


def ranked(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.score, r.row_id)):
        out.setdefault(r.query_id, []).append(r.row_id)
    return out


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(blocks, "ROWS", 8)


@pytest.fixture
def index(spark, tmp_path):
    made = Index(spark, str(tmp_path / "index"))
    made.create()
    return made


TEXTS = {0: "w0 w1", 1: "w30 w2", 2: "w39", 3: "nowhere", 4: "w0_w1 w35", 5: "w1 w1 w33", 6: "w3_w0 w2_w2"}


def test_blocks_give_the_rows_of_full_scoring_and_skip_others(spark, index, small_blocks):
    strong = [(f"s{i}", WORDS[30 + i % 10], " ".join([WORDS[30 + i % 10]] * 9)) for i in range(12)]
    docs = [(f"f{i:03d}", prose(2), prose(rng.choice([5, 30, 90]))) for i in range(200)] + strong + [("empty", None, None), ("same", "w0", "w1"), ("same2", "w0", "w1")]
    index.put(chunks(spark, docs))
    plain = {q: t for q, t in TEXTS.items() if "_" not in t}
    scores = full(index, TEXTS)
    assert ranked(index.rank(query_table(spark, TEXTS), 6)[0]) == best(scores, 6)
    for k in (1, 500):
        found, work = index.rank(query_table(spark, plain), k, phrases=False)
        assert ranked(found) == best({p: s for p, s in scores.items() if p[0] in plain}, k)
        done = {r.query_id: (r.blocks, r.scored) for r in work.collect()}
        assert all(scored <= n if k == 1 else scored == n for n, scored in done.values())
        if k == 1:
            assert sum(n for n, _ in done.values()) > sum(s for _, s in done.values()) and done[2][1] < done[2][0]
    for weights in ([0.0, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0], [-1.0, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0]):
        assert ranked(index.rank(query_table(spark, plain), 7, weights, phrases=False)[0]) == best(full(index, plain, weights), 7)


def test_changes_keep_statistics_and_results(spark, index, small_blocks, monkeypatch):
    monkeypatch.setattr("quarry.app.FAN", 100)  # no merge yet
    state = {f"f{i:02d}": [(prose(2), prose(20)) for _ in range(rng.randint(1, 4))] for i in range(30)}

    def put(paths, gone=()):
        rows = [(f, *c) for f in paths for c in state[f]]
        index.put(chunks(spark, rows), spark.createDataFrame([(g,) for g in gone], "file_path string"))
        for g in gone:
            state.pop(g, None)

    def check():
        last = index.latest()
        own = index.tables.chunks(last)
        assert sorted((r.file_path, r.symbol_name, r.chunk_text) for r in own.collect()) == sorted((f, *c) for f, cs in state.items() for c in cs)
        assert (last.n_rows, last.n_tokens) == tuple(own.agg(F.count("*"), F.sum("doc_len")).first())
        df = {r.term: r.df for r in index.tables.rows("terms", last).groupBy("term").agg(F.sum("df").alias("df")).filter("df <> 0").collect()}
        fresh = search.postings(own.withColumns({c: F.array_join(c, "\n") for c in ("imports", "cross_references")}), list(WEIGHTS))
        assert df == {r.term: r.df for r in fresh.groupBy("term").agg(F.countDistinct("row_id").alias("df")).collect()}
        some = {q: TEXTS[q] for q in (0, 2, 5)}
        assert ranked(index.rank(query_table(spark, some), 6, phrases=False)[0]) == best(full(index, some), 6)

    put(list(state))
    for step in range(2):
        some = rng.sample(sorted(state), 5)
        for f in some:
            state[f] = [(prose(2), prose(15)) for _ in range(rng.randint(1, 4))]
        state[f"new{step}"] = [("w39", prose(8))]
        put([*some, f"new{step}"], [f for f in rng.sample(sorted(state), 3) if f not in some and not f.startswith("new")])
    check()
    before = {r.file_path: r.chunk_count for r in index.files().collect()}
    assert before == {f: len(cs) for f, cs in state.items()} and index.state()["total_chunks"] == str(sum(before.values()))

    # the newest segments are merged, then all; each time nothing else changes
    monkeypatch.setattr("quarry.app.FAN", 2)
    old = index.latest()
    parts = [s.name for s in old.segments]
    monkeypatch.setattr(tables.Segment, "n_rows", property(lambda s: s.__dict__["n_rows"] if s.name != parts[0] else 10**9, lambda s, v: s.__dict__.__setitem__("n_rows", v)), raising=False)
    assert index.compact()
    assert [s.name for s in index.latest().segments][0] == parts[0] and len(index.latest().segments) == 2
    check()
    monkeypatch.undo()
    monkeypatch.setattr(blocks, "ROWS", 8)
    assert index.compact(whole=True) and not index.compact(whole=True)
    last = index.latest()
    assert [s.tables for s in last.segments] == [["chunks", "postings", "terms"]] and last.segments[0].n_rows == last.n_rows
    assert index.tables.rows("chunks", last).count() == last.n_rows  # deleted rows are gone from the files
    check()
    # a reader of an older version still sees it, until it is removed
    assert index.tables.chunks(old).count() == old.n_rows
    assert index.tables.clean() > 0 and index.tables.numbers() == [last.number] and index.tables.clean() == 0
    check()


def test_merges_keep_up_by_themselves(spark, index):
    for i in range(5):
        index.put(chunks(spark, [(f"f{i}", "w0", prose(5))]))
    assert len(index.latest().segments) < 5 and index.latest().n_rows == 5
    assert index.latest().changes == 5 and index.latest().number == 7


def test_scores_read_no_chunks(spark, index):
    index.put(chunks(spark, [(f"f{i}", "w0", prose(9)) for i in range(20)]))
    found, work = index.rank(query_table(spark, TEXTS), 3)
    for df in (found, work):
        assert df.inputFiles() and not any("/chunks/" in f for f in df.inputFiles())
    packed, asked = index.search({0: "w0", 1: "nowhere"}, Options(max_results=3))
    assert packed.count() == 3 and {r.query_id: r.found for r in asked.collect()} == {0: 3, 1: 0}
    plan = packed._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(row_id" in plan or "PushedFilters: [IsNotNull(row_id), In(row_id" in plan or "In(row_id" in plan


@pytest.mark.parametrize("linked", [{"file"}, set()])
def test_a_version_is_published_once(spark, tmp_path, monkeypatch, linked):
    monkeypatch.setattr(tables, "LINKED", linked)
    log = Log(spark, str(tmp_path / "log"))
    assert log.names() == [] and log.put("1.json", "a") and not log.put("1.json", "b") and log.put("2.json", "é")
    assert log.read("1.json") == "a" and log.read("2.json") == "é" and [n for n in log.names() if not n.startswith(".")] == ["1.json", "2.json"]


def test_writers_side_by_side(spark, index, monkeypatch):
    index.put(chunks(spark, [("a", "w0", "w1"), ("b", "w0", "w2")]))
    other, once = Index(spark, index.tables.root), []

    def late(publish):
        def run(self, version):
            if not once:
                once.append(1)
                action()
            return publish(self, version)

        return run

    plain = tables.Tables.publish
    monkeypatch.setattr(tables.Tables, "publish", late(plain))
    # rows of another writer come first: this one's are taken back, and can be put again
    action = lambda: other.put(chunks(spark, [("c", "w0", "w3")]))
    with pytest.raises(ConflictError):
        index.put(chunks(spark, [("d", "w0", "w4")]))
    assert {r.file_path for r in index.files().collect()} == {"a", "b", "c"}
    index.put(chunks(spark, [("d", "w0", "w4")]))
    # a merge of another writer comes first: rows are put on top of it
    once.clear()
    action = lambda: other.compact(whole=True)
    index.put(chunks(spark, [("a", "w0", "w9 w9")]))
    assert sorted((r.file_path, r.chunk_text) for r in index.tables.chunks(index.version).collect()) == [("a", "w9 w9"), ("b", "w2"), ("c", "w3"), ("d", "w4")]
    # rows come while segments are merged: both count
    once.clear()
    action = lambda: other.put(chunks(spark, [("b", "w0", "w8")]))
    assert index.compact(whole=True)
    assert sorted((r.file_path, r.chunk_text) for r in index.tables.chunks(index.version).collect()) == [("a", "w9 w9"), ("b", "w8"), ("c", "w3"), ("d", "w4")]
    assert index.latest().n_rows == 4 and ranked(index.rank(query_table(spark, {0: "w8", 1: "w2"}), 5)[0]).keys() == {0}


def test_a_run_that_ends_early_leaves_the_version(spark, index, monkeypatch):
    index.put(chunks(spark, [("a", "w0", "w1")]))
    before = index.latest()

    def fail(self, version):
        raise OSError("lost")

    monkeypatch.setattr(tables.Tables, "publish", fail)
    with pytest.raises(OSError, match="lost"):
        index.put(chunks(spark, [("a", "w0", "w2")]))
    monkeypatch.undo()
    assert index.latest() == before and [r.chunk_text for r in index.tables.chunks(index.version).collect()] == ["w1"]
    assert isinstance(before, Version) and index.put(chunks(spark, [("a", "w0", "w2")])) == {"n_files": 1, "n_chunks": 1}


def test_bitmaps_mark_rows(spark):
    ids = [1, 8, 9, 32768, 32769, (1 << 33) + 5]
    marks = blocks.bitmaps(spark.createDataFrame([(i,) for i in ids], "row_id long")).unionByName(blocks.bitmaps(spark.createDataFrame([(7,)], "row_id long")))
    rows = spark.createDataFrame([(i + d, d) for i in ids for d in (-1, 0, 1)], "row_id long, d int").filter("row_id > 0")
    assert sorted({r.row_id for r in blocks.live(rows, marks).collect()}) == sorted({i + d for i in ids for d in (-1, 0, 1)} - {*ids, 7, 0})


def test_postings_are_made_where_rows_lie_and_blocks_in_parts_change_nothing(spark, index, small_blocks, monkeypatch):
    monkeypatch.setattr(blocks, "TOKENS", 50)  # blocks come in several parts
    index.put(chunks(spark, [(f"f{i:02d}", prose(2), prose(rng.choice([5, 30, 90]))) for i in range(60)] + [("none", None, None)]))
    index.put(chunks(spark, [("f07", "w0", prose(9))]), spark.createDataFrame([("f11",), ("f12",)], "file_path string"))
    last = index.latest()
    rows = index.tables.rows("postings", last)
    assert rows.groupBy("term", "block").count().filter("count > 1").count() > 0
    made = blocks.postings(index.tables.rows("chunks", last).withColumns({c: F.array_join(c, "\n") for c in ("imports", "cross_references")}), list(WEIGHTS))
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    plain = {q: t for q, t in TEXTS.items() if "_" not in t}
    scores = full(index, TEXTS)
    near = index.rank(query_table(spark, plain), 6, phrases=False)[0]
    assert ranked(near) == best({p: s for p, s in scores.items() if p[0] in plain}, 6)
    assert "Generate" not in near._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]  # no row of a (query, row) pair is made for all
    assert ranked(index.rank(query_table(spark, TEXTS), 6)[0]) == best(scores, 6)
    monkeypatch.setattr(blocks, "FEW_TERMS", 0)
    assert ranked(index.rank(query_table(spark, plain), 6, phrases=False)[0]) == ranked(near)
