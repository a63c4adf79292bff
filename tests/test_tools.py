import json

import pytest
from pyspark.sql import functions as F
from quarry.__main__ import main
from quarry.app import Index
from quarry.operators import formats, metrics, segment
from quarry.server import Server
from quarry.sources import records
from quarry.streaming.refresh import follow


@pytest.fixture
def tree(tmp_path, monkeypatch):
    (tmp_path / "a.py").write_text("def load():\n    pass\n\n\ndef save():\n    load()\n")
    monkeypatch.chdir(tmp_path)
    return tmp_path


def test_command_line_and_server(spark, tree, capsys):
    run = lambda *a: (main(list(a), spark), capsys.readouterr().out)[1]
    run("init")
    assert run("index") == "n_files: 1, n_chunks: 2, n_failed: 0\n"
    assert run("query", "save", "--format", "locator") == "a.py:5-6\n"
    assert run("query", "nothing") == "No results found.\n"
    assert json.loads(run("query", "save", "--format", "json"))["total_results"] == 1
    assert "python: 1" in run("status")
    assert "max_db_size_mb = 7" in run("config", "storage.max_db_size_mb", "7") and main(["config", "storage.max_db_size_mb"]) == 2
    with pytest.raises(SystemExit):
        main(["query", "x", "--weights", "1,2"])

    server = Server(Index(spark, f"{tree}/.quarry/index"), str(tree))
    ask = lambda method, **params: json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": params})
    tool = lambda name, **args: ask("tools/call", name=name, arguments=args)
    lines = [ask("initialize"), "{", '{"method": "note"}', ask("other"), tool("search"), tool("search", query="x", max_tokens=-1), tool("search", query="save", file_filter="[a"), tool("outline", path="a.py"), ask("tools/list")]
    got = [json.loads(line) for line in server.run(lines)]
    assert [g.get("error", {}).get("code") for g in got] == [None, -32700, -32601, -32602, -32602, -32602, None, None]
    assert got[6]["result"]["content"][0]["text"].splitlines()[1:3] == ["Found 2 symbols", "[1] load (function) a.py:1-3"[:-1] + "2"]
    assert [t["name"] for t in got[7]["result"]["tools"]] == ["search", "update", "outline"]


def test_stream(spark, tree, tmp_path_factory):
    index = Index(spark, str(tmp_path_factory.mktemp("i") / "index"))
    index.create()
    place = str(tmp_path_factory.mktemp("c"))
    for n, more in enumerate(["b.py", "c.go"]):
        (tree / more).write_text("def b():\n    pass\n" if n == 0 else "package c\nfunc C() {}\n")
        follow(index, str(tree), place).trigger(availableNow=True).start().awaitTermination()
        assert index.state()["total_files"] == str(2 + n)


def test_surfaced(spark):
    actions = spark.createDataFrame([("t", 0, "grep -rn def .", "./a.py:3:def f(x):\nb/c.py:1: class D:\n./a.py:3:def f(x):\nx.py: nothing"), ("t", 1, "cat b/c.py", "class D:\n  async def g(self):\n"), ("t", 2, None, None)], "task string, turn int, command string, observation string")
    repo = spark.createDataFrame([("t", "a.py"), ("t", "b/c.py"), ("u", "cat")], "task string, file_path string")
    got = {r.turn: (r.files, [tuple(b) for b in r.blocks]) for r in records.surfaced(actions, repo).collect()}
    assert got == {0: (["a.py", "b/c.py"], [("a.py", "f"), ("b/c.py", "D")]), 1: (["b/c.py"], [("b/c.py", "D"), ("b/c.py", "g")]), 2: ([], [])}


def test_trajectory_measures(spark):
    turns = spark.createDataFrame([("t", 0, 5, ["a", "b"]), ("t", 1, 7, ["b", "c"]), ("u", 0, 1, [])], "task string, turn int, tokens long, items array<string>")
    gold = spark.createDataFrame([("t", "c")], "task string, item string")
    assert [(r["rank"], r.item) for r in metrics.surfaced_lists(turns).orderBy("rank").collect()] == [(1, "a"), (2, "b"), (3, "c")]
    got = {(r.query_id, r.k): r for r in metrics.trajectories(turns, gold, [1, 5], 1.0).collect()}
    assert (got["t", 5].recall, got["t", 1].recall, got["t", 5].turn, got["t", 5].tokens) == (1.0, 0.0, 1, 12)
    assert (got["u", 1].recall, got["u", 1].turn) == (1.0, 0)


def test_report_and_segments(spark):
    configs = spark.createDataFrame([("flat", 1, "1,1", 10, 0.5, 0.75), ("default", 0, "10,1", 10, 0.5, 0.75)], "config string, ord int, weights string, k int, f1 double, ndcg double")
    arms = spark.createDataFrame([], "arm string, ord int, n_queries long, k int, f1 double, ndcg double")
    report = formats.ablation_report(configs, arms).first().output
    assert "| default | 10,1 | 0.5000 | 0.7500 |\n| flat |" in report and "_none_" in report and "**default** (0.7500); the default is the best: **yes**" in report
    best = metrics.best_config(configs, "ndcg").first()
    assert (best.config, best.agrees) == ("default", True)

    docs = spark.createDataFrame([(1, "aa a\nbb\n\ncccc\nd")], "row_id long, text string")
    assert [(r.start_line, r.end_line, r.start_byte, r.end_byte) for r in segment.by_size(docs, 4).orderBy("segment").collect()] == [(1, 2, 0, 8), (3, 4, 8, 14), (5, 5, 14, 15)]
    chunks = spark.createDataFrame([("c", "f", 1, "b\nc"), ("c", "f", 0, "é\n"), ("c", "g", 2, "")], "corpus_id string, file_path string, place int, chunk_text string")
    assert [(r.start_byte, r.end_byte, r.start_line, r.end_line) for r in segment.places(chunks).filter("file_path = 'f'").orderBy("place").collect()] == [(0, 3, 1, 1), (3, 6, 2, 3)]
    assert {r.file_path: r.text for r in segment.join_files(chunks).collect()} == {"f": "é\nb\nc", "g": ""}


def test_outline_takes_folders_in_either_case(spark):
    columns = spark.createDataFrame([("Src/a.py",), ("src/b.py",), ("SRC",), ("src",), ("srcs/c.py",)], "file_path string")
    found = columns.filter(formats.under(F.col("file_path"), "src"))
    assert {r.file_path for r in found.collect()} == {"Src/a.py", "src/b.py", "src"}


def test_patterns_in_texts_equal_brute_force(spark):
    import random

    rng = random.Random(3)
    word = lambda n: "".join(rng.choices("ab/.", k=n))
    texts = [(rng.choice("tu"), i, rng.choice([None, "", word(2), word(40), word(90)])) for i in range(60)]
    patterns = [(rng.choice(["t", "u", "v", None]), rng.choice([None, "", word(1), word(2), word(3), word(5), word(9)])) for _ in range(80)]
    got = records.contained(spark.createDataFrame(texts, "task string, id int, text string"), spark.createDataFrame(patterns, "task string, pattern string"))
    want = {(t, i, p) for t, i, text in texts for k, p in patterns if k == t and text is not None and p is not None and p in text}
    assert sorted(map(tuple, got.collect())) == sorted(want) and want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_results_of_many_queries_are_healed_at_once(spark, tmp_path):
    tree = tmp_path / "tree"
    tree.mkdir()
    for name in ("load", "save", "keep"):
        (tree / f"{name}.py").write_text(f"def {name}():\n    pass\n")
    index = Index(spark, str(tmp_path / "index"))
    index.create()
    index.index(str(tree))
    before = index.version
    texts = {0: "load", 1: "save", 2: "keep", 3: "nothing"}
    names = lambda packed: {(r.query_id, r.file_path, r.symbol_name) for r in packed.collect()}
    packed, asked, healed = index.search_healed(str(tree), texts)
    assert healed == {"files_checked": 3, "files_reindexed": 0, "files_dropped": 0} and len(names(packed)) == 3
    (tree / "load.py").write_text("def load_all():\n    pass\n")
    (tree / "save.py").unlink()
    packed, asked, healed = index.search_healed(str(tree), texts)
    assert healed == {"files_checked": 3, "files_reindexed": 1, "files_dropped": 1}
    assert names(packed) == {(0, "load.py", "load_all"), (2, "keep.py", "keep")}
    assert {r.query_id: r.found for r in asked.collect()} == {0: 1, 1: 0, 2: 1, 3: 0} and index.latest().changes > before - 1


@pytest.mark.parametrize(("few", "many"), [(5_000, 200_000), (1, 200_000), (1, 1)])
def test_patterns_are_found_without_a_shuffle_of_texts(spark, monkeypatch, few, many):
    monkeypatch.setattr(records, "FEW_TERMS", few)
    monkeypatch.setattr(records, "MANY_TERMS", many)
    texts = [("t", i, "\n".join("the same long words and " + "abcé😀z"[(i * j) % 6] for j in range(i))) for i in range(12)] + [("u", 1, "the same long words"), ("u", 2, None)]
    patterns = [("t", p) for p in ("the same long words", "words and a\nthe", "😀", "and é\nthe same", "ab", "", "same lon", "not there at all", None)] + [("u", "long words")]
    found = records.contained(spark.createDataFrame(texts, "task string, id int, text string"), spark.createDataFrame(patterns, "task string, pattern string"))
    want = {(k, i, p) for k, i, text in texts for j, p in patterns if j == k and text is not None and p is not None and p in text}
    got = [tuple(r) for r in found.collect()]
    assert set(got) == want and len(got) == len(want) and len(want) > 40
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = records.contained(spark.createDataFrame(texts, "task string, id int, text string"), spark.createDataFrame(patterns, "task string, pattern string"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert ("BroadcastHashJoin" in plan) == (many > 1)
