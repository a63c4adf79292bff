import json

import pytest
from quarry import config
from quarry.app import NO_HASH, Index, Options
from quarry.operators import formats
from quarry.sources import records
from quarry.sources.tables import StoreError

A = '"""Doc of a."""\nimport os\n\n\ndef authenticate_user(name):\n    return load(name)\n\n\nclass Store:\n    def save(self):\n        pass\n'


def rows(results):
    return [(r.file_path, r.symbol_name) for r in results.orderBy("rank").collect()]


@pytest.fixture
def place(tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text(A)
    (tmp_path / "src/b.go").write_text("package b\n\nfunc Authenticate() {}\n\nfunc User() {}\n")
    return tmp_path


def test_life_of_an_index(spark, place, tmp_path):
    root, index = str(place / "src"), Index(spark, str(tmp_path / "index"))
    with pytest.raises(StoreError):
        index.state()
    index.create()
    index.create()
    assert rows(index.search({0: "save"})[0]) == []
    assert index.index(root) == {"n_files": 2, "n_chunks": 5, "n_failed": 0}
    assert index.index(root) == {"n_files": 0, "n_chunks": 0, "n_failed": 0}
    state, languages = index.status()
    assert (state["total_files"], state["total_chunks"]) == ("2", "5") and [tuple(r) for r in languages.collect()] == [("go", 1), ("python", 1)]
    # a word with _ is a phrase
    assert rows(index.search({0: "authenticate_user"})[0]) == [("a.py", "authenticate_user")]
    assert set(rows(index.search({0: "authenticate user"})[0])) >= {("a.py", "authenticate_user"), ("b.go", "User")}
    assert set(rows(index.search({0: "authenticate user"}, Options(file_filter=["*.go"]))[0])) == {("b.go", "Authenticate"), ("b.go", "User")}
    packed, asked = index.search({0: "save", 1: "the", 2: "nothere"})
    assert {(r.query_id, r.found) for r in asked.collect()} == {(0, 2), (1, 0), (2, 0)}
    assert "Store.save (method) a.py:10-11" in formats.as_text(packed, asked).filter("query_id = 0").first().output
    with pytest.raises(ValueError):
        index.search({0: "save"}, Options(weights=[1.0]))

    # a change, a broken file, a new one: only they are cut; the broken one keeps its rows
    (place / "src/a.py").write_text(A + "\n\ndef later():\n    pass\n")
    (place / "src/b.go").write_bytes(b"\xff\xfe")
    (place / "src/c.ts").write_text("function save() {}\n")
    assert index.index(root) == {"n_files": 2, "n_chunks": 5, "n_failed": 1}
    assert rows(index.search({0: "later"})[0]) == [("a.py", "later")] and rows(index.search({0: "Authenticate"})[0])[0][0] in ("a.py", "b.go")
    assert index.tables.chunks(index.version).count() == 7

    # a search sees what changed since; what is gone goes
    (place / "src/c.ts").unlink()
    (place / "src/a.py").write_text("def save_all():\n    pass\n")
    packed, _, healed = index.search_fresh(root, "save")
    assert rows(packed) == [("a.py", "save_all")]
    assert healed == {"files_checked": 2, "files_reindexed": 1, "files_dropped": 1}
    assert [r.line for r in index.outline("a.py").orderBy("line_no").collect()] == ['Path: "a.py"', "Found 1 symbols", "[1] save_all (function) a.py:1-2"]
    assert index.update(root, ["a.py", "gone.py"], force=True)["n_files"] == 1
    assert index.index(root, force=True) == {"n_files": 1, "n_chunks": 1, "n_failed": 1}


def chunk(**more):
    return {"symbol_name": "f", "symbol_type": "function", "file_path": "x.py", "start_byte": 0, "end_byte": 3, "start_line": 1, "end_line": 1, "chunk_text": "def f", "language": "python"} | more


def test_ingest(spark, tmp_path):
    index = Index(spark, str(tmp_path / "index"))
    index.create()
    source = tmp_path / "chunks.json"
    source.write_text(json.dumps([chunk(), chunk(symbol_name="g", extra=1), chunk(file_path="y.go", language="go", imports=["a", "b"])]))
    assert index.ingest(str(source)) == {"n_files": 2, "n_chunks": 3}
    assert index.ingest(str(source)) == {"n_files": 2, "n_chunks": 3}
    assert [r.symbol_name for r in index.tables.chunks(index.version).orderBy("row_id").collect()] == ["f", "g", "f"] * 2
    assert {r.hash for r in index.files().collect()} == {NO_HASH}
    source.write_text("[]")
    assert index.ingest(str(source)) == {"n_files": 0, "n_chunks": 0} and index.state()["total_chunks"] == "0"
    version = index.version
    missing = chunk()
    del missing["chunk_text"]
    for bad in (json.dumps([missing]), json.dumps([chunk(symbol_type="macro")]), json.dumps([chunk(language="cobol")]), json.dumps([chunk(start_byte="a")]), "[{", None):
        path = tmp_path / "none.json" if bad is None else source
        if bad is not None:
            source.write_text(bad)
        with pytest.raises(records.IngestError):
            index.ingest(str(path))
    assert index.version == version


def test_settings():
    plain = config.Config()
    assert config.parse(config.dump(plain)) == plain
    assert config.parse('languages = ["go"]\nother = 1\n[retrieval]\nbm25_b = 1').languages == ["go"]
    for bad in ("languages = [", 'languages = ["cobol"]', "version = 1", "storage = 3", '[storage]\nmax_db_size_mb = "a"'):
        with pytest.raises(config.ConfigError):
            config.parse(bad)


def test_records(spark, tmp_path):
    values = [None, "", "null", "[", '{"file": "a"}', '[1, null, "x", {"file": 3}, {"file": ""}, {"file": "b.py", "start_line": 2, "end_line": 5}, {"file": "a.py"}, {"file": "b.py", "start_line": 2, "end_line": 5}]']
    raw = spark.createDataFrame([(str(i), "r", "q", v) for i, v in enumerate(values)], "instance_id string, repo string, problem_statement string, gold_context string")
    got = {r.query_id: r for r in records.benchmark_queries(raw).collect()}
    assert all(got[str(i)].gold_blocks == [] for i in range(5))
    assert [tuple(b) for b in got["5"].gold_blocks] == [("a.py", "a.py::L0-L0"), ("b.py", "b.py::L2-L5")] and got["5"].gold_files == ["a.py", "b.py"]

    tasks = spark.createDataFrame([(f"i{i}", f"r{i % 4}", "go" if i == 0 else "python") for i in range(12)], "instance_id string, repo string, language string")
    assert [(r.repo, r.instance_id) for r in records.select_tasks(tasks, 2, 4).collect()] == [("r0", "i4"), ("r0", "i8"), ("r1", "i1"), ("r1", "i5")]

    suite = {"corpora": [{"id": "c", "chunks": [chunk(), chunk(chunk_text="é")], "queries": [{"id": "q", "query": "f", "gold_files": ["x.py"], "gold_blocks": [{"file_path": "x.py", "symbol_name": "f"}]}]}]}
    (tmp_path / "suite.json").write_text(json.dumps(suite, indent=1))
    chunks, queries = records.read_suite(spark, str(tmp_path / "suite.json"))
    assert [(r.start_byte, r.end_byte) for r in chunks.orderBy("place").collect()] == [(0, 5), (10000, 10002)]
    assert [(r.corpus_id, r.query_id, r.query_type, r.gold_blocks[0].symbol_name) for r in queries.collect()] == [("c", "q", "keyword", "f")]

    turn = {"record": "turn", "turn": 0, "files_surfaced": ["a"], "blocks_surfaced": [["a", "f"]], "prompt_tokens": 3, "completion_tokens": 1}
    (tmp_path / "t").mkdir()
    (tmp_path / "t/one.jsonl").write_text("\n".join(map(json.dumps, [{"record": "meta", "arm": "x", "task_id": "t"}, turn])))
    meta, turns = records.read_trajectories(spark, str(tmp_path / "t"))
    assert meta.count() == 1 and turns.first().blocks_surfaced == [["a", "f"]]
    (tmp_path / "t/two.jsonl").write_text(json.dumps(turn))
    with pytest.raises(Exception, match="no meta line"):
        records.read_trajectories(spark, str(tmp_path / "t"))[1].collect()


def test_dumped_chunks_are_read_again(spark, tmp_path):
    rows = [chunk(symbol_name=f"f{i}", chunk_text='a "}" \\ [\né' * i, imports=["x"] * (i % 3)) for i in range(12)]
    source = tmp_path / "in.json"
    source.write_text(json.dumps(rows))
    first = records.read_chunks(spark, str(source))
    records.dump_chunks(first.repartition(3), str(tmp_path / "out"))
    again = records.read_chunks(spark, str(tmp_path / "out"))
    names = [c for c in first.columns if c != "place"]
    assert sorted(map(str, again.select(names).collect())) == sorted(map(str, first.select(names).collect())) and first.count() == 12
    records.dump_chunks(first.limit(0), str(tmp_path / "none"))
    assert records.read_chunks(spark, str(tmp_path / "none")).count() == 0
    suite = spark.createDataFrame([("c", 1)], "corpus_id string, place int")
    assert records.corpus(suite, "c").count() == 1
    with pytest.raises(KeyError):
        records.corpus(suite, "d")
