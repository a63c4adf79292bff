import json
import os

import pytest
import xxhash
from pyspark.sql import functions as F
from quarry.functions.hashes import content_hash, file_hash
from quarry.operators import code, formats, index, metrics, search
from quarry.sources import files

PY = b'''"""Doc."""
import os
from a import (b,
    c)


class A(Base):
    @wraps(x)
    def f(self):
        def inner():
            pass
        load(inner())
        load(1)
        self.other()


async def \xc3\xa9t\xc3\xa9():
    pass
'''
GO = b'''package main

// func no() {}
type S struct { a int }
type (
	T struct { f func() }
	U struct {}
)
func (s *S) Get(k string) (interface{}, error) {
	x := "}"
	return x, nil
}
func (g *G[K]) Put() {}
func (g G[K]) Len() int { return 0 }
func main() {}
'''


TS = b"""import x from 'y';
interface I { a(): void }
type T = { b: number };
export function one<T>(a: { k: T }): { r: T } {
  return { r: a.k }; // }
}
declare function no(a: string): void;
export const two = async (a: number): Promise<number> => a + f({ b: 1 });
const three = (x) => {
  const inner = y => y;
};
const plain = 5, s = "class Z {";
export class C extends B {
  field = make(1);
  private handler: () => void;
  constructor(private a: string) { super(a); }
  static async get(k: string): Promise<{ v: string }> {
    if (k) { go(k) }
    return { v: `}` };
  }
}
"""


def test_typescript_symbols():
    rows = code.typescript_symbols(TS)
    assert _names(rows) == [("one", "function", None), ("two", "function", None), ("three", "function", None), ("inner", "function", "three"), ("C", "class", None), ("constructor", "method", "C"), ("get", "method", "C")]
    text = {r["symbol_name"]: r["chunk_text"] for r in rows}
    assert text["two"] == "two = async (a: number): Promise<number> => a + f({ b: 1 })" and text["inner"] == "inner = y => y"
    assert text["one"].startswith("function one") and text["one"].endswith("// }\n}\n") and text["get"].startswith("static async get") and text["get"].endswith("`}` };\n  }\n")
    assert code.typescript_symbols(b"") == []
    assert _names(code.typescript_symbols(b"class A { f( {")) == [("A", "class", None)]


def _names(rows):
    return [(r["symbol_name"], r["symbol_type"], r["parent_symbol"]) for r in rows]


def test_python_symbols():
    rows = code.python_symbols(PY)
    assert _names(rows) == [("A", "class", None), ("f", "method", "A"), ("inner", "function", "f"), ("été", "function", None)]
    f = rows[1]
    assert f["chunk_text"].startswith("@wraps(x)\n") and f["cross_references"] == ["wraps", "load", "inner"]
    assert all(PY[r["start_byte"] : r["end_byte"]].decode() == r["chunk_text"] and r["chunk_text"].endswith("\n") for r in rows)
    assert f["file_docstring"] == "Doc." and f["imports"] == ["import os", "from a import (b,\n    c)"]
    assert (rows[0]["start_line"], rows[0]["end_line"]) == (7, 14)


def test_rejected_python_falls_back_to_lines():
    rows = code.python_symbols(b"x = (\ndef f(:\r\n  pass\nclass B:\n  pass")
    assert [(r["symbol_name"], r["symbol_type"], r["start_byte"], r["end_byte"], r["start_line"], r["end_line"], r["is_heuristic"]) for r in rows] == [("f", "function", 6, 22, 2, 3, True), ("B", "class", 22, 37, 4, 5, True)]
    assert code.python_symbols(b"# nothing") == []


def test_go_symbols():
    rows = code.go_symbols(GO)
    assert _names(rows) == [("S", "struct", None), ("T", "struct", None), ("Get", "method", "S"), ("Put", "method", None), ("Len", "method", "G[K]"), ("main", "function", None)]
    assert rows[2]["chunk_text"].endswith("return x, nil\n}\n") and rows[1]["chunk_text"].endswith("U struct {}\n)\n")


@pytest.mark.parametrize("path,patterns,want", [
    ("node_modules/a.py", files.DEFAULT_IGNORES, True), ("src/build/x.go", files.DEFAULT_IGNORES, True), ("builder/x.go", files.DEFAULT_IGNORES, False),
    ("a/b_generated.py", ["*_generated.py"], True), ("a/vendor/x.go", ["/vendor/**"], False), ("vendor/y/x.go", ["vendor/**"], True),
    ("a/keep.py", ["a/*", "!a/keep.py"], False), ("a/keep.py", ["!a/keep.py", "a/*"], True), ("x.py", ["# x.py", ""], False),
])
def test_ignores(spark, path, patterns, want):
    assert spark.range(1).select(files.ignored(F.lit(path), patterns).alias("i")).first().i is want


def test_scan_symbols_and_hashes(spark, tmp_path):
    for name, data in {"a.py": PY, "sub/m.go": GO, "bad.py": b"\xff\xfe", "env/x.py": b"def f(): pass", "t.txt": b"x", "empty.ts": b""}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
        os.utime(tmp_path / name, (1000, 1000))
    rows = {r.file_path: r for r in files.scan(spark, str(tmp_path)).collect()}
    assert rows.keys() == {"a.py", "sub/m.go", "bad.py", "empty.ts"} and rows["empty.ts"].text == "" and rows["empty.ts"].error is None
    assert rows["bad.py"].error == "not UTF-8" and rows["bad.py"].text is None and rows["a.py"].error is None
    assert rows["a.py"].hash == xxhash.xxh3_128_hexdigest(PY + (1000).to_bytes(8, "little")) and rows["a.py"].language == "python"
    found = code.symbols(files.scan(spark, str(tmp_path))).groupBy("file_path").count().collect()
    assert {tuple(r) for r in found} == {("a.py", 4), ("sub/m.go", 6)}


TREE = {
    ".gitignore": "*.go\n!keep.go\n/out/\n# x\n\\#odd.py\ntrail.py  \n", "pkg/.gitignore": "gen_*\n!up.go\ndeep/**/z.py\n", "pkg/.ignore": "!gen_back.py\n",
    "pkg/__init__.py": "", "_own.py": "x", ".hidden.py": "x", ".cfg/a.py": "x", "a.go": "x", "keep.go": "x", "pkg/up.go": "x", "pkg/sub/b.go": "x",
    "out/a.py": "x", "pkg/out/a.py": "x", "#odd.py": "x", "trail.py": "x", "pkg/gen_a.py": "x", "pkg/gen_back.py": "x", "gen_a.py": "x", "pkg/deep/p/q/z.py": "x", "pkg/deep/z.py": "x",
    "other/.gitignore": "*\n!*.ts\n", "other/a.ts": "x", "other/b.py": "x", "other/sub/a.ts": "x", "pkg/sub/\u00e9 x.ts": "x", "env/a.py": "x",
}


def _tree(root):
    for name, text in TREE.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)


@pytest.mark.parametrize("spread", [1, 3, 64])
def test_scan_obeys_ignore_files_of_the_tree(spark, tmp_path, monkeypatch, spread):
    """Which files a tree's own rules leave out; an ignored folder hides what is below it, also from ``!``."""
    monkeypatch.setattr(files, "SPREAD", spread)
    _tree(tmp_path)
    (tmp_path / "link.py").symlink_to(tmp_path / "_own.py")
    (tmp_path / "loop").symlink_to(tmp_path)
    found = sorted(r.file_path for r in files.scan(spark, str(tmp_path)).collect())
    assert found == sorted(["pkg/__init__.py", "_own.py", "keep.go", "pkg/up.go", "pkg/out/a.py", "pkg/gen_back.py", "gen_a.py", "other/a.ts", "pkg/sub/\u00e9 x.ts"])
    part = sorted(r.file_path for r in files.scan(spark, f"file:{tmp_path}", [f"{tmp_path}/pkg/sub", f"{tmp_path}/a.go", f"{tmp_path}/none"], defaults=False).collect())
    assert part == ["pkg/sub/\u00e9 x.ts"]


def test_files_that_cannot_be_read_or_cut(spark, tmp_path, monkeypatch):
    rows = files.read(spark.createDataFrame([(f"{tmp_path}/gone.py", 5)], "path string, length long").withColumn("modificationTime", F.timestamp_seconds(F.lit(1000))))
    assert files.prepare(rows, str(tmp_path)).select("file_path", "text", "hash", "mtime", "error").collect() == [("gone.py", None, None, 1000, "can't be read")]
    monkeypatch.setitem(code.SEGMENTERS, "go", lambda data: 1 / 0)
    assert _names(code.cut("go", b"def a\n")) == [("a", "function", None)] and code.cut("go", b"") == [] and code.cut("python", b"x = (\n") == []


def test_refresh_replaces_changed_and_keeps_failed(spark, tmp_path):
    for name in ("same", "edit", "gone", "fail"):
        (tmp_path / f"{name}.py").write_text(f"def {name}(): pass\n")
    empty_files, empty_chunks = index.empty(spark)
    first_files, first_chunks, stats = index.refresh(files.scan(spark, str(tmp_path)), empty_files, empty_chunks)
    assert stats.first().asDict() == {"n_files": 4, "n_chunks": 4, "n_failed": 0}
    stored = [df.sparkSession.createDataFrame(df.collect(), df.schema) for df in (first_files, first_chunks)]
    (tmp_path / "edit.py").write_text("def edit(): pass\ndef more(): pass\n")
    (tmp_path / "gone.py").unlink()
    (tmp_path / "fail.py").write_bytes(b"\xff")
    (tmp_path / "new.py").write_text("x = 1\n")
    now_files, now_chunks, stats = index.refresh(files.scan(spark, str(tmp_path)), *stored)
    old = {r.symbol_name: r.row_id for r in stored[1].collect()}
    now = {r.symbol_name: r.row_id for r in now_chunks.collect()}
    assert now.keys() == {"same", "edit", "more", "fail"} and now["same"] == old["same"] and now["fail"] == old["fail"]
    assert max(old.values()) < now["edit"] < now["more"]
    assert {(r.file_path, r.chunk_count) for r in now_files.collect()} == {("same.py", 1), ("edit.py", 2), ("fail.py", 1), ("new.py", 0)}
    assert stats.first().asDict() == {"n_files": 2, "n_chunks": 2, "n_failed": 1}


def test_hashes_of_nulls(spark):
    rows = spark.createDataFrame([(b"x", 5), (None, 5), (b"x", None)], "b binary, t long").select(content_hash("b").alias("c"), file_hash("b", "t").alias("f")).collect()
    assert [r.c for r in rows] == [xxhash.xxh3_128_hexdigest(b"x"), None, xxhash.xxh3_128_hexdigest(b"x")] and rows[0].f and not rows[1].f and not rows[2].f


def test_formats(spark):
    results = spark.createDataFrame([(0, 2, "g", "function", None, "b.py", 3, 4, 0, 9, "python", -0.5, 'say "é"\n', 2), (0, 1, "f", "method", "A", "a.py", 1, 2, 0, 5, "python", -1.234, "body", 1)],
        "query_id long, rank int, symbol_name string, symbol_type string, parent_symbol string, file_path string, start_line int, end_line int, start_byte long, end_byte long, language string, score double, text string, tokens long")
    queries = spark.createDataFrame([(0, 'a "q"', 5), (1, "none", 0)], "query_id long, query string, found long")
    text = {r.query_id: r.output for r in formats.as_text(results, queries).collect()}
    rule = formats.RULE + "\n"
    assert text[0] == rule + 'Query: "a "q""\nFound 5 results (showing top 2, 3 tokens)\n' + rule + "\n[1] A.f (method) a.py:1-2 (score: -1.23)\nbody\n\n[2] g (function) b.py:3-4 (score: -0.50)\nsay \"é\"\n\n\n" + rule
    assert text[1] == rule + 'Query: "none"\nFound 0 results (showing top 0, 0 tokens)\n' + rule + "\n" + rule
    out = {r.query_id: r.output for r in formats.as_json(results, queries).collect()}
    for q, n in ((0, 2), (1, 0)):
        value = json.loads(out[q])
        assert out[q] == json.dumps(value, indent=2, ensure_ascii=False) and len(value["chunks"]) == n
    assert {r.query_id: r.output for r in formats.as_locators(results, queries).collect()} == {0: "a.py:1-2\nb.py:3-4\n", 1: ""}


def test_outline_stops_at_the_budget(spark):
    rows = spark.createDataFrame([("src/a.py", 9, 10, "b"), ("src/a.py", 1, 2, "a"), ("other.py", 1, 1, "x"), ("src/b.py", 1, 1, "c")], "file_path string, start_line int, end_line int, symbol_name string").withColumn("symbol_type", F.lit("function")).withColumn("parent_symbol", F.lit(None).cast("string"))
    lines = [r.line for r in formats.outline(rows, "src", 2000).orderBy("line_no").collect()]
    assert lines == ['Path: "src"', "Found 3 symbols", "[1] a (function) src/a.py:1-2", "[2] b (function) src/a.py:9-10", "[3] c (function) src/b.py:1-1"]
    assert [r.line for r in formats.outline(rows, "src", 15).orderBy("line_no").collect()] == lines[:3]


def test_sweep_equals_single_runs(spark):
    chunks = spark.createDataFrame([(1, "load", "parse config"), (2, "config", "x y"), (3, None, "load load")], "row_id long, name string, body string")
    terms = spark.createDataFrame([(0, "config", 0), (0, "load", 1)], "query_id long, term string, pos int")
    index, sizes, grid = search.postings(chunks, ["name", "body"]), search.lengths(chunks, ["name", "body"]), {"a": [10.0, 1.0], "b": [1.0, 0.0]}
    got = {(r.config, r.row_id): r.score for r in search.sweep(index, sizes, terms, grid).collect()}
    for name, ws in grid.items():
        for r in search.bm25(index, sizes, terms, ws).collect():
            assert abs(got[name, r.row_id] - r.score) < 1e-12
    assert len(got) == 6


def test_weighted_means_and_order(spark):
    rows = spark.createDataFrame([("x", 1, 2, 0.5), ("x", 1, 6, 1.0), ("y", 1, 0, 0.7)], "arm string, k int, n_queries long, ndcg double")
    assert {(r.arm, r.ndcg) for r in metrics.weighted(rows, ["ndcg"], ["arm", "k"]).collect()} == {("x", 0.875), ("y", 0.0)}
    grid = spark.createDataFrame([("a", 0, 0.5), ("b", 1, 0.9), ("c", 2, 0.5)], "config string, ord int, ndcg double")
    assert [r.config for r in metrics.rank_configs(grid, "ndcg").collect()] == ["b", "a", "c"]
