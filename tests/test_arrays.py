"""JSON arrays cut at any byte, against the plain parser."""

import json
import random

import pytest
from quarry.sources.arrays import read_array

SCHEMA = "a string, b long, c struct<d: string, e: array<struct<f: string>>>"
rng = random.Random(5)


def text(n):
    return "".join(rng.choices(['"', "\\", "{", "}", "[", "]", ",", "é", "\n", " ", "x", "\\\\", "\\}"], k=n))


def value():
    return {"a": rng.choice([None, text(rng.randrange(12))]), "b": rng.choice([None, rng.randrange(99)])} | ({"c": {"d": text(3), "e": [{"f": text(2)} for _ in range(rng.randrange(3))]}} if rng.random() < 0.5 else {}) | ({"other": [{}, [[{"x": "}"}]], {}]} if rng.random() < 0.3 else {})


def plain(v):
    c = v.get("c")
    return v.get("a"), v.get("b"), c and (c["d"], [(e["f"],) for e in c["e"]])


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "40", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    old = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("indent", [None, 1])
@pytest.mark.parametrize("ascii_only", [True, False])
def test_elements_equal_those_of_a_parser(spark, tmp_path, small_splits, indent, ascii_only):
    want = {}
    for name, n in (("one", 40), ("two", 1), ("none", 0)):
        values = [value() for _ in range(n)]
        (tmp_path / f"{name}.json").write_text(json.dumps(values, indent=indent, ensure_ascii=ascii_only) + "\n" * (n % 2))
        want |= {(f"{name}.json", i): plain(v) for i, v in enumerate(values)}
    rows = read_array(spark, str(tmp_path), SCHEMA)
    got = {(r.file.rsplit("/", 1)[1], r.element): (r.value.a, r.value.b, r.value.c and (r.value.c.d, [(e.f,) for e in r.value.c.e])) for r in rows.collect()}
    assert got == want
    assert rows.select("file").distinct().count() == 2


@pytest.mark.parametrize("bad", ["", "{}", '[{"a": "x"}', '[{"a": "x}]', '[{"a": 1}}]', '{"a": [{}]}', '[{"b": "no number"}]', "[{a}]"])
def test_broken_arrays_fail(spark, tmp_path, small_splits, bad):
    (tmp_path / "x.json").write_text(bad)
    if bad == "":
        assert read_array(spark, str(tmp_path), SCHEMA).collect() == []
        return
    with pytest.raises(Exception, match="JSON|parse|MALFORMED"):
        read_array(spark, str(tmp_path), SCHEMA).collect()
