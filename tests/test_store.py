"""The store, its pointers, and what is configured: analyzers by language, embeddings, tables removed."""

import json

import numpy as np
import pytest

from tessera.api import Config, Engine
from tessera.operators.extract import extract, parses, sound_part
from tessera.runtime import materialize, release
from tessera.schemas import LEASES
from tessera.sources import scan
from tessera.sources.store import Store


def leases(spark, *keys):
    return spark.createDataFrame([(k, "i", None, None) for k in keys], LEASES)


def test_commits_are_seen_whole_and_in_order(spark, tmp_path):
    a, b = Store(spark, f"file://{tmp_path}/s"), Store(spark, f"{tmp_path}/s/")
    assert not a.exists() and a.read("leases").count() == 0
    a.commit(leases=leases(spark, "x"))
    old = b.read("leases")
    b.commit(leases=leases(spark, "x", "y"))
    assert old.count() == 1 and a.read("leases").count() == 2
    assert a.vacuum() == 1 and b.read("leases").count() == 2


def test_of_two_writers_one_gets_an_error(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.commit(leases=leases(spark, "x"))
    with pytest.raises(RuntimeError):
        store._point({"leases": "elsewhere"}, 1)
    assert store.read("leases").count() == 1 and not [p for p in (tmp_path / "s" / "pointers").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]


def test_released_tables_are_gone(spark):
    release(spark)
    df, kept = materialize(spark.range(5), "t"), materialize(spark.range(6), "t", keep=True)
    assert df.count() == 5 and release(spark) == 1 and kept.count() == 6


def test_truth_round_trip(spark, tmp_path):
    end = "struct<file:string,line:int,name:string>"
    header = spark.sql(f"SELECT 'v1' AS schema, 'r' AS repo, 'c' AS commit, 'g' AS generator, CAST(array(named_struct('file', 'a', 'line', 1, 'name', 'f')) AS array<{end}>) AS functions")
    edges = spark.sql("SELECT named_struct('file', 'a', 'line', 1, 'name', 'f') AS caller, named_struct('file', 'b', 'line', 2, 'name', 'g') AS callee")
    scan.write_truth(header, edges, str(tmp_path / "truth"))
    h, e = scan.read_truth(spark, str(tmp_path / "truth"))
    assert h.collect() == header.collect() and e.collect() == edges.collect()


def test_walk_without_rules(spark, tmp_path):
    names = {"a.py", ".env", "node_modules/x.js", "p/__init__.py", "p/_q/deep/b.py", "p/empty.py", ".nvmrc", ".gitignore", "p/.gitignore", "p/no.py", "drop.py", "p/target/c.py"}
    for name in names:
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_text("" if "empty" in name else "x = 1")
    (tmp_path / ".gitignore").write_text("drop.py\n")
    (tmp_path / "p/.gitignore").write_text("no.py\n")
    (tmp_path / "p/loop").symlink_to(tmp_path)
    assert {r.path for r in scan.everything(spark, str(tmp_path)).collect()} == names
    want = {"a.py", "p/__init__.py", "p/_q/deep/b.py", "p/empty.py", ".nvmrc"}
    for root in (str(tmp_path), f"{tmp_path}/", f"file://{tmp_path}"):
        got = {r.path: r for r in scan.walk(spark, root).collect()}
        assert set(got) == want and got["p/empty.py"].length == 0 and bytes(got["a.py"].content) == b"x = 1"


def test_analyzers_by_language():
    assert Config(".").wants(("go",)) and not Config(".", native_disabled_languages=("go",)).wants(("go", "c"))
    only = Config(".", native_languages=("rust", "c"))
    assert only.wants(("c", "cpp")) and not only.wants(("go",))
    with pytest.raises(ValueError):
        Config(".", embeddings="else").resolved()


def test_semantic_search_by_embeddings(spark, tmp_path):
    pieces = ["[UNK]", "load", "user", "draw", "line", "def", "(", ")", ":", "py", "a"]
    (tmp_path / "v.txt").write_text("\n".join(pieces) + "\n")
    matrix = np.zeros((len(pieces), 3), "<f4")
    matrix[1:3, 0], matrix[3:5, 1], matrix[5:, 2] = 5, 5, 0.01
    header = json.dumps({"e": {"dtype": "F32", "shape": list(matrix.shape), "data_offsets": [0, matrix.nbytes]}}).encode()
    (tmp_path / "m.bin").write_bytes(len(header).to_bytes(8, "little") + header + matrix.tobytes())
    tree = tmp_path / "tree"
    tree.mkdir()
    (tree / "a.py").write_text("def load():\n    pass\n\n\ndef draw():\n    pass\n")
    engine = Engine.open(spark, str(tree), embeddings="static", vocabulary=str(tmp_path / "v.txt"), matrix=str(tmp_path / "m.bin"))
    engine.index()
    assert "load" in engine.semantic("user", 1).first().id and "draw" in engine.semantic("line", 1).first().id
    lost = Engine.open(spark, str(tree), embeddings="static", vocabulary=str(tmp_path / "none"), matrix=str(tmp_path / "m.bin"))
    assert lost.embedder is None and "draw" in lost.semantic("draw", 1).first().id


def test_broken_python_keeps_what_parses():
    text = "import os\n\n@deco\ndef good(a):\n    return bad(a)\n\ndef broken(:\n    x = 1\n\nclass C:\n    def m(self):\n        self.k()\n"
    assert not parses("python", text) and parses("python", "x = 1") and parses("go", "func f() { g(\"}\") }") and not parses("java", "class A { void f( }")
    assert [type(x).__name__ for x in sound_part(text).body] == ["Import", "FunctionDef", "ClassDef"]
    found = {s["qualified_name"]: s for s in extract("a.py", "python", text.encode())}
    assert set(found) == {"good", "broken", "C", "C.m"} and found["good"]["call_sites"][0]["callee"] == "bad" and found["broken"]["call_sites"] is None
    assert found["good"]["span"] == {"start": 4, "end": 5} and found["good"]["annotations"] == ["deco"]


def test_call_arguments_of_any_length():
    long = ", ".join(f"g({k})" for k in range(2000))
    sites = {s["callee"]: s for s in extract("A.java", "java", f"class A {{\n  void f() {{\n    h({long});\n  }}\n}}\n".encode())[1]["call_sites"]}
    assert sites["h"]["argc"] == 2000 and sites["h"]["args"][-1] == "call:g"
