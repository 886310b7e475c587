"""Embeddings, analyzers and the tool server."""

import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.api import Engine
from tessera.operators import embed, native
from tessera.server import Server, read_message

PIECES = ["[UNK]", "get", "user", "##s", "cafe", "(", ")", "by", "##name"]


@pytest.fixture(scope="module")
def embedder(tmp_path_factory):
    folder = tmp_path_factory.mktemp("weights")
    (folder / "vocab.txt").write_text("\n".join(PIECES) + "\n")
    matrix = np.arange(len(PIECES) * 4, dtype="<f4").reshape(-1, 4) % 7
    header = json.dumps({"embeddings": {"dtype": "F32", "shape": [len(PIECES), 4], "data_offsets": [0, matrix.nbytes]}}).encode()
    (folder / "m.safetensors").write_bytes(len(header).to_bytes(8, "little") + header + matrix.tobytes())
    return embed.Embedder.load(str(folder / "vocab.txt"), str(folder / "m.safetensors"))


def test_words_and_pieces():
    assert embed.words("Get Users(Café)\x07 日本") == ["get", "users", "(", "cafe", ")", "日", "本"]
    v = {p: i for i, p in enumerate(PIECES)}
    assert embed.pieces("users", v) == [2, 3] and embed.pieces("byname", v) == [7, 8]
    assert embed.pieces("userx", v) == [0] and embed.pieces("s" * 101, v) == [0]


def test_vectors_are_normalised_means(spark, embedder):
    docs = spark.createDataFrame([(1, "get users"), (2, "zzz"), (3, None)], "id long, text string")
    got = {r.id: np.array(r.vector) for r in embedder.vectors(docs, F.col("text")).collect()}
    mean = embedder.matrix[[1, 2, 3]].mean(0)
    assert np.allclose(got[1], mean / np.linalg.norm(mean))
    assert not got[2].any() and not got[3].any()


def test_vector_table_is_kept_and_pruned(spark, embedder):
    row = lambda i, n: (i, n, n, f"def {n}()", "", "")
    table = lambda *rows: spark.createDataFrame(list(rows), "id string, name string, qualified_name string, signature string, docstring string, parent_symbol string")
    none = spark.createDataFrame([], "id string, text_sha string, vector array<double>")
    first = embed.refreshed(table(row("a", "get"), row("b", "user")), none, embedder)
    marked = first.withColumn("vector", F.array(F.lit(9.0)))
    second = {r.id: r.vector for r in embed.refreshed(table(row("a", "get"), row("b", "users")), marked, embedder).collect()}
    assert second["a"] == [9.0] and len(second["b"]) == 4
    assert {r.id for r in embed.refreshed(table(row("c", "by")), marked, embedder).collect()} == {"c"}


def test_bad_matrix_files(tmp_path):
    bad = tmp_path / "x"
    bad.write_bytes(b"abc")
    with pytest.raises(ValueError):
        embed.read_matrix(str(bad))
    header = json.dumps({"e": {"dtype": "F16", "shape": [1, 1], "data_offsets": [0, 2]}}).encode()
    bad.write_bytes(len(header).to_bytes(8, "little") + header + b"\0\0")
    with pytest.raises(ValueError):
        embed.read_matrix(str(bad))


TREE = {
    "pom.xml": "<project/>", "composer.json": '{"autoload": {"psr-4": {"App\\\\": "src/", "App\\\\Api\\\\": "api/"}}}', "Cargo.toml": "[package]", "pyproject.toml": "",
    "j/Base.java": "package j;\npublic class Base {\n}\n", "j/Child.java": "package j;\npublic class Child extends Base {\n    public void run(int x) {\n        Base b = null;\n    }\n}\n",
    "p/a.php": "<?php\nuse App\\Api\\Client;\nuse App\\Model;\nclass A extends Model {\n}\n", "api/Client.php": "<?php\nclass Client {\n}\n", "src/Model.php": "<?php\nclass Model {\n}\n",
    "r/lib.rs": "mod inner;\n", "r/inner.rs": "pub fn f() {\n}\n",
    "py/a.py": "import py.b\n\ndef f():\n    return 1\n", "py/b.py": "X = 1\n\ndef g():\n    return 2\n",
    "c/compile_commands.json": "[]", "c/main.c": '#include "util.h"\nint main(void) {\n    return 0;\n}\n', "c/util.h": "int util(void);\n",
    "cs/One/One.csproj": '<Project><ItemGroup><ProjectReference Include="..\\Two\\Two.csproj" /></ItemGroup></Project>', "cs/Two/Two.csproj": "<Project/>",
    "cs/One/A.cs": "class A : B, IThing {\n}\n", "cs/Two/B.cs": "class B {\n}\ninterface IThing {\n}\n",
}


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, text in TREE.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    engine = Engine.open(spark, str(root), native_analyzers=native.defaults())
    engine.index()
    return engine


def test_native_edges(tree):
    rows = tree.edges_table().filter("source = 'native'").collect()
    names = {r.id: r.name for r in tree.symbols_table().collect()}
    got = {(names.get(r.src, r.src), names.get(r.dst, r.dst), r.type): r.confidence for r in rows}
    assert got["Child", "Base", "extends"] == 0.97 and got["run", "Base", "uses-type"] == 0.94
    assert got["A", "B", "extends"] == 0.96 and got["A", "IThing", "implements"] == 0.96
    assert got["A", "Model", "extends"] == 0.95
    files = {(a, b): c for (a, b, k), c in got.items() if k == "imports"}
    assert files["file:p/a.php", "file:api/Client.php"] == files["file:p/a.php", "file:src/Model.php"] == 0.94
    assert files["file:r/lib.rs", "file:r/inner.rs"] == 0.93 and files["file:c/main.c", "file:c/util.h"] == 0.95
    assert files["file:py/a.py", "file:py/b.py"] == 0.94
    assert files["file:cs/One/A.cs", "file:cs/Two/B.cs"] == 0.94 and ("file:cs/Two/B.cs", "file:cs/One/A.cs") not in files


def test_server(tree):
    ask = lambda i, method, **params: json.dumps({"jsonrpc": "2.0", "id": i, "method": method, "params": params}).encode()
    framed = ask(2, "tools/list")
    sent = b"\n".join([ask(1, "initialize", protocolVersion="2024-11-05"), b"Content-Length: %d\r\n\r\n%b" % (len(framed), framed), b'{"method": "notifications/initialized"}', ask(3, "tools/call", name="symbols", arguments={"query": "child"}), ask(4, "tools/call", name="impact", arguments={"query": "Base"}), ask(5, "tools/call", name="nothing"), ask(6, "none"), b"{"]) + b"\n"
    out = io.BytesIO()
    Server(tree).serve(io.BytesIO(sent), out)
    said = {m["id"]: m for m in map(json.loads, out.getvalue().splitlines())}
    assert said[1]["result"]["protocolVersion"] == "2024-11-05" and len(said[2]["result"]["tools"]) == 9
    assert json.loads(said[3]["result"]["content"][0]["text"])["symbols"][0]["qualified_name"] == "Child"
    assert json.loads(said[4]["result"]["content"][0]["text"])["count"] >= 1
    assert said[5]["error"]["code"] == -32602 and said[6]["error"]["code"] == -32601 and said[None]["error"]["code"] == -32700
    assert read_message(io.BytesIO(b"")) is None
