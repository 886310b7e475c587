"""Analyzers that add edges of their own: imports by project files, declared bases, and types named in a body.

An analyzer has languages(), available(root) and analyze(symbols, files), which gives edges. A body is
split into words once and the words joined to the types' names, so no callable meets every type.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import base_name, dir_name, fold_path
from tessera.operators.calls import stripped
from tessera.operators.edges import edge, family, inheritance
from tessera.operators.intervals import tightest
from tessera.runtime import ship
from tessera.schemas import CALLABLE, TYPE_LIKE
from tessera.sources import scan


class Analyzer(Protocol):
    def languages(self) -> tuple[str, ...]: ...

    def available(self, root: str) -> bool: ...

    def analyze(self, symbols: DataFrame, files: DataFrame) -> DataFrame: ...


def best_of_types(uses: DataFrame, symbols: DataFrame) -> DataFrame:
    """uses (src, from_file, fam, name) with dst: the type of that name in the same file, else in the same folder, else the first by path and id."""
    types = symbols.filter(F.col("kind").isin(*TYPE_LIKE)).select(F.col("id").alias("dst"), F.col("file_path").alias("to_file"), family(F.col("language")).alias("fam"), "name")
    nearness = F.when(F.col("to_file") == F.col("from_file"), 0).when(dir_name(F.col("to_file")) == dir_name(F.col("from_file")), 1).otherwise(2)
    order = Window.partitionBy("src", "name").orderBy("near", "to_file", "dst")
    return uses.join(types, ["fam", "name"]).filter("src <> dst").withColumn("near", nearness).withColumn("place", F.row_number().over(order)).filter("place = 1").drop("near", "place")


def named_types(symbols: DataFrame, languages: tuple[str, ...], in_signature: float, in_body: float) -> DataFrame:
    """uses-type from callables to the types that their signature or body names; the signature's confidence where both do."""
    rows = symbols.filter(F.col("kind").isin(*CALLABLE) & F.col("language").isin(*languages)).select(F.col("id").alias("src"), F.col("file_path").alias("from_file"), family(F.col("language")).alias("fam"), "signature", "raw_text")
    word = F.lit(r"\b([A-Z]\w*)\b")
    part = lambda text, c: rows.select("src", "from_file", "fam", F.lit(c).alias("confidence"), F.explode(F.array_distinct(F.regexp_extract_all(stripped(F.col(text)), word, 1))).alias("name"))
    uses = part("signature", in_signature).unionByName(part("raw_text", in_body)).groupBy("src", "from_file", "fam", "name").agg(F.max("confidence").alias("confidence"))
    return edge(best_of_types(uses, symbols), "uses-type", F.col("confidence"), "native", "lexical")


def declared_bases(symbols: DataFrame, languages: tuple[str, ...], confidence: float) -> DataFrame:
    """extends and implements of these languages; for C# and PHP the list after the colon, and extends, implements and use."""
    own = symbols.filter(F.col("language").isin(*languages))
    known = inheritance(symbols).join(own.select(F.col("id").alias("src")), "src", "left_semi").join(own.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "type", "confidence", "source", "reason").withColumns({"confidence": F.lit(confidence), "source": F.lit("native"), "reason": F.lit("declared")})
    sig, body = F.col("signature"), F.col("raw_text")
    cut = lambda text: F.filter(F.transform(F.split(text, ","), lambda x: F.element_at(F.split(F.regexp_extract(F.trim(x), r"^([\w.\\]+)", 1), r"[.\\]"), -1)), lambda x: x != "")
    colon = cut(F.regexp_extract(sig, r"\b(?:class|interface|struct|record)\s+\w+(?:<[^>]*>)?[^:{]*:\s*([^{]+?)(?:\s+where\b|\s*\{|$)", 1))
    lists = (
        ("csharp", "extends", F.when(F.col("kind") == "class", F.filter(F.slice(colon, 1, 1), lambda x: ~x.rlike("^I[A-Z]")))),
        ("csharp", "implements", F.filter(colon, lambda x: x.rlike("^I[A-Z]"))),
        ("php", "extends", cut(F.regexp_extract(sig, r"\bextends\s+([\w\\, ]+?)(?:\s+implements\b|\s*\{|$)", 1))),
        ("php", "implements", F.concat(cut(F.regexp_extract(sig, r"\bimplements\s+([\w\\, ]+)", 1)), cut(F.array_join(F.regexp_extract_all(body, F.lit(r"(?m)^\s+use\s+([\w\\, ]+);"), 1), ",")))),
    )
    for language, kind, names in lists:
        if language in languages:
            rows = own.filter((F.col("language") == language) & F.col("kind").isin(*TYPE_LIKE)).select(F.col("id").alias("src"), F.col("file_path").alias("from_file"), F.lit(language).alias("fam"), F.explode(F.array_distinct(names)).alias("name"))
            known = known.unionByName(edge(best_of_types(rows, symbols), kind, confidence, "native", "declared"))
    return known


def _file_edges(pairs: DataFrame, confidence: float) -> DataFrame:
    """imports edges of (from_file, to_file)."""
    return edge(pairs.filter("from_file <> to_file").select(F.concat(F.lit("file:"), "from_file").alias("src"), F.concat(F.lit("file:"), "to_file").alias("dst")).distinct(), "imports", confidence, "native", "project")


def _paths(files: DataFrame) -> DataFrame:
    return files.select(F.col("path").alias("to_file"), "language")


@dataclass
class Lexical:
    """Declared bases and named types of some languages; subclasses add imports from the project's files."""

    names: tuple[str, ...]
    markers: tuple[str, ...]
    bases: float | None
    in_signature: float
    in_body: float
    root: str = "."

    def languages(self) -> tuple[str, ...]:
        return self.names

    def available(self, root: str) -> bool:
        self.root = root
        return any(next(Path(root).glob(m), None) is not None for m in self.markers)

    def imports(self, symbols: DataFrame, files: DataFrame) -> DataFrame | None:
        return None

    def analyze(self, symbols: DataFrame, files: DataFrame) -> DataFrame:
        found = named_types(symbols, self.names, self.in_signature, self.in_body)
        for more in (declared_bases(symbols, self.names, self.bases) if self.bases else None, self.imports(symbols, files)):
            if more is not None:
                found = found.unionByName(more)
        return found


class Rust(Lexical):
    """``mod x;`` of a file names x.rs or x/mod.rs next to it."""

    def imports(self, symbols, files):
        own = files.filter("language = 'rust'")
        mods = own.select(F.col("path").alias("from_file"), F.explode(F.regexp_extract_all(F.decode("content", "UTF-8"), F.lit(r"(?m)^\s*(?:pub\s+)?mod\s+(\w+)\s*;"), 1)).alias("m"))
        near = F.when(base_name(F.col("from_file")).isin("mod.rs", "lib.rs", "main.rs"), dir_name(F.col("from_file"))).otherwise(F.regexp_replace("from_file", r"\.rs$", ""))
        wanted = mods.select("from_file", F.explode(F.array(F.concat_ws("/", F.nullif(near, F.lit("")), F.concat("m", F.lit(".rs"))), F.concat_ws("/", F.nullif(near, F.lit("")), "m", F.lit("mod.rs")))).alias("to_file"))
        return _file_edges(wanted.join(_paths(files).select("to_file"), "to_file", "left_semi"), 0.93)


class CFamily(Lexical):
    """Quoted includes, next to the file or under an include folder of the compilation database."""

    def imports(self, symbols, files):
        spark = files.sparkSession
        own = files.filter(F.col("language").isin("c", "cpp"))
        quoted = own.select(F.col("path").alias("from_file"), F.explode(F.regexp_extract_all(F.decode("content", "UTF-8"), F.lit(r"(?m)^\s*#\s*include\s*[\"<]([^\">]+)[\">]"), 1)).alias("inc"))
        database = next(Path(self.root).glob("**/compile_commands.json"), None)
        under = spark.createDataFrame([], "folder string")
        if database is not None:
            rows = scan.compile_commands(spark, str(database)).select("directory", "include")
            whole = F.when(F.col("include").startswith("/"), F.col("include")).otherwise(F.concat_ws("/", "directory", "include"))
            under = rows.select(F.regexp_replace(F.concat(F.lit("/"), fold_path(whole)), "^/+", "/").alias("p")).filter(F.col("p").startswith(self.root)).select(F.expr(f"substring(p, {len(self.root) + 2})").alias("folder")).distinct()
        beside = quoted.select("from_file", fold_path(F.concat_ws("/", F.nullif(dir_name(F.col("from_file")), F.lit("")), "inc")).alias("to_file"))
        below = quoted.crossJoin(F.broadcast(under)).select("from_file", fold_path(F.concat_ws("/", F.nullif("folder", F.lit("")), "inc")).alias("to_file"))
        return _file_edges(beside.unionByName(below).unionByName(quoted.select("from_file", fold_path(F.col("inc")).alias("to_file"))).join(_paths(files).select("to_file"), "to_file", "left_semi"), 0.95)


def quoted_includes(files: DataFrame) -> DataFrame:
    """imports edges of includes that name a file next to the including one."""
    own = files.filter(F.col("language").isin("c", "cpp"))
    quoted = own.select(F.col("path").alias("from_file"), F.explode(F.regexp_extract_all(F.decode("content", "UTF-8"), F.lit(r"(?m)^\s*#\s*include\s*\"([^\"]+)\""), 1)).alias("inc"))
    beside = quoted.select("from_file", fold_path(F.concat_ws("/", F.nullif(dir_name(F.col("from_file")), F.lit("")), "inc")).alias("to_file"))
    return _file_edges(beside.join(_paths(files).select("to_file"), "to_file", "left_semi"), 0.95)


class CSharp(Lexical):
    """Files of a project import those of the projects that it refers to."""

    def imports(self, symbols, files):
        spark, found = files.sparkSession, None
        own = files.filter("language = 'csharp'").select("path")
        for project in sorted(Path(self.root).glob("**/*.csproj")):
            here = project.parent.relative_to(self.root).as_posix()
            target = scan.project_references(spark, str(project)).select(dir_name(fold_path(F.concat(F.lit("" if here == "." else here + "/"), "include"))).alias("folder"))
            mine = own.filter(F.lit(here == ".") | F.col("path").startswith(here + "/")).select(F.col("path").alias("from_file"))
            pairs = own.select(F.col("path").alias("to_file")).join(F.broadcast(target), F.expr("startswith(to_file, concat(folder, '/'))")).crossJoin(mine).select("from_file", "to_file")
            found = pairs if found is None else found.unionByName(pairs)
        return None if found is None else _file_edges(found, 0.94)


class Php(Lexical):
    """``use`` of a class whose longest PSR-4 prefix gives a file."""

    def imports(self, symbols, files):
        spark, composer = files.sparkSession, Path(self.root) / "composer.json"
        if not composer.exists():
            return None
        own = files.filter("language = 'php'")
        used = own.select(F.col("path").alias("from_file"), F.explode(F.regexp_extract_all(F.decode("content", "UTF-8"), F.lit(r"(?m)^use\s+\\?([\w\\]+)"), 1)).alias("class"))
        hits = used.join(F.broadcast(scan.psr4(spark, str(composer))), F.expr("startswith(class, prefix)"))
        order = Window.partitionBy("from_file", "class").orderBy(F.length("prefix").desc(), "folder")
        one = hits.withColumn("place", F.row_number().over(order)).filter("place = 1")
        path = F.concat(F.regexp_replace("folder", "/*$", "/"), F.replace(F.expr("substring(class, length(prefix) + 1)"), F.lit("\\"), F.lit("/")), F.lit(".php"))
        return _file_edges(one.select("from_file", fold_path(path).alias("to_file")).join(_paths(files).select("to_file"), "to_file", "left_semi"), 0.94)


def _bound_calls(path: str, text: str) -> list[tuple[str, int, str, str]]:
    """(path, line, module or file, name) of calls of bare names that a from-import or a definition of the file itself binds; nothing is imported to tell."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    bound: dict[str, tuple[str, str]] = {}
    for node in ast.walk(tree):
        if isinstance(node, ast.ImportFrom):
            up = path.split("/")[: -node.level] if node.level else []
            module = "/".join([*up, *filter(None, (node.module or "").split("."))])
            bound |= {a.asname or a.name: (module, a.name) for a in node.names}
    bound |= {x.name: (path, x.name) for x in tree.body if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))}
    return [(path, n.lineno, *bound[n.func.id]) for n in ast.walk(tree) if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in bound]


def python_calls(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """calls of Python functions whose name is bound to exactly one definition: from the innermost callable around the call to the function, or to the class's __init__."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for p, c in zip(*(x.to_pylist() for x in batch.columns)) if c is not None for r in _bound_calls(p, bytes(c).decode("utf-8", "replace"))]
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.string()))], names=["from_file", "line", "module", "name"])

    ship(files.sparkSession)
    bound = files.filter("language = 'python'").select("path", "content").mapInArrow(run, "from_file string, line int, module string, name string")
    own = symbols.filter("language = 'python'")
    places = F.array(F.col("module"), F.concat("module", F.lit(".py")), F.concat("module", F.lit("/__init__.py")))
    aims = bound.select("from_file", "line", "name", F.explode(places).alias("to_file"))
    functions = own.filter("kind = 'function'").select(F.col("id").alias("dst"), F.col("file_path").alias("to_file"), "name")
    classes = own.filter("kind = 'constructor'").select(F.col("id").alias("dst"), F.col("file_path").alias("to_file"), F.col("parent_symbol").alias("name"))
    hits = aims.join(functions.unionByName(classes), ["to_file", "name"])
    callers = own.filter(F.col("kind").isin(*CALLABLE)).select(F.col("id").alias("src"), F.col("file_path").alias("from_file"), F.col("span.start").alias("low"), F.col("span.end").alias("high"))
    inside = tightest(hits.select("from_file", "line", "dst"), callers, "from_file", "line", ("low", "high"), ["from_file", "line", "dst"], "src")
    return edge(inside.filter("src <> dst").select("src", "dst").distinct(), "calls", 0.98, "native", "ast")


class Python(Lexical):
    """Dotted modules that are files of the tree, and calls of names that are bound."""

    def imports(self, symbols, files):
        raw = symbols.filter("language = 'python'").select(F.col("file_path").alias("from_file"), F.explode("imports").alias("imp")).distinct()
        dots = F.length(F.regexp_extract("imp", r"^(\.*)", 1))
        rest = F.replace(F.regexp_replace("imp", r"^\.+", ""), F.lit("."), F.lit("/"))
        module = F.when(dots > 0, fold_path(F.concat_ws("/", dir_name(F.col("from_file")), F.repeat(F.lit("../"), dots - 1), rest))).otherwise(rest)
        tries = F.array(*(F.concat(m, F.lit(end)) for m in (module, dir_name(module)) for end in (".py", "/__init__.py")))
        return _file_edges(raw.select("from_file", F.explode(tries).alias("to_file")).join(_paths(files).select("to_file"), "to_file", "left_semi"), 0.94)

    def analyze(self, symbols, files):
        return super().analyze(symbols, files).unionByName(python_calls(symbols, files))


def defaults() -> list[Analyzer]:
    """One analyzer for each language that has one."""
    return [
        Python(("python",), ("pyproject.toml", "setup.py", "setup.cfg", "requirements*.txt"), None, 0.96, 0.96),
        Lexical(("java",), ("pom.xml", "build.gradle*"), 0.97, 0.96, 0.94),
        Rust(("rust",), ("Cargo.toml",), 0.96, 0.93, 0.94),
        CFamily(("c", "cpp"), ("compile_commands.json", "*/compile_commands.json"), None, 0.91, 0.93),
        CSharp(("csharp",), ("**/*.csproj",), 0.96, 0.95, 0.93),
        Php(("php",), ("composer.json",), 0.95, 0.94, 0.90),
    ]
