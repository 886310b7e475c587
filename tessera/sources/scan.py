"""The repository walk: files to (path, language, blob_sha, content), with every rule a predicate or a join."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import islice
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import PRUNED, is_sensitive, language_of
from tessera.operators.extract import LARGEST
from tessera.runtime import ship

#: Read in this order in each folder, so that the project's own rules are the later ones to lose.
IGNORE_FILES = (".tesseraignore", ".gitignore")


def ignore_pattern(rule: str, base: str = "") -> tuple[str, bool, bool] | None:
    """(regular expression on the path, negated, only folders) of one line of an ignore file in folder ``base``; None for blanks and comments."""
    text = rule.rstrip("\n").rstrip()
    if not text or text.startswith("#"):
        return None
    negated = text.startswith("!")
    text = text[1:] if negated else text
    folders = text.endswith("/")
    text = text.strip("/") if folders else text
    anchored = "/" in text.rstrip("/")
    text = text.lstrip("/")
    out = []
    i = 0
    while i < len(text):
        if text.startswith("**/", i):
            out.append("(?:[^/]+/)*")
            i += 3
        elif text.startswith("**", i):
            out.append(".*")
            i += 2
        elif text[i] == "*":
            out.append("[^/]*")
            i += 1
        elif text[i] == "?":
            out.append("[^/]")
            i += 1
        elif text[i] == "[" and "]" in text[i + 1 :]:
            end = text.index("]", i + 1)
            out.append("[" + ("^" + text[i + 2 : end] if text[i + 1] in "!^" else text[i + 1 : end]).replace("\\", "\\\\") + "]")
            i = end + 1
        else:
            out.append(re.escape(text[i]))
            i += 1
    head = re.escape(base + "/") if base else ""
    return f"^{head}{'' if anchored else '(?:.*/)?'}{''.join(out)}{'/.*' if folders else '(?:/.*)?'}$", negated, folders


def ignore_rules(files: dict[str, str]) -> list[tuple[str, bool]]:
    """(pattern, negated) of ignore files by path, outer folders first: of the rules that match a path the last decides."""
    order = sorted(files, key=lambda p: (p.count("/"), str(PurePosixPath(p).parent), IGNORE_FILES.index(PurePosixPath(p).name) if PurePosixPath(p).name in IGNORE_FILES else 9))
    out = []
    for path in order:
        base = str(PurePosixPath(path).parent)
        for line in files[path].split("\n"):
            rule = ignore_pattern(line, "" if base == "." else base)
            if rule:
                out.append(rule[:2])
    return out


def is_ignored(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """Whether the last rule that matches ignores the path: a cascade with the last rule first."""
    verdict = None
    for pattern, negated in reversed(rules):
        verdict = (F if verdict is None else verdict).when(path.rlike(pattern), not negated)
    return F.lit(False) if verdict is None else verdict.otherwise(False)


def _file_system(root: str):
    """(file system, path on it) of a folder's URI or local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(root))


def _below(system, at: str, skip: frozenset[str]) -> Iterator[tuple[str, int]]:
    """(path, bytes) of the files below a folder; folders of these names are not entered, nor are links."""
    from pyarrow import fs

    if isinstance(system, fs.LocalFileSystem):
        for folder, inside, names in os.walk(at):
            inside[:] = sorted(x for x in inside if x not in skip)
            for name in sorted(names):
                path = os.path.join(folder, name)
                if not os.path.islink(path) and os.path.isfile(path):
                    yield path, os.path.getsize(path)
        return
    todo = [at]
    while todo:
        for x in system.get_file_info(fs.FileSelector(todo.pop())):
            if x.type == fs.FileType.File:
                yield x.path, x.size
            elif x.type == fs.FileType.Directory and x.base_name not in skip:
                todo.append(x.path)


def listing(spark: SparkSession, root: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """(path, length) of the files below root, relative to it, but for folders of the names in skip.

    Spark's own readers pass over names that begin with _ or a dot, such as __init__.py and ignore files, and over empty files. The driver lists
    root alone; each folder in it is listed by a task.
    """
    from pyarrow import fs

    system, home = _file_system(root)
    top = [(os.path.relpath(x.path, home), x.type == fs.FileType.Directory, x.size or 0) for x in system.get_file_info(fs.FileSelector(home)) if not (x.type == fs.FileType.Directory and x.base_name in skip) and not (isinstance(system, fs.LocalFileSystem) and os.path.islink(x.path))]
    passed = frozenset(skip)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, home = _file_system(root)
        for batch in batches:
            for name, folder, size in zip(*(c.to_pylist() for c in batch.columns)):
                rows = ((os.path.relpath(p, home), n) for p, n in _below(system, f"{home}/{name}", passed)) if folder else iter([(name, size)])
                while some := list(islice(rows, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in some], pa.string()), pa.array([r[1] for r in some], pa.int64())], names=["path", "length"])

    ship(spark)
    rows = spark.createDataFrame(top, "path string, folder boolean, length long")
    return rows.repartition(max(1, min(len(top), 1024))).mapInArrow(run, "path string, length long")


def contents(files: DataFrame, root: str) -> DataFrame:
    """files (path, length, ...) with their bytes as content; those that are no longer there are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, home = _file_system(root)
        for batch in batches:
            for k, path in enumerate(batch.column("path").to_pylist()):  # one file at a time, however long
                try:
                    with system.open_input_stream(f"{home}/{path}") as stream:
                        data = stream.read()
                except OSError:
                    continue
                yield pa.RecordBatch.from_arrays([*batch.slice(k, 1).columns, pa.array([data], pa.binary())], names=[*batch.schema.names, "content"])

    ship(files.sparkSession)
    return files.mapInArrow(run, T.StructType([*files.schema.fields, T.StructField("content", T.BinaryType())]))


def walk(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """(path, language, blob_sha, length, content) of the supported files below root, as the rules leave them."""
    plain = listing(spark, root, PRUNED)
    rules = ignore_rules({r.path: bytes(r.content).decode("utf-8", "replace") for r in contents(plain.filter(F.substring_index("path", "/", -1).isin(*IGNORE_FILES)), root).select("path", "content").collect()})
    kept = plain.filter(~is_sensitive(F.col("path")) & ~is_ignored(F.col("path"), rules)).withColumn("language", language_of(F.col("path"))).filter("language IS NOT NULL")
    read = contents(kept, root).withColumn("blob_sha", F.sha1("content"))
    return read.select("path", "language", "blob_sha", "length", *(["content"] if content else []))


def everything(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of all files below root, whatever the rules say."""
    return listing(spark, root)


def oversized(files: DataFrame) -> DataFrame:
    """(path, error) of files that are too long to extract."""
    return files.filter(F.col("length") > LARGEST).select("path", F.lit("file too large").alias("error"))


def read_truth(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(header, edges) of an oracle's lines of JSON, packed with gzip or not."""
    end = "struct<file:string,line:int,name:string>"
    rows = spark.read.schema(f"schema string, repo string, commit string, generator string, functions array<{end}>, caller {end}, callee {end}").json(path)
    header = rows.filter("schema IS NOT NULL").select("schema", "repo", "commit", "generator", "functions")
    return header, rows.filter("caller IS NOT NULL").select("caller", "callee")


def write_truth(header: DataFrame, edges: DataFrame, path: str) -> None:
    """An oracle's lines of JSON, packed: what read_truth reads. The header is a line like the others, wherever it comes."""
    lines = header.select(F.to_json(F.struct("schema", "repo", "commit", "generator", "functions")).alias("value")).unionByName(edges.select(F.to_json(F.struct("caller", "callee")).alias("value")))
    lines.write.mode("error").option("compression", "gzip").text(path)


def read_baseline(spark: SparkSession, path: str, values: str = "commit string, precision double, recall double, minUniverse double, tolerance double") -> DataFrame:
    """A baseline's JSON object of repositories, a row each."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string, struct<{values.replace(' string', ':string').replace(' double', ':double')}>>").alias("m"))
    return text.select(F.explode("m").alias("repo", "v")).select("repo", "v.*")


def compile_commands(spark: SparkSession, path: str) -> DataFrame:
    """(file, directory, include) from a compilation database."""
    rows = spark.read.option("multiLine", "true").schema("file string, directory string, command string, arguments array<string>").json(path)
    words = F.coalesce("arguments", F.split("command", r"\s+"))
    return rows.select("file", "directory", F.explode(F.filter(words, lambda w: w.rlike("^-I.+"))).alias("include")).withColumn("include", F.expr("substring(include, 3)"))


def psr4(spark: SparkSession, path: str) -> DataFrame:
    """(prefix, folder) of a composer.json."""
    body = spark.read.text(path, wholetext=True).select(F.explode(F.from_json(F.get_json_object("value", "$.autoload['psr-4']"), "map<string,string>")).alias("prefix", "folder"))
    return body


def project_references(spark: SparkSession, path: str) -> DataFrame:
    """(include) project references of a .csproj."""
    text = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(r"<ProjectReference\s+Include=\"([^\"]+)\""), 1)).alias("include"))
    return text.withColumn("include", F.replace("include", F.lit("\\"), F.lit("/")))


def to_json(df: DataFrame, pretty: bool = False) -> str:
    """The rows as a JSON list; for results that a person reads."""
    rows = [json.loads(x) for x in df.toJSON().collect()]
    return json.dumps(rows, indent=2 if pretty else None, ensure_ascii=False)
