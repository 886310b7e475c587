"""Certification of unified diffs against the indexed graph."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.intervals import overlapping, touched
from tessera.operators.traverse import covering, followed, inbound
from tessera.policy import DIAGNOSTIC, TraversalPolicy
from tessera.runtime import materialize, ship
from tessera.schemas import IMPACT_TYPES

_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


class MalformedDiff(ValueError):
    """The text is not a unified diff."""


def _path(line: str) -> str:
    name = line.split("\t", 1)[0].strip().strip('"')
    return name[2:] if name[:2] in ("a/", "b/") else name


def parse_diff(text: str) -> list[dict]:
    """Files of a git diff: path, deleted, binary, and hunks (first, last) of the new file's changed lines.

    A hunk's range holds only lines added or, for lines taken away, the line where they were; context is left out. A file whose
    mode or name alone changed is dropped. ``+++`` counts as a header only between hunks. Raises MalformedDiff.
    """
    files: list[dict] = []
    now: dict | None = None
    old_left = new_left = line_no = 0
    touched: list[int] | None = None

    def close():
        nonlocal touched
        if now is not None and touched:
            now["hunks"].append((min(touched), max(touched)))
        touched = None

    for raw in text.split("\n"):
        line = raw.removesuffix("\r")
        if old_left > 0 or new_left > 0:
            mark = line[:1]
            if mark == "+":
                touched.append(max(line_no, 1))
                line_no, new_left = line_no + 1, new_left - 1
            elif mark == "-":
                touched.append(max(line_no, 1))
                old_left -= 1
            elif mark in (" ", ""):
                line_no, old_left, new_left = line_no + 1, old_left - 1, new_left - 1
            elif mark != "\\":
                raise MalformedDiff(f"unexpected line in a hunk: {line[:60]!r}")
            if old_left < 0 or new_left < 0:
                raise MalformedDiff("a hunk has more lines than its header says")
            continue
        if line.startswith("diff --git "):
            close()
            tail = line[len("diff --git ") :].split(" b/", 1)
            now = {"path": tail[1] if len(tail) == 2 else "", "deleted": False, "binary": False, "hunks": [], "named": False}
            files.append(now)
        elif line.startswith("--- ") and now is not None:
            now["old"] = _path(line[4:])
        elif line.startswith("+++ "):
            if now is None:
                raise MalformedDiff("a file without its diff --git line")
            now["named"] = True
            name = _path(line[4:])
            if name == "/dev/null":
                now["deleted"], now["path"] = True, now.get("old", now["path"])
            else:
                now["path"] = name
        elif line.startswith(("Binary files ", "GIT binary patch")) and now is not None:
            now["binary"] = True
        elif line.startswith("deleted file mode") and now is not None:
            now["deleted"] = True
        elif line.startswith("@@"):
            close()
            m = _HUNK.match(line)
            if now is None or m is None or not now["named"]:
                raise MalformedDiff(f"a hunk out of place or with a bad range: {line[:60]!r}")
            old_left, line_no, new_left = int(m[2] or 1), int(m[3]), int(m[4] or 1)
            if m[4] == "0":
                line_no += 1
            touched = []
        elif now is None and line.strip() and not files and line.startswith(("+", "-")):
            raise MalformedDiff("changes before any file")
    close()
    if old_left > 0 or new_left > 0:
        raise MalformedDiff("the last hunk is cut short")
    if text.strip() and not files:
        raise MalformedDiff("no file in it")
    return [{k: f[k] for k in ("path", "deleted", "binary", "hunks")} for f in files if f["hunks"] or f["deleted"] or f["binary"] or f["named"]]


FILES = "diff_id string, malformed string, path string, deleted boolean, binary boolean, hunk int, new_start int, new_end int"


def diff_hunks(diffs: DataFrame) -> DataFrame:
    """A row for each hunk of diffs (diff_id, unified_diff); a file without hunks has one with null ranges, a malformed diff one with its reason."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in FILES.split(", ")]
        for batch in batches:
            rows: list[tuple] = []
            for key, text in zip(batch.diff_id, batch.unified_diff):
                try:
                    for f in parse_diff(text or ""):
                        head = (key, None, f["path"], f["deleted"], f["binary"])
                        rows += [(*head, n, a, b) for n, (a, b) in enumerate(f["hunks"])] or [(*head, None, None, None)]
                except MalformedDiff as error:
                    rows.append((key, str(error), None, None, None, None, None, None))
            frame = pd.DataFrame(rows, columns=names)
            yield frame.astype({c: "Int32" for c in ("hunk", "new_start", "new_end")} | {c: "boolean" for c in ("deleted", "binary")})

    ship(diffs.sparkSession)
    return diffs.select(F.col("diff_id").cast("string"), F.col("unified_diff").cast("string")).mapInPandas(run, FILES)


def _sides(hunks: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    h = hunks.filter("new_start IS NOT NULL AND NOT deleted AND NOT binary").select("diff_id", "hunk", F.col("path").alias("file_path"), "new_start", "new_end")
    return h, symbols.select("id", "file_path", "kind", "name", "language", F.col("span.start").alias("span_start"), F.col("span.end").alias("span_end"), "annotations")


def changed_symbols(hunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """(diff_id, hunk, symbol columns): symbols whose lines a hunk touches, documents and files aside."""
    return overlapping(*_sides(hunks, symbols), "file_path", ("new_start", "new_end"), ("span_start", "span_end"))


def touched_symbols(hunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol columns): the symbols of changed_symbols, without the hunks, each row once however many touch it."""
    h, s = _sides(hunks, symbols)
    return touched(s, h, "file_path", ("span_start", "span_end"), ("new_start", "new_end"))


def file_findings(hunks: DataFrame, manifest: DataFrame, current: DataFrame, mapped: DataFrame) -> DataFrame:
    """(diff_id, path, hunk, finding): what cannot be told of a file or hunk, the first that holds.

    manifest has file_path and blob_sha as indexed; current has file_path and blob_sha of the content now (a file not in
    it is taken to be as indexed); mapped has diff_id, hunk and file_path of hunks with a symbol.
    """
    m = manifest.select(F.col("file_path").alias("path"), F.col("blob_sha").alias("indexed_sha"))
    c = current.select(F.col("file_path").alias("path"), F.col("blob_sha").alias("current_sha"))
    x = mapped.select("diff_id", F.col("file_path").alias("path"), "hunk").distinct().withColumn("mapped", F.lit(True))
    joined = hunks.filter("malformed IS NULL").join(m, "path", "left").join(c, "path", "left").join(x, ["diff_id", "path", "hunk"], "left")
    finding = (
        F.when(F.col("binary"), "binary_change").when(F.col("deleted"), "deleted_file").when(F.col("new_start").isNull(), "diff_no_hunks").when(F.col("indexed_sha").isNull(), "file_not_indexed")
        .when(F.col("current_sha") != F.col("indexed_sha"), "index_stale").when(F.col("mapped").isNull(), "hunk_unmapped")
    )
    per_file = F.col("finding").isin("binary_change", "deleted_file", "file_not_indexed", "index_stale")
    return joined.withColumn("finding", finding).filter("finding IS NOT NULL").select("diff_id", "path", F.when(~per_file, F.col("hunk")).alias("hunk"), "finding").distinct()


def impacted(changed: DataFrame, edges: DataFrame, depth: int = 3, policy: TraversalPolicy = DIAGNOSTIC) -> DataFrame:
    """(node, depth) of what depends on the changed symbols (id), without those."""
    return inbound(followed(edges, IMPACT_TYPES, policy), changed.select(F.col("id").alias("node")), depth).filter("depth > 0")


def missing_tests(changed: DataFrame, edges: DataFrame, is_test, depth: int = 6) -> DataFrame:
    """Changed code symbols, not tests themselves, into which no covering test has a direct edge."""
    tests = covering(edges, changed.select(F.col("id").alias("node")), DIAGNOSTIC, depth)
    direct = edges.filter(F.col("type").isin(*IMPACT_TYPES)).join(tests.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    return changed.filter((F.col("language") != "plaintext") & ~is_test).join(direct, "id", "left_anti")


def verdicts(diffs: DataFrame, hunks: DataFrame, findings: DataFrame, missing: DataFrame | None = None) -> DataFrame:
    """(diff_id, verdict, unknowns): block where malformed, manual_review where anything is unknown, else allow; an empty diff is allowed."""
    bad = hunks.filter("malformed IS NOT NULL").select("diff_id").distinct().withColumn("bad", F.lit(True))
    every = findings.select("diff_id")
    if missing is not None:
        every = every.unionByName(missing.select("diff_id"))
    n = every.groupBy("diff_id").agg(F.count("*").alias("n"))
    joined = diffs.select(F.col("diff_id").cast("string").alias("diff_id")).join(bad, "diff_id", "left").join(n, "diff_id", "left")
    return joined.select("diff_id", F.when(F.col("bad"), "block").when(F.col("n") > 0, "manual_review").otherwise("allow").alias("verdict"), F.coalesce("n", F.lit(0)).cast("long").alias("unknowns"))


def certify(unified_diff: str, symbols: DataFrame, edges: DataFrame, manifest: DataFrame, current: DataFrame, is_test, require_tests: bool = False) -> dict:
    """A report on one diff: verdict, findings, changed and impacted symbols, covering tests."""
    spark = symbols.sparkSession
    diffs = spark.createDataFrame([("diff", unified_diff)], "diff_id string, unified_diff string")
    hunks = materialize(diff_hunks(diffs), "hunks")
    changed = materialize(changed_symbols(hunks, symbols), "changed")
    findings = file_findings(hunks, manifest, current, changed)
    code = changed.dropDuplicates(["id"])
    missing = missing_tests(code, edges, is_test) if require_tests else None
    verdict = verdicts(diffs, hunks, findings, missing).first()
    tests = covering(edges, code.select(F.col("id").alias("node")), DIAGNOSTIC, 6)
    ids = lambda df, c: [r[0] for r in df.select(c).distinct().orderBy(c).collect()]
    rows = [r.asDict() for r in findings.orderBy("path", "hunk", "finding").collect()]
    if missing is not None:
        rows += [{"path": r.file_path, "hunk": None, "finding": "missing_test", "symbol": r.id} for r in missing.orderBy("file_path", "span_start", "id").collect()]
    return {"verdict": verdict.verdict, "findings": rows, "changed": ids(code, "id"), "impacted": ids(impacted(code, edges).join(symbols.select(F.col("id").alias("node")), "node", "left_semi"), "node"), "tests": ids(tests, "node")}


#: Exit codes of the command line by verdict; anything else that goes wrong is 1.
EXIT = {"allow": 0, "manual_review": 2, "block": 3}
