"""The command line: python -m tessera.cli COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from tessera.api import Engine
from tessera.operators.certify import EXIT
from tessera.policy import CERTIFICATION, DIAGNOSTIC, IMPACT, TESTS
from tessera.sources.scan import to_json

VERSION = "0.1.0"
POLICIES = {p.name: p for p in (DIAGNOSTIC, TESTS, IMPACT, CERTIFICATION)}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera")
    top.add_argument("--root", default=".")
    top.add_argument("--refresh", action="store_true", help="index before answering")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("version", "init", "status"):
        sub.add_parser(name)
    sub.add_parser("index").add_argument("--force", action="store_true")
    for name in ("symbols", "query"):
        p = sub.add_parser(name)
        p.add_argument("text", nargs="?", default="")
        p.add_argument("--limit", type=int, default=50 if name == "symbols" else 20)
    sub.add_parser("deps").add_argument("path")
    sub.add_parser("file-symbols").add_argument("path")
    for name in ("impact", "tests"):
        p = sub.add_parser(name)
        p.add_argument("text")
        p.add_argument("--policy", choices=POLICIES, default="diagnostic" if name == "impact" else "tests")
        if name == "impact":
            p.add_argument("--depth", type=int, default=3)
    for name in ("icr", "lock", "unlock"):
        sub.add_parser(name).add_argument("intent")
    p = sub.add_parser("conflicts")
    p.add_argument("a")
    p.add_argument("b")
    p = sub.add_parser("certify")
    p.add_argument("diff", help="a file, or - for standard input")
    p.add_argument("--require-tests", action="store_true")
    sub.add_parser("mcp", help="answer JSON-RPC on standard input")
    return top


def run(argv: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    out = out or sys.stdout
    a = parser().parse_args(argv)
    if a.command == "version":
        print(VERSION, file=out)
        return 0
    engine = Engine.open(spark or SparkSession.builder.appName("tessera").getOrCreate(), a.root)
    say = lambda x: print(json.dumps(x, indent=2, default=str), file=out)
    show = lambda df: print(to_json(df, pretty=True), file=out)
    slim = ("id", "file_path", "kind", "qualified_name", "signature", "span")
    if a.command in ("init", "index"):
        say(engine.index(force=getattr(a, "force", False)))
        return 0
    if a.refresh:
        engine.index()
    match a.command:
        case "status":
            say(engine.status())
        case "symbols":
            show(engine.symbols(a.text, a.limit).select(*slim, "rank"))
        case "query":
            show(engine.query(a.text, a.limit).select(*slim, "tier"))
        case "deps":
            show(engine.deps(a.path))
        case "file-symbols":
            show(engine.file_symbols(a.path).select(*slim))
        case "impact":
            show(engine.impact(a.text, a.depth, POLICIES[a.policy]).select(*slim, "depth"))
        case "tests":
            show(engine.tests(a.text, POLICIES[a.policy]).select(*slim))
        case "icr":
            show(engine.icr(a.intent))
        case "conflicts":
            show(engine.conflicts(a.a, a.b))
        case "lock":
            got = engine.lock(a.intent)
            say({"acquired": got})
            return 0 if got else 1
        case "unlock":
            say({"released": engine.unlock(a.intent)})
        case "mcp":
            from tessera.server import Server

            Server(engine).serve()
        case "certify":
            report = engine.certify(sys.stdin.read() if a.diff == "-" else Path(a.diff).read_text(), a.require_tests)
            say(report)
            return EXIT[report["verdict"]]
    return 0


if __name__ == "__main__":
    sys.exit(run())
