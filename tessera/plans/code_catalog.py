"""Registered queries over source text: a small repository in each language, once for every region, through the extractor and the edge builders.

NN in a text or path is replaced by X and the region's key. Expected rows are literal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import edges as E
from tessera.operators import native
from tessera.operators.calls import ancestors, calls
from tessera.operators.extract import extract_files
from tessera.operators.localtypes import local_types
from tessera.plans.code_expected import EXPECTED
from tessera.plans.registry import query
from tessera.runtime import materialize
from tessera.sources.driver_tables import table

SOURCES = {
    "java": {
        "java/NN/app/ServiceNN.java": ("java", """package appNN;
import storeNN.RepoNN;
import org.slf4j.Logger;
public class ServiceNN extends BaseNN {
    private RepoNN repo;
    public void run(String id, int n) {
        helper(id);
        repo.save(id);
        Logger.info(id);
        out.save(id);
        inherited(n);
        make().save(id);
        pick(3);
        new TaskNN(n);
    }
    private void helper(String s) { check(s); }
    RepoNN make() { return repo; }
    void pick(String s) { }
    void pick(long n) { }
    boolean check(String s) {
        return s.isEmpty();
    }
}
"""),
        "java/NN/app/BaseNN.java": ("java", "package appNN;\npublic class BaseNN {\n    protected void inherited(int n) { }\n}\n"),
        "java/NN/app/TaskNN.java": ("java", "package appNN;\nclass TaskNN {\n    TaskNN(int n) { }\n    public static void info(String s) { }\n}\n"),
        "java/NN/store/RepoNN.java": ("java", "package storeNN;\npublic class RepoNN {\n    public void save(String id) { }\n}\n"),
        "java/NN/store/CacheNN.java": ("java", "package storeNN;\npublic class CacheNN {\n    public void save(String id) { }\n}\n"),
    },
    "csharp": {
        "cs/NN/App.cs": ("csharp", """using NN.Conv;
namespace NN {
    public class AppNN {
        private readonly StoreNN store;
        public AppNN(StoreNN s) { store = s; }
        public void RunNN(string text)
        {
            ConvNN.ParseNN<int>(text);
            ConvNN.ParseNN(text);
            store.SaveNN(text);
            log.SaveNN(text);
            HelpNN(1);
            var q = new QueueNN();
            q.PushNN(text);
        }
        private void HelpNN(int n) { }
        private void HelpNN(int n, int m) { }
    }
}
"""),
        "cs/NN/Conv.cs": ("csharp", "public static class ConvNN {\n    public static object ParseNN(string s) { return s; }\n    public static T ParseNN<T>(string s) { return default(T); }\n}\n"),
        "cs/NN/Store.cs": ("csharp", "public class StoreNN {\n    public void SaveNN(string s) { }\n}\npublic class QueueNN {\n    public void SaveNN(string s) { }\n    public void PushNN(string s) { }\n}\n"),
    },
    "go": {
        "go/NN/main.go": ("go", """package main

import (
	"encoding/json"
	"example.com/NN/go/NN/renderNN"
)

const (
	Limit = 3
	second
)

type Server struct {
	cache *Cache
}

func (s *Server) Serve(n int) error {
	s.log(n)
	s.cache.Get(n)
	renderNN.New(n)
	json.Marshal(n)
	w := NewWriter(n)
	w.Write(n)
	return nil
}

func (s *Server) log(n int) {}

func NewWriter(n int) *Writer { return &Writer{} }
"""),
        "go/NN/cache.go": ("go", "package main\n\ntype Cache struct{}\n\nfunc (c *Cache) Get(n int) {}\n\ntype Writer struct{}\n\nfunc (w *Writer) Write(n int) {}\n\nfunc (c *Cache) Write(n int) {}\n"),
        "go/NN/renderNN/render.go": ("go", "package renderNN\n\nfunc New(n int) {}\n\nfunc Marshal(n int) {}\n"),
    },
    "rust": {
        "rs/NN/core/src/main.rs": ("rust", """use printer_NN::out;
mod parse;
pub struct Job {
    sink: Sink,
}
impl Job {
    pub fn new() -> Self { Job { sink: Sink {} } }
    pub fn drive(&self) {
        parse::run(1);
        drop(self);
        Job::new().finish();
        PathBuf::from(1);
        shown(2);
        deep(3);
        hidden(4);
    }
    fn finish(&self) {}
}
pub struct Sink {}
impl Sink {
    fn finish(&self) {}
}
fn from(n: i32) {}
"""),
        "rs/NN/core/src/parse.rs": ("rust", "pub fn run(n: i32) {}\n"),
        "rs/NN/core/src/other.rs": ("rust", "pub fn run(n: i32) {}\npub fn drop(n: i32) {}\n"),
        "rs/NN/printer_NN/src/lib.rs": ("rust", "pub use facade_NN::deep;\nuse private_NN::hidden;\npub fn shown(n: i32) {}\n"),
        "rs/NN/facade_NN/src/lib.rs": ("rust", "pub fn deep(n: i32) {}\n"),
        "rs/NN/private_NN/src/lib.rs": ("rust", "pub fn hidden(n: i32) {}\n"),
    },
    "typescript": {
        "ts/NN/app.ts": ("typescript", """import { Store } from './store';
import axios from 'axios';
export class AppNN extends BaseNN {
  constructor(private store: Store) { super(); }
  start(id: string): void {
    this.store.load(id);
    this.stop();
    axios.load(id);
    const c = new Cache();
    c.load(id);
    shared(id);
  }
  stop(): void { }
}
export const shared = (id: string) => { lowest(id); };
function lowest(id) { return id; }
"""),
        "ts/NN/store.ts": ("typescript", "import { Cache } from './cache';\nexport class Store {\n  load(id: string): void { }\n}\nexport class BaseNN {\n  constructor() { }\n}\n"),
        "ts/NN/cache.ts": ("typescript", "export class Cache {\n  load(id: string): void { }\n}\n"),
    },
    "php": {
        "php/NN/Shop.php": ("php", """<?php
class ShopNN {
    public function __construct(private CartNN $cart) { }
    public function buyNN() {
        $this->makeNN()->checkoutNN();
        $this->cart->addNN(1);
        $logger->addNN(2);
        $this->anyNN()->doneNN();
        return new WishNN();
    }
    function makeNN() { return new CartNN(); }
    function anyNN() { return $this->x; }
}
"""),
        "php/NN/Cart.php": ("php", "<?php\nclass CartNN {\n    public function checkoutNN() { }\n    public function addNN($n) { }\n    public function doneNN() { }\n}\n"),
        "php/NN/Wish.php": ("php", "<?php\nclass WishNN {\n    public function __construct() { }\n    public function checkoutNN() { }\n    public function addNN($n) { }\n    public function doneNN() { }\n}\n"),
    },
    "cpp": {
        "cpp/NN/a.cpp": ("cpp", """#include "b.hpp"
class EngineNN {
public:
  EngineNN(int n) : pump(n) { }
  void runNN(int n) { stepNN(n); }
  void stepNN(int n);
private:
  PumpNN pump;
};
void EngineNN::stepNN(int n) {
  pump.pushNN(n);
  vec.pushNN(n);
  freeNN(n);
  PumpNN other(n);
}
static void freeNN(int n) { }
"""),
        "cpp/NN/b.hpp": ("cpp", "struct PumpNN {\n  void pushNN(int n) { }\n};\nstruct TankNN {\n  void pushNN(int n) { }\n};\n"),
    },
    "python": {
        "py/NN/app.py": ("python", """import json
from .store import Store


def traced(f):
    return f


class AppNN(BaseNN):
    store: Store

    def __init__(self):
        super().__init__()

    @traced
    def run(self, item: Item):
        self.store.save(item)
        json.save(item)
        item.save()
        self.step()
        self.kept()
        return self.size

    def step(self):
        return helper(1)

    @property
    def size(self):
        return 1


def helper(n):
    return Store()
"""),
        "py/NN/store.py": ("python", "class Store:\n    def __init__(self):\n        pass\n\n    def save(self, x):\n        pass\n\n\nclass BaseNN:\n    def __init__(self):\n        pass\n\n    def kept(self):\n        pass\n"),
        "py/NN/broken.py": ("python", "from .app import helper\n\n\ndef good():\n    return helper(2)\n\n\ndef typing_now(:\n    helper(3)\n    # helper_not(4)\n\n\nclass After:\n    def stays(self):\n        return good()\n"),
        "py/NN/test_app.py": ("python", "from .app import helper\n\n\ndef test_helper():\n    assert helper(1)\n\n\ndef aid():\n    return helper(2)\n\n\ndef test_via():\n    aid()\n"),
    },
    "dispatch": {
        "go/NN/d/iface.go": ("go", "package d\n\ntype CloserNN interface {\n\tShutNN(n int)\n}\n\nfunc Drive(c CloserNN, n int) {\n\tc.ShutNN(n)\n}\n\nfunc Blind(n int) {\n\tthing.ShutNN(n)\n}\n"),
        **{f"go/NN/d/impl{k}.go": ("go", f"package d\n\ntype Impl{k} struct{{}}\n\nfunc (i *Impl{k}) ShutNN(n int) {{}}\n") for k in range(10, 28)},
    },
}


def files(spark, sf_dir):
    """(path, language, content) of the repositories, a copy of each for each region."""
    rows = spark.createDataFrame([(p, g, t) for some in SOURCES.values() for p, (g, t) in some.items()], "path string, language string, text string")
    key = F.concat(F.lit("X"), F.col("r_regionkey").cast("string"))
    named = lambda c: F.replace(c, F.lit("NN"), key)
    return table(spark, sf_dir, "region").select("r_regionkey").crossJoin(F.broadcast(rows)).select(named("path").alias("path"), "language", F.encode(named("text"), "UTF-8").alias("content"))


_built: dict[tuple[str, str, str], DataFrame] = {}


def _once(spark, sf_dir, name: str, make) -> DataFrame:
    """A table of the repositories, written once for each application."""
    key = (spark.sparkContext.applicationId, str(sf_dir), name)
    if key not in _built:
        _built[key] = materialize(make(), f"code-{name}", keep=True)
    return _built[key]


def extracted(spark, sf_dir):
    return _once(spark, sf_dir, "symbols", lambda: extract_files(files(spark, sf_dir)))


def scoped(spark, sf_dir):
    return _once(spark, sf_dir, "scope", lambda: E.scope(extracted(spark, sf_dir)))


def structured(spark, sf_dir):
    s = extracted(spark, sf_dir)
    return _once(spark, sf_dir, "structure", lambda: E.interface_satisfaction(s).unionByName(E.inheritance(s)))


def called(spark, sf_dir):
    return _once(spark, sf_dir, "calls", lambda: calls(extracted(spark, sf_dir), scoped(spark, sf_dir), structured(spark, sf_dir)))


def _short(c: str):
    """An id without its content's hash."""
    return F.regexp_replace(c, "@[0-9a-f]{40}", "")


def _values(rows: list[tuple], columns: str) -> str:
    """SQL of literal rows, a copy for each region."""
    lit = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"{x}::DOUBLE" if isinstance(x, float) else str(x).lower()
    body = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)
    named = ", ".join(f"replace({c}, 'NN', 'X' || r_regionkey) AS {c}" if isinstance(v, str) else c for c, v in zip(columns.split(), rows[0]))
    return f"SELECT {named} FROM region, (VALUES {body}) AS t({', '.join(columns.split())})"


def code_query(columns: str):
    """Registers a query whose rows are those of EXPECTED, for every region."""

    def add(function):
        return query(_values(EXPECTED[function.__name__], columns) if function.__name__ in EXPECTED else None)(function)

    return add


def _symbols_of(folder: str):
    def run(spark, sf_dir):
        s = extracted(spark, sf_dir).filter(F.col("file_path").startswith(folder) & ~F.col("file_path").contains("/d/"))
        return s.select("kind", _short("id").alias("symbol"), F.col("span.start").alias("first_line"), F.col("span.end").alias("last_line"), "exports")

    return run


def _edges_of(make, folder: str = "", *more: str):
    def run(spark, sf_dir):
        e = make(spark, sf_dir).filter(F.col("src").contains(folder) | F.col("dst").contains(folder))
        return e.select(_short("src").alias("src"), _short("dst").alias("dst"), *more)

    return run


def _add(name: str, columns: str, run) -> None:
    run.__name__ = name
    code_query(columns)(run)


for _folder in ("java", "cs", "go", "rs", "ts", "php", "cpp", "py"):
    _add(f"extract_{_folder}", "kind symbol first_line last_line exports", _symbols_of(f"{_folder}/"))
    _add(f"calls_{_folder}", "src dst confidence source reason", (lambda folder: lambda spark, sf_dir: _edges_of(called, folder, "confidence", "source", "reason")(spark, sf_dir).filter("src NOT LIKE '%/d/%'"))(f"{_folder}/"))
_add("dispatch_rescue", "src dst confidence source reason", _edges_of(called, "/d/", "confidence", "source", "reason"))
_add("import_edges", "src dst type confidence", _edges_of(lambda spark, d: E.imports(extracted(spark, d)), "", "type", "confidence"))
_add("extends_regex", "src dst type confidence", _edges_of(lambda spark, d: structured(spark, d).filter("reason = 'type-ref'"), "", "type", "confidence"))
_add("interface_satisfaction", "src dst type confidence", _edges_of(lambda spark, d: structured(spark, d).filter("reason = 'method-set'"), "", "type", "confidence"))
_add("uses_type_tokens", "src dst confidence", _edges_of(lambda spark, d: E.uses_type(extracted(spark, d), scoped(spark, d)), "", "confidence"))
_add("decorator_supplement", "src dst confidence reason", _edges_of(lambda spark, d: E.decorators(extracted(spark, d), called(spark, d), scoped(spark, d)), "", "confidence", "reason"))
_add("tests_edge_confidence_tiers", "src dst confidence reason", _edges_of(lambda spark, d: E.tests(extracted(spark, d), called(spark, d), scoped(spark, d)), "", "confidence", "reason"))
_add("contains_code", "src dst", _edges_of(lambda spark, d: E.contains(extracted(spark, d)), ""))


@code_query("from_file to_file")
def scope_semi_join(spark, sf_dir):
    return scoped(spark, sf_dir).filter("from_file <> to_file AND from_file NOT LIKE '%/d/%'")


@code_query("caller variable type")
def local_types_code(spark, sf_dir):
    s = extracted(spark, sf_dir).filter("file_path NOT LIKE '%/d/%'")
    return local_types(s, ancestors(s, structured(spark, sf_dir))).select(_short("caller").alias("caller"), "variable", F.upper("type_lc").alias("type"))


@code_query("src dst type confidence")
def native_types(spark, sf_dir):
    """Types named in bodies and declared bases, as the analyzers of their languages have them."""
    s = extracted(spark, sf_dir).filter("file_path NOT LIKE '%/d/%'")
    found = None
    for a in native.defaults():
        part = native.named_types(s, a.names, a.in_signature, a.in_body)
        part = part.unionByName(native.declared_bases(s, a.names, a.bases)) if a.bases else part
        found = part if found is None else found.unionByName(part)
    return found.select(_short("src").alias("src"), _short("dst").alias("dst"), "type", "confidence")


@code_query("src dst confidence")
def native_imports(spark, sf_dir):
    """Imports that analyzers tell from the files alone: Python modules, Rust mod lines, quoted includes."""
    s, f = extracted(spark, sf_dir), files(spark, sf_dir)
    by_kind = {type(a): a for a in native.defaults()}
    parts = [native.Python.imports(by_kind[native.Python], s, f), native.Rust.imports(by_kind[native.Rust], s, f), native.quoted_includes(f)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("src", "dst", "confidence")


@code_query("src dst confidence")
def native_python_calls(spark, sf_dir):
    return native.python_calls(extracted(spark, sf_dir), files(spark, sf_dir)).select(_short("src").alias("src"), _short("dst").alias("dst"), "confidence")


@code_query("symbol argc arguments generic callee")
def call_site_forms(spark, sf_dir):
    """Normal forms of call sites: qualifier, number and kinds of arguments, explicit type arguments."""
    s = extracted(spark, sf_dir).filter("call_sites IS NOT NULL AND file_path NOT LIKE '%/d/%'").select(_short("id").alias("symbol"), F.explode("call_sites").alias("s"))
    return s.select("symbol", "s.argc", F.array_join("s.args", "|").alias("arguments"), "s.generic", "s.callee")
