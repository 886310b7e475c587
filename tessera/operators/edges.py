"""Edge builders: symbols in, edges out, each a plan of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import base_name, dir_name, fold_path, has_test_annotation, is_test_path, stem, suffixes
from tessera.operators.expand import expand
from tessera.operators.merge import division
from tessera.runtime import materialize
from tessera.schemas import CALLABLE

#: In these languages any file of the language is in reach without an import.
REPO_WIDE = ("csharp", "php", "c", "cpp")
SAME_DIR = ("go", "java")
CAP = 16


def edge(df: DataFrame, kind: str, confidence: float | Column, source: str, reason: str, src: str = "src", dst: str = "dst") -> DataFrame:
    c = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return df.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(kind).alias("type"), c.cast("double").alias("confidence"), F.lit(source).alias("source"), F.lit(reason).alias("reason"))


def family(language: Column) -> Column:
    """Languages whose files may use one another."""
    return F.when(language.isin("javascript", "typescript", "tsx"), "web").when(language.isin("c", "cpp"), "c").otherwise(language)


def crate_root(path: Column) -> Column:
    """The folder of the crate that a Rust file belongs to: what holds its src, tests, benches or examples folder, else its own."""
    return F.when(path.rlike(r"(^|/)(src|tests|benches|examples)/"), F.regexp_extract(path, r"^(.*?)/?(?:src|tests|benches|examples)/", 1)).otherwise(dir_name(path))


def crate_scope(symbols: DataFrame) -> DataFrame:
    """(from_file, to_file) over crates, marked crate: and their folder: the own one, those that any file of it uses, and what these re-export by ``pub use``, and so on."""
    files = symbols.filter("language = 'rust'").select(crate_root(F.col("file_path")).alias("root"), "imports")
    roots = files.select("root").distinct()
    named = roots.select("root", F.replace(F.lower(base_name(F.col("root"))), F.lit("-"), F.lit("_")).alias("name"))
    used = files.select("root", F.explode("imports").alias("imp")).distinct()
    head = F.lower(F.substring_index(F.regexp_replace("imp", r"^pub (use )?", ""), "::", 1))
    used = used.select("root", F.col("imp").startswith("pub ").alias("public"), head.alias("name")).filter("name NOT IN ('', 'crate', 'super', 'self', 'std', 'core', 'alloc')")
    # a package's name often has the folder's as its last word
    tries = used.withColumn("short", F.substring_index("name", "_", -1))
    exact = tries.join(named.withColumnRenamed("root", "to"), "name").select("root", "public", "name", "to")
    short = tries.join(named.select("name"), "name", "left_anti").join(named.select(F.col("root").alias("to"), F.col("name").alias("short")), "short").select("root", "public", "name", "to")
    links = materialize(exact.unionByName(short).filter("root <> to").select("root", "public", "to").distinct(), "crate-links")
    found = materialize(links.select("root", "to").distinct(), "crates")
    again = links.filter("public").select(F.col("root").alias("to"), F.col("to").alias("next")).distinct()
    size = found.count()
    while size:
        found = materialize(found.unionByName(found.join(again, "to").select("root", F.col("next").alias("to"))).filter("root <> to").distinct(), "crates")
        more = found.count()
        if more == size:
            break
        size = more
    mark = lambda c: F.concat(F.lit("crate:"), c)
    return found.unionByName(roots.select("root", F.col("root").alias("to"))).select(mark("root").alias("from_file"), mark("to").alias("to_file"))


def scope(symbols: DataFrame) -> DataFrame:
    """(from_file, to_file): the files whose symbols a file can name, itself among them. Repo-wide languages are left out; Rust has rows for crates instead; see in_scope.

    Relative imports are folded onto the file's folder; others match a file without its extension, or by any of their
    slash-suffixes a folder, or by their last part a folder's or a file's name. Suffixes are exploded, so that every rule is an equi-join.
    """
    files = symbols.select(F.col("file_path").alias("to_file"), family(F.col("language")).alias("fam")).distinct()
    own = symbols.filter("language <> 'rust'").select(F.col("file_path").alias("from_file"), "language", family(F.col("language")).alias("fam")).distinct()
    raw = symbols.filter(~F.col("language").isin(*REPO_WIDE, "plaintext", "rust")).select(F.col("file_path").alias("from_file"), "language", family(F.col("language")).alias("fam"), F.explode("imports").alias("imp")).distinct()
    here = dir_name(F.col("from_file"))
    dots = F.length(F.regexp_extract("imp", r"^(\.+)", 1))
    py_rel = F.concat_ws("/", here, F.repeat(F.lit("../"), dots - 1), F.replace(F.regexp_replace("imp", r"^\.+", ""), F.lit("."), F.lit("/")))
    relative = F.when((F.col("language") == "python") & F.col("imp").startswith("."), fold_path(py_rel)).when(F.col("imp").rlike(r"^\.\.?(/|$)"), fold_path(F.concat_ws("/", here, "imp")))
    plain = (
        F.when(F.col("language").isin("python", "java"), F.replace("imp", F.lit("."), F.lit("/")))
        .otherwise(F.col("imp"))
    )
    imports = raw.withColumn("relative", relative).withColumn("path", F.coalesce("relative", plain))
    bare = F.regexp_replace("to_file", r"\.[^./]+$", "")
    named = files.select("to_file", "fam", bare.alias("path")).unionByName(files.select("to_file", "fam", F.regexp_replace(bare, r"/(index|__init__|mod|lib)$", "").alias("path")))
    exact = imports.withColumn("path", F.regexp_replace("path", r"\.(js|ts|jsx|tsx|mjs|cjs)$", "")).join(named, ["fam", "path"]).select("from_file", "to_file")
    # a dotted import may name a member of the file
    member = imports.filter("relative IS NULL AND language IN ('python', 'java')").withColumn("path", dir_name(F.col("path"))).join(named, ["fam", "path"]).select("from_file", "to_file")
    loose = imports.filter("relative IS NULL")
    dirs = files.select("to_file", "fam", dir_name(F.col("to_file")).alias("dir"))
    by_suffix = loose.select("from_file", "fam", F.explode(suffixes(F.col("path"))).alias("dir")).join(dirs, ["fam", "dir"]).select("from_file", "to_file")
    last = loose.select("from_file", "fam", base_name(F.col("path")).alias("last"))
    by_dir = last.join(dirs.select("to_file", "fam", base_name(F.col("dir")).alias("last")), ["fam", "last"]).select("from_file", "to_file")
    by_file = last.join(files.select("to_file", "fam", stem(F.col("to_file")).alias("last")), ["fam", "last"]).select("from_file", "to_file")
    near = own.filter(F.col("language").isin(*SAME_DIR)).select("from_file", "fam", here.alias("dir")).join(dirs, ["fam", "dir"]).select("from_file", "to_file")
    self_ = own.select("from_file", F.col("from_file").alias("to_file"))
    found = self_
    for part in (exact, member, by_suffix, by_dir, by_file, near):
        found = found.unionByName(part)
    return found.distinct().unionByName(crate_scope(symbols))


def in_scope(pairs: DataFrame, scope_table: DataFrame) -> DataFrame:
    """pairs (with from_file, to_file, from_language, to_language) whose target is in reach."""
    wide = F.col("from_language").isin(*REPO_WIDE)
    free = pairs.filter(wide & (family(F.col("from_language")) == family(F.col("to_language"))))
    place = lambda file, language: F.when(F.col(language) == "rust", F.concat(F.lit("crate:"), crate_root(F.col(file)))).otherwise(F.col(file))
    near = scope_table.select(F.col("from_file").alias("_from"), F.col("to_file").alias("_to"))
    bound = pairs.filter(~wide).withColumns({"_from": place("from_file", "from_language"), "_to": place("to_file", "to_language")}).join(near, ["_from", "_to"], "left_semi")
    return free.unionByName(bound.select(*free.columns))


def defines(symbols: DataFrame) -> DataFrame:
    return edge(symbols.select(F.concat(F.lit("file:"), "file_path").alias("src"), F.col("id").alias("dst")), "defines", 1.0, "ast", "structural")


def imports(symbols: DataFrame) -> DataFrame:
    """From the file to each string that one of its symbols imports."""
    rows = symbols.select("file_path", F.explode("imports").alias("imp")).select(F.concat(F.lit("file:"), "file_path").alias("src"), F.concat(F.lit("import:"), "imp").alias("dst")).distinct()
    return edge(rows, "imports", 0.9, "ast", "structural")


def contains(symbols: DataFrame) -> DataFrame:
    """From a class-like symbol to those of its file that name it as their parent, without case."""
    parents = symbols.filter(F.col("kind").isin("struct", "class", "interface", "trait")).select(F.col("id").alias("src"), "file_path", F.lower("name").alias("parent"))
    children = symbols.filter("parent_symbol IS NOT NULL AND parent_symbol <> ''").select(F.col("id").alias("dst"), "file_path", F.lower("parent_symbol").alias("parent"))
    return edge(expand(parents, children, ["file_path", "parent"], "dst").filter("src <> dst"), "contains", 1.0, "ast", "structural")


def _bases() -> list[tuple[Column, str, Column, float]]:
    """(languages, kind of edge, array of base names, confidence)."""
    lang, sig, body = F.col("language"), F.col("signature"), F.col("raw_text")
    web_java = lang.isin("javascript", "typescript", "tsx", "java")
    cut = lambda text: F.transform(F.split(text, ","), lambda x: F.regexp_extract(F.trim(x), r"^([\w.]+)", 1))
    first = F.substring_index(body, "\n", 1)
    return [
        (web_java, "extends", F.regexp_extract_all(sig, F.lit(r"\bextends\s+([\w.]+)"), 1), 0.85),
        (web_java, "implements", cut(F.regexp_extract(sig, r"\bimplements\s+([^{]+)", 1)), 0.85),
        (lang == "python", "extends", F.when(F.col("kind") == "class", cut(F.regexp_extract(first, r"^\s*class\s+\w+\s*\(([^)]*)\)", 1))), 0.85),
        (lang == "rust", "implements", F.regexp_extract_all(body, F.lit(r"\bimpl(?:<[^>]*>)?\s+([\w:]+)(?:<[^>]*>)?\s+for\s+\w+"), 1), 0.85),
        (lang == "go", "extends", F.when(F.col("kind") == "struct", F.regexp_extract_all(body, F.lit(r"(?m)^[ \t]+\*?(?:\w+\.)?([A-Z]\w*)[ \t]*$"), 1)), 0.7),
    ]


def inheritance(symbols: DataFrame) -> DataFrame:
    """extends and implements by the declaration's text; bases match any symbol of that name, without case or scope."""
    targets = symbols.select(F.col("id").alias("dst"), F.lower("name").alias("base"))
    found = None
    for languages, kind, names, confidence in _bases():
        rows = symbols.filter(languages).select(F.col("id").alias("src"), F.explode(F.array_distinct(F.transform(names, lambda x: F.lower(F.substring_index(F.regexp_replace(x, "::", "."), ".", -1))))).alias("base")).filter("base <> ''")
        part = edge(rows.join(targets, "base").filter("src <> dst").distinct(), kind, confidence, "heuristic", "type-ref")
        found = part if found is None else found.unionByName(part)
    return found


def _with_targets(rows: DataFrame, symbols: DataFrame, key: str) -> DataFrame:
    """rows (src, from_file, from_language, key) joined to symbols of that lower-case name."""
    targets = symbols.select(F.col("id").alias("dst"), F.col("file_path").alias("to_file"), F.col("language").alias("to_language"), F.col("kind").alias("to_kind"), F.col("name").alias("to_name"), F.lower("name").alias(key))
    return rows.join(targets, key).filter("src <> dst")


def uses_type(symbols: DataFrame, scope_table: DataFrame) -> DataFrame:
    """From a symbol to those in scope that a capitalised word of its signature names, without case."""
    words = F.regexp_extract_all("signature", F.lit(r"\b([A-Z][A-Za-z0-9_]+)\b"), 1)
    rows = symbols.select(F.col("id").alias("src"), F.col("file_path").alias("from_file"), F.col("language").alias("from_language"), F.lower("name").alias("own"), F.explode(F.array_distinct(F.transform(words, F.lower))).alias("type_lc")).filter("own <> type_lc")
    return edge(in_scope(_with_targets(rows, symbols, "type_lc"), scope_table).select("src", "dst").distinct(), "uses-type", 0.5, "heuristic", "type-ref")


def interface_satisfaction(symbols: DataFrame) -> DataFrame:
    """implements from a type to an interface whose methods it all has, and overrides from each such method to the interface.

    A type is a folder and a parent's name; an interface's methods are its members, or those its text declares.
    """
    ifaces = symbols.filter(F.col("kind").isin("interface", "trait"))
    listed = F.regexp_extract_all("raw_text", F.lit(r"(?m)^[ \t]+(?:fn |func |def )?([A-Za-z_]\w*)\s*(?:<[^>]*>)?\("), 1)
    need = ifaces.select(F.col("id").alias("iface"), "language", F.explode(F.array_distinct(listed)).alias("method"))
    have = symbols.filter(F.col("kind").isin("method", "function", "constructor") & (F.col("parent_symbol") != "")).select(F.struct("language", dir_name(F.col("file_path")).alias("dir"), F.lower("parent_symbol").alias("parent")).alias("owner"), F.col("name").alias("method"), F.col("id").alias("method_id"))
    met = division(have, need, "owner", "iface", "method").join(need.select("iface", "language").distinct(), "iface").filter("owner.language = language")
    named = ifaces.select(F.col("id").alias("iface"), F.lower("name").alias("iface_lc"))
    met = materialize(met.join(named, "iface").filter("owner.parent <> iface_lc").select("owner", "iface"), "satisfied")
    types = symbols.filter(F.col("kind").isin("struct", "class", "type")).select(F.struct("language", dir_name(F.col("file_path")).alias("dir"), F.lower("name").alias("parent")).alias("owner"), F.col("id").alias("type_id"))
    implements = edge(met.join(types, "owner").groupBy("owner", "iface").agg(F.max("type_id").alias("src")).withColumnRenamed("iface", "dst"), "implements", 0.75, "heuristic", "method-set")
    overrides = edge(met.join(need.select("iface", "method"), "iface").join(have, ["owner", "method"]).select(F.col("method_id").alias("src"), F.col("iface").alias("dst")).distinct(), "overrides", 0.75, "heuristic", "method-set")
    return implements.unionByName(overrides)


BUILTIN_DECORATORS = ("property", "staticmethod", "classmethod", "cached_property", "abstractmethod", "override", "overload", "dataclass", "final", "wraps", "lru_cache", "cache", "contextmanager")


def decorators(symbols: DataFrame, calls: DataFrame, scope_table: DataFrame) -> DataFrame:
    """calls from the one in-scope function that a bare decorator names to what it wraps, and from its callers to the decorator."""
    mark = F.explode(F.col("annotations")).alias("mark")
    rows = symbols.filter(F.col("language").isin("python", "typescript", "tsx", "javascript")).select(F.col("id").alias("wrapped"), F.col("file_path").alias("from_file"), F.col("language").alias("from_language"), mark)
    rows = rows.withColumn("deco", F.regexp_extract("mark", r"^@?([A-Za-z_]\w*)(\(.*)?$", 1)).filter((F.col("deco") != "") & ~F.col("deco").isin(*BUILTIN_DECORATORS))
    targets = symbols.filter("kind = 'function'").select(F.col("id").alias("wrapper"), F.col("name").alias("deco"), F.col("file_path").alias("to_file"), F.col("language").alias("to_language"))
    hits = in_scope(rows.join(targets, "deco").filter("wrapper <> wrapped"), scope_table)
    sole = hits.groupBy("wrapped", "deco").agg(F.min("wrapper").alias("wrapper"), F.countDistinct("wrapper").alias("n")).filter("n = 1")
    first = edge(sole, "calls", 0.7, "heuristic", "decorator", "wrapper", "wrapped")
    second = edge(calls.filter("type = 'calls'").select(F.col("src").alias("caller"), F.col("dst").alias("wrapped")).join(sole, "wrapped").filter("caller <> wrapper"), "calls", 0.7, "heuristic", "decorator", "caller", "wrapper")
    return first.unionByName(second).distinct()


def is_test_symbol() -> Column:
    return is_test_path(F.col("file_path")) | has_test_annotation(F.col("annotations"))


def tests(symbols: DataFrame, calls: DataFrame, scope_table: DataFrame, helpers: int = 3) -> DataFrame:
    """From test functions to what they test; the first rule that gives a pair stays.

    By name (TestX, test_x, XTest, XSpec) in scope at 0.8; else by calls: directly 0.85, through 1 to 3 helpers
    in test code 0.75, 0.65, 0.6, and one call beyond the production symbol 0.55.
    """
    callable_ = F.col("kind").isin(*CALLABLE)
    test = symbols.filter(is_test_symbol() & (F.col("language") != "plaintext")).select("id", "file_path", "language", "name", "kind")
    test_ids, code = test.select("id"), symbols.join(test.select("id"), "id", "left_anti").filter("language <> 'plaintext'")
    bare = F.lower(F.coalesce(F.nullif(F.regexp_extract("name", r"^(?i:test)_?(.+)$", 1), F.lit("")), F.nullif(F.regexp_extract("name", r"^(.+?)_?(?i:test|spec)$", 1), F.lit(""))))
    rows = test.select(F.col("id").alias("src"), F.col("file_path").alias("from_file"), F.col("language").alias("from_language"), bare.alias("base")).filter("base IS NOT NULL")
    named = in_scope(_with_targets(rows, code, "base"), scope_table).select("src", "dst", F.lit(0).alias("rule"), F.lit(0.8).alias("confidence"))
    links = calls.filter("type = 'calls'").select("src", "dst").distinct()
    start = test.filter(callable_).select(F.col("id").alias("src"), F.col("id").alias("at"))
    found, at = named, start
    for depth, c in enumerate((0.85, 0.75, 0.65, 0.6)[: helpers + 1]):
        step = at.join(links.select(F.col("src").alias("at"), F.col("dst").alias("next")), "at").select("src", F.col("next").alias("at")).filter("src <> at").distinct()
        into = step.join(code.select(F.col("id").alias("at")), "at", "left_semi").select("src", F.col("at").alias("dst"))
        found = found.unionByName(into.select("src", "dst", F.lit(1 + depth).alias("rule"), F.lit(c).alias("confidence")))
        beyond = into.join(links.select(F.col("src").alias("dst"), F.col("dst").alias("next")), "dst").select("src", F.col("next").alias("dst")).join(code.select(F.col("id").alias("dst")), "dst", "left_semi").distinct()
        found = found.unionByName(beyond.select("src", "dst", F.lit(10 + depth).alias("rule"), F.lit(0.55).alias("confidence")))
        at = step.join(test_ids.select(F.col("id").alias("at")), "at", "left_semi")
    best = found.groupBy("src", "dst").agg(F.min_by("confidence", "rule").alias("confidence"))
    return edge(best, "tests", F.col("confidence"), "heuristic", "test-evidence")


def build(symbols: DataFrame) -> DataFrame:
    """All edges of a symbol table, merged. Tables that several builders read are written to the shared folder once."""
    from tessera.operators.calls import calls
    from tessera.operators.merge import merge_edges

    reach = materialize(scope(symbols), "scope")
    structure = materialize(interface_satisfaction(symbols).unionByName(inheritance(symbols)), "structure")
    called = materialize(calls(symbols, reach, structure), "calls")
    decorated = materialize(decorators(symbols, called, reach), "decorated")
    parts = [defines(symbols), imports(symbols), contains(symbols), structure, uses_type(symbols, reach), called, decorated, tests(symbols, called.unionByName(decorated), reach)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return merge_edges(every)
