"""Call resolution: call sites to candidates, narrowed by tiers that never empty a set and by rules that may, then edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import is_property_annotation
from tessera.operators.edges import CAP, family, in_scope
from tessera.operators.expand import expand
from tessera.operators.localtypes import java_types, local_types
from tessera.runtime import materialize
from tessera.schemas import CALLABLE, TYPE_LIKE

OVERLOADED = ("csharp", "php", "c", "cpp", "java")
IMPLICIT_SELF = ("java", "csharp", "cpp")
SELF_WORDS = ("self", "this", "cls")
SUPER_WORDS = ("super", "super()")
#: Of these the candidates are narrowed before a site with too many is given up.
LATE_CAP = ("java", "rust")
#: In these a receiver that is no local of known type, no indexed type and no parent of a candidate belongs to a library.
CLOSED_RECEIVER = ("csharp", "php", "c", "cpp")
#: In these the type of a receiver that is a call's result has to be known.
RESULT_TYPED = ("java", "php", "rust")
#: Java's widening of literals.
LITERALS = {
    "int": "int long float double short byte Integer", "long": "long float double Long", "float": "float double Float", "double": "double Double",
    "char": "char int long float double Character", "boolean": "boolean Boolean", "String": "String",
}
WIDE_PARAMETERS = ("Object", "CharSequence", "Number", "Comparable", "Iterable", "Collection", "Map")


def prefer(candidates: DataFrame, site: list[str], *good: Column) -> DataFrame:
    """Of each site the candidates that are good; all of them where none is. Of several tiers each chooses among what the one before left: one window in all."""
    mask = reduce(lambda m, g: m * 2 + F.coalesce(g, F.lit(False)).cast("int"), good, F.lit(0))
    return candidates.withColumn("_mask", mask).withColumn("_best", F.max("_mask").over(Window.partitionBy(*site))).filter("_mask = _best").drop("_mask", "_best")


def cap(candidates: DataFrame, site: list[str], most: int = CAP) -> DataFrame:
    """Sites with no more than ``most`` candidates."""
    return candidates.withColumn("_n", F.count("*").over(Window.partitionBy(*site))).filter(F.col("_n") <= most).drop("_n")


def narrow(sites: DataFrame, targets: DataFrame) -> DataFrame:
    """(site, target), distinct: what prefer leaves of each site's candidates, which are not listed for it.

    sites has site, own, callee and want: its candidates are the targets (target, callee, have) of that callee other than own, and good where
    they have what it wants. Whether a site has a good one is told by the least and the greatest target of (callee, have): one of them is
    not the row's own. A callee's targets then go to the sites whole. Only targets of more than one callee or have can come twice to a site.
    """
    targets = targets.dropna(subset=["target", "callee"]).distinct()
    ends = targets.groupBy("callee", F.col("have").alias("want")).agg(F.min("target").alias("least"), F.max("target").alias("most"))
    rows = sites.dropna(subset=["own", "callee"]).join(ends, ["callee", "want"], "left")
    good = F.coalesce((F.col("least") != F.col("own")) | (F.col("most") != F.col("own")), F.lit(False))
    flagged = rows.select("site", "own", "callee", "want", good.alias("good")).repartition("site").withColumn("any_good", F.max("good").over(Window.partitionBy("site"))).filter("good OR NOT any_good")
    # where two of a site's rows ask for one group with other owns, all of it is among the candidates
    asked = flagged.groupBy("site", "callee", F.when(F.col("any_good"), F.col("want")).alias("want"), F.col("any_good").alias("narrowed")).agg(F.min("own").alias("own"), F.max("own").alias("own_2"))
    asked = asked.select("site", "callee", F.struct("narrowed", "want").alias("part"), F.when(F.col("own") == F.col("own_2"), F.col("own")).alias("own"))
    often = targets.groupBy("target").agg((F.count("*") > 1).alias("often"))
    have = F.array(F.struct(F.lit(False).alias("narrowed"), F.lit(None).cast(targets.schema["have"].dataType).alias("want")), F.struct(F.lit(True).alias("narrowed"), F.col("have").alias("want")))
    groups = targets.join(often, "target").select("callee", "target", "often", F.explode(have).alias("part")).distinct()
    found = lambda t: expand(asked, t, ["callee", "part"], "target").filter("own IS NULL OR target <> own").select("site", "target")
    return found(groups.filter("NOT often")).unionByName(found(groups.filter("often")).distinct())


def rivals(targets: DataFrame) -> DataFrame:
    """(callee, target, others): how many other targets (target, callee and more) each target's callee has."""
    known = targets.dropna(subset=["target", "callee"]).distinct()
    size = known.groupBy("callee").agg(F.count("*").alias("size"))
    return known.groupBy("callee", "target").agg(F.count("*").alias("own")).join(size, "callee").select("callee", "target", (F.col("size") - F.col("own")).alias("others"))


def under_cap(sites: DataFrame, most: int = CAP) -> DataFrame:
    """The rows (site, others and more) of sites of which no row by itself has more than ``most`` candidates; only these need be listed for cap."""
    return sites.repartition("site").withColumn("_most", F.max("others").over(Window.partitionBy("site"))).filter(F.col("_most") <= most).drop("_most")


def _declared(signature: Column) -> Column:
    """The declared parameters as text, without generics and nested brackets' contents."""
    inner = F.regexp_extract(signature, r"\(([^()]*(?:\([^()]*\)[^()]*)*)\)", 1)
    flat = F.regexp_replace(inner, r"<[^<>]*(?:<[^<>]*>[^<>]*)*>|\[[^\[\]]+\]|\([^()]*\)", "")
    return F.filter(F.transform(F.split(flat, ","), F.trim), lambda p: (p != "") & ~p.rlike(r"^(&?(mut )?self|cls|void|\*|/)(:|$)"))


def parameters(signature: Column) -> Column:
    """How many parameters a signature declares, without a receiver; -1 where it takes any number."""
    parts = _declared(F.regexp_replace(signature, r"^func\s*\([^)]*\)", "func"))
    return F.when(F.exists(parts, lambda p: p.rlike(r"\.\.\.|^\*|\bparams\b|=")), F.lit(-1)).otherwise(F.size(parts))


def parameter_types(signature: Column) -> Column:
    """The bare type of each declared parameter of a Java signature, with its [] marks."""
    return F.transform(_declared(signature), lambda p: F.concat(F.regexp_extract(p, r"([A-Za-z_]\w*)\s*(?:\[\])*\s+\w+$", 1), F.regexp_extract(p, r"((?:\[\])*)\s+\w+$", 1)))


def return_type(language: Column, name: Column, signature: Column, body: Column, parent: Column) -> Column:
    """The bare type of what a callable returns; '' where its text does not say."""
    before = F.regexp_extract(F.substring_index(signature, "(", 1), r"([A-Za-z_]\w*)(?:<[^()]*>)?((?:\[\])*)\s+\w+\s*$", 1)
    array = F.regexp_extract(F.substring_index(signature, "(", 1), r"((?:\[\])+)\s+\w+\s*$", 1)
    php = F.regexp_extract(signature, r"\)\s*:\s*\??\\?(?:\w+\\)*(\w+)", 1)
    made = F.regexp_extract(body, r"\breturn\s+new\s+\\?(?:\w+\\)*([A-Z]\w*)", 1)
    arrow = F.regexp_extract(signature, r"->\s*(?:&(?:'\w+\s+)?(?:mut\s+)?)?(?:(?:Option|Result|Box|Rc|Arc)<)?&?(?:mut\s+)?(?:\w+::)*([A-Z]\w*)", 1)
    php_type = F.when(php.isin("self", "static"), parent).when(php != "", php).when(made != "", made).when(body.rlike(r"\breturn\s+\$this\s*;"), parent).otherwise("")
    return F.when(language == "php", php_type).when(language == "rust", F.when(arrow == "Self", parent).otherwise(arrow)).when(language == "java", F.when(before.isin("void", "public", "private", "protected", "static", "final"), "").otherwise(F.concat(before, array))).otherwise("")


def sites(symbols: DataFrame) -> DataFrame:
    """A row for each call site: caller, where and what it is in, the callee's name and its qualifier."""
    rows = symbols.filter(F.col("kind").isin(*CALLABLE)).select(
        F.col("id").alias("caller"), F.col("file_path").alias("from_file"), F.col("language").alias("from_language"), F.lower("parent_symbol").alias("own_parent"),
        F.regexp_extract("signature", r"^func\s*\((\w+)\s", 1).alias("receiver"), F.regexp_extract("raw_text", r"\bimpl(?:<[^>]*>)?\s+(?:\w+::)*(\w+)", 1).alias("_"), F.posexplode("call_sites").alias("site_no", "s"),
    ).drop("_")
    parts = F.transform(F.split(F.col("s.callee"), r"\.|::|->"), lambda x: F.when(F.col("from_language") == "php", F.ltrim(x, F.lit("$"))).otherwise(x))
    named = rows.select("caller", "from_file", "from_language", "own_parent", "receiver", "site_no", F.element_at(parts, -1).alias("callee"), F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise("").alias("qualifier"), F.col("s.argc").alias("argc"), F.col("s.generic").alias("generic"), F.col("s.args").alias("args"))
    # Rust's prelude has the bare drop
    return named.filter(~F.col("callee").isin("", "constructor") & ~((F.col("from_language") == "rust") & (F.col("qualifier") == "") & (F.col("callee") == "drop")))


def _targets(symbols: DataFrame) -> DataFrame:
    """Callables by exact name, with what the tiers look at."""
    return symbols.filter(F.col("kind").isin(*CALLABLE)).select(
        F.col("id").alias("target"), F.col("name").alias("callee"), F.col("file_path").alias("to_file"), F.col("language").alias("to_language"), F.lower("parent_symbol").alias("parent"), parameters(F.col("signature")).alias("arity"),
        (F.size("type_parameters") > 0).alias("generic_target"), F.when(F.col("language") == "java", parameter_types(F.col("signature"))).alias("parameter_types"), F.col("type_parameters").alias("own_types"), (F.col("kind") != "function").alias("is_member"),
    )


def candidates(call_sites: DataFrame, symbols: DataFrame, scope_table: DataFrame) -> DataFrame:
    """Callables of exactly the callee's name in scope, not the caller; those of the caller's own file where there are any."""
    return prefer(_reached(call_sites, symbols, scope_table), ["caller", "site_no"], F.col("to_file") == F.col("from_file"))


def _reached(call_sites: DataFrame, symbols: DataFrame, scope_table: DataFrame) -> DataFrame:
    return in_scope(call_sites.join(_targets(symbols), "callee").filter("caller <> target"), scope_table)


def ancestors(symbols: DataFrame, structure: DataFrame, levels: int = 4) -> DataFrame:
    """(language, class_lc, level, base_lc): base classes by name within a language, the nearest level of each."""
    names = symbols.select(F.col("id").alias("src"), family(F.col("language")).alias("family"), F.lower("name").alias("class_lc"))
    bases = names.select(F.col("src").alias("dst"), "family", F.col("class_lc").alias("base_lc"))
    step = structure.filter("type IN ('extends', 'implements') AND reason = 'type-ref'").select("src", "dst").join(names, "src").join(bases, ["dst", "family"]).select("family", "class_lc", "base_lc").filter("class_lc <> base_lc").distinct()
    found, now = step.withColumn("level", F.lit(1)), step
    for level in range(2, levels + 1):
        now = now.join(step.select("family", F.col("class_lc").alias("base_lc"), F.col("base_lc").alias("next")), ["family", "base_lc"]).select("family", "class_lc", F.col("next").alias("base_lc")).filter("class_lc <> base_lc").distinct()
        found = found.unionByName(now.withColumn("level", F.lit(level)))
    return found.groupBy("family", "class_lc", "base_lc").agg(F.min("level").alias("level"))


def imported_files(symbols: DataFrame) -> DataFrame:
    """(from_file, qualifier, files): imports by their last segment, in its case, with the indexed files they resolve to; none for an external one.

    Only precise matches count: the file without its extension, or a folder, is the import's path or a slash-suffix of it, or ends with it.
    """
    raw = symbols.filter(~F.col("language").isin("plaintext", "rust")).select(F.col("file_path").alias("from_file"), F.explode("imports").alias("imp")).distinct()
    plain = F.regexp_replace(F.trim("imp"), r"^\./|\.(go|py|tsx?|jsx?|java|rs)$", "")
    slashed = F.when(~plain.contains("/"), F.replace(plain, F.lit("."), F.lit("/"))).otherwise(plain)
    raw = raw.select("from_file", F.lower(slashed).alias("path"), F.element_at(F.split(F.regexp_replace(slashed, r"[:\\\\]+", "/"), "/"), -1).alias("qualifier")).filter("qualifier <> ''")
    files = symbols.select(F.col("file_path").alias("to_file")).distinct()
    bare = F.lower(F.regexp_replace("to_file", r"\.[^./]+$", ""))
    folder = F.when(bare.contains("/"), F.regexp_replace(bare, r"/[^/]*$", ""))
    from tessera.functions.text import suffixes

    # a place of a file answers to its whole path and to every suffix of it; an import asks by its path, and for folders by its suffixes
    whole = files.select("to_file", F.explode(F.concat(suffixes(bare), F.coalesce(suffixes(folder), F.array().cast("array<string>")))).alias("path"))
    exact = files.select("to_file", folder.alias("path")).filter("path IS NOT NULL")
    hits = raw.join(whole, "path").select("from_file", "qualifier", "to_file").unionByName(raw.select("from_file", "qualifier", F.explode(suffixes(F.col("path"))).alias("path")).join(exact, "path").select("from_file", "qualifier", "to_file"))
    found = hits.filter("from_file <> to_file").groupBy("from_file", "qualifier").agg(F.collect_set("to_file").alias("files"))
    return raw.select("from_file", "qualifier").distinct().join(found, ["from_file", "qualifier"], "left").select("from_file", "qualifier", F.coalesce("files", F.array().cast("array<string>")).alias("files"))


def result_types(all_sites: DataFrame, symbols: DataFrame, scope_table: DataFrame) -> DataFrame:
    """(caller, qualifier, results): the types that the call in a qualifier like ``make()`` may return by the callables in scope, null where one does not say."""
    asked = all_sites.filter(F.col("qualifier").endswith("()") & F.col("from_language").isin(*RESULT_TYPED)).select("caller", "qualifier", "from_file", "from_language", F.expr("left(qualifier, length(qualifier) - 2)").alias("callee")).distinct()
    what = return_type(F.col("language"), F.col("name"), F.col("signature"), F.col("raw_text"), F.col("parent_symbol"))
    givers = symbols.filter(F.col("kind").isin(*CALLABLE)).select(F.col("name").alias("callee"), F.col("file_path").alias("to_file"), F.col("language").alias("to_language"), F.lower(F.when(F.col("kind") == "constructor", F.col("parent_symbol")).otherwise(what)).alias("result"))
    made = symbols.filter(F.col("kind").isin("class", "struct", "enum")).select(F.col("name").alias("callee"), F.col("file_path").alias("to_file"), F.col("language").alias("to_language"), F.lower("name").alias("result"))
    hits = in_scope(asked.join(givers.unionByName(made), "callee"), scope_table)
    return hits.groupBy("caller", "qualifier").agg(F.collect_set("result").alias("results"), F.max(F.col("result") == "").alias("unsure")).select("caller", "qualifier", F.when(~F.col("unsure"), F.col("results")).alias("results"))


def _java_fits(given: Column) -> Column:
    """Whether no known type of an argument conflicts with the candidate's parameter; unknown ones are neutral."""
    compatible = F.create_map(*(x for k, v in LITERALS.items() for x in (F.lit(k), F.array(*map(F.lit, v.split())))))

    def conflict(pair):
        arg, want = pair["args"], pair["parameter_types"]
        literal = arg.startswith("#")
        type_ = F.when(literal, F.element_at(F.split(F.substring(arg, 2, 200), r"\."), -1)).otherwise(F.try_element_at(given, arg))
        bare = F.regexp_replace(want, r"(\[\])+$", "")
        wide = bare.isin(*WIDE_PARAMETERS) | bare.rlike("^[A-Z]$") | F.array_contains("own_types", bare) | (want == "")
        return type_.isNotNull() & (arg != "") & (type_ != want) & ~wide & ~(literal & F.coalesce(F.array_contains(F.try_element_at(compatible, type_), want), F.lit(False)))

    clash = F.exists(F.arrays_zip("args", "parameter_types"), lambda p: F.coalesce(conflict(p), F.lit(False)))
    return (F.col("from_language") != "java") | (F.col("arity") == -1) | (F.size("args") != F.size("parameter_types")) | F.coalesce(~clash, F.lit(True))


def resolve(symbols: DataFrame, scope_table: DataFrame, structure: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sites, found): every call site with what is known of its receiver, and the narrowed candidates with their site's ``capped`` mark.

    What is known of a site is joined to it before its candidates are, so that all tiers run over one partitioning by site.
    """
    site = ["caller", "site_no"]
    every = sites(symbols)
    known = symbols.filter(F.col("kind").isin(*TYPE_LIKE)).select(F.lower("name").alias("type_lc"), F.lit(True).alias("indexed")).distinct()
    types = local_types(symbols, ancestors(symbols, structure)).select("caller", F.col("variable").alias("qualifier"), "type_lc")
    every = every.join(types, ["caller", "qualifier"], "left").join(known.select(F.col("type_lc").alias("_q"), F.col("indexed").alias("is_type")), F.lower("qualifier") == F.col("_q"), "left").drop("_q")
    every = every.join(result_types(every, symbols, scope_table), ["caller", "qualifier"], "left")
    every = materialize(every.join(imported_files(symbols), ["from_file", "qualifier"], "left").join(java_types(symbols), "caller", "left"), "call-sites")
    found = _reached(every, symbols, scope_table)
    overloaded = F.col("from_language").isin(*OVERLOADED)
    plain_generic = (F.col("from_language") != "csharp") | (F.col("generic") == F.col("generic_target"))
    found = prefer(found, site, F.col("to_file") == F.col("from_file"))
    by_site = Window.partitionBy(*site)
    found = found.withColumn("raw", F.count("*").over(by_site))
    found = prefer(found, site, ~overloaded | (F.col("arity") == -1) | (F.col("arity") == F.col("argc")), plain_generic, _java_fits(F.col("java_types")))
    q, language = F.col("qualifier"), F.col("from_language")
    own = q.isin(*SELF_WORDS) | (q == F.col("receiver")) & (q != "")
    implicit = language.isin(*IMPLICIT_SELF) & (q == "") & (F.col("own_parent") != "")
    result = q.endswith("()")
    typed = F.col("type_lc").isNotNull() & (q != "") & ~own & ~result
    of_type, of_qualifier, of_own = (F.coalesce(F.col("parent") == x, F.lit(False)) for x in (F.col("type_lc"), F.lower(q), F.col("own_parent")))
    bare = F.regexp_extract("to_file", r"([^/]*?)\.[^./]*$", 1)
    in_module = (bare == q) | (bare == "mod") & F.regexp_extract("to_file", r"([^/]*)/[^/]*$", 1).eqNullSafe(q)
    some = lambda x: F.max(x).over(by_site)
    found = found.withColumns({"any_type": some(of_type), "any_qualifier": some(of_qualifier), "any_own": some(of_own), "any_module": some(in_module), "same_file": F.sum((F.col("to_file") == F.col("from_file")).cast("int")).over(by_site)})
    is_type, imported = F.coalesce("is_type", F.lit(False)), F.col("files").isNotNull()
    from_import = F.array_contains("files", F.col("to_file"))
    upper, lower = q.rlike("^[A-Z]"), q.rlike("^[a-z]")
    rust_module = F.when(F.col("any_module"), in_module).otherwise((F.col("same_file") == 1) & (F.col("to_file") == F.col("from_file")))
    keep = (
        F.when(own | implicit, ~F.col("any_own") | of_own)
        .when(result & language.isin(*RESULT_TYPED), F.coalesce(((F.size("results") == 1) | (language == "rust")) & F.array_contains("results", F.col("parent")) & ((language != "rust") | F.col("is_member")), F.lit(False)))
        .when(result | (q == ""), True)
        .when(typed, of_type)
        .when(F.col("any_qualifier"), of_qualifier)
        .when(language.isin(*CLOSED_RECEIVER), is_type | (q == "base") | (q == "parent") | (q == "static"))
        .when((language == "rust") & upper, False)
        .when(language == "rust", rust_module)
        .when((language == "java") & lower & ~is_type, False)
        .when(imported, from_import)
        .when((language == "java") & upper & ~is_type, False)
        .otherwise(True)
    )
    early = ~language.isin(*LATE_CAP) & (F.col("raw") > CAP)
    found = found.filter(~q.isin(*SUPER_WORDS) & (keep | early)).withColumn("capped", early | (F.count("*").over(by_site) > CAP))
    return every, materialize(found.select(*site, "from_file", "from_language", "callee", "target", "to_file", "any_own", "any_type", "capped"), "callees")


def _edge_rows(df: DataFrame, stage: int, confidence: float | Column, source: str, reason: str) -> DataFrame:
    c = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return df.select("caller", "target", F.lit(stage).alias("stage"), c.cast("double").alias("confidence"), F.lit(source).alias("source"), F.lit(reason).alias("reason"))


def calls(symbols: DataFrame, scope_table: DataFrame, structure: DataFrame) -> DataFrame:
    """The calls edges. For each (caller, target) the first stage that gives it stays.

    0 property reads; 1 narrowed call sites, with the evidence of a syntax tree only where one gave the site; 2 members inherited by own
    or super calls; 3 dispatch over an interface, by a receiver's type or in place of too many candidates; 4 construction of a class;
    5 words of the body, where a callable's sites were not looked for.
    """
    site = ["caller", "site_no"]
    every, found = resolve(symbols, scope_table, structure)
    members = symbols.filter(F.col("kind").isin(*CALLABLE)).select(F.col("id").alias("target"), F.col("name").alias("callee"), F.lower("parent_symbol").alias("base_lc"), F.col("file_path").alias("to_file"), F.col("language").alias("to_language"), family(F.col("language")).alias("family"))
    # members that own classes inherit: of super calls, and of own calls whose class has none itself
    own = F.col("qualifier").isin(*SELF_WORDS) | (F.col("qualifier") == F.col("receiver")) & (F.col("qualifier") != "") | F.col("from_language").isin(*IMPLICIT_SELF) & (F.col("qualifier") == "")
    has_own = found.filter("any_own").select(*site).distinct()
    up = ancestors(symbols, structure).withColumnRenamed("class_lc", "own_parent")
    seeking = every.filter((F.col("own_parent") != "") & (own | F.col("qualifier").isin(*SUPER_WORDS))).join(has_own.withColumn("has_own", F.lit(True)), site, "left").filter(F.col("has_own").isNull() | F.col("qualifier").isin(*SUPER_WORDS))
    inherited = seeking.withColumn("family", family(F.col("from_language"))).join(up, ["family", "own_parent"]).join(members.select("target", "callee", "base_lc", "family"), ["base_lc", "callee", "family"]).filter("caller <> target")
    inherited = materialize(inherited.withColumn("_near", F.min("level").over(Window.partitionBy(*site))).filter("level = _near").select(*site, "target"), "inherited")
    kept = found.filter("NOT capped").join(inherited.select(*site).distinct(), site, "left_anti")
    same = F.when(F.col("to_file") == F.col("from_file"), 0.85).otherwise(0.6)
    by_tree, by_text = kept.filter("from_language = 'python'"), kept.filter("from_language <> 'python'")
    # dispatch: through an interface that a receiver is known to be, wherever the implementors are
    met = structure.filter("reason = 'method-set' AND type = 'overrides'").select(F.col("src").alias("target"), F.col("dst").alias("iface"))
    ifaces = symbols.filter(F.col("kind").isin("interface", "trait")).select(F.col("id").alias("iface"), F.lower("name").alias("type_lc"), F.col("file_path").alias("iface_file"), F.col("language").alias("iface_language"))
    implementing = met.join(ifaces, "iface").join(members, "target")
    typed = every.filter(F.col("type_lc").isNotNull() & (F.col("qualifier") != "") & ~own).join(found.filter("any_type").select(*site).distinct(), site, "left_anti")
    through = typed.join(implementing.select("type_lc", "callee", "target"), ["type_lc", "callee"]).filter("caller <> target").select("caller", "target").distinct()
    # and in place of more candidates than are followed: an interface in scope that declares the method, its implementors in scope
    full = found.filter("capped").select(*site, "callee", "from_file", "from_language").distinct()
    rescued = in_scope(full.join(implementing.select("callee", "target", "iface_file", "iface_language", "to_file", "to_language"), "callee").filter("caller <> target"), scope_table)
    seen = in_scope(rescued.select(*site, "target", "from_file", "from_language", F.col("iface_file").alias("to_file"), F.col("iface_language").alias("to_language")), scope_table).select("caller", "target").distinct()
    # construction, where nothing else was found
    resolved = found.select(*site).unionByName(inherited.select(*site)).distinct()
    built = constructed(every.join(resolved, site, "left_anti"), symbols, scope_table, up)
    stages = [
        _edge_rows(property_reads(symbols, scope_table), 0, 0.7, "ast", "property"), _edge_rows(by_tree, 1, 0.95, "ast", "ast-narrowed"), _edge_rows(by_text, 1, same, "regex", "regex-fallback"),
        _edge_rows(inherited, 2, 0.85, "heuristic", "inheritance"), _edge_rows(through.unionByName(seen), 3, 0.7, "heuristic", "dispatch"), _edge_rows(built, 4, 0.85, "heuristic", "constructor"),
        _edge_rows(body_words(symbols, scope_table), 5, same, "regex", "regex-fallback"),
    ]
    first = reduce(DataFrame.unionByName, stages).groupBy("caller", "target").agg(F.min_by(F.struct("confidence", "source", "reason"), F.struct("stage", -F.col("confidence"))).alias("e"))
    return first.select(F.col("caller").alias("src"), F.col("target").alias("dst"), F.lit("calls").alias("type"), "e.confidence", "e.source", "e.reason")


def constructed(open_sites: DataFrame, symbols: DataFrame, scope_table: DataFrame, up: DataFrame) -> DataFrame:
    """(caller, target): constructors of the class that a site names, in scope; cls() is the own class, super() the nearest base that has one, whatever its file."""
    classes = symbols.filter(F.col("kind").isin("class", "struct")).select(F.col("name").alias("callee"), F.col("file_path").alias("to_file"), F.col("language").alias("to_language"), F.lower("name").alias("class_lc"))
    builders = symbols.filter("kind = 'constructor' OR name IN ('__init__', 'constructor', '__construct')").select(F.col("id").alias("target"), F.lower("parent_symbol").alias("class_lc"), F.col("file_path").alias("to_file"), family(F.col("language")).alias("family"), parameters(F.col("signature")).alias("arity"))
    own = open_sites.filter("callee = 'cls' AND own_parent <> ''").join(builders.withColumnRenamed("class_lc", "own_parent"), "own_parent").filter("to_file = from_file").select("caller", "site_no", "from_language", "argc", "arity", "target")
    made = in_scope(open_sites.join(classes, "callee"), scope_table).join(builders, ["class_lc", "to_file"]).select("caller", "site_no", "from_language", "argc", "arity", "target")
    # an inherited constructor, where the class has none
    direct = made.unionByName(own).filter("caller <> target")
    direct = prefer(direct, ["caller", "site_no"], (F.col("from_language") != "java") | (F.col("arity") == -1) | (F.col("arity") == F.col("argc")))
    open_sites = open_sites.withColumn("family", family(F.col("from_language")))
    bases = up.join(builders.select("target", "family", F.col("class_lc").alias("base_lc")), ["family", "base_lc"])
    of_class = in_scope(open_sites.join(classes, "callee"), scope_table).join(builders, ["class_lc", "to_file"], "left_anti").join(bases.withColumnRenamed("own_parent", "class_lc"), ["family", "class_lc"]).select("caller", "site_no", "level", "target")
    of_super = open_sites.filter("callee = 'super' AND own_parent <> ''").join(bases, ["family", "own_parent"]).select("caller", "site_no", "level", "target")
    higher = of_class.unionByName(of_super).filter("level <= 3").withColumn("_near", F.min("level").over(Window.partitionBy("caller", "site_no"))).filter("level = _near AND caller <> target")
    return direct.select("caller", "target").unionByName(higher.select("caller", "target")).distinct()


def property_reads(symbols: DataFrame, scope_table: DataFrame) -> DataFrame:
    """(caller, target): attribute reads of property methods; those of the own file first, of own attributes those of the own class, else at most CAP."""
    rows = symbols.filter(F.col("kind").isin(*CALLABLE)).select(F.col("id").alias("caller"), F.col("file_path").alias("from_file"), F.col("language").alias("from_language"), F.lower("parent_symbol").alias("own_parent"), F.posexplode("attr_sites").alias("site_no", "s"))
    parts = F.split("s.callee", r"\.")
    rows = rows.select("caller", "from_file", "from_language", "own_parent", "site_no", F.element_at(parts, -1).alias("callee"), F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise("").alias("qualifier"))
    targets = symbols.filter((F.col("kind").isin("method", "function")) & is_property_annotation(F.col("annotations"))).select(F.col("id").alias("target"), F.col("name").alias("callee"), F.lower("parent_symbol").alias("parent"), F.col("file_path").alias("to_file"), F.col("language").alias("to_language"))
    owned = F.when(F.col("qualifier").isin(*SELF_WORDS), F.col("parent") == F.col("own_parent")).otherwise(F.col("parent") == F.lower("qualifier"))
    found = prefer(in_scope(rows.join(targets, "callee").filter("caller <> target"), scope_table), ["caller", "site_no"], F.col("to_file") == F.col("from_file"), owned)
    return cap(found, ["caller", "site_no"]).select("caller", "target").distinct()


def stripped(text: Column) -> Column:
    """Code without comments and with quoted text blanked."""
    quoted = F.regexp_replace(text, r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`", "\"\"")
    return F.regexp_replace(F.regexp_replace(quoted, r"(?s)/\*.*?\*/", " "), r"(?m)(//|#).*$", "")


def body_words(symbols: DataFrame, scope_table: DataFrame) -> DataFrame:
    """(caller, target, from_file, to_file): names followed by a parenthesis in the bodies of callables whose call sites are null, as those recovered from broken files."""
    rows = symbols.filter(F.col("kind").isin(*CALLABLE) & F.col("call_sites").isNull() & (F.col("language") != "plaintext"))
    words = F.array_distinct(F.regexp_extract_all(stripped(F.col("raw_text")), F.lit(r"\b([A-Za-z_]\w*)\s*\("), 1))
    rows = rows.select(F.col("id").alias("caller"), F.col("file_path").alias("from_file"), F.col("language").alias("from_language"), F.posexplode(words).alias("site_no", "callee")).filter("callee NOT IN ('constructor', 'super')")
    targets = symbols.filter(F.col("kind").isin(*CALLABLE)).select(F.col("id").alias("target"), F.col("name").alias("callee"), F.col("file_path").alias("to_file"), F.col("language").alias("to_language"))
    found = prefer(in_scope(rows.join(targets, "callee").filter("caller <> target"), scope_table), ["caller", "site_no"], F.col("to_file") == F.col("from_file"))
    return cap(found, ["caller", "site_no"]).select("caller", "target", "from_file", "to_file").distinct()
