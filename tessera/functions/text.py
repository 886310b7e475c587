"""Scalar functions of the engine as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STOPWORDS = (
    "the", "a", "an", "is", "of", "for", "to", "in", "and", "or", "with", "this", "that", "be", "on", "as", "it",
    "func", "function", "method", "class", "struct", "return", "returns", "var", "let", "const", "void", "int", "str", "string", "bool", "true", "false", "null", "none", "self",
)
_DOCUMENTS = "md mdx markdown yaml yml json xml sh bash zsh fish toml ini cfg conf txt proto sql graphql gql csv".split()
LANGUAGES = {
    "go": "go", "py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "tsx", "java": "java", "rs": "rust", "c": "c", "h": "c",
    "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "c++": "cpp", "hh": "cpp", "hpp": "cpp", "hxx": "cpp", "cs": "csharp", "php": "php", "php3": "php", "php4": "php", "php5": "php", "phtml": "php",
} | dict.fromkeys(_DOCUMENTS, "plaintext")
BASENAMES = dict.fromkeys("Makefile GNUmakefile makefile Dockerfile Containerfile .gitignore .dockerignore .gitattributes .editorconfig .eslintignore .prettierignore .nvmrc .node-version .python-version".split(), "plaintext")
PRUNED = (".git", ".tessera", ".cache", ".venv", ".tox", ".next", ".idea", "node_modules", "vendor", "dist", "bin", "__pycache__", "target", "coverage", ".pytest_cache", ".mypy_cache", ".ruff_cache")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    """Everything before the last slash, '' where there is none."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*$", "")).otherwise("")


def stem(path: Column) -> Column:
    """The base name without its last extension."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def fold_path(path: Column) -> Column:
    """The path with '.' and '..' folded; a '..' above the root is dropped."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    step = lambda done, p: F.when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p)))
    return F.array_join(F.reduce(parts, F.array().cast("array<string>"), step), "/")


def suffixes(path: Column) -> Column:
    """Every slash-suffix of a path, the longest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))


def language_of(path: Column) -> Column:
    """Language by exact base name, then by case-sensitive extension; null where unsupported."""
    name = base_name(path)
    by_name = F.create_map(*(F.lit(x) for kv in BASENAMES.items() for x in kv))
    by_ext = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.coalesce(F.try_element_at(by_name, name), F.try_element_at(by_ext, F.regexp_extract(name, r"\.([^.]+)$", 1)))


def is_sensitive(path: Column) -> Column:
    """Files of settings that hold credentials, names with secret or credential, keys and certificates, and ignore files of the project, without case."""
    return F.lower(base_name(path)).rlike(r"^\.(git|tessera)ignore$|^\.envrc$|^\.env\.|\.env$|^\.(npmrc|pypirc|netrc)$|secret|credential|\.(key|pem|crt|cer|p12|pfx|jks|keystore|pkcs12)$")


def in_pruned_dir(path: Column) -> Column:
    return F.arrays_overlap(F.split(dir_name(path), "/"), F.array(*(F.lit(x) for x in PRUNED)))


def is_test_path(path: Column) -> Column:
    """By a language's convention for the file's name, or a directory test, tests or __tests__ on the way."""
    path = F.replace(path, F.lit("\\"), F.lit("/"))
    any_case = F.lower(base_name(path)).rlike(r"_test\.(go|py)$|^test_.*\.py$|\.(test|spec)\.(ts|tsx|js|jsx)$")
    exact = base_name(path).rlike(r"(Test|Spec)\.java$|Tests?\.cs$|Test\.php$")
    return any_case | exact | F.arrays_overlap(F.split(dir_name(path), "/"), F.array(F.lit("tests"), F.lit("test"), F.lit("__tests__")))


def has_test_annotation(annotations: Column) -> Column:
    """A unit-test mark among the annotations, with or without its @ or brackets."""
    bare = lambda a: F.lower(F.regexp_replace(F.trim(a), r"^(?:@|#?\[)\s*|\s*\]$", ""))
    return F.exists(F.coalesce(annotations, F.array().cast("array<string>")), lambda a: bare(a).rlike(r"^(test$|test\(|testcase|testmethod$|fact$|theory$|tokio::test|async_std::test|pytest\.mark)") | F.lower(F.trim(a)).startswith("#[test"))


def is_property_annotation(annotations: Column) -> Column:
    return F.exists(annotations, lambda a: F.regexp_replace(a, "^@", "").rlike(r"^(property|cached_property|functools\.cached_property)$|\.(setter|getter|deleter)$"))


def is_exported(language: Column, name: Column, signature: Column) -> Column:
    """By the language's rule on the name or on the line that declares it; languages without a rule export nothing."""
    return (
        F.when(language == "go", name.rlike("^[A-Z]"))
        .when(language.isin("javascript", "typescript", "tsx"), signature.contains("export ") | signature.contains("module.exports"))
        .when(language == "python", ~name.startswith("_"))
        .when(language.isin("java", "rust"), signature.contains("public ") | signature.contains("pub "))
        .otherwise(False)
    )


def token_estimate(text: Column, language: Column | None = None) -> Column:
    """Bytes / 4 + 1, nothing for nothing; a document's is bytes / 4."""
    n = F.octet_length(text)
    code = F.when(n == 0, 0).otherwise(F.expr("0") + F.floor(n / 4) + 1)
    return (code if language is None else F.when(language == "plaintext", F.floor(n / 4)).otherwise(code)).cast("int")


def camel_tokens(text: Column) -> Column:
    """Lower-case tokens: runs of letters and digits, cut at camel humps and digits; under 2 bytes and stopwords left out."""
    cut = F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")
    for pattern in (r"(\p{Ll})(\p{Lu})", r"(\p{Lu})(\p{Lu}\p{Ll})", r"(\p{L})(\p{N})", r"(\p{N})(\p{L})"):
        cut = F.regexp_replace(cut, pattern, "$1 $2")
    return F.filter(F.split(F.lower(cut), " +"), lambda t: (F.octet_length(t) >= 2) & ~t.isin(*STOPWORDS))


def half_up_4(x: Column) -> Column:
    return F.floor(x * 10000 + 0.5) / 10000


def blank_identifier(text: Column, name: Column) -> Column:
    """text with whole occurrences of the identifier replaced by a mark; identifiers are ASCII letters, digits and _."""
    quoted = F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), name, F.lit(r"\E(?![A-Za-z0-9_])"))
    return F.when((name == "") | name.isNull(), text).otherwise(F.regexp_replace(text, quoted, "\u0001"))
