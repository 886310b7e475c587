"""Accuracy of derived edges against an oracle's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import half_up_4
from tessera.operators.intervals import overlapping, tightest, touched
from tessera.operators.traverse import best_product, inbound_each
from tessera.runtime import fresh
from tessera.schemas import CALLABLE


def match_declarations(decls: DataFrame, symbols: DataFrame) -> DataFrame:
    """decls (file, line, name) with the id of the smallest symbol that holds the line and has the name."""
    spans = symbols.select(F.col("file_path").alias("file"), "id", F.lower("name").alias("low_name"), F.col("span.start").alias("span_start"), F.col("span.end").alias("span_end"))
    asked = decls.select("file", "line", "name", F.lower("name").alias("low_name"))
    return tightest(asked, spans, ["file", "low_name"], "line", ("span_start", "span_end"), ["file", "line", "name"], "id").select("file", "line", "name", "id")


def score_edges(truth: DataFrame, predicted: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """One row: tp, fp, fn, precision, recall and f1 (half up at 4 places) of distinct (src, dst), self-edges aside, both ends in the universe (id)."""
    def clean(df):
        df = df.select("src", "dst").filter("src <> dst").distinct()
        for end in ("src", "dst") if universe is not None else ():
            df = df.join(universe.select(F.col("id").alias(end)).distinct(), end, "left_semi")
        return df
    a, b = clean(truth).withColumn("t", F.lit(1)), clean(predicted).withColumn("p", F.lit(1))
    counts = a.join(b, ["src", "dst"], "full_outer").agg(F.count_if(F.col("t").isNotNull() & F.col("p").isNotNull()).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    return with_rates(counts)


def with_rates(counts: DataFrame) -> DataFrame:
    """counts (tp, fp, fn) with precision, recall and f1; 0 where the denominator is."""
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return counts.select("*", half_up_4(p).alias("precision"), half_up_4(r).alias("recall"), half_up_4(f).alias("f1"))


def false_positives(truth: DataFrame, predicted: DataFrame, by: str) -> DataFrame:
    """(by, n): predicted edges that are not true, by source or reason."""
    return predicted.filter("src <> dst").join(truth.select("src", "dst").distinct(), ["src", "dst"], "left_anti").groupBy(F.coalesce(F.col(by), F.lit("")).alias(by)).agg(F.count("*").alias("n"))


def hit_rate(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row: functions (dst) with a true test, those with one that was predicted too, and their ratio."""
    true = truth.select("src", "dst").distinct()
    hit = true.join(predicted.select("src", "dst").distinct(), ["src", "dst"], "left_semi")
    a = true.agg(F.countDistinct("dst").alias("covered")).crossJoin(hit.agg(F.countDistinct("dst").alias("hit")))
    return a.select("covered", "hit", half_up_4(F.when(F.col("covered") > 0, F.col("hit") / F.col("covered")).otherwise(0.0)).alias("hit_rate"))


def macro_impact(true_reach: DataFrame, predicted_reach: DataFrame) -> DataFrame:
    """One row: mean precision, recall and F1 over seeds of (seed, node) sets.

    A seed with neither set is skipped; with no prediction precision is 1, with no truth recall is 1; F1 is 0 where both are 0.
    """
    a = true_reach.filter("seed <> node").select("seed", "node", F.lit(1).alias("t")).distinct()
    b = predicted_reach.filter("seed <> node").select("seed", "node", F.lit(1).alias("p")).distinct()
    per = a.join(b, ["seed", "node"], "full_outer").groupBy("seed").agg(F.count("t").alias("nt"), F.count("p").alias("np"), F.count_if(F.col("t").isNotNull() & F.col("p").isNotNull()).alias("tp"))
    p = F.when(F.col("np") > 0, F.col("tp") / F.col("np")).otherwise(1.0)
    r = F.when(F.col("nt") > 0, F.col("tp") / F.col("nt")).otherwise(1.0)
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return per.agg(F.count("*").alias("seeds"), half_up_4(F.avg(p)).alias("precision"), half_up_4(F.avg(r)).alias("recall"), half_up_4(F.avg(f)).alias("f1"))


def score_impact(truth: DataFrame, predicted: DataFrame, seeds: DataFrame, depth: int, floor: float = 0.0) -> DataFrame:
    """macro_impact of reaching the seeds over the true and the predicted edges, the latter with paths of product ``floor`` at least."""
    a = inbound_each(truth.select("src", "dst").distinct(), seeds, depth)
    b = best_product(predicted, seeds, floor, depth) if floor > 0 else inbound_each(predicted.select("src", "dst").distinct(), seeds, depth)
    return macro_impact(a.select("seed", "node"), b.select("seed", "node"))


def gate(scores: DataFrame, floors: DataFrame, metrics: tuple[str, ...] = ("precision", "recall")) -> DataFrame:
    """(repo, metric, value, floor): scores that fall under the baseline's floor by more than its tolerance."""
    (tolerance,) = fresh(scores, "tolerance")
    f = floors.select("repo", F.coalesce("tolerance", F.lit(0.0)).alias(tolerance), *(F.col(m).alias(f"floor_{m}") for m in metrics))
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.col(f"floor_{m}").cast("double").alias("floor")) for m in metrics))
    return scores.join(f, "repo").select("repo", tolerance, F.explode(rows).alias("x")).filter(f"x.value < x.floor - {tolerance}").select("repo", "x.metric", "x.value", "x.floor")


def universe_report(decls: DataFrame, matched: DataFrame, symbols: DataFrame) -> DataFrame:
    """(why, n) of distinct declarations (file, line, name) that no symbol was matched to.

    'no-symbols': the file has none; 'no-span': none holds the line; 'not-callable': one that does has the name but is no callable; 'name-disagrees': a callable does, under another name.
    """
    lost = decls.select("file", "line", "name").distinct().join(matched.select("file", "line", "name").distinct(), ["file", "line", "name"], "left_anti")
    # a name's part after its last dot decides whether it agrees: spans of that name are asked for by it, and of others one of the first and the last name is another
    last = lambda c: F.substring_index(c, ".", -1)
    spans = symbols.filter("name IS NOT NULL").select(F.col("file_path").alias("file"), last("name").alias("base"), F.col("kind").isin(*CALLABLE).alias("callable"), F.col("span.start").alias("span_start"), F.col("span.end").alias("span_end"))
    lost = lost.withColumn("base", last("name"))
    points = lost.select("file", "base", F.col("line").alias("low")).distinct().withColumn("high", F.col("low"))
    other_kind = touched(points, spans.filter("NOT callable"), ["file", "base"], ("low", "high"), ("span_start", "span_end")).select("file", "base", F.col("low").alias("line"), F.lit(True).alias("other_kind"))
    ends = spans.filter("callable").groupBy("file", "span_start", "span_end").agg(F.min("base").alias("first"), F.max("base").alias("last"))
    lines = overlapping(points.select("file", "low", "high").distinct(), ends, "file", ("low", "high"), ("span_start", "span_end")).groupBy("file", F.col("low").alias("line")).agg(F.min("first").alias("first"), F.max("last").alias("last"))
    known = symbols.select(F.col("file_path").alias("file"), F.lit(True).alias("has")).distinct()
    why = F.when(F.col("has").isNull(), "no-symbols").when(F.col("other_kind"), "not-callable").when((F.col("first") != F.col("base")) | (F.col("last") != F.col("base")), "name-disagrees").otherwise("no-span")
    return lost.join(known, "file", "left").join(other_kind, ["file", "base", "line"], "left").join(lines, ["file", "line"], "left").groupBy(why.alias("why")).agg(F.count("*").alias("n"))


def outside_oracle(language: Column, file: Column, name: Column) -> Column:
    """What an oracle leaves out: build output of C and C++, what Java's compiler makes up, PHP's closures."""
    c = language.isin("c", "cpp") & file.rlike(r"(^|/)build/|^cmake-build")
    java = (language == "java") & (name.rlike(r"lambda\$|access\$|\$deserializeLambda\$") | name.isin("$values", "<clinit>"))
    return c | java | ((language == "php") & name.contains("{closure"))


def is_header(file: Column) -> Column:
    """Whether a file of C or C++ is a header."""
    return file.rlike(r"\.(h|hpp|hh|hxx|inc)$")


def scorecard(title: str, row: dict) -> str:
    """A row of scores as a small Markdown table."""
    return "\n".join([f"### {title}", "", "| metric | value |", "|---|---|", *(f"| {k} | {v} |" for k, v in row.items()), ""])
