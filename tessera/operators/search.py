"""Retrieval: ranked lexical search, TF-IDF and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import camel_tokens
from tessera.runtime import materialize


def rank(query: str) -> Column:
    """100 name =, 90 qualified name =, 80 name begins, 70 name holds, 60 qualified name holds, 40 path or signature holds; 0 for an empty query, else null."""
    q = query.strip().lower()
    if not q:
        return F.lit(0)
    name, qualified = F.lower("name"), F.lower("qualified_name")
    return (
        F.when(name == q, 100).when(qualified == q, 90).when(name.startswith(q), 80).when(name.contains(q), 70)
        .when(qualified.contains(q), 60).when(F.lower("file_path").contains(q) | F.lower("signature").contains(q), 40)
    )


def lexical(symbols: DataFrame, query: str, limit: int = 50, start: str = "span.start") -> DataFrame:
    """The best ``limit`` symbols (50 where not positive) by rank, then file, place and id."""
    ranked = symbols.withColumn("rank", rank(query)).filter("rank IS NOT NULL")
    return ranked.orderBy(F.desc("rank"), "file_path", start, "id").limit(limit if limit > 0 else 50)


def term_counts(docs: DataFrame, text: Column, key: str = "id") -> DataFrame:
    """(key, term, tf, n), written once: how often each term is in each document, and the number of documents; null keys are a document too."""
    counted = docs.select(key, F.explode(camel_tokens(text)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    total = docs.select(key).distinct().agg(F.count("*").alias("n"))
    return materialize(counted.crossJoin(F.broadcast(total)), "term-counts")


def idf(counts: DataFrame) -> DataFrame:
    """(term, df, idf) of the documents in term_counts."""
    return counts.groupBy("term").agg(F.count("*").alias("df"), F.first("n").alias("n")).select("term", "df", F.log((F.col("n") + 1) / (F.col("df") + 1)).alias("idf"))


def document_frequencies(docs: DataFrame, text: Column, key: str = "id") -> DataFrame:
    """(term, df, idf) as idf(term_counts(docs, text)) has it, without counting or writing what is in each document: a document is one row with its distinct terms."""
    terms = docs.select(key, F.array_distinct(camel_tokens(text)).alias("terms")).groupBy(key).agg(F.flatten(F.collect_list("terms")).alias("terms"))
    df = terms.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    total = docs.select(key).distinct().agg(F.count("*").alias("n"))
    return df.crossJoin(F.broadcast(total)).select("term", "df", F.log((F.col("n") + 1) / (F.col("df") + 1)).alias("idf"))


def tf_idf(counts: DataFrame, key: str = "id") -> DataFrame:
    """The inverted index (term, key, weight, norm, idf) of term_counts: weight (1 + ln tf) * ln((n + 1) / (df + 1)), norm that of the document's weights."""
    weighed = counts.join(idf(counts).select("term", "idf"), "term").select("term", key, ((1 + F.log("tf")) * F.col("idf")).alias("weight"), "idf")
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(key)))  # the rows move once, and stay with their document
    return weighed.select("term", key, "weight", norm.alias("norm"), "idf")


def tf_idf_of(counts: DataFrame, query: str, key: str = "id") -> DataFrame:
    """The rows of tf_idf for the terms of a query alone: norms are summed only for the documents that have one of them."""
    spark = counts.sparkSession
    asked = spark.createDataFrame([(query,)], "q string").select(F.explode(F.array_distinct(camel_tokens(F.col("q")))).alias("term"))
    weights = idf(counts).select("term", "idf")
    hit = materialize(counts.join(F.broadcast(asked), "term", "left_semi").join(weights, "term").select("term", key, ((1 + F.log("tf")) * F.col("idf")).alias("weight"), "idf"), "hits")
    touched = counts.join(hit.select(key).distinct(), key, "left_semi").join(weights, "term")
    norms = touched.groupBy(key).agg(F.sqrt(F.sum(F.pow((1 + F.log("tf")) * F.col("idf"), F.lit(2)))).alias("norm"))
    return hit.join(norms, key).select("term", key, "weight", "norm", "idf")


#: The stored index has so many parts, by hash of the term; a query reads those of its terms.
PARTS = 64


def part_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(PARTS)).cast("int")


def parts_asked(spark, query: str) -> list[int]:
    """The parts of the index that a query's terms are in."""
    return [r.part for r in spark.createDataFrame([(query,)], "q string").select(F.explode(camel_tokens(F.col("q"))).alias("term")).select(part_of(F.col("term")).alias("part")).distinct().collect()]


def tf_idf_query(index: DataFrame, query: str, limit: int = 20, key: str = "id") -> DataFrame:
    """(key, score): cosine of the query with the documents of the index (tf_idf or its rows for the query's terms). Terms that no document has are ignored; nothing for a limit of 0 or less."""
    spark = index.sparkSession
    asked = spark.createDataFrame([(query,)], "q string").select(F.explode(camel_tokens(F.col("q"))).alias("term")).groupBy("term").agg(F.count("*").alias("tf"))
    # a query's terms are few: they are broadcast, and only their rows leave the index
    hits = materialize(index.join(F.broadcast(asked), "term").withColumn("asked", (1 + F.log("tf")) * F.col("idf")), "asked")
    size = hits.groupBy("term").agg(F.first("asked").alias("asked")).agg(F.sqrt(F.sum(F.col("asked") * F.col("asked"))).alias("asked_norm"))
    dots = hits.groupBy(key).agg(F.sum(F.col("weight") * F.col("asked")).alias("dot"), F.max("norm").alias("norm"))
    scored = dots.crossJoin(F.broadcast(size)).filter("dot > 0 AND norm > 0 AND asked_norm > 0").select(key, (F.col("dot") / (F.col("norm") * F.col("asked_norm"))).alias("score"))
    return scored.orderBy(F.desc("score"), key).limit(max(limit, 0))


def dot(a: Column, b: Column) -> Column:
    """Dot product in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_top(vectors: DataFrame, query: list[float], limit: int = 20, key: str = "id", vector: str = "vector", positive: bool = True) -> DataFrame:
    """(key, score): cosine with the query, best first; scores not above 0 are left out unless ``positive`` is false."""
    q = F.array(*(F.lit(float(x)) for x in query))
    v = F.col(vector)
    scored = vectors.select(key, (dot(v, q) / (norm(v) * norm(q))).alias("score"))
    return (scored.filter("score > 0") if positive else scored.filter("score IS NOT NULL")).orderBy(F.desc("score"), key).limit(limit)


def mean_pool(tokens: DataFrame, matrix: DataFrame, key: str = "id") -> DataFrame:
    """(key, vector): the normalised mean of the rows (token, vector) of each key's tokens; unknown tokens are left out."""
    cells = tokens.join(matrix, "token").select(key, F.posexplode("vector").alias("at", "x"))
    mean = cells.groupBy(key, "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    packed = mean.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda c: c["x"]).alias("v"))
    size = norm(F.col("v"))
    return packed.select(key, F.when(size > 0, F.transform("v", lambda x: x / size)).otherwise(F.col("v")).alias("vector"))


def hybrid(semantic: DataFrame, lexical_hits: DataFrame, limit: int, key: str = "id") -> DataFrame:
    """(key, tier, position): the semantic hits (key, score) first, then lexical ones (key, rank, place) not among them, ``limit`` in all."""
    s = semantic.select(key, F.lit(0).alias("tier"), (-F.col("score")).alias("by"), F.col(key).cast("string").alias("tie"))
    x = lexical_hits.join(semantic.select(key), key, "left_anti").select(key, F.lit(1).alias("tier"), (-F.col("rank")).cast("double").alias("by"), F.col("place").cast("string").alias("tie"))
    return s.unionByName(x).orderBy("tier", "by", "tie", key).limit(limit).select(key, "tier")
