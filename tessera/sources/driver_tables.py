"""The star-schema tables read as a graph, as symbols and as corpora; and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _node(prefix: str, key: str):
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependent to dependency: orders call customers and use parts, parts implement suppliers, those and customers extend nations, nations define regions. Not merged."""
    t = lambda n: table(spark, sf_dir, n)
    row = lambda df, src, dst, kind, conf, source, reason: df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), conf.cast("double").alias("confidence"), F.lit(source).alias("source"), reason.alias("reason"))
    why = F.when(F.col("l_returnflag") == "A", "dispatch").when(F.col("l_returnflag") == "N", "ast-narrowed").otherwise("regex-fallback")
    lines = t("lineitem")
    return (
        row(t("orders"), _node("o", "o_orderkey"), _node("c", "o_custkey"), "calls", F.lit(0.95), "ast", F.lit("ast-narrowed"))
        .unionByName(row(lines, _node("o", "l_orderkey"), _node("p", "l_partkey"), "uses-type", F.round(1 - 5 * F.col("l_discount"), 4), "heuristic", why))
        .unionByName(row(lines, _node("p", "l_partkey"), _node("s", "l_suppkey"), "implements", F.lit(0.85), "heuristic", F.lit("type-ref")))
        .unionByName(row(t("supplier"), _node("s", "s_suppkey"), _node("n", "s_nationkey"), "extends", F.lit(0.85), "heuristic", F.lit("inheritance")))
        .unionByName(row(t("customer"), _node("c", "c_custkey"), _node("n", "c_nationkey"), "extends", F.lit(0.85), "heuristic", F.lit("inheritance")))
        .unionByName(row(t("nation"), _node("n", "n_nationkey"), _node("r", "n_regionkey"), "defines", F.lit(1.0), "ast", F.lit("structural")))
    )


EDGES_SQL = """
edges AS (
  SELECT 'o' || o_orderkey AS src, 'c' || o_custkey AS dst, 'calls' AS type, 0.95::DOUBLE AS confidence, 'ast' AS source, 'ast-narrowed' AS reason FROM orders
  UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey, 'uses-type', round(1 - 5 * l_discount, 4), 'heuristic',
    CASE l_returnflag WHEN 'A' THEN 'dispatch' WHEN 'N' THEN 'ast-narrowed' ELSE 'regex-fallback' END FROM lineitem
  UNION ALL SELECT 'p' || l_partkey, 's' || l_suppkey, 'implements', 0.85, 'heuristic', 'type-ref' FROM lineitem
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'extends', 0.85, 'heuristic', 'inheritance' FROM supplier
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'extends', 0.85, 'heuristic', 'inheritance' FROM customer
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'defines', 1.0, 'ast', 'structural' FROM nation
)"""


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as symbols: the type is the file, the brand the parent."""
    p = table(spark, sf_dir, "part")
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    return p.select(
        _node("p", "p_partkey").alias("id"), F.concat(F.lit("src/"), F.lower("p_type"), F.lit(".py")).alias("file_path"), F.lit("python").alias("language"),
        F.when(F.col("p_size") > 25, "class").otherwise("method").alias("kind"), name.alias("name"), F.concat("p_brand", F.lit("."), name).alias("qualified_name"), F.col("p_brand").alias("parent_symbol"),
        F.concat(F.lit("def "), name, F.lit("("), F.col("p_size").cast("string"), F.lit(")")).alias("signature"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("docstring"),
        F.struct(F.col("p_size").alias("start"), (F.col("p_size") + 4).alias("end")).alias("span"), (F.col("p_retailprice") > 1000).alias("exports"),
    )


SYMBOLS_SQL = """
symbols AS (
  SELECT 'p' || p_partkey AS id, 'src/' || lower(p_type) || '.py' AS file_path, 'python' AS language,
    CASE WHEN p_size > 25 THEN 'class' ELSE 'method' END AS kind, replace(p_name, ' ', '_') AS name,
    p_brand || '.' || replace(p_name, ' ', '_') AS qualified_name, p_brand AS parent_symbol,
    'def ' || replace(p_name, ' ', '_') || '(' || p_size || ')' AS signature, concat_ws(' ', p_name, p_type, p_brand) AS docstring,
    p_size AS span_start, p_size + 4 AS span_end, p_retailprice > 1000 AS exports
  FROM part
)"""


def flat(df: DataFrame) -> DataFrame:
    """Symbols with the span as two columns."""
    return df.withColumn("span_start", F.col("span.start")).withColumn("span_end", F.col("span.end")).drop("span")


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders before and after: keys not divisible by 10, then those not 1 more; the signature of every 7th changed, every 13th renamed."""
    o = table(spark, sf_dir, "orders")
    base = lambda name, signature: (
        _node("o", "o_orderkey").alias("id"), F.concat(F.lit("src/"), F.lower(F.col("o_orderpriority")), F.lit(".py")).alias("file_path"), name.alias("qualified_name"), F.lit("function").alias("kind"), name.alias("name"),
        signature.alias("signature"), F.concat(F.lit("def "), name, F.lit("(): return price_of(\""), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("\", \""), F.col("o_orderkey").cast("string"), F.lit("\")")).alias("raw_text"),
        F.struct((F.col("o_orderkey") + 1).cast("int").alias("start"), (F.col("o_orderkey") + 2).cast("int").alias("end")).alias("span"), (F.col("o_orderstatus") == "F").alias("exports"),
    )
    plain = F.concat(F.lit("cust"), (F.col("o_custkey") % 500).cast("string"))
    signature = F.concat(F.lit("def f("), F.col("o_orderstatus"), F.lit(")"))
    before = o.filter("o_orderkey % 10 <> 0").select(*base(plain, signature))
    renamed = F.when(F.col("o_orderkey") % 13 == 0, F.concat(plain, F.lit("_v2"))).otherwise(plain)
    after = o.filter("o_orderkey % 10 <> 1").select(*base(renamed, F.when(F.col("o_orderkey") % 7 == 0, F.concat(signature, F.lit(": int"))).otherwise(signature)))
    return before, after


def _snapshot_sql(name: str, keep: str, rename: str, signature: str) -> str:
    return f"""
{name} AS (
  SELECT 'o' || o_orderkey AS id, 'src/' || lower(o_orderpriority) || '.py' AS file_path, {rename} AS qualified_name, 'function' AS kind, {rename} AS name, {signature} AS signature,
    'def ' || {rename} || '(): return price_of("' || o_totalprice::DECIMAL(18,2)::VARCHAR || '", "' || o_orderkey || '")' AS raw_text,
    o_orderkey + 1 AS span_start, o_orderstatus = 'F' AS exports
  FROM orders WHERE {keep}
)"""


_PLAIN = "('cust' || (o_custkey % 500))"
SNAPSHOTS_SQL = (
    _snapshot_sql("before", "o_orderkey % 10 <> 0", _PLAIN, "('def f(' || o_orderstatus || ')')")
    + ","
    + _snapshot_sql("after", "o_orderkey % 10 <> 1", f"(CASE WHEN o_orderkey % 13 = 0 THEN {_PLAIN} || '_v2' ELSE {_PLAIN} END)", "('def f(' || o_orderstatus || ')' || CASE WHEN o_orderkey % 7 = 0 THEN ': int' ELSE '' END)")
)
