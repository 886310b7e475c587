"""The registered queries of the training-data operators, with SQL where it can say the same."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.compression import compression_filter
from tessera.llm.digest_index import DigestIndex, ingest_in_turns
from tessera.llm.licenses import scan_licenses
from tessera.llm.lm_score import load_vocabulary, score_documents
from tessera.llm.mixing import mix
from tessera.llm.packing import pack_documents
from tessera.llm.secrets import scan_secrets
from tessera.llm.simhash import near_groups
from tessera.llm.storage import shared_path
from tessera.llm.suffix_dedup import repeated_passages
from tessera.llm.toxicity import toxic_documents

#: Target weights of the sources; a source not named weighs 1.
WEIGHTS = {"src0": 2.0, "src1": 8.0, "src2": 6.0, "src3": 4.0, "src4": 3.0}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: A sentencepiece model; the default is the public one that the installed package public_tokenizers holds.
VOCABULARY = os.environ.get("TESSERA_VOCABULARY", "/opt/tokenizers/piece_bpe_32k.model")


def op1_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir), load_vocabulary(VOCABULARY))


def op2_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(documents(spark, sf_dir))


def op3_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_filter(documents(spark, sf_dir))


def op4_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = DigestIndex(spark, shared_path(spark, "digest-index"))
    added = ingest_in_turns(documents(spark, sf_dir), index)
    index.close()
    return added


OP5_SQL = """
SELECT min(doc_id) AS doc_id, sha256(text) AS digest
FROM documents WHERE text IS NOT NULL GROUP BY sha256(text)
"""


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), vocabulary=VOCABULARY)


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    return mix(docs, WEIGHTS, copy="repetition").select("doc_id", "source", "repetition")


OP8_SQL = f"""
WITH sizes AS (
  SELECT source, sum(length(text))::DOUBLE AS n FROM documents GROUP BY source
), weighed AS (
  SELECT source, n, 4.0::DOUBLE * n AS cap, sum(n) OVER () AS budget,
    CASE source {' '.join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.items())} ELSE 1.0 END::DOUBLE AS w
  FROM sizes
), filling AS (
  SELECT *,
    coalesce(sum(cap) OVER before, 0) AS cap_before,
    sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS w_left,
    cap / w AS turn
  FROM weighed
  WINDOW before AS (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), clamped AS (
  SELECT *, min(CASE WHEN (budget - cap_before) * w / w_left >= cap THEN 1 ELSE 0 END)
    OVER (ORDER BY turn, source ROWS UNBOUNDED PRECEDING) AS is_full
  FROM filling
), epochs AS (
  SELECT source, CASE WHEN is_full = 1 THEN 4.0::DOUBLE
    ELSE (budget - coalesce(sum(cap) FILTER (WHERE is_full = 1) OVER (), 0)) * w
      / sum(w) FILTER (WHERE is_full = 0) OVER () / n END AS e
  FROM clamped
), copies AS (
  SELECT doc_id, d.source, (floor(e) + CASE WHEN
    ('0x' || substr(md5('mix-1:' || doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE < e - floor(e)
    THEN 1 ELSE 0 END)::INTEGER AS c
  FROM documents d JOIN epochs USING (source)
)
SELECT doc_id, source, unnest(range(1, c + 1))::INTEGER AS repetition FROM copies
"""


def op7_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lattice_likelihood": op1_lattice_likelihood,
    "op2_suffix_repeats": op2_suffix_repeats,
    "op3_compression_bands": op3_compression_bands,
    "op4_simhash_groups": op4_simhash_groups,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_secret_links": op7_secret_links,
    "op8_source_mixing": op8_source_mixing,
    "op9_toxicity": op9_toxicity,
    "op10_license_scan": op10_license_scan,
}
ORACLES: dict[str, str] = {
    "op5_exact_dedup": OP5_SQL,
    "op8_source_mixing": OP8_SQL,
}
