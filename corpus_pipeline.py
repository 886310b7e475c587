"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.digest_index import first_of_each
from tessera.llm.mixing import mix
from tessera.llm.packing import pack_documents
from tessera.llm.queries import VOCABULARY, WEIGHTS
from tessera.llm.simhash import drop_near_duplicates
from tessera.llm.storage import materialize
from tessera.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier judges toxic; it is trained on the labelled ones among them.

    Null, empty and wordless texts stay, very long ones are judged whole, repeated rows share their fate; a null doc_id has no label
    but is judged; without labels of both classes all stay; an empty table stays empty. All columns pass, whatever their names.
    """
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each text the row of least doc_id, by an index of digests that is empty at the start of a run.

    Null texts all stay, empty ones are copies of one another; null doc_ids come last; of rows alike in both one stays, the
    least by its other columns; an empty table stays empty. All columns pass, whatever their names.
    """
    return first_of_each(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each near-duplicate group the document of least doc_id.

    Null and wordless texts are in no group and stay; a null doc_id is greater than all others; rows alike in doc_id and signature
    stay or go together; an empty table stays empty. All columns pass, whatever their names.
    """
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and samples documents to the sources' target weights.

    A null source is a source of its own; null texts have no characters and go with their source; a null doc_id hashes as an empty
    one; rows of one doc_id are kept or left together; an empty table stays empty. All columns pass, whatever their names.
    """
    return mix(docs, WEIGHTS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every token of the mixed corpus in a sequence.

    Null and empty texts have no row; a long text has one for each piece; repeated rows and null doc_ids are packed each by itself; an empty
    table gives no rows. Columns other than doc_id and text are left out.
    """
    return pack_documents(docs, vocabulary=VOCABULARY)


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: A trained classifier decides the first stage, so SQL can't give the rows; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
