"""Documents to training sequences: language ID, exact dedup, near-dedup, mixing, packing.

Each stage works on all that its predecessor kept. The stages before the last return the columns of ``documents``.

Defined cases, stage by stage; each operator's module says more. Null, empty and blank texts, and those without a letter, go with
language ID, as does what it scores under a half; null ids, languages and sources go through all stages. Rows that repeat a
document are one after exact dedup, that with most code points, then the smallest id, null ids last. Of near copies the smallest id stays,
rows without an id all do. Mixing draws rows by id, those without one by text, and null sources and languages are a value
of their own. Packing takes whatever is left; texts of any length stay whole until it cuts pieces of them. An empty table
gives an empty result in each stage. Extra columns go through to the last stage, which leaves them out.
``ORACLE_SQL`` is None: the language model, SimHash and packing cannot be said in SQL; tests/llm holds a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import exact_dedup, language_id, mixing, packing, simhash
from marlstone.llm.common import cut


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample_mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"stage-{name}")
    return docs
