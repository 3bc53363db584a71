"""A training corpus from ``documents``: five stages, each a filter or a rewrite of whole rows.

1. language ID: documents without a recognisable language go;
2. n-gram Jaccard join: of each group of near copies the document of the least id stays;
3. substring dedup: repeated lines stay where they come first;
4. benchmark decontamination: contaminated documents go;
5. best-fit packing: where every text lies in sequences of permitted lengths.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqledger.llm.decontaminate import decontaminate
from seqledger.llm.langid import keep_identified
from seqledger.llm.line_dedup import remove_repeats
from seqledger.llm.ngram_join import keep_one_of_each
from seqledger.llm.packing import pack_documents
from seqledger.session import cut

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs, least=0.5)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(docs, k=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = remove_repeats(docs, counts="n_units_of_text", spans="removed_from_text")
    length = F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return out.select(*[length.alias(c) if c == "n_chars" else out[c] for c in docs.columns])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=13, share=20, action="drop")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: The first stage is a learned model, which SQL can't express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
