"""A training corpus from the table of documents, in five stages.

1. language ID: documents whose language cannot be told are rejected;
2. near-duplicates: one document of each group stays;
3. secret scans: secrets are replaced in the texts;
4. mixing: documents are replicated towards the target weights of their sources, and shuffled;
5. packing: texts are tokenized and packed into training sequences.

Each stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of ``docs``.
Between stages the rows are written to the shared folder and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vicinity.llm import langid, mixing, neardup, packing, secrets
from vicinity.llm.common import cut_lineage, read_table
from vicinity.llm.queries import MIX_OTHER, MIX_WEIGHTS

#: Least posterior of the predicted language.
MIN_LANGUAGE_SCORE = 0.5
#: Mean number of times that a character of the input appears in the mixture.
EPOCHS = 1.0


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, MIN_LANGUAGE_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_secrets(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, MIX_WEIGHTS, MIX_OTHER, EPOCHS).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", remove_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL cannot express the stages; tests hold the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
