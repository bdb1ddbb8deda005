"""The corpus pipeline: five stages over `documents`, each on all rows that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written as
Parquet and read again before the next one; all but the last return the columns
of `documents`.

1. toxicity: documents that score 0.7 or more go.
2. near_duplicates: one document of each component, the smallest id, stays.
3. decontamination: documents that hold a benchmark item go.
4. secrets: every secret found is masked in the text; no document goes.
5. tokens: SentencePiece ids of each text, and the digest of their decoding.

Defined results: rows with a null id take part in stages 1, 3, 4 and 5 and pass
stage 2; a null or empty text is clean, has no duplicates, items, secrets or ids;
equal rows (id and text) become one in stage 2, rows of one id with other texts stay
together; very long texts are read whole; an empty table gives an empty result; other
columns of `documents`, also those named like an operator's own, are kept by all
stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cinetide.llm import decontaminate, neardup, pieces, secrets, toxicity
from cinetide.llm.common import discarded, made, saved, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.tokenized(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("tokens", tokenize),
]
#: Training, hashing and transducers are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    docs, mark = table(spark, sf_dir, "documents"), made()
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
        discarded(spark, mark, docs)  # what the stage itself made, and its predecessor's table
    return STAGES[-1][1](spark, docs, sf_dir)
