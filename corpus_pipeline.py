"""A training-corpus pipeline over ``documents``: five of the training-data
operators in a row, each stage written to the shared folder and read by the next.

1. toxicity: documents that the classifier (learnt from ``labels`` and this
   stage's own documents) rejects go;
2. near duplicates (five words, similarity 0.8): one document of each group stays;
3. decontamination: documents with a verbatim window of ``benchmark`` go;
4. personal data: texts with pseudonyms;
5. packing: the pieces of all that is left, in sequences of 2048 tokens.

Stages 1 to 4 return the columns of ``documents``.  Null texts, empty tables and
extra columns go through.  Stage 2 compares rows by their texts alone: rows that
share an id, or have none, are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from clickfeat.llm import decontaminate, minhash, packing, pii, toxicity
from clickfeat.llm.common import fold, read, staged
from clickfeat.llm.queries import byte_bpe, pseudonym_key


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.learn(docs, read(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)
    return toxicity.accepted(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.one_of_each(docs, k=5)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(docs, pseudonym_key(spark), spans="__found").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, byte_bpe())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", pseudonymise),
    ("packing", pack),
]

#: most stages cannot be put in SQL; tests hold each against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
