"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All
but the last return the columns of `docs`. `run` writes each stage's rows as a Parquet
table in the shared folder and reads them again, so a lost executor costs no more than
the tasks of the stage that runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loamgraph.llm.mixing import take_mix
from loamgraph.llm.near_dedup import keep_one
from loamgraph.llm.packing import pack
from loamgraph.llm.quality import keep_good
from loamgraph.llm.toxicity import keep_clean
from loamgraph.runtime import Scratch, ship, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject. Null and empty texts and null
    ids are scored like any text, repeated rows alike; an empty table stays empty."""
    ship(spark)
    return keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; odd rows as in drop_toxic."""
    ship(spark)
    return keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: five-word shingles, similarity 0.8
    or more. Null and empty texts are in no class and stay. Rows equal in doc_id and text
    count as one document; rows that share a doc_id but not the text are told apart."""
    ship(spark)
    return keep_one(docs, width=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes, down to none. Sources are the
    column `source`, null one of them; null texts have no words, and are taken as often
    as all documents of their source."""
    ship(spark)
    return take_mix(docs, weights=(5, 2, 1), repeats=3)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in sequences of 2048. A null or empty text is its
    end's token; repeated rows are documents of their own."""
    ship(spark)
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", drop_poor),
    ("near-duplicate removal", drop_near_copies),
    ("mixing", mix),
    ("packing", pack_sequences),
]

#: Trained models and a tokenizer can't be written in SQL. No stage is compared with a
#: plain version yet.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
