"""Corpus pipeline: toxic, foreign, repeated and contaminated documents go; what is left becomes token ids.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as
the next stage's documents. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import bpe, language, toxicity
from newsloom.llm.containment import contained, without
from newsloom.llm.near_duplicates import near_duplicates
from newsloom.llm.queries import table, tokenizer_file
from newsloom.llm.sample import held_out
from newsloom.session import run_dir

TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below ``TOXIC``; the model does not learn from the hold-out third of ids."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id", 3, 1))
    scored = toxicity.toxicity(docs, model, reject=TOXIC)
    return scored.filter("predicted = 0").select(*docs.columns)


def drop_foreign(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the languages learned from ``lang``; texts without letters and texts unlike all of them go."""
    model = language.train(docs, ~held_out("doc_id", 4, 2))
    scored = language.language(docs, model, known="_known")
    return scored.filter((F.col("lang_pred") != "und") & (F.col("_known") == 1)).select(*docs.columns)


def drop_repeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates; texts without words stay."""
    groups = near_duplicates(docs, size=5, percent=80)
    return without(docs, groups.filter(~F.col("kept")).select("doc_id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than 80 percent of every benchmark item."""
    hits = contained(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, hits.select(F.col("id").alias("doc_id")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, and whether these decode to the very text."""
    return bpe.with_tokens(docs, bpe.load(tokenizer_file()), ids="ids", lossless="lossless")


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_foreign),
    ("near_duplicates", drop_repeated),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: Two of the stages are fitted models, which SQL cannot express; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    folder = run_dir(spark, "corpus")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
