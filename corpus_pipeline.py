"""Corpus pipeline: toxicity, near duplicates, secrets, mixture, packing.

Each stage takes all that its predecessor kept, as written Parquet, and
returns the columns of ``documents`` (the last one returns packed pieces).

Defined results: other columns of the input are left out, whatever their names;
an empty table gives no rows.  Null and empty texts score like texts without an
entry, are in no group of copies, hold no secrets, have no words and so go in the
mixture.  Rows without an id are in no group of copies; of rows that share an id
each is judged by its own text.  Repeated rows are one group of copies.  Texts of
any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import mixing, near_dedup, packing, secret_scan, toxicity
from vellum.llm.scratch import Scratch, partitions, table
from vellum.llm.tokens import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Copies of one row that one task makes.
AT_ONCE = 4096


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text scores 0.5 or more go; the model is fitted on these documents and the labels."""
    docs = docs.select(*COLUMNS)
    return toxicity.reject(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest doc_id."""
    return near_dedup.deduplicate(docs.select(*COLUMNS))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; found spans are replaced by a mark."""
    return secret_scan.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it.

    Rows that are equal in all columns share a key (128 bits) and their copies, so
    each key is one row that is repeated: no rows of a key need to be told apart.
    """
    docs = docs.select(*COLUMNS)
    whole = F.to_json(F.struct(*COLUMNS), {"ignoreNullFields": "false"})
    keyed = docs.withColumn("_key", F.md5(whole))
    taken = mixing.mix(keyed.select("_key", "source", "text"), key="_key").groupBy("_key").agg(F.sum("copies").alias("_copies")).filter("_copies > 0")
    one = keyed.groupBy("_key").agg(*(F.first(c).alias(c) for c in COLUMNS)).join(taken, "_key")
    # what is taken very often is dealt to many tasks first
    step = F.lit(AT_ONCE).cast("long")
    often = one.filter(F.col("_copies") > step).withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1, step))).repartition(partitions(spark), "_key", "_from")
    each = one.filter(F.col("_copies") <= step).withColumn("_from", F.lit(0).cast("long")).unionByName(often)
    times = F.least(step, F.col("_copies") - F.col("_from")).cast("int")
    return each.withColumn("_each", F.explode(F.array_repeat(F.lit(0), times))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("secret_scan", redact_secrets), ("mixing", mix_sources), ("packing", pack_sequences)]

#: Model scores and draws have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.write(docs, name)
    return docs
