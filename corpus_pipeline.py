"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; all but the last
return the columns of documents. Between stages the rows are written as Parquet and
read again, in the shared folder when ``run`` applies them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.llm import line_dedup, mixing, near_copies, packing, quality
from vellumspark.llm.common import kept, table, visible


def reject_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    visible(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def cut_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars follows the text; documents of boilerplate only stay, with empty text.
    Copies of a text are one page, so that they don't make its lines boilerplate."""
    clean = line_dedup.dedup_lines(docs, copies_once=True).drop("lines_dropped")
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    visible(spark)
    return near_copies.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    visible(spark)
    return packing.digests(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality", reject_bad),
    ("lines", cut_boilerplate),
    ("near duplicates", keep_one_of_each),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A fitted classifier and a tokenizer are not SQL; tests/llm/test_pipeline.py follows
#: every stage by brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
