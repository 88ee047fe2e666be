"""From raw documents to training pieces: each stage is one operator of ``lacuna.llm``.

Rows with nulls in any column, texts of any length, repeated rows and extra columns pass every stage;
what each does with them is said there. Every stage takes ``(spark, docs, sf_dir)`` and works on all rows the stage before it kept; all but
the last return the columns of ``docs`` as they came. The driver writes what a stage returns and
reads it again as the next one's ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm import decontaminate, exact_dedup, sentence_pieces, simhash, toxicity
from lacuna.llm.common import small_batches, stage, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. A null or empty text has the score of no sentences, a null id is
    scored like others; repeated rows share their fate; an empty table stays empty. Texts are scored
    whole. Without a usable label nothing is rejected."""
    small_batches(spark)
    return toxicity.keep_civil(docs, table(spark, sf_dir, "labels"), usable=~toxicity.held_out())


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal without white space the longest stays, then the smallest id; a null id loses. Null,
    empty and blank texts equal each other; of repeated rows one stays; an empty table stays empty."""
    small_batches(spark)
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts whose fingerprints reach each other the one with the smallest id stays; a null id loses.
    Texts without words have the fingerprint zero; of repeated rows one stays; an empty table stays empty."""
    small_batches(spark)
    return simhash.keep_one(docs, width=3, max_bits=2)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth or more of their words in benchmark passages go. Null and empty texts
    have no words and stay, as does everything if the benchmark is empty; repeated rows share their fate."""
    small_batches(spark)
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece ids of every document, and the digest of what they decode to. Null and empty texts
    have no ids; the id is the key of the draws, and null ids share one; repeated rows get equal ids."""
    small_batches(spark)
    model = public_tokenizers.path("piece_bpe_32k.model")
    ids = docs.select("doc_id", sentence_pieces.encoded(F.col("text"), F.col("doc_id"), model).alias("ids"))
    return ids.withColumn("text_sha256", F.sha2(sentence_pieces.decoded(F.col("ids"), model), 256))


STAGES = [
    ("toxicity", toxic),
    ("exact_dedup", exact),
    ("simhash", near),
    ("decontaminate", contaminated),
    ("sentence_pieces", pieces),
]

#: The scores of a fitted model and sampled pieces are beyond SQL; tests use brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; between stages rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs)
    return docs
