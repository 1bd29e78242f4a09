"""The corpus pipeline: documents to packed sequences in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all
but the last return the columns of documents.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidewatch.llm import language, lines, mixing, near, packing  # noqa: E402
from tidewatch.llm.common import ROW_GROUP_BYTES, document_rows, documents, keep  # noqa: E402

#: A document goes when so few of its n-grams belong to the language that fits it best.
MIN_LANGUAGE_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that the corpus teaches; `lang` becomes the prediction."""
    model = language.learn(docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    judged = language.predict(docs, model)
    known = judged.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return document_rows(known.withColumn("lang", F.col("lang_pred")))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take the boilerplate lines of each source out of its documents; whole copies, which
    the next stage merges, make no line frequent. Sources of every size are treated."""
    return document_rows(lines.dedup_lines(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies."""
    return near.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents as often as the target weights of their sources ask for."""
    return mixing.take_mix(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences, with their token ids."""
    return packing.pack_pieces(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_boilerplate),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# Learned filters, sketches and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written before the next reads them."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}", ROW_GROUP_BYTES)
    return STAGES[-1][1](spark, docs, sf_dir)
