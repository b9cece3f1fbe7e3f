"""The corpus pipeline: quality filter, line deduplication, near-duplicate removal, packing.

STAGES lists the steps in order; each takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read again as
the next one's ``docs``.  All but the last return the columns of the documents they were given.

1. ``quality``: a document goes if the additive model scores its whole text below 0.7.  The model learns from the labelled rows that aren't
   held out, at most ``quality_gam.MAX_TRAIN``.
2. ``lines``: of lines that differ by two edits or fewer the first in the corpus stays; of lines under 16 characters that aren't blank, of equal ones only.  A document can lose all its lines; its row stays.
3. ``near_duplicates``: of documents whose five-word shingle sets link at 0.75 the one with the least id stays.
4. ``packing``: the tokenised documents as sequences of at most 1024 ids, a row for each piece.

Null and empty texts pass the stages as the operators define: scored like any text, without lines, linked with nothing, one end id.
Rows that repeat an id are one document from stage 3 on.  Of documents or lines that tie, the first by id (and place) stays.  Very long
texts are taken whole in every stage.  Extra columns pass through the first three stages.  Empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession

from fieldlens.llm import line_dedup, ngram_join, packing, quality_gam
from fieldlens.llm.common import shared_path, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_gam.keep_good(docs, quality_gam.train(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicate(docs, short=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.tokenise(docs, tokenizers.path("byte_bpe_50k.json"), tokenizers.PATTERN))


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("packing", pack)]

#: The classifier and the packing aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = shared_path(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
