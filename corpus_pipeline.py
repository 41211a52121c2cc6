"""The corpus pipeline: stages over documents, each over what the one before it kept.

Cases, for every stage and the whole: null and empty texts are documents of an empty text: they
are scored as such, link with nothing, hold no passage and no personal data, and pack as one end
token; a null id stays, and its row is kept by every stage that keeps its text; repeated rows
count as copies, of which one stays where they have words and an id; of linked documents the
smallest id stays; texts of any length are read whole; extra columns, whatever their names, pass
through all stages but the last; without labels or benchmark items nothing goes for want of them;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopframe.llm import decontam, ngram_join, packing, pii, quality
from hopframe.llm.common import drop_written, settled, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier finds good."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents."""
    return ngram_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; documents that are mostly benchmark go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their ids, and the ids' CRC-32 beside them."""
    return packing.pack(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("packing", pack),
]

#: Classifiers, a random field and a tokenizer take part: SQL cannot express these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, as a written table. A stage's table goes when the next one is written, or fails."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        try:
            after = settled(spark, lambda: stage(spark, docs, sf_dir))  # noqa: B023
        finally:
            if before is not None:
                drop_written(before)
        docs = before = after
    return docs
