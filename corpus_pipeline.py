"""The corpus pipeline: language ID, toxicity, SimHash near-dedup, PII and packing, one after the other.

Every stage takes all that the stage before it kept.  All but the last return the columns of ``documents``: the first two
drop the documents that they reject, the third all but one of each group of near-duplicates, the fourth covers personal
data in the texts and counts their characters anew.  The last returns the pieces of packed sequences.

Cases: a null text has no language and is dropped; a null label, language or source is kept; repeated rows are copies of
one another, so one stays; an empty table goes through all stages; extra columns are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from whylake.llm import langid, packing, pii, simhash, toxicity
from whylake.llm.common import fresh, materialise, table


#: Texts that travel to Python at a time.  Spark's default of ten thousand is made for short rows.
BATCH = 1000


def small_batches(spark: SparkSession) -> None:
    """Fewer texts in a batch, so that several tasks with long texts fit into one executor."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose language cannot be told."""
    small_batches(spark)
    model = langid.learn(docs, langid.training_labels(docs))
    lang, score = fresh(docs, "lang_pred"), fresh(docs, "lang_score")
    return langid.identified(docs, model, lang=lang, score=score).where(F.col(lang) != langid.UNKNOWN).select(*docs.columns)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that score as toxic."""
    small_batches(spark)
    model = toxicity.learn(docs, toxicity.training_labels(table(spark, sf_dir, "labels")))
    score = fresh(docs, "toxic_score")
    return toxicity.scored(docs, model, score=score).where(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near-duplicates: five words, similarity 0.8 or more."""
    small_batches(spark)
    return simhash.keep_one_similar(docs)


def covered(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind."""
    clean = pii.masked(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else clean


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences."""
    small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", known_language),
    ("toxicity", not_toxic),
    ("near_dedup", near_dedup),
    ("pii", covered),
    ("packing", packed),
]

#: Learned models, near-duplicate components and tokenisers are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written before the next one reads it more than once."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
