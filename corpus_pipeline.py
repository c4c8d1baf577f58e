"""A training corpus from the table of documents: score, filter, deduplicate twice, pack.

Each stage takes what its predecessor kept, as a Parquet table in the shared folder, and returns a DataFrame. Null texts
count as empty ones; ids may be null or repeat; extra columns are carried; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import packing, quality, simhash, suffixdedup, toxicity
from weftgraph.llm.bytescan import small_batches
from weftgraph.plans.storage import materialize

#: SQL cannot express the fitted models, fingerprints and token ids.
ORACLE_SQL = None

#: Documents that score lower are rejected; documents that score as high or higher are.
LEAST_QUALITY, TOXIC = 0.5, 0.5


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled quality classifier accepts; each row is judged by its text alone."""
    small_batches(spark)
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_quality(docs, model, LEAST_QUALITY)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class-conditional Kneser-Ney models do not call toxic; each row is judged by its text alone."""
    small_batches(spark)
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_ordinary(docs, model, TOXIC)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are alike in 0.8 or more of their five-word shingles, found by SimHash.

    Equal texts, empty ones among them, are such a group; rows with a null id stay only where a group has no other.
    """
    small_batches(spark)
    return simhash.keep_representatives(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words and more that occur in an earlier place; those emptied by it go.

    Rows are told apart by id and text; null and empty texts stay as they are.
    """
    small_batches(spark)
    cut = suffixdedup.cut_later(docs, suffixdedup.repeated_passages(docs))
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens, with their ids; a null or empty text is the end id alone."""
    small_batches(spark)
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, window=2048)


STAGES = [
    ("quality classifier", keep_good),
    ("toxicity", drop_toxic),
    ("SimHash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
