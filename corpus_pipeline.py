"""A training corpus from ``documents``: quality, near duplicates, personal data, mixture, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsframe.llm import mixing, neardup, packing, pii, quality
from obsframe.session import configure, scratch

# Two of the stages learn models, so no SQL gives the rows; tests compare each stage with a plain version.
ORACLE_SQL = None


def _fresh(docs: DataFrame, name: str) -> str:
    """``name``, or with underscores until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _same_columns(out: DataFrame, docs: DataFrame) -> DataFrame:
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the field of lines finds bad (below 0.5)."""
    configure(spark)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = _fresh(docs, "quality_score")
    return _same_columns(quality.score(docs, model, name).filter(F.col(name) >= 0.5), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, the smallest doc_id, of each group of similarity 0.8 on five-word shingles."""
    configure(spark)
    return _same_columns(neardup.keep_one(docs, neardup.NearDupParams(words=5)), docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind in brackets; n_chars follows where the column is there."""
    configure(spark)
    name = _fresh(docs, "pii_spans")
    found = pii.find(docs, pii.train(docs), name)
    out = found.withColumn("text", pii.redact(F.col("text"), F.col(name)))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.size(name) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return _same_columns(out, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents so that in expectation all sources weigh the same, and shuffle them globally."""
    configure(spark)
    return mixing.shuffled(mixing.mix(docs)).select("_row.*")


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches of the documents that are left, by their number of words: doc_id, length, bucket, padded_length, batch, slot."""
    configure(spark)
    return packing.pack(packing.word_lengths(docs))


STAGES = [
    ("quality classifier", select_quality),
    ("near-duplicate removal", drop_near_duplicates),
    ("personal data", redact_pii),
    ("source mixture", mix_sources),
    ("packing", pack_batches),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written as Parquet to the shared folder and read again."""
    configure(spark)
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch(spark)
    for i, (_, stage) in enumerate(STAGES):
        path = f"{folder}/stage-{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
