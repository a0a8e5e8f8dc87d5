"""The given tables in the roles the operators work on.  Every mapping uses whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsframe.session import configure, scratch

# Parameters of the workload, used on the Spark and the SQL side alike.
THRESHOLD = 4096
RECEIPT_MAX = 1024
WINDOW_TOKENS = 1800
HOT = 1
NOW = "2024-01-31 00:00:00"
RETENTION_DAYS = 20
QUOTA = 120_000
GENERATION_RETENTION = 3
GENERATION_QUOTA = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # A text table in fewer files than cores: spread narrow heavy work (regular expressions) over the cores.
    # At scale there are more files than cores and nothing is moved.
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in ("documents", "pages") and len(df.inputFiles()) < cores else df


def spread(spark: SparkSession, sf_dir: str, *names: str) -> str:
    """A folder with these tables for a job that reads them many times: the given one, or copies in as many files as cores.

    :func:`table` moves a text table in few files at every reading; here it is moved once.
    """
    cores = spark.sparkContext.defaultParallelism
    if len(spark.read.parquet(f"{sf_dir}/documents.parquet").inputFiles()) >= cores:
        return sf_dir
    folder = scratch(spark)
    for name in names:
        copied = table(spark, sf_dir, name)
        copied.write.parquet(f"{folder}/{name}.parquet")
    return folder


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as tool results: session and project = source, call = doc_id, tool = lang."""
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("project_id"),
        F.col("source").alias("session_id"),
        F.col("doc_id").cast("string").alias("tool_call_id"),
        F.col("lang").alias("tool_name"),
        "text",
        (F.col("n_chars") < 100).alias("is_error"),
        F.col("doc_id").alias("seq"),
    )


def now():
    return F.lit(NOW).cast("timestamp")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def block(text):
    null = F.lit(None).cast("string")
    return F.struct(F.lit("text").alias("type"), text.alias("text"), null.alias("id"), null.alias("name"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as messages: assistant turns play tool results, user turns the calls before them."""
    null = F.lit(None).cast("string")
    call = F.struct(
        F.lit("toolCall").alias("type"),
        null.alias("text"),
        F.concat(F.lit("call-"), F.col("turn") + 1).alias("id"),
        F.lit("answer").alias("name"),
    )
    asks, answers = F.col("role") == "user", F.col("role") == "assistant"
    return table(spark, sf_dir, "conversations").select(
        F.lit("conversations").alias("project_id"),
        F.col("conv_id").cast("string").alias("session_id"),
        F.col("turn").alias("msg_idx"),
        F.when(asks, "assistant").when(answers, "toolResult").otherwise("user").alias("role"),
        F.when(asks, F.array(block(F.col("text")), call)).otherwise(F.array(block(F.col("text")))).alias("content"),
        F.when(answers, F.concat(F.lit("call-"), F.col("turn"))).alias("tool_call_id"),
        F.when(answers, F.lit("answer")).alias("tool_name"),
        F.when(answers, F.lit(False)).alias("is_error"),
        F.col("turn").alias("timestamp"),
    )


def spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as they are: roles user, assistant, system with plain text."""
    return table(spark, sf_dir, "conversations").select(
        F.lit("conversations").alias("project_id"),
        F.col("conv_id").cast("string").alias("session_id"),
        F.col("turn").alias("msg_idx"),
        "role",
        "text",
    )


def result_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tool results of those messages as observations to archive."""
    return messages(spark, sf_dir).filter(F.col("role") == "toolResult").select(
        "project_id",
        "session_id",
        "tool_call_id",
        "tool_name",
        F.col("content")[0]["text"].alias("text"),
        "is_error",
        (F.col("session_id").cast("long") * 1000 + F.col("msg_idx")).alias("seq"),
    )


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as files: project = host, path = URL path without query and fragment."""
    return table(spark, sf_dir, "pages").select(
        F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("project_id"),
        F.regexp_replace(F.regexp_extract("url", "^[a-z]+://[^/?#]+([^?#]*)", 1), "^/+", "").alias("path"),
        F.col("html").alias("text"),
        "page_id",
    )


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: project = source, path = lang/doc_id.txt."""
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("project_id"),
        F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        "text",
        "doc_id",
        "source",
    )


def one_project():
    """A project for all documents, derived from the source name (src0, src1, ...)."""
    return F.substring("source", 1, 3)


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark passages as queries: every three words in a row, from the first to the last."""
    words = F.split(F.regexp_replace("text", r"\s+", " "), " ")
    parts = F.transform(
        F.sequence(F.lit(0), F.ceil(F.size(words) / 3).cast("int") - 1), lambda i: F.array_join(F.slice(words, i * 3 + 1, F.lit(3)), " ")
    )
    cut = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(parts).alias("part", "query"))
    return cut.select(
        F.substring(F.concat(F.lit("src"), "item_id"), 1, 3).alias("project_id"),
        F.concat_ws(".", F.col("item_id").cast("string"), F.col("part").cast("string")).alias("query_id"),
        "query",
    )


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark passages as queries, whole and as they are."""
    return table(spark, sf_dir, "benchmark").select(
        F.lit("src").alias("project_id"), F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query")
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as change events: project = user, path from the event's key."""
    kind = F.when(F.col("event_type") == "signup", "add").when(F.col("event_type") == "error", "unlink").otherwise("change")
    return events(spark, sf_dir).select(
        F.concat(F.lit("user-"), F.col("user_id")).alias("project_id"),
        F.concat(F.lit("src/"), F.get_json_object("props", "$.k")).alias("path"),
        kind.alias("event"),
        "ts",
        F.col("event_id").alias("seq"),
    )


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as stored artifacts: project = user, size = value in cents, mtime = event time."""
    return events(spark, sf_dir).select(
        F.concat(F.lit("user-"), F.col("user_id")).alias("project_id"),
        F.col("event_id").cast("string").alias("artifact_id"),
        F.round(F.col("value") * 100).cast("long").alias("size"),
        F.col("ts").alias("modified_at"),
        "event_type",
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as map generations: project = user, generation = event id, active = the last signup or click."""
    rows = events(spark, sf_dir).select(
        F.concat(F.lit("user-"), F.col("user_id")).alias("project_id"),
        F.col("event_id").alias("generation"),
        F.round(F.col("value") * 100).cast("long").alias("bytes"),
        "event_type",
        "value",
        "props",
    )
    active = rows.filter(F.col("event_type") == "click").groupBy("project_id").agg(F.max("generation").alias("_active"))
    return (
        rows.join(active, "project_id", "left")
        .withColumn("is_active", F.coalesce(F.col("generation") == F.col("_active"), F.lit(False)))
        .drop("_active")
    )


def oplog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as an operation log: one session per user, operations by event type."""
    op = (
        F.when(F.col("event_type") == "signup", "capsule_build")
        .when(F.col("event_type") == "error", "archive")
        .when(F.col("event_type") == "click", "map_query")
        .when(F.col("event_type") == "purchase", "generation")
        .otherwise("reduction")
    )
    key = F.get_json_object("props", "$.k").cast("long")
    return events(spark, sf_dir).select(
        F.concat(F.lit("user-"), F.col("user_id")).alias("session_id"),
        F.col("event_id").alias("seq"),
        op.alias("op"),
        F.col("value").alias("duration_ms"),
        (F.col("value") < 20).alias("ok"),
        (key > 50).alias("deduplicated"),
        F.round(F.col("value") * 100).cast("long").alias("bytes"),
        key.cast("string").alias("content_hash"),
        key.alias("insertion_index"),
        (key > 30).alias("triggered"),
        key.alias("reduced_count"),
        F.round(F.col("value") * 1000).cast("long").alias("tokens_before"),
        F.round(F.col("value") * 500).cast("long").alias("tokens_after"),
        (key > 60).alias("target_reached"),
    )
