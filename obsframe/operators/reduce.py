"""Context budgets: shrink conversations to a token target by replacing old tool results with receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.receipts import is_receipt, receipt
from ..functions.text import block_text, byte_len, replace_text_blocks, token_estimate
from ..session import staged
from .ordered import Running, position_chunks, running, top_k

SESSION = ["project_id", "session_id"]
MESSAGE = [*SESSION, "msg_idx"]


def message_bytes(content: Column | None = None) -> Column:
    """Bytes of the serialized message; a null field is left out."""
    body = F.col("content") if content is None else content
    return byte_len(F.to_json(F.struct("role", body.alias("content"), "tool_call_id", "tool_name", "is_error", "timestamp")))


def paired_results(results: DataFrame, messages: DataFrame) -> DataFrame:
    """Tool results whose call id occurs in some assistant message of the same conversation."""
    calls = (
        messages.filter(F.col("role") == "assistant")
        .select(*SESSION, F.explode("content").alias("b"))
        .filter(F.col("b.type") == "toolCall")
        .select(*SESSION, F.col("b.id").alias("tool_call_id"))
    )
    return results.join(calls, [*SESSION, "tool_call_id"], "left_semi")


def lookup_by_call(results: DataFrame, metadata: DataFrame) -> DataFrame:
    """Attach the last archive record of (session, call); rows without one keep nulls."""
    key = [*SESSION, "tool_call_id"]
    fields = ["observation_id", "artifact_id", "archived_tool", "original_bytes", "sanitized_bytes", "redactions"]
    last = (
        metadata.withColumnRenamed("tool_name", "archived_tool")
        .withColumnRenamed("redaction_count", "redactions")
        .groupBy(*key)
        .agg(F.max_by(F.struct(*fields), "position").alias("_record"))
    )
    return results.join(last, key, "left").select(
        *results.columns, *[F.col(f"_record.{f}").alias(f) for f in fields]
    )


def hot_set(messages: DataFrame, k: int) -> DataFrame:
    """The newest ``k`` tool results of each conversation, as ``(session, hot_from)``: the oldest hot index."""
    results = messages.filter(F.col("role") == "toolResult").select(*MESSAGE)
    newest = top_k(results, SESSION, [F.col("msg_idx").desc()], k)
    return newest.groupBy(*SESSION).agg(F.min("msg_idx").alias("hot_from"))


def context_pressure(sizes: DataFrame, windows: DataFrame, soft: float, target: float) -> DataFrame:
    """Per conversation: estimated tokens against the trigger and the target.

    sizes: session key, message_bytes.  windows: session key, window_tokens, prompt_bytes.
    """
    totals = sizes.groupBy(*SESSION).agg(
        F.sum("message_bytes").alias("_bytes"), F.count(F.lit(1)).alias("_n")
    )
    total = F.col("_bytes") + F.col("_n") + 1 + F.col("prompt_bytes")  # brackets and commas of the array
    return (
        totals.join(windows, SESSION)
        .withColumn("total_bytes", total)
        .withColumn("tokens_before", token_estimate("total_bytes"))
        .withColumn("target_tokens", F.col("window_tokens") * F.lit(target))
        .withColumn("triggered", F.col("tokens_before") >= F.col("window_tokens") * F.lit(soft))
        .drop("_bytes", "_n", "prompt_bytes", "window_tokens")
    )


def greedy_reduce(candidates: DataFrame) -> DataFrame:
    """Mark the candidates that are replaced: oldest first until the estimate reaches the target.

    candidates: session key, msg_idx, saving, total_bytes, target_tokens.  A saving may be negative, so the
    stop test looks at the lowest estimate so far: once at the target, replacing stops for good.
    """
    prior = running(
        candidates,
        SESSION,
        ["msg_idx"],
        {"_saved": Running("sum", F.col("saving"), before=True)},
        position_chunks("msg_idx"),
    ).withColumn("_estimate", token_estimate(F.col("total_bytes") - F.col("_saved")))
    lowest = running(
        prior,
        SESSION,
        ["msg_idx"],
        {"_lowest": Running("min", F.col("_estimate"))},
        position_chunks("msg_idx"),
    )
    return lowest.filter(F.col("_lowest") > F.col("target_tokens")).drop("_saved", "_estimate", "_lowest")


def reduction_candidates(
    messages: DataFrame, metadata: DataFrame, artifacts: DataFrame, pressure: DataFrame, hot: int, receipt_max: int
) -> DataFrame:
    """Cold, paired, archived results of triggered conversations whose receipt is smaller than their text."""
    # Message content stays where it is: everything the joins need of it is measured here.
    text = block_text("content")
    results = messages.filter(F.col("role") == "toolResult").filter(text.isNotNull() & ~is_receipt(text)).select(
        *MESSAGE,
        "tool_call_id",
        "is_error",
        byte_len(text).alias("text_bytes"),
        message_bytes().alias("bytes_before"),
        message_bytes(replace_text_blocks("content", F.lit(""))).alias("bytes_empty"),
    )
    triggered = pressure.filter("triggered").select(*SESSION, "total_bytes", "target_tokens")
    cold = (
        results.join(triggered, SESSION)
        .join(hot_set(messages, hot), SESSION)
        .filter(F.col("msg_idx") < F.col("hot_from"))
        .drop("hot_from")
    )
    known = lookup_by_call(paired_results(cold, messages), metadata).filter(F.col("artifact_id").isNotNull())
    stored = known.withColumnRenamed("archived_tool", "tool_name").join(
        artifacts.select("project_id", "artifact_id", F.col("content").alias("sanitized")),
        ["project_id", "artifact_id"],
    )
    with_receipt = receipt(stored, receipt_max).filter(byte_len("receipt") < F.col("text_bytes"))
    escaped_bytes = byte_len(F.to_json(F.array("receipt"))) - 4  # without brackets and quotes
    return with_receipt.select(
        *MESSAGE,
        "total_bytes",
        "target_tokens",
        "receipt",
        (F.col("bytes_before") - F.col("bytes_empty") - escaped_bytes).alias("saving"),
    )


def reduction_report(pressure: DataFrame, reduced: DataFrame) -> DataFrame:
    """Per conversation: triggered, target reached, replaced count, tokens before and after."""
    gains = reduced.groupBy(*SESSION).agg(
        F.count(F.lit(1)).alias("reduced_count"), F.sum("saving").alias("_saved")
    )
    after = token_estimate(F.col("total_bytes") - F.coalesce("_saved", F.lit(0)))
    return pressure.join(gains, SESSION, "left").select(
        *SESSION,
        "triggered",
        (after <= F.col("target_tokens")).alias("target_reached"),
        F.coalesce("reduced_count", F.lit(0)).cast("long").alias("reduced_count"),
        "tokens_before",
        after.alias("tokens_after"),
    )


def reduce_context(
    messages: DataFrame,
    metadata: DataFrame,
    artifacts: DataFrame,
    windows: DataFrame,
    soft: float = 0.75,
    target: float = 0.6,
    hot: int = 6,
    receipt_max: int = 4096,
) -> tuple[DataFrame, DataFrame]:
    """``(messages, report)``: order, count and envelope of the messages never change."""
    sizes = messages.select(*MESSAGE, message_bytes().alias("message_bytes"))
    pressure = context_pressure(sizes, windows, soft, target)
    # Ids, savings and receipts (bounded) are staged once: the decision below reads them several times.
    candidates = staged(reduction_candidates(messages, metadata, artifacts, pressure, hot, receipt_max))
    reduced = greedy_reduce(candidates.drop("receipt"))
    report = reduction_report(pressure, reduced)
    chosen = candidates.join(reduced.select(*MESSAGE), MESSAGE, "left_semi").select(*MESSAGE, "receipt")
    out = messages.join(chosen, MESSAGE, "left").withColumn(
        "content",
        F.when(F.col("receipt").isNotNull(), replace_text_blocks("content", F.col("receipt"))).otherwise(
            F.col("content")
        ),
    )
    return out.withColumn("reduced", F.col("receipt").isNotNull()).drop("receipt"), report
