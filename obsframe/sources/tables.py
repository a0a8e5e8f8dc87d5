"""Readers with fixed schemas and strict validation, and the content-addressed artifact sink."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..params import MAX_SAFE_INTEGER
from ..schemas import CHANGES, MESSAGES, METADATA

HASH = r"^[a-f0-9]{64}$"

# Field of a metadata record -> name in its JSON form.
_METADATA_JSON = {
    "artifact_id": "artifactId",
    "observation_id": "observationId",
    "tool_call_id": "toolCallId",
    "tool_name": "toolName",
    "session_id": "sessionId",
    "content_hash": "contentHash",
}
_METADATA_SIZES = {
    "original_bytes": "originalBytes",
    "sanitized_bytes": "sanitizedBytes",
    "redaction_count": "redactionCount",
}
_METADATA_TIMES = {"created_at": "createdAt", "updated_at": "updatedAt"}


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parquet at ``path``; a path that does not exist is an empty table."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def _kind(record: Column, name: str) -> Column:
    """JSON type of a field (STRING, BIGINT, DECIMAL(..), ...), null when absent."""
    return F.schema_of_variant(F.try_variant_get(record, f"$.{name}", "variant"))


def _string(record: Column, name: str) -> Column:
    return F.when(_kind(record, name) == "STRING", F.try_variant_get(record, f"$.{name}", "string"))


def parse_metadata(lines: DataFrame) -> DataFrame:
    """Parse JSON lines (column ``value``) into metadata columns plus ``reason`` (null when the record is valid)."""
    parsed = lines.filter(F.trim(F.regexp_replace("value", r"\s", "")) != "").withColumn(
        "_v", F.try_parse_json("value")
    )
    v = F.col("_v")
    columns = {f: _string(v, j) for f, j in _METADATA_JSON.items()}
    number = {f: F.try_variant_get(v, f"$.{j}", "decimal(38,4)") for f, j in _METADATA_SIZES.items()}
    for f, j in _METADATA_SIZES.items():
        numeric = _kind(v, j).rlike("^(?:BIGINT|DECIMAL|DOUBLE)")
        whole = (number[f] == F.floor(number[f])) & (F.abs(number[f]) <= MAX_SAFE_INTEGER)
        columns[f] = F.when(numeric & whole, number[f].cast("long"))
    columns |= {f: F.try_to_timestamp(_string(v, j)) for f, j in _METADATA_TIMES.items()}
    columns["schema_version"] = F.try_variant_get(v, "$.schemaVersion", "int")
    out = parsed.withColumns(columns)
    required = [F.col(c).isNotNull() for c in columns if c != "tool_call_id"]
    call_ok = F.col("tool_call_id").isNotNull() | _kind(v, "toolCallId").isNull()
    reason = (
        F.when(v.isNull(), "not JSON")
        .when(~F.coalesce(F.col("schema_version") == 1, F.lit(False)), "unsupported schema version")
        .when(~reduce(and_, required) | ~call_ok, "missing or mistyped field")
        .when(F.col("content_hash") != F.col("artifact_id"), "content hash differs from artifact id")
        .when(~F.col("artifact_id").rlike(HASH), "invalid artifact id")
    )
    return out.withColumn("reason", reason).drop("_v")


def read_metadata(spark: SparkSession, path: str, mode: str = "fail"):
    """Archive records from JSON lines.

    ``fail``: any bad record fails the read, naming its file and text.  ``quarantine``: ``(records, rejects)``.
    """
    try:
        lines = spark.read.text(path).withColumn("file", F.input_file_name())
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        lines = spark.createDataFrame([], "value string, file string")
    parsed = parse_metadata(lines)
    names = METADATA.fieldNames()
    if mode == "quarantine":
        return (
            parsed.filter(F.col("reason").isNull()).select(*names),
            parsed.filter(F.col("reason").isNotNull()).select("file", "value", "reason"),
        )
    if mode != "fail":
        raise ValueError("mode must be fail or quarantine")
    message = F.concat(
        F.lit("invalid metadata record in "), F.col("file"), F.lit(": "), F.col("reason"), F.lit(": "),
        F.substring("value", 1, 200),
    )
    checked = F.when(F.col("reason").isNull(), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return parsed.filter(checked).select(*names)


def metadata_json(metadata: DataFrame) -> DataFrame:
    """Metadata records as JSON lines (column ``value``); an absent call id is left out."""
    stamp = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
    fields = [F.lit(1).alias("schemaVersion")]
    fields += [F.col(f).alias(j) for f, j in {**_METADATA_JSON, **_METADATA_SIZES}.items()]
    fields += [F.date_format(f, stamp).alias(j) for f, j in _METADATA_TIMES.items()]
    return metadata.select(F.to_json(F.struct(*fields)).alias("value"))


def artifact_inventory(artifacts: DataFrame) -> DataFrame:
    """Id, size and modification time of stored artifacts; rows whose names are not hash shaped are ignored."""
    shaped = F.col("artifact_id").rlike(HASH) & (F.col("shard") == F.substring("artifact_id", 1, 2))
    return artifacts.filter(shaped).select("project_id", "artifact_id", "size", "modified_at")


ARTIFACTS = T.StructType(
    [
        T.StructField("artifact_id", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("modified_at", T.TimestampType()),
        T.StructField("project_id", T.StringType()),
        T.StructField("shard", T.StringType()),
        T.StructField("batch_id", T.LongType()),
    ]
)


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    return read_or_empty(spark, path, ARTIFACTS)


def write_artifacts(artifacts: DataFrame, path: str, batch_id: int) -> None:
    """Store artifacts whose hash is absent.

    Each batch owns its partition and replaces it when it runs again, so a repeated write changes nothing.
    Earlier batches are read for their ids only.  Files are sorted by project and hash: their statistics prune as well
    as a folder per shard would, without its hundreds of small files per batch.
    """
    spark = artifacts.sparkSession
    stored = read_artifacts(spark, path).filter(F.col("batch_id") != batch_id).select("project_id", "artifact_id")
    fresh = artifacts.join(stored, ["project_id", "artifact_id"], "left_anti").dropDuplicates(
        ["project_id", "artifact_id"]
    )
    (
        fresh.withColumn("batch_id", F.lit(batch_id).cast("long"))
        .select(*ARTIFACTS.fieldNames())
        .hint("rebalance", "project_id", "shard")
        .sortWithinPartitions("project_id", "artifact_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id")
        .parquet(path)
    )


# Files of more bytes are hashed in pieces of about this size: no row holds them.
PIECE_BYTES = 32 << 20
# Names by which a text reader would unpack a file.
_PACKED = r"(?i)\.(?:gz|bz2|deflate|snappy|lz4|lzo|xz|zst|zstd|passthrough)$"
_MARK = b"\xef\xbb\xbf"


def _pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Lines of a split, each with its end, in pieces of about ``most`` bytes."""
    names = ["path", "size", "start", "piece", "bytes"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    key, made, held, n = None, 0, [], 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*key, made, b"".join(held)), kinds, strict=True)], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        where = list(zip(*[batch.column(c).to_pylist() for c in ("path", "size", "start")], strict=True))
        edges = [0, *(i for i in range(1, len(where)) if where[i] != where[i - 1]), len(where)]
        lines = batch.column("line").to_pylist()
        for a, b in zip(edges, edges[1:]):
            if where[a] != key or n > most:
                if held:
                    yield row()
                made = made + 1 if where[a] == key else 0
                key, held, n = where[a], [], 0
            held += [b"\n".join(lines[a:b]), b"\n"]
            n += len(held[-2]) + 1
    if held:
        yield row()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each file whose pieces come in order.

    Whether the file ends with its last line end, and whether the reader has left out a byte order mark, follows from its size.
    """
    path, size, seen, last, sums = None, 0, 0, b"", ()

    def begun() -> tuple:
        return hashlib.sha256(), hashlib.sha256(_MARK)

    def row() -> pa.RecordBatch:
        for digest, lost in zip(sums, (0, len(_MARK)), strict=True):
            for end in (last, last[:-1]):
                if seen + len(end) + lost == size:
                    digest.update(end)
                    return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([digest.hexdigest()])], names=["file", "content_hash"])
        raise ValueError(f"{path}: {seen + len(last)} bytes read of {size}")

    for batch in batches:
        for i in range(batch.num_rows):
            at, of = batch.column("path")[i].as_py(), batch.column("size")[i].as_py()
            if at != path:
                if path is not None:
                    yield row()
                path, size, seen, last, sums = at, of, 0, b"", begun()
            for digest in sums:
                digest.update(last)
            seen += len(last)
            last = batch.column("bytes")[i].as_py()
    if path is not None:
        yield row()


def _hash_in_pieces(spark: SparkSession, root: str, over: int) -> DataFrame:
    """(file, content_hash) of the files below ``root`` with more than ``over`` bytes, which many tasks read as lines.

    A digest goes over a file in order: its pieces are sorted, on disk where they must be, and pass one task as a stream.
    """
    meta = F.col("_metadata")
    lines = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(root)
    split = lines.filter((meta["file_size"] > over) & ~meta["file_path"].rlike(_PACKED)).select(
        meta["file_path"].alias("path"), meta["file_size"].alias("size"), meta["file_block_start"].alias("start"),
        F.col("value").cast("binary").alias("line"),
    )
    pieces = split.mapInArrow(
        lambda batches: _pieces(batches, PIECE_BYTES >> 4), "path string, size long, start long, piece long, bytes binary"
    )
    ordered = pieces.repartition("path").sortWithinPartitions("path", "start", "piece")
    return ordered.mapInArrow(_hashed, "file string, content_hash string")


def read_corpus(spark: SparkSession, root: str, project_id: str, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Files below ``root`` as (project_id, path, content, size_bytes, modified_at, content_hash), paths relative with ``/``.

    ``content`` is read only where it is asked for, and a row can hold 2 GB of it; ``content_hash`` is there for files of any
    size.  Those of more than ``piece_bytes`` are hashed in pieces, but for names that a text reader would unpack.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = "/" + root.split("://")[-1].strip("/") + "/"
    plain = F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "^[a-z0-9]+:/+", "/")
    # Conditions on metadata leave files out before anything of them is read.
    in_pieces = (F.col("_metadata.file_size") > piece_bytes) & ~F.col("_metadata.file_path").rlike(_PACKED)

    def shown(df: DataFrame, content_hash: Column) -> DataFrame:
        return df.select(
            F.lit(project_id).alias("project_id"),
            plain.substr(F.lit(len(base) + 1), F.length(plain)).alias("path"),
            "content",
            F.col("length").alias("size_bytes"),
            F.col("modificationTime").alias("modified_at"),
            content_hash.alias("content_hash"),
        )

    whole = shown(files.filter(~in_pieces), F.sha2("content", 256))
    named = files.filter(in_pieces).withColumn("_at", F.col("_metadata.file_path"))
    large = named.join(_hash_in_pieces(spark, root, piece_bytes), F.col("_at") == F.col("file"))
    return whole.unionByName(shown(large, F.col("content_hash")))


def read_messages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(MESSAGES).format(fmt).load(path)


def read_changes(spark: SparkSession, path: str, max_files: int = 64) -> DataFrame:
    """Stream of change events; ``max_files`` bounds what one trigger takes, the rest stays pending."""
    return spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", max_files).parquet(path)
