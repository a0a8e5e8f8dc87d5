"""Versioned snapshots: data first, pointer last, readers follow the pointer only."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.retention import generation_report, prune_generations
from ..plans.workspace import Workspace
from ..schemas import (
    DIRTY,
    FILE_KINDS,
    FILES,
    FRESHNESS,
    GENERATIONS,
    LANGUAGES,
    PENDING,
    POINTERS,
    SCHEMA_VERSION,
    SYMBOL_KINDS,
    WARNING_CODES,
    WARNINGS,
)
from ..session import staged, stored
from .tables import HASH, read_or_empty

GENERATOR = "obsframe"
GENERATOR_VERSION = "0.1.0"
TABLES = {"files": FILES, "warnings": WARNINGS, "dirty": DIRTY, "pending": PENDING}
KEY = ["project_id", "generation"]


def _missing(array: str, *fields: str) -> Column:
    return F.exists(array, lambda x: reduce(or_, [x[f].isNull() for f in fields]))


def invalid_file(row: str = "") -> Column:
    """True for a file record that breaks the schema contract."""
    symbols = F.exists(
        "symbols",
        lambda s: s["name"].isNull()
        | s["signature"].isNull()
        | s["exported"].isNull()
        | ~F.coalesce(s["kind"].isin(*SYMBOL_KINDS), F.lit(False))
        | ~F.coalesce(s["line"] > 0, F.lit(False)),
    )
    checks = [
        F.col("path").isNull(),
        ~F.coalesce(F.col("kind").isin(*FILE_KINDS), F.lit(False)),
        ~F.coalesce(F.col("language").isin(*LANGUAGES), F.lit(False)),
        ~F.coalesce(F.col("content_hash").rlike(HASH), F.lit(False)),
        ~F.coalesce(F.col("size_bytes") >= 0, F.lit(False)),
        F.col("lexical_terms").isNull(),
        F.col("dependencies").isNull(),
        F.coalesce(_missing("imports", "source", "names", "type_only"), F.lit(True)),
        F.coalesce(_missing("exports", "name", "type_only"), F.lit(True)),
        F.coalesce(symbols, F.lit(True)),
    ]
    return reduce(or_, checks)


def invalid_generation() -> Column:
    valid = [
        F.col("schema_version") == SCHEMA_VERSION,
        F.col("generation") > 0,
        F.col("head").isNotNull(),
        F.col("workspace_revision").rlike(HASH),
        F.col("freshness").isin(*FRESHNESS),
        F.col("generator") == GENERATOR,
        F.col("generator_version") == GENERATOR_VERSION,
        F.col("generated_at").isNotNull(),
    ]
    return ~F.coalesce(reduce(and_, valid), F.lit(False))


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return read_or_empty(spark, f"{root}/{name}", TABLES[name])


def read_generations(spark: SparkSession, root: str) -> DataFrame:
    return read_or_empty(spark, f"{root}/generations", GENERATIONS)


def read_pointers(spark: SparkSession, root: str) -> DataFrame:
    """Newest well-formed pointer of each project."""
    rows = read_or_empty(spark, f"{root}/pointers", POINTERS)
    newest = rows.groupBy("project_id").agg(
        F.max_by(F.struct("generation", "path", "activated_at"), F.struct("activated_at", "generation")).alias("_p")
    ).select("project_id", "_p.*")
    formed = (F.col("generation") > 0) & (F.col("path") == F.concat(F.lit("generations/"), F.col("generation").cast("string")))
    return newest.filter(F.coalesce(formed, F.lit(False)))


def invalid_generations(spark: SparkSession, root: str, keys: DataFrame) -> DataFrame:
    """Those of ``keys`` (project_id, generation) with any violation: one bad row rejects the generation as a whole.

    The keys join on the partition columns, so only their partitions are read.
    """
    dirty_bad = F.col("path").isNull() | ~F.coalesce(
        F.col("content_hash").rlike(HASH) | (F.col("content_hash") == "deleted"), F.lit(False)
    )
    warning_bad = (
        F.col("path").isNull() | F.col("message").isNull() | ~F.coalesce(F.col("code").isin(*WARNING_CODES), F.lit(False))
    )
    checks = [
        (read_table(spark, root, "files"), invalid_file()),
        (read_table(spark, root, "warnings"), warning_bad),
        (read_table(spark, root, "dirty"), dirty_bad),
        (read_table(spark, root, "pending"), F.col("path").isNull()),
        (read_generations(spark, root), invalid_generation()),
    ]
    found = [df.join(keys, KEY, "left_semi").filter(bad).select(*KEY) for df, bad in checks]
    return reduce(DataFrame.unionByName, found).distinct()


def read_snapshot(spark: SparkSession, root: str, project_id: str, generation: int) -> dict[str, DataFrame]:
    """One generation of one project; raises when it is missing or any part of it is invalid."""
    here = (F.col("project_id") == project_id) & (F.col("generation") == generation)
    ledger = read_generations(spark, root).filter(here)
    if ledger.isEmpty() or not invalid_generations(spark, root, ledger.select(*KEY)).isEmpty():
        raise ValueError(f"unsupported or invalid snapshot: {project_id} generation {generation}")
    return {"generation": ledger, **{n: read_table(spark, root, n).filter(here) for n in TABLES}}


def read_active(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The active generation of every project that has a valid one.

    Pointers and valid ledger rows (one per project) are staged and join on the partition columns, so only active
    partitions are scanned.
    """
    pointed = staged(read_pointers(spark, root).select(*KEY))
    ledger = read_generations(spark, root).join(pointed, KEY, "left_semi")
    valid = staged(ledger.join(invalid_generations(spark, root, pointed), KEY, "left_anti"))
    keys = valid.select(*KEY)
    return {"generation": valid, **{n: read_table(spark, root, n).join(keys, KEY, "left_semi") for n in TABLES}}


def hydrate(spark: SparkSession, root: str, projects: DataFrame) -> DataFrame:
    """State to start from: the last valid generation of a project, else empty and stale."""
    active = read_active(spark, root)["generation"].select("project_id", "generation", "head", "workspace_revision", "freshness")
    return projects.select("project_id").distinct().join(active, "project_id", "left").select(
        "project_id",
        F.coalesce("generation", F.lit(0)).alias("generation"),
        F.coalesce("head", F.lit("no-head")).alias("head"),
        "workspace_revision",
        F.coalesce("freshness", F.lit("stale")).alias("freshness"),
    )


def _content_hash(df: DataFrame, columns: list[str]) -> DataFrame:
    """Order-free digest of a table per project: count, two independent sums and an exclusive or, all map-side combined."""
    row = F.sha2(F.to_json(F.struct(*columns)), 256)

    def part(start: int) -> Column:
        return F.conv(F.substring(row, start, 15), 16, 10).cast("decimal(38,0)")

    return df.groupBy("project_id").agg(
        F.concat_ws(
            ":",
            F.count(F.lit(1)).cast("string"),
            F.sum(part(1)).cast("string"),
            F.sum(part(16)).cast("string"),
            F.bit_xor(F.xxhash64(row)).cast("string"),
        ).alias("digest")
    )


def _parts(workspace: Workspace) -> dict[str, DataFrame]:
    return {
        "files": workspace.files.select(*[c for c in FILES.fieldNames() if c != "generation"]),
        "warnings": workspace.warnings.select("project_id", "path", "code", "message"),
        "dirty": workspace.dirty.select("project_id", "path", "content_hash"),
        "pending": workspace.pending.select("project_id", "path").distinct(),
    }


def semantic_hashes(workspace: Workspace, heads: DataFrame) -> DataFrame:
    """Digest per project of everything durable: not the number, not the times."""
    out = heads.select("project_id", "head").join(workspace.revision, "project_id").join(workspace.freshness, "project_id")
    names = []
    for name, df in _parts(workspace).items():
        columns = [c for c in df.columns if c != "project_id"]
        out = out.join(_content_hash(df, columns).withColumnRenamed("digest", f"_{name}"), "project_id", "left")
        names.append(F.coalesce(f"_{name}", F.lit("")))
    return out.select(
        "project_id",
        "head",
        "workspace_revision",
        "freshness",
        F.sha2(F.concat_ws("|", "head", "workspace_revision", "freshness", *names), 256).alias("semantic_hash"),
    )


def _write(df: DataFrame, path: str) -> None:
    (
        df.hint("rebalance", *KEY)  # few files per partition; a partition of a hot project is split at run time
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*KEY)
        .parquet(path)
    )


def publish_generation(workspace: Workspace, heads: DataFrame, root: str, now: Column) -> DataFrame:
    """Publish the state of all projects; returns (project_id, generation) of what became active.

    A project equal to its active generation is left alone.  The ledger row comes first and claims the number, then
    the data, and the pointer row last: until then nobody can see the generation, and the number of a failed attempt
    is never used again.
    """
    spark = heads.sparkSession
    ledger = read_generations(spark, root)
    active = ledger.join(read_pointers(spark, root).select(*KEY), KEY, "left_semi").select(
        "project_id", F.col("semantic_hash").alias("_active")
    )
    known = ledger.groupBy("project_id").agg(F.max("generation").alias("_known"))
    # Stored with their size: few projects are sent to the tables, which then stay where they are.
    chosen = stored(
        semantic_hashes(workspace, heads)
        .join(active, "project_id", "left")
        .filter(F.col("_active").isNull() | (F.col("_active") != F.col("semantic_hash")))
        .join(known, "project_id", "left")
        .withColumn("generation", (F.coalesce("_known", F.lit(0)) + 1).cast("long"))
        .drop("_active", "_known")
    )
    if chosen.isEmpty():
        return chosen.select(*KEY)
    numbers = chosen.select(*KEY)
    parts = {name: df.join(numbers, "project_id") for name, df in _parts(workspace).items()}
    # A row's JSON with its generation, without writing the number into every row.
    plain = F.octet_length(F.to_json(F.struct("*"))) + F.length(F.lit(',"generation":'))
    measured = _parts(workspace)["files"].groupBy("project_id").agg(F.sum(plain).alias("_plain"), F.count(F.lit(1)).alias("_rows"))
    sizes = measured.join(numbers, "project_id").select(
        "project_id", (F.col("_plain") + F.col("_rows") * F.length(F.col("generation").cast("string"))).alias("bytes")
    )
    rows = chosen.join(sizes, "project_id", "left").select(
        "project_id",
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        "head",
        "workspace_revision",
        "freshness",
        "semantic_hash",
        F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"),
        F.lit(GENERATOR).alias("generator"),
        F.lit(GENERATOR_VERSION).alias("generator_version"),
        now.alias("generated_at"),
        "generation",
    )
    _write(rows, f"{root}/generations")
    for name, df in parts.items():
        _write(df, f"{root}/{name}")
    numbers.select(
        *KEY, F.concat(F.lit("generations/"), F.col("generation").cast("string")).alias("path"), now.alias("activated_at")
    ).write.mode("append").parquet(f"{root}/pointers")
    return numbers


def generation_ledger(spark: SparkSession, root: str) -> DataFrame:
    """Ledger for pruning: every generation with its size, whether it is active and, if so, whether it is valid."""
    pointed = staged(read_pointers(spark, root).select(*KEY))
    active = pointed.withColumn("is_active", F.lit(True))
    invalid = invalid_generations(spark, root, pointed).withColumn("_bad", F.lit(True))
    return (
        read_generations(spark, root)
        .join(active, KEY, "left")
        .join(invalid, KEY, "left")
        .select(
            *KEY, "bytes", F.coalesce("is_active", F.lit(False)).alias("is_active"), F.col("_bad").isNull().alias("is_valid")
        )
    )


def prune(spark: SparkSession, root: str, retention: int, quota: int) -> DataFrame:
    """Delete surplus generations below the active one and report per project.

    Deleting a partition is a file-system call of the driver, as for any dropped partition; the list is streamed.
    """
    decisions = staged(prune_generations(generation_ledger(spark, root), retention, quota))
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for row in decisions.filter("deleted").select(*KEY).toLocalIterator():
        for name in ("generations", *TABLES):
            escaped = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(row["project_id"])
            target = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/project_id={escaped}/generation={row['generation']}")
            target.getFileSystem(conf).delete(target, True)
    return generation_report(decisions, quota)
