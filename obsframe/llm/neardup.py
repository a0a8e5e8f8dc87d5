"""Near-duplicate groups by HyperMinHash registers, banding, corrected estimates and exact confirmation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsframe.llm.components import components
from obsframe.llm.shingles import WordIds, shingle_set
from obsframe.session import discard, scratch, staged

# Parts of the rows of one hub where they meet its sizes.
_SALTS = 64


@dataclass(frozen=True)
class NearDupParams:
    """252 registers in 42 bands of 6: a pair at similarity 0.8 shares no band with probability 3e-6.

    ``slack`` is how far below the threshold an estimate may lie before the pair is left unconfirmed: five standard
    deviations of the estimate at 0.8.  Components of ``hub_size`` classes or more are compared in blocks of
    ``block_rows`` with what lies around them; this decides the way of a comparison, not whether it is made.
    """

    words: int = 2
    percent: int = 80
    bands: int = 42
    rows: int = 6
    mantissa_bits: int = 10
    slack: float = 0.13
    hub_size: int = 8
    block_rows: int = 512

    @property
    def registers(self) -> int:
        return self.bands * self.rows


def _multipliers(m: int) -> np.ndarray:
    """Odd 32-bit multipliers, one for each register, from a fixed seed."""
    return np.random.Generator(np.random.PCG64(20240131)).integers(0, 2**31, m, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def registers(shingles: np.ndarray, multipliers: np.ndarray, mantissa_bits: int) -> np.ndarray:
    """For each bucket's hash, the smallest value over the set: leading zeros above ``mantissa_bits`` bits after them."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(multipliers), np.uint32(0xFFFFFFFF))
    for i in range(0, len(x), 1024):
        np.minimum(low, (x[i : i + 1024, None] * multipliers).min(axis=0), out=low)
    # The exponent of the exact double gives the leading zeros, its upper mantissa the bits that follow the first one.
    bits = np.maximum(low, 1).astype(np.float64).view(np.uint64)
    zeros = np.uint64(1023 + 31) - (bits >> np.uint64(52))
    mantissa = (bits >> np.uint64(52 - mantissa_bits)) & np.uint64((1 << mantissa_bits) - 1)
    return ((zeros << np.uint64(mantissa_bits)) | mantissa).astype(np.uint16)


def band_keys(sketches: np.ndarray, p: NearDupParams) -> np.ndarray:
    """(documents, registers) to (documents, bands): a 64-bit key for the registers of each band."""
    h = np.broadcast_to(np.arange(1, p.bands + 1, dtype=np.uint64), (len(sketches), p.bands)).copy()
    parts = sketches.reshape(len(sketches), p.bands, p.rows).astype(np.uint64)
    for i in range(p.rows):
        h = (h ^ parts[:, :, i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, mantissa_bits: int) -> np.ndarray:
    """Jaccard estimates of register rows: the share of equal registers, less the chance that unlike minima agree.

    Minima of independent sets fall in one cell of relative width 2**-mantissa_bits with probability
    na*nb/(na+nb)**2 / (2 ln 2) * 2**-mantissa_bits.
    """
    equal = (a == b).mean(axis=1)
    chance = na * nb / (na + nb) ** 2 * 0.7213475 / (1 << mantissa_bits)
    return (equal - chance) / (1 - chance)


def _sketch_batches(p: NearDupParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, multipliers = WordIds(), _multipliers(p.registers)
        for batch in batches:
            n, digest, sketch = [], [], []
            for text in batch.column("text"):
                s = shingle_set(text.as_py(), p.words, ids)
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sketch.append(registers(s, multipliers, p.mantissa_bits).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sketch, pa.binary())],
                names=["doc_id", "text_hash", "n_shingles", "digest", "sketch"],
            )

    return run


def sketch(docs: DataFrame, p: NearDupParams) -> DataFrame:
    """doc_id, n_shingles, digest of the whole set (null: empty set) and compressed registers of every document."""
    text = F.col("text").cast("binary")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return source.mapInArrow(_sketch_batches(p), "doc_id long, text_hash long, n_shingles long, digest binary, sketch binary")


def _band_batches(p: NearDupParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), dtype=np.uint16)
            keys = band_keys(rows.reshape(batch.num_rows, p.registers), p)
            cid = np.repeat(batch.column("cid").to_numpy(zero_copy_only=False), p.bands)
            for i in range(0, len(cid), 1 << 18):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel()[i : i + (1 << 18)]), pa.array(cid[i : i + (1 << 18)])], names=["key", "cid"]
                )

    return run


def _estimate_batches(p: NearDupParams):
    least = p.percent / 100 - p.slack

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(batch.num_rows, -1)
                for c in ("sketch_a", "sketch_b")
            )
            na, nb = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("n_a", "n_b"))
            # Sizes alone rule out what cannot reach the threshold.
            near = (estimate(a, b, na, nb, p.mantissa_bits) >= least) & (100 * np.minimum(na, nb) >= p.percent * np.maximum(na, nb))
            yield batch.select(["a", "b"]).filter(pa.array(near))

    return run


def _confirm_batches(p: NearDupParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, last, own = WordIds(), None, None
        for batch in batches:
            keep = []
            for a, text_a, text_b in zip(*(batch.column(c) for c in ("a", "text_a", "text_b")), strict=True):
                if a.as_py() != last:
                    last, own = a.as_py(), shingle_set(text_a.as_py(), p.words, ids)
                other = shingle_set(text_b.as_py(), p.words, ids)
                both = len(np.intersect1d(own, other, assume_unique=True))
                keep.append(100 * both >= p.percent * (len(own) + len(other) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _block_links(p: NearDupParams):
    least = p.percent / 100 - p.slack

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """Links between the left block and the members of other components in the right one."""
        ids, multipliers, out = WordIds(), _multipliers(p.registers), []

        def sets(table: pa.Table):
            return [shingle_set(t, p.words, ids) for t in table.column("text").to_pylist()]

        if left.num_rows and right.num_rows:
            xs, ys = sets(left), sets(right)
            sketches = np.array([registers(y, multipliers, p.mantissa_bits) for y in ys])
            sizes = np.array([len(y) for y in ys], dtype=float)
            cid, component = (right.column(c).to_numpy() for c in ("cid", "component"))
            merged: set[tuple[int, int]] = set()
            for x, a, own in zip(xs, left.column("cid").to_pylist(), left.column("component").to_pylist(), strict=True):
                n = float(len(x))
                near = estimate(registers(x, multipliers, p.mantissa_bits)[None], sketches, n, sizes, p.mantissa_bits) >= least
                near &= (100 * np.minimum(n, sizes) >= p.percent * np.maximum(n, sizes)) & (component != own)
                for j in np.flatnonzero(near).tolist():
                    # Of two components one link is enough.
                    if (own, int(component[j])) in merged:
                        continue
                    both = len(np.intersect1d(x, ys[j], assume_unique=True))
                    if 100 * both >= p.percent * (len(x) + len(ys[j]) - both):
                        merged.add((own, int(component[j])))
                        out.append((a, int(cid[j])))
        return pa.table({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64())})

    return run


def _members(met: DataFrame, classes: DataFrame, docs: DataFrame, path: str) -> DataFrame:
    """cid, n_shingles, sketch, text of the classes that share a bucket: written once to ``path``, read by every comparison.

    A class is fetched by the id and the hash of the text of one of its documents.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("binary")
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64(text).alias("_hash"), text.alias("text"))
    named = classes.join(met.select("cid").distinct(), "cid")
    match = F.col("_id").eqNullSafe(F.col("rep.doc_id")) & (F.col("_hash") == F.col("rep.text_hash"))
    texts.join(named, match).select("cid", "n_shingles", "sketch", "text").write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def _links(pairs: DataFrame, members: DataFrame, p: NearDupParams) -> DataFrame:
    """The pairs (a, b) of classes that reach the threshold: estimated on registers, then confirmed on full sets."""
    side = lambda x: members.select(
        F.col("cid").alias(x), F.col("sketch").alias(f"sketch_{x}"), F.col("n_shingles").alias(f"n_{x}")
    )
    likely = staged(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_estimate_batches(p), "a long, b long"))
    of = lambda x: members.select(F.col("cid").alias(x), F.col("text").alias(f"text_{x}"))
    return staged(likely.join(of("b"), "b").join(of("a"), "a").mapInArrow(_confirm_batches(p), "a long, b long"))


def _around_hubs(open_rows: DataFrame, hubs: DataFrame, groups: DataFrame, members: DataFrame, p: NearDupParams) -> DataFrame:
    """Links of components (component, hub) with the members of their hub and with each other, block against block.

    Pairs are made and tested inside a task; only links leave it.  A block holds about ``block_rows`` classes on each side.
    """
    around = open_rows.select("cid", "component").distinct().join(hubs.filter("component <> hub"), "component")
    inside = groups.select(F.col("id").alias("cid"), F.col("component")).join(
        around.select(F.col("hub").alias("component")).distinct(), "component"
    )
    left = around.select("hub", "cid", "component")
    right = left.union(inside.select(F.col("component").alias("hub"), "cid", "component"))
    sizes = left.groupBy("hub").agg(F.ceil(F.count("*") / p.block_rows).cast("int").alias("_l")).join(
        right.groupBy("hub").agg(F.ceil(F.count("*") / p.block_rows).cast("int").alias("_r")), "hub"
    )
    # A hub may hold most rows, so they meet its sizes under a salt.
    salted = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    salt = F.pmod(F.hash("cid"), F.lit(_SALTS))
    checked = lambda df: df.withColumn("salt", salt).join(salted, ["hub", "salt"]).join(members.select("cid", "text"), "cid")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))
    a = checked(left).withColumn("l", F.pmod(F.xxhash64("cid"), F.col("_l"))).withColumn("r", every("_r"))
    b = checked(right).withColumn("r", F.pmod(F.xxhash64("cid"), F.col("_r"))).withColumn("l", every("_l"))
    # Aliases make the columns of both sides different ones.
    names = ("hub", "l", "r", "cid", "component", "text")
    cut = lambda df: df.select(*[F.col(n).alias(n) for n in names]).groupBy("hub", "l", "r")
    return staged(cut(a).cogroup(cut(b)).applyInArrow(_block_links(p), "a long, b long").distinct())


def near_duplicates(docs: DataFrame, p: NearDupParams = NearDupParams()) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, text_hash (xxhash64), n_shingles, component_id, kept.

    * Documents with equal shingle sets are one class before any pair is looked at, so copies cost one row each.
    * Classes that share a band meet the smallest and the largest class of that bucket, not each other.
    * After the components of those links, members of a bucket that are still in different components meet each other:
      no link that could join two components is lost.  Members of one component never meet.  What lies around a large
      component meets it in blocks, inside tasks; other pairs are rows.
    * Text null or without words: n_shingles 0, linked with nothing, component_id = doc_id.
    * Repeated rows are each returned.  A null doc_id is never a component's id unless all its ids are null.
    """
    sketches = staged(sketch(docs, p))
    classes = staged(
        sketches.filter("n_shingles > 0")
        .groupBy("digest")
        .agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("rep"),
            F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"),
        )
        .withColumn("cid", F.monotonically_increasing_id())
    )
    bands = classes.select("cid", "sketch").mapInArrow(_band_batches(p), "key long, cid long")
    ends = bands.groupBy("key").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi")).filter("lo < hi")
    met = staged(bands.join(ends, "key"))
    folder = scratch(docs.sparkSession)
    members = _members(met, classes, docs, folder)
    stars = (
        met.filter("cid > lo").select(F.col("lo").alias("a"), F.col("cid").alias("b"))
        .union(met.filter("cid > lo and cid < hi").select("cid", "hi"))
        .distinct()
    )
    first = _links(stars, members, p)
    groups = staged(components(first))
    # Buckets that still hold several components: all pairs across components meet, around a hub or one by one.
    labelled = met.join(groups.withColumnRenamed("id", "cid"), "cid", "left").select(
        "key", "cid", F.coalesce("component", "cid").alias("component")
    )
    open_keys = labelled.groupBy("key").agg(F.min("component").alias("_c"), F.max("component").alias("_d")).filter("_c < _d").select("key")
    rows = staged(labelled.join(open_keys, "key", "left_semi"))
    sizes = groups.groupBy("component").agg(F.count("*").alias("_n"))
    sized = rows.select("key", "component").distinct().join(sizes, "component", "left")
    tops = sized.groupBy("key").agg(F.max(F.struct(F.coalesce("_n", F.lit(1)).alias("n"), "component")).alias("top"))
    # The largest component that a component shares a bucket with.
    hubs = staged(
        sized.join(tops, "key").groupBy("component").agg(F.max("top").alias("top"))
        .filter(F.col("top.n") >= p.hub_size).select("component", F.col("top.component").alias("hub"))
    )
    second = _around_hubs(rows, hubs, groups, members, p)
    named = rows.join(hubs, "component", "left").select("key", "cid", "component", F.coalesce("hub", -F.col("component") - 1).alias("hub"))
    left = named.select("key", F.col("cid").alias("a"), F.col("component").alias("_ca"), F.col("hub").alias("_ha"))
    right = named.select("key", F.col("cid").alias("b"), F.col("component").alias("_cb"), F.col("hub").alias("_hb"))
    across = left.join(right, "key").filter("a < b and _ca <> _cb and _ha <> _hb and _ha <> _cb and _hb <> _ca")
    third = _links(across.select("a", "b").distinct(), members, p)
    discard(docs.sparkSession, folder)
    groups = staged(components(first.union(second).union(third)))
    ids = (
        classes.select("cid", "digest", "rep")
        .join(groups.withColumnRenamed("id", "cid"), "cid", "left")
        .withColumn("component", F.coalesce("component", "cid"))
    )
    least = ids.groupBy("component").agg(F.min("rep.doc_id").alias("component_id"))
    by_digest = ids.join(least, "component").select("digest", "component_id")
    out = sketches.select("doc_id", "text_hash", "n_shingles", "digest").join(by_digest, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def keep_one(docs: DataFrame, p: NearDupParams = NearDupParams()) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, the smallest doc_id; rows without words all stay.

    Rows that repeat a kept doc_id and its text are one document; their first row stays.
    """
    flags = staged(near_duplicates(docs.select("doc_id", "text"), p))
    key = lambda df: df.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_doc"), F.xxhash64(F.col("text").cast("binary")).alias("_text"))
    match = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash"))
    # Only what goes is looked up, the smaller part as a rule; its join is an equi-join that Spark may broadcast by size.
    out = rows.join(key(flags.filter("not kept")).distinct(), match, "left_anti")
    counted = flags.filter("kept and n_shingles > 0").groupBy("doc_id", "text_hash").agg(F.count("*").alias("_n"))
    repeated = staged(key(counted.filter("_n > 1")))
    if not repeated.isEmpty():
        out = out.join(repeated, match, "left_anti").unionByName(out.join(repeated, match, "left_semi").dropDuplicates(["_doc", "_text"]))
    return out.select("_row.*")
