"""Removal of byte strings that repeat anywhere in a collection of texts, by column-wise sorting of aligned windows.

Every window of ``length`` bytes has an anchor, the least hash among its ``gram``-byte pieces, which the window's bytes alone
decide, so equal windows are aligned at equal anchors.  A cell is a run of neighbouring windows with one anchor, in one half
of the window.  Cells meet by a hash of the bytes that all windows of that half share (the core), as small rows; a cell whose
whole stretch stands elsewhere is settled by that.  Only cells with the core of another but a stretch of their own, those at
the edges of repeats, have their bytes fetched and sorted column by column (:mod:`columns`), one symbol of each a round.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsframe.llm.columns import repeated_starts
from obsframe.session import discard, scratch, staged

_CHUNK_BITS = 20
_CELLS = "doc binary, anchor int, low int, high int, core long, span_a long, span_b long"
_RANGES = "doc binary, low int, high int"
_WINDOWS = "doc binary, start int, window_a long, window_b long"
_RUNS = T.ArrayType(T.StructType().add("start", "integer").add("end", "integer"))
_LOW_WORD = (1 << 64) - 1
_SHARES = 1024  # a key of more than this part of all rows is cut into pieces


@dataclass(frozen=True)
class RepeatParams:
    """``group_rows``: a larger group of cells with one core is dealt out by whole windows instead of sorted in one task."""

    length: int = 400
    gram: int = 16
    group_rows: int = 4096
    batch_rows: int = 4096

    def __post_init__(self):
        if self.gram < 16 or self.length < 2 * self.gram or self.length > 1 << 16 or min(self.group_rows, self.batch_rows) < 2:
            raise ValueError("gram is 16 or more, length at least twice gram and at most 65536, group_rows and batch_rows 2 or more")


def text_key(text: Column) -> Column:
    """128 bits that name a text."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit mix of the ``gram`` bytes at each position."""
    words = np.ndarray((len(data) - 7,), np.uint64, data, strides=(1,)).copy()
    n = len(data) - gram + 1
    out = words[:n] * np.uint64(0x9E3779B97F4A7C15)
    for at in [*range(8, gram - 7, 8), *([gram - 8] if gram % 8 else [])]:
        out ^= out >> np.uint64(29)
        out += words[at : at + n]
        out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    out *= np.uint64(0x94D049BB133111EB)
    return out


def _anchors(data: np.ndarray, p: RepeatParams) -> np.ndarray:
    """For each window of ``data`` (less than 2^20 bytes) the position of its least hash, the last one of equal ones."""
    hashes = _gram_hashes(data, p.gram)
    mask = np.uint64((1 << _CHUNK_BITS) - 1)
    hashes &= ~mask
    hashes |= mask - np.arange(len(hashes), dtype=np.uint64)
    width, n = p.length - p.gram + 1, len(data) - p.length + 1
    rows = -(-len(hashes) // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(hashes)] = hashes
    blocks = padded.reshape(rows, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(after[:n], before[width - 1 : width - 1 + n])
    return (mask - (least & mask)).astype(np.int64)


def _pieces(offsets: np.ndarray, p: RepeatParams) -> Iterator[tuple[int, int, int, int]]:
    """(first byte, end, first text, last text + 1): runs of whole texts, or overlapping parts of one long text."""
    most, i, n = (1 << _CHUNK_BITS) - 1, 0, len(offsets) - 1
    while i < n:
        start = int(offsets[i])
        if offsets[i + 1] - start > most:
            step = most - p.length + 1
            for at in range(start, int(offsets[i + 1]) - p.length + 1, step):
                yield at, min(at + most, int(offsets[i + 1])), i, i + 1
            i += 1
            continue
        j = int(np.searchsorted(offsets, start + most, side="right")) - 1
        yield start, int(offsets[j]), i, j
        i = j


def _cells(data: np.ndarray, offsets: np.ndarray, p: RepeatParams) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, anchor, low, high, half) of the cells of each piece, positions in ``data``; high is included."""
    half = (p.length - p.gram) // 2
    for start, end, i, j in _pieces(offsets, p):
        if end - start < p.length:
            continue
        anchor = _anchors(data[start:end], p) + start
        at = np.arange(start, end - p.length + 1)
        text = np.searchsorted(offsets[i + 1 : j + 1], at, side="right") + i if j - i > 1 else np.full(len(at), i)
        whole = np.flatnonzero(at + p.length <= offsets[text + 1])
        if not len(whole):
            continue
        at, text, anchor = at[whole], text[whole], anchor[whole]
        left = anchor - at > half
        new = np.ones(len(at), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (left[1:] != left[:-1])
        low = np.flatnonzero(new)
        high = np.append(low[1:], len(at)) - 1
        yield text[low], anchor[low], at[low], at[high], left[low]


def _cell_batches(p: RepeatParams, whole: bool):
    """Rows of cells; without ``whole`` their cores alone."""
    half, far = (p.length - p.gram) // 2, p.length - p.gram
    # All windows of the left half hold the bytes from anchor - half - 1, those of the right half up to anchor + length - half.
    cores = {True: (-half - 1, p.length - far), False: (0, p.length - half)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            offsets = np.frombuffer(column.buffers()[1], np.int32 if pa.types.is_binary(column.type) else np.int64)
            offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
            buffer = column.buffers()[2]
            if buffer is None:
                continue
            data, view, docs = np.frombuffer(buffer, np.uint8), memoryview(buffer), batch.column("doc")
            for text, anchor, low, high, left in _cells(data, offsets, p):
                core = [
                    xxhash.xxh3_64_intdigest(view[a + cores[x][0] : a + cores[x][1]], x) for a, x in zip(anchor.tolist(), left.tolist(), strict=True)
                ]
                arrays = [pa.array(np.array(core, np.uint64).view(np.int64))]
                if whole:
                    spans = [
                        xxhash.xxh3_128_intdigest(view[a : b + p.length], c - a)
                        for a, b, c in zip(low.tolist(), high.tolist(), anchor.tolist(), strict=True)
                    ]
                    base = offsets[text]
                    arrays = [
                        docs.take(pa.array(text)).cast(pa.binary()),
                        *[pa.array((x - base).astype(np.int32)) for x in (anchor, low, high)],
                        *arrays,
                        pa.array(np.array([x & _LOW_WORD for x in spans], np.uint64).view(np.int64)),
                        pa.array(np.array([x >> 64 for x in spans], np.uint64).view(np.int64)),
                    ]
                yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in _CELLS.split(", ")] if whole else ["core"])

    return run


def _ranges(doc: list[bytes], starts: list[np.ndarray]) -> pa.RecordBatch:
    """Rows (doc, low, high) of the runs of consecutive starts."""
    docs, lows, highs = [], [], []
    for d, s in zip(doc, starts, strict=True):
        if len(s):
            cut = np.flatnonzero(np.diff(s) > 1)
            lows += s[np.append(0, cut + 1)].tolist()
            highs += s[np.append(cut, len(s) - 1)].tolist()
            docs += [d] * (len(cut) + 1)
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.binary()), pa.array(lows, pa.int32()), pa.array(highs, pa.int32())], names=["doc", "low", "high"])


def _sorted_groups(p: RepeatParams):
    """Sort the cells of whole groups together, some thousand at a time; rows come sorted by core."""

    def solve(rows: list[dict]) -> pa.RecordBatch:
        starts = np.array([r["low"] - r["anchor"] for r in rows])
        groups = np.unique([r["core"] for r in rows], return_inverse=True)[1]
        found = repeated_starts([r["bytes"] for r in rows], starts, groups, p.length)
        open_rows = [i for i, r in enumerate(rows) if r["n"] == 1]
        return _ranges([rows[i]["doc"] for i in open_rows], [found[i] + rows[i]["anchor"] for i in open_rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if len(held) >= p.batch_rows and held[-1]["core"] != row["core"]:
                    yield solve(held)
                    held = []
                held.append(row)
        if held:
            yield solve(held)

    return run


def _window_rows(p: RepeatParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                view = memoryview(row["bytes"])
                marks = [xxhash.xxh3_128_intdigest(view[i : i + p.length]) for i in range(len(view) - p.length + 1)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["doc"]] * len(marks), pa.binary()),
                        pa.array(range(row["low"], row["low"] + len(marks)), pa.int32()),
                        pa.array([_signed(x & _LOW_WORD) for x in marks], pa.int64()),
                        pa.array([_signed(x >> 64) for x in marks], pa.int64()),
                    ],
                    names=["doc", "start", "window_a", "window_b"],
                )

    return run


def _met(rows: DataFrame, counted: DataFrame, keys: list[str], least: int) -> DataFrame:
    """``rows`` whose keys are in ``counted``, with its other columns but ``_n``, the number of rows of a key or more.

    A key of more than ``least`` rows and more than a 1024th of all is dealt out in pieces that meet copies of its one row,
    so no task holds it whole.  There are at most 1024 such keys, and 2048 pieces.
    """
    most = max(least, (counted.agg(F.sum("_n")).first()[0] or 0) // _SHARES)
    heavy = F.broadcast(counted.filter(F.col("_n") > most).select(*keys, F.ceil(F.col("_n") / most).cast("int").alias("_pieces")))
    pieces = F.coalesce("_pieces", F.lit(1))
    dealt = rows.join(heavy, keys, "left").withColumn("_piece", F.floor(F.rand(0) * pieces).cast("int")).drop("_pieces")
    copies = counted.join(heavy, keys, "left").withColumn("_piece", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("_pieces", "_n")
    return dealt.join(copies, [*keys, "_piece"]).drop("_piece")


def repeated_ranges(texts: DataFrame, p: RepeatParams = RepeatParams()) -> DataFrame:
    """doc, low, high: starts (bytes, high included) of the windows of ``length`` bytes that also start anywhere else.

    texts: doc (a key that equal texts share, see :func:`text_key`) and text (binary, not null), a row for each text; a row
    that comes twice is a repeat of its own.  Cores are compared again byte by byte; whole stretches by 128 bits.

    No step holds a core in one task unless it has few cells: counts are added in the map tasks, what they say returns by
    joins that cut frequent keys, and a core with more than ``group_rows`` different stretches is settled by counting windows.
    """
    spark, folder = texts.sparkSession, scratch(texts.sparkSession)
    texts = texts.select("doc", "text")
    cores = texts.mapInArrow(_cell_batches(p, False), "core long").groupBy("core").agg(F.count("*").alias("_n"))
    cores.filter("_n > 1").write.parquet(f"{folder}/shared")
    cells = _met(texts.mapInArrow(_cell_batches(p, True), _CELLS), spark.read.parquet(f"{folder}/shared"), ["core"], p.group_rows)
    # Equal rows of a text that comes several times are one row with a count.
    cells.groupBy(*[x.split()[0] for x in _CELLS.split(", ")]).agg(F.count("*").alias("n")).write.parquet(f"{folder}/cells")
    cells = spark.read.parquet(f"{folder}/cells")
    stretch = ["core", "span_a", "span_b"]
    place = F.struct("doc", "anchor", "low", "high")
    cells.groupBy(*stretch).agg(F.sum("n").alias("n"), F.min(place).alias("place")).write.parquet(f"{folder}/stretches")
    stretches = spark.read.parquet(f"{folder}/stretches")
    settled = _met(cells, stretches.filter("n > 1").select(*stretch, F.col("n").alias("_n")), stretch, p.group_rows).select("doc", "low", "high")
    mixed = stretches.groupBy("core").agg(F.count("*").alias("members"), F.min("n").alias("_least")).filter("members > 1 AND _least = 1")
    mixed.select("core", "members", F.col("members").alias("_n")).write.parquet(f"{folder}/mixed")
    asked = _met(stretches, spark.read.parquet(f"{folder}/mixed"), ["core"], p.group_rows).select("place.*", "core", "n", "members")
    wanted = asked.groupBy("doc").agg(F.collect_list(F.struct("core", "n", "members", "anchor", "low", "high")).alias("asked"))
    once = texts.groupBy("doc").agg(F.first("text").alias("text")).join(wanted, "doc")
    cut = F.transform("asked", lambda x: F.struct(x.alias("of"), F.substring("text", x["low"] + 1, x["high"] - x["low"] + p.length).alias("bytes")))
    once.select("doc", F.explode(cut).alias("_c")).select("doc", "_c.of.*", "_c.bytes").write.parquet(f"{folder}/edges")
    edges = spark.read.parquet(f"{folder}/edges")
    few = edges.filter(F.col("members") <= p.group_rows).drop("members")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    few = few.repartition(parts, "core").sortWithinPartitions("core").mapInArrow(_sorted_groups(p), _RANGES)
    windows = edges.filter(F.col("members") > p.group_rows).mapInArrow(_window_rows(p), _WINDOWS)
    windows.groupBy("window_a", "window_b").agg(F.count("*").alias("_n")).filter("_n > 1").write.parquet(f"{folder}/again")
    many = _met(windows, spark.read.parquet(f"{folder}/again"), ["window_a", "window_b"], p.group_rows).select("doc", F.col("start").alias("low"), F.col("start").alias("high"))
    out = staged(settled.unionByName(few).unionByName(many).distinct())
    discard(spark, folder)
    return out


def _merged(ranges: list[dict], length: int) -> list[tuple[int, int]]:
    """Maximal runs (start, end) of the bytes that the windows cover."""
    out: list[tuple[int, int]] = []
    for low, high in sorted((r["low"], r["high"]) for r in ranges):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high + length))
        else:
            out.append((low, high + length))
    return out


def _cut_batches(length: int):
    removed_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept = [], []
            for text, ranges in zip(batch.column("_text"), batch.column("_ranges"), strict=True):
                data = text.as_py()
                runs = _merged(ranges.as_py() or [], length)
                removed.append([{"start": a, "end": b} for a, b in runs])
                ends = [0, *[b for _, b in runs]]
                kept.append(b"".join(data[a:b] for a, b in zip(ends, [*[a for a, _ in runs], len(data)], strict=True)) if runs else data)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), pa.array(removed, removed_type), pa.array(kept, pa.binary())], names=["_row", "removed", "kept"]
            )

    return run


def without_repeats(docs: DataFrame, p: RepeatParams = RepeatParams()) -> DataFrame:
    """``docs`` with ``removed`` (runs of bytes, end excluded) and ``kept`` (the other bytes, in order).

    docs: text and any other columns; columns named removed or kept are replaced.  A byte goes if a string of ``length``
    bytes covers it that also starts elsewhere, in the same text or another row's; matches do not cross texts and are judged
    on the input.  Null and empty texts and those shorter than ``length`` keep all; of equal rows none is spared; an empty
    table gives no rows.  Texts are read as UTF-8 bytes, so a cut may fall inside a character.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("removed", "kept")]
    text = F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b""))
    rows = docs.select(F.struct(*others).alias("_row"), text.alias("_text")).withColumn("_doc", text_key(F.col("_text")))
    texts = rows.filter(F.octet_length("_text") >= p.length).select(F.col("_doc").alias("doc"), F.col("_text").alias("text"))
    found = repeated_ranges(texts, p).groupBy(F.col("doc").alias("_doc")).agg(F.collect_list(F.struct("low", "high")).alias("_ranges"))
    joined = rows.join(found, "_doc", "left").select("_row", "_text", "_ranges")
    schema = joined.select("_row").schema.add("removed", _RUNS).add("kept", "binary")
    return joined.mapInArrow(_cut_batches(p.length), schema).select("_row.*", "removed", "kept")
