"""Phrase mining by SETM (Houtsma and Swami, ICDE 1995): occurrence relations that grow by one word a level.

The relation of a level holds (piece, position, phrase).  It is persisted in blocks, one row for each run of texts of a
language, sorted by piece and position; pieces never cross a block unseen, so the merge-join of a level (same piece,
next position) is a walk along a block.  What crosses blocks is grouped: each block sends every phrase once with its
count, a window adds the counts, and only frequent phrases return to the blocks that hold them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from obsframe.session import discard, scratch, staged

# Where pieces end; words end at spaces and tabs.
PIECE_ENDS = b".,;:!?\n\v\f\r"
_FOLD = bytes.maketrans(bytes(range(65, 91)) + b"\t" + PIECE_ENDS, bytes(range(97, 123)) + b" " + b"\n" * len(PIECE_ENDS))
_SLICE = 1 << 20
_LOCAL_BITS, _COUNTER_BITS = 22, 18
_ROWS = 50_000
_BLOCKS = "block long, lang string, n_words long, tail int, words binary, seq binary"
_LEVEL = "block long, tail int, seq binary, phrases binary"


@dataclass(frozen=True)
class PhraseParams:
    """``block_words`` bounds the words of a block and with them a task's memory."""

    longest: int = 4
    least: int = 30
    cover_percent: int = 80
    top: int = 2000
    block_words: int = 1 << 21

    def __post_init__(self):
        if self.longest < 2 or self.least < 1 or self.top < 1 or not self.longest <= self.block_words <= 1 << 21:
            raise ValueError("longest is 2 or more, least and top are positive, block_words lies between longest and 2097152")


def _pack(values: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values if isinstance(values, bytes) else values.tobytes())


def _unpack(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _tokens(text: bytes) -> Iterator[list[bytes]]:
    """Words, with a line feed where a piece ends and empty tokens between separators, a slice of the text at a time."""
    text, at = text.translate(_FOLD), 0
    while at < len(text):
        stop = len(text)
        if stop - at > _SLICE:
            ends = [x for x in (text.find(b" ", at + _SLICE), text.find(b"\n", at + _SLICE)) if x >= 0]
            stop = min(ends, default=stop - 1) + 1
        yield text[at:stop].replace(b"\n", b" \n ").split(b" ")
        at = stop


class _Block:
    """The words of one language so far, numbered as they come."""

    def __init__(self):
        self.ids: defaultdict[bytes, int] = defaultdict()
        self.ids.default_factory = self.ids.__len__
        self.ids[b""], self.ids[b"\n"]  # 0: nothing between two separators, 1: the end of a piece
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, tokens: list[bytes]) -> None:
        seq = np.fromiter(map(self.ids.__getitem__, tokens), np.int32, len(tokens))
        seq = seq[seq > 0] - 2  # -1: the end of a piece
        self.parts.append(seq)
        self.size += len(seq)

    def row(self, lang: str, code: int, tail: int) -> tuple:
        seq = np.concatenate(self.parts)
        tail = min(tail, len(seq))
        words = b" ".join(list(self.ids)[2:])
        return code, lang, int((seq[: len(seq) - tail] >= 0).sum()), tail, _pack(words), _pack(seq)

    def rest(self, tail: int) -> _Block:
        """A new block that starts with the last ``tail`` positions, which this one keeps but does not count."""
        out, names = _Block(), list(self.ids)
        out.add([names[i + 2] for i in np.concatenate(self.parts)[-tail:]])
        return out


def _block_batches(p: PhraseParams):
    names = [x.split()[0] for x in _BLOCKS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << _COUNTER_BITS, 0
        open_blocks: dict[str, _Block] = {}

        def closed(lang: str, tail: int) -> pa.RecordBatch:
            nonlocal made
            if made >> _COUNTER_BITS:
                raise ValueError("too many blocks in a partition: raise block_words")
            block, made = open_blocks[lang], made + 1
            if tail:
                open_blocks[lang] = block.rest(tail)
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in zip(block.row(lang, first + made - 1, tail), kinds, strict=True)], names=names
            )

        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
                lang = lang.as_py()
                if not (data := text.as_py()):
                    continue
                for tokens in _tokens(data):
                    open_blocks.setdefault(lang, _Block()).add(tokens)
                    if open_blocks[lang].size >= p.block_words:
                        yield closed(lang, p.longest - 1)
                    elif sum(b.size for b in open_blocks.values()) >= 2 * p.block_words:
                        # Many languages at once: the largest makes room; it holds more than the words it keeps.
                        largest = max(open_blocks, key=lambda x: open_blocks[x].size)
                        if open_blocks[largest].size >= p.longest:
                            yield closed(largest, p.longest - 1)
                open_blocks[lang].add([b"\n"])
        for lang in sorted(open_blocks):
            yield closed(lang, 0)

    return run


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each block once, with how often they stand there."""
    for batch in batches:
        for row in batch.to_pylist():
            seq = _unpack(row["seq"], np.int32)
            words = zstandard.ZstdDecompressor().decompress(row["words"]).split(b" ")
            counted = seq[: len(seq) - row["tail"]]
            n = np.bincount(counted[counted >= 0], minlength=len(words))
            if not (seq >= 0).any():
                continue
            for i in range(0, len(words), _ROWS):
                part = words[i : i + _ROWS]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["lang"]] * len(part), pa.string()),
                        pa.array(part, pa.binary()).cast(pa.string()),
                        pa.array((row["block"] << _LOCAL_BITS) + np.arange(i, i + len(part)), pa.int64()),
                        pa.array(n[i : i + len(part)], pa.int64()),
                    ],
                    names=["lang", "word", "code", "n"],
                )


def _joined(seq: np.ndarray, phrases: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The merge-join with the next position: where two phrases stand side by side, the different pairs, which is where."""
    at = np.flatnonzero((seq[:-1] >= 0) & (seq[1:] >= 0))
    pairs, which = np.unique(seq[at].astype(np.int64) * phrases + seq[at + 1], return_inverse=True)
    return at, pairs, which


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The phrases of each block that are one word longer, once, with how often they stand there."""
    for batch in batches:
        for row in batch.to_pylist():
            seq, phrases = _unpack(row["seq"], np.int32), _unpack(row["phrases"], np.int64)
            at, pairs, which = _joined(seq, len(phrases))
            n = np.bincount(which[at < len(seq) - row["tail"]], minlength=len(pairs))
            for i in range(0, len(pairs), _ROWS):
                part = pairs[i : i + _ROWS]
                code = (row["block"] << _LOCAL_BITS) + np.arange(i, i + len(part))
                columns = phrases[part // len(phrases)], phrases[part % len(phrases)], code, n[i : i + len(part)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["pre", "suf", "code", "n"])


def _held(first: bool):
    """Semi-join the occurrences of a block with its frequent phrases."""
    schema = pa.schema([("block", pa.int64()), ("tail", pa.int32()), ("seq", pa.binary()), ("phrases", pa.binary())])

    def run(blocks: pa.Table, frequent: pa.Table) -> pa.Table:
        if not blocks.num_rows or not frequent.num_rows:
            return schema.empty_table()
        row = blocks.to_pylist()[0]
        seq = _unpack(row["seq"], np.int32)
        if not first:
            at, _, which = _joined(seq, len(_unpack(row["phrases"], np.int64)))
            seq = np.full(len(seq), -1, np.int32)
            seq[at] = which
        frequent = frequent.sort_by("local")
        local = frequent.column("local").to_numpy()
        number = np.full(max(int(seq.max(initial=-1)), int(local[-1])) + 2, -1, np.int32)  # the last entry answers -1
        number[local] = np.arange(len(local))
        out = [row["block"], row["tail"], _pack(number[seq]), _pack(frequent.column("phrase").to_numpy())]
        return pa.Table.from_arrays([pa.array([x], t) for x, t in zip(out, schema.types, strict=True)], schema=schema)

    return run


def _frequent(rows: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Rows of frequent phrases: ``f`` over all blocks; the least code names the phrase.

    A phrase has one row for each block that holds it, so no group has more rows than there are blocks.
    """
    group = Window.partitionBy(*keys)
    summed = rows.select("*", F.sum("n").over(group).alias("f"), F.min("code").over(group).alias("phrase"))
    return summed.filter(F.col("f") >= least).select(*keys, "code", "f", "phrase")


def count_phrases(docs: DataFrame, p: PhraseParams = PhraseParams()) -> tuple[list[DataFrame], DataFrame]:
    """Frequent phrases of 1 to ``longest`` words, and the number of words of each language.

    A table for each length: phrase (a number), lang, words, f, first (f of its first 1, 2, ... words), rest (f of what
    follows them).
    """
    spark = docs.sparkSession
    folder = scratch(spark)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").cast("binary").alias("text"))
    texts.mapInArrow(_block_batches(p), _BLOCKS).write.parquet(f"{folder}/level-0")
    blocks = spark.read.schema(_BLOCKS).parquet(f"{folder}/level-0")
    totals = staged(blocks.groupBy("lang").agg(F.sum("n_words").alias("n")))
    rows = blocks.mapInArrow(_word_rows, "lang string, word string, code long, n long")
    levels, keys = [], ["lang", "word"]
    for k in range(1, p.longest + 1):
        path = f"{folder}/frequent-{k}"
        _frequent(rows, keys, p.least).write.parquet(path)
        found = spark.read.parquet(path)
        levels.append(staged(_described(found.filter("code = phrase"), levels)))
        if k == p.longest:
            break
        local = found.select(F.shiftright("code", _LOCAL_BITS).alias("block"), (F.col("code") % (1 << _LOCAL_BITS)).alias("local"), "phrase")
        held = blocks.drop("lang", "n_words", "words").groupBy("block").cogroup(local.groupBy("block"))
        held.applyInArrow(_held(k == 1), _LEVEL).write.parquet(f"{folder}/level-{k}")
        # Occurrences of phrases of k words replace those of shorter ones.
        discard(spark, f"{folder}/level-{k - 1}")
        discard(spark, path)
        blocks = spark.read.schema(_LEVEL).parquet(f"{folder}/level-{k}")
        rows, keys = blocks.mapInArrow(_pair_rows, "pre long, suf long, code long, n long"), ["pre", "suf"]
    discard(spark, folder)
    return levels, totals


def _described(found: DataFrame, levels: list[DataFrame]) -> DataFrame:
    none = F.array().cast("array<long>")
    if not levels:
        return found.select("phrase", "lang", F.array("word").alias("words"), "f", none.alias("first"), none.alias("rest"))
    known = levels[-1]
    pre = known.select(F.col("phrase").alias("pre"), "lang", F.col("words").alias("_words"), F.col("f").alias("_f"), F.col("first").alias("_first"))
    suf = known.select(F.col("phrase").alias("suf"), F.element_at("words", -1).alias("_last"), F.col("f").alias("_r"), F.col("rest").alias("_rest"))
    return found.join(pre, "pre").join(suf, "suf").select(
        "phrase",
        "lang",
        F.concat("_words", F.array("_last")).alias("words"),
        "f",
        F.concat("_first", F.array("_f")).alias("first"),
        F.concat(F.array("_r"), "_rest").alias("rest"),
        "pre",
        "suf",
    )


def collocations(docs: DataFrame, p: PhraseParams = PhraseParams()) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    docs: text, lang and any other columns.  Null and empty texts hold no words; a null language is ``und``; repeated
    rows count each time; an empty table gives no rows.  A phrase of 2 to ``longest`` words that occurs a times, ``least``
    at least, scores floor(2000000 a / (l + r)) at its weakest cut, l and r being the counts of both parts (ties: the
    earlier cut), and is left out if a phrase one word longer holds it in ``cover_percent`` of its occurrences; a still
    longer one that does implies one of those.  Equal scores go to the more frequent, then to the smaller phrase in byte
    order.  Products are decimals of 38 digits.
    """
    levels, totals = count_phrases(docs, p)
    # Numbers name phrases of one length.
    shown = [level.select(F.lit(k).alias("size"), "phrase", "lang", "words", "f", "first", "rest") for k, level in enumerate(levels[1:], 2)]
    covering = [
        level.select(F.lit(k).alias("size"), F.col(side).alias("phrase"), "f") for k, level in enumerate(levels[2:], 2) for side in ("pre", "suf")
    ]
    phrases = _union(shown)
    if covering:
        longer = _union(covering).groupBy("size", "phrase").agg(F.max("f").alias("_longer"))
        phrases = phrases.join(longer, ["size", "phrase"], "left").filter(
            "_longer IS NULL OR CAST(100 AS DECIMAL(20, 0)) * CAST(_longer AS DECIMAL(19, 0)) < "
            f"CAST({p.cover_percent} AS DECIMAL(20, 0)) * CAST(f AS DECIMAL(19, 0))"
        )
    cut = F.expr(
        "array_min(transform(first, (l, i) -> named_struct('score', CAST(2000000 AS DECIMAL(18, 0)) * CAST(f AS DECIMAL(19, 0)) "
        "div (CAST(l AS DECIMAL(19, 0)) + CAST(rest[i] AS DECIMAL(19, 0))), 'k', i, 'l', l, 'r', rest[i])))"
    )
    scored = phrases.select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), cut.alias("_cut"))
    flat = scored.select("lang", "phrase", "a", F.col("_cut.l").alias("l"), F.col("_cut.r").alias("r"), F.col("_cut.score").cast("long").alias("score"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = flat.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= p.top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
