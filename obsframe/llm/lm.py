"""Stupid-backoff language model scores of every document against the counts of all other documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsframe.llm.shingles import WordIds, combine, word_ids


@dataclass(frozen=True)
class LmParams:
    """``chunk_docs`` and ``bucket_bytes`` size the work of a task: documents of a chunk and text behind a table's part."""

    order: int = 2
    alpha: float = 0.4
    chunk_docs: int = 2000
    bucket_bytes: int = 8 << 20


def _size_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t.as_py() or b"" for t in batch.column("text")]
        row = [len(texts), sum(map(len, texts)), sum(len(t.split()) for t in texts)]
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in row], names=["docs", "bytes", "words"])


def _grams(text: bytes | None, order: int, ids: WordIds) -> list[np.ndarray]:
    """Hashes of the n-grams of each order 1..order, those of order n from word n - 1 on."""
    hashes = word_ids((text or b"").split(), ids)
    return [combine(hashes, n) if len(hashes) >= n else np.empty(0, np.uint64) for n in range(1, order + 1)]


def _chunk_keys(texts: list[bytes | None], order: int) -> tuple[list[list[np.ndarray]], np.ndarray, np.ndarray]:
    ids = WordIds()
    grams = [_grams(t, order, ids) for t in texts]
    flat = [g for doc in grams for g in doc]
    keys, counts = np.unique(np.concatenate(flat) if flat else np.empty(0, np.uint64), return_counts=True)
    return grams, keys, counts


def _parts(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(part, start, end) of sorted keys by their upper bits."""
    part = (keys >> np.uint64(64 - bits)).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.empty(0, int)
    for a, b in zip(starts, np.r_[starts[1:], len(part)].astype(int), strict=True):
        yield int(part[a]), int(a), int(b)


def _planes(values: np.ndarray) -> bytes:
    """Numbers as planes of equal bytes: the zeros of small ones lie together and compress to nothing."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _pack_keys(keys: np.ndarray) -> bytes:
    """The lower seven bytes: the part holds the upper one."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()


def _unpack_keys(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 7, 8), np.uint8)
    out[:, :7] = np.frombuffer(data, np.uint8).reshape(-1, 7)
    return out.view("<u8").ravel()


def _count(order: int, bits: int):
    def run(table: pa.Table) -> pa.Table:
        _, keys, counts = _chunk_keys(table.column("text").to_pylist(), order)
        rows = [(p, _pack_keys(keys[a:b]), _planes(counts[a:b])) for p, a, b in _parts(keys, bits)]
        chunk = table.column("chunk")[0].as_py()
        return pa.table(
            {
                "part": pa.array([r[0] for r in rows], pa.int64()),
                "chunk": pa.array([chunk] * len(rows), pa.int64()),
                "keys": pa.array([r[1] for r in rows], pa.binary()),
                "counts": pa.array([r[2] for r in rows], pa.binary()),
            }
        )

    return run


def _total(table: pa.Table) -> pa.Table:
    """The count table of one part, joined back to each chunk that asked: totals in the order of the chunk's keys."""
    keys = [_unpack_keys(k) for k in table.column("keys").to_pylist()]
    counts = [_from_planes(c) for c in table.column("counts").to_pylist()]
    every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.zeros(len(every), np.int64)
    np.add.at(totals, inverse, np.concatenate(counts).astype(np.int64))
    ends = np.cumsum([len(k) for k in keys])[:-1]
    answers = [_planes(x) for x in np.split(totals[inverse], ends)]
    return pa.table({"part": table.column("part"), "chunk": table.column("chunk"), "totals": pa.array(answers, pa.binary())})


def document_score(grams: list[np.ndarray], lookup, words: int, alpha: float) -> tuple[int, float, int]:
    """(words, log score, words scored by a shorter n-gram than the longest possible) of one document.

    ``lookup`` gives the counts over all documents; those of the document itself are taken off.  ``words``: of all documents.
    """
    n = len(grams[0])
    if not n:
        return 0, 0.0, 0
    rest = []
    for g in grams:
        _, inverse, own = np.unique(g, return_inverse=True, return_counts=True)
        rest.append((lookup(g) - own[inverse]).astype(np.float64))
    others = max(words - n, 1)
    score = np.log(np.maximum(rest[0], 1) / others)  # an unknown word counts as seen once
    short = np.zeros(n, dtype=bool)
    for m in range(2, len(grams) + 1):
        if n < m:
            break
        seen = rest[m - 1] > 0
        ratio = np.log(np.maximum(rest[m - 1], 1)) - np.log(np.maximum(rest[m - 2][: n - m + 1], 1))
        score[m - 1 :] = np.where(seen, ratio, score[m - 1 :] + np.log(alpha))
        short[m - 1 :] = ~seen
    return n, float(score.sum()), int(short.sum())


def _score(order: int, bits: int, words: int, alpha: float):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        grams, keys, _ = _chunk_keys(docs.column("text").to_pylist(), order)
        got = dict(zip(answers.column("part").to_pylist(), answers.column("totals").to_pylist(), strict=True))
        totals = np.concatenate([_from_planes(got[p]) for p, _, _ in _parts(keys, bits)] or [np.empty(0, np.uint64)]).astype(np.int64)
        lookup = lambda g: totals[np.searchsorted(keys, g)]
        rows = [document_score(g, lookup, words, alpha) for g in grams]
        return pa.table(
            {
                "doc_id": docs.column("doc_id"),
                "n_words": pa.array([r[0] for r in rows], pa.int64()),
                "log_score": pa.array([r[1] for r in rows], pa.float64()),
                "n_backoff": pa.array([r[2] for r in rows], pa.int64()),
            }
        )

    return run


def stupid_backoff(docs: DataFrame, p: LmParams = LmParams()) -> DataFrame:
    """doc_id, n_words, log_score (sum of log S over words), n_backoff for each row of ``docs`` (doc_id, text).

    S(w | context) is count(context w) / count(context) where count(context w) > 0, else ``alpha`` times S of the context
    without its first word; at last count(w) / words.  Counts are over all other documents (rows); a word none of them has
    counts as seen once.  The first words of a document have the contexts there are.  Words are split at ASCII white space.

    Documents are dealt to chunks.  A chunk sends each of its distinct n-grams once, with its count, to the part of the count
    table that the n-gram's hash names; the part adds up and answers in the chunk's order; the chunk sums per document.  An
    n-gram that all documents have comes once from a chunk, so no part is hot, and both kinds of groups are of bounded size.
    Null and empty texts: 0 words, score 0.0.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    size = source.select("text").mapInArrow(_size_batches, "docs long, bytes long, words long").agg(F.sum("docs"), F.sum("bytes"), F.sum("words")).first()
    n, size, words = (v or 0 for v in size)
    # At least eight bits, so that seven bytes of a key are enough beside its part.
    bits = max(8, int(size // p.bucket_bytes).bit_length())
    chunks = max(1, -(-n // p.chunk_docs))
    dealt = source.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.crc32("text")), F.lit(chunks)).cast("long"))
    asked = dealt.groupBy("chunk").applyInArrow(_count(p.order, bits), "part long, chunk long, keys binary, counts binary")
    answers = asked.groupBy("part").applyInArrow(_total, "part long, chunk long, totals binary")
    schema = "doc_id long, n_words long, log_score double, n_backoff long"
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_score(p.order, bits, words, p.alpha), schema)
