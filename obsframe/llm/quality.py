"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsframe.session import staged

_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DIGIT = b"0123456789"
_PUNCT = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_MARKS = b"!#$%&*+/<=>@[\\]^_`{|}~"
_ENDS = (b".", b"!", b"?", b":", b'"', b")", "…".encode())

# Features of one line; each line also sees those of the line before and the line after.
OWN = 12


@dataclass(frozen=True)
class QualityParams:
    """``max_docs`` bounds the labelled documents that are learned from, ``max_lines`` the lines of all of them:
    documents are taken whole or left out.

    Both bound the fit alone; scores read every line of every text.
    """

    max_docs: int = 3000
    max_lines: int = 600_000
    rounds: int = 150
    rate: float = 0.1
    penalty: float = 1e-3


def line_features(line: bytes, previous: bytes | None) -> tuple[float, ...]:
    n = len(line)
    words = line.split()
    k = len(words)
    if not k:
        return (1.0,) + (0.0,) * (OWN - 1)
    letters = max(1, n - k + 1)
    return (
        0.0,
        min(np.log1p(n), 8.0) / 8,
        min(letters / k, 20.0) / 20,
        (n - len(line.translate(None, _UPPER))) / letters,
        (n - len(line.translate(None, _DIGIT))) / letters,
        (n - len(line.translate(None, _PUNCT))) / letters,
        (n - len(line.translate(None, _MARKS))) / letters,
        1 - len(set(words)) / k,
        sum(map(eq, words, words[1:])) / k,
        float(line.rstrip().endswith(_ENDS)),
        float(k < 4),
        float(line == previous),
    )


def document_features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines, features) with those of both neighbours and a constant, and the weight of each line: its bytes plus one."""
    lines = (text or b"").split(b"\n")
    own = np.array([line_features(x, lines[i - 1] if i else None) for i, x in enumerate(lines)], dtype=np.float64)
    edge = np.zeros((1, OWN))
    x = np.hstack([own, np.vstack([edge, own[:-1]]), np.vstack([own[1:], edge]), np.ones((len(own), 1))])
    return x, np.array([len(x) + 1.0 for x in lines])


WIDTH = 3 * OWN + 1


def _steps(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Documents of alike numbers of lines, so that padding at most doubles them."""
    size = np.ceil(np.log2(np.maximum(lengths, 1))).astype(int)
    for s in np.unique(size):
        yield np.flatnonzero(size == s)


def marginals(u: np.ndarray, lengths: np.ndarray, t: np.ndarray, pairs: bool = False):
    """P(line is good) for concatenated lines with good-over-bad scores ``u``, by forward-backward over each document.

    ``t`` (2 x 2) scores a line's label after the one before.  With ``pairs`` also the expected count of each pair of
    labels over all documents.
    """
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(int)
    out, counts = np.empty(len(u)), np.zeros((2, 2))
    for docs in _steps(lengths):
        n, longest = lengths[docs], int(lengths[docs].max())
        at = starts[docs][None, :] + np.minimum(np.arange(longest)[:, None], n[None, :] - 1)
        live = np.arange(longest)[:, None] < n[None, :]
        score = np.zeros((longest, len(docs), 2))
        score[:, :, 1] = u[at]
        forward = np.empty_like(score)
        forward[0] = score[0]
        for i in range(1, longest):
            f = forward[i - 1]
            step = np.logaddexp(f[:, :1] + t[0], f[:, 1:] + t[1]) + score[i]
            step -= step.max(axis=1, keepdims=True)
            forward[i] = np.where(live[i][:, None], step, f)
        backward = np.zeros_like(score)
        for i in range(longest - 2, -1, -1):
            b = backward[i + 1] + score[i + 1]
            step = np.logaddexp(b[:, :1] + t[:, 0], b[:, 1:] + t[:, 1])
            step -= step.max(axis=1, keepdims=True)
            backward[i] = np.where(live[i + 1][:, None], step, 0.0)
        both = forward + backward
        good = 1 / (1 + np.exp(np.clip(both[:, :, 0] - both[:, :, 1], -500, 500)))
        out[at[live]] = good[live]
        if pairs:
            joint = forward[:-1, :, :, None] + t + (score[1:] + backward[1:])[:, :, None, :]
            joint = np.exp(joint - joint.max(axis=(2, 3), keepdims=True))
            joint /= joint.sum(axis=(2, 3), keepdims=True)
            counts += joint[live[1:]].sum(axis=0)
    return (out, counts) if pairs else out


def fit(x: np.ndarray, weights: np.ndarray, lengths: np.ndarray, labels: np.ndarray, p: QualityParams) -> dict:
    """Weights of the field, lines taking their document's label, then a logistic map of document scores to labels."""
    y = np.repeat(labels, lengths).astype(float)
    w, t = np.zeros(x.shape[1]), np.zeros((2, 2))
    steps = np.maximum(lengths - 1, 0)
    seen = np.diag([float(steps[labels == 0].sum()), float(steps[labels == 1].sum())])
    mean, square = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    for i in range(1, p.rounds + 1):
        good, counts = marginals(x @ w, lengths, t, pairs=True)
        slope = np.concatenate([x.T @ (y - good) / len(y) - p.penalty * w, ((seen - counts) / len(y) - p.penalty * t).ravel()])
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        step = p.rate * (mean / (1 - 0.9**i)) / (np.sqrt(square / (1 - 0.99**i)) + 1e-8)
        w, t = w + step[:-4], t + step[-4:].reshape(2, 2)
    model = {"w": w, "t": t, "slope": 1.0, "shift": 0.0}
    z, a, b = _logit(_document_means(marginals(x @ w, lengths, t), weights, lengths)), 1.0, 0.0
    for _ in range(50):  # Newton steps with a small ridge, so that separable labels keep finite weights
        q = 1 / (1 + np.exp(-(a * z + b)))
        g = np.array([((labels - q) * z).sum() - 0.1 * (a - 1), (labels - q).sum() - 0.1 * b])
        r = q * (1 - q)
        h = np.array([[(r * z * z).sum() + 0.1, (r * z).sum()], [(r * z).sum(), r.sum() + 0.1]])
        da, db = np.linalg.solve(h, g)
        a, b = a + np.clip(da, -1, 1), b + np.clip(db, -1, 1)
    return model | {"slope": max(float(a), 0.1), "shift": float(b)}


def _document_means(good: np.ndarray, weights: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(int)
    return np.add.reduceat(good * weights, starts) / np.add.reduceat(weights, starts)


def _logit(q: np.ndarray) -> np.ndarray:
    q = np.clip(q, 1e-6, 1 - 1e-6)
    return np.log(q / (1 - q))


def score_texts(texts: list[bytes | None], model: dict) -> np.ndarray:
    parts = [document_features(x) for x in texts]
    lengths = np.array([len(w) for _, w in parts])
    x, weights = np.vstack([v for v, _ in parts]), np.concatenate([w for _, w in parts])
    means = _document_means(marginals(x @ model["w"], lengths, model["t"]), weights, lengths)
    return 1 / (1 + np.exp(-(model["slope"] * _logit(means) + model["shift"])))


def held_out():
    """True where crc32 of doc_id as text leaves 1 when divided by 3 (null ids: the empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1


def _fitting(lines: list[tuple[int, int]], most: int) -> tuple[list[int], list[int]]:
    """Ids of (id, lines) that together keep within ``most`` lines, and those left out; one that still fits is taken."""
    taken, left = [], []
    for i, n in lines:
        (taken if n <= most else left).append(i)
        most -= n if n <= most else 0
    return taken, left


def _training_batches():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            quality, n, x, w = [], [], [], []
            for text, label in zip(batch.column("text"), batch.column("quality"), strict=True):
                features, weights = document_features(text.as_py() or b"")
                quality.append(label.as_py())
                n.append(len(weights))
                x.append(features.tobytes())
                w.append(weights.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(quality, pa.int32()), pa.array(n, pa.int64()), pa.array(x, pa.binary()), pa.array(w, pa.binary())],
                names=["quality", "n", "x", "w"],
            )

    return run


def train(docs: DataFrame, labels: DataFrame, p: QualityParams = QualityParams()) -> dict | None:
    """Fit on at most ``max_docs`` labelled documents that are not held out, picked by a hash of their ids.

    labels: doc_id, quality (0 or 1; other rows are left out; the least label of a repeated id counts).  None without
    labelled documents of both kinds.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.filter("doc_id is not null and quality in (0, 1)").filter(~held_out())
    picked = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.max_docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    # At most max_docs short rows: a proven bound for the broadcast and, after it, for what the driver gets.
    sample = staged(texts.join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"]))
    count = F.coalesce(F.length(F.regexp_replace(F.col("text").cast("string"), "[^\n]", "")), F.lit(0)) + 1
    counted = sample.select("doc_id", count.alias("n"), F.xxhash64("doc_id").alias("h")).collect()
    _, left = _fitting([(r.doc_id, r.n) for r in sorted(counted, key=lambda r: (r.h, r.doc_id))], p.max_lines)
    if left:
        sample = sample.filter(~F.col("doc_id").isin(left))
    rows = sample.orderBy("doc_id").select("text", "quality").mapInArrow(_training_batches(), "quality int, n long, x binary, w binary").collect()
    labels_of = np.array([r.quality for r in rows])
    if not len(rows) or labels_of.min() == labels_of.max():
        return None
    x = np.concatenate([np.frombuffer(r.x).reshape(-1, WIDTH) for r in rows])
    w = np.concatenate([np.frombuffer(r.w) for r in rows])
    return fit(x, w, np.array([r.n for r in rows]), labels_of, p)


def _score_batches(model: dict | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                texts = part.column("_text").to_pylist()
                scores = score_texts(texts, model) if model else np.full(len(texts), 0.5)
                yield part.drop_columns(["_text"]).append_column("_score", pa.array(scores))

    return run


def score(docs: DataFrame, model: dict | None, name: str = "score") -> DataFrame:
    """``docs`` with the column ``name`` added (in place of one of that name): how likely quality is 1, from the text alone.

    Null and empty texts count as one empty line.  Without a model every score is 0.5.
    """
    carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != name]).alias("_doc"), F.col("text").cast("binary").alias("_text"))
    schema = T.StructType([carried.schema["_doc"], T.StructField("_score", T.DoubleType())])
    return carried.mapInArrow(_score_batches(model), schema).select("_doc.*", F.col("_score").alias(name))
