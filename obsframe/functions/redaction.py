"""Secret redaction as six ordered, guarded regular-expression stages."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import SPACE_CLASS

MARK = "[REDACTED]"

# The secret-bearing names and token shapes.
SECRET_NAME = (
    "(?:(?:[a-z0-9]+[_-])*(?:api[_-]?key|access[_-]?key|secret[_-]?access[_-]?key|access[_-]?token"
    "|auth[_-]?token|refresh[_-]?token|token|password|passwd|secret|client[_-]?secret|private[_-]?key))"
)
TOKEN_SHAPES = "sk-[A-Za-z0-9_-]{16,}|gh[pousr]_[A-Za-z0-9_]{20,}|github_pat_[A-Za-z0-9_]{20,}"

_S = f"[{SPACE_CLASS}]"
_WORD_START = "(?<![A-Za-z0-9_])"
_WORD_END = "(?![A-Za-z0-9_])"

# (name, guard words, pattern, replacement).  Each stage reads the output of the one before.  A guard is
# a cheap necessary test on the original text: the mark holds none of the guarded words, so a stage
# can never create a match for a later one whose guard was false.
_NAMED_WORDS = ("key", "token", "passw", "secret")
STAGES = (
    (
        "private keys",
        ("-----begin ",),
        r"-----BEGIN ((?:RSA |EC |OPENSSH )?PRIVATE KEY)-----[\s\S]*?-----END \1-----",
        f"-----BEGIN $1-----\n{MARK}\n-----END $1-----",
    ),
    (
        "bearer headers",
        ("bearer",),
        rf"(?i)({_WORD_START}Authorization{_S}*[:=]{_S}*[\"']?Bearer{_S}+)[^{SPACE_CLASS}\"',;]+",
        f"$1{MARK}",
    ),
    (
        "quoted values",
        _NAMED_WORDS,
        rf"(?i)([\"']?{SECRET_NAME}[\"']?{_S}*[:=]{_S}*)([\"'])([^\r\n]*?)\2",
        f"$1$2{MARK}$2",
    ),
    (
        "bare values",
        _NAMED_WORDS,
        rf"(?i)({_WORD_START}{SECRET_NAME}{_WORD_END}{_S}*[:=]{_S}*)(?![\"'])([^{SPACE_CLASS},;]+)",
        f"$1{MARK}",
    ),
    (
        "token shapes",
        ("sk-", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_"),
        rf"{_WORD_START}(?:{TOKEN_SHAPES}){_WORD_END}",
        MARK,
    ),
    (
        "address passwords",
        ("://",),
        rf"(?i)({_WORD_START}[a-z][a-z0-9+.-]*://[^{SPACE_CLASS}/:@]+:)[^{SPACE_CLASS}/@]+(@)",
        f"$1{MARK}$2",
    ),
)


def _bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: a one-element transform keeps it from being inlined twice."""
    return F.transform(F.array(value), body)[0]


def _stage(state: Column, pattern: str, replacement: str) -> Column:
    def counted(n: Column) -> Column:
        return F.when(n == 0, state).otherwise(
            F.struct(F.regexp_replace(state["t"], pattern, replacement).alias("t"), (state["n"] + n).alias("n"))
        )

    return _bound(F.regexp_count(state["t"], F.lit(pattern)).cast("long"), counted)


def _guarded(guard: str, pattern: str, replacement: str):
    return lambda s: F.when(F.col(guard), _stage(s, pattern, replacement)).otherwise(s)


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``sanitized`` and ``redactions`` (total matches over all stages)."""
    names = [f"_guard{i}" for i in range(len(STAGES))]
    guarded = df.withColumn("_lower", F.lower(text)).withColumns(
        {
            name: reduce(or_, [F.contains(F.col("_lower"), F.lit(w)) for w in words])
            for name, (_, words, _, _) in zip(names, STAGES)
        }
    )
    plain = F.struct(F.col(text).alias("t"), F.lit(0).cast("long").alias("n"))
    state = plain
    for name, (_, _, pattern, replacement) in zip(names, STAGES):
        state = _bound(state, _guarded(name, pattern, replacement))
    # Most texts pass no guard and skip every stage.
    done = F.when(reduce(or_, [F.col(n) for n in names]), state).otherwise(plain)
    return guarded.withColumn("_done", done).select(
        *df.columns, F.col("_done.t").alias("sanitized"), F.col("_done.n").alias("redactions")
    )
