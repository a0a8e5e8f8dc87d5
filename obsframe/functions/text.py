"""Scalar text expressions.  Everything here is a Catalyst expression; nothing is a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Term pattern, and the white space class used by trimming and collapsing.
TERM_PATTERN = r"[\p{L}\p{N}_$-]{2,}"
TOKEN_PATTERN = r"[\p{L}\p{N}]+"
SPACE_CLASS = r"\t-\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
REPLACEMENT = "�"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sha256(c: Column | str) -> Column:
    return F.sha2(_col(c), 256)


def byte_len(c: Column | str) -> Column:
    return F.octet_length(_col(c)).cast("long")


def observation_id(session: Column | str, call: Column | str) -> Column:
    digest = F.sha2(F.concat(_col(session), F.lit("\0"), _col(call)), 256)
    return F.concat(F.lit("obs_"), F.substring(digest, 1, 24))


def project_id(root: Column | str) -> Column:
    return F.substring(F.sha2(_col(root), 256), 1, 32)


def is_obs_id(c: Column | str) -> Column:
    return _col(c).rlike(r"^(?:obs_[a-f0-9]{24}|[a-f0-9]{64})$")


def trimmed(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), rf"^[{SPACE_CLASS}]+|[{SPACE_CLASS}]+$", "")


def token_estimate(size: Column | str) -> Column:
    """One token per three bytes, rounded up."""
    return F.ceil(_col(size) / F.lit(3.0)).cast("long")


def _tail_cut(raw: Column) -> Column:
    """Bytes of an unfinished character at the end of ``raw`` (0 to 3)."""
    tail = F.hex(F.substring(raw, -3, 3))
    return (
        F.when(tail.rlike("[C-F].$"), 1)
        .when(tail.rlike("[EF].[89AB].$"), 2)
        .when(tail.rlike("^F.[89AB].[89AB].$"), 3)
        .otherwise(0)
    )


def clip_bytes(c: Column | str, limit: int | Column) -> Column:
    """Longest text of at most ``limit`` bytes; a character cut after three of four bytes shows as U+FFFD."""
    c = _col(c)
    limit = F.lit(limit) if isinstance(limit, int) else limit
    raw = F.substr(c.cast("binary"), F.lit(1), limit.cast("int"))
    size = F.octet_length(raw)
    cut = _tail_cut(raw)
    whole = F.substr(raw, F.lit(1), size - cut).cast("string")
    shown = F.when(cut == 3, F.concat(whole, F.lit(REPLACEMENT))).otherwise(whole)
    return F.when(F.octet_length(c) <= limit, c).otherwise(shown)


def prefix_bytes(c: Column | str, limit: int | Column) -> Column:
    """Longest prefix of whole characters within ``limit`` bytes."""
    c = _col(c)
    limit = F.lit(limit) if isinstance(limit, int) else limit
    raw = F.substr(c.cast("binary"), F.lit(1), limit.cast("int"))
    whole = F.substr(raw, F.lit(1), F.octet_length(raw) - _tail_cut(raw)).cast("string")
    return F.when(F.octet_length(c) <= limit, c).otherwise(whole)


def byte_slice(c: Column | str, offset: Column | int, limit: Column | int) -> Column:
    """Bytes ``[offset, offset + limit)`` decoded so that the decoded text is at most ``limit`` bytes.

    Continuation bytes at the start decode to one U+FFFD each (three bytes for one), so each of them
    costs two bytes of the budget; an unfinished character at the end is dropped.
    """
    c = _col(c)
    offset = F.lit(offset) if isinstance(offset, int) else offset
    limit = F.lit(limit) if isinstance(limit, int) else limit
    data = c.cast("binary")
    head = F.hex(F.substr(data, (offset + 1).cast("int"), F.lit(3)))
    strays = F.when(
        offset > 0, F.length(F.regexp_extract(head, "^((?:[89AB].)*)", 1)) / 2
    ).otherwise(0).cast("int")
    # Fewer bytes than the strays need: only strays fit, three decoded bytes each.
    body = F.when(limit < strays * 3, F.lit(0)).otherwise(limit - strays * 2 - strays)
    shown_strays = F.least(strays, F.floor(limit / 3).cast("int"))
    marks = F.repeat(F.lit(REPLACEMENT), shown_strays)
    raw = F.substr(data, (offset + strays + 1).cast("int"), body.cast("int"))
    cut = _tail_cut(raw)
    whole = F.substr(raw, F.lit(1), F.octet_length(raw) - cut).cast("string")
    shown = F.when(cut == 3, F.concat(whole, F.lit(REPLACEMENT))).otherwise(whole)
    return F.concat(marks, shown)


def tool_label(c: Column | str) -> Column:
    """Printable ASCII only, at most 64 bytes; a character beyond the basic plane counts as two."""
    wide = F.regexp_replace(_col(c), r"[\x{10000}-\x{10FFFF}]", "??")
    return F.substring(F.regexp_replace(wide, r"[^\x20-\x7e]", "?"), 1, 64)


def lexical_terms(path: Column | str, text: Column | str, limit: int | None = None) -> Column:
    """Distinct terms in order of first occurrence: all of them, or the first ``limit``."""
    source = F.lower(F.concat(_col(path), F.lit(" "), _col(text)))
    terms = F.array_distinct(F.regexp_extract_all(source, F.lit(TERM_PATTERN), F.lit(0)))
    return terms if limit is None else F.slice(terms, 1, limit)


def query_terms(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(TERM_PATTERN), F.lit(0))


def field_tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(TOKEN_PATTERN), F.lit(0))


def bounded_message(c: Column | str, limit: int = 512) -> Column:
    return F.substring(F.regexp_replace(_col(c), rf"[{SPACE_CLASS}]+", " "), 1, limit)


def block_text(content: Column | str) -> Column:
    """Text blocks joined by newline; null when there is none."""
    texts = F.transform(F.filter(_col(content), lambda b: b["type"] == "text"), lambda b: b["text"])
    return F.when(F.size(texts) > 0, F.array_join(texts, "\n"))


def replace_text_blocks(content: Column | str, text: Column | str) -> Column:
    """One text block in front, then every non-text block."""
    content = _col(content)
    block = F.struct(
        F.lit("text").alias("type"),
        _col(text).alias("text"),
        F.lit(None).cast("string").alias("id"),
        F.lit(None).cast("string").alias("name"),
    )
    return F.concat(F.array(block), F.filter(content, lambda b: b["type"] != "text"))


def excerpt(text: Column | str, terms: Column | str, limit: int = 4096, max_terms: int = 40) -> Column:
    """Head of the source when it is readable, else its first terms."""
    return F.coalesce(F.substring(_col(text), 1, limit), F.array_join(F.slice(_col(terms), 1, max_terms), " "))


def match_lines(text: Column | str, query: Column | str, clip: int) -> Column:
    """Array of ``(line, text)`` whose clipped, lower-cased line contains the lower-cased trimmed query."""
    needle = F.lower(trimmed(query))
    lines = F.transform(
        F.split(_col(text), "\n"),
        lambda line, i: F.struct((i + 1).cast("long").alias("line"), clip_bytes(line, clip).alias("text")),
    )
    return F.filter(lines, lambda m: F.contains(F.lower(m["text"]), needle))
