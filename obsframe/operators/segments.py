"""Source files cut into segments in Arrow batches, with what the usual headers declare.

A file is masked, cut and counted where its row is: its segments are never shuffled or sorted.  The rules are those of
``functions/source.py``.  Headers of the usual shape (a function with plain parameters, a method without annotations) are read
here for a whole batch at once; their columns are null for any other header, which the patterns of ``extract.py`` read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.source import CLOSE, COMMA, EQUALS, MASK, MAX_NESTING, MODIFIERS, OPEN, STRUCTURAL

FILE = ["project_id", "path"]
# Rows and bytes of a batch that is read and sent at once.
_ROWS, _BYTES = 1 << 15, 8 << 20

# A text is worked on as UTF-8, where masks are bytes that no text has until it is cut.
_FIRST_MASK = 0xF5
_MASKED = bytes(
    _FIRST_MASK + STRUCTURAL.index(chr(i)) if i < 128 and chr(i) in STRUCTURAL else i for i in range(256)
)
_CODES = np.frombuffer(_MASKED, np.uint8)
_NEWLINE = _MASKED[ord("\n")]
_SIGNS = np.array([chr(i) in STRUCTURAL or i >= _FIRST_MASK for i in range(256)])

# --- masks, as in functions/source.py ------------------------------------------------------------------

_SPECIAL = re.compile(rb"[\"'/`]")
_ESCAPED = rb"\\(?![\n\r]|\xc2\x85|\xe2\x80[\xa8\xa9])[\s\S]"
_QUOTED = {
    b'"': re.compile(rb'"[^"\\\n]*+(?:' + _ESCAPED + rb'[^"\\\n]*+)*+"'),
    b"'": re.compile(rb"'[^'\\\n]*+(?:" + _ESCAPED + rb"[^'\\\n]*+)*+'"),
    b"`": re.compile(rb"`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`"),
}
_LITERAL = re.compile(rb"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*+\])++/[a-z]*+")
_BEFORE_LITERAL = re.compile(rb"(?:\A|[(,=:\[!&|?;{}+*%~^-]|=>|(return|typeof|case))[ \t\n\x0b\f\r]{0,16}\Z")
_NAMED = re.compile(
    rb"port(?<=(?<![\w$.])import|(?<![\w$.])export)\s*(?:type\s+)?(?:[\w$]+\s*,\s*)?\{[^{}]*\}"
)


def _word_before(text: bytes, at: int) -> bool:
    """Whether a sign of a word stands before this place."""
    if at and text[at - 1] >= _FIRST_MASK:
        return False
    sign = text[max(0, at - 4) : at].decode(errors="ignore")[-1:]
    return sign == "_" or (sign != "" and unicodedata.category(sign) in ("Lu", "Ll", "Lt", "Lm", "Lo", "Nd"))


def _starts_literal(text: bytes, at: int) -> bool:
    """Whether a slash at this place stands behind what cannot end an operand."""
    low = max(0, at - 32)
    part, start = text[low:at], 0
    while found := _BEFORE_LITERAL.search(part, start):
        start = found.start() + 1
        if found[1]:
            if not _word_before(text, low + found.start()):
                return True
        elif found[0].strip(b" \t\n\x0b\f\r") or low + found.start() == 0:
            return True
    return False


def _tokens(text: bytes, script: bool) -> bytes:
    """Comments blanked, strings and pattern literals masked."""
    out, at = [], 0
    while found := _SPECIAL.search(text, at):
        p = found.start()
        out.append(text[at:p])
        sign, token = found[0], None
        if sign == b"/":
            if text.startswith(b"//", p):
                at = text.find(b"\n", p)
                if at < 0:
                    return b"".join(out)
                continue
            if text.startswith(b"/*", p):
                end = text.find(b"*/", p + 2)
                at = len(text) if end < 0 else end + 2
                out.append(b" " + b"\n" * text.count(b"\n", p, at))
                continue
            if script and _starts_literal(text, p):
                token = _LITERAL.match(text, p)
        else:
            if sign == b'"' and text.startswith(b'"""', p) and (end := text.find(b'"""', p + 3)) >= 0:
                at = end + 3
                out.append(text[p:at].translate(_MASKED))
                continue
            token = _QUOTED[sign].match(text, p)
        out.append(token[0].translate(_MASKED) if token else sign)
        at = token.end() if token else p + 1
    out.append(text[at:])
    return b"".join(out)


def _groups(at: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the outermost parentheses that are masked, from the places of all."""
    if not len(at) % 2 and opens[::2].all() and not opens[1::2].any():
        return at[::2], at[1::2]
    held, spans = [], []
    for p, is_open in zip(at.tolist(), opens.tolist(), strict=True):
        if is_open:
            held.append([p, 0])
        elif held:
            start, inner = held.pop()
            if held:
                held[-1][1] = max(held[-1][1], inner + 1)
            if inner < MAX_NESTING:
                while spans and spans[-1][0] > start:
                    spans.pop()
                spans.append((start, p))
    pairs = np.array(spans, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _encoded(text: str) -> bytes:
    """UTF-8 where signs that look like masks are masks."""
    data = text.encode()
    if b"\xee\x80" in data:
        for i, sign in enumerate(MASK):
            data = data.replace(sign.encode(), bytes([_FIRST_MASK + i]))
    return data


def _masked(text: str, script: bool) -> tuple[np.ndarray, np.ndarray]:
    """The text as ``functions.source.masked_source`` masks it, and the places of its structural signs and masks."""
    codes = np.frombuffer(_tokens(_encoded(text), script), np.uint8).copy()
    at = np.flatnonzero(_SIGNS[codes])
    signs = codes[at]
    parens = (signs == 40) | (signs == 41)
    first, last = _groups(at[parens], signs[parens] == 40)
    if len(first):
        group = np.searchsorted(first, at, "right") - 1
        inside = at[(group >= 0) & (at <= last[group])]
        codes[inside] = _CODES[codes[inside]]
    if script:
        # A list of names has import, export, type, a comma or blanks before its brace.
        braces = at[codes[at] == 123]
        before = codes[np.maximum(braces - 1, 0)]
        before = np.where(before == 32, codes[np.maximum(braces - 2, 0)], before)
        named = braces[(before == 116) | (before == 101) | (before == 44) | (before <= 32)]
        if len(named):
            whole = codes.tobytes()
            end = whole.find(b"}", named[-1])
            for found in _NAMED.finditer(whole, 0, len(whole) if end < 0 else end + 1):
                part = codes[found.start() - 2 : found.end()]
                part[:] = _CODES[part]
    return codes, at


class _Cut:
    """Segments of one text."""

    def __init__(self, text: str, script: bool):
        codes, at = _masked(text, script)
        signs = codes[at]
        stops = (signs == 123) | (signs == 125) | (signs == 59)
        if script:
            stops |= signs == 10
        ends = at[stops] + 1
        if len(codes) and (not len(ends) or ends[-1] < len(codes)):
            ends = np.append(ends, len(codes))
        self.last = codes[ends - 1]
        self.bounds = np.concatenate([[0], ends])
        self.newlines = np.diff(np.searchsorted(at[(signs == 10) | (signs == _NEWLINE)], self.bounds))
        self.codes, self.masks = codes, at[signs >= _FIRST_MASK]
        data = codes.tobytes()
        for sign in np.unique(codes[self.masks]).tolist():
            data = data.replace(bytes([sign]), MASK[sign - _FIRST_MASK].encode())
        # A mask is three bytes long.
        self.raw = self._strings(data, self.bounds + 2 * np.searchsorted(self.masks, self.bounds))

    @staticmethod
    def _strings(data: bytes, bounds: np.ndarray) -> pa.Array:
        return pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data))

    def restored(self) -> pa.Array:
        """The segments without masks."""
        codes = self.codes.copy()
        codes[self.masks] = np.frombuffer(STRUCTURAL.encode(), np.uint8)[codes[self.masks] - _FIRST_MASK]
        return self._strings(codes.tobytes(), self.bounds)


# --- headers of the usual shape -------------------------------------------------------------------------

_S = r"[ \t\n\x0b\f\r]"
_SIGN = f"[^{MASK[0]}-{chr(0xE00A)}]"  # whatever is no mask
_FUNCTION = (
    rf"^{_S}*(?P<prefix>(?:(?:export|default|declare|async|abstract){_S}+)*)function{_S}+(?P<name>[A-Za-z_$][A-Za-z0-9_$]*){_S}*"
    rf"{OPEN}(?P<inner>(?:{_SIGN}|[{COMMA}{EQUALS}])*){CLOSE}(?:{_S}*:{_S}*(?P<result>{_SIGN}*?))?{_S}*[{{}};\n]?$"
)
_PARAMETER = (
    rf"^(?P<rest>\.\.\.)?{_S}*(?P<name>[^:?{EQUALS}]*?){_S}*(?P<mark>\?)?{_S}*(?::{_S}*(?P<kind>[^{EQUALS}]*?))?{_S}*"
    rf"(?:{EQUALS}{_S}*(?P<default>(?s:.*)))?$"
)
_MODS = "|".join(MODIFIERS)
_METHOD = (
    rf"^(?P<before>{_S}*(?P<mods>(?:(?:{_MODS}){_S}+)*)(?P<kind>[A-Za-z_$][A-Za-z0-9_$.\[\]<>?, \t\n\f\r]*){_S}+)(?P<name>[A-Za-z_$][A-Za-z0-9_$]*){_S}*"
    rf"{OPEN}[^@{OPEN}{CLOSE}]*{CLOSE}[^@{OPEN}{CLOSE}]*[{{;]$"
)
# What a rule of ``render_signature`` would change.
_UNTIDY = r"[\t\n\x0b\f\r]|  | [,()\]>]|,[^ ]|,$|[(\[<@] "
_TYPE = re.compile(rf"\A\s*(?:(?:{_MODS})\b\s*)*(class|interface|enum|record)\s+([A-Za-z_$][A-Za-z0-9_$]*)", re.ASCII)
_TYPE_WORD = re.compile(r"class|interface|enum|record")
_UNUSUAL = re.compile(rf"[^\x00-\x7f{MASK}]")


def _extracted(values: pa.Array, pattern: str) -> tuple[pa.Array, dict[str, pa.Array]]:
    found = pc.extract_regex(values, pattern)
    return pc.is_valid(found), dict(zip(found.type.names, found.flatten(), strict=True)) if len(found) else {}


def _inferred(default: pa.Array) -> pa.Array:
    """The type that a literal default gives its parameter."""
    patterns = {r"^(?:true|false)$": ": boolean", r"""^(?:"(?s:.*)"|'(?s:.*)')$""": ": string", r"^(?:[0-9][A-Za-z0-9_.]*|\.[0-9]+)$": ": number"}
    out = pa.array([""] * len(default), pa.string())
    for pattern, kind in patterns.items():
        out = pc.if_else(pc.match_substring_regex(default, pattern), kind, out)
    return out


def functions(raw: pa.Array, signed: bool) -> dict[str, pa.Array]:
    """Name, signature, export and default of functions with plain parameters; null for any other segment."""
    n, kinds = len(raw), {"fn_name": pa.string(), "fn_signature": pa.string(), "fn_exported": pa.bool_(), "fn_default": pa.bool_()}
    at = np.flatnonzero(pc.match_substring(raw, "function").to_numpy(zero_copy_only=False))
    there, parts = _extracted(raw.take(pa.array(at)), _FUNCTION)
    at = at[there.to_numpy(zero_copy_only=False)] if len(at) else at
    if not len(at):
        return {k: pa.nulls(n, t) for k, t in kinds.items()}
    parts = {k: pc.fill_null(v.filter(there), "") for k, v in parts.items()}
    exported = pc.match_substring_regex(parts["prefix"], "export|default")
    found = {"fn_name": parts["name"], "fn_signature": pa.nulls(len(at), pa.string()), "fn_exported": exported, "fn_default": pc.match_substring(parts["prefix"], "default")}
    if signed:
        listed = pc.split_pattern(parts["inner"], COMMA)
        items = listed.flatten()
        if pc.any(pc.match_substring_regex(parts["inner"], r"[\t\n\x0b\f\r]|  ")).as_py():
            items = pc.replace_substring_regex(items, rf"{_S}+", " ")
        items = pc.utf8_trim(items, " ")
        kept = pc.not_equal(items, "").to_numpy(zero_copy_only=False)
        bounds = np.concatenate([[0], np.cumsum(kept)])[listed.offsets.to_numpy() - listed.offsets[0].as_py()]
        _, p = _extracted(items.filter(pa.array(kept)), _PARAMETER)
        if p:
            p = {k: pc.fill_null(v, "") for k, v in p.items()}
            by_default = pc.not_equal(p["default"], "")
            marked = pc.or_(pc.not_equal(p["mark"], ""), by_default)
            typed = pc.not_equal(p["kind"], "")
            kind = pc.if_else(typed, pc.binary_join_element_wise(": ", p["kind"], ""), "")
            inferred = pc.and_(by_default, pc.invert(typed))
            kind = pc.replace_with_mask(kind, inferred, _inferred(p["default"].filter(inferred)))
            shown = pc.binary_join_element_wise(p["rest"], p["name"], pc.if_else(marked, "?", ""), kind, "")
        else:
            shown = pa.array([], pa.string())
        inner = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), shown), ", ")
        result = pc.if_else(pc.equal(parts["result"], ""), "", pc.binary_join_element_wise(": ", parts["result"], ""))
        found["fn_signature"] = pc.binary_join_element_wise("function ", parts["name"], "(", inner, ")", result, "")
    place = np.full(n, -1)
    place[at] = np.arange(len(at))
    taken = pa.array(place, mask=place < 0)
    return {k: found[k].take(taken).cast(t) for k, t in kinds.items()}


def methods(raw: pa.Array, restored: pa.Array) -> dict[str, pa.Array]:
    """Name, signature, modifiers and line ends before the name of methods without annotations; null for any other segment."""
    n, kinds = len(raw), {"method_name": pa.string(), "method_signature": pa.string(), "method_modifiers": pa.string(), "method_lines": pa.int64()}
    ended = pc.or_(pc.ends_with(raw, "{"), pc.ends_with(raw, ";"))
    at = np.flatnonzero(pc.and_(pc.match_substring(raw, OPEN), ended).to_numpy(zero_copy_only=False))
    there, parts = _extracted(raw.take(pa.array(at)), _METHOD)
    if len(at):
        there = pc.and_(there, pc.invert(pc.fill_null(pc.match_substring_regex(parts["kind"], rf"^(?:{_MODS}|class|interface|enum|record)\b"), True)))
        whole = restored.take(pa.array(at))
        text = pc.utf8_trim(pc.replace_substring_regex(whole, r"[{;]$", ""), " \t\n\x0b\f\r")
        untidy = pc.match_substring_regex(text, _UNTIDY)
        told = text.filter(untidy)
        for pattern, by in ((rf"{_S}+", " "), (r" ?, ?", ", "), (r" ([)\]>])", r"\1"), (r"([(\[<@]) ", r"\1"), (r" \(", "(")):
            told = pc.replace_substring_regex(told, pattern, by)
        text = pc.replace_with_mask(text, untidy, told)
        # A blank stays before the type parameters of a method; and what a source holds of the masks' signs is no mask.
        usual = pc.invert(pc.or_(pc.match_substring(text, " <"), pc.match_substring(text, chr(0xE00A))))
        there = pc.and_(there, usual)
        at = at[there.to_numpy(zero_copy_only=False)]
    if not len(at):
        return {k: pa.nulls(n, t) for k, t in kinds.items()}
    parts = {k: v.filter(there) for k, v in parts.items()}
    found = {
        "method_name": parts["name"], "method_signature": text.filter(there),
        "method_modifiers": pc.utf8_trim(pc.replace_substring_regex(parts["mods"], rf"{_S}+", " "), " "),
        "method_lines": pc.count_substring(parts["before"], "\n"),
    }
    place = np.full(n, -1)
    place[at] = np.arange(len(at))
    taken = pa.array(place, mask=place < 0)
    return {k: found[k].take(taken).cast(t) for k, t in kinds.items()}


def _types(raw: pa.Array) -> tuple[list, list, list]:
    """Kind and name of the type that each header opens, or else the header, where a pattern has to read it."""
    kinds, names, unread = [], [], []
    for text in raw.to_pylist():
        kind = name = header = None
        if _TYPE_WORD.search(text):
            if "@" in text or _UNUSUAL.search(text):
                header = text
            elif found := _TYPE.match(text):
                kind, name = found[1], found[2]
        kinds.append(kind)
        names.append(name)
        unread.append(header)
    return kinds, names, unread


# --- files ----------------------------------------------------------------------------------------------

_BASE = "seg int, raw string, line long, depth long"
_SCRIPT = f"{_BASE}, fn_name string, fn_signature string, fn_exported boolean, fn_default boolean"
_JAVA = (
    f"{_BASE}, opener_seg int, opener_kind string, opener_name string, opener_raw string, after long, "
    "method_name string, method_signature string, method_modifiers string, method_lines long"
)
_NOTHING_TOLD = rf"^{_S}*\}}?$"


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(project, path, texts): rows of one key come one behind the other, and are one file; null texts are none."""
    held: dict[tuple, list[str | None]] = {}
    for batch in batches:
        for project, path, text, copies in zip(*[batch.column(c) for c in (*FILE, "text", "copies")], strict=True):
            key, n, texts = (project.as_py(), path.as_py()), copies.as_py(), [text.as_py()]
            if n > 1:
                held.setdefault(key, []).extend(texts)
                if len(held[key]) < n:
                    continue
                texts = held.pop(key)
            if there := [x for x in texts if x is not None]:
                yield *key, there


def _cut(texts: list[str], script: bool, restore: bool) -> tuple:
    """(seg, raw, line, depth, last sign, restored) of a file, its copies side by side."""
    cuts = [_Cut(text, script) for text in texts]
    raw, restored = [c.raw for c in cuts], [c.restored() for c in cuts] if restore else []
    seg = np.concatenate([np.arange(len(c.raw)) for c in cuts])
    last, newlines = np.concatenate([c.last for c in cuts]), np.concatenate([c.newlines for c in cuts])
    raw, restored = pa.concat_arrays(raw), pa.concat_arrays(restored) if restore else None
    if len(cuts) > 1:
        by = np.argsort(seg, kind="stable")
        seg, last, newlines, raw = seg[by], last[by], newlines[by], raw.take(pa.array(by))
        restored = restored.take(pa.array(by)) if restore else None
    step = (last == 123).astype(np.int64) - (last == 125)
    balance = np.cumsum(step)
    low = np.concatenate([[0], np.minimum(np.minimum.accumulate(balance), 0)[:-1]]) if len(seg) else balance
    return seg, raw, 1 + np.cumsum(newlines) - newlines, balance - step - low, last, restored


def _openers(seg: np.ndarray, depth: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the header whose brace encloses each segment (-1: none), and how many semicolons its body had before."""
    n = len(seg)
    high = int(seg[-1]) + 1 if n else 1
    at = np.flatnonzero(last == 123)
    key = (depth[at] + 1) * high + seg[at]
    by = np.argsort(key, kind="stable")
    at, key = at[by], key[by]
    # The last header of a smaller number that opens this level.
    found = np.searchsorted(key, depth * high + seg) - 1
    opener = np.where((found >= 0) & (key[found] // high == depth), at[found], -1) if len(at) else np.full(n, -1)
    body = np.where(opener >= 0, seg[opener], -1)
    by = np.argsort(body, kind="stable")
    ends = (last[by] == 59).astype(np.int64)
    before = np.cumsum(ends) - ends
    first = np.concatenate([[True], body[by][1:] != body[by][:-1]]) if n else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0)) if n else by
    after = np.empty(n, np.int64)
    after[by] = before - before[start]
    return opener, after


def gathered(files: DataFrame) -> DataFrame:
    """Rows of one key together, with their number as ``copies``.  Segments need it and ask for it where it is not there;
    whoever makes long texts from short ones does it before."""
    return files.withColumn("copies", F.count(F.lit(1)).over(Window.partitionBy(*FILE)))


def _schema(files: DataFrame, columns: str) -> str:
    return ", ".join(f"{c} {files.schema[c].dataType.simpleString()}" for c in FILE) + f", {columns}"


def _batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], read) -> Iterator[pa.RecordBatch]:
    """Parts of files, (project, path, arrays), gathered to batches that ``read`` completes."""
    held, n, size = [], 0, 0

    def made() -> Iterator[pa.RecordBatch]:
        where = np.repeat(np.arange(len(held)), [len(x[2][0]) for x in held])
        keys = [pa.array([x[k] for x in held], t).take(pa.array(where)) for k, t in enumerate(types[:2])]
        whole = [pa.concat_arrays([x[2][k] for x in held]) for k in range(len(held[0][2]))]
        for i in range(0, len(where), _ROWS):
            columns = read([c.slice(i, _ROWS) for c in whole])
            yield pa.RecordBatch.from_arrays(
                [c.cast(t) for c, t in zip([*[k.slice(i, _ROWS) for k in keys], *columns], types, strict=True)], names=names
            )

    for project, path, arrays in rows:
        if not len(arrays[0]):
            continue
        held.append((project, path, arrays))
        n, size = n + len(arrays[0]), size + sum(a.nbytes for a in arrays)
        if n >= _ROWS or size >= _BYTES:
            yield from made()
            held, n, size = [], 0, 0
    if held:
        yield from made()


_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "bigint": pa.int64()}


def _run(files: DataFrame, columns: str, parts, read) -> DataFrame:
    schema = _schema(files, columns)
    names, types = zip(*[x.split() for x in schema.split(", ")], strict=True)
    types = [_ARROW[t] for t in types]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((project, path, parts(texts)) for project, path, texts in _files(batches))
        return _batches(rows, list(names), types, read)

    whole = files if "copies" in files.columns else gathered(files.select(*FILE, "text"))
    return whole.select(*FILE, "text", "copies").mapInArrow(run, schema)


def segments(files: DataFrame, script: bool) -> DataFrame:
    """``(project_id, path, seg, raw, line, depth)`` of every segment."""

    def parts(texts: list[str]) -> list[pa.Array]:
        seg, raw, line, depth, _, _ = _cut(texts, script, False)
        return [pa.array(seg, pa.int32()), raw, pa.array(line, pa.int64()), pa.array(depth, pa.int64())]

    return _run(files, _BASE, parts, lambda columns: columns)


def script_segments(files: DataFrame, signed: bool = True, having: str = "", plain: bool = False) -> DataFrame:
    """Segments of scripts at the top level, with the functions among them; only those that hold ``having``, if given.

    ``plain``: functions are not looked for.
    """

    def parts(texts: list[str]) -> list[pa.Array]:
        seg, raw, line, depth, _, _ = _cut(texts, True, False)
        at = np.flatnonzero(depth == 0)
        columns = [pa.array(seg[at], pa.int32()), raw.take(pa.array(at)), pa.array(line[at], pa.int64()), pa.array(depth[at], pa.int64())]
        if having:
            kept = pc.match_substring_regex(columns[1], having)
            columns = [c.filter(kept) for c in columns]
        return columns

    def read(columns: list[pa.Array]) -> list[pa.Array]:
        found = {} if plain else functions(columns[1], signed)
        return [*columns, *found.values()]

    return _run(files, _BASE if plain else _SCRIPT, parts, read)


def java_segments(files: DataFrame) -> DataFrame:
    """Segments of Java files that say something, with the header that encloses them and the methods among them.

    The header is its segment, kind and name; ``opener_raw`` is a header that a pattern has to read instead.  ``after``: how many
    segments of the same body ended with a semicolon before.
    """

    def parts(texts: list[str]) -> list[pa.Array]:
        seg, raw, line, depth, last, restored = _cut(texts, False, True)
        told = pc.invert(pc.match_substring_regex(raw, _NOTHING_TOLD))
        at = np.flatnonzero(told.to_numpy(zero_copy_only=False))
        seg, line, depth, last = seg[at], line[at], depth[at], last[at]
        raw, restored = raw.take(pa.array(at)), restored.take(pa.array(at))
        opener, after = _openers(seg, depth, last)
        used, which = np.unique(opener, return_inverse=True)
        heads = [pa.array([None if i < 0 else int(seg[i]) for i in used.tolist()], pa.int32())]
        outside = int(len(used) > 0 and used[0] < 0)
        heads += [pa.array([None] * outside + x, pa.string()) for x in _types(raw.take(pa.array(used[outside:], pa.int64())))]
        of = pa.array(which, pa.int64())
        return [
            pa.array(seg, pa.int32()), raw, pa.array(line, pa.int64()), pa.array(depth, pa.int64()), *[h.take(of) for h in heads],
            pa.array(after, pa.int64()), restored,
        ]

    def read(columns: list[pa.Array]) -> list[pa.Array]:
        return [*columns[:-1], *methods(columns[1], columns[-1]).values()]

    return _run(files, _JAVA, parts, read)
