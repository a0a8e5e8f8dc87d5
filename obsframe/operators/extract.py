"""Imports, exports and symbols of source files as set-based jobs over segments.

Contract: declarations are read by anchored patterns at the depth where they stand.  A header may share its line with
others or span lines; what needs a grammar (regular-expression literals, destructuring) is outside the contract.
A file is one row of the input and is cut into segments there (``segments.py``); a row for each segment goes on from that.
Headers of the usual shape come with what they declare; the patterns here read all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import source as src
from ..functions.source import CLOSE, COMMA, EQUALS, MODIFIERS, OPEN, PARENS, restored, split_top_level
from . import segments as sg
from .ordered import Running, position_chunks, running
from .segments import FILE

NAME = r"[\p{L}_$][\p{L}\p{N}_$]*"
SYMBOL_TYPE = (
    "array<struct<name:string,kind:string,signature:string,exported:boolean,line:bigint,container:string,"
    "annotations:array<string>,modifiers:array<string>,type_parameters:array<string>,"
    "relationships:struct<extends:array<string>,implements:array<string>,permits:array<string>>>>"
)
IMPORT_TYPE = "array<struct<source:string,names:array<string>,type_only:boolean,static:boolean,wildcard:boolean>>"
EXPORT_TYPE = "array<struct<name:string,source:string,type_only:boolean>>"


def brace_depth(lines: DataFrame) -> DataFrame:
    """Add ``depth`` (running balance clamped at zero) and ``max_depth`` up to each line.

    The clamp is S - min(0, lowest S so far), where a line counts with its own lowest prefix.
    """
    def step(b: Column) -> Column:
        return F.when(b == "{", 1).otherwise(-1)

    chunk = position_chunks("line")
    braces = lines.withColumn("_b", F.regexp_extract_all("text", F.lit("[{}]"), F.lit(0)))
    folded = braces.withColumn(
        "_f",
        F.aggregate(
            "_b",
            F.struct(F.lit(0).alias("d"), F.lit(0).alias("lo")),
            lambda a, b: F.struct((a["d"] + step(b)).alias("d"), F.least(a["lo"], a["d"] + step(b)).alias("lo")),
        ),
    )
    summed = running(
        folded, FILE, ["line"], {"_s": Running("sum", F.col("_f.d"), before=True)}, chunk
    ).withColumn("_low", F.col("_s") + F.col("_f.lo"))
    lowest = running(summed, FILE, ["line"], {"_m": Running("min", F.col("_low"))}, chunk).withColumn(
        "depth", (F.col("_s") + F.col("_f.d") - F.least(F.lit(0), F.col("_m"))).cast("long")
    )
    before = running(lowest, FILE, ["line"], {"_p": Running("last", F.col("depth"), before=True)}, chunk)
    # The highest depth inside a line is folded from the depth before it.
    entry = F.coalesce("_p", F.lit(0)).cast("long")
    peak = F.aggregate(
        "_b",
        F.struct(entry.alias("d"), entry.alias("m")),
        lambda a, b: F.struct(
            F.greatest(a["d"] + step(b), F.lit(0).cast("long")).alias("d"),
            F.greatest(a["m"], a["d"] + step(b)).alias("m"),
        ),
        lambda a: a["m"],
    )
    peaked = before.withColumn("_peak", peak)
    return running(peaked, FILE, ["line"], {"max_depth": Running("max", F.col("_peak"))}, chunk).select(
        *lines.columns, "depth", "max_depth"
    )


def code_segments(files: DataFrame, script: bool) -> DataFrame:
    """``(project_id, path, seg, raw, depth, line)``: depth before the segment, line of its first character."""
    return sg.segments(files, script)


def _group(c: Column, pattern: str, index: int) -> Column:
    """Capture group, null when empty or absent."""
    return src.once(F.regexp_extract(c, pattern, index), lambda g: F.when(g != "", g))


def _line_of(pattern: str) -> Column:
    """Line where the first capture group of ``pattern`` ends: the group is everything before the name."""
    return F.col("line") + src.newlines(F.regexp_extract("raw", pattern, 1))


def _symbol(
    name: Column, kind: Column, signature: Column, exported: Column, line: Column,
    container: Column | None = None, annotations: Column | None = None, modifiers: Column | None = None,
    type_parameters: Column | None = None, relationships: Column | None = None,
) -> Column:
    null = F.lit(None)
    return F.struct(
        name.alias("name"),
        kind.alias("kind"),
        signature.alias("signature"),
        exported.alias("exported"),
        line.cast("long").alias("line"),
        (null.cast("string") if container is None else container).alias("container"),
        (null.cast("array<string>") if annotations is None else annotations).alias("annotations"),
        (null.cast("array<string>") if modifiers is None else modifiers).alias("modifiers"),
        (null.cast("array<string>") if type_parameters is None else type_parameters).alias("type_parameters"),
        (
            null.cast("struct<extends:array<string>,implements:array<string>,permits:array<string>>")
            if relationships is None
            else relationships
        ).alias("relationships"),
    )


def _none(kind: str) -> Column:
    return F.array().cast(kind)


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that others read several times.  Behind a generator each is computed once a row; a plain column
    would be written out again wherever it is read."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


# --- scripts -----------------------------------------------------------------------------------------

_PREFIX = r"\A\s*((?:(?:export|default|declare|async|abstract)\s+)*)"
_FUNCTION = _PREFIX + rf"function\b\s*\*?\s*({NAME})?\s*(?:<[^{OPEN}]*>)?\s*({PARENS})(?:\s*:\s*([\s\S]*?))?\s*\z"
_BLOCK = _PREFIX + rf"(class|interface|(?:const\s+)?enum|namespace|module)\b\s*({NAME}(?:\.{NAME})*|[\"'][^\"']*[\"'])?"
_ALIAS = _PREFIX + rf"type\s+({NAME})\s*(?:<[\s\S]*?>)?\s*=\s*([\s\S]*?)\s*\z"
_VARIABLE = _PREFIX + r"(const|let|var)\s+(?!enum\b)([\s\S]*?)\s*\z"
_FROM = r"from\s*[\"']([^\"']*)[\"']"


def _parameter(p: Column) -> Column:
    """One parameter: a default makes it optional, and a literal default gives its type."""
    pattern = rf"\A(\.\.\.)?\s*([^:?{EQUALS}]*?)\s*(\?)?\s*(?::\s*([^{EQUALS}]*?))?\s*(?:{EQUALS}\s*([\s\S]*))?\z"
    parts = F.array(*[F.regexp_extract(p, pattern, i) for i in range(1, 6)])

    def shown(found: Column) -> Column:
        rest, name, mark, kind, default = (found[i] for i in range(5))
        inferred = (
            F.when(default.rlike(r"\A(?:true|false)\z"), ": boolean")
            .when(default.rlike(r"\A(?:\"[\s\S]*\"|'[\s\S]*')\z"), ": string")
            .when(default.rlike(r"\A(?:\d[\w.]*|\.\d+)\z"), ": number")
            .otherwise("")
        )
        return F.concat(
            rest,
            name,
            F.when((mark != "") | (default != ""), "?").otherwise(""),
            F.when(kind != "", F.concat(F.lit(": "), kind)).otherwise(inferred),
        )

    return src.once(parts, shown)


def _function_signature(head: Column, name: Column) -> Column:
    inner = src.once(F.regexp_extract(head, _FUNCTION, 3), lambda g: g.substr(F.lit(2), F.length(g) - 2))
    inner = F.replace(inner, F.lit(EQUALS + src.MORE), F.lit(src.ARROW))
    shown = F.array_join(F.transform(split_top_level(inner, COMMA), _parameter), ", ")
    result = src.once(
        F.regexp_extract(head, _FUNCTION, 4), lambda g: F.when(g != "", F.concat(F.lit(": "), g)).otherwise("")
    )
    return restored(F.concat(F.lit("function "), name, F.lit("("), shown, F.lit(")"), result))


def _listed(c: Column) -> Column:
    """Elements of a masked import or export list as (name, type_only)."""
    items = F.filter(F.transform(F.split(c, COMMA), lambda i: F.trim(F.translate(i, src.NEWLINE, " "))), lambda i: i != "")
    return F.transform(
        items,
        lambda i: F.struct(
            F.regexp_replace(i, r"\A(?:type\s+)?(?:[\s\S]*\s+as\s+)?", "").alias("name"),
            i.rlike(r"\Atype\s+(?!as\b)").alias("type_only"),
        ),
    )


def _script_heads(files: DataFrame, **asked) -> DataFrame:
    """Top-level segments of script files with ``head`` (without what ends them)."""
    top = sg.script_segments(files, **asked)
    return _once(top, head=F.regexp_replace("raw", r"[{};\n]\z", "")).filter(F.trim("head") != "")


def _declaring(rows: DataFrame) -> DataFrame:
    """Add ``prefix`` and ``form``: what a head declares, null when nothing.  A function that is already read needs no prefix."""
    h, read = F.col("head"), F.col("fn_name").isNotNull()
    form = (
        F.when(read | h.rlike(_FUNCTION), "function")
        .when(h.rlike(_BLOCK) & F.endswith("raw", F.lit("{")), "block")
        .when(h.rlike(_ALIAS), "alias")
        .when(h.rlike(_VARIABLE), "variable")
    )
    return _once(rows, form=form, prefix=F.when(~read, F.regexp_extract(h, _PREFIX, 1)))


def _script_symbols(signed: bool = True) -> Column:
    """Symbols of a row of ``_declaring``; unsigned ones have no signatures."""
    h, form, prefix = F.col("head"), F.col("form"), F.col("prefix")
    exported = F.coalesce("fn_exported", prefix.rlike(r"\b(?:export|default)\b"))
    written = (lambda c: c) if signed else (lambda c: F.lit(None).cast("string"))
    fn_name = F.coalesce(_group(h, _FUNCTION, 2), F.lit("default"))
    word = F.regexp_replace(F.regexp_extract(h, _BLOCK, 2), r"\Aconst\s+", "")
    block_kind = F.when(word == "module", "namespace").otherwise(word)
    block_name = F.coalesce(_group(h, _BLOCK, 3), F.lit("default"))
    alias_name = F.regexp_extract(h, _ALIAS, 2)
    start_line = _line_of(r"\A(\s*)")
    declarators = F.filter(
        split_top_level(F.regexp_replace(F.regexp_extract(h, _VARIABLE, 3), r"\[[^\[\]]*\]", "[]")),
        lambda d: d.rlike(rf"\A{NAME}\s*!?\s*(?:[:=]|\z)"),
    )
    keyword = F.regexp_extract(h, _VARIABLE, 2)

    def declared(d: Column) -> Column:
        name = F.regexp_extract(d, rf"\A({NAME})", 1)
        kind = F.trim(F.regexp_extract(d, rf"\A{NAME}\s*!?\s*:\s*((?:[^=]|=>)*)", 1))
        return _symbol(
            name,
            F.lit("variable"),
            written(restored(F.concat(keyword, F.lit(" "), name, F.when(kind != "", F.concat(F.lit(": "), kind)).otherwise("")))),
            exported,
            start_line,
        )

    read = _symbol(F.col("fn_name"), F.lit("function"), F.col("fn_signature"), exported, F.col("line"))
    return (
        F.when(F.col("fn_name").isNotNull(), F.array(read))
        .when(
            form == "function",
            F.transform(
                F.array(fn_name),
                lambda n: _symbol(n, F.lit("function"), written(_function_signature(h, n)), exported, start_line),
            ),
        )
        .when(
            form == "block",
            F.array(
                _symbol(
                    restored(block_name), block_kind, written(restored(F.concat(block_kind, F.lit(" "), block_name))), exported, start_line
                )
            ),
        )
        .when(
            form == "alias",
            F.array(
                _symbol(
                    alias_name, F.lit("type"),
                    written(restored(F.concat(F.lit("type "), alias_name, F.lit(" = "), F.regexp_extract(h, _ALIAS, 3)))),
                    exported, start_line,
                )
            ),
        )
        .when(form == "variable", F.transform(declarators, declared))
        .otherwise(_none(SYMBOL_TYPE))
    ).cast(SYMBOL_TYPE)


def _named_list(h: Column) -> Column:
    return F.regexp_extract(h, f"{src.OPEN_BRACE}([^{src.CLOSE_BRACE}]*){src.CLOSE_BRACE}", 1)


def _script_imports() -> Column:
    h = F.col("head")
    is_import = h.rlike(r"\A\s*import\b\s*(?![.(" + OPEN + r"])")
    source = restored(F.coalesce(_group(h, _FROM, 1), F.regexp_extract(h, r"\A\s*import\s*[\"']([^\"']*)[\"']", 1)))
    clause = r"\A\s*import\s+(?:type\s+(?!from\b))?"
    first = _group(h, clause + rf"({NAME})\s*(?:,|from\b)", 1)
    space = _group(h, rf"\*\s*as\s+({NAME})", 1)
    names = F.concat(
        F.filter(F.array(first, space), lambda n: n.isNotNull()), F.transform(_listed(_named_list(h)), lambda n: n["name"])
    )
    required = rf"\A\s*(?:export\s+)?(?:const|let|var)\s+({NAME})\b[^=]*=\s*require\s*{OPEN}\s*[\"']([^\"']*)[\"']\s*{CLOSE}\s*\z"
    no = F.lit(None).cast("boolean")

    def imported(source: Column, names: Column, type_only: Column) -> Column:
        return F.array(
            F.struct(source.alias("source"), names.alias("names"), type_only.alias("type_only"), no.alias("static"), no.alias("wildcard"))
        )

    return (
        F.when(is_import & (source != ""), imported(source, names, h.rlike(r"\A\s*import\s+type\s+(?!from\b)")))
        .when(
            h.rlike(required),
            imported(restored(F.regexp_extract(h, required, 2)), F.array(F.regexp_extract(h, required, 1)), F.lit(False)),
        )
        .otherwise(_none(IMPORT_TYPE))
    ).cast(IMPORT_TYPE)


def _script_exports() -> Column:
    """Exports of a row of ``_declaring`` with its ``symbols``."""
    h, symbols = F.col("head"), F.col("symbols")
    exported = F.coalesce("fn_exported", F.col("prefix").rlike(r"\b(?:export|default)\b"))
    default = F.coalesce("fn_default", F.col("prefix").rlike(r"\bdefault\b"))
    nothing = F.lit(None).cast("string")

    def export(name: Column, source: Column = nothing, type_only: Column = F.lit(False)) -> Column:
        return F.struct(name.alias("name"), source.alias("source"), type_only.alias("type_only"))

    from_source = restored(_group(h, _FROM, 1))
    is_list = h.rlike(rf"\A\s*export\s*(?:type\s*)?{src.OPEN_BRACE}")
    whole_type = h.rlike(r"\A\s*export\s*type\b")
    own = F.transform(symbols, lambda s: export(s["name"], type_only=s["kind"].isin("interface", "type")))
    with_default = F.when(
        default & (F.size(symbols) > 0) & (symbols[0]["name"] != "default"), F.array(export(F.lit("default")))
    ).otherwise(_none(EXPORT_TYPE))
    common = _group(h, rf"\A\s*(?:module\s*\.\s*)?exports\s*\.\s*({NAME})\s*=(?!=)", 1)
    # A function is none of the lists and assignments below.
    read = F.col("fn_name").isNotNull()
    return (
        F.when(read, F.when(exported, F.concat(own, with_default)).otherwise(_none(EXPORT_TYPE)))
        .when(is_list, F.transform(_listed(_named_list(h)), lambda e: export(e["name"], from_source, whole_type | e["type_only"])))
        .when(h.rlike(r"\A\s*export\s*(?:type\s*)?\*"), F.array(export(F.lit("*"), from_source, whole_type)))
        .when((F.size(symbols) > 0) & exported, F.concat(own, with_default))
        .when(h.rlike(r"\A\s*export\s+default\b") | h.rlike(r"\A\s*export\s*=(?!=)"), F.array(export(F.lit("default"))))
        .when(common.isNotNull(), F.array(export(common)))
        .when(h.rlike(r"\A\s*module\s*\.\s*exports\s*=(?!=)"), F.array(export(F.lit("default"))))
        .otherwise(_none(EXPORT_TYPE))
    ).cast(EXPORT_TYPE)


def ts_declarations(files: DataFrame) -> DataFrame:
    """``(project_id, path, seg, imports, exports, symbols)`` for the top level of script files."""
    rows = _once(_declaring(_script_heads(files)), symbols=_script_symbols())
    out = _once(rows, imports=_script_imports(), exports=_script_exports()).select(*FILE, "seg", "imports", "exports", "symbols")
    return out.filter((F.size("imports") > 0) | (F.size("exports") > 0) | (F.size("symbols") > 0))


# --- Java --------------------------------------------------------------------------------------------

_MODS = "|".join(MODIFIERS)
_ANNOTATION = rf"@(?!interface\b)\s*({NAME}(?:\s*\.\s*{NAME})*)\s*(?:{PARENS})?"
_JAVA_MODS = rf"\A\s*((?:(?:{_MODS})\b\s*)*)"
_JAVA_TYPE = _JAVA_MODS + rf"(class|@\s*interface|interface|enum|record)\s+({NAME})([\s\S]*)\z"
_TYPE_PARAMS = rf"\A\s*({src.ANGLES})"
_METHOD = _JAVA_MODS + rf"({src.ANGLES}\s*)?([^={OPEN}{CLOSE}]*[\s>\]])({NAME})\s*{OPEN}"
_CONSTRUCTOR = _JAVA_MODS + rf"({src.ANGLES}\s*)?({NAME})\s*{OPEN}"
_FIELD = _JAVA_MODS + rf"([^={OPEN}{CLOSE};]*?[\s>\]])({NAME})\s*(?:\[\s*\]\s*)*(?:=|,|\z)"
_RELATION_END = r"(?=\s(?:extends|implements|permits)\s|\z)"


def _inner_list(c: Column) -> Column:
    """Parts of ``<...>``, rendered."""
    inside = c.substr(F.lit(2), F.length(c) - 2)
    return F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.transform(split_top_level(inside), src.render_signature)
    )


def _headed(raw: Column) -> Column:
    """A Java segment without annotations and what ends it."""
    return F.regexp_replace(F.regexp_replace(raw, r"[{};]\z", ""), _ANNOTATION, " ")


def _type_kind(head: Column) -> Column:
    return F.regexp_replace(_group(head, _JAVA_TYPE, 2), r"@\s*interface", "annotation")


def _java_heads(files: DataFrame) -> DataFrame:
    """Segments of Java files with ``head`` (without annotations and what ends them); bare ends say nothing."""
    raw = code_segments(files, script=False)
    # A lone opening brace encloses, a lone semicolon ends the constants of an enum.
    told = raw.filter(~F.col("raw").rlike(r"\A\s*\}?\z"))
    return _once(told, head=_headed(F.col("raw")))


def _java_rows(files: DataFrame, openers: bool = False) -> DataFrame:
    """Java heads with their type, the ``opener`` around them and, unless only ``openers`` are asked for, their ``form``.

    A header that opens a brace encloses what stands one level deeper until that brace closes.  Methods of the usual shape
    keep their ``method_`` columns, which are null for all other rows.
    """
    told = sg.java_segments(files)
    opens = F.endswith("raw", F.lit("{"))
    if openers:
        told = told.filter(opens)
    around = _once(told, _around=_headed(F.col("opener_raw")))
    unread = F.col("opener_raw").isNotNull()
    opener = F.when(
        F.col("opener_seg").isNotNull(),
        F.struct(
            F.col("opener_seg").alias("seg"),
            F.when(unread, _type_kind(F.col("_around"))).otherwise(F.col("opener_kind")).alias("kind"),
            F.when(unread, _group(F.col("_around"), _JAVA_TYPE, 3)).otherwise(F.col("opener_name")).alias("name"),
        ),
    )
    rows = _once(around, opener=opener).drop("_around", "opener_seg", "opener_kind", "opener_name", "opener_raw")
    # Constants come before the first semicolon of an enum body.
    in_type = F.col("opener.kind").isNotNull()
    constants = (F.col("opener.kind") == "enum") & (F.col("after") == 0)
    method = F.when(in_type & ~constants, F.col("_method"))
    rows = _once(rows.withColumnRenamed("method_name", "_method"), method_name=method).drop("_method")
    unread = F.col("method_name").isNull()
    rows = _once(rows, head=F.when(unread, _headed(F.col("raw"))))
    h = F.col("head")
    typed = unread & opens
    rows = _once(rows, type_kind=F.when(typed, _type_kind(h)), type_name=F.when(typed, _group(h, _JAVA_TYPE, 3)))
    if openers:
        return rows.filter(F.col("type_kind").isNotNull())
    rows = rows.filter(~unread | (F.trim(F.regexp_replace("raw", r"[{};]\z", "")) != ""))
    is_constructor = h.rlike(_CONSTRUCTOR) & (F.regexp_extract(h, _CONSTRUCTOR, 3) == F.col("opener.name"))
    is_compact = (F.col("opener.kind") == "record") & opens & (
        F.regexp_extract(h, _JAVA_MODS + rf"({NAME})\s*\z", 2) == F.col("opener.name")
    )
    form = (
        F.when(~unread, "method")
        .when(F.col("type_kind").isNotNull(), "type")
        .when(~in_type, None)
        .when(constants, "constants")
        .when(is_constructor | is_compact, "constructor")
        .when(h.rlike(_METHOD), "method")
        .when(h.rlike(_FIELD) & (F.endswith("raw", F.lit(";")) | h.rlike(r"=")), "field")
    )
    return _once(rows, form=form)


def _java_modifiers() -> Column:
    listed = F.trim(F.regexp_replace(F.regexp_extract("head", _JAVA_MODS, 1), r"\s+", " "))
    return F.filter(F.split(listed, " "), lambda m: m != "")


def _java_type_and_member_symbols() -> tuple[Column, Column]:
    """Symbols of a type's row of ``_java_rows``, and those of a member's."""
    h = F.col("head")
    in_type = F.col("opener.kind").isNotNull()
    container = F.when(in_type, F.col("opener.name"))
    open_public = F.coalesce(F.col("opener.kind").isin("interface", "annotation"), F.lit(False))
    annotations = F.transform(
        F.regexp_extract_all("raw", F.lit(_ANNOTATION), F.lit(1)), lambda a: F.regexp_replace(a, r"\s+", "")
    )
    modifiers = _java_modifiers()
    public = F.array_contains(modifiers, "public")
    header = src.render_signature(restored(h))

    # Types.
    rest = F.regexp_extract(h, _JAVA_TYPE, 4)
    params = F.regexp_extract(rest, _TYPE_PARAMS, 1)
    tail = F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace(rest, _TYPE_PARAMS, ""), rf"\A\s*{PARENS}", " "))

    def related(word: str) -> Column:
        listed = F.regexp_extract(tail, rf"\s{word}\s+([\s\S]*?){_RELATION_END}", 1)
        return F.transform(split_top_level(listed), src.render_signature)

    relationships = F.struct(
        related("extends").alias("extends"), related("implements").alias("implements"), related("permits").alias("permits")
    )
    type_line = _line_of(r"\A([\s\S]*?)\b(?:class|interface|enum|record)\s+" + NAME)
    type_symbol = _symbol(
        F.col("type_name"), F.col("type_kind"), header, public | (in_type & open_public), type_line, container,
        annotations, modifiers, _inner_list(params), relationships,
    )
    listed = F.regexp_extract(rest, rf"\A\s*(?:{src.ANGLES})?\s*({PARENS})", 1)
    components = F.transform(
        split_top_level(listed.substr(F.lit(2), F.length(listed) - 2), COMMA),
        lambda c: _symbol(
            F.regexp_extract(c, rf"({NAME})\s*\z", 1), F.lit("field"), src.render_signature(restored(F.regexp_replace(c, _ANNOTATION, " "))),
            F.lit(True), type_line, F.col("type_name"),
            F.transform(F.regexp_extract_all(c, F.lit(_ANNOTATION), F.lit(1)), lambda a: F.regexp_replace(a, r"\s+", "")),
            F.array().cast("array<string>"),
        ),
    )
    of_type = F.when(F.col("type_kind") == "record", F.concat(F.array(type_symbol), components)).otherwise(F.array(type_symbol))

    # Members.
    constructor = _symbol(
        F.col("opener.name"), F.lit("constructor"), header, public,
        _line_of(rf"\A([\s\S]*?){NAME}\s*{OPEN}"), container, annotations, modifiers,
        _inner_list(F.trim(F.regexp_extract(h, _CONSTRUCTOR, 2))),
    )
    method_name = F.regexp_extract(h, _METHOD, 4)
    method_line = F.col("line") + src.newlines(
        F.regexp_extract(F.regexp_replace("raw", r"[{};]\z", ""), rf"\A((?:[^@{OPEN}]|@\s*{NAME}(?:\.{NAME})*\s*(?:{PARENS})?)*?){NAME}\s*{OPEN}", 1)
    )
    method = _symbol(
        method_name, F.lit("method"), header, public | open_public, method_line, container, annotations, modifiers,
        _inner_list(F.trim(F.regexp_extract(h, _METHOD, 2))),
    )
    pieces = split_top_level(h)
    fields = F.transform(
        pieces,
        lambda p, i: _symbol(
            F.when(i == 0, F.regexp_extract(p, _FIELD, 3)).otherwise(F.regexp_extract(p, rf"\A({NAME})", 1)),
            F.lit("field"),
            src.render_signature(
                restored(
                    F.when(i == 0, F.regexp_extract(p, rf"\A([^={OPEN}]*?[\s>\]]{NAME})\s*(?:\[\s*\]\s*)*(?:=[\s\S]*)?\z", 1)).otherwise(
                        F.concat(
                            F.array_join(F.transform(F.slice(pieces, F.lit(1), i), lambda q: F.regexp_replace(q, r"\s*\z", "")), ", "),
                            F.lit(", "),
                            F.regexp_extract(p, rf"\A({NAME})", 1),
                        )
                    )
                )
            ),
            public | open_public,
            F.col("line") + src.newlines(F.regexp_extract("raw", r"\A((?:\s|@\s*[\w.]+\s*(?:" + PARENS + r")?)*)", 1)),
            container,
            annotations,
            modifiers,
        ),
    )
    constants = F.filter(
        F.transform(
            F.split(F.regexp_replace(h, PARENS, " "), ","),
            lambda c: _symbol(
                F.regexp_extract(c, rf"({NAME})\s*\z", 1), F.lit("enum-constant"), F.regexp_extract(c, rf"({NAME})\s*\z", 1),
                F.lit(True), F.col("line") + src.newlines(F.regexp_extract("raw", r"\A(\s*)", 1)), container,
                F.array().cast("array<string>"), F.array().cast("array<string>"),
            ),
        ),
        lambda s: s["name"] != "",
    )
    form = F.col("form")
    listed = F.col("method_modifiers")
    known = F.when(listed == "", F.array().cast("array<string>")).otherwise(F.split(listed, " "))
    read = _symbol(
        F.col("method_name"), F.lit("method"), F.col("method_signature"), F.array_contains(known, "public") | open_public,
        F.col("line") + F.col("method_lines"), container, F.array().cast("array<string>"), known, F.array().cast("array<string>"),
    )
    members = (
        F.when(F.col("method_name").isNotNull(), F.array(read).cast(SYMBOL_TYPE))
        .when(form == "constants", constants.cast(SYMBOL_TYPE))
        .when(form == "constructor", F.array(constructor).cast(SYMBOL_TYPE))
        .when(form == "method", F.array(method).cast(SYMBOL_TYPE))
        .when(form == "field", F.filter(fields.cast(SYMBOL_TYPE), lambda s: s["name"] != ""))
        .otherwise(_none(SYMBOL_TYPE))
    )
    return of_type.cast(SYMBOL_TYPE), members


def _java_symbols() -> Column:
    types, members = _java_type_and_member_symbols()
    return F.when(F.col("form") == "type", types).otherwise(members)


def _java_imports() -> Column:
    h = F.col("head")
    top = F.col("depth") == 0
    imported = r"\A\s*import\s+(static\s+)?([\p{L}\p{N}_$.\s]+?)\s*(\.\s*\*)?\s*\z"
    qualified = F.regexp_replace(F.regexp_extract(h, imported, 2), r"\s+", "")
    wildcard = F.regexp_extract(h, imported, 3) != ""
    return F.when(
        top & h.rlike(imported),
        F.array(
            F.struct(
                qualified.alias("source"),
                F.when(wildcard, F.array().cast("array<string>")).otherwise(F.array(F.substring_index(qualified, ".", -1))).alias("names"),
                F.lit(False).alias("type_only"),
                (F.regexp_extract(h, imported, 1) != "").alias("static"),
                wildcard.alias("wildcard"),
            )
        ).cast(IMPORT_TYPE),
    ).otherwise(_none(IMPORT_TYPE))


def _java_exports() -> Column:
    public = F.array_contains(_java_modifiers(), "public")
    open_public = F.coalesce(F.col("opener.kind").isin("interface", "annotation"), F.lit(False))
    return F.when(
        F.col("type_kind").isNotNull() & (public | open_public),
        F.array(
            F.struct(
                F.col("type_name").alias("name"),
                F.lit(None).cast("string").alias("source"),
                F.col("type_kind").isin("interface", "annotation").alias("type_only"),
            )
        ).cast(EXPORT_TYPE),
    ).otherwise(_none(EXPORT_TYPE))


def java_declarations(files: DataFrame) -> DataFrame:
    """``(project_id, path, seg, package_name, imports, exports, symbols)`` for Java files."""
    # A method of the usual shape stands in a type: it names no package and imports nothing.
    name = _group(F.col("head"), r"\A\s*package\s+([\p{L}\p{N}_$.\s]+?)\s*\z", 1)
    package = F.when(F.col("depth") == 0, F.regexp_replace(name, r"\s+", ""))
    out = _once(
        _java_rows(files), package_name=package, imports=_java_imports(), exports=_java_exports(), symbols=_java_symbols()
    ).select(*FILE, "seg", "package_name", "imports", "exports", "symbols")
    return out.filter(
        F.col("package_name").isNotNull() | (F.size("imports") > 0) | (F.size("symbols") > 0)
    )


# --- tables ------------------------------------------------------------------------------------------


def _table(rows: DataFrame, items: Column) -> DataFrame:
    """A row for each of ``items``, which are computed by the generator and nowhere else."""
    return rows.select(*FILE, "seg", F.posexplode(items).alias("item", "_x")).select(*FILE, "seg", "item", "_x.*")


def ts_imports(files: DataFrame) -> DataFrame:
    # What imports has one of these words.
    heads = _script_heads(files, having="import|require", plain=True)
    return _table(heads, _script_imports()).drop("static", "wildcard")


def ts_exports(files: DataFrame) -> DataFrame:
    rows = _once(_declaring(_script_heads(files, signed=False)), symbols=_script_symbols(signed=False))
    return _table(rows, _script_exports())


def ts_symbols(files: DataFrame) -> DataFrame:
    rows = _declaring(_script_heads(files)).filter(F.col("form").isNotNull())
    return _table(rows, _script_symbols()).select(
        *FILE, "seg", "item", "name", "kind", "signature", "exported", "line"
    )


def java_imports(files: DataFrame) -> DataFrame:
    return _table(_java_heads(files).filter(F.col("depth") == 0), _java_imports())


TYPE_KINDS = ("class", "interface", "enum", "record", "annotation")


def java_types(files: DataFrame) -> DataFrame:
    types, _ = _java_type_and_member_symbols()
    return _table(_java_rows(files, openers=True), types).filter(F.col("kind").isin(*TYPE_KINDS))


def java_members(files: DataFrame) -> DataFrame:
    rows = _java_rows(files).filter(F.col("form").isNotNull())
    return _table(rows, _java_symbols()).filter(~F.col("kind").isin(*TYPE_KINDS)).drop("relationships")


def dependency_names(imports: Column, exports: Column, symbols: Column) -> Column:
    """Distinct names a file depends on, from its nested tables."""
    plain = F.transform(imports, lambda i: i["source"])
    again = F.filter(F.transform(exports, lambda e: e["source"]), lambda s: s.isNotNull())
    related = F.flatten(
        F.transform(
            F.filter(symbols, lambda s: s["relationships"].isNotNull()),
            lambda s: F.concat(s["relationships"]["extends"], s["relationships"]["implements"], s["relationships"]["permits"]),
        )
    )
    bounds = F.filter(
        F.transform(
            F.flatten(F.transform(symbols, lambda s: F.coalesce(s["type_parameters"], F.array().cast("array<string>")))),
            lambda p: F.regexp_replace(F.regexp_extract(p, r"\bextends\s+(.+)$", 1), "<.*$", ""),
        ),
        lambda b: b != "",
    )
    return F.array_distinct(
        F.concat(plain, again, related, F.transform(related, lambda r: F.regexp_replace(r, "<.*$", "")), bounds)
    )


def dependencies(files: DataFrame) -> DataFrame:
    """Edge table ``(project_id, path, dependency)``."""
    return files.select(
        *FILE, F.explode(dependency_names(F.col("imports"), F.col("exports"), F.col("symbols"))).alias("dependency")
    )


def page_links(pages: DataFrame) -> DataFrame:
    """Distinct link targets of web pages: ``(project_id, path, dependency)``."""
    targets = F.regexp_extract_all("text", F.lit(r"href=\"([^\"]*)\""), F.lit(1))
    return pages.select(*FILE, F.explode(F.array_distinct(targets)).alias("dependency")).distinct()
