"""Source text as expressions: comments out, strings and parentheses masked, cut into segments.

A segment ends at a brace, a semicolon or (for scripts) a line end outside parentheses.  Structural characters inside
strings and parentheses are masked by private-use characters, so braces can be counted with plain sums.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col

# Limits on analysed Java sources.
MAX_JAVA_BYTES = 2 * 1024 * 1024
MAX_NESTING = 512

STRUCTURAL = "{};\n(),<>="
MASK = "".join(chr(0xE000 + i) for i in range(len(STRUCTURAL)))
ARROW = chr(0xE00A)  # a masked "=>"
OPEN_BRACE, CLOSE_BRACE, SEMICOLON, NEWLINE, OPEN, CLOSE, COMMA, LESS, MORE, EQUALS = MASK

# Where a slash starts a pattern literal: behind what cannot end an operand.  The slash is tested before what stands behind.
_PATTERN_LITERAL = (
    r"(?=/)(?:(?<=(?:[(,=:\[!&|?;{}+*%~^-]|=>|\breturn|\btypeof|\bcase)\s{0,16})|(?<=\A\s{0,16}))"
    r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*+\])++/[a-z]*+"
)
_TOKENS = "|".join(
    (
        r"//[^\n]*",
        r"/\*[\s\S]*?(?:\*/|\z)",
        r'"""[\s\S]*?"""',
        r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"',
        r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'",
        r"`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`",
        r"[^\"'/`]+",
        r"[\s\S]",
    )
)
# Balanced groups nest so deep; a source with deeper parentheses is degraded.
MAX_GROUPS = 32


def _balanced(opening: str, closing: str) -> str:
    """Pattern of a group with groups of the same kind inside."""
    plain = f"[^{opening}{closing}]"
    out = f"{opening}{plain}*+{closing}"
    for _ in range(MAX_GROUPS - 1):
        out = f"{opening}(?:{plain}++|{out})*+{closing}"
    return out


PARENS = _balanced(OPEN, CLOSE)
ANGLES = _balanced("<", ">")
MASKED_ANGLES = ANGLES.replace("<", LESS).replace(">", MORE)


def _retokenized(text: Column, pattern: str, change) -> Column:
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), change), "")


def once(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, however often it is read."""
    return F.transform(F.array(value), then)[0]


def _mask(c: Column) -> Column:
    return F.translate(c, STRUCTURAL, MASK)


def restored(c: Column) -> Column:
    """Undo the masks."""
    return F.translate(F.replace(c, F.lit(ARROW), F.lit("=>")), MASK, STRUCTURAL)


def masked_source(text: Column | str, script: bool) -> Column:
    """Comments blanked (line ends kept); strings, pattern literals of scripts and parentheses masked.

    Parentheses are masked from the inside out, in as many rounds as they are deep.
    """

    def token(t: Column) -> Column:
        quoted = t.rlike(r"\A(?:\"|'|`)") & (F.length(t) > 1)
        return (
            F.when(F.startswith(t, F.lit("//")), F.lit(""))
            .when(F.startswith(t, F.lit("/*")), F.concat(F.lit(" "), F.regexp_replace(t, r"[^\n]", "")))
            .when(quoted | (F.startswith(t, F.lit("/")) & (F.length(t) > 1)), _mask(t))
            .otherwise(t)
        )

    def parens(t: Column) -> Column:
        return F.when(F.startswith(t, F.lit("(")) & (F.length(t) > 1), _mask(t)).otherwise(t)

    out = _retokenized(_col(text), f"{_PATTERN_LITERAL}|{_TOKENS}" if script else _TOKENS, token)
    def grouped(t: Column) -> Column:
        # Parentheses nest only where one opens before another has closed: most texts need no count.
        deep = F.when(t.rlike(r"\([^()]*\("), deepest(t, "()")).otherwise(F.lit(1))
        rounds = F.sequence(F.lit(1), F.least(F.greatest(deep, F.lit(1)), F.lit(MAX_NESTING)))
        return F.aggregate(rounds, t, lambda t, _: _retokenized(t, r"\([^()]*\)|[^()]+|[()]", parens))

    out = once(out, grouped)
    if script:
        # Between lists the text goes on to the next word that may start one.
        word = r"(?<![\w$.])(?:import|export)"
        named = r"\s*(?:type\s+)?(?:[\w$]+\s*,\s*)?\{[^{}]*\}"
        pieces = word + named + rf"|[\s\S][\s\S]*?(?={word}|\z)"
        out = _retokenized(out, pieces, lambda t: F.when(t.rlike(rf"\A(?:import|export){named}\z"), _mask(t)).otherwise(t))
    return out


def segments(masked: Column, script: bool) -> Column:
    stops = r"{};\n" if script else "{};"
    return F.regexp_extract_all(masked, F.lit(f"[^{stops}]*[{stops}]|[^{stops}]+"), F.lit(0))


def brace_balance(masked: Column) -> Column:
    """Opening minus closing braces."""
    size = F.length(masked)
    return (size - F.length(F.replace(masked, F.lit("{"), F.lit("")))) - (
        size - F.length(F.replace(masked, F.lit("}"), F.lit("")))
    )


def deepest(text: Column, pair: str) -> Column:
    """Highest running depth of a pair of signs, clamped at zero; the state of the fold is two numbers."""
    start = F.struct(F.lit(0).alias("d"), F.lit(0).alias("m"))
    # Signs alone: the fold has a step for each.
    signs = F.regexp_replace(text, f"[^{re.escape(pair)}]+", "")
    return F.aggregate(
        F.filter(F.split(signs, ""), lambda x: x != ""),
        start,
        lambda a, b: F.when(
            b == pair[0], F.struct((a["d"] + 1).alias("d"), F.greatest(a["m"], a["d"] + 1).alias("m"))
        ).otherwise(F.struct(F.greatest(a["d"] - 1, F.lit(0)).alias("d"), a["m"].alias("m"))),
        lambda a: a["m"],
    )


def max_nesting(text: Column | str) -> Column:
    """Highest running brace depth."""
    return deepest(_col(text), "{}")


def newlines(c: Column) -> Column:
    return F.length(c) - F.length(F.translate(c, "\n" + NEWLINE, ""))


def split_top_level(c: Column, comma: str = ",") -> Column:
    """Parts of a list at commas outside type arguments and parentheses."""
    angles = MASKED_ANGLES if comma == COMMA else ANGLES
    low = LESS if comma == COMMA else "<"
    parts = F.regexp_extract_all(c, F.lit(f"(?:[^{comma}{low}{OPEN}]++|{angles}|{PARENS}|[{low}{OPEN}])++"), F.lit(0))
    return F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: p != "")


def split_type_list(c: Column | str) -> Column:
    return split_top_level(_col(c))


# Declaration modifiers.
MODIFIERS = (
    "public",
    "protected",
    "private",
    "abstract",
    "static",
    "final",
    "sealed",
    "non-sealed",
    "strictfp",
    "native",
    "synchronized",
    "transient",
    "volatile",
    "default",
)


def render_signature(c: Column | str) -> Column:
    """One canonical spacing for a declaration header."""
    out = F.trim(F.regexp_replace(_col(c), r"\s+", " "))
    for pattern, replacement in (
        (r" ?, ?", ", "),
        (r" ([)\]>])", "$1"),
        (r"([(\[<@]) ", "$1"),
        (r" \(", "("),
        (rf"(?<!\b(?:{'|'.join(MODIFIERS)})) <", "<"),
    ):
        out = F.regexp_replace(out, pattern, replacement)
    return out
