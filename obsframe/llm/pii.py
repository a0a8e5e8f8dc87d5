"""Personal data in texts: fixed kinds by pattern and check, further spans by boosted trees over wide candidates.

Everything here is a column expression of one row; no text is shuffled and no Python runs on executors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsframe.llm.boosting import boost, calibrated, score_column, tree_values
from obsframe.llm.folds import blocks, let, walk

# The kinds in their order.  The patterns find what the plain ones find,
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+      ip   [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card  [0-9]([\x20-]?[0-9])+ of 13 to 19 digits               phone \+[0-9][\x20().0-9-]+[0-9]
# but start only where a run starts (or the last match ended) and never give back characters, so that long runs cost
# linear time and no stack.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A text that this finds nothing in has no match of the pattern.
HINTS = {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": r"\+[0-9]", "number": "[0-9]", "key": "[0-9]", "secret": "[=:]"}

# Wide candidate generators: runs of digits with separators, long tokens that hold a digit, assignments to a secret's name.
GENERATORS = {
    "number": r"(?<![0-9A-Za-z.])\+?[0-9(][0-9\x20().-]{6,38}[0-9](?![0-9A-Za-z])",
    "key": r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]{0,64}[0-9])[A-Za-z0-9_+/=-]{16,}+",
    "secret": r"(?i)(?<![A-Za-z0-9])(?:password|passwd|pwd|token|secret|api[_-]?key)[\"']?[\x20\t]{0,3}[=:][\x20\t]{0,3}[\"']?[^\s\"']{6,}+",
}
# Words before a candidate: weak labels, given to candidates whose own context is hidden from the trees.
_NAMED = {
    "number": r"(?i)\b(?:phone|telephone|tel|call|fax|mobile|cell|whatsapp|contact|ssn|social\x20security|passport|iban|account|card|visa)\b",
    "key": r"(?i)(?:passw(?:or)?d|pwd|token|secret|key|credentials?|login)[\"']?\s*(?:is\b|[=:])?\s*[\"']?$",
}
_OTHER = {
    "number": r"(?i)\b(?:order|invoice|isbn|issn|page|version|ver|build|date|year|total|sum|id|ref|row|lines?|part|serial|no|nr)\b",
    "key": r"(?i)\b(?:commit|sha-?[0-9]*|md5|digest|checksum|hash|etag|uuid|guid|rev|revision)\b",
}
_DATE = r"^(?:[0-9]{4}([-.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-.])[0-9]{1,2}\2[0-9]{4})(?![0-9.-])"
_BOUNDS = {
    "length": (9, 12, 16, 20, 32, 48), "digits": (0.2, 0.4, 0.6, 0.8, 0.95), "upper": (0.01, 0.3, 0.6), "marks": (0, 2, 5),
    "size": (8, 9, 11, 12, 15), "tail": (2, 3, 4),
}
FORMAT = ("length", "digits", "upper", "marks", "shape", "size", "tail")
CONTEXT = ("before", "after", "edge")
FEATURES = ("generator", *FORMAT, *CONTEXT)
# Context is this many characters on each side, at most to the neighbouring match; its words fall into this many slots.
_AROUND, _SLOTS = 32, 4096
_WORD = {"before": r"(\p{L}{2,})[^\p{L}]*$", "after": r"^[^\p{L}]*(\p{L}{2,})"}
_UNKNOWN = 1  # a word that speaks neither for nor against; also what hidden context looks like

@dataclass(frozen=True)
class PiiParams:
    """``precision``: what the calibration third must show above the threshold of a generator; ``even``: the least calibrated
    probability of what is accepted; ``doubt``: the weight of a candidate without a label.
    """

    trees: int = 25
    depth: int = 3
    rate: float = 0.3
    precision: float = 0.98
    even: float = 0.5
    doubt: float = 0.1


def _matches(text: Column, pattern: str, hinted: Column) -> Column:
    return F.when(hinted, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _located(text: Column, matches: Column, pattern: str) -> Column:
    """Where the matches lie: lengths of the pieces between them are added up.  Code points, end exclusive."""

    def at(pieces: Column) -> Column:
        lengths = F.zip_with(pieces, matches, lambda x, m: F.struct(F.length(x).alias("gap"), F.coalesce(F.length(m), F.lit(0)).alias("own")))
        ends = walk(lengths, F.lit(0), lambda end, x: end + x["gap"] + x["own"], lambda end, x: end + x["gap"], "int")
        return F.transform(
            F.arrays_zip(matches.alias("match"), F.slice(ends, 1, F.size(matches)).alias("start")),
            lambda m, i: F.struct(
                m["start"].alias("start"),
                (m["start"] + F.length(m["match"])).alias("end"),
                m["match"].alias("match"),
                F.right(F.get(pieces, i), F.lit(_AROUND)).alias("before"),
                F.left(F.get(pieces, i + 1), F.lit(_AROUND)).alias("after"),
            ),
        )

    empty = F.array().cast("array<struct<start:int,end:int,match:string,before:string,after:string>>")
    return F.when(F.size(matches) > 0, let(F.split(text, pattern, -1), at)).otherwise(empty)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _valid(kind: str, match: Column) -> Column:
    digits = _digits(match)
    if kind == "ip":
        parts = F.split(match, r"\.")
        small = lambda x: F.regexp_replace(x, "^0+", "").rlike("^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")
        return F.forall(parts, small)
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _binned(value: Column, bounds) -> Column:
    out = F.lit(0)
    for b in bounds:
        out = out + (value > b).cast("int")
    return out


def _share(match: Column, drop: str) -> Column:
    return 1 - F.length(F.regexp_replace(match, drop, "")) / F.greatest(F.length(match), F.lit(1))


def _value(match: Column) -> Column:
    """What an assignment assigns."""
    return F.regexp_replace(match, r"^[^=:]*[=:][\x20\t]*[\"']?", "")


def _format(generator: str, span: Column) -> list[Column]:
    """Format of a candidate in few bins.

    A number is seen without its country code, so phones with and without one look alike; an assignment by its value.  No
    check and no plus is a feature: these give the labels.
    """
    match, zero = span["match"], F.lit(0)
    length = shape = size = tail = zero
    if generator == "number":
        match = F.regexp_replace(match, r"^\+(?:[0-9]{1,3}(?=[^0-9])[\x20.-]?)?", "")
        shape = F.when(match.contains("("), 1).when(match.rlike(r"^[0-9-]*-[0-9-]*$"), 2).when(match.rlike(r"^[0-9.]*\.[0-9.]*$"), 3)
        shape = shape.when(match.rlike("^[0-9]*$"), 0).otherwise(4)
        size = _binned(F.length(_digits(match)), _BOUNDS["size"])
        tail = _binned(F.length(F.regexp_extract(match, "[0-9]+$", 0)), _BOUNDS["tail"])
    else:
        match = _value(match) if generator == "secret" else match
        length = _binned(F.length(match), _BOUNDS["length"])
        shape = F.when(match.startswith("eyJ"), 1).when(match.rlike("^[A-Za-z]{2,6}[_-]"), 2).otherwise(0)
    return [
        length,
        _binned(_share(match, "[0-9]"), _BOUNDS["digits"]),
        _binned(_share(match, "[A-Z]"), _BOUNDS["upper"]),
        _binned(F.length(F.regexp_replace(match, "[A-Za-z0-9]", "")), _BOUNDS["marks"]),
        shape,
        size,
        tail,
    ]


def _slot(side: str, span: Column) -> Column:
    """The nearest word of a side, by the slot of its hash from 1; 0 without a word."""
    word = F.lower(F.regexp_extract(span[side], _WORD[side], 1))
    return F.when(word == "", 0).otherwise(F.pmod(F.crc32(word), F.lit(_SLOTS)) + 1).cast("int")


def _context(generator: str, span: Column, words: dict) -> list[Column]:
    """What the words on both sides speak (0 against, 1 unknown, 2 for), and what stands right before: 0 a blank, 1 the start
    of a line, 2 a quote, bracket or sign of assignment, 3 anything else.
    """
    out = []
    for side in _WORD:
        held = words.get((generator, side))
        out.append(F.element_at(F.split(F.lit(held), ",").cast("array<int>"), _slot(side, span) + 1) if held else F.lit(_UNKNOWN))
    before = span["before"]
    edge = F.when(before.rlike(r"(?:^|[\n\r])[\x20\t]*$"), 1).when(before.rlike(r"[\"'=:(<\[{]\s*$"), 2).when(before.rlike(r"\s$"), 0)
    return [*out, edge.otherwise(3)]


def _proof(generator: str, span: Column) -> Column:
    """1 where a check proves the candidate, 0 where one disproves it, else null.  No feature repeats a check."""
    match, digits = span["match"], _digits(span["match"])
    if generator == "secret":
        value = _value(match)
        against = ~value.rlike("[0-9]") | value.rlike(r"[(<{$*]") | (F.length(value) < 8)
        shaped = value.rlike(r"^(?:[0-9a-f]{16,}|[0-9A-F]{16,}|AKIA[0-9A-Z]{16}|eyJ[A-Za-z0-9_.=-]{16,}|[A-Za-z]{2,6}[_-][A-Za-z0-9]{16,})[;,]?$")
        return F.when(against, 0).when(shaped, 1)
    if generator == "number":
        card = F.length(digits).between(13, 19) & F.call_function("luhn_check", digits) & ~match.contains("(")
        phone = match.startswith("+") & F.length(digits).between(9, 15)
        return F.when(match.rlike(_DATE) | match.rlike(r"^[0-9]+(?:\.[0-9]+){3}$"), 0).when(card | phone, 1)
    return F.when(match.rlike("^AKIA[0-9A-Z]{16}$"), 1).when(match.rlike("^[0-9]*$") | match.rlike("/.*/"), 0)


def _named(generator: str, span: Column) -> Column:
    """The weak label that the words before a candidate give; null without such words or with words of both kinds."""
    if generator == "secret":
        return F.lit(None).cast("int")
    named, other = span["before"].rlike(_NAMED[generator]), span["before"].rlike(_OTHER[generator])
    return F.when(named & ~other, 1).when(other & ~named, 0)


def _bare(generator: str, span: Column) -> Column:
    """0 for plain runs of digits and long numbers that neither a check nor a name speaks for, else null."""
    if generator != "number":
        return F.lit(None).cast("int")
    both = span["before"].rlike(_NAMED[generator])
    return F.when(~both & (F.length(_digits(span["match"])).between(13, 19) | span["match"].rlike("^[0-9]*$")), 0)


def _generate(docs: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Add for each pattern its located matches as column ``_<name>``.  Most texts pass none of the hints, each tried once."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    hints = {HINTS[name]: f"_h_{i}" for i, name in enumerate(patterns)}
    out = docs.withColumns({column: text.rlike(hint) for hint, column in hints.items()})
    out = out.withColumns({f"_m_{name}": _matches(text, pattern, F.col(hints[HINTS[name]])) for name, pattern in patterns.items()})
    out = out.withColumns({f"_{name}": _located(text, F.col(f"_m_{name}"), pattern) for name, pattern in patterns.items()})
    return out.drop(*hints.values(), *[f"_m_{name}" for name in patterns])


def _speaking(found: DataFrame, third: Column) -> dict:
    """(generator, side) -> what each slot of words speaks, as joined digits; from checks alone, in the first third.

    Counted by slot, so at most 6 x 4,097 rows reach the driver.
    """
    def seen(g: str):
        return lambda s: F.struct(
            F.lit(g).alias("g"), *[_slot(side, s).alias(side) for side in _WORD], F.coalesce(_proof(g, s), _bare(g, s)).alias("label")
        )

    flat = found.filter(third == 0).select(F.explode(F.concat(*[F.transform(f"_{g}", seen(g)) for g in GENERATORS])).alias("c")).select("c.*")
    sides = F.explode(F.array(*[F.struct(F.lit(side).alias("side"), F.col(side).alias("slot")) for side in _WORD])).alias("w")
    counted = flat.filter("label is not null").select("g", "label", sides).groupBy("g", "w").agg(F.count("*").alias("n"), F.sum("label").alias("sure"))
    tables: dict = {}
    for r in counted.collect():
        tables.setdefault((r.g, r.w.side), []).append((r.w.slot, r.n, r.sure))
    out = {}
    for key, rows in tables.items():
        slot, n, sure = (np.array(c, dtype=float) for c in zip(*rows, strict=True))
        share = (sure.sum() + 0.5) / (n.sum() + 1)
        own = (sure + 4 * share) / (n + 4)
        lift = np.log(own / (1 - own)) - np.log(share / (1 - share))
        spoken = np.full(_SLOTS + 1, _UNKNOWN)
        spoken[slot.astype(int)] = np.where(n < 3, _UNKNOWN, np.where(lift > 1, 2, np.where(lift < -1, 0, _UNKNOWN)))
        out[key] = ",".join(map(str, spoken))
    return out


def train(docs: DataFrame, p: PiiParams = PiiParams()) -> dict | None:
    """Words, trees and thresholds from all candidates of ``docs``.

    A hash of the text deals documents to thirds.  The first tells which neighbouring words go with candidates that a check
    proves or disproves.  The second fits boosted trees over format and context.  Checks label candidates seen whole; the
    words of a fixed list label others weakly, and those are seen with their context hidden, so the trees cannot learn the
    list back.  The third calibrates: probabilities rise with the score by isotonic regression, and a generator's threshold is
    the lowest score of probability ``even`` or more at which the share of label 1 above is at least ``precision``.  Without
    such a score the generator adds nothing.  Candidates without a label count in the fit as ``doubt`` of a negative each, and
    a generator that has such ones never accepts below even odds: a format without labels stays out.  In small tables a
    third without candidates is replaced by all.  None when there is no candidate.

    Candidates are counted by feature cell, of which there are at most some 250,000 in a third; formats and contexts that do
    not occur take none.  Nothing else reaches the driver.
    """
    found = _generate(docs.select(F.col("text").cast("string").alias("_text")), GENERATORS)
    third = F.crc32(F.coalesce(F.col("_text"), F.lit(""))) % 3
    words = _speaking(found, third)

    def cell(g: str):
        def of(s: Column) -> Column:
            proof, named = _proof(g, s), _named(g, s)
            hidden = proof.isNull() & named.isNotNull()
            seen = [F.when(hidden, blank).otherwise(f) for f, blank in zip(_context(g, s, words), (_UNKNOWN, _UNKNOWN, 0), strict=True)]
            values = [F.lit(list(GENERATORS).index(g)), *_format(g, s), *seen]
            return F.struct(*[f.cast("int").alias(n) for f, n in zip(values, FEATURES, strict=True)], F.coalesce(proof, named, _bare(g, s)).alias("label"))

        return of

    flat = found.select(third.alias("third"), F.explode(F.concat(*[F.transform(f"_{g}", cell(g)) for g in GENERATORS])).alias("c")).select("third", "c.*")
    rows = flat.groupBy("third", *FEATURES).agg(
        F.count("label").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("sure"), F.count_if(F.col("label").isNull()).alias("open")
    ).collect()
    if not rows:
        return None
    rows.sort()
    x = np.array([[r[f] for f in FEATURES] for r in rows])
    third, n, sure, unknown = (np.array([r[c] for r in rows], dtype=float) for c in ("third", "n", "sure", "open"))
    fitted = third == 1 if (third == 1).any() else third >= 0
    base, trees = boost(x[fitted], (n + p.doubt * unknown)[fitted], sure[fitted], p.trees, p.depth, p.rate)
    score = base + sum(tree_values(t, x) for t in trees)
    thresholds = []
    for g in range(len(GENERATORS)):
        own = x[:, 0] == g
        mine = own & (third == 2) if (own & (third == 2) & (n > 0)).any() else own
        best = None
        for low, chance, above in calibrated(score[mine], n[mine], sure[mine]):
            if chance >= p.even and above >= p.precision:
                best = low - 1e-9
        if best is not None and unknown[own].any():
            best = max(best, 0.0)
        thresholds.append(best)
    return {"base": base, "trees": trees, "thresholds": thresholds, "words": words}


def _accepted(generator: str, model: dict) -> Column:
    threshold = model["thresholds"][list(GENERATORS).index(generator)]
    spans = F.col(f"_{generator}")
    if threshold is None:
        return F.array().cast("array<struct<kind:string,start:int,end:int>>")
    # Bins are computed once for a candidate, then walked by the trees.
    binned = F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            *[f.alias(n) for f, n in zip((*_format(generator, s), *_context(generator, s, model["words"])), FEATURES[1:], strict=True)],
        ),
    )
    own = F.lit(list(GENERATORS).index(generator))
    passed = F.filter(binned, lambda s: score_column(model["base"], model["trees"], [own, *[s[n] for n in FEATURES[1:]]]) >= threshold)
    return F.transform(passed, lambda s: F.struct(F.lit(generator).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def find(docs: DataFrame, model: dict | None, name: str = "pii") -> DataFrame:
    """``docs`` with the column ``name`` added (in place of one of that name): array of (kind, start, end).

    First the spans of the four fixed kinds, by kind and start, whatever the trees say; then accepted candidates, by start,
    that touch none of them and no earlier accepted one.  Null and empty texts have none.
    """
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != name]).alias("_doc"), F.col("text").cast("string").alias("_text"))
    out = _generate(held, PATTERNS)

    def kept(k: str) -> Column:
        valid = F.filter(F.col(f"_{k}"), lambda s: _valid(k, s["match"]))
        return F.transform(valid, lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    out = out.withColumn("_base", F.concat(*map(kept, KINDS))).drop(*[f"_{k}" for k in KINDS])
    if model is None:
        return out.select("_doc.*", F.col("_base").alias(name))
    out = _generate(out, GENERATORS)
    out = out.withColumn("_more", F.concat(*[_accepted(g, model) for g in GENERATORS]))
    return out.select("_doc.*", F.when(F.size("_more") > 0, F.concat("_base", _free("_base", "_more"))).otherwise(F.col("_base")).alias(name))


def _free(base: str, more: str) -> Column:
    """Spans of ``more`` by start, the longest first, that touch no span of ``base`` and none taken before: walks over all spans
    by start tell each how far the fixed ones before it reach and where the next one starts.
    """
    never = F.lit(2**31 - 1)
    spans = F.concat(
        F.transform(base, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("last"), F.lit(None).cast("string").alias("kind"))),
        F.transform(more, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("last"), s["kind"].alias("kind"))),
    )

    def taken(ordered: Column) -> Column:
        fixed = lambda s: s["kind"].isNull()
        reach = walk(ordered, F.lit(0), lambda r, s: F.when(fixed(s), F.greatest(r, -s["last"])).otherwise(r), lambda r, s: r, "int")
        following = walk(F.reverse(ordered), never, lambda r, s: F.when(fixed(s), s["start"]).otherwise(r), lambda r, s: r, "int")
        met = F.arrays_zip(ordered.alias("s"), reach.alias("reach"), F.reverse(following).alias("next"))
        clear = F.filter(met, lambda m: m["s"]["kind"].isNotNull() & (m["reach"] <= m["s"]["start"]) & (m["next"] >= -m["s"]["last"]))
        chosen = walk(
            F.transform(clear, lambda m: m["s"]),
            F.lit(0),
            lambda at, s: F.when(s["start"] >= at, -s["last"]).otherwise(at),
            lambda at, s: F.when(s["start"] >= at, F.struct(s["kind"].alias("kind"), s["start"].alias("start"), (-s["last"]).alias("end"))),
            "struct<kind:string,start:int,end:int>",
        )
        return F.filter(chosen, lambda s: s.isNotNull())

    return let(F.array_sort(spans), taken)


def redact(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in brackets; of spans that overlap, the first names the hole."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    holes = walk(
        ordered,
        F.lit(0),
        lambda at, s: F.greatest(at, s["end"]),
        lambda at, s: F.when(s["start"] >= at, F.struct(at.alias("at"), s["start"].alias("to"), s["kind"].alias("kind"))),
        "struct<at:int,to:int,kind:string>",
    )

    def block(held: Column) -> Column:
        # The text of a block is cut out once, its pieces from that.
        first, last = F.get(held, F.lit(0))["at"], F.element_at(held, -1)["to"]
        return let(
            F.substring(text, first + 1, last - first),
            lambda part: F.array_join(
                F.transform(held, lambda h: F.concat(F.substring(part, h["at"] - first + 1, h["to"] - h["at"]), F.lit("["), F.upper(h["kind"]), F.lit("]"))), ""
            ),
        )

    joined = F.array_join(F.transform(blocks(F.filter(holes, lambda h: h.isNotNull())), block), "")
    end = F.array_max(F.transform(spans, lambda s: s["end"]))
    return F.when(F.size(spans) > 0, F.concat(joined, F.substring(text, end + 1, F.length(text)))).otherwise(text)


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
