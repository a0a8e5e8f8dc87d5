"""Declarations of script and Java files: small sources, each written to show a rule of the language."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from obsframe.functions import source as src
from obsframe.operators import corpus, extract
from obsframe.operators.ordered import explode_lines
from obsframe.plans import corpus as plans

SCRIPTS = {
    # Every form of import; the text of a comment is not one.
    "in.ts": """\
// import { nothing } from "comment";
import "polyfill";
import brew from "./kettle";
import * as grain from '../mill/grain';
import { sieve as strain, sift } from "tools/sieve";
import type { Recipe } from "./recipe";
""",
    # Exports with and without a declaration of their own.
    "out.ts": """\
let stock = 4;
export { stock as pantry };
export * from "./shelf";
export { jar } from "./jars";
export type Grams = number;
export default class Oven {}
""",
    # Headers: typed parameters, defaults whose types follow from literals, rest parameters, generics.
    "fn.ts": """\
export function knead(dough: Dough, minutes = 10, gentle = false): Dough { return dough; }
function rest(...loaves: Loaf[]): void {}
export interface Loaf { crust: string }
enum Heat { Low, High }
/* function hidden() {} */
const note = "class Quoted {}";
""",
    "old.cjs": "const path = require('node:path');\nmodule.exports.bake = bake;\nfunction bake() {}\n",
    "open.ts": "class Unclosed {\n  rise() {",
}

JAVA = {
    "Kiln.java": """\
package craft.pottery;
import java.time.Duration;
import static java.lang.Math.max;
import craft.glaze.*;

/** class InComment {} */
@Heated
public class Kiln<G extends Glaze> extends Furnace implements Timer, Sensor<G> {
    protected int degrees = 20;
    String label = "enum Quoted { A }";

    Kiln(int degrees) { int local = degrees; this.degrees = local; }

    @Override
    public Duration fire(G glaze, Map<String, List<G>> shelves) throws KilnException { return null; }

    private static class Vent { boolean open; }
}
""",
    "Kinds.java": """\
package craft;
sealed interface Clay permits Stoneware, Porcelain {
    void throwOn(Wheel wheel);
}
record Stoneware(int cone, String body) implements Clay {}
public enum Finish { MATT, GLOSSY; int coats; }
@interface Fragile { int grade() default 1; }
""",
    "Cut.java": "package craft; class Cut { void shape(",
    "Deep.java": "class Layer {\n" * (src.MAX_NESTING + 1) + "}" * (src.MAX_NESTING + 1),
}


def files(spark, sources):
    rows = [("p", path, bytearray(text.encode()), "indexed", None) for path, text in sources.items()]
    return spark.createDataFrame(rows, "project_id string, path string, content binary, outcome string, read_error string")


@pytest.fixture(scope="module")
def found(spark):
    # Java goes in with the line ends of another system: lines stay the same.
    sources = SCRIPTS | {p: t.replace("\n", "\r\n") if p == "Kinds.java" else t for p, t in JAVA.items()}
    return {r["path"]: r.asDict(recursive=True) for r in corpus.index_corpus(files(spark, sources)).collect()}


def line_of(path, piece):
    """1-based line of the first occurrence of ``piece``."""
    text = (SCRIPTS | JAVA)[path]
    return text[: text.index(piece)].count("\n") + 1


def symbol(record, name, kind):
    (one,) = [s for s in record["symbols"] if (s["name"], s["kind"]) == (name, kind)]
    return one


def test_script_imports(found):
    got = {i["source"]: (i["names"], bool(i["type_only"])) for i in found["in.ts"]["imports"]}
    assert got == {
        "polyfill": ([], False),
        "./kettle": (["brew"], False),
        "../mill/grain": (["grain"], False),
        "tools/sieve": (["strain", "sift"], False),
        "./recipe": (["Recipe"], True),
    }
    assert set(found["in.ts"]["dependencies"]) == set(got)


def test_script_exports(found):
    exports = {e["name"]: e["source"] for e in found["out.ts"]["exports"]}
    assert {"pantry", "*", "jar", "Grams", "default"} <= set(exports)
    assert (exports["*"], exports["jar"], exports["pantry"]) == ("./shelf", "./jars", None)
    assert {("stock", "variable"), ("Grams", "type"), ("Oven", "class")} == {
        (s["name"], s["kind"]) for s in found["out.ts"]["symbols"]
    }


def test_script_headers(found):
    record = found["fn.ts"]
    knead = symbol(record, "knead", "function")
    assert knead["signature"] == "function knead(dough: Dough, minutes?: number, gentle?: boolean): Dough"
    assert symbol(record, "rest", "function")["signature"] == "function rest(...loaves: Loaf[]): void"
    kinds = {s["name"]: s["kind"] for s in record["symbols"]}
    assert kinds == {"knead": "function", "rest": "function", "Loaf": "interface", "Heat": "enum", "note": "variable"}
    for s in record["symbols"]:
        assert s["line"] == line_of("fn.ts", s["name"] if s["name"] != "Loaf" else "export interface")


def test_common_modules(found):
    record = found["old.cjs"]
    assert [(i["source"], i["names"]) for i in record["imports"]] == [("node:path", ["path"])]
    assert "bake" in {e["name"] for e in record["exports"]}


def test_open_sources_are_degraded(spark, found):
    warnings = corpus.index_warnings(
        spark.createDataFrame([("p", p, r["degraded_reason"]) for p, r in found.items()], "project_id string, path string, degraded_reason string"),
        files(spark, {"z": ""}).withColumnRenamed("read_error", "message"),
    ).collect()
    assert {w["path"]: w["code"] for w in warnings} == dict.fromkeys(("open.ts", "Cut.java", "Deep.java"), "parse-error")
    assert "nesting" in found["Deep.java"]["degraded_reason"]
    for path in ("open.ts", "Cut.java", "Deep.java"):
        assert found[path]["kind"] == "lexical" and not found[path]["symbols"]


def test_java_head(found):
    record = found["Kiln.java"]
    assert record["package_name"] == "craft.pottery"
    assert {(i["source"], i["static"], i["wildcard"]) for i in record["imports"]} == {
        ("java.time.Duration", False, False), ("java.lang.Math.max", True, False), ("craft.glaze", False, True),
    }
    kiln = symbol(record, "Kiln", "class")
    assert kiln["type_parameters"] == ["G extends Glaze"] and kiln["annotations"] == ["Heated"] and kiln["exported"]
    assert kiln["relationships"] == {"extends": ["Furnace"], "implements": ["Timer", "Sensor<G>"], "permits": []}
    assert {"Furnace", "Timer", "craft.glaze"} <= set(record["dependencies"])


def test_java_members(found):
    record = found["Kiln.java"]
    members = {(s["name"], s["kind"], s["container"]) for s in record["symbols"]}
    assert members == {
        ("Kiln", "class", None), ("degrees", "field", "Kiln"), ("label", "field", "Kiln"), ("Kiln", "constructor", "Kiln"),
        ("fire", "method", "Kiln"), ("Vent", "class", "Kiln"), ("open", "field", "Vent"),
    }
    fire = symbol(record, "fire", "method")
    assert fire["signature"] == "public Duration fire(G glaze, Map<String, List<G>> shelves) throws KilnException"
    assert (fire["annotations"], fire["line"]) == (["Override"], line_of("Kiln.java", "public Duration"))
    assert not symbol(record, "label", "field")["exported"]


def test_java_kinds(found):
    record = found["Kinds.java"]
    got = {(s["name"], s["kind"]): (s["container"], s["line"]) for s in record["symbols"]}
    at = {p: line_of("Kinds.java", p) for p in ("sealed", "void", "record", "public enum", "@interface")}
    assert got == {
        ("Clay", "interface"): (None, at["sealed"]),
        ("throwOn", "method"): ("Clay", at["void"]),
        ("Stoneware", "record"): (None, at["record"]),
        ("cone", "field"): ("Stoneware", at["record"]),
        ("body", "field"): ("Stoneware", at["record"]),
        ("Finish", "enum"): (None, at["public enum"]),
        ("MATT", "enum-constant"): ("Finish", at["public enum"]),
        ("GLOSSY", "enum-constant"): ("Finish", at["public enum"]),
        ("coats", "field"): ("Finish", at["public enum"]),
        ("Fragile", "annotation"): (None, at["@interface"]),
        ("grade", "method"): ("Fragile", at["@interface"]),
    }
    assert symbol(record, "Clay", "interface")["relationships"]["permits"] == ["Stoneware", "Porcelain"]


def test_brace_depth(spark):
    rng = random.Random(5)
    text = "".join(rng.choice("{}x\n") for _ in range(60))
    lines = explode_lines(spark.createDataFrame([("p", "f", text)], "project_id string, path string, text string"))
    got = [(r["depth"], r["max_depth"]) for r in extract.brace_depth(lines).orderBy("line").collect()]
    depth, peak, want = 0, 0, []
    for line in text.split("\n"):
        for ch in line:
            depth = max(0, depth + {"{": 1, "}": -1}.get(ch, 0))
            peak = max(peak, depth)
        want.append((depth, peak))
    assert got == want


def test_lists_and_spacing(spark):
    row = spark.range(1).select(
        src.split_type_list(F.lit("Pair<Left,  Right>, int[] , Tree<Leaf<A, B>>")).alias("parts"),
        src.render_signature(F.lit("static <T>  Bag <T> of ( T first ,T second )")).alias("header"),
        src.max_nesting(F.lit("}{{}{{")).alias("deep"),
    ).first()
    assert row.parts == ["Pair<Left, Right>", "int[]", "Tree<Leaf<A, B>>"]
    assert row.header == "static <T> Bag<T> of(T first, T second)"
    assert row.deep == 3


DEEP_SOURCES = {
    "calls.ts": "export function f(a = g(h(i(1)))): void {}\nexport function g(b = "
    + "h(" * 20 + "1" + ")" * 20 + ", c: number): string { return c; }\nexport const after = 1;\n",
    "patterns.ts": "export const re = /\\{/;\nexport function match(s: string): boolean { return /[/}(]\\/{2,}/g.test(s) || s.length / 2 > 1 / 3; }\n"
    "export const half = (total: number) => total / 2; // } / {\nlet found = [/\"/, /'(/];\nexport class Last {}\n",
    "Maps.java": "class Maps { Map<String,Map<String,Map<String,List<Integer>>>> m; A<B<C<D<E<F<G, H>>>>>, I> deep, other;\n"
    "  <T extends A<B<C<D<E<T>>>>>> Map<T, A<B<C<D<E>>>>> turn(Map<T, A<B<C<D<E>>>>> from, int n) { return null; }\n"
    "  @Note(a(b(c(d(e(1)))))) int noted; }\n",
    "lost.ts": "export const one = " + "(" * 40 + "1" + ")" * 40 + ";\n",
}


def test_depth_and_pattern_literals(spark):
    rows = plans.index_files(
        spark.createDataFrame([("p", p, bytearray(t.encode())) for p, t in DEEP_SOURCES.items()], "project_id string, path string, content binary"), stage=True
    )["files"].collect()
    by = {r.path: r for r in rows}
    names = {p: {(s.name, s.kind) for s in r.symbols} for p, r in by.items()}
    assert names["calls.ts"] == {("f", "function"), ("g", "function"), ("after", "variable")}
    assert {s.signature for s in by["calls.ts"].symbols} >= {"function f(a?): void", "function g(b?, c: number): string"}
    assert by["patterns.ts"].degraded_reason is None
    assert names["patterns.ts"] == {("re", "variable"), ("match", "function"), ("half", "variable"), ("found", "variable"), ("Last", "class")}
    assert names["Maps.java"] == {
        ("Maps", "class"), ("m", "field"), ("deep", "field"), ("other", "field"), ("turn", "method"), ("noted", "field")
    }
    turn = next(s for s in by["Maps.java"].symbols if s.name == "turn")
    assert turn.signature == "<T extends A<B<C<D<E<T>>>>>> Map<T, A<B<C<D<E>>>>> turn(Map<T, A<B<C<D<E>>>>> from, int n)"
    assert "nest deeper" in by["lost.ts"].degraded_reason and names["lost.ts"] == set()


def test_type_lists_of_any_depth(spark):
    deep = "A<" * 30 + "B, C" + ">" * 30
    row = spark.range(1).select(src.split_type_list(F.lit(f"{deep}, D<E<F<G<H, I>>>>, J")).alias("parts")).first()
    assert row.parts == [deep, "D<E<F<G<H, I>>>>", "J"]


def test_lists_are_masked_and_headers_with_bodies_are_not(spark):
    # Words that begin like a list, or hold one inside a name, are no lists; parentheses nest only in the last line.
    text = (
        "export function iex(n: number) { return n; }\nreimport { a };\nx.export { b };\n"
        "import main, { c as d } from './c';\nexport { e };\nfunction f(g = h(1), k = (2)) {}\n"
    )
    (row,) = spark.createDataFrame([(text,)], "text string").select(src.masked_source("text", script=True).alias("m")).collect()
    shown = row.m.translate({ord(m): s for m, s in zip(src.MASK, src.STRUCTURAL, strict=True)})
    assert shown == text
    assert row.m.count("{") == 4 and row.m.count(src.OPEN_BRACE) == 2
    assert "(" not in row.m and row.m.count(src.OPEN) == 4


def test_tables_compute_declarations_once(spark):
    def calls(df, pattern):
        return df._jdf.queryExecution().optimizedPlan().toString().count(pattern)

    files = spark.createDataFrame([("p", "a.ts", "export function f(a = 1) {}")], "project_id string, path string, text string")
    # The name of a function is cut from its header once, and imports need no functions.
    name = extract._FUNCTION + ", 2)"
    assert calls(extract.ts_symbols(files), name) == 1
    assert calls(extract.ts_imports(files), name) == 0
    assert [r.signature for r in extract.ts_symbols(files).collect()] == ["function f(a?: number)"]
