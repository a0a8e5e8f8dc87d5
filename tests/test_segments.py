"""Segments made in Arrow batches: what is read there agrees with the patterns, and no segment is shuffled."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from obsframe.functions import source as src
from obsframe.operators import extract as ex
from obsframe.operators import segments as sg

PIECES = {
    True: [
        "export ", "default ", "async ", "function ", "f", "$x", "café", "(", ")", "(a, b = 1)", "(a: string, k = 2)", "(...r: T[])", "(x?: A<B, C>, y = 'q, )')",
        "( )", "(a ? b)", ": void ", ": A<B> ", " {", "}", ";", "\n", "// c ( {\n", "/* x {\n y */", '"s{;"', "'q\\'('", "`t\n{`", "'open", '"""d"""',
        "import { a, b as c } from './x';", "export type { Z } from \"z\";", "export * from 'k'", "let a = 1, b: X = /re[/]{/g;", "return /x{/;", "x / y / z",
        "class K ", "import type a, { b\n }", "\t", "  ", "=> ", "", "é",
    ],
    False: [
        "public ", "static ", "default ", "void ", "String ", "List<String> ", "Map<K, V>[] ", "<T> ", "foo", "D", "(", ")", "(int a, List<String> b)", "(@N int a)",
        "( int a ,int b)", " throws IOException", "{", "}", ";", "\n", " ", "@Ov ", "@Gen(n = {1}) ", "class D ", "enum E {", "enum E { A, B(1), C { } ;", "interface I ",
        "record Rec(int x, @Q String y) ", "D(int a)", "int a = 1, b[] = {2}, c;", "// c {\n", "/* { */", '"s;{"', "if (a < b) ", "é", " return k; ", "public m(int a) {", "",
    ],
}


def _sources(script: bool, n: int) -> list[str]:
    rng = random.Random(11)
    return ["".join(rng.choice(PIECES[script]) for _ in range(rng.randrange(1, 30))) for _ in range(n)]


@pytest.mark.parametrize("script", [True, False])
def test_segments_are_those_of_the_expressions(spark, script):
    rows = [("p", str(i), t) for i, t in enumerate(_sources(script, 120))] + [("p", "none", None), ("p", "", "")]
    files = spark.createDataFrame(rows, "project_id string, path string, text string")
    plain = files.select("path", F.posexplode(src.segments(src.masked_source("text", script), script)).alias("seg", "raw")).collect()
    got = ex.code_segments(files, script).collect()
    assert sorted((r.path, r.seg, r.raw) for r in got) == sorted((r.path, r.seg, r.raw) for r in plain)
    for path in {r.path for r in plain}:
        depth, line = 0, 1
        for r in sorted((r for r in got if r.path == path), key=lambda r: r.seg):
            assert (r.depth, r.line) == (depth, line)
            depth = max(0, depth + (r.raw[-1] == "{") - (r.raw[-1] == "}"))
            line += r.raw.count("\n") + r.raw.count(src.NEWLINE)


def test_functions_read_in_batches_agree_with_the_patterns(spark):
    texts = _sources(True, 150) + [
        "export function mix(dough: Dough, minutes = 10, soft = true, name = 'x', rate = .5, q = null, z?): Dough<T> {}",
        "export default async function  go ( a ,, b\t: c ) :  A | B \n{}", "function none(): void;", "declare function f(...rest: X[]): void", "function g(a = 1, )",
    ]
    files = spark.createDataFrame([("p", str(i), t) for i, t in enumerate(texts)], "project_id string, path string, text string")
    heads = ex._script_heads(files).localCheckpoint()
    unread = heads
    for c in ("fn_name", "fn_signature", "fn_exported", "fn_default"):
        unread = unread.withColumn(c, F.lit(None).cast(heads.schema[c].dataType))

    def told(rows):
        out = ex._once(ex._declaring(rows), symbols=ex._script_symbols())
        return ex._once(out, exports=ex._script_exports()).select("path", "seg", "symbols", "exports").collect()

    assert heads.filter("fn_name is not null").count() > 5
    assert sorted(told(heads)) == sorted(told(unread))


def test_methods_read_in_batches_agree_with_the_patterns(spark):
    texts = ["class D {" + t for t in _sources(False, 150)] + [
        "public interface I {\n void a();\n  public static Map<String, int[]> b ( int x ,Y y ) throws Z ;\n}", "enum E { A; String m(int a) { } }", "enum E { String m(int a) { } }",
    ]
    files = spark.createDataFrame([("p", str(i), t) for i, t in enumerate(texts)], "project_id string, path string, text string")
    rows = ex._java_rows(files).filter("form is not null").localCheckpoint()
    assert rows.filter("method_name is not null").count() > 5
    again = rows.withColumn("head", ex._headed(F.col("raw"))).withColumn("method_name", F.lit(None).cast("string"))
    h = F.col("head")
    assert again.filter((F.col("form") == "method") & ~h.rlike(ex._METHOD)).count() == 0

    def told(df):
        return sorted(ex._table(df, ex._java_symbols()).select("path", "seg", "name", "kind", "signature", "exported", "line", "container", "modifiers", "type_parameters").collect())

    assert told(rows) == told(again)


def test_copies_of_a_file_are_read_side_by_side(spark):
    files = spark.createDataFrame([("d", "a.ts", "f {\ng }\n")] * 2, "project_id string, path string, text string")
    got = sorted((r.seg, r.raw, r.depth, r.line) for r in ex.code_segments(files, True).collect())
    assert got == [(0, "f {", 0, 1), (0, "f {", 1, 1), (1, "\n", 2, 1), (1, "\n", 2, 2), (2, "g }", 1, 3), (2, "g }", 2, 3), (3, "\n", 0, 3), (3, "\n", 0, 4)]


def test_segments_are_not_shuffled(spark):
    files = spark.range(5).selectExpr("'p' project_id", "string(id) path", "'function f(a) { }' text")
    for frame in (ex.ts_symbols(files), ex.ts_exports(files), ex.ts_imports(files), ex.java_members(files)):
        plan = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
        above, _, below = plan.partition("MapInArrow")
        assert below and not any(x in above for x in ("Exchange", "Sort", "Window"))
