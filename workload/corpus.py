"""Admission, indexing, ranked search and workspace state over pages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from obsframe.functions import paths as px
from obsframe.functions import text as fx
from obsframe.operators import admission as ad
from obsframe.operators import corpus as co
from obsframe.operators import extract as ex
from obsframe.operators import overlay as ov
from obsframe.operators import search as se
from obsframe.operators import segments as sg
from obsframe.plans import corpus as plans
from obsframe.plans import workspace as ws
from obsframe.session import scratch

from . import sql, tables as t

# Rules exercised on page paths, whose first segment is a language.
RULES = ["# pages", "/fr", "*5", "!/en/*5", "de/**/8*", "es/", "!es/5*", "**/9??", "!en/9*0", "  "]
GLOBS = ["en/1*", "./es/2*/", "7?", "!en", " "]


def path_functions(spark, sf_dir):
    p = t.page_files(spark, sf_dir).withColumn("path", F.concat(F.lit("Src\\"), "path"))
    norm = px.normalize_path("path")
    return p.select(
        "page_id", norm.alias("path"), px.basename(norm).alias("base"), px.extname(norm).alias("ext"),
        px.is_safe_path("path").alias("safe"), F.size(px.segments(norm)).cast("long").alias("segments"),
    )


def exclude_segments(spark, sf_dir):
    return ad.exclude_segments(t.page_files(spark, sf_dir), ["fr", "533", "825"]).select("project_id", "path")


def exclude_globs(spark, sf_dir):
    return ad.exclude_globs(t.page_files(spark, sf_dir), GLOBS).select("project_id", "path")


def apply_ignore_rules(spark, sf_dir):
    return ad.apply_ignore_rules(t.page_files(spark, sf_dir), RULES).select("project_id", "path")


def ignore_rule_tables(spark, sf_dir):
    """Every host has its own rule file: each of its first path segments but English is ignored, .html comes back."""
    files = t.page_files(spark, sf_dir)
    heads = files.select("project_id", F.split("path", "/")[0].alias("h")).distinct()
    rules = heads.filter(F.col("h") != "en").select(
        "project_id", F.ascii("h").alias("rule_idx"), F.concat(F.lit("/"), "h", F.lit("/*")).alias("pattern")
    ).unionByName(
        heads.select("project_id", F.lit(1000).alias("rule_idx"), F.lit("!*.html").alias("pattern")).distinct()
    ).unionByName(heads.select("project_id", F.lit(1001).alias("rule_idx"), F.lit("/**/7*/").alias("pattern")).distinct())
    return ad.apply_ignore_rules(files, rules).select("project_id", "path")


def admit(spark, sf_dir):
    return ad.admit(t.page_files(spark, sf_dir), ["!en/1*", "*0"], ["en/1*"]).select("project_id", "path")


def _raw(spark, sf_dir):
    """pages as raw files: very short or odd ones play missing, unreadable, non-regular and binary files."""
    n = F.length("text")
    return t.page_files(spark, sf_dir).select(
        "project_id", "path", "page_id",
        F.when(n % 11 == 3, F.concat(F.lit(b"\0"), F.col("text").cast("binary"))).otherwise(F.col("text").cast("binary")).alias("content"),
        (n % 11 != 5).alias("present"),
        (n % 11 != 7).alias("is_regular"),
        F.when(n % 11 == 9, F.concat(F.lit("cannot  read "), "path")).alias("read_error"),
    )


def classify_outcome(spark, sf_dir):
    marked = ad.mark_admitted(_raw(spark, sf_dir), ["*5"], ["fr/**"])
    return ad.classify_outcome(marked).select("page_id", "outcome", ad.is_text("content").alias("is_text"))


def language(spark, sf_dir):
    """Documents as source files: the extension follows from language and length."""
    ext = F.element_at(
        F.array(*[F.lit(e) for e in ("ts", "TSX", "mts", "js", "cjs", "java", "md", "py")]),
        (F.col("n_chars") % 8 + 1).cast("int"),
    )
    d = t.table(spark, sf_dir, "documents").select(
        "doc_id", F.concat("lang", F.lit("/."), "source", F.lit("/"), "doc_id", F.lit("."), ext).alias("path")
    )
    return d.select("doc_id", px.extname("path").alias("ext"), px.language("path").alias("language"))


def _indexed(spark, sf_dir):
    return plans.index_files(_raw(spark, sf_dir).drop("page_id"), ["*5"], ["fr/**"])


def index_files(spark, sf_dir):
    f = _indexed(spark, sf_dir)["files"]
    return f.select(
        "project_id", "path", "kind", "language", "content_hash", "size_bytes",
        F.size("lexical_terms").cast("long").alias("terms"),
        (F.size("symbols") + F.size("imports") + F.size("exports") + F.size("dependencies")).cast("long").alias("declared"),
    )


def index_warnings(spark, sf_dir):
    return _indexed(spark, sf_dir)["warnings"]


def warnings_summary(spark, sf_dir):
    return co.warnings_summary(_indexed(spark, sf_dir)["warnings"])


def page_links(spark, sf_dir):
    return ex.page_links(t.page_files(spark, sf_dir))


def _unique_pages(spark, sf_dir):
    """Pages under paths of their own: a host may serve one path more than once."""
    return t.page_files(spark, sf_dir).withColumn("path", F.concat("path", F.lit("@"), "page_id"))


def code_segments(spark, sf_dir):
    """Style rules and scripts inside pages, read as source: one row per file with its brace structure."""
    seg = ex.code_segments(_unique_pages(spark, sf_dir), script=False)
    return seg.groupBy("project_id", "path").agg(
        F.count(F.lit(1)).alias("segments"), F.max("depth").alias("max_depth"), F.max("line").alias("last_line")
    )


def brace_depth(spark, sf_dir):
    from obsframe.operators.ordered import explode_lines

    # Tags play braces, so that depth changes on every line.
    text = F.translate("text", "{}<>", "  {}")
    lines = explode_lines(_unique_pages(spark, sf_dir).select("project_id", "path", text.alias("text")))
    return ex.brace_depth(lines).select("project_id", "path", "line", "depth", "max_depth")


def declarations(spark, sf_dir):
    """Documents as script files with one declaration per line: the symbol table of every file."""
    files = _scripts(spark, sf_dir)
    return ex.ts_symbols(files).select("path", "name", "kind", "signature", "exported", "line")


def _joined(text):
    """All words of a text as one name."""
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)), "_")


def _scripts(spark, sf_dir):
    """Every document line becomes a function named by all its words; the import is named by all words of the text."""
    word = _joined(F.col("text"))
    lines = F.transform(
        F.split("text", "\n"),
        lambda l: F.concat(
            F.lit("export function f"), _joined(l),
            F.lit("(n: string, k = 2): void { use(n, k); }"),
        ),
    )
    head = F.concat(F.lit('import { '), word, F.lit(' as a } from "./'), word, F.lit('.js";'))
    return t.document_files(spark, sf_dir).select(
        "project_id", "path", F.concat(head, F.lit("\n"), F.array_join(lines, "\n")).alias("text"), "doc_id"
    )


def declared_imports(spark, sf_dir):
    return ex.ts_imports(_scripts(spark, sf_dir)).select("path", "source", F.array_join("names", ",").alias("names"), "type_only")


def declared_exports(spark, sf_dir):
    return ex.ts_exports(_scripts(spark, sf_dir)).groupBy("path").agg(
        F.count(F.lit(1)).alias("exports"), F.min("name").alias("first"), F.max("name").alias("last")
    )


def _word_scripts(spark, sf_dir):
    """Every word of a document line becomes a function of that line, which stands behind them whole as a comment."""
    words = lambda l: F.regexp_extract_all(F.lower(l), F.lit("[a-z]+"), F.lit(0))
    function = lambda w: F.concat(F.lit("export function f"), w, F.lit("(n: string, k = 2): void { use(n, k); } "))
    lines = F.transform(
        F.split("text", "\n"), lambda l: F.concat(F.array_join(F.transform(words(l), function), ""), F.lit("// "), l)
    )
    heads = F.transform(
        F.split("text", "\n"),
        lambda l, i: F.concat(F.lit('import { a } from "./'), i + 1, F.lit("/"), F.array_join(words(l), "-"), F.lit('.js"; // '), l),
    )
    # Sources are many times as long as their documents, so rows of one file are brought together before.
    return sg.gathered(t.document_files(spark, sf_dir)).select(
        "project_id", "path", F.array_join(F.concat(heads, lines), "\n").alias("text"), "doc_id", "copies"
    )


def declarations_words(spark, sf_dir):
    return ex.ts_symbols(_word_scripts(spark, sf_dir)).select("path", "name", "kind", "signature", "exported", "line")


def declared_imports_words(spark, sf_dir):
    return ex.ts_imports(_word_scripts(spark, sf_dir)).select("path", "source", F.array_join("names", ",").alias("names"), "type_only")


def declared_exports_words(spark, sf_dir):
    return ex.ts_exports(_word_scripts(spark, sf_dir)).groupBy("path").agg(
        F.count(F.lit(1)).alias("exports"), F.min("name").alias("first"), F.max("name").alias("last")
    )


def java_members_words(spark, sf_dir):
    """Every document becomes a class with a method for each word, the line whole behind its methods as a comment."""
    method = lambda w: F.concat(F.lit("public String m"), w, F.lit("(int n, List<String> k) throws IOException { return k; } "))
    lines = F.transform(
        F.split("text", "\n"),
        lambda l: F.concat(F.array_join(F.transform(F.regexp_extract_all(F.lower(l), F.lit("[a-z]+"), F.lit(0)), method), ""), F.lit("// "), l),
    )
    documents = t.table(spark, sf_dir, "documents").withColumns(
        {"project_id": F.col("source"), "path": F.concat("doc_id", F.lit(".java"))}
    )
    classes = sg.gathered(documents.select("project_id", "path", "text", "doc_id")).select(
        "project_id", "path", "copies",
        F.concat(F.lit("public final class D"), "doc_id", F.lit(" {\n"), F.array_join(lines, "\n"), F.lit("\n}\n")).alias("text"),
    )
    return ex.java_members(classes).select("path", "name", "kind", "signature", "exported", "line", "container")


def _classes(spark, sf_dir):
    """Every document becomes a class with one method per line."""
    methods = F.transform(
        F.split("text", "\n"),
        lambda l: F.concat(
            F.lit("  public String m"), _joined(l),
            F.lit("(int n, List<String> k) throws IOException { return k; }"),
        ),
    )
    head = F.concat(
        F.lit("package doc.p"), "lang", F.lit(";\nimport static java.util."), "source",
        F.lit(".*;\n@Gen(n = {1})\npublic final class D"), "doc_id", F.lit("<T extends Base> implements Doc<T> {\n"),
    )
    d = t.table(spark, sf_dir, "documents")
    return d.select(
        F.col("source").alias("project_id"), F.concat("doc_id", F.lit(".java")).alias("path"),
        F.concat(head, F.array_join(methods, "\n"), F.lit("\n}\n")).alias("text"),
    )


def java_members(spark, sf_dir):
    return ex.java_members(_classes(spark, sf_dir)).select("path", "name", "kind", "signature", "exported", "line", "container")


def java_types(spark, sf_dir):
    rel = F.col("relationships")
    return ex.java_types(_classes(spark, sf_dir)).select(
        "path", "name", "kind", "signature", "line", F.array_join("annotations", ",").alias("annotations"),
        F.array_join("modifiers", ",").alias("modifiers"), F.array_join("type_parameters", ",").alias("type_parameters"),
        F.array_join(rel["implements"], ",").alias("implements"),
    )


def java_imports(spark, sf_dir):
    return ex.java_imports(_classes(spark, sf_dir)).select("path", "source", "static", "wildcard")


def dependencies(spark, sf_dir):
    decl = ex.java_declarations(_classes(spark, sf_dir))
    return ex.dependencies(decl).select("path", "dependency").distinct()


# --- search ------------------------------------------------------------------------------------------


def _records(spark, sf_dir, together=False):
    """Documents as indexed files without declarations, one project per source or all together."""
    files = t.document_files(spark, sf_dir)
    if together:
        files = files.withColumn("project_id", t.one_project())
    empty = {
        "imports": ex.IMPORT_TYPE, "exports": ex.EXPORT_TYPE, "symbols": ex.SYMBOL_TYPE, "dependencies": "array<string>",
    }
    return files.select(
        "project_id", "path", F.lit("lexical").alias("kind"), fx.sha256("text").alias("content_hash"),
        fx.lexical_terms("path", "text").alias("lexical_terms"),
        *[F.array().cast(k).alias(c) for c, k in empty.items()],
        F.lit(None).cast("string").alias("degraded_reason"),
    )


def corpus_stats(spark, sf_dir):
    index = plans.build_index(_records(spark, sf_dir))
    return index.doc_stats.select("project_id", "field", "n_docs", F.round("avg_length", 6).alias("avg_length"))


def term_stats(spark, sf_dir):
    return plans.build_index(_records(spark, sf_dir)).term_stats


def expand_terms(spark, sf_dir):
    return _expanded(spark, sf_dir, t.search_queries(spark, sf_dir))


def expand_terms_passages(spark, sf_dir):
    return _expanded(spark, sf_dir, t.passages(spark, sf_dir))


def _expanded(spark, sf_dir, queries):
    asked = se.split_queries(queries).select("q_term").distinct()
    words = t.document_files(spark, sf_dir).select(F.explode(F.array_distinct(fx.field_tokens("text"))).alias("term")).distinct()
    return se.expand_terms(asked, words).select("q_term", "term", "match", F.round("weight", 6).alias("weight"))


def search_corpus(spark, sf_dir):
    return _found(spark, sf_dir, t.search_queries(spark, sf_dir))


def search_corpus_passages(spark, sf_dir):
    return _found(spark, sf_dir, t.passages(spark, sf_dir))


def _found(spark, sf_dir, queries):
    index = plans.write_index(_records(spark, sf_dir, together=True), scratch(spark))
    return plans.search_corpus(index, queries).select(
        "query_id", F.col("rank").cast("long").alias("rank"), "path", "score"
    )


# --- workspace ---------------------------------------------------------------------------------------


def _base(spark, sf_dir):
    return t.document_files(spark, sf_dir).select("project_id", "path", fx.sha256("text").alias("content_hash"))


def _current(spark, sf_dir):
    """Curation of the documents: bad ones go, toxic ones change, odd sizes turn binary, irregular or ignored."""
    labels = t.table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    docs = t.document_files(spark, sf_dir).join(labels, "doc_id", "left")
    n = F.length("text")
    toxic = F.coalesce(F.col("toxic") == 1, F.lit(False))
    bad = F.coalesce(F.col("quality") == 0, F.lit(False))
    outcome = (
        F.when(bad & toxic, "read-error").when(bad, "missing").when(n > 8000, "non-text").when(n < 60, "non-regular")
        .when(n < 120, "ignored").otherwise("indexed")
    )
    text = F.when(toxic, F.concat("text", F.lit(" [reviewed]"))).otherwise(F.col("text"))
    rows = docs.select("project_id", "path", outcome.alias("outcome"), text.alias("text"))
    added = t.table(spark, sf_dir, "benchmark").select(
        F.lit("src0").alias("project_id"), F.concat(F.lit("new/"), "item_id").alias("path"), F.lit("indexed").alias("outcome"), "text"
    )
    return rows.unionByName(added).select(
        "project_id", "path", "outcome",
        F.when(F.col("outcome").isin("indexed", "non-text"), fx.sha256("text")).alias("content_hash"), "text",
    )


def diff_overlay(spark, sf_dir):
    return ov.diff_overlay(_base(spark, sf_dir), _current(spark, sf_dir))


def _changed(spark, sf_dir):
    """Labelled documents are the listed changes; good ones are tracked."""
    labels = t.table(spark, sf_dir, "labels")
    return t.document_files(spark, sf_dir).join(labels, "doc_id").select(
        "project_id", "path", (F.col("quality") == 1).alias("tracked")
    )


def _previous_dirty(spark, sf_dir):
    return _base(spark, sf_dir).join(
        _current(spark, sf_dir).filter(F.col("outcome").isin("read-error", "ignored")).select("project_id", "path"),
        ["project_id", "path"], "left_semi",
    )


def diff_changed(spark, sf_dir):
    return ov.diff_changed(
        _base(spark, sf_dir), _current(spark, sf_dir), _changed(spark, sf_dir), _previous_dirty(spark, sf_dir)
    )


def paths_to_refresh(spark, sf_dir):
    failed = _current(spark, sf_dir).filter(F.col("outcome") == "read-error")
    return ov.paths_to_refresh(_changed(spark, sf_dir), _previous_dirty(spark, sf_dir), failed)


def carry_forward(spark, sf_dir):
    previous = _base(spark, sf_dir).withColumn("dirty_hash", F.reverse("content_hash"))
    return ov.carry_forward(_current(spark, sf_dir), previous)


def replace_by_key(spark, sf_dir):
    cur = _current(spark, sf_dir)
    updates = cur.filter(F.col("outcome") == "indexed").select("project_id", "path", "content_hash")
    return ov.replace_by_key(_base(spark, sf_dir), updates, cur.filter(F.col("outcome") == "missing"))


def overlay_changed(spark, sf_dir):
    after = _current(spark, sf_dir).filter(F.col("outcome") == "indexed")
    return ov.overlay_changed(_base(spark, sf_dir), after)


def _heads(spark, sf_dir):
    return _base(spark, sf_dir).select("project_id").distinct().withColumn("head", F.concat(F.lit("head-"), "project_id"))


def _workspace(spark, sf_dir):
    cur = _current(spark, sf_dir)
    base = _records(spark, sf_dir)
    empty = base.drop("project_id", "path", "kind", "content_hash", "lexical_terms")
    files = cur.filter(F.col("outcome") == "indexed").select(
        "project_id", "path", F.lit("lexical").alias("kind"), "content_hash", fx.lexical_terms("path", "text").alias("lexical_terms"),
        *[F.lit(None).cast(f.dataType).alias(f.name) if f.name == "degraded_reason" else F.array().cast(f.dataType).alias(f.name) for f in empty.schema],
    )
    outcomes = cur.select("project_id", "path", "outcome", "content_hash")
    warnings = cur.filter(F.col("outcome") == "read-error").select(
        "project_id", "path", F.lit("read-error").alias("code"), F.lit("unreadable").alias("message")
    )
    indexed = {"files": files, "warnings": warnings, "outcomes": outcomes}
    return ws.overlay(base, indexed, _heads(spark, sf_dir), previous_dirty=_previous_dirty(spark, sf_dir))


def overlay(spark, sf_dir):
    w = _workspace(spark, sf_dir)
    files = w.files.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("files"), F.min("path").alias("first_path"), F.max("content_hash").alias("max_hash")
    )
    return files.join(w.revision, "project_id").join(w.freshness, "project_id")


def workspace_revision(spark, sf_dir):
    return ov.workspace_revision(_heads(spark, sf_dir), _base(spark, sf_dir))


def freshness(spark, sf_dir):
    cur = _current(spark, sf_dir)
    none = cur.filter(F.lit(False))
    files = cur.withColumn("degraded_reason", F.when(F.col("outcome") == "non-regular", F.lit("x")))
    failed = cur.filter((F.col("outcome") == "read-error") & F.startswith("path", F.lit("en")))
    return ov.freshness(_heads(spark, sf_dir), none, failed, files, cur)


def _evidence_input(spark, sf_dir, queries=t.search_queries):
    """Passages are asked of the documents and of the passages themselves."""
    files = _records(spark, sf_dir, together=True).select("project_id", "path", "lexical_terms").withColumn(
        "text", F.when(F.startswith("path", F.lit("en")), F.array_join("lexical_terms", "+"))
    )
    asked = queries(spark, sf_dir)
    state = asked.select("project_id").distinct().withColumn("freshness", F.lit("stale"))
    return asked, files, state


def fallback_evidence(spark, sf_dir):
    return _evidence(ov.fallback_evidence(*_evidence_input(spark, sf_dir)))


def fallback_evidence_passages(spark, sf_dir):
    return _evidence(ov.fallback_evidence(*_evidence_input(spark, sf_dir, t.passages)))


def _evidence(out):
    return out.select("query_id", F.col("rank").cast("long").alias("rank"), "kind", "path", fx.sha256("excerpt").alias("excerpt_hash"))


QUERIES = {
    f.__name__: f
    for f in (
        path_functions, exclude_segments, exclude_globs, apply_ignore_rules, ignore_rule_tables, admit, classify_outcome,
        language, index_files, index_warnings, warnings_summary, page_links, code_segments, brace_depth, declarations,
        declarations_words, declared_imports_words, declared_exports_words, java_members_words,
        declared_imports, declared_exports, java_types, java_members, java_imports, dependencies, corpus_stats, term_stats,
        expand_terms, expand_terms_passages, search_corpus, search_corpus_passages, diff_overlay, diff_changed, paths_to_refresh, carry_forward, replace_by_key,
        overlay_changed, overlay, workspace_revision, freshness, fallback_evidence, fallback_evidence_passages,
    )
}

_PAGES = f"WITH {sql.PAGE_FILES}"
_DOCS = f"WITH {sql.DOCUMENT_FILES}"
# Each rule as (regex, negated, directory only, whole path), written out by hand.
_RULES = [
    ("^fr$", False, False, True), ("^[^/]*5$", False, False, False), ("^en/[^/]*5$", True, False, True),
    ("^de/(.*/)?8[^/]*$", False, False, True), ("^es$", False, True, False), ("^es/5[^/]*$", True, False, True),
    ("^(.*/)?9[^/][^/]$", False, False, True), ("^en/9[^/]*0$", True, False, True),
]


def _ignored(rules: str, name: str = "ignored") -> str:
    """CTEs: every leading part of a path against every rule; the last match decides; any ignored part hides the path."""
    return f"""parts AS (
  SELECT project_id, path, s, i, array_to_string(s[1:i], '/') AS prefix, s[i] AS segment, i < len(s) AS is_dir
  FROM (SELECT project_id, path, s, unnest(generate_series(1, len(s))) AS i
        FROM (SELECT project_id, path, list_filter(string_split(path, '/'), lambda x: x <> '') AS s FROM files))),
verdicts AS (
  SELECT p.project_id, p.path, p.i, arg_max(r.negated, r.idx) AS negated FROM parts p JOIN ({rules}) r
    ON (r.project_id IS NULL OR r.project_id = p.project_id) AND (p.is_dir OR NOT r.dir_only)
   AND regexp_matches(CASE WHEN r.whole THEN p.prefix ELSE p.segment END, r.regex)
  GROUP BY 1, 2, 3),
{name} AS (SELECT DISTINCT project_id, path FROM verdicts WHERE NOT negated)"""


def _rule_rows(rules) -> str:
    return " UNION ALL ".join(
        f"SELECT NULL AS project_id, {i} AS idx, {sql.quote(r)} AS regex, {n} AS negated, {d} AS dir_only, {w} AS whole"
        for i, (r, n, d, w) in enumerate(rules)
    )


_RULE_TABLES = """SELECT DISTINCT project_id, ascii(h) AS idx, '^' || h || '/[^/]*$' AS regex, false AS negated, false AS dir_only, true AS whole
  FROM (SELECT project_id, split_part(path, '/', 1) AS h FROM files) WHERE h <> 'en'
  UNION ALL SELECT DISTINCT project_id, 1000, '^[^/]*\\.html$', true, false, false FROM files
  UNION ALL SELECT DISTINCT project_id, 1001, '^(.*/)?7[^/]*$', false, true, true FROM files"""
_FIVE = _ignored(_rule_rows([("^[^/]*5$", False, False, False)]))
_RAW = f"""{_PAGES}, {_FIVE}, raw AS (
  SELECT f.*, length(text) % 11 AS r, regexp_matches(f.path, '^fr/.*$') OR i.path IS NOT NULL AS out_
  FROM files f LEFT JOIN ignored i ON i.project_id = f.project_id AND i.path = f.path),
judged AS (SELECT *, CASE WHEN out_ THEN 'ignored' WHEN r = 5 THEN 'missing' WHEN r = 7 THEN 'non-regular' WHEN r = 9 THEN 'read-error'
  WHEN r = 3 THEN 'non-text' ELSE 'indexed' END AS outcome FROM raw)"""
_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_$-]{{2,}}')"
_TERMS = rf"""lex0 AS (SELECT project_id, path, unnest(w) AS term, generate_subscripts(w, 1) AS i
    FROM (SELECT project_id, path, {_WORDS.format("path || ' ' || text")} AS w FROM files)),
lex AS (SELECT *, row_number() OVER (PARTITION BY project_id, path ORDER BY i) AS rn
        FROM (SELECT project_id, path, term, min(i) AS i FROM lex0 GROUP BY 1, 2, 3))"""
_LINES = """ln AS (SELECT *, array_to_string(regexp_extract_all(lower(l), '[a-z]+'), '_') AS w FROM (
    SELECT project_id, path, doc_id, text, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM files))"""
_CLASSES = """ln AS (SELECT *, array_to_string(regexp_extract_all(lower(l), '[a-z]+'), '_') AS w FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))"""

_ACCENTS = ("ßäçèéêíñóöü", "ABCDEFGHIJK")


def _plain(c: str) -> str:
    """Terms are lower case, so capitals can stand for the accented letters: edit distance here counts bytes."""
    return f"translate({c}, '{_ACCENTS[0]}', '{_ACCENTS[1]}')"


def _postings(project: str) -> str:
    token = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
    return rf"""f AS (
  SELECT {project} AS project_id, path, 'path' AS field, {token.format("path")} AS tokens FROM files
  UNION ALL SELECT {project}, path, 'fileName', {token.format("split_part(path, '/', -1)")} FROM files
  UNION ALL SELECT {project}, path, 'terms', {token.format("string_agg(term, ' ')")} FROM lex GROUP BY 1, 2),
p AS (SELECT project_id, path, field, term, len, count(*) AS tf FROM (
        SELECT project_id, path, field, len(tokens) AS len, unnest(tokens) AS term FROM f) GROUP BY ALL),
nd AS (SELECT {project} AS project_id, count(*) AS n FROM files GROUP BY 1),
ds AS (SELECT project_id, field, any_value(n) AS n_docs, sum(tf) / any_value(n) AS avg_length FROM p JOIN nd USING (project_id) GROUP BY 1, 2),
ts AS (SELECT project_id, field, term, count(*) AS df FROM p GROUP BY 1, 2, 3)"""


_ASKED = rf"""{sql.QUERIES}, qt AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '[\p{{L}}\p{{N}}]+')) AS q_term FROM queries)"""


def _expansion(vocabulary: str) -> str:
    return f"""qd AS (SELECT DISTINCT q_term, length(q_term) AS n, (15 * length(q_term) + 50) // 100 AS d FROM qt),
voc AS (SELECT DISTINCT term, length(term) AS m FROM {vocabulary}),
pairs AS (
  SELECT q_term, term, CASE WHEN q_term = term THEN 'exact' ELSE 'prefix' END AS match,
         CASE WHEN q_term = term THEN 1.0::DOUBLE ELSE 0.5::DOUBLE * n / m END AS weight FROM qd JOIN voc ON starts_with(term, q_term)
  UNION ALL
  SELECT q_term, term, 'fuzzy', 0.5::DOUBLE * (1 - levenshtein({_plain("term")}, {_plain("q_term")})::DOUBLE / n)
  FROM qd JOIN voc ON abs(n - m) <= d AND d > 0 AND q_term <> term AND levenshtein({_plain("term")}, {_plain("q_term")}) <= d),
expanded AS (SELECT q_term, term, arg_max(match, struct_pack(w := weight, m := match)) AS match, max(weight) AS weight FROM pairs GROUP BY 1, 2)"""


_CURRENT = f"""{_DOCS}, cur0 AS (
  SELECT f.*, coalesce(toxic = 1, false) AS toxic_, coalesce(quality = 0, false) AS bad, quality, length(text) AS n
  FROM files f LEFT JOIN labels USING (doc_id)),
cur AS (
  SELECT project_id, path, outcome, CASE WHEN outcome IN ('indexed', 'non-text') THEN sha256(t) END AS content_hash, t AS text FROM (
    SELECT project_id, path, CASE WHEN bad AND toxic_ THEN 'read-error' WHEN bad THEN 'missing' WHEN n > 8000 THEN 'non-text'
             WHEN n < 60 THEN 'non-regular' WHEN n < 120 THEN 'ignored' ELSE 'indexed' END AS outcome,
           CASE WHEN toxic_ THEN text || ' [reviewed]' ELSE text END AS t FROM cur0
    UNION ALL SELECT 'src0', 'new/' || item_id, 'indexed', text FROM benchmark)),
base AS (SELECT project_id, path, sha256(text) AS h FROM files),
changed AS (SELECT project_id, path, quality = 1 AS tracked FROM files JOIN labels USING (doc_id)),
prev AS (SELECT b.* FROM base b JOIN cur c USING (project_id, path) WHERE outcome IN ('read-error', 'ignored')),
diff AS (
  SELECT coalesce(b.project_id, c.project_id) AS project_id, coalesce(b.path, c.path) AS path, coalesce(outcome, 'missing') AS outcome,
    CASE WHEN outcome = 'indexed' AND content_hash IS DISTINCT FROM h THEN content_hash
         WHEN h IS NULL THEN NULL WHEN coalesce(outcome, 'missing') = 'missing' THEN 'deleted' WHEN outcome = 'non-text' THEN content_hash
         WHEN outcome = 'non-regular' THEN sha256('non-regular' || chr(0) || b.path) END AS dirty_hash
  FROM base b FULL JOIN cur c ON b.project_id = c.project_id AND b.path = c.path)"""


def _revision(dirty: str) -> str:
    return f"""SELECT h.project_id, sha256('head-' || h.project_id || coalesce(chr(0) || string_agg(d.b || chr(0) || d.hash, chr(0) ORDER BY d.b), ''))
        AS workspace_revision FROM (SELECT DISTINCT project_id FROM base) h LEFT JOIN (
          SELECT project_id, substr(md5(path), 1, 3) AS b, sha256(string_agg(path || chr(0) || hash, chr(0) ORDER BY path::BLOB)) AS hash
          FROM ({dirty}) GROUP BY ALL) d USING (project_id) GROUP BY 1"""


ORACLES = {
    "path_functions": rf"""{_PAGES} SELECT page_id, 'Src/' || path AS path, split_part('Src/' || path, '/', -1) AS base,
        coalesce(lower(regexp_extract('Src/' || path, '[^./](\.[^./]*)$', 1)), '') AS ext,
        NOT list_contains(string_split('Src/' || path, '/'), '..') AS safe, len(string_split('Src/' || path, '/'))::BIGINT AS segments FROM files""",
    "exclude_segments": f"""{_PAGES} SELECT project_id, path FROM files
        WHERE NOT list_has_any(string_split(path, '/'), ['fr', '533', '825'])""",
    "exclude_globs": f"""{_PAGES} SELECT project_id, path FROM files WHERE NOT regexp_matches(path, '^en/1[^/]*$')
        AND NOT regexp_matches(path, '^es/2[^/]*/.*') AND NOT regexp_matches(path, '(^|.*/)7[^/]$')""",
    "apply_ignore_rules": f"""{_PAGES}, {_ignored(_rule_rows(_RULES))} SELECT project_id, path FROM files ANTI JOIN ignored USING (project_id, path)""",
    "ignore_rule_tables": f"""{_PAGES}, {_ignored(_RULE_TABLES)} SELECT project_id, path FROM files ANTI JOIN ignored USING (project_id, path)""",
    "admit": f"""{_PAGES}, {_ignored(_rule_rows([("^en/1[^/]*$", True, False, True), ("^[^/]*0$", False, False, False)]))}
        SELECT project_id, path FROM files ANTI JOIN ignored USING (project_id, path) WHERE NOT regexp_matches(path, '^en/1[^/]*$')""",
    "classify_outcome": f"{_RAW} SELECT page_id, outcome, r <> 3 AS is_text FROM judged",
    "language": """SELECT doc_id, ['.ts', '.tsx', '.mts', '.js', '.cjs', '.java', '.md', '.py'][n_chars % 8 + 1] AS ext,
        ['typescript', 'typescript', 'typescript', 'javascript', 'javascript', 'java', 'text', 'text'][n_chars % 8 + 1] AS language FROM documents""",
    "index_files": rf"""{_RAW}, w AS (SELECT project_id, path, count(DISTINCT term) AS terms FROM (
          SELECT project_id, path, unnest({_WORDS.format("path || ' ' || text")}) AS term FROM judged WHERE outcome = 'indexed') GROUP BY 1, 2)
        SELECT project_id, path, 'lexical' AS kind, 'text' AS language, sha256(text) AS content_hash, strlen(text)::BIGINT AS size_bytes,
               terms, 0::BIGINT AS declared FROM judged JOIN w USING (project_id, path) WHERE outcome = 'indexed'""",
    "index_warnings": f"{_RAW} SELECT project_id, path, 'read-error' AS code, 'cannot read ' || path AS message FROM judged WHERE outcome = 'read-error'",
    "warnings_summary": f"{_RAW} SELECT project_id, 'read-error' AS code, count(*) AS n FROM judged WHERE outcome = 'read-error' GROUP BY 1",
    "page_links": rf"""{_PAGES} SELECT DISTINCT project_id, path, unnest(regexp_extract_all(text, 'href="([^"]*)"', 1)) AS dependency FROM files""",
    "brace_depth": r"""WITH RECURSIVE """ + sql.PAGE_FILES + r""",
        b AS (SELECT project_id, path, line, [CASE x WHEN '>' THEN -1 ELSE 1 END for x in regexp_extract_all(t, '[<>]')] AS steps FROM (
            SELECT project_id, path || '@' || page_id AS path, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM files)),
        c AS (SELECT project_id, path, line, unnest(steps) AS step, generate_subscripts(steps, 1) AS i FROM b),
        s AS (SELECT *, sum(step) OVER (PARTITION BY project_id, path ORDER BY line, i) AS run FROM c),
        d AS (SELECT *, run - least(0, min(run) OVER (PARTITION BY project_id, path ORDER BY line, i)) AS depth FROM s),
        e AS (SELECT project_id, path, line, arg_max(depth, i) AS depth, max(depth) AS peak FROM d GROUP BY 1, 2, 3)
        SELECT b.project_id, b.path, b.line, coalesce(last_value(e.depth IGNORE NULLS) OVER w, 0)::BIGINT AS depth,
               coalesce(max(e.peak) OVER w, 0)::BIGINT AS max_depth
        FROM b LEFT JOIN e USING (project_id, path, line) WINDOW w AS (PARTITION BY b.project_id, b.path ORDER BY b.line)""",
    "declarations": f"""{_DOCS}, {_LINES} SELECT path, 'f' || w AS name, 'function' AS kind,
        'function f' || w || '(n: string, k?: number): void' AS signature, true AS exported, (i + 1)::BIGINT AS line FROM ln""",
    "declared_imports": """SELECT lang || '/' || doc_id || '.txt' AS path, './' || w || '.js' AS source, CASE WHEN w = '' THEN 'as a' ELSE 'a' END AS names,
        false AS type_only FROM (SELECT *, array_to_string(regexp_extract_all(lower(text), '[a-z]+'), '_') AS w FROM documents)""",
    "declared_exports": f"{_DOCS}, {_LINES} SELECT path, count(*) AS exports, min('f' || w) AS first, max('f' || w) AS last FROM ln GROUP BY 1",
    "java_types": """SELECT doc_id || '.java' AS path, 'D' || doc_id AS name, 'class' AS kind,
        'public final class D' || doc_id || '<T extends Base> implements Doc<T>' AS signature, 4::BIGINT AS line, 'Gen' AS annotations,
        'public,final' AS modifiers, 'T extends Base' AS type_parameters, 'Doc<T>' AS implements FROM documents""",
    "java_members": f"""WITH {_CLASSES} SELECT doc_id || '.java' AS path, 'm' || w AS name, 'method' AS kind,
        'public String m' || w || '(int n, List<String> k) throws IOException' AS signature, true AS exported, (i + 4)::BIGINT AS line,
        'D' || doc_id AS container FROM ln""",
    "java_imports": """SELECT doc_id || '.java' AS path, 'java.util.' || source AS source, true AS static, true AS wildcard FROM documents""",
    "dependencies": """SELECT doc_id || '.java' AS path, unnest(['java.util.' || source, 'Doc<T>', 'Doc', 'Base']) AS dependency FROM documents""",
    "corpus_stats": f"{_DOCS}, {_TERMS}, {_postings('project_id')} SELECT project_id, field, n_docs, round(avg_length, 6) AS avg_length FROM ds",
    "term_stats": f"{_DOCS}, {_TERMS}, {_postings('project_id')} SELECT project_id, field, term, df FROM ts",
    "expand_terms": rf"""WITH {_ASKED}, words AS (SELECT unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM documents),
        {_expansion("words")} SELECT q_term, term, match, round(weight, 6) AS weight FROM expanded""",
    "search_corpus": f"""{_DOCS}, {_TERMS}, {_postings("'documents'")}, {_ASKED}, {_expansion("ts")},
        weighted AS (SELECT query_id, field, e.term, sum(weight * CASE field WHEN 'fileName' THEN 3.0 WHEN 'path' THEN 2.5 ELSE 1.0 END
              * ln(1 + (n_docs - df + 0.5) / (df + 0.5))) AS w, any_value(avg_length) AS avg_length
            FROM qt JOIN expanded e USING (q_term) JOIN ts USING (term) JOIN ds USING (project_id, field) GROUP BY 1, 2, 3),
        scores AS (SELECT query_id, path, round(sum(w * (1.0 + tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_length)))), 6) AS score
            FROM p JOIN weighted USING (field, term) GROUP BY 1, 2),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM scores)
        SELECT query_id, rank, path, score FROM ranked WHERE rank <= 10""",
    "diff_overlay": f"""{_CURRENT} SELECT *, CASE WHEN outcome = 'read-error' THEN 'pending' WHEN dirty_hash IS NOT NULL THEN 'dirty' ELSE 'clean' END
        AS status FROM diff""",
    "diff_changed": f"""{_CURRENT}, r AS (SELECT project_id, path FROM changed UNION SELECT project_id, path FROM prev
          UNION SELECT project_id, path FROM cur WHERE outcome = 'read-error')
        SELECT r.project_id, r.path, coalesce(outcome, 'missing') AS outcome,
          CASE WHEN outcome = 'read-error' AND p.h IS NOT NULL THEN p.h WHEN tracked IS NULL THEN NULL WHEN outcome = 'indexed' THEN content_hash
               WHEN coalesce(outcome, 'missing') = 'missing' THEN 'deleted' WHEN outcome = 'non-text' AND tracked THEN content_hash
               WHEN outcome = 'non-regular' AND tracked THEN sha256('non-regular' || chr(0) || r.path) END AS dirty_hash
        FROM r LEFT JOIN cur USING (project_id, path) LEFT JOIN changed USING (project_id, path) LEFT JOIN prev p USING (project_id, path)""",
    "paths_to_refresh": f"""{_CURRENT} SELECT project_id, path FROM changed UNION SELECT project_id, path FROM prev
        UNION SELECT project_id, path FROM cur WHERE outcome = 'read-error'""",
    "carry_forward": f"""{_CURRENT} SELECT project_id, path, outcome, CASE WHEN outcome = 'read-error' THEN h ELSE content_hash END AS content_hash,
        CASE WHEN outcome = 'read-error' THEN reverse(h) END AS dirty_hash, outcome = 'read-error' AS pending,
        outcome = 'read-error' AND h IS NOT NULL AS carried FROM cur LEFT JOIN base USING (project_id, path)""",
    "replace_by_key": f"""{_CURRENT} SELECT project_id, path, content_hash FROM cur WHERE outcome = 'indexed'
        UNION ALL SELECT project_id, path, h FROM base WHERE (project_id, path) NOT IN (SELECT (project_id, path) FROM cur WHERE outcome IN ('indexed', 'missing'))""",
    "overlay_changed": f"""{_CURRENT}, a AS (SELECT project_id, path, content_hash AS h FROM cur WHERE outcome = 'indexed')
        SELECT project_id, count(*) AS changed_rows FROM ((FROM base EXCEPT FROM a) UNION ALL (FROM a EXCEPT FROM base)) GROUP BY 1""",
    "overlay": f"""{_CURRENT}, fx AS (SELECT project_id, path, content_hash AS h FROM cur WHERE outcome = 'indexed'
          UNION ALL SELECT b.* FROM base b JOIN cur USING (project_id, path) WHERE outcome = 'read-error'),
        dirty AS (SELECT project_id, path, dirty_hash AS hash FROM diff WHERE dirty_hash IS NOT NULL
          UNION ALL SELECT p.project_id, p.path, p.h FROM prev p JOIN cur USING (project_id, path) WHERE outcome = 'read-error'),
        rev AS ({_revision("SELECT * FROM dirty")})
        SELECT project_id, count(*) AS files, min(path) AS first_path, max(h) AS max_hash, any_value(workspace_revision) AS workspace_revision,
          CASE WHEN project_id IN (SELECT project_id FROM cur WHERE outcome = 'read-error') THEN 'stale'
               WHEN project_id IN (SELECT project_id FROM dirty) THEN 'dirty' ELSE 'fresh' END AS freshness
        FROM fx JOIN rev USING (project_id) GROUP BY 1""",
    "workspace_revision": f"{_CURRENT} {_revision('SELECT project_id, path, h AS hash FROM base')}",
    "freshness": f"""{_CURRENT} SELECT project_id, CASE WHEN bool_or(outcome = 'read-error' AND starts_with(path, 'en')) THEN 'stale'
        WHEN bool_or(outcome = 'non-regular') THEN 'unsupported' ELSE 'dirty' END AS freshness FROM cur GROUP BY 1""",
    "fallback_evidence": rf"""{_DOCS}, {_TERMS}, {sql.QUERIES},
        q AS (SELECT DISTINCT query_id, unnest({_WORDS.format("query")}) AS term FROM queries),
        m AS (SELECT DISTINCT query_id, path FROM q JOIN lex USING (term)),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY path) AS rank FROM m),
        fe AS (SELECT path, string_agg(term, '+' ORDER BY i) AS full_,
                     string_agg(term, ' ' ORDER BY i) FILTER (rn <= 40) AS head FROM lex GROUP BY path),
        e AS (SELECT path, sha256(CASE WHEN starts_with(path, 'en') THEN substr(full_, 1, 4096) ELSE head END) AS x FROM fe),
        hit AS (SELECT query_id, rank, path FROM r WHERE rank <= 3
                UNION ALL SELECT query_id, 1, (SELECT min(path) FROM files) FROM queries WHERE query_id NOT IN (SELECT query_id FROM m))
        SELECT query_id, rank, 'source' AS kind, path, x AS excerpt_hash FROM hit JOIN e USING (path)""",
}

_LINE_WORDS = """lw AS (SELECT *, regexp_extract_all(lower(l), '[a-z]+') AS ws FROM (
    SELECT doc_id, lang || '/' || doc_id || '.txt' AS path, unnest(string_split(text, chr(10))) AS l,
           generate_subscripts(string_split(text, chr(10)), 1) AS i, len(string_split(text, chr(10))) AS n FROM documents)),
wl AS (SELECT doc_id, path, i, n, unnest(ws) AS w FROM lw)"""
ORACLES |= {
    f"{name}_passages": sql.asked_whole(ORACLES[name]) for name in ("expand_terms", "search_corpus", "fallback_evidence")
} | {
    "declarations_words": f"""WITH {_LINE_WORDS} SELECT path, 'f' || w AS name, 'function' AS kind,
        'function f' || w || '(n: string, k?: number): void' AS signature, true AS exported, (n + i)::BIGINT AS line FROM wl""",
    "declared_imports_words": f"""WITH {_LINE_WORDS} SELECT path, './' || i || '/' || array_to_string(ws, '-') || '.js' AS source,
        'a' AS names, false AS type_only FROM lw""",
    "declared_exports_words": f"""WITH {_LINE_WORDS} SELECT path, count(*) AS exports, min('f' || w) AS first, max('f' || w) AS last FROM wl GROUP BY 1""",
    "java_members_words": f"""WITH {_LINE_WORDS} SELECT doc_id || '.java' AS path, 'm' || w AS name, 'method' AS kind,
        'public String m' || w || '(int n, List<String> k) throws IOException' AS signature, true AS exported, (i + 1)::BIGINT AS line,
        'D' || doc_id AS container FROM wl""",
}
