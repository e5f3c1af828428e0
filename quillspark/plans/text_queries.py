"""Queries over text functions, readers' steps and names, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators import relational, retrieval
from quillspark.plans.tables import table
from quillspark.sources import readers, writers

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("normalize_code", r"""
WITH d AS (SELECT doc_id, chr(10) || '  ' || chr(10) || replace(text, ' | ', '  ' || chr(9) || chr(10)) || ' ' || chr(9) || chr(10) || chr(10) AS t FROM documents),
r AS (SELECT doc_id, array_to_string(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '[ \t\n\r\x0B\f\x1C-\x1F]+$', '')), chr(10)) AS j FROM d)
SELECT doc_id, md5(regexp_replace(j, '^\n+|\n+$', '', 'g')) AS digest, CAST(length(regexp_replace(j, '^\n+|\n+$', '', 'g')) AS BIGINT) AS n FROM r""")
def normalize_code(spark, sf_dir):
    t = F.concat(F.lit("\n  \n"), F.replace("text", F.lit(" | "), F.lit("  \t\n")), F.lit(" \t\n\n"))
    out = X.normalize_code(t)
    return table(spark, sf_dir, "documents").select("doc_id", out.alias("o")).select("doc_id", F.md5("o").alias("digest"), F.length("o").cast("long").alias("n"))


@query("nonblank_lines", r"""
WITH d AS (SELECT doc_id, list_filter(list_transform(string_split(replace(text, '. ', '.' || chr(10) || ' ' || chr(10)), chr(10)), lambda x: regexp_replace(x, '[ \t\n\r\x0B\f\x1C-\x1F]+$', '')), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, md5(array_to_string(l, chr(10))) AS digest FROM d""")
def nonblank_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", X.nonblank_lines(F.replace("text", F.lit(". "), F.lit(".\n \n"))).alias("l"))
    return rows.select("doc_id", F.size("l").cast("long").alias("n_lines"), F.md5(F.array_join("l", "\n")).alias("digest"))


@query("clean_ocr", r"""
SELECT doc_id, md5(regexp_replace(replace(replace(chr(10) || chr(10) || '<|begin_of_box|>' || text || '<|end_of_box|>' || chr(10), '<|begin_of_box|>', ''), '<|end_of_box|>', ''), '^\n+|\n+$', '', 'g')) AS digest FROM documents""")
def clean_ocr(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.clean_ocr(F.concat(F.lit("\n\n<|begin_of_box|>"), "text", F.lit("<|end_of_box|>\n")))).alias("digest"))


@query("render_text", r"""
WITH d AS (SELECT doc_id, replace(replace(replace(text, ' | ', chr(9)), ', ', ' – '), '. ', '… —') AS t FROM documents)
SELECT doc_id, md5(replace(replace(replace(replace(replace(t, chr(9), '    '), chr(10), '⏎'), '–', '-'), '—', '--'), '…', '...')) AS digest FROM d""")
def render_text(spark, sf_dir):
    t = F.replace(F.replace(F.replace("text", F.lit(" | "), F.lit("\t")), F.lit(", "), F.lit(" – ")), F.lit(". "), F.lit("… —"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.render_text(t, preserve_newlines=False)).alias("digest"))


@query("symbol_loss_flags", r"""
WITH d AS (SELECT lang, text AS r, CASE WHEN doc_id % 2 = 0 THEN translate(text, '.', '') ELSE text END AS h FROM documents),
s AS (SELECT lang, length(r) - length(translate(r, '()[]{},.:;=', '')) AS a, length(h) - length(translate(h, '()[]{},.:;=', '')) AS b FROM d)
SELECT lang, count(*) AS n, count(*) FILTER (a > 0 AND b < 0.8e0 * a) AS lost, CAST(sum(a) AS BIGINT) AS symbols FROM s GROUP BY lang""")
def symbol_loss_flags(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", F.col("text").alias("r"), F.when(F.col("doc_id") % 2 == 0, F.translate("text", ".", "")).otherwise(F.col("text")).alias("h"))
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(X.symbol_loss(F.col("r"), F.col("h"))).alias("lost"), F.sum(X.symbol_count(F.col("r"))).cast("long").alias("symbols"))


@query("extract_code", r"""
WITH c AS (SELECT conv_id, turn, trim(text, chr(32) || chr(9) || chr(10) || chr(13)) AS s, CASE turn % 4
  WHEN 0 THEN 'note' || chr(10) || '```python' || chr(10) || text || chr(10) || '```' || chr(10) || 'end'
  WHEN 1 THEN '<|begin_of_box|> ' || text || ' <|end_of_box|>' WHEN 2 THEN '  ' || text || chr(10)
  ELSE '```' || chr(10) || 'first' || chr(10) || '```' || chr(10) || 'then' || chr(10) || '```python' || chr(10) || text || chr(10) || '```' END AS t FROM conversations)
SELECT conv_id, turn, md5(CASE WHEN s = '' THEN trim(t, chr(32) || chr(9) || chr(10) || chr(13)) ELSE s END) AS digest FROM c""")
def extract_code(spark, sf_dir):
    f = X.FENCE
    kinds = [F.concat(F.lit(f"note\n{f}python\n"), "text", F.lit(f"\n{f}\nend")), F.concat(F.lit(X.BOX_OPEN + " "), "text", F.lit(" " + X.BOX_CLOSE)), F.concat(F.lit("  "), "text", F.lit("\n"))]
    t = F.when(F.col("turn") % 4 == 0, kinds[0]).when(F.col("turn") % 4 == 1, kinds[1]).when(F.col("turn") % 4 == 2, kinds[2]).otherwise(F.concat(F.lit(f"{f}\nfirst\n{f}\nthen\n{f}python\n"), "text", F.lit(f"\n{f}")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(X.extract_code(t)).alias("digest"))


@query("extract_letter", r"""
WITH c AS (SELECT conv_id, turn, substr('ABCDEFGH', CAST(length(text) % 8 + 1 AS INTEGER), 1) AS l FROM conversations)
SELECT conv_id, turn, CASE WHEN turn % 6 = 5 THEN NULL ELSE l END AS letter FROM c""")
def extract_letter(spark, sf_dir):
    letter = F.substring(F.lit("ABCDEFGH"), (F.length("text") % 8 + 1).cast("int"), F.lit(1))
    said = F.array(F.concat(F.lit('{"answer": "'), F.lower(letter), F.lit('"}')), letter, F.concat(F.lit("The answer is: "), letter, F.lit(". Sure.")), F.concat(F.lit("("), letter, F.lit(")")), F.concat(F.lit("Option "), letter, F.lit(" is correct")), F.lit("none of these"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.answer_letter(F.element_at(said, (F.col("turn") % 6 + 1).cast("int"))).alias("letter"))


@query("extract_json", r"""
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 2 = 0 END AS same,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def extract_json(spark, sf_dir):
    f = X.FENCE
    body = F.concat(F.lit('{"is_same": '), F.when(F.col("event_id") % 2 == 0, "true").otherwise("false"), F.lit("}"))
    said = F.when(F.col("event_id") % 5 == 0, F.lit("{not json")).when(F.col("event_id") % 5 == 1, F.concat(F.lit(f"{f}json\n"), body, F.lit(f"\n{f}"))).when(F.col("event_id") % 5 == 2, F.concat(F.lit(X.BOX_OPEN), body, F.lit(X.BOX_CLOSE))).otherwise(body)
    return table(spark, sf_dir, "events").select("event_id", X.json_flag(said, "is_same").alias("same"), F.get_json_object(X.json_text(F.col("props")), "$.k").cast("long").alias("k"))


@query("file_names", r"""
SELECT page_id, CASE WHEN trim(url) = '' THEN 'model' ELSE substr(regexp_replace(trim(url), '[^a-zA-Z0-9._-]+', '_', 'g'), 1, 80) END AS safe, replace(url, '/', '_') AS flat,
  'dataset_' || substr(regexp_replace(trim(url), '[^a-zA-Z0-9._-]+', '_', 'g'), 1, 80) || '.json' AS dataset, 'page_' || lpad(CAST(page_id AS VARCHAR), CAST(greatest(3, length(CAST(page_id AS VARCHAR))) AS INTEGER), '0') || '_ratio1.5.png' AS png FROM pages""")
def file_names(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", X.safe_filename(url).alias("safe"), X.flat_filename(url).alias("flat"), writers.dataset_name(url).alias("dataset"), writers.page_name(F.col("page_id"), F.lit(1.5)).alias("png"))


@query("page_groups", r"""
WITH p AS (SELECT 'case' || (page_id % 40) AS code_id, CASE page_id % 3 WHEN 0 THEN 1.0e0 WHEN 1 THEN 1.5e0 ELSE 2.0e0 END AS ratio, page_id,
  'out/case' || (page_id % 40) || '/img/page_' || lpad(CAST(page_id AS VARCHAR), CAST(greatest(3, length(CAST(page_id AS VARCHAR))) AS INTEGER), '0') || CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN '_ratio1.5' ELSE '_ratio2' END || '.png' AS path FROM pages)
SELECT code_id, ratio, CAST(count(*) AS INTEGER) AS num_pages, string_agg(path, '|' ORDER BY page_id) AS paths FROM p GROUP BY code_id, ratio""")
def page_groups(spark, sf_dir):
    part = F.element_at(F.array(F.lit(""), F.lit("_ratio1.5"), F.lit("_ratio2")), (F.col("page_id") % 3 + 1).cast("int"))
    path = F.concat(F.lit("out/case"), (F.col("page_id") % 40).cast("string"), F.lit("/img/"), F.format_string("page_%03d", "page_id"), part, F.lit(".png"))
    return relational.page_groups(table(spark, sf_dir, "pages").select(path.alias("path"))).select("code_id", "ratio", "num_pages", F.array_join("image_paths", "|").alias("paths"))


@query("pending_cases", """
WITH c AS (SELECT doc_id, r.ratio FROM documents, (VALUES (1.0e0), (2.0e0), (4.0e0)) r(ratio)),
n AS (SELECT DISTINCT doc_id, CASE WHEN quality = 1 THEN 1.0e0 ELSE 2.0e0 END AS ratio FROM labels)
SELECT c.doc_id, c.ratio FROM c WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.doc_id = c.doc_id AND n.ratio = c.ratio)""")
def pending_cases(spark, sf_dir):
    cases = relational.expand_ratios(table(spark, sf_dir, "documents").select("doc_id"), (1, 2, 4))
    done = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, 1.0).otherwise(2.0).alias("ratio"))
    return relational.pending(cases, done, ("doc_id", "ratio"))


@query("done_keys", """
SELECT DISTINCT k AS done_key FROM (SELECT unnest([url, CAST(page_id % 100 AS VARCHAR) || '|2.0']) AS k FROM pages)""")
def done_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(F.col("url").alias("image_path"), (F.col("page_id") % 100).alias("code_id"), F.lit(2.0).alias("ratio"))
    return relational.done_keys(rows)


_PAIR_SQL = r"""
WITH f AS (SELECT conv_id, turn, chr(10) || chr(10) || chr(10) || replace(text, '. ', '.' || chr(10) || CASE WHEN turn % 3 = 0 THEN chr(10) || ' ' || chr(10) ELSE chr(10) END) || chr(10) || chr(10) || ' ' || chr(10) || 'role ' || role || chr(10) || chr(10) || chr(10) || chr(10) || 'last block' AS t FROM conversations),
l AS (SELECT conv_id, turn, array_to_string(list_transform(string_split(t, chr(10)), lambda x: CASE WHEN trim(x, chr(32) || chr(9) || chr(13)) = '' THEN '' ELSE x END), chr(10)) AS t FROM f),
b AS (SELECT conv_id, turn, list_transform(list_filter(string_split_regex(t, '\n\n\n+'), lambda x: replace(x, chr(10), '') <> ''), lambda x: trim(regexp_replace(x, '\n+', chr(10), 'g'), chr(10))) AS b FROM l)
"""


@query("split_pair", _PAIR_SQL + "SELECT conv_id, turn, md5(b[1]) AS left_digest, b[2] AS right_text FROM b")
def split_pair(spark, sf_dir):
    """Every conversation turn as a file whose sentences are blocks: one blank line apart, or two and more."""
    gap = F.when(F.col("turn") % 3 == 0, F.lit(".\n\n \n")).otherwise(F.lit(".\n\n"))
    t = F.concat(F.lit("\n\n\n"), F.replace(F.col("text"), F.lit(". "), gap), F.lit("\n\n \nrole "), "role", F.lit("\n\n\n\nlast block"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", X.split_pair(t).alias("p"))
    return rows.select("conv_id", "turn", F.md5("p.left").alias("left_digest"), F.col("p.right").alias("right_text"))


@query("balanced_pairs", """
WITH p AS (SELECT row_number() OVER (ORDER BY page_id) - 1 AS pos, count(*) OVER () AS n, 'f' || page_id AS file, url AS l, md5(html) AS r FROM pages),
h AS (SELECT *, CASE WHEN n - 1 - pos = pos THEN n - 1 - ((pos + 1) % n) ELSE n - 1 - pos END AS at FROM p WHERE pos < n // 2)
SELECT file, l AS "left", r AS "right", true AS label FROM h
UNION ALL SELECT h.file || '___vs___' || p.file, h.l, p.r, false FROM h JOIN p ON p.pos = h.at""")
def balanced_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("f"), F.col("page_id").cast("string")).alias("file"), F.col("url").alias("left"), F.md5("html").alias("right"))
    placed = relational.positions(rows, "page_id").drop("page_id").withColumn("pos", F.col("pos").cast("long"))
    return relational.balanced_pairs(placed, placed.count()).select("file", "left", "right", "label")


@query("page_zip", """
WITH a AS (SELECT page_id AS page, url AS left_url FROM pages WHERE page_id % 2 = 0), b AS (SELECT page_id AS page, url AS right_url FROM pages WHERE page_id % 3 = 0)
SELECT coalesce(a.page, b.page) AS page, left_url, right_url FROM a FULL OUTER JOIN b ON a.page = b.page""")
def page_zip(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return relational.zip_pages(pages.where("page_id % 2 = 0").select(F.col("page_id").alias("page"), F.col("url").alias("left_url")), pages.where("page_id % 3 = 0").select(F.col("page_id").alias("page"), F.col("url").alias("right_url")))


def _code():
    """A Python file made from each document: its text is the comment of a function."""
    extra = F.when(F.col("doc_id") % 3 == 0, "class C:\n    pass\n").otherwise("")
    note = F.concat(F.lit("    # "), F.replace("text", F.lit("\n"), F.lit("\n    # ")), F.lit("\n"))
    return F.concat(F.lit("import os\n\n@cache\ndef f"), F.col("doc_id").cast("string"), F.lit("(x):\n"), note, F.lit("    return "), F.col("n_chars").cast("string"), F.lit("\n\n"), extra, F.lit("# "), "lang", F.lit("\n@wrap\n\nasync def g(y):\n    yield y"))


_BODY_SQL = "'def f' || doc_id || '(x):' || chr(10) || '    # ' || replace(text, chr(10), chr(10) || '    # ') || chr(10) || '    return ' || n_chars"
_CODE_SQL = f"'import os' || chr(10) || chr(10) || '@cache' || chr(10) || {_BODY_SQL} || chr(10) || chr(10) || CASE WHEN doc_id % 3 = 0 THEN 'class C:' || chr(10) || '    pass' || chr(10) ELSE '' END || '# ' || lang"


@query("last_def_split", f"SELECT doc_id, md5({_CODE_SQL}) AS background, '@wrap' || chr(10) || chr(10) || 'async def g(y):' || chr(10) || '    yield y' AS current FROM documents")
def last_def_split(spark, sf_dir):
    background, current = X.split_last_definition(_code())
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(background).alias("background"), current.alias("current"))


@query("line_chunks", f"""
SELECT doc_id, CAST(CASE WHEN doc_id % 3 = 0 THEN 4 ELSE 3 END AS INTEGER) AS n_chunks, md5('import os' || chr(10) || chr(10) || '@cache' || '|' || {_BODY_SQL} || chr(10)
  || CASE WHEN doc_id % 3 = 0 THEN '|class C:' || chr(10) || '    pass' ELSE '' END || chr(10) || '# ' || lang || chr(10) || '@wrap' || chr(10) || '|async def g(y):' || chr(10) || '    yield y') AS digest FROM documents""")
def line_chunks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", retrieval.line_chunks(_code(), "python").alias("c")).select("doc_id", F.size("c").alias("n_chunks"), F.md5(F.array_join("c", "|")).alias("digest"))


@query("function_chunks", f"""
SELECT doc_id, CAST(CASE WHEN doc_id % 3 = 0 THEN 3 ELSE 2 END AS INTEGER) AS n_pattern, CAST(CASE WHEN doc_id % 3 = 0 THEN 4 ELSE 3 END AS INTEGER) AS n_tree,
  md5('import os' || chr(10) || chr(10) || '|@cache' || chr(10) || {_BODY_SQL} || chr(10) || chr(10)
    || CASE WHEN doc_id % 3 = 0 THEN '|class C:' || chr(10) || '    pass' || chr(10) ELSE '' END || '# ' || lang || chr(10) || '|@wrap' || chr(10) || chr(10) || 'async def g(y):' || chr(10) || '    yield y') AS digest FROM documents""")
def function_chunks(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", retrieval.function_chunks(_code(), F.lit("python")).alias("by_pattern"), retrieval.syntax_chunks(_code(), F.lit("python")).alias("by_tree"))
    return rows.select("doc_id", F.size("by_pattern").alias("n_pattern"), F.size("by_tree").alias("n_tree"), F.md5(F.array_join("by_tree", "|")).alias("digest"))


#: A small file in each language: what comes first, a definition around a comment, and a second definition.
_SAMPLES = {
    "cpp": ("#include <map>", "int twice(int x) {", "    return 2 * x;\n}", "class Box : public Base {\n    int n;\n};"),
    "java": ("import java.util.List;", "public class Box extends Base {", "    int n;\n}", "final class Cup {\n    int m;\n}"),
    "typescript": ("import x from 'y';", "function twice(x: number): number {", "    return 2 * x;\n}", "class Box extends Base {\n    n = 1;\n}"),
    "rust": ("use std::io;", "pub fn twice(x: i32) -> i32 {", "    2 * x\n}", "struct Cup {\n    n: i32,\n}"),
    "go": ("package main", "func twice(x int) int {", "    return 2 * x\n}", "type Cup struct {\n    n int\n}"),
}


@query("language_chunks", r"""
WITH d AS (SELECT doc_id, CAST(doc_id % 5 AS INTEGER) AS k, '    // ' || regexp_replace(text, '[^A-Za-z ]', '', 'g') AS note FROM documents),
p AS (SELECT doc_id, k, note, ['#include <map>', 'import java.util.List;', 'import x from ''y'';', 'use std::io;', 'package main'][k + 1] AS a,
  ['int twice(int x) {', 'public class Box extends Base {', 'function twice(x: number): number {', 'pub fn twice(x: i32) -> i32 {', 'func twice(x int) int {'][k + 1] AS b,
  ['    return 2 * x;', '    int n;', '    return 2 * x;', '    2 * x', '    return 2 * x'][k + 1] || chr(10) || '}' AS c,
  ['class Box : public Base {#    int n;#};', 'final class Cup {#    int m;#}', 'class Box extends Base {#    n = 1;#}', 'struct Cup {#    n: i32,#}', 'type Cup struct {#    n int#}'][k + 1] AS e FROM d)
SELECT doc_id, ['cpp', 'java', 'typescript', 'rust', 'go'][k + 1] AS language, CAST([4, 4, 3, 3, 3][k + 1] AS INTEGER) AS n_lines,
  md5(a || '|' || b || chr(10) || note || chr(10) || c || '|' || replace(e, '#', chr(10))) AS digest FROM p""")
def language_chunks(spark, sf_dir):
    """Both chunkers in the languages other than Python; the letters of each document are a comment."""
    at = (F.col("doc_id") % len(_SAMPLES) + 1).cast("int")
    pick = lambda i: F.element_at(F.array(*(F.lit(x[i]) for x in _SAMPLES.values())), at)
    note = F.concat(F.lit("    // "), F.regexp_replace("text", "[^A-Za-z ]", ""))
    code = F.concat(pick(0), F.lit("\n\n"), pick(1), F.lit("\n"), note, F.lit("\n"), pick(2), F.lit("\n\n"), pick(3), F.lit("\n"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.element_at(F.array(*map(F.lit, _SAMPLES)), at).alias("language"), code.alias("code"))
    lines = F.coalesce(*(F.when(F.col("language") == name, F.size(retrieval.line_chunks(F.col("code"), name))) for name in _SAMPLES))
    return rows.select("doc_id", "language", lines.alias("n_lines"), F.md5(F.array_join(retrieval.function_chunks(F.col("code"), F.col("language")), "|")).alias("digest"))


@query("syntax_tokens")
def syntax_tokens(spark, sf_dir):
    from quillspark.functions.rendering import syntax_tokens as tokens

    rows = table(spark, sf_dir, "documents").select("doc_id", tokens("modern")(_code(), F.lit("python")).alias("t"))
    return rows.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct(F.transform("t", lambda x: x["color"]))).alias("n_colors"))


@query("languages", r"""
SELECT page_id, coalesce(map_extract_value(MAP {'.py': 'python', '.js': 'javascript', '.ts': 'typescript', '.java': 'java', '.cpp': 'cpp', '.c': 'c', '.go': 'go', '.rs': 'rust', '.rb': 'ruby', '.php': 'php'},
  ['.py', '.JS', '.rs', '.xyz', ''][CAST(page_id % 5 AS INTEGER) + 1].lower()), 'python') AS language, CAST(page_id AS DOUBLE) AS order_key FROM pages""")
def languages(spark, sf_dir):
    name = F.concat(F.lit("dir/item"), F.col("page_id").cast("string"), F.element_at(F.array(*map(F.lit, (".py", ".JS", ".rs", ".xyz", ""))), (F.col("page_id") % 5 + 1).cast("int")))
    return table(spark, sf_dir, "pages").select("page_id", X.language_of(name).alias("language"), X.file_order(name).alias("order_key"))


@query("qa_items", r"""
SELECT conv_id * 1000 + turn AS id, role AS repo, text AS code, 'A. ' || role || chr(10) || 'B. ' || turn || chr(10) AS options_text FROM conversations WHERE trim(text, chr(32) || chr(9) || chr(10) || chr(13)) <> ''""")
def qa_items(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), F.col("role").alias("repo"), F.col("text").alias("context"), F.lit("?").alias("question"), F.create_map(F.lit("B"), F.col("turn").cast("string"), F.lit("A"), "role").alias("options"), F.lit("A").alias("answer"), F.lit(None).cast("boolean").alias("is_hard"))
    return readers.qa_rows(rows, None).select("id", "repo", "code", "options_text")


@query("masked_keys", r"""
SELECT page_id, CASE WHEN length(url) <= 12 THEN left(url, 2) || '...' || right(url, 2) ELSE left(url, 6) || '...' || right(url, 6) END AS masked FROM pages""")
def masked_keys(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.mask_key(F.col("url")).alias("masked"))
