"""Queries over metrics, aggregates, reports and retrieval, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import metrics
from quillspark.functions import text as X
from quillspark.operators import relational, reports, retrieval
from quillspark.plans import pipelines
from quillspark.plans.tables import table
from quillspark.streaming import clients

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


#: DuckDB's levenshtein counts bytes: the characters of a pair are numbered, so that each is one byte.
_NUMBERED = "array_to_string(list_transform(string_split({}, ''), lambda c: chr(CAST(list_position(v, c) + 32 AS INTEGER))), '')"
#: Stand-in for OCR output at ratios 1, 2 and 4 of benchmark items.
_OCR_SQL = r"""
WITH g AS (SELECT item_id, text AS r FROM benchmark),
o AS (SELECT item_id, ratio, r, CASE ratio WHEN 1.0e0 THEN r WHEN 2.0e0 THEN replace(r, 'th', 't') ELSE translate(r, '.,e', '') END AS h FROM g, (VALUES (1.0e0), (2.0e0), (4.0e0)) v(ratio)),
n AS (SELECT *, array_to_string(list_filter(list_transform(string_split(r, chr(10)), lambda x: rtrim(x)), lambda x: x <> ''), chr(10)) AS a, array_to_string(list_filter(list_transform(string_split(h, chr(10)), lambda x: rtrim(x)), lambda x: x <> ''), chr(10)) AS b FROM o),
m AS (SELECT *, list_distinct(string_split(a || b, '')) AS v FROM n),
s AS (SELECT ratio, CASE WHEN length(a) = 0 THEN CASE WHEN length(b) > 0 THEN 1.0e0 ELSE 0.0e0 END ELSE levenshtein(A_, B_)::DOUBLE / length(a) END AS cer FROM m)
""".replace("A_", _NUMBERED.format("a")).replace("B_", _NUMBERED.format("b"))


def _ocr(spark, sf_dir):
    truth = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("code_id"), F.col("text").alias("code"))
    read = relational.expand_ratios(truth.withColumnRenamed("code", "seen"), (1, 2, 4))
    ratio = F.col("ratio")
    read = read.select("code_id", "ratio", F.when(ratio == 1, F.col("seen")).when(ratio == 2, F.replace("seen", F.lit("th"), F.lit("t"))).otherwise(F.translate("seen", ".,e", "")).alias("text"))
    joined = relational.score_inputs(read, truth)
    return joined.select("ratio", metrics.cer(X.without_blank_lines(F.col("code")), X.without_blank_lines(F.col("text")), any_length=False).alias("cer"))


@query("ocr_cer_by_ratio", _OCR_SQL + "SELECT ratio, count(*) AS n, round(avg(cer), 6) AS cer, round(avg(CASE WHEN cer = 0 THEN 1 ELSE 0 END) * 100, 6) AS perfect_pct FROM s GROUP BY ratio")
def ocr_cer_by_ratio(spark, sf_dir):
    return reports.error_report(_ocr(spark, sf_dir)).select("ratio", "n", F.round("cer", 6).alias("cer"), F.round("perfect_pct", 6).alias("perfect_pct"))


@query("ocr_total_row", _OCR_SQL + "SELECT CASE WHEN grouping(ratio) = 1 THEN 'ALL' ELSE CAST(ratio AS VARCHAR) END AS ratio, count(*) AS n, round(avg(cer), 6) AS cer FROM s GROUP BY GROUPING SETS ((ratio), ())")
def ocr_total_row(spark, sf_dir):
    scored = _ocr(spark, sf_dir)
    return reports.with_total(reports.error_report(scored), scored).select("ratio", "n", F.round("cer", 6).alias("cer"))


@query("judge_queue", _OCR_SQL + "SELECT ratio, count(*) AS n FROM s WHERE cer > 0 GROUP BY ratio")
def judge_queue(spark, sf_dir):
    return _ocr(spark, sf_dir).where("cer > 0").groupBy("ratio").agg(F.count(F.lit(1)).alias("n"))


def _document_reading(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("code"))
    return d.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.replace("code", F.lit("th"), F.lit("t"))).when(F.col("doc_id") % 3 == 1, F.translate("code", ".,", "")).otherwise(F.col("code")))


@query("ocr_cer_documents")
def ocr_cer_documents(spark, sf_dir):
    """Whole documents: bit-parallel distance, which SQL engines lack."""
    rows = _document_reading(spark, sf_dir).select("doc_id", X.without_blank_lines(F.col("code")).alias("code"), X.without_blank_lines(F.col("text")).alias("text"))
    return rows.select("doc_id", F.round(metrics.cer(F.col("code"), F.col("text")), 6).alias("cer"))


@query("ocr_wer_documents")
def ocr_wer_documents(spark, sf_dir):
    rows = _document_reading(spark, sf_dir)
    return rows.select("doc_id", F.round(metrics.wer(F.col("code"), F.col("text")), 6).alias("wer"), F.round(metrics.line_similarity("code", "text"), 6).alias("line_sim"))


@query("ocr_wer", r"""
WITH g AS (SELECT item_id, regexp_split_to_array(trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')), ' ') AS a FROM benchmark),
h AS (SELECT item_id, a, list_filter(a, lambda w: w NOT IN ('the', 'of', 'de')) AS b, list_distinct(a) AS v FROM g),
c AS (SELECT item_id, len(a) AS n, array_to_string(list_transform(a, lambda w: chr(CAST(list_position(v, w) + 32 AS INTEGER))), '') AS x, array_to_string(list_transform(b, lambda w: chr(CAST(list_position(v, w) + 32 AS INTEGER))), '') AS y FROM h)
SELECT item_id, round(levenshtein(x, y)::DOUBLE / n, 6) AS wer FROM c""")
def ocr_wer(spark, sf_dir):
    words = metrics.word_list(F.col("text"))
    hyp = F.array_join(F.filter(words, lambda w: ~w.isin("the", "of", "de")), " ")
    return table(spark, sf_dir, "benchmark").select("item_id", F.round(metrics.wer(F.col("text"), hyp, any_length=False), 6).alias("wer"))


_ES_SQL = r"""
WITH t AS (SELECT item_id, m.mode, text AS t FROM benchmark, (VALUES ('text_only'), ('image_ratio2')) m(mode)),
p AS (SELECT item_id, mode, t, CASE WHEN mode = 'text_only' THEN CASE WHEN item_id % 2 = 0 THEN '# note' || chr(10) || '  ' || t ELSE t || chr(10) || 'more' END ELSE translate(t, 'e', '') END AS p FROM t),
l AS (SELECT *, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS a, list_filter(list_transform(string_split(p, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT starts_with(x, '#')) AS b0 FROM p),
c AS (SELECT *, b0[1:len(a)] AS b FROM l),
s AS (SELECT item_id, mode, array_to_string(a, chr(10)) AS x, array_to_string(b, chr(10)) AS y, a, b FROM c),
n AS (SELECT *, list_distinct(string_split(x || y, '')) AS v FROM s),
r AS (SELECT item_id, mode, CASE WHEN x = '' AND y = '' THEN 100.0e0 WHEN x = '' OR y = '' THEN 0.0e0 ELSE (1 - levenshtein(X_, Y_)::DOUBLE / greatest(length(x), length(y))) * 100 END AS es, CASE WHEN a = b THEN 100.0e0 ELSE 0.0e0 END AS em FROM n)
""".replace("X_", _NUMBERED.format("x")).replace("Y_", _NUMBERED.format("y"))


def _completions(spark, sf_dir):
    t = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("t"), F.explode(F.array(F.lit("text_only"), F.lit("image_ratio2"))).alias("mode"))
    plain = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("# note\n  "), "t")).otherwise(F.concat("t", F.lit("\nmore")))
    t = t.withColumn("p", F.when(F.col("mode") == "text_only", plain).otherwise(F.translate("t", "e", "")))
    return t.select("item_id", "mode", metrics.edit_similarity(F.col("t"), F.col("p"), any_length=False).alias("es"), metrics.exact_match(F.col("t"), F.col("p")).alias("em"))


@query("edit_similarity", _ES_SQL + "SELECT item_id, mode, round(es, 6) AS es, em FROM r")
def edit_similarity(spark, sf_dir):
    return _completions(spark, sf_dir).select("item_id", "mode", F.round("es", 6).alias("es"), "em")


@query("completion_by_mode", _ES_SQL + "SELECT mode, round(avg(es), 6) AS average_es, round(avg(em), 6) AS average_em, count(*) AS n FROM r GROUP BY mode UNION ALL SELECT 'all', round(avg(es), 6), round(avg(em), 6), count(*) FROM r")
def completion_by_mode(spark, sf_dir):
    r = _completions(spark, sf_dir)
    rounded = lambda d: d.select("mode", F.round("average_es", 6).alias("average_es"), F.round("average_em", 6).alias("average_em"), "n")
    return rounded(reports.mode_average(r)).unionByName(rounded(reports.pooled_average(r).withColumn("mode", F.lit("all"))))


_QA_SQL = "WITH q AS (SELECT role AS source_file, CASE WHEN turn % 2 = 0 THEN 'text_only' ELSE 'image' END AS mode, CASE WHEN length(text) % 5 = 0 THEN NULL ELSE substr('ABCD', CAST(length(text) % 4 AS INTEGER) + 1, 1) END AS p, substr('abcd', CAST(conv_id % 4 AS INTEGER) + 1, 1) AS a FROM conversations), r AS (SELECT *, coalesce(p = upper(a), false) AS ok FROM q) "


def _qa(spark, sf_dir):
    pred = F.when(F.length("text") % 5 != 0, F.substring(F.lit("ABCD"), (F.length("text") % 4 + 1).cast("int"), F.lit(1)))
    answer = F.substring(F.lit("abcd"), (F.col("conv_id") % 4 + 1).cast("int"), F.lit(1))
    return table(spark, sf_dir, "conversations").select(F.col("role").alias("source_file"), F.when(F.col("turn") % 2 == 0, "text_only").otherwise("image").alias("mode"), metrics.is_correct(pred, answer).alias("is_correct"))


@query("qa_accuracy", _QA_SQL + "SELECT mode, source_file, avg(CAST(ok AS INTEGER)) AS accuracy, count(*) FILTER (ok) AS correct, count(*) AS total FROM r GROUP BY GROUPING SETS ((mode), (mode, source_file))")
def qa_accuracy(spark, sf_dir):
    return reports.accuracy_nested(_qa(spark, sf_dir))


_CLONE_SQL = "WITH c AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'text_only' ELSE 'image' END AS mode, quality = 1 AS label, CASE WHEN doc_id % 7 <> 0 THEN toxic = 1 END AS pred FROM labels), k AS (SELECT mode, count(*) FILTER (pred AND label) AS tp, count(*) FILTER (pred AND NOT label) AS fp, count(*) FILTER (NOT pred AND NOT label) AS tn, count(*) FILTER (NOT pred AND label) AS fn, count(*) AS total, count(pred) AS valid_total FROM c GROUP BY mode), m AS (SELECT *, CASE WHEN total > 0 THEN (tp + tn)::DOUBLE / total ELSE 0 END AS acc, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS recall FROM k) "


def _clones(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(F.when(F.col("doc_id") % 2 == 0, "text_only").otherwise("image").alias("mode"), (F.col("quality") == 1).alias("label"), F.when(F.col("doc_id") % 7 != 0, F.col("toxic") == 1).alias("pred"))


@query("clone_confusion", _CLONE_SQL + "SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM m")
def clone_confusion(spark, sf_dir):
    return reports.confusion(_clones(spark, sf_dir))


@query("score_stats", "SELECT event_type AS mode, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS lowest, max(value) AS highest, round(median(value), 6) AS median FROM events GROUP BY event_type")
def score_stats(spark, sf_dir):
    s = reports.score_stats(table(spark, sf_dir, "events").select(F.col("event_type").alias("mode"), F.col("value").alias("score")))
    return s.select("mode", "n", *(F.round(c, 6).alias(c) for c in ("mean", "std")), "lowest", "highest", F.round("median", 6).alias("median"))


@query("mode_summary", """
WITH s AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'text_only' ELSE 'image_ratio4' END AS mode, event_type AS model, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY 1, 2)
SELECT mode, string_agg(model || ':' || n, ',' ORDER BY model) AS models FROM s GROUP BY mode""")
def mode_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 2 == 0, "text_only").otherwise("image_ratio4").alias("mode"), F.col("event_type").alias("model"), "value")
    s = e.groupBy("mode", "model").agg(F.round(F.avg("value"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))
    return reports.model_summary(s).select("mode", F.array_join(F.transform("models", lambda m: F.concat_ws(":", m["model"], m["n"].cast("string"))), ",").alias("models"))


@query("empty_modes", """
WITH s AS (SELECT 'text_only' AS mode, count(*) AS n, round(avg(value), 6) AS mean FROM events)
SELECT m.mode, coalesce(s.n, 0) AS n, coalesce(s.mean, 0.0e0) AS mean, CASE WHEN s.n IS NULL THEN 'no results' END AS note FROM (VALUES ('text_only'), ('image'), ('image_ratio1'), ('image_ratio2'), ('image_ratio4'), ('image_ratio8')) m(mode) LEFT JOIN s ON s.mode = m.mode""")
def empty_modes(spark, sf_dir):
    s = reports.score_stats(table(spark, sf_dir, "events").select(F.lit("text_only").alias("mode"), F.col("value").alias("score"))).withColumn("mean", F.round("mean", 6))
    return reports.with_empty_modes(s)


_TOKENS_SQL = "WITH c AS (SELECT lang AS mode, n_chars // 4 AS p, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE n_chars // 16 END AS k FROM documents), s AS (SELECT mode, count(*) AS calls, count(*) FILTER (coalesce(k, 0) = 0) AS empty_completions, CAST(sum(p) AS BIGINT) AS prompt_tokens, CAST(sum(coalesce(k, 0)) AS BIGINT) AS completion_tokens, CAST(sum(p + coalesce(k, 0)) AS BIGINT) AS total_tokens FROM c GROUP BY mode) "


def _calls(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    p, k = F.expr("n_chars div 4"), F.when(F.col("doc_id") % 9 != 0, F.expr("n_chars div 16"))
    return reports.token_stats(d.select(F.col("lang").alias("mode"), p.alias("prompt_tokens"), k.alias("completion_tokens"), (p + F.coalesce(k, F.lit(0))).alias("total_tokens")))


@query("token_stats", _TOKENS_SQL + "SELECT *, total_tokens::DOUBLE / greatest(calls, 1) AS mean_tokens FROM s")
def token_stats(spark, sf_dir):
    return _calls(spark, sf_dir)


@query("prompt_completion_ratio", _TOKENS_SQL + "SELECT round(avg(prompt_tokens::DOUBLE / completion_tokens), 9) AS mean_ratio, round(sum(prompt_tokens)::DOUBLE / sum(completion_tokens), 9) AS total_ratio, count(*) AS modes FROM s WHERE prompt_tokens > 0 AND completion_tokens > 0")
def prompt_completion_ratio(spark, sf_dir):
    return reports.prompt_completion_ratio(_calls(spark, sf_dir)).select(F.round("mean_ratio", 9).alias("mean_ratio"), F.round("total_ratio", 9).alias("total_ratio"), "modes")


@query("mode_report", _CLONE_SQL + """, f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM m)
SELECT 'code_clone_detection' AS task, CAST(12 AS INTEGER) AS font_size, coalesce(max(CASE WHEN mode = 'text_only' THEN printf('Acc:%.2f F1:%.2f', acc, f1) END), 'N/A') AS text_only, coalesce(max(CASE WHEN mode = 'image' THEN printf('Acc:%.2f F1:%.2f', acc, f1) END), 'N/A') AS image, 'N/A' AS image_ratio2 FROM f""")
def mode_report(spark, sf_dir):
    k = reports.confusion(_clones(spark, sf_dir))
    none = F.lit(None).cast("double")
    values = {"es": none, "em": none, "accuracy": none, "correct": none, "total": none, "acc": F.col("acc"), "f1": F.col("f1"), "score": none}
    cells = k.select(F.lit("code_clone_detection").alias("task"), F.lit(12).alias("font_size"), "mode", reports.report_cell(F.lit("code_clone_detection"), values).alias("cell"))
    return reports.mode_report(cells, ("text_only", "image", "image_ratio2"))


@query("sliding_chunks", r"""
WITH l AS (SELECT doc_id, CASE WHEN string_split(text, chr(10))[-1] = '' THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS a FROM documents),
s AS (SELECT doc_id, a, unnest(range(0, CAST(greatest(0, ceil((len(a) - 8) / 4.0e0)) AS BIGINT) + 1)) * 4 AS st FROM l WHERE len(a) > 0)
SELECT DISTINCT doc_id, md5(array_to_string(a[st + 1:st + 8], chr(10))) AS chunk FROM s""")
def sliding_chunks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(retrieval.sliding_chunks(F.col("text"), 8, 4)).alias("c")).select("doc_id", F.md5("c").alias("chunk"))


@query("rag_context", r"""
WITH l AS (SELECT doc_id, text, CASE WHEN string_split(text, chr(10))[-1] = '' THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS a FROM documents),
s AS (SELECT doc_id, text, a, unnest(range(0, CAST(greatest(0, ceil((len(a) - 8) / 4.0e0)) AS BIGINT) + 1)) * 4 AS st FROM l WHERE len(a) > 0),
c AS (SELECT doc_id, st, array_to_string(a[st + 1:st + 8], chr(10)) AS t, text FROM s),
v AS (SELECT doc_id, st, t, [length(t)::DOUBLE, (length(t) - length(replace(t, 'e', '')))::DOUBLE, (length(t) - length(replace(t, 't', '')))::DOUBLE] AS x, [length(text)::DOUBLE, (length(text) - length(replace(text, 'e', '')))::DOUBLE, (length(text) - length(replace(text, 't', '')))::DOUBLE] AS y FROM c),
k AS (SELECT doc_id, st, t, row_number() OVER (PARTITION BY doc_id ORDER BY round(coalesce(CASE WHEN list_dot_product(x, x) * list_dot_product(y, y) > 0 THEN list_dot_product(x, y) / sqrt(list_dot_product(x, x) * list_dot_product(y, y)) END, 0), 9) DESC, st) AS r FROM v)
SELECT doc_id, md5(string_agg(t, chr(10) || chr(10) ORDER BY st)) AS context FROM k WHERE r <= 3 GROUP BY doc_id""")
def rag_context(spark, sf_dir):
    mark = lambda c: F.array(F.length(c).cast("double"), (F.length(c) - F.length(F.replace(c, F.lit("e")))).cast("double"), (F.length(c) - F.length(F.replace(c, F.lit("t")))).cast("double"))
    context = retrieval.local_context(retrieval.window_chunks(X.split_lines(F.col("text")), 8, 4), mark(F.col("text")), mark, 3)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(context).alias("context")).where("context IS NOT NULL")


@query("topk_cosine", """
WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 20 = 0), a AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, a.vec_id AS id, round(list_cosine_similarity(q.e, a.e), 9) AS similarity FROM q, a WHERE a.vec_id <> q.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s)
SELECT query_id, id, round(similarity, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 3""")
def topk_cosine(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return retrieval.top_k(rows, rows.where("id % 20 = 0"), 3).select("query_id", "id", F.round("similarity", 6).alias("similarity"), "rank")


@query("judge_preference", """
WITH e AS (SELECT event_id, -abs(value) / 100 AS a, CASE WHEN event_id % 4 = 0 THEN NULL ELSE -abs(value) / 50 END AS b0 FROM events), f AS (SELECT event_id, a, coalesce(b0, a - 2.3e0) AS b FROM e)
SELECT event_id, round(exp(a) / (exp(a) + exp(b)), 9) AS p_a, round((exp(b) / (exp(a) + exp(b)) + exp(a) / (exp(a) + exp(b))) / 2, 9) AS preference FROM f""")
def judge_preference(spark, sf_dir):
    a, b = -F.abs("value") / 100, F.when(F.col("event_id") % 4 != 0, -F.abs("value") / 50)
    pa, pb = metrics.option_probability(a, b)
    return table(spark, sf_dir, "events").select("event_id", F.round(pa, 9).alias("p_a"), F.round(metrics.swapped_preference(pb, pa), 9).alias("preference"))


@query("merged_flags", """
SELECT doc_id, quality = 1 OR toxic = 1 AS typo, toxic = 1 AS loss FROM labels""")
def merged_flags(spark, sf_dir):
    heuristic = F.create_map(F.lit("typo"), F.col("quality") == 1, F.lit("loss"), F.lit(False))
    judge = F.create_map(F.lit("typo"), F.col("toxic") == 1, F.lit("loss"), F.col("toxic") == 1, F.lit("unknown"), F.lit(True))
    return table(spark, sf_dir, "labels").select("doc_id", reports.merge_flags(heuristic, judge).alias("m")).select("doc_id", F.col("m")["typo"].alias("typo"), F.col("m")["loss"].alias("loss"))


class _Letters(clients.EchoClient):
    """Answers with a letter that the prompt's length decides."""

    def __init__(self):
        super().__init__(lambda p: "The answer is " + "ABCD"[len(p) % 4])


@query("pipeline_qa", """
WITH q AS (SELECT conv_id * 1000 + turn AS id, role AS source_file, text, substr('ABCD', CAST(conv_id % 4 + 1 AS INTEGER), 1) AS a FROM conversations WHERE trim(text, chr(32) || chr(9) || chr(10) || chr(13)) <> ''),
m AS (SELECT *, 'text_only' AS mode, 'Repository:' || chr(10) || text || chr(10) || chr(10) || 'Question: ?' || chr(10) || 'A. ' || source_file || chr(10) || chr(10) || 'Answer with one letter.' AS p FROM q
UNION ALL SELECT *, 'no_context', 'Question: ?' || chr(10) || 'A. ' || source_file || chr(10) || chr(10) || 'Answer with one letter.' FROM q)
SELECT id, mode, substr('ABCD', CAST(length(p) % 4 + 1 AS INTEGER), 1) AS pred_letter, substr('ABCD', CAST(length(p) % 4 + 1 AS INTEGER), 1) = a AS is_correct FROM m""")
def pipeline_qa(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where(~X.is_blank(F.col("text")))
    items = rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("role").alias("repo"), F.col("text").alias("code"), F.lit("?").alias("question"), F.concat(F.lit("A. "), "role", F.lit("\n")).alias("options_text"), F.substring(F.lit("ABCD"), (F.col("conv_id") % 4 + 1).cast("int"), F.lit(1)).alias("correct_letter"))
    return pipelines.qa(items, _Letters, ("text_only", "no_context")).select("id", "mode", "pred_letter", "is_correct")


@query("pipeline_reconstruction")
def pipeline_reconstruction(spark, sf_dir):
    """Benchmark items read by a client that answers in capitals."""
    truth = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("code_id"), F.col("text").alias("code"))
    return pipelines.reconstruction(truth, clients.EchoClient, (1.0, 2.0)).select("code_id", "ratio", F.round("cer", 6).alias("cer"), F.round("wer", 6).alias("wer"), F.round("line_sim", 6).alias("line_sim"), F.col("taxonomy")["Symbol_Loss"].alias("symbol_loss"))


class _Prefixed(clients.EchoClient):
    """Answers with the prompt after a fixed word; capitals of all letters differ between engines."""

    def __init__(self):
        super().__init__("Answer: ".__add__)


@query("model_answers", """
SELECT conv_id, turn, 'Answer: ' || text AS output, greatest(1, length(text) // 4) AS prompt_tokens FROM conversations""")
def model_answers(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("prompt"))
    return clients.ask_rows(rows, _Prefixed).select("conv_id", "turn", "output", "prompt_tokens")
