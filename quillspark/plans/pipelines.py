"""The evaluation tasks end to end, each from rows to scored rows; a client answers, functions score.

Every task takes a client factory (see streaming.clients), so a model behind a service and a stand-in for
tests run the same plan. Results of all modes are one long table with a ``mode`` column."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from quillspark.functions import layout, metrics, rendering
from quillspark.functions import text as X
from quillspark.operators import relational, reports, retrieval
from quillspark.streaming import clients

#: Names of the error taxonomy (fixed values).
TAXONOMY = ("Visual_Typo", "Symbol_Loss", "Indentation_Error", "Line_Skipped", "Variable_Hallucination", "Code_Invention", "Repetition", "Comment_Loss")


def prompt(template: str, **parts: Column) -> Column:
    """A template with {name} fields filled from columns; null fills as nothing."""
    pieces, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        pieces += [F.lit(before), F.coalesce(parts[name].cast("string"), F.lit(""))]
    return F.concat(*pieces, F.lit(rest))


# Default templates; each task takes others.
COMPLETE = "Write only the next line of this code.\n{current}\n\nRelated code:\n{context}"
ANSWER = "Repository:\n{code}\n\nQuestion: {question}\n{options_text}\nAnswer with one letter."
ANSWER_ALONE = "Question: {question}\n{options_text}\nAnswer with one letter."
COMPARE = 'Do both functions do the same? Reply as JSON {"is_same": true} or {"is_same": false}.\nFirst:\n'
DESCRIBE = "Document {docfile_name} about {intent} from this code:\n{code}"
READ = "Transcribe the code on these pages as it stands.\n{code}"


def hash_vector(words: list[str], size: int = 64) -> list[float]:
    made = np.zeros(size)
    for w in words:
        h = zlib.crc32(w.encode())
        made[h % size] += 1 if h & 1024 else -1
    return made.tolist()


@F.pandas_udf(ArrayType(DoubleType()))
def hash_embedding(x: pd.Series) -> pd.Series:
    """A stand-in for an embedding model: signed hashed words; blank text is the zero vector."""
    return x.map(lambda s: hash_vector((s or "").split()))


def retrieved(rows: DataFrame, k: int = 3, language: str = "python", embed=hash_embedding) -> DataFrame:
    """rows(id, background, current) with ``context``: the k function chunks most like the current function."""
    chunks = rows.select("id", "current", F.posexplode(retrieval.syntax_chunks(F.col("background"), F.lit(language))).alias("idx", "text"))
    scored = chunks.select("id", "idx", "text", embed("text").alias("vec"), embed("current").alias("query_vec"))
    return rows.join(retrieval.context_by_similarity(retrieval.rank_chunks(scored, k)), "id", "left").withColumn("context", F.coalesce("context", F.lit("")))


def completion(rows: DataFrame, make_client: Callable, ratios=(1.0, 2.0, 4.0, 8.0), template: str = COMPLETE, policy=None, keep_without_context: bool = False) -> DataFrame:
    """rows(id, background, current, gt) to id, mode, output, cleaned_output, es, em and token counts."""
    ready = retrieved(rows)
    if not keep_without_context:
        ready = ready.where(~X.is_blank(F.col("context")))
    modes = F.array(F.lit("text_only"), *(F.lit(f"image_ratio{r:g}") for r in ratios))
    asked = ready.withColumn("prompt", prompt(template, current=F.col("current"), context=F.col("context"))).withColumn("mode", F.explode(modes))
    said = clients.ask_rows(asked.select("id", "mode", "gt", "prompt"), make_client, policy)
    said = said.withColumn("cleaned_output", X.extract_code(F.col("output")))
    return said.select("id", "mode", "gt", "output", "cleaned_output", metrics.edit_similarity(F.col("gt"), F.col("cleaned_output")).alias("es"), metrics.exact_match(F.col("gt"), F.col("cleaned_output")).alias("em"), "prompt_tokens", "completion_tokens", (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"))


def qa(items: DataFrame, make_client: Callable, modes=("text_only", "no_context", "image_ratio1"), policy=None) -> DataFrame:
    """items(id, repo, code, question, options_text, correct_letter) to pred_letter and is_correct by mode."""
    parts = {c: F.col(c) for c in ("code", "question", "options_text")}
    asked = items.withColumn("mode", F.explode(F.array(*map(F.lit, modes))))
    asked = asked.withColumn("prompt", F.when(F.col("mode") == "no_context", prompt(ANSWER_ALONE, **parts)).otherwise(prompt(ANSWER, **parts)))
    said = clients.ask_rows(asked.select("id", F.col("repo").alias("source_file"), "correct_letter", "mode", "prompt"), make_client, policy)
    said = said.withColumn("pred_letter", X.answer_letter(F.col("output")))
    return said.withColumn("is_correct", metrics.is_correct(F.col("pred_letter"), F.col("correct_letter")))


def clones(pairs: DataFrame, make_client: Callable, ratios=(1.0, 2.0), policy=None) -> DataFrame:
    """pairs(file, left, right, label) to pred by mode: true, false or null where the answer has no verdict."""
    modes = F.array(F.lit("text_only"), *(F.lit(f"image_ratio{r:g}") for r in ratios))
    asked = F.concat(F.lit(COMPARE), "left", F.lit("\nSecond:\n"), "right")
    said = clients.ask_rows(pairs.select("file", "label", asked.alias("prompt"), F.explode(modes).alias("mode")), make_client, policy)
    return said.withColumn("pred", X.json_flag(F.col("output"), "is_same"))


def summaries(rows: DataFrame, make_client: Callable, make_judge: Callable, most_tokens: int | None = None, policy=None) -> DataFrame:
    """rows(intent, docfile_name, relevant_code_context, target_text) to the judge's mean preference for ours.

    The judge sees both orders; empty outputs or targets are not judged and score null."""
    if most_tokens is not None:
        rows = relational.within_tokens(rows, "relevant_code_context", most_tokens)
    asked = rows.withColumn("prompt", prompt(DESCRIBE, docfile_name=F.col("docfile_name"), intent=F.col("intent"), code=F.col("relevant_code_context")))
    said = clients.ask_rows(asked.select("intent", "docfile_name", "target_text", "prompt"), make_client, policy).select("intent", "docfile_name", "target_text", F.col("output").alias("ours"))
    order = lambda a, b: F.concat(F.lit("Which text is better, A or B?\nA:\n"), a, F.lit("\nB:\n"), b)
    valid = said.where((F.coalesce("ours", F.lit("")) != "") & (F.coalesce("target_text", F.lit("")) != ""))
    both = valid.select("intent", "docfile_name", "ours", F.posexplode(F.array(order(F.col("target_text"), F.col("ours")), order(F.col("ours"), F.col("target_text")))).alias("order_no", "prompt"))
    votes = clients.ask_rows(both, make_judge, policy).select("intent", "docfile_name", "order_no", F.upper(F.trim("output")).alias("vote"))
    scored = votes.groupBy("intent", "docfile_name").agg(F.max(F.when(F.col("order_no") == 0, F.col("vote"))).alias("first"), F.max(F.when(F.col("order_no") == 1, F.col("vote"))).alias("second"))
    score = metrics.text_preference(F.col("first"), F.col("second"))
    return said.join(scored.select("intent", "docfile_name", score.alias("score")), ["intent", "docfile_name"], "left")


def heuristic_flags(ref: Column, hyp: Column) -> Column:
    """The taxonomy as map<string,boolean>; only symbol loss is judged without a model."""
    values = [X.symbol_loss(ref, hyp) if name == "Symbol_Loss" else F.lit(False) for name in TAXONOMY]
    return F.create_map(*(x for name, v in zip(TAXONOMY, values, strict=True) for x in (F.lit(name), v)))


def reconstruction(truth: DataFrame, make_client: Callable, ratios=(1.0, 1.5, 2.0, 4.0, 6.0, 8.0), done: DataFrame | None = None, policy=None) -> DataFrame:
    """truth(code_id, code) to a record per ratio with cer, wer, line_sim and flags; done cases are skipped."""
    cases = relational.expand_ratios(truth, ratios)
    if done is not None:
        cases = relational.pending(cases, done)
    asked = cases.withColumn("prompt", prompt(READ, code=F.col("code")))
    said = clients.ask_rows(asked, make_client, policy)
    ref, hyp = X.without_blank_lines(F.col("code")), X.without_blank_lines(X.clean_ocr(F.col("output")))
    scored = said.withColumns({"ref": ref, "hyp": hyp})
    return scored.select("code_id", "ratio", F.col("output").alias("text"), "error", metrics.cer(F.col("ref"), F.col("hyp")).alias("cer"), metrics.wer(F.col("ref"), F.col("hyp")).alias("wer"), metrics.line_similarity("ref", "hyp").alias("line_sim"), F.length("ref").alias("ref_len"), F.length("hyp").alias("hyp_len"), heuristic_flags(F.col("ref"), F.col("hyp")).alias("taxonomy"))


def judged(records: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Records with a judge's flags (code_id, ratio, judge map) merged in, those with errors only."""
    both = records.join(verdicts, ["code_id", "ratio"], "left")
    return both.withColumn("taxonomy", F.when((F.col("cer") > 0) & F.col("judge").isNotNull(), reports.merge_flags(F.col("taxonomy"), F.col("judge"))).otherwise(F.col("taxonomy"))).drop("judge")


def selected(names: str, known: tuple[str, ...]) -> list[str]:
    """Tasks of a comma list in the known order of the list; unknown names raise ValueError."""
    wanted = [n.strip() for n in names.split(",") if n.strip()]
    if unknown := [n for n in wanted if n not in known]:
        raise ValueError(f"unknown: {', '.join(unknown)}")
    return wanted


def only_rows(rows: DataFrame, chosen: list[int] | None, cache: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rows to run again, cached results of the rest): the chosen ids, or all without a cached result."""
    if chosen is None:
        return rows.join(cache.select(key), key, "left_anti"), cache
    return rows.where(F.col(key).isin(chosen)), cache.where(~F.col(key).isin(chosen))


def valid_pairs(rows: DataFrame, gold: str = "target_text", pred: str = "output") -> tuple[DataFrame, Column]:
    """Rows with both texts, and an aggregate that counts empty predictions of all rows."""
    full = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return rows.where(full(gold) & full(pred)), F.count_if(~full(pred)).alias("empty_predictions")


def page_limit(model: str) -> int:
    """Most pages that a model is sent (fixed values)."""
    return 50 if "glm" in model.lower() else 100


def pages_to_images(docs: DataFrame, code: str, res: Column, font: Column, model: str = "", most: int | None = None) -> DataFrame:
    """Printed rows of each text within the model's page limit; a drawer turns rows of a page to pixels."""
    return rendering.page_rows(docs, code, res, font).where(F.col("page") <= (page_limit(model) if most is None else most))


def compressed_resolution(tokens: Column, ratio: Column, base_res: Column, pages: Column, variant: str = "b") -> Column:
    """Page size of a compressed set: 14 at ratio 0, the base at 1, else nearest to the tokens of a page."""
    target = tokens / ratio / F.greatest(pages, F.lit(1))
    near = layout.nearest_larger(target) if variant == "b" else layout.nearest_resolution(F.floor(target))
    return F.when(ratio == 0, 14).when(ratio == 1, base_res).otherwise(near).cast("int")
