"""Chunks of code and their retrieval by similarity."""

from __future__ import annotations

import ast
import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quillspark.functions import metrics, text

# Where a function or class begins, for the first chunker and for the line-wise one.
DEFINITIONS = {
    "python": r'(^|\n)(\s*)(def|class)\s+[^\n]+(\n(?!\s*(?:def|class)\s)[^\n]*)*',
    "cpp": r'(^|\n)(\s*)(?:class\s+[a-zA-Z_][a-zA-Z0-9_]*(?:\s*:\s*[^{]*)?|(?:[a-zA-Z_][a-zA-Z0-9_<>:,\s]*\s+)?[a-zA-Z_][a-zA-Z0-9_]*\s*\([^{;]*\)(?:\s*[^{;]*)?)\s*(?:{[^}]*}|[^;]*;)?',
    "java": r'(^|\n)(\s*)(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)*(?:class\s+[a-zA-Z_][a-zA-Z0-9_]*(?:\s+extends\s+[a-zA-Z_][a-zA-Z0-9_]*)?(?:\s+implements\s+[^{]*)?|(?:<.*>)?(?:[a-zA-Z_][a-zA-Z0-9_<>:,\s]*)\s+[a-zA-Z_][a-zA-Z0-9_]*\s*\([^{;]*\)(?:\s*throws\s+[^{;]*)?)\s*(?:{[^}]*}|[^;]*;)?',
    "typescript": r'(^|\n)(\s*)(?:(?:public|private|protected|static|abstract)\s+)*(?:class\s+[a-zA-Z_][a-zA-Z0-9_]*(?:\s+extends\s+[a-zA-Z_][a-zA-Z0-9_]*)?(?:\s+implements\s+[^{]*)?|(?:(?:public|private|protected|static|async)\s+)*(?:function\s+)?(?:[a-zA-Z_][a-zA-Z0-9_]*)\s*(?:<.*>)?\s*\([^{;]*\)\s*(?::\s*[^{;]*\s*)?(?:=>)?)\s*(?:{[^}]*}|[^;]*;)?',
    "rust": r'(^|\n)(\s*)(?:pub\s+)?(?:struct\s+[a-zA-Z_][a-zA-Z0-9_]*|impl(?:\s+[a-zA-Z_][a-zA-Z0-9_]*)?(?:\s+for\s+[a-zA-Z_][a-zA-Z0-9_]*)?|(?:async\s+)?fn\s+[a-zA-Z_][a-zA-Z0-9_]*\s*(?:<.*>)?\s*\([^{;]*\)(?:\s*->\s*[^{;]*\s*)?)\s*(?:{[^}]*}|[^;]*;)?',
    "go": r'(^|\n)(\s*)(?:type\s+[a-zA-Z_][a-zA-Z0-9_]*\s+struct|func\s+(?:\([^)]*\)\s*)?[a-zA-Z_][a-zA-Z0-9_]*\s*\([^{;]*\)(?:\s*[^{;]*\s*)?)\s*(?:{[^}]*}|[^;]*;)?',
}
LINE_DEFINITIONS = {
    "python": r"^(class\s+\w+|def\s+\w+|async\s+def\s+\w+)",
    "py": r"^(class\s+\w+|def\s+\w+|async\s+def\s+\w+)",
    "java": r"^(\s*(public|private|protected)?\s*(static)?\s*(class|interface|enum|void|int|String|boolean|long|double|float|char|byte|short)\s+\w+)",
    "cpp": r"^(\s*(class|struct|void|int|bool|auto|template)\s+\w+)",
    "typescript": r"^(\s*(export\s+)?(class|interface|function|async\s+function|const\s+\w+\s*=\s*\(|let\s+\w+\s*=\s*\()\s*\w*)",
    "ts": r"^(\s*(export\s+)?(class|interface|function|async\s+function|const\s+\w+\s*=\s*\(|let\s+\w+\s*=\s*\()\s*\w*)",
    "javascript": r"^(\s*(export\s+)?(class|function|async\s+function|const\s+\w+\s*=\s*\(|let\s+\w+\s*=\s*\()\s*\w*)",
    "js": r"^(\s*(export\s+)?(class|function|async\s+function|const\s+\w+\s*=\s*\(|let\s+\w+\s*=\s*\()\s*\w*)",
    "rust": r"^(\s*(pub\s+)?(fn|struct|enum|impl|trait)\s+\w+)",
    "go": r"^(\s*(func|type)\s+\w+)",
}


def window_chunks(code_lines: Column, size: int = 80, overlap: int = 40) -> Column:
    """Array of (start, text): windows of lines by a stride, the last one reaching the end; repeats stay."""
    step = size - overlap
    if step <= 0:
        raise ValueError("overlap must be smaller than the window")

    def cut(got):
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size(got) - size) / step)).cast("int"))
        return F.when(F.size(got) > 0, F.transform(starts, lambda i: F.struct((i * step).alias("start"), F.array_join(F.slice(got, i * step + 1, F.lit(size)), "\n").alias("text"))))

    return text.let(code_lines, cut)


def sliding_chunks(code: Column, size: int = 80, overlap: int = 40) -> Column:
    """Array of chunk texts, equal ones once, in order of first appearance."""
    return F.array_distinct(F.transform(window_chunks(text.split_lines(code), size, overlap), lambda c: c["text"]))


def line_chunks(code: Column, language: str = "python") -> Column:
    """Chunks that begin at lines which open a definition; blank chunks are dropped."""
    opens = LINE_DEFINITIONS.get(language.lower(), LINE_DEFINITIONS["python"])

    def cut(got):
        starts = F.filter(F.transform(got, lambda s, i: F.when((i == 0) | s.rlike(opens), i)), lambda i: i.isNotNull())
        return F.transform(starts, lambda a, i: F.array_join(F.slice(got, a + 1, F.coalesce(F.get(starts, i + 1), F.size(got)) - a), "\n"))

    return F.filter(text.let(F.split(code, "\n"), cut), lambda c: text.strip(c) != "")


def split_functions(code: str, language: str = "python") -> list[str]:
    """Text before the first definition, then from each definition to the next, stripped, blank ones dropped."""
    opens = re.compile(DEFINITIONS.get(language.lower(), DEFINITIONS["python"]), re.MULTILINE)
    cuts = [m.start() for m in opens.finditer(code)]
    bounds = sorted({0, *cuts, len(code)}) if cuts else [0, len(code)]
    pieces = [code[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
    return [p.strip() if cuts else p for p in pieces if p.strip()]


def split_python(code: str) -> list[str]:
    """Top-level functions and classes of Python code with their decorators, line ends kept.

    Code that does not parse falls back to split_functions."""
    try:
        body = ast.parse(code).body
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return split_functions(code, "python")
    got = code.splitlines(keepends=True)
    if not got:
        return split_functions(code, "python")
    kinds = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
    starts = sorted(min([d.lineno for d in node.decorator_list[:1]] + [node.lineno]) - 1 for node in body if isinstance(node, kinds))
    if not starts:
        return [code]
    bounds = [*starts, len(got)]
    head = ["".join(got[: starts[0]])] if starts[0] else []
    return head + [c for a, b in zip(bounds, bounds[1:], strict=False) if (c := "".join(got[a:b])).strip()]


@F.pandas_udf(ArrayType(StringType()))
def function_chunks(code: pd.Series, language: pd.Series) -> pd.Series:
    """Chunks by pattern of the row's language."""
    return pd.Series([None if c is None else split_functions(c, lang or "python") for c, lang in zip(code, language, strict=True)])


@F.pandas_udf(ArrayType(StringType()))
def syntax_chunks(code: pd.Series, language: pd.Series) -> pd.Series:
    """Chunks by the syntax tree for Python, by pattern otherwise."""
    return pd.Series([None if c is None else split_python(c) if (lang or "python").lower() == "python" else split_functions(c, lang) for c, lang in zip(code, language, strict=True)])


def rank_chunks(chunks: DataFrame, k: int, by: str = "id") -> DataFrame:
    """chunks(id, idx, text, vec, query_vec) to the k most similar of each id with their similarity."""
    scored = chunks.withColumn("similarity", metrics.cosine(F.col("vec"), F.col("query_vec")))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("similarity"), "idx"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def local_context(chunks: Column, query_vec: Column, vector, k: int) -> Column:
    """The k chunks of a row most similar to its query vector, in source order, joined by blank lines.

    chunks is array<struct<start,text>> of the row itself, so nothing is exploded or shuffled; similarities
    are rounded to nine digits and ties go to the earlier chunk."""

    def best(q):
        scored = F.transform(chunks, lambda c: F.struct((-F.round(metrics.cosine(vector(c["text"]), q), 9)).alias("off"), c["start"].alias("start"), c["text"].alias("text")))
        top = F.slice(F.array_sort(scored), 1, k)
        return F.array_join(F.transform(F.array_sort(F.transform(top, lambda c: F.struct(c["start"].alias("start"), c["text"].alias("text")))), lambda c: c["text"]), "\n\n")

    return text.let(query_vec, best)


def context_in_source_order(ranked: DataFrame, by: str = "id") -> DataFrame:
    """The kept chunks of each id joined by blank lines in the order of the source."""
    return ranked.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda c: c["text"]), "\n\n").alias("context"))


def context_by_similarity(ranked: DataFrame, by: str = "id") -> DataFrame:
    """The kept chunks of each id joined by blank lines, most similar first."""
    return ranked.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda c: c["text"]), "\n\n").alias("context"))


#: Bytes of vectors, as doubles, in one side of a tile, and similarities that are held at once.
TILE_BYTES, SLAB = 16 << 20, 1 << 20


def _unit_vectors(side: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The ids and unit vectors of a table, by id; a zero vector stays."""
    ids, flat = side["id"].to_numpy(), pc.list_flatten(side["vec"]).to_numpy().astype(np.float64)
    if side["vec"].null_count or len(flat) % len(ids) or not (pc.list_value_length(side["vec"]).to_numpy() == len(flat) // len(ids)).all():
        raise ValueError("vectors must be of one length")
    order, v = np.argsort(ids, kind="stable"), flat.reshape(len(ids), -1)
    return ids[order], (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300))[order]


def nearest(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int, slab: int = SLAB) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query id, id and similarity of the k rows most similar to each query; unit vectors, both sides by id.

    Similarities have nine digits and ties go to the lesser id. At most ``slab`` of them exist at a time: each
    slab leaves those that reach what is the k-th best so far."""
    high = max(1, min(len(q), 256, slab))
    wide, out = max(1, slab // high), []
    for a in range(0, len(q), high):
        own, block = query_ids[a : a + high], q[a : a + high]
        n = len(own)
        least, last = np.full(n, -np.inf), np.full(n, np.iinfo(np.int64).max)
        at, to, value = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for b in range(0, len(v), wide):
            part = ids[b : b + wide]
            sims = block @ v[b : b + wide].T
            low, top = np.searchsorted(part, own), np.searchsorted(part, own, "right")
            for i in np.flatnonzero(top > low):
                sims[i, low[i] : top[i]] = -np.inf
            seen = sims >= least[:, None] - 1e-9
            if k < len(part) and np.count_nonzero(seen) > 8 * k * n:  # no good bound yet: the slab's own k-th best is one
                np.nan_to_num(sims, copy=False, nan=-np.inf, posinf=-np.inf, neginf=-np.inf)
                seen = sims >= np.maximum(np.partition(sims, -k, axis=1)[:, -k], least)[:, None] - 1e-9
            i, j = np.nonzero(seen)
            s, j = np.round(sims[i, j], 9), part[j]
            good = np.isfinite(s) & ((s > least[i]) | ((s == least[i]) & (j < last[i])))
            at, to, value = np.concatenate([at, i[good]]), np.concatenate([to, j[good]]), np.concatenate([value, s[good]])
            order = np.lexsort((to, -value, at))
            at, to, value = at[order], to[order], value[order]
            rank = np.arange(len(at)) - np.searchsorted(at, at)
            keep = rank < k
            at, to, value, rank = at[keep], to[keep], value[keep], rank[keep]
            full = rank == k - 1
            least[at[full]], last[at[full]] = value[full], to[full]
        out.append((own[at], to, value))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def top_k(rows: DataFrame, queries: DataFrame, k: int, block: int | None = None) -> DataFrame:
    """rows(id, vec), queries(id, vec) to (query_id, id, similarity, rank): exact, in tiles of queries and rows.

    Both sides are dealt by their ids to parts of at most about TILE_BYTES of vectors (``block`` sets the queries of a part);
    each pair of parts meets in one task, in slabs, and keeps k rows a query. The driver counts and holds no vector.
    A query never finds itself; a row without an id is none's."""
    spark = rows.sparkSession
    rows, queries = (d.select(F.col("id").cast("long").alias("id"), "vec").where("id IS NOT NULL") for d in (rows, queries))
    n, size = rows.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    per = max(1, TILE_BYTES // (8 * max(size or 1, 2 * k)))
    blocks = max(1, math.ceil(queries.count() / (block or per)))
    parts = max(math.ceil(n / per), min(math.ceil(n / 1024), math.ceil(2 * spark.sparkContext.defaultParallelism / blocks)), 1)
    deal = lambda count: F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    asked = queries.select("id", "vec", deal(blocks).alias("block"), every(parts).alias("part"))
    found = rows.select("id", "vec", every(blocks).alias("block"), deal(parts).alias("part"))

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        got = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        if len(left) and len(right):
            got = nearest(*_unit_vectors(left), *_unit_vectors(right), k)
        return pa.table(dict(zip(("query_id", "id", "similarity"), got, strict=True)))

    out = asked.groupBy("block", "part").cogroup(found.groupBy("block", "part")).applyInArrow(tile, "query_id long, id long, similarity double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)
