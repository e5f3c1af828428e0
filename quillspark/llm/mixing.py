"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Each document gets the exponential key -ln(u)/w with u from a digest of its id and text and w its quality
weight. Within a source documents are ordered by key; complete epochs take every document, and the rest of
the source's token budget goes to the documents whose middle lies within it by a prefix sum. A hot source
is split: keys fall into bins whose number grows with the square root of the source's rows, so neither the
bins of a source nor the rows of a bin are many; bins are summed and accumulated, and the fine order runs
within a bin.

Defined cases: null text has size 0; null source is a source of its own and comes last; rows that are equal
in id and text share a key and are interchangeable; an empty table gives no rows; a source of size 0 has
target 0; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm import shared

#: Weights that sources take in turn, and the share of all sizes that the mix takes.
WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2
#: Marks that speak against a document's quality weight.
JUNK = "!$%&*#|"
WORD = r"[^\x20\x09-\x0D]+"
#: Bins per octave of keys for each square root of a source's rows.
BINS = 0.25


def quality_weight(text):
    """1 for text without junk marks down to 0.05 where a fifth or more of it is junk."""
    n = F.length(text)
    junk = (n - F.length(F.translate(text, JUNK, ""))) / F.greatest(n, F.lit(1))
    return F.greatest(F.lit(0.05), F.lit(1.0) - 5 * junk)


def ranked(names: DataFrame, column: str = "source") -> DataFrame:
    """names, distinct in the column, with their place by code point from 0 on, null last, and no window over all.

    The column's range partitioning cuts it; sizes of ranges are accumulated and ranks run within a range."""
    dealt = shared.written(names.repartitionByRange(F.col(column).isNull(), F.col(column)).withColumn("_r", F.spark_partition_id()), "mix-sources")
    sizes = sorted((r[0], r[1]) for r in dealt.groupBy("_r").count().collect())  # a row per shuffle partition
    start, held = {}, 0
    for r, n in sizes:
        start[r], held = held, held + n
    from_ = F.coalesce(F.element_at(F.expr("map(" + ",".join(f"{r},{n}L" for r, n in start.items()) + ")"), F.col("_r")), F.lit(0)) if start else F.lit(0)
    within = F.row_number().over(Window.partitionBy("_r").orderBy(F.col(column).isNull(), column))
    return dealt.withColumn("rank", from_ + within - 1).drop("_r")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """sizes(source, source_size) to target: weighted shares, stopped at cap sizes, the excess reshared.

    The level per unit of weight rises as sources reach their caps; it is found by aggregates over the sources,
    a few at most, since each round only adds capped ones."""
    step = ranked(sizes).withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int")).cast("double"))
    step = step.withColumn("most", (cap * F.col("source_size")).cast("double"))
    total = share * float(step.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    held, free, level, n = 0.0, 0.0, 0.0, -1
    while True:
        capped = (F.col("most") <= level * F.col("w")) if n >= 0 else F.lit(False)
        got = step.agg(F.count_if(capped), F.coalesce(F.sum(F.when(capped, F.col("most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~capped, F.col("w"))), F.lit(0.0))).first()
        if got[0] == n or not got[2]:
            held, free = got[1], got[2]
            break
        n, held, free = got
        level = (total - held) / free
    capped = F.col("most") <= level * F.col("w")
    target = F.when(capped, F.col("most")).otherwise(F.lit(total - held) * F.col("w") / F.lit(free or 1.0))
    return step.select("source", "source_size", target.alias("target"), *(c for c in ("n_rows",) if c in sizes.columns))


def mix(docs: DataFrame, seed: str = "mix-1", weights=WEIGHTS, share: float = SHARE, weight=None) -> DataFrame:
    """docs(doc_id, text, source) to doc_id, size, source_size, target, taken, key, source.

    ``weight`` is a positive quality weight of a row, a Column such as a classifier's score; without one it is
    quality_weight() of the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), text).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), (-F.log(u) / (quality_weight(text) if weight is None else F.greatest(F.coalesce(weight.cast("double"), F.lit(0.0)), F.lit(1e-6)))).alias("key"))
    made = shared.written(made, "mix")
    sizes = made.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    plan = source_targets(sizes, weights, share)
    plan = plan.select(F.col("source").alias("_s"), "source_size", "target", F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).alias("epochs"), F.ceil(F.sqrt("n_rows") * BINS).alias("fine"))
    binned = made.join(plan, made.source.eqNullSafe(plan._s)).withColumn("bin", F.floor(F.log2("key") * F.col("fine")))
    sums = binned.groupBy("_s", "bin").agg(F.sum("size").alias("bin_size"))
    run = Window.partitionBy("_s").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    start = sums.select(F.col("_s").alias("_t"), F.col("bin").alias("_b"), F.coalesce(F.sum("bin_size").over(run), F.lit(0)).alias("bin_start"))
    placed = binned.join(start, F.col("_s").eqNullSafe(F.col("_t")) & (F.col("bin") == F.col("_b")))
    fine = Window.partitionBy("_s", "bin").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("bin_start") + F.coalesce(F.sum("size").over(fine), F.lit(0))
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    extra = F.when(before + F.col("size") / 2 <= rest, F.col("size")).otherwise(F.lit(0))
    return placed.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + extra).cast("long").alias("taken"), "key")


def op8_query(spark, sf_dir) -> DataFrame:
    return mix(shared.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t FROM documents
), m AS (
  SELECT doc_id, source,
    CAST(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    -ln((CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || t), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
      / greatest(0.05::DOUBLE, 1.0::DOUBLE - 5 * ((length(t) - length(translate(t, '!$%&*#|', '')))::DOUBLE / greatest(length(t), 1))) AS key
  FROM d
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM m GROUP BY source
), w AS (
  SELECT *, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS INTEGER) + 1] AS DOUBLE) AS w,
    CAST(2 * source_size AS DOUBLE) AS most, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS total FROM s
), c AS (
  SELECT *, most * (sum(w) OVER (ORDER BY most / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    <= (total - coalesce(sum(most) OVER (ORDER BY most / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w AS capped FROM w
), g AS (
  SELECT source, source_size, CASE WHEN capped THEN most ELSE
    (total - coalesce(sum(CASE WHEN capped THEN most END) OVER (), 0)) * w / (sum(CASE WHEN NOT capped THEN w END) OVER ()) END AS target FROM c
), p AS (
  SELECT m.doc_id, m.size, g.source_size, g.target,
    CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END AS epochs,
    coalesce(sum(m.size) OVER (PARTITION BY m.source ORDER BY m.key, m.doc_id, m.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM m JOIN g ON m.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + CASE WHEN before + size / 2.0 <= target - epochs * source_size THEN size ELSE 0 END AS BIGINT) AS taken
FROM p
"""
