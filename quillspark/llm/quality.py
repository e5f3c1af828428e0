"""Quality classifier by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are the texts whose label is 1; label 0 is never read. Unlabelled web text is a sample of
the documents themselves. The class prior is estimated, by the best bin: a discriminator of positives and
unlabelled texts is fitted on four fifths and scores the fifth, and the prior is the share of unlabelled texts
over the share of positives above the threshold where the upper confidence bound of that ratio is least.
A small network over text statistics then minimises prior*R_p(+) + max(0, R_u(-) - prior*R_p(-)) with the
logistic loss; where the bracket turns negative, its gradient is reversed.

Both samples hold at most ``max_rows`` rows outside the held-out fold, those of smallest digest; scoring
covers every whole text.

Defined cases: null text is empty and is scored as such; an id that is labelled twice counts once; rows of
null label or id are not learnt from; without positives or without unlabelled rows the score is 0.5; null
doc_id counts as empty text in the fold; repeated rows get equal scores; other columns are kept by keep_good()
and never used.
"""

from __future__ import annotations

import string
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import shared

#: Rows of each of the two samples that are learnt from.
MAX_ROWS = 10_000
FOLDS, THRESHOLD = 5, 0.3
MARKS = string.punctuation.encode()
_OUT = "doc_id long, held_out boolean, score double"


def statistics(raw: bytes) -> list[float]:
    """Numbers that describe a whole text; none depends on labels, language tag, source or id."""
    words = raw.split()
    n, size = len(words), len(raw)
    if not n:
        return [0.0] * (len(MARKS) + 18)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lengths = np.fromiter(map(len, words), np.int64, n)
    upper, lower = hist[65:91].sum(), hist[97:123].sum()
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False))) if n > 1 else 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    same = sum(map(bytes.__eq__, words, words[1:])) if n > 1 else 0
    marks = [float(np.log1p(50 * hist[c] / n)) for c in MARKS]
    return [
        np.log1p(n), np.log1p(size), lengths.mean(), lengths.std(), float(lengths.max() > 40), len(counts) / n, len(counts) / n**0.7,
        pairs / max(n - 1, 1), same / n, counts.most_common(1)[0][1] / n, upper / max(upper + lower, 1), (upper + lower) / size,
        hist[48:58].sum() / size, hist[128:].sum() / size, np.log1p(20 * len(lines) / n), len(set(lines)) / max(len(lines), 1),
        sum(w[0] < 91 and w[0] > 64 for w in words) / n, sum(w[-1:] == b"." for w in words) / n, *marks,
    ]


def fold(doc_id, folds: int):
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


class Model:
    """Standardisation and a network with one hidden layer; plain arrays, so it is small to ship."""

    def __init__(self, prior: float, n: int, hidden: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.prior, self.mean, self.scale = prior, np.zeros(n), np.ones(n)
        self.w = [rng.normal(0, n**-0.5, (n, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.array([np.log(prior / (1 - prior))]), rng.normal(0, 0.01, n)]
        self.fitted = False

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def logits(self, z: np.ndarray):
        h = np.tanh(z @ self.w[0] + self.w[1])
        return h @ self.w[2] + self.w[3][0] + z @ self.w[4], h

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), self.prior)
        return _sigmoid(self.logits(self.standard(x))[0])

    def gradients(self, z: np.ndarray, g: np.ndarray, h: np.ndarray, decay: float) -> list[np.ndarray]:
        """Of the weights, from the gradient g of the logits; decay shrinks what multiplies inputs."""
        back = np.outer(g, self.w[2]) * (1 - h * h)
        return [z.T @ back + decay * self.w[0], back.sum(0), h.T @ g + decay * self.w[2], np.array([g.sum()]), z.T @ g + decay * self.w[4]]

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray, gradient, steps: int = 400, rate: float = 0.02, decay: float = 1e-3) -> None:
        """Descend by ``gradient``, a function of the logits, the number of positives before them and the prior."""
        self.mean, self.scale = unlabelled.mean(0), unlabelled.std(0) + 1e-6
        z = self.standard(np.concatenate([positive, unlabelled]))
        moment, square = [0.0] * 5, [0.0] * 5
        for t in range(1, steps + 1):
            f, h = self.logits(z)
            for i, d in enumerate(self.gradients(z, gradient(f, len(positive), self.prior), h, decay)):
                moment[i] = 0.9 * moment[i] + 0.1 * d
                square[i] = 0.999 * square[i] + 0.001 * d * d
                self.w[i] = self.w[i] - rate * (moment[i] / (1 - 0.9**t)) / (np.sqrt(square[i] / (1 - 0.999**t)) + 1e-8)
        self.fitted = True


def _sigmoid(f: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


def risk_parts(f: np.ndarray, n_p: int, prior: float) -> tuple[float, float]:
    """prior*R_p(+) and the bracket R_u(-) - prior*R_p(-) with the logistic loss; f has the positives first."""
    return prior * np.logaddexp(0, -f[:n_p]).mean(), np.logaddexp(0, f[n_p:]).mean() - prior * np.logaddexp(0, f[:n_p]).mean()


def nonnegative_gradient(f: np.ndarray, n_p: int, prior: float) -> np.ndarray:
    """Of the unbiased risk by the logits; of the bracket alone, reversed, where that is negative."""
    s, g = _sigmoid(f), np.empty(len(f))
    if risk_parts(f, n_p, prior)[1] >= 0:
        g[:n_p] = -prior / n_p
        g[n_p:] = s[n_p:] / (len(f) - n_p)
    else:
        g[:n_p] = prior * s[:n_p] / n_p
        g[n_p:] = -s[n_p:] / (len(f) - n_p)
    return g


def discriminating_gradient(f: np.ndarray, n_p: int, prior: float) -> np.ndarray:
    """Of the balanced logistic loss that tells positives from unlabelled texts."""
    s, g = _sigmoid(f), np.empty(len(f))
    g[:n_p] = (s[:n_p] - 1) / n_p
    g[n_p:] = s[n_p:] / (len(f) - n_p)
    return g


def best_bin(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1, gamma: float = 0.01) -> float:
    """The share of positives among unlabelled texts from the scores of a discriminator."""
    cuts = np.unique(positive)
    share = lambda x: 1 - np.searchsorted(np.sort(x), cuts) / len(x)
    q_p, q_u = share(positive), share(unlabelled)
    slack = (1 + gamma) * sum(np.sqrt(np.log(4 / delta) / (2 * len(x))) for x in (positive, unlabelled))
    at = np.argmin((q_u + slack) / q_p)
    return float(np.clip(q_u[at] / q_p[at], 0.02, 0.98))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, parts: int = 5, decay: float = 3e-3) -> float:
    """Class prior of the unlabelled texts: each part is scored by a discriminator fitted on the others."""
    if len(positive) < 2 * parts or len(unlabelled) < 2 * parts:
        return 0.5
    scores = [np.empty(len(positive)), np.empty(len(unlabelled))]
    for k in range(parts):
        own = [np.arange(len(x)) % parts == k for x in (positive, unlabelled)]
        model = Model(0.5, positive.shape[1])
        model.fit(positive[~own[0]], unlabelled[~own[1]], discriminating_gradient, steps=100, decay=decay)
        for out, x, part in zip(scores, (positive, unlabelled), own, strict=True):
            out[part] = model.logits(model.standard(x[part]))[0]
    return best_bin(*scores)


def _measure(batches):
    import pyarrow as pa

    for b in batches:
        made = [statistics(t) for t in shared.text_bytes(b.column("text"))]
        yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(made, pa.list_(pa.float64()))], names=["digest", "x"])


def _sample(texts: DataFrame, max_rows: int) -> np.ndarray:
    """Statistics of the max_rows texts of smallest digest, in its order; Spark keeps that many rows a task."""
    rows = texts.select("digest", "text").mapInArrow(_measure, "digest long, x array<double>").orderBy("digest", "x").limit(max_rows).collect()
    return np.array([r.x for r in rows]) if rows else np.empty((0, len(statistics(b""))))


def samples(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Statistics of trusted positives and of unlabelled documents, outside fold 0, at most max_rows each."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.where(F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != 0)).withColumn("digest", F.xxhash64("doc_id", "text"))
    seen = labels.where(F.col("quality").cast("int") == 1).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    taken = seen.where(F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != 0)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    positive = texts.join(F.broadcast(taken), "doc_id")  # at most max_rows ids
    # one pass over whole tables measures little more than max_rows texts: a digest below a share of its range
    share = min(1.0, 1.5 * max_rows / max(1, docs.count()))
    unlabelled = texts.where(F.pmod("digest", F.lit(1 << 40)) < int(share * (1 << 40)))
    return _sample(positive, max_rows), _sample(unlabelled.withColumn("digest", F.pmod("digest", F.lit(1 << 40))), max_rows)


def fit(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, max_rows: int = MAX_ROWS) -> Model:
    """Learn from trusted positives and unlabelled documents."""
    positive, unlabelled = samples(docs, labels, folds, max_rows)
    model = Model(estimate_prior(positive, unlabelled), unlabelled.shape[1])
    if len(positive) and len(unlabelled):
        model.fit(positive, unlabelled, nonnegative_gradient)
    else:
        model.prior = 0.5
    return model


def _scorer(model: Model):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            x = np.array([statistics(t) for t in shared.text_bytes(b.column("text"))]).reshape(b.num_rows, -1)
            made = model.scores(x) if b.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(made, pa.float64())], names=["doc_id", "held_out", "score"])

    return run


def score(docs: DataFrame, model: Model, folds: int = FOLDS) -> DataFrame:
    """docs(doc_id, text) to doc_id, held_out, score."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (fold(F.col("doc_id"), folds) == 0).alias("held_out"))
    return rows.mapInArrow(_scorer(model), _OUT)


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score reaches the threshold, all columns kept."""
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            raw = shared.text_bytes(b.column(at))
            if raw:
                yield b.filter(pa.array(model.scores(np.array([statistics(t) for t in raw])) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op7_query(spark, sf_dir) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, shared.table(spark, sf_dir, "labels")))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
