"""Toxicity by a classifier chain.

Categories are predicted one after another by logistic models over the presence of words
(bare, the first ``STEM`` letters of longer ones, and the run of signs that a word ends in,
which tells junk) and the logarithm of their number, as long texts hold words by chance; each later model also gets the earlier categories' probabilities.  In fitting, those are
out-of-fold predictions (``folds`` folds), so a later model sees the errors that it will
meet.  A category's threshold is the one of best F-beta (``BETA``) on its out-of-fold predictions.

Fitting uses a hash sample of ``max_rows`` labelled documents in expectation; words and
their frequencies by category are counted with Spark over the sample's whole texts, and the
``max_words`` with the strongest log odds in any category are the features.  All documents
are scored, whole texts.

Defined cases: rows with a null label or text are not fitted on; a null or empty text has
no words and gets the base rates; a category without both outcomes in the sample gets its
rate as a constant and no positive verdicts; repeated rows are scored alike.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnlake.llm.common import sample_share, share, ship, stored

EDGES = "\"'`()[]{}<>.,;:!?*#&%$_~|«»„“”’…-=+/\\"


STEM = 5
BETA = 2.0  # of the thresholds: a document missed costs more than a false alarm


def words_of(text: str | None) -> set[str]:
    raw = set((text or "").lower().split())
    bare = {w.strip(EDGES) for w in raw}
    signs = {w[len(w.rstrip(EDGES)):] for w in raw if w[-2:-1] in EDGES or len(w) == 1}
    return (bare | signs | {w[:STEM] + "-" for w in bare if len(w) > STEM}) - {""}


def _length(words: int) -> float:
    """The length feature, between 0 and about 1."""
    return float(np.log1p(words) / 10)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 2e-4,
                 steps: int = 400) -> np.ndarray:
    """Weights (the last is the intercept) by accelerated gradient descent."""
    n, d = x.shape
    x = np.hstack([x, np.ones((n, 1), x.dtype)])
    probe = np.ones(d + 1, x.dtype)  # power iteration for the step size
    for _ in range(8):
        probe = x.T @ (x @ probe)
        probe /= np.linalg.norm(probe) or 1
    step = 1 / (np.linalg.norm(x @ probe) ** 2 / (4 * n) + penalty)
    w = at = np.zeros(d + 1, x.dtype)
    shrink = np.full(d + 1, penalty, x.dtype)
    shrink[-1] = 0
    for i in range(steps):
        grad = x.T @ (_sigmoid(x @ at) - y).astype(x.dtype) / n + shrink * at
        new = at - step * grad
        at, w = new + i / (i + 3) * (new - w), new
    return w


def _apply(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return _sigmoid(x @ w[:-1] + w[-1])


def best_threshold(p: np.ndarray, y: np.ndarray, beta: float = 1.0) -> float:
    """The probability of best F-beta, in the middle of its gap."""
    order = np.argsort(-p, kind="stable")
    p, hits = p[order], np.cumsum(y[order])
    f1 = (1 + beta ** 2) * hits / (np.arange(1, len(p) + 1) + beta ** 2 * y.sum())
    f1[:-1][p[:-1] == p[1:]] = -1  # equal probabilities go together
    i = int(np.argmax(f1))
    return float((p[i] + (p[i + 1] if i + 1 < len(p) else 0)) / 2)


@dataclasses.dataclass
class Chain:
    names: list[str]
    words: dict[str, int]
    models: list[np.ndarray | float]  # weights, or a constant rate
    thresholds: list[float]

    @classmethod
    def fit(cls, names: list[str], words: dict[str, int], x: np.ndarray, y: np.ndarray,
            fold: np.ndarray, folds: int) -> Chain:
        models, thresholds, given = [], [], np.zeros((len(x), 0), x.dtype)
        for j in range(len(names)):
            target, full = y[:, j], np.hstack([x, given])
            if len(set(target.tolist())) < 2:
                rate = float(target.mean()) if len(target) else 0.0
                models.append(rate)
                thresholds.append(2.0)
                out = np.full(len(x), rate)
            else:
                models.append(fit_logistic(full, target))
                out = np.zeros(len(x))
                for f in range(folds):
                    rest = fold != f
                    if not rest.all() and rest.any():
                        out[~rest] = _apply(fit_logistic(full[rest], target[rest]), full[~rest])
                thresholds.append(best_threshold(out, target, BETA))
            given = np.hstack([given, out[:, None].astype(x.dtype)])
        return cls(names, words, models, thresholds)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """(texts, categories) probabilities."""
        out, d = np.zeros((len(texts), len(self.names))), len(self.words)
        has, length = [], np.zeros(len(texts))
        for i, t in enumerate(texts):
            found = words_of(t)
            length[i] = _length(len(found))
            has.append([self.words[w] for w in found & self.words.keys()])
        rows = np.repeat(np.arange(len(texts)), [len(h) for h in has])
        cols = np.array([c for h in has for c in h], np.int64)
        for j, w in enumerate(self.models):
            if isinstance(w, float):
                out[:, j] = w
                continue
            z = np.bincount(rows, weights=w[cols], minlength=len(texts)).astype(float)
            out[:, j] = _sigmoid(z + length * w[d] + out[:, :j] @ w[d + 1:d + 1 + j] + w[-1])
        return out


def fit(df: DataFrame, labels: DataFrame, categories: dict[str, str], id_col: str = "doc_id",
        text_col: str = "text", max_rows: int = 8000, max_words: int = 1500, min_docs: int = 5,
        least_strength: float = 5.0, folds: int = 3) -> Chain:
    ship(df.sparkSession)
    names = list(categories)
    wanted = labels.select(id_col, *(F.expr(c).cast("int").alias(f"y{i}")
                                     for i, c in enumerate(categories.values()))).dropna()
    sample = df.select(id_col, F.col(text_col).alias("text")).join(
        F.broadcast(sample_share(wanted, max_rows, id_col)), id_col).where("text IS NOT NULL")
    ys = [f"y{i}" for i in range(len(names))]
    # exact copies count once, with their majority label: else their words look telling
    sample = stored(sample.groupBy("text").agg(
        *((F.avg(y) >= 0.5).cast("int").alias(y) for y in ys)), "labelled")

    def presence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(w, *y) for t, *y in batch[["text", *ys]].itertuples(index=False)
                    for w in words_of(t)]
            got = pd.DataFrame(rows, columns=["w", *ys])
            got["n"] = 1
            yield got.groupby("w", as_index=False)[["n", *ys]].sum()

    kinds = ", ".join(f"{c} long" for c in ("n", *ys))
    counted = sample.mapInPandas(presence, f"w string, {kinds}").groupBy("w").agg(
        *(F.sum(c).alias(c) for c in ("n", *ys))).where(F.col("n") >= min_docs)
    size = sample.agg(F.count("*").alias("n"), *(F.sum(y).alias(y) for y in ys)).first()

    def strength(y: str) -> Column:
        """Log odds of the word in the category against the rest, by its standard error."""
        pos, neg = float(size[y] or 0), float(size["n"] - (size[y] or 0))
        a, b = F.col(y) + 0.5, F.col("n") - F.col(y) + 0.5
        odds = F.log(a / (F.lit(pos) - F.col(y) + 0.5)) - F.log(b / (F.lit(neg) - (
            F.col("n") - F.col(y)) + 0.5))
        return F.abs(odds) / F.sqrt(1 / a + 1 / b)

    most = F.greatest(*map(strength, ys)) if len(ys) > 1 else strength(ys[0])
    strongest = counted.select("w", most.alias("s")).where(F.col("s") >= least_strength).orderBy(
        F.desc("s"), "w").limit(max_words)
    words = {r.w: i for i, r in enumerate(strongest.collect())}
    shared = share(df.sparkSession, words)

    @F.pandas_udf("has array<int>, length double")
    def features(texts: pd.Series) -> pd.DataFrame:
        known = shared.value
        rows = [(sorted(known[w] for w in f & known.keys()), _length(len(f)))
                for f in map(words_of, texts)]
        return pd.DataFrame(rows, columns=["has", "length"])

    rows = sample.select(features("text").alias("f"), F.pmod(
        F.xxhash64(F.lit("fold"), "text"), F.lit(folds)).alias("fold"), *ys).select("f.*", "fold", *ys).collect()
    x = np.zeros((len(rows), len(words) + 1), np.float32)
    for i, r in enumerate(rows):
        x[i, r["has"]] = 1
        x[i, -1] = r.length
    y = np.array([[r[c] for c in ys] for r in rows], float).reshape(len(rows), len(ys))
    order = np.lexsort((*y.T, np.array([hash(tuple(r["has"])) for r in rows], np.int64))) \
        if rows else np.zeros(0, int)
    fold = np.array([r.fold for r in rows], int)
    return Chain.fit(names, words, x[order], y[order], fold[order], folds)


def classify(df: DataFrame, chain: Chain, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """id, p_<category> and <category> (at its threshold) of every row."""
    ship(df.sparkSession)
    shared = share(df.sparkSession, chain)
    names = chain.names
    kinds = ", ".join([f"p_{n} double" for n in names] + [f"{n} boolean" for n in names])

    @F.pandas_udf(kinds)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            p = shared.value.score(list(texts))
            yield pd.DataFrame(
                {f"p_{n}": p[:, j] for j, n in enumerate(names)}
                | {n: p[:, j] >= shared.value.thresholds[j] for j, n in enumerate(names)})

    return df.select(id_col, score(F.col(text_col)).alias("r")).select(id_col, "r.*")
