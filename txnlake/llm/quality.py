"""Document quality by a factorisation machine.

A document is a sparse vector x: its distinct words and the sign runs that end them, hashed to
``BUCKETS`` places; structure statistics (lengths, shares of signs, capitals, digits and
repeats, lines), each cut into steps with one place a step; and the metadata columns given, cut
the same way.  The score is the logistic function of

    w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2),

all pairwise interactions of rank ``factors`` in time linear in the number of places.

Learning: ``max_rows`` labelled documents in expectation (a hash sample; documented bound), whole
texts; exact copies count once, with the share of label 1 among them; mini-batch steps of Adam
with numpy on the driver, the same on every run.  The model has a fixed size, so the broadcast
does not grow.  Every document is scored whole, in pieces of ``PIECE`` characters cut at white
space where there is some; words that occur in several pieces count once.

Defined cases: a null text is scored as an empty one, which has its structure places only; rows
without an id or a label are not learned from; without any labelled row every score is 0.5, with
labels of one kind only that rate, smoothed; repeated rows are scored alike; an empty table gives an
empty result; other columns of the input are not read.
"""

from __future__ import annotations

import dataclasses
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlake.llm.common import sample_share, share, ship, stored
from txnlake.llm.langid import held_out

BUCKETS = 1 << 15
PIECE = 500_000
STEPS = 16  # of one statistic
SIGNS = "\"'`()[]{}<>.,;:!?*#&%$_~|«»„“”’…-=+/\\@^"
STATISTICS = ("chars", "words", "word_length", "distinct", "most_frequent", "signs", "sign_ends",
              "capitals", "digits", "line_length", "repeated_lines", "alone_signs", "word_deviation",
              "doubled")


@functools.cache
def _kinds() -> np.ndarray:
    """Of each code point below 2^16: 1 capital, 2 digit, 3 sign, 4 white space, else 0."""
    kinds = np.zeros(1 << 16, np.uint8)
    for c in range(1 << 16):
        x = chr(c)
        kinds[c] = 1 if x.isupper() else 2 if x.isdigit() else 4 if x.isspace() else 0
    kinds[[ord(c) for c in SIGNS]] = 3
    return kinds


def _pieces(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > PIECE:
        end = max(text.rfind(c, at + 1, at + PIECE) for c in " \n\t") + 1 or at + PIECE
        yield text[at:end]
        at = end
    yield text[at:]


def _step(share: float) -> int:
    """The step of a value between 0 and 1: finer near both ends."""
    share = min(max(share, 0.0), 1.0)
    side = min(share, 1 - share)
    half = min(STEPS // 2 - 1, int(np.log2(side * 256 + 1)))
    return half if share <= 0.5 else STEPS - 1 - half


def _size_step(value: float) -> int:
    """The step of a value from 0 on, by its logarithm."""
    return min(STEPS - 1, int(np.log2(max(value, 0.0) + 1)))


def features(text: str | None, meta: tuple = ()) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of one document."""
    text = text or ""
    marks, seen, lines = set(), {}, {}
    kinds = np.zeros(5, np.int64)
    words = length = squares = ends = alone = n_lines = doubled = 0
    for piece in _pieces(text):
        code = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), "<u4")
        kinds += np.bincount(_kinds()[np.minimum(code, 0xFFFF)], minlength=5)
        parts = piece.split()
        for w in parts:
            seen[w] = seen.get(w, 0) + 1
        for line in piece.split("\n"):
            if line := line.strip():
                h = hash_of(line)
                lines[h] = lines.get(h, 0) + 1
                n_lines += 1
        words += len(parts)
        doubled += sum(map(str.__eq__, parts, parts[1:]))
    for w, n in seen.items():
        bare = w.strip(SIGNS)
        tail = w[len(w.rstrip(SIGNS)):]
        length += n * len(bare)
        squares += n * len(bare) ** 2
        if len(tail) > 1:
            ends += n
            marks.add("$" + tail[:8])
        if not bare:
            alone += n
            marks.add("$" + w[:8])
        else:
            marks.add(bare.lower() if len(bare) <= 64 else bare[:64].lower())
    top = max(seen.values(), default=0)
    some, chars = max(words, 1), max(int(kinds.sum()), 1)
    mean = length / some
    steps = {
        "chars": _size_step(len(text)), "words": _size_step(words), "word_length": _size_step(mean * 4),
        "distinct": _step(len(seen) / some), "most_frequent": _step(top / some),
        "signs": _step(kinds[3] / chars), "sign_ends": _step(ends / some),
        "capitals": _step(kinds[1] / chars), "digits": _step(kinds[2] / chars),
        "line_length": _size_step(len(text) / max(n_lines, 1)),
        "repeated_lines": _step(1 - len(lines) / max(n_lines, 1)), "alone_signs": _step(alone / some),
        "word_deviation": _size_step(4 * max(squares / some - mean * mean, 0.0) ** 0.5),
        "doubled": _step(doubled / some)}
    places = [BUCKETS + i * STEPS + steps[s] for i, s in enumerate(STATISTICS)]
    first = BUCKETS + len(STATISTICS) * STEPS
    for i, m in enumerate(meta):
        known = m is not None and m == m
        places.append(first + i * (STEPS + 1) + (_size_step(abs(m)) if known else STEPS))
    hashed = sorted({hash_of(m) % BUCKETS for m in marks})
    values = np.ones(len(hashed) + len(places), np.float32)
    values[:len(hashed)] = 1 / max(len(hashed), 1) ** 0.5
    return np.array(hashed + places, np.int64), values


def hash_of(x: str) -> int:
    return zlib.crc32(x.encode("utf-8", "surrogatepass"))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the rows between the starts; no part is empty."""
    return np.add.reduceat(values, starts, axis=0)


@dataclasses.dataclass
class Machine:
    bias: float
    w: np.ndarray  # (places,)
    v: np.ndarray  # (places, factors)

    @classmethod
    def empty(cls, rate: float, metas: int, factors: int) -> Machine:
        places = BUCKETS + len(STATISTICS) * STEPS + metas * (STEPS + 1)
        start = np.random.default_rng(7).normal(0, 0.03, (places, factors)).astype(np.float32)
        return cls(float(np.log(rate / (1 - rate))), np.zeros(places, np.float32), start)

    def logits(self, places: np.ndarray, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        vx = self.v[places] * x[:, None]
        both = _sums(vx, starts) ** 2 - _sums(vx * vx, starts)
        return self.bias + _sums(self.w[places] * x, starts) + both.sum(1) / 2

    def score(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not docs:
            return np.zeros(0)
        starts = np.cumsum([0] + [len(p) for p, _ in docs[:-1]])
        return _sigmoid(self.logits(np.concatenate([p for p, _ in docs]),
                                    np.concatenate([x for _, x in docs]), starts).astype(float))

    def learn(self, docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, passes: int,
              batch: int, rate: float, penalty: float) -> None:
        """Adam over mini-batches, in an order drawn by a fixed seed."""
        draw, state, t = np.random.default_rng(11), {}, 0

        def move(name: str, value: np.ndarray, grad: np.ndarray) -> np.ndarray:
            m, s = state.get(name, (np.zeros_like(grad), np.zeros_like(grad)))
            m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad * grad
            state[name] = m, s
            return value - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(s / (1 - 0.999 ** t)) + 1e-8)

        for _ in range(passes):
            order = draw.permutation(len(docs))
            for at in range(0, len(docs), batch):
                t += 1
                some = order[at:at + batch]
                places = np.concatenate([docs[i][0] for i in some])
                x = np.concatenate([docs[i][1] for i in some])
                sizes = np.array([len(docs[i][0]) for i in some])
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                vx = self.v[places] * x[:, None]
                sums = _sums(vx, starts)
                z = self.bias + _sums(self.w[places] * x, starts) + (
                    sums ** 2 - _sums(vx * vx, starts)).sum(1) / 2
                err = ((_sigmoid(z) - y[some]) / len(some)).astype(np.float32)
                e = np.repeat(err, sizes) * x
                n = len(self.w)
                gw = np.bincount(places, e, n).astype(np.float32) + penalty * self.w
                gv = np.repeat(sums, sizes, axis=0) - vx
                gv = np.stack([np.bincount(places, e * gv[:, f], n) for f in range(gv.shape[1])],
                              axis=1).astype(np.float32) + penalty * self.v
                self.bias = float(move("b", np.float64(self.bias), np.float64(err.sum())))
                self.w, self.v = move("w", self.w, gw), move("v", self.v, gv)


def labelled_sample(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
                    meta_cols: tuple[str, ...], max_rows: int) -> DataFrame:
    """(text, m0 ..., y) of about ``max_rows`` distinct labelled texts, stored."""
    told = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).dropna()
    told = stored(sample_share(told.groupBy("id").agg(F.avg("y").alias("y")), max_rows, "id"), "labels")
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                     *(F.col(c).cast("double").alias(f"m{i}") for i, c in enumerate(meta_cols)))
    metas = [f"m{i}" for i in range(len(meta_cols))]
    texts = stored(docs.join(told, "id").groupBy("text").agg(
        *(F.min(m).alias(m) for m in metas), F.avg("y").alias("y")), "labelled")
    return sample_share(texts, max_rows, "text")


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", meta_cols: tuple[str, ...] = ("n_chars",), max_rows: int = 6000,
        factors: int = 8, passes: int = 12, batch: int = 128, rate: float = 0.01,
        penalty: float = 1e-5) -> Machine:
    """A machine of the labelled documents (labels: id, 0 or 1)."""
    ship(df.sparkSession)
    sample = labelled_sample(df, labels, id_col, text_col, label_col, meta_cols, max_rows)
    metas = [f"m{i}" for i in range(len(meta_cols))]

    @F.pandas_udf("p array<int>, x array<float>")
    def places(text: pd.Series, *meta: pd.Series) -> pd.DataFrame:
        rows = [features(t, m) for t, *m in zip(text, *meta)]
        return pd.DataFrame({"p": [p for p, _ in rows], "x": [x for _, x in rows]})

    rows = sample.select(F.xxhash64("text").alias("key"), F.xxhash64(F.lit(1), "text").alias("key2"),
                         places("text", *metas).alias("f"), "y").select("key", "key2", "f.*", "y").collect()
    rows.sort(key=lambda r: (r.key, r.key2))
    y = np.array([r.y for r in rows])
    if not len(y):
        machine = Machine.empty(0.5, len(meta_cols), factors)
        machine.v[:] = 0
        return machine
    machine = Machine.empty((y.sum() + 1) / (len(y) + 2), len(meta_cols), factors)
    if y.min() == y.max():
        machine.v[:] = 0
        return machine
    machine.learn([(np.array(r.p, np.int64), np.array(r.x, np.float32)) for r in rows], y,
                  passes, batch, rate, penalty)
    return machine


def scored(df: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text",
           meta_cols: tuple[str, ...] = ("n_chars",), least: float = 0.3) -> DataFrame:
    """id, held_out, score, predicted of every row."""
    ship(df.sparkSession)
    shared = share(df.sparkSession, machine)

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for text, *meta in batches:
            out, held, size = [], [], 0
            for t, *m in zip(text, *meta):
                held.append(features(t, m))
                size += len(held[-1][0])
                if size > 200_000:
                    out.append(shared.value.score(held))
                    held, size = [], 0
            yield pd.Series(np.concatenate([*out, shared.value.score(held)]))

    ids = F.col(id_col)
    got = df.select(ids, held_out(ids).alias("held_out"), score(
        F.col(text_col), *(F.col(c).cast("double") for c in meta_cols)).alias("score"))
    return got.withColumn("predicted", F.when(F.col("score") >= least, 1).otherwise(0))


def quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            label_col: str = "quality", meta_cols: tuple[str, ...] = ("n_chars",),
            least: float = 0.3, **fitting) -> DataFrame:
    """id, held_out, score, predicted of every row; learned from the labels not held out."""
    ids = F.col(id_col)
    known = labels.where(ids.isNotNull() & ~held_out(ids))
    machine = fit(df, known, id_col, text_col, label_col, meta_cols, **fitting)
    return scored(df, machine, id_col, text_col, meta_cols, least)
