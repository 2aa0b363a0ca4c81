"""Secret scans: fixed patterns, and a character convolutional network over candidates.

Base findings come from three patterns (kinds assign, access, hex; leftmost, not
overlapping within a kind; spans are the whole matches, in code points).

Candidates are the maximal runs of ``RUN`` characters, 12 or more, with a digit.  Each one
is read by a small convolutional network (numpy) together with its context: 16 characters
before, its first 32 and last 16, and 16 after, as character classes.  The network is
fitted on the labelled findings of all documents: every candidate (those of equal texts once),
positive where a base finding overlaps it, both labels of the same total weight; half of
them are shown without context (in what is held back, too), so that a value is also known by
itself.  They are dealt by a
hash into groups of up to ``GROUP``; Spark trains the groups side by side, an epoch at a time from
the same weights, and the weights' mean begins the next one.  The network's
probabilities are calibrated (Platt) on a third that it was not fitted on, and the
threshold is the highest that finds ``recall`` of that third's positives.  Candidates above
it that no base finding overlaps are added, as kind ``model``.  Of a candidate that is not
added whole, its parts between '/' and '=' are read without context (if they are such runs),
and a run or part of more than 48 characters through views of 48, ``STEP`` apart; what is hit is
added, overlapping views as one.

Defined cases: a null text is empty; without labelled findings of both kinds nothing is
added; repeated rows are scanned alike; texts and runs of any length are scanned whole.
Runs under 12 characters or without a digit are never shown to the network.
"""

from __future__ import annotations

import bisect
import dataclasses
import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlake.llm.common import each, order_statistics, share, ship, stored, turn_to

# The base patterns and the least lengths of their matches.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                    r"([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # whole runs: the same as [0-9a-f]+ of 24 and more
KINDS = ("assign", "access", "hex", "model")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

DIGIT = re.compile(r"[0-9]")
RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
LEAST = 12
BEFORE, HEAD, TAIL, AFTER = 16, 32, 16, 16
WIDTH = BEFORE + HEAD + TAIL + AFTER
STEP = 16
PART = re.compile(r"[^/=]+")
SPAN, FILTERS = 5, 16
EPOCHS, GROUP = 6, 2048
#: Character classes, one of each: pad, hex letters and others by case, digit, signs, rest.
CLASSES = ("", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "0123456789",
           "+/", "_-", "=:", "\"'", " ", "\n\t\r", "@.")
OTHER = len(CLASSES)
CLASS_OF = {c: i for i, group in enumerate(CLASSES) for c in group}
DEPTH = OTHER + 2  # and a flag: part of the candidate


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans of the runs of LEAST characters and more that hold a digit."""
    found, at = [], 0
    while m := DIGIT.search(text, at):
        start = m.start()
        while start > at and RUN.match(text, start - 1, start):
            start -= 1
        at = RUN.match(text, m.start()).end()
        if at - start >= LEAST:
            found.append((start, at))
    return found


def views_within(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Spans inside a candidate: its parts, and views over what is longer than one view."""
    seen = HEAD + TAIL
    spans = [(start, end)]
    spans += [s for m in PART.finditer(text, start, end) if (s := m.span()) != spans[0]
              and s[1] - s[0] >= LEAST and DIGIT.search(text, *s)]
    yield from spans[1:]
    for a, b in spans:
        if b - a > seen:
            yield from ((i, i + seen) for i in (*range(a, b - seen, STEP), b - seen)
                        if DIGIT.search(text, i, i + seen))


def classes(text: str, start: int, end: int, context: bool = True) -> np.ndarray:
    """The view of a candidate: a class for each of WIDTH places (negative: in the candidate)."""
    head, tail = text[start:min(end, start + HEAD)], text[max(start + HEAD, end - TAIL):end]
    before = text[max(0, start - BEFORE):start] if context else ""
    after = text[end:end + AFTER] if context else ""
    out = np.zeros(WIDTH, np.int64)
    for part, at, sign in ((before, BEFORE - len(before), 1), (head, BEFORE, -1),
                           (tail, BEFORE + HEAD, -1), (after, BEFORE + HEAD + TAIL, 1)):
        for i, c in enumerate(part, at):
            out[i] = sign * CLASS_OF.get(c, OTHER)
    return out


def _one_hot(views: np.ndarray) -> np.ndarray:
    x = np.zeros((*views.shape, DEPTH), np.float32)
    np.put_along_axis(x, np.abs(views)[..., None], 1, axis=2)
    x[..., -1] = views < 0
    return x


def _windows(views: np.ndarray) -> np.ndarray:
    x = np.lib.stride_tricks.sliding_window_view(_one_hot(views), SPAN, axis=1)
    return x.transpose(0, 1, 3, 2).reshape(len(views), WIDTH - SPAN + 1, SPAN * DEPTH)


@dataclasses.dataclass
class Network:
    """Convolution, rectifier, maximum and mean over places, logistic output."""

    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 2.0

    @classmethod
    def new(cls, seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        return cls(r.normal(0, 0.2, (SPAN * DEPTH, FILTERS)).astype(np.float32),
                   np.zeros(FILTERS, np.float32),
                   r.normal(0, 0.2, 2 * FILTERS + 1).astype(np.float32))

    def _forward(self, x: np.ndarray):
        act = np.maximum(x @ self.conv + self.bias, 0)
        pooled = np.hstack([act.max(1), act.mean(1), np.ones((len(x), 1), np.float32)])
        return act, pooled, pooled @ self.out

    def logits(self, views: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(_windows(views[i:i + 256]))[2]
                               for i in range(0, len(views), 256)] or [np.zeros(0)])

    def probabilities(self, views: np.ndarray) -> np.ndarray:
        return self.calibrated(self.logits(views))

    def calibrated(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * logits.astype(float) + self.shift, -35, 35)))

    def train(self, views: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 64,
              rate: float = 3e-3, seed: int = 11) -> None:
        """Adam on the logistic loss."""
        state = self.start()
        for epoch in range(epochs):
            state = self.epoch(state, views, y, np.ones(len(y), np.float32), (seed, epoch), batch, rate)
        self.take(state)

    def _params(self) -> list[np.ndarray]:
        return [self.conv, self.bias, self.out]

    def start(self) -> np.ndarray:
        """What training goes on from: steps, weights, both moments; one vector."""
        flat = np.concatenate([p.ravel() for p in self._params()]).astype(float)
        return np.concatenate([[0.0], flat, 0 * flat, 0 * flat])

    def take(self, state: np.ndarray) -> None:
        """The weights of a training state."""
        at = 1
        for p in self._params():
            p[...] = state[at:at + p.size].reshape(p.shape)
            at += p.size

    def epoch(self, state: np.ndarray, views: np.ndarray, y: np.ndarray, weight: np.ndarray,
              seed: tuple[int, int], batch: int = 64, rate: float = 3e-3) -> np.ndarray:
        """The training state after one pass over the rows."""
        self.take(state)
        t, params = state[0], self._params()
        size = sum(p.size for p in params)
        m1, m2 = (np.split(state[1 + k * size:1 + (k + 1) * size].astype(np.float32), np.cumsum(
            [p.size for p in params])[:-1]) for k in (1, 2))
        m1, m2 = ([m.reshape(p.shape) for m, p in zip(ms, params)] for ms in (m1, m2))
        order = np.random.default_rng(seed).permutation(len(views))
        for i in range(0, len(order), batch):
            pick = order[i:i + batch]
            x = _windows(views[pick])
            act, pooled, z = self._forward(x)
            dz = (weight[pick] * (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y[pick])
                  / len(pick)).astype(np.float32)
            top, mean = dz[:, None] * self.out[:FILTERS], dz[:, None] * self.out[FILTERS:-1]
            d = np.repeat(mean[:, None] / act.shape[1], act.shape[1], axis=1)
            at = act.argmax(1)
            np.put_along_axis(d, at[:, None], np.take_along_axis(d, at[:, None], 1)
                              + top[:, None], 1)
            d *= act > 0
            grads = [np.tensordot(x, d, ([0, 1], [0, 1])), d.sum((0, 1)), dz @ pooled]
            t += 1
            for p, g, a, b in zip(params, grads, m1, m2):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= rate * (a / (1 - 0.9 ** t)) / (np.sqrt(b / (1 - 0.999 ** t)) + 1e-8)
        return np.concatenate([[t], *(a.ravel() for part in (params, m1, m2) for a in part)])


def labelled(df: DataFrame, text_col: str = "text") -> DataFrame:
    """label, place (text's hash and number), held back or not, and view of every candidate;
    those of equal texts once."""
    ship(df.sparkSession)
    texts = df.select(F.col(text_col).alias("text")).where("text IS NOT NULL")
    schema = pa.schema([("y", pa.int32()), ("part", pa.int64()), ("n", pa.int32()),
                        ("held", pa.bool_()), ("view", pa.binary())])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in each(batch.column(0)):
                runs = candidates(text)
                if not runs:
                    continue
                base = base_spans(text)
                starts, far = [s for s, _, _ in base], list(itertools.accumulate(
                    (e for _, _, e in base), max, initial=0))
                part = int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"),
                                                      digest_size=6).digest(), "big")
                held = part % 3 == 0
                for n, (start, end) in enumerate(runs):
                    # the furthest end of the base findings that begin before this one ends
                    y = int(far[bisect.bisect_left(starts, end)] > start)
                    view = classes(text, start, end, (part // 3 + n) % 2 == 0)
                    rows.append((y, part, n, held, view.astype(np.int8).tobytes()))
                    if len(rows) >= 5000:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return texts.mapInArrow(label, "y int, part long, n int, held boolean, view binary").distinct()


def _views(cells) -> np.ndarray:
    return np.frombuffer(b"".join(cells), np.int8).reshape(-1, WIDTH).astype(np.int64)


def fit(df: DataFrame, text_col: str = "text", recall: float = 0.99) -> Network | None:
    """The network of all labelled findings; None without both labels."""
    found = stored(labelled(df, text_col), "findings")
    sizes = {(r.held, r.y): r["count"] for r in found.groupBy("held", "y").count().collect()}
    if len(sizes) < 4:
        return None
    net = Network.new()
    _train(net, found.where("NOT held"), [sizes[False, y] for y in (0, 1)])
    _calibrate(net, found.where("held"), [sizes[True, y] for y in (0, 1)], recall)
    return net


def _train(net: Network, found: DataFrame, sizes: list[int], seed: int = 11) -> None:
    """Epochs of the groups side by side; their states' mean begins the next."""
    total = sum(sizes)
    groups = -(-total // GROUP)
    weights = np.array([total / 2 / n for n in sizes], np.float32)
    rows = found.withColumn("group", F.pmod(F.xxhash64(F.lit("group"), "part", "n"), F.lit(groups)))
    state = net.start()
    for epoch in range(EPOCHS):
        def learn(found: pd.DataFrame) -> pd.DataFrame:
            found = found.sort_values(["part", "n"])
            y = found.y.to_numpy()
            after = Network.new().epoch(state, _views(found["view"]), y.astype(np.float32),
                                        weights[y], (seed, epoch))
            return pd.DataFrame({"size": len(found), "state": [after.tolist()]})

        # sums of decimals: the same in any order
        mean = (rows.groupBy("group").applyInPandas(learn, "size long, state array<double>")
                .select("size", F.posexplode("state")).groupBy("pos").agg(
                    F.sum((F.col("size") * F.col("col")).cast("decimal(38,20)")).alias("sum"))
                .collect())
        for r in mean:
            state[r.pos] = float(r["sum"]) / total
    net.take(state)


def _calibrate(net: Network, found: DataFrame, sizes: list[int], recall: float) -> None:
    """Platt's scale and shift (Newton, smoothed targets), and the threshold."""
    def logits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"y": batch.y, "z": net.logits(_views(batch["view"])).astype(float)})

    told = stored(found.mapInPandas(logits, "y int, z double"), "logits")
    y, z, a, b = F.col("y"), F.col("z"), 1.0, 0.0
    target = F.when(y > 0, (sizes[1] + 1) / (sizes[1] + 2)).otherwise(1 / (sizes[0] + 2))
    for _ in range(30):
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), a * z + b))))
        w = p * (1 - p) + 1e-9
        r = told.agg(*(F.sum(x).alias(k) for k, x in {
            "zz": w * z * z, "wz": w * z, "w": w, "gz": (p - target) * z, "g": p - target}.items())
        ).first()
        step = np.clip(np.linalg.solve([[r.zz + 1e-3, r.wz], [r.wz, r.w]],
                                       [r.gz + 1e-3 * (a - 1), r.g]), -1, 1)
        a, b = a - float(step[0]), b - float(step[1])
        if np.abs(step).max() < 1e-9:
            break
    net.scale, net.shift = a, b
    least = int((1 - recall) * sizes[1])  # in the order of probabilities
    at = least if a >= 0 else sizes[1] - 1 - least
    bound = order_statistics(told.where("y > 0"), "y", "z", lambda n: [at])[1][0]
    net.threshold = float(net.calibrated(np.array([bound]))[0])


def all_spans(text: str, net: Network | None) -> list[tuple[int, int, int]]:
    """Base spans, and the candidates that the network adds; sorted."""
    held = base_spans(text)
    if net is None:
        return held
    merged = []
    for start, _, end in held:  # disjoint cover of the base spans, in order
        if merged and start < merged[-1][1]:
            merged[-1] = merged[-1][0], max(end, merged[-1][1])
        else:
            merged.append((start, end))
    starts, ends = [s for s, _ in merged], [e for _, e in merged]

    def free(start: int, end: int) -> bool:
        i = bisect.bisect_right(ends, start)
        return i == len(starts) or starts[i] >= end

    def hits(spans: list[tuple[int, int]], context: bool) -> list[tuple[int, int]]:
        return [x for j in range(0, len(spans), 1024) for x, p in zip(
            spans[j:j + 1024], net.probabilities(np.array(
                [classes(text, s, e, context) for s, e in spans[j:j + 1024]]))) if p >= net.threshold]

    runs = candidates(text)
    whole = hits([x for x in runs if free(*x)], True)
    more, added = [], set(whole)
    inside = {x for run in runs if run not in added for x in views_within(text, *run) if free(*x)}
    for start, end in sorted(whole + hits(sorted(inside), False)):
        if more and start < more[-1][1]:
            more[-1] = more[-1][0], max(end, more[-1][1])
        else:
            more.append((start, end))
    return sorted(held + [(s, 3, e) for s, e in more])


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **fitting) -> DataFrame:
    """id, findings by base kind, digest of the base spans, all spans, of every row."""
    shared = share(df.sparkSession, fit(df, text_col, **fitting))

    @F.arrow_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        turn_to("secret_scan")
        for texts in batches:
            rows = []
            for text in each(texts):
                spans = all_spans(text or "", shared.value)
                base = [x for x in spans if x[1] < 3]
                rows.append((*(sum(x[1] == k for x in base) for k in range(3)),
                             hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.StructArray.from_arrays(
                [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)],
                names=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return df.select(id_col, find(F.col(text_col)).alias("r")).select(id_col, "r.*")


def redact(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    out, at = [], 0
    for start, _, end in spans:
        if end > at:
            if start >= at:
                out += [text[at:start], mark]
            at = end
    return "".join(out) + text[at:]


def redacted(df: DataFrame, text_col: str = "text", length_col: str = "n_chars",
             mark: str = "[SECRET]", **fitting) -> DataFrame:
    """All rows and columns as given, each finding replaced by ``mark`` in the text and the
    text's length (if there is such a column) set anew."""
    shared = share(df.sparkSession, fit(df, text_col, **fitting))

    @F.arrow_udf("string")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        turn_to("secret_scan")
        for texts in batches:
            yield pa.array((t if t is None else redact(t, all_spans(t, shared.value), mark)
                            for t in each(texts)), pa.string(), size=len(texts))

    out = df.withColumn(text_col, clean(F.col(text_col)))
    if length_col in df.columns:
        kind = df.schema[length_col].dataType
        out = out.withColumn(length_col, F.when(
            F.col(length_col).isNotNull(), F.length(text_col)).cast(kind))
    return out.select(*df.columns)
