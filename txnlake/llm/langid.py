"""Language ID with language-bitmask n-gram filters.

A bit-sliced Bloom filter holds, per slot, one bit for each language.  A letter n-gram
(3 and 4 letters, lower-cased, word edges included) has ``HASHES`` slots; the AND of
their rows is the set of all languages whose typical n-grams include it (a superset, by
false positives).  Per language, the share of a text's n-grams with its bit is corrected
for the false positives that the language's fill predicts, and the largest share decides;
``score`` is that share over the sum of all languages' shares.

Learning: all labelled documents of the ``max_langs`` languages that have most, whole texts,
n-grams counted with Spark (in a task first, ``HELD_GRAMS`` of a language at a time); an n-gram is
typical of the languages in which its frequency is at least ``ratio`` times its highest;
the ``max_grams`` most frequent of them enter the filter, whose size is fixed by the
parameters, so the broadcast is bounded whatever the input.

Defined cases: a null text or one without letters is ``und`` with score 0, as is every
text if no labelled row was given; a text with letters of which the filter knows no
n-gram gets the most frequent language with score 0; ties go to the more frequent
language; a null id is never learned from and not held out; texts are read whole, in
pieces of ``PIECE`` characters cut at a space where there is one.
"""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnlake.llm.common import each, fresh, order_statistics, share, ship, stored, turn_to

UNDETERMINED = "und"
SIZES = (3, 4)
HASHES = 3
PIECE = 500_000
BLOCK = 100_000  # characters of whole short texts read at a time
HELD_GRAMS = 1 << 18  # n-grams of a language that a task holds before it passes them on
LEAST_SHARE = 0.01  # the quantile of a language's shares that its bound is taken from
RESULT = "lang_pred string, score double"


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _pieces(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > PIECE:
        end = text.rfind(" ", at + 1, at + PIECE) + 1 or at + PIECE
        yield text[at:end]
        at = end
    yield text[at:]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def grams(texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the text, n-gram hash) of every letter n-gram."""
    parts = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
             for t in texts]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    code = np.concatenate(parts)
    code = np.where(_letters()[code], code, 0).astype(np.uint64)
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 0) | (code[:-1] != 0) | (doc[1:] != doc[:-1])
    doc, code = doc[keep], code[keep]
    docs, hashes = [], []
    for n in SIZES:
        m = len(code) - n + 1
        if m <= 0:
            continue
        h, fits = np.full(m, n, np.uint64), doc[:m] == doc[n - 1:]
        for i in range(n):
            h = h * np.uint64(0x100000001B3) + code[i:i + m]
            if 0 < i < n - 1:
                fits &= code[i:i + m] != 0
        docs.append(doc[:m][fits])
        hashes.append(_mixed(h[fits]))
    return (np.concatenate(docs), np.concatenate(hashes)) if docs else (doc[:0], code[:0])


def _blocks(texts: Iterable[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Rows and text pieces, about BLOCK characters (or one piece) at a time."""
    rows, held, size = [], [], 0
    for i, text in enumerate(texts):
        for piece in _pieces(text) if isinstance(text, str) else ():
            rows.append(i)
            held.append(piece)
            size += len(piece)
            if size >= BLOCK:
                yield rows, held
                rows, held, size = [], [], 0
    if rows:
        yield rows, held


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams and their summed numbers."""
    g, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(g)
    g, n = g[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])[:len(g)])
    return g[first], np.add.reduceat(n, first) if len(first) else n


@dataclasses.dataclass
class Model:
    langs: list[str]
    slots: np.ndarray  # (slots, bytes): bit l of a row is language l
    false_positive: np.ndarray  # per language

    @classmethod
    def build(cls, langs: list[str], hashes: np.ndarray, typical: np.ndarray,
              log2_slots: int) -> Model:
        """typical: (n-grams, languages) booleans."""
        slots = np.zeros((1 << log2_slots, max(1, -(-len(langs) // 8))), np.uint8)
        rows = np.packbits(typical, axis=1, bitorder="little")
        for at in cls._places(hashes, len(slots)):
            np.bitwise_or.at(slots, at, rows)
        fill = np.unpackbits(slots, axis=1, bitorder="little")[:, :len(langs)].mean(0)
        return cls(langs, slots, fill ** HASHES)

    @staticmethod
    def _places(hashes: np.ndarray, slots: int) -> Iterator[np.ndarray]:
        for i in range(HASHES):
            yield ((hashes >> np.uint64(20 * i)) & np.uint64(slots - 1)).astype(np.int64)

    def languages_of(self, hashes: np.ndarray) -> np.ndarray:
        """(n-grams, languages): which languages the filter holds for each n-gram."""
        rows = np.bitwise_and.reduce([self.slots[p] for p in self._places(hashes, len(self.slots))])
        return np.unpackbits(rows, axis=1, bitorder="little")[:, :len(self.langs)]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        return [(lang, score) for lang, score, _ in self.measure(texts, len(texts))]

    def measure(self, texts: Iterable[str | None], n: int) -> list[tuple[str, float, float]]:
        """Language, score, and the language's own share, which other languages don't change, of
        n texts."""
        hits = np.zeros((n, max(1, len(self.langs))))
        total, letters = np.zeros(n), np.zeros(n, bool)
        if self.langs:
            for rows, pieces in _blocks(texts):
                doc, h = grams(pieces)
                bits, row = self.languages_of(h), np.array(rows)[doc]
                total += np.bincount(row, minlength=n)
                for i in range(len(self.langs)):
                    hits[:, i] += np.bincount(row, weights=bits[:, i], minlength=n)
            letters = total > 0
        share = hits / np.maximum(total, 1)[:, None]
        if self.langs:
            share = np.clip((share - self.false_positive) / (1 - self.false_positive), 0, None)
        best = share.argmax(1)
        top, all_ = share.max(1), share.sum(1)
        return [(self.langs[b], float(t / s) if s > 0 else 0.0, float(t)) if ok
                else (UNDETERMINED, 0.0, 0.0)
                for b, t, s, ok in zip(best, top, all_, letters)]


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang",
        max_langs: int = 256, max_grams: int = 60_000,
        ratio: float = 0.3, log2_slots: int = 19) -> Model:
    """A model of the labelled rows (null texts and labels don't count)."""
    ship(labelled.sparkSession)
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(
        "text IS NOT NULL AND lang IS NOT NULL")
    counts = {r.lang: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n"))
              .orderBy(F.desc("n"), "lang").limit(max_langs).collect()}
    langs = list(counts)
    if not langs:
        return Model([], np.zeros((1, 1), np.uint8), np.zeros(0))
    number = F.create_map(*(F.lit(x) for i, k in enumerate(langs) for x in (k, i)))
    known = rows.select("text", F.element_at(number, F.col("lang")).alias("l")).where("l IS NOT NULL")
    schema = pa.schema([("l", pa.int32()), ("g", pa.int64()), ("n", pa.int64())])

    def told(label: int, parts: list) -> pa.RecordBatch:
        g, n = _summed(parts)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(g), label, np.int32)),
                                           pa.array(g.view(np.int64)), pa.array(n)], schema=schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("langid")
        waiting: dict[int, list] = {}  # texts of a language that are not read yet, and their size
        held: dict[int, list] = {}

        def read(label: int) -> Iterator[pa.RecordBatch]:
            for _, pieces in _blocks(waiting.pop(label)[0]):
                held.setdefault(label, []).append(np.unique(grams(pieces)[1], return_counts=True))
                if sum(len(g) for g, _ in held[label]) >= HELD_GRAMS:
                    held[label] = [_summed(held[label])]
                    if len(held[label][0][0]) >= HELD_GRAMS // 2:
                        yield told(label, held.pop(label))

        for batch in batches:
            for text, label in zip(each(batch["text"]), batch["l"].to_pylist()):
                wait = waiting.setdefault(label, [[], 0])
                wait[0].append(text)
                wait[1] += len(text)
                if wait[1] >= BLOCK:
                    yield from read(label)
        for label in list(waiting):
            yield from read(label)
        for label, parts in held.items():
            yield told(label, parts)

    counted = stored(known.mapInArrow(count, "l int, g long, n long").groupBy(
        "l", "g").agg(F.sum("n").alias("n")), "grams")
    totals = {r.l: r.n for r in counted.groupBy("l").agg(F.sum("n").alias("n")).collect()}
    share = F.col("n") / F.element_at(F.create_map(*(F.lit(x) for k, v in totals.items()
                                                     for x in (k, float(v)))), F.col("l")) \
        if totals else F.lit(0.0)
    # stored first: collected at once, every task would send the driver max_grams rows
    best = stored(counted.withColumn("p", share).groupBy("g")
                  .agg(F.collect_list(F.struct("l", "p")).alias("at"), F.max("p").alias("top"))
                  .orderBy(F.desc("top"), "g").limit(max_grams), "best").orderBy("g").collect()
    typical = np.zeros((len(best), len(langs)), bool)
    for i, r in enumerate(best):
        for x in r["at"]:
            typical[i, x.l] = x.p >= ratio * r.top
    hashes = np.array([r.g for r in best], np.int64).view(np.uint64)
    return Model.build(langs, hashes, typical, log2_slots)


def _told(rows: list[tuple[str, float, float]], which: int, name: str) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array(
        [r[which] for r in rows], pa.float64())], names=["lang_pred", name])


def predictor(spark, model: Model):
    """text -> struct(lang_pred, score)."""
    ship(spark)
    shared = share(spark, model)

    @F.arrow_udf(RESULT)
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        turn_to("langid")
        for texts in batches:
            yield _told(shared.value.measure(each(texts), len(texts)), 1, "score")

    return predict


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang", **fitting) -> DataFrame:
    """id, held_out, lang_pred, score of every row; learned from the rows not held out."""
    ids = F.col(id_col)
    model = fit(df.where(ids.isNotNull() & ~held_out(ids)), text_col, lang_col, **fitting)
    got = df.select(ids, held_out(ids).alias("held_out"),
                    predictor(df.sparkSession, model)(F.col(text_col)).alias("r"))
    return got.select(id_col, "held_out", "r.lang_pred", "r.score")


def keep_identified(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    lang_col: str = "lang", least: float = 0.5, **fitting) -> DataFrame:
    """The rows whose language is determined, columns as given: the share of that language is
    at least ``least`` times the first percentile of the shares of all rows labelled so and
    found so.  All rows, if no row is labelled; those found to be of a language of which no row
    is labelled so and found so."""
    ids = F.col(id_col)
    model = fit(df.where(ids.isNotNull() & ~held_out(ids)), text_col, lang_col, **fitting)
    if not model.langs:
        return df
    shared = share(df.sparkSession, model)

    @F.arrow_udf("lang_pred string, share double")
    def measured(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        turn_to("langid")
        for texts in batches:
            yield _told(shared.value.measure(each(texts), len(texts)), 2, "share")

    # read once, for the bounds and for the rows that stay
    name = fresh(df, "told")
    rows = stored(df.withColumn(name, measured(F.col(text_col))), "measured")
    lang, part = F.col(name)["lang_pred"], F.col(name)["share"]
    right = rows.where((F.col(lang_col) == lang) & (lang != UNDETERMINED)).select(
        lang.alias("lang"), part.alias("share"))

    def around(n: int) -> list[int]:
        """The places on either side of the quantile."""
        at = LEAST_SHARE * (n - 1)
        return [int(at), min(int(at) + 1, n - 1)]

    sizes = {r.lang: r["count"] for r in right.groupBy("lang").count().collect()}
    bounds = {}
    for k, (low, high) in order_statistics(right, "lang", "share", around).items():
        weight = LEAST_SHARE * (sizes[k] - 1) % 1
        bounds[k] = least * (low * (1 - weight) + high * weight)
    bound = F.lit(0.0)
    if bounds:
        bound = F.coalesce(F.element_at(F.create_map(*(
            F.lit(x) for kv in bounds.items() for x in kv)), lang), bound)
    return rows.where((lang != UNDETERMINED) & (part >= bound)).select(*df.columns)
