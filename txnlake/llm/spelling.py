"""Spelling variants of a corpus: near words by a bit-sliced position index.

Words are maximal runs of ``LETTERS`` with A-Z lower-cased; a deterministic one in ``every``
(by crc32 of document and run) loses one letter, as typing slips do.  Words of ``least_length``
code points that occur ``least_count`` times are the vocabulary; two are near if exactly one
inserted, deleted or replaced code point makes one the other.

Near words: for every (position, letter) a bitset over a part of the vocabulary says which words
have it there.  Reading a query letter by letter, word-parallel recurrences carry four sets at
once: without an error, and with one replaced letter (same position), one letter too many in the
query (positions shifted down) or in the word (shifted up).  All queries of a part advance
together, as rows of a matrix of bitsets.

A part is what shares half a word: of two near words of c, or of c and c + 1, code points, either
the first c // 2 or the last c - c // 2 agree.  Each word is dealt to its parts by that half;
pairs that agree in the first half are left out in parts by the last half, so each pair is met
once.  A part of many words is cut into blocks that are matched block against block; of each
query a tile returns the number of its near words and the best one, never the pairs.

Defined cases: a null text has no words; a null id counts as an empty one; repeated rows count
again; texts are read in pieces cut between words, so their length does not matter; a run is held
whole; ties go to the smaller word in code-point order; an empty table gives an empty result;
other columns of the input are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnlake.llm.common import ship, stored

LETTERS = "A-Za-zÀ-ÿ"
PIECE = 1 << 20
#: Distinct words counted by a task before it hands them on.
HELD = 200_000
#: Words of a block, and code points of a block of long words.
BLOCK, CELLS = 4096, 1 << 17
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_INSIDE = re.compile(f"[{LETTERS}]*")


def _pieces(text: str) -> Iterator[str]:
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > PIECE:
            end = _INSIDE.match(text, at + PIECE).end()
        yield text[at:end]
        at = end


def slip(doc_id: str, run: str, every: int) -> str:
    """The run, without one letter if the crc32 of document and run is divisible by ``every``."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    return run if h % every else run[:h % len(run)] + run[h % len(run) + 1:]


def words_of(doc_id: str | None, text: str | None, least_length: int = 6,
             every: int = 199) -> Counter:
    """Words of one document with their number; shorter ones are left out."""
    runs, got = Counter(), Counter()
    pattern = re.compile(f"[{LETTERS}]{{{least_length},}}")  # a slip only shortens a run
    for piece in _pieces(text or ""):
        runs.update(pattern.findall(piece))
    for run, n in runs.items():
        word = slip(doc_id or "", run.lower() if run.isascii() else run.translate(LOWER), every)
        if len(word) >= least_length:
            got[word] += n
    return got


def vocabulary(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               least_length: int = 6, least_count: int = 5, every: int = 199) -> DataFrame:
    """(word, n) of the words that occur ``least_count`` times or more."""
    ship(df.sparkSession)

    def out(got: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(got), pa.string()), pa.array(list(got.values()), pa.int64())],
            ["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: Counter = Counter()
        for batch in batches:
            for i in range(len(batch)):
                got.update(words_of(batch["id"][i].as_py(), batch["text"][i].as_py(),
                                    least_length, every))
                if len(got) >= HELD:
                    yield out(got)
                    got = Counter()
        if got:
            yield out(got)

    texts = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return (texts.mapInArrow(count, "word string, n long").groupBy("word")
            .agg(F.sum("n").alias("n")).where(F.col("n") >= least_count))


# ---------------------------------------------------------------- the index of one tile

def _matrix(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(words, positions) code points, 0 beyond a word's end, and the lengths."""
    size = np.array([len(w) for w in words], np.int64)
    most = max(1, int(size.max(initial=0)))
    cells = np.frombuffer("".join(w.ljust(most, "\0") for w in words).encode(
        "utf-32-le", "surrogatepass"), "<u4")
    return cells.reshape(len(words), most).astype(np.int64), size


def _bitsets(flags: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    packed = np.packbits(flags, axis=1, bitorder="little")
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view("<u8")


class Index:
    """Bitsets over ``words`` for every (position, letter)."""

    def __init__(self, words: list[str]):
        cells, self.size = _matrix(words)
        self.letters = np.unique(cells)
        at = np.arange(cells.shape[1]) * len(self.letters) + np.searchsorted(self.letters, cells)
        there = np.arange(cells.shape[1]) < self.size[:, None]
        self.keys, row = np.unique(at[there], return_inverse=True)
        flags = np.zeros((len(self.keys) + 1, len(words)), bool)  # the last row: nowhere
        flags[row, np.nonzero(there)[0]] = True
        self.bits = _bitsets(flags)

    def rows(self, cells: np.ndarray, shift: int) -> np.ndarray:
        """Of each letter of the queries, the row of its bitset ``shift`` positions on."""
        code = np.searchsorted(self.letters, cells).clip(max=len(self.letters) - 1)
        position = np.arange(cells.shape[1]) + shift
        at = position * len(self.letters) + code
        row = np.searchsorted(self.keys, at).clip(max=max(0, len(self.keys) - 1))
        known = (position >= 0) & (self.letters[code] == cells)
        known &= (self.keys[row] == at) if len(self.keys) else False
        return np.where(known, row, len(self.keys))

    def one_error(self, queries: list[str], among: np.ndarray, half: np.ndarray):
        """Bitsets of the words of ``among`` that are one replaced letter from each query, one
        letter longer, one shorter, and of those that agree in its first ``half`` letters."""
        cells, size = _matrix(queries)
        order = np.argsort(-size, kind="stable")  # queries still being read come first
        cells, size, half = cells[order], size[order], half[order]
        same, up, down = (self.rows(cells, d) for d in (0, 1, -1))
        none = among[order].copy()
        replaced, longer, shorter = (np.zeros_like(none) for _ in range(3))
        agree = none.copy()
        for i in range(int(size.max(initial=0))):
            live = slice(0, int(np.searchsorted(-size, -i, "left")))
            z, here = none[live], self.bits[same[live, i]]
            replaced[live] = (replaced[live] & here) | (z & ~here)
            longer[live] = (longer[live] | z) & self.bits[up[live, i]]
            shorter[live] = (shorter[live] & self.bits[down[live, i]]) | z
            none[live] = z & here
            now = half == i + 1
            agree[now] = none[now]
        longer |= none
        lengths = [_bitsets(np.stack([self.size == m + d for m in size])) if len(size)
                   else none for d in (0, 1, -1)]
        back = np.argsort(order)
        return tuple((s & m)[back] for s, m in zip((replaced, longer, shorter), lengths)
                     ) + (agree[back],)


def match(rows: list[tuple[int, bool, int, str, int, bool, bool]]) -> list[tuple]:
    """(word, near, best n, best word) of the queries among rows (part, by last half, c, word,
    n, is query, is in the index) that have a near word in their part."""
    index = sorted((r for r in rows if r[6]), key=lambda r: (-r[4], r[3]))  # the best one first
    asked = [r for r in rows if r[5]]
    if not index or not asked:
        return []
    parts, member = np.unique([r[0] for r in index], return_inverse=True)
    of_part = _bitsets(np.vstack([np.arange(len(parts))[:, None] == member,
                                  np.zeros((1, len(index)), bool)]))
    where = np.searchsorted(parts, [r[0] for r in asked]).clip(max=len(parts) - 1)
    where = np.where(parts[where] == [r[0] for r in asked], where, len(parts))
    c = np.array([r[2] for r in asked])
    by_end = np.array([r[1] for r in asked])
    replaced, longer, shorter, agree = Index([r[3] for r in index]).one_error(
        [r[3] for r in asked], of_part[where], c // 2)
    short = np.array([len(r[3]) for r in asked]) == c
    near = np.where(short[:, None], replaced | longer, shorter)
    near &= np.where(by_end[:, None], ~agree, ~np.uint64(0))
    count = np.bitwise_count(near).sum(1)
    found = np.flatnonzero(count)
    first = (near[found] != 0).argmax(1)
    low = near[found, first]
    low &= ~low + np.uint64(1)
    bit = np.bitwise_count(low - np.uint64(1))
    return [(asked[q][3], int(count[q]), index[i][4], index[i][3])
            for q, i in zip(found.tolist(), (64 * first + bit).tolist())]


# ------------------------------------------------------------------------ over Spark

def _points(words: DataFrame) -> DataFrame:
    """(c, by_end, half, word, n): the parts of each word; c is its length, or one less."""
    c, half = F.col("c"), F.floor(F.col("c") / 2).cast("int")
    length = F.char_length("word")
    return (words.select("word", "n", F.explode(F.array(length, length - 1)).alias("c"))
            .where("c >= 0")
            .select("word", "n", "c", F.explode(F.array(
                F.struct(F.lit(False).alias("by_end"), F.substring("word", F.lit(1), half).alias("half")),
                F.struct(F.lit(True).alias("by_end"), F.expr(
                    "right(word, c - cast(floor(c / 2) as int))").alias("half")))).alias("p"))
            .select(c, "p.by_end", "p.half", "word", "n"))


def _block_rows(c: Column) -> Column:
    return F.least(F.lit(BLOCK), F.greatest(F.lit(1), F.floor(F.lit(CELLS) / F.greatest(c, F.lit(1)))))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best): the number of near words of each word (word, n) that has some, and
    the one of largest n as a struct (minus n, word)."""
    ship(words.sparkSession)
    part = ["c", "by_end", "half"]
    points = _points(words)
    large = stored(points.groupBy(part).agg(F.count("*").alias("rows")).withColumn(
        "blocks", F.ceil(F.col("rows") / _block_rows(F.col("c"))).cast("int")).where("blocks > 1")
        .select(*part, "blocks"), "large-parts")
    blocks = F.coalesce("blocks", F.lit(1))
    own = F.pmod(F.xxhash64("word"), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    placed = points.join(large, part, "left").select(*part, "word", "n", own.alias("own"), other.alias("other"))
    # a tile is (block of queries, block of the index); a word asks in its row, and is found in
    # its column of tiles
    role = F.explode(F.when(F.col("own") == F.col("other"), F.array(F.lit("both"))).otherwise(
        F.array(F.lit("asks"), F.lit("found"))))
    tiles = placed.select("*", role.alias("role")).select(
        *part, F.when(F.col("role") == "found", F.col("other")).otherwise(F.col("own")).alias("row"),
        F.when(F.col("role") == "found", F.col("own")).otherwise(F.col("other")).alias("column"),
        "word", "n", "role")
    tile = [*part, "row", "column"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []  # rows of whole tiles
        now: list = []
        last, number, cells = None, 0, 0

        def matched(rows: list) -> pa.RecordBatch:
            got = match(rows)
            cols = list(zip(*got)) if got else [()] * 4
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()),
                 pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())],
                ["word", "near", "best_n", "best_word"])

        for batch in batches:
            for c, by_end, half, row, column, word, n, role in zip(
                    *(batch[x].to_pylist() for x in (*tile, "word", "n", "role"))):
                if (key := (c, by_end, half, row, column)) != last:
                    if len(now) > 1:
                        held += now
                    if len(held) >= BLOCK or cells >= 4 * CELLS:
                        yield matched(held)
                        held, cells = [], 0
                    last, number, now = key, number + 1, []
                now.append((number, by_end, c, word, n, role != "found", role != "asks"))
                cells += len(word)
        if len(now) > 1:
            held += now
        if held:
            yield matched(held)

    found = tiles.repartition(*tile).sortWithinPartitions(*tile).mapInArrow(
        run, "word string, near long, best_n long, best_word string")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct(
        (-F.col("best_n")).alias("minus_n"), F.col("best_word").alias("word"))).alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each word's chain of forms, by pointer jumping (a chain has
    as many steps as n can be multiplied, so a few rounds do)."""
    at = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(at.join(step, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("more")),
            "roots")
        if moved.where("more").isEmpty():
            return moved.select("word", "root")
        at = moved.select("word", "root")


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word (word, n): its form is its near word of
    largest n, if that is ``ratio`` times its own or more."""
    words = stored(words, "vocabulary")
    both = stored(words.join(near_words(words), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        (-F.col("best.minus_n")).alias("best_n"), F.col("best.word").alias("best_word")), "near")
    told = F.col("best_n") >= ratio * F.col("n")
    forms = both.select("word", F.when(told, F.col("best_word")).alias("form"), "n", "n_near",
                        F.when(told, F.col("best_n")).alias("form_n"))
    roots = _roots(forms.where("form IS NOT NULL"))
    return forms.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variant_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   least_length: int = 6, least_count: int = 5, every: int = 199,
                   ratio: int = 5) -> DataFrame:
    """``variants`` of the vocabulary of the documents."""
    return variants(vocabulary(df, id_col, text_col, least_length, least_count, every), ratio)
