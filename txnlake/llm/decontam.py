"""Benchmark decontamination by template canonicalisation.

Words (split at white space, punctuation at their ends dropped, lower-cased) become a
template: numbers, units and names (capitalised inside a sentence) are replaced by typed
placeholders.  Windows of ``window`` template words of the benchmark are hashed, as a table;
document windows meet them in a hash join.  A filter of the benchmark's hashes (bits, of a bounded
size, broadcast) keeps windows that cannot meet any from being dealt out; so neither the benchmark
nor its index is ever in one place, and the documents are read once, however large it is.  Spark
chooses how the tables are joined, and splits a hot window's rows.  A match keeps its
place in the item; per text and item the placeholders must be consistent: one
benchmark number, unit or name stands for one of the document throughout, and the other
way round.  An item counts as found if ``coverage`` of its windows match so, counted over
all alignments that are at most half an item apart (words put in or left out only shift what
follows); or if ``RUN_WORDS`` words in a row match on one alignment, however long the item; or if
``WORD_SHARE`` of its words lie in matched windows (an edit costs a short item most of its
windows).  ``reparameterised`` tells that some slot differs.  Texts are told apart by a 128-bit hash:
copies are judged once, and every row with the text is reported.

Each text is read in four ways (``READINGS``): with all placeholders; with every capitalised
word a name, also where a sentence opens; with numbers only, whatever the case; and word for
word, whatever the case.  A window may match in any of them.

Defined cases: null texts hold nothing; items shorter than the window are matched whole,
those under ``min_words`` words never; a window with fewer than half its words literal is
too general as a template and is matched word for word only (coverage is the larger of that
of the windows matched in any way, and of those matched as templates); repeated items and rows are
found each by itself; null ids are carried, of any type; texts are read whole, in pieces of
``PIECE_WORDS`` words; an empty table gives an empty result; other columns are not read, and only
``without_leaks`` carries them.
"""

from __future__ import annotations

import dataclasses
import itertools
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlake.llm.common import each, fresh, share, ship, stored, turn_to

NUMBER, UNIT, NAME, FIRST = 1, 2, 3, 4  # codes of the placeholders; literals from FIRST on
# Words taken as units of measure.
UNITS = frozenset("""
    % $ € £ ° mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams ton tons
    pound pounds ounce ounces ml l litre litres liter liters gallon gallons second seconds minute
    minutes hour hours day days week weeks month months year years dollar dollars cent cents euro
    euros percent degree degrees volt volts watt watts joule joules newton newtons hz khz mhz mph
    kmh celsius fahrenheit kelvin mole moles byte bytes kb mb gb tb""".split())
NUMERIC = re.compile(r"[+-]?\d+(?:[.,:/]\d+)*")
EDGES = "\"'`()[]{}<>.,;:!?*#&_~|«»„“”’…-"
CACHE = 400_000
ENDS, CAPITAL = 1, 2
PIECE_WORDS = 200_000
BLOCK_WORDS = 1 << 14  # words of texts that are read together
RUN_WORDS, WORD_SHARE = 20, 0.75
MAX_FILTER_BITS = 28  # 32 MB
#: Names inside sentences; all capitalised words; numbers alone; nothing but the words.
TYPED, CAPITALS, PLAIN, EXACT = READINGS = range(4)


class Reader:
    """Codes of words: hashes of literals, small numbers for placeholders.  Words are numbered as
    they are met, and what is known of a number is kept in arrays."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.codes, self.marks = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.uint8)

    def _learn(self, new: list[str]) -> None:
        """Number words; what is known of them is found for all of them together."""
        first, n = len(self.number), len(self.number) + len(new)
        if n > len(self.codes):  # twice the room, so that words are seldom copied
            self.codes, self.marks = (np.concatenate([x, np.zeros(2 * n - len(x), x.dtype)])
                                      for x in (self.codes, self.marks))
        bare = [w.strip(EDGES) for w in new]
        low = [w.lower() for w in bare]
        digest = xxhash.xxh64_intdigest
        codes = np.fromiter((digest(w.encode("utf-8", "surrogatepass")) for w in low), np.uint64, len(new))
        self.codes[first:n] = np.maximum(codes, np.uint64(FIRST))
        # a number ends with a digit: few words are looked at closely
        kinds = [NUMBER if b[-1:].isdecimal() and NUMERIC.fullmatch(b) else UNIT if w in UNITS else 0
                 for b, w in zip(bare, low)]
        marks = np.array(kinds, np.uint8) << 2
        marks[[w[-1] in ".!?:" for w in new]] |= ENDS
        marks[[w[:1].isupper() for w in bare]] |= CAPITAL
        self.marks[first:n] = marks
        self.number.update(zip(new, range(first, n)))

    def readings(self, raw: list[str], first: np.ndarray | int = 0) -> list[np.ndarray]:
        """Codes of words, by reading; those at ``first`` begin a sentence."""
        if len(self.number) >= CACHE:
            self.clear()
        new = set(raw).difference(self.number)
        if new:
            self._learn(list(new))
        at = np.fromiter(map(self.number.__getitem__, raw), np.int64, len(raw))
        exact, mark = self.codes[at], self.marks[at]
        begins = np.ones(len(raw), bool)
        begins[1:] = mark[:-1] & ENDS
        begins[first] = True
        kind, capital = (mark >> 2).astype(np.uint64), (mark & CAPITAL) > 0
        typed = np.where(kind > 0, kind, exact)
        capital &= kind == 0
        name = np.uint64(NAME)
        return [np.where(capital & ~begins, name, typed), np.where(capital, name, typed),
                np.where(kind == NUMBER, kind, exact), exact]


def hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of ``size`` codes."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(size):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += codes[i:i + n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h


WINDOWS = ("item long, size int, reading int, h long, place int, literal boolean, kinds array<int>, "
           "words array<string>, n_words int, n_windows int, n_literal int")


def item_windows(text: str, window: int, min_words: int, reader: Reader) -> list[tuple]:
    """The windows of one item: (size, reading, hash, place, whether it is literal enough as a
    template, placeholders, words, and the item's numbers of words, windows, literal windows)."""
    raw = text.split()
    if len(raw) < max(1, min_words):
        return []
    values, readings = [w.strip(EDGES).lower() for w in raw], reader.readings(raw)
    size = min(window, len(raw))
    n, rows, literal = len(raw) - size + 1, [], set()
    for r, codes in enumerate(readings):
        many = np.convolve(codes >= FIRST, np.ones(size, int), "valid") * 2 >= size
        h = hashes(codes, size)
        for at in np.flatnonzero(many).tolist():
            if r == TYPED:
                literal.add(at)
            kinds = np.minimum(readings[TYPED], codes)[at:at + size]
            rows.append((size, r, int(h[at].view(np.int64)), at,
                         [int(k) if k < FIRST else 0 for k in kinds.tolist()], values[at:at + size]))
    return [(size, r, h, at, at in literal, kinds, words, len(raw), n, len(literal))
            for size, r, h, at, kinds, words in rows]


def _table(rows: list[tuple], spec: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(),
             "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
    fields = [f.split(" ") for f in spec.split(", ")]
    cols = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields)],
                                      [n for n, _ in fields])


def benchmark_windows(items: DataFrame, window: int, min_words: int) -> DataFrame:
    """The windows of the items (item, text)."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("decontam")
        reader = Reader()
        for batch in batches:
            for i in range(len(batch)):
                item = batch["item"][i].as_py()
                rows = item_windows(batch["text"][i].as_py(), window, min_words, reader)
                if rows:
                    yield _table([(item, *r) for r in rows], WINDOWS)

    return items.where("text IS NOT NULL").mapInArrow(cut, WINDOWS)


def _filters(windows: DataFrame) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Bits of the windows' hashes, as many as they need but MAX_FILTER_BITS at most, and the sizes
    and readings that there are."""
    kinds = [(r["size"], r.reading) for r in windows.select("size", "reading").distinct().collect()]
    bits = min(MAX_FILTER_BITS, max(22, (16 * windows.count()).bit_length()))
    slot = f"explode(array(h & {(1 << bits) - 1}, shiftrightunsigned(h, 32) & {(1 << bits) - 1})) AS slot"
    got = windows.selectExpr(slot).selectExpr(
        "shiftright(slot, 6) AS at", "shiftleft(1L, cast(slot & 63 AS int)) AS bit").groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[got["at"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    # a byte for each bit where that stays small: looked up faster
    return (np.unpackbits(table.view(np.uint8), bitorder="little") if bits <= 22 else table), sorted(kinds)


def _hits(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Where both bits of a hash are set."""
    def there(slot: np.ndarray) -> np.ndarray:
        if bits.dtype == np.uint8:
            return bits[slot & np.uint64(len(bits) - 1)] > 0
        slot = slot & np.uint64(64 * len(bits) - 1)
        return (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) > 0

    at = np.flatnonzero(there(h))
    return at[there(h[at] >> np.uint64(32))]


@dataclasses.dataclass
class Block:
    """Words of short texts, or of a piece of a long one, one after the other."""

    words: list[str] = dataclasses.field(default_factory=list)
    marks: list[tuple] = dataclasses.field(default_factory=list)  # of the texts
    starts: list[int] = dataclasses.field(default_factory=list)  # where their words begin here
    first: list[int] = dataclasses.field(default_factory=list)  # the first word's place in the text
    lead: list[int] = dataclasses.field(default_factory=list)  # words before those to be looked up
    many: list[int] = dataclasses.field(default_factory=list)  # places where a window may begin

    def add(self, mark: tuple, words: list[str], first: int = 0, lead: int = 0,
            many: int | None = None) -> None:
        self.starts.append(len(self.words))
        self.words += words
        self.marks.append(mark)
        self.first.append(first - lead)
        self.lead.append(lead)
        self.many.append(len(words) - lead if many is None else many)

    def hits(self, reader: Reader, bits: np.ndarray, kinds: list[tuple[int, int]]) -> list[tuple]:
        """Rows of HITS: windows within a text that pass the filter."""
        starts, lead, many = (np.array(x) for x in (self.starts, self.lead, self.many))
        sizes = np.diff(np.append(starts, len(self.words)))
        readings, rows = reader.readings(self.words, starts[sizes > 0]), []
        place = np.arange(len(self.words)) - np.repeat(starts, sizes)  # in its part of the block
        begin, left = np.repeat(lead, sizes), np.repeat(sizes, sizes) - place
        open_ = (place >= begin) & (place - begin < np.repeat(many, sizes))
        text = np.repeat(np.arange(len(starts)), sizes)
        for size, r in kinds:
            h = hashes(readings[r], size)
            at = _hits(bits, h)
            at = at[open_[at] & (left[at] >= size)]
            rows += [(*self.marks[i], size, r, k, self.first[i] + p,
                      [w.strip(EDGES).lower() for w in self.words[a:a + size]])
                     for a, i, p, k in zip(at.tolist(), text[at].tolist(), place[at].tolist(),
                                           h[at].view(np.int64).tolist())]
        return rows


def blocks(texts: Iterable[tuple[tuple, str]], longest: int) -> Iterator[Block]:
    """The texts (mark, text) in blocks; those over PIECE_WORDS in pieces, one a block."""
    block = Block()
    for mark, text in texts:
        whole = text.split()
        if len(whole) <= PIECE_WORDS:
            block.add(mark, whole)
            if len(block.words) >= BLOCK_WORDS:
                yield block
                block = Block()
            continue
        # pieces share a window less one word; a piece begins in the sentence that it is in
        for first in range(0, max(1, len(whole) - longest + 1), PIECE_WORDS):
            lead, end = min(first, 1), first + PIECE_WORDS + longest - 1
            piece = Block()
            piece.add(mark, whole[first - lead:end], first, lead, PIECE_WORDS if end < len(whole) else None)
            yield piece
    if block.words:
        yield block


HITS = "t1 long, t2 long, size int, reading int, h long, at long, found array<string>"


def text_hits(texts: DataFrame, bits: np.ndarray, kinds: list[tuple[int, int]]) -> DataFrame:
    """The windows of the texts (t1, t2, text) that pass the filter, with their words."""
    shared = share(texts.sparkSession, (bits, kinds))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("decontam")
        bits, kinds = shared.value
        longest, reader = max((size for size, _ in kinds), default=1), Reader()
        for batch in batches:
            marks = zip(batch["t1"].to_pylist(), batch["t2"].to_pylist())
            rows = []
            for block in blocks(zip(marks, each(batch["text"])), longest):
                rows += block.hits(reader, bits, kinds)
                if len(rows) >= 10_000:
                    yield _table(rows, HITS)
                    rows = []
            if rows:
                yield _table(rows, HITS)

    return texts.mapInArrow(search, HITS)


def _lists(cells: pa.ListArray) -> list[list]:
    """The lists of an Arrow array, their values taken out together."""
    values, ends = cells.flatten().to_pylist(), cells.offsets.to_pylist()
    return [values[a - ends[0]:b - ends[0]] for a, b in itertools.pairwise(ends)]


JUDGED = "t1 long, t2 long, item long, n_windows long, coverage double, reparameterised boolean"


def judged(matches: list[tuple], coverage: float) -> tuple[bool, float, int, bool]:
    """Whether an item counts as found in a text; coverage and number of matched windows whose slots
    agree with the others'; whether one of their slots has another value than the item's.  Matches
    are (shift, place, minus the reading, literal, kinds, words, found, n_words, n_windows,
    n_literal), of nearby shifts; alignments of more windows come first, and of a place the most
    literal reading that agrees counts."""
    n_words, n_windows, n_literal = matches[0][7:]
    size = len(matches[0][5])
    there: dict[tuple[int, str], str] = {}
    back: dict[tuple[int, str], str] = {}
    held: dict[int, bool] = {}
    differs, longest = False, 0
    shifts: dict[int, list] = defaultdict(list)
    for m in matches:
        shifts[m[0]].append(m[1:])
    for _, places in sorted(shifts.items(), key=lambda x: (-len({m[0] for m in x[1]}), x[0])):
        run, last, done = 0, -2, -1
        for place, _, literal, kinds, words, found, *_ in sorted(places, key=lambda m: m[:2]):
            if place == done:
                continue
            slots = [x for x in zip(kinds, words, found) if x[0]]
            if any(there.get((k, a), b) != b or back.get((k, b), a) != a for k, a, b in slots):
                continue
            for k, a, b in slots:
                there[k, a], back[k, b] = b, a
                differs |= a != b
            held[place] = literal
            run, last, done = run + 1 if place == last + 1 else 1, place, place
            longest = max(longest, run)
    share_ = max(len(held) / n_windows, sum(held.values()) / max(1, n_literal))
    words = len({i for p in held for i in range(p, p + size)})
    good = bool(held) and (share_ >= coverage or longest + size - 1 >= RUN_WORDS
                           or words >= WORD_SHARE * n_words)
    return good, share_, len(held), differs


def judge(matches: list[tuple], coverage: float) -> tuple[bool, float, int, bool]:
    """The best of the groups of nearby alignments."""
    matches = sorted(matches, key=lambda m: m[:3])
    far = max(1, matches[0][7] // 2)
    best, first = (False, 0.0, 0, False), 0
    for i in range(1, len(matches) + 1):
        if i == len(matches) or matches[i][0] - matches[i - 1][0] > far:
            best = max(best, judged(matches[first:i], coverage), key=lambda x: x[:3])
            first = i
    return best


PARAMETERS = {"window": 8, "min_words": 5, "coverage": 0.5}


def leaks_of_texts(texts: DataFrame, items: DataFrame, window: int, min_words: int,
                   coverage: float) -> DataFrame:
    """JUDGED: the items (item, text) that the texts (t1, t2, text) hold."""
    ship(texts.sparkSession)
    windows = stored(benchmark_windows(items, window, min_words), "windows")
    bits, kinds = _filters(windows)
    # a text that stands in many rows is found in each, and combined before it is dealt out
    hits = text_hits(texts, bits, kinds).distinct()
    met = stored(hits.join(windows, ["size", "reading", "h"]), "matches")

    def decide(rows: pa.Table) -> pa.Table:
        # literal windows must agree word by word: hashes alone may meet by chance
        numbers = (rows[c].to_pylist() for c in ("at", "place", "reading", "literal", "n_words", "n_windows", "n_literal"))
        lists = (_lists(rows[c].combine_chunks()) for c in ("kinds", "words", "found"))
        matches = [(at - place, place, -reading, literal, kinds, words, found, *counts)
                   for at, place, reading, literal, *counts, kinds, words, found in zip(*numbers, *lists)
                   if words == found or all(k or a == b for k, a, b in zip(kinds, words, found))]
        good, share_, count, differs = judge(matches, coverage) if matches else (False, 0, 0, False)
        key = [rows[c][0].as_py() for c in ("t1", "t2", "item")]
        return pa.Table.from_pylist([dict(zip(judged_.names, (*key, count, share_, differs)))][:int(good)], judged_)

    judged_ = pa.schema([(c, t) for c, t in zip(("t1", "t2", "item", "n_windows", "coverage", "reparameterised"),
                                                [pa.int64()] * 4 + [pa.float64(), pa.bool_()])])
    # a group is what one text holds of one item
    return met.groupBy("t1", "t2", "item").applyInArrow(decide, JUDGED)


def _marks(text_col: str) -> dict:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return {"t1": F.xxhash64(text), "t2": F.xxhash64(F.lit(1), text)}


def _items(benchmark: DataFrame, text_col: str, *cols) -> DataFrame:
    """The benchmark's rows, numbered, as a table (so the numbers stay)."""
    return stored(benchmark.select(F.monotonically_increasing_id().alias("item"), *cols,
                                   F.col(text_col).alias("text")), "items")


def find_leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
               text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text", **parameters) -> DataFrame:
    """One row per document and benchmark item that it holds: id, item id, n_windows,
    coverage, reparameterised."""
    items = _items(benchmark, item_text_col, F.col(item_col).alias("key"))
    marks = _marks(text_col)
    texts = df.where(F.col(text_col).isNotNull()).select(
        *(c.alias(k) for k, c in marks.items()), F.col(text_col).alias("text"))
    found = stored(leaks_of_texts(texts, items, **(PARAMETERS | parameters)).join(
        items.select("item", "key"), "item").select(
        "t1", "t2", F.col("key").alias("k"), "n_windows", "coverage", "reparameterised"), "found")
    rows = df.select(F.col(id_col).alias("i"), *(c.alias(k) for k, c in marks.items()))
    return rows.join(found, ["t1", "t2"]).select(
        F.col("i").alias(id_col), F.col("k").alias(item_col), "n_windows", "coverage", "reparameterised")


def without_leaks(df: DataFrame, benchmark: DataFrame, text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text",
                  **parameters) -> DataFrame:
    """The rows that hold no benchmark item, columns as given."""
    names = {k: fresh(df, k) for k in ("t1", "t2")}
    marks = _marks(text_col)
    texts = df.where(F.col(text_col).isNotNull()).select(
        *(c.alias(k) for k, c in marks.items()), F.col(text_col).alias("text"))
    found = stored(leaks_of_texts(texts, _items(benchmark, item_text_col), **(PARAMETERS | parameters)).select(
        *(F.col(k).alias(n) for k, n in names.items())).distinct(), "leaking")
    return df.withColumns({names[k]: c for k, c in marks.items()}).join(
        found, list(names.values()), "left_anti").select(*df.columns)
