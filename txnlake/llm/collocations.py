"""Collocations: phrases of two and three words that stand together more often than by chance.

A text's A-Z are lower-cased, pieces end at ``SEPARATORS``, words at spaces and tabs; everything
is counted per language.  ``n`` is the number of words, f(phrase) that of its contiguous
occurrences within pieces.  Candidates are the phrases with f >= ``least``.

The texts are read once into a table of chunks: the numbers of their words, and of each number
the word's 64-bit hash.  The table of words tells whether two words of a language share a hash;
if so, the texts are read again with another seed, so from there on hashes stand for words exactly.

Level by level, as in Apriori: only words with f >= ``least`` can stand in a candidate pair, and
only such pairs in a candidate triple.  Pairs, then triples, are first counted by KEY_BITS of the
hash of their words; the keys that reach ``least`` become a filter of a fixed size, broadcast to the
next level.  (Both may let more through, never less.)  Tasks send such numbers and counts packed, a
row for each range of keys (sorted, differences, compressed), and a range's rows are added up
together; there are more ranges where there are more words.  What passes the filters are the
candidates.  With their words they go into double-array tries (one root a language), dealt by
ranges of (language, words) to about ``max_phrases`` each; tasks build them.  Tries are broadcast, ``READING`` of that
many phrases at a time, and the chunks are read once for each such lot: numpy advances the states
of the text positions together, level by level; accepting states are counted with bincount, and the
tasks' counts, packed likewise, summed.  All of a, l and r come from there.  A trie holds a range
of first words, so a position takes part in few of them; no task's memory grows with the candidates.

Cutting a candidate in two gives l and r (f of the first part and of the rest) and the score
floor(1000000 a a / (l r)), in decimals of 38 digits; the lowest score counts, ties to the
smaller cut.  A candidate inside a longer one that has ``nested`` percent of its f or more is
dropped.

Defined cases: a null text is empty, a null language is ``und``; a phrase does not reach from one
text into another; repeated rows count again; a text of many megabytes is read in pieces, each
with the two words that follow it; ties go to the smaller phrase (UTF-8 bytes); an empty table
gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import contextlib
import dataclasses
import itertools
import pickle
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txnlake.llm.common import share, ship, stored
from txnlake.session import scratch_path

SEPARATORS = b".,;:!?\n\v\f\r"
END = b"\xff"  # the end of a piece; no UTF-8 text holds this byte
NO_LANG = "und"
BLOCK = 1 << 20  # bytes of text read at a time
CHUNK_WORDS = 1 << 20  # words of a chunk
HELD_HASHES = 1 << 20  # hashes of phrases that a task holds
HELD_WORDS = 1 << 18  # words that a task counts before it hands them on
KEY_BITS = 40  # of a phrase's hash, by which it is counted
LEAST_PARTS, PART_STARTS, PART_IDS = 8, 1 << 21, 14  # bits; places of phrases in a part; bits
SLICE = 1 << 16  # rows of numbers of a batch from a worker
FILTER_BITS = 25  # the two probes: the lowest and the highest of KEY_BITS
READING = 3  # full tries that one reading of the chunks counts
#: Chunks are rows of megabytes: bytes of a batch between Spark and a worker, and pages and row groups
#: that close after any row, so that what stands beside the heap does not grow with rows.  Chunks
#: and words are written side by side, without a sort.
_CONF = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
         "spark.sql.maxConcurrentOutputFileWriters": "2"}
_PAGES = {"compression": "zstd", "parquet.page.size.row.check.min": "1", "parquet.block.size": str(16 << 20)}
_BYTES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + SEPARATORS,
                         b"abcdefghijklmnopqrstuvwxyz " + END * len(SEPARATORS))
_NEXT = re.compile(rb" *[^ \xff]+")
_WORD = re.compile(rb"[^ \xff]*")


# --------------------------------------------------------------------------- reading

def _cuts(raw: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Pieces of about BLOCK bytes of one text, each with its next two words, if the text goes
    on there within a piece."""
    at = 0
    while len(raw) - at > BLOCK:
        end = raw.rfind(END, at, at + BLOCK) + 1
        ahead = b""
        if end <= at:
            end = raw.rfind(b" ", at, at + BLOCK) + 1
            if end <= at:  # one word, longer than a block
                end = _WORD.match(raw, at + BLOCK).end()
            first = _NEXT.match(raw, end)
            second = _NEXT.match(raw, first.end()) if first else None
            ahead = raw[end:(second or first).end()] if first else b""
        yield raw[at:end], ahead
        at = end
    yield raw[at:], b""


def blocks(langs: Iterable, texts: Iterable) -> Iterator[tuple[str, list[bytes], int]]:
    """(language, words, number of starts) of about BLOCK bytes of text; END stands between
    pieces and texts.  Words from the number of starts on only complete phrases."""
    held: dict[str, list[bytes]] = {}
    size: Counter = Counter()

    def words(raw: bytes) -> list[bytes]:
        return raw.replace(END, b" \xff ").split()

    for lang, text in zip(langs, texts):
        if not text:
            continue
        lang = NO_LANG if lang is None else lang
        raw = text.encode("utf-8", "surrogatepass").translate(_BYTES)
        if len(raw) > BLOCK:
            for piece, ahead in _cuts(raw):
                got = words(piece)
                yield lang, got + words(ahead), len(got)
            continue
        held.setdefault(lang, []).append(raw)
        size[lang] += len(raw)
        if size[lang] >= BLOCK:
            got = words(END.join(held.pop(lang)))
            size[lang] = 0
            yield lang, got, len(got)
    for lang, raws in held.items():
        got = words(END.join(raws))
        yield lang, got, len(got)


def _word_hash(lang: str, words: Iterable[bytes], seed: int) -> np.ndarray:
    """64-bit hashes of words; 0 is END's."""
    seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), seed)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) or 1 for w in words), np.uint64)


def _planes(x: np.ndarray) -> np.ndarray:
    """The bytes of numbers below 2^32, the lowest of all first: so they compress better."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T)


def _numbers(planes) -> np.ndarray:
    planes = np.frombuffer(planes, np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


READ = "lang string, ids binary, hashes binary, starts int, word string, n long"


def read_texts(docs: DataFrame, seed: int) -> DataFrame:
    """Chunks (lang, ids, hashes, starts) and, in rows of their own, the words (lang, word, n) of
    docs (lang, text).  A chunk's ids are numbers of its words by falling frequency (as _planes), 0
    is END, and hashes[id] is the word's; phrases start at the first ``starts`` ids.  A word has a
    row for each task that read it, or more."""
    def chunk(lang: str, parts: list[list[bytes]], starts: int | None, counts: dict[bytes, int]) -> pa.RecordBatch:
        number: dict[bytes, int] = {END: 0}
        flat = list(itertools.chain.from_iterable([*p, END] for p in parts))
        for w in set(flat).difference(number):
            number[w] = len(number)
        ids = np.fromiter(map(number.__getitem__, flat), "<u4", len(flat))
        words = list(number)[1:]
        h = _word_hash(lang, words, seed)
        starts = len(ids) if starts is None else starts
        for w, n in zip(words, np.bincount(ids[:starts], minlength=len(number))[1:].tolist()):
            counts[w] = counts.get(w, 0) + n
        order = np.argsort(-np.bincount(ids, minlength=len(number))[1:], kind="stable")
        rank = np.zeros(len(number), "<u4")
        rank[1 + order] = np.arange(1, len(number))
        return pa.RecordBatch.from_arrays(
            [pa.array([lang], pa.string()), pa.array([_planes(rank[ids]).tobytes()], pa.binary()),
             pa.array([np.concatenate([np.zeros(1, np.uint64), h[order]]).tobytes()], pa.binary()),
             pa.array([starts], pa.int32()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64())], names)

    def words_of(counts: dict[str, dict[bytes, int]]) -> Iterator[pa.RecordBatch]:
        for lang, found in counts.items():
            words = sorted(found)
            for at in range(0, len(words), 1 << 14):
                part = words[at:at + (1 << 14)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part), pa.string()), *(pa.nulls(len(part), pa.binary()),) * 2,
                     pa.nulls(len(part), pa.int32()),
                     pa.array([w.decode("utf-8", "surrogatepass") for w in part], pa.string()),
                     pa.array([found[w] for w in part], pa.int64())], names)

    names = [x.split()[0] for x in READ.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, dict[bytes, int]] = defaultdict(dict)
        for lang, parts, starts in parted(batches):
            yield chunk(lang, parts, starts, counts[lang])
            if sum(map(len, counts.values())) >= HELD_WORDS:
                yield from words_of(counts)
                counts.clear()
        yield from words_of(counts)

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[list[bytes]], int | None]]:
        held: dict[str, list] = {}
        size: Counter = Counter()
        for batch in batches:
            texts = ((x.as_py() for x in batch[c]) for c in ("lang", "text"))
            for lang, words, starts in blocks(*texts):
                if starts < len(words):  # a piece of a long text, with the words that follow it
                    yield lang, [words], starts
                    continue
                held.setdefault(lang, []).append(words)
                size[lang] += len(words)
                if sum(size.values()) >= CHUNK_WORDS:
                    lang = max(size, key=size.get)
                    size[lang] = 0
                    yield lang, held.pop(lang), None
        for lang, parts in held.items():
            yield lang, parts, None

    return docs.mapInArrow(read, READ)


def with_hashes(words: DataFrame, seed: int) -> DataFrame:
    """(lang, h, word, n): the words (lang, word, n) with their hashes."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch["lang"].to_pylist()
            words = [w.encode("utf-8", "surrogatepass") for w in batch["word"].to_pylist()]
            h = np.zeros(len(words), np.uint64)
            for lang in set(langs):
                at = [i for i, x in enumerate(langs) if x == lang]
                h[at] = _word_hash(lang, [words[i] for i in at], seed)
            yield pa.RecordBatch.from_arrays([batch["lang"], pa.array(h.view(np.int64)), batch["word"], batch["n"]],
                                             ["lang", "h", "word", "n"])

    return words.mapInArrow(add, "lang string, h long, word string, n long")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, np.ndarray, int]]:
    for batch in batches:
        for i in range(len(batch)):
            yield (batch["lang"][i].as_py(), _numbers(batch["ids"][i].as_buffer()),
                   np.frombuffer(batch["hashes"][i].as_buffer(), "<u8"), batch["starts"][i].as_py())


# ------------------------------------------------------------------- level candidates

def _phrase_hash(parts: list[np.ndarray]) -> np.ndarray:
    """The hash of words' hashes, or of pairs' hashes: both say which words and language."""
    h = parts[0]
    for p in parts[1:]:
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + p
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(31))


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    def probe(h: np.ndarray) -> np.ndarray:
        at = (h & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
        return (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1

    ok = probe(h)
    ok[ok] = probe(h[ok] >> np.uint64(KEY_BITS - FILTER_BITS))
    return ok


def filter_of(hashes: DataFrame) -> np.ndarray:
    """The bits of a filter that holds all values of column ``h``, two bits each; its size is fixed."""
    slot = f"(x & {(1 << FILTER_BITS) - 1})"
    hashes = hashes.selectExpr(f"explode(array(h, shiftright(h, {KEY_BITS - FILTER_BITS}))) AS x")
    got = hashes.selectExpr(f"shiftright({slot}, 6) AS at", f"shiftleft(1L, cast({slot} & 63 AS int)) AS bit") \
        .groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    bits[got["at"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return bits


def _starts(filters: list[np.ndarray], ids: np.ndarray, hashes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of a chunk, for phrases of 2, 3 ... words as far as the filters (of words, pairs ...) go: the
    places where one starts whose parts pass, and its hash."""
    word = _has(filters[0], hashes)
    word[0] = False
    ok, h = word[ids], hashes[ids]
    start = np.flatnonzero(ok[:-1] & ok[1:])
    found = [(start, _phrase_hash([h[start], h[start + 1]]))]
    for below in filters[1:]:
        start, key = found[-1]
        good = _has(below, key)
        start, key = start[good], key[good]
        follows = np.flatnonzero(start[1:] == start[:-1] + 1)
        found[-1] = start, key
        found.append((start[follows], _phrase_hash([key[follows], key[follows + 1]])))
    return found


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their summed numbers."""
    key, n = (np.concatenate(x) for x in zip(*parts))
    key, at = np.unique(key, return_inverse=True)
    return key, np.bincount(at, n, len(key)).astype(np.int64)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of SLICE rows, so that no large buffer is needed to receive it."""
    return (batch.slice(at, SLICE) for at in range(0, len(batch), SLICE))


PACKED = "part long, many int, packed binary"


def _packed(key: np.ndarray, n: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """PACKED: ascending keys and their counts, a row for each value of key >> bits."""
    part = key >> bits
    first = np.flatnonzero(np.diff(part, prepend=-1))
    rows: list[tuple[int, int, bytes]] = []
    for at, end in itertools.pairwise([*first.tolist(), len(key)]):
        gaps = np.diff(key[at:end], prepend=part[at] << bits)
        rows.append((int(part[at]), end - at, pa.compress(
            _planes(np.concatenate([gaps, n[at:end]])), codec="zstd", asbytes=True)))
        if len(rows) == 256 or end == len(key):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(
                zip(*rows), (pa.int64(), pa.int32(), pa.binary()))], ["part", "many", "packed"])
            rows = []


def _summed(rows: pa.Table, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of a part's rows and their summed counts."""
    start, held, size = rows["part"][0].as_py() << bits, [], 0
    for many, raw in zip(rows["many"], rows["packed"]):
        many = many.as_py()
        x = _numbers(pa.decompress(raw.as_buffer(), 8 * many, codec="zstd"))
        held.append((start + np.cumsum(x[:many]), x[many:]))
        size += many
        if size > HELD_HASHES:
            held, size = [_merged(held)], 0
    return _merged(held)


def frequent(chunks: DataFrame, filters: list[np.ndarray], least: int, parts: int) -> DataFrame:
    """(h): KEY_BITS of the hashes of phrases, one word longer than the last filter's, whose parts
    pass the filters (of words, of pairs) and that occur ``least`` times; added up in 2^parts parts."""
    shared = [share(chunks.sparkSession, f) for f in filters]
    bits, mask = KEY_BITS - parts, np.uint64((1 << KEY_BITS) - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, ids, hashes, starts in _chunks(batches):
            start, h = _starts([f.value for f in shared], ids, hashes)[-1]
            held.append(np.unique((h[start < starts] & mask).view(np.int64), return_counts=True))
            size += len(held[-1][0])
            if size > HELD_HASHES:
                yield from _packed(*_merged(held), bits)
                held, size = [], 0
        if held:
            yield from _packed(*_merged(held), bits)

    def often(rows: pa.Table) -> pa.Table:
        h, n = _summed(rows, bits)
        return pa.table({"h": h[n >= least]})

    return chunks.mapInArrow(count, PACKED).groupBy("part").applyInArrow(often, "h long")


def candidates(chunks: DataFrame, filters: list[np.ndarray]) -> DataFrame:
    """(lang, w1, w2, w3), words by their hashes, of the pairs (w3 null) and triples whose parts and
    selves pass the filters (of words, pairs, triples)."""
    shared = [share(chunks.sparkSession, f) for f in filters]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, ids, hashes, starts in _chunks(batches):
            # the last level's parts passed all filters; what comes after it is not asked for
            for k, (start, key) in enumerate(_starts([f.value for f in shared], ids, hashes)[:-1], 2):
                inside = start < starts
                _, at = np.unique(key[inside], return_index=True)
                at = start[inside][at]
                at = at[np.lexsort((ids[at + 1], ids[at]))]  # alike side by side: they compress
                words = [pa.array(hashes[ids[at + i]].view(np.int64)) for i in range(k)]
                words += [pa.nulls(len(at), pa.int64())] * (3 - k)
                yield from _slices(pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(at), pa.string()), *words], ["lang", "w1", "w2", "w3"]))

    return chunks.mapInArrow(find, "lang string, w1 long, w2 long, w3 long").distinct()


# ------------------------------------------------------------------ double-array tries

@dataclasses.dataclass
class Trie:
    """From a state, letter c (a word's number) leads to state base[state] + c, if that one's
    check is the state.  The first states are the languages' roots."""
    langs: list[str]
    words: np.ndarray  # hashes, ascending
    numbers: np.ndarray  # and the letter of each
    base: np.ndarray
    check: np.ndarray
    phrase: np.ndarray  # of each state, the id of the phrase that ends there, or -1

    @classmethod
    def build(cls, langs: np.ndarray, words: list[np.ndarray], there: list[np.ndarray],
              ids: np.ndarray) -> Trie:
        """Of phrases with a language, words by position (where there are any) and an id."""
        names, lang = np.unique(langs.astype(str), return_inverse=True)
        known, often = np.unique(np.concatenate([x[t] for x, t in zip(words, there)]), return_counts=True)
        # frequent words get small numbers, so that children lie close together
        letters = np.zeros(len(known), np.int64)
        letters[np.argsort(-often, kind="stable")] = np.arange(1, len(known) + 1)
        # nodes, level by level: distinct (node above, letter)
        node, parents, marks, size = lang, [], [], len(names)
        last = node.copy()
        for x, t in zip(words, there):
            code = letters[np.searchsorted(known, x[t])]
            pairs, at = np.unique(node[t] * (len(letters) + 1) + code, return_inverse=True)
            parents.append(pairs // (len(letters) + 1))
            marks.append(pairs % (len(letters) + 1))
            node = node.copy()
            node[t] = size + at
            last[t] = node[t]
            size += len(pairs)
        parent, mark = np.concatenate(parents), np.concatenate(marks)
        base = cls._places(parent, mark, len(names), size)
        state = np.arange(size)
        state[len(names):] = base[parent] + mark
        top = int(state.max()) + 1
        bases, check, phrase = np.zeros(top, np.int64), np.full(top, -1, np.int64), np.full(top, -1, np.int64)
        bases[state] = base
        check[state[len(names):]] = state[parent]
        phrase[state[last]] = ids
        return cls(names.tolist(), known, letters, bases, check, phrase)

    @staticmethod
    def _places(parent: np.ndarray, mark: np.ndarray, roots: int, size: int) -> np.ndarray:
        """A base for each node, so that no two children share a place: nodes with many children
        first, each at the first place that suits it of a window that moves on; single children
        then fill the gaps."""
        order = np.lexsort((mark, parent))
        parent, mark = parent[order], mark[order]
        who, first, many = np.unique(parent, return_index=True, return_counts=True)
        base = np.zeros(size, np.int64)
        taken = np.zeros(roots + 2 * size + int(mark.max(initial=0)) + 1, bool)
        taken[:roots] = True
        free, top, window, kind = roots, roots, 1 << 10, 0
        for i in np.lexsort((who, -many))[:int((many > 1).sum())].tolist():
            letters = mark[first[i]:first[i] + many[i]]
            span = letters - letters[0]
            size_class = int(many[i]) if many[i] <= 8 else 8 + int(many[i]).bit_length()
            if size_class != kind:  # fewer children: look again from the first gap on
                kind, free = size_class, roots
            if top + 2 * window + span[-1] > len(taken):
                taken = np.concatenate([taken, np.zeros(len(taken) + 2 * window + int(span[-1]), bool)])
            while True:
                room = np.flatnonzero(~taken[free:free + window]) + free
                tried = 1
                while len(room) and tried < len(span):  # a few children, then twice as many
                    some = span[tried:2 * tried]
                    room = room[:512 if tried > 4 else None]
                    room = room[~taken[room[:, None] + some].any(1)]
                    tried *= 2
                if len(room):
                    break
                free = min(free + window, top)  # and not here again, for nodes of this size
            at = int(room[0])
            taken[at + span] = True
            top = max(top, at + int(span[-1]) + 1)
            base[who[i]] = at - letters[0]
        single = np.flatnonzero(many == 1)
        if len(single):
            taken = np.concatenate([taken, np.zeros(len(single), bool)])
            base[who[single]] = np.flatnonzero(~taken)[:len(single)] - mark[first[single]]
        return base

    def dump(self) -> bytes:
        """Compressed, as most places of the arrays are empty: it goes through the driver."""
        small = (x.astype("<i4") for x in (self.numbers, self.base, self.check))
        return zlib.compress(pickle.dumps((self.langs, self.words, *small, self.phrase)), 1)

    @classmethod
    def load(cls, raw: bytes) -> Trie:
        return cls(*pickle.loads(zlib.decompress(raw)))

    def step(self, states: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The next states; -1 where there is none."""
        to = self.base[states] + letters
        ok = (letters > 0) & (to >= 0) & (to < len(self.check))
        to = np.where(ok, to, 0)
        return np.where(ok & (self.check[to] == states), to, -1)

    def count(self, lang: str, ids: np.ndarray, hashes: np.ndarray, starts: int,
              total: np.ndarray, depth: int = 3) -> None:
        """Add to the total how often each accepting state is reached in a chunk."""
        if lang not in self.langs:
            return
        at = np.searchsorted(self.words, hashes).clip(max=len(self.words) - 1)
        letters = np.where(self.words[at] == hashes, self.numbers[at], 0)
        # the first step, once for each word; few words start a phrase of this trie
        first = self.step(np.full(len(letters), self.langs.index(lang)), letters)
        at = np.flatnonzero((first >= 0)[ids[:starts]])
        states = first[ids[at]]
        reached = [states[self.phrase[states] >= 0]]
        for level in range(1, depth):
            inside = at + level < len(ids)
            at, states = at[inside], states[inside]
            states = self.step(states, letters[ids[at + level]])
            at, states = at[states >= 0], states[states >= 0]
            reached.append(states[self.phrase[states] >= 0])
        total += np.bincount(np.concatenate(reached), minlength=len(total))


def _built(phrases: pa.Table) -> pa.Table:
    """One shard's trie, as a row."""
    cols = [phrases[c].combine_chunks() for c in ("w1", "w2", "w3")]
    trie = Trie.build(np.array(phrases["lang"].to_pylist(), object),
                      [c.fill_null(0).to_numpy().view(np.uint64) for c in cols],
                      [c.is_valid().to_numpy(zero_copy_only=False) for c in cols], phrases["id"].to_numpy())
    return pa.table({"shard": pa.array([phrases["shard"][0].as_py()], pa.int32()),
                     "trie": pa.array([trie.dump()], pa.binary())})


def trie_counts(chunks: DataFrame, phrases: DataFrame, max_phrases: int) -> DataFrame:
    """(lang, w1, w2, w3, a): the occurrences in the chunks of the stored phrases (of one to three
    words, by hash; those missing are null)."""
    spark = chunks.sparkSession
    shards = max(-(-phrases.count() // max_phrases), 1)
    dealt = stored(phrases.repartitionByRange(shards, "lang", "w1", "w2", "w3").withColumns({
        "id": F.monotonically_increasing_id(), "shard": F.spark_partition_id()}), "phrases")
    tries = stored(dealt.groupBy("shard").applyInArrow(_built, "shard int, trie binary"), "tries")
    lots, size = [], 0  # the shards of each reading; ranges are not quite even
    for r in dealt.groupBy("shard").count().orderBy("shard").collect():
        if not lots or size + r["count"] > 1.25 * READING * max_phrases:
            lots, size = [*lots, []], 0
        lots[-1].append(r["shard"])
        size += r["count"]

    def add(rows: pa.Table) -> pa.Table:
        return pa.table(dict(zip(("id", "a"), _summed(rows, PART_IDS))))

    sums = dealt.select("id", F.lit(0).cast("long").alias("a")).limit(0)
    for lot in lots:
        # READING * max_phrases bounds their size, of a few MB
        shared = spark.sparkContext.broadcast(
            [r["trie"] for r in tries.where(F.col("shard").isin(lot)).select("trie").collect()])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            held = [Trie.load(raw) for raw in shared.value]
            totals = [np.zeros(len(trie.base), np.int64) for trie in held]
            for chunk in _chunks(batches):
                for trie, total in zip(held, totals):
                    trie.count(*chunk, total)
            for trie, total in zip(held, totals):
                state = np.flatnonzero(total)
                state = state[np.argsort(trie.phrase[state])]
                yield from _packed(trie.phrase[state], total[state], PART_IDS)

        sums = sums.unionAll(stored(chunks.mapInArrow(run, PACKED).groupBy("part").applyInArrow(
            add, "id long, a long"), "trie-counts"))
        shared.destroy()
    return stored(dealt.join(sums, "id").select("lang", "w1", "w2", "w3", "a"), "counted")


# -------------------------------------------------------------------------- the report

def _score(a: str, left: str, right: str):
    """floor(1000000 a a / (left right)), exactly."""
    return F.expr(f"(1000000BD * cast({a} as decimal(38,0)) * {a}) div "
                  f"(cast({left} as decimal(38,0)) * {right})")


def scored(phrases: DataFrame, nested: int) -> DataFrame:
    """(lang, w1, w2, w3, a, l, r, score) of the phrases that stay, from the counts of words,
    pairs and triples (lang, w1, w2, w3, a)."""
    words = phrases.where("w2 IS NULL").select("lang", "w1", "a")
    pairs = phrases.where("w2 IS NOT NULL AND w3 IS NULL").select("lang", "w1", "w2", "a")
    triples = phrases.where("w3 IS NOT NULL")

    def with_count(df: DataFrame, counts: DataFrame, keys: list[str], name: str) -> DataFrame:
        cols = [c for c in counts.columns if c not in ("lang", "a")]
        return df.join(counts.select("lang", *(F.col(c).alias(k) for c, k in zip(cols, keys)),
                                     F.col("a").alias(name)), ["lang", *keys])

    longer = triples.select("lang", F.col("a").alias("b"), F.explode(F.array(
        F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"))
    longest = longer.groupBy("lang", "p.w1", "p.w2").agg(F.max("b").alias("b"))
    two = with_count(with_count(pairs, words, ["w1"], "l"), words, ["w2"], "r")
    two = two.join(longest, ["lang", "w1", "w2"], "left").where(
        f"b IS NULL OR 100 * b < {int(nested)} * a").select(
        "lang", "w1", "w2", F.lit(None).cast("long").alias("w3"), "a", "l", "r",
        _score("a", "l", "r").alias("score"))
    three = with_count(with_count(triples, words, ["w1"], "l1"), pairs, ["w2", "w3"], "r1")
    three = with_count(with_count(three, pairs, ["w1", "w2"], "l2"), words, ["w3"], "r2")
    three = three.select("*", _score("a", "l1", "r1").alias("s1"), _score("a", "l2", "r2").alias("s2"))
    first = F.col("s1") <= F.col("s2")
    three = three.select("lang", "w1", "w2", "w3", "a", F.when(first, F.col("l1")).otherwise(
        F.col("l2")).alias("l"), F.when(first, F.col("r1")).otherwise(F.col("r2")).alias("r"),
        F.least("s1", "s2").alias("score"))
    return two.unionByName(three)


def _apart(read: DataFrame) -> DataFrame:
    """What was read, stored with chunks and words in folders of their own (column kind)."""
    path = scratch_path(read.sparkSession, "llm-read")
    kind = F.when(F.col("word").isNull(), "chunk").otherwise("word")
    read.withColumn("kind", kind).write.options(**_PAGES).partitionBy("kind").parquet(path)
    return read.sparkSession.read.schema(f"{READ}, kind string").parquet(path)


@contextlib.contextmanager
def _set(spark: SparkSession, conf: dict[str, str]):
    """Settings for the jobs inside."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10,
                 nested: int = 50, top: int = 2000, max_phrases: int = 300_000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` best phrases of each language."""
    ship(df.sparkSession)
    docs = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"),
                     F.col(text_col).alias("text")).where("text IS NOT NULL")
    with _set(df.sparkSession, _CONF):
        words, counted = _counted(docs, least, max_phrases)
    return _best(scored(counted, nested), words, top)


def _counted(docs: DataFrame, least: int, max_phrases: int) -> tuple[DataFrame, DataFrame]:
    """The words (lang, h, word, n) and, as trie_counts gives them, the candidates and their words."""
    for seed in itertools.count():
        read = _apart(read_texts(docs, seed))
        words = stored(with_hashes(read.where("kind = 'word'").groupBy("lang", "word").agg(
            F.sum("n").alias("n")), seed), "words")
        if words.groupBy("lang", "h").count().where("count > 1").isEmpty():
            break
    chunks = read.where("kind = 'chunk'").select("lang", "ids", "hashes", "starts")
    filters = [filter_of(words.where(F.col("n") >= least).select("h"))]
    places = chunks.agg(F.sum("starts")).first()[0] or 0
    parts = min(max(LEAST_PARTS, (places // PART_STARTS).bit_length()), KEY_BITS)
    for _ in range(2):
        filters.append(filter_of(frequent(chunks, filters, least, parts)))
    found = stored(candidates(chunks, filters), "candidates")
    single = found.where("w3 IS NULL").select("lang", F.explode(F.array("w1", "w2")).alias("w1")).distinct()
    missing = F.lit(None).cast("long")
    phrases = stored(found.unionByName(single.select(
        "lang", "w1", missing.alias("w2"), missing.alias("w3"))), "all-phrases")
    # the filters may have let a few through that are too rare, but words count whatever they are
    return words, trie_counts(chunks, phrases, max_phrases).where((F.col("a") >= least) | F.col("w2").isNull())


def _best(phrases: DataFrame, words: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each language, with their words."""
    order = [F.desc("score"), F.desc("a")]
    # first within slices of a language, so that no task ranks all phrases of one; by numbers alone
    # with all that tie, so that words are joined to what can be among the first only
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("w1", "w2", "w3"), F.lit(64))).orderBy(*order)
    best = phrases.withColumn("rank", F.rank().over(part)).where(F.col("rank") <= top)
    best = stored(best.withColumn("rank", F.rank().over(
        Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top), "best")
    asked = best.select("lang", F.explode(F.array("w1", "w2", "w3")).alias("h")).where("h IS NOT NULL").distinct()
    known = stored(words.join(asked, ["lang", "h"]).select("lang", "h", "word"), "best-words")
    for i in (1, 2, 3):
        best = best.join(known.select("lang", F.col("h").alias(f"w{i}"), F.col("word").alias(f"t{i}")),
                         ["lang", f"w{i}"], "inner" if i < 3 else "left")
    best = best.withColumn("phrase", F.concat_ws(" ", "t1", "t2", "t3"))
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order, "phrase")
    best = best.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(
        Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long")).where(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
