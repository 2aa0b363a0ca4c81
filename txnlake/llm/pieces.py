"""SentencePiece encoding and decoding with an Aho-Corasick automaton.

The automaton over all pieces scans a text once; at each position the output links give
every piece that ends there, longest first, and each relaxes the best score of that
position (Viterbi: the sum of piece scores is highest; ties keep the longer last piece).
A character without a piece of its own costs ten less than the lowest piece score and is
written as byte pieces.

White space marks: a space is written as the mark; a dummy one goes before the text where
the model says so.  A mark that stands in the text itself is written as byte pieces, so
decoding gives every text back exactly.

Where no piece can span two characters, the best segmentation is that of the two sides:
texts are cut before runs of marks, around line ends and between words and signs (derived
from the pieces), and parts that repeat are encoded once (a cache of twice ``CACHE`` parts
at most, per worker).

The models of this kind may come with merge ranks as scores: ids are then those of the best
path under these scores, which may differ from the merge order's.

Defined cases: a null text has null ids, an empty one no ids; one unbroken word of any
length is one part, scanned in one pass.
"""

from __future__ import annotations

import array
import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnlake.llm.common import kept, share, ship

MARK = "▁"
CACHE = 100_000
CACHED_CHARS = 64
#: A vocabulary up to this size is broadcast.
MAX_VOCABULARY_BYTES = 64 << 20
#: Below the lowest piece score; what a character without a piece costs.
UNKNOWN_PENALTY = 10.0
BATCH_IDS = 4_000_000


class Vocabulary:
    """Pieces of a model file: (piece, score, id) of the ordinary ones, the ids of the byte
    pieces, what each id stands for."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        self.pieces = [(sp.id_to_piece(i), sp.get_score(i), i) for i in range(n)
                       if not special[i] and not sp.is_byte(i)]
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        if len(self.bytes) != 256:
            raise ValueError("a vocabulary with byte pieces is needed")
        self.dummy = len(sp.encode("a")) > 0 and sp.id_to_piece(sp.encode("a")[0])[0] == MARK
        self.out = [b""] * n
        for piece, _, i in self.pieces:
            self.out[i] = piece.replace(MARK, " ").encode()
        for value, i in self.bytes.items():
            self.out[i] = bytes([value])
        self.digest = hashlib.sha256(repr((self.pieces, self.dummy)).encode()).hexdigest()
        size = sum(map(len, self.out)) + 40 * n
        if size > MAX_VOCABULARY_BYTES:
            raise ValueError(f"a vocabulary of {size} bytes is over the bound for broadcasts")

    @property
    def unknown(self) -> float:
        return min(s for _, s, _ in self.pieces) - UNKNOWN_PENALTY

    def splitter(self) -> re.Pattern:
        """Matches the parts of a text whose segmentations are independent: no piece holds a
        mark behind another character, a line end beside one, or a sign of ``signs`` behind
        a character that is neither a mark nor such a sign."""
        before: dict[str, set[str]] = {}
        for p, _, _ in self.pieces:
            for a, b in zip(p, p[1:]):
                before.setdefault(b, set()).add(a)
        if before.get(MARK, set()) - {MARK}:
            raise ValueError("a piece with a mark inside; texts cannot be cut at marks")
        joined = {c for p, _, _ in self.pieces if len(p) > 1 for c in p}
        alone = {c for c in "\n\t\r" if c not in joined}
        signs = {c for p, _, _ in self.pieces for c in p if not c.isalpha()} - alone - {MARK}
        while wrong := {c for c in signs if before.get(c, set()) - signs - {MARK}}:
            signs -= wrong
        every, signs = signs, {c for c in signs if c.isascii()}
        while more := {a for c in signs for a in before.get(c, ())} & every - signs:
            signs |= more  # the fewer, the faster to match
        a, s = (re.escape("".join(sorted(x))) for x in (alone, signs))
        words = rf"{MARK}*[^{MARK}{a}]+" if not s else \
            rf"{MARK}*[{s}]*[^{MARK}{a}{s}]+|{MARK}*[{s}]+"
        return re.compile((f"[{a}]|" if a else "") + f"{words}|{MARK}+")


class Encoder:
    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.automaton = ahocorasick.Automaton()
        for piece, score, i in vocabulary.pieces:
            self.automaton.add_word(piece, (len(piece), score, i))
        self.automaton.make_automaton()
        self.unknown = vocabulary.unknown
        self.single = {p for p, _, _ in vocabulary.pieces if len(p) == 1}
        self.parts = vocabulary.splitter()
        self.cache: dict[str, array.array] = {}
        self.older: dict[str, array.array] = {}

    def viterbi(self, part: str) -> array.array:
        """Ids of the best segmentation of one part."""
        n = len(part)
        best, last = [float("-inf")] * (n + 1), [None] * (n + 1)
        best[0] = 0.0
        # characters without a piece: positions that a byte step may reach, in order
        bare = [] if self.single.issuperset(part) else [
            k for k, c in enumerate(part, 1) if c not in self.single]
        bare.append(n + 1)
        step, due = iter(bare), 0
        due = next(step)
        for end, piece in self.automaton.iter(part):
            while due <= end:  # no piece that ends there is still to come
                if best[due - 1] + self.unknown > best[due]:
                    best[due], last[due] = best[due - 1] + self.unknown, None
                due = next(step)
            score = best[end + 1 - piece[0]] + piece[1]
            if score > best[end + 1]:
                best[end + 1], last[end + 1] = score, piece
        while due <= n:
            if best[due - 1] + self.unknown > best[due]:
                best[due], last[due] = best[due - 1] + self.unknown, None
            due = next(step)
        ids = array.array("i")
        while n:
            piece = last[n]
            if piece:
                ids.append(piece[2])
                n -= piece[0]
            else:
                ids.extend(self.v.bytes[b] for b in reversed(part[n - 1].encode()))
                n -= 1
        ids.reverse()
        return ids

    def encode(self, text: str) -> array.array:
        ids = array.array("i")
        if not text:
            return ids
        # a mark in the text itself: byte pieces, with an ordinary part on either side
        for k, plain in enumerate(text.split(MARK)):
            if k:
                ids.extend(self.v.bytes[b] for b in MARK.encode())
            elif self.v.dummy:
                plain = " " + plain
            for part in self.parts.findall(plain.replace(" ", MARK)):
                got = self.cache.get(part)
                if got is None:
                    got = self.older.get(part) or self.viterbi(part)
                    if len(part) <= CACHED_CHARS:
                        if len(self.cache) >= CACHE:  # parts in use are taken over again
                            self.older, self.cache = self.cache, {}
                        self.cache[part] = got
                ids.extend(got)
        return ids

    def decode(self, ids) -> str:
        text = b"".join(map(self.v.out.__getitem__, ids)).decode("utf-8")
        return text[1:] if self.v.dummy and ids else text


def per_worker(vocabulary: Vocabulary, make):
    """``make(vocabulary)``, kept for the later tasks of this Python worker."""
    return kept(make.__name__, vocabulary.digest, lambda: make(vocabulary))


def encode_documents(df: DataFrame, model_path: str, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids and whether the ids decode to the text, for every row."""
    ship(df.sparkSession)
    shared = share(df.sparkSession, Vocabulary(model_path))
    schema = T.StructType([
        T.StructField(id_col, df.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("round_trip", T.BooleanType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = per_worker(shared.value, Encoder)

        def out(keys, flat, ends, same):
            ids = pa.ListArray.from_arrays(
                pa.array([None if e is None else s for s, e in zip([0, *_filled(ends)], ends)]
                         + [len(flat)], pa.int32()), pa.array(np.frombuffer(flat, np.int32)
                                                              if len(flat) else [], pa.int32()))
            n = [None if e is None else e - s for s, e in zip([0, *_filled(ends)], ends)]
            return pa.RecordBatch.from_arrays(
                [keys, pa.array(n, pa.int64()), ids, pa.array(same, pa.bool_())], schema.names)

        for batch in batches:
            flat, ends, same, start = array.array("i"), [], [], 0
            keys = batch[id_col]
            for i, cell in enumerate(batch["text"]):
                text = cell.as_py()
                if text is None:
                    ends.append(None)
                    same.append(None)
                else:
                    ids = coder.encode(text)
                    flat.extend(ids)
                    ends.append(len(flat))
                    same.append(coder.decode(ids) == text)
                if len(flat) >= BATCH_IDS:
                    yield out(keys.slice(start, i + 1 - start), flat, ends, same)
                    flat, ends, same, start = array.array("i"), [], [], i + 1
            if ends:
                yield out(keys.slice(start), flat, ends, same)

    return df.select(id_col, F.col(text_col).alias("text")).mapInArrow(encode, schema)


def _filled(ends: list[int | None]) -> list[int]:
    """Each row's end, a null row's being that of the row before."""
    out, at = [], 0
    for e in ends:
        at = at if e is None else e
        out.append(at)
    return out
