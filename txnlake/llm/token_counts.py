"""Token counts by dynamic programming over a trie of pre-tokens.

Texts are cut into pre-tokens (the independent parts of ``pieces``).  The distinct new
ones of a batch go into a trie; one walk over it computes, at each node, the best score of
the prefix that it stands for and the tokens of that best segmentation, from the scores
above it, so a prefix that many pre-tokens share is scored once.  Terminal nodes give the
pre-tokens' counts, which are kept (up to ``CACHE``) and summed for each document.

The count equals the number of ids that ``pieces.Encoder`` gives.

Defined cases: a null text has a null count, an empty one 0; pre-tokens of over
``TRIE_CHARS`` characters are scored alone, by the same recurrence, in one pass.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlake.llm.common import share, ship
from txnlake.llm.pieces import CACHE, MARK, Vocabulary, per_worker

TRIE_CHARS = 64
BATCH_CHARS = 1_000_000
END = ""  # the key of a node at which a pre-token ends


class Endings:
    """Automaton that tells, after each character, the pieces that end there (longest
    first, as (length, score)), so no prefix is looked up that is not a piece."""

    def __init__(self, scores: dict[str, float]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.fall, self.out = [0], [()]
        for piece, score in scores.items():
            at = 0
            for c in piece:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.fall.append(0)
                    self.out.append(())
                at = self.next[at][c]
            self.out[at] = ((len(piece), score),)
        level = list(self.next[0].values())
        while level:
            below = []
            for at in level:
                for c, to in self.next[at].items():
                    self.fall[to] = self.step(self.fall[at], c)
                    self.out[to] += self.out[self.fall[to]]
                    below.append(to)
            level = below

    def step(self, at: int, c: str) -> int:
        while (to := self.next[at].get(c)) is None and at:
            at = self.fall[at]
        return to or 0


class Counter:
    def __init__(self, vocabulary: Vocabulary) -> None:
        self.scores = {p: s for p, s, _ in vocabulary.pieces}
        self.widest = max(map(len, self.scores))
        self.endings = Endings(self.scores)
        self.dummy, self.unknown = vocabulary.dummy, vocabulary.unknown
        self.parts = vocabulary.splitter()
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def _relax(self, state: int, c: str, best: list[float], tokens: list[int]) -> tuple[float, int]:
        """Best score and its tokens behind ``c``, from those of the prefixes (the latest last)."""
        top, count = float("-inf"), 0
        for size, score in self.endings.out[state]:
            if best[-size] + score > top:
                top, count = best[-size] + score, tokens[-size] + 1
        if c not in self.scores and best[-1] + self.unknown > top:
            top, count = best[-1] + self.unknown, tokens[-1] + len(c.encode())
        return top, count

    def _alone(self, part: str) -> int:
        best, tokens, state = [0.0], [0], 0
        for c in part:
            state = self.endings.step(state, c)
            top, count = self._relax(state, c, best, tokens)
            best.append(top)
            tokens.append(count)
            if len(best) > 64 * self.widest:
                del best[:-self.widest], tokens[:-self.widest]
        return tokens[-1]

    def learn(self, parts: Iterable[str]) -> None:
        """Counts of pre-tokens not yet known."""
        trie: dict = {}
        for part in parts:
            if len(part) > TRIE_CHARS:
                self.known[part] = self._alone(part)
                continue
            node = trie
            for c in part:
                below = node.get(c)
                if below is None:
                    below = node[c] = {}
                node = below
            node[END] = part
        step, relax = self.endings.step, self._relax
        best, tokens, states = [0.0], [0], [0]
        walk = [iter(trie.items())]
        while walk:
            for c, node in walk[-1]:
                if c == END:
                    self.known[node] = tokens[-1]
                    continue
                state = step(states[-1], c)
                top, count = relax(state, c, best, tokens)
                best.append(top)
                tokens.append(count)
                states.append(state)
                walk.append(iter(node.items()))
                break
            else:
                walk.pop()
                best.pop()
                tokens.pop()
                states.pop()

    def pre_tokens(self, text: str) -> Iterator[tuple[list[str], int]]:
        """(pre-tokens, tokens of marks that stand in the text) by stretches of bounded size."""
        for k, plain in enumerate(text.split(MARK)):
            if not k and self.dummy and text:
                plain = " " + plain
            marks, at = len(MARK.encode()) * bool(k), 0
            while at < len(plain) or marks:
                end = len(plain)
                if end - at > BATCH_CHARS:
                    end = at + len(plain[at:at + BATCH_CHARS].rstrip(" "))
                    end = plain.rfind(" ", at + 1, end)
                    while end > at and plain[end - 1] == " ":
                        end -= 1
                    end = end if end > at else len(plain)
                yield self.parts.findall(plain[at:end].replace(" ", MARK)), marks
                at, marks = end, 0

    def count(self, texts: list[str | None]) -> list[tuple[int, int] | tuple[None, None]]:
        """(pre-tokens, tokens) of each text."""
        sums = [(None, None) if t is None else (0, 0) for t in texts]
        held: list[tuple[int, list[str], int]] = []

        def settle() -> None:
            distinct = {p for _, parts, _ in held for p in parts}
            if len(self.known) > CACHE:
                self.older, self.known = self.known, {}
            new = distinct.difference(self.known)
            again = new & self.older.keys()
            self.known.update((p, self.older[p]) for p in again)
            self.learn(new - again)
            for row, parts, marks in held:
                n, total = sums[row]
                sums[row] = n + len(parts), total + marks + sum(map(self.known.__getitem__, parts))
            held.clear()

        size = 0
        for row, text in enumerate(texts):
            for parts, marks in self.pre_tokens(text) if text is not None else ():
                held.append((row, parts, marks))
                size += 8 * len(parts)
                if size >= BATCH_CHARS:
                    settle()
                    size = 0
        settle()
        return sums


def token_counts(df: DataFrame, model_path: str, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """id, n_pretokens and n_tokens of every row."""
    ship(df.sparkSession)
    shared = share(df.sparkSession, Vocabulary(model_path))

    @F.pandas_udf("n_pretokens long, n_tokens long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter = per_worker(shared.value, Counter)
        for texts in batches:
            got = counter.count([t if isinstance(t, str) else None for t in texts])
            yield pd.DataFrame(got, columns=["n_pretokens", "n_tokens"], dtype="Int64")

    return df.select(id_col, count(F.col(text_col)).alias("r")).select(id_col, "r.*")
