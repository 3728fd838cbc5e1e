"""Word-piece counts by a linear longest-match automaton.

The vocabulary is a trie with two roots: pieces that begin a word and pieces that continue one.  Where the walk cannot
go on, a failure link leads to the state that remains after the longest-match pieces read so far are popped off; only
their number is stored.  Every character is read once, and no piece is ever built.

A word that cannot be cut into pieces is one unknown piece, as in greedy word-piece tokenizers.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forecourt.llm.frames import col, text_of

VOCABULARY = "piece_bpe_32k.model"
WORD_START = "▁"
# Words remembered per Python worker and the longest of them: bounds on memory, not on results.
REMEMBERED = 250_000
REMEMBERED_CHARS = 48
_WORDS = re.compile("[^\x20\x09-\x0d]+")


class Automaton:
    """Counts the pieces of a word by greedy longest match.

    `pieces` that begin with `start` begin a word, the others continue one.
    """

    def __init__(self, pieces: Iterable[str], start: str = WORD_START) -> None:
        # State 0 begins a word, state 1 continues it.
        self.next: list[dict[str, int]] = [{}, {}]
        self.start = start
        ends = set()
        for piece in pieces:
            if not piece:
                continue
            state = 0 if piece.startswith(start) else 1
            for c in piece:
                state = self.next[state].setdefault(c, len(self.next))
                if state == len(self.next):
                    self.next.append({})
            ends.add(state)
        # fail[s]: state left after popping, -1 if the text read cannot be cut; pops[s]: pieces popped on the way.
        self.fail = [-1] * len(self.next)
        self.pops = [0] * len(self.next)
        queue = deque([0, 1])
        while queue:
            above = queue.popleft()
            for c, state in self.next[above].items():
                if state in ends:
                    self.fail[state], self.pops[state] = 1, 1
                else:
                    popped, back = self.pops[above], self.fail[above]
                    while back >= 0 and c not in self.next[back]:
                        popped += self.pops[back]
                        back = self.fail[back]
                    if back >= 0:
                        self.fail[state], self.pops[state] = self.next[back][c], popped
                queue.append(state)

    def count(self, word: str) -> int:
        """Pieces of `word`; 0 if it cannot be cut into pieces."""
        following, fail, pops = self.next, self.fail, self.pops
        state = total = 0
        for c in self.start + word:
            while (to := following[state].get(c, -1)) < 0:
                total += pops[state]
                state = fail[state]
                if state < 0:
                    return 0
            state = to
        while state != 1:
            total += pops[state]
            state = fail[state]
            if state < 0:
                return 0
        return total


class Counter:
    def __init__(self, automaton: Automaton) -> None:
        self.automaton = automaton
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def counts(self, text: str) -> tuple[int, int, int]:
        """Words, pieces (an unknown word is one) and unknown words of a text."""
        known, learn = self.known, self._learn
        n = pieces = unknown = 0
        for match in _WORDS.finditer(text):
            word = match.group()
            size = known.get(word)
            if size is None:
                size = learn(word)
                known = self.known
            n += 1
            pieces += size
            unknown += not size
        return n, pieces + unknown, unknown

    def _learn(self, word: str) -> int:
        size = self.older.get(word)
        if size is None:
            size = self.automaton.count(word)
        if len(word) <= REMEMBERED_CHARS:
            if len(self.known) >= REMEMBERED:
                self.older, self.known = self.known, {}
            self.known[word] = size
        return size


def read_pieces(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return [model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One per Python worker."""
    return Counter(Automaton(read_pieces(path)))


def count_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, n_words, n_pieces, n_unknown_words; one row per row of `docs`.

    `path` names a vocabulary file that every executor has.  NULL text counts as empty: all counts 0.  Texts and words
    of any length are read whole.  Repeated rows give equal rows, an empty table none; other columns are not read.
    """
    file = path or public_tokenizers.path(VOCABULARY)

    @F.pandas_udf("n_words bigint, n_pieces bigint, n_unknown_words bigint")
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        run = counter(file).counts
        for texts in batches:
            yield pd.DataFrame([run(t) for t in texts], columns=["n_words", "n_pieces", "n_unknown_words"])

    return docs.select(col(id_col).alias("doc_id"), measure(text_of(text_col)).alias("m")).select("doc_id", "m.*")
