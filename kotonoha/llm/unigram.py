"""Token counts of unigram vocabularies: Viterbi that carries a score and a count, and no path."""

from __future__ import annotations

import re
from copy import copy
from functools import lru_cache

import ahocorasick
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kotonoha.llm.common import map_rows

#: The mark that stands for a space, and how far below the worst entry an unknown character scores.
MARK, PENALTY = "▁", 10.0

#: Units of text remembered by a task before the older half goes, and characters beyond which a unit is not.
UNITS, LONG = 200_000, 100


def load_pieces(path: str) -> tuple[list[tuple[str, float]], bool]:
    """(entry, score) of a model file, and whether unknown characters fall back to bytes.

    Control, unknown and byte entries never match text and are left out.
    """
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    pieces = [(model.id_to_piece(i), model.get_score(i)) for i in ids
              if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    return pieces, any(map(model.is_byte, ids))


class Counter:
    """Pieces of the best segmentation of a text.

    All entries that end at a character come from one automaton, the longest
    first.  A later one replaces the best so far only if it scores more, so among
    equal scores the longest last entry wins.  A character that is no entry may
    be taken as unknown, at ``PENALTY`` below the worst entry; it counts one piece
    per UTF-8 byte, or, without byte entries, one per run of unknown characters.
    """

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool, units: int = UNITS):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - PENALTY
        self.bytes, self.most = byte_fallback, units
        # No entry continues over a mark, so the best path has a border before each run of marks.
        self.splits = all(MARK not in piece.lstrip(MARK) for piece, _ in pieces)
        self.forget()

    def forget(self) -> None:
        """Empties the tables of units met."""
        self.units: dict[str, int] = {}
        self.before: dict[str, int] = {}

    def best(self, text: str) -> int:
        """Pieces of the best path over text whose spaces are marks already."""
        found: list[list] = [[] for _ in text]
        for end, entry in self.automaton.iter(text):
            found[end].append(entry)
        scores, counts, fused = [0.0], [0], [False]
        for end, entries in enumerate(found):
            top, count, unknown, single = None, 0, False, False
            for size, score in entries:
                score += scores[end + 1 - size]
                if top is None or score > top:
                    top, count = score, counts[end + 1 - size] + 1
                single = single or size == 1
            if not single and (top is None or scores[end] + self.unknown > top):
                top, unknown = scores[end] + self.unknown, True
                count = counts[end] + (len(text[end].encode()) if self.bytes else not fused[end])
            scores.append(top)
            counts.append(count)
            fused.append(unknown)
        return counts[-1]

    def unit(self, chunk: str) -> int:
        if len(chunk) > LONG:
            return self.best(MARK + chunk)
        if len(self.units) >= self.most // 2:
            self.units, self.before = {}, self.units
        if (made := self.before.get(chunk)) is None:
            made = self.best(MARK + chunk)
        self.units[chunk] = made
        return made

    def count(self, text: str) -> int:
        """Pieces of a text with a mark before it and for each of its spaces; none for an empty one."""
        if not text:
            return 0
        if not self.splits:
            return self.best(MARK + text.replace(" ", MARK))
        chunks = text.split(" ")
        if MARK in text or "" in chunks:
            return sum(map(self.best, re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))))
        counts = list(map(self.units.get, chunks))
        if None in counts:
            counts = [self.unit(c) if n is None else n for c, n in zip(chunks, counts)]
        return sum(counts)


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One per worker process; its automaton does not grow, and every task fills tables of its own."""
    return Counter(*load_pieces(path))


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens of every row's text (null or empty: 0).

    Repeated rows give repeated rows; other columns are left out.  The model file
    must lie at ``path`` on every executor.
    """
    def make():
        known = copy(counter(path))
        known.forget()
        count = known.count
        return lambda text: (count(text or ""),)

    return map_rows(df, make, [text_col], [id_col], [T.StructField("n_tokens", T.LongType())])
