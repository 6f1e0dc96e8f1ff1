"""Token counts of a unigram tokenizer without building its tokens.

An Aho-Corasick automaton reports every vocabulary piece that ends at each place of a word. Dynamic
programming keeps, per place, the best score and the number of pieces on the way there; nothing is traced
back. The rules are those of the tokenizers library's unigram model: a piece replaces another only when its
path scores strictly higher, so of equal paths the one whose last piece starts first stays; a character
without a piece of its own costs the lowest score less ten and, where the vocabulary has byte pieces, counts
one piece a byte. Texts are split before every space, which is written as a mark at a word's front.
"""

from __future__ import annotations

import math

import ahocorasick
import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "▁"
#: What an unknown character scores below the lowest piece; the libraries' constant.
UNKNOWN_PENALTY = 10.0
#: Words remembered with their counts before the memory is emptied.
REMEMBERED = 400_000
#: Characters that are split and looked up at a time.
CHUNK = 1 << 20


def vocabulary(path: str) -> tuple[list[tuple[str, float]], bool]:
    """Pieces that match text with their scores, and whether bytes stand in for unknown characters."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    pieces = [(model.id_to_piece(i), model.get_score(i)) for i in ids if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
    return pieces, any(model.is_byte(i) for i in ids)


class Counter:
    """Best scores and piece counts of words under a unigram vocabulary."""

    def __init__(self, pieces: list[tuple[str, float]], bytes_stand_in: bool, lowest: float | None = None):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        if pieces:
            self.automaton.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.any = bool(pieces)
        self.unknown = (min((s for _, s in pieces), default=0.0) if lowest is None else lowest) - UNKNOWN_PENALTY
        self.bytes_stand_in = bytes_stand_in
        self._empty()

    def _empty(self) -> None:
        self.index: dict[str, int] = {}
        self.scores, self.counts = np.zeros(REMEMBERED), np.zeros(REMEMBERED, np.int64)

    def word(self, word: str) -> tuple[float, int]:
        """Score and number of pieces of the best segmentation of one word."""
        size = len(word)
        best, count = [-math.inf] * (size + 1), [0] * (size + 1)
        best[0] = 0.0
        known, single = [False] * (size + 1), self.single
        done = 0

        def unknown_to(end: int) -> None:
            # The one-character step comes last for its end, so it only wins strictly.
            nonlocal done
            while done < end:
                at, done = done, done + 1
                if word[at] not in single:
                    score = best[at] + self.unknown
                    if score > best[done]:
                        # Without byte pieces a run of unknown characters is one piece.
                        fresh = len(word[at].encode("utf-8", "surrogatepass")) if self.bytes_stand_in else not known[at]
                        best[done], count[done], known[done] = score, count[at] + fresh, True

        if self.any:
            for last, (length, score) in self.automaton.iter(word):
                end = last + 1
                unknown_to(last)
                score += best[end - length]
                if score > best[end]:
                    best[end], count[end], known[end] = score, count[end - length] + 1, False
        unknown_to(size)
        return best[size], count[size]

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores and counts of whole texts."""
        scores, counts = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        held: list[list[str]] = []
        size, first = 0, 0
        for n, text in enumerate(texts):
            held.append(words(text))
            size += len(text)
            if size >= CHUNK or n == len(texts) - 1:
                flat = [w for some in held for w in some]
                for at in range(0, len(flat), REMEMBERED // 2):
                    self._learn(flat[at : at + REMEMBERED // 2])
                    part = np.fromiter(map(self.index.__getitem__, flat[at : at + REMEMBERED // 2]), np.int64)
                    owner = np.repeat(np.arange(first, n + 1), [len(s) for s in held])[at : at + REMEMBERED // 2]
                    scores += np.bincount(owner, self.scores[part], len(texts))
                    counts += np.bincount(owner, self.counts[part], len(texts)).astype(np.int64)
                held, size, first = [], 0, n + 1
        return scores, counts

    def _learn(self, flat: list[str]) -> None:
        new = [w for w in set(flat) if w not in self.index]
        if len(self.index) + len(new) > REMEMBERED:
            self._empty()
            new = list(set(flat))
        for w in new:
            at = self.index[w] = len(self.index)
            self.scores[at], self.counts[at] = self.word(w)


def words(text: str) -> list[str]:
    """The words of a text, each with the mark at its front; further spaces are words of their own."""
    if not text:
        return []
    parts = text.replace(MARK, " ").split(" ")
    # A space at the very front is the first word's own mark.
    return [MARK + p for p in (parts[1:] if not parts[0] else parts)]


_LOADED: dict[str, Counter] = {}


def loaded(path: str) -> Counter:
    """The counter of a vocabulary file, kept by the Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Counter(*vocabulary(path))
    return _LOADED[path]


def token_counts(text: Column, path: str) -> Column:
    """A struct ``(n_tokens, score)`` per text; a null or empty text has no tokens and score 0.

    ``path`` names a sentencepiece vocabulary that every node can read; its pieces and scores are taken as
    a unigram model, whatever kind of model it was made as.
    """

    @F.pandas_udf("n_tokens long, score double")
    def count(texts: pd.Series) -> pd.DataFrame:
        scores, counts = loaded(path).texts(["" if t is None else t for t in texts])
        return pd.DataFrame({"n_tokens": counts, "score": scores})

    return count(text)
